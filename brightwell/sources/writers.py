"""Sinks: tables, page texts, nested documents, rolling results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def once(df: DataFrame, path: str) -> None:
    """Write unless the path exists."""
    df.write.mode("ignore").parquet(path)


def bundle(folder: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def rolling_result(df: DataFrame, path: str) -> None:
    """The newest state as one JSON line, replacing the last; df has one row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def page_texts(elements: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(doc_id, page_no, markdown): a page's element texts in order."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return elements.where("text IS NOT NULL").groupBy("doc_id", "page_no").agg(F.array_join(F.transform(parts, lambda p: p["text"]), separator).alias("markdown"))


def page_list(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, markdown_pages): pages in order; a document without pages gives its whole text as one. documents: doc_id, text."""
    lists = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "markdown"))), lambda p: p["markdown"]).alias("found"))
    return documents.join(lists, "doc_id", "left").select("doc_id", F.coalesce("found", F.array(F.coalesce("text", F.lit("")))).alias("markdown_pages"))


def split_pages(documents: DataFrame, separator: str) -> DataFrame:
    """(doc_id, page_no, markdown) of texts cut at a separator."""
    return documents.select("doc_id", F.posexplode(F.split("text", F.lit("\\Q" + separator + "\\E"))).alias("p", "markdown")).select("doc_id", (F.col("p") + 1).alias("page_no"), "markdown")


def describe_images(pages: DataFrame, descriptions: DataFrame, marker: str = "<!-- image -->", end: str = "<!-- end image description -->") -> DataFrame:
    """Pages whose n-th image marker is followed by the n-th description of the page. descriptions: doc_id, page_no, ord, text."""
    lists = descriptions.groupBy("doc_id", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda d: F.concat(F.lit(marker + "\n**AI-Generated Image Description:** "), d["text"], F.lit(f"\n{end}\n"))).alias("d"))
    return pages.join(lists, ["doc_id", "page_no"], "left").withColumn("markdown", F.when(F.col("d").isNull(), F.col("markdown")).otherwise(tx.fill_placeholders(F.col("markdown"), marker, F.col("d")))).drop("d")


def structured_document(pages: DataFrame, schema_name: str) -> DataFrame:
    """(doc_id, tree): a minimal nested document as JSON, one text over each page. pages: doc_id, page_no, markdown, width, height."""
    box = F.struct(F.lit(0).alias("l"), F.lit(0).alias("t"), F.col("width").alias("r"), F.col("height").alias("b"), F.lit("TOPLEFT").alias("coord_origin"))
    ref = F.format_string("#/texts/%d", F.col("page_no") - 1)
    node = F.struct(
        ref.alias("self_ref"), F.lit("#/body").alias("parent"), F.lit("body").alias("content_layer"), F.lit("text").alias("label"),
        F.array(F.struct("page_no", box.alias("bbox"), F.array(F.lit(0), F.char_length("markdown")).alias("charspan"))).alias("prov"), F.col("markdown").alias("orig"), F.col("markdown").alias("text"),
    )
    lists = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", node.alias("n")))).alias("t"), F.count(F.lit(1)).alias("n"))
    mime = F.when(F.col("n") > 1, "application/pdf").otherwise("image/*")
    texts = F.transform("t", lambda x: x["n"])
    tree = F.struct(F.lit(schema_name).alias("schema_name"), F.col("doc_id").cast("string").alias("name"), F.struct(mime.alias("mimetype")).alias("origin"), F.transform(texts, lambda x: x["self_ref"]).alias("body"), texts.alias("texts"))
    return lists.select("doc_id", F.to_json(tree).alias("tree"))


def split_images(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents without images, page_images): pages array<struct<page_no, markdown, image>> loses its images to a table of their own."""
    images = documents.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page_no", "p.image").where("image IS NOT NULL")
    return documents.withColumn("pages", F.transform("pages", lambda p: p.dropFields("image"))), images


def image_list(elements: DataFrame) -> DataFrame:
    """(doc_id, ref, page_no) of pictures in order; page 1 where none is known."""
    return elements.where("kind = 'picture'").select("doc_id", "ref", F.coalesce("page_no", F.lit(1)).alias("page_no"))
