"""Line deduplication across documents with DataFrame functions only.

Lines are exploded with their position, their normalised form is hashed, and
the documents of each hash are counted. Of lines found in too many documents
the positions to drop are gathered by document and taken out of the split
text, so lines are reassembled by position and no line travels as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, written

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    """White space of ASCII off both ends, A-Z to a-z."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


#: A document is an id and its text: rows that repeat an id with another text lose their own lines.
OWN = ["doc_id", "own__"]


def occurrences(documents: DataFrame, *, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, own__ (hash of the text), pos, h1, h2: the lines whose key is long enough, under 128 bits of hash.

    Two 64-bit hashes of the key under different seeds make a false match
    improbable for up to about 2^60 different lines.
    """
    lines = documents.where(F.char_length("text") >= min_chars).select("doc_id", F.xxhash64("text").alias("own__"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # Lower case does not change the length, so the filter needs no key.
    long = lines.where((F.octet_length("line") >= min_chars) & (F.char_length(F.btrim("line", F.lit(ASCII_SPACE))) >= min_chars))
    key = line_key(F.col("line"))
    return long.select(*OWN, "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def dropped_positions(documents: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """OWN and the array gone__ of positions to drop; documents without any are absent.

    Counts are pre-aggregated by (key, document), then by key, before each
    shuffle, so a line of a third of all documents is a row for each task.
    """
    seen = written(occurrences(documents, min_chars=min_chars).where("doc_id is not null"), "line-keys")
    by_doc = seen.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    common = by_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder")).where(F.col("n_docs") >= min_docs)
    common = written(common, "line-common")
    hit = seen.join(common, ["h1", "h2"]).where("doc_id <> holder")
    return hit.groupBy(*OWN).agg(F.collect_set("pos").alias("gone__"))


def dedup_lines(documents: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns, with text rebuilt, and n_lines and n_dropped beside it.

    A line goes if its key has at least min_chars code points and is in at
    least min_docs different doc_ids, but stays in the largest doc_id that
    holds it. A null or empty text is one empty line. Rows that repeat a
    doc_id count as one document, and each loses the lines of its own text;
    rows without an id count for no line and stay whole. Columns named n_lines
    or n_dropped are replaced. An empty table gives an empty result.
    """
    names = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    gone = written(dropped_positions(documents, min_chars=min_chars, min_docs=min_docs), "line-drops")
    # A merge join at every size: what is dropped grows with the texts, and each document has one row on its side.
    both = documents.select(*names).withColumn("own__", F.xxhash64("text")).join(gone.hint("merge"), OWN, "left")
    # array_except hashes the positions, so a text of very many lines costs as much a line as a short one.
    lines = _lines(F.col("text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines__") - 1), F.col("gone__")), lambda at: F.get(F.col("lines__"), at))
    # Spark splits no text here that loses nothing.
    both = both.withColumn("lines__", F.when(F.col("gone__").isNotNull(), lines))
    text = F.when(F.col("gone__").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.concat_ws("\n", kept))
    newlines = F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("")))
    out = both.withColumn("n_lines", (newlines + 1).cast("bigint")).withColumn("n_dropped", F.coalesce(F.size("gone__"), F.lit(0)).cast("bigint"))
    return out.withColumn("text", text).select(*names, "n_lines", "n_dropped")
