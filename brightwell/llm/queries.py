"""The queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, licenses, line_dedup, quality, sentencepieces, sharding, simhash, token_files, warc
from .common import LOWER, UPPER, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(table(spark, sf_dir, "documents"), keep="max")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), shards=sharding.topology(8), grown=sharding.topology(9))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_licenses, op3_exact_dedup, op4_simhash, op5_warc, op6_sharding, op7_line_dedup, op8_sentencepiece, op9_token_files, op10_decontaminate)}

_LOWERED = f"translate({{}}, '{UPPER}', '{LOWER}')"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _licence_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    words = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    given = ", ".join(f"({', '.join(map(quoted, t))})" for t in licenses.TEMPLATES)
    sizes = ", ".join(f"({n}, {size}, {stride})" for n in range(1, 200) for size, stride, _ in [licenses.windows_for(n)])
    return f"""
        WITH given(template, license, body) AS (VALUES {given}),
        sizes(n, size, stride) AS (VALUES {sizes}),
        tw AS (SELECT template, license, {words.format('body')} AS w FROM given),
        ts AS (SELECT DISTINCT template, license, array_to_string(w[p + 1 : p + 5], ' ') AS g FROM (SELECT *, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM tw)),
        t AS (SELECT ts.*, c.n, size, stride FROM ts JOIN (SELECT template, count(*) AS n FROM ts GROUP BY template) c USING (template) JOIN sizes USING (n)),
        dw AS (SELECT doc_id, {words.format('text')} AS w FROM documents),
        ds AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 5], ' ') AS g FROM (SELECT *, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM dw WHERE len(w) > 0)),
        hits AS (SELECT doc_id, template, license, n, g, unnest(range(greatest(0, (p - size + stride) // stride), p // stride + 1)) * stride AS start FROM ds JOIN t USING (g)),
        win AS (SELECT doc_id, template, license, start, count(DISTINCT g) / any_value(n)::DOUBLE AS c FROM hits GROUP BY ALL)
        SELECT doc_id, template, license, max(c) AS containment, count(*) AS n_windows, min(start)::INTEGER AS first_word
        FROM win WHERE c >= {licenses.CONTAINMENT} GROUP BY doc_id, template, license"""


def _leak_sql() -> str:
    words = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"
    parts = "(SELECT DISTINCT {0}, array_to_string(w[p + 1 : p + 5], ' ') AS g FROM (SELECT *, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM (SELECT {0}, {1} AS w FROM {2}) WHERE len(w) > 0))"
    return f"""
        WITH i AS {parts.format('item_id', words, 'benchmark')}, d AS {parts.format('doc_id', words, 'documents')},
        n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS matched, any_value(item_shingles) AS item_shingles, count(*) / any_value(item_shingles)::DOUBLE AS containment
        FROM i JOIN d USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= {decontaminate.CONTAINMENT} * any_value(item_shingles) - 1e-9"""


ORACLE_SQL = {
    "op2_licenses": _licence_sql(),
    "op3_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWERED.format("coalesce(text, '')")} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY t)""",
    "op5_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
        r AS (SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, n >= {warc.REVISIT_BYTES} AND page_id > min(page_id) OVER (PARTITION BY h) AS again, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r""",
    "op7_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, {_LOWERED.format(f"trim(line, {_SPACES})")} AS key FROM l),
        c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
        m AS (SELECT k.*, holder IS NOT NULL AND holder <> doc_id AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op10_decontaminate": _leak_sql(),
}
