"""Layout queries: pages of boxes made from order lines and parts, and texts of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import layout
from .metric_queries import LINES, lines
from .registry import query, read, rounded

# Fixture rows as (SQL, Spark) pairs: an order is a page, its lines are elements and regions.
_X, _Y = "(l_partkey % 61) / 100.0::DOUBLE", "(l_suppkey % 47) / 50.0::DOUBLE"
ELEMENTS = f"""SELECT 'd' || (l_orderkey % 50) AS doc_id, l_orderkey AS page_no, '#/' || l_orderkey || '/' || l_linenumber AS ref, l_linenumber AS ord, CASE WHEN l_linenumber = 3 THEN 'table' ELSE 'text' END AS kind,
    CASE l_linenumber WHEN 1 THEN 'page_header' WHEN 2 THEN 'page_footer' WHEN 3 THEN 'table' WHEN 4 THEN 'formula' ELSE 'text' END AS label, CASE WHEN l_partkey % 3 = 0 THEN 'page ' || l_partkey ELSE l_partkey::VARCHAR END AS text,
    {_X} AS l, {_Y} AS t, {_X} + 0.1 + l_quantity / 200 AS r, {_Y} + 0.02 + l_quantity / 1000 AS b FROM {LINES}"""
REGIONS = f"""SELECT 'd' || (l_orderkey % 50) AS doc_id, l_orderkey AS page_no, l_linenumber AS ord, CASE WHEN l_linenumber % 3 = 0 THEN 'table' WHEN l_linenumber = 2 THEN 'title' ELSE 'text' END AS label,
    {_X} + 0.02 AS l, {_Y} - 0.01 AS t, {_X} + 0.12 + (l_quantity % 7) / 50 AS r, {_Y} + 0.03 AS b, CASE WHEN l_partkey % 11 = 0 THEN '[Image]' ELSE 'region ' || l_partkey END AS text FROM {LINES}"""


def _xy():
    return F.col("l_partkey") % 61 / 100.0, F.col("l_suppkey") % 47 / 50.0


def elements(spark, sf):
    x, y = _xy()
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    label = F.when(n == 1, "page_header").when(n == 2, "page_footer").when(n == 3, "table").when(n == 4, "formula").otherwise("text")
    text = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("page "), F.col("l_partkey"))).otherwise(F.col("l_partkey").cast("string"))
    return lines(spark, sf).select(F.concat(F.lit("d"), F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_orderkey").alias("page_no"), F.concat(F.lit("#/"), "l_orderkey", F.lit("/"), n).alias("ref"), n.alias("ord"),
        F.when(n == 3, "table").otherwise("text").alias("kind"), label.alias("label"), text.alias("text"), x.alias("l"), y.alias("t"), (x + 0.1 + q / 200).alias("r"), (y + 0.02 + q / 1000).alias("b"))


def regions(spark, sf):
    x, y = _xy()
    n = F.col("l_linenumber")
    text = F.when(F.col("l_partkey") % 11 == 0, "[Image]").otherwise(F.concat(F.lit("region "), F.col("l_partkey")))
    return lines(spark, sf).select(F.concat(F.lit("d"), F.col("l_orderkey") % 50).alias("doc_id"), F.col("l_orderkey").alias("page_no"), n.alias("ord"), F.when(n % 3 == 0, "table").when(n == 2, "title").otherwise("text").alias("label"),
        (x + 0.02).alias("l"), (y - 0.01).alias("t"), (x + 0.12 + F.col("l_quantity") % 7 / 50).alias("r"), (y + 0.03).alias("b"), text.alias("text"))


_PUNCT = tx.PUNCTUATION.replace("'", "''")
_TOK = "list_filter(regexp_split_to_array(line, '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}]+'), lambda x: x <> '')"


@query(
    f"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), t AS (SELECT doc_id, pos, {_TOK} AS ts FROM s),
    n AS (SELECT doc_id, pos, len(ts)::DOUBLE AS n, len(list_filter(ts, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{3,}}') OR regexp_matches(x, '[A-Za-z0-9]{{5,}}'))) AS wordy, len(list_filter(ts, lambda x: regexp_matches(trim(x, '{_PUNCT}'), '^[\\p{{L}}\\p{{N}}]$'))) AS single,
        len(list_filter(ts, lambda x: length(trim(x, '{_PUNCT}')) <= 2)) AS short, len(list_filter(ts, lambda x: regexp_matches(x, '[^\\p{{L}}\\p{{N}}_\\s]{{2,}}'))) > 0 AS broken FROM t)
    SELECT doc_id, pos::INTEGER AS pos, n >= 4 AND wordy / n < 0.5 AND (single / n >= 0.2 OR short / n >= 0.5 OR broken) AS garbled FROM n"""
)
def garble_flags(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("doc_id", "pos", tx.is_garbled(F.col("line")).alias("garbled"))


@query("SELECT source AS doc_id, doc_id AS page_no, (sum(length(regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', ''))) + sum(length(lang)) + 5 * count(*))::BIGINT AS chars FROM documents GROUP BY 1, 2")
def char_counts(spark, sf):
    d = read(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), "text", F.lit("text").alias("label"))
    # A table cell on each page.
    cells = read(spark, sf, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_no"), F.concat(F.lit("  cell "), "lang", F.lit(" ")).alias("text"))
    return layout.native_chars(d, cells)


@query("SELECT s_suppkey % 7 AS doc_id, s_suppkey AS page_no FROM supplier WHERE abs(s_acctbal) / 10 >= 400 * 0.8")
def image_backed_pages(spark, sf):
    s = read(spark, sf, "supplier").select((F.col("s_suppkey") % 7).alias("doc_id"), F.col("s_suppkey").alias("page_no"), (F.abs("s_acctbal") / 10).alias("w"), F.lit(1.0).alias("h"), F.lit(20.0).alias("page_w"), F.lit(20.0).alias("page_h"))
    return layout.image_backed_pages(s.select("doc_id", "page_no", "w", "h"), s.select("doc_id", "page_no", "page_w", "page_h"))


@query("WITH h AS (SELECT doc_id, (48271 * doc_id + 11) % 2147483647 AS h, text FROM documents WHERE length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) > 80) SELECT doc_id, left(text, 2000) AS text FROM h ORDER BY h, doc_id LIMIT 100")
def doc_prefix_filter(spark, sf):
    from ..sources import readers

    return readers.filtered_corpus(read(spark, sf, "documents"), 100)


_ALIAS = "CASE {k} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tx.LABEL_ALIASES.items()) + " END"
_LABELS = ("title", "text", "Paragraph ", "figure", "code", "list", "table", "equation", "image_caption", "footnote", "strange", "")


@query(
    f"""WITH x AS (SELECT p_partkey, [{', '.join(f"'{s}'" for s in _LABELS)}][p_partkey % 12 + 1] AS label, p_size / 51.0::DOUBLE AS m FROM part), k AS (SELECT p_partkey, lower(trim(label)) AS k, m FROM x)
    SELECT p_partkey, CASE WHEN k IN ({', '.join(f"'{s}'" for s in tx.PASS_LABELS)}) THEN k ELSE coalesce({_ALIAS.format(k='k')}, CASE WHEN m < 0.07 THEN 'page_header' WHEN m > 0.93 THEN 'page_footer' ELSE 'text' END) END AS label FROM k"""
)
def resolve_labels(spark, sf):
    label = F.get(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % 12).cast("int"))
    return read(spark, sf, "part").select("p_partkey", tx.resolve_label(label, F.col("p_size") / 51.0, F.col("p_size") / 51.0).alias("label"))


@query(f"SELECT ref, CASE WHEN (length(text) > 15 OR contains(text, ' ')) AND (label = 'page_footer' AND (t + b) / 2 <= 0.93 OR label = 'page_header' AND (t + b) / 2 >= 0.07) THEN 'text' ELSE label END AS label FROM ({ELEMENTS})")
def correct_furniture(spark, sf):
    return layout.correct_furniture(elements(spark, sf)).select("ref", "label")


_HOLDS = "(e.l + e.r) / 2 BETWEEN g.l - 1e-6 AND g.r + 1e-6 AND (e.t + e.b) / 2 BETWEEN g.t - 1e-6 AND g.b + 1e-6"
_I = "greatest(least(e.r, g.r) - greatest(e.l, g.l), 0) * greatest(least(e.b, g.b) - greatest(e.t, g.t), 0)"
_PIOU = f"{_I} / ((e.r - e.l) * (e.b - e.t) + (g.r - g.l) * (g.b - g.t) - {_I})"
_BEST = f"""c AS (SELECT e.doc_id, e.page_no, e.ref, e.kind, g.ord AS region_ord, g.l AS gl, g.t AS gt, g.r AS gr, g.b AS gb, (g.label = 'table') = (e.kind = 'table') AS same, {_HOLDS} AS holds, {_PIOU} AS iou, (g.r - g.l) * (g.b - g.t) AS size FROM e JOIN g ON g.doc_id = e.doc_id AND g.page_no = e.page_no),
    f AS (SELECT * FROM c WHERE holds OR iou >= 0.1)"""


@query(f"WITH e AS ({ELEMENTS}), g AS ({REGIONS}), {_BEST} SELECT ref, region_ord FROM f QUALIFY row_number() OVER (PARTITION BY ref ORDER BY holds DESC, CASE WHEN holds THEN size ELSE -iou END, region_ord) = 1")
def best_region(spark, sf):
    return layout.best_region(elements(spark, sf), regions(spark, sf)).select("ref", "region_ord")


@query(f"WITH e AS ({ELEMENTS}), g AS ({REGIONS}), {_BEST} SELECT ref, region_ord FROM f QUALIFY row_number() OVER (PARTITION BY ref ORDER BY same DESC, holds DESC, CASE WHEN holds THEN size ELSE -iou END, region_ord) = 1")
def best_region_of_kind(spark, sf):
    return layout.best_region_of_kind(elements(spark, sf), regions(spark, sf)).select("ref", "region_ord")


_UNMAPPED = f"""WITH e AS (SELECT * FROM ({ELEMENTS}) WHERE ord <= 3), g AS ({REGIONS}), x AS (SELECT * FROM ({ELEMENTS}) WHERE ord = 4)
    SELECT g.page_no, g.ord FROM g WHERE g.label <> 'table' AND g.text <> '[Image]' AND g.r - g.l >= 0.004 AND g.b - g.t >= 0.004
    AND NOT EXISTS (SELECT 1 FROM e WHERE e.page_no = g.page_no AND ((g.l + g.r) / 2 BETWEEN e.l AND e.r AND (g.t + g.b) / 2 BETWEEN e.t AND e.b OR {_PIOU} >= 0.1))
    AND NOT EXISTS (SELECT 1 FROM x WHERE x.page_no = g.page_no AND (g.l + g.r) / 2 BETWEEN x.l AND x.r AND (g.t + g.b) / 2 BETWEEN x.t AND x.b)"""


@query(_UNMAPPED)
def unmapped_regions(spark, sf):
    e = elements(spark, sf)
    return layout.unmapped_regions(regions(spark, sf), e.where("ord <= 3"), e.where("ord = 4")).select("page_no", "ord")


@query(
    f"""WITH g AS ({REGIONS}), x AS (SELECT * FROM ({ELEMENTS}) WHERE ord = 4), m AS (SELECT page_no, max(ord) AS last FROM g GROUP BY 1)
    SELECT page_no, ord, label, text FROM g WHERE label = 'table' OR NOT EXISTS (SELECT 1 FROM x WHERE x.page_no = g.page_no AND (g.l + g.r) / 2 BETWEEN x.l AND x.r AND (g.t + g.b) / 2 BETWEEN x.t AND x.b)
    UNION ALL SELECT x.page_no, (last + 1)::INTEGER, 'formula', x.text FROM x JOIN m USING (page_no)"""
)
def inject_formulas(spark, sf):
    f = elements(spark, sf).where("ord = 4").select("doc_id", "page_no", F.lit(0).alias("ord"), "l", "t", "r", "b", F.col("text").alias("latex"))
    return layout.inject_formulas(regions(spark, sf), f).select("page_no", "ord", "label", "text")


@query(
    f"""WITH g AS (SELECT * FROM ({REGIONS})), r AS (SELECT *, (t + b) / 2 AS m, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, ord) - 1 AS place FROM g)
    SELECT doc_id, page_no, place::INTEGER AS ord, CASE WHEN label = 'table' THEN 'table' ELSE 'text' END AS kind, CASE label WHEN 'table' THEN 'table' WHEN 'title' THEN 'section_header' ELSE CASE WHEN m < 0.07 THEN 'page_header' WHEN m > 0.93 THEN 'page_footer' ELSE 'text' END END AS label FROM r"""
)
def build_elements(spark, sf):
    return layout.build_elements(regions(spark, sf)).select("doc_id", "page_no", "ord", "kind", "label")


# Points from the bottom left: elements of a page stacked by hash.
_POINTS = f"""SELECT 'd' AS doc_id, l_orderkey AS page_no, '#/' || l_orderkey || '/' || l_linenumber AS ref, l_linenumber AS ord, CASE WHEN l_linenumber <= 2 THEN 'table' ELSE 'text' END AS kind, CASE WHEN l_linenumber <= 2 THEN 'table' WHEN l_linenumber = 5 THEN 'footnote' ELSE 'text' END AS label,
    CASE WHEN l_partkey % 2 = 0 THEN '  † note' ELSE 'plain' END AS text, (l_suppkey % 90)::DOUBLE AS l, (l_partkey % 97 + 30)::DOUBLE AS t, l_suppkey % 90 + 60 + l_quantity AS r, (l_partkey % 97)::DOUBLE AS b FROM {LINES}"""


@query(
    f"""WITH e AS ({_POINTS}) SELECT a.ref AS table_ref, n.ref AS note_ref FROM e a JOIN e n ON a.page_no = n.page_no AND a.kind = 'table' AND n.kind = 'text' AND (n.label = 'footnote' OR regexp_matches(n.text, '^\\s*[∗*†‡§¶⁎⋆]'))
    AND greatest(n.t, n.b) BETWEEN least(a.t, a.b) - 24 AND least(a.t, a.b) + 2 AND (n.l + n.r) / 2 BETWEEN a.l - 2 AND a.r + 2"""
)
def table_footnotes(spark, sf):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    e = lines(spark, sf).select(F.lit("d").alias("doc_id"), F.col("l_orderkey").alias("page_no"), F.concat(F.lit("#/"), "l_orderkey", F.lit("/"), n).alias("ref"), n.alias("ord"), F.when(n <= 2, "table").otherwise("text").alias("kind"), F.when(n <= 2, "table").when(n == 5, "footnote").otherwise("text").alias("label"),
        F.when(p % 2 == 0, "  † note").otherwise("plain").alias("text"), (F.col("l_suppkey") % 90).cast("double").alias("l"), (p % 97 + 30).cast("double").alias("t"), (F.col("l_suppkey") % 90 + 60 + F.col("l_quantity")).alias("r"), (p % 97).cast("double").alias("b"))
    return layout.table_footnotes(e).select("table_ref", "note_ref")


# A user's events as a document: titles, steps and prose by event type.
_TITLES = """SELECT user_id AS doc_id, event_id::VARCHAR AS ref, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, CASE event_type WHEN 'signup' THEN 'section_header' WHEN 'purchase' THEN 'section_header' WHEN 'error' THEN 'paragraph' ELSE 'list_item' END AS label,
    CASE event_type WHEN 'signup' THEN 'Algorithm ' || event_id || ' sort' WHEN 'purchase' THEN 'Box ' || event_id WHEN 'click' THEN '1. step' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'Require: x' ELSE 'prose' END ELSE 'prose' END AS text FROM events"""
_ENV = f"""e AS ({_TITLES}), c AS (SELECT *, label = 'section_header' AS cap, label = 'section_header' AND text LIKE 'Algorithm%' AS alg, label = 'list_item' AND text <> 'prose' AS step FROM e),
    o AS (SELECT *, last_value(CASE WHEN NOT step THEN {{'alg': alg, 'ref': ref}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS own FROM c),
    v AS (SELECT doc_id, ref, ord, CASE WHEN cap THEN 'caption' WHEN step AND coalesce(own.alg, FALSE) THEN 'code' ELSE label END AS label, CASE WHEN cap THEN ref WHEN step AND coalesce(own.alg, FALSE) THEN own.ref END AS caption_ref, text FROM o)"""


def _titles(spark, sf):
    from pyspark.sql import Window as W

    k, i = F.col("event_type"), F.col("event_id")
    label = F.when(k.isin("signup", "purchase"), "section_header").when(k == "error", "paragraph").otherwise("list_item")
    text = F.when(k == "signup", F.concat(F.lit("Algorithm "), i, F.lit(" sort"))).when(k == "purchase", F.concat(F.lit("Box "), i)).when(k == "click", "1. step").when((k == "view") & (i % 2 == 0), "Require: x").otherwise("prose")
    return read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), i.cast("string").alias("ref"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("ord"), label.alias("label"), text.alias("text"), F.lit("text").alias("kind"), F.lit("#/body").alias("parent_ref"))


@query(f"WITH {_ENV} SELECT doc_id, ref, label, caption_ref FROM v")
def structured_environments(spark, sf):
    return layout.structured_environments(_titles(spark, sf)).select("doc_id", "ref", "label", "caption_ref")


@query(
    f"""WITH {_ENV}, n AS (SELECT *, caption_ref IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, caption_ref) > 1 AS grouped, row_number() OVER (PARTITION BY doc_id, caption_ref ORDER BY ord) - 1 AS inside FROM v)
    SELECT doc_id, ref, CASE WHEN grouped THEN '#/env/' || caption_ref ELSE '#/body' END AS parent_ref, CASE WHEN grouped THEN inside ELSE ord END::INTEGER AS ord, label FROM n
    UNION ALL SELECT doc_id, '#/env/' || ref, '#/body', ord::INTEGER, 'unspecified' FROM n WHERE grouped AND ref = caption_ref"""
)
def group_environments(spark, sf):
    return layout.group_environments(layout.structured_environments(_titles(spark, sf))).select("doc_id", "ref", "parent_ref", "ord", "label")


# A user's events as a first page in points from the bottom left: two signups are headers, clicks between them the band.
_FIRST = """SELECT user_id AS doc_id, event_id::VARCHAR AS ref, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord, CASE WHEN event_type = 'signup' THEN 'section_header' WHEN event_type = 'click' THEN 'text' ELSE 'list_item' END AS label, (event_id * 37 % 500)::DOUBLE AS l, (event_id * 101 % 7919 / 10)::DOUBLE AS y FROM events"""


def _authors(events):
    from pyspark.sql import Window as W

    k, i = F.col("event_type"), F.col("event_id")
    y = (i * 101 % 7919 / 10).cast("double")
    e = events.select(F.col("user_id").alias("doc_id"), i.cast("string").alias("ref"), F.lit("#/body").alias("parent_ref"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("ord"), F.lit("text").alias("kind"),
        F.when(k == "signup", "section_header").when(k == "click", "text").otherwise("list_item").alias("label"), F.lit(1).alias("page_no"), (i * 37 % 500).cast("double").alias("l"), y.alias("t"), y.alias("b"))
    return layout.reorder_authors(e).select("doc_id", "ref", "ord")


@query(
    f"""WITH e AS ({_FIRST}), h AS (SELECT doc_id, ref, y FROM e WHERE label = 'section_header' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, ord) <= 2),
    b AS (SELECT doc_id, arg_max(ref, y) AS title, max(y) AS hi, min(y) AS lo FROM h GROUP BY 1 HAVING count(*) = 2 AND max(y) > min(y)),
    m AS (SELECT e.doc_id, ref, title, y, l, e.ord FROM e JOIN b USING (doc_id) WHERE label = 'text' AND y > lo AND y < hi), k AS (SELECT doc_id FROM m GROUP BY 1 HAVING count(*) >= 2 AND max(l) - min(l) >= 60),
    p AS (SELECT doc_id, ref, title, row_number() OVER (PARTITION BY doc_id ORDER BY -round_even(y / 16, 0), l, ord) AS place FROM m WHERE doc_id IN (SELECT doc_id FROM k)),
    q AS (SELECT e.doc_id, e.ref, coalesce(t.ord, e.ord) AS a, coalesce(p.place, 0) AS c FROM e LEFT JOIN p USING (doc_id, ref) LEFT JOIN e t ON t.doc_id = p.doc_id AND t.ref = p.title)
    SELECT doc_id, ref, (row_number() OVER (PARTITION BY doc_id ORDER BY a, c, ref) - 1)::INTEGER AS ord FROM q"""
)
def reorder_authors(spark, sf):
    return _authors(read(spark, sf, "events"))


@query(
    f"""WITH e AS ({ELEMENTS}), g AS (SELECT * FROM ({REGIONS}) WHERE ord % 2 = 1), {_BEST}, hit AS (SELECT ref, gl, gt, gr, gb FROM f QUALIFY row_number() OVER (PARTITION BY ref ORDER BY same DESC, holds DESC, CASE WHEN holds THEN size ELSE -iou END, region_ord) = 1),
    s AS (SELECT e.*, e.page_no % 2 = 0 AND e.page_no IN (SELECT page_no FROM g) AND (label <> 'formula' OR kind = 'table') AS open, gl, gt, gr, gb FROM e LEFT JOIN hit ON hit.ref = e.ref AND e.page_no % 2 = 0 AND (label <> 'formula' OR kind = 'table')),
    p AS (SELECT page_no, median(greatest(t - gt, 0)) AS up, median(greatest(gb - b, 0)) AS down FROM s WHERE gl IS NOT NULL AND kind <> 'table' AND (t - gt > 0 OR gb - b > 0) GROUP BY 1)
    SELECT ref, round(coalesce(gl, l), 6) AS l, round(coalesce(gt, t - CASE WHEN open AND kind <> 'table' THEN least(coalesce(up, 0), abs(t - b)) ELSE 0 END), 6) AS t, round(coalesce(gr, r), 6) AS r, round(coalesce(gb, b + CASE WHEN open AND kind <> 'table' THEN least(coalesce(down, 0), abs(t - b)) ELSE 0 END), 6) AS b FROM s LEFT JOIN p USING (page_no)"""
)
def snap_to_regions(spark, sf):
    e = elements(spark, sf)
    return rounded(layout.snap_to_regions(e, regions(spark, sf).where("ord % 2 = 1"), e.where("page_no % 2 = 0").select("doc_id", "page_no")).select("ref", "l", "t", "r", "b"))


@query(
    f"""WITH e AS ({ELEMENTS}), p AS (SELECT page_no, coalesce(median(ord / 1000.0::DOUBLE), 0) AS up, coalesce(median(0.005::DOUBLE), 0) AS down FROM e WHERE page_no % 3 = 0 GROUP BY 1)
    SELECT ref, round(t - least(coalesce(up, 0), abs(t - b)), 6) AS t, round(b + least(coalesce(down, 0), abs(t - b)), 6) AS b FROM e LEFT JOIN p USING (page_no)"""
)
def expand_cells(spark, sf):
    e = elements(spark, sf)
    pads = e.where("page_no % 3 = 0").select("doc_id", "page_no", (F.col("ord") / 1000.0).alias("top"), F.lit(0.005).alias("bottom"))
    return rounded(layout.expand_cells(e, pads).select("ref", "t", "b"))


@query(
    f"""WITH e AS ({ELEMENTS}), b AS (SELECT page_no, string_agg(text, ' ' ORDER BY text) AS whole FROM e GROUP BY 1), m AS (SELECT ref, count(*) OVER (PARTITION BY page_no) AS n, row_number() OVER (PARTITION BY page_no ORDER BY ord) AS k FROM e WHERE label = 'text' AND kind = 'text')
    SELECT doc_id, page_no, ref, CASE WHEN n >= 2 THEN whole ELSE text END AS text FROM e JOIN b USING (page_no) LEFT JOIN m USING (ref) WHERE n IS NULL OR n < 2 OR k = 1"""
)
def coalesce_blocks(spark, sf):
    """Each page's first block holds all numbers of its texts."""
    e = elements(spark, sf)
    blocks = e.groupBy("doc_id", "page_no").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text")).select("doc_id", "page_no", F.lit(0).alias("block"), "text", *(F.lit(v).alias(c) for c, v in zip("ltrb", (0.0, 0.0, 1.0, 1.0))))
    return layout.coalesce_blocks(e, blocks).select("doc_id", "page_no", "ref", "text")


@query(
    """SELECT 'd' AS doc_id, s_suppkey::INTEGER AS page_no, '#/t/0' AS ref, 0 AS col, s_name || ' left side' AS text, 10.0::DOUBLE AS l, 10.0::DOUBLE AS t, 90.0::DOUBLE AS r, 20.0::DOUBLE AS b FROM supplier
    UNION ALL SELECT 'd', s_suppkey::INTEGER, '#/t/0', 1, s_name || ' right', 200.0, 10.0, 290.0, 20.0 FROM supplier"""
)
def split_columns(spark, sf):
    """Texts of two lines in two columns of a page for each supplier."""
    s = read(spark, sf, "supplier").select(F.lit("d").alias("doc_id"), F.col("s_suppkey").cast("int").alias("page_no"), F.col("s_name").alias("name"))
    e = s.select("doc_id", "page_no", F.lit("#/t/0").alias("ref"), F.concat("name", F.lit(" left side "), "name", F.lit(" right")).alias("text"), F.lit(10.0).alias("l"), F.lit(10.0).alias("t"))
    rows = s.select("doc_id", "page_no", F.concat("name", F.lit(" left side")).alias("text"), *(F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (10.0, 10.0, 90.0, 20.0)))).unionByName(s.select("doc_id", "page_no", F.concat("name", F.lit(" right")).alias("text"), *(F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (200.0, 10.0, 290.0, 20.0)))))
    return layout.split_columns(e, rows)


@query(
    """WITH x AS (SELECT user_id, (event_id * 37 % 400)::DOUBLE AS x0 FROM events), l AS (SELECT user_id, list_sort(list_distinct(list(x0))) AS xs FROM x GROUP BY 1),
    s AS (SELECT user_id, list_reduce(xs, lambda a, e: CASE WHEN e - a[len(a)] <= 40 THEN a ELSE list_append(a, e) END, [xs[1]]) AS starts FROM l)
    SELECT user_id, (len(list_filter(starts, lambda e: e <= x0)) - 1)::INTEGER AS col, min(x0) AS x0, count(*)::INTEGER AS n FROM x JOIN s USING (user_id) GROUP BY 1, 2"""
)
def cluster_columns(spark, sf):
    return layout.cluster_columns(read(spark, sf, "events").select("user_id", (F.col("event_id") * 37 % 400).cast("double").alias("x0")), ["user_id"])


@query("SELECT s_suppkey::VARCHAR AS table_ref, 1 AS row, 0 AS col, s_name AS text FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 0, 1, 'Shares' FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 5, 5, 'old' FROM supplier")
def fill_table_cells(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("table_ref"), "s_name")
    html = s.select("table_ref", F.concat(F.lit("<table><tr><th>Name</th><th> Shares </th></tr><tr></tr><tr><td>"), "s_name", F.lit("</td><td></td></tr></table>")).alias("html"))
    cells = s.select("table_ref", F.explode(F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(t).alias("text")) for r, c, t in ((1, 0, "?"), (0, 1, "?"), (5, 5, "old"))))).alias("x")).select("table_ref", "x.*")
    return layout.fill_cells(cells, layout.html_grids(html))


@query(
    """WITH r AS (SELECT s_nationkey::VARCHAR AS table_ref, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k, s_name, s_suppkey FROM supplier),
    c AS (SELECT table_ref, k, 0 AS col, s_name || ' & co' AS text FROM r UNION ALL SELECT table_ref, k, 1, s_suppkey::VARCHAR FROM r WHERE s_suppkey % 3 <> 0)
    SELECT table_ref, k::INTEGER AS row, col, text FROM c"""
)
def html_outline(spark, sf):
    """A table of each nation's suppliers: entities, marks inside cells, comments and unclosed cells."""
    key = F.col("s_suppkey")
    second = F.when(key % 3 == 0, F.lit("<td>open<!-- <td>x</td> -->")).otherwise(F.concat(F.lit("<TD class='n'> <i>"), key, F.lit("</i></TD >")))
    row = F.concat(F.lit("<tr id=r><th> "), "s_name", F.lit(" &amp; co</th>"), second, F.lit("</tr><tr></tr>"))
    made = read(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("table_ref"), key, row.alias("row"))
    html = made.groupBy("table_ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "row"))), lambda r: r["row"]), "").alias("html"))
    grids = layout.html_grids(html)
    return grids.select("table_ref", F.posexplode("grid").alias("row", "cells")).select("table_ref", "row", F.posexplode("cells").alias("col", "text"))


@query("SELECT p_partkey, 'title' AS label, 0.0::DOUBLE AS l, 1.0::DOUBLE AS r, round(p_size / 999.0::DOUBLE, 6) AS b, p_name AS text FROM part UNION ALL SELECT p_partkey, 'text', round(5 / 999.0::DOUBLE, 6), round(500.5 / 999.0::DOUBLE, 6), 1.0, p_brand FROM part")
def parse_regions(spark, sf):
    raw = F.concat(F.lit("noise<|det|>title [0, 0, 1200, "), "p_size", F.lit("]<|/det|> "), "p_name", F.lit(" <|det|>[5, 5, 500.5, 2000]<|/det|>"), "p_brand", F.lit("<|det|>text [1, 2]<|/det|>short<|det|>text [1,2,3,4]<|/det|>  "))
    out = read(spark, sf, "part").select("p_partkey", F.explode(tx.parse_regions(raw)).alias("g"))
    return rounded(out.select("p_partkey", "g.label", "g.l", "g.r", "g.b", "g.text"))


@query(r"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'A_' || p_size || ' &= 1 \\ B_0 &= 2' ELSE 'A_00' || ' &= 1 \\ &= 3' END AS latex FROM part")
def dedup_latex(spark, sf):
    n = F.col("p_size")
    raw = F.when(n % 2 == 0, F.concat(F.lit("A_"), n, F.lit(r" &= 1 \\ B_0 &= 2"))).otherwise(F.lit(r" A_00 &= 1 \\ &= 3 \\ \intertext{again} A_00 &= 4"))
    return read(spark, sf, "part").select("p_partkey", tx.dedup_latex(raw).alias("latex"))


@query("SELECT doc_id, text FROM documents")
def byte_level_decode(spark, sf):
    """Texts in byte-level characters and back."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in keep]
    latin = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    coded = F.translate(latin, "".join(map(chr, rest)), "".join(chr(256 + k) for k in range(len(rest))))
    return read(spark, sf, "documents").select("doc_id", tx.byte_level_decode(coded).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '[|@#!¡·$€%&()=?¿^*;:,¨´><+]', '_', 'g') AS safe, octet_length(encode(text)) = length(text) AS ascii, regexp_matches(text, '[一-鿿]') AS chinese, regexp_replace(regexp_replace(split_part(text, ' de ', -1), '^\\s+', ''), '\\s+$', '') AS tail FROM documents")
def text_helpers(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", tx.safe_name(t).alias("safe"), tx.is_ascii(t).alias("ascii"), tx.has_chinese(t).alias("chinese"), tx.answer_after(t, " de ").alias("tail"))


@query(
    f"""WITH e AS ({ELEMENTS}), c AS (SELECT doc_id, page_no, sum(CASE WHEN label <> 'formula' THEN length(text) ELSE 0 END) + sum(CASE WHEN kind = 'table' THEN 4 ELSE 0 END) AS n FROM e GROUP BY 1, 2 HAVING bool_or(label <> 'formula'))
    SELECT doc_id, page_no, n >= 12 AND page_no % 4 <> 0 AS digital FROM c"""
)
def skip_ocr(spark, sf):
    """Each table has a cell of four characters."""
    e = elements(spark, sf)
    cells = e.where("kind = 'table'").select("doc_id", "page_no", F.lit(" cell ").alias("text"))
    return layout.skip_ocr(e, cells, e.where("page_no % 4 = 0").select("doc_id", "page_no").distinct(), 12)


@query(
    f"""WITH f AS (SELECT doc_id, page_no, ord, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, ord) AS n FROM ({ELEMENTS}) WHERE label <> 'table'), g AS (SELECT *, (n - 1) // 8 AS g FROM f WHERE n <= 60),
    b AS (SELECT doc_id, g, sum(sum(0.5)) OVER (PARTITION BY doc_id ORDER BY g) - sum(0.5) AS spent FROM g GROUP BY 1, 2)
    SELECT g.doc_id, page_no, ord FROM g JOIN b USING (doc_id, g) WHERE spent <= 22"""
)
def cap_formulas(spark, sf):
    """At most 60 formulas a document, in batches of 8 that begin within 22 seconds at half a second each."""
    f = elements(spark, sf).where("label <> 'table'").select("doc_id", "page_no", "ord", F.lit(0.5).alias("took"))
    return layout.cap_formulas(f, 60, batch=8, seconds=22.0).select("doc_id", "page_no", "ord")
