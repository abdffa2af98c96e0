"""Text, layout and detection operators on literal cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwell.functions import text as tx
from brightwell.operators import chat, detection, layout, metrics, vectors


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], list(given)) if given else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "garbled"),
    [
        ("q 7 w 3 zz 1 kk", True),  # nothing but short pieces
        ("the old q committee x will k meet j in may", False),  # half of it are words
        ("a1 b2 c3 d4 e5", True),
        ("a b c", False),  # fewer than four pieces are not judged
        ("Invoice 2024-11 for the northern branch office", False),
        ("   ", False),
        (None, False),
    ],
)
def test_garbled(spark, text, garbled):
    row = spark.createDataFrame([(text,)], "t string").select(tx.is_garbled(F.col("t")).alias("x")).first()
    assert bool(row["x"]) is garbled


def test_byte_level(spark):
    """Each printable stand-in of a byte gives its byte back; tabs and umlauts among them."""
    stand_in, spare = {}, 256
    for b in range(256):
        if 33 <= b < 127 or 161 <= b < 173 or b >= 174:
            stand_in[b] = chr(b)
        else:
            stand_in[b], spare = chr(spare), spare + 1
    for text in ("two words", "tab\there", "Größe über 3 µm", "語 and 😀"):
        assert value(spark, tx.byte_level_decode(F.col("t")), t="".join(stand_in[b] for b in text.encode())) == text


def test_regions(spark):
    raw = "skipped<|det|>table [111,222,333,444]<|/det|> cells <|det|>text [0,10,1500,20]<|/det|>wide"
    got = value(spark, tx.parse_regions(F.col("t")), t=raw)
    assert [(r["label"], r["text"]) for r in got] == [("table", "cells"), ("text", "wide")]
    assert [round(got[0][c] * 999) for c in "ltrb"] == [111, 222, 333, 444]
    assert (got[1]["l"], got[1]["r"]) == (0.0, 1.0)


def test_labels(spark):
    """Plain text becomes furniture only in the bands at the top and the foot of a page."""
    at = lambda label, middle: value(spark, tx.resolve_label(F.col("l"), F.col("m"), F.col("m")), l=label, m=middle)
    assert [at("text", y) for y in (0.01, 0.2, 0.6, 0.99)] == ["page_header", "text", "text", "page_footer"]
    assert {at("title", 0.01), at("title", 0.6)} == {"section_header"}
    assert [at(name, 0.6) for name in ("header", "footer", "equation")] == ["page_header", "page_footer", "formula"]


def grid(spark, html):
    return layout.html_grids(spark.createDataFrame([("t", html)], "table_ref string, html string")).first()["grid"]


def test_grid(spark):
    assert grid(spark, "<table><tr><td> 4 &lt; 5 </td><TD class='n'>caf&eacute; <b>noir</b></TD></tr><tr><th>x</th></tr></table>") == [["4 < 5", "café noir"], ["x"]]
    assert grid(spark, "<tr></tr><tr><td>never closed<td>closed</td></tr><tr><!-- <td>no</td> --><td></td></tr>") == [["closed"], [""]]
    assert grid(spark, "<td>before any row</td><tr><td>a<table><tr><td>inner</td></tr></table></td><td>b</td></tr>") == [["inner", "b"]]
    assert grid(spark, None) == [] and grid(spark, "no table") == []


def test_latex(spark):
    """A row whose left side was there before goes, with what follows it; rows without a left side go on."""
    of = lambda t: value(spark, tx.dedup_latex(F.col("t")), t=t)
    assert of(r"f(a) &= 2 \\ \intertext{so} f(a) &= 7") == "f(a) &= 2"
    for same in (r"u &= v \\ w &= v", r"u &= v \\ &= 3 \\ &= 4", "E = mc^2"):
        assert of(same) == same


def test_ink():
    page = np.full((1754, 1240), 255, dtype=np.uint8)
    page[400:470, 300:520] = 0
    page[800:860, 300:520] = 0
    (box,) = detection.ink_components(page, [(290, 790, 530, 870)])
    assert 250 <= box[0] <= 305 and 380 <= box[1] <= 405 and 515 <= box[2] <= 560 and 465 <= box[3] <= 490


def test_ink_joins_corners():
    page = np.full((1000, 1000), 255, dtype=np.uint8)
    page[400:450, 300:350] = 0
    page[450:500, 350:400] = 0
    assert detection.ink_components(page, []) == [(300, 400, 400, 500)]


def test_environments(spark):
    rows = [("section_header", "Algorithm 1 Sort"), ("text", "Require: x"), ("list_item", "1. a"), ("list_item", "2) b"), ("text", "prose"), ("section_header", "Box 2 note"), ("list_item", "1. c")]
    e = spark.createDataFrame([("d", f"r{k}", "#/body", k, "text", a, b) for k, (a, b) in enumerate(rows)], "doc_id string, ref string, parent_ref string, ord int, kind string, label string, text string")
    out = layout.structured_environments(e)
    assert [r["label"] for r in out.orderBy("ord").collect()] == ["caption", "code", "code", "code", "text", "caption", "list_item"]
    grouped = layout.group_environments(out)
    top = [r["ref"] for r in grouped.where("parent_ref = '#/body'").orderBy("ord").collect()]
    assert top == ["#/env/r0", "r4", "r5", "r6"]
    assert [r["ref"] for r in grouped.where("parent_ref = '#/env/r0'").orderBy("ord").collect()] == ["r0", "r1", "r2", "r3"]


def test_authors(spark):
    box = lambda ref, label, l, y, ord_, parent="#/body", kind="text": ("d", ref, parent, ord_, kind, label, 1, float(l), float(y), float(y))
    rows = [box("title", "section_header", 100, 700, 0), box("a3", "text", 400, 650, 3), box("a1", "text", 50, 651, 5), box("a2", "text", 220, 649, 0, "#/groups/0"), box("#/groups/0", "group", 0, 0, 4, kind="group"), box("stop", "section_header", 100, 500, 1), box("body", "text", 50, 400, 2)]
    schema = "doc_id string, ref string, parent_ref string, ord int, kind string, label string, page_no int, l double, t double, b double"
    out = layout.reorder_authors(spark.createDataFrame(rows, schema))
    assert [r["ref"] for r in out.orderBy("ord").collect()] == ["title", "a1", "a2", "a3", "stop", "body"]
    single = [r if r[1] not in ("a2", "a3") else (*r[:7], 60.0, *r[8:]) for r in rows]
    same = layout.reorder_authors(spark.createDataFrame(single, schema))
    assert {(r["ref"], r["parent_ref"]) for r in same.collect()} == {(r[1], r[2]) for r in single}


def test_split_columns(spark):
    """A text over three columns; one that a line is missing of, one in a single column, and a short one stay whole."""
    place = {"river": (0.0, 5.0), "bank": (0.0, 15.0), "stone": (90.0, 5.0), "bridge": (95.0, 15.0), "mill": (300.0, 8.0), "lost": (0.0, 200.0), "found": (10.0, 212.0)}
    lines = spark.createDataFrame([(d, 1, t, x, y, x + 50, y + 8) for d in ("p", "q") for t, (x, y) in place.items()] + [("p", 1, "  ", 0.0, 0.0, 1.0, 1.0), ("p", 1, "river", 800.0, 800.0, 850.0, 808.0)], "doc_id string, page_no int, text string, x0 double, y0 double, x1 double, y1 double")
    rows = [("p", 1, "a", "river  bank stone bridge mill", 0.0, 4.0), ("p", 1, "b", "river bank unknown words", 0.0, 4.0), ("p", 1, "c", "lost found lost", 0.0, 200.0), ("q", 1, "d", "mill river", 0.0, 0.0), ("q", 2, "e", "river bank stone bridge", 0.0, 0.0), ("q", 1, "f", None, 0.0, 0.0)]
    e = spark.createDataFrame(rows, "doc_id string, page_no int, ref string, text string, l double, t double")
    got = layout.split_columns(e, lines).orderBy("ref", "col").collect()
    assert [(r["ref"], r["col"], r["text"], r["l"], r["t"], r["r"], r["b"]) for r in got] == [("a", 0, "river bank", 0.0, 5.0, 50.0, 23.0), ("a", 1, "stone bridge", 90.0, 5.0, 145.0, 23.0), ("a", 2, "mill", 300.0, 8.0, 350.0, 16.0)]
    assert {(r["ref"], r["col"]) for r in layout.split_columns(e, lines, min_chars=3).collect()} == {("a", 0), ("a", 1), ("a", 2), ("d", 0), ("d", 1)}


def test_cap_formulas(spark):
    rows = [(d, k // 10, k, 2.0) for d, n in (("a", 75), ("b", 3)) for k in range(n)]
    f = spark.createDataFrame(rows, "doc_id string, page_no int, ord int, took double")
    count = lambda df: dict(df.groupBy("doc_id").count().collect())
    assert count(layout.cap_formulas(f)) == {"a": 60, "b": 3}
    assert count(layout.cap_formulas(f, 50, batch=10, seconds=25.0)) == {"a": 20, "b": 3}
    assert count(layout.cap_formulas(f, 50, batch=10, seconds=0.0)) == {"a": 10, "b": 3}


def test_coalesce_blocks(spark):
    schema = "doc_id string, page_no int, ref string, ord int, kind string, label string, text string, l double, t double, r double, b double"
    e = spark.createDataFrame([("d", 1, "a", 0, "text", "text", "Ann", 0.0, 0.0, 10.0, 10.0), ("d", 1, "b", 1, "text", "text", "x@y", 0.0, 12.0, 10.0, 20.0), ("d", 1, "c", 2, "text", "text", "far", 0.0, 90.0, 10.0, 99.0)], schema)
    blocks = spark.createDataFrame([("d", 1, 0, "Ann x@y", 0.0, 0.0, 20.0, 20.0)], "doc_id string, page_no int, block int, text string, l double, t double, r double, b double")
    assert [(r["ref"], r["text"], r["r"]) for r in layout.coalesce_blocks(e, blocks).orderBy("ord").collect()] == [("a", "Ann x@y", 20.0), ("c", "far", 10.0)]


def test_nms_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for image in range(4):
        for k in range(25):
            x, y = rng.uniform(0, 60, 2)
            rows.append((image, k, float(x), float(y), float(x + rng.uniform(10, 40)), float(y + rng.uniform(10, 40)), float(rng.uniform()), int(rng.integers(2))))
    df = spark.createDataFrame(rows, "image_id int, det_id int, x1 double, y1 double, x2 double, y2 double, conf double, cls int")
    for max_det in (300, 3):
        want = set()
        for image in range(4):
            kept = []
            for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[6], r[1])):

                def iou(a, b):
                    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
                    i = max(w, 0) * max(h, 0)
                    return i / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - i)

                if len(kept) < max_det and not any(k[7] == r[7] and iou(k, r) > 0.45 for k in kept):
                    kept.append(r)
            want |= {(r[0], r[1]) for r in kept}
        assert {(r["image_id"], r["det_id"]) for r in detection.nms(df, max_det=max_det).collect()} == want


def test_pool(spark):
    items = spark.createDataFrame([("r1", [3.0, 0.0]), ("r1", [0.0, 0.0]), ("r2", [1.0, 0.0]), ("r2", [0.0, 1.0]), ("empty", [])], "room string, v array<float>")
    got = {r["room"]: r["pooled"] for r in vectors.pool(items, "room", "v").collect()}
    assert set(got) == {"r1", "r2"}
    assert np.allclose(np.linalg.norm(got["r1"]), 1) and np.allclose(got["r2"], [2**-0.5] * 2)
    with pytest.raises(ValueError):
        vectors.pool(items, "room", "v", "max")


def test_hits_and_ece(spark):
    s = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.7), (0, 0.2)], "label int, score double")
    assert {r["k"]: r["hits"] for r in metrics.hits_at_k(s, [1, 2, 3]).collect()} == {1: 0.5, 2: 1.0, 3: 1.0}
    p = spark.createDataFrame([(0.05, 0), (0.95, 1), (1.0, 0)], "p double, label int")
    assert abs(metrics.ece(p).first()["ece"] - (0.05 + 0.05) / 3) < 1e-9


def test_templates(spark):
    """A style without a separator takes no leading characters off; one with it does; an open turn leaves its cue."""
    rows = spark.createDataFrame([(1, 0, "user", "<hello>"), (1, 1, "assistant", "hi"), (1, 2, "user", "more"), (1, 3, "assistant", None)], "conv_id int, turn int, role string, text string")
    text = lambda name, **k: chat.messages_of(rows, chat.STYLES[name]).select(chat.prompt(F.col("messages"), chat.STYLES[name], **k)).first()[0]
    assert text("mistral_instruct") == "[INST] <hello> [/INST] hi </s>[INST] more [/INST]"
    assert text("llama_2", system="S") == "[INST] <<SYS>>\nS\n<</SYS>>\n\n<hello> [/INST] hi </s><s>[INST] more [/INST]"
    assert text("chatml_direct").endswith("<|im_end|><|im_start|>user\nmore<|im_end|><|im_start|>assistant\n")
    assert text("v1_mmtag").endswith("USER: <hello> ASSISTANT: hi</s>USER: more ASSISTANT:")
    assert text("plain") == "<hello>\nhimore\n"
