"""Text expressions: OCR quality, white space, labels, boxes in markup, prompts, byte-level decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and patterns of the text-quality score.
GARBLE_MIN_TOKENS = 4
GARBLE_WORD_FLOOR = 0.5
GARBLE_SINGLE = 0.2
GARBLE_SHORT = 0.5
WORD_RUN = r"[\p{L}\p{Nl}\p{No}]{3,}"
LONG_ALNUM = r"[A-Za-z0-9]{5,}"
PUNCT_RUN = r"[^\p{L}\p{N}_\s]{2,}"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Labels of regions.
LABEL_ALIASES = {
    "title": "section_header",
    "sub_title": "section_header",
    "subtitle": "section_header",
    "heading": "section_header",
    "header": "page_header",
    "footer": "page_footer",
    "list": "list_item",
    "image": "picture",
    "figure": "picture",
    "image_caption": "caption",
    "figure_caption": "caption",
    "table_caption": "caption",
    "equation": "formula",
}
PASS_LABELS = (
    "caption", "checkbox_selected", "checkbox_unselected", "code", "document_index", "empty_value", "footnote", "formula",
    "grading_scale", "handwritten_text", "list_item", "page_footer", "page_header", "reference", "section_header",
)
HEADER_BAND, FOOTER_BAND = 0.07, 0.93
MIN_REGION_DIM = 0.004
PLACEHOLDER = r"(?i)^\[(non[-\s]?text|image|figure|photo|graphic|table|chart)\]$"
CAPTION = r"(?i)^\s*(Algorithm|Procedure|Listing|Box|Sidebar|Panel)\s+\d+\b"
ALGORITHM = r"(?i)^\s*(Algorithm|Procedure|Listing)\s+\d+\b"
STEP = r"(?i)^\s*(\d+\s*[:.)]|(Require|Ensure|Input|Output)\s*:)"
FOOTNOTE_MARKERS = "∗*†‡§¶⁎⋆"


def clean_space(text: Column) -> Column:
    """Runs of white space (Unicode) to one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(clean_space(F.coalesce(text, F.lit(""))), " "), lambda t: t != "")


def is_garbled(text: Column) -> Column:
    """Whether a text span reads like broken OCR.

    At least GARBLE_MIN_TOKENS tokens, under half of them word-like (a run of
    three letters or of five ASCII letters and digits), and one of: a fifth
    single characters, half of two characters at most without punctuation
    around them, or a run of punctuation marks.
    """

    def judge(ts: Column) -> Column:
        n = F.size(ts).cast("double")
        core = lambda t: F.btrim(t, F.lit(PUNCTUATION))
        share = lambda test: F.size(F.filter(ts, test)) / n
        wordy = share(lambda t: F.rlike(t, F.lit(WORD_RUN)) | F.rlike(t, F.lit(LONG_ALNUM)))
        single = share(lambda t: F.rlike(core(t), F.lit(r"^[\p{L}\p{N}]$")))
        short = share(lambda t: F.char_length(core(t)) <= 2)
        broken = F.exists(ts, lambda t: F.rlike(t, F.lit(PUNCT_RUN)))
        return (F.size(ts) >= GARBLE_MIN_TOKENS) & (wordy < GARBLE_WORD_FLOOR) & ((single >= GARBLE_SINGLE) | (short >= GARBLE_SHORT) | broken)

    # The tokens are bound once: an array of one array.
    return F.coalesce(F.get(F.transform(F.array(tokens(text)), judge), F.lit(0)), F.lit(False))


def resolve_label(label: Column, top: Column, bottom: Column) -> Column:
    """A region's label: aliases, labels that pass, and by position for plain text."""
    key = F.lower(F.btrim(F.coalesce(label, F.lit(""))))
    out = F.when(key.isin(*PASS_LABELS), key)
    for a, b in LABEL_ALIASES.items():
        out = out.when(key == a, F.lit(b))
    middle = (top + bottom) / 2
    return out.when(middle < HEADER_BAND, "page_header").when(middle > FOOTER_BAND, "page_footer").otherwise("text")


def correct_furniture(label: Column, text: Column, top: Column, bottom: Column) -> Column:
    """A page header or footer outside its band that reads like content becomes text."""
    middle, t = (top + bottom) / 2, strip(F.coalesce(text, F.lit("")))
    content = (F.char_length(t) > 15) | t.contains(" ")
    wrong = ((label == "page_footer") & (middle <= FOOTER_BAND)) | ((label == "page_header") & (middle >= HEADER_BAND))
    return F.when(content & wrong, "text").otherwise(label)


def recoverable(label: Column, text: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    """Whether a region may become an element: a text, no placeholder, no table, no degenerate box."""
    t = strip(F.coalesce(text, F.lit("")))
    return (F.lower(label) != "table") & (t != "") & ~F.rlike(t, F.lit(PLACEHOLDER)) & (box[2] - box[0] >= MIN_REGION_DIM) & (box[3] - box[1] >= MIN_REGION_DIM)


def parse_regions(raw: Column) -> Column:
    """array<struct<label, l, t, r, b, text>> from markup `label [x, y, x, y]` between <|det|> and <|/det|>, then text.

    <|det|> separates; coordinates of 0..999 become 0..1, clamped; a missing
    label is text; regions without four numbers or without text are left out.
    """
    chunks = F.filter(F.split(raw, r"<\|det\|>"), lambda c: c.contains("<|/det|>"))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c / 999.0))

    def one(c: Column) -> Column:
        head = F.substring_index(c, "<|/det|>", 1)
        body = F.substring(c, F.char_length(head) + 9, F.char_length(c))
        inner = F.regexp_extract(head, r"([A-Za-z_]+)?\s*\[\s*([\d.\s,]+?)\s*\]", 2)
        label = F.lower(F.regexp_extract(head, r"([A-Za-z_]+)?\s*\[\s*([\d.\s,]+?)\s*\]", 1))
        nums = F.transform(F.filter(F.split(inner, ","), lambda x: F.btrim(x) != ""), lambda x: F.btrim(x).try_cast("double"))
        at = lambda k: unit(F.get(nums, F.lit(k)))
        return F.struct(
            F.when(label == "", "text").otherwise(label).alias("label"), at(0).alias("l"), at(1).alias("t"), at(2).alias("r"), at(3).alias("b"),
            strip(body).alias("text"), ((F.size(nums) >= 4) & ~F.exists(nums, lambda x: x.isNull())).alias("ok"),
        )

    good = F.filter(F.transform(chunks, one), lambda x: x["ok"] & (x["text"] != ""))
    return F.transform(good, lambda x: x.dropFields("ok"))


def dedup_latex(latex: Column) -> Column:
    r"""Rows (between \\) whose left-hand side of over 3 characters came before are dropped; untouched if none is."""
    s = strip(F.coalesce(latex, F.lit("")))
    rows = F.filter(F.transform(F.split(s, r"\\\\\\\\".replace("\\\\", "\\")), lambda r: strip(F.regexp_replace(r, r"\\intertext\s*\{[^}]*\}", ""))), lambda r: r != "")
    side = lambda r: strip(F.substring_index(r, "&", 1))
    kept = F.aggregate(rows, F.slice(rows, 1, 0), lambda acc, r: F.when((F.char_length(side(r)) > 3) & F.exists(acc, lambda k: side(k) == side(r)), acc).otherwise(F.concat(acc, F.array(r))))
    return F.when(F.size(kept) == F.size(rows), s).otherwise(F.array_join(kept, " \\\\ "))


def safe_name(text: Column) -> Column:
    """Characters that are awkward in names become underscores."""
    return F.regexp_replace(text, "[|@#!¡·$€%&()=?¿^*;:,¨´><+]", "_")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def has_chinese(text: Column) -> Column:
    return F.rlike(text, F.lit("[一-鿿]"))


def answer_after(text: Column, marker: str) -> Column:
    """What follows the last marker, without white space around it."""
    return strip(F.element_at(F.split(text, F.lit(_quoted(marker))), -1))


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def drop_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.char_length(text) - len(suffix))).otherwise(text)


def rerank_prompt(instruction: Column, query: Column, document: Column) -> Column:
    return F.concat(F.lit("<Instruct>: "), instruction, F.lit("\n<Query>: "), query, F.lit("\n<Document>: "), document)


def model_name(path: Column) -> Column:
    """The last part of a path; of a checkpoint folder, the last two joined by _."""
    parts = F.split(F.btrim(path, F.lit("/")), "/")
    last = F.element_at(parts, -1)
    return F.when(last.startswith("checkpoint-"), F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), last)).otherwise(last)


def fill_placeholders(text: Column, marker: str, replacements: Column) -> Column:
    """The n-th marker becomes the n-th replacement; markers beyond them stay."""
    parts = F.split(text, F.lit(_quoted(marker)))
    joined = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.get(replacements, i - 1), F.lit(marker)), p)))
    return F.array_join(joined, "")


def data_uri_payload(uri: Column) -> Column:
    """Bytes of a base64 data URI, or of bare base64."""
    return F.unbase64(F.when(uri.startswith("data:"), F.regexp_extract(uri, "^data:[^,]*,(.*)$", 1)).otherwise(uri))


def is_pdf(uri: Column) -> Column:
    return F.lower(uri).startswith("data:application/pdf") | (F.substring(F.decode(F.substring(data_uri_payload(uri), 1, 5), "ISO-8859-1"), 1, 5) == "%PDF-")


def document_format(uri: Column) -> Column:
    """pdf, pptx, docx, ppt or doc by the MIME type of a data URI; null for others."""
    mime = F.regexp_extract(uri, "^data:([^;,]*)", 1)
    names = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.ms-powerpoint": "ppt", "application/msword": "doc"}
    out = F.when(F.lit(False), "")
    for m, n in names.items():
        out = out.when(mime == m, F.lit(n))
    return out


def byte_level_decode(text: Column) -> Column:
    """Text of byte-level BPE characters back to UTF-8; other characters are dropped, broken sequences become U+FFFD.

    Each character stands for one byte: itself if printable, else the next
    from U+0100. The map is a string translated to ISO-8859-1, so the
    expression stays in the JVM.
    """
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    # Stand-ins beyond Latin-1 go to their bytes; bytes that stand for themselves stay.
    known = F.regexp_replace(text, "[^" + "!-~¡-¬®-ÿ" + chr(256) + "-" + chr(255 + len(rest)) + "]", "")
    latin = F.translate(known, "".join(chr(256 + k) for k in range(len(rest))), "".join(map(chr, rest)))
    return F.decode(F.encode(latin, "ISO-8859-1"), "UTF-8")


def check_suffix(path: Column, suffixes: list[str]) -> Column:
    """The path, or an error if it ends in none of the suffixes (case aside)."""
    fits = F.lit(False)
    for x in suffixes:
        fits = fits | F.endswith(F.lower(path), F.lit(x.lower()))
    return F.when(fits, path).otherwise(F.raise_error(F.format_string(f"%s is none of {', '.join(suffixes)}", path)))
