"""Chat operators: prompt templates, request and result envelopes, multimodal tokens.

Messages are rows (conv_id, turn, role, text) or array<struct<role, content>>
columns; an ordered list of a conversation's messages is gathered within its
conversation only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

IMAGE_TOKEN, IGNORE = -200, -100


@dataclass(frozen=True)
class Style:
    """A prompt style: kind is single, two, mpt, llama2, plain or spaced; roles name user and assistant.

    tagged: `lead_with_image` gives a leading image turns of its own.
    """

    kind: str
    system: str = ""
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    sep: str = "###"
    sep2: str = ""
    tagged: bool = False


# Separators, role names and system texts of the named templates.
_CURIOUS_HUMAN = "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."
_CURIOUS_USER = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
_TAGGED = (
    "A chat between a curious user and an artificial intelligence assistant. The assistant is able to understand the visual content that the user provides, and assist the user with a variety of "
    "tasks using natural language.The visual content will be provided with the following format: <Image>visual content</Image>."
)
_VISION = "You are a helpful language and vision assistant. You are able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language."
_SAFE = (
    "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, "
    "dangerous, or illegal content. Please ensure that your responses are socially unbiased and positive in nature.\n\nIf a question does not make any sense, or is not factually coherent, explain why "
    "instead of answering something not correct. If you don't know the answer to a question, please don't share false information."
)
_MPT = "<|im_start|>system\nA conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers."
_DIRECT = "<|im_start|>system\nAnswer the questions."
_USERS, _HUMANS, _MARKED = ("USER", "ASSISTANT"), ("Human", "Assistant"), ("<|im_start|>user\n", "<|im_start|>assistant\n")

STYLES = {
    "v0": Style("single", _CURIOUS_HUMAN, _HUMANS, "###"),
    "v1": Style("two", _CURIOUS_USER, _USERS, " ", "</s>"),
    "vicuna_v1": Style("two", _CURIOUS_USER, _USERS, " ", "</s>"),
    "llama_2": Style("llama2", _SAFE, _USERS, "<s>", "</s>"),
    "mistral_instruct": Style("llama2", "", _USERS, "", "</s>"),
    "chatml_direct": Style("mpt", _DIRECT, _MARKED, "<|im_end|>"),
    "mistral_direct": Style("mpt", _DIRECT, _MARKED, "<|im_end|>"),
    "plain": Style("plain", "", ("", ""), "\n"),
    "v0_plain": Style("plain", "", ("", ""), "\n"),
    "llava_v0": Style("single", _CURIOUS_HUMAN, _HUMANS, "###"),
    "v0_mmtag": Style("single", _TAGGED, _HUMANS, "###", tagged=True),
    "llava_v1": Style("two", _CURIOUS_HUMAN, _USERS, " ", "</s>"),
    "v1_mmtag": Style("two", _TAGGED, _USERS, " ", "</s>", tagged=True),
    "llava_llama_2": Style("llama2", _VISION, _USERS, "<s>", "</s>"),
    "mpt": Style("mpt", _MPT, _MARKED, "<|im_end|>"),
    "spaced": Style("spaced", "", _HUMANS, "###"),
}


def messages_of(rows: DataFrame, style: Style) -> DataFrame:
    """(conv_id, messages): the turns in order as array<struct<role, content>>, with the style's role names."""
    role = F.when(F.col("role") == "user", style.roles[0]).when(F.col("role") == "assistant", style.roles[1]).otherwise(F.col("role"))
    one = F.struct("turn", role.alias("role"), F.col("text").alias("content"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def prompt(messages: Column, style: Style, system: str | Column | None = None) -> Column:
    """The prompt of array<struct<role, content>>. A null or empty content leaves the role's cue for an answer.

    two and plain alternate their separators by place; llama2 wraps turns of
    even place in [INST], the first with the system text, and takes leading
    characters of its separator off.
    """
    sys = F.lit(style.system) if system is None else (F.lit(system) if isinstance(system, str) else system)
    sep, sep2 = F.lit(style.sep), F.lit(style.sep2)
    full = lambda m: F.coalesce(m["content"], F.lit("")) != ""
    turn = lambda i: F.when(i % 2 == 0, sep).otherwise(sep2)
    join = lambda f: F.array_join(F.transform(messages, f), "")
    if style.kind == "single":
        return F.concat(sys, sep, join(lambda m: F.when(full(m), F.concat(m["role"], F.lit(": "), m["content"], sep)).otherwise(F.concat(m["role"], F.lit(":")))))
    if style.kind == "spaced":
        return F.concat(sys, F.lit("\n\n"), sep, F.lit(" "), join(lambda m: F.when(full(m), F.concat(m["role"], F.lit(": "), m["content"], F.lit("\n"), sep, F.lit(" "))).otherwise(F.concat(m["role"], F.lit(":")))))
    if style.kind == "two":
        return F.concat(sys, sep, join(lambda m, i: F.when(full(m), F.concat(m["role"], F.lit(": "), m["content"], turn(i))).otherwise(F.concat(m["role"], F.lit(":")))))
    if style.kind == "mpt":
        return F.concat(sys, sep, join(lambda m: F.when(full(m), F.concat(m["role"], m["content"], sep)).otherwise(m["role"])))
    if style.kind == "plain":
        return F.concat(sys, join(lambda m, i: F.when(full(m), F.concat(m["content"], turn(i))).otherwise("")))
    if style.kind == "llama2":
        head = F.when(sys != "", F.concat(F.lit("<<SYS>>\n"), sys, F.lit("\n<</SYS>>\n\n"))).otherwise("")
        ask = lambda m, i: F.concat(sep, F.lit("[INST] "), F.when(i == 0, head).otherwise(""), m["content"], F.lit(" [/INST]"))
        body = join(lambda m, i: F.when(~full(m), "").when(i % 2 == 0, ask(m, i)).otherwise(F.concat(F.lit(" "), m["content"], F.lit(" "), sep2)))
        return F.ltrim(body, sep) if style.sep else body
    raise ValueError(f"unknown style {style.kind!r}")


def lead_with_image(messages: Column, mark: str = "<image>", tagged: bool = False, roles: tuple[str, str] = ("USER", "ASSISTANT")) -> Column:
    """The first message without its own mark, and the mark before it; tagged puts the mark into turns of its own."""
    first = F.get(messages, F.lit(0))
    body = tx.strip(F.replace(first["content"], F.lit(mark), F.lit("")))
    rest = F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))
    make = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    if tagged:
        new = F.array(make(F.lit(roles[0]), F.lit(f"<Image>{mark}</Image>")), make(F.lit(roles[1]), F.lit("Received.")), make(first["role"], body))
    else:
        new = F.array(make(first["role"], F.concat(F.lit(mark + "\n"), body)))
    return F.when(F.size(messages) > 0, F.concat(new, rest)).otherwise(messages)


def without_system(messages: Column) -> Column:
    """Messages without a leading system message, where the receiver has no such role."""
    return F.when(F.get(messages, F.lit(0))["role"] == "system", F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)


def check_images(count: Column, least: int = 0, most: int = 1) -> Column:
    """The count, or an error if it is not within the bounds."""
    return F.when((count < least) | (count > most), F.raise_error(F.format_string(f"this model takes {least} to {most} images in each conversation, not %d", count)).cast("int")).otherwise(count)


def number_images(messages: DataFrame) -> DataFrame:
    """Add prefix: the placeholders <|image_n|> before each message, numbered over all inputs in order.

    messages: input, ord, role, n_images. Placeholders of user messages are
    carried into the later messages of the same input.
    """
    from pyspark.sql import Window as W

    from ..ranges import running

    own = F.when(F.col("role") == "user", F.col("n_images")).otherwise(0)
    totals = messages.groupBy("input").agg(F.sum(own).alias("k"))
    start = running(totals, ["input"], value="k").select("input", (F.col("cum") - F.col("k")).alias("before"))
    upto = F.sum(own).over(W.partitionBy("input").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    out = messages.join(start, "input").withColumn("upto", upto)
    marks = F.array_join(F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("upto")), lambda n: F.concat(F.lit("<|image_"), (n + F.col("before")).cast("string"), F.lit("|>\n"))), "")
    return out.withColumn("prefix", F.when(F.col("upto") > 0, marks).otherwise("")).drop("upto", "before")


def image_contents(text: Column, n_images: Column, first: Column, total_images: Column) -> Column:
    """Contents of a message: an image entry for each image, then the text; a placeholder in the first message if no message has one."""
    entry = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.cast("string").alias("text"))
    n = F.when(first & (total_images == 0), 1).otherwise(n_images)
    return F.concat(F.array_repeat(entry("image", F.lit(None)), n.cast("int")), F.array(entry("text", text)))


def header_prompt(messages: Column, images: Column) -> Column:
    """Contents after a begin mark each, with an image mark before those with an image (at most one)."""
    one = F.zip_with(messages, images, lambda m, n: F.concat(F.when(n == 1, "<|image|>").when(n == 0, "").otherwise(F.raise_error(F.lit("a message takes 0 or 1 image"))), F.lit("<|begin_of_text|>"), m["content"]))
    return F.array_join(one, "")


def explode_requests(requests: DataFrame) -> DataFrame:
    """One row for each requested choice: (request_id, input_pos, choice, input) from request_id and inputs array<struct<.., n>>."""
    each = requests.select("request_id", F.posexplode("inputs").alias("input_pos", "input"))
    return each.select("request_id", "input_pos", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(F.col("input.n"), F.lit(1)), F.lit(1)) - 1)).alias("choice"), "input")


def collect_choices(rows: DataFrame, *, first_only: bool = False, index: str = "choice") -> DataFrame:
    """(request_id, outputs): per input the choices in order, per request the inputs in order.

    rows: request_id, input_pos, choice, created, finish_reason, content.
    index is what a choice's index holds: choice or input_pos. Null contents
    become empty, null reasons stop.
    """
    entry = F.struct(
        F.col("choice").alias("k"), F.col("created").cast("bigint").alias("created"), F.coalesce("finish_reason", F.lit("stop")).alias("finish_reason"),
        F.col(index).cast("int").alias("index"), F.struct(F.coalesce("content", F.lit("")).alias("content"), F.lit("assistant").alias("role")).alias("message"),
    )
    per = rows.groupBy("request_id", "input_pos").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    keep = F.slice("c", 1, 1) if first_only else F.col("c")
    per = per.select("request_id", "input_pos", F.transform(keep, lambda x: x.dropFields("k")).alias("choices"))
    return per.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("input_pos", "choices"))), lambda x: x["choices"]).alias("outputs"))


def usage(rows: DataFrame) -> DataFrame:
    """(request_id, completion_tokens, prompt_tokens, total_tokens): sums, null counting as 0."""
    names = ("completion_tokens", "prompt_tokens", "total_tokens")
    return rows.groupBy("request_id").agg(*(F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in names))


def interleave(chunks: Column, separator: int = IMAGE_TOKEN, bos: int | None = None) -> Column:
    """Token chunks joined by the separator; a begin token that opens the first chunk is kept once and cut from every chunk."""
    starts = F.lit(False) if bos is None else F.coalesce(F.get(F.get(chunks, F.lit(0)), F.lit(0)) == bos, F.lit(False))
    cut = lambda c: F.when(starts, F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)
    body = F.flatten(F.transform(chunks, lambda c, i: F.when(i == 0, cut(c)).otherwise(F.concat(F.array(F.lit(separator)), cut(c)))))
    return F.when(starts, F.concat(F.array(F.lit(bos)), body)).otherwise(body) if bos is not None else body


def splice_images(ids: Column, labels: Column, features: Column, max_length: int | None = None) -> Column:
    """struct(slots, labels): image tokens become that many slots of -1 - place with ignored labels; cut to max_length.

    features: array of the number of slots of each image, in order.
    """
    nth = lambda i: F.size(F.filter(F.slice(ids, F.lit(1), i), lambda t: t == IMAGE_TOKEN))
    slots = F.flatten(F.transform(ids, lambda t, i: F.when(t == IMAGE_TOKEN, F.transform(F.array_repeat(F.lit(0), F.coalesce(F.get(features, nth(i)), F.lit(0))), lambda _, k: -1 - k)).otherwise(F.array(t))))
    lab = F.flatten(F.zip_with(F.transform(ids, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), labels, lambda x, y: F.when(x["t"] == IMAGE_TOKEN, F.array_repeat(F.lit(IGNORE), F.coalesce(F.get(features, nth(x["i"])), F.lit(0)))).otherwise(F.array(y))))
    cut = (lambda c: F.slice(c, 1, max_length)) if max_length is not None else (lambda c: c)
    return F.struct(cut(slots).alias("slots"), cut(lab).alias("labels"))


def pad(values: Column, length: Column | int, fill: int, *, left: bool = False) -> Column:
    missing = F.array_repeat(F.lit(fill), F.greatest((F.lit(length) if isinstance(length, int) else length) - F.size(values), F.lit(0)))
    return F.concat(missing, values) if left else F.concat(values, missing)


def within_budget(ids: Column, max_length: int, before: Column | None = None, after: Column | None = None) -> Column:
    """before + ids + after in at most max_length tokens: the ids give way, from their end."""
    none = F.slice(ids, 1, 0)
    before, after = (none if c is None else c for c in (before, after))
    room = F.greatest(F.lit(max_length) - F.size(before) - F.size(after), F.lit(0))
    return F.concat(before, F.slice(ids, F.lit(1), room), after)


def passthrough(requests: DataFrame) -> DataFrame:
    """The task that answers a request with itself."""
    return requests


def stops(tokens: Column, decoded: Column, stop_ids: list[list[int]], words: list[str]) -> Column:
    """Whether generation is to stop: the tokens end like a stop sequence, or the text holds a stop word."""
    out = F.lit(False)
    for s in stop_ids:
        out = out | (F.slice(tokens, F.greatest(F.size(tokens) - len(s) + 1, F.lit(1)), len(s)) == F.array(*map(F.lit, s)))
    for w in words:
        out = out | decoded.contains(w)
    return out


#: Sizes of generated images by aspect ratio.
IMAGE_SIZES = {
    "9:21": (672, 1600),
    "9:16": (768, 1344),
    "2:3": (768, 1152),
    "4:5": (912, 1136),
    "5:4": (1136, 912),
    "3:2": (1152, 768),
    "16:9": (1344, 768),
    "21:9": (1600, 672),
    "1:1": (1024, 1024),
}


def image_size(ratio: Column) -> Column:
    """struct(width, height) of an aspect ratio; square for unknown ones."""
    out = F.when(F.lit(False), F.struct(F.lit(0).alias("width"), F.lit(0).alias("height")))
    for k, (w, h) in IMAGE_SIZES.items():
        out = out.when(ratio == k, F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")))
    return out.otherwise(F.struct(F.lit(1024).alias("width"), F.lit(1024).alias("height")))
