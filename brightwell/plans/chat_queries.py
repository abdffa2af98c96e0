"""Chat and envelope queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chat
from .registry import query, read

_ROLE = "CASE role WHEN 'user' THEN '{0}' WHEN 'assistant' THEN '{1}' ELSE role END"
_TURNS = "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, {role}, text) - 1 AS i, {role} AS role, coalesce(text, '') AS text FROM conversations"


def _turns(style: chat.Style) -> str:
    return _TURNS.format(role=_ROLE.format(*style.roles))


def _sql(style: chat.Style, head: str, full: str, cue: str) -> str:
    return f"""SELECT conv_id, {head} || string_agg(CASE WHEN text <> '' THEN {full} ELSE {cue} END, '' ORDER BY i) AS prompt FROM ({_turns(style)}) GROUP BY conv_id"""


def _prompt(spark, sf, name: str, system: str = "Be brief."):
    style = chat.STYLES[name]
    return chat.messages_of(read(spark, sf, "conversations"), style).select("conv_id", chat.prompt(F.col("messages"), style, system).alias("prompt"))


@query(_sql(chat.STYLES["v0"], "'Be brief.###'", "role || ': ' || text || '###'", "role || ':'"))
def chat_prompt_single(spark, sf):
    return _prompt(spark, sf, "v0")


@query(_sql(chat.STYLES["v1"], "'Be brief. '", "role || ': ' || text || CASE WHEN i % 2 = 0 THEN ' ' ELSE '</s>' END", "role || ':'"))
def chat_prompt_two(spark, sf):
    return _prompt(spark, sf, "v1")


@query(_sql(chat.STYLES["mpt"], "'Be brief.<|im_end|>'", "role || text || '<|im_end|>'", "role"))
def chat_prompt_mpt(spark, sf):
    return _prompt(spark, sf, "mpt")


@query(_sql(chat.STYLES["plain"], "'Be brief.'", "text || CASE WHEN i % 2 = 0 THEN chr(10) ELSE '' END", "''"))
def chat_prompt_plain(spark, sf):
    return _prompt(spark, sf, "plain")


@query(_sql(chat.STYLES["spaced"], "'Be brief.' || chr(10) || chr(10) || '### '", "role || ': ' || text || chr(10) || '### '", "role || ':'"))
def chat_prompt_spaced(spark, sf):
    return _prompt(spark, sf, "spaced")


@query(
    f"""WITH t AS ({_turns(chat.STYLES["llama_2"])}), p AS (SELECT conv_id, string_agg(CASE WHEN text = '' THEN '' WHEN i % 2 = 0 THEN '<s>[INST] ' || CASE WHEN i = 0 THEN '<<SYS>>' || chr(10) || 'Be brief.' || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || text || ' [/INST]' ELSE ' ' || text || ' </s>' END, '' ORDER BY i) AS p FROM t GROUP BY 1)
    SELECT conv_id, ltrim(p, '<s>') AS prompt FROM p"""
)
def chat_prompt_llama2(spark, sf):
    return _prompt(spark, sf, "llama_2")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _template_sql(name: str) -> str:
    """The SQL of a template with its own system text, by kind."""
    style = chat.STYLES[name]
    s, a, b = _literal(style.system), _literal(style.sep), _literal(style.sep2)
    either = f"CASE WHEN i % 2 = 0 THEN {a} ELSE {b} END"
    if style.kind == "single":
        sql = _sql(style, f"{s} || {a}", f"role || ': ' || text || {a}", "role || ':'")
    elif style.kind == "two":
        sql = _sql(style, f"{s} || {a}", f"role || ': ' || text || {either}", "role || ':'")
    elif style.kind == "mpt":
        sql = _sql(style, f"{s} || {a}", f"role || text || {a}", "role")
    elif style.kind == "plain":
        sql = _sql(style, s, f"text || {either}", "''")
    elif style.kind == "spaced":
        sql = _sql(style, f"{s} || chr(10) || chr(10) || {_literal(style.sep + ' ')}", f"role || ': ' || text || chr(10) || {_literal(style.sep + ' ')}", "role || ':'")
    else:
        head = f"CASE WHEN i = 0 THEN {_literal(f'<<SYS>>{chr(10)}{style.system}{chr(10)}<</SYS>>{chr(10)}{chr(10)}') if style.system else repr('')} ELSE '' END"
        sql = _sql(style, "''", f"CASE WHEN i % 2 = 0 THEN {a} || '[INST] ' || {head} || text || ' [/INST]' ELSE ' ' || text || ' ' || {b} END", "''")
        sql = f"SELECT conv_id, {'ltrim(prompt, ' + a + ')' if style.sep else 'prompt'} AS prompt FROM ({sql})"
    return f"SELECT {_literal(name)} AS template, conv_id, prompt FROM ({sql})"


@query(" UNION ALL ".join(map(_template_sql, chat.STYLES)))
def chat_templates(spark, sf):
    """Each conversation in each named template, read and gathered once."""
    roles = F.create_map(*(x for k, v in (("user", 0), ("assistant", 1)) for x in (F.lit(k), F.lit(v))))
    plain = chat.Style("plain", roles=("user", "assistant"))
    rows = chat.messages_of(read(spark, sf, "conversations"), plain)
    named = lambda s: F.transform("messages", lambda m: F.struct(F.coalesce(F.get(F.array(*map(F.lit, s.roles)), F.try_element_at(roles, m["role"])), m["role"]).alias("role"), m["content"].alias("content")))
    all_ = F.array(*(F.struct(F.lit(n).alias("template"), chat.prompt(named(s), s).alias("prompt")) for n, s in chat.STYLES.items()))
    return rows.select("conv_id", F.explode(all_).alias("t")).select("t.template", "conv_id", "t.prompt")


_CHOICES = "SELECT conv_id AS request_id, turn // 2 AS input_pos, turn % 2 AS choice, turn * 10 AS created, CASE WHEN turn % 3 = 0 THEN NULL ELSE 'length' END AS finish_reason, CASE WHEN turn % 5 = 4 THEN NULL ELSE text END AS content, length(text) AS k FROM conversations"


def _choices(spark, sf):
    t = F.col("turn")
    rows = read(spark, sf, "conversations")
    return rows.select(F.col("conv_id").alias("request_id"), F.floor(t / 2).alias("input_pos"), (t % 2).alias("choice"), (t * 10).alias("created"), F.when(t % 3 == 0, None).otherwise("length").alias("finish_reason"), F.when(t % 5 == 4, None).otherwise(F.col("text")).alias("content"), F.char_length("text").alias("k"))


@query(
    f"""SELECT request_id, (dense_rank() OVER (PARTITION BY request_id ORDER BY input_pos) - 1)::INTEGER AS input_pos, (row_number() OVER (PARTITION BY request_id, input_pos ORDER BY choice) - 1)::INTEGER AS place, created::BIGINT AS created, coalesce(finish_reason, 'stop') AS finish_reason, choice::INTEGER AS "index", coalesce(content, '') AS content, 'assistant' AS role FROM ({_CHOICES})"""
)
def choices_envelope(spark, sf):
    nested = chat.collect_choices(_choices(spark, sf))
    flat = nested.select("request_id", F.posexplode("outputs").alias("input_pos", "choices")).select("request_id", "input_pos", F.posexplode("choices").alias("place", "c"))
    return flat.select("request_id", "input_pos", "place", "c.created", "c.finish_reason", "c.index", F.col("c.message.content").alias("content"), F.col("c.message.role").alias("role"))


@query(f"SELECT request_id, arg_min(coalesce(content, ''), choice) AS content, input_pos::BIGINT AS input_pos FROM ({_CHOICES}) GROUP BY request_id, input_pos")
def first_choice(spark, sf):
    nested = chat.collect_choices(_choices(spark, sf), first_only=True)
    return nested.select("request_id", F.posexplode("outputs").alias("p", "choices")).select("request_id", F.col("choices")[0]["message"]["content"].alias("content"), F.col("p").cast("bigint").alias("input_pos"))


@query(f"SELECT request_id, sum(coalesce(CASE WHEN created % 20 = 0 THEN k END, 0))::BIGINT AS completion_tokens, sum(k)::BIGINT AS prompt_tokens, 0::BIGINT AS total_tokens FROM ({_CHOICES}) GROUP BY 1")
def usage_totals(spark, sf):
    rows = _choices(spark, sf).select("request_id", F.when(F.col("created") % 20 == 0, F.col("k")).alias("completion_tokens"), F.col("k").alias("prompt_tokens"), F.lit(None).cast("int").alias("total_tokens"))
    return chat.usage(rows)


@query("SELECT conv_id AS request_id, 0 AS input_pos, unnest(range(0, greatest(coalesce(n, 1), 1)))::INTEGER AS choice FROM (SELECT conv_id, nullif(max(turn) % 4, 3) AS n FROM conversations GROUP BY 1)")
def explode_requests(spark, sf):
    n = F.max("turn") % 4
    requests = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("request_id")).agg(F.array(F.struct(F.when(n == 3, None).otherwise(n).cast("int").alias("n"))).alias("inputs"))
    return chat.explode_requests(requests).select("request_id", "input_pos", "choice")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [1, p_size, -200, 5, -200, 7, 8] ELSE [p_size + 100, -200, 1, 5, -200, 1, 7, 8] END::INTEGER[] AS ids FROM part".replace("SELECT p_partkey, CASE", "SELECT p_partkey, array_to_string(CASE").replace("::INTEGER[] AS ids", ", ',') AS ids"))
def interleave_tokens(spark, sf):
    one, n = F.lit(1), F.col("p_size")
    chunks = F.when(n % 2 == 0, F.array(F.array(one, n), F.array(one, F.lit(5)), F.array(one, F.lit(7), F.lit(8)))).otherwise(F.array(F.array(n + 100), F.array(one, F.lit(5)), F.array(one, F.lit(7), F.lit(8))))
    ids = chat.interleave(chunks, bos=1)
    return read(spark, sf, "part").select("p_partkey", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT p_partkey, '7,-1,-2,8,-1,9' AS slots, '1,-100,-100,2,-100,3' AS labels, '0,0,7' AS padded FROM part")
def splice_images(spark, sf):
    ids = F.array(*map(F.lit, (7, -200, 8, -200, 9)))
    labels = F.array(*map(F.lit, (1, 0, 2, 0, 3)))
    s = chat.splice_images(ids, labels, F.array(F.lit(2), F.lit(1)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return read(spark, sf, "part").select("p_partkey", s.alias("s")).select("p_partkey", text(F.col("s.slots")).alias("slots"), text(F.col("s.labels")).alias("labels"), text(chat.pad(F.array(F.lit(7)), 3, 0, left=True)).alias("padded"))


@query(
    """WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn % 3 ELSE 0 END AS n FROM conversations), t AS (SELECT conv_id, sum(n) AS k FROM m GROUP BY 1), s AS (SELECT conv_id, coalesce(sum(k) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t),
    u AS (SELECT m.conv_id, turn, before, sum(n) OVER (PARTITION BY m.conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto FROM m JOIN s USING (conv_id))
    SELECT conv_id AS input, turn AS ord, coalesce(array_to_string(list_transform(range(1, upto::BIGINT + 1), lambda x: '<|image_' || (x + before)::BIGINT || '|>' || chr(10)), ''), '') AS prefix FROM u"""
)
def number_images(spark, sf):
    m = read(spark, sf, "conversations").select(F.col("conv_id").alias("input"), F.col("turn").alias("ord"), "role", (F.col("turn") % 3).alias("n_images"))
    return chat.number_images(m).select("input", "ord", "prefix")


def _image_entries(rows):
    even = F.col("conv_id") % 2 == 0
    n = F.when(even, F.col("turn") % 2).otherwise(0)
    # An even conversation has an image in each odd turn; its first message takes a placeholder only in odd ones.
    c = chat.image_contents(F.col("text"), n, F.col("turn") == 0, F.lit(0))
    return rows.select("conv_id", "turn", F.size(c).alias("entries"), F.element_at(c, -1)["text"].alias("text"))


@query("SELECT conv_id, turn, CASE WHEN n > 0 THEN n + 1 ELSE 1 + (turn = 0)::INTEGER END::INTEGER AS entries, text FROM (SELECT *, turn % 2 AS n FROM conversations WHERE conv_id % 2 = 0) UNION ALL SELECT conv_id, turn, 1 + (turn = 0)::INTEGER, text FROM conversations WHERE conv_id % 2 = 1")
def image_contents(spark, sf):
    return _image_entries(read(spark, sf, "conversations"))


@query("SELECT conv_id, string_agg(CASE WHEN turn % 4 = 0 THEN '<|image|>' ELSE '' END || '<|begin_of_text|>' || text, '' ORDER BY turn) AS prompt FROM conversations GROUP BY 1")
def header_prompt(spark, sf):
    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", chat.header_prompt(F.col("m"), F.transform("m", lambda m: F.when(m["turn"] % 4 == 0, 1).otherwise(0))).alias("prompt"))


@query("SELECT conv_id, count(*)::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE NOT (k = 1 AND (conv_id % 3 = 0 OR role = 'system')) GROUP BY 1")
def without_system(spark, sf):
    role = F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), "system").otherwise(F.col("role"))
    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role"), "text"))).alias("m"))
    return rows.select("conv_id", F.size(chat.without_system(F.col("m"))).alias("n")).where("n > 0")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 672 WHEN 1 THEN 1344 ELSE 1024 END AS width, CASE p_size % 3 WHEN 0 THEN 1600 WHEN 1 THEN 768 ELSE 1024 END AS height FROM part")
def image_sizes(spark, sf):
    ratio = F.when(F.col("p_size") % 3 == 0, "9:21").when(F.col("p_size") % 3 == 1, "16:9").otherwise("odd")
    return read(spark, sf, "part").select("p_partkey", chat.image_size(ratio).alias("s")).select("p_partkey", "s.*")


@query("SELECT conv_id, '<Instruct>: find' || chr(10) || '<Query>: ' || role || chr(10) || '<Document>: ' || text AS prompt, turn FROM conversations")
def rerank_prompts(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", tx.rerank_prompt(F.lit("find"), F.col("role"), F.col("text")).alias("prompt"), "turn")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'runs_checkpoint-' || p_size ELSE p_name END AS model, p_size % 5 = 0 AS stop, CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_name || '<' END AS clean FROM part")
def model_names(spark, sf):
    n = F.col("p_size")
    path = F.when(n % 2 == 0, F.concat(F.lit("/a/runs/checkpoint-"), n, F.lit("/"))).otherwise(F.concat(F.lit("org/"), "p_name"))
    said = F.when(n % 5 == 0, F.concat("p_name", F.lit("</s>"))).otherwise(F.concat("p_name", F.lit("<")))
    return read(spark, sf, "part").select("p_partkey", tx.model_name(path).alias("model"), chat.stops(F.array(F.lit(5), n % 5), said, [[5, 0]], ["</s>"]).alias("stop"), tx.drop_suffix(said, "</s>").alias("clean"))


@query("SELECT conv_id, turn, '<image>' || chr(10) || trim(text) AS content FROM conversations WHERE turn = 0")
def lead_with_image(spark, sf):
    rows = read(spark, sf, "conversations").where("turn = 0")
    m = F.array(F.struct("role", F.concat(F.lit("<image>"), "text").alias("content")))
    return rows.select("conv_id", "turn", chat.lead_with_image(m)[0]["content"].alias("content"))


@query("SELECT conv_id, turn, least(length(text), 20) + 3 AS n, CASE WHEN length(text) >= 20 THEN 20 ELSE length(text) END AS last FROM conversations WHERE text IS NOT NULL")
def within_budget(spark, sf):
    """Places of characters stand for tokens: two tokens before, one after, 23 in all."""
    c = read(spark, sf, "conversations").where("text IS NOT NULL")
    ids = F.slice(F.sequence(F.lit(1), F.char_length("text") + 1), F.lit(1), F.char_length("text"))
    cut = chat.within_budget(ids, 23, F.array(F.lit(-1), F.lit(-2)), F.array(F.lit(-3)))
    return c.select("conv_id", "turn", F.size(cut).cast("bigint").alias("n"), F.greatest(F.try_element_at(cut, F.lit(-2)), F.lit(0)).cast("bigint").alias("last"))


@query("SELECT conv_id, (count(*) % 2)::INTEGER AS images FROM conversations GROUP BY 1")
def check_images(spark, sf):
    n = read(spark, sf, "conversations").groupBy("conv_id").agg((F.count(F.lit(1)) % 2).cast("int").alias("n"))
    return n.select("conv_id", chat.check_images(F.col("n")).alias("images"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def passthrough(spark, sf):
    return chat.passthrough(read(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


@query("SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN '.PT' ELSE '.onnx' END AS path FROM customer")
def check_suffix(spark, sf):
    path = F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ".PT").otherwise(".onnx"))
    return read(spark, sf, "customer").select("c_custkey", tx.check_suffix(path, [".pt", ".onnx"]).alias("path"))


@query("SELECT doc_id AS pos, (length(text) % 97)::DOUBLE + 9 AS score FROM documents WHERE text IS NOT NULL")
def rerank(spark, sf):
    """A scorer of lengths; scores come back under the documents' places."""
    from ..operators import scoring

    docs = read(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("pos"), "text")
    return scoring.rerank(docs, lambda ask, text: len(text) % 97 + len(ask), "what", "find").select("pos", "score")
