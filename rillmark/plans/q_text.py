"""Queries: graders, parsers, prompt building, ids, splits, geometry.

Tables have no solved problems, so texts are made of their columns: each maker is one SQL
expression for both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat as H
from ..functions import graders as G
from ..functions import parsers as P
from ..functions import prompts as Q
from .base import query, r6, s6, table

# a solution of a part: its price after the mark, or a stated price, or none
_PART = "(SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN concat('size 7, so #### ', CAST(p_size * 1000 AS VARCHAR(20)), ',5') WHEN p_size % 3 = 1 THEN concat('Well. Answer: $', CAST(p_size AS VARCHAR(20)), '$ dollars') ELSE concat('no idea . ', p_name) END AS text FROM part)"
_SIZE = "CAST(p_size AS VARCHAR(20))"


def solutions(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql(f"SELECT * FROM {_PART.replace('VARCHAR(20)', 'STRING')}")


@query(f"""WITH e AS (SELECT p_partkey, regexp_extract_all(text, '#### (-?[0-9.,]+)', 1) AS a FROM {_PART} s) SELECT p_partkey, replace(a[-1], ',', '') AS answer FROM e""")
def grade_number_strict(spark, sf):
    return solutions(spark, sf).select("p_partkey", G.number_answer(F.col("text")).alias("answer"))


@query(f"""WITH e AS (SELECT p_partkey, regexp_extract_all(text, '(-?[0-9.,]+)', 1) AS a FROM {_PART} s) SELECT p_partkey, coalesce(list_filter(a, lambda x: x NOT IN ('', '.'))[-1], a[1]) AS answer FROM e""")
def grade_number_flexible(spark, sf):
    return solutions(spark, sf).select("p_partkey", G.number_answer(F.col("text"), flexible=True).alias("answer"))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 0.0::DOUBLE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.1 END AS score FROM {_PART} s""")
def grade_number_score(spark, sf):
    truth = F.when(F.col("p_size") % 2 == 0, F.concat((F.col("p_size") * 1000).cast("string"), F.lit("5"))).otherwise("x")
    return solutions(spark, sf).select("p_partkey", G.number_score(F.col("text"), truth, wrong=0.1).alias("score"))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN 1.0::DOUBLE ELSE -1.0 END AS score, CASE WHEN p_size % 3 = 1 THEN {_SIZE} ELSE '[INVALID]' END AS pred FROM {_PART} s""")
def grade_stated_answer(spark, sf):
    x = G.stated_score(F.col("text"), F.col("p_size").cast("string"))
    return solutions(spark, sf).select("p_partkey", x["score"].alias("score"), x["pred"].alias("pred"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(concat('The ', p_name, ', a ', p_type, '!')), '[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~]', '', 'g'), '(^|\\b)(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM part")
def plain_answer_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", G.plain_text(F.concat(F.lit("The "), "p_name", F.lit(", a "), "p_type", F.lit("!"))).alias("text"))


@query("""WITH a AS (SELECT a.n_nationkey, lower(a.n_name) || CASE WHEN a.n_nationkey % 2 = 1 THEN ' land' ELSE '' END AS said, lower(b.n_name) AS golden FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey - a.n_nationkey % 3)
SELECT n_nationkey, CASE WHEN said = golden THEN 1.0::DOUBLE ELSE 0.2 END AS exact, CASE WHEN contains(said, golden) THEN 1.0::DOUBLE ELSE 0.0 END AS contained FROM a""")
def grade_qa_match(spark, sf):
    n = table(spark, sf, "nation")
    other = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("golden"))
    both = n.join(other, F.col("k") == F.col("n_nationkey") - F.col("n_nationkey") % 3)
    text = F.concat(F.lit("<answer>x</answer> <answer> The "), "n_name", F.when(F.col("n_nationkey") % 2 == 1, " land").otherwise(""), F.lit("!</answer>"))
    golden = F.array(F.lit("nowhere"), F.lower("golden"))
    return both.select("n_nationkey", G.exact_match(text, golden, wrong=0.2).alias("exact"), G.exact_match(text, golden, contained=True).alias("contained"))


@query(f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS format, {s6('0.9 * CASE WHEN p_size % 20 = p_size THEN 1 ELSE 0 END + 0.1 * CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END')} AS score FROM part")
def grade_geometry(spark, sf):
    think = F.when(F.col("p_size") % 2 == 0, "<think>so\n</think> ").otherwise("")
    text = F.concat(think, F.lit("\\boxed{\\frac{"), F.col("p_size").cast("string"), F.lit("}{7}} ok"))
    truth = F.concat(F.lit("\\dfrac{"), (F.col("p_size") % 20).cast("string"), F.lit("} {7}"))
    return table(spark, sf, "part").select("p_partkey", G.think_format(text).alias("format"), r6(G.geometry_score(text, truth)).alias("score"))


@query("""WITH a AS (SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN '\\frac{' || p_size || '}{3}' WHEN 2 THEN CAST(p_size AS VARCHAR) END AS answer FROM part)
SELECT p_partkey, answer, CASE WHEN answer = '\\frac{' || (p_size % 24) || '}{3}' THEN 1.0::DOUBLE ELSE 0.0 END AS score, CASE WHEN p_size = 5 THEN '\\frac{1}{2}' ELSE '0.' || p_size END AS normal FROM a""")
def grade_boxed(spark, sf):
    """Boxes with braces, of another kind, with a space behind them (which go first), unclosed."""
    n, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    braced = F.concat(F.lit("\\boxed{\\frac{"), n, F.lit("}{3}}"))
    text = F.when(k == 0, F.concat(F.lit("thus \\fbox{1} and "), braced, F.lit("."))).when(k == 1, F.concat(F.lit("\\fbox{"), n, F.lit("}"))).when(k == 2, F.concat(F.lit("\\boxed "), n, F.lit("$ or "), braced)).otherwise(F.concat(F.lit("\\boxed{"), n))
    truth = F.concat((F.col("p_size") % 24).cast("string"), F.lit("/3"))
    return table(spark, sf, "part").select("p_partkey", G.boxed_answer(text).alias("answer"), G.boxed_score(text, truth).alias("score"), G.math_normal(F.concat(F.lit("x=0."), n)).alias("normal"))


@query("""WITH a AS (SELECT p_partkey, p_size AS x, (p_size % 7) / 100.0 AS y, (p_size % 11 = p_size) AS pair FROM part)
SELECT p_partkey, CASE WHEN len(list_filter([y / 100, y, y * 100], lambda t: abs(t - x) <= 1e-4 * greatest(abs(t), x))) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS percent, CASE WHEN pair THEN 1.0::DOUBLE ELSE 0.0 END AS pair FROM a""")
def grade_numeric(spark, sf):
    n = F.col("p_size").cast("string")
    pair = lambda x, y: F.concat(F.lit("("), x, F.lit(", "), y, F.lit(")"))
    percent = G.numeric_score(F.concat(n, F.lit("%")), ((F.col("p_size") % 7) / 100).cast("string"))
    two = G.numeric_score(pair(n, F.lit("2\\pi")), pair((F.col("p_size") % 11).cast("double").cast("string"), F.lit("6.2832")))
    return table(spark, sf, "part").select("p_partkey", percent.alias("percent"), two.alias("pair"))


@query("""WITH a AS (SELECT o_custkey, list(o_orderpriority) AS x, list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS y FROM orders GROUP BY 1),
c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS m FROM orders GROUP BY ALL)
SELECT o_custkey, round(CASE WHEN sum(n) = sum(m) THEN 1.0 WHEN sum(m) = 0 THEN 0.0 ELSE sum(least(n, m)) / (sum(n) + sum(m) - sum(least(n, m))) END, 6) + 0.0::DOUBLE AS score FROM c GROUP BY 1""")
def tool_name_jaccard(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("x"), F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")))).alias("y"))
    return o.select("o_custkey", r6(G.multiset_jaccard(F.col("x"), F.col("y"))).alias("score"))


@query(f"SELECT doc_id, {s6('least(-(n_chars - (2000 - 500)) / 500.0, 0)')} AS penalty FROM documents")
def overlong_penalty(spark, sf):
    return table(spark, sf, "documents").select("doc_id", r6(G.overlong_penalty(F.col("n_chars"), 2000, 500)).alias("penalty"))


@query(f"""WITH a AS (SELECT p_partkey, p_size, p_size / 50.0 AS x FROM part), s AS (SELECT *, CASE WHEN x <= 0.05 OR x >= 0.95 THEN 0 WHEN x < 0.25 THEN (x - 0.05) / 0.2 WHEN x <= 0.75 THEN 1 ELSE (0.95 - x) / 0.2 END AS area FROM a)
SELECT p_partkey, {s6('area')} AS area, {s6('CASE WHEN p_size % 7 = 0 THEN -1 WHEN x < 0.5 THEN least(0.45 * x + 0.2 + 0.15 * 0.5 + 0.1 + 0.1 * area, x) ELSE 0.45 * x + 0.2 + 0.15 * 0.5 + 0.1 + 0.1 * area END')} AS reward, {s6('1 / (1 + exp(-4 * (x - 0.5)))')} AS relative FROM s""")
def crop_reward(spark, sf):
    x = F.col("p_size") / 50.0
    area = G.area_score(x)
    reward = G.proxy_reward(x, F.lit(1.0), F.lit(0.5), F.lit(1.0), area, F.col("p_size") % 7 != 0)
    return table(spark, sf, "part").select("p_partkey", r6(area).alias("area"), r6(reward).alias("reward"), r6(G.relative_relevance(x, F.lit(0.5), 4.0)).alias("relative"))


@query(f"""WITH p AS (SELECT p_partkey, p_size % 7 AS k, p_size, CAST(round(p_retailprice) AS INT) % 3 = 0 AS hit FROM part)
SELECT p_partkey, {s6("CASE k WHEN 1 THEN CASE WHEN hit THEN 1 ELSE -1 END WHEN 5 THEN CASE WHEN hit THEN 1 ELSE 0.1 END WHEN 6 THEN (p_size % 4) / 4.0 ELSE CASE WHEN hit THEN 1 ELSE 0 END END")} AS score FROM p""")
def grade_dispatch(spark, sf):
    """Every kind of grader, on answers of which a third are right."""
    k, n = F.col("p_size") % 7, F.col("p_size").cast("string")
    truth = F.when(F.round("p_retailprice").cast("int") % 3 == 0, n).otherwise(F.concat(n, F.lit("7")))
    source = F.element_at(F.array(*map(F.lit, ("openai/gsm8k", "aime2024", "searchR1_nq", "lighteval/MATH", "numina_olympiads", "hiyouga/geometry3k", "apps"))), k + 1)
    around = F.element_at(F.array(*map(F.lit, ("so #### ", "Answer: ", "<answer>", "\\boxed{", "We see the answer is ", "<think>a</think> \\boxed{", ""))), k + 1)
    ending = F.element_at(F.array(*map(F.lit, ("", "", "</answer>", "}", ".0 cm", "}", ""))), k + 1)
    passed = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("p_size") % 4)
    return table(spark, sf, "part").select("p_partkey", r6(G.dispatch(source, F.concat(around, n, ending), truth, passed)).alias("score"))


_CALL = """concat('go <tool_call>{"name": "', event_type, '", "arguments": {"u": ', CAST(user_id AS {}), '}}</tool_call><tool_call>broken</tool_call> end')"""


@query("""SELECT event_id, event_type AS name, '{"u":' || user_id || '}' AS arguments, 'go  end' AS content FROM events""")
def tool_calls_hermes(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", _CALL.replace("{}", "STRING", 1) + " AS text")
    return e.select("event_id", F.inline(P.hermes_calls(F.col("text"))), P.hermes_content(F.col("text")).alias("content"))


@query("""SELECT event_id, event_type AS name, 'user' AS k, CAST(user_id AS VARCHAR) AS v FROM events WHERE event_id % 4 < 3 UNION ALL SELECT event_id, event_type, 'kind', 'x y' FROM events WHERE event_id % 4 < 3
UNION ALL SELECT event_id, 'again', 'user', '<b>' || event_type || '</b>' FROM events WHERE event_id % 4 = 2""")
def tool_calls_parameters(spark, sf):
    """One call; one with a name given twice; two with markup in a value and one without any; one never closed."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    one = lambda before: F.concat(F.lit("<tool_call><function="), kind, F.lit(before + "><parameter=user>\n"), user, F.lit("\n</parameter><parameter=kind>x y</parameter></function></tool_call>"))
    two = F.concat(one(""), F.lit("\nand <tool_call>\n<function=again>\n<parameter=user>\n<b>"), kind, F.lit("</b>\n</parameter>\n</function>\n</tool_call><tool_call><function=none></function></tool_call>"))
    text = F.element_at(F.array(one(""), one("><parameter=user>old</parameter><parameter=kind>z</parameter"), two, F.regexp_replace(one(""), "</tool_call>$", "")), (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", text.alias("text"))
    return e.select("event_id", F.inline(P.function_calls(F.col("text")))).select("event_id", "name", F.explode("arguments").alias("k", "v"))


@query("""SELECT event_id, event_type AS name, 'q' AS k, CAST(user_id AS VARCHAR) AS v FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, 'more', 'q', 'last' FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'more', 'r', '1 < 2' FROM events WHERE event_id % 3 = 1""")
def tool_calls_invoke(spark, sf):
    """One call; two, of which the second gives a name twice; one never closed."""
    one = F.concat(F.lit('<invoke name="'), "event_type", F.lit('"><parameter name="q">'), F.col("user_id").cast("string"), F.lit("</parameter></invoke>"))
    more = F.lit('<invoke name="more"><parameter name="q">first</parameter>\n<parameter name="r"> 1 < 2 </parameter><parameter name="q">last</parameter></invoke>')
    text = F.element_at(F.array(one, F.concat(F.lit("so "), one, F.lit(" then "), more), F.replace(one, F.lit("</invoke>"), F.lit(""))), (F.col("event_id") % 3 + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", text.alias("text"))
    return e.select("event_id", F.inline(P.invoke_calls(F.col("text")))).select("event_id", "name", F.explode("arguments").alias("k", "v"))


@query("SELECT event_id, event_type AS name, CASE WHEN user_id % 2 = 0 THEN '{\"a\":1}' ELSE '{}' END AS arguments FROM events")
def tool_calls_marked(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("<|tool_call_begin|>functions."), "event_type", F.lit(":0<|tool_call_argument_begin|>"), F.when(F.col("user_id") % 2 == 0, '{"a":1}').otherwise("oops"), F.lit("<|tool_call_end|>")).alias("text"))
    return e.select("event_id", F.inline(P.marked_calls(F.col("text"))))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS cx, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 2 = 0 END AS strict FROM part")
def crop_action_parse(spark, sf):
    body = F.concat(F.lit('{"cx": '), F.col("p_size").cast("string"), F.lit(', "cy": 5, "area": '), F.when(F.col("p_size") % 5 == 0, "true").otherwise("9"), F.lit("}"))
    x = P.crop_action(F.concat(F.lit("<crop>"), body, F.when(F.col("p_size") % 2 == 0, "</crop>").otherwise("")))
    return table(spark, sf, "part").select("p_partkey", x["cx"].alias("cx"), x["strict"].alias("strict"))


@query("""WITH d AS (SELECT doc_id, 'by ' || source || ' ' AS s, ['image', 'video', 'audio'][doc_id % 3 + 1] AS tag, doc_id % 4 AS n FROM documents),
p AS (SELECT doc_id, s, tag, n, unnest(range(0, 2 * n + 1)) AS k FROM d)
SELECT doc_id, k + 1 AS at, CASE WHEN k % 2 = 0 THEN 'text' ELSE tag END AS type, CASE WHEN k % 2 = 0 THEN CASE WHEN k = 0 THEN s ELSE ' ' || (k // 2 - 1) END END AS text FROM p""")
def media_parts(spark, sf):
    tag = F.element_at(F.array(*map(F.lit, ("<image>", "<video>", "<audio>"))), (F.col("doc_id") % 3 + 1).cast("int"))
    rest = F.array_join(F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), (F.col("doc_id") % 4).cast("int")), lambda i: F.concat(tag, F.lit(" "), i.cast("string"))), "")
    t = table(spark, sf, "documents").select("doc_id", F.posexplode(P.media_parts(F.concat(F.lit("by "), "source", F.lit(" "), rest))).alias("at", "p"))
    return t.select("doc_id", (F.col("at") + 1).alias("at"), "p.type", "p.text")


@query("SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS learned, sum(n)::BIGINT AS tokens FROM (SELECT conv_id, role, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS n FROM conversations) GROUP BY conv_id")
def sft_loss_mask(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    t = c.select("conv_id", Q.assistant_mask(F.col("m")).alias("t"))
    return t.select("conv_id", F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x["mask"]).alias("learned"), F.size("t").cast("bigint").alias("tokens"))


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_TURN = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"


@query(f"""SELECT conv_id, coalesce(string_agg(text || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS learned,
CASE WHEN arg_min(role, turn) = 'system' THEN '' ELSE '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) END || string_agg({_TURN}, '' ORDER BY turn) AS whole FROM conversations GROUP BY conv_id""")
def token_loss_mask(spark, sf):
    """Conversations as tokens: what the learned ones and all of them say."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("m"))
    told = H.loss_mask(c, "m", byte_tokenizer(), 1 << 20, pad="none")
    return H.learned_text(told.drop("m", "position_ids"), byte_tokenizer()).select("conv_id", "learned", "whole")


@query()
def token_prompt_filter(spark, sf):
    """Benchmark prompts of at most 96 tokens with their template."""
    b = table(spark, sf, "benchmark").select("item_id", F.array(F.struct(F.lit("user").alias("role"), "text")).alias("m"))
    return H.within_tokens(b, "m", byte_tokenizer(), 96).select("item_id")


@query("SELECT item_id AS index, 'user' AS role, text || ' Think.' AS content, 'bench' AS data_source, CAST(length(text) AS VARCHAR) AS ground_truth FROM benchmark")
def prompt_rows(spark, sf):
    b = table(spark, sf, "benchmark")
    rows = Q.prompt_row(b, "bench", "math", F.col("text"), F.length("text").cast("string"), "train", F.col("item_id"), "Think.")
    return rows.select("extra_info.index", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "data_source", "reward_model.ground_truth")


@query("SELECT page_id, replace(regexp_replace(replace(trim(' ' || url || ' [title] x [step] y  '), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') AS text FROM pages")
def completion_cleaner(spark, sf):
    return table(spark, sf, "pages").select("page_id", Q.clean_completion(F.concat(F.lit(" "), "url", F.lit(" [title] x [step] y  "))).alias("text"))


@query("SELECT p_partkey, 'part ' || p_name || ' at ' || CAST(p_size AS VARCHAR) || ' {other}' AS text FROM part")
def prompt_template(spark, sf):
    return table(spark, sf, "part").select("p_partkey", Q.render("part {title} at {n} {other}", title=F.col("p_name"), n=Q.short_number(F.col("p_size"))).alias("text"))


@query("SELECT doc_id, sha256(source || chr(0) || CAST(doc_id AS VARCHAR)) AS id FROM documents")
def stable_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.stable_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@query("SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || substr(md5('seed' || chr(0) || source), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM documents)")
def group_split_native(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.group_split(F.col("source"), "seed", {"train": 0.8, "validation": 0.1, "test": 0.1}, native=True).alias("split"))


@query()
def group_split_blake(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.group_split(F.col("source"), "seed", {"train": 0.8, "validation": 0.1, "test": 0.1}).alias("split"))


@query("SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE k <= CASE WHEN lang = 'en' THEN 5 WHEN lang = 'de' THEN 3 ELSE 2147483647 END")
def capped_split(spark, sf):
    return Q.capped_split(table(spark, sf, "documents"), "lang", "doc_id", {"en": 5, "de": 3}).select("doc_id")


@query("SELECT item_id, 0 AS side, text AS answer FROM benchmark UNION ALL SELECT item_id, 1, concat('no ', text) FROM benchmark")
def preference_rows(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("chosen"), F.concat(F.lit("no "), "text").alias("rejected"))
    return Q.preference_rows(b).select("item_id", "side", "answer")


_BOX = """WITH p AS (SELECT p_partkey, 800.0::DOUBLE AS w, 600.0::DOUBLE AS h, p_size / 50.0::DOUBLE AS a, 1.5::DOUBLE AS r, p_size * 16.0::DOUBLE AS cx FROM part),
s AS (SELECT *, least(1, least(w / sqrt(a * w * h * r), h / sqrt(a * w * h / r))) AS f FROM p), q AS (SELECT *, sqrt(a * w * h * r) * f AS bw, sqrt(a * w * h / r) * f AS bh FROM s),
b AS (SELECT p_partkey, bw, bh, least(greatest(cx, bw / 2), w - bw / 2) AS x, least(greatest(300, bh / 2), h - bh / 2) AS y FROM q)"""


@query(f"{_BOX} SELECT p_partkey, {s6('x - bw / 2')} AS x1, {s6('y - bh / 2')} AS y1, {s6('x + bw / 2')} AS x2, {s6('y + bh / 2')} AS y2 FROM b")
def crop_box(spark, sf):
    b = Q.box_of(F.col("p_size") * 16.0, F.lit(300.0), F.col("p_size") / 50.0, F.lit(800.0), F.lit(600.0), F.lit(1.5))
    return table(spark, sf, "part").select("p_partkey", *(r6(b[c]).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(f"{_BOX}, i AS (SELECT p_partkey, greatest(least(x + bw / 2, 400) - greatest(x - bw / 2, 0), 0) * greatest(least(y + bh / 2, 600) - greatest(y - bh / 2, 0), 0) AS o, bw * bh + 240000 AS t FROM b) SELECT p_partkey, {s6('o / (t - o)')} AS iou FROM i")
def box_iou(spark, sf):
    b = Q.box_of(F.col("p_size") * 16.0, F.lit(300.0), F.col("p_size") / 50.0, F.lit(800.0), F.lit(600.0), F.lit(1.5))
    half = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(400.0).alias("x2"), F.lit(600.0).alias("y2"))
    return table(spark, sf, "part").select("p_partkey", r6(Q.iou(b, half)).alias("iou"))


@query("SELECT p_partkey, arg_min(r, abs(ln(p_size / 10.0 / r))) AS ratio FROM part, (SELECT unnest([0.55, 1.02, 1.53, 2.07]::DOUBLE[]) AS r) GROUP BY p_partkey")
def nearest_ratio(spark, sf):
    return table(spark, sf, "part").select("p_partkey", Q.nearest_ratio(F.col("p_size") / 10.0, [0.55, 1.02, 1.53, 2.07]).alias("ratio"))


@query(f"SELECT p_partkey, {s6('CASE WHEN p_size / 30.0 > 1.5 THEN 30 * 1.5 ELSE p_size END')} AS w, {s6('CASE WHEN p_size / 30.0 > 1.5 THEN 30 ELSE p_size / 1.5 END')} AS h FROM part")
def inscribed_box(spark, sf):
    b = Q.inscribed(F.col("p_size").cast("double"), F.lit(30.0), F.lit(1.5))
    return table(spark, sf, "part").select("p_partkey", r6(b["w"]).alias("w"), r6(b["h"]).alias("h"))


@query("SELECT p_partkey, CASE WHEN p_size / 400.0 <= 0.005 THEN 'negligible' WHEN p_size / 400.0 <= 0.02 THEN 'small' WHEN p_size / 400.0 <= 0.05 THEN 'noticeable' WHEN p_size / 400.0 <= 0.10 THEN 'large' ELSE 'severe' END AS severity FROM part")
def crop_severity(spark, sf):
    return table(spark, sf, "part").select("p_partkey", Q.severity(F.col("p_size") / 400.0).alias("severity"))
