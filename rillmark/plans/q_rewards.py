"""Queries: rewards, tool-call dialects, actions, dataset builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import equality as E
from ..functions import graders as G
from ..functions import parsers as P
from ..functions import prompts as Q
from ..operators import arrays as R
from ..operators import batch as B
from ..operators import losses as L
from ..operators import registry as X
from ..operators import rewards as W
from .base import TOKENS_SQL, query, r6, s6, table, tokens

_T = f"WITH {TOKENS_SQL}"


def _text(*parts):
    """Text of literals and columns (which stand in a list)."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.col(p[0]).cast("string") for p in parts))


# ---- rewards


def _answers(spark, sf):
    """A number as answer to each order, right for a third of them."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice").cast("int").alias("p"))
    return o.select("o_orderkey", "o_custkey", "p", F.concat(F.lit("#### "), (F.col("p") - F.when(F.col("p") % 3 == 0, 0).otherwise(1)).cast("string")).alias("text"), F.col("p").cast("string").alias("truth"))


_RIGHT = "SELECT o_orderkey, o_custkey, CAST(round(o_totalprice) AS INT) AS p, CASE WHEN CAST(round(o_totalprice) AS INT) % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS acc FROM orders"


@query(f"SELECT o_orderkey, acc AS reward, acc FROM ({_RIGHT}) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def reward_naive(spark, sf):
    """A prompt's last output alone is scored."""
    last = W.last_output(_answers(spark, sf), ["o_custkey"], "o_orderkey")
    return W.naive(last, G.number_score(F.col("text"), F.col("truth"))).select("o_orderkey", "reward", "acc")


@query(f"SELECT o_orderkey, {s6('acc + least(-(p % 1000 - 600) / 400.0, 0)')} AS reward, acc, {s6('least(-(p % 1000 - 600) / 400.0, 0)')} AS overlong_reward, p % 1000 > 600 AS overlong FROM ({_RIGHT})")
def reward_overlong(spark, sf):
    out = X.REWARD_MANAGERS.get("dapo")(_answers(spark, sf), G.number_score(F.col("text"), F.col("truth")), F.col("p") % 1000, 1000, 400)
    return out.select("o_orderkey", r6("reward").alias("reward"), "acc", r6("overlong_reward").alias("overlong_reward"), "overlong")


@query(f"SELECT o_orderkey, {s6('acc + (p % 5) / 5.0')} AS reward, acc, {s6('(p % 5) / 5.0')} AS style FROM ({_RIGHT})")
def reward_components(spark, sf):
    out = X.REWARD_MANAGERS.get("gdpo")(_answers(spark, sf), acc=G.number_score(F.col("text"), F.col("truth")), style=(F.col("p") % 5) / 5.0)
    return out.select("o_orderkey", r6("reward").alias("reward"), "acc", r6("style").alias("style"))


@query("""WITH l AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS pos, sum(CASE WHEN l_linenumber <= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS n, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS acc FROM lineitem)
SELECT l_orderkey, pos, CASE WHEN pos = n - 1 THEN l_orderkey / 10.0 ELSE 0.0 END::DOUBLE AS rm_score, acc FROM l""")
def reward_tokens(spark, sf):
    """A trajectory's reward on its last valid token, with extra columns as they are named."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("n"), F.min("l_linenumber").alias("acc"))
    rows = lines.select("l_orderkey", "acc", F.transform("n", lambda x: F.when(x <= 4, 1).otherwise(0)).alias("mask"), (F.col("l_orderkey") / 10.0).alias("reward"))
    out = W.extract(W.token_rewards(rows, "mask"), ["l_orderkey", "acc"])
    return out.select("l_orderkey", F.posexplode("rm_scores").alias("pos", "rm_score"), "acc")


@query("SELECT item_id, CAST(item_id % 3 AS INT) AS worker FROM benchmark")
def reward_workers(spark, sf):
    return W.round_robin(table(spark, sf, "benchmark"), 3, "item_id").select("item_id", "worker")


@query(f"SELECT doc_id, {s6('(length(text) % 7 + length(source)) * 0.5')} AS score FROM documents")
def custom_reward(spark, sf):
    """A user's function of source, text and truth."""

    def judge(source, text, truth, weight):
        return weight * (len(text) % 7 + len(truth))

    from functools import partial

    score = X.scored_by(partial(judge, weight=0.5))
    return table(spark, sf, "documents").select("doc_id", r6(score(F.col("lang"), F.col("text"), F.col("source"))).alias("score"))


@query(f"WITH t AS (SELECT l_orderkey, list(l_returnflag <> 'R' ORDER BY l_linenumber, l_partkey, l_suppkey)[1:10] AS p FROM lineitem GROUP BY 1) SELECT l_orderkey, {s6('len(list_filter(p, lambda x: x)) / len(p)')} AS score FROM t")
def pass_fraction(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") != "R").alias("ok")))).alias("p"))
    return t.select("l_orderkey", r6(G.pass_fraction(F.transform("p", lambda x: x["ok"]))).alias("score"))


@query("""WITH e AS (SELECT event_id, event_id % 4 AS t, user_id % 5 AS a FROM events)
SELECT event_id, CASE WHEN t = a THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM e""")
def tool_call_format(spark, sf):
    """Truths and answers with thoughts and neither, a call, a response, both; and repeated tags."""
    call, says = "\n<tool_call>\n{}\n</tool_call>", "\n<response>ok</response>"
    parts = ["", call, says, call + says, call + call]
    truth = F.element_at(F.array(*(F.lit("<think>t</think>" + p) for p in parts[:4])), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.element_at(F.array(*(F.lit("<think>so\nit is</think>" + p) for p in parts)), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", G.call_format_reward(text, truth).alias("score"))


_TRAPEZOID = "CASE WHEN x <= 0.05 OR x >= 0.95 THEN 0 WHEN x < 0.25 THEN (x - 0.05) / 0.2 WHEN x <= 0.75 THEN 1 ELSE (0.95 - x) / 0.2 END"


@query(f"WITH a AS (SELECT p_partkey, p_size, p_size * 20 / 1000.0 AS x FROM part) SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN -1.0 ELSE {s6(_TRAPEZOID)} END AS reward FROM a")
def crop_reward_of_text(spark, sf):
    """From the text of an action to its reward: -1 without a valid action."""
    body = F.concat(F.lit('<crop>{"cx": 5, "cy": 7, "area": '), (F.col("p_size") * 20).cast("string"), F.when(F.col("p_size") % 6 == 0, ', "z": 1').otherwise(""), F.lit("}</crop>"))
    action = P.crop_action(body)
    return table(spark, sf, "part").select("p_partkey", r6(F.when(action.isNull(), -1.0).otherwise(G.area_score(action["area"] / 1000.0))).alias("reward"))


@query("""WITH p AS (SELECT p_partkey, p_size AS n, p_size % 6 AS k, CAST(round(p_retailprice) AS INT) % 2 = 0 AS same FROM part)
SELECT p_partkey, same AS "right", CASE k WHEN 0 THEN n || ' cm' WHEN 1 THEN '\\frac{' || n || '}{7}' WHEN 2 THEN '(' || n || ', 3)' WHEN 3 THEN n || ',000' WHEN 4 THEN CAST(n AS VARCHAR) ELSE 'x+' || n END AS answer, same AS formed FROM p""")
def competition_answers(spark, sf):
    """Answers of several shapes found in running text, of which half are the truth."""
    n, k = F.col("p_size").cast("string"), F.col("p_size") % 6
    said = F.when(k == 0, F.concat(F.lit("We get x = "), n, F.lit(" cm"))).when(k == 1, F.concat(F.lit("The answer is \\boxed{\\frac{"), n, F.lit("}{7}}. Done"))).when(k == 2, F.concat(F.lit("Answer: ("), n, F.lit(", 3)")))
    said = said.when(k == 3, F.concat(F.lit("there are "), n, F.lit(",000"))).when(k == 4, F.concat(n, F.lit(" is the answer"))).otherwise(F.concat(F.lit("it must be x+"), n))
    m = F.when(F.round("p_retailprice").cast("int") % 2 == 0, n).otherwise(F.concat(F.lit("9"), n))
    truth = F.when(k == 1, F.concat(F.lit("\\dfrac{"), m, F.lit("}{7}"))).when(k == 2, F.concat(F.lit("("), m, F.lit(", 3)"))).when(k == 3, F.concat(m, F.lit("000"))).when(k == 5, F.concat(F.lit("x + "), m)).otherwise(m)

    @F.pandas_udf("right boolean, formed boolean, answer string")
    def graded(s, t):
        import pandas as pd

        return pd.DataFrame([dict(zip(("right", "formed", "answer"), E.competition_score(a, b), strict=True)) for a, b in zip(s, t, strict=True)])

    x = graded(said, truth)
    return table(spark, sf, "part").select("p_partkey", x["right"].alias("right"), x["answer"].alias("answer"), x["formed"].alias("formed"))


# ---- distillation, entropy


@query(f"{_T} SELECT {s6('sum(sum_pi_squared * mask) / sum(mask)')} AS loss FROM tok")
def entropy_loss(spark, sf):
    return L.entropy_loss(tokens(spark, sf), F.col("sum_pi_squared")).select(r6("loss").alias("loss"))


@query(f"""WITH x AS MATERIALIZED (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE * 5 AS s FROM embeddings), y AS (SELECT vec_id, i, s, abs(s) AS t FROM x),
z AS (SELECT vec_id, ln(sum(exp(s))) AS sl, ln(sum(exp(t))) AS tl FROM y GROUP BY 1), r AS (SELECT y.vec_id, s - sl AS s, t - tl AS t, row_number() OVER (PARTITION BY y.vec_id ORDER BY t DESC, i) AS a, row_number() OVER (PARTITION BY y.vec_id ORDER BY s DESC, i) AS b FROM y JOIN z USING (vec_id))
SELECT vec_id, {s6('greatest(sum(exp(t) * (t - s)), 0)')} AS loss, {s6('sum(exp(s))')} AS student_mass, {s6('sum(exp(t))')} AS teacher_mass, CAST(count(*) FILTER (WHERE b <= 8) AS INT) AS overlap FROM r WHERE a <= 8 GROUP BY vec_id""")
def forward_kl_topk(spark, sf):
    z = F.transform("embedding", lambda v: v.cast("double") * 5)
    out = table(spark, sf, "embeddings").select("vec_id", X.DISTILLATION.get("forward_kl_topk")(z, F.transform(z, F.abs), 8).alias("d"))
    return out.select("vec_id", *(r6(f"d.{c}").alias(c) for c in ("loss", "student_mass", "teacher_mass")), "d.overlap")


@query(f"""{_T}, d AS (SELECT mask, least(0.5 * (lp - ref_lp) * (lp - ref_lp), 0.001) AS l, exp(lp - old_lp) AS r FROM tok)
SELECT {s6('sum(l * mask) / sum(mask)')} AS loss, {s6('sum(greatest(l * r, l * greatest(least(r, 1.2), 0.8)) * mask) / sum(mask)')} AS policy, {s6('min(l) FILTER (WHERE mask > 0)')} AS low, {s6('max(l) FILTER (WHERE mask > 0)')} AS high FROM d""")
def distillation_aggregate(spark, sf):
    """A divergence by its registered name, as a loss and as the advantage of a policy loss.
    Advantages are negative here, and no ratio is near three, so the second bound is idle."""
    loss = X.DISTILLATION.get("mse")(F.col("lp"), F.col("ref_lp"))
    plain = L.distillation(tokens(spark, sf), loss, "token-mean", 0.001)
    policy = L.distillation(tokens(spark, sf), loss, "token-mean", 0.001, (F.col("lp"), F.col("old_lp"))).select(F.col("loss").alias("policy"))
    return plain.crossJoin(F.broadcast(policy)).select(*(r6(c).alias(c) for c in ("loss", "policy", "low", "high")))  # one row each


# ---- tool calls


def _events(spark, sf, text):
    return table(spark, sf, "events").select("event_id", "event_type", "user_id", text.alias("text"))


@query("""SELECT event_id, event_type AS name, '{"u": ' || user_id || '}' AS arguments FROM events WHERE user_id % 3 = 2 UNION ALL SELECT event_id, 'again', '{}' FROM events WHERE event_id % 4 = 0""")
def tool_calls_channel(spark, sf):
    """Calls in the open, behind a thought that names one; without the mark of JSON it is none."""
    thought = F.lit("<|channel|>analysis<|message|>to=functions.no <|constrain|>json<|message|>{}<|call|><|end|>")
    head, k = "<|start|>assistant<|channel|>commentary to=functions.", F.col("user_id") % 3
    call = F.concat(F.lit(head), "event_type", F.when(k == 2, " <|constrain|>json").otherwise(""), F.lit('<|message|>{"u": '), F.col("user_id").cast("string"), F.lit("}<|call|>"))
    again = F.when(F.col("event_id") % 4 == 0, head + "again <|constrain|>json<|message|>{}<|call|>").otherwise("")
    e = _events(spark, sf, F.concat(thought, F.when(k == 0, "").otherwise(call), again))
    return e.select("event_id", F.inline(P.channel_calls(F.col("text"))))


def _arguments(e, calls):
    return e.select("event_id", F.inline(calls)).select("event_id", "name", F.explode("arguments").alias("k", "v"))


@query("""SELECT event_id, event_type AS name, 'user' AS k, CAST(user_id AS VARCHAR) AS v FROM events UNION ALL SELECT event_id, event_type, 'kind', to_json('x"y ' || event_id)::VARCHAR FROM events""")
def tool_calls_keyed(spark, sf):
    e = _events(spark, sf, _text("<tool_call>", ["event_type"], "<arg_key>user</arg_key>\n<arg_value>", ["user_id"], '</arg_value><arg_key>kind</arg_key><arg_value> x"y ', ["event_id"], " </arg_value></tool_call>"))
    return _arguments(e, P.typed(P.keyed_calls(F.col("text"))))


@query("""SELECT event_id, event_type AS name, 'a' AS k, CASE WHEN user_id % 2 = 0 THEN '[' || user_id || ']' ELSE to_json('no ' || user_id)::VARCHAR END AS v FROM events""")
def tool_calls_seed(spark, sf):
    value = F.when(F.col("user_id") % 2 == 0, _text("[", ["user_id"], "]")).otherwise(_text("no ", ["user_id"]))
    e = _events(spark, sf, F.concat(_text("<seed:tool_call>\n<function=", ["event_type"], ">\n<parameter=a>"), value, F.lit("</parameter>\n</function></seed:tool_call>")))
    return _arguments(e, P.typed(P.seed_calls(F.col("text"))))


@query("""SELECT event_id, event_type AS name, 's' AS k, to_json(CAST(user_id AS VARCHAR))::VARCHAR AS v FROM events UNION ALL SELECT event_id, event_type, 'n', CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE to_json('about ' || user_id)::VARCHAR END FROM events""")
def tool_calls_marked_parameters(spark, sf):
    """Strings by their mark, though they look like numbers; other values as JSON where they are."""
    m = P._MARK
    number = F.when(F.col("event_id") % 2 == 0, _text(["user_id"])).otherwise(_text("about ", ["user_id"]))
    text = F.concat(
        _text(f'thinking</think>hello\n\n<{m}tool_calls>\n<{m}invoke name="', ["event_type"], f'">\n<{m}parameter name="s" string="true">', ["user_id"], f'</{m}parameter>\n<{m}parameter name="n" string="false">'),
        number, F.lit(f"</{m}parameter>\n</{m}invoke>\n</{m}tool_calls>"),
    )
    return _arguments(_events(spark, sf, text), P.marked_invocations(F.col("text")))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'about ' || url WHEN 1 THEN '<think>so ' || url ELSE '' END AS text FROM pages")
def answer_after_thought(spark, sf):
    """Thoughts that end twice, don't end, and with nothing behind them."""
    text = F.element_at(F.array(_text("so</think>hm</think>about ", ["url"]), _text("<think>so ", ["url"]), _text("<think>", ["url"], "</think>")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", P.after_thought(text).alias("text"))


@query("""SELECT event_id, event_type AS name, 'q' AS k, to_json('a, ' || user_id || '}c')::VARCHAR AS v FROM events UNION ALL SELECT event_id, event_type, 'n', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, event_type, 'f', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'null' END FROM events UNION ALL SELECT event_id, event_type, 'w', to_json('w' || user_id)::VARCHAR FROM events""")
def tool_calls_braces(spark, sf):
    """Quoted and bare values of a small grammar; a brace inside quotes doesn't end a call."""
    flag = F.when(F.col("user_id") % 2 == 0, "True").otherwise("NULL")
    text = F.concat(_text("<|tool_call>call:", ["event_type"], '{q:<|"|>a, ', ["user_id"], '}c<|"|>,n:', ["user_id"], ",f:"), flag, _text(",w:w", ["user_id"], "}<tool_call|>"))
    return _arguments(_events(spark, sf, text), P.brace_calls(F.col("text")))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'open_page' WHEN 2 THEN 'calc' ELSE 'y' || user_id END AS name FROM events")
def tool_name_inferred(spark, sf):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "search").when(k == 1, _text("functions.Open-Page:", ["user_id"])).when(k == 2, _text("x", ["user_id"])).otherwise(_text("y", ["user_id"]))
    keys = F.when(k == 2, F.array(F.lit("b"), F.lit("a"), F.lit("more"))).otherwise(F.array(F.lit("z")))
    return table(spark, sf, "events").select("event_id", P.named_tool(raw, keys, {"search": ["q"], "open_page": ["url"], "calc": ["a", "b"]}).alias("name"))


# ---- actions


@query("""WITH p AS (SELECT p_partkey, p_size * 3 AS cx, p_size % 3 = 0 AS fenced, p_size % 5 = 0 AS talk FROM part)
SELECT p_partkey, CASE WHEN cx <= 100 AND NOT talk THEN cx * 10 END AS cx, CASE WHEN cx <= 100 AND NOT talk THEN NOT fenced END AS strict FROM p""")
def percent_action_parse(spark, sf):
    body = _text('{"cx_pct": ', ["cx"], ', "cy_pct": 5, "area_pct": 9}')
    text = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("well "), body)).when(F.col("p_size") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    x = table(spark, sf, "part").withColumn("cx", F.col("p_size") * 3).select("p_partkey", P.percent_action(text).alias("x"))
    return x.select("p_partkey", "x.cx", "x.strict")


@query("""WITH p AS (SELECT p_partkey, ['crop', 'crop_pad', 'pad', 'cut'][p_size % 4 + 1] AS op, p_size AS x1, p_size * 2 % 70 AS x2 FROM part)
SELECT p_partkey, CASE WHEN op IN ('crop', 'crop_pad') AND x1 < x2 THEN op END AS operation, CASE WHEN op IN ('crop', 'crop_pad') AND x1 < x2 THEN x1 END AS x1 FROM p""")
def layout_action_parse(spark, sf):
    """Padding needs the whole image, which no box here is."""
    op = F.element_at(F.array(*map(F.lit, ("crop", "crop_pad", "pad", "cut"))), (F.col("p_size") % 4 + 1).cast("int"))
    text = F.concat(F.lit('{"operation": "'), op, F.lit('", "x1_pct": '), F.col("p_size").cast("string"), F.lit(', "y1_pct": 0, "x2_pct": '), (F.col("p_size") * 2 % 70).cast("string"), F.lit(', "y2_pct": 90}'))
    return table(spark, sf, "part").select("p_partkey", P.layout_action(text).alias("x")).select("p_partkey", "x.operation", "x.x1")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'crop' WHEN 1 THEN 'pad' END AS mode FROM part")
def mode_decision_parse(spark, sf):
    text = F.element_at(F.array(*map(F.lit, ('{"mode":"crop"}', ' {"mode": "pad"} ', '{"mode":"crop","why":1}', '{"mode":"both"}'))), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", P.mode_decision(text).alias("mode"))


@query(f"""WITH p AS (SELECT p_partkey, p_size, p_size % 2 = 0 AS c, p_size % 3 = 0 AS f, p_size / 60.0 AS x FROM part)
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL WHEN c AND f THEN 'crop_fill' WHEN c THEN 'crop' WHEN f THEN 'fill' ELSE 'keep' END AS operation, CASE WHEN p_size % 7 <> 0 AND c THEN {s6('x')} END AS "left", CASE WHEN p_size % 7 <> 0 AND f THEN p_size END AS red FROM p""")
def crop_fill_parse(spark, sf):
    """Fields in their order, a box only with a crop and a colour only with a fill; every seventh
    has its first two fields the other way round."""
    c, f, n = F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0, F.col("p_size")
    box = F.when(c, F.concat(F.lit("["), (n / 60).cast("string"), F.lit(",0,1,1]"))).otherwise("null")
    colour = F.when(f, F.concat(F.lit("["), n.cast("string"), F.lit(",0,255]"))).otherwise("null")
    first = F.when(n % 7 == 0, F.concat(F.lit('{"is_cropped":'), c.cast("string"), F.lit(',"target_ratio":1.5'))).otherwise(F.concat(F.lit('{"target_ratio":1.5,"is_cropped":'), c.cast("string")))
    text = F.concat(first, F.lit(',"is_filled":'), f.cast("string"), F.lit(',"crop_box":'), box, F.lit(',"fill_color":'), colour, F.lit("}"))
    x = table(spark, sf, "part").select("p_partkey", P.crop_fill(text).alias("x"))
    return x.select("p_partkey", F.when(F.col("x").isNotNull(), P.operation_of(F.col("x.is_cropped"), F.col("x.is_filled"))).alias("operation"), r6(F.get("x.crop_box", F.lit(0))).alias("left"), F.get("x.fill_color", F.lit(0)).alias("red"))


# ---- dataset builders


@query("SELECT item_id AS index, text || ' Think.' AS content, CAST(length(text) * 1000 AS VARCHAR) AS ground_truth, text || ' #### ' || length(text) || ',000' AS answer FROM benchmark")
def word_problem_rows(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("answer", F.concat("text", F.lit(" #### "), F.length("text").cast("string"), F.lit(",000")))
    rows = Q.word_problem_rows(b, "bench", "text", "answer", "train", F.col("item_id"), "Think.")
    return rows.select("extra_info.index", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "extra_info.answer")


@query("SELECT p_partkey AS index, '\\frac{' || p_size || '}{9}' AS ground_truth, p_name || ' Box it.' AS content FROM part")
def boxed_rows(spark, sf):
    p = table(spark, sf, "part").withColumn("solution", F.concat(F.lit("so \\boxed{\\frac{"), F.col("p_size").cast("string"), F.lit("}{9}}.")))
    rows = Q.boxed_rows(p, "parts", "p_name", "solution", "test", F.col("p_partkey"), "Box it.")
    return rows.select("extra_info.index", "reward_model.ground_truth", F.col("prompt")[0]["content"].alias("content"))


def _numbered(spark, sf):
    return B.with_row_index(table(spark, sf, "documents").select("doc_id", "lang", "source", F.md5("text").alias("h")), ["doc_id"])


_NUMBERED = "SELECT doc_id, lang, source, md5(text) AS h, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, count(*) OVER () AS n FROM documents"


@query(f"SELECT row_idx * 2 + k AS row_idx, h AS prompt, CASE WHEN k = 0 THEN lang ELSE source END AS response FROM ({_NUMBERED}), (SELECT unnest([0, 1]) AS k)")
def both_responses(spark, sf):
    return Q.both_responses(_numbered(spark, sf), "h", "lang", "source")


@query(f"SELECT row_idx, 'train' AS split FROM ({_NUMBERED}) WHERE row_idx < round(n * 0.75) UNION ALL SELECT row_idx, 'test' FROM ({_NUMBERED}) WHERE row_idx >= n - round(n * 0.25)")
def reward_model_split(spark, sf):
    d = _numbered(spark, sf)
    return Q.reward_model_split(d, d.count()).select("row_idx", "split")


@query("SELECT page_id, 'See ' || url || '. more' AS query, ['go to ' || url, 'x y'] AS choices, CAST(page_id % 2 AS INT) AS gold FROM pages")
def choice_rows(spark, sf):
    p = table(spark, sf, "pages")
    x = Q.choice_row(_text("See ", ["url"], " [title] more"), F.array(_text(" go to ", ["url"], "[header]"), F.lit("x  y")), F.col("page_id") % 2)
    return p.select("page_id", x.alias("x")).select("page_id", "x.*")


@query("SELECT item_id AS index, 'searchR1_nq' AS data_source, 'Ask: ' || text AS content, CASE WHEN item_id % 2 = 0 THEN [text] ELSE ['golden', CAST(item_id AS VARCHAR)] END AS truth FROM benchmark")
def search_prompt_rows(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("source", F.lit("nq"))
    truth = F.when(F.col("item_id") % 2 == 0, F.array("text"))
    rows = Q.search_rows(b, "text", truth, F.array(F.lit("golden"), F.col("item_id").cast("string")), "source", "train", F.col("item_id"), "You search.", "Ask: \n")
    return rows.select("extra_info.index", "data_source", F.col("prompt")[1]["content"].alias("content"), "extra_info.tools_kwargs.search.create_kwargs.ground_truth").withColumnRenamed("ground_truth", "truth")


@query("SELECT item_id AS index, true AS need, CAST(length(text) AS VARCHAR) AS truth FROM benchmark")
def tool_rows(spark, sf):
    rows = Q.prompt_row(table(spark, sf, "benchmark"), "bench", "math", F.col("text"), F.length("text").cast("string"), "train", F.col("item_id"))
    out = Q.with_tool(rows, "code_interpreter", F.col("reward_model.ground_truth"))
    return out.select("extra_info.index", F.col("extra_info.need_tools_kwargs").alias("need"), F.col("extra_info.tools_kwargs.code_interpreter.create_kwargs.ground_truth").alias("truth"))


@query("SELECT conv_id AS index, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS place, role, text AS content FROM conversations")
def fixed_conversations(spark, sf):
    c = Q.conversations_of(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return c.select("index", F.posexplode("messages").alias("place", "m")).select("index", "place", "m.role", "m.content")


@query("SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda w: w <> ''), ' ') AS title FROM documents")
def squeezed_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.squeeze_title(F.col("text")).alias("title"))


@query("""WITH i AS (SELECT doc_id, sha256('asset' || chr(0) || source) AS a, CAST('0x' || substr(md5('7' || chr(0) || source), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM documents), s AS (SELECT *, CASE WHEN u < 0.6 THEN 'train' ELSE 'test' END AS split FROM i)
SELECT split, count(*) AS rows, count(DISTINCT a) AS groups FROM s GROUP BY split""")
def source_index_report(spark, sf):
    return Q.index_report(Q.source_index(table(spark, sf, "documents"), "doc_id", "source", 7, {"train": 0.6, "test": 0.4}))


@query(f"""SELECT p_partkey, 1.5::DOUBLE AS target_ratio, CASE WHEN p_size % 2 = 0 THEN {s6('p_size / 800.0')} END AS "left", CASE WHEN p_size % 2 = 0 THEN {s6('(p_size + 300) / 600.0')} END AS bottom, CASE WHEN p_size % 3 = 0 THEN p_size END AS red, p_name AS description FROM part""")
def detail_targets(spark, sf):
    n = F.col("p_size").cast("bigint")
    cropped = F.col("p_size") % 2 == 0
    box = F.when(cropped, F.array(n, F.lit(3).cast("bigint"), n + 450, n + 300)).otherwise(F.array(*(F.lit(x).cast("bigint") for x in (0, 0, 800, 600))))
    x = Q.detail_target(box, F.lit(800), F.lit(600), F.lit(1.5), cropped, F.col("p_size") % 3 == 0, F.array(F.col("p_size"), F.lit(0), F.lit(0)), _text(" ", ["p_name"], " "))
    t = table(spark, sf, "part").select("p_partkey", x.alias("x"))
    return t.select("p_partkey", "x.target_ratio", r6(F.get("x.crop_box", F.lit(0))).alias("left"), r6(F.get("x.crop_box", F.lit(3))).alias("bottom"), F.get("x.fill_color", F.lit(0)).alias("red"), "x.description")


@query("SELECT page_id, url || '.png' AS image, 65536 AS min_pixels, 1048576 AS max_pixels FROM pages")
def media_descriptors(spark, sf):
    m = Q.media_descriptors(F.array(_text(["url"], ".png")), 65536, 1048576)
    return table(spark, sf, "pages").select("page_id", F.inline(m))


@query("""WITH h AS (SELECT conv_id, sha256('[' || string_agg('{"role":"' || role || '","n":' || length(text) || '}', ',' ORDER BY turn) || ']') AS h FROM conversations GROUP BY 1),
a AS (SELECT k // 64 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM (SELECT h, row_number() OVER (ORDER BY conv_id) - 1 AS k FROM h) x GROUP BY x.k // 64), b AS (SELECT k // 64 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM a x GROUP BY x.k // 64)
SELECT sha256(string_agg(h, '' ORDER BY k)) AS digest FROM b""")
def messages_digest(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("m"))
    return Q.messages_digest(c.withColumn("m", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["n"].alias("n")))), "m", "conv_id")


@query("""SELECT p_partkey, '{"size":' || p_size || ',"name":"' || p_name || '","none":null}' AS content, p_type AS description FROM part""")
def without_description(spark, sf):
    text = _text('{"size":', ["p_size"], ',"description":"', ["p_type"], '","name":"', ["p_name"], '","none":null}')
    return table(spark, sf, "part").select("p_partkey", Q.without_description(text).alias("x")).select("p_partkey", "x.*")


@query("""SELECT unnest(['roles', 'image', 'target', 'ratio', 'flags']) AS fault, unnest([count(*) FILTER (WHERE p_size % 4 = 0), count(*) FILTER (WHERE p_size % 5 = 0), count(*) FILTER (WHERE p_size % 6 = 0), count(*) FILTER (WHERE p_size % 6 = 0 OR p_size % 7 = 0), count(*) FILTER (WHERE p_size % 6 = 0)]) AS n FROM part""")
def detail_faults(spark, sf):
    n = F.col("p_size")
    target = F.concat(F.lit('{"target_ratio":1.5,"is_cropped":false,"is_filled":false,"crop_box":null,"fill_color":null,"description":"'), F.when(n % 6 == 0, " ").otherwise("x"), F.lit('"}'))
    message = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    m = F.array(message(F.when(n % 4 == 0, "system").otherwise("user"), F.when(n % 5 == 0, "no image").otherwise("<image> look")), message(F.lit("assistant"), target))
    rows = table(spark, sf, "part").select(m.alias("messages"), F.when(n % 7 == 0, 2.0).otherwise(1.5).alias("target_ratio"), F.lit(False).alias("is_cropped"), F.lit(False).alias("is_filled"))
    return Q.detail_faults(rows)


# ---- ragged arrays


def _r4(x):
    """Four decimals, and a negative number that rounds to zero stays negative, as in SQL."""
    return F.round(F.abs(x), 4) * F.signum(x)


def _lists(spark, sf):
    """The first numbers of each vector, as many as its label says."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", F.lit(1), F.col("label") % 5 + 1), lambda v: _r4(v.cast("double"))).alias("x"))


_LISTS = "SELECT vec_id, label, list_transform(embedding[1:label % 5 + 1], lambda v: round(v::DOUBLE, 4)) AS x FROM embeddings"


@query(f"SELECT vec_id, list_concat(x, list_transform(range(6 - len(x)), lambda i: -1.0::DOUBLE)) AS x FROM ({_LISTS})")
def pad_right_lists(spark, sf):
    return _lists(spark, sf).select("vec_id", R.pad_right(F.col("x"), F.lit(6), F.lit(-1.0)).alias("x"))


@query(f"SELECT vec_id, x FROM ({_LISTS})")
def remove_left_padding(spark, sf):
    n = F.size("x")
    padded, mask = F.concat(F.array_repeat(F.lit(9.0), 8 - n), F.col("x")), F.concat(F.array_repeat(F.lit(0), 8 - n), F.array_repeat(F.lit(1), n))
    return _lists(spark, sf).select("vec_id", R.remove_left_padding(padded, mask).alias("x"))


@query("SELECT vec_id, list_transform(embedding[63 - label % 5:64], lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS mask FROM embeddings")
def response_mask_tail(spark, sf):
    mask = F.transform("embedding", lambda v: F.when(v > 0, 1).otherwise(0))
    return table(spark, sf, "embeddings").select("vec_id", R.mask_tail(mask, F.col("label") % 5 + 2).alias("mask"))


@query("SELECT vec_id, list_transform(range(6), lambda i: CASE WHEN i < label % 5 THEN 1 ELSE 0 END) AS mask FROM embeddings")
def length_mask(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", R.mask_of_length(F.col("label") % 5, F.lit(6)).alias("mask"))


@query("SELECT vec_id, list_transform(range(6), lambda i: CASE WHEN i = label % 5 THEN vec_id / 4.0 ELSE 0.0 END::DOUBLE) AS reward FROM embeddings")
def reward_at_last_token(spark, sf):
    mask = R.mask_of_length(F.col("label") % 5 + 1, F.lit(6))
    return table(spark, sf, "embeddings").select("vec_id", R.at_last_valid(F.col("vec_id") / 4.0, mask).alias("reward"))
