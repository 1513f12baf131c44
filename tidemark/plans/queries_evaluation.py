"""Catalog: evaluation and canary comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluation
from . import oracle as o
from .catalog import query
from .tables import as_of


@query("j1_golden_sample")
def _(t):
    return evaluation.golden_sample(t.golden(), 10).select("kb_id", "item_id")


def _judged(t):
    """Every assistant turn as an answer to be judged against the turn before it."""
    c = t.conversations
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id")
    answers = c.where(F.col("role") == "assistant").select(key, "conv_id", "turn", F.col("text").alias("answer"))
    asked = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    expected = F.when(F.pmod("turn", F.lit(3)) == 0, "").when(F.pmod("turn", F.lit(5)) == 0, "Not found in the files").otherwise(F.col("asked"))
    rows = answers.join(asked, ["conv_id", "turn"]).withColumn("expected", expected)
    cites = rows.select("item_id", F.explode(text.sentences(F.col("asked"))).alias("text"))
    return evaluation.judge(rows, cites)


_JUDGE = f"""WITH r AS (SELECT a.conv_id * 1000 + a.turn AS item_id, a.conv_id, a.turn, a.text AS answer, q.text AS asked,
    CASE WHEN a.turn % 3 = 0 THEN '' WHEN a.turn % 5 = 0 THEN 'Not found in the files' ELSE q.text END AS expected
  FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant'),
t AS (SELECT *, {o.content_terms('answer')} AS ans, {o.content_terms('expected')} AS et FROM r),
c AS (SELECT item_id, ans, {o.content_terms('s')} AS ct FROM (SELECT item_id, ans, unnest({o.sentences('asked')}) AS s FROM t)),
cs AS (SELECT item_id, avg((({o.overlap('ct', 'ans')}) > 0.1 OR ({o.overlap('ans', 'ct')}) > 0.3)::INT) AS cited FROM c GROUP BY 1),
f AS (SELECT t.*, coalesce(cited, CASE WHEN len(ans) = 0 THEN 1 ELSE 0 END) AS ca,
  CASE WHEN expected = '' THEN CASE WHEN len(ans) = 0 THEN 0 ELSE 0.7 END
    WHEN regexp_matches(expected, {o.q(o.fixed.NOT_FOUND_EXPECTED)}) THEN (regexp_matches(answer, {o.q(o.fixed.ABSTAINED)}) OR len(ans) = 0)::INT
    ELSE {o.overlap('et', 'ans')} END::DOUBLE AS fa FROM t LEFT JOIN cs USING (item_id)),
j AS (SELECT *, round(0.8 * fa + 0.2 * ca, 3) AS overall FROM f)"""


@query("j2_judge", _JUDGE + " SELECT item_id, round(fa, 3) AS fact, round(ca, 3) AS cited, overall FROM j")
def _(t):
    return _judged(t).select(
        "item_id", F.col("factual_accuracy").alias("fact"), F.col("citation_accuracy").alias("cited"), "overall"
    )


@query(
    "j3_doc_recall",
    o.with_views(
        "traces_v citations_v",
        """SELECT trace_id, CASE WHEN k % 3 = 0 THEN NULL ELSE (bool_or(doc_id = k) OR bool_or(doc_id = k + 100))::INT::DOUBLE END AS recall
        FROM traces_v JOIN citations_v USING (trace_id) GROUP BY trace_id, k""",
    ),
)
def _(t):
    cited = t.citations().groupBy("trace_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("cited"))
    none = F.array().cast("array<string>")
    wanted = F.when(F.pmod("k", F.lit(3)) == 0, none).otherwise(F.array(F.col("k").cast("string"), (F.col("k") + 100).cast("string")))
    rows = t.traces().select("trace_id", wanted.alias("expected")).join(cited, "trace_id")
    return rows.select("trace_id", evaluation.doc_recall(F.col("expected"), F.col("cited")).alias("recall"))


def _results(t):
    """Evaluation rows of both config versions from the trace log."""
    k = F.col("k")
    rows = t.traces().select(
        "config_version",
        "kb_id",
        F.concat(F.lit("q"), F.pmod("trace_id", F.lit(400)).cast("string")).alias("question"),
        F.when(F.pmod("user_id", F.lit(4)) == 0, "target").otherwise("golden").alias("kind"),
        F.when(F.pmod(k, F.lit(3)) == 0, "").otherwise("something").alias("expected"),
        "status",
        F.round(F.col("coverage"), 3).alias("overall"),
        "groundedness",
        F.when(F.pmod(k, F.lit(6)) != 0, (F.pmod(k, F.lit(6)) > 2).cast("double")).alias("doc_recall"),
        "llm_calls",
        "latency_ms",
        "trace_id",
    )
    return rows.withColumn("passed", evaluation.passed())


_RES = """e AS (SELECT *, CASE WHEN kind = 'target' AND expected = '' THEN status = 'verified'
   WHEN expected <> '' AND status = 'failed' THEN overall >= 0.7 ELSE overall >= 0.7 AND status NOT IN ('error', 'failed') END AS passed
  FROM (SELECT config_version, kb_id, trace_id, 'q' || (trace_id % 400) AS question, CASE WHEN user_id % 4 = 0 THEN 'target' ELSE 'golden' END AS kind,
    CASE WHEN k % 3 = 0 THEN '' ELSE 'something' END AS expected, status, round(coverage, 3) AS overall, groundedness,
    CASE WHEN k % 6 <> 0 THEN (k % 6 > 2)::INT::DOUBLE END AS doc_recall, llm_calls, latency_ms FROM traces_v)),
s AS (SELECT config_version, kb_id, count(*) AS n, round(avg(passed::INT), 4) AS pass_rate, round(avg(overall), 4) AS judge_overall,
   round(avg(groundedness), 4) AS groundedness, round(avg((status = 'verified')::INT), 4) AS verified_rate, round(avg(doc_recall), 4) AS doc_recall,
   round(avg(llm_calls), 2) AS avg_llm_calls, floor(avg(latency_ms))::BIGINT AS avg_latency_ms FROM e GROUP BY 1, 2)"""


@query("j4_pass_rule", o.with_views("traces_v", _RES + " SELECT trace_id, passed FROM e"))
def _(t):
    return _results(t).select("trace_id", "passed")


@query("j5_summary", o.with_views("traces_v", _RES + " SELECT config_version::BIGINT AS config_version, * EXCLUDE (config_version) FROM s"))
def _(t):
    return evaluation.summarise(_results(t), ["config_version", "kb_id"])


@query(
    "j6_regressions",
    o.with_views(
        "traces_v",
        _RES
        + """ SELECT c.kb_id, c.pass_rate < b.pass_rate - 0.02 OR c.judge_overall < b.judge_overall - 0.02 AS regression,
          (SELECT count(DISTINCT question) FROM e WHERE config_version = 2 AND NOT passed AND e.kb_id = c.kb_id
             AND question IN (SELECT question FROM e WHERE config_version = 1 AND passed)) AS lost
        FROM s b JOIN s c USING (kb_id) WHERE b.config_version = 1 AND c.config_version = 2""",
    ),
)
def _(t):
    r = _results(t)
    base, cand = r.where(F.col("config_version") == 1), r.where(F.col("config_version") == 2)
    flags = evaluation.regressions(evaluation.summarise(base, ["kb_id"]), evaluation.summarise(cand, ["kb_id"]), ["kb_id"])
    lost = evaluation.lost_items(base, cand).groupBy("kb_id").agg(F.countDistinct("question").alias("lost"))
    return flags.select("kb_id", "regression").join(lost, "kb_id", "left").fillna(0)


@query("j7_assign_config")
def _(t):
    asked = t.events.select(F.col("event_id").alias("query_id"))
    return evaluation.assign_config(asked, canary=2, active=1, pct=0.2)


_STATS = """c AS (SELECT config_version, count(*) AS n, avg((status = 'verified')::INT) AS verified, avg(negative_signal::INT) AS negative,
  avg(coalesce(groundedness, 0)) AS groundedness FROM traces_v WHERE NOT is_eval AND created_at >= TIMESTAMP '2024-01-21' GROUP BY 1)"""


def _stats(t):
    return evaluation.version_stats(t.traces(), as_of() - F.expr("interval 10 days"))


@query(
    "j8_version_stats",
    o.with_views(
        "traces_v",
        _STATS + " SELECT config_version, n, round(verified, 4) AS verified, round(negative, 4) AS negative, round(groundedness, 4) AS groundedness FROM c",
    ),
)
def _(t):
    s = _stats(t)
    for c in ("verified", "negative", "groundedness"):
        s = s.withColumn(c, F.round(c, 4))
    return s


@query(
    "j9_canary_decision",
    o.with_views(
        "traces_v",
        _STATS
        + """ SELECT 2::BIGINT AS canary, x.n AS canary_n, y.n AS active_n, CASE WHEN x.n < 20 THEN 'expired'
          WHEN x.verified < y.verified - 0.05 OR x.negative > y.negative + 0.05 OR x.groundedness < y.groundedness - 0.05 THEN 'rolled_back'
          ELSE 'promoted' END AS decision FROM c x, c y WHERE x.config_version = 2 AND y.config_version = 1""",
    ),
)
def _(t):
    return evaluation.canary_decision(_stats(t), 2, 1, age_days=10)


@query("j10_ci_gate")
def _(t):
    return evaluation.below_gate(evaluation.summarise(_results(t), ["config_version", "kb_id"]), 0.9)
