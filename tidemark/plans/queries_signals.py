"""Catalog: feedback, rephrases, clusters and re-check over the whole event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals
from . import oracle as o
from .catalog import query

_GOOD = "(rating > 0 OR kind IN ('copy', 'citation_click'))"
_W = "CASE kind WHEN 'explicit' THEN 1.0::DOUBLE WHEN 'copy' THEN 0.5 WHEN 'citation_click' THEN 0.3 ELSE 0.7 END"


def _signals_sql(source: str) -> str:
    return f"""SELECT chunk_id, round(sum(CASE WHEN {_GOOD} THEN {_W} ELSE 0 END), 4) AS good,
      round(sum(CASE WHEN NOT {_GOOD} AND (rating < 0 OR kind = 'rephrase') THEN {_W} ELSE 0 END), 4) AS bad
      FROM {source} JOIN (SELECT DISTINCT trace_id, chunk_id FROM citations_v) USING (trace_id) GROUP BY 1"""


def _rounded(df):
    return df.select("chunk_id", F.round("good", 4).alias("good"), F.round("bad", 4).alias("bad"))


@query("g1_chunk_signals", o.with_views("traces_v feedback_v citations_v", _signals_sql("feedback_v")))
def _(t):
    return _rounded(signals.chunk_signals(t.feedback(), t.citations()))


@query(
    "g2_reopen",
    o.with_views(
        "traces_v feedback_v",
        f"""b AS (SELECT DISTINCT trace_id FROM feedback_v WHERE NOT {_GOOD} AND (rating < 0 OR kind = 'rephrase'))
        SELECT t.trace_id, negative_signal OR b.trace_id IS NOT NULL AS negative_signal, diagnosed AND b.trace_id IS NULL AS diagnosed
        FROM traces_v t LEFT JOIN b ON b.trace_id = t.trace_id""",
    ),
)
def _(t):
    return signals.reopen_negative(t.traces(), t.feedback()).select("trace_id", "negative_signal", "diagnosed")


@query(
    "g3_correction_goldens",
    o.with_views(
        "traces_v feedback_v",
        """SELECT trace_id, kb_id, query AS question, f.correction AS expected_answer, user_id % 50 = 0 AS active
        FROM feedback_v f JOIN traces_v USING (trace_id) WHERE f.correction <> '' AND rating < 0""",
    ),
)
def _(t):
    made = signals.correction_goldens(t.feedback(), t.traces(), F.pmod("user_id", F.lit(50)) == 0)
    return made.select("trace_id", "kb_id", "question", "expected_answer", "active")


@query(
    "g4_rephrases",
    o.with_views(
        "turns_v",
        f"""p AS (SELECT session_id, trace_id, lag(trace_id) OVER w AS prev_id, created_at, lag(created_at) OVER w AS prev_at,
             query, lag(query) OVER w AS prev_q FROM turns_v WINDOW w AS (PARTITION BY session_id ORDER BY created_at)),
        x AS (SELECT *, {o.content_terms('query')} AS a, {o.content_terms('prev_q')} AS b FROM p
              WHERE prev_id IS NOT NULL AND lower(query) <> lower(prev_q) AND created_at - prev_at <= INTERVAL 3 MINUTE)
        SELECT trace_id, prev_id AS rephrase_of, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)), 4) AS similarity
        FROM x WHERE len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) >= 0.1""",
    ),
)
def _(t):
    return signals.rephrases(t.turns(), threshold=0.1).select("trace_id", "rephrase_of", F.round("similarity", 4).alias("similarity"))


@query("g5_clusters")
def _(t):
    return signals.cluster_questions(t.turns(), similarity=0.4)


def _rechecks(t):
    k = F.col("k")
    return t.traces().join(t.feedback().select("trace_id", "correction"), "trace_id").select(
        "trace_id",
        "kb_id",
        "user_id",
        F.col("query").alias("question"),
        "correction",
        (~F.col("status").isin("direct", "error", "escalated")).alias("checkable"),
        (F.pmod(k, F.lit(17)) == 0).alias("check_failed"),
        F.coalesce((F.col("groundedness") >= 0.8) & (F.col("contradiction") == 0), F.lit(False)).alias("orig_supported"),
        F.when(F.col("correction") != "", F.col("coverage") >= 0.5).alias("corr_supported"),
        F.when(F.pmod(k, F.lit(3)) == 0, "failed").otherwise("verified").alias("fresh_status"),
    ).withColumn("verdict", signals.recheck_verdict())


_RECHECK = """rechecks_v AS (SELECT *, CASE WHEN verdict0 = 'fixed' AND fresh <> 'verified' THEN 'unclear' ELSE verdict0 END AS verdict FROM (
  SELECT *, CASE WHEN failed THEN 'error' WHEN NOT checkable THEN CASE WHEN corr THEN 'you_were_right' ELSE 'not_checkable' END
     WHEN corr IS NULL THEN CASE WHEN orig THEN 'stands' ELSE 'fixed' END
     WHEN orig AND corr THEN 'both' WHEN orig THEN 'stands_correction_unsupported' WHEN corr THEN 'you_were_right' ELSE 'fixed' END AS verdict0
  FROM (SELECT t.trace_id, t.kb_id, t.user_id, t.query AS question, f.correction, t.status NOT IN ('direct', 'error', 'escalated') AS checkable,
     k % 17 = 0 AS failed, coalesce(groundedness >= 0.8 AND contradiction = 0, false) AS orig,
     CASE WHEN f.correction <> '' THEN coverage >= 0.5 END AS corr, CASE WHEN k % 3 = 0 THEN 'failed' ELSE 'verified' END AS fresh
     FROM traces_v t JOIN feedback_v f USING (trace_id))))"""


@query("g6_recheck_verdict", o.with_views("traces_v feedback_v", _RECHECK + " SELECT trace_id, verdict FROM rechecks_v"))
def _(t):
    return _rechecks(t).select("trace_id", "verdict")


@query(
    "g7_undo_negative",
    o.with_views(
        "traces_v feedback_v citations_v",
        _RECHECK
        + """, kept AS (SELECT * FROM feedback_v WHERE NOT (kind = 'explicit' AND rating < 0
          AND trace_id IN (SELECT trace_id FROM rechecks_v WHERE verdict LIKE 'stands%'))) """
        + _signals_sql("kept"),
    ),
)
def _(t):
    kept = signals.undo_negative(t.feedback(), _rechecks(t))
    return _rounded(signals.chunk_signals(kept, t.citations()))


@query(
    "g8_recheck_goldens",
    o.with_views(
        "traces_v feedback_v",
        _RECHECK
        + """ SELECT trace_id, kb_id, question, correction AS expected_answer, coalesce(corr, false) AND user_id % 2 = 0 AS active,
        CASE WHEN corr THEN '' ELSE 'Not supported by the documents at re-check: review before enabling.' END AS note
        FROM rechecks_v WHERE correction <> ''""",
    ),
)
def _(t):
    return signals.recheck_goldens(_rechecks(t), F.pmod("user_id", F.lit(2)) == 0)
