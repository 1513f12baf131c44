"""Catalog: failure mining over the whole event log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text
from ..operators import mining
from ..session import cut_lineage, new_folder
from ..sources.trace_store import DETAILS, TraceStore
from . import oracle as o
from .catalog import query

ORIGINS = ("web", "rewrite", "widen", "neighbor", "exact", "cold")


class Log:
    """Child tables of the trace log that the rules read."""

    def __init__(self, t):
        self.t = t
        self.traces = t.traces().withColumn("diagnosed", mining.initially_diagnosed())
        self.mined = mining.mine_failures(self.traces)
        names = F.array(*[F.lit(x) for x in ORIGINS])
        origin = F.get(names, F.pmod(F.floor(F.col("k") / 5), F.lit(6)).cast("int"))
        doc = F.pmod("trace_id", F.lit(t.n_docs()))
        self.rescues = self.traces.where("healed").select(
            "trace_id",
            F.lit(0).alias("subq"),
            origin.alias("origin"),
            F.concat(doc.cast("string"), F.lit("-0")).alias("chunk_id"),
            F.lit("http://example.com").alias("url"),
            F.col("query").alias("question"),
        )
        titles = t.docs().select("doc_id", F.array("title").alias("queries"))
        self.rewrites = (
            self.traces.where("healed").select("trace_id", F.lit(0).alias("subq"), doc.alias("doc_id"))
            .join(titles, "doc_id").drop("doc_id")
        )
        self.errors = self.traces.where(F.col("llm_calls") == 0).select("trace_id")
        self.dropped = self.traces.where(F.col("status") == "partial").select("trace_id", F.col("query").alias("sentence"))
        self.conflicts = self.traces.where(F.col("contradiction") >= 0.4).select("trace_id")
        self.evidence = t.citations()
        self.unanswered = self.traces.select("trace_id", F.lit(0).alias("position"), F.col("query").alias("question"))
        self.docs = t.docs().withColumn("content_hash", text.content_hash(F.col("text")))
        source = F.concat("text", F.when(F.col("tier") == "cold", "!").otherwise(""))
        self.sources = t.docs().select("uri", text.content_hash(source).alias("source_hash"))

    def rescue(self):
        return mining.rescue_findings(self.mined, self.rescues, self.rewrites, self.t.chunks(), self.docs)

    def unsupported(self):
        return mining.unsupported_findings(self.mined, self.dropped)

    def conflict(self):
        return mining.conflict_findings(self.mined, self.conflicts, self.evidence)

    def gap(self):
        return mining.gap_findings(self.mined, self.rescues, self.errors, self.unanswered)

    def injection(self):
        return mining.injection_findings(self.mined, self.evidence, self.t.marked_chunks())

    def others(self):
        out = self.rescue()
        for part in (self.unsupported(), self.conflict(), self.gap(), self.injection()):
            out = out.unionByName(part)
        return out

    def negative(self):
        return mining.negative_findings(self.mined, self.evidence, self.docs, self.sources, self.others())

    def findings(self):
        others = cut_lineage(self.others(), "findings")
        return others.unionByName(
            mining.negative_findings(self.mined, self.evidence, self.docs, self.sources, others)
        )


_MINED = """mined_v AS (SELECT *, CASE WHEN status IN ('failed', 'partial') OR negative_signal THEN 1.0::DOUBLE ELSE 0.5 END AS severity FROM traces_v
   WHERE NOT is_eval AND NOT (status IN ('verified', 'direct', 'escalated') AND NOT healed)
     AND (status IN ('failed', 'partial') OR negative_signal OR healed))"""
_RAW = o.q(o.fixed.RAW_WORD)
_RESCUE = f""",
rescues_v AS (SELECT trace_id, kb_id, severity, created_at, query AS question, trace_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, (trace_id % (SELECT max(doc_id) + 1 FROM documents)) || '-0' AS chunk_id,
   ['web', 'rewrite', 'widen', 'neighbor', 'exact', 'cold'][(k // 5) % 6 + 1] AS origin FROM mined_v WHERE healed),
rw_v AS (SELECT r.*, d.status AS ds, d.tier AS dt, {o.tokens('c.text')} AS have,
   list_filter(regexp_extract_all(lower(r.question), {_RAW}), lambda w: w NOT IN ({o.STOP}) AND length(w) > 2) AS asked,
   list_filter(regexp_extract_all(lower(d.title), {_RAW}), lambda w: w NOT IN ({o.STOP}) AND length(w) > 2) AS said
   FROM rescues_v r JOIN chunks_v c USING (chunk_id) JOIN docs_v d ON d.doc_id = r.doc_id WHERE origin <> 'web'),
miss_v AS (SELECT trace_id, string_agg(DISTINCT w, '|' ORDER BY w) AS ws FROM (SELECT trace_id, have, unnest(asked) AS w FROM rw_v)
   WHERE NOT list_contains(have, {o.stem('w')}) GROUP BY 1),
pres_v AS (SELECT trace_id, string_agg(DISTINCT w, '|' ORDER BY w) AS ws FROM (SELECT trace_id, have, asked, unnest(said) AS w FROM rw_v)
   WHERE list_contains(have, {o.stem('w')}) AND NOT list_contains(asked, w) GROUP BY 1),
rf_v AS (SELECT trace_id, kb_id, severity, created_at, 'missing_content' AS root_cause, 'web:' || question AS target, '' AS user_words, '' AS doc_words
     FROM rescues_v WHERE origin = 'web'
   UNION ALL SELECT r.trace_id, kb_id, severity, created_at,
     CASE WHEN origin = 'rewrite' THEN 'vocabulary_gap' WHEN origin = 'widen' THEN 'ranking_miss' WHEN origin = 'neighbor' THEN 'bad_chunking'
       WHEN origin = 'cold' AND ds = 'quarantined' THEN 'twiddler_error' WHEN origin = 'cold' AND dt = 'cold' THEN 'ranking_miss' ELSE 'missing_context' END,
     CASE WHEN origin = 'neighbor' OR (origin = 'cold' AND ds = 'quarantined') THEN 'doc:' || doc_id
       WHEN origin = 'cold' AND dt = 'cold' THEN 'tier:' || doc_id ELSE 'chunk:' || chunk_id END,
     CASE WHEN origin = 'neighbor' OR (origin = 'cold' AND (ds = 'quarantined' OR dt = 'cold')) THEN '' ELSE coalesce(m.ws, '') END,
     CASE WHEN origin = 'rewrite' THEN coalesce(p.ws, '') ELSE '' END
   FROM rw_v r LEFT JOIN miss_v m USING (trace_id) LEFT JOIN pres_v p USING (trace_id))"""
_OTHERS = """,
uf_v AS (SELECT trace_id, kb_id, severity * 0.8 AS severity, created_at, 'generation_error' AS root_cause, 'prompt:generate' AS target FROM mined_v WHERE status = 'partial'),
cd_v AS (SELECT trace_id, 'docs:' || string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS target FROM citations_v GROUP BY 1),
cf_v AS (SELECT trace_id, kb_id, severity, created_at, 'conflicting_sources' AS root_cause, target FROM mined_v JOIN cd_v USING (trace_id) WHERE contradiction >= 0.4),
gf_v AS (SELECT trace_id, kb_id, severity, created_at, 'missing_content' AS root_cause, 'gap:' || lower(query) AS target FROM mined_v
   WHERE status = 'failed' AND NOT healed AND llm_calls <> 0),
jf_v AS (SELECT DISTINCT m.trace_id, m.kb_id, 1.0::DOUBLE AS severity, m.created_at, 'injection' AS root_cause, 'doc:' || c.doc_id AS target
   FROM mined_v m JOIN citations_v c USING (trace_id) JOIN chunks_v ch USING (chunk_id) WHERE c.doc_id % 97 = 0),
of_v AS (SELECT trace_id, kb_id, severity, created_at, root_cause, target FROM rf_v UNION ALL SELECT * FROM uf_v UNION ALL SELECT * FROM cf_v
   UNION ALL SELECT * FROM gf_v UNION ALL SELECT * FROM jf_v),
sf_v AS (SELECT DISTINCT m.trace_id, m.kb_id, 1.0::DOUBLE AS severity, m.created_at, 'stale_content' AS root_cause, 'doc:' || c.doc_id AS target
   FROM mined_v m JOIN citations_v c USING (trace_id) JOIN docs_v d USING (doc_id) WHERE m.negative_signal AND d.tier = 'cold'
   UNION ALL SELECT trace_id, kb_id, 1.0, created_at, 'gate_error', 'gate:threshold' FROM mined_v WHERE negative_signal AND route = 'direct'),
nf_v AS (SELECT * FROM sf_v UNION ALL SELECT trace_id, kb_id, 1.0, created_at, 'unexplained_negative', 'trace:' || trace_id FROM mined_v
   WHERE negative_signal AND trace_id NOT IN (SELECT trace_id FROM of_v UNION ALL SELECT trace_id FROM sf_v)),
all_v AS (SELECT * FROM of_v UNION ALL SELECT * FROM nf_v),
dt_v AS (SELECT kb_id, root_cause, target, trace_id, max(severity) AS severity, min(created_at) AS seen_at FROM all_v GROUP BY 1, 2, 3, 4),
dg_v AS (SELECT kb_id, root_cause, target, sum(severity) AS impact, count(*) AS n_traces FROM dt_v GROUP BY 1, 2, 3)"""


def mined_sql(rest: str, full: bool = False) -> str:
    views = "traces_v citations_v chunks_v" if full else "traces_v"
    return o.with_views(views, _MINED + (_RESCUE + _OTHERS if full else "") + rest)


def brief(df):
    return df.select("kb_id", "trace_id", "root_cause", "target", F.round("severity", 4).alias("severity"))


_BRIEF = " SELECT kb_id, trace_id, root_cause, target, round(severity, 4) AS severity FROM "


@query("i1_mine_failures", mined_sql(" SELECT kb_id, trace_id, status FROM mined_v"))
def _(t):
    return Log(t).mined.select("kb_id", "trace_id", "status")


@query(
    "i2_initially_diagnosed",
    o.with_views("traces_v", "SELECT trace_id, status IN ('verified', 'direct', 'escalated') AND NOT healed AS diagnosed FROM traces_v"),
)
def _(t):
    return t.traces().select("trace_id", mining.initially_diagnosed().alias("diagnosed"))


@query(
    "i3_rescue_findings",
    mined_sql(" SELECT kb_id, trace_id, root_cause, target, round(severity, 4) AS severity, user_words, doc_words FROM rf_v", True),
)
def _(t):
    f = Log(t).rescue()
    shown = [F.coalesce(F.array_join(F.sort_array(c), "|"), F.lit("")).alias(c) for c in ("user_words", "doc_words")]
    return f.select("kb_id", "trace_id", "root_cause", "target", F.round("severity", 4).alias("severity"), *shown)


@query("i4_unsupported_findings", mined_sql(_BRIEF + "uf_v", True))
def _(t):
    return brief(Log(t).unsupported())


@query("i5_conflict_findings", mined_sql(_BRIEF + "cf_v", True))
def _(t):
    return brief(Log(t).conflict())


@query("i6_gap_findings", mined_sql(_BRIEF + "gf_v", True))
def _(t):
    return brief(Log(t).gap())


@query("i7_injection_findings", mined_sql(_BRIEF + "jf_v", True))
def _(t):
    return brief(Log(t).injection())


@query("i8_negative_findings", mined_sql(_BRIEF + "nf_v", True))
def _(t):
    return brief(Log(t).negative())


@query("i9_severity", mined_sql(" SELECT trace_id, severity FROM mined_v"))
def _(t):
    return Log(t).mined.select("trace_id", "severity")


@query(
    "i10_diagnoses",
    mined_sql(" SELECT kb_id, root_cause, target, round(impact, 4) AS impact, n_traces FROM dg_v", True),
)
def _(t):
    d = mining.upsert_diagnoses(cut_lineage(Log(t).findings(), "findings"))
    return d.select("kb_id", "root_cause", "target", F.round("impact", 4).alias("impact"), "n_traces")


# ------------------------------------------------------------------ the stored trace log

CUT = "2024-01-16"
_CUT = f"created_at < TIMESTAMP '{CUT}'"


def stored_log(log: Log) -> dict:
    """The nine tables of details of the whole log."""
    said = F.array(F.lit("c"))
    return {
        "trace_subqueries": log.unanswered.select("trace_id", F.col("position").alias("subq"), "question", F.lit(False).alias("answered")),
        "trace_evidence": log.evidence,
        "trace_claims": log.conflicts.select("trace_id", F.lit(0).alias("sentence"), said.alias("contradicting")),
        "trace_citations": log.evidence.withColumn("sentence", F.lit(0)),
        "trace_heals": log.rescues.select("trace_id", F.lit(1).alias("round"), F.lit("retrieval").alias("arm")),
        "trace_rescues": log.rescues,
        "trace_rewrites": log.rewrites,
        "trace_unsupported": log.dropped,
        "trace_steps": log.errors.select("trace_id", F.lit(0).alias("step"), F.lit("answer").alias("stage"), F.lit("no call").alias("error")),
    }


def write_runs(store: TraceStore, log: Log, runs=("early", "late")) -> list[bool]:
    """The log as two runs, those before ``CUT`` and the rest."""
    details = stored_log(log)
    early = F.col("created_at") < F.lit(CUT).cast("timestamp")
    return [store.write(run, log.traces.where(early if run == "early" else ~early), details) for run in runs]


def _sizes(store: TraceStore):
    out = store.traces().groupBy(F.lit("traces").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    for name in DETAILS:
        out = out.unionByName(store.detail(name).groupBy(F.lit(name).alias("name")).agg(F.count(F.lit(1)).alias("n")))
    return out


@query(
    "a6_trace_store",
    o.with_views(
        "traces_v",
        """n_v AS (SELECT count(*) AS n, count(*) FILTER (healed) AS healed, count(*) FILTER (contradiction >= 0.4) AS clash, count(*) FILTER (llm_calls = 0) AS dead,
          count(*) FILTER (status = 'partial') AS partial,
          count(*) FILTER (healed AND trace_id % (SELECT max(doc_id) + 1 FROM documents) IN (SELECT doc_id FROM documents)) AS reworded FROM traces_v)
        SELECT unnest(['traces', 'trace_subqueries', 'trace_evidence', 'trace_claims', 'trace_citations', 'trace_heals', 'trace_rescues', 'trace_rewrites',
          'trace_unsupported', 'trace_steps']) AS name, unnest([n, n, 2 * n, clash, 2 * n, healed, healed, reworded, partial, dead]) AS n FROM n_v""",
    ),
)
def _(t):
    store, log = TraceStore(t.spark, new_folder(t.spark, "trace-log"), "long", "long"), Log(t)
    write_runs(store, log)
    write_runs(store, log)  # a retried write changes nothing
    return _sizes(store)


_REOPENED = _MINED.replace("NOT (status IN", "(negative_signal OR NOT (status IN").replace("AND NOT healed)\n", "AND NOT healed))\n")


@query(
    "i10_merged_diagnoses",
    o.with_views("traces_v citations_v chunks_v", _REOPENED + _RESCUE + _OTHERS)
    + f""", f1 AS (SELECT * FROM all_v WHERE {_CUT}),
      f2 AS (SELECT a.* FROM all_v a JOIN mined_v m USING (trace_id) WHERE NOT a.{_CUT} OR m.negative_signal AND m.k % 2 = 0),
      both_v AS (SELECT *, 'open' AS status FROM f1 WHERE root_cause <> 'missing_content' UNION ALL SELECT *, 'open' FROM f2 UNION ALL
        SELECT *, 'fixed' FROM f1 WHERE root_cause = 'missing_content'),
      once_v AS (SELECT kb_id, root_cause, target, status, trace_id, max(severity) AS severity FROM both_v GROUP BY ALL)
    SELECT kb_id, root_cause, target, status, round(sum(severity), 4) AS impact, count(*) AS n_traces FROM once_v GROUP BY 1, 2, 3, 4""",
)
def _(t):
    """Two cycles over a stored log: the second meets diagnoses of the first, some of them closed since, and traces it has seen."""
    store, log = TraceStore(t.spark, new_folder(t.spark, "trace-log"), "long", "long"), Log(t)
    marked = t.marked_chunks()
    book, members = None, None
    for run, looked_at in (("early", datetime(2024, 2, 1)), ("late", datetime(2024, 4, 1))):
        write_runs(store, log, [run])
        # bad feedback comes with the question, for some again after the first cycle
        again = F.when((F.pmod("k", F.lit(2)) == 0) & F.lit(run == "late"), F.lit("2024-03-01").cast("timestamp"))
        bad = log.traces.where("negative_signal").select(
            "trace_id", F.lit("explicit").alias("kind"), F.lit(-1).alias("rating"), F.coalesce(again, "created_at").alias("ts")
        )
        mined = cut_lineage(mining.mine_failures(store.traces(bad)), "mined")
        found = cut_lineage(mining.mine_log(mined, store.detail, marked, log.docs, log.sources), "findings")
        if book is not None:
            closed = F.when(F.col("root_cause") == "missing_content", "fixed").otherwise(F.col("status"))
            book = book.withColumn("status", closed)
        book, members = (cut_lineage(d, "book") for d in mining.merge_findings(found, book, members, run))
        store.mark_mined(run, mined, looked_at)
    return book.select("kb_id", "root_cause", "target", "status", F.round("impact", 4).alias("impact"), "n_traces")


def _diagnoses(t):
    return cut_lineage(mining.upsert_diagnoses(cut_lineage(Log(t).findings(), "findings")), "diagnoses")


_KIND = """CASE root_cause WHEN 'vocabulary_gap' THEN 'augment_chunk' WHEN 'missing_context' THEN 'augment_chunk'
  WHEN 'ranking_miss' THEN CASE WHEN target LIKE 'tier:%' THEN 'set_tier' ELSE 'augment_chunk' END
  WHEN 'bad_chunking' THEN 'rechunk_doc' WHEN 'stale_content' THEN 'recrawl_doc' WHEN 'missing_content' THEN 'content_gap'
  WHEN 'generation_error' THEN CASE WHEN impact >= 1.5 THEN 'improve_prompt' END WHEN 'twiddler_error' THEN 'unquarantine_doc'
  WHEN 'injection' THEN 'quarantine_doc' WHEN 'gate_error' THEN 'gate_threshold' END"""


@query(
    "i11_propose_fixes",
    mined_sql(
        f""", al_v AS (SELECT d.kb_id, d.root_cause, d.target FROM dg_v d JOIN rf_v r USING (kb_id, root_cause, target)
          WHERE d.root_cause = 'vocabulary_gap' AND n_traces >= 2 GROUP BY 1, 2, 3 HAVING bool_or(user_words <> '') AND bool_or(doc_words <> ''))
        SELECT kb_id, root_cause, target, kind FROM (SELECT kb_id, root_cause, target, {_KIND} AS kind FROM dg_v) WHERE kind IS NOT NULL
        UNION ALL SELECT kb_id, root_cause, target, 'add_alias' FROM al_v""",
        True,
    ),
)
def _(t):
    d = _diagnoses(t)
    live = d.select("kb_id", "root_cause", "target", F.lit("applied").alias("status"))
    return mining.propose_fixes(d, live).select("kb_id", "root_cause", "target", "kind")


def _conflict_members(t):
    f = Log(t).conflict()
    cited = t.citations().select("trace_id", F.col("doc_id").alias("member"))
    return f.join(cited, "trace_id").select("kb_id", "root_cause", "target", F.col("member").alias("doc_id")).distinct()


@query(
    "i12_worst_of_conflict",
    mined_sql(
        """, m AS (SELECT DISTINCT f.kb_id, f.target, d.doc_id, d.authority, d.modified_at FROM cf_v f JOIN citations_v c USING (trace_id)
             JOIN docs_v d ON d.doc_id = c.doc_id WHERE d.status = 'active'),
        r AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY kb_id, target) AS n FROM m
              WINDOW w AS (PARTITION BY kb_id, target ORDER BY authority, modified_at, doc_id))
        SELECT kb_id, target, doc_id::VARCHAR AS worst_doc FROM r WHERE nth = 1 AND n >= 2""",
        True,
    ),
)
def _(t):
    return mining.worst_of_conflict(_conflict_members(t), t.docs()).select("kb_id", "target", "worst_doc")


@query(
    "i13_risk",
    mined_sql(
        f""" SELECT kb_id, root_cause, target, kind, CASE WHEN kind IN ('augment_chunk', 'rechunk_doc', 'recrawl_doc', 'set_tier') THEN 'low'
          WHEN kind = 'gate_threshold' THEN 'medium' WHEN kind IS NOT NULL THEN 'high' END AS risk,
          CASE WHEN kind IS NOT NULL THEN 'fixing' WHEN impact >= 1.5 AND root_cause IN ('unexplained_negative', 'generation_error') THEN 'needs_human' ELSE 'open' END AS status
        FROM (SELECT *, {_KIND} AS kind FROM dg_v)""",
        True,
    ),
)
def _(t):
    d = _diagnoses(t)
    none = d.select("kb_id", "root_cause", "target", F.lit("applied").alias("status"))
    fixes = mining.propose_fixes(d, none).where(F.col("kind") != "add_alias")
    key = ["kb_id", "root_cause", "target"]
    return mining.status_after_proposals(d, fixes).select(*key, "status").join(fixes.select(*key, "kind", "risk"), key, "left")


@query(
    "i14_target_questions",
    mined_sql(
        """, a AS (SELECT l.kb_id, l.root_cause, l.target, t.query AS question, min({'s': seen_at, 't': trace_id}) AS first_at FROM dt_v l JOIN traces_v t USING (trace_id) GROUP BY 1, 2, 3, 4)
        SELECT * EXCLUDE (first_at) FROM (SELECT *, row_number() OVER (PARTITION BY kb_id, root_cause, target ORDER BY first_at, question) AS position FROM a)""",
        True,
    ),
)
def _(t):
    log = Log(t)
    chosen = mining.target_questions(mining.diagnosis_traces(log.findings()), log.traces)
    return chosen.withColumn("position", F.col("position").cast("long"))


def _results(t, heals=False):
    """Two evaluation runs per cluster: odd sessions under the base, even under a candidate."""
    k = F.col("k")
    return t.traces().select(
        F.concat(F.lit("fix-"), F.col("query_cluster_id").cast("string")).alias("fix_id"),
        "trace_id",
        F.when(F.pmod("trace_id", F.lit(2)) == 0, "base").otherwise("candidate").alias("variant"),
        F.when(F.col("event_type_") == "click", "target").otherwise("golden").alias("kind"),
        F.concat(F.lit("q"), F.pmod("user_id", F.lit(9)).cast("string"), F.lit("-"), F.floor(k / 20).cast("string")).alias("question"),
        "status",
        "healed",
        (F.pmod("user_id", F.lit(11)) != 0).alias("passed"),
        (F.pmod("user_id", F.lit(10)) / 10).alias("overall"),
    )


def _with_type(t):
    class Wrapped:
        @staticmethod
        def traces():
            return t.traces().withColumn("event_type_", F.substring_index("query", " ", 1))

    return Wrapped


_RESULTS = """res_v AS (SELECT 'fix-' || query_cluster_id AS fix_id, trace_id, CASE WHEN trace_id % 2 = 0 THEN 'base' ELSE 'candidate' END AS variant,
  CASE WHEN query LIKE 'click%' THEN 'target' ELSE 'golden' END AS kind, 'q' || (user_id % 9) || '-' || (k // 20) AS question, status, healed,
  user_id % 11 <> 0 AS passed, (user_id % 10) / 10.0::DOUBLE AS overall,
  CASE WHEN status = 'verified' THEN CASE WHEN healed THEN 0.6 ELSE 1.0 END WHEN status = 'partial' THEN 0.3 ELSE 0 END::DOUBLE AS score FROM traces_v)"""


def _marked(t):
    r = _results(_with_type(t))
    heals = r.where("healed").select("trace_id", F.lit("H2-H4").alias("step"))
    return mining.mark_first_pass(r, heals)


@query("i15_target_score", o.with_views("traces_v", _RESULTS + " SELECT fix_id, variant, round(sum(score), 4) AS score FROM res_v WHERE kind = 'target' GROUP BY 1, 2"))
def _(t):
    r = _marked(t).where(F.col("kind") == "target")
    return r.groupBy("fix_id", "variant").agg(F.round(F.sum(mining.target_score()), 4).alias("score"))


@query(
    "i16_gate_verdict",
    o.with_views(
        "traces_v",
        _RESULTS
        + """, p AS (SELECT fix_id, sum(score) FILTER (kind = 'target' AND variant = 'base') AS tb, sum(score) FILTER (kind = 'target' AND variant = 'candidate') AS tc,
          count(*) FILTER (kind = 'golden' AND variant = 'base') AS n_golden,
          round(avg(passed::INT) FILTER (kind = 'golden' AND variant = 'base'), 4) AS pb, round(avg(passed::INT) FILTER (kind = 'golden' AND variant = 'candidate'), 4) AS pc,
          round(avg(overall) FILTER (kind = 'golden' AND variant = 'base'), 4) AS jb, round(avg(overall) FILTER (kind = 'golden' AND variant = 'candidate'), 4) AS jc
          FROM res_v GROUP BY 1),
        l AS (SELECT fix_id, count(*) AS regressed FROM (SELECT fix_id, question FROM res_v WHERE kind = 'golden' GROUP BY 1, 2
              HAVING bool_or(passed) FILTER (variant = 'base') AND NOT bool_or(passed) FILTER (variant = 'candidate')) GROUP BY 1),
        v AS (SELECT p.*, coalesce(regressed, 0) AS regressed, coalesce(pc < pb - 0.02, false) OR coalesce(jc < jb - 0.02, false) AS regression FROM p LEFT JOIN l USING (fix_id))
        SELECT fix_id, round(tb, 4) AS target_base, round(tc, 4) AS target_candidate, regressed, regression,
          CASE WHEN tb IS NULL THEN NOT regression ELSE coalesce(tc, 0) > tb END AND NOT regression AND regressed <= floor(n_golden * 0.02) AS passed FROM v""",
    ),
)
def _(t):
    v = mining.gate_verdict(_marked(t))
    return v.select(
        "fix_id", F.round("target_base", 4).alias("target_base"), F.round("target_candidate", 4).alias("target_candidate"),
        "regressed", "regression", "passed",
    )


@query(
    "i17_healed_goldens",
    o.with_views(
        "traces_v citations_v",
        """d AS (SELECT trace_id, string_agg(DISTINCT doc_id, ',' ORDER BY doc_id) AS docs FROM citations_v GROUP BY 1),
        g AS (SELECT DISTINCT kb_id, query AS question FROM traces_v WHERE is_eval OR status = 'partial')
        SELECT kb_id, question, trace_id, docs FROM (SELECT kb_id, query AS question, min(trace_id) AS trace_id FROM traces_v
          WHERE status = 'verified' AND (kb_id, query) NOT IN (SELECT kb_id, question FROM g) GROUP BY 1, 2) JOIN d USING (trace_id)""",
    ),
)
def _(t):
    tr = t.traces().withColumn("question", F.col("query"))
    known = tr.where(F.col("is_eval") | (F.col("status") == "partial"))
    made = mining.healed_goldens(tr, known, t.citations())
    docs = F.array_join(F.transform("expected_doc_ids", lambda d: d.cast("string")), ",")
    return made.select("kb_id", "question", "trace_id", docs.alias("docs"))


@query(
    "i18_fix_queue",
    o.with_views(
        "traces_v diagnoses_v",
        """SELECT kb_id, fix_id, place FROM (SELECT f.kb_id, fix_id, row_number() OVER (PARTITION BY f.kb_id ORDER BY impact DESC, f.created_at, fix_id) AS place
        FROM fixes_v f JOIN diagnoses_v d USING (diagnosis_id) WHERE f.status = 'proposed')""",
    ),
)
def _(t):
    return mining.fix_queue(t.fixes(), t.diagnoses()).select("kb_id", "fix_id", F.col("place").cast("long").alias("place"))


@query("i19_apply_and_review")
def _(t):
    kinds = F.array(*[F.lit(k) for k in ("set_tier", "quarantine_doc", "unquarantine_doc")])
    edits = t.citations().select(
        F.concat(F.lit("fix-"), F.col("trace_id").cast("string")).alias("fix_id"),
        F.get(kinds, F.pmod("trace_id", F.lit(3)).cast("int")).alias("kind"),
        "doc_id",
        F.lit("warm").alias("tier"),
        F.col("trace_id").alias("applied_at"),
    )
    after, inverse = mining.apply_document_fixes(t.docs(), edits)
    back = mining.roll_back_documents(after, inverse).select("doc_id", F.col("status").alias("restored"))
    verdicts = F.array(*[F.lit(x) for x in ("approve", "reject", "roll_back")])
    n = F.col("query_cluster_id")
    decisions = t.traces().select(
        F.concat(F.lit("fix-"), "kb_id", F.lit("-"), n.cast("string")).alias("fix_id"),
        F.get(verdicts, F.pmod("trace_id", F.lit(3)).cast("int")).alias("decision"),
        F.lit("").alias("reason"),
        F.col("created_at").alias("ts"),
    )
    fixes, diagnoses = mining.review_fixes(t.fixes(), t.diagnoses(), decisions)
    states = fixes.groupBy(F.lit("fix").alias("what"), "status").agg(F.count(F.lit(1)).alias("n"))
    more = diagnoses.groupBy(F.lit("diagnosis").alias("what"), "status").agg(F.count(F.lit(1)).alias("n"))
    docs = after.join(back, "doc_id").groupBy(F.lit("document").alias("what"), F.concat_ws("->", "restored", "status").alias("status"))
    return states.unionByName(more).unionByName(docs.agg(F.count(F.lit(1)).alias("n")))


def _setting_fixes(t):
    """Configuration fixes that the log's traces would propose: a threshold, a boost or aliases of their base."""
    kinds = F.array(*[F.lit(k) for k in ("gate_threshold", "doc_boost", "add_alias")])
    params = F.create_map(
        F.lit("value"), F.round(F.col("k") / 100, 2).cast("string"),
        F.lit("doc_id"), F.pmod("trace_id", F.lit(t.n_docs())).cast("string"),
        F.lit("boost"), F.col("llm_calls").cast("string"),
        F.lit("phrases"), F.concat(F.lit("a"), F.pmod("k", F.lit(9)).cast("string"), F.lit(",b"), F.pmod("k", F.lit(4)).cast("string")),
        F.lit("expansions"), F.col("query"),
    )
    kind = F.get(kinds, F.pmod("trace_id", F.lit(3)).cast("int"))
    return t.traces().select(F.col("trace_id").alias("fix_id"), "kb_id", kind.alias("kind"), params.alias("params"), F.col("created_at").alias("applied_at"), "negative_signal")


@query(
    "i19_setting_edits",
    o.with_views(
        "traces_v",
        """e AS (SELECT kb_id, trace_id, created_at, negative_signal AS gone, unnest(CASE trace_id % 3 WHEN 0 THEN ['gate_threshold']
             WHEN 1 THEN ['boost:' || (trace_id % (SELECT max(doc_id) + 1 FROM documents))] ELSE ['alias:a' || (k % 9), 'alias:b' || (k % 4)] END) AS name,
             CASE trace_id % 3 WHEN 0 THEN round(k / 100.0::DOUBLE, 2)::VARCHAR WHEN 1 THEN llm_calls::VARCHAR ELSE query END AS value FROM traces_v),
        base AS (SELECT DISTINCT kb_id, 'gate_threshold' AS name, '0.2' AS value FROM traces_v),
        r AS (SELECT kb_id, name, arg_max(value, (created_at, trace_id::VARCHAR)) AS after,
             arg_max(value, (created_at, trace_id::VARCHAR)) FILTER (NOT gone) AS stays FROM e GROUP BY 1, 2)
        SELECT kb_id, name, r.after, coalesce(r.stays, base.value) AS restored FROM r LEFT JOIN base USING (kb_id, name)""",
    ),
)
def _(t):
    fixes = _setting_fixes(t)
    settings = fixes.select("kb_id", F.lit("gate_threshold").alias("name"), F.lit("0.2").alias("value")).distinct()
    after, inverse = mining.apply_setting_fixes(settings, mining.setting_edits(fixes))
    after, inverse = cut_lineage(after, "settings"), cut_lineage(inverse, "inverse")
    back = mining.roll_back_settings(after, inverse, fixes.where("negative_signal").select("fix_id"))
    return after.withColumnRenamed("value", "after").join(back.withColumnRenamed("value", "restored"), ["kb_id", "name"], "left")


@query(
    "i20_cycle_report",
    mined_sql(
        """ SELECT kb_id, (SELECT count(*) FROM mined_v m WHERE m.kb_id = b.kb_id) AS traces, (SELECT count(*) FROM all_v m WHERE m.kb_id = b.kb_id) AS findings,
        (SELECT count(*) FROM dg_v m WHERE m.kb_id = b.kb_id) AS diagnoses FROM (SELECT DISTINCT kb_id FROM mined_v) b""",
        True,
    ),
)
def _(t):
    log = Log(t)
    found = log.findings()
    return mining.cycle_report(log.mined, found, mining.upsert_diagnoses(found))


@query(
    "i21_disposition",
    o.with_views(
        "traces_v",
        """x AS (SELECT trace_id, ['augment_chunk', 'add_alias', 'rechunk_doc', 'recrawl_doc', 'set_tier', 'doc_boost', 'gate_threshold', 'improve_prompt',
             'quarantine_doc', 'unquarantine_doc', 'content_gap'][k % 11 + 1] AS kind, negative_signal AS passed, healed AS canary FROM traces_v)
        SELECT trace_id, kind, CASE WHEN kind IN ('augment_chunk', 'add_alias', 'rechunk_doc', 'doc_boost', 'gate_threshold', 'improve_prompt') AND NOT passed THEN 'rejected'
          WHEN kind IN ('augment_chunk', 'add_alias', 'rechunk_doc', 'recrawl_doc', 'set_tier') THEN 'applied'
          WHEN kind IN ('doc_boost', 'gate_threshold') THEN CASE WHEN canary THEN 'queued_for_canary' ELSE 'canary' END
          ELSE 'pending_approval' END AS outcome FROM x""",
    ),
)
def _(t):
    kinds = F.array(*[F.lit(k) for k in o.fixed.FIX_RISK])
    rows = t.traces().select(
        "trace_id",
        F.get(kinds, F.pmod("k", F.lit(11))).alias("kind"),
        F.col("negative_signal").alias("passed"),
        F.col("healed").alias("canary_running"),
    )
    rows = rows.withColumn("risk", mining.risk(F.col("kind")))
    return rows.select("trace_id", "kind", mining.disposition().alias("outcome"))


@query(
    "i22_bases_with_work",
    o.with_views("docs_v traces_v", "SELECT DISTINCT kb_id FROM traces_v WHERE NOT diagnosed AND NOT is_eval"),
)
def _(t):
    return mining.bases_with_work(t.traces().select("kb_id").distinct(), t.traces())
