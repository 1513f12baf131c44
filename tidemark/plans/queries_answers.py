"""Catalog: routing, grading, answering and checking.

Questions are all user turns; claims are all sentences of all benchmark passages, checked
against the chunks that retrieval finds for them in the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers, signals
from ..session import cut_lineage
from . import oracle as o
from .catalog import query
from .queries_retrieval import _PARTS, bm25_sql, hit_chunks, sentence_hits

fx = o.fixed
OPENINGS = ("", "Compare this: ", "Research ", "Hello there!", "What is the latest on ")
TAIL = " and how does it work? Why; both"


def questions(t):
    """User turns with varied openings; every fifth one is only a greeting."""
    n = F.pmod(F.col("session_id") + F.col("turn") / 2, F.lit(5)).cast("int")
    head = F.get(F.array(*[F.lit(x) for x in OPENINGS]), n)
    said = F.when(n == 3, head).when(n == 4, F.concat(head, "query")).otherwise(F.concat(head, "query", F.lit(TAIL)))
    return t.turns().select(F.col("trace_id").alias("query_id"), "session_id", "turn", said.alias("query"))


_Q = f"""q_v AS (SELECT trace_id AS query_id, session_id, turn, CASE n WHEN 3 THEN 'Hello there!' WHEN 4 THEN 'What is the latest on ' || query
  ELSE ['', 'Compare this: ', 'Research '][n + 1] || query || '{TAIL}' END AS query
  FROM (SELECT *, floor(session_id + turn / 2)::BIGINT % 5 AS n FROM turns_v)),
gate_v AS (SELECT *, CASE WHEN greet THEN 0.05 ELSE 0.9 END::DOUBLE AS need,
   CASE WHEN greet THEN 'simple' WHEN regexp_matches(low, {o.q(fx.RESEARCH_OPENING)}) THEN 'research'
     WHEN regexp_matches(low, {o.q(fx.COMPARISON)}) OR length(query) - length(replace(query, '?', '')) > 1 OR regexp_matches(low, {o.q(fx.SECOND_QUESTION)}) THEN 'multi_part'
     ELSE 'simple' END AS complexity,
   CASE WHEN greet THEN 0.0 WHEN regexp_matches(low, {o.q(fx.RECENCY)}) THEN 0.8 ELSE 0.1 END::DOUBLE AS fresh
  FROM (SELECT *, lower(query) AS low, regexp_matches(query, {o.q(fx.GREETING)}) AS greet FROM q_v))"""


@query("f1_gate", o.with_views("turns_v", _Q + " SELECT query_id, need AS retrieval_need, complexity, fresh AS freshness_need FROM gate_v"))
def _(t):
    return answers.gate_features(questions(t)).select("query_id", "retrieval_need", "complexity", "freshness_need")


@query(
    "f2_route",
    o.with_views(
        "turns_v chunks_v",
        _Q
        + f""", kb AS (SELECT kb_id, sum(token_count) AS tokens FROM chunks_v GROUP BY 1),
        x AS (SELECT g.*, kb.tokens, 40000 * (1 + session_id % 40) AS win, turn % 4 <> 2 AS esc FROM gate_v g JOIN kb ON kb.kb_id = ['en', 'de', 'fr', 'es'][session_id % 4 + 1])
        SELECT query_id, CASE WHEN session_id % 9 = 0 THEN 'standard' WHEN need < 0.3 AND regexp_matches(trim(query), {o.q(fx.SMALL_TALK)}) AND length(query) <= 60 THEN 'direct'
          WHEN complexity = 'research' AND esc THEN 'deep' WHEN tokens > 0 AND tokens <= least(200000, floor(win * 0.6)) THEN 'long_context'
          WHEN complexity = 'simple' THEN 'fast' ELSE 'standard' END AS route FROM x""",
    ),
)
def _(t):
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    asked = answers.gate_features(questions(t)).withColumn("kb_id", F.get(langs, F.pmod("session_id", F.lit(4)).cast("int")))
    rows = (
        asked.join(answers.base_tokens(t.chunks()), "kb_id")
        .withColumn("window", 40000 * (1 + F.pmod("session_id", F.lit(40))))
        .withColumn("mode", F.when(F.pmod("session_id", F.lit(9)) == 0, "standard").otherwise("auto"))
        .withColumn("allow_escalation", F.pmod("turn", F.lit(4)) != 2)
        .withColumn("is_eval", F.lit(False))
        .withColumn("staged", F.lit(False))
    )
    return rows.select("query_id", answers.route().alias("route"))


_PLAN = f"""cut_v AS (SELECT query_id, query, list_filter(list_transform(regexp_split_to_array(
    regexp_replace(query, '(?i)\\band (?:also |then )?((?:what|how|which|who|when|where|why|is|are|does|do|can)\\b)', chr(1) || '\\1', 'g'), '[?;\\x01]'),
    lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: len({o.content_terms('s')}) >= 1) AS ps FROM q_v),
plan_v AS (SELECT query_id, unnest(range(len(ps))) AS subq, unnest(ps) AS part FROM (SELECT query_id, (CASE WHEN len(ps) > 0 THEN ps ELSE [query] END) AS ps FROM cut_v)),
kw_v AS (SELECT query_id, subq, CASE WHEN part LIKE '%?' THEN part ELSE part || '?' END AS question,
   list_filter(regexp_extract_all(part, '[A-Za-z0-9][\\p{{L}}\\p{{N}}_\\-.]*'), lambda w: lower(w) NOT IN ({o.STOP}) AND length(w) > 2) AS kws FROM plan_v)"""


@query(
    "f3_plan",
    o.with_views("turns_v", f"{_Q}, {_PLAN} SELECT query_id, subq::BIGINT AS subq, question, array_to_string(kws, '|') AS keywords FROM kw_v"),
)
def _(t):
    p = answers.plan_questions(questions(t))
    return p.select("query_id", F.col("subq").cast("long").alias("subq"), "question", F.array_join("keywords", "|").alias("keywords"))


@query(
    "f4_rewrites",
    o.with_views(
        "turns_v",
        f"""{_Q}, {_PLAN},
        w_v AS (SELECT query_id, subq, question, w, i, row_number() OVER (PARTITION BY query_id, subq ORDER BY length(w) DESC, i) AS nth, count(*) OVER (PARTITION BY query_id, subq) AS n
          FROM (SELECT query_id, subq, question, unnest(kws) AS w, unnest(range(len(kws))) AS i FROM kw_v)),
        r_v AS (SELECT query_id, subq, question, array_to_string(kws, ' ') AS r FROM kw_v
          UNION SELECT query_id, subq, question, string_agg(w, ' ' ORDER BY nth) FROM w_v WHERE nth <= 2 AND n > 2 GROUP BY 1, 2, 3
          UNION SELECT query_id, subq, question, array_to_string({o.tokens('question')}, ' ') FROM kw_v)
        SELECT query_id, subq::BIGINT AS subq, r AS rewrite FROM r_v WHERE r <> '' AND r <> question""",
    ),
)
def _(t):
    made = answers.rewrites(answers.plan_questions(questions(t)))
    return made.select("query_id", F.col("subq").cast("long").alias("subq"), "rewrite")


# ------------------------------------------------------------------ evidence for benchmark sentences


class Work:
    """Candidates, evidence and claims for every sentence of every benchmark passage."""

    def __init__(self, t):
        self.t = t
        self.subqueries = t.parts()
        hits = sentence_hits(t)
        best = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("final"))
        self.candidates = t.stored(
            "candidates", lambda: best.join(hit_chunks(t).select("chunk_id", "doc_id", "text", "ord"), "chunk_id")
        )
        self.top = hits.where(F.col("rank") == 0).select("query_id", F.col("subq").alias("sentence"), "chunk_id")

    def graded(self):
        return answers.grade(self.candidates, self.subqueries).withColumn("origin", F.lit("initial"))

    def evidence(self, limit=12):
        chosen = answers.select_evidence(self.graded(), limit)
        return chosen.withColumn("text", answers.evidence_text())

    def sentences(self):
        said = self.subqueries.select("query_id", F.col("subq").alias("sentence"), F.col("question").alias("text"))
        cited = said.join(self.top, ["query_id", "sentence"], "left")
        layout = F.when(F.pmod("sentence", F.lit(3)) == 1, "bullet").otherwise("continue")
        return cited.select(
            "query_id", "sentence", "text", F.array_compact(F.array("chunk_id")).alias("citations"),
            layout.alias("block"), F.lit("").alias("heading"),
        )

    def claims(self):
        return answers.verify_claims(self.sentences(), self.evidence(), ascii_only=True)

    def checked(self):
        claims = cut_lineage(self.claims(), "claims")
        parts = answers.answered_parts(self.subqueries, claims)
        return claims, parts, answers.answer_metrics(self.sentences(), claims, parts)


_NUM = "list_distinct(list_transform(regexp_extract_all(%s, " + o.q(fx.NUMBER) + "), lambda n: replace(n, ',', '')))"
_WORK = f""",
cand_v AS (SELECT query_id, chunk_id, max(score) AS final FROM hits_v GROUP BY 1, 2),
ct_v AS (SELECT c.*, m.text, m.doc_id, {o.content_terms('m.text')} AS ct FROM cand_v c JOIN masked_v m USING (chunk_id)),
qt_v AS (SELECT query_id, subq, question, {o.content_terms('question')} AS qt FROM subq_v),
sh_v AS (SELECT c.query_id, chunk_id, final, doc_id, text, subq, {o.overlap('qt', 'ct')} AS share FROM ct_v c JOIN qt_v USING (query_id)),
g_v AS (SELECT query_id, chunk_id, final, doc_id, text, CASE WHEN max(share) >= 0.5 THEN 'correct' WHEN max(share) >= 0.25 THEN 'ambiguous' ELSE 'incorrect' END AS verdict,
   coalesce(string_agg(subq, ',' ORDER BY subq) FILTER (share >= 0.5), '') AS helped FROM sh_v GROUP BY 1, 2, 3, 4, 5),
sn_v AS (SELECT query_id, chunk_id, s, i, {o.content_terms('s')} AS st FROM (SELECT query_id, chunk_id, unnest(ss) AS s, unnest(range(len(ss))) AS i
   FROM (SELECT query_id, chunk_id, {o.sentences('text')} AS ss FROM ct_v))),
sb_v AS (SELECT n.query_id, chunk_id, s, i, max({o.overlap('qt', 'st')}) AS b FROM sn_v n JOIN qt_v USING (query_id) GROUP BY 1, 2, 3, 4),
ks_v AS (SELECT query_id, chunk_id, string_agg(s, ' ' ORDER BY nth) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY b DESC, i) AS nth FROM sb_v) WHERE nth <= 2 GROUP BY 1, 2),
ev_v AS (SELECT * FROM (SELECT g.*, keys, CASE WHEN verdict = 'correct' OR keys IS NULL THEN text ELSE keys END AS etext,
   row_number() OVER (PARTITION BY query_id ORDER BY verdict <> 'correct', round(final, 6) DESC, chunk_id) AS place
   FROM g_v g LEFT JOIN ks_v USING (query_id, chunk_id) WHERE verdict <> 'incorrect') WHERE place <= 12),
se_v AS (SELECT s.query_id, s.subq AS sentence, s.question AS text, h.chunk_id AS cited FROM subq_v s
   LEFT JOIN hits_v h ON h.query_id = s.query_id AND h.subq = s.subq AND h.rank = 0),
ce_v AS (SELECT s.query_id, s.sentence, s.text AS claim, e.chunk_id, e.doc_id, {o.content_terms('s.text')} AS a, {o.content_terms('e.etext')} AS b,
   {_NUM % 's.text'} AS an, {_NUM % 'e.etext'} AS bn FROM se_v s LEFT JOIN ev_v e USING (query_id)),
cv_v AS (SELECT *, chunk_id IS NOT NULL AND len(list_intersect(an, bn)) = len(an) AS has_all,
   CASE WHEN chunk_id IS NULL THEN 0 ELSE {o.overlap('a', 'b')} END AS cov FROM ce_v),
cl_v AS (SELECT query_id, sentence, claim, any_value(a) AS a,
   coalesce(string_agg(chunk_id, ',' ORDER BY chunk_id) FILTER (cov >= 0.8 AND has_all), '') AS supporting,
   coalesce(string_agg(chunk_id, ',' ORDER BY chunk_id) FILTER (NOT (cov >= 0.8 AND has_all) AND cov >= 0.6 AND len(an) > 0 AND len(bn) > 0 AND len(list_intersect(an, bn)) = 0), '') AS contradicting,
   CASE WHEN bool_or(cov >= 0.8 AND has_all) THEN 'full' WHEN coalesce(max(cov) FILTER (has_all), 0) >= 0.5 THEN 'partial' ELSE 'none' END AS support
   FROM cv_v GROUP BY 1, 2, 3),
an_v AS (SELECT q.query_id, q.subq, q.question, bool_or(c.support IS NOT NULL AND ({o.overlap('q.qt', 'c.a')}) >= 0.34) AS answered
   FROM qt_v q LEFT JOIN (SELECT * FROM cl_v WHERE support = 'full') c ON c.query_id = q.query_id GROUP BY 1, 2, 3),
me_v AS (SELECT query_id, groundedness, contradiction, coverage, citation_accuracy, claims, 
     claims > 0 AND groundedness >= 0.9 AND contradiction <= 0.1 AND coverage >= 0.8 AS pass FROM
   (SELECT query_id, round(avg((support = 'full')::INT), 4) AS groundedness, round(avg((contradicting <> '')::INT), 4) AS contradiction, count(*) AS claims FROM cl_v GROUP BY 1)
   JOIN (SELECT query_id, round(avg(answered::INT), 4) AS coverage FROM an_v GROUP BY 1) USING (query_id)
   JOIN (SELECT query_id, round(avg((cited IS NOT NULL AND list_contains(string_split(supporting, ','), cited))::INT), 4) AS citation_accuracy
         FROM se_v JOIN cl_v USING (query_id, sentence) GROUP BY 1) USING (query_id))"""


def work_sql(rest: str) -> str:
    return bm25_sql(_PARTS, 150, "escalated", _WORK + rest)


def long(c):
    return F.col(c).cast("long").alias(c)


@query("f5_grade", work_sql(" SELECT query_id, chunk_id, verdict, helped, coalesce(keys, '') AS keys FROM g_v LEFT JOIN ks_v USING (query_id, chunk_id)"))
def _(t):
    return Work(t).graded().select(
        "query_id", "chunk_id", "verdict",
        F.array_join(F.transform("helped", lambda s: s.cast("string")), ",").alias("helped"),
        F.array_join("key_sentences", " ").alias("keys"),
    )


@query(
    "f6_coverage",
    work_sql(""" SELECT s.query_id, s.subq::BIGINT AS subq, bool_or(coalesce(list_contains(string_split(helped, ','), s.subq::VARCHAR) AND verdict = 'correct', false)) AS covered
      FROM subq_v s LEFT JOIN g_v USING (query_id) GROUP BY 1, 2"""),
)
def _(t):
    w = Work(t)
    return answers.coverage(w.subqueries, w.graded()).select("query_id", long("subq"), "covered")


@query(
    "f8_rescues",
    work_sql(""" SELECT query_id, subq::BIGINT AS subq, chunk_id, doc_id FROM (SELECT query_id, unnest(string_split(helped, ','))::BIGINT AS subq, chunk_id, doc_id
      FROM g_v WHERE verdict = 'correct') WHERE subq % 2 = 0"""),
)
def _(t):
    w = Work(t)
    fixed_now = w.subqueries.where(F.pmod("subq", F.lit(2)) == 0)
    return answers.rescues(w.graded(), fixed_now).select("query_id", long("subq"), "chunk_id", "doc_id")


@query(
    "f9_whole_base",
    o.with_views(
        "masked_v",
        "SELECT source_id AS query_id, chunk_id FROM masked_v m JOIN docs_v d USING (doc_id) WHERE allowed",
    ),
)
def _(t):
    chunks = t.masked_chunks().drop("kb_id").join(t.docs().select("doc_id", F.col("source_id").alias("kb_id")), "doc_id")
    asked = chunks.select(F.col("kb_id").alias("query_id"), "kb_id", F.lit("long_context").alias("route")).distinct()
    parts = asked.select("query_id", F.lit(0).alias("subq"))
    return answers.whole_base_evidence(asked, chunks, parts).select("query_id", "chunk_id")


@query("f10_evidence", work_sql(" SELECT query_id, chunk_id, verdict, place FROM ev_v"))
def _(t):
    return Work(t).evidence().select("query_id", "chunk_id", "verdict", long("place"))


@query("f11_evidence_text", work_sql(" SELECT query_id, chunk_id, etext AS text FROM ev_v"))
def _(t):
    return Work(t).evidence().select("query_id", "chunk_id", "text")


@query("f12_draft")
def _(t):
    w = Work(t)
    return answers.draft(w.evidence(), w.subqueries)


def _lists(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.array_join(F.sort_array(c), ","))
    return df


@query("f13_verify", work_sql(" SELECT query_id, sentence::BIGINT AS sentence, support, supporting, contradicting FROM cl_v"))
def _(t):
    c = _lists(Work(t).claims(), "supporting", "contradicting")
    return c.select("query_id", long("sentence"), "support", "supporting", "contradicting")


@query(
    "f14_skipped_claims",
    work_sql(" SELECT query_id, sentence::BIGINT AS sentence, CASE WHEN sentence % 2 = 0 THEN support ELSE 'none' END AS support FROM cl_v"),
)
def _(t):
    w = Work(t)
    some = w.claims().where(F.pmod("sentence", F.lit(2)) == 0)
    return answers.claims_for_all(w.sentences(), some).select("query_id", long("sentence"), "support")


@query("f15_metrics", work_sql(" SELECT query_id, groundedness, contradiction, coverage, citation_accuracy, claims FROM me_v"))
def _(t):
    return Work(t).checked()[2].drop("n_sentences")


@query(
    "f16_status",
    work_sql(""" SELECT query_id, CASE WHEN pass THEN 'verified' ELSE 'partial' END AS status,
      round(groundedness * (0.5 + 0.5 * coverage) * (1 - contradiction), 3) AS confidence FROM me_v"""),
)
def _(t):
    m = Work(t).checked()[2]
    return m.select("query_id", answers.status().alias("status"), F.round(answers.confidence(), 3).alias("confidence"))


@query("f17_repair")
def _(t):
    w = Work(t)
    kept, _ = answers.repair(w.sentences(), w.claims())
    return kept


@query(
    "f18_cited_sentence",
    work_sql(f""", u AS (SELECT se.query_id, se.cited, min(sentence) AS sentence FROM se_v se WHERE cited IS NOT NULL GROUP BY 1, 2),
      x AS (SELECT u.query_id, u.cited AS chunk_id, se.text AS said, m.text FROM u JOIN se_v se USING (query_id, sentence) JOIN masked_v m ON m.chunk_id = u.cited),
      y AS (SELECT query_id, chunk_id, {o.content_terms('said')} AS a, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (SELECT *, {o.sentences('text')} AS ss FROM x)),
      z AS (SELECT *, {o.content_terms('s')} AS b FROM y)
      SELECT query_id, chunk_id, s AS cited_text FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY {o.overlap('a', 'b')} DESC, i) AS nth FROM z) WHERE nth = 1"""),
)
def _(t):
    w = Work(t)
    return answers.citations(w.sentences(), hit_chunks(t)).select("query_id", "chunk_id", "cited_text")


@query(
    "f19_spans",
    work_sql(""", u AS (SELECT query_id, cited, row_number() OVER (PARTITION BY query_id ORDER BY min(sentence)) AS n FROM se_v WHERE cited IS NOT NULL GROUP BY 1, 2)
      SELECT s.query_id, s.sentence::BIGINT AS sentence, (sum(length(text) + 1) OVER w - length(text) - 1)::BIGINT AS start,
        (sum(length(text) + 1) OVER w - 1)::BIGINT AS end, coalesce(n::VARCHAR, '') AS numbers
      FROM se_v s LEFT JOIN u ON u.query_id = s.query_id AND u.cited = s.cited WINDOW w AS (PARTITION BY s.query_id ORDER BY s.sentence)"""),
)
def _(t):
    s = answers.spans(Work(t).sentences())
    numbers = F.coalesce(F.array_join(F.transform("numbers", lambda n: n.cast("string")), ","), F.lit(""))
    return s.select("query_id", long("sentence"), long("start"), long("end"), numbers.alias("numbers"))


@query("f19_compose")
def _(t):
    w = Work(t)
    _, parts, metrics = w.checked()
    return answers.compose(w.t.subqueries(), w.sentences(), metrics, parts)


@query(
    "f20_conflicts",
    o.with_views(
        "traces_v citations_v chunks_v",
        """SELECT t.trace_id AS query_id, any_value(query) AS claim, string_agg(DISTINCT c.doc_id, ',' ORDER BY c.doc_id) AS docs
        FROM traces_v t JOIN citations_v c USING (trace_id) JOIN chunks_v USING (chunk_id) WHERE contradiction >= 0.4 GROUP BY 1""",
    ),
)
def _(t):
    both = t.citations().groupBy("trace_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("contradicting"))
    none = F.array().cast("array<string>")
    claims = t.traces().join(both, "trace_id").select(
        F.col("trace_id").alias("query_id"), F.lit(0).alias("sentence"), F.col("query").alias("claim"), none.alias("supporting"),
        F.when(F.col("contradiction") >= 0.4, F.col("contradicting")).otherwise(none).alias("contradicting"),
    )
    docs = F.array_join(F.transform("doc_ids", lambda d: d.cast("string")), ",")
    return answers.conflicts(claims, t.chunks()).select("query_id", "claim", docs.alias("docs"))


@query(
    "f21_pool_subanswers",
    o.with_views(
        "traces_v citations_v",
        """w AS (SELECT session_id AS parent_id, t.trace_id AS worker, CASE WHEN k % 4 <> 3 THEN k % 4 END AS subq, status, chunk_id FROM traces_v t JOIN citations_v USING (trace_id)),
        f AS (SELECT *, row_number() OVER (PARTITION BY parent_id, chunk_id ORDER BY subq IS NULL, worker) AS nth FROM w)
        SELECT parent_id AS query_id, chunk_id, subq, CASE WHEN status = 'verified' THEN 'correct' ELSE 'ambiguous' END AS verdict,
          CASE WHEN status = 'verified' THEN 1.0 ELSE 0.6 END::DOUBLE AS final FROM f WHERE nth = 1""",
    ),
)
def _(t):
    part = F.pmod("k", F.lit(4))
    rows = t.traces().join(t.citations().select("trace_id", "chunk_id"), "trace_id").select(
        F.col("session_id").alias("parent_id"), F.col("trace_id").alias("worker"), F.when(part != 3, part).alias("subq"), "status", "chunk_id"
    )
    return answers.pool_subanswers(rows).drop("origin")


@query(
    "f22_follow_ups",
    o.with_views(
        "traces_v",
        """g AS (SELECT user_id AS parent_id, trace_id, unnest([query, kb_id]) AS question, unnest([0, 1]) AS pos FROM traces_v WHERE status <> 'verified'),
        f AS (SELECT parent_id, question, min(trace_id * 2 + pos) AS ord FROM g WHERE (parent_id, question) NOT IN (SELECT user_id, query FROM traces_v WHERE status = 'verified') GROUP BY 1, 2)
        SELECT parent_id, question, position FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY ord) AS position FROM f)""",
    ),
)
def _(t):
    rows = t.traces().select(
        F.col("user_id").alias("parent_id"), F.col("trace_id").alias("worker"), "status", F.array("query", "kb_id").alias("unanswered")
    )
    planned = t.traces().where(F.col("status") == "verified").select(F.col("user_id").alias("parent_id"), F.col("query").alias("question"))
    return answers.follow_ups(rows, planned).withColumn("position", F.col("position").cast("long"))


@query(
    "f23_budget",
    """WITH s AS (SELECT conv_id AS query_id, turn AS step, sum(1 + length(text) // 100) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS spent FROM conversations)
    SELECT query_id, step, spent, spent <= CASE conv WHEN 0 THEN 8 WHEN 1 THEN 30 ELSE 120 END AS allowed FROM (SELECT *, query_id % 3 AS conv FROM s)""",
)
def _(t):
    tiers = F.array(*[F.lit(x) for x in ("fast", "standard", "deep")])
    steps = t.conversations.select(
        F.col("conv_id").alias("query_id"),
        F.col("turn").alias("step"),
        (1 + F.floor(F.length("text") / 100)).alias("calls"),
        F.get(tiers, F.pmod("conv_id", F.lit(3)).cast("int")).alias("tier"),
    )
    return answers.within_budget(steps).select("query_id", "step", "spent", "allowed")


@query(
    "f24_history",
    o.with_views(
        "turns_v",
        """r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC) AS nth FROM turns_v)
        SELECT session_id, string_agg(query, ' || ' ORDER BY created_at) AS history FROM r WHERE nth <= 5 GROUP BY 1""",
    ),
)
def _(t):
    h = signals.last_questions(t.turns())
    return h.select("session_id", F.array_join("history", " || ").alias("history"))


@query(
    "f25_nearest_for_check",
    work_sql(f""", qs AS (SELECT b.item_id AS query_id, {o.content_terms("b.text || ' ' || coalesce(string_agg(s.text, ' ' ORDER BY sentence), '')")} AS a
         FROM benchmark b LEFT JOIN se_v s ON s.query_id = b.item_id GROUP BY b.item_id, b.text),
      r AS (SELECT c.query_id, c.chunk_id, row_number() OVER (PARTITION BY c.query_id ORDER BY round({o.overlap('a', 'ct')}, 6) DESC, chunk_id) AS nth FROM ct_v c JOIN qs USING (query_id))
      SELECT query_id, chunk_id FROM r WHERE nth <= 20 OR (query_id, chunk_id) IN (SELECT query_id, cited FROM se_v WHERE cited IS NOT NULL)"""),
)
def _(t):
    w = Work(t)
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return answers.nearest_for_check(w.candidates, w.sentences(), asked).select("query_id", "chunk_id")


@query(
    "f27_hand_over",
    o.with_views(
        "traces_v",
        """x AS (SELECT *, k % 2 = 0 AND NOT is_eval AND (status = 'failed' OR k % 3 > 0) AS general FROM traces_v)
        SELECT trace_id, general, NOT general AND status IN ('partial', 'failed') AND NOT healed AND k % 5 <> 1 AND route = 'standard' AND NOT is_eval AS escalate FROM x""",
    ),
)
def _(t):
    rows = t.traces().withColumns(
        {
            "n_unanswered": F.pmod("k", F.lit(3)),
            "allow_general": F.pmod("k", F.lit(2)) == 0,
            "allow_escalation": ~F.col("healed"),
            "mode": F.when(F.pmod("k", F.lit(5)) == 1, "fast").otherwise("auto"),
        }
    )
    general, escalate = answers.hand_over()
    return rows.select("trace_id", general.alias("general"), escalate.alias("escalate"))
