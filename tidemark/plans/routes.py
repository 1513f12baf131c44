"""Questions answered each by its own route, in one answer table.

Small talk needs no documents; a base that fits the model is read whole; other questions are searched
fast (one part, one heal round) or the standard way; research is planned into sub-questions that are answered like
questions of their own, asked on where they leave parts open, and answered from what they cited.
A standard answer that fails, with leave to escalate, is researched too.  Every route is one job over all its questions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fixed import DEFAULTS, Tunables
from ..operators import answers
from ..session import cut_lineage
from . import questions as q

DEEP_ROUNDS = 2
FOLLOW_UP_FROM = 12  # more calls than this must be left for another round of research
WHOLE_CALLS = q.PLAN_CALLS + q.ANSWER_CALLS
_ASKED = {"mode": "auto", "window": 128_000, "allow_escalation": True, "allow_general": False, "is_eval": False, "staged": False}
_COMPOSED = ["query_id", "status", "answer", "unanswered", "groundedness", "contradiction", "coverage", "citation_accuracy", "claims", "confidence"]


@dataclass
class Routed:
    """``answers``: a row per question with its route, whether it was escalated to it, status, answer, measures, open parts, calls
    and whether a general note is due (null measures where nothing was searched).
    ``sentences`` and ``parts``: as in :class:`questions.Answer`, of all routes.
    ``workers``: query_id, worker, question, status, follow_up of the research."""

    answers: DataFrame
    sentences: DataFrame
    parts: DataFrame
    workers: DataFrame


def routes(asked: DataFrame, base: q.Base, cfg: Tunables = DEFAULTS) -> DataFrame:
    """``asked`` (query_id, kb_id, query, and mode, window, allow_escalation, allow_general, is_eval, staged if known) with its route."""
    rows = asked.select("query_id", "kb_id", "query", *[F.col(c) if c in asked.columns else F.lit(v).alias(c) for c, v in _ASKED.items()])
    chunks = base.chunks
    if "token_count" not in chunks.columns:
        chunks = chunks.withColumn("token_count", text.estimate_tokens(F.col("text")))
    sizes = answers.base_tokens(chunks.join(rows.select("kb_id").distinct(), "kb_id", "left_semi"))
    rows = answers.gate_features(rows).join(sizes, "kb_id", "left").withColumn("kb_tokens", F.coalesce("kb_tokens", F.lit(0)))
    return rows.withColumn("route", answers.route(cfg))


@dataclass
class _Done:
    composed: DataFrame
    sentences: DataFrame
    parts: DataFrame
    spent: DataFrame


def _done(asked: DataFrame, answer: q.Answer, spent: DataFrame, cfg: Tunables) -> _Done:
    said = answers.compose(asked, answer.sentences, answer.metrics, answer.parts, cfg).select(*_COMPOSED)
    parts = answer.parts.select("query_id", "subq", "question", "answered")
    return _Done(cut_lineage(said, "composed"), answer.sentences, parts, spent.groupBy("query_id").agg(F.sum("calls").alias("calls")))


def searched(asked: DataFrame, base: q.Base, rounds: int, cfg: Tunables, budget: DataFrame | None, max_parts: int | None = None) -> _Done:
    """The fast and the standard route."""
    planned = answers.plan_questions(asked.select("kb_id", "query_id", "query"), max_parts).drop("query")
    answer, _, _ = q.answer_questions(planned, base, rounds, cfg, budget)
    return _done(asked, answer, answer.spent, cfg)


def _no_pool(graded: DataFrame) -> DataFrame:
    return graded.where(F.lit(False)).select("query_id", "chunk_id", "subqs", F.lit(0).alias("tier"), F.lit(0.0).alias("score"))


def _answered(planned: DataFrame, graded: DataFrame, limit: int, base: q.Base, rounds: int, cfg: Tunables, budget: DataFrame | None) -> q.Answer:
    """An answer from given chunks, healed."""
    answer = q.answer_from(q._evidence(graded, limit), planned)
    return q.heal_answers(planned, graded, _no_pool(graded), base, answer, rounds, cfg, budget)


def read_whole(asked: DataFrame, base: q.Base, cfg: Tunables, budget: DataFrame | None) -> _Done:
    """Answers from all visible chunks of the base, which the route's limit of tokens bounds."""
    planned = answers.plan_questions(asked.select("kb_id", "query_id", "query")).drop("query")
    routed = asked.select("query_id", "kb_id", F.lit("long_context").alias("route"))
    live = base.chunks.where("status = 'active'").select("kb_id", "chunk_id", "doc_id", "ord", "status", "text", "allowed")
    rows = answers.whole_base_evidence(routed, live, planned)
    graded = rows.withColumn("subqs", F.col("helped")).withColumn("key_sentences", F.array().cast("array<string>")).select(*q._GRADED)
    start = asked.select("query_id", F.lit(WHOLE_CALLS).cast("long").alias("calls"))
    purse = None if budget is None else q.calls_left(budget, start).withColumnRenamed("left", "calls")
    answer = _answered(planned, cut_lineage(graded, "graded"), 0, base, cfg.standard_heal_rounds, cfg, purse)
    return _done(asked, answer, start.unionByName(answer.spent), cfg)


def _work(todo: DataFrame, base: q.Base, cfg: Tunables, purse: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sub-questions (parent_id, kb_id, worker, subq, question, follow_up) answered the standard way.

    Returns their states, what they cited and the calls of each parent.  The calls of a parent's ``purse`` (query_id, calls) are
    shared equally; a sub-question whose share pays no answer fails.
    """
    own = F.concat_ws("#", F.col("parent_id").cast("string"), F.col("worker").cast("string"))
    todo = cut_lineage(todo.withColumn("query_id", own), "workers")
    budget = None
    if purse is not None:
        each = todo.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")).join(purse.withColumnRenamed("query_id", "parent_id"), "parent_id")
        share = F.least(F.floor(F.col("calls") / F.col("n")), F.lit(cfg.standard_calls)).cast("long")
        budget = todo.join(each.select("parent_id", share.alias("calls")), "parent_id").select("query_id", "calls")
    done = searched(todo.withColumnRenamed("question", "query"), base, cfg.standard_heal_rounds, cfg, budget)
    told = todo.join(done.composed.select("query_id", "status", "unanswered"), "query_id", "left")
    told = told.withColumn("status", F.coalesce("status", F.lit("failed"))).withColumn("unanswered", F.coalesce("unanswered", F.array("question")))
    told = cut_lineage(told, "told")
    cited = done.sentences.select("query_id", F.explode("citations").alias("chunk_id")).distinct()
    cited = cited.join(told, "query_id").select("parent_id", "worker", "subq", "status", "chunk_id")
    spent = done.spent.join(todo.select("query_id", "parent_id"), "query_id").groupBy(F.col("parent_id").alias("query_id")).agg(F.sum("calls").alias("calls"))
    return told, cut_lineage(cited, "cited"), cut_lineage(spent, "spent")


def research(
    asked: DataFrame, base: q.Base, cfg: Tunables = DEFAULTS, budget: DataFrame | None = None, plan: DataFrame | None = None
) -> tuple[_Done, DataFrame]:
    """Plan, sub-answers, one round of follow-ups, and an answer from all they cited.

    ``plan`` (query_id, subq, question) replaces the built-in plan of the questions it names.
    """
    own = answers.plan_questions(asked.select("kb_id", "query_id", "query")).drop("query")
    if plan is not None:
        given = asked.select("kb_id", "query_id").join(plan.select("query_id", "subq", F.col("question").alias("query")), "query_id")
        said = answers.plan_questions(given.select("kb_id", "query_id", F.col("subq").alias("_nth"), "query"))
        first = said.where("subq = 0").withColumn("question", F.col("query")).withColumn("subq", F.col("_nth").cast("int"))
        own = own.join(plan.select("query_id"), "query_id", "left_anti").unionByName(first.select(*own.columns))
    planned = cut_lineage(own, "plan")
    start = asked.select("query_id", F.lit(q.PLAN_CALLS + q.ANSWER_CALLS).cast("long").alias("calls"))
    purse = None if budget is None else cut_lineage(q.calls_left(budget, start).withColumnRenamed("left", "calls"), "purse")
    rows = planned.select(F.col("query_id").alias("parent_id"), "kb_id", F.col("subq").alias("worker"), "subq", "question", F.lit(False).alias("follow_up"))
    told, cited, spent = _work(rows, base, cfg, purse)
    if purse is not None:
        purse = cut_lineage(q.calls_left(purse, spent).withColumnRenamed("left", "calls"), "purse")
    parents = planned.withColumnRenamed("query_id", "parent_id")
    gaps = answers.follow_ups(told, parents)
    if purse is not None:
        gaps = gaps.join(purse.where(F.col("calls") > FOLLOW_UP_FROM).select(F.col("query_id").alias("parent_id")), "parent_id", "left_semi")
    last = parents.groupBy("parent_id", "kb_id").agg(F.max("subq").alias("_last"))
    nth = (F.col("_last") + F.col("position")).cast("int")
    more = gaps.join(last, "parent_id").select("parent_id", "kb_id", nth.alias("worker"), F.lit(None).cast("int").alias("subq"), "question", F.lit(True).alias("follow_up"))
    more = cut_lineage(more, "follow-ups")
    if not more.isEmpty():
        told_more, cited_more, spent_more = _work(more, base, cfg, purse)
        told, cited, spent = told.unionByName(told_more), cited.unionByName(cited_more), spent.unionByName(spent_more)
        if purse is not None:
            purse = cut_lineage(q.calls_left(purse, spent_more).withColumnRenamed("left", "calls"), "purse")
    every = planned.groupBy("query_id").agg(F.sort_array(F.collect_list("subq")).alias("_every"))
    body = base.chunks.select("chunk_id", "doc_id", "ord", F.col("status").alias("_state"), "text")
    pooled = answers.pool_subanswers(cited).join(every, "query_id").join(body, "chunk_id").withColumnRenamed("_state", "status")
    helped = F.when(F.col("subq").isNull(), F.col("_every")).otherwise(F.array("subq"))
    pooled = pooled.withColumn("helped", helped).withColumn("subqs", F.col("helped")).withColumn("key_sentences", F.array().cast("array<string>"))
    answer = _answered(planned, cut_lineage(pooled.select(*q._GRADED), "graded"), cfg.generate_k, base, DEEP_ROUNDS, cfg, purse)
    workers = told.select(F.col("parent_id").alias("query_id"), "worker", "question", "status", "follow_up")
    return _done(asked, answer, start.unionByName(spent).unionByName(answer.spent), cfg), workers


def answer_routed(asked: DataFrame, base: q.Base, cfg: Tunables = DEFAULTS, budgeted: bool = True, plan: DataFrame | None = None) -> Routed:
    """Every question by its route; see :func:`routes` for ``asked``.

    ``budgeted``: no question makes more calls than its route may (``call_budget``); an escalated one has the research's on top.
    """
    routed = cut_lineage(routes(asked, base, cfg), "routed")
    found = {r["route"] for r in routed.select("route").distinct().collect()}  # five labels at most

    def of(name: str) -> DataFrame:
        return routed.where(F.col("route") == name)

    def purse(rows: DataFrame, tier: str) -> DataFrame | None:
        return q.call_budget(rows.withColumn("tier", F.lit(tier)), cfg) if budgeted else None

    done: dict[str, _Done] = {}
    if "fast" in found:
        done["fast"] = searched(of("fast"), base, cfg.fast_heal_rounds, cfg, purse(of("fast"), "fast"), 1)
    if "long_context" in found:
        done["long_context"] = read_whole(of("long_context"), base, cfg, purse(of("long_context"), "standard"))
    deep = of("deep").withColumn("escalated", F.lit(False))
    if "standard" in found:
        done["standard"] = searched(of("standard"), base, cfg.standard_heal_rounds, cfg, purse(of("standard"), "standard"))
        judged = of("standard").join(done["standard"].composed, "query_id", "left").withColumn("status", F.coalesce("status", F.lit("failed")))
        judged = judged.withColumn("n_unanswered", F.coalesce(F.size("unanswered"), F.lit(0)))
        onward = judged.where(answers.hand_over()[1]).select(*routed.columns, F.lit(True).alias("escalated"))
        deep = deep.unionByName(onward)
    deep = cut_lineage(deep, "deep")
    workers = routed.where(F.lit(False)).select("query_id", F.lit(0).alias("worker"), F.lit("").alias("question"), F.lit("").alias("status"), F.lit(False).alias("follow_up"))
    if not deep.isEmpty():
        done["deep"], workers = research(deep, base, cfg, purse(deep, "deep"), plan)

    final = routed.join(deep.select("query_id", "escalated"), "query_id", "left").withColumn("escalated", F.coalesce("escalated", F.lit(False)))
    final = final.withColumn("route", F.when(F.col("escalated"), "deep").otherwise(F.col("route")))
    composed, sentences, parts, spent = None, None, None, None
    for name, one in done.items():
        keep = final.where(F.col("route") == name).select("query_id")
        tables = [d.join(keep, "query_id", "left_semi") for d in (one.composed, one.sentences, one.parts)]
        if composed is None:
            composed, sentences, parts, spent = *tables, one.spent
        else:
            composed, sentences, parts = (a.unionByName(b) for a, b in zip((composed, sentences, parts), tables, strict=True))
            spent = spent.unionByName(one.spent)
    if composed is None:  # small talk only: nothing was searched
        none = searched(routed.where(F.lit(False)), base, 0, cfg, None)
        composed, sentences, parts, spent = none.composed, none.sentences, none.parts, none.spent
    calls = spent.groupBy("query_id").agg(F.sum("calls").alias("calls"))
    rows = final.join(composed, "query_id", "left").join(calls, "query_id", "left")
    state = F.when(F.col("route") == "direct", "direct").otherwise(F.coalesce("status", F.lit("failed")))
    rows = rows.withColumn("status", state).withColumn("calls", F.coalesce("calls", F.lit(0)))
    rows = rows.withColumn("n_unanswered", F.coalesce(F.size("unanswered"), F.lit(0)))
    note = (F.col("status") != "direct") & answers.hand_over()[0]
    table = rows.select("query_id", "kb_id", "query", "route", "escalated", *[c for c in _COMPOSED if c != "query_id"], "calls", note.alias("general"))
    return Routed(cut_lineage(table, "answers"), cut_lineage(sentences, "sentences"), cut_lineage(parts, "parts"), workers)
