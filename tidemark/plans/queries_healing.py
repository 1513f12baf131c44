"""Catalog: the heal rounds and whole evaluation runs over all benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, search
from . import questions as q
from .catalog import query


def _base(t):
    chunks = t.stored("chunks", lambda: t.masked_chunks().withColumn("anchors", search.anchors(search.exact_hay())))
    kept = ["kb_id", "chunk_id", "doc_len", "allowed", "escalated"]
    index = t.stored("posting_blocks", lambda: search.posting_blocks(search.tokenised(chunks), chunks.count()))
    return q.Base(
        chunks,
        t.stored("docs", lambda: t.docs().withColumn("kb_id", F.lit("all")).drop("text")),
        index,
        t.stored("lengths", lambda: search.block_lengths(index).select(*kept)),
    )


def _planned(t):
    asked = t.benchmark.select(F.lit("all").alias("kb_id"), F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return answers.plan_questions(asked).drop("query")


@query("f7_heal_retrieval")
def _(t):
    base, asked = _base(t), _planned(t)
    graded, pool = q.first_pass(asked, base)
    healed = q.heal_retrieval(asked, graded, pool, base)
    return healed.graded.select("query_id", "chunk_id", "verdict", "origin")


@query("f26_heal_answers")
def _(t):
    answer, _, _ = q.answer_questions(_planned(t), _base(t))
    return answer.metrics


@query("j11_run_items")
def _(t):
    items = t.benchmark.select(
        "item_id",
        F.col("text").alias("question"),
        F.col("text").alias("expected"),
        F.lit("golden").alias("kind"),
        F.array().cast("array<string>").alias("expected_doc_ids"),
    )
    done = q.run_items(items, _planned(t), _base(t))
    return done.select("item_id", "status", "groundedness", "coverage", "overall", "passed", "healed")
