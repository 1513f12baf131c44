"""Planning, drafting, checking, repairing and composing on a small corpus."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import answers
from tidemark.plans import questions as q

EV = "query_id int, chunk_id string, place int, text string"
SUB = "query_id int, subq int, question string"


def test_plan_splits_and_keeps_at_least_one_part(spark):
    df = spark.createDataFrame([(1, "What is the refund window and how do I claim ERR-4012?"), (2, "the of")], "query_id int, query string")
    got = sorted((r["query_id"], r["subq"], r["question"]) for r in answers.plan_questions(df).collect())
    assert got == [(1, 0, "What is the refund window?"), (1, 1, "how do I claim ERR-4012?"), (2, 0, "the of?")]


def test_draft_uses_each_sentence_once_and_reports_gaps(spark):
    ev = spark.createDataFrame([(1, "a", 1, "# Refund window days\n\nThe refund window lasts 30 days. Claims need a receipt."), (1, "b", 2, "Refund window rules differ. Nothing else.")], EV)
    sub = spark.createDataFrame([(1, 0, "refund window"), (1, 1, "refund window claims"), (1, 2, "parental leave")], SUB)
    rows = sorted(answers.draft(ev, sub).collect(), key=lambda r: (r["kind"], r["position"]))
    assert [r["text"] for r in rows if r["kind"] == "sentence"] == ["The refund window lasts 30 days.", "Refund window rules differ."]
    assert [r["subq"] for r in rows if r["kind"] == "unanswered"] == [1, 2]
    avoid = spark.createDataFrame([(1, " the REFUND window lasts 30 days.")], "query_id int, claim string")
    again = answers.draft(ev, sub, avoid).where("kind = 'sentence'").collect()
    assert [r["text"] for r in again] == ["Refund window rules differ."]


def test_verify_supports_contradicts_and_covers(spark):
    said = spark.createDataFrame([(1, 0, "The refund window lasts 30 days.", ["a"]), (1, 1, "Moon cheese tastes blue.", ["a"])], "query_id int, sentence int, text string, citations array<string>")
    ev = spark.createDataFrame([(1, "a", 1, "The refund window lasts 30 days for all."), (1, "b", 2, "The refund window lasts 60 days.")], EV)
    claims = {r["sentence"]: r for r in answers.verify_claims(said, ev).collect()}
    assert claims[0]["support"] == "full" and claims[0]["supporting"] == ["a"] and claims[0]["contradicting"] == ["b"]
    assert claims[1]["support"] == "none"
    sub = spark.createDataFrame([(1, 0, "How long is the refund window?"), (1, 1, "Who pays?")], SUB)
    c = answers.verify_claims(said, ev)
    parts = answers.answered_parts(sub, c)
    m = answers.answer_metrics(said, c, parts).first()
    assert (m["groundedness"], m["contradiction"], m["coverage"], m["citation_accuracy"]) == (0.5, 0.5, 0.5, 0.5)


def test_repair_moves_layout_to_the_next_kept_sentence(spark):
    said = spark.createDataFrame([(1, 0, "bad", ["x"], "bullet", "Head"), (1, 1, "good", ["x"], "continue", ""), (1, 2, "fine", ["z"], "continue", "")],
                                 "query_id int, sentence int, text string, citations array<string>, block string, heading string")
    claims = spark.createDataFrame([(1, 0, "bad", "none", [], []), (1, 1, "good", "full", ["y"], []), (1, 2, "fine", "full", ["z"], [])],
                                   "query_id int, sentence int, claim string, support string, supporting array<string>, contradicting array<string>")
    kept, kept_claims = answers.repair(said, claims)
    rows = [tuple(r) for r in kept.orderBy("sentence").collect()]
    assert rows == [(1, 0, "good", ["y"], "bullet", "Head"), (1, 1, "fine", ["z"], "continue", "")]
    assert sorted(r["sentence"] for r in kept_claims.collect()) == [0, 1]


def test_spans_slice_back_to_the_text(spark):
    said = spark.createDataFrame([(1, 0, "One.", ["b"]), (1, 1, "Two two.", ["a", "b"])], "query_id int, sentence int, text string, citations array<string>")
    rows = answers.spans(said).orderBy("sentence").collect()
    joined = "One. Two two."
    assert [joined[r["start"]:r["end"]] for r in rows] == ["One.", "Two two."]
    assert [r["numbers"] for r in rows] == [[1], [2, 1]]


def small_base(spark):
    rows = [
        ("c1", "d1", 0, "warm", "The refund window lasts 30 days after purchase."),
        ("c2", "d1", 1, "warm", "A receipt is needed for every claim."),
        ("c3", "d2", 0, "cold", "Parental leave lasts sixteen weeks for employees."),
        ("c4", "d3", 0, "warm", "Holiday calendars are published every spring by the office."),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, ord int, tier string, text string")
    none = F.array().cast("array<string>")
    chunks = df.select(
        F.lit("kb").alias("kb_id"), "chunk_id", "doc_id", "ord", F.lit("active").alias("status"), F.lit("").alias("title"), F.lit("").alias("section_path"),
        F.lit("").alias("context"), none.alias("aliases"), none.alias("flags"), "text", (F.col("tier") != "cold").alias("allowed"), F.lit(True).alias("escalated"),
    )
    docs = df.select("doc_id", "tier").distinct().select(
        F.lit("kb").alias("kb_id"), "doc_id", F.lit("active").alias("status"), "tier", F.lit(1.0).alias("authority"), F.lit(0.7).alias("quality"), F.lit(0.5).alias("freshness"))
    return q.Base.build(chunks, docs)


def test_healing_finds_the_cold_document(spark):
    asked = spark.createDataFrame([("kb", 1, "How long is the refund window?"), ("kb", 2, "How long does parental leave last?")], "kb_id string, query_id int, query string")
    sub = answers.plan_questions(asked).drop("query")
    answer, healed, _ = q.answer_questions(sub, small_base(spark), rounds=2)
    status = {r["query_id"]: r["s"] for r in answer.metrics.select("query_id", answers.status().alias("s")).collect()}
    assert status == {1: "verified", 2: "verified"}
    rescued = {(r["query_id"], r["origin"], r["chunk_id"]) for r in healed.rescues.collect()}
    assert rescued == {(2, "cold", "c3")}


@pytest.mark.parametrize("mode,route", [("fast", "fast"), ("auto", "direct")])
def test_route(spark, mode, route):
    df = spark.createDataFrame([("hello there", mode, 10, 1000, True, False, False)], "query string, mode string, kb_tokens int, window int, allow_escalation boolean, is_eval boolean, staged boolean")
    gated = answers.gate_features(df).withColumn("retrieval_need", F.lit(0.05))
    assert gated.select(answers.route().alias("r")).first()["r"] == route
