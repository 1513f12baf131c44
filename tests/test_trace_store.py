"""The stored trace log, merged diagnoses, setting edits and call budgets."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from test_answers import small_base

from tidemark.operators import answers, mining
from tidemark.plans import questions as q
from tidemark.session import new_folder
from tidemark.sources.trace_store import DETAILS, TraceStore

DAY = datetime(2024, 1, 1, 9)
FINDING = """kb_id string, trace_id string, root_cause string, target string, severity double, summary string, question string, doc_id string,
chunk_id string, tier string, url string, user_words array<string>, doc_words array<string>, seen_at timestamp"""


def traces(spark, *rows):
    return spark.createDataFrame(
        [(i, "kb", "q", status, healed, False, at) for i, status, healed, at in rows],
        "trace_id string, kb_id string, query string, status string, healed boolean, is_eval boolean, created_at timestamp",
    )


def findings(spark, *rows):
    """rows: trace, cause, target, severity, words, day of January"""
    made = [
        ("kb", t, c, g, s, f"said by {t}", f"asked by {t}", None, None, None, None, list(w), None, datetime(2024, 1, d)) for t, c, g, s, w, d in rows
    ]
    return spark.createDataFrame(made, FINDING)


def test_a_run_written_again_changes_nothing(spark):
    store = TraceStore(spark, new_folder(spark, "log"))
    assert store.traces().count() == 0 and store.detail("trace_steps").count() == 0
    log = traces(spark, ("a", "failed", False, DAY), ("b", "verified", False, datetime(2024, 1, 2)), ("c", "partial", False, None))
    said = spark.createDataFrame([("a", "x"), ("a", "y"), ("z", "of no trace")], "trace_id string, sentence string")
    assert store.write("r1", log, {"trace_unsupported": said})
    before = sorted(map(str, store.traces().collect()))
    assert not store.write("r1", log.limit(1), {"trace_unsupported": said.limit(0)})
    assert sorted(map(str, store.traces().collect())) == before and len(before) == 3
    assert {r.sentence for r in store.detail("trace_unsupported").collect()} == {"x", "y"}
    assert store.traces(since=datetime(2024, 1, 2).date()).count() == 1
    with pytest.raises(ValueError):
        store.write("../r2", log, {})
    with pytest.raises(ValueError):
        store.write("r2", log, {"trace_thoughts": said})


def test_a_run_that_failed_is_not_read_and_can_be_written_again(spark):
    store = TraceStore(spark, new_folder(spark, "log"))
    log = traces(spark, ("a", "failed", False, DAY))
    store.write("r1", log, {})
    broken = spark.createDataFrame([("b", "x")], "trace_id string, sentence string").withColumn(
        "sentence", F.when(F.raise_error(F.lit("lost")).isNull(), F.col("sentence"))
    )
    more = traces(spark, ("b", "failed", False, DAY))
    with pytest.raises(Exception, match="lost"):
        store.write("r2", more, {"trace_unsupported": broken})
    assert [r.trace_id for r in store.traces().collect()] == ["a"]
    assert store.write("r2", more, {}) and store.traces().count() == 2


def test_dealt_with_until_bad_feedback_comes(spark):
    store = TraceStore(spark, new_folder(spark, "log"))
    log = traces(spark, ("clean", "verified", False, DAY), ("bad", "failed", False, DAY), ("healed", "verified", True, DAY))
    store.write("r1", log, {})

    def todo(feedback=None):
        return {r.trace_id for r in store.traces(feedback).where("not diagnosed").collect()}

    assert todo() == {"bad", "healed"}
    store.mark_mined("c1", log.where("trace_id <> 'clean'"), datetime(2024, 1, 5))
    store.mark_mined("c1", log.limit(0), datetime(2024, 1, 5))
    assert todo() == set()
    told = [("clean", "explicit", -1, datetime(2024, 1, 3)), ("bad", "explicit", -1, datetime(2024, 1, 4)), ("healed", "rephrase", -1, datetime(2024, 1, 6))]
    feedback = spark.createDataFrame(told, "trace_id string, kind string, rating int, ts timestamp")
    assert todo(feedback) == {"clean", "healed"}


def test_findings_merge_into_open_diagnoses(spark):
    first = findings(spark, ("t1", "gap", "g", 1.0, "ab", 1), ("t2", "gap", "g", 0.5, "bc", 2), ("t2", "gap", "g", 0.5, "c", 2), ("t1", "miss", "m", 0.8, "", 1))
    book, members = mining.merge_findings(first, None, None, "c1")
    by = {r.root_cause: r for r in book.collect()}
    assert (by["gap"].impact, by["gap"].n_traces, by["gap"].summary, by["gap"].question) == (1.5, 2, "said by t2", "asked by t1")
    assert by["gap"].user_words == ["a", "b", "c"] and by["miss"].user_words is None and members.count() == 3

    same, same_members = mining.merge_findings(first, book, members, "c1")  # run again
    assert sorted(map(str, same.collect())) == sorted(map(str, book.collect())) and same_members.count() == 3

    book = book.withColumn("status", F.when(F.col("root_cause") == "miss", "wont_fix").otherwise("fixing"))
    second = findings(spark, ("t2", "gap", "g", 1.0, "da", 3), ("t3", "gap", "g", 1.0, "", 3), ("t1", "miss", "m", 0.8, "", 3))
    book, members = mining.merge_findings(second, book, members, "c2")
    rows = book.collect()
    gap = [r for r in rows if r.root_cause == "gap"]
    assert [(r.impact, r.n_traces, r.status, r.summary, r.user_words) for r in gap] == [(2.5, 3, "fixing", "said by t3", ["a", "b", "c", "d"])]
    assert sorted((r.status, r.impact, r.n_traces) for r in rows if r.root_cause == "miss") == [("open", 0.8, 1), ("wont_fix", 0.8, 1)]
    assert len({r.diagnosis_id for r in rows}) == 3 and members.count() == 5
    few, _ = mining.merge_findings(second, book, members, "c3", limit=2)
    assert next(r for r in few.collect() if r.root_cause == "gap").user_words == ["a", "b"]
    none, _ = mining.merge_findings(second.limit(0), book, members, "c3")
    assert none.count() == 3


def test_settings_are_put_back_one_fix_at_a_time(spark):
    base = spark.createDataFrame([("kb", "gate_threshold", "0.3")], "kb_id string, name string, value string")
    rows = [
        ("f1", "kb", "gate_threshold", {"value": "0.2"}, 1),
        ("f2", "kb", "gate_threshold", {"value": "0.1"}, 2),
        ("f3", "kb", "add_alias", {"phrases": "pto,,leave", "expansions": "holiday"}, 3),
        ("f4", "kb", "doc_boost", {"doc_id": "7", "boost": "1.2"}, 4),
        ("f5", "kb", "set_tier", {"doc_id": "7"}, 5),
    ]
    edits = mining.setting_edits(spark.createDataFrame(rows, "fix_id string, kb_id string, kind string, params map<string,string>, applied_at int"))
    after, inverse = mining.apply_setting_fixes(base, edits)

    def values(df):
        return {r.name: r.value for r in df.collect()}

    everything = {"gate_threshold": "0.1", "alias:pto": "holiday", "alias:leave": "holiday", "boost:7": "1.2"}
    assert values(after) == everything

    def without(*ids):
        return values(mining.roll_back_settings(after, inverse, spark.createDataFrame([(i,) for i in ids], "fix_id string")))

    assert without("f1") == everything
    assert without("f2") == everything | {"gate_threshold": "0.2"}
    assert without("f1", "f2", "f3") == {"gate_threshold": "0.3", "boost:7": "1.2"}

    fixes = spark.createDataFrame([("a", "rechunk_doc", "d1", 3), ("b", "augment_chunk", "d2", 3), ("c", "set_tier", "d1", 3)], "fix_id string, kind string, doc_id string, version int")
    docs = spark.createDataFrame([("d1", 3), ("d2", 4)], "doc_id string, version int")
    back = mining.chunk_fix_roll_backs(fixes, docs, fixes.select("fix_id"))
    assert {(r.doc_id, r.ok) for r in back.collect()} == {("d1", True), ("d2", False)}


def test_affordable_takes_the_first_of_a_question(spark):
    missing = spark.createDataFrame([(i, s) for i in range(1, 7) for s in range(4)], "query_id int, subq int")
    left = {1: 2, 2: 3, 3: 4, 4: 5, 5: 50}  # question 6 has no limit
    got = q.affordable(missing, spark.createDataFrame(list(left.items()), "query_id int, left int"))
    want = {(i, s) for i in range(1, 7) for s in range(4) if i not in left or left[i] >= 3 and s + 1 + 1 <= left[i]}
    assert {(r.query_id, r.subq) for r in got.collect()} == want


def test_answers_within_budget_become_a_stored_log_that_is_mined(spark):
    said = "How long does parental leave last?"
    asked = spark.createDataFrame([("kb", i, said) for i in (1, 2, 3)] + [("kb", 4, "How do submarines float?")], "kb_id string, query_id int, query string")
    limits = {1: 3, 2: 5, 3: 30, 4: 9}
    budget = spark.createDataFrame(list(limits.items()), "query_id int, calls long")
    sub = answers.plan_questions(asked).drop("query")
    base = small_base(spark)
    answer, healed, _ = q.answer_questions(sub, base, rounds=2, budget=budget)
    spent = {r.query_id: r.calls for r in answer.spent.collect()}
    assert all(spent.get(i, 0) <= n for i, n in limits.items())
    # 1 cannot pay a first answer, 2 cannot pay another look, 3 can
    assert 1 not in spent and spent[2] == 4 and spent[3] >= 6
    assert {(r.query_id, r.arm) for r in healed.heals.where("query_id in (2, 3)").collect()} == {(2, "budget"), (3, "retrieval")}

    log, details = q.trace_log(asked, sub, answer, healed, "night-1", DAY)
    assert set(details) == set(DETAILS)
    store = TraceStore(spark, new_folder(spark, "log"))
    assert store.write("night-1", log, details)
    kept = {r.trace_id: r for r in store.traces().collect()}
    assert {i: kept[f"night-1/{i}"].status for i in (1, 3, 4)} == {1: "failed", 3: "verified", 4: "failed"}
    assert kept["night-1/3"].healed and kept["night-1/3"].llm_calls == spent[3]

    mined = mining.mine_failures(store.traces())
    docs = base.docs.withColumn("title", F.lit("")).withColumn("uri", F.col("doc_id")).withColumn("content_hash", F.lit("h"))
    sources = docs.select("uri", F.lit("h").alias("source_hash"))
    found = mining.mine_log(mined, store.detail, base.chunks, docs, sources)
    causes = {(r.trace_id, r.root_cause, r.target) for r in found.collect()}
    assert ("night-1/3", "ranking_miss", "tier:d2") in causes
    assert ("night-1/4", "missing_content", "gap:how do submarines float?") in causes
    assert not any(t == "night-1/1" and c == "missing_content" for t, c, _ in causes)
