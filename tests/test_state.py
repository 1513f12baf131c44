"""Versions, quotas, limits, ordered helpers, metrics and repair against plain models."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import corpus, evaluation, health, mining, ordered, signals

CH = "doc_id string, chunk_id string, doc_version int, status string"


def state(df):
    return {(r["chunk_id"], r["status"]) for r in df.collect()}


def test_activation_keeps_the_version_live_before(spark):
    chunks = spark.createDataFrame([("d", "a1", 1, "retired"), ("d", "a2", 2, "active"), ("d", "a4", 4, "staged"), ("e", "b1", 1, "active")], CH)
    after = corpus.promote_staged(chunks)
    assert state(after) == {("a2", "retired"), ("a4", "active"), ("b1", "active")}
    back = corpus.roll_back(after, spark.createDataFrame([("d",)], "doc_id string"))
    assert state(back) == {("a2", "active"), ("a4", "retired"), ("b1", "active")}
    docs = spark.createDataFrame([("d", 2)], "doc_id string, version int")
    assert corpus.next_versions(docs, back).first()["next_version"] == 5


def test_change_detection(spark):
    docs = spark.createDataFrame([("k", "u1", "d1", "h1", "active", 1), ("k", "u2", "d2", "h2", "error", 1), ("k", "u3", "d3", "h3", "active", 1)],
                                 "kb_id string, uri string, doc_id string, content_hash string, status string, version int")
    found = spark.createDataFrame([("k", "u1", "h1", None), ("k", "u2", "h2", None), ("k", "u4", "h", "bad"), ("k", "u5", "h", None)],
                                  "kb_id string, uri string, content_hash string, parse_error string")
    got = {r["uri"]: r["outcome"] for r in corpus.detect_changes(found, docs).collect()}
    assert got == {"u1": "unchanged", "u2": "updated", "u4": "error", "u5": "created"}
    assert {r["uri"] for r in corpus.removed_from_source(docs, found).collect()} == {"u3"}


def plain_admission(rows, budget, tokens_budget, files, tokens):
    out, names = [], set()
    for _, name, est, exists in rows:
        replaces = exists or name in names
        if not replaces and files >= budget:
            out.append("full")
        elif est is None:
            out.append("unreadable")
        elif tokens + est > tokens_budget:
            out.append("pages")
        else:
            tokens += est
            if not replaces:
                files += 1
                names.add(name)
            out.append("saved")
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_upload_admission_is_an_ordered_fold(spark, seed):
    r = random.Random(seed)
    rows = [(i, f"f{r.randint(0, 12)}.txt", r.choice([None, 10, 50, 200]), r.random() < 0.1) for i in range(80)]
    up = spark.createDataFrame([("k", *row[:2], 5, row[2], row[3]) for row in rows], "kb_id string, position int, name string, size int, est_tokens int, exists boolean")
    lim = spark.createDataFrame([("k", 100, 8, 1500, 2, 100)], "kb_id string, max_bytes int, file_budget int, token_budget int, files int, tokens int")
    got = [x["verdict"] for x in sorted(corpus.admit_uploads(up, lim).collect(), key=lambda x: x["position"])]
    assert got == plain_admission(rows, 8, 1500, 2, 100)


def plain_replay(rows, site):
    used, deep, recent, total, out = {}, {}, {}, {}, {}
    for user, ts, rid, is_deep, exempt, daily, deep_limit, minute in sorted(rows, key=lambda x: (x[1], x[2])):
        day = ts // 86400
        recent[user] = [t for t in recent.get(user, []) if ts - t <= 60]
        verdict = "ok"
        if not exempt:
            if daily and used.get((user, day), 0) >= daily:
                verdict = "daily"
            elif is_deep and deep.get((user, day), 0) >= deep_limit:
                verdict = "deep"
            elif site and total.get(day, 0) >= site:
                verdict = "global"
            elif minute and len(recent[user]) >= minute:
                verdict = "minute"
        if verdict == "ok":
            used[user, day] = used.get((user, day), 0) + 1
            deep[user, day] = deep.get((user, day), 0) + is_deep
            total[day] = total.get(day, 0) + 1
            recent[user].append(ts)
        out[rid] = verdict
    return out


@pytest.mark.parametrize("seed,site", [(1, 0), (2, 25), (3, 12)])
def test_limit_replay_equals_plain_fold_over_midnight(spark, seed, site):
    r = random.Random(seed)
    rows = []
    for i in range(160):
        ts = float(r.choice([86400 - r.randint(0, 90), 86400 + r.randint(0, 90), 2 * 86400 + r.randint(-60, 200), r.randint(0, 259200)]))
        user = r.randint(0, 5)
        rows.append((user, ts, i, r.random() < 0.2, user == 0, 7, 1, 2))
    df = spark.createDataFrame(rows, "user_id long, ts double, request_id long, deep boolean, exempt boolean, daily_limit int, deep_limit int, minute_limit int")
    got = {x["request_id"]: x["verdict"] for x in health.replay_limits(df, site_limit=site).collect()}
    assert got == plain_replay(rows, site)


def test_ordered_helpers_equal_plain_windows(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(r.choice("ab"), i, r.randint(0, 9)) for i in range(200)], "k string, i int, v int")
    w = Window.partitionBy("k").orderBy("i")
    want = {(x["k"], x["i"]): (x["p"], x["s"]) for x in df.withColumn("p", F.lag("v").over(w)).withColumn("s", F.sum("v").over(w)).collect()}
    lagged = ordered.lag_by_bucket(df, ["k"], ["i"], F.floor(F.col("i") / 7), ["v"])
    both = ordered.running_total_by_bucket(lagged, ["k"], ["i"], F.floor(F.col("i") / 11), "v", "s")
    assert {(x["k"], x["i"]): (x["prev"]["v"] if x["prev"] else None, x["s"]) for x in both.collect()} == want


def test_percentiles_round_half_to_even(spark):
    df = spark.createDataFrame([("a", v) for v in range(4)] + [("b", 5)], "k string, v int")
    got = {r["k"]: r["p50"] for r in health.nearest_rank(df, ["k"], "v", {"p50": 0.5}).collect()}
    assert got == {"a": 2, "b": 5}


def test_undo_is_exact(spark):
    fb = spark.createDataFrame([(1, "explicit", -1), (1, "copy", 0), (2, "explicit", -1)], "trace_id int, kind string, rating int")
    cites = spark.createDataFrame([(1, "c"), (1, "c"), (2, "c")], "trace_id int, chunk_id string")
    row = signals.chunk_signals(fb, cites).first()
    assert (row["good"], row["bad"]) == (0.5, 2.0)
    stands = spark.createDataFrame([(1, "stands")], "trace_id int, verdict string")
    assert signals.chunk_signals(signals.undo_negative(fb, stands), cites).first()["bad"] == 1.0


def test_disposition(spark):
    rows = [("augment_chunk", False, False), ("augment_chunk", True, False), ("recrawl_doc", None, False), ("gate_threshold", True, False),
            ("gate_threshold", True, True), ("improve_prompt", True, False), ("quarantine_doc", None, False)]
    df = spark.createDataFrame(rows, "kind string, passed boolean, canary_running boolean").withColumn("risk", mining.risk(F.col("kind")))
    assert [r["d"] for r in df.select(mining.disposition().alias("d")).collect()] == [
        "rejected", "applied", "applied", "canary", "queued_for_canary", "pending_approval", "pending_approval"]


def test_canary_waits_then_decides(spark):
    stats = spark.createDataFrame([(1, 100, 0.8, 0.05, 0.9), (2, 10, 0.2, 0.0, 0.1)], "config_version int, n long, verified double, negative double, groundedness double")
    decide = lambda s, age: evaluation.canary_decision(s, 2, 1, age).first()["decision"]
    assert decide(stats, 1) == "waiting" and decide(stats, 8) == "expired"
    enough = stats.withColumn("n", F.lit(50))
    assert decide(enough, 1) == "rolled_back"
    assert decide(enough.withColumn("verified", F.lit(0.9)).withColumn("groundedness", F.lit(0.9)).withColumn("negative", F.lit(0.0)), 1) == "promoted"
