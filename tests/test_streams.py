"""Streams give what the batch operators give on the same rows."""

import datetime
import glob
import os
import random
import re
import uuid

from pyspark.sql import functions as F

from tidemark.operators import search, signals
from tidemark.plans import catalog
from tidemark.plans.queries_streams import StreamTables, out_path, run
from tidemark.plans.tables import Tables
from tidemark.streaming import ingestion, jobs, spans

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_rate_stream_equals_batch(spark):
    t, s = Tables(spark, SF), StreamTables(spark, SF)
    pick = lambda d: d.select(F.col("trace_id").alias("request_id"), F.col("user_id").alias("key"), "created_at")
    batch = jobs.rates_in_window(pick(t.traces()), 3600).select("key", "request_id", "n_recent")
    assert rows(run(s, jobs.rate_stream(pick(s.traces()), 3600), ["key", "request_id"])) == rows(batch)


def test_rephrase_stream_equals_batch(spark):
    t, s = Tables(spark, SF), StreamTables(spark, SF)
    batch = signals.rephrases(t.turns(), threshold=0.05).select("session_id", "trace_id", "rephrase_of")
    got = run(s, jobs.rephrase_stream(s.turns(), 0.05), ["session_id", "trace_id"]).where("rephrase_of is not null")
    assert rows(got.select("session_id", "trace_id", "rephrase_of")) == rows(batch) and batch.count() > 0


def in_triggers(spark, folder, batches, schema):
    """A stream of given batches, one to a trigger, in their order."""
    for n, some in enumerate(batches):
        path = f"{folder}/{n}"
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(path)
        for f in glob.glob(f"{path}/*.parquet"):
            os.utime(f, (1_000_000 + n, 1_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_rates_follow_late_rows_in_any_triggers(spark, tmp_path):
    draw = random.Random(5)
    start = datetime.datetime(2024, 3, 1, tzinfo=datetime.UTC)
    # whole and half seconds, so that gaps of exactly a minute are among them; a key with most rows
    times = [start + datetime.timedelta(seconds=draw.randrange(1200) / 2) for _ in range(400)]
    data = [(n, "hot" if n % 4 else f"k{n % 3}", at) for n, at in enumerate(times)]
    schema = "request_id long, key string, created_at timestamp"
    batch = rows(jobs.rates_in_window(spark.createDataFrame(data, schema)).select("key", "request_id", "n_recent"))
    for size in (400, 67):
        draw.shuffle(data)
        stream = in_triggers(spark, str(tmp_path / str(size)), [data[i : i + size] for i in range(0, 400, size)], schema)
        got = run(Tables(spark, SF), jobs.rate_stream(stream, late="1 hour"), ["key", "request_id"])
        assert rows(got) == batch


def test_rates_drop_state_and_rows_behind_the_watermark(spark, tmp_path):
    def at(minute):
        return datetime.datetime(2024, 3, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=minute)

    batches = [[(1, "k", at(0))], [(2, "k", at(60))], [(3, "k", at(61))], [(4, "k", at(0.5)), (5, "k", at(61.5))]]
    stream = in_triggers(spark, str(tmp_path / "in"), batches, "request_id long, key string, created_at timestamp")
    seen = []
    folder = str(tmp_path / "check")
    jobs.run_now(jobs.rate_stream(stream), lambda df, n: seen.append((n, rows(df))), checkpoint=folder)
    told = [r for _, some in seen for r in some]
    assert sorted(told) == [("k", 1, 1), ("k", 2, 1), ("k", 3, 2), ("k", 5, 2)]  # 4 is an hour late
    state = spark.read.format("statestore").option("stateVarName", "rows").load(folder)
    assert {r["id"] for r in state.select("list_element.id").collect()} == {2, 3, 5}  # the first is gone


def test_a_late_question_takes_a_rephrase_back(spark, tmp_path):
    def at(second):
        return datetime.datetime(2024, 3, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=second)

    one, two, other = "reset router password", "router password reset steps", "holiday calendar berlin"
    batches = [
        [(1, "kb", "s", one, at(0)), (2, "kb", "s", two, at(100)), (9, "kb", None, one, at(100))],
        [(3, "kb", "s", other, at(50))],  # came late and stands between
        [(4, "kb", "s", one, at(280)), (5, "kb", "t", two, at(281)), (6, "kb", "s", one.upper(), at(290)), (7, "kb", "s", two, at(471))],
    ]
    schema = "trace_id long, kb_id string, session_id string, query string, created_at timestamp"
    stream = in_triggers(spark, str(tmp_path / "in"), batches, schema)
    seen = {}
    path = str(tmp_path / "out")

    def write(df, n):
        seen[n] = {(r.trace_id, r.rephrase_of) for r in df.collect()}
        jobs.batch_writer(path)(df, n)

    jobs.run_now(jobs.rephrase_stream(stream), write)
    assert seen[0] == {(2, 1)} and seen[1] == {(2, None)} and seen[2] == {(4, 2)}
    last = jobs.latest(spark, path, ["kb_id", "session_id", "trace_id"]).where("rephrase_of is not null")
    batch = signals.rephrases(spark.createDataFrame([r for some in batches for r in some], schema))
    pick = ["kb_id", "session_id", "trace_id", "rephrase_of", "similarity"]
    assert rows(last.select(*pick)) == rows(batch.select(*pick)) and last.count() == 1


def test_ingest_adds_versions_only_for_changes(spark):
    t = Tables(spark, SF)
    log = ingestion.CorpusLog(spark, out_path(t, "corpus-" + uuid.uuid4().hex[:6]))

    def batch(*files):
        df = spark.createDataFrame(list(files), "uri string, body string")
        return df.select(F.lit("kb").alias("kb_id"), "uri", F.concat("uri", F.lit(".txt")).alias("name"), F.encode("body", "UTF-8").alias("content"))

    log.ingest(batch(("a", "First text here."), ("b", "Second text.")), 0)
    log.ingest(batch(("a", "First text here."), ("b", "Second text changed."), ("c", "Third.")), 1)
    log.ingest(batch(("a", "First text here."), ("b", "Second text changed."), ("c", "Third.")), 1)  # a retried batch
    assert {(r["uri"], r["version"]) for r in log.documents().collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert {r["text"] for r in log.live_chunks().collect()} == {"First text here.", "Second text changed.", "Third."}


def test_ingest_reads_the_current_table_by_slice_and_keeps_postings(spark, tmp_path):
    def batch(*files):
        df = spark.createDataFrame(list(files), "uri string, body string")
        return df.select(F.lit("kb").alias("kb_id"), "uri", F.concat("uri", F.lit(".txt")).alias("name"), F.encode("body", "UTF-8").alias("content"))

    log = ingestion.CorpusLog(spark, str(tmp_path / "log"), slices=16, fold=0.5, keep_index=True)
    texts = {f"u{i}": f"Text number {i} about things." for i in range(30)}
    log.ingest(batch(*texts.items()), 0)
    assert log._since(None) == (None, [0])
    for n in range(1, 3):
        new = {f"u{n}": f"Changed words {n}.", f"v{n}": f"Other matters {n}."}
        texts |= new
        log.ingest(batch(*new.items(), ("u9", texts["u9"])), n)
        if n == 2:
            log.ingest(batch(*new.items(), ("u9", texts["u9"])), n)  # a retried batch
    assert log._since(None) == (0, [1, 2])  # the first batch was folded, those after it are a small part of it
    plan = log.known(batch(("u2", "")), 5)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[slice#\d+ IN|PartitionFilters: \[isnotnull\(slice#\d+\), \(slice#\d+ = ", plan)
    assert [(r.uri, r.version) for r in log.known(batch(("u2", ""), ("nowhere", "")), 5).collect()] == [("u2", 2)]
    want = {(f"u{i}", 2 if 1 <= i < 3 else 1) for i in range(30)} | {(f"v{n}", 1) for n in range(1, 3)}
    assert {(r.uri, r.version) for r in log.documents().collect()} == want
    assert sorted(r.text for r in log.live_chunks().collect()) == sorted(texts.values())
    live = log.live_chunks()
    pick = lambda df: {(r.term, r.tf, r.doc_len) for r in df.select("term", "tf", "doc_len").collect()}
    assert pick(log.index().postings()) == pick(search.postings(live))
    assert log.index().postings().count() == search.postings(live).count()
    assert log.fold_log(force=True) and log._since(None)[1] == []
    assert {(r.uri, r.version) for r in log.documents().collect()} == want


def test_tables_in_folders_of_files_are_streamed(spark, tmp_path):
    """A larger table is a folder of files; a stream of it has the rows of the table, like one of a single file."""
    folder = str(tmp_path)
    turns = [(c, n, "user", f"how long does part {c} last {n // 2}") for c in range(3) for n in range(0, 6, 2)]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(turns, schema).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    texts = [(d, "en", f"Title {d}\n\nA line about part {d}.") for d in range(4)]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").repartition(2).write.parquet(f"{folder}/documents.parquet")
    told = catalog.QUERIES["k4_rephrase_stream"](spark, folder)
    batch = signals.rephrases(Tables(spark, folder).turns(), threshold=0.1)
    assert rows(told.select("session_id", "trace_id", "rephrase_of")) == rows(batch.select("session_id", "trace_id", "rephrase_of")) and batch.count() > 0
    live = catalog.QUERIES["k1_incremental_ingest"](spark, folder)
    assert live.select("doc_id").distinct().count() == 4


def test_many_keys_share_a_state(spark):
    """A state is a slot's span of time with all its keys, so the number of states does not follow that of the keys."""
    start = datetime.datetime(2024, 3, 1, tzinfo=datetime.UTC)
    data = [(n, n % 900 if n % 11 else None, start + datetime.timedelta(seconds=n)) for n in range(3000)]
    asked = spark.createDataFrame(data, "request_id long, key long, created_at timestamp")
    states = spans.in_spans(asked, 60, ["key"]).select("slot", "span").distinct().count()
    assert states <= 2 * (spans.SLOTS + 1) < 900


def test_rates_of_null_keys_are_counted_together(spark, tmp_path):
    start = datetime.datetime(2024, 3, 1, tzinfo=datetime.UTC)
    data = [(n, n % 3 if n % 2 else None, start + datetime.timedelta(seconds=7 * n)) for n in range(60)]
    schema = "request_id long, key long, created_at timestamp"
    batch = jobs.rates_in_window(spark.createDataFrame(data, schema)).select("request_id", "key", "n_recent")
    stream = in_triggers(spark, str(tmp_path), [data[:40], data[40:]], schema)
    got = run(Tables(spark, SF), jobs.rate_stream(stream, late="1 hour"), ["key", "request_id"])
    assert {tuple(r) for r in got.select("request_id", "key", "n_recent").collect()} == {tuple(r) for r in batch.collect()}
