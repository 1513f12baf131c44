"""Operations on the stored chunks: same rows as on the table in memory, and untouched files stay."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import corpus
from tidemark.operators.chunk_store import ChunkStore

KIND = "kb_id string, doc_id long, chunk_id string, doc_version int, status string, text string"


def chunks(spark):
    rows = []
    for d in range(40):
        kb = ["7", "b/c", "a=1"][d % 3]
        for v, status in ((1, "retired"), (2, "active"), (3, "staged")):
            if v < 3 or d % 2:
                rows += [(kb, d, f"{d}-{o}@{v}", v, status, "x" * o) for o in range(3)]
    return spark.createDataFrame(rows, KIND)


def rows(df):
    return sorted(tuple(r) for r in df.select("kb_id", "doc_id", "chunk_id", "doc_version", "status", "text").collect())


def files(store):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.root}/data/**/*.parquet", recursive=True)}


def test_operations_equal_those_in_memory(spark, tmp_path):
    now = chunks(spark).cache()
    store = ChunkStore(spark, str(tmp_path / "s"), slices=4).create(now)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    target = ids(1, 3).withColumn("version", F.lit(3))
    store.activate("a", target)
    now = corpus.activate_versions(now, target)
    assert rows(store.chunks()) == rows(now)
    store.roll_back("b", ids(1, 8, 99))
    now = corpus.roll_back(now, ids(1, 8, 99))
    assert rows(store.chunks()) == rows(now)
    store.discard("c", ids(5))
    now = corpus.discard_staged(now, ids(5))
    fresh = spark.createDataFrame([("7", 9, "9-0@4", 4, "staged", "new")], KIND)
    store.stage("d", fresh)
    now = corpus.discard_staged(now, ids(9)).unionByName(fresh)
    assert rows(store.chunks()) == rows(now)
    more = spark.createDataFrame([("new", 77, "77-0@1", 1, "active", "n")], KIND)
    store.add("e", more)
    now = now.unionByName(more)
    assert rows(store.chunks()) == rows(now)
    store.promote("f")
    now = corpus.promote_staged(now)
    assert rows(store.chunks()) == rows(now)
    again = files(store)
    store.promote("f")
    store.roll_back("b", ids(1, 8, 99))  # both are done: a second try changes nothing
    assert files(store) == again and rows(store.chunks()) == rows(now)


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), slices=16).create(chunks(spark))
    before = files(store)
    store.activate("a", spark.createDataFrame([("b/c", 1, 3)], "kb_id string, doc_id long, version int"))
    after = files(store)
    slices = {re.search(r"slice=\d+", f)[0] for f in set(before) ^ set(after) | {f for f in before if after.get(f) != before[f]}}
    assert len(slices) == 1 and all("kb_id=b%2Fc" in f for f in set(before) ^ set(after))
    assert sum(after.get(f) == t for f, t in before.items()) > 0.9 * len(before)


def test_live_chunks_are_read_by_partition(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), slices=2).create(chunks(spark))
    plan = store.chunks("active", "staged")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[status#\d+ IN \(active,staged\)\]", plan)
    docs = chunks(spark).select("kb_id", "doc_id").distinct().withColumn("title", F.lit("t"))
    assert {r.status for r in store.live(docs).collect()} == {"active", "staged"}


@pytest.mark.parametrize("fails_at", ["rows", "data", "done"])
def test_a_failed_operation_is_finished_or_tried_again(spark, tmp_path, monkeypatch, fails_at):
    now = chunks(spark).cache()
    store = ChunkStore(spark, str(tmp_path / "s"), slices=2).create(now)
    ids = spark.createDataFrame([(i,) for i in range(0, 40, 4)], "doc_id long")

    def stop(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        real = store._mark
        if fails_at == "rows":
            m.setattr(store, "_mark", stop)
        elif fails_at == "data":
            m.setattr(store, "_apply", stop)
        else:
            m.setattr(store, "_mark", lambda path: stop() if path.endswith("done") else real(path))
        with pytest.raises(OSError):
            store.roll_back("a", ids)
    want = rows(corpus.roll_back(now, ids))
    if fails_at == "rows":
        assert rows(store.chunks()) == rows(now)  # nothing was made ready
    else:
        assert rows(store.chunks()) == want  # the next reader finishes it
    store.roll_back("a", ids)
    assert rows(store.chunks()) == want


def test_an_operation_moves_no_text_twice_and_leaves_one_copy(spark, tmp_path):
    seen = []
    store = ChunkStore(spark, str(tmp_path / "s"), slices=2).create(chunks(spark))
    real = store._write
    store._write = lambda rows, *more: (seen.append(rows._jdf.queryExecution().executedPlan().toString()), real(rows, *more))
    targets = spark.createDataFrame([(i, 3) for i in (1, 3, 5)], "doc_id long, version int")
    store.activate("a", targets)
    store.roll_back("b", targets)
    store.discard("c", targets)
    store.promote("d")
    assert len(seen) == 4
    for plan in seen:  # a line of an exchange names nothing below it, a join's shuffled side is sorted
        assert "SortMergeJoin" not in plan and not re.search(r"Exchange hashpartitioning\([^)]*slice", plan)
    assert not glob.glob(f"{store.root}/journal/*/rows/**/*.parquet", recursive=True)


def test_a_move_that_was_cut_short_is_taken_up_where_it_ended(spark, tmp_path, monkeypatch):
    now = chunks(spark).cache()
    store = ChunkStore(spark, str(tmp_path / "s"), slices=2).create(now)
    ids = spark.createDataFrame([(i,) for i in range(0, 40, 4)], "doc_id long")
    real = store._partitions
    with monkeypatch.context() as m:
        m.setattr(store, "_apply", lambda journal: None)
        store.roll_back("a", ids)
    journal = f"{store.root}/journal/a"
    assert len(real(f"{journal}/rows")) > 2
    with monkeypatch.context() as m:  # two partitions are put in place, then the writer is lost
        m.setattr(store, "_partitions", lambda path: (*real(path)[:2], "kb_id=none/status=x/slice=0"))
        with pytest.raises(Exception, match="none"):
            store._apply(journal)
    assert rows(store.chunks()) == rows(corpus.roll_back(now, ids))
