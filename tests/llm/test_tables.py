"""ARC to WARC, packing, substring dedup, Jaccard groups, vectors, components."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from helpers import LAST, SCHEMA, jaccard_groups, odd_documents, windows_removed
from pyspark.sql import functions as F

from tidemark.llm import jaccard, lattice, neighbours, packing, sketch, substrings, warc
from tidemark.llm.components import connected
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_warc_query(spark):
    first, want = {}, []
    for i, html in sorted(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()):
        raw = (html or "").encode()
        kept = first.setdefault(raw, i)
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if kept == i else "revisit", None if kept == i else kept))
    assert sorted(tuple(r) for r in QUERIES["op4_arc_to_warc"](spark, SF).collect()) == want


@pytest.mark.parametrize("version", [1, 2])
def test_warc_odd_pages(spark, version):
    pages = [(3, "http://a b\n", None, 1), (1, None, "", 1), (2, "u", "x\r\n\r\ny", 1), (None, "u", "x\r\n\r\ny", 1), (2, "u", "x\r\n\r\ny", 1), (9, "é", " \n", 1)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string, payload int").repartition(2)
    rows = warc.read(spark, warc.archive(pages, version=version)).collect()
    by = sorted((r.source_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.url) for r in rows)
    assert by == [
        (0, "revisit", 2, 6, "u"), (1, "response", None, 0, "-"), (2, "response", None, 6, "u"), (2, "revisit", 2, 6, "u"),
        (3, "revisit", 1, 0, "http://a%20b%0A"), (9, "response", None, 2, "é"),
    ]
    ids = {r.record_id: r for r in rows}
    assert all(ids[r.refers_to_record].payload_digest == r.payload_digest for r in rows if r.record_type == "revisit")
    assert {r.record_type for r in warc.read(spark, warc.archive(pages, min_bytes=7)).collect()} == {"response"}
    assert warc.read(spark, warc.archive(pages.limit(0))).count() == 0


def test_arc_parsing():
    said = b"1 0 org\n" + warc.ARC_FIELDS[1].encode() + b"\n"
    head = b"filedesc://x.arc 0.0.0.0 19970101000000 text/plain %d\n" % len(said) + said + b"\n"
    arc = head + b"http://a/ 1.2.3.4 19970102030405 text/html 5\nab\ncd\ndns:b 0.0.0.0 199701 text/dns 3\nxyz\n"
    got = list(warc.arc_records(gzip.compress(arc)))
    assert [(f["url"], f["ip-address"], f["archive-date"], b, e) for _, f, b, e in got] == [
        ("http://a/", "1.2.3.4", "19970102030405", b"ab\ncd", None), ("dns:b", "0.0.0.0", "199701", b"xyz", None),
    ]
    bad = list(warc.arc_records(arc + b"http://c/ 1.2.3.4 19970102030405 text/html 99\nshort"))
    assert len(bad) == 3 and "declared length" in bad[2][3]
    assert "version block" in next(warc.arc_records(b"http://a/ 1.2.3.4 1997 text/html 1\nx"))[3]


def packed_plainly(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(room, n) for n, (room, s, c) in enumerate(bins) if room >= size and room > 0 and (source is None or source not in s) and (cluster is None or cluster not in c)]
        if not fits:
            bins.append([capacity, set(), set()])
        n = min(fits)[1] if fits else len(bins) - 1
        out.append((n, capacity - bins[n][0]))
        bins[n][0] -= size
        bins[n][1].add(source)
        bins[n][2].add(cluster)
    return out


def test_bins_are_the_tightest():
    rng = random.Random(3)
    for trial in range(150):
        sources = [None, *range(200 if trial % 3 == 0 else 9)]
        items = [(rng.randint(0, 50), rng.choice(sources), rng.choice([None, rng.randint(0, 300)])) for _ in range(rng.randint(0, 250))]
        items.sort(key=lambda x: -x[0])
        bins = packing.Bins(50)
        assert [bins.add(*x) for x in items] == packed_plainly(items, 50)


def test_packing_whole(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA).unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    sized = packing.sized(docs).cache()
    rows = packing.pack(sized.withColumn("bin_id", F.lit("clash")), capacity=300, rows=60).toPandas()
    assert rows.groupby("bin_id").length.sum().max() <= 300
    assert rows.length.sum() == sized.agg(F.sum("length")).first()[0]
    assert rows[rows.piece == 0].shape[0] == docs.count()
    assert not rows[rows.cluster.notna()].duplicated(["bin_id", "cluster"]).any()
    ordered = rows.sort_values(["bin_id", "place", "length"])
    assert (ordered.place == ordered.groupby("bin_id").length.cumsum() - ordered.length).all()
    assert packing.pack(sized.limit(0)).count() == 0


def same_removals(spark, rows, size):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, _gone int, _key string").repartition(3)
    got = substrings.remove_repeats(docs, size=size).collect()
    assert sorted((LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == windows_removed(rows, size)


def test_substrings(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 30)))) for i in range(120)]
    rows += [(i, t) for i, t, *_ in odd_documents()] + [(None, "a b c d a b c d"), (5, "a b c d a b a a b c"), (7, "\t a\x85b  c\n d a  b c d")]
    same_removals(spark, rows, 5)
    monkeypatch.setattr(substrings, "HOT", 3)
    monkeypatch.setattr(substrings, "SHARES", 4)
    same_removals(spark, rows, 5)
    same_removals(spark, [], 5)


def test_substring_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in windows_removed(rows, 50)]
    assert sorted(tuple(r) for r in QUERIES["op9_substring_dedup"](spark, SF).collect()) == want


def test_sketch_never_underestimates(spark):
    h = np.random.default_rng(1).integers(0, 1 << 62, 3000).astype(np.uint64)
    counts = np.random.default_rng(2).integers(1, 6, 3000)

    def run(batches):
        for batch in batches:
            counter = sketch.Counter(16)
            for k in batch["id"].to_pylist():
                counter.add(np.repeat(h[k], counts[k]))
            yield from counter.batches()

    bits = sketch.busy(spark.range(0, 3000, 1, 3).mapInArrow(run, sketch.CELLS), 16, (2, 5))
    for limit, one in zip((2, 5), bits, strict=True):
        said = sketch.reaches(h, one, 16)
        assert said[counts >= limit].all() and said[counts < limit].mean() < 0.1


def jaccard_rows():
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(200)]
    rows = [(1000, None), (1001, ""), (1002, " \t"), (1003, "A b"), (1004, "a B"), (1005, "a b c d"), (1006, "one"), (1007, "ONE"), (1008, "é É")]
    for i in range(100):
        words = base[: rng.choice([60, 80, 100])]
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 5)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_jaccard_groups(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SALT_ROWS", max(10, block))
    rows = jaccard_rows()
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in rows], "doc_id long, text string, n int, keys string").repartition(3)
    assert sorted(tuple(r) for r in jaccard.near_groups(docs).collect()) == jaccard_groups(rows)


def test_jaccard_odd_rows(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    rows = jaccard.near_groups(docs).collect()
    assert len(rows) == docs.count() and all((r.n_shingles == 0) <= (r.doc_id == r.component_id) for r in rows)
    assert jaccard.near_groups(docs.limit(0)).count() == 0


def test_jaccard_bound_is_from_above():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    for _ in range(200):
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        x, y = (np.frombuffer(jaccard.bitmap(s), np.uint64) for s in (a, b))
        most = min(len(a) - np.bitwise_count(x & ~y).sum(), len(b) - np.bitwise_count(y & ~x).sum())
        assert most >= len(np.intersect1d(a, b)) == jaccard._common(a, b)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 103), (103, 101), (7, 7), (200, 201), (201, 200)]
    got = dict(tuple(r) for r in connected(spark.createDataFrame(chain, "u long, v long")).collect())
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 103: 100, 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lattice_points():
    x = np.random.default_rng(0).normal(size=(500, 8)) * 2
    p = lattice.nearest_point(x)
    whole, half = (p == np.rint(p)).all(axis=1), (p - 0.5 == np.rint(p - 0.5)).all(axis=1)
    assert (whole | half).all() and (p.sum(axis=1) % 2 == 0).all() and len(lattice.ROOTS) == 240
    own = ((x - p) ** 2).sum(axis=1)
    assert all((((x - p - r) ** 2).sum(axis=1) >= own - 1e-12).all() for r in lattice.ROOTS)


def vector_rows(n=200, dim=16):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, dim))
    return [(i, [float(x) for x in base[i % 20] + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.16])], int(rng.integers(0, 3))) for i in range(n)]


def odd_vectors(like):
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, []]
    return [*((900 + k, v, 1) for k, v in enumerate(odd)), (910, like[1], None), (911, [1.0, 2.0], 1), (912, [2.0, 4.0], 1), (None, like[1], like[2]), like]


@pytest.mark.parametrize("block", [1024, 7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    rows = vector_rows()
    x, ids, label = np.array([r[1] for r in rows]), np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    size = np.linalg.norm(x, axis=1)
    near = (x @ x.T / size[:, None] / size[None] >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    group = ids.copy()
    for _ in rows:
        group = np.minimum(group, np.where(near, group[None], 1 << 60).min(axis=1))
    want = {(int(i), int(n), int(g), bool(i == g)) for i, n, g in zip(ids, near.sum(axis=1), group, strict=True)}
    want |= {(k, 0, k, True) for k in (*range(900, 906), 910)} | {(911, 1, 911, True), (912, 1, 911, False), (None, 0, None, True)}
    table = spark.createDataFrame([(*r, 1) for r in rows + odd_vectors(rows[0])], "vec_id long, embedding array<double>, label int, id int").repartition(3)
    got = [tuple(r) for r in lattice.near_copies(table).collect()]
    assert len(got) == table.count() and set(got) == want and near.sum() > 100
    assert lattice.near_copies(table.limit(0)).count() == 0


def test_nearest_neighbours(spark):
    rows = vector_rows(400)
    odd = [r for r in odd_vectors(rows[0]) if r[0] != 910]  # this one has a usable vector
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(3)
    got = neighbours.nearest(table, F.pmod("id", F.lit(10)) == 0, degree=8, breadth=32).collect()
    x = np.array([r[1] for r in rows])
    hits = 0
    for q in range(0, 400, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = sorted((r["rank"], r.id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[m[1]] - m[2]) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.95 * 400
    assert 900 not in {r.query_id for r in got}
    assert neighbours.nearest(table.limit(0), F.col("id") == 0).count() == 0
    few = neighbours.nearest(table.where("vec_id < 3"), F.col("id") == 0).collect()
    assert [(r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


def test_a_graph_of_many_blocks_with_copies(spark):
    """32 blocks to start from; a query measures a part of the table; a third of the rows are one vector."""
    x = np.random.default_rng(5).normal(size=(1200, 16))
    x[::3] = x[0]
    table = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, vertex string").repartition(3)
    visits: list[int] = []
    got = neighbours.nearest(table, F.pmod("id", F.lit(25)) == 0, degree=12, breadth=16, block=32, visits=visits).collect()
    hits = 0
    for q in range(0, 1200, 25):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = sorted(range(1200), key=lambda i: (d[i], i))[:10]
        mine = [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        if q % 3 == 0:
            assert mine == want and all(r.score == 0 for r in got if r.query_id == q)
        assert len(mine) == 10 and mine == sorted(mine, key=lambda i: (round(d[i], 9), i))
        hits += len(set(mine) & set(want))
    assert hits >= 0.95 * 480
    assert sum(visits) < 0.5 * 800 * 33  # 801 vertices; 32 queries that are no copies and one vertex of all copies


def test_all_ends_of_a_vector_meet(spark):
    """60 ends around vector 0, the star's centre, and 400 around vector 100: none is left out."""
    for centre, leaves in ((0, 60), (100, 400)):
        x = np.random.default_rng(centre).normal(size=(leaves, 8))
        points = [(1000 + i, v.tolist()) for i, v in enumerate(x)]
        vectors = spark.createDataFrame([(centre, [9.0] * 8), *points], "id long, vector array<double>")
        graph = spark.createDataFrame([(i, centre, 50.0, 0) for i, _ in points], "u long, v long, d double, born int")
        got = {}
        for r in neighbours._round(graph, vectors, 24, 1).collect():
            got.setdefault(r.u, {})[r.v] = r.d
        assert set(got) - {centre} == {i for i, _ in points}
        if leaves == 60:  # one meeting: each finds its nearest
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
            np.fill_diagonal(d, np.inf)
            assert all(min(got[1000 + i], key=got[1000 + i].get) == 1000 + int(d[i].argmin()) for i in range(leaves))


def test_neighbour_query_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = QUERIES["op3_nn_descent"](spark, SF).collect()
    asked = ids[ids % 100 == 0]
    hits = 0
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 10 * len(asked) and hits >= 0.9 * 10 * len(asked)
