"""The pipeline's stages one by one against plain Python, and as a whole."""

import random

import corpus_pipeline
from helpers import SCHEMA, jaccard_groups, odd_documents, windows_removed

from tidemark.llm import languages, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def small_corpus():
    rng = random.Random(5)
    said = {"en": "the and ing that tion with for re er on", "fr": "le la les des ment que eau oir un et", "de": "der die und sch ein ung keit ich zu auf"}
    rows, passage = [], " ".join(f"shared{k}" for k in range(60))
    for i in range(90):
        lang = rng.choice(list(said))
        words = ["".join(rng.choices(said[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(60, 150))]
        rows.append([i, " ".join(words), lang, f"s{i % 4}", 0])
    for i in range(90, 100):
        rows.append([i, rows[i - 90][1], rows[i - 90][2], "s0", 0])  # copies
    for i in range(100, 105):
        rows.append([i, rows[i - 60][1] + " " + passage + " end", rows[i - 60][2], "s1", 0])
    rows.append([105, 'the word and token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" with the rest of that', "en", "s2", 0])
    rows += [[106, "1234 5678 ...", None, "s3", 13], [107, None, "en", "s3", None]]
    return [(i, t, lang, s, len(t) if t else n) for i, t, lang, s, n in rows]


def test_stages(spark):
    rows = small_corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    by_name = dict(corpus_pipeline.STAGES)
    assert list(by_name) == ["language_id", "ngram_jaccard", "substring_dedup", "secret_scan", "best_fit_packing"]

    told = by_name["language_id"](spark, docs, "")
    kept = sorted(tuple(r) for r in told.collect())
    assert told.columns == COLUMNS and {r[0] for r in kept} == set(range(106))
    assert [(r[0], r[1], *r[3:]) for r in kept] == [(r[0], r[1], *r[3:]) for r in sorted(rows[:106])]

    docs = spark.createDataFrame(kept, SCHEMA)
    left = sorted(tuple(r) for r in by_name["ngram_jaccard"](spark, docs, "").collect())
    leaders = {i for i, _, group in jaccard_groups([r[:2] for r in kept]) if i == group}
    assert left == [r for r in kept if r[0] in leaders] and len(left) < 100

    docs = spark.createDataFrame(left, SCHEMA)
    cut = sorted(tuple(r) for r in by_name["substring_dedup"](spark, docs, "").collect())
    want = {i: (t if k else None) for i, n, k, t in windows_removed([r[:2] for r in left], 50) if n > k or not k}
    assert {r[0] for r in cut} == set(want)
    before = {r[0]: r[1] for r in left}
    assert all(r[1] == (before[r[0]] if want[r[0]] is None else want[r[0]]) and r[4] == len(r[1]) for r in cut)
    assert sum("shared0 " in r[1] for r in cut) == 1

    docs = spark.createDataFrame(cut, SCHEMA)
    masked = sorted(tuple(r) for r in by_name["secret_scan"](spark, docs, "").collect())
    assert [r[0] for r in masked] == [r[0] for r in cut]
    changed = [(a, b) for a, b in zip(cut, masked, strict=True) if a != b]
    assert [a[0] for a, _ in changed] == [105] and "[SECRET]" in changed[0][1][1] and not any(secrets.base_spans(r[1]) for r in masked)

    packed = by_name["best_fit_packing"](spark, spark.createDataFrame(masked, SCHEMA), "").collect()
    assert {r.doc_id for r in packed} == {r[0] for r in masked}
    assert sum(r.length for r in packed) == sum(len(r[1].split()) for r in masked)


def test_run_whole(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({r.doc_id for r in rows}) > 50


def test_odd_rows_pass(spark):
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == COLUMNS
        out.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
    assert languages.train(docs.limit(0)).families == {}


def test_rows_that_share_an_id(spark):
    """A text that copies nothing stays, whatever else has its id; equal rows count once."""
    word = lambda x: " ".join(f"{x}{k}" for k in range(60))
    a, b, d, e = map(word, "abde")
    rows = [(3, a), (5, a), (5, b), (7, d), (7, d), (8, e), (8, e + " end"), (9, None), (9, None), (9, ""), (None, "x y"), (None, a), (None, "x y")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    eight = [r for r in got if r[0] == 8]
    assert len(eight) == 1 and left.columns == COLUMNS
    assert [r for r in got if r[0] != 8] == sorted([(3, a), (5, b), (7, d), (9, None), (9, ""), (None, "x y")], key=repr)
