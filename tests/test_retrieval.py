"""Retrieval and ranking against brute force on small random inputs."""

import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions.fixed import DEFAULTS
from tidemark.operators import ranking, search, vector_index

WORDS = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma".split()


def chunk_rows(n=60, seed=1):
    r = random.Random(seed)
    return [(f"c{i}", f"d{i % 9}", i // 9, " ".join(r.choice(WORDS) for _ in range(r.randint(0, 14))), r.random() > 0.2) for i in range(n)]


def chunks_df(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, ord int, text string, allowed boolean")
    return df.select(
        F.lit("kb").alias("kb_id"), "chunk_id", "doc_id", "ord", F.lit("active").alias("status"), F.lit("").alias("title"),
        F.lit("").alias("section_path"), F.lit("").alias("context"), F.array().cast("array<string>").alias("aliases"),
        F.array().cast("array<string>").alias("flags"), "text", "allowed", F.lit(True).alias("escalated"),
    )


def subqueries_df(spark, questions):
    df = spark.createDataFrame(questions, "query_id int, subq int, question string")
    none = F.array().cast("array<string>")
    return df.select(F.lit("kb").alias("kb_id"), "query_id", "subq", "question", none.alias("variants"), none.alias("keywords"), none.alias("identifiers"))


def brute_bm25(rows, terms, k):
    visible = [r for r in rows if r[4]]
    avg = sum(len(r[3].split()) for r in rows) / len(rows)
    n = len(visible)
    out = []
    for cid, _, _, body, _ in visible:
        toks = body.split()
        score = 0.0
        for t in terms:
            tf = toks.count(t)
            df = sum(t in r[3].split() for r in visible)
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avg))
        if score > 0:
            out.append((cid, score))
    return sorted(out, key=lambda x: (-round(x[1], 6), x[0]))[:k]


@pytest.mark.parametrize("partitions", [1, 5, 16])
def test_bm25_equals_brute_force_on_any_partitioning(spark, partitions):
    rows = chunk_rows()
    chunks = chunks_df(spark, rows).repartition(partitions)
    asked = subqueries_df(spark, [(1, 0, "alpha beta"), (1, 1, "sigma"), (2, 0, "kappa unknown")])
    hits = search.bm25_search(search.query_terms(asked), search.postings(chunks), search.chunk_lengths(chunks), k=7).collect()
    for qid, subq, terms in [(1, 0, ["alpha", "beta"]), (1, 1, ["sigma"]), (2, 0, ["kappa"])]:
        got = [(h["chunk_id"], h["score"]) for h in sorted(hits, key=lambda h: h["rank"]) if (h["query_id"], h["subq"]) == (qid, subq)]
        want = brute_bm25(rows, terms, 7)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_alias_expansion_adds_weaker_terms(spark):
    aliases = spark.createDataFrame([("single sign", ["sso login", "alpha"]), ("absent", ["zeta"])], "phrase string, expansions array<string>")
    asked = subqueries_df(spark, [(1, 0, "Single sign alpha")])
    got = {r["term"]: r["weight"] for r in search.query_terms(asked, aliases).collect()}
    assert got == {"single": 1.0, "sign": 1.0, "alpha": 1.0, "sso": 0.7, "login": 0.7}


def test_exact_matches_whole_words_and_punctuation(spark):
    rows = [("c1", "d", 0, "see v1.2.3 and ERR-42.", True), ("c2", "d", 1, "xv1.2 err-42", True), ("c3", "d", 2, "a ?? b", True)]
    pats = spark.createDataFrame([("kb", 1, 0, ["v1.2", "err-42"]), ("kb", 2, 0, ["??"])], "kb_id string, query_id int, subq int, patterns array<string>")
    hits = {(r["query_id"], r["chunk_id"]): r["score"] for r in search.exact_search(pats, chunks_df(spark, rows)).collect()}
    assert hits == {(1, "c1"): 1.0, (1, "c2"): 0.5, (2, "c3"): 1.0}
    both = search.exact_search(pats, chunks_df(spark, rows), require_all=True).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in both} == {(1, "c1"), (2, "c3")}


def test_all_patterns_wanted_looks_only_into_chunks_that_may_have_all(spark, monkeypatch):
    """The costly look into a text is for chunks with a word of every pattern; repeated chunks count as often as they are there."""
    rows = [("c1", "d", 0, "see v1.2 and err-42", True), ("c2", "d", 1, "err-42 only", True), ("c3", "d", 2, "v1 err", True), ("c4", "d", 3, "err-42 x", True)]
    chunks = chunks_df(spark, rows)
    twice = chunks.where("chunk_id = 'c4'")
    pats = spark.createDataFrame([("kb", 1, 0, ["v1.2", "err-42"]), (None, 2, 0, ["err-42"])], "kb_id string, query_id int, subq int, patterns array<string>")
    seen = lambda df: sorted((r["query_id"], r["chunk_id"], r["rank"], r["score"]) for r in df.collect())
    look = search.text.whole_word

    def watched(hay, pattern):
        return F.when(hay.contains("only"), F.raise_error(F.lit("looked into a chunk without v1.2")).cast("boolean")).otherwise(look(hay, pattern))

    monkeypatch.setattr(search.text, "whole_word", watched)
    assert seen(search.exact_search(pats, chunks, require_all=True)) == [(1, "c1", 0, 1.0)]
    monkeypatch.undo()
    # of a chunk that is there twice, each text is met by each place of a pattern
    four = spark.createDataFrame([("kb", 1, 0, ["err-42", "zz", "yy", "ww"])], "kb_id string, query_id int, subq int, patterns array<string>")
    assert seen(search.exact_search(four, chunks.unionByName(twice), require_all=True)) == [(1, "c4", 0, 1.0)]


@pytest.mark.parametrize("mask", ["allowed", "escalated"])
def test_bm25_with_stored_frequencies_is_the_same(spark, mask):
    chunks = chunks_df(spark, chunk_rows() + [("c3", "d0", 99, "alpha beta", True), ("c99", "d0", 98, "omega", False)])
    index, lengths = search.postings(chunks), search.chunk_lengths(chunks)
    terms = search.query_terms(subqueries_df(spark, [(1, 0, "alpha beta gamma"), (2, 0, "omega"), (3, 0, "unknown")]))
    found = [search.bm25_search(terms, index, lengths, mask, 7, f).collect() for f in (None, search.term_frequencies(index))]
    assert found[0] and sorted(found[0]) == sorted(found[1])


@pytest.mark.parametrize("block", [4, 1000])
def test_dense_blocks_equal_numpy(spark, block):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(23, 8)).astype(np.float32)
    vec = spark.createDataFrame([(i, "m" if i % 5 else "old", v[i].tolist()) for i in range(23)], "chunk_id int, model string, vector array<float>")
    q = spark.createDataFrame([(i, 0, j, "m", v[i + j].tolist()) for i in range(4) for j in range(2)], "query_id int, subq int, variant int, model string, vector array<float>")
    hits = vector_index.dense_search(q, vec, k=5, block=block).collect()
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    usable = [i for i in range(23) if i % 5]
    for i in range(4):
        best = {c: max(u[i] @ u[c], u[i + 1] @ u[c]) for c in usable}
        want = sorted(best, key=lambda c: (-round(best[c], 6), c))[:5]
        assert [h["chunk_id"] for h in sorted(hits, key=lambda h: h["rank"]) if h["query_id"] == i] == want


def test_access_masks(spark):
    chunks = chunks_df(spark, [(f"c{i}", f"d{i}", 0, "x", True) for i in range(5)]).drop("allowed", "escalated")
    docs = spark.createDataFrame(
        [("kb", "d0", "active", "warm", []), ("kb", "d1", "active", "cold", []), ("kb", "d2", "quarantined", "warm", []),
         ("kb", "d3", "active", "warm", ["hr"]), ("kb", "d4", "superseded", "warm", [])],
        "kb_id string, doc_id string, status string, tier string, acl array<string>",
    )
    def masks(principals):
        got = search.access_masks(chunks, docs, principals).collect()
        return {r["doc_id"] for r in got if r["allowed"]}, {r["doc_id"] for r in got if r["escalated"]}

    assert masks([]) == ({"d0"}, {"d0", "d1", "d2"})
    assert masks(["hr"]) == ({"d0", "d3"}, {"d0", "d1", "d2", "d3"})


def test_second_list_goes_on_where_the_first_ends(spark):
    kind = "query_id int, subq int, retriever string, chunk_id string, rank int, score double"
    a = spark.createDataFrame([(1, 0, "exact", "x", 0, 1.0)], kind)
    b = spark.createDataFrame([(1, 0, "exact", "x", 0, 1.0), (1, 0, "exact", "y", 1, 1.0)], kind)
    fused = {r["chunk_id"]: r["fused"] for r in ranking.fuse(search.append_list(a, b)).collect()}
    assert fused["x"] == pytest.approx(0.8 / 61 + 0.8 / 62) and fused["y"] == pytest.approx(0.8 / 63)


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, doc_id string, subqs array<int>, final double, text string")


def test_near_copies_merge_into_the_better_one(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "a", "d", [0], 0.9, long), (1, "b", "d", [1], 0.8, long + " extra"), (1, "c", "d", [0], 0.7, "other words here entirely now")]
    got = {r["chunk_id"]: r for r in ranking.drop_near_copies(candidates(spark, rows)).collect()}
    assert got["b"]["duplicate_of"] == "a" and got["a"]["subqs"] == [0, 1] and got["c"]["duplicate_of"] is None


def test_selection_guarantees_then_cuts_by_score(spark):
    rows = [(1, f"c{i}", "d", [i % 5], 1 - i / 100, "t") for i in range(30)] + [(1, "z", "d", [4], 0.01, "t")]
    asked = subqueries_df(spark, [(1, i, "q") for i in range(5)])
    two = ranking.select_final(candidates(spark, rows), asked, replace(DEFAULTS, final_k=2)).collect()
    assert {r["chunk_id"] for r in two} == {"c0", "c1"}
    many = ranking.select_final(candidates(spark, [(1, "a", "d", [0], 0.9, ""), (1, "b", "d", [0], 0.8, ""), (1, "e", "d", [0], 0.7, ""), (1, "x", "d", [1], 0.1, "")]),
                                subqueries_df(spark, [(1, 0, "q"), (1, 1, "q")]), replace(DEFAULTS, final_k=3)).collect()
    assert {r["chunk_id"] for r in many} == {"a", "b", "x"}


def test_rules_apply_in_order_and_are_logged(spark):
    cand = spark.createDataFrame([(1, "a", "d1", ["injection_suspect"], 1.0, 0.8), (1, "b", "d2", [], 1.0, 0.8)],
                                 "query_id int, chunk_id string, doc_id string, flags array<string>, final double, freshness_need double")
    docs = spark.createDataFrame([("d1", "quarantined", 0.5), ("d2", "active", 1.0)], "doc_id string, status string, freshness double")
    boosts = spark.createDataFrame([("d2", 2.0)], "doc_id string, factor double")
    got = {r["chunk_id"]: r for r in ranking.apply_rules(cand, docs, boosts).collect()}
    assert got["a"]["final"] == pytest.approx(0.3 * 0.5 * 1.05) and got["b"]["final"] == pytest.approx(2.0 * 1.1)
    assert [x["rule"] for x in got["a"]["rules"]] == ["injection_demote", "quarantine_demote", "freshness"]


def test_bm25_in_blocks_equals_the_sum_of_all_pairs(spark, monkeypatch):
    """No row per question and chunk leaves a block, only its best; ties, repeated rows and masks as in the plain sum."""
    texts = [f"alpha {'beta ' * (n % 3)}word{n % 4} de la gamma{n % 2}" for n in range(40)] + ["alpha beta"] * 6
    data = [("a" if n % 7 else "b", f"c{n}", t, n % 5 > 0, True) for n, t in enumerate(texts)]
    data += data[3:5]  # rows that come twice count as one of twice the terms
    chunks = spark.createDataFrame(data, "kb_id string, chunk_id string, text string, allowed boolean, escalated boolean")
    asked = [(kb, q, s, t, w) for q in range(5) for s in (0, 1) for kb, t, w in
             ((("a", "b")[q % 2], "alpha", 1.0), ("a", f"word{q % 4}", 0.7), (("a", "b")[q % 2], "beta", 1.0 + s))]
    terms = spark.createDataFrame(asked, "kb_id string, query_id int, subq int, term string, weight double")
    words = search.tokenised(chunks).cache()
    posted, lengths = search.postings(words).collect(), words.select("kb_id", "allowed", "doc_len").collect()
    want = Counter()
    for kb, q, s, t, w in asked:
        mine = [p for p in posted if p["kb_id"] == kb and p["term"] == t and p["allowed"]]
        n = sum(r["allowed"] for r in lengths if r["kb_id"] == kb)
        sizes = [r["doc_len"] for r in lengths if r["kb_id"] == kb]
        idf = math.log(1 + (n - len(mine) + 0.5) / (len(mine) + 0.5))
        for p in mine:
            part = 1 - fixed.BM25_B + fixed.BM25_B * p["doc_len"] / (sum(sizes) / len(sizes))
            want[q, s, p["chunk_id"]] += w * idf * p["tf"] * (fixed.BM25_K1 + 1) / (p["tf"] + fixed.BM25_K1 * part)
    best = set()
    for q, s in {k[:2] for k in want}:
        ranked = sorted((-round(v, 6), k[2]) for k, v in want.items() if k[:2] == (q, s))
        best |= {(q, s, c, rank, -v) for rank, (v, c) in enumerate(ranked[:4])}
    monkeypatch.setattr(search, "BLOCK_CHUNKS", 9)
    monkeypatch.setattr(search, "BLOCK_QUESTIONS", 3)
    for index in (search.postings(words), search.chunk_terms(words)):
        hits = search.bm25_search(terms, index, words.select("kb_id", "allowed", "doc_len"), "allowed", 4)
        assert {(h["query_id"], h["subq"], h["chunk_id"], h["rank"], round(h["score"], 6)) for h in hits.collect()} == best


@pytest.mark.parametrize("mask", ["allowed", "escalated"])
def test_bm25_over_stored_blocks_is_the_plain_sum(spark, monkeypatch, mask):
    """Blocks hold all chunks, shown by a mask or not, and the first blocks' k-th score loses none of the best of the others."""
    monkeypatch.setattr(search, "BLOCK_CHUNKS", 5)
    rows = [(c, d, o, body.replace("alpha", "alphas"), shown) for c, d, o, body, shown in chunk_rows(90)]
    rows += [rows[3], rows[7], ("c11", "d", 99, "beta gamma gamma", False)]  # some come twice, as they are or with other words
    words = search.tokenised(chunks_df(spark, rows))
    asked = subqueries_df(spark, [(1, 0, "alpha beta"), (1, 1, "sigma theta kappa lambda"), (2, 0, "kappa unknown")])
    terms, index = search.query_terms(asked), search.posting_blocks(words, len(rows)).cache()
    assert index.select("block").distinct().count() > 4
    hits = search.bm25_search(terms, index, search.block_lengths(index), mask, 7).collect()
    posted = search.postings(words).collect()
    lengths = words.collect()
    n, avg = sum(r[mask] for r in lengths), sum(r["doc_len"] for r in lengths) / len(lengths)
    df = Counter(p["term"] for p in posted if p[mask])
    want = Counter()
    for t in terms.collect():
        for p in (p for p in posted if p["term"] == t["term"] and p[mask]):
            part = 1 - fixed.BM25_B + fixed.BM25_B * p["doc_len"] / avg
            idf = math.log(1 + (n - df[t["term"]] + 0.5) / (df[t["term"]] + 0.5))
            want[t["query_id"], t["subq"], p["chunk_id"]] += t["weight"] * idf * p["tf"] * (fixed.BM25_K1 + 1) / (p["tf"] + fixed.BM25_K1 * part)
    best = set()
    for q, s in {key[:2] for key in want}:
        ranked = sorted((-round(v, 6), key[2]) for key, v in want.items() if key[:2] == (q, s))
        best |= {(q, s, c, rank, -v) for rank, (v, c) in enumerate(ranked[:7])}
    assert {(h["query_id"], h["subq"], h["chunk_id"], h["rank"], round(h["score"], 6)) for h in hits} == best


def test_words_are_shuffled_once_for_the_index(spark):
    plan = search.posting_blocks(search.tokenised(chunks_df(spark, chunk_rows())), 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_postings_move_a_chunk_as_one_value(spark):
    """A row per term and chunk was shuffled; now a chunk's words are, and are counted where they arrive."""
    rows = chunk_rows(30)
    rows += [rows[3], rows[3], ("c11", "d", 99, "beta gamma gamma", False), ("bare", "d", 1, "", True)]
    chunks = chunks_df(spark, rows).withColumn("kb_id", F.lit("all"))
    plan = search.postings(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(chunk_id" in plan
    words = search.tokenised(chunks).collect()
    want = Counter((w["chunk_id"], w["doc_len"], w["allowed"], search.text.stem_word(x)) for w in words for x in w["words"])
    got = search.postings(chunks).collect()
    assert {(p["chunk_id"], p["doc_len"], p["allowed"], p["term"]): p["tf"] for p in got} == want and len(got) == len(want)


def test_a_block_lets_out_only_what_reaches_the_floor():
    import pyarrow as pa

    r = random.Random(4)
    texts = [[r.choice(WORDS[: 2 + n % 9]) for _ in range(12)] for n in range(300)]
    frame = pa.table({"kb_id": ["kb"] * 300, "chunk_id": [f"c{n:03}" for n in range(300)], "doc_len": pa.array([12] * 300, pa.int32()), "terms": texts, "block": [0] * 300})
    parts = search._posted(frame, [], None)
    ask = lambda floor: pa.table({
        "query_id": [1], "subq": [0], "kb_id": [["kb"] * 4], "term": [[WORDS[0], WORDS[1], WORDS[8], WORDS[9]]], "w": [[0.1, 0.2, 2.0, 3.0]], "avg_len": [[12.0] * 4],
        "floor": pa.array([floor], pa.float64()),
    })
    every = search._best_of_block(parts, ask(None), 300).to_pylist()
    assert len(every) > 250
    floor = sorted(x["score"] for x in every)[-20]
    kept = search._best_of_block(parts, ask(floor), 300).to_pylist()
    assert kept == [x for x in every if x["score"] >= floor - 2e-6] and len(kept) < 60


def test_a_word_is_stemmed_alike_in_python(spark):
    said = [a + b for a in ("go", "walk", "straße", "\U0001d4b3xyz", "i") for b in ("", *fixed.STEM_SUFFIXES, "er")]
    got = spark.createDataFrame([(w,) for w in said], "w string").select("w", search.text.stem(F.col("w")).alias("s")).collect()
    assert {x["w"]: x["s"] for x in got} == {w: search.text.stem_word(w) for w in said}


def test_stages_after_the_search_read_only_the_chunks_it_found(spark, tmp_path):
    """Texts of all chunks were joined anew, and shuffled, for every use of the candidates; now those found are looked up once."""
    from tidemark.plans import queries_answers, queries_retrieval, tables

    docs = [(i, f"title {i}\nalpha beta {i}\n\ngamma {i}", "en" if i % 3 else None, "web", 30) for i in range(12)] + [(3, "title 3\nagain", "en", "web", 13), (99, None, "en", "web", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, "alpha beta. gamma 3.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    t = tables.Tables(spark, str(tmp_path))
    named = [(7, 0, "3-1"), (7, 1, "3-1"), (7, 0, "5-3"), (7, 1, "0-0"), (7, 0, "77-1")]
    hits = spark.createDataFrame([(*h, "bm25", n, 3.0 - n) for n, h in enumerate(named)], "query_id long, subq int, chunk_id string, retriever string, rank int, score double")
    t.stored("hits", lambda: hits)

    key = lambda rows: sorted(map(str, rows))
    every = t.masked_chunks().where(F.col("chunk_id").isin([h[2] for h in named]))
    assert key(t.masked_chunks(hits=hits).select(every.columns).collect()) == key(every.collect()) != []
    assert every.count() == 10  # the document that is there twice meets its labels and its own copies
    assert _reads_texts(t.masked_chunks())
    stages = queries_retrieval.Cascade(t).ruled(), queries_answers.Work(t).candidates
    for stage, columns in zip(stages, (["query_id", "chunk_id"], ["query_id", "chunk_id", "text"]), strict=True):
        assert key(stage.select(columns).distinct().collect()) != []
        assert not _reads_texts(stage)


def _reads_texts(df):
    """Whether a plan scans the documents' texts, rather than those of stored chunks."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "doc_id#" in line and "text#" in line]
    return any("chunk_id#" not in line for line in scans)


def test_a_base_keeps_blocks_and_exact_search_takes_stored_words(spark):
    """Heal rounds built blocks from all postings, and split all texts into words, for every search."""
    from tidemark.plans.questions import Base

    chunks = chunks_df(spark, [*chunk_rows(20), ("c50", "d1", 50, "alpha, kappa-7 beta", True), ("c51", "d1", 51, "kappa 7", True)])
    base = Base.build(chunks, chunks.select("kb_id", "doc_id"))
    assert "block" in base.index.columns and base.frequencies is None
    assert base.lengths.count() == 22
    patterns = spark.createDataFrame([("kb", 1, 0, ["kappa-7", "alpha"]), ("kb", 2, 0, ["7"])], "kb_id string, query_id int, subq int, patterns array<string>")
    key = ["query_id", "chunk_id", "rank", "score"]
    stored = chunks.withColumn("anchors", search.anchors(search.exact_hay()))
    for every in (False, True):
        plain, quick = (sorted(search.exact_search(patterns, c, require_all=every).select(key).collect()) for c in (chunks, stored))
        assert plain == quick and (1, "c50") in {(r["query_id"], r["chunk_id"]) for r in plain}
    unread = chunks.withColumn("anchors", F.array().cast("array<string>"))
    assert search.exact_search(patterns, unread).count() == 0
