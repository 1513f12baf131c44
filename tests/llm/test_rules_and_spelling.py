"""The rule ledger and spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from helpers import SCHEMA, WORD, odd_documents
from pyspark.sql import functions as F

from tidemark.llm import rules, spelling
from tidemark.llm.queries import QUERIES
from tidemark.session import cut_lineage

SF = "/root/testdata/sf0.001"


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered), len(re.findall("[A-Z]", text)))


RULE_TEXTS = ["a b c a b c", "x\nx\n\nx \n", "\nq", "q\n", "A|B <x> $5 é&é", "one two three " * 40, "w " * 49, "w" * 40 + " " + "\n".join(["same"] * 9), "\n \n\t\n"]
_ROW = ["doc_id", *rules.MEASURES]


def test_ledger_equals_plain_python(spark):
    rows = [(i, t) for i, t, *_ in odd_documents()] + list(enumerate(RULE_TEXTS))
    random.seed(3)
    rows += [(100 + i, "".join(random.choices(["aa ", "bb ", "Cé\n", "|", "\r"], k=random.randint(0, 120)))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, failed int").repartition(5)
    got = rules.judged(rules.ledger(docs)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r[c] for c in _ROW) for r in got), key=key) == sorted(((i, *measures(t)) for i, t in rows), key=key)
    for r in got:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base == bool(r.failed & 3) and r.kept == (r.failed == 0)


def test_policies_and_ablations(spark):
    entries = rules.ledger(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    rows = entries.collect()
    two = rules.Policy("two", ("few_words",), ("symbols", "capitals", "repeated_lines"), 1)

    def dropped(policy, failed):
        hard, soft = policy.masks()
        return bool(failed & hard) or (failed & soft).bit_count() > policy.most

    assert {r.doc_id for r in rules.judged(entries, two).where("kept").collect()} == {r.doc_id for r in rows if not dropped(two, r.failed) and not r.failed & 3}
    got = {(r.version, r.rule): tuple(r)[2:] for r in rules.ablations(entries, (*rules.POLICIES, two)).collect()}
    for policy in (*rules.POLICIES, two):
        out = [r for r in rows if dropped(policy, r.failed)]
        for name, bit in rules.BIT.items():
            back = [r for r in out if not dropped(policy, r.failed & ~bit)]
            want = (len(rows), sum(bool(r.failed & bit) for r in rows), len(out), len(back), sum(r.n_words for r in back))
            assert got[policy.version, name] == want
    empty = rules.ledger(spark.createDataFrame([], SCHEMA))
    assert rules.judged(empty).collect() == [] and rules.ablations(empty).collect() == []


def vocabulary(rows, one_in):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if one_in and h % one_in == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(n, ratio=10):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out)


def test_spelling_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_spelling_variants"](spark, SF).collect()
    want = grouped(vocabulary(rows, 31))
    assert sorted(map(tuple, got)) == want and any(r[1] for r in want)


def test_word_counts_of_odd_rows(spark):
    rows = [(i, t) for i, t, *_ in odd_documents()] * 2
    rows += [(i, "Étéétéé ÉTÉÉTÉÉ AAAAAAAb aaaaaaab ×÷×÷×÷× αβγδεζηθ x-" + "Q" * 3000) for i in (1, 1, 2, 3, None, 62)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int").repartition(3)
    for one_in in (None, 2, 31):
        got = {r.word: r.n for r in spelling.word_counts(docs, drop_one_in=one_in).collect()}
        assert got == vocabulary(rows, one_in)


@pytest.mark.parametrize("pass_bytes", [spelling.PASS_BYTES, 64 * spelling.CHUNK])
def test_variants_of_made_words(spark, pass_bytes):
    random.seed(5)
    words = {"".join(random.choices("abé", k=random.randint(7, 9))): random.choice([2, 3, 30, 400, 5000, 100000]) for _ in range(900)}
    words |= {"x" * k: 10 ** (k % 5 + 1) for k in range(40, 60)} | {"y" * 400: 5, "y" * 399 + "z": 50, "y" * 401: 500}
    table = cut_lineage(spark.createDataFrame(list(words.items()), "word string, n long").withColumn("form", F.lit("clash")))
    assert sorted(map(tuple, spelling.variants(table, pass_bytes=pass_bytes).collect())) == grouped(words)


def test_filters_in_many_passes_find_the_same(spark):
    random.seed(6)
    words = {"".join(random.choices("abcd", k=random.randint(7, 8))) for _ in range(70000)}
    table = cut_lineage(spark.createDataFrame([(w, 2) for w in words], "word string, n long"))
    one = spelling.near_words(table)
    many = spelling.near_words(table, 64 * spelling.CHUNK)
    count = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("word", "other"))).first()
    assert count(one) == count(many)
    w = sorted(words)[0]
    assert one.where(F.col("word") == w).count() == sum(one_apart(w, v) for v in words)


def test_an_empty_vocabulary(spark):
    table = cut_lineage(spark.createDataFrame([], "word string, n long"))
    assert spelling.variants(table).collect() == []
