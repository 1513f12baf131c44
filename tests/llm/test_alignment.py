"""Token alignment against the libraries and plain loops."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from helpers import SCHEMA, odd_documents
from pyspark.sql import functions as F

from tidemark.llm import alignment
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute_force(rows):
    """(id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of (id, text) rows."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in printable]
    letter = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(others)}

    def spans(parts):
        out, at = [], 0
        for i, raw in parts:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out, b"".join(raw for _, raw in parts)

    told, count = [], Counter()
    for i, text in rows:
        if not text:
            told.append((i, [], [], [], []))
            continue
        ea = a.encode(" " + text, add_special_tokens=False)
        ta, ja = spans([(x, bytes(letter[c] for c in t)) for x, t in zip(ea.ids, ea.tokens, strict=True)])
        ib = b.encode(text)
        tb, jb = spans([(x, bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode()) for x in ib])
        if ja != (" " + text).encode() or jb != ja:
            told.append((i, [], [], [], []))
            continue
        links, low = [], 0
        for x, s, e in ta:
            while tb[low][2] <= s:
                low += 1
            k = low
            while k < len(tb) and tb[k][1] < e:
                links.append((x, tb[k][0]))
                k += 1
        both = {e for *_, e in ta} & {e for *_, e in tb}
        groups, start = [], 0
        for end in sorted(both):
            groups.append(tuple(",".join(str(x) for x, s, e in t if start <= s and e <= end) for t in (ta, tb)) if len(text) < 3000 else None)
            start = end
        told.append((i, ta, tb, links, groups))
        count.update(set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, ta, tb, links, groups in told:
        text = ";".join("|".join(g) for g in groups) if None not in groups else None
        out.append((i, len(ta), len(tb), len(groups), len(links), text, sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links)))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:5], r[6:])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x[:5] == y[:5] and x[6:] == y[6:] and (y[5] is None or x[5] == y[5])


TRICKY = [
    "a <s> b</s> <unk> <0x41>\x00　x  y", "<|endoftext|> <|endoftext|>x", " lead", "trail  ", "don't I'll  WE", "tab\tnew\n\n line \n x",
    "naïve café ﬁ é", "日本語 テキスト。", "🙂🙃 x🙂", "▁", "a▁b", " ▁", "1234567 89,01", "  ", "\n", "the the the the", "x" * 400,
]


@pytest.mark.parametrize("limit", [None, 0])
def test_alignment_equals_brute_force(spark, limit):
    rows = [(r[0], r[1]) for r in odd_documents()] + list(enumerate(TRICKY))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, pairs string").repartition(3)
    got = alignment.aligned_counts(docs, BPE, PIECES, limit=limit).select(COLUMNS)
    same(got.collect(), brute_force(rows))


def test_alignment_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(*r[:5], None if r[5] is None else hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "", *r[6:]) for r in brute_force([tuple(r) for r in rows])]
    same(QUERIES["op11_token_alignment"](spark, SF).select(*[F.col("groups_sha256") if c == "groups" else c for c in COLUMNS]).collect(), want)


def test_alignment_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert alignment.aligned_counts(docs, BPE, PIECES).select(COLUMNS).collect() == []
