"""Parsers and the chunker on hand-written sources."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import packing
from tidemark.functions.fixed import ChunkStrategy
from tidemark.functions.html import html_blocks
from tidemark.operators import parsing

HTML = """<html><head><title>Onboarding</title></head><body><nav><p>Menu</p></nav><main><h1>Start</h1>
<p>Welcome <b>all</b>.</p><ul><li>one</li><li>two <i>x</i></li></ul><pre>code
 here</pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><dl><dt>t</dt><dd>d</dd></dl>
<blockquote><p>quoted</p></blockquote></main><footer>bye</footer></body></html>"""


def test_html_blocks():
    title, found = html_blocks(HTML)
    assert title == "Onboarding"
    assert [(k, t, n) for k, t, n, _ in found] == [
        ("heading", "Start", 1), ("para", "Welcome all .", 0), ("list", "- one\n- two x", 0), ("code", "code\n here", 0),
        ("table", "| a | b |\n| 1 | 2 |", 0), ("list", "t\nd", 0), ("para", "quoted", 0),
    ]


def test_html_without_structure_and_deep_nesting():
    assert html_blocks("<body>just\n\n- a\n- b</body>")[1] == [("para", "just", 0, None), ("list", "- a\n- b", 0, None)]
    deep = "<p>x" * 3000
    assert len(html_blocks(deep)[1]) == 3000


MD = """---
title: "Limits"
---
# Rate limits #

| plan | value |
|------|-------|
| pro | 6000 |

Setext
------
- one
  more
* two

```py
# not a heading
```
Last line
joined.
"""


def markdown(spark, *sources):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(sources)], "k int, s string")
    rows = sorted(df.select("k", parsing.parse_markdown(F.col("s")).alias("p")).collect())
    return [(r.p.title, [(b.kind, b.text, b.level) for b in r.p.blocks]) for r in rows]


def test_markdown_blocks(spark):
    [(title, found)] = markdown(spark, MD)
    assert title == "Limits"
    assert found == [
        ("heading", "Rate limits", 1), ("table", "| plan | value |\n| pro | 6000 |", 0), ("heading", "Setext", 2),
        ("list", "- one more\n* two", 0), ("code", "```py\n# not a heading\n```", 0), ("para", "Last line joined.", 0),
    ]


def test_markdown_corners(spark):
    got = markdown(
        spark, "", "---\nno end", "---\ntitle: 'X'\ntitle: Y\n---\nbody", "- a\n---\n- b\n  c\nd\n  e", "~~~\n```\nopen", "text\n===\n---\n===\nx",
        "para\nline\n---\n| a |\n1. x\n   y\r\n2) z", "a line\n" * 20000, "- it\n  co\n" * 8000,
    )
    assert got[:7] == [
        ("", []), ("", [("para", "--- no end", 0)]), ("Y", [("para", "body", 0)]),
        ("", [("heading", "- a", 2), ("list", "- b c", 0), ("para", "d e", 0)]), ("", [("code", "~~~\n```\nopen", 0)]),
        ("", [("heading", "text", 1), ("heading", "---", 1), ("para", "x", 0)]),
        ("", [("para", "para line ---", 0), ("table", "| a |", 0), ("list", "1. x y\n2) z", 0)]),
    ]
    assert [len(x[1]) for x in got[7:]] == [1, 1] and got[8][1][0][1].count("\n") == 7999


def test_text_blocks(spark):
    source = "SERVICE LEVELS\n\nUp 99.95% of the time, hy-\nphenated.\n\n1.2 Response\n- one\n- two\n\n\n3. item.\n4. item."
    df = spark.createDataFrame([(source,)], "t string").select(parsing.text_blocks(F.col("t")).alias("b"))
    got = [(b["kind"], b["text"], b["level"]) for b in df.first()["b"]]
    assert got == [
        ("heading", "SERVICE LEVELS", 1), ("para", "Up 99.95% of the time, hyphenated.", 0), ("heading", "1.2 Response", 2),
        ("list", "- one\n- two", 0), ("heading", "3. item.", 2), ("list", "4. item.", 0),
    ]


SMALL = ChunkStrategy("small", 30, 50, 10, 8)


def packed(spark, documents, strategy):
    rows = [(k, [dict(zip(("kind", "text", "level", "page"), b, strict=True)) for b in found]) for k, found in enumerate(documents)]
    df = spark.createDataFrame(rows, f"k int, blocks array<{parsing.BLOCK}>").repartition(3)
    out = [[] for _ in documents]
    for c in sorted(parsing.pack_chunks(df, ["k"], strategy).collect(), key=lambda c: (c.k, c.ord)):
        out[c.k].append(c)
    return out


def test_sections_close_chunks_and_overlap_is_whole_sentences(spark):
    para = "Alpha beta gamma delta. " * 5
    [found] = packed(
        spark,
        [[("heading", "One", 1, None), ("para", para.strip(), 0, 2), ("para", para.strip(), 0, 3), ("heading", "Two", 2, None), ("para", "End. It is.", 0, 4)]],
        SMALL,
    )
    assert [c["ord"] for c in found] == list(range(len(found)))
    assert found[0]["section_path"] == "One" and found[-1]["section_path"] == "One > Two"
    assert found[1]["text"].startswith("Alpha beta gamma delta.\n\n") and [c["page"] for c in found] == [2, 3, 4]


def test_split_table_repeats_header(spark):
    rows = ["| h |"] + [f"| {'x' * 40} {i} |" for i in range(8)]
    [found] = packed(spark, [[("table", "\n".join(rows), 0, None)]], ChunkStrategy("s", 1, 30, 1, 0))
    assert len(found) > 1 and all(c["text"].startswith("| h |") for c in found)
    assert [r for c in found for r in c["text"].split("\n")[1:]] == rows[1:]


def test_small_last_chunk_joins_its_section(spark):
    para = "Word word word word word word word. " * 6
    [found] = packed(spark, [[("para", para.strip(), 0, None), ("code", "x", 0, None)]], ChunkStrategy("s", 40, 50, 20, 0))
    assert len(found) == 1 and found[0]["text"].endswith("\n\nx")


def test_chunks_keep_every_word_and_their_order(spark):
    rng = random.Random(7)
    said = lambda: "".join(rng.choices("abc. \nA", k=rng.randint(1, 400)))
    documents = [[(rng.choice(["heading", "para", "list", "code"]), said(), rng.randint(1, 4), None) for _ in range(rng.randint(1, 12))] for _ in range(150)]
    documents = [[(k, t.strip(), n if k == "heading" else 0, p) for k, t, n, p in d if t.strip()] for d in documents]
    letters = lambda s: [c for c in s if c.isalpha()]
    for found, chunks in zip(documents, packed(spark, documents, ChunkStrategy("s", 20, 30, 8, 0)), strict=True):
        assert [c["ord"] for c in chunks] == list(range(len(chunks)))
        assert letters("".join(c["text"] for c in chunks)) == letters("".join(t for _, t, *_ in found))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30), st.integers(5, 60))
def test_fill_breaks_are_greedy(lengths, limit):
    firsts = packing.fill_breaks(lengths, 1, limit, -1)
    groups = [lengths[a:b] for a, b in zip(firsts, [*firsts[1:], len(lengths)], strict=bool(lengths))]
    total = lambda g: sum(g) + len(g) - 1
    assert sum(groups, []) == lengths and all(len(g) == 1 or total(g) <= limit for g in groups)
    assert all(total([*g, h[0]]) > limit for g, h in zip(groups, groups[1:], strict=False))


def test_parse_keeps_bad_files_as_rows(spark):
    rows = [("a.txt", b"Hello there friend."), ("b.exe", b"x"), ("c.md", b"# T\n\nbody"), ("d.html", b"<p></p>"), ("e.pdf", b"%PDF")]
    files = spark.createDataFrame(rows, "name string, content binary").withColumn("mime", parsing.mime_of(F.col("name")))
    got = {r["name"]: r for r in parsing.parse_documents(files).collect()}
    assert got["a.txt"]["parse_error"] is None and got["c.md"]["title"] == "T"
    assert got["b.exe"]["parse_error"].startswith("unsupported") and got["d.html"]["parse_error"].startswith("no extractable")
    assert got["e.pdf"]["parse_error"].startswith("no decoder")
