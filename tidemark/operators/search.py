"""Index building and the three retrievers, for many questions at once.

Tables used here (keys in brackets):

* ``chunks``   [kb_id, chunk_id]: doc_id, ord, status, title, section_path, context,
  aliases, text, flags, embedding, embedding_model
* ``subqueries`` [query_id, subq]: kb_id, question, variants, keywords, identifiers
* ``hits``     [query_id, subq, retriever, chunk_id]: rank (from 0), score
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..session import cut_lineage, maybe_broadcast, small_enough

BLOCK_CHUNKS = 32_768  # chunks whose scores are summed in one group
MANY_BLOCKS = 64  # from so many on, blocks grow to four times the chunks
BLOCK_QUESTIONS = 65_536  # sub-questions that meet them there
DIGITS = 6  # scores equal to this many places are ties, decided by chunk_id


def live_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Active and staged chunks with their document's title."""
    titles = docs.select("kb_id", "doc_id", "title")
    live = chunks.where(F.col("status").isin("active", "staged"))
    return live.join(titles, ["kb_id", "doc_id"])


def version_visible(chunks: DataFrame, staged_docs: DataFrame | None) -> DataFrame:
    """Documents under test show their staged chunks, all others their active ones."""
    if staged_docs is None:
        return chunks.where(F.col("status") == "active")
    marked = staged_docs.select("doc_id").distinct().withColumn("under_test", F.lit(True))
    wanted = F.when(F.col("under_test"), F.lit("staged")).otherwise(F.lit("active"))
    return chunks.join(marked, "doc_id", "left").where(F.col("status") == wanted).drop("under_test")


def readable(acl: Column, principals: Sequence[str]) -> Column:
    """Public (empty list) or sharing at least one principal."""
    allowed = F.size(F.coalesce(acl, F.array().cast("array<string>"))) == 0
    if principals:
        allowed = allowed | F.arrays_overlap(acl, F.array(*[F.lit(p) for p in principals]))
    return allowed


def access_masks(
    chunks: DataFrame,
    docs: DataFrame,
    principals: Sequence[str] = (),
    staged_docs: DataFrame | None = None,
) -> DataFrame:
    """Chunks with ``readable``, ``allowed`` (first pass) and ``escalated`` flags."""
    meta = docs.select(
        "kb_id",
        "doc_id",
        F.col("status").alias("doc_status"),
        F.col("tier").alias("doc_tier"),
        F.col("acl").alias("doc_acl"),
    )
    can_read = readable(F.col("doc_acl"), principals)
    warm = (F.col("doc_status") == "active") & (F.col("doc_tier") != "cold")
    known = F.col("doc_status").isin("active", "quarantined")
    return (
        version_visible(chunks, staged_docs)
        .join(meta, ["kb_id", "doc_id"])
        .withColumn("readable", can_read)
        .withColumn("allowed", can_read & warm)
        .withColumn("escalated", can_read & known)
        .drop("doc_acl")
    )


def only_chunks(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """The chunks that ``hits`` name, all rows of each.

    Hits are bounded by questions and ``k``, texts are not: while the names are small, no text is moved to find these.
    """
    return chunks.join(maybe_broadcast(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")


# ------------------------------------------------------------------ keyword index


def index_text(chunks: DataFrame) -> Column:
    """What the keyword index sees of a chunk; absent columns count as empty."""
    parts = [F.col(c) for c in ("title", "section_path", "context") if c in chunks.columns]
    if "aliases" in chunks.columns:
        parts.append(F.array_join("aliases", " "))
    return F.concat_ws(" ", *parts, F.col("text"))


def _counted_words(chunks: DataFrame) -> Column:
    return F.filter(text.words(index_text(chunks)), lambda w: ~text.is_stop_word(w))


def tokenised(chunks: DataFrame) -> DataFrame:
    """Chunks as the keyword index sees them: keys, mask columns, words and their number.

    Stored once, it serves :func:`postings` and :func:`chunk_lengths` without a second look at the texts.
    """
    masks = [c for c in ("allowed", "escalated") if c in chunks.columns]
    return chunks.select("kb_id", "chunk_id", *masks, _counted_words(chunks).alias("words")).withColumn("doc_len", F.size("words"))


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """Tokens per chunk.  Stemming does not change a count, so it is left out."""
    return chunks if "doc_len" in chunks.columns else chunks.withColumn("doc_len", F.size(_counted_words(chunks)))


def postings(chunks: DataFrame, only_terms: DataFrame | None = None) -> DataFrame:
    """Term frequencies per chunk; with ``only_terms`` just for the terms asked about.

    The filter by term runs before the shuffle, so an ad-hoc search moves only the
    postings it needs.  Without it a chunk's words are moved as one value, and counted where all rows
    of its key have met.  ``chunks`` may carry mask columns, which are kept; it may also be
    :func:`tokenised`.
    """
    masks = [c for c in ("allowed", "escalated") if c in chunks.columns]
    words = chunks if "words" in chunks.columns else tokenised(chunks)
    if only_terms is None:
        words = words.select("kb_id", "chunk_id", *masks, "doc_len", _one_value("words").alias("words")).repartition("chunk_id")  # a constant kb_id would not count as part of a key
        words = words.withColumn("words", F.split("words", " "))
    exploded = (
        words.select("kb_id", "chunk_id", *masks, "doc_len", F.explode("words").alias("_w"))
        .withColumn("term", text.stem(F.col("_w")))
        .drop("_w")
    )
    if only_terms is not None:
        wanted = only_terms.select("kb_id", "term").distinct()
        exploded = exploded.join(maybe_broadcast(wanted), ["kb_id", "term"], "left_semi")
    return exploded.groupBy("kb_id", "chunk_id", "term", "doc_len", *masks).agg(
        F.count(F.lit(1)).alias("tf")
    )


def chunk_terms(words: DataFrame) -> DataFrame:
    """Each chunk's index terms, with repeats, from :func:`tokenised`; what :func:`postings` counts, as one row a chunk."""
    masks = [c for c in ("allowed", "escalated") if c in words.columns]
    terms = F.transform("words", lambda w: text.stem(w))
    rows = words.select("kb_id", "chunk_id", *masks, "doc_len", terms.alias("terms"))
    return rows.groupBy("kb_id", "chunk_id", *masks, "doc_len").agg(F.flatten(F.collect_list("terms")).alias("terms"))


def _blocks(n: int) -> int:
    """Blocks for ``n`` chunks: many small ones first, then fewer of up to four times the size."""
    return max(1, min(-(-n // BLOCK_CHUNKS), MANY_BLOCKS), -(-n // (4 * BLOCK_CHUNKS)))


def _one_value(words: str) -> Column:
    """A list of words as one text, null if it has none: one value is less to move than many, and words have no spaces."""
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def posting_blocks(words: DataFrame, n: int) -> DataFrame:
    """What :func:`postings` counts, from :func:`tokenised`, as lists by block of chunks; stored, it serves every search.

    ``n`` is about the number of chunks.  A term's row holds, for a base and a block, the places of its chunks there, their
    ``tf`` and how many of them each mask shows.  A chunk's row (term null) holds its place; ``copies`` counts equal rows.
    The texts' words are shuffled once and become terms in the block, each word once.
    """
    masks = [c for c in ("allowed", "escalated") if c in words.columns]
    rows = words.select("kb_id", "chunk_id", *masks, "doc_len", _one_value("words").alias("terms"))
    return _dealt(rows, _blocks(n), text.stem_word)


def block_lengths(index: DataFrame) -> DataFrame:
    """:func:`chunk_lengths` of the chunks in :func:`posting_blocks`."""
    masks = [c for c in ("allowed", "escalated") if c in index.columns]
    chunks = index.where(F.col("term").isNull())
    return chunks.select("kb_id", "chunk_id", *masks, "doc_len", F.explode(F.expr("array_repeat(0, copies)")).alias("_c")).drop("_c")


def _dealt(rows: DataFrame, blocks: int, stem: Callable[[str], str] | None = None) -> DataFrame:
    """:func:`posting_blocks` of rows with a chunk's ``terms`` and, if they are counted, ``tfs``; to be stemmed, words in one text."""
    masks = [c for c in ("allowed", "escalated") if c in rows.columns]
    kinds = dict(rows.dtypes)
    schema = f"block long, kb_id {kinds['kb_id']}, term string, at array<int>, tf array<int>, "
    schema += "".join(f"n_{m} long, " for m in masks)
    schema += f"place int, chunk_id {kinds['chunk_id']}, doc_len {kinds['doc_len']}, copies int" + "".join(f", {m} boolean" for m in masks)

    def post(frame: pa.Table) -> pa.Table:
        return _posted(frame, masks, stem)

    return rows.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks))).groupBy("block").applyInArrow(post, schema)


def _encoded(values: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the values, nulls as one value, and the value of each code."""
    coded = pc.dictionary_encode(values.combine_chunks(), null_encoding="encode")
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _posted(frame: pa.Table, masks: list[str], stem: Callable[[str], str] | None) -> pa.Table:
    # equal rows are one chunk; chunks are placed in the order of their ids, which decides ties
    by_id = pc.sort_indices(frame, sort_keys=[("chunk_id", "ascending")])
    frame = frame.take(by_id)
    same = np.zeros(frame.num_rows, np.int64)
    for c in ("kb_id", "chunk_id", "doc_len", *masks):
        code, known = _encoded(frame[c])
        same = np.unique(same * len(known) + code, return_inverse=True)[1]
    _, first, same, copies = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first, kind="stable")
    place = np.empty(len(first), np.int64)
    place[order] = np.arange(len(first))
    where, first, copies = place[same], first[order], copies[order]
    chunks = frame.take(pa.array(first))

    words, row = _flat(pc.split_pattern(frame["terms"], " ") if stem is not None else frame["terms"])
    code, known = _encoded(words)
    if stem is not None:
        told, known = _encoded(pa.chunked_array([pa.array([stem(w) for w in known.to_pylist()], pa.string())]))
        code = told[code] if len(told) else code
    base, bases = _encoded(frame["kb_id"])
    wide, n = max(len(known), 1), max(len(first), 1)
    key, back = np.unique((base[row] * wide + code) * n + where[row], return_inverse=True)
    weights = pc.list_flatten(frame["tfs"]).to_numpy() if "tfs" in frame.column_names else None
    tf = np.bincount(back, weights=weights, minlength=len(key)).astype(np.int32)
    at, key = key % n, key // n
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    ends, head = np.r_[start, len(key)].astype(np.int32), key[start]
    shown = [np.add.reduceat(pc.fill_null(chunks[m], False).to_numpy().astype(np.int64)[at], start) if len(start) else start for m in masks]

    block = frame["block"][0].as_py()
    posts = {
        "block": pa.array(np.full(len(start), block)), "kb_id": bases.take(pa.array(head // wide)), "term": known.take(pa.array(head % wide)),
        "at": pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32))), "tf": pa.ListArray.from_arrays(pa.array(ends), pa.array(tf)),
        **{f"n_{m}": pa.array(x) for m, x in zip(masks, shown, strict=True)},
    }
    held = {
        "block": pa.array(np.full(len(first), block)), "kb_id": chunks["kb_id"], "place": pa.array(np.arange(len(first), dtype=np.int32)),
        "chunk_id": chunks["chunk_id"], "doc_len": chunks["doc_len"], "copies": pa.array(copies.astype(np.int32)), **{m: chunks[m] for m in masks},
    }
    columns = ["block", "kb_id", "term", "at", "tf", *[f"n_{m}" for m in masks], "place", "chunk_id", "doc_len", "copies", *masks]
    kinds = {**{c: v.type for c, v in held.items()}, **{c: v.type for c, v in posts.items()}}
    full = [pa.table({c: t[c] if c in t else pa.nulls(len(t["block"]), kinds[c]) for c in columns}) for t in (held, posts)]
    return pa.concat_tables(full)


def term_frequencies(index: DataFrame) -> DataFrame:
    """How many entries of :func:`postings` each term has, by mask; stored beside the index it serves every search."""
    masks = [c for c in ("allowed", "escalated") if c in index.columns]
    return index.groupBy("kb_id", "term").agg(*[F.count_if(F.col(c)).alias(c) for c in masks])


def query_terms(subqueries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Weighted terms per sub-question: its own at 1.0, alias expansions at 0.7.

    ``aliases`` has a phrase and an array of expansions per row; a phrase applies when
    it occurs in the sub-question's texts as a whole word.
    """
    texts = F.concat(
        F.array("question"),
        F.coalesce("variants", F.array().cast("array<string>")),
        F.coalesce("keywords", F.array().cast("array<string>")),
    )
    base = subqueries.select("kb_id", "query_id", "subq", texts.alias("texts"))
    own = base.select(
        "kb_id",
        "query_id",
        "subq",
        F.explode(F.flatten(F.transform("texts", lambda x: text.tokens(x)))).alias("term"),
        F.lit(1.0).alias("weight"),
    )
    if aliases is not None:
        own = own.unionByName(_alias_terms(base, aliases))
    return own.groupBy("kb_id", "query_id", "subq", "term").agg(F.max("weight").alias("weight"))


def _alias_terms(base: DataFrame, aliases: DataFrame) -> DataFrame:
    """Expansions whose phrase occurs, found by joining on the phrase's longest word."""
    joined = F.lower(F.array_join("texts", " "))
    runs = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))
    phrases = aliases.select(
        F.lower("phrase").alias("phrase"), "expansions", _anchor(F.lower("phrase")).alias("anchor")
    )
    found = (
        base.withColumn("joined", joined)
        .withColumn("anchor", F.explode(F.array_distinct(F.concat(runs(F.col("joined")), _marks(F.col("joined"))))))
        .join(maybe_broadcast(phrases), "anchor")
        .where(text.whole_word(F.col("joined"), F.col("phrase")))
    )
    return found.select(
        "kb_id",
        "query_id",
        "subq",
        F.explode(F.flatten(F.transform("expansions", lambda x: text.tokens(x)))).alias("term"),
        F.lit(0.7).alias("weight"),
    )


def bm25_search(
    terms: DataFrame,
    index: DataFrame,
    lengths: DataFrame,
    mask: str = "allowed",
    k: int = fixed.DEFAULTS.retrieve_k,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """Okapi BM25 top ``k`` per sub-question.

    ``index`` is :func:`posting_blocks`, :func:`postings` or :func:`chunk_terms`, ``lengths`` is :func:`chunk_lengths`.
    Frequencies and collection size count visible chunks; the average length counts all of them.  With ``frequencies``
    (:func:`term_frequencies` of the index) the index is read once, not also for counting.
    """
    small = small_enough(terms)  # decided on the questions, before any index scan

    def bounded(df: DataFrame) -> DataFrame:
        # Each side passed here has at most as many rows as ``terms``.
        return F.broadcast(df) if small else df

    asked = bounded(terms.select("kb_id", "term").distinct())
    in_blocks, whole = "block" in index.columns, "terms" in index.columns
    if in_blocks:
        met = index.where(F.col("term").isNotNull()).join(asked, ["kb_id", "term"], "left_semi")
    else:
        seen = index.where(F.col(mask))
        if whole:
            met = seen.select("kb_id", F.explode(F.array_distinct("terms")).alias("term")).join(asked, ["kb_id", "term"], "left_semi")
        else:
            met = seen = seen.join(asked, ["kb_id", "term"], "left_semi")
    stats = (
        lengths.join(bounded(terms.select("kb_id").distinct()), "kb_id", "left_semi")
        .groupBy("kb_id")
        .agg(F.count_if(F.col(mask)).alias("n"), F.avg("doc_len").alias("avg_len"))
    )
    if frequencies is None:
        df = met.groupBy("kb_id", "term").agg((F.sum(f"n_{mask}") if in_blocks else F.count(F.lit(1))).alias("df")).where(F.col("df") > 0)
    else:
        known = frequencies.select("kb_id", "term", F.col(mask).alias("df")).where(F.col("df") > 0)
        df = known.join(asked, ["kb_id", "term"], "left_semi")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(bounded(stats), "kb_id").select("kb_id", "term", idf.alias("idf"), "avg_len")
    weighted = terms.join(bounded(weights), ["kb_id", "term"])
    if in_blocks:
        held = index.where(F.col("term").isNull() & F.col(mask))
        blocks = index.agg(F.max("block")).first()[0]
        blocks = 1 if blocks is None else blocks + 1
    else:
        blocks = _blocks(lengths.where(F.col(mask)).count())
        if whole:
            rows = seen.select("kb_id", "chunk_id", "doc_len", "terms")
        else:
            entries = seen.groupBy("kb_id", "chunk_id", "doc_len").agg(F.collect_list(F.struct("term", F.col("tf").cast("long").alias("tf"))).alias("e"))
            rows = entries.select("kb_id", "chunk_id", "doc_len", F.col("e.term").alias("terms"), F.col("e.tf").alias("tfs"))
        dealt = _dealt(rows, blocks)
        dealt = cut_lineage(dealt, "posting-blocks") if _pilots(blocks, k) < blocks else dealt
        held, met = dealt.where(F.col("term").isNull()), dealt.where(F.col("term").isNotNull())
        met = met.join(asked, ["kb_id", "term"], "left_semi") if whole else met
    parts = ["block", "kb_id", "term", "at", "tf", "place", "chunk_id", "doc_len"]
    shares = max(1, -(-terms.select("query_id", "subq").distinct().count() // BLOCK_QUESTIONS))
    return _block_hits(held.select(*parts).unionByName(met.select(*parts)), weighted, blocks, shares, k)


def _pilots(blocks: int, k: int | None) -> int:
    """How many blocks are searched first, to know what a chunk of the others must reach."""
    return blocks if k is None or blocks < 4 else math.isqrt(blocks - 1) + 1


def _block_hits(parts: DataFrame, weighted: DataFrame, blocks: int, shares: int, k: int | None) -> DataFrame:
    """The best ``k`` chunks of each sub-question, from all blocks.

    Every block of chunks meets every share of the sub-questions in one group.  A group holds its chunks' postings and
    one sum per chunk, never a row per question and chunk: only its best ``k`` leave it.  The root of the number of blocks
    goes first.  The k-th best score there is one that no chunk of the other blocks may fall short of: what does is not
    among the best, and does not leave its group, nor is it summed where its terms cannot reach that score.
    """
    kinds = {**dict(weighted.dtypes), **dict(parts.dtypes)}
    entry = F.struct("kb_id", "term", (F.col("weight") * F.col("idf")).alias("w"), "avg_len")
    asked = weighted.groupBy("query_id", "subq").agg(F.collect_list(entry).alias("e"))
    asked = asked.select(
        "query_id", "subq", *[F.col(f"e.{c}").alias(c) for c in ("kb_id", "term", "w", "avg_len")],
        F.pmod(F.xxhash64("query_id", "subq"), F.lit(shares)).alias("share"), F.lit(None).cast("double").alias("floor"),
    )
    schema = f"query_id {kinds['query_id']}, subq {kinds['subq']}, chunk_id {kinds['chunk_id']}, score double"

    def score(chunks: pa.Table, questions: pa.Table) -> pa.Table:
        return _best_of_block(chunks, questions, k)

    def scored(some: DataFrame, questions: DataFrame, numbers: Column) -> DataFrame:
        placed = some.withColumn("share", _each(shares))
        dealt = questions.withColumn("block", F.explode(numbers))
        return placed.groupBy("block", "share").cogroup(dealt.groupBy("block", "share")).applyInArrow(score, schema)

    numbers, pilots = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), _pilots(blocks, k)
    if pilots == blocks:
        return top_hits(scored(parts, asked, numbers), "bm25", k)
    asked = cut_lineage(asked, "asked")
    first = top_hits(scored(parts.where(F.col("block") < pilots), asked, F.slice(numbers, 1, pilots)), "bm25", k)
    first = cut_lineage(first, "first-hits")
    floors = first.where(F.col("rank") == k - 1).select("query_id", "subq", F.col("score").alias("floor"))
    same = [asked[c].eqNullSafe(floors[c]) for c in ("query_id", "subq")]
    known = asked.drop("floor").join(maybe_broadcast(floors), same, "left").select(*[asked[c] for c in asked.columns[:-1]], "floor")
    rest = scored(parts.where(F.col("block") >= pilots), known, F.slice(numbers, pilots + 1, blocks - pilots))
    return top_hits(first.select(*rest.columns).unionByName(rest), "bm25", k)


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _codes(values: pa.ChunkedArray, known: pa.Array) -> np.ndarray:
    """The place of each value in ``known``, -1 where it is not there."""
    return pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy().astype(np.int64)


def _flat(lists: pa.ChunkedArray) -> tuple[pa.ChunkedArray, np.ndarray]:
    """The lists' values and, for each, the row it comes from."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return pc.list_flatten(lists), np.repeat(np.arange(len(n)), n)


def _best_of_block(parts: pa.Table, questions: pa.Table, k: int | None) -> pa.Table:
    """The best ``k`` chunks of a block for each question, those below its floor left out."""
    is_chunk = pc.is_null(parts["term"])
    chunks, posts = parts.filter(is_chunk), parts.filter(pc.invert(is_chunk))
    chunks = chunks.take(pc.sort_indices(chunks["place"]))
    q_term, q_row = _flat(questions["term"])
    q_kb = pc.list_flatten(questions["kb_id"])
    bases = pc.unique(q_kb)
    vocabulary = pc.unique(q_term)
    wide = max(len(vocabulary), 1)
    q_base = _codes(q_kb, bases)
    avg_len = np.zeros(len(bases))
    avg_len[q_base] = pc.list_flatten(questions["avg_len"]).to_numpy()
    q_key, q_weight = q_base * wide + _codes(q_term, vocabulary), pc.list_flatten(questions["w"]).to_numpy()

    base, term = _codes(posts["kb_id"], bases), _codes(posts["term"], vocabulary)
    used = np.flatnonzero((base >= 0) & (term >= 0))
    used = used[np.argsort(base[used] * wide + term[used], kind="stable")]
    posts, base, term = posts.take(pa.array(used)), base[used], term[used]
    place, post = _flat(posts["at"])
    place, tf = place.to_numpy().astype(np.int64), pc.list_flatten(posts["tf"]).to_numpy()
    held = np.full(int(max(place.max(initial=-1), pc.max(chunks["place"]).as_py() or 0)) + 1, -1, np.int64)
    held[chunks["place"].to_numpy()] = np.arange(len(chunks))
    row = held[place]  # chunks the mask hides are not among them
    shown = row >= 0
    row, post, tf = row[shown], post[shown], tf[shown]
    ids = pc.unique(chunks["chunk_id"])  # in the order of ids, which decides ties
    chunk = _codes(chunks["chunk_id"], ids)[row]
    part = 1 - fixed.BM25_B + fixed.BM25_B * chunks["doc_len"].to_numpy()[row] / avg_len[base[post]]
    gain = tf * (fixed.BM25_K1 + 1) / (tf + fixed.BM25_K1 * part)
    key = base * wide + term
    at = np.searchsorted(key, q_key)
    known = at < len(key)
    known[known] = key[at[known]] == q_key[known]
    begin, end = (np.searchsorted(post, at, side) for side in ("left", "right"))
    begin, end = np.where(known, begin, 0), np.where(known, end, 0)
    starts = np.flatnonzero(np.r_[True, post[1:] != post[:-1]]) if len(post) else np.zeros(0, np.int64)
    top = np.zeros(len(key))
    top[post[starts]] = np.maximum.reduceat(gain, starts) if len(starts) else 0
    most = np.where(end > begin, q_weight * top[np.minimum(at, len(key) - 1)], 0) if len(key) else np.zeros(len(q_key))
    floors = pc.fill_null(questions["floor"], -np.inf).to_numpy() - 2 * 10.0**-DIGITS
    single = len(ids) == len(chunks)  # a list then has a chunk once, and can be looked up

    def added(i: int, some: np.ndarray) -> np.ndarray:
        """What term ``i`` gives to each of some chunks."""
        listed = chunk[begin[i] : end[i]]
        spot = np.minimum(np.searchsorted(listed, some), len(listed) - 1)
        return np.where(listed[spot] == some, q_weight[i] * gain[begin[i] : end[i]][spot], 0)

    rows, found, scores = [], [], []
    first = np.searchsorted(q_row, np.arange(len(questions) + 1))
    for n in range(len(questions)):
        mine = np.arange(first[n], first[n + 1])
        mine = mine[end[mine] > begin[mine]]
        floor = floors[n]
        if not len(mine) or (single and most[mine].sum() < floor):
            continue
        by_most = mine[np.argsort(most[mine], kind="stable")]
        reach = np.cumsum(most[by_most])
        few = int(np.searchsorted(reach, floor)) if single and (q_weight[mine] >= 0).all() else 0  # too weak even together
        total = np.bincount(
            np.concatenate([chunk[begin[i] : end[i]] for i in by_most[few:]] if few else [chunk[begin[i] : end[i]] for i in mine]),
            weights=np.concatenate([q_weight[i] * gain[begin[i] : end[i]] for i in (by_most[few:] if few else mine)]),
            minlength=len(ids),
        )
        if few:
            some = np.flatnonzero(total >= max(floor - reach[few - 1], 1e-300))
            sums = total[some]
            for j in range(few - 1, -1, -1):  # the strongest of them first, while fewer can still reach the floor
                sums = sums + added(by_most[j], some)
                can = sums >= floor - (reach[j - 1] if j else 0) - 1e-9
                some, sums = some[can], sums[can]
            sums = np.zeros(len(some))
            for i in mine:  # in the order of the terms, as in the full sum
                sums += added(i, some)
        else:
            some = np.flatnonzero(total > 0)
            sums = total[some]
        near = sums >= floor
        some, sums = some[near], sums[near]
        if k is not None and len(some) > k:
            tied = np.round(sums, DIGITS)
            kth = np.partition(tied, -k)[-k]
            above, level = np.flatnonzero(tied > kth), np.flatnonzero(tied == kth)
            kept = np.concatenate([above, level[: k - len(above)]])
            some, sums = some[kept], sums[kept]
        rows.append(np.full(len(some), n))
        found.append(some)
        scores.append(sums)
    rows, found, scores = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (found, np.int64), (scores, float)))
    out = [questions["query_id"].take(rows), questions["subq"].take(rows), ids.take(pa.array(found)), pa.array(scores)]
    return pa.table(dict(zip(("query_id", "subq", "chunk_id", "score"), out, strict=True)))


def top_hits(scored: DataFrame, retriever: str, k: int | None) -> DataFrame:
    """The best ``k`` (all, if None) of each sub-question, ranked from 0.

    The bare row number is what is filtered: Spark then keeps ``k`` rows of a question in each
    partition before the shuffle.
    """
    order = [F.round("score", DIGITS).desc(), F.col("chunk_id")]
    w = Window.partitionBy("query_id", "subq").orderBy(*order)
    numbered = scored.withColumn("nth", F.row_number().over(w))
    kept = numbered if k is None else numbered.where(F.col("nth") <= k)
    return kept.select("query_id", "subq", F.lit(retriever).alias("retriever"), "chunk_id", (F.col("nth") - 1).alias("rank"), "score")


# ------------------------------------------------------------------ exact matches


def _marks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)[^\w\s]"), F.lit(0))


def _anchor(c: Column) -> Column:
    """The longest word of a phrase, or a punctuation mark if it has no word.

    A phrase found as a whole word has each of its words as a whole word of the text,
    so joining on one of them loses nothing.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))
    return F.coalesce(longest["r"], F.get(_marks(c), F.lit(0)))


def anchors(hay: Column) -> Column:
    """The words and marks of a text that patterns are located by; stored with the chunks, it serves every search."""
    low = F.lower(hay)
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)), _marks(low)))


def exact_hay() -> Column:
    """What :func:`exact_search` sees of a chunk."""
    return F.concat_ws("\n", F.col("title"), F.col("section_path"), F.col("text"))


def exact_search(
    patterns: DataFrame,
    chunks: DataFrame,
    mask: str = "allowed",
    k: int = fixed.DEFAULTS.retrieve_k,
    require_all: bool = False,
) -> DataFrame:
    """Chunks containing the patterns as whole words; score is the share of them hit.

    ``patterns``: kb_id, query_id, subq, patterns (array).  Candidates come from an
    equi-join on one word of each pattern; only those pairs are checked by expression.
    With ``require_all`` a chunk is looked into only if it has a word of every pattern.
    ``chunks`` with :func:`anchors` stored are not read for their words again.
    """
    wanted = (
        patterns.withColumn(
            "patterns",
            F.array_distinct(F.filter(F.transform("patterns", F.trim), lambda p: F.length(p) >= 2)),
        )
        .where(F.size("patterns") > 0)
        .select("kb_id", "query_id", "subq", F.size("patterns").alias("asked"), F.explode("patterns").alias("pattern"))
        .withColumn("anchor", _anchor(F.lower("pattern")))
    )
    hay = exact_hay()
    seen = chunks.where(F.col(mask)).select("kb_id", "chunk_id", hay.alias("hay"))
    words = F.col("anchors") if "anchors" in chunks.columns else anchors(hay)
    located = (
        chunks.where(F.col(mask)).select("kb_id", "chunk_id", F.explode(words).alias("anchor"))
        .join(maybe_broadcast(wanted), ["kb_id", "anchor"])
    )
    # A pattern that is one word is settled by the join; others are looked up in the text.
    settled = F.lower("pattern") == F.col("anchor")
    kept = ["query_id", "subq", "chunk_id", "asked"]
    located = _may_have_all(located, kept) if require_all else cut_lineage(located, "located")
    checked = (
        maybe_broadcast(located.where(~settled))
        .join(seen, ["kb_id", "chunk_id"])
        .where(text.whole_word(F.col("hay"), F.col("pattern")))
    )
    hit = (
        located.where(settled)
        .select(*kept)
        .unionByName(checked.select(*kept))
        .groupBy(*kept)
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    if require_all:
        hit = hit.where(F.col("hits") == F.col("asked"))
    scored = hit.withColumn("score", F.col("hits") / F.col("asked"))
    return top_hits(scored, "exact", k)


def _may_have_all(located: DataFrame, kept: list[str]) -> DataFrame:
    """The rows of chunks in which as many patterns were located as are asked.

    Where chunks repeat, a pattern is located, and may count, more than once: those go on too.
    """
    place = F.struct("kb_id", "anchor", "pattern")
    groups = located.groupBy(*kept).agg(F.collect_list(place).alias("places"))
    repeated = F.size("places") > F.size(F.array_distinct(F.transform("places", lambda p: p["pattern"])))
    whole = cut_lineage(groups.where((F.size("places") >= F.col("asked")) | repeated), "located")
    return whole.select(*kept, F.inline("places"))


def broad_patterns(subqueries: DataFrame, most: int | None = None) -> DataFrame:
    """Keywords longer than three characters of each sub-question; the first ``most`` if given."""
    kept = F.filter("keywords", lambda w: F.length(w) > 3)
    kept = kept if most is None else F.slice(kept, 1, most)
    return subqueries.select("kb_id", "query_id", "subq", kept.alias("patterns"))


def identifier_patterns(subqueries: DataFrame) -> DataFrame:
    return subqueries.select("kb_id", "query_id", "subq", F.col("identifiers").alias("patterns"))


def append_list(first: DataFrame, second: DataFrame) -> DataFrame:
    """One list after another: the second list's ranks go on where the first ends."""
    ends = first.groupBy("query_id", "subq").agg(F.count(F.lit(1)).alias("_n"))
    moved = second.join(ends, ["query_id", "subq"], "left").withColumn(
        "rank", F.col("rank") + F.coalesce("_n", F.lit(0)).cast("int")
    )
    return first.unionByName(moved.drop("_n"))


# ------------------------------------------------------------------ neighbours


def neighbours(candidates: DataFrame, chunks: DataFrame, radius: int = 1, mask: str = "escalated") -> DataFrame:
    """Chunks next to a candidate in its document, same status, at most ``radius`` away.

    The band is turned into an equi-join by listing the neighbouring positions.
    """
    steps = [d for d in range(-radius, radius + 1) if d]
    wanted = candidates.select(
        "query_id",
        F.col("chunk_id").alias("near"),
        "doc_id",
        "status",
        F.explode(F.array(*[F.col("ord") + d for d in steps])).alias("ord"),
    )
    seen = chunks.where(F.col(mask)).select("doc_id", "status", "ord", "chunk_id")
    return wanted.join(seen, ["doc_id", "status", "ord"]).select("query_id", "near", "chunk_id", "ord")
