"""SentencePiece encoding by a batched Viterbi search in numpy, and decoding.

The piece table (pieces and scores) comes from a SentencePiece model file.  A text is its
words, each with the spaces before it; no piece reaches over a word's end.  Distinct words of
equal length are searched together: hashes of all their substrings are looked up among the
sorted hashes of the pieces, and for each end the best last piece is an arg-max over the piece
lengths, kept as a back-pointer.  Equal scores go to the longer last piece.  Characters without
a piece become byte pieces (or the unknown id, if the model has no bytes).

``scores``: "stored" takes the file's log probabilities, as a unigram model has them; "rank"
takes minus the logarithm of a piece's rank, for files that store merge ranks; None chooses by
the file: stored ranks are whole numbers that count down from the first piece.

Null texts count as empty and give no ids.  Rows are encoded one by one, so repeated rows and
empty tables need no rule; a very long word is searched block by block.  Decoding is exact but
for the sign U+2581, which stands for a space and decodes to one, and for models whose
normaliser changes texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable, ragged
from .words import freeing, segments

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN_PENALTY = np.float32(10.0)


class Pieces:
    """A piece table ready for searching."""

    def __init__(self, model: str, scores: str | None = None):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        stored = np.array([sp.get_score(i) for i in plain], np.float64)
        if scores is None:
            scores = "rank" if len(stored) > 2 and stored.min() < -1000 and (stored == np.round(stored)).all() else "stored"
        # a score of minus the rank becomes minus its logarithm
        self.scores = (stored if scores == "stored" else -np.log(np.maximum(-stored, 0) + 2)).astype(np.float32)
        self.unknown = np.float32(self.scores.min() - UNKNOWN_PENALTY)
        self.byte_ids = np.full(256, sp.unk_id(), np.int32)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(self.names[i][1:-1], 16)] = i
        self.has_bytes = any(sp.is_byte(i) for i in range(n))
        lengths = np.array([len(self.names[i]) for i in plain])
        self.longest = int(lengths.max())
        keys = np.zeros(len(plain), np.uint64)
        for size in np.unique(lengths):
            some = np.flatnonzero(lengths == size)
            keys[some] = self._prefix(_codes([self.names[plain[i]] for i in some], size))[:, -1] + np.uint64(size)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(plain, np.int32)[order], self.scores[order]
        self.by_word = not any(SPACE in x.lstrip(SPACE) for i in plain if (x := self.names[i]))
        probe = "a  b　ﬁ Å\t"
        self.identity = sp.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        raw = [bytes([int(x[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(self.names)]
        raw[sp.unk_id()] = " ⁇ ".encode()
        self.raw_lengths = np.array([len(x) for x in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + codes[:, k] + np.uint64(1)
        return out

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among the sorted piece keys, -1 if it is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def viterbi(self, words: list[str]) -> list[np.ndarray]:
        """Best pieces of each word (all words of one length): indices of pieces, -1 for a lone unknown character."""
        size, n = len(words[0]), len(words)
        prefix = self._prefix(_codes(words, size))
        reach = min(self.longest, size)
        powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(reach + 1)], np.uint64)
        best = np.full((n, reach + size + 1), -np.inf, np.float32)  # shifted by reach, so that no start lies before 0
        best[:, reach] = 0
        back, piece = np.zeros((n, size + 1), np.int8 if reach < 128 else np.int32), np.full((n, size + 1), -1, np.int32)
        every, block = np.arange(n), max(1, (1 << 20) // (n * reach))
        for low in range(1, size + 1, block):
            ends = np.arange(low, min(low + block, size + 1))
            match = np.full((n, len(ends), reach), -1, np.int32)  # last axis: longest piece first
            for length in range(1, reach + 1):
                ok = ends >= length
                if ok.any():
                    e = ends[ok]
                    keys = prefix[:, e] - prefix[:, e - length] * powers[length] + np.uint64(length)
                    match[:, ok, reach - length] = self._probe(keys)
            gain = np.where(match >= 0, self.scores[match], np.float32(-np.inf))
            gain[:, :, -1] = np.where(match[:, :, -1] >= 0, gain[:, :, -1], self.unknown)
            for k, end in enumerate(ends):
                total = best[:, end : end + reach] + gain[:, k]
                choice = total.argmax(axis=1)
                best[:, reach + end] = total[every, choice]
                back[:, end] = reach - choice
                piece[:, end] = match[every, k, choice]
        steps, at = [], np.full(n, size)
        while True:
            live = np.flatnonzero(at > 0)
            if not len(live):
                break
            steps.append((live, piece[live, at[live]]))
            at[live] -= back[live, at[live]]
        rows, found = np.concatenate([r for r, _ in steps][::-1]), np.concatenate([p for _, p in steps][::-1])
        order = np.argsort(rows, kind="stable")
        return np.split(found[order], np.cumsum(np.bincount(rows, minlength=n))[:-1])

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (spaces written as spaces), for a ``ChunkTable``."""
        words = [w.replace(" ", SPACE) for w in words]
        sizes = np.array([len(w) for w in words])
        out: list = [None] * len(words)
        for size in np.unique(sizes):
            some = np.flatnonzero(sizes == size)
            step = max(1, (1 << 17) // int(size))
            for i in range(0, len(some), step):
                part = some[i : i + step].tolist()
                for k, found in zip(part, self.viterbi([words[j] for j in part]), strict=True):
                    out[k] = self.ids[found] if (found >= 0).all() else self._with_bytes(words[k], found)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array([len(x) for x in out], np.int32)

    def _with_bytes(self, word: str, found: np.ndarray) -> np.ndarray:
        ids, at = [], 0
        for k in found:
            if k >= 0:
                ids.append([self.ids[k]])
                at += len(self.names[self.ids[k]])
                continue
            fallen = self.byte_ids[list(word[at].encode())] if self.has_bytes else [self.sp.unk_id()]
            if self.has_bytes or not (ids and ids[-1] == [self.sp.unk_id()]):  # unknown characters in a row are one id
                ids.append(list(fallen))
            at += 1
        return np.array([i for x in ids for i in x], np.int32)


def _codes(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), size).astype(np.uint64)


def _word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of words: rows' starts, and runs of spaces after anything but a space sign."""
    space = data == 32
    start = space & ~np.r_[False, space[:-1]]
    at = np.flatnonzero(start & (np.arange(len(data)) >= 3))
    sign = (data[at - 1] == 0x81) & (data[at - 2] == 0x96) & (data[at - 3] == 0xE2)
    start[at[sign]] = False
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(start)


def encode(docs: DataFrame, model: str, text_col: str = "text", scores: str | None = None, out_col: str = "ids") -> DataFrame:
    """Adds ``out_col``, the ids of each whole text."""
    kept = [f for f in docs.schema.fields if f.name.lower() != out_col.lower()]
    # the dummy space before a text that is not empty
    lead = F.concat(F.when(F.coalesce(text_col, F.lit("")) == "", "").otherwise(" "), F.coalesce(text_col, F.lit(""))).alias("_led")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(model, scores)
        known = ChunkTable(table.learn, 1_000_000)
        for batch in batches:
            led = batch[batch.num_columns - 1]
            if not table.identity:
                led = pa.array([table.sp.normalize(x[1:]).replace(SPACE, " ") for x in led.to_pylist()], pa.string())
            for row, data, offsets in segments(led):
                starts = _word_starts(data, offsets) if table.by_word else np.unique(offsets[:-1][offsets[:-1] < len(data)])
                ids, lengths = known(data, starts, np.r_[starts[1:], len(data)]) if len(data) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                ends = np.r_[0, np.cumsum(lengths)][np.searchsorted(starts, offsets)]
                some = batch.slice(row, len(offsets) - 1)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns[: len(kept)], lists], [*(f.name for f in kept), out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*[f"`{f.name}`" for f in kept], lead).mapInArrow(freeing(run), f"{schema}, `{out_col}` array<int>" if schema else f"`{out_col}` array<int>")


def decode(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, the text of each list of ids (null for null); bytes that are no UTF-8 become U+FFFD."""
    kept = [f for f in rows.schema.fields if f.name.lower() != out_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                lists = some[ids_col].cast(pa.large_list(pa.int32()))
                counts = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                lengths = table.raw_lengths[ids]
                raw = table.raw[ragged(table.raw_starts[ids], lengths)].tobytes()
                ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]].tolist()
                texts = [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                out = pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(some[f.name] for f in kept), out], [*(f.name for f in kept), out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*[f"`{f.name}`" for f in kept]).mapInArrow(freeing(run), f"{schema}, `{out_col}` string")
