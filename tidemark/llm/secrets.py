"""Secrets in whole texts: fixed patterns, and strings that a primed compressor finds new.

Base spans come from three patterns (fixed values below).  A further candidate is a long run of
token characters with letters and digits that no base span touches and that has a sensitive word
shortly before it.  Its novelty is what it adds, in bytes a character, to the zstandard size
of the text around it, under a dictionary of identifiers: words, hex tables and repeated names
cost little, random strings cost nearly their entropy.  Spans are in code points, end exclusive.

Null texts count as empty and give no span; very long texts are scanned whole.  Rows are judged
one by one, so repeated rows, ties and empty tables need no rule.  All input columns are kept;
an input column named like an output is replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import freeing

# The base patterns, the least lengths, and the order of kinds.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Sensitive words of the added method, and the identifiers its compressor knows beforehand.
SENSITIVE = re.compile(r"(?i:passw|pwd|secret|token|credential|bearer|authoriz|private.?key|access.?key|api.?key|client.?id|signature|webhook)")
_SENSITIVE_HINTS = "passw pwd secret token credential bearer authoriz private access api client signature webhook".split()
IDENTIFIERS = """
0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789ABCDEF abcdefghijklmnopqrstuvwxyz_0123456789 00000000 11111111 ffffffff
public static final private protected class interface return import export const function async await undefined null true false None self
request response session context config options params headers content length string number object array value default index result error message
database connection username password hostname address endpoint service account project region bucket version release production development staging
getElementById addEventListener setTimeout createElement querySelector onChange handleSubmit className dispatchEvent preventDefault
authorization bearer application/json text/html charset=utf-8 https://www.example.com/api/v1/users/ access_token refresh_token client_secret
""".encode()
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_RUN = bytes(104 if chr(b).isalnum() and b < 128 or chr(b) in "+/_=-" else 32 for b in range(256))
_HEX_RUN = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind; leftmost, not overlapping within a kind."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(x in low for x in _HINTS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    if b"h" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_RUN):
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


class Novelty:
    """Bytes a character that a string adds to the compressed text around it."""

    def __init__(self, identifiers: bytes = IDENTIFIERS, around: int = 200):
        import zstandard

        primer = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False)
        self.around = around

    def __call__(self, text: str, start: int, end: int) -> float:
        near = (text[max(0, start - self.around) : start] + "\n" + text[end : end + self.around]).encode("utf-8", "replace")
        string = text[start:end].encode("utf-8", "replace")
        return (len(self.compressor.compress(near + string)) - len(self.compressor.compress(near))) / (end - start)


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty, reach: int = 48, least: float = 0.55) -> list[tuple[int, int, str]]:
    """Candidates clear of ``taken`` whose context is sensitive and whose novelty is ``least`` or more."""
    if b"h" * 16 not in text.encode("utf-8", "surrogatepass").translate(_RUN):
        return []
    low = text.lower()
    if not any(x in low for x in _SENSITIVE_HINTS):
        return []
    out = []
    ends: list[int] = []
    top = 0
    for _, e, _ in taken:
        ends.append(top := max(top, e))
    starts = [s for s, _, _ in taken]
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        before = bisect.bisect_left(starts, end)
        if before and ends[before - 1] > start:
            continue
        string = m[0]
        if not (any(c.isdigit() for c in string) and any(c.isalpha() for c in string)):
            continue
        if SENSITIVE.search(text, max(0, start - reach), start) and novelty(text, start, end) >= least:
            out.append((start, end, "novel"))
    return out


def scan(docs: DataFrame, text_col: str = "text", least: float = 0.55, reach: int = 48, masked: bool = False) -> DataFrame:
    """Adds n_assign, n_access, n_hex, n_spans, base_sha256 and spans (and masked: the text without its secrets).

    Spans are ``kind:start:end`` by start and then kind, joined by commas; base_sha256 is the
    digest of the base ones alone.  In ``masked`` each run of touching spans is one [SECRET].
    """
    names = ["n_assign", "n_access", "n_hex", "n_spans", "base_sha256", "spans", *["masked"] * masked]
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    types = [pa.int64()] * 4 + [pa.string()] * (2 + masked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch, rows = whole.slice(low, 512), []
                for text in batch[text_col].to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    spans = sorted(base + novel_spans(text, base, novelty, reach, least), key=lambda x: (x[0], KINDS.index(x[2])))
                    counts = [sum(x[2] == kind for x in base) for kind in KINDS[:3]]
                    row = [*counts, len(spans), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)]
                    rows.append(row + [_masked(text, spans)] * masked)
                new = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), *new], [*(f.name for f in kept), *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    added = "n_assign long, n_access long, n_hex long, n_spans long, base_sha256 string, spans string" + ", masked string" * masked
    return docs.select(*[f"`{f.name}`" for f in kept], *[f"`{text_col}`"] * (text_col.lower() in names)).mapInArrow(freeing(run), f"{schema}, {added}" if schema else added)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _masked(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``scan`` with the masked text."""
    return scan(docs, text_col, masked=True)
