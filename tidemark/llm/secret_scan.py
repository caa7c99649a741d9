"""Secret scans: fixed patterns, and strings in a sensitive context that do not compress.

Some strings look like secrets only by being nothing else: no word, no identifier, no repeat of
what stands around them.  Each candidate near a sensitive word is measured by the bytes that it
adds to zstandard's output, the compressor being primed with the identifiers of the whole corpus
and given the text before and after the candidate.  A name made of known words costs a few
references; a random key costs nearly its length, and is reported.

The dictionary holds the words (letters and underscores) of most documents, counted over all of
them; it has at most DICTIONARY_WORDS words of at most 24 characters, so it may go to every task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, slices, small_batches

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words of which one occurs in each match of ASSIGN.
_ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words after which a string may be a secret.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "credential", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "private_key", "bearer", "authorization")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE | re.ASCII)
#: A candidate: at least 16 characters of keys and codes, digits and letters among them.
_CANDIDATE = re.compile(r"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}")
_START = re.compile(r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z0-9+/_=-])")
#: It starts within REACH characters after the word, on the same line.
REACH = 48
#: Characters before and after a candidate that it is measured against.
AROUND = 512
#: Reported are candidates that add at least this share of their length in compressed bytes.
NOVELTY = 0.7
#: Words of the dictionary, and characters of a word at most.
DICTIONARY_WORDS, WORD = 4096, 24
_WORD = re.compile(rb"[A-Za-z_]{3,24}").fullmatch
#: Words that a task counts before it hands its counts on.
COUNTED = 400_000
KINDS = ("assign", "access", "hex", "novel")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    novelty: int


class Novelty:
    """Compressed bytes that a string adds where it stands."""

    def __init__(self, words: list[str]) -> None:
        # The commonest words come last, where references to them are shortest.
        primed = zstandard.ZstdCompressionDict(" ".join(reversed(words)).encode() or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        level = 12
        primed.precompute_compress(level=level)
        self.size = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def added(self, text: str, start: int, end: int) -> int:
        """Of text[start:end]; its other occurrences around it are taken out first, for a copied secret is one still."""
        found = text[start:end]
        before, after = (part.replace(found, "") for part in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))
        return max(0, len(self.size((before + found + after).encode())) - len(self.size((before + after).encode())))


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost, non-overlapping within a kind, failing matches dropped.

    low: the text in lower case, which tells quickly that no ASSIGN is in it.
    """
    out = []
    if any(w in low for w in _ASSIGNED):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Strings near a sensitive word, each once, in their order."""
    last = -1
    for m in _SENSITIVE.finditer(text):
        line = text.find("\n", m.end(), m.end() + REACH)
        for start in _START.finditer(text, m.end(), line if line >= 0 else m.end() + REACH):
            if start.start() > last and (c := _CANDIDATE.match(text, start.start())):
                last = c.start()
                yield c.span()


def spans(text: str, novelty: Novelty) -> list[Span]:
    """Base spans, and candidates outside of them that add NOVELTY of their length; all with what they add."""
    low = text.lower()
    base = base_spans(text, low)
    out = [Span(a, kind, b, novelty.added(text, a, b)) for a, kind, b in base]
    if any(w in low for w in SENSITIVE):
        k, reached = 0, 0
        for a, b in candidates(text):
            while k < len(base) and base[k][0] < b:
                reached = max(reached, base[k][2])
                k += 1
            if a >= reached and (n := novelty.added(text, a, b)) >= NOVELTY * (b - a):
                out.append(Span(a, 3, b, n))
    return sorted(out)


def dictionary(docs: DataFrame) -> list[str]:
    """The words of most documents, commonest first, ties in order; counted over whole texts of all rows.

    A document counts a word once, a very long one once a slice.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            kept = [(w, n) for w, n in seen.items() if _WORD(w)]
            seen.clear()
            return batch_of([("word", pa.string()), ("n", pa.int64())], [w.decode() for w, _ in kept], [n for _, n in kept])

        for b in small_batches(batches, 256):
            for text in b.column(0).cast(pa.binary()):
                for piece in slices(text.as_py()):
                    seen.update(w for w in set(piece.split()) if len(w) <= WORD)
                if len(seen) > COUNTED:
                    yield told()
        yield told()

    words = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(counts, "word string, n long")
    most = words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS)
    return [r.word for r in most.collect()]  # at most DICTIONARY_WORDS rows


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, found: array of (kind, start, end, novelty), in code points, for every row.

    Null and empty texts have none; each input row gives one row, whatever its id or further
    columns; an empty table gives an empty one.  novelty is the number of compressed bytes that
    the span adds, of base spans too.
    """
    words = dictionary(docs)
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for b in small_batches(batches, 256):
            found = [[{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "novelty": s.novelty} for s in spans(t.as_py(), novelty)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kinds)], names=["doc_id", "found"])

    kept = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.mapInArrow(rows, "doc_id long, found array<struct<kind:string,start:int,end:int,novelty:int>>")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, all spans as text, and the bytes that each adds."""
    found = F.col("found")
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    listed = lambda c: F.array_join(F.transform(c, shown), ",")
    n = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(found, lambda x: x["kind"] != "novel")
    return scan(docs).select("doc_id", *[n(k) for k in KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(found).alias("spans"), F.array_join(F.transform(found, lambda x: x["novelty"].cast("string")), ",").alias("novelty"))


def redact(docs: DataFrame) -> DataFrame:
    """The columns of docs, every span of a text replaced by its kind in brackets; of overlapping spans the first, then the longer."""
    words = dictionary(docs)
    where = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(words)
        for b in small_batches(batches, 256):
            texts = [None if t is None else hidden(t, spans(t, novelty)) for t in b.column(where).to_pylist()]
            yield b.set_column(where, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(rows, docs.schema)


def hidden(text: str, found: list[Span]) -> str:
    out, at = [], 0
    for s in sorted(found, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{KINDS[s.kind]}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]

