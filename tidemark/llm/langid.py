"""Language identification by nearest centroid.

A text becomes a vector of hashed character 2- and 3-grams weighted by TF-IDF and scaled to
length one; only letters count, all else is a gap between words.  Each language has several
centroids, found by spherical k-means on a bounded sample of labelled texts.  A text gets the
language of the centroid of the largest cosine.  It is rejected where its distance, one minus
that cosine, is beyond what the language's own training texts have: these and pieces of them are
measured against the language's centroids, by class of length, since short texts lie farther
from any centroid than long ones.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize, small_batches

#: Hashed n-grams: the length of every vector.
FEATURES = 8192
#: Labelled texts a language is learned from, at most; the bound of all that training gathers.
SAMPLE = 400
CENTROIDS = 3
#: A text is rejected where its cosine is below MARGIN times this quantile of those of training texts of its length.
QUANTILE, MARGIN = 0.001, 0.8
#: Classes of length: powers of two of the number of different n-grams.  A class that fewer than SEEN training texts show takes the limit of the class below.
CLASSES, SEEN = 14, 20
UNKNOWN = "und"
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_SHIFT = np.uint32(32 - 13)


def _letter(code: int) -> int:
    """The lower-case letter of a code, or a space for what is no letter."""
    return ord(c.lower()[0]) if (c := chr(code)).isalpha() else 32


@functools.lru_cache(1)
def _table() -> np.ndarray:
    return np.array([_letter(k) for k in range(1 << 16)], np.uint32)


def _codes(text: str) -> np.ndarray:
    """Lower-case letters with spaces for all else."""
    if text.isascii() or max(text) < "\U00010000":
        return _table()[np.frombuffer(f" {text} ".encode("utf-16-le", "surrogatepass"), "<u2")]
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    seen, at = np.unique(codes, return_inverse=True)
    return np.array([_letter(k) for k in seen.tolist()], np.uint32)[at]


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    codes = _codes(text)
    gap = codes == 32
    codes = codes[~(gap & np.append(False, gap[:-1]))]
    if len(codes) < 3:
        return np.zeros(FEATURES, np.int64)
    pairs = codes[:-1] * _A ^ codes[1:] * _B
    triples = pairs[:-1] * _B ^ codes[2:] * _C
    mixed = np.concatenate([pairs * _C, triples * _A])
    return np.bincount(mixed >> _SHIFT, minlength=FEATURES)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """A row of length one for each text (zeros for a text without weighted n-grams)."""
    rows = np.array([counts(t) for t in texts], np.float32).reshape(len(texts), FEATURES)
    np.log1p(rows, out=rows)
    rows *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    rows /= np.where(norm > 0, norm, 1)[:, None]
    return rows


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k unit centroids; the first is the row nearest the mean, each next the row farthest from those before."""
    mean = rows.mean(0)
    chosen = [int(np.argmax(rows @ mean))]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin((rows @ rows[chosen].T).max(1))))
    centroids = rows[chosen]
    for _ in range(rounds):
        nearest = np.argmax(rows @ centroids.T, axis=1)
        sums = np.array([rows[nearest == c].sum(0) if (nearest == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]
    return centroids.astype(np.float32)


def length_classes(rows: np.ndarray) -> np.ndarray:
    """For each vector its class of length."""
    return np.minimum(CLASSES - 1, np.log2(np.maximum(1, np.count_nonzero(rows, axis=1))).astype(np.int64))


def pieces(text: str) -> list[str]:
    """The text, and a piece of it of each length that is a power of two from 16 on; places depend on its length alone."""
    sizes = [1 << k for k in range(4, 15) if 1 << k < len(text)]
    starts = [len(text) * 2654435761 % (len(text) - n) for n in sizes]
    return [text, *[text[a : a + n] for a, n in zip(starts, sizes, strict=True)]]


def limits(texts: list[str], idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The least cosine that is accepted, by class of length: near the least that training texts have."""
    cosines, classes = [], []
    for begin in range(0, len(texts), 32):
        rows = vectors([p for t in texts[begin : begin + 32] for p in pieces(t)], idf)
        cosines.append((rows @ centroids.T).max(1))
        classes.append(length_classes(rows))
    cosine, of = np.concatenate(cosines), np.concatenate(classes)
    out, last = np.zeros(CLASSES), 0.0
    for c in range(CLASSES):
        if (of == c).sum() >= SEEN:
            last = max(last, MARGIN * float(np.quantile(cosine[of == c], QUANTILE)))
        out[c] = last
    return out


@dataclass
class Model:
    """limits: a row for each language, its least accepted cosines by class of length."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and acceptance of each text."""
        said, scores, kept = [], [], []
        for begin in range(0, len(texts), 256):
            part = texts[begin : begin + 256]
            rows = vectors(part, self.idf)
            near = rows @ self.centroids.T if len(self.owner) else np.zeros((len(part), 0))
            for text, row, length in zip(part, near, length_classes(rows), strict=True):
                if not len(row) or not has_letter(text):
                    said.append(UNKNOWN)
                    scores.append(0.0)
                    kept.append(False)
                    continue
                best = int(np.argmax(row))
                language = int(self.owner[best])
                said.append(self.languages[language])
                scores.append(float(min(max(row[best], 0.0), 1.0)))
                kept.append(bool(row[best] > 0 and row[best] >= self.limits[language, length]))
        return said, scores, kept


def held_out(doc_id: str = "doc_id"):
    """Documents kept out of training: crc32 of the id as text, modulo 3, is 1; null ids train nothing either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from text and lang of at most `sample` documents of each language, those of the smallest id hash.

    An id that repeats gives one text, the one of the smallest hash.  Documents are chosen by id
    and language alone, then only their texts are kept.  Ids are first thinned by a threshold on
    their hash that leaves a few times `sample` of each language, whatever the number of rows.
    The driver gets n-gram weights and centroids, never texts.
    """
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    place = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids"))
    thinned = labelled.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(place * F.col("ids") <= 4.0 * sample)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = thinned.select("doc_id", "lang").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample)
    # At most `sample` ids of each language go to all tasks, so that no text is shuffled for a row that is not chosen.
    texts = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"], "left_semi")
    texts = texts.groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one")).select("lang", F.col("one.text").alias("text"))
    texts = materialize(texts, "sample")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                seen += counts(text) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(seen, n))], names=["gram", "n"])

    sums = texts.select("text").mapInArrow(present, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(FEATURES + 1)
    for r in sums:
        df[r.gram] = r.n
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1).astype(np.float32)

    def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = spherical_kmeans(vectors(group["text"].tolist(), idf), centroids)
        least = limits(group["text"].tolist(), idf, found).tolist()
        return pd.DataFrame({"lang": key[0], "centroid": [c.tobytes() for c in found], "limits": [least] * len(found)})

    learned = texts.groupBy("lang").applyInPandas(learn, "lang string, centroid binary, limits array<double>").collect()
    languages = sorted({r.lang for r in learned})
    least = {r.lang: r.limits for r in learned}
    learned = sorted(learned, key=lambda r: (r.lang, bytes(r.centroid)))
    return Model(
        languages, idf, np.array([np.frombuffer(r.centroid, np.float32) for r in learned], np.float32).reshape(-1, FEATURES),
        np.array([languages.index(r.lang) for r in learned], np.int64), np.array([least[x] for x in languages]).reshape(-1, CLASSES),
    )


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row; only the text is looked at.

    `und`, score 0 and not accepted: a null text, one without a letter, or any text if nothing
    could be learned.  Repeated rows, null ids and further columns are no matter.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            said, scores, kept = told.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(made, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def keep_known_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows whose text is in a known language; columns and texts stay as they are."""
    told = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        return pd.Series(told.value.predict(["" if t is None else t for t in texts])[2])

    return docs.where(accepted(F.col("text")))
