"""Collocations against the definition, summaries against their guarantee, and exact arithmetic beyond 64 bits."""

import random
import re
from collections import Counter
from itertools import pairwise

import duckdb
import numpy as np
import pytest

from tidemark.llm import collocations as co
from tidemark.llm.queries import QUERIES


def brute(rows, threshold, top=2000):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 6):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    frequent = {k: v for k, v in f.items() if v >= threshold}
    longer = Counter()
    for (lang, words), v in frequent.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                key = lang, words[i : i + m]
                longer[key] = max(longer[key], v)
    out = {}
    for (lang, words), a in frequent.items():
        if len(words) > 1 and 100 * longer[lang, words] < 100 * a:
            score, k = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, rank): (p.decode(), -a, le, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, le, r) in enumerate(sorted(found)[:top], 1)}


def result(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def some_rows(seed=2, n=500):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "New", "new", "York", "city", "état", "ÉTAT", "a\x1cb", "x" * 30]
    marks = [" ", " ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "! ", "\x0b"]
    rows = [(i, "".join(rnd.choice(words) + rnd.choice(marks) for _ in range(rnd.randrange(40))), rnd.choice(["en", "de", None, ""])) for i in range(n)]
    rows += [(i, "one passage that many documents share, word by word", "en") for i in range(60)]
    return [*rows, (7, None, "en"), (None, "new york new york", "en"), (8, "", "fr"), (9, ".,;", "fr"), (7, "new york", "en"), (7, "new york", "en")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as words", "'x' as phrase", "2 as n", "'y' as part")


@pytest.mark.parametrize("threshold", [5, 60])
def test_by_the_definition(spark, threshold):
    rows = some_rows()
    assert result(co.collocations(frame(spark, rows), threshold)) == brute(rows, threshold)


def test_small_blocks_summaries_and_full_bitmaps(spark, monkeypatch):
    """Every bound at work: texts in parts, many summaries, counters beyond the capacity, a bitmap of few bits."""
    rows = [*some_rows(4, 300), (600, "new york city, " * 300 + "of the new york", "en")]
    for name, value in (("BLOCK", 200), ("OCCURRENCES", 50), ("PENDING", 40), ("BITS", 8)):
        monkeypatch.setattr(co, name, value)
    monkeypatch.setattr(co, "range_bits", lambda mass: 3)
    assert result(co.collocations(frame(spark, rows).repartition(3), 8)) == brute(rows, 8)


def test_first_rows_of_each_lang_only(spark):
    rows = some_rows(6)
    assert result(co.collocations(frame(spark, rows), 5, top=7)) == brute(rows, 5, top=7)


def test_an_empty_table(spark):
    assert co.collocations(frame(spark, [])).count() == 0
    assert co.collocations(frame(spark, [(1, None, None)])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_frequent_keys_survive_in_little_space(seed):
    rnd = np.random.default_rng(seed)
    keys = rnd.zipf(1.3, 60_000).astype(np.uint64)
    threshold = 100
    summary = co.MisraGries(len(keys), threshold, pending=500)
    most = 0
    for part in np.array_split(keys, 200):
        summary.add(*co.counted(part))
        most = max(most, sum(map(len, summary.keys)))
    want, n = np.unique(keys, return_counts=True)
    assert set(want[n >= threshold].tolist()) <= set(summary.survivors().tolist())
    assert summary.taken < threshold and most <= summary.capacity + 500 + 300


def test_merged_in_any_grouping():
    rnd = np.random.default_rng(1)
    keys = rnd.integers(0, 3000, 40_000).astype(np.uint64) ** 2 // 3000
    for pieces in (3, 50):
        summary = co.MisraGries(len(keys), 50, pending=1000)
        for part in np.array_split(keys, pieces):
            summary.add(*co.counted(part))
        want, n = np.unique(keys, return_counts=True)
        assert set(want[n >= 50].tolist()) <= set(summary.survivors().tolist())


def test_hashes_follow_the_words():
    one, two = co.Block.of([b"Ab c  d, e", b"", b"x\ty"]), co.Block.of([b"zz zz ab c d"])
    assert [one.data[a:b] for a, b in zip(one.starts, one.ends, strict=True)] == [b"ab", b"c", b"d", b"e", b"x", b"y"]
    assert one.text.tolist() == [0, 0, 0, 0, 2, 2] and [a == b for a, b in pairwise(one.piece.tolist())] == [True, True, False, False, True]
    seeds = np.zeros(3, np.uint64)
    h, g = one.word_hashes(0, seeds), two.word_hashes(0, seeds[:1])
    assert h[:3].tolist() == g[2:].tolist() and len(set(h.tolist())) == 6
    (_, _, all_words), (_, pair, at) = co.phrases_of(h, one.piece, 2, [])
    assert pair[0] == list(co.phrases_of(g, two.piece, 2, []))[1][1][2] and at.tolist() == [0, 1, 4] and len(all_words) == 6
    assert one.word_hashes(0, seeds + np.uint64(5))[0] != h[0]


def test_phrases_with_a_rare_word_or_pair_are_left_out():
    block = co.Block.of([b"a b c d"])
    h = block.word_hashes(0, np.zeros(1, np.uint64))

    def only(hashes):
        data = bytearray(1 << 17)
        for at in (hashes >> np.uint64(44)).tolist():
            data[at >> 3] |= 1 << (at & 7)
        return co.Bitmap(20, bytes(data))

    found = lambda *maps: [at.tolist() for _, _, at in co.phrases_of(h, block.piece, 4, list(maps))]
    assert found() == [[0, 1, 2, 3], [0, 1, 2], [0, 1], [0]]
    assert found(only(h[:3])) == [[0, 1, 2], [0, 1], [0], []]
    pairs = list(co.phrases_of(h, block.piece, 2, []))[1][1]
    assert found(only(h), only(pairs[1:])) == [[0, 1, 2, 3], [1, 2], [1], []]


@pytest.mark.parametrize(("gap", "most"), [(1000, 5), (1000, 10**6), (1 << 40, 5), (1 << 40, 10**6)])
def test_packing_round_trip(gap, most):
    rng = np.random.default_rng(gap)
    start = 3 << 44
    keys = np.unique(rng.integers(0, min(gap * 50, 1 << 44), 50).astype(np.uint64)) + np.uint64(start)
    counts = rng.integers(1, most, len(keys))
    got = co.unpacked(co.packed_keys(keys, start), co.packed_counts(counts), start)
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == counts.tolist()


def test_equal_hashes_are_told_apart():
    one, two = (np.array(x, np.uint64) for x in ([5, 7, 5, 5, 7], [1, 2, 1, 3, 2]))
    which, often = co.distinct(one, two)
    assert sorted((int(one[k]), int(two[k]), int(n)) for k, n in zip(which, often, strict=True)) == [(5, 1, 2), (5, 3, 1), (7, 2, 2)]


def test_products_beyond_64_bits(spark):
    a, n, length = 3 * 10**12, 7 * 10**15, 4 * 10**12
    phrases = spark.createDataFrame([("en", 1, "p", length), ("en", 1, "q", length + 1), ("en", 2, "p q", a)], "lang string, words int, phrase string, f long")
    (row,) = co.scored(phrases, spark.createDataFrame([("en", n)], "lang string, n long")).collect()
    assert (row.score, row.l, row.r) == (1000 * a * n // (length * (length + 1)), length, length + 1)


def test_same_as_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    rel = con.execute(co.ORACLE_SQL)
    names = [c[0] for c in rel.description]
    want = sorted(rel.fetchall())
    assert sorted(tuple(r) for r in QUERIES["op13_phrase_collocations"](spark, folder).select(*names).collect()) == want and want
