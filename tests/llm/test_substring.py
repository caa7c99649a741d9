import hashlib
import random

import duckdb
import numpy as np

from tidemark.llm import substring as sub


def brute(rows):
    """For (doc_id, text) rows: the digests, by a table of all windows."""
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - 49):
            if i is not None:
                key = tuple(w[p : p + 50])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and least[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str)


def test_cover_gives_every_difference():
    assert {(a - b) % sub.PERIOD for a in sub.COVER for b in sub.COVER} == set(range(sub.PERIOD))


def test_passages_at_all_offsets(spark, make_docs):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefghij") + rnd.choice("abcdefghij") + rnd.choice("xyz")
    passage = [word() for _ in range(70)]
    rows = []
    for k in range(66):
        n = (50, 49, 70, 60, 51)[k % 5]
        at = rnd.randrange(0, 71 - n)
        rows.append((k, " ".join([word() for _ in range(k)] + passage[at : at + n] + [word() for _ in range(rnd.randrange(40))])))
    rows += [(200, "same " * 300), (201, "same " * 120), (5, "same " * 60), (None, rows[0][1]), (300, rows[2][1]), (300, rows[2][1]), (300, "other " + rows[4][1])]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "é b c")]
    assert got(sub.digest(make_docs(rows, extra=True))) == brute(rows)


def test_a_crowded_bitmap_changes_nothing(spark, sample, monkeypatch):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(sub.digest(docs)) == want
    monkeypatch.setattr(sub.repeated_windows, "__defaults__", (14,))
    assert got(sub.digest(docs)) == want


def test_sql_says_the_same(spark, sample):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sample}/documents.parquet'")
    assert got(sub.digest(spark.read.parquet(f"{sample}/documents.parquet"))) == sorted([tuple(r) for r in con.execute(sub.ORACLE_SQL).fetchall()], key=str)


def test_empty_table(make_docs):
    assert sub.digest(make_docs([])).count() == 0


def test_removal_keeps_rows_columns_and_white_space(spark, make_docs):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, "lead\n\nin  " + text + "\n tail  end"), (3, None), (4, "short"), (None, text)]
    df = make_docs(rows, extra=True).withColumnRenamed("found", "starts")
    out = sub.remove_repeats(df)
    assert out.columns == df.columns
    said = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert said[1][0] == text and said[2] == ("lead\n\nin\n tail  end", 19) and said[3][0] is None and said[4][0] == "short" and said[None][0] == text
    assert sub.cut_text(text, np.array([0, 10])) == ""


def test_runs_tell_the_order_of_words_and_small_ranges_change_nothing(spark, sample, monkeypatch):
    w = sub.Windows()
    runs = {}
    for words in ([b"a", b"b", b"c"], [b"b", b"a", b"c"], [b"x", b"a", b"b", b"c"]):
        hashed = w.words(words)
        at = np.array([len(words) - 3])
        runs[tuple(words)] = [int(w.runs(w.prefixes(hashed, k), at, 3, k)[0]) for k in (0, 1)]
    one, turned, moved = runs.values()
    assert one == moved and one[0] != turned[0] and one[1] != turned[1]
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    monkeypatch.setattr(sub, "RANGE", 16)
    assert got(sub.digest(docs)) == want
