"""Encoders against the tokenizers library on texts that are hard to cut."""

import random
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, token_counts
from tidemark.llm.packing import ChunkIds
from tidemark.llm.token_counts import Merges, PieceCounts, merged_count

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a\x1cb  c", "a\x85b", " lead", "trail ", "x\n\ny", "x<|endoftext|>y <|endoftext|> z", "İΣΑΣ don't 12²Ⅷ", "é <|startoftext|≯q", "<|endoftext|≯", "\r\nq\n r\n", "日本語 テスト 한국어 🤖🤖", "\n", "a \n", "x \xa0y", "a" * 5000]
TEXT = st.lists(st.sampled_from([*"ab c\n\t '.<|é²1\x1c\x85\xa0\u0301", "'ll", "<|endoftext|>"]), max_size=16).map("".join)


@pytest.fixture(scope="module")
def tools():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS), PieceCounts(Merges(BYTES)), bpe.WordBpe(WORDS), ChunkIds(WORDS)


def same(tools, text):
    byte_library, word_library, counts, coder, known = tools
    assert counts.of(text) == len(byte_library.encode(text, add_special_tokens=False).ids)
    ids = word_library.encode(text, add_special_tokens=False).ids
    assert [i for c in bpe.chunks(text) for i in coder.encode(c)] == ids
    assert coder.decode(ids) == word_library.decode(ids, skip_special_tokens=False)
    assert b"".join(known.encode([text])) == b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(tools, text):
    same(tools, text)


@settings(max_examples=1500, deadline=None)
@given(TEXT)
def test_random_texts(tools, text):
    same(tools, text)


@pytest.mark.parametrize("text", ["ab" * 150, "xyz" * 86 + "q", "語彙" * 50_000, "abcdefghij" * 20_000, "QUJDRA" * 30_000 + " tail"], ids=["300", "259", "cjk", "letters", "base64"])
def test_long_words_in_seconds(tools, text):
    coder, known = tools[3], tools[4]
    ids = tools[1].encode(text, add_special_tokens=False).ids
    began = time.process_time()
    assert [i for c in bpe.chunks(text) for i in coder.encode(c)] == ids
    assert time.process_time() - began < 20
    assert b"".join(known.encode([text])) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_heap_skips_stale_pairs():
    rank = {("a", "a"): 0, ("aa", "a"): 1, ("b", "aa"): 2}
    assert merged_count(list("aaaa"), rank) == 2 and merged_count(list("aaa"), rank) == 1 and merged_count(list("baab"), rank) == 2 and merged_count([], rank) == 0


def test_null_rows_and_clashing_columns(make_docs):
    from tidemark.llm.bpe import encode_and_decode
    from tidemark.llm.token_counts import count_tokens

    rows = [(1, None), (2, ""), (3, "word " * 20_000), (3, "word " * 20_000), (None, "é")]
    for f, path in ((count_tokens, BYTES), (encode_and_decode, WORDS)):
        got = sorted(((r.doc_id or 0, r.n_tokens) for r in f(make_docs(rows, extra=True), path).collect()))
        assert [i for i, _ in got] == [0, 1, 2, 3, 3] and got[1][1] == got[2][1] == 0 and got[3] == got[4] and got[3][1] >= 20_000
        assert f(make_docs([]), path).count() == 0


def test_words_found_in_chunks_and_chunks_that_are_words_share_one_table(tools):
    """In any order of meeting them: lower case that undoes NFC, contractions, final sigma, special strings."""
    library, coder = tools[1], tools[3]
    texts = ["its it's 's S'S 'S", "İstanbul i̇stanbul i̇ İ", "ΟΔΟΣ οδος οδοσ Σ ς", "<|endoftext|> a<|ENDOFTEXT|>b <| |> <|", "É É é é Ég ég", "ǰ J̌ ǰ", "x###y ### x y", "\x01\x7f a\x01 a"]
    for order in (texts, texts[::-1]):
        known, shown = ChunkIds(WORDS), bpe._Chunks(coder)
        for text in order:
            want = b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)
            assert b"".join(known.encode([text])) == want, text
            ids = library.encode(text, add_special_tokens=False).ids
            parts = [shown[c] for c in bpe.chunks(text)]
            assert sum(p[0] for p in parts) == len(ids) and "".join(p[1] for p in parts).split() == [str(i) for i in ids], text
            assert "".join(p[2] for p in parts)[:-1] == library.decode(ids, skip_special_tokens=False), text


def held_bytes(make):
    """Bytes that making a table takes, by Python's own account."""
    import gc
    import tracemalloc

    gc.collect()
    tracemalloc.start()
    table = make()
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    return table, used


@pytest.mark.parametrize("length", [2000, 60, 8])
def test_tables_are_bounded_in_bytes(monkeypatch, length):
    """Distinct chunks without spaces, more than the table may hold: what is kept stays below the bound."""
    rnd = random.Random(length)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz猫é") for _ in range(length)) for _ in range(50_000 if length == 8 else 3000)]
    monkeypatch.setattr(bpe, "TABLE_BYTES", 2 << 20)
    monkeypatch.setattr(token_counts, "TABLE_BYTES", 2 << 20)
    counts, coder = PieceCounts(Merges(BYTES)), bpe._Chunks(bpe.WordBpe(WORDS))
    for table in (counts, coder):
        _, used = held_bytes(lambda table=table: [table[w] for w in words] and None)
        assert used < 4 << 20 and table.held <= 2 << 20 and (len(table) == 0) == (length > table.LONG)
    library = Tokenizer.from_file(WORDS)
    for w in words[:20]:
        ids = library.encode(w, add_special_tokens=False).ids
        assert coder[w] == (len(ids), "".join(f"{i} " for i in ids), library.decode(ids, skip_special_tokens=False) + " ")


def made_words(seed, count, letters="abcdefghijklmnopqrstuvwxyz"):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(letters, k=rnd.randint(3, 14))) for _ in range(count)]


def test_words_merged_together_are_the_librarys(tools, monkeypatch):
    """Every width of rows, words cut by their chunks, special strings, unstable letters, tables without room."""
    library, coder = tools[1], tools[3]
    monkeypatch.setattr(bpe, "CELLS", 1 << 10)
    monkeypatch.setattr(bpe, "CHUNKS", 50)
    plain = made_words(1, 600) + ["ab" * n for n in (3, 5, 9, 20, 31, 32, 33)] + ["Σ猫é" * 20, "猫" * 64, "İ" * 64, "a" * 64]
    odd = made_words(2, 600, "abST'.,é²Σİ\u0301猫<|>7\x1c\x7f")
    texts = [*ODD, " ".join(plain), " ".join(odd), " ".join(plain + odd)[:5000], "<|endoftext|>" + " x<|endoftext|>y" * 3]
    for table_bytes in (160 << 20, 100_000, 0):
        monkeypatch.setattr(bpe, "TABLE_BYTES", table_bytes)
        for order in (texts, texts[::-1]):
            known = bpe._Chunks(coder)
            for text, cut in zip(order, bpe.learnt(order, known), strict=True):
                ids = library.encode(text, add_special_tokens=False).ids
                parts = [known[c] for c in cut]
                assert sum(p[0] for p in parts) == len(ids) and "".join(p[1] for p in parts).split() == [str(i) for i in ids], text
                assert "".join(p[2] for p in parts)[:-1] == library.decode(ids, skip_special_tokens=False), text
            assert known.held <= max(table_bytes, 1000) and (table_bytes < 160 << 20 or plain[0] in known)


def test_new_words_cost_less_than_one_by_one(tools):
    """Texts of words that no table knows: at most six tenths of the time of merging each by itself."""
    coder, texts = tools[3], [" ".join(made_words(seed, 1000)) for seed in range(40)]

    def seconds(cut_texts):
        known = bpe._Chunks(coder)
        began = time.process_time()
        made = [[known[c] for c in cut] for cut in cut_texts(known)]
        return time.process_time() - began, made

    together, got = min((seconds(lambda known: bpe.learnt(texts, known)) for _ in range(3)), key=lambda x: x[0])
    alone, want = min((seconds(lambda known: map(bpe.chunks, texts)) for _ in range(3)), key=lambda x: x[0])
    assert got == want and together < 0.6 * alone, (together, alone)
