"""Secret scans: base spans by the plain patterns, novelty on planted keys and on names of known words."""

import hashlib
import random
import re
import string

import pytest

from tidemark.llm import secret_scan
from tidemark.llm.queries import QUERIES

PATTERNS = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
FITS = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
NAMES = "connection timeout seconds user config value account name public static return string client server request response service provider handler storage default session identity access management refresh rotate update index number".split()


def plain(text):
    found = [(m.start(), list(PATTERNS).index(k), k, m.end()) for k, p in PATTERNS.items() for m in p.finditer(text) if FITS[k](m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def check(texts, rows):
    for r in rows:
        base = plain(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, *_ in base) for kind in PATTERNS)
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [x for x in every if not x.startswith("novel")] == listed
        places = [(int(a), secret_scan.KINDS.index(k)) for k, a, _ in (x.split(":") for x in every)]
        assert places == sorted(places)
        assert len(r.novelty.split(",")) == len(every) or not every


def test_base_spans_of_the_table(spark):
    sample = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}
    rows = QUERIES["op11_secret_scan"](spark, sample).collect()
    check(texts, rows)
    assert len(rows) == len(texts) and sum(r.n_assign for r in rows) > 0


def test_random_texts(spark, make_docs):
    rnd = random.Random(3)
    bits = ["token", "SECRET", "Api_Key", "apikey", "paßword", "password", "ſecret", "toKen", " ", "  ", "=", ":", '"', "'", "abcdef0123456789", "AKIA", "AKIA12", "ABCDEFGH1234", "é", "\n", "x.y-z", "0" * 31, "f", "token=token=abcdefgh", "token: secret: abcdefgh"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(25)))) for i in range(400)] + [(400, None), (401, ""), (401, ""), (402, "token = " + "a1" * 200_000), (403, " ".join(["token"] * 50_000))]
    texts = dict(rows)
    got = secret_scan.digest(make_docs(rows, extra=True)).collect()
    assert len(got) == len(rows)
    check(texts, got)


def test_an_empty_table(spark, make_docs):
    assert secret_scan.digest(make_docs([])).count() == 0


@pytest.fixture(scope="module")
def novelty():
    return secret_scan.Novelty(NAMES)


def wrapped(found):
    return f"public static string handler(request) {{\n  // bearer {found} of the service\n  return response;\n}}"


def test_keys_are_novel_and_names_are_not(novelty):
    rnd = random.Random(8)
    keys = ["".join(rnd.choice(al) for _ in range(n)) + "x7" for al, n in [("0123456789abcdef", 26), (string.ascii_letters + string.digits, 18), (string.ascii_letters + string.digits + "+/", 40)] for _ in range(60)]
    names = ["_".join(rnd.sample(NAMES, 4)) + "_v2" for _ in range(60)]
    novel = lambda x: [s for s in secret_scan.spans(wrapped(x), novelty) if s.kind == 3]
    for key in keys:
        (s,) = novel(key)
        assert wrapped(key)[s.start : s.end] == key and s.novelty >= secret_scan.NOVELTY * len(key)
    assert not any(map(novel, names))
    # A secret that stands there twice is one still; without a sensitive word near it is left alone.
    twice = wrapped(keys[70] + " and token " + keys[70])
    assert sum(s.kind == 3 for s in secret_scan.spans(twice, novelty)) == 2
    assert not secret_scan.spans(keys[70], novelty) and not secret_scan.spans("bearer " + " " * 60 + keys[70], novelty) and not secret_scan.spans("bearer\n" + keys[70], novelty)


def test_known_identifiers_lower_the_measure(novelty):
    name = "connection_timeout_seconds_4_storage"
    bare = secret_scan.Novelty([])
    text = wrapped(name)
    at = text.index(name)
    assert novelty.added(text, at, at + len(name)) < bare.added(text, at, at + len(name))


def test_base_spans_hide_candidates(novelty):
    text = 'token = "a8Kd72hsLq93PzRt55"'
    assert [(secret_scan.KINDS[s.kind], s.start, s.end) for s in secret_scan.spans(text, novelty)] == [("assign", 0, 27)]
    assert secret_scan.hidden(text, secret_scan.spans(text, novelty)) == '[assign]"'


def test_dictionary_counts_all_documents(spark, make_docs, monkeypatch):
    rows = [(i, "shared word_%s zz" % "abcdefghij"[i % 10] + " shared 12ab " + "q" * 30) for i in range(50)]
    monkeypatch.setattr(secret_scan, "COUNTED", 5)
    assert secret_scan.dictionary(make_docs(rows)) == ["shared", *[f"word_{c}" for c in "abcdefghij"]]


def test_redaction_keeps_columns(spark, make_docs):
    docs = make_docs([(1, "key AKIA" + "A1" * 8 + "!"), (2, None)])
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {1: "key [access]!", 2: None}
