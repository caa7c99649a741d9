import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert {r.doc_id for r in rows} == set(truth) and len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert set(r.lang_pred for r in rows) <= set(truth.values())
    out = [r for r in rows if r.held_out]
    print("accuracy", np.mean([r.lang_pred == truth[r.doc_id] for r in out]), "accepted", np.mean([r.accepted for r in out]))
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.98
    assert np.mean([r.accepted for r in out]) > 0.99


#: Sentences in languages that the test documents do not have, and noise of the keyboard.
UNKNOWN = [
    "La vita è bella quando il sole splende sulla città e i bambini giocano nel parco con i loro amici",
    "Het is vandaag mooi weer en wij gaan met de hele familie naar het strand om te zwemmen",
    "Tänään on kaunis päivä ja menemme koko perheen kanssa rannalle uimaan ja syömään jäätelöä",
    "A vida é bela quando o sol brilha sobre a cidade e as crianças brincam no parque com os seus amigos",
    "Dzisiaj jest piękna pogoda i idziemy z całą rodziną na plażę popływać w morzu",
    "Bugün hava çok güzel ve bütün aile ile birlikte denize gidip yüzeceğiz",
    "asdf jkl qwer uiop zxcv asdfgh hjkl poiu mnbv qazwsx edcrfv tgbyhn",
]


def test_unknown_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    assert not any(model.predict(UNKNOWN)[2])
    # Pieces of known texts are accepted at every length.
    texts = [r.text for r in docs.where("doc_id % 7 = 0").collect()]
    assert np.mean(model.predict([p for t in texts for p in langid.pieces(t)])[2]) > 0.99


@pytest.mark.parametrize("left", ["de", "es", "fr"])
def test_a_language_left_out_of_training_is_rejected(spark, left):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs, langid.train(docs.where(F.col("lang") != left))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([not r.accepted for r in rows if r.lang == left]) >= 0.9
    assert np.mean([r.accepted for r in rows if r.lang != left]) >= 0.99


def test_limits_rise_with_length_and_follow_the_texts():
    rnd = np.random.default_rng(5)
    words = ["".join(rnd.choice(list("abcdefgh"), 4)) for _ in range(40)]
    texts = [" ".join(rnd.choice(words, n)) for n in (5, 20, 80, 300) for _ in range(40)]
    idf = np.ones(langid.FEATURES, np.float32)
    centroids = langid.spherical_kmeans(langid.vectors(texts, idf), 2)
    least = langid.limits(texts, idf, centroids)
    assert (np.diff(least) >= 0).all() and least[-1] > 0
    cosine = (langid.vectors(texts, idf) @ centroids.T).max(1)
    classes = langid.length_classes(langid.vectors(texts, idf))
    assert (cosine >= least[classes] * 0.99).mean() > 0.99
    assert langid.pieces("x" * 10) == ["x" * 10] and [len(p) for p in langid.pieces("y" * 100)] == [100, 16, 32, 64]


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(1)
    other = docs.withColumn("lang", langid.F.when(langid.held_out(), langid.F.lit("xx")).otherwise(docs["lang"]))
    a, b = (sorted(tuple(r) for r in langid.identify(d).collect()) for d in (docs, other))
    assert [r[:3] for r in a] == [r[:3] for r in b]


def test_edge_rows(spark, make_docs):
    rows = [(k, t) for k, t in enumerate(["the cat and the dog", "the bird and the cat sat", "der hund und die katze", "die katze und der vogel"] * 6)]
    df = spark.createDataFrame([(i, t, "en" if "the" in t else "de", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = [(100, None), (101, ""), (102, "123 !?"), (103, "the dog and the cat " * 5000), (None, "und die katze"), (104, "und die katze"), (104, "und die katze"), (105, "猫と犬")]
    model = langid.train(df)
    out = langid.predict(make_docs(odd, extra=True), model).collect()
    said = {r.doc_id: (r.lang_pred, r.accepted) for r in out}
    assert len(out) == len(odd)
    assert [said[k][0] for k in (100, 101, 102)] == ["und"] * 3 and said[103][0] == "en" and said[104] == ("de", True) and said[None][0] == "de"
    assert said[105][0] in ("en", "de") and not said[105][1]
    kept = langid.keep_known_languages(make_docs(odd, extra=True), model)
    assert kept.columns == make_docs(odd, extra=True).columns
    assert {r.doc_id for r in kept.collect()} == {103, 104, None}
    assert langid.identify(make_docs([])).count() == 0
    assert {r.lang_pred for r in langid.identify(make_docs([(1, "no labels here")])).collect()} == {"und"}


def test_repeated_ids_keep_the_sample_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "materialize", lambda df, name: seen.append(df.collect()) or df)
    rows = [(0, f"the cat number {k}", "en") for k in range(900)] + [(k, f"der hund {k}", "de") for k in range(3, 300)] + [(k, "le chat", "fr") for k in range(6)]
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50)
    trained = [r.lang for r in seen[0]]
    held = lambda ids: sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in ids)
    assert trained.count("en") == held([0]) and trained.count("de") == 50 and trained.count("fr") == held(range(6))


def test_letters_beyond_sixteen_bits_count():
    gothic = "𐌰𐌱𐌲 𐌰𐌱𐌲"
    assert langid.counts(gothic).sum() == langid.counts("abc abc").sum() > 0
    assert (langid.counts(gothic + " abc") != langid.counts("abc")).any()
    assert (langid._codes("aÉ1猫") == langid._codes("aÉ1猫𐌰")[:6].tolist()[:5] + [32]).all()


def plain_counts(text):
    """Counts of letter pairs and triples within one gap-joined text, by the definition."""
    codes = [ord(c.lower()[0]) if c.isalpha() else 32 for c in f" {text} "]
    codes = [c for k, c in enumerate(codes) if not (c == 32 and k and codes[k - 1] == 32)]
    a, b, c = (int(x) for x in (langid._A, langid._B, langid._C))
    out, low = [0] * langid.FEATURES, (1 << 32) - 1
    for k in range(len(codes) - 1):
        pair = (codes[k] * a ^ codes[k + 1] * b) & low
        out[(pair * c & low) >> 19] += 1
        if k + 2 < len(codes):
            out[(((pair * b & low) ^ (codes[k + 2] * c & low)) * a & low) >> 19] += 1
    return out


def test_tf_idf_and_nearest_centroid_by_the_definition():
    rnd = np.random.default_rng(3)
    texts = ["the cat and the dog", "Der Hund, und die Katze!", "a1b2 c", "été à la plage"]
    for t in texts:
        assert langid.counts(t).tolist() == plain_counts(t)
    idf = rnd.random(langid.FEATURES).astype(np.float32)
    got = langid.vectors(texts, idf)
    for t, row in zip(texts, got, strict=True):
        want = np.array([np.log1p(n) * w for n, w in zip(plain_counts(t), idf.tolist(), strict=True)])
        assert np.allclose(row, want / np.sqrt((want**2).sum()), atol=1e-6)
    centroids = langid.spherical_kmeans(got, 2)
    assert np.allclose((centroids**2).sum(1), 1, atol=1e-5)
    near = [[float(sum(a * b for a, b in zip(r, c, strict=True))) for c in centroids.tolist()] for r in got.tolist()]
    owner = [int(np.argmax(n)) for n in near]
    for k in range(2):  # a fixed point: each centroid is the direction of the sum of the texts nearest to it
        own = got[[i for i, o in enumerate(owner) if o == k]].sum(0)
        assert np.allclose(centroids[k], own / np.linalg.norm(own), atol=1e-5)
    model = langid.Model(["x", "y"], idf, centroids, np.array([1, 0]), np.zeros((2, langid.CLASSES)))
    said, scores, _ = model.predict(texts)
    assert said == [["y", "x"][o] for o in owner] and np.allclose(scores, [max(n) for n in near], atol=1e-5)
