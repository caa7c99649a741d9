"""The registered queries as the contracts state them: columns, types, a row for each input row."""

import pytest

from tidemark.llm.queries import QUERIES

COLUMNS = {
    "op1_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op2_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op6_training_order": "slot bigint, shard bigint, doc_id bigint, piece int, length int, ids_crc32 bigint, record binary",
    "op7_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op8_bpe_encoding": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_document_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op10_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op11_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op12_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op13_phrase_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, sample, name):
    df = QUERIES[name](spark, sample)
    types = dict(df.dtypes)
    for column in COLUMNS[name].split(", "):
        given, kind = column.split()
        assert types[given] == kind
    if name.split("_")[0] not in ("op1", "op4", "op6", "op12", "op13"):
        ids = sorted(r.doc_id for r in df.select("doc_id").collect())
        assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{sample}/documents.parquet").select("doc_id").collect())


def test_counts_and_codes_equal_the_library(spark, sample):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sample}/documents.parquet").collect()}
    counter, coder = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    for r in QUERIES["op10_token_counts"](spark, sample).collect():
        n = len(counter.encode(texts[r.doc_id]).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 512)
    for r in QUERIES["op8_bpe_encoding"](spark, sample).collect():
        ids = coder.encode(texts[r.doc_id], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(coder.decode(ids, skip_special_tokens=False)))
