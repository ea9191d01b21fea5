"""Registered queries: SQL equivalents, and results of the whole tables."""

import zlib

import pytest

from feedloom.llm import queries

from .. import duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert duck.actual(queries.QUERIES[name](spark, SF)) == duck.expected(queries.ORACLES[name], SF)


def test_shards_of_all_documents(spark):
    got = queries.QUERIES["op1_hypergeometric_shards"](spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.index) and got.law.unique().tolist() == ["rows"] and got.grown_shard.isna().all()
    for i, r in docs.iterrows():
        data = (r.text or "").encode()
        assert (got.loc[i, "size"], got.loc[i, "text_crc32"]) == (len(data) + 8, zlib.crc32(data))
    assert set(got.shard) == set(range(24)) and got.groupby("shard").size().agg(lambda s: s.max() - s.min()) <= 1


def test_packed_ids_and_whole_counts(spark):
    import numpy as np
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 0] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    packed = queries.QUERIES["op4_best_fit_packing"](spark, SF).toPandas()
    assert packed.length.sum() == sum(map(len, ids.values()))
    for r in packed.itertuples():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counted = queries.QUERIES["op6_digest_cache_counts"](spark, SF).toPandas().set_index("doc_id").n_tokens
    assert counted.to_dict() == {i: len(pieces.encode(t or "")) for i, t in zip(docs.doc_id, docs.text, strict=True)}
