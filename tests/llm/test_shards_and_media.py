"""Sharding and media columns: laws, round trips and edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import media, sharding

DOCS = "doc_id long, text string, source string, shard string"
ROWS = [(1, "a b", "s", "x"), (2, None, None, None), (3, "", "s", "y"), (4, "a b", "s", "x"), (4, "a b", "s", "x"), (None, "é" * 64, "t", "z"), (6, "word " * 40_000, "t", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def test_matrix_keeps_both_margins_and_is_seeded():
    sent, sizes = [5, 0, 90, 31], sharding.shard_sizes(126, 8)
    m = sharding.communication_matrix(sent, sizes, 3)
    assert m.sum(1).tolist() == sent and m.sum(0).tolist() == sizes.tolist()
    assert (m == sharding.communication_matrix(sent, sizes, 3)).all()


def test_matrix_follows_the_hypergeometric_mean():
    sizes = sharding.shard_sizes(300, 3)
    got = np.mean([sharding.communication_matrix([100, 200], sizes, s)[0] for s in range(400)], axis=0)
    assert np.allclose(got, 100 / 3, atol=1.0)


def test_hypergeometric_draws_follow_the_law():
    from math import comb

    rng = np.random.default_rng(5)
    for good, bad, drawn in ((5, 7, 6), (40, 3, 20), (300, 500, 30), (1, 9, 3)):
        low, high = max(0, drawn - bad), min(good, drawn)
        got = np.bincount([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(6000)], minlength=high + 1)
        want = np.array([comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn) if k >= low else 0 for k in range(high + 1)]) * 6000
        big = want >= 5
        chi = ((got - want)[big] ** 2 / want[big]).sum()
        assert got[:low].sum() == 0 and chi < big.sum() + 5 * np.sqrt(2 * big.sum()) + 3
    # more rows than numpy's sampler takes
    far = [sharding.hypergeometric(rng, 3 * 10**12, 10**12, 10**11) for _ in range(300)]
    deviation = np.sqrt(10**11 * 0.75 * 0.25 * (1 - 10**11 / (4 * 10**12)))
    assert abs(np.mean(far) - 0.75e11) < 5 * deviation / np.sqrt(300) and 0.8 < np.std(far) / deviation < 1.2


def test_the_permutation_is_uniform(spark):
    """Chi-square over all orders of five rows in two partitions, and over places of a larger table."""
    from collections import Counter
    from itertools import permutations

    seen = Counter()
    for seed in range(6000):
        m = sharding.communication_matrix([2, 3], sharding.shard_sizes(5, 2), seed)
        rows = []
        for p, first in ((0, 0), (1, 2)):
            shard, _, key = sharding._labels(m[p], np.array([1, 1]), p, seed)
            rows += [(s, k, first + i) for i, (s, k) in enumerate(zip(shard.tolist(), key.tolist(), strict=True))]
        seen[tuple(i for _, _, i in sorted(rows))] += 1
    want = 6000 / 120
    chi = sum((seen[o] - want) ** 2 / want for o in permutations(range(5)))
    assert chi < 119 + 5 * np.sqrt(2 * 119)


def test_rows_lie_where_a_plain_replay_puts_them(spark):
    df = spark.range(0, 500, 1, 3).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df, 4, seed=9, bucket_rows=20, stable=True).collect()}
    sent = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]
    sizes = sharding.shard_sizes(500, 4)
    buckets = np.maximum(1, -(-sizes // 20))
    held, low = [], 0
    for p, n in enumerate(sent):
        shard, bucket, key = sharding._labels(sharding.communication_matrix(sent, sizes, 9)[p], buckets, p, 9)
        held += [(s, b, k, low + i) for i, (s, b, k) in enumerate(zip(shard.tolist(), bucket.tolist(), key.tolist(), strict=True))]
        low += n
    want, slots = {}, [0] * 4
    for s, _, _, i in sorted(held):
        want[i] = (s, slots[s])
        slots[s] += 1
    assert got == want


def test_long_rows_make_more_buckets(spark):
    df = spark.range(64).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    got = sharding.shuffle_into_shards(df, 2, bucket_bytes=40_000)
    assert sorted((r.shard, r.slot) for r in got.collect()) == [(s, i) for s in range(2) for i in range(32)]


@pytest.mark.parametrize("rows,shards,bucket", [(1000, 7, 16), (5, 24, 16384), (1, 1, 1)])
def test_sizes_slots_and_rows(spark, rows, shards, bucket):
    df = spark.range(rows).withColumnRenamed("id", "doc_id")
    got = sharding.shuffle_into_shards(df, shards, bucket_rows=bucket).toPandas()
    assert sorted(got.doc_id) == list(range(rows))
    sizes = got.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_same_seed_same_order_other_seed_other(spark):
    df = spark.range(400).withColumnRenamed("id", "doc_id")
    first, again, other = ({r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df, 4, seed=s).collect()} for s in (1, 1, 2))
    assert first == again != other


def test_clashing_columns_nulls_repeats_and_empty(spark, docs):
    got = sharding.shuffle_into_shards(docs, 3).toPandas()
    assert list(got.columns) == ["doc_id", "text", "source", "shard", "slot"] and len(got) == len(ROWS)
    assert sharding.shuffle_into_shards(docs.limit(0), 3).count() == 0
    names = ["label", "bucket", "key", "place", "part", "at", "start", "p", "n", "_deal", "_bucket", "_key", "_place", "_shard", "Bucket_", "size", "a.b", "slot"]
    wide = spark.createDataFrame([tuple(f"{i}-{n}" for n in names) for i in range(9)], ", ".join(f"`{n}` string" for n in names))
    told = sharding.shuffle_into_shards(wide, 2, bucket_rows=2)
    assert told.columns == [*names[:-1], "shard", "slot"]
    assert sorted(told.select(*(f"`{n}`" for n in names[:-1])).collect()) == sorted(wide.select(*(f"`{n}`" for n in names[:-1])).collect())


def test_parse_orders_text_media_and_captions():
    html = (
        "<html><head><title>no</title></head><body>Hi <b>there</b><p>one&amp;two</p><img src='a.png' alt=' x  y '>"
        "<figure><img src='b.png' alt='alt'><video src='c.mp4'></video><figcaption>both <i>of</i> them</figcaption></figure>"
        "<script>var x='<p>no</p>'</script>tail<img></body></html>"
    )
    got = media.parse(html)
    assert [r[0] for r in got] == list(range(len(got)))
    assert [r[1:] for r in got] == [
        ("text", "Hi there", None, None), ("text", "one&two", None, None), ("media", None, "a.png", "x y"),
        ("media", None, "b.png", "both of them"), ("media", None, "c.mp4", "both of them"), ("text", "tail", None, None),
    ]


def test_parse_survives_broken_pages():
    for html in (None, "", "<", "<p", "<figure><figcaption>open", "</figure></figcaption>", "<script>", "a<![CDATA[x", "<figure><img src=a><figcaption>c"):
        assert isinstance(media.parse(html), list)
    assert media.parse("<figure><figcaption>open")[0][1:3] == ("text", "open")


def test_stored_media_round_trip(spark, docs):
    got = media.document_media(docs).toPandas()
    assert len(got) == len(ROWS)
    texts = {}
    for i, t, *_ in ROWS:
        texts.setdefault(-1 if i is None else i, (t or "").encode())
    for r in got.itertuples():
        data = texts[-1 if r.doc_id != r.doc_id else int(r.doc_id)]
        padded = data + bytes(-len(data) % 64 if data else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        stored = f"P5\n64 {len(padded) // 64}\n255\n".encode() + padded
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.read_image(stored) == padded


def test_resolve_keeps_positions_and_unknown_references(spark):
    digest = hashlib.sha256(b"x").hexdigest()
    pages = spark.createDataFrame([(1, f"<p>t</p><img src='sha256:{digest}' alt='c'><img src='http://a/b.png'>"), (2, None)], "page_id long, html string")
    table = spark.createDataFrame([(digest, 5)], "digest string, size int")
    rows = {r.position: r for r in media.resolve(media.interleave(pages), table).collect()}
    assert rows[0].text == "t" and rows[1].size == 5 and rows[1].caption == "c"
    assert rows[2].ref == "http://a/b.png" and rows[2].size is None
    with pytest.raises(ValueError):
        media.read_image(b"P5\n64 2\n255\nshort")


def test_media_of_an_empty_table(spark, docs):
    assert media.document_media(docs.limit(0)).count() == 0
    assert media.interleave(spark.createDataFrame([], "page_id long, html string")).select(F.explode("sequence")).count() == 0
