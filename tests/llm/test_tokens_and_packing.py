"""Token caches against the libraries, packing laws, decontamination against dynamic programming."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import common, decontaminate, packing, token_counts, tokens

ODD = ["", " ", "\n", "\n\n", "a\n", "\na", " a", "a ", "a  b", "a \nb", "a\n b", "\n\na b\n", "<s>hi</s>", "<|endoftext|> x<|endoftext|>y", "▁a b", "a\tb", "a\r\nb", "é x", "　a", "日本 語", "😀 a😀", "İx ΣΑΣ", "\x00a", "a\n\n\nb", "don't it's 12 3.4", "́a b́", "ᄀ\nᅡ"]


def odd_texts():
    rng = random.Random(4)
    parts = ["a", "b", " ", " ", "\n", "é", ".", "ing", "the", "\t", "1", "  ", "\r", "▁", "ß", "İ", "<s>", "́", "<|endoftext|>"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)]


def test_units_give_the_librarys_ids():
    units = tokens.JsonUnits(tokens.tokenizer_path("word_bpe_49k.json"))
    texts = odd_texts()
    want = [np.array(e.ids, "<u4").tobytes() for e in units.whole.encode_batch(texts, add_special_tokens=False)]
    assert units.ids(texts) == want and units.ids([None]) == [b""]


def test_units_give_the_librarys_counts():
    units = tokens.PieceUnits(tokens.tokenizer_path("piece_bpe_32k.model"))
    texts = odd_texts()
    assert units.cuts and units.counts(texts) == [len(units.model.encode(t)) for t in texts] and units.counts([None]) == [0]


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 3)
    units = tokens.JsonUnits(tokens.tokenizer_path("word_bpe_49k.json"))
    first = units.ids(["a b c d e", "f g"])
    assert units.ids(["a b c d e", "f g"]) == first == units.ids(["a b c d e", "f g"]) and len(units.parts) <= 7


def test_counts_come_from_the_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [(1, "a b", 9), (2, "a b", 9), (2, "a b", 9), (3, None, 9), (4, "", 9), (None, "x y z", 9), (5, "w " * 6000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = token_counts.token_counts(docs, path)
    units = tokens.PieceUnits(tokens.tokenizer_path("piece_bpe_32k.model"))
    want = sorted((str(d), len((t or "").encode()), len(units.model.encode(t or "")), len(units.model.encode(t or "")) > 4096) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    cache = token_counts.read_cache(spark, path)
    assert cache.count() == 4 == cache.select("content").distinct().count()
    more = docs.union(spark.createDataFrame([(9, "new text", 1)], docs.schema))
    assert token_counts.token_counts(more, path).count() == len(rows) + 1
    assert token_counts.read_cache(spark, path).count() == 5
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
    # what the cache says is what counts
    spark.createDataFrame([], token_counts.CACHE)
    other = str(tmp_path / "other")
    version = tokens.file_digest(tokens.tokenizer_path("piece_bpe_32k.model"))
    docs.limit(1).select(token_counts.content_digest().alias("content"), F.lit(version).alias("tokenizer"), F.lit(77).cast("long").alias("n_tokens")).write.parquet(other)
    assert {r.n_tokens for r in token_counts.token_counts(docs.filter("doc_id = 1"), other).collect()} == {77}


@pytest.mark.parametrize("bits", [1, 3, 1 << 26])
def test_each_content_is_encoded_once_whatever_the_bitmaps_say(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(token_counts, "BITS", bits)
    path = str(tmp_path / "cache")
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i % 17} and {i % 5}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    units = tokens.PieceUnits(tokens.tokenizer_path("piece_bpe_32k.model"))
    want = sorted((i, len(units.model.encode(t))) for i, t in rows)
    few = docs.filter("doc_id < 40")
    for part in (few, docs, docs):
        held = {r.doc_id for r in part.select("doc_id").collect()}
        got = token_counts.token_counts(part, path)
        assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == [w for w in want if w[0] in held]
        cache = token_counts.read_cache(spark, path)
        assert cache.count() == cache.select("content").distinct().count() == part.select("text").distinct().count()


def test_a_second_run_encodes_nothing(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = str(tmp_path / "cache")
    token_counts.fill_cache(docs.filter("lang = 'en'"), path)
    early = token_counts.read_cache(spark, path).count()
    first = token_counts.token_counts(docs, path).collect()
    n = token_counts.read_cache(spark, path).count()
    assert 0 < early < n == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    monkeypatch.setattr(token_counts, "_encoded", None)  # a second run doesn't come to it
    assert sorted(token_counts.token_counts(docs, path).collect(), key=str) == sorted(first, key=str)
    assert token_counts.read_cache(spark, path).count() == n


def test_open_bins_are_best_fit_and_bounded():
    rng = random.Random(1)
    for most in (1, 3, 50):
        bins, free = packing.OpenBins(100, most), {}
        for i in range(400):
            n = rng.randint(1, 100)
            fits = [f for f in free.values() if f >= n]
            before = bins.n_bins
            bins.add(n, (i, 0, 0, n, b""))
            assert bins.n_open <= most and (bins.n_bins == before) == bool(fits)
            free = {b[0]: f for f, b in bins.rest()}
        held = bins.drain() + [b for _, b in bins.rest()]
        rows = [row for _, rs in held for row in rs]
        assert sorted(r[0] for r in rows) == list(range(400))
        for _, rs in held:
            assert [r[5] for r in rs] == np.cumsum([0, *(r[3] for r in rs)])[:-1].tolist() and sum(r[3] for r in rs) <= 100


@pytest.mark.parametrize("partitions", [1, 5])
def test_packing_is_whole(spark, partitions):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "idea", "of", "xyzzy", "stone."]) for _ in range(rng.choice([0, 3, 200, 900, 5000]))), "x") for i in range(80)]
    rows += [(500, None, "x"), (500, "", "x"), (None, "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(partitions)
    got = packing.pack(docs, open_bins=4, partitions_together=2).toPandas()
    units = tokens.JsonUnits(tokens.tokenizer_path("word_bpe_49k.json"))
    ids = {i: units.ids([t])[0] + bytes(4) for i, t, _ in rows if i not in (None, 500)}
    for doc, g in got[got.doc_id.notna() & (got.doc_id != 500)].groupby("doc_id"):
        g = g.sort_values("piece")
        assert g.piece.tolist() == list(range(len(g))) and b"".join(g.ids) == ids[doc]
        assert g.start.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and (g.length[:-1] == 2048).all()
    assert sorted(got[got.doc_id == 500].length) == [1, 1] and len(got[got.doc_id.isna()]) == 1
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.15 * got.length.sum() / 2048 + 2 * partitions


def brute_pack(lengths, size, most):
    """The bins of an online best-fit of bounded space, by search over all open bins."""
    free, closed, made = {}, 0, []
    for n in lengths:
        fits = [f for f in free.values() if f >= n]
        if fits:
            # of bins with equal space any will do: the multiset of free spaces is the same
            bin_ = next(b for b, f in free.items() if f == min(fits))
        else:
            if len(free) == most:
                fullest = next(b for b, f in free.items() if f == min(free.values()))
                made.append(free.pop(fullest))
            bin_ = closed = closed + 1
            free[bin_] = size
        free[bin_] -= n
        if free[bin_] == 0:
            made.append(free.pop(bin_))
    return sorted(made + list(free.values()))


def test_packing_equals_brute_best_fit():
    rng = random.Random(8)
    for most in (1, 4, 64):
        lengths = [rng.choice([rng.randint(1, 60), rng.randint(1, 300)]) for _ in range(1200)]
        bins = packing.OpenBins(300, most)
        for n in lengths:
            bins.add(n, (n,))
        spaces = [300 - sum(r[0] for r in rows) for _, rows in bins.closed] + [f for f, _ in bins.rest()]
        assert sorted(spaces) == brute_pack(lengths, 300, most)


def test_the_whole_packing_has_as_many_sequences_as_brute_best_fit(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["the"] * rng.choice([5, 40, 300, 900, 2500]))) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), open_bins=64, slack=2048).toPandas()
    order = got.sort_values(["doc_id", "piece"])
    assert got.sequence_id.nunique() == len(brute_pack(order.length.tolist(), 2048, 64))


@pytest.mark.parametrize("partitions", [16, 32, 64, 512])
def test_a_second_pass_task_holds_few_partitions(spark, partitions):
    left = spark.range(partitions * 3).select(F.shiftleft(F.col("id") % partitions, 32).alias("sequence_id"))
    found = packing.groups(left, partitions - 1, 8).groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct(packing.source_partition()).alias("n")).collect()
    assert len(found) == partitions // 8 and {r.n for r in found} == {8}


def test_packing_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, (row[-1], j))
    return best


def test_myers_equals_dynamic_programming():
    rng = random.Random(6)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(1, n))) for n in (70, 120))
        assert decontaminate.myers(p, t) == distance(p, t)
    assert decontaminate.myers("abc", "") == (3, 0)


def edited(text, edits, rng):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "q" + text[at + 1 :]])
    return text


def test_matches_equal_brute_force(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "on", "Ünder", "delta-x"]) + str(rng.randint(0, 99)) for _ in range(n))
    items = [(i, say(rng.randint(2, 25))) for i in range(12)] + [(50, None), (51, ""), (52, "?!")]
    rows = []
    for d in range(80):
        item = rng.choice(items[:12])[1]
        held = edited(item, rng.choice([0, 0, 1, 3, 6, 12, 40]), rng) if rng.random() < 0.7 else ""
        rows.append((d, f"{say(rng.randint(0, 30))} {held.upper() if d % 5 == 0 else held}, {say(10)}", 1))
    rows += [(200, None, 1), (201, "", 1), (None, items[0][1], 1), (202, items[0][1], 1), (202, items[0][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, distance int")
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = set()
    for d, t, _ in rows:
        for i, s in items:
            p = decontaminate.normal(s)
            if p and t and (best := distance(p, decontaminate.normal(t)))[0] <= decontaminate.budget(len(p), 0.06):
                want.add((d, i, *best))
    for most in (8 << 20, 300):
        got = decontaminate.contaminated(docs, bench, most_bytes=most).collect()
        assert {(r.doc_id, r.item_id, r.distance, r.stop) for r in got} == want
        assert len(got) == len(want) + sum(1 for w in want if w[0] == 202)
    flagged = {r.doc_id for r in decontaminate.flag(docs, bench).filter("contaminated").collect()}
    assert flagged == {w[0] for w in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.flag(docs, bench.limit(0)).filter("contaminated").count() == 0
    common.drop_scratch(spark)
