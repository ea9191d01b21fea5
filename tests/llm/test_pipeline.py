"""The corpus pipeline on planted documents, stage by stage."""

import shutil
from pathlib import Path

import pytest

import corpus_pipeline
from feedloom.llm import decontaminate, queries

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("planted")
    for name in ("labels", "benchmark"):
        shutil.copy(SF / f"{name}.parquet", top / f"{name}.parquet")
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    base = docs.filter("length(text) between 800 and 3000 and lang = 'en'").orderBy("doc_id").limit(3).collect()
    item = spark.read.parquet(str(SF / "benchmark.parquet")).orderBy("item_id").first().text
    extra = [(90_000 + i, r.text, "en", "x", len(r.text)) for i, r in enumerate(base)]
    extra += [(91_000, "Some words before. " + item.upper() + " And some after it.", "en", "x", 1), (92_000, "12 34 --", "en", "x", 1), (93_000, None, None, None, None)]
    docs.union(spark.createDataFrame(extra, docs.schema)).write.parquet(str(top / "documents.parquet"))
    return top, base


def test_stages(spark, planted):
    top, base = planted
    docs = spark.read.parquet(f"{top}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(top))
        path = f"{top}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        held[name] = docs
        if name != "packing":
            assert docs.columns == names and docs.exceptAll(before).isEmpty()
        counts.append(docs.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dup", "decontamination", "packing"]
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in held.items()}
    assert not {92_000, 93_000} & ids["language"]
    for i, r in enumerate(base):
        if {90_000 + i, r.doc_id} <= ids["language"]:
            assert 90_000 + i not in ids["near_dup"]
    assert 91_000 in ids["near_dup"] and 91_000 not in ids["decontamination"]
    bench = spark.read.parquet(f"{top}/benchmark.parquet")
    assert decontaminate.contaminated(held["decontamination"], bench).isEmpty()
    assert ids["packing"] == ids["decontamination"]
    result = corpus_pipeline.run(spark, str(top))
    assert {r.doc_id for r in result.select("doc_id").distinct().collect()} == ids["packing"]


def test_clashing_names_and_empty_tables(spark, planted, tmp_path):
    top, _ = planted
    docs = spark.read.parquet(f"{top}/documents.parquet").limit(40)
    names = ["toxicity", "_toxicity", "language", "_language", "leak", "_leak", "_id", "_print", "score"]
    wide = docs.select("*", *(docs.doc_id.cast("string").alias(n) for n in names))
    held = {r.doc_id: tuple(r) for r in wide.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, str(top))
        assert got.columns == wide.columns and all(held[r.doc_id] == tuple(r) for r in got.collect())
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{top}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
