"""The language stage drops texts in a foreign script, in an unlearned language or in none."""

import random

import corpus_pipeline
from feedloom.llm import language

SF = "/root/testdata/sf0.01"
FOREIGN = [
    "В начале июля, в чрезвычайно жаркое время, под вечер один молодой человек вышел из своей каморки",
    "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。",
    "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan",
    " ".join("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=2 + i % 8)) for i in range(60)),
    "Привет",
]


def test_foreign_texts_go_and_learned_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900_000 + i, t, None, "x", len(t)) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.union(extra), SF).select("doc_id").collect()}
    assert not {900_000 + i for i in range(len(FOREIGN))} & kept
    lettered = {r.doc_id for r in docs.filter(docs.text.rlike(r"\p{L}")).select("doc_id").collect()}
    assert len(lettered - kept) <= 0.002 * len(lettered)


def test_a_language_left_out_of_training_is_strange(spark):
    sample = language.training_sample(spark.read.parquet(f"{SF}/documents.parquet"))
    for lang in ("en", "de", "fr", "es"):
        model = language.fit(sample[sample.lang != lang])
        own = spark.createDataFrame(sample[sample.lang == lang])
        told = language.with_language(own, model).select("language.strange").collect()
        assert sum(r.strange >= corpus_pipeline.MOST_STRANGE for r in told) >= 0.95 * len(told)
