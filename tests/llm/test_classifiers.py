"""Toxicity and language: kernels against their definition, held-out accuracy, edge cases."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from feedloom.llm import language, svm, toxicity, words

SF = "/root/testdata/sf0.01"
INSULTS = ["idiot", "moron", "scumbag", "worthless", "pathetic"]


def sample(n, seed):
    rng = random.Random(seed)
    syllables = ["the", "an", "re", "on", "ti", "es", "or", "wh", "st", "ing", "ou", "ha", "le", "ma"]
    rows = []
    for i in range(n):
        text = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
        if i % 3 == 0:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        rows.append((" ".join(text) + ".", int(i % 3 == 0)))
    return pd.DataFrame(rows, columns=["text", "toxic"])


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(sample(400, 1))


def scores(model, texts):
    return np.concatenate([x.to_numpy() for x in toxicity._score(iter([pa.array(texts, pa.string())]), model)])


def image_of(codes):
    """The kernel's image by its definition."""
    out = {}
    for size in (3, 4):
        for at in combinations(range(len(codes)), size):
            if at[-1] - at[0] < toxicity.SPAN:
                key = 0
                for i in at:
                    key = key * words.CLASSES + codes[i]
                key += words.CLASSES**4 if size == 3 else 0
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
    return out


def random_weights():
    dense = np.random.default_rng(0).normal(size=toxicity._SPACE).astype(np.float32)
    dense[[k for k in range(words.CLASSES**2)]] = 0
    return dense


def test_kernel_images_follow_the_definition():
    dense = random_weights()
    for word in ("moron", "a", "ab", "añb", "x-y.z", "aaaa"):
        own = words.bare(word)
        want = image_of([words.EDGE, *(words.letter_class(ord(c)) for c in own), words.EDGE])
        row = words.letters([own])
        got, norm = toxicity._images([row[0]])[0], toxicity._norm(row)[0]
        assert got.keys() == want.keys() and all(abs(got[k] * norm - want[k]) < 1e-9 for k in want)
        # the folded form is the same sum
        direct = sum(v * float(dense[k]) for k, v in got.items())
        assert abs(words.score_words([word], 1, lambda r: toxicity._margin_kernel(r, dense))[0, 0] - direct) < 1e-4


def test_a_long_words_margin_is_that_of_its_best_part_by_brute_force():
    dense = random_weights()
    rng = random.Random(3)
    for n in (1, 30, 32, 33, 40, 75):
        word = "".join(rng.choice("abcdeé") for _ in range(n))
        codes = [words.EDGE, *(words.letter_class(ord(c)) for c in word), words.EDGE]
        width = min(len(codes), toxicity.WORD)
        sums = [sum(v * float(dense[k]) for k, v in image_of(codes[s : s + width]).items()) for s in range(len(codes) - width + 1)]
        want = max(sums) / toxicity._NORM[width]
        assert abs(words.score_words([word], 1, lambda r: toxicity._margin_kernel(r, dense))[0, 0] - want) < 1e-3


def test_windows_of_sentences_by_brute_force():
    dense = random_weights()
    zero = np.arange(toxicity._SPACE)
    four, three = zero < words.CLASSES**4, zero >= words.CLASSES**4
    for k in range(4):  # weights of subsequences with a gap character don't exist
        dense[four & (zero // words.CLASSES**k % words.CLASSES == 0)] = 0
    for k in range(3):
        dense[three & ((zero - words.CLASSES**4) // words.CLASSES**k % words.CLASSES == 0)] = 0
    for text in ("Ab cd-ef, gh! Ij klm nop qrs tuv wxyz.", "a", "", "one\ntwo three four five six"):
        best = toxicity._best_windows([text], dense, toxicity.Model(None))[0]
        sums = [-np.inf]
        for sentence in text.lower().replace("!", "!\n").split("\n"):
            row = [words.letter_class(ord(c)) for c in sentence if words.letter_class(ord(c))]
            row += [0] * toxicity.RUN
            for s in range(len(row) - toxicity.RUN):
                sums.append(sum(v * float(dense[k]) for k, v in image_of([c for c in row[s : s + toxicity.RUN]]).items()))
        assert best == max(sums) or abs(best - max(sums) / toxicity._NORM[toxicity.RUN]) < 1e-3


def test_a_text_is_as_toxic_as_its_most_toxic_part(model):
    """The score from the kernel's definition, the logistic and the maximum, one by one."""
    dense = model.words.dense()
    for text in ("the idiot", "on ti es", "what a mo.ron"):
        margins = []
        for word in text.split():
            codes = [words.EDGE, *(words.letter_class(ord(c)) for c in words.bare(word)), words.EDGE]
            margins.append(sum(v * float(dense[k]) for k, v in image_of(codes).items()) / toxicity._NORM[len(codes)])
        want = 1 / (1 + np.exp(-(model.words.slope * (max(max(margins), toxicity.FLOOR) + model.words.bias) + model.words.shift)))
        assert abs(scores(toxicity.Model(model.words), [text])[0] - want) < 1e-4


@pytest.mark.parametrize("length,least", [(40, 0.95), (400, 0.95), (40_000, 0.75)])
def test_insults_inside_runs_of_any_length(model, length, least):
    rng = random.Random(length)
    clean = sample(1500, 4)
    syllables = [w.strip(".") for t, y in zip(clean.text, clean.toxic, strict=True) if not y for w in t.split()]
    runs, chains = [], []
    for _ in range(60 if length < 40_000 else 25):
        held = []
        while sum(map(len, held)) < length:
            held.append(rng.choice(syllables))
        runs.append("".join(held))
        chains.append("-".join(held))
    bad_runs = [r[: (k := rng.randrange(len(r)))] + rng.choice(INSULTS) + r[k:] for r in runs]
    bad_chains = ["-".join([*(p := c.split("-"))[: (k := rng.randrange(len(p)))], rng.choice(INSULTS), *p[k:]]) for c in chains]
    assert (scores(model, runs) >= 0.5).mean() <= 0.04 and (scores(model, chains) >= 0.5).mean() <= 0.04
    found = (scores(model, bad_runs) >= 0.5).mean(), (scores(model, bad_chains) >= 0.5).mean()
    assert min(found) >= least


def test_an_insult_with_a_space_put_in(model):
    rng = random.Random(6)
    test = sample(300, 5)
    clean = [t for t, y in zip(test.text, test.toxic, strict=True) if not y]
    bad = []
    for t in clean:
        word = rng.choice(INSULTS)
        k = rng.randrange(2, len(word) - 1)
        bad.append(t[:-1] + " " + word[:k] + " " + word[k:] + ".")
    assert (scores(model, bad) >= 0.5).mean() >= 0.9 and (scores(model, clean) >= 0.5).mean() <= 0.02


def test_held_out_gapped_and_inserted(model):
    test = sample(300, 2)
    got = scores(model, test.text.tolist())
    assert ((got >= 0.5) == (test.toxic == 1)).mean() > 0.98
    clean = [t for t, y in zip(test.text, test.toxic, strict=True) if not y][:60]
    for spoil, least in ((lambda w: ".".join(w), 0.98), (lambda w: " ".join(w), 0.9), (lambda w: w[:2] + "*" + w[2:], 0.98), (lambda w: w[:3] + "q" + w[3:], 0.8)):
        rng = random.Random(1)
        bad = [t + " " + spoil(rng.choice(INSULTS)) for t in clean]
        assert (scores(model, bad) >= 0.5).mean() >= least


def test_toxicity_edges(spark, model):
    rows = [(1, None, 0), (2, "", 0), (3, "12 !! %", 0), (4, "idiot", 0), (4, "idiot", 0), (None, "the an re " * 30_000 + "moron", 0), (6, "x" * 100_000, 0), (7, "a b c d", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxicity int")
    got = toxicity.with_toxicity(df, model, "score").collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows] and all(0 <= r.score <= 1 for r in got)
    assert [r.score >= 0.5 for r in got] == [False, False, False, True, True, True, False, False]
    assert toxicity.with_toxicity(df.limit(0), model).count() == 0


def test_toxicity_without_both_classes():
    for label, high in ((0, False), (1, True)):
        one = toxicity.fit(pd.DataFrame({"text": ["a b", "c"], "toxic": [label, label]}))
        assert (scores(one, ["idiot", None]) >= 0.5).tolist() == [high, high]
    none = toxicity.fit(pd.DataFrame({"text": pd.Series([], dtype=str), "toxic": pd.Series([], dtype=int)}))
    assert scores(none, ["x"])[0] < 0.5
    assert scores(toxicity.fit(pd.DataFrame({"text": ["", ""], "toxic": [0, 1]})), ["x"])[0] < 0.5


def test_fit_ignores_order():
    data = sample(90, 3)
    a, b = toxicity.fit(data), toxicity.fit(data.iloc[::-1])
    for x, y in ((a.words, b.words), (a.windows, b.windows)):
        assert (x.index == y.index).all() and np.allclose(x.weight, y.weight)


def test_samples_are_the_same_in_every_run(spark):
    docs = spark.createDataFrame([(1, "b " * 15, "en"), (1, "a " * 15, "en"), (2, "c " * 15, "en"), (2, None, "en")] * 3, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    for n in (1, 4):
        got = toxicity.training_sample(docs.repartition(n), labels)
        assert sorted(map(tuple, got.values.tolist())) == [("a " * 15, 1), ("c " * 15, 0)]
        taught = language.training_sample(docs.repartition(n))
        assert taught.values.tolist() == [["a " * 15, "en"], ["c " * 15, "en"]]


def test_samples_leave_the_held_out_fold_alone(spark):
    import zlib

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.training_sample(docs, labels, rows=10_000, chars=10**9)
    table = docs.join(labels, "doc_id").toPandas()
    free = table[[zlib.crc32(str(i).encode()) % 5 != 0 for i in table.doc_id]]
    assert sorted(got.text) == sorted(free[free.text != ""].text)
    few = toxicity.training_sample(docs, labels, rows=5)
    assert few.groupby("toxic").size().max() <= 5
    taught = language.training_sample(docs)
    held = set(docs.toPandas().loc[lambda d: [zlib.crc32(str(i).encode()) % 5 == 0 for i in d.doc_id], "text"])
    owners = docs.toPandas().groupby("text").doc_id.apply(list)
    assert all(any(zlib.crc32(str(i).encode()) % 5 for i in owners[t]) for t in taught.text if t in held)


def test_language_held_out(spark):
    import zlib

    table = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    out = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in table.doc_id])
    found = language.fit(language.training_sample(spark.read.parquet(f"{SF}/documents.parquet")))
    told = [x for a in language._predict(iter([pa.array(table[out].text.tolist())]), found) for x in a.to_pylist()]
    assert np.mean([t["lang_pred"] == x for t, x in zip(told, table[out].lang, strict=True)]) > 0.97


def test_language_features_count_every_n_gram_once():
    rng = random.Random(9)
    for n in (0, 1, 2, 3, 32, 33, 64, 500, 40_000):
        word = "".join(rng.choice("abcüñ日本") for _ in range(n))
        text = f"x1 {word}  A-b {word[:5]}\n"
        want = np.zeros(language.BUCKETS)
        for w in ("x", word, "ab", word[:5]):
            if w:
                row = [0, *map(ord, w), 0]
                for size in (1, 2, 3):
                    for i in range(len(row) - size + 1):
                        h = size
                        for c in row[i : i + size]:
                            h = (h ^ c) * 0x9E3779B97F4A7C15 % (1 << 64)
                        want[h >> (64 - 13)] += 1
        assert np.allclose(language.features([text])[0], want / want.sum() * language.SCALE)
        # what scores a word is the same sum, whatever its length
        if n:
            weights = np.random.default_rng(1).normal(size=(language.BUCKETS, 3))
            trigrams = np.random.default_rng(2).normal(size=(language.TRIGRAM_BUCKETS, 2)).astype(np.float32)
            alone = language.features([word])[0] / language.SCALE
            got = words.score_words([word], 6, lambda r: language._contribution(r, weights, trigrams), words.codepoints)[0]
            assert np.allclose(got[:3] / got[3], alone @ weights)
            at, owner = language._trigrams(word)
            assert got[5] == len(at) == n and not owner.any()
            assert np.isclose(got[4], trigrams[at].sum(0).max(), rtol=1e-3, atol=1e-2)


def test_votes_by_hand():
    machines = (language.Machine("a", "b", 0.0, 1.0), language.Machine("a", "c", 0.0, 1.0), language.Machine("b", "c", 0.0, 1.0))
    best, sure = language._vote(("a", "b", "c"), machines, np.array([[1.0, 2.0, 5.0], [-1.0, -2.0, 3.0], [2.0, -1.0, -3.0]]))
    assert best.tolist() == [0, 1, 2] and np.allclose(sure, [1 / (1 + np.exp(-1)), 1 / (1 + np.exp(-1)), 1 / (1 + np.exp(-1))])


def test_language_edges(spark):
    rows = [("the cat and the dog " * 5, "en"), ("der hund und die katze " * 5, "de"), ("le chat et le chien " * 5, "fr"), ("el gato y el perro " * 5, "es"), ("kissa ja koira " * 5, "fi")] * 3
    model = language.fit(pd.DataFrame(rows, columns=["text", "lang"]))
    assert set(model.within) == {"germanic", "romance", "uralic"}
    texts = ["the dog and the cat", "die katze", "el perro y el gato", "le chien", "kissa", None, "", "12 -- 3", "x" * 50_000, "日本語"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = [r.language for r in language.with_language(df, model).collect()]
    assert [g.lang_pred for g in got[:5]] == ["en", "de", "es", "fr", "fi"]
    assert all(g.lang_pred == "und" and g.score == 0 for g in got[5:8]) and all(g.lang_pred != "und" and 0 <= g.score <= 1 for g in got[8:])
    assert language.with_language(df.limit(0), model).count() == 0
    none = language.fit(pd.DataFrame({"text": [], "lang": []}))
    assert language.with_language(df, none).select("language.lang_pred").distinct().collect()[0][0] == "und"
    alone = language.fit(pd.DataFrame({"text": ["abc"] * 3, "lang": ["en"] * 3}))
    assert language.with_language(df, alone).filter("doc_id = 0").first().language.lang_pred == "en"


def test_machine_separates_and_weighs():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    w, b = svm.fit(x, np.array([-1.0, -1, 1, 1]), cost=100.0)
    assert ((x @ w + b) > 0).tolist() == [False, False, True, True]
    slope, shift = svm.platt(np.array([-2.0, -1, 1, 2]), np.array([0, 0, 1, 1]))
    assert slope > 0 and abs(shift) < 1
