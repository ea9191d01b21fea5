"""Language identification in two steps: the family first, then its languages pairwise.

A text's features are the shares of hashed character n-grams (one to three letters,
word edges included) of its words. One-versus-one linear support vector machines
tell the families apart, and others, trained on one family's texts only, each pair of
languages within it. All of them are linear in the n-grams, so a word's contribution
to every machine is computed once and looked up.

The machines only tell the learned languages apart. Whether a text is in any of them is
told by its letter trigrams: a word has the log probability of the language that gives
it most, and a text's mean is compared with that of the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import common, svm
from .words import Scores, characters, codepoints

if TYPE_CHECKING:
    import pandas as pd

BUCKETS = 1 << 13
TRIGRAM_BUCKETS = 1 << 16
PRIOR = 0.5  # added to every trigram's count
DOUBT = 10  # so many trigrams as in a typical text are added to a text: a short one proves less
UNKNOWN = "und"
# Families of ISO 639-1 codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky"),
    "indic": ("hi", "bn", "ur", "mr", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt", "am"),
}


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


@dataclass(frozen=True)
class Machine:
    """w.x + b > 0 speaks for `yes`, else for `no`; a column of Model.weights holds w."""

    yes: str
    no: str
    bias: float
    slope: float


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # BUCKETS x machines
    families: tuple[str, ...]
    between: tuple[Machine, ...]
    within: dict[str, tuple[tuple[str, ...], tuple[Machine, ...]]]
    trigrams: np.ndarray  # TRIGRAM_BUCKETS x languages, log probabilities
    typical: float  # the mean of a median training text under the others
    unseen: float  # the log probability of a trigram that no text has


def _hashed(grams: list[np.ndarray], count: int) -> np.ndarray:
    """The bucket of each n-gram, given the characters at each of its places."""
    h = np.full(grams[0].shape, len(grams), np.uint64)
    for c in grams:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - count.bit_length() + 1)).astype(np.int64)


def _buckets(rows: np.ndarray, sizes: tuple[int, ...] = (1, 2, 3), count: int = BUCKETS, step: int = 1 << 14) -> Iterator[np.ndarray]:
    """The buckets of each row's n-grams, every n-gram once, at most `step` of a row at a time."""
    for size in sizes:
        n = rows.shape[1] - size + 1
        for low in range(0, n, step):
            high = min(n, low + step)
            yield _hashed([rows[:, low + i : high + i] for i in range(size)], count)


def _contribution(rows: np.ndarray, weights: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
    """Summed weights of a word's n-grams for every machine and how many n-grams there are.

    Then the log probability of its trigrams in the likeliest language, and their number.
    """
    out = np.zeros((len(rows), weights.shape[1] + 3))
    for at in _buckets(rows):
        out[:, :-3] += weights[at].sum(1)
        out[:, -3] += at.shape[1]
    total = np.zeros((len(rows), trigrams.shape[1]))
    for at in _buckets(rows, (3,), TRIGRAM_BUCKETS):
        total += trigrams[at].sum(1)
        out[:, -1] += at.shape[1]
    if total.size:
        out[:, -2] = total.max(1)
    return out


def _pairs(x: np.ndarray, gram: np.ndarray, names: np.ndarray, cost: float) -> list[tuple[Machine, np.ndarray]]:
    """A machine and its weights for every two names; gram is x @ x.T, as there are fewer texts than buckets."""
    out = []
    for yes, no in combinations(sorted(set(names)), 2):
        use = np.flatnonzero((names == yes) | (names == no))
        sign = np.where(names[use] == yes, 1.0, -1.0)
        weight = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum()) * len(sign)
        own = gram[np.ix_(use, use)]
        values, vectors = np.linalg.eigh(own)
        keep = values > 1e-10 * values.max()
        root = np.sqrt(values[keep])
        w, b = svm.fit(vectors[:, keep] * root, sign, cost=cost, weight=weight)
        dual = vectors[:, keep] @ (w / root)
        slope, _ = svm.platt(own @ dual + b, (sign > 0).astype(int))
        out.append((Machine(str(yes), str(no), b, slope), x[use].T @ dual))
    return out


def _stream(text: str) -> np.ndarray:
    """The characters of a text's words' letters, a zero on either side of each word."""
    held = [w for w in ("".join(filter(str.isalpha, w)) for w in text.lower().split()) if w]
    return characters("\0" + "\0\0".join(held) + "\0") if held else np.zeros(0, np.uint32)


def features(texts: list[str]) -> np.ndarray:
    """One row of n-gram shares per text, scaled so that a typical one has length 1."""
    out = np.zeros((len(texts), BUCKETS))
    for i, text in enumerate(texts):
        row = _stream(text)
        if len(row):
            one, two, three = row, row[1:], row[2:]
            # no n-gram goes over the two zeros between words
            pair, triple = (one[:-1] != 0) | (two != 0), two[:-1] != 0
            for grams in ([one], [one[:-1][pair], two[pair]], [one[:-2][triple], two[:-1][triple], three[triple]]):
                out[i] += np.bincount(_hashed(grams, BUCKETS), minlength=BUCKETS)
            out[i] /= out[i].sum()
    return out * SCALE


SCALE = 10.0


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each letter trigram of a text, and the number of the word that has it."""
    row = _stream(text)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[1:-1] != 0)
    owner = np.cumsum((row[:-1] == 0) & (row[1:] != 0))[at] - 1
    return _hashed([row[at], row[at + 1], row[at + 2]], TRIGRAM_BUCKETS), owner


def _likelihoods(texts: list[str], langs: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Model.trigrams, .typical and .unseen; each text is judged without its own counts."""
    names, column = np.unique(langs, return_inverse=True)
    cut = [_trigrams(t) for t in texts]
    counts = np.zeros((TRIGRAM_BUCKETS, len(names)))
    for (at, _), k in zip(cut, column, strict=True):
        np.add.at(counts[:, k], at, 1)
    space = counts.sum(0) + PRIOR * TRIGRAM_BUCKETS
    table = np.log((counts + PRIOR) / space)
    means = []
    for (at, owner), k in zip(cut, column, strict=True):
        if len(at):
            own, back, n = np.unique(at, return_inverse=True, return_counts=True)
            rows = table[own]
            rows[:, k] = np.log((counts[own, k] - n + PRIOR) / (space[k] - len(at)))
            words = np.zeros((owner.max() + 1, len(names)))
            np.add.at(words, owner, rows[back])
            means.append(words.max(1).sum() / len(at))
    unseen = float(np.log(PRIOR / space.max())) if len(names) else 0.0
    return table.astype(np.float32), float(np.median(means)) if means else unseen, unseen


def fit(sample: pd.DataFrame, cost: float = 10.0) -> Model:
    """Train on rows (text, lang); any order gives the same model. No rows: every text is `und`."""
    sample = sample.dropna().sort_values(["lang", "text"], kind="stable")
    langs = sample.lang.to_numpy(str)
    families = np.array([family_of(x) for x in langs], dtype=str)
    x = features(sample.text.tolist())
    gram = x @ x.T
    between = _pairs(x, gram, families, cost)
    within, columns = {}, [w for _, w in between]
    for name in sorted(set(families)):
        own = np.flatnonzero(families == name)
        pairs = _pairs(x[own], gram[np.ix_(own, own)], langs[own], cost)
        columns += [w for _, w in pairs]
        within[str(name)] = (tuple(sorted(map(str, set(langs[own])))), tuple(m for m, _ in pairs))
    weights = np.stack(columns, 1) * SCALE if columns else np.zeros((BUCKETS, 0))
    return Model(weights, tuple(sorted(map(str, set(families)))), tuple(m for m, _ in between), within, *_likelihoods(sample.text.tolist(), langs))


def _vote(names: tuple[str, ...], machines: tuple[Machine, ...], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The winner's number per row (votes, then summed margins), and its least probability against the others."""
    votes, total = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
    worst = np.ones((len(margins), len(names)))
    at = {n: i for i, n in enumerate(names)}
    for k, m in enumerate(machines):
        p = svm.logistic(m.slope * (margins[:, k] + m.bias))
        for name, q in ((m.yes, p), (m.no, 1 - p)):
            votes[:, at[name]] += q >= 0.5 if name == m.yes else q > 0.5
            total[:, at[name]] += q
            worst[:, at[name]] = np.minimum(worst[:, at[name]], q)
    best = np.argmax(votes + total / (len(names) + 1), axis=1)
    return best, worst[np.arange(len(margins)), best]


def _strangeness(total: np.ndarray, many: np.ndarray, model: Model) -> np.ndarray:
    """From summed log probabilities of `many` trigrams: 0 as in a typical training text, towards 1 as if none was ever seen."""
    range_ = max(model.typical - model.unseen, 1e-9)
    return np.clip((model.typical - total / many) / range_ * many / (many + DOUBT), 0.0, 1.0)


def _predict_texts(texts: list[str], scores: Scores, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = [t.lower().split() for t in texts]
    size = np.array([len(c) for c in cut], np.int64)
    lang, score, strange = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts)), np.ones(len(texts))
    words = [w for c in cut for w in c]
    if not words or not model.families:
        return lang, score, strange
    at = scores.rows(words)
    some = np.flatnonzero(size)
    total = np.add.reduceat(scores.table[at], (np.cumsum(size) - size)[some], axis=0)
    real = total[:, -1] > 0
    some, total = some[real], total[real]
    margins = total[:, :-3] / total[:, -3:-2]
    strange[some] = _strangeness(total[:, -2], total[:, -1], model)
    family, sure = _vote(model.families, model.between, margins)
    used = len(model.between)
    for i, name in enumerate(sorted(model.within)):
        names, machines = model.within[name]
        rows = np.flatnonzero(family == model.families.index(name))
        best, own = _vote(names, machines, margins[rows, used : used + len(machines)])
        lang[some[rows]] = np.array(names, dtype=object)[best]
        score[some[rows]] = sure[rows] * own
        used += len(machines)
    return lang, score, strange


def _fact(word: str) -> tuple[float]:
    return (0.0,)


@common.tidily
def _predict(arrays: Iterator[pa.Array], model: Model, chars: int = 1 << 20) -> Iterator[pa.Array]:
    scores = Scores(model.weights.shape[1] + 3, partial(_contribution, weights=model.weights, trigrams=model.trigrams), _fact, codepoints)
    for texts in arrays:
        langs: list[str] = []
        sure: list[float] = []
        odd: list[float] = []
        held: list[str] = []
        weight = 0
        for part in common.in_rows(texts):
            for text in part:
                held.append(text or "")
                weight += len(held[-1])
                if weight > chars:
                    for out, got in zip((langs, sure, odd), _predict_texts(held, scores, model), strict=True):
                        out += got.tolist()
                    held, weight = [], 0
        for out, got in zip((langs, sure, odd), _predict_texts(held, scores, model), strict=True):
            out += got.tolist()
        yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(odd, pa.float64())], ["lang_pred", "score", "strange"])


def training_sample(docs: DataFrame, rows: int = 300, chars: int = 4000, languages: int = 200) -> pd.DataFrame:
    """At most `rows` texts of each language, of 20 to `chars` characters, outside the held-out fold.

    Rows are taken by the hash of doc_id, of the `languages` languages with most rows. A
    doc_id that repeats within a language has its least text, so any run takes the same.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    usable = usable.filter(F.col("lang").isNotNull() & F.length("text").between(20, chars) & ~common.in_fold())
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return usable.limit(0).toPandas()[["text", "lang"]]
    # half as many again, as the draw is by chance; the rest goes below
    share = F.create_map(*(F.lit(v) for r in counts for v in (r.lang, min(1.0, 1.5 * rows / r.n))))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    drawn = usable.withColumn("draw", draw).filter(F.col("draw") < F.element_at(share, F.col("lang")) * (1 << 20))
    got = drawn.groupBy("lang", "doc_id", "draw").agg(F.min("text").alias("text")).toPandas()
    return got.sort_values(["draw", "doc_id"], kind="stable").groupby("lang").head(rows).sort_values(["doc_id", "lang"])[["text", "lang"]]


def predictor(model: Model):
    """A column function: text -> struct(lang_pred, score, strange)."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _predict(arrays, model)

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "lang_pred string, score double, strange double")


def with_language(docs: DataFrame, model: Model, column: str = "language") -> DataFrame:
    """docs with a struct column (lang_pred, score and strange from 0 to 1) over whole texts.

    The score compares the learned languages only; a text in none of them is strange.

    One narrow pass; only the text goes through Python. A null text and one without a
    letter are `und` with score 0, and strange 1; equal texts get equal values, and ties
    between languages go to the first by name. A word of any length counts whole. An empty
    table gives an empty result; other columns (one named `column` is replaced) and
    repeated rows stay as they are.
    """
    return docs.withColumn(column, predictor(model)(F.col("text")))
