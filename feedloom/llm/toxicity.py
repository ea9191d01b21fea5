"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

The kernel of two strings counts their common subsequences of three and of four
characters; an occurrence that spans s characters weighs DECAY**s, up to SPAN
characters, so inserted or gapped characters lower a match and don't undo it.

A sentence is embedded twice, and two machines share the landmarks.

* Its words, a word's edges being characters too. Characters other than letters are
  left out, and three or more single letters in a row make one word. What is scored is
  any WORD characters in a row of a word, so of most words the whole.
* Its windows: any RUN letters in a row of the sentence, white space and all else left
  out. They hold insults that run over a space, and those inside unspaced runs.

Landmarks are words of the sample: up to half of them words with the runs of four to
six letters that tell the classes apart most, the others drawn by seed; after the
first round the clean words that look most toxic are added. A string is embedded as
K(u, Z) K(Z, Z)**-1/2.

The machines are trained on the sentences of labelled documents, copies left out. A
sentence is as toxic as its most toxic part (a latent choice, made anew in every
round) and a document as its most toxic sentence. All parts of clean sentences are
negatives; of windows, some drawn by seed and those that look most toxic. A toxic
document's sentences first all take its label; then those words count that have runs
that occur in toxic documents far above chance, and of a document without any its most
toxic ones, if the machine finds them toxic. Words found toxic are also trained on
with a letter put in. The windows of toxic sentences that hold such a word are the
second machine's positives. Its bar lies above the windows of 99 % of clean documents
that it was not trained on, and above all where windows can't tell the classes apart.

As K(u, Z) times any vector is linear in the subsequences, a trained machine folds
into one weight per subsequence; scoring adds weights and never calls the kernel.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, svm
from .shingles import shingle_sets
from .words import CELLS, CLASSES, Scores, bare, by_length, characters, classes, letters, score_words

if TYPE_CHECKING:
    import pandas as pd

SPAN, DECAY = 7, 0.85
WORD = 34  # characters, edges included
RUN = 12
COST = 0.1
SPOILT = 400
SCALE = 2.0  # brings typical images to length 1 or so
FLOOR = -1.0  # the sum of a text without words
_GAPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)] + [(i, j, k) for k in range(3, SPAN) for j in range(2, k) for i in range(1, j)]
_SPACE = CLASSES**4 + CLASSES**3


@dataclass(frozen=True)
class Machine:
    """Non-zero subsequence weights (an index is three or four letter classes), the bias and the logistic's two numbers."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def dense(self) -> np.ndarray:
        out = np.zeros(_SPACE, np.float32)
        out[self.index] = self.weight
        return out

    def chance(self, margin: np.ndarray) -> np.ndarray:
        return svm.logistic(self.slope * (margin + self.bias) + self.shift)


@dataclass(frozen=True)
class Model:
    """The machine of words and that of windows; a text's score is the higher of theirs.

    The best of n clean windows grows with the logarithm of n; its margin is lowered by
    that growth where a text has more windows than a `usual` one.
    """

    words: Machine
    windows: Machine | None = None
    usual: float = 1.0
    growth: float = 0.0


def _constant(shift: float) -> Model:
    return Model(Machine(np.empty(0, np.int64), np.empty(0), 0.0, 1.0, shift))


def _norms(most: int) -> np.ndarray:
    """The length of the image of n characters, n to `most`, if no subsequence occurs twice."""
    total = np.zeros(most + 1)
    for gap in _GAPS:
        total += DECAY ** (2 * (gap[-1] + 1)) * np.maximum(0, np.arange(len(total)) - gap[-1])
    return np.sqrt(np.maximum(total, DECAY**6))


_NORM = _norms(max(WORD, RUN))


def _norm(rows: np.ndarray) -> np.ndarray:
    return _NORM[np.minimum((rows > 0).sum(1), len(_NORM) - 1)]


def _occurrences(rows: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(subsequence indexes by the first character's place, span) of all occurrences, gap by gap.

    An index with a gap character among its classes belongs to no subsequence.
    """
    width = rows.shape[-1]
    pairs = {i: rows[..., : width - i] * CLASSES + rows[..., i:] for i in range(1, min(SPAN - 1, width))}
    for i, pair in pairs.items():
        for j in range(i + 1, min(SPAN, width)):
            three = pair[..., : width - j] * CLASSES + rows[..., j:]
            yield three + CLASSES**4, j + 1
            for k in range(j + 1, min(SPAN, width)):
                yield three[..., : width - k] * CLASSES + rows[..., k:], k + 1


def _highest(rows: np.ndarray, dense: np.ndarray, width: int) -> np.ndarray:
    """For each place, the summed weights of the subsequences within the `width` characters that start there.

    Rows of fewer characters have one place.
    """
    n = rows.shape[-1]
    width = min(width, n)
    out = np.zeros((*rows.shape[:-1], n - width + 1))
    by_span: dict[int, np.ndarray] = {}
    for at, span in _occurrences(rows):
        held = dense.take(at)
        by_span[span] = by_span[span] + held if span in by_span else held
    for span, held in by_span.items():
        places = width - span + 1  # where an occurrence within a window can start
        if places > 0:
            total = np.zeros((*rows.shape[:-1], held.shape[-1] + 1))
            np.cumsum(held, axis=-1, dtype=float, out=total[..., 1:])
            out += DECAY**span * (total[..., places : places + out.shape[-1]] - total[..., : out.shape[-1]])
    return out


def _margin_kernel(rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """A word's margin: that of its most toxic WORD characters in a row."""
    best = np.full(len(rows), -np.inf)
    for low in range(0, max(1, rows.shape[1] - WORD + 1), CELLS):
        part = rows[:, low : low + CELLS + WORD - 1]
        best = np.maximum(best, _highest(part, dense, WORD).max(1))
    return (best / _norm(rows[:, :WORD]))[:, None]


def _images(strings: list[np.ndarray]) -> list[dict[int, float]]:
    """The kernel's image of each row of classes, as subsequence -> weight."""
    out = []
    for row in strings:
        image: dict[int, float] = {}
        norm = _norm(row[None, :])[0]
        for at, span in _occurrences(row):
            for k in at.tolist():
                image[k] = image.get(k, 0.0) + DECAY**span / norm
        out.append(image)
    return out


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _pieces(text: str | None) -> list[str]:
    """A text's words to learn from: of a word of more than WORD - 2 letters, parts of it that overlap, to its end."""
    out = []
    for word in split(text):
        own = bare(word)
        if len(own) <= WORD - 2:
            out.append(word)
        else:
            out += [own[low : low + WORD - 2] for low in (*range(0, len(own) - WORD + 2, 8), len(own) - WORD + 2)]
    return out


def _sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' letters as classes, white space and all else left out, and where each text starts.

    RUN gap characters stand between sentences (a line feed, or white space behind a
    full stop, question or exclamation mark) and texts, so that no window spans two.
    """
    chars = [characters(t.lower() + "\n") for t in texts]
    ends = np.cumsum([len(c) for c in chars])
    row = np.concatenate(chars)
    codes = classes(row)
    mark = (row == 33) | (row == 46) | (row == 63)
    stop = row == 10
    stop[1:] |= mark[:-1] & ((row[1:] == 32) | ((row[1:] >= 9) & (row[1:] <= 13)))
    often = np.where(stop, RUN, codes > 0)
    first = np.zeros(len(texts), np.int64)
    first[1:] = np.cumsum(often)[ends[:-1] - 1]
    return np.repeat(codes, often).astype(np.int32), first


def _windows(texts: list[str], dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margins of all windows of all texts, by the letters they start at, those letters, and where each text starts."""
    row, first = _sentences(texts)
    out = np.empty(len(row))
    end = np.pad(row, (0, RUN - 1))
    for low in range(0, len(row), 1 << 15):
        part = end[low : low + (1 << 15) + RUN - 1]
        out[low : low + (1 << 15)] = _highest(part, dense, RUN)
    return np.where(row > 0, out / _NORM[RUN], -np.inf), row, first


def _joined(words: list[str], short: np.ndarray, doc: np.ndarray) -> tuple[list[str], list[int]]:
    """Words made of three or more single letters in a row, and their documents.

    A long run gives words of at most 24 letters that overlap by 8.
    """
    made, where = [], []
    cut = np.flatnonzero(np.concatenate(([True], (short[1:] != short[:-1]) | (doc[1:] != doc[:-1]))))
    for a, b in zip(cut, np.append(cut[1:], len(short)), strict=True):
        if short[a] and b - a >= 3:
            for low in range(a, max(a + 1, b - 8), 16):
                made.append("".join(words[low : min(b, low + 24)]))
                where.append(int(doc[low]))
    return made, where


def _facts(word: str) -> tuple[float]:
    return (float(len(word) < 4 and sum(c.isalpha() for c in word) == 1),)


def _originals(texts: list[str], k: int = 64) -> list[int]:
    """Numbers of the texts that share less than a third of their sketch with every earlier one kept.

    What copies repeat is no evidence; the sketches are bottom-k ones of 4-word shingles.
    """
    kept, holders = [], {}
    for i, own in enumerate(shingle_sets(texts, 4, limit=1 << 16)):
        low = own[:k].tolist()
        shared = Counter(j for v in low for j in holders.get(v, ()))
        if not shared or 3 * max(shared.values()) < len(low):
            kept.append(i)
            for v in low:
                holders.setdefault(v, []).append(i)
    return kept


RUNS = (4, 5, 6)
RUN_BUCKETS = 1 << 20


def _grams(words: list[str]) -> list[np.ndarray]:
    """Hashes of the runs of four to six letters of each word, edges included."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
    held = [bare(w) for w in words]
    for n, at in by_length(held).items():
        if n >= 2:
            rows = letters([held[i] for i in at])
            codes = []
            for size in RUNS:
                width = rows.shape[1] - size + 1
                if width > 0:
                    run = np.full((len(rows), width), size, np.uint64)
                    for k in range(size):
                        run = (run ^ rows[:, k : width + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    codes.append((run >> np.uint64(44)).astype(np.int64))
            for i, c in zip(at, np.concatenate(codes, axis=1), strict=True):
                out[i] = c
    return out


def _surprise(seen: np.ndarray, counts: np.ndarray, odds: float) -> np.ndarray:
    """How far above chance a thing seen in seen[label] documents leans to the toxic ones: the exponent of the odds."""
    n = seen.sum(0)
    base = counts[1] / counts.sum()
    share = np.clip(seen[1] / np.maximum(n, 1), 1e-6, 1 - 1e-6)
    found = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    return np.where((seen[1] + 0.5) / (counts[1] + 1) > odds * (seen[0] + 0.5) / (counts[0] + 1), found, 0.0)


def _spoil(word: str, rng: np.random.Generator) -> str:
    own = bare(word)
    at = int(rng.integers(1, max(2, len(own))))
    return own[:at] + chr(97 + int(rng.integers(26))) + own[at:]


class Landmarks:
    """The Nystroem space of some words: K(u, Z) K(Z, Z)**-1/2, scaled so that most words have length 1 or so."""

    def __init__(self, words: list[str]) -> None:
        images = _images([letters([bare(w)])[0] for w in words])
        self.columns = np.unique(np.concatenate([np.fromiter(m, np.int64) for m in images]))
        z = np.zeros((len(images), len(self.columns)))
        for i, m in enumerate(images):
            z[i, np.searchsorted(self.columns, list(m))] = list(m.values())
        values, vectors = np.linalg.eigh(z @ z.T)
        keep = values > 1e-8 * values.max()
        self.place = np.zeros(_SPACE, np.int32)
        self.place[self.columns] = np.arange(1, len(self.columns) + 1)
        self.basis = np.zeros((keep.sum(), len(self.columns) + 1), np.float32)  # a subsequence's part of each dimension
        self.basis[:, 1:] = SCALE * (vectors[:, keep] / np.sqrt(values[keep])).T @ z

    def rows(self, strings: np.ndarray) -> np.ndarray:
        """The embeddings of rows of classes: the sums of their subsequences' parts."""
        flat, column, weight = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0)]
        for at, span in _occurrences(strings):
            at = self.place[at]
            row, col = np.nonzero(at)
            flat.append(row)
            column.append(at[row, col])
            weight.append(np.full(len(row), DECAY**span))
        row, col, much = np.concatenate(flat), np.concatenate(column), np.concatenate(weight)
        out = np.empty((len(strings), len(self.basis)), np.float32)
        for d, part in enumerate(self.basis):
            out[:, d] = np.bincount(row, much * part.take(col), len(strings))
        return out / _norm(strings)[:, None].astype(np.float32)

    def embed(self, words: list[str], spare: int = 0) -> np.ndarray:
        """A row per word, and `spare` rows of zeros."""
        out = np.zeros((len(words) + spare, len(self.basis)), np.float32)
        for low in range(0, len(words), 4096):
            part = words[low : low + 4096]
            out[low : low + len(part)] = score_words(part, out.shape[1], self.rows)
        return out

    def folded(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The subsequences and their weights in a machine's margin."""
        return self.columns, w @ self.basis[:, 1:].astype(float)


DRAWN = 8  # windows of a clean document to learn from, at first and then in each round


def _fit_windows(texts: list[str], y: np.ndarray, space: Landmarks, toxic: list[str], rng: np.random.Generator, rounds: int = 3) -> Model | None:
    """The machine of windows, from documents and the words that the first machine found toxic.

    Every second clean document, and every fourth toxic one, is only used to set the bar.
    """
    clean, bad = [t for t, label in zip(texts, y, strict=True) if not label], [t for t, label in zip(texts, y, strict=True) if label]
    taught, unseen = clean[::2], clean[1::2]
    if not taught or not unseen or not bad:
        return None

    def cut(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.pad(row, (0, RUN))[at[:, None] + np.arange(RUN)].astype(np.int64)

    finder = {w: letters([w], edge=0)[0].astype(np.uint8).tobytes() for w in toxic if 3 <= len(w)}
    found = []
    for i, text in enumerate(bad):
        if i % 4 != 3:
            row, _ = _sentences([text])
            codes = np.pad(row.astype(np.uint8), RUN).tobytes()
            there = {bare(w) for w in _pieces(text)}
            for word, key in finder.items():
                if word in there and (at := codes.find(key)) >= 0:
                    for copy in range(6):
                        own = key
                        if copy >= 3:  # with a letter put in
                            k = int(rng.integers(1, len(key)))
                            own = key[:k] + bytes([int(rng.integers(1, 27))]) + key[k:]
                        whole = codes[:at] + own + codes[at + len(key) :]
                        slack = RUN - len(own)
                        start = at - int(rng.integers(0, slack + 1)) if slack >= 0 else at + int(rng.integers(0, 1 - slack))
                        found.append(np.frombuffer(whole[max(0, start) : max(0, start) + RUN].ljust(RUN, b"\0"), np.uint8).astype(np.int64))
    if not found:
        return None
    good = np.stack(found)
    row, first = _sentences(taught)
    starts = np.flatnonzero(row)
    if not len(starts):
        return None
    worst = cut(row, rng.choice(starts, DRAWN * len(taught)))
    x_good, x_bad = space.rows(good), space.rows(worst)
    x_bad[:: 2 * DRAWN] = 0  # letters that no landmark knows are clean
    for step in range(rounds):
        x, sign = np.concatenate((x_good, x_bad)), np.concatenate((np.ones(len(x_good)), -np.ones(len(x_bad))))
        weight = np.where(sign > 0, 0.5 / len(x_good), 0.5 / len(x_bad)) * len(sign)
        w, b = svm.fit(x, sign, cost=COST, weight=weight)
        machine = Machine(*space.folded(w), b, 1.0, 0.0)
        dense = machine.dense()
        if step + 1 < rounds:
            # the windows that look most toxic of each clean document
            margin, row, first = _windows(taught, dense)
            ends = np.append(first[1:], len(row))
            hard = np.concatenate([a + np.argsort(-margin[a:e], kind="stable")[:DRAWN] for a, e in zip(first, ends, strict=True)])
            x_bad = np.concatenate((x_bad, space.rows(cut(row, hard))))
    model = Model(machine, machine, float(np.median([len(t) for t in unseen])))
    calm, hot = (np.maximum(_best_windows(t, dense, model), FLOOR) for t in (unseen, bad[3::4] or bad))
    # the maximum's law is Gumbel's: two quantiles give its growth with the number of windows
    growth = float(np.quantile(calm, 0.99) - np.quantile(calm, 0.5)) / 4.23
    model = Model(machine, machine, model.usual, growth)
    calm, hot = (np.maximum(_best_windows(t, dense, model), FLOOR) for t in (unseen, bad[3::4] or bad))
    top, high = np.quantile(calm, 0.99), np.quantile(hot, 0.1)
    # above the clean documents' best windows, short of the toxic ones'; where these are no higher, beyond all
    bar = (top + high) / 2 if high > top else calm.max() + np.ptp(calm) / 2
    bar = max(bar, -b / 2)
    slope = 4.0 / max(bar - np.median(calm), 1e-6)
    return replace(model, windows=Machine(machine.index, machine.weight, b, slope, -slope * (bar + b)))


def _best_windows(texts: list[str], dense: np.ndarray, model: Model) -> np.ndarray:
    margin, _, first = _windows(texts, dense)
    many = np.maximum(1.0, np.array([len(t) for t in texts]) / model.usual)
    return np.maximum.reduceat(margin, first) - model.growth * np.log(many)


def fit(sample: pd.DataFrame, landmarks: int = 128, rounds: int = 3, seed: int = 7) -> Model:
    """Train on rows (text, toxic) of a bounded sample; any order gives the same model.

    Without rows of both classes the model scores every text alike: the one class's
    label, or not toxic.
    """
    sample = sample.dropna(subset=["toxic"]).sort_values(["toxic", "text"], kind="stable")
    sample = sample.iloc[_originals(sample.text.tolist())]
    docs = [_pieces(t) for t in sample.text]
    y = sample.toxic.to_numpy(int)
    if len(set(y)) < 2:
        return _constant(4.0 if len(y) and y[0] == 1 else -4.0)
    vocabulary: dict[str, int] = {}
    rows = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for words in docs]
    words = list(vocabulary)
    if not words:
        return _constant(-4.0)
    seen = np.zeros((2, len(words)))
    for r, label in zip(rows, y, strict=True):
        seen[label, np.unique(r)] += 1
    grams = _grams(words)
    counts = np.bincount(y, minlength=2)
    hits = np.zeros((2, RUN_BUCKETS))
    for r, label in zip(rows, y, strict=True):
        hits[label, np.unique(np.concatenate([grams[i] for i in np.unique(r)] or [np.empty(0, np.int64)]))] += 1
    telling = _surprise(hits, counts, 10.0)
    bar = np.log(np.count_nonzero(hits.sum(0)) + 1) + 2
    best_gram = np.array([telling[g].max(initial=0) for g in grams])
    suspect = _surprise(seen, counts, 2.5) > 0
    strong = suspect & (best_gram > bar)  # with letters that toxic documents have above any chance
    usable = np.array([len(g) >= 2 for g in grams])
    order = np.lexsort((-seen[1], -np.where(usable & suspect, best_gram, 0)))
    chosen, covered = [], set()
    for i in order:
        if len(chosen) == landmarks // 2 or best_gram[i] <= 0:
            break
        if not covered.issuperset(strongest := [int(g) for g in grams[i] if telling[g] > 0.5 * best_gram[i]]):
            chosen.append(i)
            covered.update(strongest)
    others = np.flatnonzero(usable)
    chosen += list(np.random.default_rng(seed).permutation(others)[: landmarks - len(chosen)])
    del grams, hits, telling
    flat, of = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    clean = np.flatnonzero(seen[0])
    explained = np.zeros(len(docs), bool)
    explained[of[strong[flat]]] = True
    toxic = np.where(strong if strong.any() else suspect, seen[1], 0.0)  # how many toxic documents a word stands for
    if not toxic.any():
        toxic = seen[1].copy()
    rng = np.random.default_rng(seed)
    space = None
    for step in range(rounds):
        if step < 2:
            table = None
            space = Landmarks([words[i] for i in dict.fromkeys(chosen)])
            table = space.embed(words, spare=3 * SPOILT)
        pos = np.flatnonzero(toxic)
        # the words found toxic stand with a letter put in somewhere, too
        often = pos[np.argsort(-toxic[pos], kind="stable")][:SPOILT]
        extra = len(words) + np.arange(3 * len(often))
        table[extra] = space.embed([_spoil(words[i], rng) for i in often for _ in range(3)])
        pick = np.concatenate((clean, pos, extra))
        sign = np.concatenate((-np.ones(len(clean)), np.ones(len(pos) + len(extra))))
        share = np.concatenate((np.log1p(seen[0][clean]), toxic[pos], np.repeat(toxic[often], 3)))
        for s in (-1, 1):
            share[sign == s] *= 0.5 * len(sign) / share[sign == s].sum()
        w, b = svm.fit(table, sign, cost=COST, weight=share, pick=pick)
        margin = table[: len(words)] @ w.astype(np.float32) + b
        best = np.full(len(docs), -np.inf)
        np.maximum.at(best, of, margin[flat])
        top = np.full(len(docs), -np.inf)
        np.maximum.at(top, of, np.where(suspect, margin, -np.inf)[flat])
        # strong words stay; a toxic document without any has its most toxic suspects
        near = (y[of] == 1) & suspect[flat] & (strong[flat] | (~explained[of] & (margin[flat] >= np.maximum(0, 0.7 * top[of]))))
        if not near.any():
            break
        toxic = np.bincount(np.unique(np.stack((of[near], flat[near])), axis=1)[1], minlength=len(words)).astype(float)
        if step == 0:
            # clean words that look most toxic become landmarks too: the machine can tell them apart then
            chosen += clean[np.argsort(-np.where(usable, margin, -np.inf)[clean], kind="stable")[: landmarks // 2]].tolist()
    has = np.isfinite(best)
    slope, shift = svm.platt(best[has], y[has], caution=4.0)
    spoken = [bare(words[i]) for i in np.flatnonzero(toxic * strong)] or [bare(words[i]) for i in np.flatnonzero(toxic)]
    found = _fit_windows(sample.text.fillna("").tolist(), y, space, sorted(set(spoken)), rng)
    return replace(found or Model(None), words=Machine(*space.folded(w), b, slope, shift))


@common.tidily
def _score(arrays: Iterator[pa.Array], model: Model, chars: int = 1 << 20) -> Iterator[pa.Array]:
    scores = Scores(1, partial(_margin_kernel, dense=model.words.dense()), _facts)
    dense = None if model.windows is None else model.windows.dense()
    for texts in arrays:
        out: list[np.ndarray] = []
        held: list[str] = []
        weight = 0
        for part in common.in_rows(texts):
            for text in part:
                held.append(text or "")
                weight += len(held[-1])
                if weight > chars:
                    out.append(_score_texts(held, scores, model, dense))
                    held, weight = [], 0
        out.append(_score_texts(held, scores, model, dense))
        yield pa.array(np.concatenate(out))


def _score_texts(texts: list[str], scores: Scores, model: Model, dense: np.ndarray | None) -> np.ndarray:
    cut = [split(t) for t in texts]
    size = np.array([len(c) for c in cut], np.int64)
    words = [w for c in cut for w in c]
    best = np.full(len(texts), FLOOR)
    if words:
        at = scores.rows(words)
        own, short = scores.table[at, 0], scores.facts[at, 0] > 0
        first = np.cumsum(size) - size
        best[size > 0] = np.maximum.reduceat(own, first[size > 0])
        if (short[2:] & short[1:-1] & short[:-2]).any():
            made, where = _joined(words, short, np.repeat(np.arange(len(texts)), size))
            if made:
                np.maximum.at(best, where, score_words(made, 1, scores.kernel)[:, 0])
    told = model.words.chance(np.maximum(best, FLOOR))
    if dense is not None and texts:
        told = np.maximum(told, model.windows.chance(np.maximum(_best_windows(texts, dense, model), FLOOR)))
    return told


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = 1200, chars: int = 5000) -> pd.DataFrame:
    """At most `rows` labelled texts of each class, of at most `chars` characters, outside the held-out fold.

    Rows are taken by the hash of doc_id. A doc_id with several labels has the largest,
    one with several texts the least, so any run takes the same.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~common.in_fold())
    picked = None
    for label in (0, 1):
        # twice as many, as some texts are longer than a sample's may be
        part = usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text").between(1, chars))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas()
    found["h"] = [hash_(i) for i in found.doc_id]
    return found.sort_values(["h", "doc_id"], kind="stable").groupby("toxic").head(rows)[["text", "toxic"]]


def hash_(i: int) -> int:
    return (int(i) * 0x9E3779B97F4A7C15 >> 7) & 0xFFFFFFFF


def scorer(model: Model):
    """A column function: text -> toxicity from 0 to 1."""
    from pyspark.sql.functions import arrow_udf

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _score(arrays, model)

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "double")


def with_toxicity(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """docs with a toxicity column from 0 to 1 over whole texts.

    One narrow pass; only the text goes through Python. Null, empty and wordless
    texts get the score of a text without any evidence; equal texts score alike. An
    empty table gives an empty result. Other columns (one named `column` is replaced),
    repeated rows and row order stay as they are.
    """
    return docs.withColumn(column, scorer(model)(F.col("text")))
