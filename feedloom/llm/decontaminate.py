"""Benchmark passages in documents: pigeonhole pieces, then Myers' bit-parallel distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_PLAIN = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_built: dict[bytes, Matcher] = {}

MATCHES = "doc_id long, item_id long, distance int, start int, stop int"


def normal(text: str | None) -> str:
    """Lower case, ASCII letters and digits and all other characters' UTF-8 bytes, single spaces between; a character per byte."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()).decode("latin-1")


def budget(length: int, rate: float) -> int:
    """Edits (insertions, deletions, substitutions of bytes) that an item of this length may differ by."""
    return int(length * rate)


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of text, and the first place where such a part ends."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Matcher:
    """Finds items in normalised texts. An item of length m and budget e is cut into e + 1
    pieces; a part within e edits holds one of them unchanged, close to its place."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items = [(i, s, budget(len(s), rate)) for i, s in items if s]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, s, e) in enumerate(self.items):
            cuts = [len(s) * k // (e + 1) for k in range(e + 2)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                places.setdefault(s[low:high], []).append((n, low))
        for piece, held in places.items():
            self.automaton.add_word(piece, (len(piece), held))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, stop) of each item's best part within its budget, the first if several."""
        if not self.items:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, held) in self.automaton.iter(text):
            for n, low in held:
                _, s, e = self.items[n]
                begin = end + 1 - size - low
                a, b = max(0, begin - e), min(len(text), begin + len(s) + e)
                own = windows.setdefault(n, [])
                if own and own[-1][0] <= a <= own[-1][1] and a - own[-1][0] <= 2 * e:
                    own[-1][1] = max(own[-1][1], b)  # the same part, seen through another piece
                elif not own or own[-1] != [a, b]:
                    own.append([a, b])
        out = []
        for n, own in windows.items():
            item_id, s, e = self.items[n]
            best = None
            for a, b in own:
                if best and best[0] == 0:
                    break
                distance, stop = myers(s, text[a:b])
                if distance <= e and (best is None or (distance, a + stop) < (best[0], best[2])):
                    _, back = myers(s[::-1], text[a : a + stop][::-1])
                    best = (distance, a + stop - back, a + stop)
            if best:
                out.append((item_id, *best))
        return out


def _matcher(items: list[tuple[int, str]], rate: float) -> Matcher:
    """One automaton per worker and set of items."""
    key = hashlib.blake2b(repr((items, rate)).encode("utf-8", "surrogatepass")).digest()
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, rate)
    return _built[key]


@common.tidily
def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], rate: float) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(items, rate)
    for batch in batches:
        texts = chain.from_iterable(common.in_rows(batch.column(1)))
        rows = [(doc_id, *hit) for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True) if text for hit in matcher.find(normal(text))]
        if rows:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "item_id", "distance", "start", "stop"])


def _blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks whose texts have at most about most_bytes together."""
    held = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length("text") > 0)
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // most_bytes)
    for part in range(parts):
        own = held.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield sorted({(-1 if r.item_id is None else r.item_id, normal(r.text)) for r in own.collect()})


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, most_bytes: int = 8 << 20) -> DataFrame:
    """Which benchmark items whole documents hold, up to int(rate * length) edits.

    docs(doc_id, text, ...), benchmark(item_id, text, ...). Returns a row per document
    row and item: doc_id, item_id, distance, and the start and stop of the best part in
    the normalised text (see normal()). Null and empty texts hold nothing, null and empty
    items are in nothing; a null item_id is -1; repeated items are one, repeated
    documents have rows each. Further columns are ignored.

    One narrow pass over the documents, whose tasks hold the items' automaton. The items
    are sized first: beyond most_bytes they are searched in blocks, a pass for each.
    """
    found = None
    for items in _blocks(benchmark, most_bytes):
        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_search, items=items, rate=rate), MATCHES)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], MATCHES) if found is None else found


def flag(docs: DataFrame, benchmark: DataFrame, column: str = "contaminated", rate: float = 0.06, most_bytes: int = 8 << 20) -> DataFrame:
    """docs with a boolean column: whether the text holds any item. Only the text goes through Python."""
    from pyspark.sql.functions import arrow_udf

    hit = F.lit(False)
    for items in _blocks(benchmark, most_bytes):
        hit = hit | arrow_udf(_flagger(items, rate), "boolean")(F.col("text"))
    return docs.withColumn(column, hit)


def _flagger(items: list[tuple[int, str]], rate: float):
    @common.tidily
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = _matcher(items, rate)
        for texts in arrays:
            yield pa.array([bool(t) and bool(matcher.find(normal(t))) for part in common.in_rows(texts) for t in part], pa.bool_())

    run.__annotations__ = {"arrays": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run
