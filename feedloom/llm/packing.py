"""Bounded-space online best-fit packing of token sequences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import JsonUnits, load, tokenizer_path

END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])


class OpenBins:
    """At most `most` open bins of `size`; a bitset has a bit for each free space in use.

    A piece goes into the open bin that it leaves the least space in. If none has
    room, a new bin is opened, and if that is one too many the fullest is closed.
    A bin without space is closed at once.
    """

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.bits = 0
        self.by_free: list[list[list]] = [[] for _ in range(size + 1)]
        self.n_open = 0
        self.n_bins = 0
        self.closed: list[list] = []  # [number, rows]; each row ends with its offset

    def _take(self, free: int) -> list:
        bins = self.by_free[free]
        got = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.n_open -= 1
        return got

    def add(self, length: int, row: tuple) -> None:
        room = self.bits >> length
        if room:
            free = length + (room & -room).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.n_open == self.most:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, bin_ = self.size, [self.n_bins, []]
            self.n_bins += 1
        bin_[1].append((*row, self.size - free))
        free -= length
        if free == 0:
            self.closed.append(bin_)
            return
        if not self.by_free[free]:
            self.bits |= 1 << free
        self.by_free[free].append(bin_)
        self.n_open += 1

    def drain(self) -> list[list]:
        out, self.closed = self.closed, []
        return out

    def rest(self) -> list[tuple[int, list]]:
        """The open bins at the end, each with its free space."""
        return [(free, bin_) for free, bins in enumerate(self.by_free) for bin_ in bins]


def _rows(bins: list[list], base: int, still_open: bool) -> Iterator[pa.RecordBatch]:
    rows = [(*row[:5], base + number, row[5], still_open) for number, held in bins for row in held]
    if rows:
        cols = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)


@common.tidily
def _pack_texts(batches: Iterator[pa.RecordBatch], path: str, size: int, most: int, slack: int) -> Iterator[pa.RecordBatch]:
    units = load(JsonUnits, path)
    base = TaskContext.get().partitionId() << 32
    bins = OpenBins(size, most)
    end, step = END_ID.to_bytes(4, "little"), 4 * size
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            for doc_id, ids in zip(part.column(0).to_pylist(), units.ids(part.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    bins.add(len(own) // 4, (doc_id, piece, at // 4, len(own) // 4, own))
            if len(bins.closed) >= 1024:
                yield from _rows(bins.drain(), base, False)
    yield from _rows(bins.drain(), base, False)
    rest = bins.rest()
    yield from _rows([b for free, b in rest if free <= slack], base, False)
    yield from _rows([b for free, b in rest if free > slack], base, True)


@common.tidily
def _pack_again(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    base = (1 << 62) + (TaskContext.get().partitionId() << 32)
    bins = OpenBins(size, most)
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            for row in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                bins.add(row[3], row)
            if len(bins.closed) >= 1024:
                yield from _rows(bins.drain(), base, False)
    yield from _rows(bins.drain(), base, False)
    yield from _rows([b for _, b in bins.rest()], base, False)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", size: int = 2048, open_bins: int = 128, slack: int = 8, partitions_together: int = 8) -> DataFrame:
    """Sequences of at most `size` tokens from documents(doc_id, text, ...).

    A document is its ids without added special tokens, then id 0; a null or empty
    text is id 0 alone. Only documents longer than `size` are cut, into pieces of
    `size`; the last may be shorter. Returns one row per piece: doc_id (null stays
    null), piece, start, length, ids (little-endian uint32), sequence_id, offset.
    Offsets are gapless from 0 in each sequence. Rows that repeat a doc_id are packed
    as documents of their own; of bins with equal space the last opened or changed
    takes a piece. An empty table gives an empty result. Further columns are ignored.

    Every partition packs online in one pass, with `open_bins` bins open. What is
    left in bins with more than `slack` free tokens when a partition ends is packed
    once more in the same way and order, online, with that of the other partitions of
    its group. A group is `partitions_together` neighbouring partitions and one task,
    which holds the pieces of at most open_bins * partitions_together sequences.
    """
    first = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_pack_texts, path=tokenizer_path(tokenizer), size=size, most=open_bins, slack=slack), PIECES + ", open boolean")
    first = common.scratch(first, "packed")
    left, done = first.filter("open"), first.filter("not open").drop("open")
    last = left.agg(F.max(source_partition())).first()[0]
    if last is None:
        return done
    again = groups(left, last, partitions_together).sortWithinPartitions("sequence_id", "offset")
    again = again.drop("open").mapInArrow(partial(_pack_again, size=size, most=open_bins * partitions_together), PIECES + ", open boolean").drop("open")
    return done.unionByName(again)


def source_partition() -> Column:
    """The partition of the first pass that opened a sequence."""
    return F.shiftright("sequence_id", 32)


def groups(left: DataFrame, last: int, together: int) -> DataFrame:
    """The rows of every `together` neighbouring source partitions (numbered to `last`) as one partition."""
    group = F.floor(source_partition() / together).cast("int")
    return left.repartitionById(last // together + 1, group)
