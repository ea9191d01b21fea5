"""Interleaved document sequences and the store of their media payloads."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SEQUENCE = "page_id long, sequence array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_SKIP = {"script", "style", "noscript", "template", "head"}
_MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "embed": "src", "object": "data"}
_INLINE = {"a", "b", "i", "em", "strong", "span", "u", "s", "small", "sub", "sup", "code", "mark", "abbr", "q", "cite", "time", "font"}
_VOID = {"img", "br", "hr", "meta", "link", "input", "source", "embed", "wbr", "area", "base", "col", "track"}
WIDTH = 64


class _Reader(HTMLParser):
    """Collects text runs and media references in the order of the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []  # kind, text, ref, caption
        self.text: list[str] = []
        self.skipped = 0
        self.figures: list[int] = []  # for each open figure, how many rows stood before it
        self.caption: list[str] | None = None

    def flush(self) -> None:
        run = " ".join("".join(self.text).split())
        self.text = []
        if run:
            self.out.append(["text", run, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.skipped += 1
        if self.skipped:
            return
        if tag in _MEDIA:
            found = dict(attrs)
            if ref := (found.get(_MEDIA[tag]) or "").strip():
                self.flush()
                self.out.append(["media", None, ref, " ".join((found.get("alt") or "").split()) or None])
            return
        if tag not in _INLINE:
            self.flush() if self.caption is None else self.caption.append(" ")
        if tag == "figure":
            self.figures.append(len(self.out))
        elif tag == "figcaption" and self.figures:
            self.caption = []

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        if self.skipped:
            return
        if tag == "figcaption" and self.caption is not None:
            self.close_caption()
        elif tag == "figure" and self.figures:
            self.close_caption()
            self.flush()
            first, caption = self.figures.pop(), None
            for row in self.out[first:]:
                caption = row[1] if row[0] == "caption" else caption
            for row in self.out[first:]:
                if row[0] == "media" and caption:
                    row[3] = caption
            self.out[first:] = [row for row in self.out[first:] if row[0] != "caption"]
        elif tag not in _INLINE and tag not in _VOID:
            self.flush() if self.caption is None else self.caption.append(" ")

    def close_caption(self) -> None:
        if self.caption is not None:
            self.flush()
            if run := " ".join("".join(self.caption).split()):
                self.out.append(["caption", run, None, None])
            self.caption = None

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            (self.text if self.caption is None else self.caption).append(data)

    def rows(self, html: str) -> list[tuple]:
        self.feed(html)
        self.close()
        self.close_caption()
        self.flush()
        # a figure that is never closed keeps its caption as text
        out = [["text", *row[1:]] if row[0] == "caption" else row for row in self.out]
        return [(i, *row) for i, row in enumerate(out)]


def parse(html: str | None) -> list[tuple]:
    """(position, kind, text, ref, caption) of a page, in order; positions are gapless from 0."""
    return _Reader().rows(html) if html else []


@common.tidily
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
    names = ("position", "kind", "text", "ref", "caption")
    for batch in batches:
        told = [[dict(zip(names, row, strict=True)) for row in parse(html)] for html in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(told, kind)], ["page_id", "sequence"])


def interleave(pages: DataFrame) -> DataFrame:
    """(page_id, sequence) of pages(page_id, html, ...): one narrow pass.

    The sequence holds structs of position, kind (text or media), text, ref and caption.
    Scripts, styles and heads are left out; white space is collapsed; a block element
    ends a run of text. A media reference's caption is its figure's figcaption, else its
    alt text, else null. Null and empty pages have an empty sequence. Repeated rows have
    a row each; further columns are ignored.
    """
    return pages.select("page_id", "html").mapInArrow(_parse, SEQUENCE)


def digest_of(ref: Column) -> Column:
    """The payload's digest that a reference names as sha256:<hex>, else null."""
    return F.when(ref.rlike("^sha256:[0-9a-f]{64}$"), F.substring(ref, 8, 64))


def payload_of(text: Column) -> Column:
    """UTF-8 bytes (null: none) and zero bytes up to a positive multiple of 64."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    short = F.when(F.octet_length(data) == 0, F.lit(WIDTH)).otherwise(F.pmod(-F.octet_length(data), F.lit(WIDTH)))
    return F.concat(data, F.substring(F.lit(bytes(WIDTH)), F.lit(1), short))


def as_image(payload: Column) -> Column:
    """A payload of a multiple of 64 bytes as a grey image (binary PGM) of 64 8-bit samples a row."""
    rows = (F.octet_length(payload) / WIDTH).cast("int").cast("string")
    return F.concat(F.concat(F.lit(f"P5\n{WIDTH} "), rows, F.lit("\n255\n")).cast("binary"), payload)


_HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")


def read_image(media: bytes) -> bytes:
    """The samples of a stored image."""
    found = _HEADER.match(media)
    if not found:
        raise ValueError("not a stored image")
    samples = media[found.end() :]
    if len(samples) != int(found[1]) * int(found[2]):
        raise ValueError("a stored image is cut short")
    return samples


def feature(samples: bytes) -> str:
    """The mean and spread of all samples and the mean of each sixteenth of a row, as text."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    total = rows.sum(0, dtype=np.int64)
    n = rows.size
    mean = int(total.sum()) / n
    spread = (int(np.einsum("ij,ij->", rows, rows, dtype=np.int64)) / n - mean * mean) ** 0.5 if n else 0.0
    parts = total.reshape(16, -1).sum(1) * 16 // n
    return f"{mean:.4f};{max(0.0, spread):.4f};" + ",".join(map(str, parts.tolist()))


@common.tidily
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column(0), batch.column(1), strict=True):
            media = media.as_py()
            samples = read_image(media)
            rows.append((digest.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        if rows:
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in STORED.split(", ")])


STORED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(payloads: DataFrame, path: str) -> DataFrame:
    """Write (digest, payload) as images to a media store and return the table of it, (digest, media).

    A digest may stand in the store several times; readers take any one, as all are alike.
    """
    payloads.select("digest", as_image(F.col("payload")).alias("media")).write.mode("append").option("compression", "zstd").parquet(path)
    return payloads.sparkSession.read.schema("digest string, media binary").parquet(path)


def describe(stored: DataFrame) -> DataFrame:
    """Features of stored media, from the stored bytes read back: a row per digest.

    The bytes stay where they are read; what travels to be joined is a small row.
    """
    seen = stored.mapInArrow(_describe, STORED)
    names = [x.split()[0] for x in STORED.split(", ")[1:]]
    return seen.groupBy("digest").agg(F.min(F.struct(*names)).alias("m")).select("digest", "m.*")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """Sequences' elements, a row each, media references joined by digest with `media`.

    Returns page_id, position, kind, text, ref, caption, digest and media's other
    columns, which are null for text and for references that media doesn't hold.
    Positions and captions stay those of the sequence.
    """
    rows = sequences.select("page_id", F.explode("sequence").alias("e")).select("page_id", "e.*")
    rows = rows.withColumn("digest", digest_of(F.col("ref")))
    found = rows.filter(F.col("digest").isNotNull()).join(media, "digest", "left")
    plain = rows.filter(F.col("digest").isNull())
    return found.unionByName(plain, allowMissingColumns=True)


def document_pages(docs: DataFrame) -> DataFrame:
    """Documents as pages (page_id, html): a paragraph, then a figure that names the payload's digest."""
    payload = payload_of(F.col("text"))
    html = F.concat(F.lit("<article><p>document</p><figure><img src=\"sha256:"), F.sha2(payload, 256), F.lit("\"><figcaption>"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("string"), F.lit("</figcaption></figure></article>"))
    return docs.select(F.col("doc_id").cast("long").alias("page_id"), html.alias("html"))


def document_media(docs: DataFrame) -> DataFrame:
    """Every document's text as a stored medium, read back and described.

    Returns doc_id, n_bytes and the columns of describe(); a row per row of docs.
    """
    payload = payload_of(F.col("text"))
    stored = store(docs.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")), common.scratch_path(docs.sparkSession, "media"))
    facts = common.scratch(describe(stored), "features")
    told = resolve(interleave(document_pages(docs)), facts).filter("kind = 'media'")
    return told.select(F.col("page_id").alias("doc_id"), F.col("caption").cast("long").alias("n_bytes"), *[x.split()[0] for x in STORED.split(", ")[1:]])
