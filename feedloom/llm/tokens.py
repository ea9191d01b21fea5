"""Token ids and counts of whole texts from public tokenizer files, cached by unit.

A text is cut only where its tokenizer cannot merge across, each distinct unit is
encoded once per worker, and a text's ids are its units' ids in order. The caches
are bounded: a full one becomes the older half, whose entries are lost if they are not
looked up until the next is full; this costs time and never changes a result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable

CACHE_UNITS = 300_000
# The normalising and splitting rules that the parts of plain units follow.
_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
_loaded: dict[tuple[str, str], object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest_of(*rules: object) -> str:
    return json.dumps(rules, sort_keys=True)


def file_digest(path: str) -> str:
    """The tokenizer's version: a digest of its file."""
    return hashlib.sha256(open(path, "rb").read()).hexdigest()


def _plain_letters() -> tuple[str, str]:
    """Character classes of the letters and of the other numbers below U+0250, lower case."""
    low = [chr(c) for c in range(0x250) if chr(c) != "İ"]
    pick = lambda kind: "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == kind and c == c.lower())
    return pick("L"), pick("N")


_LETTERS, _NUMBERS = _plain_letters()
#: Any character but a space, a line feed and those whose lower case and class one Unicode block or two fix.
_ODD = re.compile("[^ \n\x21-\x7e\xa1-\u012f\u0131-\u024f]").search
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \n{_LETTERS}{_NUMBERS}]+").findall


class Recent(dict):
    """A cache of what was looked up lately: between CACHE_UNITS entries and twice as many."""

    def __init__(self, make: Callable[[str], object]) -> None:
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> object:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def trim(self) -> None:
        if len(self) > CACHE_UNITS:
            self.older = dict(self)
            self.clear()


class JsonUnits:
    """Whole texts' little-endian uint32 ids, for a tokenizers .json file that drops white space.

    A text of plain characters is lower-cased and cut as the file says; each new part
    goes through the model alone. Another text is cut into runs without a space or a
    line feed, as the normaliser maps both to a space and the splitting pattern never
    spans one, and new runs go through the whole library. Special strings hold neither
    and are handled as the library does by default. A file with other rules has no
    plain texts.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        rules = json.loads(open(path, encoding="utf-8").read())
        self.known = digest_of(rules.get("normalizer"), rules.get("pre_tokenizer")) == digest_of(*_RULES)
        self.units, self.parts = Recent(self._unit), Recent(self._part)

    def _unit(self, unit: str) -> bytes:
        return array("I", self.whole.encode(unit, add_special_tokens=False).ids).tobytes()

    def _part(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        self.units.trim()
        self.parts.trim()
        unit, part, out = self.units.__getitem__, self.parts.__getitem__, []
        for t in texts:
            t = t or ""
            if self.known and not _ODD(t) and "<|" not in t:
                out.append(b"".join(map(part, _WORDS(t.lower()))))
            else:
                out.append(b"".join(map(unit, t.replace("\n", " ").split(" "))))
        return out


def _shown_bytes() -> dict[int, str]:
    """Byte-level vocabularies show a byte as itself if it is printable, else as one of the characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in plain)}


_SHOWN = _shown_bytes()


class PieceUnits:
    """Unit -> number of pieces, for a sentencepiece .model file with a dummy prefix.

    Pieces hold a word mark only in front, and never a line feed, so single spaces
    between other characters and line feeds are safe cuts. A line with another
    arrangement of spaces, or with the mark itself, is encoded whole.
    """

    _odd = re.compile("  |^ | $|▁", re.M)

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(("▁" in p[1:] and p.strip("▁")) or "\n" in p for p in pieces) and [len(self.model.encode(t)) for t in ("a b", "a\nb", " a", "a")] == [2, 3, 2, 1]
        self.mark = len(self.model.encode("\n"))
        self.units = Recent(lambda unit: len(self.model.encode(unit)))

    def counts(self, texts: list[str | None]) -> list[int]:
        self.units.trim()
        get, out = self.units.__getitem__, []
        for t in texts:
            t = t or ""
            if not self.cuts or self._odd.search(t):
                out.append(len(self.model.encode(t)))
                continue
            # a line after the first has no word mark in front: it is kept with its line feed
            first, *rest = t.split("\n")
            n = sum(map(get, first.split(" "))) if first else 0
            for line in rest:
                n += sum(map(get, ("\n" + line).split(" ")))
            out.append(n - self.mark_excess(first, len(rest)))
        return out

    def mark_excess(self, first: str, feeds: int) -> int:
        """Word marks that units with a line feed in front have and the text has not."""
        extra = self.mark - 1
        return extra * (feeds if first else max(0, feeds - 1))


def load(kind: type, path: str):
    """One cache per worker, tokenizer file and kind."""
    key = (kind.__name__, path)
    if key not in _loaded:
        _loaded[key] = kind(path)
    return _loaded[key]
