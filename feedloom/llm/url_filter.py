"""URL verdicts: rules for hosts and paths first, then a weighted vocabulary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Terms that reject a URL alone, and terms of which SOFT_LIMIT distinct ones do.
STRICT = ("porn", "porno", "xxx", "hentai", "nsfw", "camgirl", "camgirls", "warez", "phishing", "casino", "viagra")
SOFT = ("ads", "ad", "track", "tracker", "tracking", "click", "popup", "banner", "affiliate", "promo", "bet", "poker", "loan", "adult", "sex", "escort", "torrent", "crack", "keygen", "pharmacy")
SOFT_LIMIT = 2
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host is what follows the first :// up to / ? # or the end, A-Z lower-cased."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return host.translate(_LOWER), tail[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


class Vocabulary:
    """Counts of vocabulary terms in a URL, found by one Aho-Corasick pass.

    A term counts where no letter or digit (a-z, 0-9) stands right before or after it.
    """

    def __init__(self, strict: Sequence[str], soft: Sequence[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, terms in ((0, soft), (1, strict)):  # a term of both is strict
            for term in terms:
                self.automaton.add_word(term.translate(_LOWER), (kind, term))
        self.empty = not len(self.automaton)
        self.automaton.make_automaton()

    def hits(self, url: str | None) -> tuple[set[str], set[str]]:
        """The distinct (soft, strict) terms of a URL."""
        found: tuple[set[str], set[str]] = (set(), set())
        if not url or self.empty:
            return found
        low = url.translate(_LOWER)
        for end, (kind, term) in self.automaton.iter(low):
            start = end - len(term) + 1
            if not (start and _word(low[start - 1])) and not (end + 1 < len(low) and _word(low[end + 1])):
                found[kind].add(term)
        return found


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


class Rules:
    """Rules by host; the longest that fits a URL wins, by its host's length, then its path's."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        for held in self.by_host.values():
            held.sort(key=lambda x: (-len(x[0]), x))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        at = host
        while at:
            for start, verdict in self.by_host.get(at, ()):
                if path.startswith(start):
                    return at + start, verdict
            at = at.partition(".")[2]
        return None


def _judge(batches: Iterator[pa.RecordBatch], rules, strict, soft, limit) -> Iterator[pa.RecordBatch]:
    ruled, words = Rules(rules), Vocabulary(strict, soft)
    for batch in batches:
        rows = []
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            rule = ruled.find(host, path)
            some, one = words.hits(url)
            verdict = rule[1] if rule else "block" if one or len(some) >= limit else "allow"
            rows.append((host, path, rule and rule[0], verdict, len(one), len(some)))
        if rows:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, limit: int = SOFT_LIMIT) -> DataFrame:
    """A verdict for every row of pages(page_id, url, ...): one narrow pass over two columns.

    Returns page_id, host, path, rule (host and path of the rule that decided, or
    null), verdict (allow or block), and the numbers of distinct strict and soft
    terms. Without a rule a URL with one strict or `limit` distinct soft terms is
    blocked. A null URL or one without :// has an empty host and path; a null one has
    no terms. Repeated rows get a row each; further columns are ignored.
    """
    return pages.select("page_id", "url").mapInArrow(partial(_judge, rules=tuple(rules), strict=tuple(strict), soft=tuple(soft), limit=limit), "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")


ORACLE = f"""
WITH u AS (
  SELECT page_id, url, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM u
), t AS (SELECT *, {" + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){x}($|[^a-z0-9])')::INT" for x in STRICT)} AS strict_hits,
    {" + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){x}($|[^a-z0-9])')::INT" for x in SOFT)} AS soft_hits FROM h
), r AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM t)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN strict_hits >= 1 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits::INT AS strict_hits, soft_hits::INT AS soft_hits
FROM r"""
