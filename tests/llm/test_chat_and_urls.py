"""Chat collapse and URL verdicts against brute force."""

import random

import pytest

from feedloom.llm import chat, url_filter

TURNS = "conv_id long, turn long, role string, text string, position string"


def brute(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    told = {c: tuple((v[3], v[5]) for v in sorted(turns)) for c, turns in convs.items()}
    low = lambda c: (c is None, c or 0)
    out = set()
    for c, turns in told.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in told.values())
        twin = any(o == turns and low(d) < low(c) for d, o in told.items())
        if not longer and not twin:
            out |= {(c, len(turns), i, f"<|im_start|>{r}\n{x}<|im_end|>\n") for i, (r, x) in enumerate(turns)}
    return out


def collapsed(spark, rows):
    return {(r.conv_id, r.n_turns, r.position, r.rendered) for r in chat.collapse_and_render(spark.createDataFrame(rows, TURNS)).collect()}


def test_prefixes_go_and_maximal_conversations_stay(spark):
    rng = random.Random(5)
    rows = []
    for c in range(60):
        turns = [rng.choice("ab") for _ in range(rng.randint(1, 4))]
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", x, "extra") for t, x in enumerate(turns)]
    rng.shuffle(rows)
    assert collapsed(spark, rows) == brute(rows)


def test_nulls_ties_repeats_gaps_and_long_texts(spark):
    rows = [
        (1, 0, "user", "hi", None), (1, 1, "assistant", None, None),
        (2, 0, "user", "hi", None), (2, 1, "assistant", "", None), (2, 7, None, "x" * 200_000, None),
        (3, None, "user", "hi", None), (None, 0, "user", "hi", None), (None, 0, "user", "hi", None),
        (4, 5000, "user", "hi", None), (4, -3, "user", "hi", None), (4, 9000, "user", "no", None),
    ]
    assert collapsed(spark, rows) == brute(rows)
    assert collapsed(spark, []) == set()


def test_a_conversation_of_many_chunks(spark):
    rows = [(1, t, "user", str(t % 7), None) for t in range(5000)] + [(2, t, "user", str(t % 7), None) for t in range(4999)] + [(3, t, "user", "0", None) for t in range(3)]
    got = collapsed(spark, rows)
    assert {c for c, *_ in got} == {1, 3} and len(got) == 5003


@pytest.mark.parametrize(
    "url,expected",
    [
        (None, ("", "")), ("", ("", "")), ("example.com/en/", ("", "")), ("http://A.Com", ("a.com", "")), ("x://h?q=://z/", ("h", "")),
        ("https://www.Example.com/EN/a?b#c", ("www.example.com", "/EN/a")), ("http://h#f/p", ("h", "")), ("http:///p", ("", "/p")), ("a://É.com/x", ("É.com", "/x")),
    ],
)
def test_split_url(url, expected):
    assert url_filter.split_url(url) == expected


def test_rules_and_vocabulary(spark):
    urls = {
        "http://www.example.com/en/1": ("www.example.com/en/", "allow"), "http://m.example.com/en/1": ("example.com/en/", "block"),
        "http://example.com/fr/porn": ("com/", "allow"), "http://a.net/es/": ("net/es/", "block"), "http://anet/es/": (None, "allow"),
        "http://com": (None, "allow"), "http://a.com": (None, "allow"), "http://a.org/porn": (None, "block"), "http://a.org/pornx": (None, "allow"),
        "http://ads.a.org/ads": (None, "allow"), "http://ads-track.a.org/": (None, "block"), "http://a.org/ADS/x?Click=1": (None, "block"),
        "http://a.org/loads/track": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "casino": (None, "block"), "http://a.net/fr": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values())
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_vocabulary_against_plain_search():
    import re

    words = url_filter.Vocabulary(url_filter.STRICT, url_filter.SOFT)
    rng = random.Random(2)
    for _ in range(500):
        url = "".join(rng.choice([*url_filter.STRICT, *url_filter.SOFT, "-", "/", "x", "9", "É", "."]) for _ in range(6))
        soft, strict = words.hits(url)
        find = lambda terms: {t for t in terms if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", url)}  # noqa: B023, E731
        assert (soft, strict) == (find(url_filter.SOFT), find(url_filter.STRICT))
    assert url_filter.Vocabulary((), ()).hits("http://ads") == (set(), set())
