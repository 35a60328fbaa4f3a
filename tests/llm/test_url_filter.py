"""URL verdicts against plain Python."""

import random

import pytest

from mnemosia.llm import url_filter as U

RULES = [U.host_rule(*r) for r in U.BASE_RULES] + [U.label_rule(x) for x in U.BLOCKED_LABELS]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = sorted([(-len(h + p), h + p, v) for v, h, p in U.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)])
    if fits:
        return host, path, fits[0][1], fits[0][2]
    blocked = any(f".{x}." in f".{host}." for x in U.BLOCKED_LABELS)
    return host, path, None, "block" if blocked and host else "allow"


URLS = [
    None, "", "no scheme", "http://", "://", "https://EXAMPLE.org/es/x", "https://example.org/es", "http://example.org/en/1", "http://example.org/en/12/3?q=/es/", "http://a.b.example.org/en/2",
    "http://notexample.org/es/1", "http://x.com/fr/", "http://x.com/FR/", "http://x.com/de/?a", "http://com/de/", "http://xcom/de/", "http://x.com/a/fr/", "http://x.org", "http://x.org?y/", "http://org/", "x://y://z.org/",
    "http://casino.net/", "http://casino.net/es/", "http://my.porn.site.com/fr/", "http://casinos.net/", "http://tracker", "http://x.net/tracker", "http://user@x.org/", "http://x.org:80/", "http://é.org/é/", "a\nb://c.org/\n", "http://exampleXorg/es/",
]


def test_equals_plain_rules(spark):
    rng = random.Random(1)
    bits = ["http://", "example", ".", "org", "com", "/", "es/", "en/1", "fr/", "de/", "?", "#", "casino", "XXX", "a", "porn."]
    urls = URLS + ["http://" + "".join(rng.choices(bits, k=rng.randrange(1, 9))) for _ in range(400)]
    rows = list(enumerate(urls)) + [(0, URLS[5])]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted((r.page_id, r.host, r.path, str(r.rule), r.verdict) for r in U.filter_urls(pages, RULES).collect())
    expected = [(i, *(str(x) if k == 2 else x for k, x in enumerate(plain(u)))) for i, u in rows]
    assert got == sorted(expected)


def test_empty_table_and_other_columns(spark):
    pages = spark.createDataFrame([(None, "http://a.org/", "h", 1)], "page_id long, url string, host string, rule int")
    assert [tuple(r)[:5] for r in U.filter_urls(pages, RULES).collect()] == [(None, "a.org", "/", "org/", "allow")]
    assert U.filter_urls(pages.where("false"), RULES).collect() == []


def test_a_rule_needs_a_literal(spark):
    with pytest.raises(ValueError):
        U.filter_urls(spark.createDataFrame([], "page_id long, url string"), [("x", "block", ".", [], 1)])


def test_thousands_of_patterns(spark):
    """Whole tokens are read off the patterns; the verdicts are those of trying every rule on every URL."""
    import fnmatch

    assert U.pattern_rule("block", "*.ads.*", "/a*b/cd", "x_y=*z")[3] == ["ads", "cd", "x", "y"]
    rng = random.Random(2)
    names = [f"n{k}" for k in range(60)]
    rules = []
    for k in range(3000):
        host = rng.choice(["*", f"*.{rng.choice(names)}.com", f"{rng.choice(names)}.*"])
        path = rng.choice(["*", f"/{rng.choice(names)}/*", f"*/{rng.choice(names)}", f"/{rng.choice(names)}*/{rng.choice(names)}/x{k % 50}"])
        query = rng.choice(["*", "*", f"*{rng.choice(names)}={rng.choice(names)}", f"{rng.choice(names)}_id=*"])
        made = U.pattern_rule(rng.choice(["block", "allow"]), host, path, query, priority=-(k % 7))
        rules += [(made, host, path, query)] if made[3] else []
    urls = []
    for _ in range(500):
        host = ".".join(rng.choices(names, k=rng.randrange(1, 3))) + ".com"
        path = "".join(f"/{rng.choice([*names, 'x7'])}" for _ in range(rng.randrange(4)))
        urls.append(f"http://{host}{path}" + rng.choice(["", f"?{rng.choice(names)}={rng.choice(names)}", f"?{rng.choice(names)}_id=7#{rng.choice(names)}"]))
    got = {r.page_id: (r.matched_rule, r.verdict) for r in U.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), [r[0] for r in rules]).collect()}
    hits = 0
    for k, url in enumerate(urls):
        rest = url.split("://")[1].split("#")[0]
        place, _, query = rest.partition("?")
        host, _, path = place.partition("/")
        path = "/" + path if "/" in place else ""
        fits = [(-m[4], m[0], m[1]) for m, h, p, q in rules if all(fnmatch.fnmatchcase(x, y) for x, y in ((host, h), (path, p), (query, q)))]
        best = min(fits, default=(0, None, "allow"))
        hits += best[1] is not None
        assert got[k] == best[1:]
    assert hits > 100
