import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import queries, url_rules

RULES = queries.SITES + queries.PATTERNS
LINES = ["bets", "^bets^", "||bets.", "*bets*", "a*bets/|", "|m.a", "||a.com^", "||a.com/*/x|", "/ads/*/b-*c^", "@@||a.com/ok", "@@/ads/ok|", "x^*^y", "é*bets", "||net/x", "net|", "a b", "|", "||*z|"]


def full_scan(rules, host, path):
    """Every rule, by its plain expression."""
    text = host + path
    hits = [r for r in rules if re.search(r.plain, url_rules_lower(text) if r.folded else text, re.DOTALL)]
    return min(hits, key=lambda x: (-x.rank, -len(x.name), x.name), default=None)


def url_rules_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_index_runs_the_same_rules_as_a_full_scan(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in url_rules.judge(pages, RULES).collect():
        best = full_scan(RULES, *url_rules.split_url(r["url"]))
        assert (r["rule"], r["verdict"]) == ((best.name, best.verdict) if best else (None, "allow"))


PIECES = ["a", "A", "bets", "Bets", "X", ".", "/", "-", "_", "^", "com", "a.com", "net", "\n", "\r", "é", "K", "İ", "/ads/", "ok", "b-", "c", "m.a", "z", "y", "%", " "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), st.lists(st.sampled_from(PIECES), max_size=6).map("".join), st.lists(st.lists(st.sampled_from([*PIECES, "*", "|", "||", "@@"]), min_size=1, max_size=6).map("".join), max_size=4), st.dictionaries(st.sampled_from(["a", "bets", "com", "net", "x"]), st.integers(0, 9)))
def test_index_equals_a_full_scan_on_any_text(host, path, more, counts):
    rules = [url_rules.site_rule(s, "block") for s in ("net/", "a.com/A", "com/", "a.com/bets")]
    for line in [*LINES, *more]:
        try:
            rules.append(url_rules.pattern_rule(line))
        except ValueError:
            assert set(line.strip()) <= set("@|*")
    host, path = url_rules_lower(host.split("/")[0].replace("?", "").replace("#", "")), "/" + path if path else ""
    assert url_rules.Index(rules, counts).best(host, path) == full_scan(rules, host, path)


def test_line_feeds_and_case_as_they_were_missed_before():
    rules = [url_rules.pattern_rule("bets"), *queries.SITES]
    index = url_rules.Index(rules, {})
    assert index.best(*url_rules.split_url("http://a.com/Xbets/")).name == "bets"
    assert index.best(*url_rules.split_url("http://a.com/x.net\n/")) is None


def test_rarest_token_files_the_rule():
    rule = url_rules.pattern_rule("/ads/*/banner^")
    assert rule.tokens == ("ads", "banner")
    assert list(url_rules.Index([rule], {"ads": 9, "banner": 3}).by_token) == ["banner"]
    assert list(url_rules.Index([rule], {"ads": 2, "banner": 3}).by_token) == ["ads"]
    index = url_rules.Index(RULES, {"example": 10, "com": 5, "org": 5, "net": 4})
    assert index.candidates("quite.other.host/path") == index.always == []


def test_wildcards_take_linear_time():
    rule = url_rules.pattern_rule("a*b*a*b*a*c*d|")
    text = "ab" * 200_000
    index = url_rules.Index([rule], {})
    assert index.best(text, "") is None
    assert index.best(text, "/cd") == rule


def test_contract_cases(spark):
    urls = [
        (1, "HTTP://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://example.net/de/", "example.net", "/de/", "net/", "block"),
        (3, "http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (4, "x://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
        (5, "http://x.net", "x.net", "", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme.net/", "", "", None, "allow"),
        (8, "http://my.bets.example.com/de/1", "my.bets.example.com", "/de/1", "example.com/de/", "block"),
        (9, "http://my.bets.example.com/fr/1", "my.bets.example.com", "/fr/1", "||bets.", "block"),
        (10, "", "", "", None, "allow"),
        (10, "http:///net/", "", "/net/", None, "allow"),
        (11, "http://example.com/DE/", "example.com", "/DE/", None, "allow"),
        (12, "http://example.com/" + "ads/" * 500_000, "example.com", "/" + "ads/" * 500_000, "/ads/", "block"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u, *_ in urls], "page_id long, url string, host string, verdict string")
    got = url_rules.judge(pages, RULES).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got) == sorted((i, h, p, r or "", v) for i, _, h, p, r, v in urls)
    assert url_rules.judge(pages.limit(0), queries.SITES).count() == 0
    assert url_rules.judge(pages.select(F.col("page_id"), F.col("url")), []).where("verdict = 'block'").count() == 0


def test_lists_are_read_with_their_errors():
    assert [r.name for r in url_rules.pattern_rules(["! a", "", " /X/ ", "@@b"])] == ["/x/", "@@b"]
    for line in ("*", "||", "@@|", "**|"):
        with pytest.raises(ValueError, match="pattern"):
            url_rules.pattern_rule(line)
    with pytest.raises(ValueError, match="rules"):
        url_rules.Index([url_rules.pattern_rule("a")] * (url_rules.MAX_RULES + 1), {})
    assert url_rules.site_rule("example.com/de", "block").tokens == ("example", "com")
