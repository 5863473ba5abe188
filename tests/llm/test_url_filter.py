import random
import re

import pytest

from brightmill.llm import url_filter


def brute(glob, text):
    return re.fullmatch("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob), text, re.S) is not None


def test_masks_like_regular_expressions():
    rng = random.Random(1)
    rules = [(i, "".join(rng.choice("ab*?*c") for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(90, "*" * 5 + "a"), (91, "x" * 130 + "*")]
    texts = ["", "x" * 131, "x" * 129] + ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = url_filter.Automaton(rules).matches(texts)
    for i, t in enumerate(texts):
        for j, (_, glob) in enumerate(rules):
            assert got[i, j] == brute(glob, t), (glob, t)


def test_awkward_rows(spark):
    long = "https://a.example/" + "y" * 50_000 + ".html"
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, " HTTP://User@Casino.EXAMPLE:80/a/?utm_source=q#z ", "x"), (3, long, None), (3, long, None), (4, "https://ü.example/漢?", "x")], "page_id bigint, url string, html string")
    rows = sorted(url_filter.filtered(pages).collect(), key=lambda r: (r.page_id or 0))
    assert [(r.page_id, r.matched, r.blocked) for r in rows] == [(None, "1,8", True), (1, "", False), (2, "", False), (3, "7", False), (3, "7", False), (4, "", False)]
    assert rows[0].canonical_url == "http://casino.example/a" and rows[1].canonical_url is None
    assert url_filter.filtered(pages, rules=[]).filter("matched <> ''").count() == 0 and url_filter.filtered(pages.limit(0)).count() == 0


def test_rules_of_a_table(spark, monkeypatch):
    rows = [(2, "*b*", True), (1, "*a*", None), (2, "*b*", True), (3, None, True), (None, "*", True), (4, "?" * 200, False)]
    table = spark.createDataFrame(rows, "rule_id int, glob string, blocks boolean")
    rules, blocking = url_filter.rules_of(table)
    assert rules == [(1, "*a*"), (2, "*b*"), (4, "?" * 200)] and blocking == (2,)
    pages = spark.createDataFrame([(1, "x://a"), (2, "x://ab"), (3, "x://" + "c" * 196)], "page_id bigint, url string")
    want = [("1", False), ("1,2", True), ("4", False)]
    assert [(r.matched, r.blocked) for r in url_filter.filtered(pages, rules, blocking).orderBy("page_id").collect()] == want
    monkeypatch.setattr(url_filter, "STATE_BYTES", 1)
    assert [(r.matched, r.blocked) for r in url_filter.filtered(pages, rules, blocking).orderBy("page_id").collect()] == want
    monkeypatch.setattr(url_filter, "RULE_BYTES", 10)
    with pytest.raises(ValueError):
        url_filter.rules_of(table)
