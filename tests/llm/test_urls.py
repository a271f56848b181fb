import re

import duckdb
import pytest

from plantspark.llm import queries, urls
from plantspark.llm.urls import ALLOW, BLOCK, PASSED, ROUNDS, UNITS, Rule

RULES = queries.URL_RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def plain(pages):
    """(page, host, path, rule, verdict) by rounds over dictionaries."""
    rows, links, seeds = [], {}, {ALLOW: {}, BLOCK: {}}
    for p, url, html in pages:
        host, path = split(url)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        rows.append((p, host, path, best))
        if host:
            for to in re.findall(r"""[\s"'/]href\s*+=\s*+(?:["']\s*+)?+(?:[a-z][a-z0-9+.-]*+:)?+//([^/?#"'\s<>\\]++)""", html or "", re.I):
                if to.lower() != host:
                    links[host, to.lower()] = links.get((host, to.lower()), 0) + 1
            if best:
                seeds[best.verdict][host] = seeds[best.verdict].get(host, 0) + 1
    scores = {}
    for verdict, ways in ((ALLOW, links), (BLOCK, {(b, a): n for (a, b), n in links.items()})):
        total = sum(seeds[verdict].values())
        base = {h: UNITS * (100 - PASSED) // 100 * n // total for h, n in seeds[verdict].items()}
        out = {}
        for (a, _), n in ways.items():
            out[a] = out.get(a, 0) + n
        now = base
        for _ in range(ROUNDS):
            new = dict(base)
            for (a, b), n in ways.items():
                if a in now:
                    new[b] = new.get(b, 0) + now[a] * n // out[a] * PASSED // 100
            now = new
        scores[verdict] = now
    return sorted(
        ((p, h, path, r.name if r else None, r.verdict if r else BLOCK if scores[BLOCK].get(h, 0) > scores[ALLOW].get(h, 0) else ALLOW)
        for p, h, path, r in rows), key=str
    )


def link(*hosts):
    return "<html>" + "".join(f'<a class="x" href="https://{h}/p?q">x</a>' for h in hosts) + "</html>"


PAGES = [
    (1, "https://good.org/a", link("fine.net", "fine.net", "good.org")),
    (2, "https://www.example.org/es/x", link("spam.net")),
    (3, "http://Fine.NET/x?y=https://a.org/", link("finer.net")),
    (4, "http://finer.net", None),
    (5, "http://farm.net/#top", link("spam.net", "bad.com", "www.example.org")),
    (6, "http://bad.com/de/1", link("farm.net", "good.org")),
    (7, "http://bad.com/en/1", ""),
    (8, "http://far.net/?q=1", link("farm.net") + "<a HREF = ' //BAD.com/de'>"),
    (9, "http://alone.net/p", "<a href='/own'>x</a><a href=mailto:x@bad.com>"),
    (10, "http://www.example.org/en/123", link("fine.net")),
    (11, "https://example.org/es", None),
    (12, "http://notexample.org/es/1", None),
    (13, "http://x.org", None),
]


def run(spark, rows):
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, RULE int").repartition(3)
    return urls.judge_urls(pages, RULES)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)


def test_rules_and_scores_as_by_dictionaries(spark):
    found = run(spark, PAGES)
    got = rows_of(found)
    assert got == plain(PAGES)
    by_page = {g[0]: g for g in got}
    assert by_page[3][1:] == ("fine.net", "/x", None, ALLOW) and by_page[4][4] == ALLOW
    assert by_page[2][3:] == ("example.org/es/", BLOCK) and by_page[10][3:] == ("example.org/en/1", BLOCK)
    assert by_page[11][3:] == ("org/", ALLOW) and by_page[13][3] is None, "the path is empty, the rule's is not"
    assert by_page[5][4] == BLOCK and by_page[8][4] == BLOCK, "who links to blocked hosts, and who links to them"
    assert by_page[9][4] == ALLOW
    scores = {r.host: (r.trust, r.distrust) for r in found.collect()}
    assert scores["finer.net"][0] > 0 == scores["finer.net"][1] and scores["alone.net"] == (0, 0)


def test_sql_twin_on_linked_pages(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    got = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op12_url_filter']})").fetchall()
    assert sorted(got, key=str) == plain(PAGES)


def test_nulls_repeated_rows_long_html(spark):
    rows = [
        (None, None, None), (None, "https://a.org/x", link("b.net")), (1, "", ""), (1, "no scheme", link("bad.com")), (2, "://", None),
        (2, "://", None), (3, "http://b.net/" + "p" * 50_000, "x" * 200_000 + link("a.org")), (4, "http://b.com/de/", " href=" + " " * 200_000),
        (4, "HTTP://B.COM/de/", " href=\"" + "\n" * 200_000), (5, "http://ÄB.net/ö?", "<a href=//é.net>"),
    ]
    got = [tuple(r) for r in run(spark, rows).select("page_id", "host", "path", "rule", "verdict").collect()]
    named = [(-1 if p is None else p, *r) for p, *r in rows]
    assert sorted(((-1 if g[0] is None else g[0], *g[1:]) for g in got), key=str) == sorted(plain(named), key=str)


def test_empty_table_and_no_rules(spark):
    assert run(spark, []).count() == 0
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert {(r.rule, r.verdict) for r in urls.judge_urls(pages, []).collect()} == {(None, ALLOW)}


def test_longest_rule_then_longer_host():
    with pytest.raises(ValueError):
        Rule("a.org", "/", "maybe")


def test_rounds_end_when_nothing_changes(spark):
    seeds = spark.createDataFrame([("a", 1, 0), ("d", 0, 3)], "host string, n_allow long, n_block long")
    chain = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("c", "d", 5)], "src string, dst string, n long")
    got = {r.host: (r.trust, r.distrust) for r in urls.propagate(seeds, chain).collect()}
    base = UNITS * 15 // 100
    step = [base, base * 85 // 100, base * 85 // 100 * 85 // 100]
    assert got["a"][0] == step[0] and got["b"][0] == step[1] and got["c"][0] == step[2]
    assert got["d"][1] == step[0] and got["c"][1] == step[1] and got["b"][1] == step[2]
