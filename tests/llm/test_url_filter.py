import re

import duckdb
import pytest

from litspark.llm import url_filter as U

PAGES = [(1, "http://A.example.com/en/x?q=/y", None), (2, "https://www.example.com/en/", '<a href="http://bad.net/">'),
         (3, "http://bad.net/fr/1", '<a href=//Good.org/x>'), (4, "http://good.org/z", "<a HREF='https://bad.net/fr/'>"),
         (5, None, "x"), (6, "no host", ""), (7, "http://lone.io", None), (8, "http://bad.net/other#://x/en/", None),
         (9, "http://notexample.com", None), (10, "http://com/", None), (11, "://?x", None), (12, "a://b://c/d", None)]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(pages, rounds=U.ROUNDS, d=U.DAMPING):
    hosts = {i: parts(u) for i, u, _ in pages}
    edges = {}
    for i, _, html in pages:
        for h in re.findall(r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html or ""):
            h = h.lower()
            if h and hosts[i][0] and h != hosts[i][0]:
                edges[hosts[i][0], h] = edges.get((hosts[i][0], h), 0) + 1
    todo, ups = {h for h, _ in hosts.values()} | {b for _, b in edges}, set()
    for h in todo:
        while len(h.split(".")) > 2:
            ups.add((h, h.split(".", 1)[1]))
            h = h.split(".", 1)[1]
    for a, b in ups:
        edges[a, b] = edges.get((a, b), 0) + 1
        edges[b, a] = edges.get((b, a), 0) + 1
    score = {}
    for kind, want in (("trust", "allow"), ("distrust", "block")):
        e = edges if kind == "trust" else {(b, a): w for (a, b), w in edges.items()}
        seed = {}
        for h, p in hosts.values():
            if rule(h, p)[1] == want:
                seed[h] = seed.get(h, 0) + 1
        seed = {h: n / sum(seed.values()) for h, n in seed.items()}
        out = {}
        for (a, _), w in e.items():
            out[a] = out.get(a, 0) + w
        s = dict(seed)
        for _ in range(rounds):
            new = {h: (1 - d) * x for h, x in seed.items()}
            for (a, b), w in e.items():
                if a in s:
                    new[b] = new.get(b, 0) + d * s[a] * w / out[a]
            s = new
        score[kind] = s
    out = []
    for i, (h, p) in hosts.items():
        r, v = rule(h, p)
        bad = round(score["distrust"].get(h, 0) - score["trust"].get(h, 0), 9) > 0
        out.append((i, h, p, r, v or ("block" if bad else "allow")))
    return out


@pytest.mark.parametrize("pages", [PAGES, PAGES[4:6], PAGES[:1] * 3])
def test_verdicts(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as rule")
    got = [tuple(r) for r in U.filter_urls(df).collect()]
    want = brute(pages) if len({p[0] for p in pages}) == len(pages) else brute(pages[:1]) * len(pages)
    assert sorted(got) == sorted(want)


def test_distrust_reaches_a_linking_host(spark):
    spam = (20, "http://spam.biz/", "<a href='http://bad.net/fr/'>")
    df = spark.createDataFrame([*PAGES, spam], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(df).collect()}
    assert got[7] == "allow" and got[20] == "block"
    assert U.filter_urls(df.limit(0)).count() == 0


def test_verdicts_do_not_depend_on_size_or_distance(spark):
    """Small seeds among many others count, and so do hosts many steps from a seed; unknown hosts are allowed."""
    many = [(i, f"http://spam{i % 40}.net/fr/", None) for i in range(100, 4100)]
    # One blocked page, whose distrust reaches 5,000 sibling hosts through their domain.
    siblings = [(5000, "http://s0.tail.org/", "<a href='http://deep.net/fr/'>"), (5001, "http://deep.net/fr/", None)]
    siblings += [(5001 + i, f"http://s{i}.tail.org/", None) for i in range(1, 5000)]
    chain = [(20000 + i, f"http://c{i}.io/", f"<a href='http://c{i + 1}.io/'>") for i in range(30)]
    chain += [(20030, "http://c30.io/", "<a href='http://spam1.net/fr/'>")]
    tie = [(30000, "http://even.biz/", None), (30001, "http://a.com/x", "<a href='http://far.biz/'>"), (30002, "http://far.biz/", None)]
    df = spark.createDataFrame(many + siblings + chain + tie, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(df, rounds=None).collect()}
    assert {got[i] for i in (*range(5000, 10001), *range(20000, 20031))} == {"block"}
    assert {got[i] for i in (30000, 30001, 30002)} == {"allow"}


def test_the_sql_settles_as_the_query_does(spark):
    """Chains of hosts far longer than the default rounds, links back and forth, and a domain with many hosts."""
    chain = [(i, f"http://c{i}.io/", f"<a href='http://c{i + 1}.io/'><a href='http://c{i - 3}.io/'>") for i in range(60)]
    chain += [(60, "http://c60.io/", "<a href='http://bad.net/fr/'>")]
    trust = [(100 + i, f"http://t{i + 1}.io/", None) for i in range(20)] + [(130, "http://a.com/x", "<a href='http://t1.io/'>")]
    trust += [(140 + i, f"http://t{i}.io/", f"<a href='http://t{i + 1}.io/'>") for i in range(1, 20)] + [(170, "http://t20.io/", "<a href='http://c5.io'>")]
    hosts = [(200 + i, f"http://h{i}.wide.org/", "<a href='http://deep.net/es/'>" if i % 7 == 0 else None) for i in range(40)]
    rows = [*chain, *trust, *hosts, (300, "http://deep.net/es/", None), *[(400 + r[0], *r[1:]) for r in PAGES]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in U.filter_urls(df, rounds=None).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert got == sorted(con.execute(U.oracle()).fetchall(), key=lambda r: r[0])
    assert {v for *_, v in got} == {"allow", "block"}
