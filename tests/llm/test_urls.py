import re

import pytest

from tidelake.llm import urls
from tidelake.llm.queries import URL_RULES


def naive(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best[0] if best else default


ODD = [None, "", "no scheme.org/", "http://", "http://ORG/", "http://org", "http://a.b.example.ORG/es/x?y#z", "http://example.org/en/12", "http://xexample.org/es/", "http://example.org./es/", "http://u@com/de/", "http://com/de", "ftp://com:80/fr/", "http://a://org/", "x://É.org/ü\n/z", "://com/de/", "http://.org/", "http://com/fr/" + "a" * 5000, "http://" + "a." * 500 + "com/de/q"]


def test_verdicts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    all_urls = [r.url for r in pages.collect()] + ODD + ODD[:6]
    table = spark.createDataFrame([(i, u, "clash", "h", 1) for i, u in enumerate(all_urls)], "page_id long, url string, host string, digest string, n int")
    rows = {r.page_id: (r["__host"], r["__path"], r["__rule"], r["__verdict"]) for r in urls.judge(table, urls.rules(spark, URL_RULES)).collect()}
    assert [rows[i] for i in range(len(all_urls))] == [naive(u, URL_RULES) for u in all_urls]


def test_precedence_defaults_and_empty_tables(spark):
    rules = [("allow", "org/"), ("block", "a.org/"), ("allow", "a.org/x"), ("block", "a.org/x"), ("block", None)]
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.a.org/y"), (3, "http://c.org/"), (4, "http://d.net/")], "page_id long, url string")
    rows = {r.page_id: r["__verdict"] for r in urls.judge(pages, urls.rules(spark, rules), "block").collect()}
    assert rows == {1: "block", 2: "block", 3: "allow", 4: "block"}
    assert {r["__verdict"] for r in urls.judge(pages, urls.rules(spark, rules).limit(0)).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), urls.rules(spark, rules)).count() == 0


def test_the_longest_rule_wins_and_rules_without_a_slash(spark):
    pages = spark.createDataFrame([(1, "http://a.org/bbbbbbbbbbbb"), (2, "http://evil.com"), (3, "http://x.evil.com?q=1"), (4, "http://evil.com/p"), (5, "http://www.a.org/")], "page_id long, url string")
    rules = urls.rules(spark, [("block", "a.org/"), ("allow", "org/bbbbbbbbbbbb"), ("block", "evil.com"), ("allow", "www.a.org/"), ("block", "org")])
    assert {r.page_id: r["__rule"] for r in urls.judge(pages, rules).collect()} == {1: "org/bbbbbbbbbbbb", 2: "evil.com", 3: "evil.com", 4: "evil.com", 5: "www.a.org/"}


def test_random_rules_and_the_registered_sql(spark):
    """Code, SQL and a plain loop agree on rules drawn at random (the SQL's rules take the place of the registered ones)."""
    import random

    rng = random.Random(6)
    label = lambda: rng.choice(["a", "b", "org", "com"])
    rules = list({f"{'.'.join(label() for _ in range(rng.randrange(1, 4)))}/{rng.choice(['', 'x', 'x/', 'xy', 'y'])}": None for _ in range(40)})
    rules = [(rng.choice(["allow", "block"]), r) for r in rules]
    pages = [(i, f"http://{'.'.join(label() for _ in range(rng.randrange(1, 5)))}/{rng.choice(['', 'x', 'xy/z', 'x/', 'yy', 'z'])}{rng.choice(['', '?q', '#/x'])}") for i in range(500)]
    table = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: (r["__host"], r["__path"], r["__rule"], r["__verdict"]) for r in urls.judge(table, urls.rules(spark, rules)).collect()}
    for i, u in pages:
        host, path, rule, verdict = naive(u, rules)
        # of equally long rules that fit, that with the longer host wins
        fits = [(len(r), len(r.split("/")[0]), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        want = (host, path, *((max(fits)[2], max(fits)[3]) if fits else (None, "allow")))
        assert got[i] == want


def test_names_that_clash(spark):
    names = ["__host", "__path", "__rule", "__verdict", "__won", "host", "path", "won", "x", "found", "short", "rule", "verdict"]
    table = spark.createDataFrame([(1, "http://org/", *range(13))], f"page_id long, url string, {', '.join(f'{n} int' for n in names)}")
    out = urls.judge(table, urls.rules(spark, URL_RULES), into=("h_", "p_", "r_", "v_"))
    assert out.columns == [*table.columns, "h_", "p_", "r_", "v_"] and tuple(out.first()) == (1, "http://org/", *range(13), "org", "/", "org/", "allow")
    with pytest.raises(ValueError):
        urls.judge(table, urls.rules(spark, URL_RULES))


def test_very_long_urls(spark):
    table = spark.createDataFrame([(1, "http://" + "a." * 20_000 + "com/de/q"), (2, "http://com/fr/" + "b" * 2_000_000)], "page_id long, url string")
    assert {r.page_id: r["__rule"] for r in urls.judge(table, urls.rules(spark, URL_RULES)).collect()} == {1: "com/de/", 2: "com/fr/"}


def test_plan_is_native(spark, sf_dir):
    plan = urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), urls.rules(spark, URL_RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "CartesianProduct" not in plan
