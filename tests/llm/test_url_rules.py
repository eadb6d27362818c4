"""URL filters: host rules against a plain reading, mined rules against counting, edge cases."""

import re
from itertools import combinations

from callqc.llm import queries, url_rules
from pyspark.sql import functions as F


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_query_host_rules(spark, sf_dir, tables):
    url = dict(tables.sql("SELECT page_id, url FROM pages").fetchall())
    got = queries.op1_url_rules(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(url)
    for r in got:
        host, path, rule, verdict = plain(url[r.page_id], queries.HOST_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined_rule else "allow"))


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.ORG/es/x?y=/z#q", "http://example.org/en/1", "http://xexample.org/es/",
            "http://b.com/fr/?a://c.com/de/", "http://com/de/", "a://b://c/de/", "http://É.com/DE/", "http://x.com\n/de/", "x" * 100_000 + "://a.org/",
            "http://a.org", "http://a.org?/es/"]
    pages = spark.createDataFrame([(k, u, "kept") for k, u in enumerate(urls)] + [(0, urls[5], "again"), (None, urls[6], "")],
                                  "page_id long, url string, host string")
    mined = spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double, lift double")
    got = url_rules.judge(pages, queries.HOST_RULES, mined).collect()
    assert len(got) == len(urls) + 2
    want = sorted(str((plain(u, queries.HOST_RULES)[:3])) for u in [*urls, urls[5], urls[6]])
    assert sorted(str((r.host, r.path, r.rule)) for r in got) == want
    assert url_rules.judge(pages.limit(0), queries.HOST_RULES, mined).count() == 0


def counted(rows, support, confidence, lift):
    """Rules by counting every combination of up to three items: tokens of the same URLs are one item."""
    n, blocked = len(rows), sum(b for _, b in rows)
    where = {}
    for token in set().union(*(t for t, _ in rows)):
        where.setdefault(frozenset(k for k, (t, _) in enumerate(rows) if token in t), set()).add(token)
    held = {}
    for size in (1, 2, 3):
        for own in combinations(where.values(), size):
            tokens = frozenset().union(*own)
            have = [b for t, b in rows if t >= tokens]
            hits, m = sum(have), len(have)
            if hits < url_rules.HITS or hits / n < support or hits / m < confidence or hits / m * n / blocked < lift:
                continue
            p, z = hits / m, url_rules.SURE
            if (p + z * z / (2 * m) - z * (p * (1 - p) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m) > blocked / n:
                held[tokens] = p
    return held


def test_mined_rules_equal_counting_and_match(spark):
    urls = [(f"http://www.{h}.net/{d}/{k}?{q}=1", h == "spam" and d == "buy" or q == "aff" and k % 5 != 0)
            for k, (h, d, q) in enumerate((h, d, q) for h in ("spam", "good", "news") for d in ("buy", "read") for q in ("aff", "id") for _ in range(12))]
    labelled = spark.createDataFrame(urls + [(None, True), ("http://x.y/", None)], "url string, blocked boolean")
    rules = url_rules.mine(labelled, "url", "blocked", support=0.02, confidence=0.75, lift=1.1).collect()
    rows = [(set(r.t), b) for r, (_, b) in zip(
        spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "k int, u string").select("k", url_rules.tokens(F.col("u")).alias("t"))
        .orderBy("k").collect(), urls, strict=True)]
    held = counted(rows, 0.02, 0.75, 1.1)
    kept = {s for s, c in held.items() if not any(t < s and held[t] >= c for t in held)}
    assert len(kept) > 1 and {frozenset(r.tokens) for r in rules} == kept
    mined = spark.createDataFrame([(r.rule_id, r.tokens, r.confidence, r.support, r.lift) for r in rules],
                                  "rule_id long, tokens array<string>, confidence double, support double, lift double")
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "page_id int, url string")
    verdicts = {r.page_id: r.verdict for r in url_rules.judge(pages, [], mined).collect()}
    assert verdicts == {k: "block" if any(s <= t for s in kept) else "allow" for k, (t, _) in enumerate(rows)}


def test_long_urls_do_not_explode(spark):
    """URLs of forty tokens: alone, and a template that many share."""
    one = [("http://a.example/" + "/".join(f"w{k}x" for k in range(40)), True)]
    template = [("http://b.example/" + "/".join(f"v{k}x" for k in range(38)) + f"/{k}?q{k % 4}x=1", k % 4 != 0) for k in range(60)]
    other = [(f"http://c.example/plain/p{k % 9}x", False) for k in range(40)]
    rules = url_rules.mine(spark.createDataFrame(one + template + other, "url string, blocked boolean"), "url", "blocked").collect()
    rows = [(set(r.t), b) for r, (_, b) in zip(
        spark.createDataFrame([(k, u) for k, (u, _) in enumerate(one + template + other)], "k int, u string").select("k", url_rules.tokens(F.col("u")).alias("t"))
        .orderBy("k").collect(), one + template + other, strict=True)]
    held = counted(rows, url_rules.SUPPORT, url_rules.CONFIDENCE, url_rules.LIFT)
    assert {frozenset(r.tokens) for r in rules} == {s for s, c in held.items() if not any(t < s and held[t] >= c for t in held)}
    assert all(r.hits >= url_rules.HITS for r in rules) and any("host:b" in r.tokens or len(r.tokens) > 30 or r.tokens[0].startswith("query:") for r in rules)


def test_many_host_rules_are_joined(spark, monkeypatch):
    rules = [("allow" if k % 3 else "block", f"h{k % 40}.example.org" if k % 2 else "example.org", f"/{'a' * (k % 7)}") for k in range(300)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values()) + queries.HOST_RULES
    urls = [f"http://{s}h{k}.example.org/{'a' * j}b" for k in range(45) for j in range(7) for s in ("", "x.")] + [None, "", "http:///a", "http://com/de/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    mined = spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double, lift double")
    got = []
    for most in (10_000, 10):
        monkeypatch.setattr(url_rules, "PLAN_RULES", most)
        got.append(sorted(map(str, url_rules.judge(pages, rules, mined).collect())))
    assert got[0] == got[1] and any("rule='h" in r for r in got[0])


def test_no_labels_give_no_rules(spark):
    none = spark.createDataFrame([], "url string, blocked boolean")
    assert url_rules.mine(none, "url", "blocked").count() == 0
    clean = spark.createDataFrame([("http://a.b/", False)] * 3, "url string, blocked boolean")
    assert url_rules.mine(clean, "url", "blocked").count() == 0


def test_main_path_has_no_python(spark, sf_dir):
    plan = queries.op1_url_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rules_of_four_and_five_tokens(spark):
    four, five = ("alpha", "beta", "gamma", "delta"), ("pan", "quo", "rex", "sol", "tau")
    urls = []
    for own in (four, five):  # all tokens together are blocked, any fewer of them are not
        urls += [(f"http:///{'/'.join(own)}/", True)] * 6
        urls += [(f"http:///{'/'.join(part)}/", False) for n in range(1, len(own)) for part in combinations(own, n)] * 6
    labelled = spark.createDataFrame(urls, "url string, blocked boolean")
    mined = url_rules.mine(labelled, "url", "blocked").cache()
    assert {frozenset(r.tokens) for r in mined.collect()} == {frozenset("path:" + x for x in own) for own in (four, five)}
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(urls)], "page_id int, url string")
    verdicts = {r.page_id: r.verdict for r in url_rules.judge(pages, [], mined).collect()}
    assert verdicts == {k: "block" if b else "allow" for k, (_, b) in enumerate(urls)}
