import re

from fieldwire.llm import url_rules as u
from fieldwire.llm.queries import URL_RULES, op5_url_filter

URLS = ["https://www.Example.ORG/es/1", "http://example.org/en/1?x=/2", "http://example.org/en/2", "http://org/x", "http://a.org", "http://notorg/x",
        "ftp://m.shop.com/fr/9.html#f", "http://x.com/de/", "//no.scheme/x", "", None, "http://?q", "http:///p?x", "http://u@h.com:80/fr/x", "a://b://c/d#e?f",
        "http://x.net/" + "seg/" * 5000, "http://ÉXAMPLE.net/é"]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = (None, None)
    for verdict, rule in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best[0] is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best[0], best[1]


def test_given_rules_and_odd_rows(spark):
    pages = spark.createDataFrame([(k if k != 3 else None, x, "h", 1, 2) for k, x in enumerate(URLS + URLS[:2])], "page_id long, url string, html string, host int, tokens int")
    got = u.judge(pages, URL_RULES).collect()
    assert len(got) == len(URLS) + 2
    want = {plain(x)[:3] for x in URLS}
    assert {(r.host, r.path, r.rule) for r in got} == want
    assert all(r.verdict in ("allow", "block") for r in got)
    assert u.judge(pages.limit(0), URL_RULES).count() == 0
    none = u.judge(pages, []).collect()
    assert {r.verdict for r in none} == {"allow"} and {r.rule for r in none} == {None}


def brute_rules(rows, p):
    """All token sets of up to three tokens by count."""
    from itertools import combinations
    sets, joint = {}, {}
    for tokens, verdict in rows:
        for k in range(p.most_tokens + 1):
            for c in combinations(sorted(set(tokens)), k):
                sets[c] = sets.get(c, 0) + 1
                joint[c, verdict] = joint.get((c, verdict), 0) + 1
    least = p.support * len(rows)
    sure = {(c, v): n / sets[c] for (c, v), n in joint.items() if n >= least}
    return {(c, v) for (c, v), s in sure.items() if not c or s >= p.confidence and not any(
        sure.get((tuple(x for x in c if x != t), v), 0) >= s for t in c)}


def test_mined_rules_against_all_sets(spark):
    page = u.with_host_and_path(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url"))
    rows = [(r.tokens, u.given_rule(r.host, r.path, u.by_host(URL_RULES))[1]) for r in page.select("host", "path", u.url_tokens().alias("tokens")).collect()]
    rows = [(t, v) for t, v in rows if v]
    p = u.Mining(support=0.03)
    got = {(tuple(r.tokens), r.verdict) for r in u.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), p).collect()}
    assert got == brute_rules(rows, p)


def test_index_finds_what_a_scan_finds(spark):
    rules = [(["a", "b"], "block", 0.9, 5), (["a"], "allow", 0.85, 9), (["c", "b"], "allow", 0.95, 3), ([], "allow", 0.7, 20), (["a", "b", "c"], "block", 0.95, 3)]
    index = u.Index(rules)
    for tokens in (["a"], ["a", "b"], ["b", "c"], ["a", "b", "c", "d"], ["x"], []):
        fits = [((bool(t), c, s, sorted(t)), v) for t, v, c, s in rules if set(t) <= set(tokens)]
        assert index.best(tokens) == max(fits)


def test_blocks_of_rules_do_not_change_verdicts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    a, b = (sorted((r.page_id, r.verdict, str(r.mined)) for r in u.judge(pages, URL_RULES, u.Mining(block_rules=n)).collect()) for n in (100_000, 7))
    assert a == b


def test_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = op5_url_filter(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def test_urls_without_a_given_rule_get_the_surest_mined_one(spark):
    page = u.with_host_and_path(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).withColumn("tokens", u.url_tokens()).collect()
    decided = [(r.page_id, r.tokens, *u.given_rule(r.host, r.path, u.by_host(URL_RULES))) for r in page]
    labels = spark.createDataFrame([(t, v) for _, t, _, v in decided], "tokens array<string>, verdict string")
    rules = [((bool(r.tokens), r.confidence, r.support, sorted(r.tokens)), r.verdict, set(r.tokens)) for r in u.mine(labels).collect()]
    got = {r.page_id: r.verdict for r in op5_url_filter(spark, "/root/testdata/sf0.01").collect()}
    for page_id, tokens, rule, verdict in decided:
        best = max(((rank, v) for rank, v, need in rules if need <= set(tokens)), default=(None, "allow"))
        assert got[page_id] == (verdict if rule else best[1])


def test_sets_with_tokens_that_fp_growth_does_not_take(spark):
    """URLs of up to 24 frequent tokens: what decides lies among the most common ones."""
    import random
    rng = random.Random(9)
    rows = []
    for _ in range(150):
        tokens = [f"t{i:02}" for i in range(24) if rng.random() < 0.25 + 0.03 * i]
        rows.append((tokens, "block" if {"t21", "t23"} <= set(tokens) else rng.choice(("allow", "allow", "allow", "block"))))
    rows += [([], "allow"), (["t23", "t23"], "allow")]
    p = u.Mining(support=0.08, confidence=0.75, most_mined=5)
    assert sum(len(set(t)) > p.most_mined for t, _ in rows) > 100
    df = spark.createDataFrame([(sorted(set(t)), v) for t, v in rows], "tokens array<string>, verdict string")
    got = {(tuple(r.tokens), r.verdict) for r in u.mine(df, p).collect()}
    want = brute_rules(rows, p)
    assert got == want and any("t23" in c for c, _ in want)
