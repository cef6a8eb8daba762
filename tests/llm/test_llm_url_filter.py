from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from basketry.llm import queries, url_filter
from basketry.llm.common import prepare

PAGES = "page_id long, url string, host string, score double"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.split("[?#]", rest[len(host) :])[0]


def rule(host, path):
    fits = [
        r for r in queries.URL_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fits, key=lambda r: len(r.text), default=None)


def ratios(urls, order):
    """The score of each URL by the two models, written as plain recursion."""
    counts, contexts = {}, {}
    padded = {u: "\x02" * (order - 1) + u + "\x03" for u in urls}
    for kind in (True, False):
        counts[kind] = Counter()
        for url, (allow, rows) in urls.items():
            if allow is kind:
                text = padded[url]
                for i in range(order - 1, len(text)):
                    for size in range(1, order + 1):
                        counts[kind][text[i - size + 1 : i + 1]] += rows
        contexts[kind] = {}
        for gram, n in counts[kind].items():
            total, kinds = contexts[kind].get((len(gram), gram[:-1]), (0, 0))
            contexts[kind][len(gram), gram[:-1]] = (total + n, kinds + 1)
    seen = set(counts[True]) | set(counts[False])
    base = 1 / max(1, sum(len(g) == 1 for g in seen))

    def p(kind, gram):
        if not gram:
            return base
        low = p(kind, gram[1:])
        total, kinds = contexts[kind].get((len(gram), gram[:-1]), (0, 0))
        return (counts[kind][gram] + kinds * low) / (total + kinds) if total else low

    out = {}
    for url, text in padded.items():
        total = 0.0
        for i in range(order - 1, len(text)):
            gram = text[i - order + 1 : i + 1]
            while gram and gram not in seen:
                gram = gram[1:]
            total += math.log(p(True, gram) / p(False, gram)) if gram else 0.0
        out[url] = total / (len(url) + 1)
    return out


def judged(df):
    return {r.row.page_id: r for r in url_filter.judge(df, "page_id", "url", queries.URL_RULES).collect()}


def check(rows, given):
    urls = {}
    for url in given.values():
        found = rule(*parts(url))
        allow, n = urls.get(url or "", (found and found.allow, 0))
        urls[url or ""] = (allow, n + 1)
    scores = ratios(urls, 5)
    assert set(rows) == set(given)
    for page, url in given.items():
        r, found = rows[page], rule(*parts(url))
        assert (r.host, r.path, r.rule) == (*parts(url), found and found.text)
        assert r.score == pytest.approx(scores[url or ""], abs=1e-9)
        if found:
            assert r.allowed == found.allow
    free = [r for r in rows.values() if r.rule is None]
    assert max([r.score for r in free if not r.allowed], default=-99) <= min([r.score for r in free if r.allowed], default=99)


def test_rules_and_scores(spark):
    prepare(spark)
    given = {
        1: "http://www.Shop.COM/x?y", 2: "https://a.example.com/en/1", 3: "https://www.example.com/en/1",
        4: "http://x.net/es/1", 5: "http://x.net/fr/2#/", 6: "http://x.net/de/", 7: "http://net/es/", 8: None, 9: "",
        10: "mailto:com/", 11: "http://com", 12: "http://com/", 13: "http://xcom/", 14: "ht\ntp://a.com/\n",
        15: "http://x.net/es/1", 16: "http://a.org/" + "long" * 3000, 17: "http://a.com?/", 18: "http://ü.ÄB.com/ß",
    }
    rows = [(k, u, "h", 0.0) for k, u in given.items()]
    check(judged(spark.createDataFrame(rows, PAGES).repartition(3)), given)


def test_query(spark, sample_dir):
    given = {r.page_id: r.url for r in spark.read.parquet(f"{sample_dir}/pages.parquet").collect()}
    df = prepare(spark).read.parquet(f"{sample_dir}/pages.parquet")
    check(judged(df), given)
    rows = queries.op7_url_filter(spark, sample_dir)
    assert rows.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert {r.verdict for r in rows.collect()} == {"allow", "block"}


def test_without_decided_urls_or_rows(spark):
    some = spark.createDataFrame([(1, "http://a.org/", "", 0.0), (1, "http://a.org/", "", 0.0)], PAGES)
    rows = url_filter.judge(some, "page_id", "url", queries.URL_RULES).collect()
    assert [(r.score, r.allowed) for r in rows] == [(0.0, True)] * 2
    assert url_filter.judge(some.where("false"), "page_id", "url", queries.URL_RULES).count() == 0


def test_main_path_runs_no_python(spark, sample_dir):
    plan = queries.op7_url_filter(spark, sample_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_no_join_gathers_on_the_driver(spark, monkeypatch):
    plans, write = [], url_filter.keep

    def plan_of(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    def keep(df, name):
        plans.append(plan_of(df))
        return write(df, name)

    prepare(spark)
    monkeypatch.setattr(url_filter, "keep", keep)
    given = {i: f"http://a{i % 9}.{'com' if i % 2 else 'net'}/{'es' if i % 3 else 'de'}/{i}" for i in range(60)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = spark.createDataFrame([(k, u, "h", 0.0) for k, u in given.items()], PAGES)
        done = url_filter.judge(df, "page_id", "url", queries.URL_RULES)
        plans.append(plan_of(done))
        check({r.row.page_id: r for r in done.collect()}, given)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert any("SortMergeJoin" in plan for plan in plans)
    assert not any("Broadcast" in plan for plan in plans)
