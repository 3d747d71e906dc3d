import math
import re

import pytest

from condeval.llm import url_filter as U

DDL = "page_id bigint, url string, rule string, verdict string"
URLS = [
    None, "", "no-scheme.com/en/", "http://", "https://WWW.Example.COM/en/a?x#y", "https://www.example.com/de/", "http://m.example.com/en/1",
    "http://example.com", "http://example.com/", "http://xcom/en/", "http://a.b.net/es/1", "http://net/fr/", "http://a.net/fr", "http://a.org/en/1",
    "ftp://A.net?q=/es/", "http://a.net/es/#top", "x://y://z.com/p", "https://ads.click.example/banner", "http://é.com/ü\n/x", "http://t.example/" + "a/" * 50_000,
]


def expected(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    best = (None, None)
    for action, rule in U.RULES:
        name, _, start = rule.partition("/")
        fits = (host == name or host.endswith("." + name)) and path.startswith("/" + start)
        if fits and len(rule) > len(best[1] or ""):
            best = (action, rule)
    return host, path, best


@pytest.fixture(scope="module")
def weights(spark):
    return U.trained(spark)


def test_rules_and_parts(spark, weights):
    rows = [(i, u, "x", "x") for i, u in enumerate([*URLS, URLS[4]])]
    got = U.judged(spark.createDataFrame(rows, DDL), weights).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, (action, rule) = expected(rows[r.page_id][1])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (action or ("block" if r.score >= 0.5 else "allow"))
    assert U.judged(spark.createDataFrame([], DDL), weights).count() == 0


def test_the_regression_learns_its_table_and_what_is_like_it(spark, weights):
    unseen = [("https://ads.other.example/banner/click", 1), ("http://casino-free.example/slots/jackpot", 1),
              ("https://docs.other.example/guide/lessons", 0), ("https://blog.other.example/history/maps", 0)]
    rows = [(y, u, "x", "x") for u, y in [*U.LABELLED, *unseen]]
    got = U.judged(spark.createDataFrame(rows, DDL), weights, rules=()).collect()
    assert all((r.verdict == "block") == bool(r.page_id) for r in got)


def test_training_follows_plain_gradient_descent(spark):
    labelled = U.LABELLED[12:20]
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(labelled)], "i int, url string")
    from pyspark.sql import functions as F

    buckets = {r.i: r.b for r in rows.select("i", U.gram_buckets(*U.host_and_path(F.col("url"))).alias("b")).collect()}
    features = []
    for i in range(len(labelled)):
        counts = {b: buckets[i].count(b) for b in set(buckets[i])}
        norm = math.sqrt(sum(v * v for v in counts.values()))
        features.append({b: v / norm for b, v in counts.items()})
    weight = {}
    for _ in range(U.STEPS):
        errors = [y - 1 / (1 + math.exp(-sum(weight.get(b, 0) * x for b, x in f.items()))) for f, (_, y) in zip(features, labelled)]
        weight = {b: w * (1 - U.DECAY) for b, w in weight.items()}
        for f, e in zip(features, errors):
            for b, x in f.items():
                weight[b] = weight.get(b, 0) + U.RATE * e * x
    got = U.trained(spark, labelled)
    assert got == pytest.approx([weight.get(b, 0) for b in range(U.BUCKETS)], abs=1e-9)


def test_no_python_on_the_main_path(spark, weights):
    plan = U.judged(spark.createDataFrame([(1, "u", "x", "x")], DDL), weights)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(Eval|Python)|MapInArrow", plan)
