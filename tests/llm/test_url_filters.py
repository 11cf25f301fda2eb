import math
import random
import re

import pytest
from pyspark.sql import functions as F

from carelane.llm import url_filters as U


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    best = None
    for verdict, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best or (None, None)


URLS = [
    None, "", "no scheme", "http://", "http://net/", "http://net", "http://a.net/x", "https://A.Example.NET/en/1?q#f", "http://example.net/EN/", "http://example.net/en",
    "http://xexample.com/de/1", "http://www.example.com/de/1", "http://a.org/fr/x", "http://org/fr/", "http://a.org?x=/fr/", "http://a.org#/fr/", "ftp://host:80/p?x://y.net/", "http://spam-farm.example.org/en/9",
    "http://ÄÖ.example.org/fr/ü", "http://a..net//en/", "http://.net/", "http://" + "x" * 20000 + ".net/" + "y" * 20000, "http://a.net/x", "x\n://b.org/fr/\nz",
]


def test_rules_and_parts(spark):
    rows = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: r for r in U.judge(rows, ([0.0] * 4096, -1.0)).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = parts(u)
        rule, verdict = rule_of(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or "allow"), u


def test_dual_training_matches_plain_gradient_descent(spark):
    rows = [(u, y) for u, y in U.LABELLED[:6] + U.LABELLED[-6:]]
    df = spark.createDataFrame(rows, "url string, label int")
    weights, bias = U.train(df, prior=0.5)  # as many of either label: the bias stays
    assert abs(U.train(df, prior=0.2)[1] - bias - math.log(0.25)) < 1e-9
    host, path = U.split_url(F.col("url"))
    feats = {r["url"]: r["x"] for r in df.select("url", U.ngrams(host, path).alias("x")).collect()}
    rows.sort()
    k = [[len(set(feats[a]) & set(feats[b])) / math.sqrt(len(feats[a]) * len(feats[b])) for b, _ in rows] for a, _ in rows]
    alpha, b = [0.0] * len(rows), 0.0
    for _ in range(U.ROUNDS):
        err = [y - 1 / (1 + math.exp(-(b + sum(u * v for u, v in zip(k[i], alpha, strict=True))))) for i, (_, y) in enumerate(rows)]
        alpha = [x * (1 - U.DECAY) + U.RATE * e for x, e in zip(alpha, err, strict=True)]
        b += U.RATE * sum(err) / len(rows)
    assert abs(b - bias) < 1e-6
    for url, _ in rows:
        z = bias + sum(weights[f] for f in feats[url]) / math.sqrt(len(feats[url]))
        want = b + sum(a * len(set(feats[url]) & set(feats[o])) / math.sqrt(len(feats[url]) * len(feats[o])) for a, (o, _) in zip(alpha, rows, strict=True))
        assert abs(z - want) < 1e-6


def blocked_share(spark, model, words):
    """Of words in forms of hosts and paths that the labelled table does not use, the share that is blocked."""
    urls = [f"https://{host.format(w)}/{path}" for w in words for host, path in (("get-{}-now.example.com", "x/1"), ("{}zone.example.org", "en/"), ("m.top{}.example.com", "a/b.html"))]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return U.judge(pages, model, rules=[]).where("verdict = 'block'").count() / len(urls)


def test_known_words_in_new_forms(spark):
    model = U.train(U.labelled_table(spark))
    assert blocked_share(spark, model, U.BLOCKED_WORDS) >= 0.65
    assert blocked_share(spark, model, U.ORDINARY_WORDS) <= 0.02


def test_words_that_are_left_out_are_not_known(spark):
    """What the table holds is what is learned: nothing else is built in."""
    left = [*U.BLOCKED_WORDS[::6], *U.ORDINARY_WORDS[::6]]
    table = U.labelled_table(spark)
    model = U.train(table.where(~F.col("url").rlike("|".join(left))))
    assert blocked_share(spark, model, U.BLOCKED_WORDS[::6]) <= 0.6
    assert not {*U.BLOCKED_WORDS} & {*U.ORDINARY_WORDS}


def brute_rule(host, path, rules):
    fits = [(-len(h + p), h + p, p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (min(fits)[1], min(fits)[3]) if fits else (None, None)


def test_many_rules_as_a_table(spark):
    rng = random.Random(4)
    hosts = [f"{a}{b}" for a in ("", "x.", "y.x.", "z.") for b in ("a.net", "b.org", "net", "c.a.net")] + [f"h{k}.com" for k in range(3000)]
    paths = ["/", "/e", "/en/", "", "/de/1", "/ü"] + [f"/p{k}/" for k in range(40)]
    rules = list({(h, p): (rng.choice(["block", "allow"]), h, p) for h, p in ((rng.choice(hosts), rng.choice(paths)) for _ in range(13_000))}.values())[:10_001]
    assert len(rules) == 10_001
    rows = [(i % 50 or None, f"http://{rng.choice(['', 'q.', 'www.'])}{rng.choice(hosts[:60])}{rng.choice(paths)}{rng.choice(['', 'x', '?q', '/en/'])}") for i in range(400)] + [(7, None), (8, "none"), (9, rules[0][1])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("__rule", F.lit("x"))
    model = ([0.0] * 4096, -1.0)
    want = sorted((str(i), *parts(u), str((r := brute_rule(*parts(u), rules))[0]), r[1] or "allow") for i, u in rows)
    for given in (rules, U.rule_table(spark, [*rules, ("block", "a.net", "/")]).where("not (host = 'a.net' and path = '/')").unionByName(U.rule_table(spark, [r for r in rules if r[1:] == ("a.net", "/")] or [("allow", "none.such", "/")]))):
        got = U.judge(pages, model, given)
        assert sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got.collect()) == want
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", got.drop("page_id")._jdf.queryExecution().executedPlan().toString())
    few = rules[:500]
    inline, table = (U.judge(pages, model, r).collect() for r in (few, U.rule_table(spark, few)))
    assert sorted(map(str, inline)) == sorted(map(str, table))
    assert U.judge(pages, model, U.rule_table(spark, few).limit(0)).where("rule is not null").count() == 0


def test_no_python_in_plan(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    plan = U.op2_url_filters(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), ([0.0] * 4096, 0.0)).count() == 0


@pytest.mark.parametrize("n", [U.MAX_LABELLED, U.MAX_LABELLED + 1])
def test_too_many_labelled_urls_are_an_error(spark, monkeypatch, n):
    monkeypatch.setattr(U, "ROUNDS", 3)
    rows = spark.range(n).select(F.concat(F.lit("http://h.example.com/"), "id").alias("url"), F.lit(1).alias("label"))
    if n <= U.MAX_LABELLED:
        assert U.train(rows)[1] > 0
        return
    with pytest.raises(ValueError, match="500"):
        U.train(rows)


def test_no_labelled_urls_block_nothing(spark):
    empty = spark.createDataFrame([("http://a.net/", None)], "url string, label int")
    pages = spark.createDataFrame([(1, "http://some.example.com/en/1"), (2, None), (3, "http://a.net/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in U.judge(pages, U.train(empty)).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block"}
