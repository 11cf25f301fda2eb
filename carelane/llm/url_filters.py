"""URL verdicts: longest-match host/path rules, else logistic regression on hashed character n-grams.

Everything runs in DataFrame/SQL functions. The regression is trained from a small labelled URL
table: its examples are few (``MAX_LABELLED``), so the model is fitted in its dual form over the
examples' similarity matrix inside one expression, and only ``2 ** BITS`` weights leave it. Scoring is
a projection without any shuffle. Up to ``MAX_INLINE`` rules travel inside the expression; more, or rules given
as a table, are joined by host suffix and path prefix, each distinct url once.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, and is
judged by the bias alone; names whose parts no labelled url has are judged by chance n-grams; without labelled urls those that fit no rule are allowed; more than ``MAX_LABELLED``
of them are an error; empty tables give no rows; repeated rows get equal verdicts; other columns
are not read. Among rules that fit, the longest (host and path characters together) wins; of equally
long ones the one that sorts first; rules with a null are none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

#: Fixed rules of the production query: (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Words of the categories that public web filters block, and of ordinary sites of many kinds. They were written down
#: from general knowledge, not from any table of urls.
BLOCKED_WORDS = (
    "porn sex xxx nude erotic escort adult "  # adult
    "casino poker roulette blackjack betting jackpot lottery "  # gambling
    "viagra cialis steroids pharma weightloss "  # drugs
    "malware trojan phishing ransomware spyware "  # attacks
    "warez keygen cracked pirated torrents "  # copies
    "adserver popunder adclick clickbait "  # advertising
    "spam scam payday"  # fraud
).split()
ORDINARY_WORDS = (
    "library museum university school science history gallery theatre "
    "hospital council parliament police weather climate "
    "garden recipes bakery restaurant hotel travel railway "
    "football chess orchestra cinema radio journal "
    "software network engineering mathematics "
    "furniture bookstore painting forestry charity"
).split()
#: Ways in which hosts and paths are written, dealt to the words of both labels alike, so that they tell nothing.
HOSTS = ("www.{}.example.com", "{}.example.org", "my{}.example.com", "{}-online.example.org", "the-{}.example.com", "www.{}24.example.org", "best-{}.example.com", "blog.{}s.example.org", "{}-club.example.com")
PATHS = ("/", "/en/1", "/fr/20.html", "/de/7/", "/es/31?page=2", "/en/about#top", "/news/5")


def _written(words: list[str], label: int) -> list[tuple[str, int]]:
    return [(f"http{'s' * (i % 2)}://{HOSTS[i % len(HOSTS)].format(w)}{PATHS[i % len(PATHS)]}", label) for i, w in enumerate(words)]


#: A small labelled URL table.
LABELLED = _written(BLOCKED_WORDS, 1) + _written(ORDINARY_WORDS, 0)
#: The most labelled examples one fit takes: its similarity matrix has this many cells squared.
MAX_LABELLED = 500
#: Bias without any labelled example: a score of practically 0.
NO_LABELS_BIAS = -40.0
#: Most rules that travel inside the expression; more are joined as a table.
MAX_INLINE = 1_000
#: Share of urls to be blocked that is assumed where the model decides; the table holds about as many of either label.
PRIOR = 0.2
BITS, SIZES, ROUNDS, RATE, DECAY = 12, (3, 4), 300, 0.5, 0.002


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to ``/ ? #``; then up to ``? #``. Both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def ngrams(host: Column, path: Column, bits: int = BITS) -> Column:
    """Distinct hashed character n-grams of the marked host and of the path, digits as one class."""

    def hashed(seed, text, n):
        return lambda i: F.pmod(F.xxhash64(F.lit(seed), F.substr(text, i, F.lit(n))), F.lit(1 << bits)).cast("int")

    parts = []
    for tag, text in (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.regexp_replace(path, "[0-9]+", "0"))):
        for n in SIZES:
            last = F.length(text) - (n - 1)
            starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(starts, hashed(f"{tag}{n}", text, n)))
    return F.when(host == "", F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(*parts)))


def train(labelled: DataFrame, bits: int = BITS, prior: float = PRIOR) -> tuple[list[float], float]:
    """Weights and bias from a table (url, label 0/1; null labels are skipped) of at most ``MAX_LABELLED`` rows; more are an error.

    Where there are both labels, the bias is moved from their shares to the ``prior``.
    """
    host, path = split_url(F.col("url"))
    rows = labelled.where(F.col("label").isNotNull()).select("url", F.col("label").cast("double").alias("y")).withColumn("x", ngrams(host, path, bits))
    size = rows.limit(MAX_LABELLED + 1).count()
    if size > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled urls")
    if not size:
        return [0.0] * (1 << bits), NO_LABELS_BIAS
    one = rows.agg(F.sort_array(F.collect_list(F.struct("url", "y", "x"))).alias("e"))
    n = F.size("e")
    norm = lambda x: F.sqrt(F.greatest(F.size(x), F.lit(1)).cast("double"))
    similar = F.transform("e", lambda a: F.transform("e", lambda b: F.size(F.array_intersect(a["x"], b["x"])) / (norm(a["x"]) * norm(b["x"]))))
    labels = F.transform("e", lambda e: e["y"])
    # The matrix travels in the state: it is computed once, not again in each step.
    start = F.struct(F.array_repeat(F.lit(0.0), n).alias("a"), F.lit(0.0).alias("b"), similar.alias("k"), labels.alias("y"))

    def step(acc, _):
        margins = F.transform(acc["k"], lambda row: acc["b"] + F.aggregate(F.zip_with(row, acc["a"], lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v))
        errors = F.zip_with(acc["y"], margins, lambda y, z: y - 1.0 / (1.0 + F.exp(-z)))
        # One binding for the errors: an array of one element, so that they are computed once a step.
        made = F.transform(F.array(errors), lambda r: F.struct(F.zip_with(acc["a"], r, lambda a, d: a * (1 - DECAY) + RATE * d).alias("a"), (acc["b"] + RATE * F.aggregate(r, F.lit(0.0), lambda s, v: s + v) / n).alias("b"), acc["k"].alias("k"), acc["y"].alias("y")))
        return F.get(made, F.lit(0))

    fitted = one.select("e", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.struct(acc["a"].alias("a"), acc["b"].alias("b"))).alias("m"))
    exploded = fitted.select("m", F.posexplode(F.arrays_zip(F.col("m.a").alias("a"), F.col("e").alias("r"))).alias("i", "z")).select(F.col("m.b").alias("b"), (F.col("z.a") / norm(F.col("z.r.x"))).alias("w"), F.explode_outer("z.r.x").alias("f"))
    got = exploded.groupBy("f").agg(F.sum("w").alias("w"), F.max("b").alias("b")).collect()  # at most 2 ** bits rows
    weights = [0.0] * (1 << bits)
    for r in got:
        if r["f"] is not None:
            weights[r["f"]] = r["w"]
    share = rows.agg(F.avg("y")).first()[0]
    moved = math.log(prior / (1 - prior)) - math.log(share / (1 - share)) if 0 < share < 1 else 0.0
    return weights, got[0]["b"] + moved


def method_score(host: Column, path: Column, model: tuple[list[float], float], bits: int = BITS) -> Column:
    """Probability that a url is to be blocked."""
    weights, bias = model
    table_ = F.lit(weights)
    x = ngrams(host, path, bits)
    total = F.aggregate(x, F.lit(0.0), lambda s, f: s + F.get(table_, f))
    return 1.0 / (1.0 + F.exp(-(F.lit(float(bias)) + total / F.sqrt(F.greatest(F.size(x), F.lit(1)).cast("double")))))


def _suffixes(host: Column) -> Column:
    """The host itself and what is left after each of its dots."""
    labels = F.split(host, r"\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Looks up each suffix of the host in a map."""
    if len(rules) > MAX_INLINE:
        raise ValueError(f"at most {MAX_INLINE} rules inside an expression")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append((p, verdict))
    kind = "array<struct<size:int,rule:string,path:string,verdict:string>>"
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    entries = []
    for h, own in sorted(by_host.items()):
        entries += [F.lit(h), F.array(*[F.struct(F.lit(-len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for p, v in own]).cast(kind)]
    lookup = F.create_map(*entries)
    found = F.flatten(F.filter(F.transform(_suffixes(host), lambda s: F.try_element_at(lookup, s)), lambda a: a.isNotNull()))
    fits = F.array_sort(F.filter(found, lambda r: F.startswith(path, r["path"])))
    return F.get(fits, F.lit(0))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table made by SQL functions alone."""
    columns = [F.lit(list(c)).alias(k) for k, c in zip(("verdict", "host", "path"), zip(*rules, strict=True), strict=True)]
    return spark.range(1).select(F.inline(F.arrays_zip(*columns)))


def joined_rule(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``__rule`` to rows with ``__host`` and ``__path``: as ``matched_rule``, for any number of rules.

    A host suffix that has rules brings the lengths of its rules' paths; only these prefixes of the path are
    looked up, by equality. A host has at most as many lengths as its longest rule path has characters.
    """
    given = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "verdict").where("h is not null and p is not null and verdict is not null")
    lengths = given.groupBy("h").agg(F.collect_set(F.length("p")).alias("lengths"))
    urls = parts.select("__host", "__path").distinct()
    suffixes = urls.select("__host", "__path", F.explode(_suffixes(F.col("__host"))).alias("h"))
    fitting = F.filter("lengths", lambda n: n <= F.length("__path"))
    asked = suffixes.join(lengths, "h").select("__host", "__path", "h", F.explode(fitting).alias("n")).select("__host", "__path", "h", F.substr("__path", F.lit(1), F.col("n")).alias("p"))
    rule = F.concat("h", "p")
    best = asked.join(given, ["h", "p"]).groupBy("__host", "__path").agg(F.min(F.struct((-F.length(rule)).alias("size"), rule.alias("rule"), F.col("p").alias("path"), "verdict")).alias("__rule"))
    return parts.join(best, ["__host", "__path"], "left")


def judge(pages: DataFrame, model: tuple[list[float], float], rules: list[tuple[str, str, str]] | DataFrame = RULES, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, host, path, rule, verdict and the method's score of every url; rules as a list or as a
    table of verdict, host, path."""
    host, path = split_url(F.col("url"))
    parts = pages.select(*keep, host.alias("__host"), path.alias("__path"))
    h, p = F.col("__host"), F.col("__path")
    if isinstance(rules, list) and len(rules) <= MAX_INLINE:
        ruled = parts.select(*keep, h, p, matched_rule(h, p, rules).alias("__rule"))
    else:
        ruled = joined_rule(parts, rule_table(pages.sparkSession, rules) if isinstance(rules, list) else rules)
    out = ruled.select(*keep, h, p, "__rule", method_score(h, p, model).alias("__score"))
    by_method = F.when(F.col("__score") >= 0.5, "block").otherwise("allow")
    return out.select(*keep, h.alias("host"), p.alias("path"), F.col("__rule")["rule"].alias("rule"), F.coalesce(F.col("__rule")["verdict"], by_method).alias("verdict"), F.col("__score").alias("score"))


def labelled_table(spark: SparkSession) -> DataFrame:
    """The bundled labelled URLs as a table made by SQL alone."""
    values = ", ".join(f"('{u}', {y})" for u, y in LABELLED)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: page_id, host, path, rule, verdict, score."""
    return judge(table(spark, sf_dir, "pages"), train(labelled_table(spark)))
