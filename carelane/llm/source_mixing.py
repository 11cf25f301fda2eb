"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

A source's weight is its token share to a power, normalised. The exponent is bisected: the least one whose
mixture's entropy does not pass a target (above 1, if the shares' own entropy is higher), and whose most
repeated source is not repeated more than ``max_repeat`` times as often as the least repeated one. A target
that no exponent up to ``MOST_EXPONENT`` meets, or that contradicts the limit, is an error. The budget of tokens
is a parameter; without one it is the smallest that holds every document once, so nothing is dropped.

Each epoch of a source is a permutation of its blocks, and of the documents in a block, both by hashes.
The last epoch is cut at the source's budget: blocks in their order while they fit, and of the one block
that does not, documents in their order while they fit. Blocks have bounded tokens however large their
source is. Sums are ordered in two steps: 4,096 ranges of a source's block order, then the blocks of the one
range that the budget ends in.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. Defined results: null and empty texts have 0 tokens and are kept
once an epoch; a source without any token runs one epoch; null is a source of its own; repeated rows share
their places and are in or out together; an empty table gives no rows; other columns pass ``mix`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialise, table

#: Repetition limit of the production mixture, tokens of a block.
MAX_REPEAT, BLOCK_TOKENS = 2.0, 250_000
#: Bisection: this many halvings; over a table, some of them at once in one aggregation.
STEPS, AT_ONCE = 30, 5
#: Sources whose sums go to the driver (16 bytes each); with more, the sums stay a table. Greatest exponent.
FEW_SOURCES, MOST_EXPONENT = 100_000, 64.0
#: Bits of a block's order that number its range.
RANGE_BITS = 12


def word_count(text: Column) -> Column:
    """Words of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def row_hash() -> Column:
    """What a document's places in permutations derive from."""
    return F.xxhash64("doc_id", "text")


#: For each exponent: entropy of the weights, and most repetition over least.
Spread = Callable[[list[float]], list[tuple[float, float]]]


def spread_of(totals: DataFrame) -> Spread:
    """Entropy and repetition by exponent of sources (source, tokens): from one small array of sums, or, with
    very many sources, by an aggregation each time."""
    logs = totals.where("tokens > 0").select(F.log(F.col("tokens").cast("double")).alias("l"))
    top = logs.agg(F.max("l").alias("hi"), F.min("l").alias("lo"), F.count("*").alias("n")).first()
    if not top["n"]:
        return lambda exponents: [(0.0, 1.0)] * len(exponents)
    repeat = lambda a: math.exp(min(700.0, (top["hi"] - top["lo"]) * abs(1 - a)))
    if top["n"] <= FEW_SOURCES:
        x = np.sort(logs.toPandas()["l"].to_numpy()) - top["hi"]

        def on_driver(exponents: list[float]) -> list[tuple[float, float]]:
            out = []
            for a in exponents:
                w = np.exp(a * x)
                out.append((float(np.log(w.sum()) - (w * a * x).sum() / w.sum()), repeat(a)))
            return out

        return on_driver

    x = F.col("l") - F.lit(top["hi"])

    def by_aggregation(exponents: list[float]) -> list[tuple[float, float]]:
        columns = [c for k, a in enumerate(exponents) for c in (F.sum(F.exp(x * a)).alias(f"z{k}"), F.sum(F.exp(x * a) * x * a).alias(f"e{k}"))]
        r = logs.agg(*columns).first()
        return [(math.log(r[f"z{k}"]) - r[f"e{k}"] / r[f"z{k}"], repeat(a)) for k, a in enumerate(exponents)]

    return by_aggregation


def _least(fits: Callable[[list[float]], list[bool]], lo: float, hi: float) -> float:
    """The least number from lo to hi that fits, if all above it do; hi is known to fit."""
    for _ in range(STEPS // AT_ONCE):
        inner = [lo + (hi - lo) * k / (1 << AT_ONCE) for k in range(1, 1 << AT_ONCE)]
        good = fits(inner)
        # The halvings of this round, looked up instead of computed one by one.
        a, b = 0, 1 << AT_ONCE
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if good[mid - 1] else (mid, b)
        lo, hi = lo + (hi - lo) * a / (1 << AT_ONCE), lo + (hi - lo) * b / (1 << AT_ONCE)
    return hi


def solve_exponent(totals: DataFrame, max_repeat: float | None, target_entropy: float | None) -> float:
    """The least exponent that keeps to the repetition limit and does not pass the target entropy."""
    spread = spread_of(totals)
    flat = lambda exponents: [target_entropy is None or e <= target_entropy + 1e-9 for e, _ in spread(exponents)]
    within = lambda exponents: [max_repeat is None or r <= max_repeat * (1 + 1e-9) for _, r in spread(exponents)]
    least = 0.0 if within([0.0])[0] else _least(within, 0.0, 1.0)
    if not flat([least])[0]:
        top = 1.0
        while not flat([top])[0]:
            top *= 2
            if top > MOST_EXPONENT:
                raise ValueError(f"no exponent up to {MOST_EXPONENT:g} has an entropy of {target_entropy:g} or less")
        least = max(least, _least(flat, 0.0, top))
        if not within([least])[0]:
            raise ValueError(f"an entropy of {target_entropy:g} needs more repetition than {max_repeat:g}")
    return least


def mixture(lengths: DataFrame, max_repeat: float | None = MAX_REPEAT, entropy_share: float | None = None, budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """source, tokens, weight, repetition, full (whole epochs), budget (tokens of the cut epoch), parts (blocks).

    ``entropy_share`` is the target entropy as a part of the greatest one; ``budget_tokens`` is what all sources
    together are to give, by default the least that holds every document.
    """
    totals = materialise(lengths.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    count = totals.where("tokens > 0").count()
    exponent = solve_exponent(totals, max_repeat, None if entropy_share is None else entropy_share * math.log(max(count, 1)))
    tokens = F.col("tokens").cast("double")
    sums = totals.where("tokens > 0").agg(F.sum(F.pow(tokens, F.lit(exponent))).alias("z"), F.max(tokens).alias("most"), F.min(tokens).alias("least")).first()
    z = sums["z"] or 1.0
    if budget_tokens is None:
        # The source that is repeated least runs once.
        once = (sums["most"] if exponent <= 1 else sums["least"]) or 1.0
        repetition = F.pow(tokens / F.lit(once), F.lit(exponent - 1.0))
    else:
        repetition = F.pow(tokens, F.lit(exponent - 1.0)) * F.lit(budget_tokens / z)
    repetition = F.when(F.col("tokens") > 0, repetition).otherwise(1.0)
    weight = F.when(F.col("tokens") > 0, F.pow(tokens, F.lit(exponent)) / z).otherwise(0.0)
    out = totals.select("source", "tokens", weight.alias("weight"), F.round(repetition, 9).alias("repetition"))
    full = F.floor("repetition").cast("int")
    parts = F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).cast("int")
    return out.withColumns({"full": full, "budget": F.floor((F.col("repetition") - full) * F.col("tokens")).cast("long"), "parts": parts})


def _block(h: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(h, F.lit(101)), parts).cast("int")


def _block_order(source: Column, epoch: Column, block: Column) -> Column:
    return F.xxhash64(F.coalesce(source, F.lit("")), epoch, block, F.lit(102))


def _doc_order(h: Column, epoch: Column) -> Column:
    return F.xxhash64(h, epoch, F.lit(103))


def _same(*names: str) -> Column:
    """Null-safe equality of columns with those of the same name after two underscores."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return out


def _rooms(blocks: DataFrame) -> DataFrame:
    """Adds ``left`` to blocks (source, block, tokens, budget, o): the tokens of its budget that earlier ones leave, at
    least 0 and at most its own."""
    blocks = blocks.withColumn("range", F.shiftright("o", 64 - RANGE_BITS))
    ranges = blocks.groupBy("source", "range").agg(F.sum("tokens").alias("__tokens"))
    # At most 2 ** RANGE_BITS rows a source.
    order = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranges = ranges.withColumn("__before", F.sum("__tokens").over(order) - F.col("__tokens")).withColumnsRenamed({"source": "__source", "range": "__range"})
    placed = blocks.join(ranges, _same("source", "range")).drop("__source", "__range")
    ends = (F.col("__before") < F.col("budget")) & (F.col("__before") + F.col("__tokens") > F.col("budget"))
    # Ranges before the end are whole, ranges after it out; sums go on only inside the one between.
    outside = placed.where(~ends).withColumn("left", F.when(F.col("__before") < F.col("budget"), F.col("tokens")).otherwise(0))
    inner = W.partitionBy("source", "range").orderBy("o", "block").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.col("__before") + F.sum("tokens").over(inner) - F.col("tokens")
    inside = placed.where(ends).withColumn("left", F.greatest(F.least(F.col("budget") - before, F.col("tokens")), F.lit(0)))
    return outside.unionByName(inside).drop("range", "o", "__before", "__tokens")


def block_plan(lengths: DataFrame, plan: DataFrame) -> DataFrame:
    """By source and block: whole epochs, and which documents the cut epoch takes: those up to ``cutoff``."""
    p = plan.select(F.col("source").alias("__source"), "repetition", "weight", "full", "budget", "parts")
    placed = lengths.join(p, _same("source")).withColumn("block", _block(F.col("h"), F.col("parts")))
    placed = placed.select("source", "block", "h", "n_tokens", "full", "budget", "weight", "repetition", "parts")
    sums = placed.groupBy("source", "block", "full", "budget", "weight", "repetition", "parts").agg(F.sum("n_tokens").alias("tokens"))
    sums = materialise(_rooms(materialise(sums.withColumn("o", _block_order(F.col("source"), F.col("full"), F.col("block"))))))
    cut = sums.where("left > 0 and left < tokens").select(F.col("source").alias("__source"), F.col("block").alias("__block"), "left")
    inside = placed.join(cut, _same("source", "block"))
    # Equal rows are one entry; a block's texts are bounded by its tokens.
    texts = inside.groupBy("source", "block", "h", "full", "left").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("o", _doc_order(F.col("h"), F.col("full")))
    run = W.partitionBy("source", "block").orderBy("o").rangeBetween(W.unboundedPreceding, W.currentRow)
    taken = texts.withColumn("sum", F.sum("n_tokens").over(run)).where(F.col("sum") <= F.col("left")).groupBy("source", "block").agg(F.max("o").alias("cutoff"))
    taken = taken.select(F.col("source").alias("__source"), F.col("block").alias("__block"), "cutoff")
    out = sums.join(taken, _same("source", "block"), "left")
    # All of a block that fits, none of one after the cut.
    cutoff = F.when((F.col("left") >= F.col("tokens")) & (F.col("budget") > 0), F.lit(2**63 - 1)).when(F.col("left") > 0, F.col("cutoff"))
    return materialise(out.select("source", "block", "full", "weight", "repetition", "parts", cutoff.alias("cutoff")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """All columns of ``docs``, each row once for each epoch that takes it, and a struct ``mix``.

    ``mix`` has weight, repetition, epoch, block, block_order, doc_order: read in ascending epoch,
    block_order, doc_order the rows of a source are its block permutations. ``docs`` has doc_id, text, source.
    """
    lengths = materialise(docs.select("source", row_hash().alias("h"), word_count(F.col("text")).alias("n_tokens")))
    plan = materialise(mixture(lengths, **how))
    blocks = block_plan(lengths, plan)
    p = plan.select(F.col("source").alias("__s"), F.col("parts").alias("__parts"))
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), row_hash().alias("__h"), F.col("source").alias("__source"))
    placed = inside.join(p, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__block", _block(F.col("__h"), F.col("__parts"))).select("__row", "__h", "__source", "__block")
    joined = placed.join(blocks, F.col("__source").eqNullSafe(F.col("source")) & (F.col("__block") == F.col("block")))
    taken = F.coalesce(_doc_order(F.col("__h"), F.col("full")) <= F.col("cutoff"), F.lit(False)).cast("int")
    epochs = joined.withColumn("__epochs", F.col("full") + taken).where("__epochs > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__epochs") - 1)))
    made = F.struct("weight", "repetition", F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), _block_order(F.col("__source"), F.col("__epoch"), F.col("__block")).alias("block_order"), _doc_order(F.col("__h"), F.col("__epoch")).alias("doc_order"))
    return epochs.select(*[F.col("__row")[c].alias(c) for c in docs.columns], made.alias("mix"))


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document, once for each epoch of its source: doc_id, source, n_tokens and its places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", word_count(F.col("text")).alias("n_tokens"), "mix.weight", "mix.repetition", "mix.epoch", "mix.block", "mix.block_order", "mix.doc_order")
