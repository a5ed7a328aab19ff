"""Problem 7: mix sources to target shares of the tokens, with capped repetition."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from intentlake.plans.runtime import store

#: Runs of letters and digits, and each other character that is no white space.
TOKEN = r"(?U)[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
#: Blocks a source is dealt into, the units of the permutations: so many at least, and one for each so many documents.
BLOCKS, BLOCK_DOCUMENTS = 1024, 10_000


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to `exponent` and normalised; a share of 0 stays 0."""
    raised = {k: s**exponent if s > 0 else 0.0 for k, s in shares.items()}
    total = sum(raised.values())
    return {k: r / total if total else 0.0 for k, r in raised.items()}


def bisect(good, low: float, high: float, steps: int = 80) -> float:
    """The largest exponent in [low, high] for which `good` holds; `good` holds at low and is monotone."""
    if good(high):
        return high
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def exponent_for_entropy(shares: dict[str, float], target: float) -> float:
    """Exponent at which the tempered shares have the entropy `target`, within [0, 64]."""
    return bisect(lambda a: entropy(tempered(shares, a)) >= target, 0.0, 64.0)


@dataclass(frozen=True)
class SourcePlan:
    source: str
    tokens: int
    target_share: float
    weight: float
    passes: float
    reachable: bool
    exponent: float


def plan_mixture(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> list[SourcePlan]:
    """Weight and passes of each source, for a mixture as large as all its sources together.

    Between the corpus as it is (exponent 0) and the wanted mixture (exponent
    1) the tempered size of a source is own ** (1 - a) * wanted ** a, both in
    tokens. Its exponent is the largest up to 1 that keeps it within
    max_repeats passes, found by bisection; a source whose exponent stays below
    1 can't reach its share. The tempered weights are then normalised: the
    sources below their limits are scaled by one factor, bisected too, until
    all weights sum to 1 or every source is at its limit, so that these keep
    their shares relative to each other. A source without tokens has weight 0.
    """
    total = sum(tokens.get(s, 0) for s in targets)
    plans = []
    for source, (wanted, repeats) in sorted(targets.items()):
        own, goal = tokens.get(source, 0), wanted * total

        def within(a: float, own: int = own, goal: float = goal, repeats: int = repeats) -> bool:
            return own ** (1.0 - a) * goal**a <= repeats * own

        if goal <= 0:
            a, size = 1.0, 0.0
        elif not own:
            a, size = 0.0, 0.0
        else:
            # with less than one pass allowed even the corpus as it is goes beyond the limit
            a = bisect(within, 0.0, 1.0)
            size = min(own ** (1.0 - a) * goal**a, repeats * own)
        plans.append(SourcePlan(source, own, wanted, size / total if total else 0.0, size / own if own else 0.0, a == 1.0 or goal <= 0, a))
    limits = {p.source: targets[p.source][1] * p.tokens / total if total else 0.0 for p in plans}
    return normalised(plans, limits)


def normalised(plans: list[SourcePlan], limits: dict[str, float]) -> list[SourcePlan]:
    """The plans with weights that sum to 1 as far as the limits allow: one factor for all below theirs."""
    total = sum(p.tokens for p in plans)

    def scaled(factor: float) -> dict[str, float]:
        return {p.source: min(p.weight * factor, limits[p.source]) for p in plans}

    # beyond this factor every source with a weight is at its limit
    most = max([limits[p.source] / p.weight for p in plans if p.weight > 0], default=1.0)
    factor = bisect(lambda f: sum(scaled(f).values()) <= 1.0, 0.0, max(1.0, most))
    weights = scaled(factor)
    return [replace(p, weight=weights[p.source], passes=weights[p.source] * total / p.tokens if p.tokens else 0.0) for p in plans]


def source_tokens(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, source, tokens of the documents that belong to a source of the mixture.

    The source is compared lower-cased and without outer white space. A null
    source, text or an unknown source takes no part; an empty text has 0 tokens.
    """
    name = lambda c: F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    wanted = targets.where(F.col("source").isNotNull()).select(name("source").alias("_source")).distinct()
    own = documents.where(F.col("text").isNotNull()).select("doc_id", name("source").alias("source"), F.regexp_count("text", F.lit(TOKEN)).cast("bigint").alias("tokens"))
    return own.join(wanted, F.col("source") == F.col("_source"), "left_semi")


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """The wanted mixture, a setting of a few rows; of a source named twice the first share counts.

    A null share counts as 0, null repeats as 1.
    """
    rows = targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").orderBy("source", "target_share", "max_repeats").collect()
    wanted: dict[str, tuple[float, int]] = {}
    for r in rows:
        wanted.setdefault(r.source.strip().lower(), (r.target_share or 0.0, 1 if r.max_repeats is None else r.max_repeats))
    return wanted


def totals(own: DataFrame) -> dict[str, int]:
    """Tokens of each source of the targets: one partial aggregation, one row per source to the driver."""
    return {r.source: r.tokens for r in own.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}


PLAN = "source string, tokens bigint, target_share double, weight double, passes double, reachable boolean, exponent double"


def plan_frame(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """The plan as rows: source, tokens, target_share, weight, passes, reachable, exponent."""
    plans = plan_mixture(totals(source_tokens(documents, targets)), read_targets(targets))
    return documents.sparkSession.createDataFrame([tuple(vars(p).values()) for p in plans], PLAN)


def plan_temperature(tokens: dict[str, int], wanted: dict[str, tuple[float, int]]) -> list[SourcePlan]:
    """The mixture that is as even as the targets without naming them.

    One exponent for all sources, the tempered shares normalised. It is the
    largest up to 1 at which the entropy is that of the targets or more, found
    by bisection, and then raised as far as the repetition limits demand (at 1
    every source is used once, which each limit of 1 or more allows).
    """
    total = sum(tokens.get(s, 0) for s in wanted)
    shares = {s: tokens.get(s, 0) / total if total else 0.0 for s in wanted}
    positive = {s: t for s, (t, _) in wanted.items() if t > 0}
    scale = sum(positive.values())
    exponent = min(1.0, exponent_for_entropy(shares, entropy({s: t / scale for s, t in positive.items()}))) if scale and total else 1.0

    def within(a: float) -> bool:
        return all(w <= max(1, wanted[s][1]) * shares[s] + 1e-12 for s, w in tempered(shares, a).items())

    if not within(exponent):
        exponent = 1.0 - bisect(lambda d: within(1.0 - d), 0.0, 1.0 - exponent)
    weights = tempered(shares, exponent)
    return [SourcePlan(s, tokens.get(s, 0), wanted[s][0], w, w / shares[s] if shares[s] else 0.0, True, exponent) for s, w in sorted(weights.items())]


def temperature(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """plan_temperature() and what its permuted blocks reach: source, share, exponent, weight, reached_share."""
    own = store(source_tokens(documents, targets))
    plans = plan_temperature(totals(own), read_targets(targets))
    total = sum(p.tokens for p in plans)
    rows = [(p.source, p.tokens / total if total else 0.0, p.exponent, p.weight) for p in plans]
    return _reached(documents.sparkSession.createDataFrame(rows, "source string, share double, exponent double, weight double"), realise(own, plans)).drop("used_tokens", "most_repeats")


def realise(own: DataFrame, plans: list[SourcePlan], seed: int = 17) -> DataFrame:
    """How often each document of `own` is used: doc_id, source, tokens, repeats; unused documents have 0.

    Whole passes use every document. For the broken last pass the documents of
    a source lie in hashed blocks; the blocks are taken in a permuted order as
    long as the budget lasts, and only the block at the edge of the budget is
    ordered inside, so no source is ever sorted as a whole.
    """
    spark = own.sparkSession
    total = sum(p.tokens for p in plans)
    whole = {p.source: int(p.passes + 1e-9) for p in plans}
    budgets = spark.createDataFrame([(p.source, whole[p.source], max(0.0, p.weight * total - whole[p.source] * p.tokens)) for p in plans], "source string, whole int, rest double")
    dealt_into = max(BLOCKS, -(-own.count() // BLOCK_DOCUMENTS))
    own = own.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(dealt_into)))
    blocks = own.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before", F.coalesce(F.sum("block_tokens").over(order), F.lit(0))).join(budgets, "source")
    dealt = own.join(before, ["source", "block"])
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("block_tokens") > F.col("rest"))
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    full = dealt.where(~edge).withColumn("used", (F.col("before") < F.col("rest")).cast("int"))
    part = dealt.where(edge).withColumn("used", (F.sum("tokens").over(inside) + F.col("before") <= F.col("rest")).cast("int"))
    return full.unionByName(part).select("doc_id", "source", "tokens", (F.col("whole") + F.col("used")).cast("bigint").alias("repeats"))


def draw(documents: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """The planned mixture, realised; texts are read once, and then only their token counts."""
    own = store(source_tokens(documents, targets))
    return realise(own, plan_mixture(totals(own), read_targets(targets)), seed)


def _reached(plan: DataFrame, drawn: DataFrame) -> DataFrame:
    used = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    everything = Window.partitionBy(F.lit(1))  # one row per source of the targets
    filled = plan.join(used, "source", "left").withColumns({"used_tokens": F.coalesce("used_tokens", F.lit(0)), "most_repeats": F.coalesce("most_repeats", F.lit(0))})
    return filled.withColumn("reached_share", F.col("used_tokens") / F.sum("used_tokens").over(everything))


def reached(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: passes, tokens used and the share actually reached, beside the target."""
    own = store(source_tokens(documents, targets))
    plans = plan_mixture(totals(own), read_targets(targets))
    plan = documents.sparkSession.createDataFrame([tuple(vars(p).values()) for p in plans], PLAN)
    return _reached(plan, realise(own, plans)).select("source", "tokens", "target_share", "reachable", F.round("passes", 6).alias("passes"), "most_repeats", "used_tokens", "reached_share")
