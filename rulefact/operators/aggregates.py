"""Evaluation metrics and grouped figures. All are grouped sums; nothing is gathered per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("proved", "not_proved", "blocked", "unknown")


def confusion(rows: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """expected, and a column per label with the count of that verdict; zero filled, other labels ignored."""
    spark = rows.sparkSession
    counted = rows.where(F.col("got").isin(*labels)).groupBy("expected").pivot("got", list(labels)).count()
    return spark.createDataFrame([(x,) for x in labels], "expected string").join(counted, "expected", "left").na.fill(0)


def per_label(rows: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 (0 where a denominator is)."""
    x = rows.select("expected", "got", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    e, g = F.col("expected") == F.col("label"), F.col("got") == F.col("label")
    x = x.groupBy("label").agg(F.count_if(e & g).alias("tp"), F.count_if(~e & g).alias("fp"), F.count_if(e & ~g).alias("fn"), F.count_if(e).alias("support"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    x = x.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return x.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(labels: DataFrame) -> DataFrame:
    """Macro precision, recall and F1, and F1 weighted by support."""
    return labels.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias("weighted_f1"))


def share(test: Column) -> Column:
    """Share of rows that pass; null without rows."""
    return F.avg(test.cast("double"))


def coverage(cases: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """share: how many of the cases have a row in `have`; null without cases."""
    return cases.join(have.select(key).distinct().withColumn("has", F.lit(True)), key, "left").agg(share(F.col("has").isNotNull()).alias("share"))


def baseline_difference(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, value, baseline, difference (null where either run lacks the metric)."""
    return current.join(baseline.withColumnRenamed("value", "baseline"), "metric", "full").select("metric", "value", "baseline", (F.col("value") - F.col("baseline")).alias("difference"))


def calibration_error(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last closed."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(p) * bins)))
    x = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(y).cast("double")).alias("accuracy"))
    return x.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y.cast("double"), 2))


#: Rows that a quantile is picked from at last.
SLICE = 50_000


def _at_ranks(rows: DataFrame, n: int, ranks: list[int], most: int) -> dict[int, float]:
    """The values at some ranks (from 0) of rows(v) without nulls, n in number: pivots near a rank cut its range down, counted in one
    pass each, until at most `most` rows lie between them, or the rank's value is a pivot."""
    found: dict[int, float] = {}
    for rank in sorted(set(ranks)):
        if rank in found:
            continue
        inside, size, before = rows, n, 0  # rows that may hold the rank, their number, rows below them
        while rank not in found:
            if size <= most:
                values = [r[0] for r in inside.orderBy("v").collect()]
                found |= {k: values[k - before] for k in ranks if before <= k < before + size}
                break
            share = (rank - before + 0.5) / size
            low, high = inside.agg(F.percentile_approx("v", [max(share - 0.001, 0.0), min(share + 0.001, 1.0)], 2000).alias("q")).first()["q"]
            v = F.col("v")
            counts = inside.agg(*(F.count_if(test).alias(name) for name, test in (("below", v < low), ("low", v == low), ("between", (v > low) & (v < high)), ("high", v == high if high > low else F.lit(False))))).first()
            at = before + counts["below"]
            if rank < at:
                inside, size = inside.where(v < low), counts["below"]
            elif rank < at + counts["low"]:
                found[rank] = low
            elif rank < at + counts["low"] + counts["between"]:
                inside, size, before = inside.where((v > low) & (v < high)), counts["between"], at + counts["low"]
            elif rank < at + counts["low"] + counts["between"] + counts["high"]:
                found[rank] = high
            else:
                before = at + counts["low"] + counts["between"] + counts["high"]
                inside, size = inside.where(v > high), size - sum(counts)
    return found


def quantiles(rows: DataFrame, value: str, shares: list[float], most: int = SLICE) -> list[float | None]:
    """Exact quantiles with linear interpolation between ranks, nulls ignored; None without a value. No task holds more than `most`
    rows at once, whatever their number: approximate quantiles and counts narrow down where a rank lies."""
    x = rows.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    n = x.count()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * q for q in shares]
    at = _at_ranks(x, n, [k for p in places for k in (int(p), min(int(p) + 1, n - 1))], most)
    return [at[int(p)] + (at[min(int(p) + 1, n - 1)] - at[int(p)]) * (p - int(p)) for p in places]


def latency(rows: DataFrame, value: str, most: int = SLICE) -> DataFrame:
    """p50, p95 (exact, interpolated) and mean."""
    p50, p95 = quantiles(rows, value, [0.5, 0.95], most)
    return rows.agg(F.lit(p50).cast("double").alias("p50"), F.lit(p95).cast("double").alias("p95"), F.avg(value).alias("mean"))


def replay_rate(runs: DataFrame) -> DataFrame:
    """Share of cases whose replays (case_id, replay, verdict lines) all have the same signature."""
    signed = runs.groupBy("case_id", "replay").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("line"))), 256).alias("signature"))
    cases = signed.groupBy("case_id").agg((F.count_distinct("signature") == 1).alias("stable"))
    return cases.agg(share(F.col("stable")).alias("replay_rate"), F.count(F.lit(1)).alias("n_cases"))


def jaccard(rows: DataFrame, seed: str, item: str) -> DataFrame:
    """seed_a, seed_b, jaccard of the items of each two seeds; counted through shared items."""
    x = rows.select(seed, item).distinct()
    sizes = x.groupBy(seed).agg(F.count(F.lit(1)).alias("n"))
    a, b = x.select(F.col(seed).alias("seed_a"), item), x.select(F.col(seed).alias("seed_b"), item)
    both = a.join(b, item).where("seed_a < seed_b").groupBy("seed_a", "seed_b").agg(F.count(F.lit(1)).alias("both"))
    out = both.join(sizes.select(F.col(seed).alias("seed_a"), F.col("n").alias("na")), "seed_a").join(sizes.select(F.col(seed).alias("seed_b"), F.col("n").alias("nb")), "seed_b")
    return out.select("seed_a", "seed_b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def supervision_counts(rows: DataFrame) -> DataFrame:
    """labelled, n_t, n_f, n_u and the sum of weights; targets 0 T, 1 F, 2 U, -1 none."""
    t = F.col("target")
    return rows.agg(F.count_if(t >= 0).alias("labelled"), *(F.count_if(t == k).alias(f"n_{c}") for k, c in enumerate("tfu")), F.coalesce(F.sum(F.when(t >= 0, F.col("weight"))), F.lit(0.0)).alias("weight"))
