"""Evaluation of rankings."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ir_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """ranked (query_id, document_id, rank), relevant (query_id, document_id) -> query_id, recall, mrr, ndcg at k.

    A query without relevant documents scores 0.
    """
    rel = relevant.select("query_id", "document_id").distinct()
    n = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = ranked.where(F.col("rank") <= k).join(rel, ["query_id", "document_id"])
    h = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max(1 / F.col("rank")).alias("mrr"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    j = queries.select("query_id").join(n, "query_id", "left").join(h, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("query_id", zero(F.col("hits") / F.col("n")).alias("recall"), zero(F.col("mrr")).alias("mrr"), zero(F.col("dcg") / F.when(F.col("n") > 0, ideal)).alias("ndcg"))


def summary(metrics: DataFrame, measures: list[str]) -> DataFrame:
    """arm, type, measures -> means for each arm over all queries (type null) and each type: one grouping-sets pass."""
    g = metrics.groupingSets([["arm"], ["arm", "type"]], "arm", "type")
    return g.agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in measures])


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    aggs = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"p{p}") for p in percents]
    return df.groupBy(*by).agg(*aggs)


def bootstrap(df: DataFrame, by: list[str], value: str, order: str, resamples: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Mean and percentile interval of each group by resampling its values, in the order of ``order``, with a seeded generator.

    A group is the scores of an arm's labelled queries, one value a query that people drafted.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        values, rng = pdf.sort_values(order)[value].tolist(), random.Random(seed)
        n = len(values)
        means = sorted(sum(rng.choices(values, k=n)) / n for _ in range(resamples))
        low, high = means[int(alpha / 2 * resamples)], means[max(0, int((1 - alpha / 2) * resamples) - 1)]
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "mean": sum(values) / n, "low": low, "high": high}])

    kinds = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in by)
    return df.groupBy(*by).applyInPandas(run, f"{kinds}, mean double, low double, high double")


def poisson_steps(most: int = 12) -> list[float]:
    """Cumulative probabilities of a Poisson variable of mean 1, from none on."""
    out, term = [], math.exp(-1)
    for k in range(most):
        out.append((out[-1] if out else 0.0) + term)
        term /= k + 1
    return out


def drawn_intervals(df: DataFrame, by: list[str], value: str, ident: str, resamples: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """by, n, mean, low, high: mean and percentile interval of each group by resampling, for groups of any size.

    A resample is a row of sums. In each, a value is drawn as often as a Poisson variable of mean 1 says,
    which its own digest of (seed, resample, ``ident``) gives: tasks need no numbering of a group's values,
    no generator and no order, and sums combine before the shuffle. Resamples without a draw are left out,
    as is a null value. For n values an end differs from that of ``bootstrap`` by its own error of
    drawing, about 2.7 sd / sqrt(n * resamples), and by a share of about 1 / n of the interval's width,
    since the number of draws varies.
    """
    steps = poisson_steps()
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), F.coalesce(F.col(ident).cast("string"), F.lit("")).alias("_i"))
    each = v.select(*by, "_v", "_i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("_r"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_r").cast("string"), "_i")), 1, 8), 16, 10).cast("double") / 2.0**32
    drawn = F.lit(len(steps))
    for k in reversed(range(len(steps))):
        drawn = F.when(u < steps[k], k).otherwise(drawn)
    means = each.withColumn("_w", drawn).groupBy(*by, "_r").agg((F.sum(F.col("_w") * F.col("_v")) / F.when(F.sum("_w") > 0, F.sum("_w"))).alias("_m"))
    ends = means.groupBy(*by).agg(F.sort_array(F.collect_list("_m")).alias("_ms"))  # ``resamples`` numbers
    at = lambda share: F.get("_ms", F.greatest(F.lit(0), share).cast("int"))
    k = F.size("_ms")
    ends = ends.select(*by, at(F.floor(F.lit(alpha / 2) * k)).alias("low"), at(F.floor(F.lit(1 - alpha / 2) * k) - 1).alias("high"))
    whole = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    return whole.join(ends, by).select(*by, "n", "mean", "low", "high") if by else whole.join(F.broadcast(ends), F.lit(True))


def paired_difference(metrics: DataFrame, arm: str, base: str, measure: str) -> DataFrame:
    """query_id, type, difference of ``measure`` between two arms."""
    a = metrics.where(F.col("arm") == arm).select("query_id", "type", F.col(measure).alias("a"))
    b = metrics.where(F.col("arm") == base).select("query_id", F.col(measure).alias("b"))
    return a.join(b, "query_id").select("query_id", "type", (F.col("a") - F.col("b")).alias("difference"))


def decision(intervals: DataFrame, margin: float) -> DataFrame:
    """type (lexical, semantic), mean, low, high -> one row: lexical_gain, no_semantic_loss, adopt.

    Adopt if the lexical interval lies above ``margin`` (chosen before, so without a default) and the
    semantic one reaches zero.
    """
    of = lambda kind, c: F.max(F.when(F.col("type") == kind, F.col(c)))
    d = intervals.agg(F.coalesce(of("lexical", "low") > margin, F.lit(False)).alias("lexical_gain"), F.coalesce(of("semantic", "high") >= 0, F.lit(False)).alias("no_semantic_loss"))
    return d.withColumn("adopt", F.col("lexical_gain") & F.col("no_semantic_loss"))
