"""Retrieval metrics, grades, rater agreement, confusion matrices and latency percentiles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.shared import settled

# Least mean precision and reciprocal rank of each grade.
GRADES = (("A", 0.99, 0.97), ("B", 0.90, 0.85), ("C", 0.75, 0.70))


def ranked_scores(expected: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """precision (found among the first k by expected) and mrr (0 beyond k) of each query.

    expected: query_id, item. ranked: query_id, item, rank from 1.
    """
    hits = ranked.filter(F.col("rank") <= k).join(expected, ["query_id", "item"], "left_semi")
    got = hits.groupBy("query_id").agg(F.countDistinct("item").alias("hits"), F.min("rank").alias("first"))
    want = expected.groupBy("query_id").agg(F.countDistinct("item").alias("expected"))
    return want.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("expected"), 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def by_category(asked: DataFrame, items: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, category, expected, hits, first (rank) of each query that expects the items of its category.

    asked: query_id, category. items: item, category. ranked: query_id, item, rank. Items are counted by category and found ones alone are
    joined, so a query and the items that it expects are not made into pairs.
    """
    own = items.select("item", "category").filter(F.col("category").isNotNull()).distinct()
    sizes = own.groupBy("category").agg(F.count("*").alias("expected"))
    want = asked.select("query_id", "category").distinct().join(sizes, "category")
    got = ranked.join(own, "item").groupBy("query_id", "category").agg(F.countDistinct("item").alias("hits"), F.min("rank").alias("first"))
    return want.join(got, ["query_id", "category"], "left").select("query_id", "category", "expected", F.coalesce("hits", F.lit(0)).alias("hits"), "first")


def category_scores(asked: DataFrame, items: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """query_id, category, and precision and mrr as ranked_scores has them, where a query expects all items of its category."""
    own = by_category(asked, items, ranked.filter(F.col("rank") <= k))
    return own.select("query_id", "category", F.round(F.col("hits") / F.col("expected"), 6).alias("precision"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def _of_union(hits: list[DataFrame], k: int, fetch: int) -> DataFrame:
    every = reduce(DataFrame.unionByName, (h.filter(F.col("rank") <= fetch).select("query_id", "item", "similarity") for h in hits))
    best = every.groupBy("query_id", "item").agg(F.max("similarity").alias("similarity"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item"))).filter(F.col("rank") <= k)


def union_recall(expected: DataFrame, hits: list[DataFrame], k: int = 3, fetch: int = 10) -> DataFrame:
    """query_id, recall: the share of the expected items among the first k of the union of several stores' hits.

    hits: query_id, item, similarity, rank of each store, of which the first `fetch` count; an item that several stores have counts once, by its best similarity.
    """
    got = _of_union(hits, k, fetch).join(expected, ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    want = expected.groupBy("query_id").agg(F.countDistinct("item").alias("expected"))
    return want.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("expected"), 6).alias("recall"))


def category_recall(asked: DataFrame, items: DataFrame, hits: list[DataFrame], k: int = 3, fetch: int = 10) -> DataFrame:
    """query_id, category, and recall as union_recall has it, where a query expects all items of its category."""
    own = by_category(asked, items, _of_union(hits, k, fetch))
    return own.select("query_id", "category", F.round(F.col("hits") / F.col("expected"), 6).alias("recall"))


def calibration(spark: SparkSession, run: int, scenario: str, augmentations: dict[str, str], raters: dict[str, Callable[[str, str], dict[str, int]]], dimensions: tuple[str, ...]) -> DataFrame:
    """Ratings of one run: run, scenario, augmentation, rater, dimension, score, rationale. A rater gives a score for each dimension of an augmentation's body; one that fails gives none and says why."""
    rows: list[tuple] = []
    for name, body in augmentations.items():
        for rater, rate in raters.items():
            try:
                scores, why = rate(scenario, body), None
            except Exception as e:  # other raters go on
                scores, why = {}, f"error: {e}"
            rows += [(run, scenario, name, rater, d, scores.get(d), why) for d in dimensions]
    return spark.createDataFrame(rows, "run int, scenario string, augmentation string, rater string, dimension string, score int, rationale string")


def grade(precision: Column, mrr: Column) -> Column:
    out = None
    for name, p, m in GRADES:
        test = (precision >= p) & (mrr >= m)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("F")


def grades(scores: DataFrame, category: str = "category") -> DataFrame:
    """Means and grade of each category and, under `all`, of all queries."""
    mean = scores.rollup(category).agg(F.count("*").alias("n"), F.avg("precision").alias("_p"), F.avg("mrr").alias("_m"), F.grouping(category).alias("_g"))
    return mean.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(category).cast("string")).alias(category), "n", F.round("_p", 6).alias("mean_precision"), F.round("_m", 6).alias("mean_mrr"), grade(F.col("_p"), F.col("_m")).alias("grade"))


def confusion(rows: DataFrame, predicted: Column, actual: Column, least_precision: float = 0.7, least_recall: float = 0.8) -> DataFrame:
    """tp, fp, tn, fn, precision and recall (1 where nothing counts), and whether both floors are met."""
    n = rows.agg(*(F.count_if(c).alias(k) for k, c in (("tp", predicted & actual), ("fp", predicted & ~actual), ("tn", ~predicted & ~actual), ("fn", ~predicted & actual))))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) == 0, F.lit(1.0)).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    out = n.withColumn("precision", F.round(ratio("tp", "fp"), 6)).withColumn("recall", F.round(ratio("tp", "fn"), 6))
    return out.withColumn("meets_floor", (ratio("tp", "fp") >= least_precision) & (ratio("tp", "fn") >= least_recall))


def rater_disagreement(ratings: DataFrame) -> DataFrame:
    """Spread of each run's dimension; over 1, of two ratings or more, is a disagreement."""
    return ratings.groupBy("run", "dimension").agg(F.round(F.avg("score"), 6).alias("mean"), (F.max("score") - F.min("score")).alias("spread"), F.count("score").alias("n")).withColumn("disagrees", (F.col("n") >= 2) & (F.col("spread") > 1))


def rater_pair_rate(ratings: DataFrame, a: str, b: str, tripwire: float = 0.05) -> DataFrame:
    """The share of dimensions rated by both on which they differ by over 1; null if there are none."""
    pair = ratings.groupBy("run", "dimension").agg(F.max(F.when(F.col("rater") == a, F.col("score"))).alias("x"), F.max(F.when(F.col("rater") == b, F.col("score"))).alias("y")).filter("x is not null and y is not null")
    rate = F.count_if(F.abs(F.col("x") - F.col("y")) > 1) / F.nullif(F.count("*"), F.lit(0))
    return pair.agg(F.count("*").alias("pairs"), F.round(rate, 6).alias("rate"), (rate > tripwire).alias("tripped"))


def nested_mean(ratings: DataFrame, *levels: str, score: str = "score") -> DataFrame:
    """Mean of means: over the last level first, then outwards."""
    out, keys = ratings.select(*levels, F.col(score).cast("double").alias(score)), list(levels)
    while keys:
        out = out.groupBy(*keys).agg(F.avg(score).alias(score))
        keys.pop()
    return out.agg(F.round(F.avg(score), 6).alias("mean"), F.count("*").alias("n"))


def time_score(seconds: Column, calls: Column, budget_seconds: Column, budget_calls: Column, veto: Column, time_weight: float = 0.5, call_weight: float = 0.5) -> Column:
    return F.when(veto, F.lit(0.0)).otherwise(F.round(F.lit(1.0) - seconds / budget_seconds * time_weight - calls / budget_calls * call_weight, 6))


def p95(rows: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """The value at place round((n - 1) * 0.95) of the sorted ones, rounded half to even, and the mean; of each group where `by` is given. Null values do not count.

    Equal values are counted together, then placed in range partitions of group and value, so no task sorts a whole group. The counts are
    written first, as what is summed and what is searched must be the same partitions.
    """
    group = F.col(by) if by else F.lit(0)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group.alias("_g"), F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    counts = settled(counts.repartitionByRange("_g", "_x").sortWithinPartitions("_g", "_x").withColumn("_p", F.spark_partition_id()))
    part = counts.groupBy("_g", "_p").agg(F.sum("_c").alias("_s"), F.sum(F.col("_c") * F.col("_x")).alias("_v"))
    of = Window.partitionBy("_g")  # a row for each partition that holds some of the group
    before = F.coalesce(F.sum("_s").over(of.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = part.select(F.col("_g").alias("_h"), F.col("_p").alias("_q"), before.alias("_b"), F.sum("_s").over(of).alias("_n"), F.sum("_v").over(of).alias("_t"))
    place = F.least(F.col("_n") - 1, F.bround((F.col("_n") - 1) * 0.95).cast("long"))
    own = Window.partitionBy("_g", "_p").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.join(total, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_p") == F.col("_q"))).withColumn("_e", F.col("_b") + F.sum("_c").over(own))
    found = run.filter((F.col("_e") > place) & (F.col("_e") - F.col("_c") <= place))
    return found.select(*([F.col("_g").alias(by)] if by else []), F.col("_n").alias("n"), F.round("_x", 6).alias("p95"), F.round(F.col("_t") / F.col("_n"), 6).alias("mean"))


def gate_status(n_real: Column, n_malformed: Column, n_input: Column, least: int) -> Column:
    """Whether an evaluation may run on its fixtures."""
    return F.when(n_input == 0, "blocked-input").when(n_malformed > 0, "blocked-malformed").when(n_real < least, "blocked-fixtures").otherwise("ok")


def schema_errors(required: dict[str, Column], checks: dict[str, Column] | None = None) -> Column:
    """Messages for required values that are null and for checks that do not hold."""
    found = [F.when(c.isNull(), F.lit(f"missing {k}")) for k, c in required.items()]
    found += [F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in (checks or {}).items()]
    return F.filter(F.array(*found), lambda e: e.isNotNull())
