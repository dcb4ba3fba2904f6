"""Queries that expect all items of a category: no pair of a query and an item is made that was not found."""


import pytest

from corvane.operators import evals
from corvane.queries import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["eval_precision_mrr", "eval_grade_by_category", "eval_union_recall"])
def test_no_join_multiplies(spark, name):
    """Rows that any join of the executed plan made: no more than what was found and the vectors."""
    found = queries()[name](spark, SMALL)
    plan = found._jdf.queryExecution()
    found.collect()
    made, todo = [], [plan.executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "Join" in kind and p.metrics().contains("numOutputRows"):
            made.append(p.metrics().apply("numOutputRows").value())
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    n, asked = vectors.count(), vectors.filter("vec_id % 20 = 0").count()
    assert max(made, default=0) <= max(n, 20 * asked)


def test_equal_to_pairs(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "query_id long, category string")
    items = spark.createDataFrame([(10, "a"), (11, "a"), (11, "a"), (12, "b"), (13, None), (14, "a"), (14, "b")], "item long, category string")
    ranked = spark.createDataFrame([(q, i, 1.0 - n / 10, n + 1) for q in (1, 2, 3, 4) for n, i in enumerate((13, 12, 11, 10, 14))], "query_id long, item long, similarity double, rank int")
    pairs = asked.join(items, "category").select("query_id", "item")
    plain = lambda df: sorted(map(tuple, df.collect()))
    for k in (1, 2, 4, 5):
        assert plain(evals.category_scores(asked, items, ranked, k).drop("category")) == plain(evals.ranked_scores(pairs, ranked, k))
        halves = [ranked.filter("item % 2 = 0"), ranked.filter("item % 2 = 1")]
        assert plain(evals.category_recall(asked, items, halves, k).drop("category")) == plain(evals.union_recall(pairs, halves, k))
