"""Boosted trees from histograms against brute force over raw rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import boosting
from tickloom.operators.boosting import Growth

COLUMNS = ["a", "b", "c"]


def table(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = 3 * (x[:, 0] > 0.3) + 2 * (x[:, 1] > 0) * (x[:, 0] <= 0.3) + np.round(rng.normal(0, 0.5, n), 3)
    return x, y


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, target double").repartition(parts)


def best_split(x, r, edges, penalty, least):
    """(gain, feature, edge) of the greatest gain, the first of equals; None if none is positive."""
    score = lambda v: v.sum() ** 2 / (len(v) + penalty) if len(v) else 0.0
    found = None
    for f, cuts in enumerate(edges):
        for e in cuts:
            low = x[:, f] <= e
            if least <= low.sum() and least <= (~low).sum() and (found is None or score(r[low]) + score(r[~low]) - score(r) > found[0] + 1e-9):
                found = (score(r[low]) + score(r[~low]) - score(r), f, e)
    return found if found and found[0] > 1e-9 else None


def brute_tree(x, r, edges, g):
    """[(rows of the leaf)] of a tree grown leaf by leaf, scanning all rows for each leaf."""
    open_, limit = [(np.arange(len(r)), 0)], g.leaves or 1 << g.depth
    while len(open_) < limit:
        gains = [best_split(x[i], r[i], edges, g.penalty, g.least) if g.depth is None or d < g.depth else None for i, d in open_]
        k = max(range(len(open_)), key=lambda j: gains[j][0] if gains[j] else -1)
        if gains[k] is None:
            break
        (i, d), (_, f, e) = open_.pop(k), gains[k]
        low = x[i, f] <= e
        open_ += [(i[low], d + 1), (i[~low], d + 1)]
    return [i for i, _ in open_]


def grouped(labels):
    return {tuple(np.flatnonzero(labels == k)) for k in np.unique(labels)}


def bins_of(x, edges):
    return np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)]).astype(np.uint8)


@pytest.mark.parametrize("g", [Growth(3, 0.3, depth=4, penalty=1.0), Growth(3, 0.3, leaves=7, least=20), Growth(2, 0.3, leaves=31, least=5, penalty=0.5)])
def test_trees_equal_brute_force(spark, g):
    x, y = table()
    e = boosting.fit(frame(spark, x, y), COLUMNS, g)
    bins, at = bins_of(x, e.edges), np.full(len(y), y.mean())
    for t in e.trees:
        want = brute_tree(x, y - at, e.edges, g)
        places = t.places(bins)
        assert grouped(places) == {tuple(i) for i in want}
        for i in want:
            value = g.rate * (y - at)[i].sum() / (len(i) + g.penalty)
            assert t.values[places[i[0]], 0] == pytest.approx(value, abs=1e-9)
        at = at + t.values[places, 0]
    assert len(e.trees) == g.trees and np.mean((y - at) ** 2) < y.var()


def test_symmetric_trees_ask_one_question_a_level(spark):
    x, y = table()
    g = Growth(2, 0.3, depth=3, penalty=3.0, symmetric=True)
    e = boosting.fit(frame(spark, x, y), COLUMNS, g)
    first = e.trees[0]
    bins, labels = bins_of(x, e.edges), np.zeros(len(y), int)
    # before the first tree all models are the mean, so its residuals are plain ones
    r = y - y.mean()
    for level, (f, c) in enumerate(zip(first.feature, first.cut, strict=True)):
        def score(f, edge):
            asked = labels * 2 + (x[:, f] > edge)
            return sum(r[asked == k].sum() ** 2 / ((asked == k).sum() + g.penalty) for k in np.unique(asked))

        assert score(f, e.edges[f][c]) == pytest.approx(max(score(k, q) for k, cuts in enumerate(e.edges) for q in cuts))
        labels = labels * 2 + (bins[:, f] > c)
    places = first.places(bins)
    assert places.max() < 8 and grouped(places) == grouped(labels)
    for k in np.unique(places):
        assert first.values[k, 0] == pytest.approx(g.rate * r[places == k].sum() / ((places == k).sum() + g.penalty))


def test_ordered_residuals_leave_the_row_itself_out(spark):
    """Models of a table that is one far value and many zeros: only rows whose turn is later see the far value."""
    x, y = np.zeros((64, 3)), np.zeros(64)
    x[:, 0] = np.arange(64)
    y[7] = 64.0
    g = Growth(1, 1.0, depth=1, penalty=0.0, symmetric=True)
    edges = boosting.edges_of(frame(spark, x, y), COLUMNS)
    models = 8
    turns = np.minimum(np.floor(np.log2(np.arange(64) + 1)).astype(np.int32), models - 2)
    state = boosting.binned(frame(spark, x, y), COLUMNS, edges, ["target"]).toPandas()
    state["turn"] = turns[np.argsort(np.argsort(-state["target"].to_numpy(), kind="stable"), kind="stable")]
    rows = boosting.blocks(spark.createDataFrame(state[["target", "turn", "bins"]], "target double, turn int, bins binary").repartition(2), 3, models, 1.0)
    ask = boosting._Asker(rows, 3, models, max(map(len, edges)) + 1, 2.0**-30)
    tree = boosting.grow_symmetric(ask, g, 2.0**-30, models)
    ask.close()
    place = tree.places(np.array([list(state["bins"][state["target"] == 64.0].iloc[0])], np.uint8))[0]
    # turn 0 is the far value's own: model 0 has seen nothing, all others have
    assert (tree.values[:, 0] == 0).all() and (tree.values[place, 1:] > 0).all()


def test_result_is_independent_of_partitions_and_shuffles(spark, monkeypatch):
    x, y = table(300)
    for g in (Growth(3, 0.2, depth=3, penalty=1.0), Growth(3, 0.2, depth=3, penalty=3.0, symmetric=True)):
        one = boosting.fit(frame(spark, x, y, 1), COLUMNS, g)
        monkeypatch.setattr(boosting, "FEW", 0)
        many = boosting.fit(frame(spark, x, y, 5), COLUMNS, g)
        monkeypatch.undo()
        for s, t in zip(one.trees, many.trees, strict=True):
            assert all(np.array_equal(a, b) for a, b in zip(s, t, strict=True))


def test_predictions_and_odd_rows(spark):
    x, y = table()
    rows = frame(spark, x, y).withColumn("id", F.monotonically_increasing_id()).withColumn("bins", F.lit("a name that clashes"))
    for g in (Growth(8, 0.3, leaves=8, least=5), Growth(8, 0.3, depth=4, penalty=3.0, symmetric=True)):
        e = boosting.fit(rows, COLUMNS, g)
        out = boosting.predict(rows, e, ["id", "target"])
        error, spread = out.agg(F.avg((F.col("target") - F.col("prediction")) ** 2), F.var_pop("target")).first()
        assert out.count() == len(y) and error < 0.5 * spread
        odd = spark.createDataFrame([(None, float("nan"), 1.0, 1), (float("inf"), -1e300, 0.0, 2)], "a double, b double, c double, id int")
        assert all(math.isfinite(r.prediction) for r in boosting.predict(odd, e, ["id"]).collect())
    with pytest.raises(ValueError, match="no train rows"):
        boosting.fit(rows.withColumn("target", F.lit(None).cast("double")), COLUMNS, g)
    same = boosting.fit(rows.withColumn("target", F.lit(0.1)), COLUMNS, Growth(2, 0.1, depth=3, penalty=1.0))
    assert all(len(t.feature) == 1 for t in same.trees) and same.base == pytest.approx(0.1)


def test_a_hot_value_and_a_constant_column(spark):
    x, y = table(600)
    x[:400, 0], x[:, 2] = 0.5, 1.0
    e = boosting.fit(frame(spark, x, y), COLUMNS, Growth(2, 0.3, depth=3, penalty=1.0))
    assert len(e.edges[2]) == 1 and all((t.feature != 2).all() for t in e.trees)


def test_models_by_name(spark):
    from tickloom.operators import models

    x, y = table(60)
    data = frame(spark, x, y).withColumns({"symbol": F.lit("s"), "dt": F.monotonically_increasing_id(), "split": F.when(F.col("a") > 1, "test").otherwise("train")})
    out = models.fit_predict(data, "symmetric_boosting", trees=1, columns=COLUMNS).collect()
    assert len(out) == (x[:, 0] > 1).sum() and all(r.predicted is not None and r.fit_error is None and r.model == "symmetric_boosting" for r in out)
    out = models.fit_predict(data.withColumn("split", F.lit("test")), "leafwise_boosting", trees=1, columns=COLUMNS).collect()
    assert len(out) == 60 and all(r.predicted is None and "no train rows" in r.fit_error for r in out)


@pytest.mark.parametrize("g", [Growth(12, 0.2, depth=4, bins=31, first=1.0), Growth(12, 0.3, leaves=9, least=5), Growth(12, 0.3, depth=3, penalty=3.0, symmetric=True)])
def test_trees_of_one_task_equal_those_of_many(spark, monkeypatch, g):
    """Steps of one task, of tasks whose sums are added at once, and of tasks that shuffle them."""
    x, y = table(300)
    made = []
    for near, few in ((boosting.NEAR, boosting.FEW), (0, 8), (0, 0)):
        monkeypatch.setattr(boosting, "NEAR", near)
        monkeypatch.setattr(boosting, "FEW", few)
        made.append(boosting.fit(frame(spark, x, y, 4), COLUMNS, g).trees)
    assert all(len(trees) == g.trees for trees in made)
    for trees in made[1:]:
        assert all(np.array_equal(a, b) for s, t in zip(made[0], trees, strict=True) for a, b in zip(s, t, strict=True))


def test_first_order_presets_equal_spark_ml(spark):
    """Columns of eight values have the same splits in both, so the trees' predictions of train rows are equal."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from tickloom.operators import models

    rng = np.random.default_rng(5)
    x = rng.integers(0, 8, (500, 3)).astype(float)
    data = frame(spark, x, x[:, 0] * (x[:, 1] > 3) + rng.normal(size=500)).withColumn("id", F.monotonically_increasing_id()).cache()
    for name, (_, rate, depth) in models.BOOSTED.items():
        vectors = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(data)
        want = GBTRegressor(labelCol="target", maxIter=6, stepSize=rate, maxDepth=depth, seed=1).fit(vectors).transform(vectors).select("id", F.col("prediction").alias("want"))
        found = boosting.predict(data, boosting.fit(data, COLUMNS, models.growth(name, 6)), ["id"])
        assert found.join(want, "id").agg(F.max(F.abs(F.col("prediction") - F.col("want")))).first()[0] < 1e-9


def test_presets_of_two_hundred_trees_run_in_few_jobs(spark):
    """Thousands of jobs before: three of each level of each tree."""
    from tickloom.operators import models

    x, y = table(200)
    rows = frame(spark, x, y)
    spark.sparkContext.setJobGroup("presets", "")
    try:
        for name in ("boosting_deep", "boosting_leafwise", "boosting_symmetric"):
            assert len(boosting.fit(rows, COLUMNS, models.growth(name)).trees) == 200
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("presets")) < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_edges_of_small_tables_are_the_same_for_any_partitions(spark):
    x = np.random.default_rng(8).normal(size=(3000, 3))
    made = [boosting.fit(frame(spark, x, x[:, 0], n), COLUMNS, Growth(1, 0.1, depth=2, bins=31)) for n in (1, 7)]
    assert all(np.array_equal(a, b) for a, b in zip(made[0].edges, made[1].edges, strict=True))
