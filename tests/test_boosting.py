"""Boosting by aggregates against plain NumPy on whole arrays; stopping, roles, blocks and trees as rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as bo

FEATURES = ["f0", "f1", "f2"]
SMALL = bo.Settings(rounds=12, leaves=6, leaf_rows=15, bins=16)


def frame(spark, n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 8, n).astype(float), rng.normal(size=n), rng.random(n)], axis=1)
    arm = rng.random(n) < 0.6
    y = rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] / 3 - 1.5 + x[:, 1] * arm)))
    rows = [(f"r{k}", *map(float, x[k]), int(arm[k]), int(y[k]), bool(k % 5 == 0)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "row_id string, f0 double, f1 double, f2 double, treatment int, conversion int, early_stop boolean").repartition(3)


def plain_tree(bins, g, h, s):
    """Best-first tree on arrays, from the definition."""
    gain = lambda a, b: a * a / (b + s.l2)

    def split(at):
        best = None
        for f in range(bins.shape[1]):
            for b in np.unique(bins[at, f])[:-1]:
                left = at[bins[at, f] <= b]
                right = at[bins[at, f] > b]
                if min(len(left), len(right)) < s.leaf_rows or min(h[left].sum(), h[right].sum()) < s.least_hessian:
                    continue
                v = gain(g[left].sum(), h[left].sum()) + gain(g[right].sum(), h[right].sum()) - gain(g[at].sum(), h[at].sum())
                if v > 0 and (best is None or v > best[0] + 1e-12):
                    best = (v, f, b, left, right)
        return best

    leaves = [np.arange(len(bins))]
    splits = [split(leaves[0])]
    while len(leaves) < s.leaves and any(splits):
        k = max((k for k in range(len(leaves)) if splits[k]), key=lambda k: splits[k][0])
        _, _, _, left, right = splits[k]
        leaves[k : k + 1], splits[k : k + 1] = [left, right], [split(left), split(right)]
    return leaves, [-s.step * g[at].sum() / (h[at].sum() + s.l2) for at in leaves]


def plain_margins(bins, y, s, rounds):
    base = math.log(y.sum() / (len(y) - y.sum()))
    margin = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        for at, value in zip(*plain_tree(bins, p - y, p * (1 - p), s), strict=True):
            margin[at] += value
    return margin


@pytest.mark.parametrize("role", ["response", "s", "t1"])
def test_equal_to_numpy(spark, role, monkeypatch):
    monkeypatch.setattr(bo, "DIRECT", {"response": 16, "s": 0, "t1": 0}[role])
    monkeypatch.setattr(bo, "BLOCK", 100)
    monkeypatch.setattr(bo, "REBASE", 3)
    rows, df = frame(spark)
    cuts = bo.cut_points(df, FEATURES, SMALL.bins)
    model = bo.fit(bo.written(bo.blocks(df, FEATURES, cuts), "blocks"), FEATURES, cuts, role, bo.Settings(**{**SMALL.__dict__, "rounds": 8}))
    assert len(model.trees) == 8 and len(model.losses) == 9
    chosen = [r for r in rows if role != "t1" or r[4] == 1]
    columns = [np.array([r[1 + k] for r in chosen]) for k in range(3)] + ([np.array([float(r[4]) for r in chosen])] if role == "s" else [])
    y, early = np.array([r[5] for r in chosen]), np.array([r[6] for r in chosen])
    bins = model.binned(columns)
    margin = plain_margins(bins[~early], y[~early], SMALL, 8)
    got = model.probability([c[~early] for c in columns])
    assert np.abs(got - 1 / (1 + np.exp(-margin))).max() < 1e-9
    p = model.probability([c[early] for c in columns])
    assert model.losses[-1] == pytest.approx(-np.mean(np.where(y[early] == 1, np.log(p), np.log(1 - p))), abs=1e-9)


def test_trees_as_rows_and_predictions(spark):
    rows, df = frame(spark, 600, 2)
    cuts = bo.cut_points(df, FEATURES, SMALL.bins)
    table = bo.written(bo.blocks(df, FEATURES, cuts), "blocks")
    model = bo.fit(table, FEATURES, cuts, "s", SMALL)
    told = spark.createDataFrame(bo.tree_rows(model), bo.TREE_SCHEMA).repartition(5).collect()
    again = bo.trees_of([tuple(r) for r in told], model.features, model.cuts, model.base, model.losses)
    assert again.trees == model.trees
    # Leaves hold all fitted rows, each at least as many as asked.
    for t in model.trees:
        leaves = [n for n, f in zip(t.rows, t.feature, strict=True) if f < 0]
        assert sum(leaves) == sum(not r[6] for r in rows) and min(leaves) >= SMALL.leaf_rows and len(leaves) <= SMALL.leaves
    both = bo.predict(model, bo.predict(model, df, "p1", 1), "p0", 0).collect()
    for arm, name in ((1, "p1"), (0, "p0")):
        want = model.probability([np.array([r[f] for r in both]) for f in FEATURES] + [np.full(len(both), float(arm))])
        assert [r[name] for r in both] == want.tolist()
    flipped = bo.predict(model, df.withColumn("treatment", 1 - F.col("treatment")), "p1", 1).collect()
    assert {r.row_id: r.p1 for r in flipped} == {r.row_id: r.p1 for r in both}
    # The order and layout of rows change no tree.
    other = bo.written(bo.blocks(df.orderBy("f2").coalesce(1), FEATURES, cuts), "blocks")
    assert bo.fit(other, FEATURES, cuts, "s", SMALL).trees == model.trees


def test_stop_needs_rounds_without_a_lower_loss(spark):
    falling = [1 - k / 1000 for k in range(30)]
    assert bo.stopped_after(falling) is None
    assert bo.stopped_after([*falling, *[0.98] * 9]) is None
    assert bo.stopped_after([*falling, *[0.98] * 10]) == 39
    assert bo.stopped_after([*falling, *[0.98] * 9, 0.97, *[0.98] * 10]) == 49
    assert bo.stopped_after([1.0]) is None
    rng = np.random.default_rng(0)
    rows = [(f"r{k}", float(rng.random()), int(rng.random() < 0.5), int(rng.random() < 0.3), k % 3 == 0) for k in range(600)]
    df = spark.createDataFrame(rows, "row_id string, f0 double, treatment int, conversion int, early_stop boolean")
    cuts = bo.cut_points(df, ["f0"], 8)
    settings = bo.Settings(rounds=60, leaf_rows=20, patience=3)
    model = bo.fit(bo.written(bo.blocks(df, ["f0"], cuts), "blocks"), ["f0"], cuts, "response", settings)
    assert len(model.trees) < 60 and bo.stopped_after(model.losses, 3) == len(model.trees)


def test_one_outcome_only_is_refused(spark):
    df = spark.createDataFrame([("a", 1.0, 0, 0, False), ("b", 2.0, 1, 1, True)], "row_id string, f0 double, treatment int, conversion int, early_stop boolean")
    with pytest.raises(ValueError, match="both outcomes"):
        bo.fit(bo.written(bo.blocks(df, ["f0"], [np.array([1.5])]), "blocks"), ["f0"], [np.array([1.5])])


def test_cut_points(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 5).alias("few"), (F.col("id") * 1.0).alias("many"), F.lit(3).alias("one"))
    few, many, one = bo.cut_points(df, ["few", "many", "one"], 10)
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5] and len(one) == 0
    assert many.tolist() == pytest.approx([99.9 * k for k in range(1, 10)])
    sampled = bo.cut_points(df, ["many"], 10, sample=300)[0]
    assert np.abs(sampled - many).max() < 80
