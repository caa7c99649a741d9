"""Fits by one task against fits by passes: the same trees and losses, with few jobs; only the roles that a query needs."""

import numpy as np
import pytest

from tidemark.operators import boosting as bo
from tidemark.operators import models
from tidemark.plans import registry, targeting_queries
from tidemark.sources import scratch

FEATURES = ["f0", "f1", "f2", "f3"]
SMALL = bo.Settings(rounds=9, leaves=7, leaf_rows=10, bins=12)


def frame(spark, n=1200, seed=5):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 3, n), rng.integers(0, 40, n), rng.integers(0, 2, n), rng.integers(0, 9, n)], axis=1).astype(float)
    arm = rng.random(n) < 0.7
    y = rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 1 + (x[:, 1] - 20) / 15 * arm)))
    rows = [(f"r{k}", *map(float, x[k]), int(arm[k]), int(y[k]), bool(rng.random() < 0.2)) for k in range(n)]
    # Copies of some rows, so that blocks count some combinations more than once.
    return spark.createDataFrame(rows + rows[:300], "row_id string, f0 double, f1 double, f2 double, f3 double, treatment int, conversion int, early_stop boolean").repartition(3)


@pytest.fixture(scope="module")
def table(spark):
    df = frame(spark)
    cuts = bo.cut_points(df, FEATURES, SMALL.bins)
    return df, cuts, bo.written(bo.blocks(df, FEATURES, cuts), "blocks")


@pytest.mark.parametrize("role", models.ROLES)
def test_one_task_grows_the_trees_of_the_passes(table, monkeypatch, role):
    _, cuts, blocks = table
    monkeypatch.setattr(bo, "CHUNK", 64)
    passes, level = [], bo.level
    monkeypatch.setattr(bo, "level", lambda *a: (passes.append(1), level(*a))[1])
    # With groups of features from 16 rows on, and without.
    for cells in (16, 4096):
        monkeypatch.setattr(bo, "CELLS", cells)
        passes.clear()
        held = bo.fit(blocks, FEATURES, cuts, role, SMALL)
        assert len(passes) == 1, "one job counts the rows, another one fits"
    monkeypatch.setattr(bo, "HELD", 0)
    passed = bo.fit(blocks, FEATURES, cuts, role, SMALL)
    assert len(passes) > SMALL.rounds
    assert held.trees == passed.trees and held.losses == passed.losses and held.base == passed.base
    assert any(len(t.feature) > 3 for t in held.trees)


def test_joint_groups_have_room_and_hold_every_feature():
    sizes = [50, 63, 11, 9, 7, 63, 63, 7, 12, 7, 63, 63, 2]
    groups = bo._joint(sizes)
    assert sorted(f for g in groups for f in g) == list(range(len(sizes)))
    assert max(np.prod([sizes[f] for f in g]) for g in groups) <= bo.CELLS and len(groups) < 7


def test_leaves_of_a_tree_by_walking_it():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 20, (3, 500)).astype(np.uint8)
    tree = bo.Tree([1, 0, -1, 2, -1, -1, -1], [9, 4, 0, 15, 0, 0, 0], [1, 3, 0, 5, 0, 0, 0], [2, 4, 0, 6, 0, 0, 0], [0, 0, 1.5, 0, 2.5, 3.5, 4.5], [0] * 7, [0] * 7)

    def walk(row):
        k = 0
        while tree.feature[k] >= 0:
            k = tree.left[k] if row[tree.feature[k]] <= tree.bin[k] else tree.right[k]
        return k

    want = [walk(row) for row in bins.T]
    assert tree.leaf_of(bins).tolist() == want and set(want) == {2, 4, 5, 6}
    margin = np.ones(500)
    tree.add(bins, margin)
    assert margin.tolist() == [1 + tree.value[k] for k in want]


def test_scores_are_those_of_each_model_alone(table):
    df, cuts, blocks = table
    fitted = models.learn(blocks, cuts, tuple(FEATURES), SMALL)
    assert list(fitted) == list(models.ROLES)
    got = {r.row_id: r for r in models.score(fitted, df.distinct()).collect()}
    for name, role, arm in (("response", "response", None), ("s1", "s", 1), ("s0", "s", 0), ("t1", "t1", None), ("t0", "t0", None)):
        want = bo.predict(fitted[role], df.distinct(), "p", arm).collect()
        assert len(want) == len(got) == 1200 and all(got[r.row_id][name] == r.p for r in want)
    assert all(r.s_uplift == r.s1 - r.s0 and r.t_uplift == r.t1 - r.t0 for r in got.values())
    alone = models.score({"s": fitted["s"]}, df.distinct())
    assert alone.columns[-3:] == ["s1", "s0", "s_uplift"] and "response" not in alone.columns


@pytest.mark.parametrize(("name", "roles"), [("fit_response", ["response"]), ("fit_s_learner", ["s"]), ("fit_t_learner", ["t1", "t0"]), ("predict_conditions", ["s"])])
def test_only_the_roles_of_a_query_are_fitted(spark, sample, monkeypatch, name, roles):
    fit, asked = bo.fit, []
    monkeypatch.setattr(scratch, "_once", {})
    monkeypatch.setattr(bo, "fit", lambda table, features, cuts, role, settings: (asked.append(role), fit(table, features, cuts, role, bo.Settings(rounds=1)))[1])
    assert registry.QUERIES[name](spark, sample).count() > 0
    assert sorted(asked) == sorted(roles)
    targeting_queries._scores(spark, sample)
    assert sorted(asked) == sorted(models.ROLES)
