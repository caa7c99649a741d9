"""The learners on the tables: 150 rounds are asked for, trees obey their settings, evaluations agree with SQL over the stored scores."""

import duckdb
import numpy as np
import pytest

from tidemark.operators import boosting, models
from tidemark.plans import registry, targeting_queries
from tidemark.sources import scratch


def test_all_learners_have_150_rounds(spark, sample, monkeypatch):
    asked = []
    monkeypatch.setattr(scratch, "_once", {})
    monkeypatch.setattr(boosting, "fit", lambda table, features, cuts, role, settings: asked.append((role, settings, tuple(features))))
    targeting_queries._models(spark, sample)
    assert [r for r, *_ in asked] == list(models.ROLES)
    assert {s for _, s, _ in asked} == {boosting.Settings(rounds=150, step=0.05, leaves=15, bins=63, leaf_rows=200, l2=1.0, patience=10)}
    assert {f for *_, f in asked} == {tuple(f"f{k}" for k in range(12))}


def test_trees_obey_their_settings(spark, sample):
    for name, roles in (("fit_response", {"response"}), ("fit_s_learner", {"s"}), ("fit_t_learner", {"t1", "t0"})):
        rows = registry.QUERIES[name](spark, sample).collect()
        assert {r.role for r in rows} <= roles
        leaves = [r for r in rows if r.feature is None]
        assert all(r.rows >= 200 or r.node == 0 for r in leaves) and all((r.left is None) == (r.feature is None) for r in rows)
        assert all(r.gain > 0 for r in rows if r.feature is not None)
        per_tree = {}
        for r in leaves:
            per_tree[r.role, r.tree] = per_tree.get((r.role, r.tree), 0) + 1
        assert max(per_tree.values(), default=1) <= 15 and max((r.tree for r in rows), default=0) < 150
    for role, model in targeting_queries._models(spark, sample).items():
        stop = boosting.stopped_after(model.losses)
        assert (stop == len(model.trees) or (stop is None and len(model.trees) == 150)) and ("treatment" in model.features) == (role == "s")


@pytest.fixture(scope="module")
def stored(spark, sample, tmp_path_factory):
    """The score table, the fitted rates and a database over them."""
    path = str(tmp_path_factory.mktemp("scores") / "scores.parquet")
    targeting_queries._scores(spark, sample).toPandas().to_parquet(path)
    con = duckdb.connect()
    con.execute(f"create view scores as select * from '{path}'")
    con.execute("""create view long as
      select 'random' as policy, row_id, treatment, conversion, tie, 0.0 as score from scores union all select 'response', row_id, treatment, conversion, tie, response from scores
      union all select 's_learner', row_id, treatment, conversion, tie, s_uplift from scores union all select 't_learner', row_id, treatment, conversion, tie, t_uplift from scores""")
    con.execute("create table placed as select *, row_number() over (partition by policy order by score desc, tie, row_id) as place, count(*) over (partition by policy) as n from long")
    con.execute("""create table curve as select policy, percent, floor(percent * n / 100) as k, n, count(*) filter (treatment = 1 and place <= k) as n1, count(*) filter (treatment = 0 and place <= k) as n0,
      count(*) filter (treatment = 1 and conversion = 1 and place <= k) as y1, count(*) filter (treatment = 0 and conversion = 1 and place <= k) as y0
      from (select policy, percent, n, floor(percent * n / 100) as k, treatment, conversion, place from placed, range(101) r(percent)) group by all""")
    con.execute("create table qini as select *, k / n as share, case when k = 0 then 0 when n0 > 0 then y1 - y0 * n1 / n0 end as q from curve")
    return con


def same(got, want):
    assert len(got) == len(want) > 0
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert (x is None and y is None) or x == y or x == pytest.approx(y, abs=1e-9)


def test_places_of_learners(spark, sample, stored):
    rows = registry.QUERIES["learner_places"](spark, sample).select("policy", "row_id", "place").collect()
    same([tuple(r) for r in rows], stored.execute("select policy, row_id, place from placed").fetchall())


def test_curves_and_areas_of_learners(spark, sample, stored):
    rows = registry.QUERIES["learner_qini_curve"](spark, sample).collect()
    want = stored.execute("select policy, percent, n1, n0, y1, y0, q, (select q from qini o where o.policy = i.policy and percent = 100) * share from qini i").fetchall()
    same([(r.policy, r.percent, r.n1, r.n0, r.y1, r.y0, None if r.q is None else round(r.q, 9), None if r.reference is None else round(r.reference, 9)) for r in rows], [(*r[:6], *(None if x is None else round(float(x), 9) for x in r[6:])) for r in want])
    areas = {r.policy: r.area for r in registry.QUERIES["learner_qini_area"](spark, sample).collect()}
    by = {}
    for policy, percent, *_, q, line in want:
        by.setdefault(policy, {})[percent] = (q, line)
    share = {(p, c): s for p, c, s in stored.execute("select policy, percent, share from qini").fetchall()}
    for policy, points in by.items():
        gaps = [None if q is None else float(q) - float(line) for q, line in (points[c] for c in range(101))]
        if None in gaps:
            assert areas[policy] is None
        else:
            x = [float(share[policy, c]) for c in range(101)]
            assert areas[policy] == pytest.approx(float(np.trapezoid(gaps, x)), abs=1e-9)


def test_capacities_and_losses_of_learners(spark, sample, stored):
    rows = registry.QUERIES["learner_capacity"](spark, sample).collect()
    want = stored.execute("select policy, percent, cast(k as bigint), n1, n0, y1, y0, 10000 * share * (y1 / nullif(n1, 0) - y0 / nullif(n0, 0)) from qini where percent in (10, 20, 30, 50, 100)").fetchall()
    same([(r.policy, r.capacity, r.selected, r.n1, r.n0, r.y1, r.y0, r.gain and round(r.gain, 7)) for r in rows], [(*r[:7], r[7] and round(r[7], 7)) for r in want])
    rates = models.fit_rates(targeting_queries._train(spark, sample)).collect()[0]
    got = {(r.model, r.arm): r for r in registry.QUERIES["learner_logloss"](spark, sample).collect()}
    assert len(got) == 9
    for model, said in (("response", "response"), ("s_learner", "case when treatment = 1 then s1 else s0 end"), ("t_learner", "case when treatment = 1 then t1 else t0 end")):
        for arm, inside in (("all", "true"), ("0", "treatment = 0"), ("1", "treatment = 1")):
            loss = lambda p, inside=inside: stored.execute(f"select count(*), avg(-(conversion * ln({p}) + (1 - conversion) * ln(1 - ({p})))) from scores where {inside}").fetchone()
            r, (n, mean) = got[model, arm], loss(said)
            arms = loss(f"case when treatment = 1 then {rates.rate_1!r} else {rates.rate_0!r} end")[1]
            whole = loss(repr(rates.rate_all))[1]
            assert r.n == n and (r.loss, r.global_loss, r.arm_loss) == pytest.approx((mean, whole, arms), abs=1e-9)
            assert r.improvement == pytest.approx((whole if model == "response" else arms) - mean, abs=1e-9)
