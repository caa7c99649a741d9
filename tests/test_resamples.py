"""The registered intervals rest on as many resamples as the reference has."""

from tidemark.operators import pricing, targeting
from tidemark.plans import registry


def test_a_thousand_resamples(spark, sample, monkeypatch):
    asked = []
    for module, name in ((targeting, "joint_bootstrap"), (pricing, "cluster_bootstrap")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda rows, n, seed, real=real: asked.append(n) or real(rows, n, seed))
    assert registry.QUERIES["joint_bootstrap"](spark, sample).count() > 0
    assert registry.QUERIES["price_cluster_bootstrap"](spark, sample).count() > 0
    assert asked == [1000, 1000]
