"""Places of learned policies against a plain sort: equal scores, and hashes that go through the shuffle as bytes."""

import hashlib
import random

from tidemark.operators import uplift


def test_places_as_sorted_and_hashes_shuffled_as_bytes(spark):
    sha, rnd = lambda x: hashlib.sha256(x.encode()).hexdigest(), random.Random(4)
    rows = [(sha(f"r{k}"), sha(f"t{k % 400}"), k % 2, k % 3 % 2, rnd.choice([0.5, 0.25, rnd.random()])) for k in range(1000)]
    scores = spark.createDataFrame(rows, "row_id string, tie string, treatment int, conversion int, response double").persist()
    placed = uplift.policy_places(scores, {"random": None, "response": "response"})
    assert placed.dtypes == [("policy", "string"), ("row_id", "string"), ("treatment", "int"), ("conversion", "int"), ("place", "bigint")]
    got = {(r.policy, r.row_id): (r.place, r.treatment, r.conversion) for r in placed.collect()}
    # Hashes of ties repeat, so that ids decide.
    for policy, score in (("random", lambda r: 0.0), ("response", lambda r: -r[4])):
        want = sorted(rows, key=lambda r, score=score: (score(r), r[1], r[0]))
        assert all(got[policy, r[0]] == (k, r[2], r[3]) for k, r in enumerate(want, 1))
    assert len(got) == 2000
    windows = [x for x in placed._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [" in x]
    assert windows and not any("tie#" in x or "row_id#" in x for x in windows)
