"""Learners of response and uplift: boosted trees on all training rows, and their scores on others."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor, wait

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_where
from ..sources.scratch import written
from . import boosting
from .boosting import Model, Settings

FEATURES = tuple(f"f{k}" for k in range(12))
#: One classifier of all rows, one that knows the arm, one of each arm.
ROLES = ("response", "s", "t0", "t1")


def training_frame(rows: DataFrame) -> DataFrame:
    """Support of each part (fit, early stop) and arm: rows and labels of both kinds."""
    part = F.when(F.col("early_stop"), "early_stop").otherwise("fit")
    out = rows.groupBy(part.alias("part"), "treatment").agg(F.count("*").alias("n"), F.sum("conversion").cast("long").alias("positives"))
    return out.withColumn("supported", (F.col("positives") > 0) & (F.col("positives") < F.col("n")))


def binned(train: DataFrame, features: tuple[str, ...] = FEATURES, settings: Settings | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """The binned rows, one written table for all roles, and the cut points, which come from the fitted rows."""
    cuts = boosting.cut_points(train.where("not early_stop"), list(features), (settings or Settings()).bins)
    return written(boosting.blocks(train, list(features), cuts), "blocks"), cuts


def learn(table: DataFrame, cuts: list[np.ndarray], features: tuple[str, ...] = FEATURES, settings: Settings | None = None, roles: tuple[str, ...] = ROLES) -> dict[str, Model]:
    """A model of each role, from what `binned` gives; the roles are fitted side by side."""
    settings = settings or Settings()
    with ThreadPoolExecutor(len(roles)) as pool:
        told = {}
        for role in roles:
            told[role] = pool.submit(boosting.fit, table, list(features), cuts, role, settings)
            wait([told[role]], 0.1)  # jobs start in the order of roles
        return {role: x.result() for role, x in told.items()}


#: Scores by name: the role that gives them, and the arm that its model is asked about.
SCORES = {"response": ("response", None), "s1": ("s", 1), "s0": ("s", 0), "t1": ("t1", None), "t0": ("t0", None)}


def score(models: dict[str, Model], rows: DataFrame) -> DataFrame:
    """Adds what these models say: response, s1 and s0, t1 and t0 (probabilities under either arm), s_uplift and t_uplift.

    No observed arm or outcome is used.
    """
    names = [n for n, (role, _) in SCORES.items() if role in models]
    told = rows.sparkSession.sparkContext.broadcast([(n, models[SCORES[n][0]], SCORES[n][1]) for n in names])  # LEAVES nodes a round
    features = next(iter(models.values())).features
    features = [f for f in features if f != "treatment"]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def said(*columns: pd.Series) -> pd.DataFrame:
        x = [c.to_numpy() for c in columns]
        return pd.DataFrame({n: model.probability(x if arm is None else [*x, np.full(len(x[0]), float(arm))]) for n, model, arm in told.value})

    out = rows.withColumn("said_", said(*[F.col(f).cast("double") for f in features])).select(*rows.columns, "said_.*")
    for a in ("s", "t"):
        if f"{a}1" in names and f"{a}0" in names:
            out = out.withColumn(f"{a}_uplift", F.col(f"{a}1") - F.col(f"{a}0"))
    return out


def fit_rates(train: DataFrame) -> DataFrame:
    """rate_all, rate_1, rate_0 of the fitted rows: what a constant prediction would say."""
    rate = lambda c: F.avg(F.when(c, F.col("conversion")))
    fitted = train.where("not early_stop")
    return fitted.agg(rate(F.lit(True)).alias("rate_all"), rate(F.col("treatment") == 1).alias("rate_1"), rate(F.col("treatment") == 0).alias("rate_0"))


def losses(scores: DataFrame, rates: DataFrame) -> DataFrame:
    """model, arm (all, 0, 1): mean log loss of what each model said for the arm that was, and of the constants of the fitted rows."""
    treated = F.col("treatment") == 1
    said = {"response": F.col("response"), "s_learner": F.when(treated, F.col("s1")).otherwise(F.col("s0")), "t_learner": F.when(treated, F.col("t1")).otherwise(F.col("t0"))}
    told = scores.crossJoin(F.broadcast(rates))  # one row
    cells = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in said.items()])
    arms = F.array(F.lit("all"), F.col("treatment").cast("string"))
    long = told.select("conversion", "rate_all", F.when(treated, F.col("rate_1")).otherwise(F.col("rate_0")).alias("rate_arm"), F.explode(arms).alias("arm"), cells.alias("cells")).select("conversion", "rate_all", "rate_arm", "arm", F.explode("cells").alias("c")).select("*", "c.*")
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = lambda c: F.avg(-(F.col("conversion") * F.ln(clip(F.col(c))) + (1 - F.col("conversion")) * F.ln(1 - clip(F.col(c)))))
    out = long.groupBy("model", "arm").agg(F.count("*").alias("n"), F.sum("conversion").cast("long").alias("positives"), loss("p").alias("loss"), loss("rate_all").alias("global_loss"), loss("rate_arm").alias("arm_loss"))
    constant = F.when(F.col("model") == "response", F.col("global_loss")).otherwise(F.col("arm_loss"))
    return out.withColumn("improvement", constant - F.col("loss"))


def score_summary(scored: DataFrame, score: str) -> DataFrame:
    return scored.agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.min(score).alias("min"), F.max(score).alias("max"), count_where(F.col(score).isNull()).alias("nulls"))
