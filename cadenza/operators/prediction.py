"""Scores of tracks by saved models, many versions in one pass.

Models are rows: one for each feature of a version, and one for each version's
temporal model. Every run says which version it is scored with, so runs of all
versions are one join and one aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.learning import CUT, Recurrent

MODELS = "fingerprint string, bias double, rank int, feature string, coefficient double, median double, mean double, std double"
TEMPORAL = "fingerprint string, inputs int, hidden int, weights array<double>"


def linear(values: DataFrame, versions: DataFrame, models: DataFrame) -> DataFrame:
    """run, track, fingerprint, score, label, predictors of every track (run, track, values map) by its run's version (run, fingerprint).

    A feature that a track lacks, or has as a number that isn't finite, counts
    as the model's median. predictors: array<struct<rank, feature, raw,
    standardized, contribution, direction>> by rank. A run whose version isn't
    among the models has no rows; a deviation of 0 counts as 1.
    """
    m = models.select("fingerprint", "bias", F.struct("rank", "feature", "coefficient", "median", "mean", "std").alias("f")).groupBy("fingerprint").agg(F.first("bias").alias("bias"), F.array_sort(F.collect_list("f")).alias("fs"))
    j = values.join(versions, "run").join(m, "fingerprint")

    def one(f):
        x = F.try_element_at("values", f["feature"])
        raw = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        z = (F.coalesce(raw, f["median"]) - f["mean"]) / F.when(f["std"] == 0, 1.0).otherwise(f["std"])
        return F.struct(
            f["rank"].alias("rank"), f["feature"].alias("feature"), raw.alias("raw"), z.alias("standardized"), (z * f["coefficient"]).alias("contribution"),
            F.when(f["coefficient"] >= 0, "more").otherwise("less").alias("direction"),
        )

    j = j.withColumn("predictors", F.transform("fs", one))
    score = F.col("bias") + F.aggregate("predictors", F.lit(0.0), lambda s, p: s + p["contribution"])
    return j.withColumn("score", score).select("run", "track", "fingerprint", "score", (F.col("score") >= CUT).cast("int").alias("label"), "predictors")


def temporal(sequences: DataFrame, versions: DataFrame, models: DataFrame) -> DataFrame:
    """run, track, probability of every sequence (run, track, xs array<array<double>>, a step each) by its run's temporal model.

    A version without a temporal model gives no row; so does a sequence whose
    steps haven't as many values as the model has inputs. Nulls are 0, the
    standardised mean. The weights travel with a version's sequences, which
    are scored in batches.
    """
    j = sequences.join(versions, "run").join(models, "fingerprint").where(F.forall("xs", lambda s: F.size(s) == F.col("inputs")) & (F.size("xs") > 0))
    kind = {c: sequences.schema[c].dataType.simpleString() for c in ("run", "track")}

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        net = Recurrent(int(first["inputs"]), int(first["hidden"]))
        net.p = unpacked(np.asarray(first["weights"], float), net.p)
        out = np.empty(len(pdf))
        steps = pdf["xs"].map(len).to_numpy()
        for n in np.unique(steps):
            at = np.flatnonzero(steps == n)
            x = np.array([[[np.nan if v is None else v for v in s] for s in pdf["xs"].iloc[i]] for i in at], float)
            out[at] = net.forward(np.nan_to_num(x))[0]
        return pdf[["run", "track"]].assign(probability=out)

    part = F.pmod(F.xxhash64("run", "track"), F.lit(256))  # one version may have most of the sequences
    return j.withColumn("_p", part).groupBy("fingerprint", "_p").applyInPandas(score, f"run {kind['run']}, track {kind['track']}, probability double")


def predict(values: DataFrame, versions: DataFrame, models: DataFrame, sequences: DataFrame | None = None, temporal_models: DataFrame | None = None) -> DataFrame:
    """Every track's prediction: by its sequence where there is one, else by the linear score.

    run, track, fingerprint, predicted, probability, score, linear_label, method, predictors.
    """
    out = linear(values, versions, models)
    if sequences is None:
        p = out.withColumn("probability", F.lit(None).cast("double"))
    else:
        p = out.join(temporal(sequences, versions, temporal_models), ["run", "track"], "left")
    by_sequence = F.col("probability").isNotNull()
    return p.select(
        "run", "track", "fingerprint", F.when(by_sequence, (F.col("probability") >= CUT).cast("int")).otherwise(F.col("label")).alias("predicted"), "probability", "score", F.col("label").alias("linear_label"),
        F.when(by_sequence, "sequence").otherwise("linear").alias("method"), "predictors",
    )


NAMES = ("w", "u", "b", "o", "c")


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    """A network's weights as one vector."""
    return np.concatenate([p[k].ravel() for k in NAMES])


def unpacked(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in NAMES:
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def train_temporal(examples: DataFrame, inputs: int, hidden: int = 32, epochs: int = 60, rate: float = 1e-2, decay: float = 1e-3, seed: int = 42) -> tuple[np.ndarray, list[float]]:
    """Weights and the loss of each epoch of a network trained on all examples (xs array<array<double>>, label 0 or 1).

    Each epoch is one pass: tasks sum the gradients of their examples, Spark
    sums the tasks' per weight, and the driver, which has a number for each
    weight only, takes one step of Adam. So the result is the same, but for
    rounding, however the examples are dealt. Positive examples weigh as much
    as negative ones in all. Examples whose steps haven't ``inputs`` values
    don't count. Without examples of both labels there is nothing to learn: an error.
    """
    spark = examples.sparkSession
    usable = examples.where(F.forall("xs", lambda s: F.size(s) == inputs) & (F.size("xs") > 0) & F.col("label").isin(0, 1)).select("xs", F.col("label").cast("int").alias("label"))
    from cadenza.plans.scratch import Scratch

    data = Scratch(spark, "lstm").save(usable)
    count = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(count) != {0, 1}:
        raise ValueError("examples of both labels are needed")
    net, total, weight = Recurrent(inputs, hidden, seed), sum(count.values()), count[0] / count[1]
    theta, m, v, losses = packed(net.p), 0.0, 0.0, []
    for step in range(1, epochs + 1):
        shared = spark.sparkContext.broadcast(theta)

        def gradients(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            net = Recurrent(inputs, hidden)
            net.p = unpacked(shared.value, net.p)
            sums = np.zeros(len(shared.value) + 1)
            for b in batches:
                steps = b["xs"].map(len).to_numpy()
                for n in np.unique(steps):
                    at = np.flatnonzero(steps == n)
                    x = np.nan_to_num(np.array([[[np.nan if q is None else q for q in s] for s in b["xs"].iloc[i]] for i in at], float))
                    loss, g = net.gradients(x, b["label"].to_numpy()[at].astype(float), weight)
                    sums += np.append(packed(g), loss) * len(at)
            yield pd.DataFrame({"i": np.arange(len(sums)), "g": sums})

        rows = data.mapInPandas(gradients, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas()  # a row a weight
        g = rows.sort_values("i")["g"].to_numpy() / total
        losses.append(float(g[-1]))
        g = g[:-1] * min(1.0, 1.0 / max(float(np.sqrt((g[:-1] ** 2).sum())), 1e-12)) + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        shared.unpersist()
    return theta, losses


def temporal_model(spark, fingerprint: str, theta: np.ndarray, inputs: int, hidden: int) -> DataFrame:
    """A trained network as a row of the temporal models."""
    return spark.createDataFrame([(fingerprint, inputs, hidden, [float(x) for x in theta])], TEMPORAL)
