"""Small models on grouped rows: standardising, sufficient statistics, a sparse linear scorer, a recurrent scorer.

Rows stay in Spark; what reaches the driver are sums whose number depends on
the features, not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the sparse fit.
ALPHAS = np.geomspace(0.3, 1e-5, 24)
SWEEPS, STOP, LEAST_NONZERO, TOP, FOLDS, CUT = 3000, 1e-7, 5, 5, 5, 0.5


def impute_standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """Each feature with its median in place of nulls, less its mean, over its population deviation (1 if that is next to 0): z_<feature>."""
    med = df.agg(*[F.median(f).alias(f"_m_{f}") for f in features])
    filled = df.crossJoin(F.broadcast(med)).withColumns({f"_f_{f}": F.coalesce(F.col(f).cast("double"), F.col(f"_m_{f}")) for f in features})
    stats = filled.agg(*[a for f in features for a in (F.avg(f"_f_{f}").alias(f"_a_{f}"), F.stddev_pop(f"_f_{f}").alias(f"_s_{f}"))])
    z = filled.crossJoin(F.broadcast(stats))
    out = z.withColumns({f"z_{f}": (F.col(f"_f_{f}") - F.col(f"_a_{f}")) / F.when(F.col(f"_s_{f}") <= 1e-12, 1.0).otherwise(F.col(f"_s_{f}")) for f in features})
    return out.select(*df.columns, *[f"z_{f}" for f in features])


def gram(df: DataFrame, features: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """by, n, i, j, value: sums of products of the features, the label (index len(features)) and 1 (the last index), i <= j."""
    by = by or []
    x = [*[F.col(f).cast("double") for f in features], F.col(label).cast("double"), F.lit(1.0)]
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    wide = df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(x[i] * x[j]).alias(f"_{i}_{j}") for i, j in cells])
    cell = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_{i}_{j}").alias("value")) for i, j in cells])
    return wide.select(*by, "n", F.inline(cell))


def lasso(g: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """Coordinate descent on (1/2) w'Gw - b'w + alpha |w|, G and b being means over rows of centred columns."""
    w = np.zeros(len(b))
    for _ in range(SWEEPS):
        most = 0.0
        for k in range(len(b)):
            if g[k, k] <= 0:
                continue
            r = b[k] - g[k] @ w + g[k, k] * w[k]
            new = np.sign(r) * max(abs(r) - alpha, 0.0) / g[k, k]
            most, w[k] = max(most, abs(new - w[k])), new
        if most < STOP:
            break
    return w


def folds(counts: DataFrame, run: str, n: str, most: int = FOLDS) -> DataFrame:
    """run, fold: runs by falling size, then name, each to the first of the smallest folds. The table has a row a run, which the driver packs."""
    rows = sorted(((-r[n], r[run]) for r in counts.select(run, n).collect()))
    sizes = [0] * min(most, len(rows))
    out = []
    for size, name in rows:
        k = sizes.index(min(sizes))
        sizes[k] -= size
        out.append((name, k))
    return counts.sparkSession.createDataFrame(out, f"{run} {counts.schema[run].dataType.simpleString()}, fold long")


def fit_sparse(df: DataFrame, features: list[str], label: str, run: str) -> dict:
    """A linear scorer of at most five features: alpha by grouped cross-validation, then refitted on the five largest coefficients.

    Folds differ by whole runs, and each has the medians and scales of its own
    training rows; the refitted model has those of all rows.
    Returns status, and with ``trained`` alpha, features, coefficients, bias,
    medians, mean and std.
    """
    stats = df.agg(F.count("*").alias("n"), F.sum(label).alias("pos"), F.countDistinct(run).alias("runs"), *[a for f in features for a in (F.median(f).alias(f"m_{f}"), F.count(f).alias(f"c_{f}"))]).first()
    use = [f for f in features if stats[f"c_{f}"] >= 2]
    n, pos = stats["n"], stats["pos"] or 0
    if n < 4 or pos < 2 or n - pos < 2 or stats["runs"] < 2 or len(use) < LEAST_NONZERO:
        return {"status": "collecting"}
    filled = df.select(run, label, *[F.coalesce(F.col(f).cast("double"), F.lit(float(stats[f"m_{f}"]))).alias(f) for f in use])
    scale = filled.agg(*[a for f in use for a in (F.avg(f).alias(f"a_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    mean = np.array([scale[f"a_{f}"] for f in use])
    std = np.array([scale[f"s_{f}"] if scale[f"s_{f}"] > 1e-12 else 1.0 for f in use])
    z = filled.select(run, label, *[((F.col(f) - float(m)) / float(s)).alias(f) for f, m, s in zip(use, mean, std, strict=True)])
    k = len(use)

    def squares(rows: DataFrame, by: list[str]) -> dict[tuple, np.ndarray]:
        out: dict[tuple, np.ndarray] = {}
        for r in gram(rows, use, label, by).collect():
            m = out.setdefault(tuple(r[c] for c in by), np.zeros((k + 2, k + 2)))
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["value"]
        return out

    total = squares(z, [])[()]
    # Every row once for each fold that may be held out; medians and scales are those of the rows that are not.
    fold = folds(df.groupBy(run).agg(F.count("*").alias("n")), run, "n")
    dealt = df.select(run, label, *[F.col(f).cast("double").alias(f) for f in use]).join(fold, run)
    dealt = dealt.withColumn("_out", F.explode(F.sequence(F.lit(0), F.lit(min(FOLDS, stats["runs"]) - 1)))).withColumn("_held", F.col("_out") == F.col("fold"))
    middle = dealt.where("NOT _held").groupBy("_out").agg(*[F.median(f).alias(f"_m_{f}") for f in use])
    dealt = dealt.join(F.broadcast(middle), "_out").withColumns({f: F.coalesce(f, f"_m_{f}", F.lit(0.0)) for f in use})
    spread = dealt.where("NOT _held").groupBy("_out").agg(*[x for f in use for x in (F.avg(f).alias(f"_a_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))])
    dealt = dealt.join(F.broadcast(spread), "_out").withColumns({f: (F.col(f) - F.col(f"_a_{f}")) / F.when(F.col(f"_s_{f}") > 1e-12, F.col(f"_s_{f}")).otherwise(1.0) for f in use})
    parts = squares(dealt, ["_out", "_held"])

    def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, mu = m[-1, -1], m[:-1, -1] / m[-1, -1]
        c = m[:-1, :-1] / rows - np.outer(mu, mu)
        return c[:-1, :-1], c[:-1, -1], mu

    g, b, mu = centred(total)
    best = None
    for alpha in ALPHAS:
        if (np.abs(lasso(g, b, alpha)) > 1e-7).sum() < LEAST_NONZERO:
            continue
        errors = []
        for out in sorted({o for o, _ in parts}):
            part = parts[out, True]
            tg, tb, tmu = centred(parts[out, False])
            w = lasso(tg, tb, alpha)
            bias = tmu[-1] - w @ tmu[:-1]
            v = np.append(w, [-1.0, bias])
            errors.append(v @ part @ v / part[-1, -1])
        key = (float(np.mean(errors)), -alpha)
        best = min(best, key) if best else key
    if best is None:
        return {"status": "collecting"}
    alpha = -best[1]
    w = lasso(g, b, alpha)
    top = sorted(sorted(range(k), key=lambda i: (-abs(w[i]), i))[:TOP])
    again = lasso(g[np.ix_(top, top)], b[top], alpha)
    names = [use[i] for i in top]
    return {
        "status": "trained", "alpha": float(alpha), "features": names, "coefficients": again.tolist(), "bias": float(mu[-1] - again @ mu[:-1][top]),
        "medians": [float(stats[f"m_{f}"]) for f in names], "mean": mean[top].tolist(), "std": std[top].tolist(), "ranking": {use[i]: float(w[i]) for i in range(k)},
    }


def linear_score(model: dict) -> dict[str, Column]:
    """Columns of a linear model: contribution_<feature>, score, predicted. Missing features count as the median."""
    out, total = {}, F.lit(float(model["bias"]))
    for f, w, med, m, s in zip(model["features"], model["coefficients"], model["medians"], model["mean"], model["std"], strict=True):
        c = (F.coalesce(F.col(f).cast("double"), F.lit(float(med))) - float(m)) / float(s) * float(w)
        out[f"contribution_{f}"] = c
        total = total + c
    return out | {"score": total, "predicted": (total >= CUT).cast("int")}


class Recurrent:
    """A one-layer LSTM with a linear output, in NumPy: forward over batches of sequences, training by backpropagation and Adam."""

    def __init__(self, inputs: int, hidden: int = 32, seed: int = 42):
        r = np.random.default_rng(seed)
        a = 1 / np.sqrt(hidden)
        self.p = {"w": r.uniform(-a, a, (4 * hidden, inputs)), "u": r.uniform(-a, a, (4 * hidden, hidden)), "b": r.uniform(-a, a, 4 * hidden), "o": r.uniform(-a, a, hidden), "c": np.zeros(1)}
        self.hidden = hidden

    @staticmethod
    def _sig(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Probabilities of sequences (rows, steps, inputs), and what training needs of each step."""
        n, h = len(x), self.hidden
        s, c, kept = np.zeros((n, h)), np.zeros((n, h)), []
        for t in range(x.shape[1]):
            g = x[:, t] @ self.p["w"].T + s @ self.p["u"].T + self.p["b"]
            i, f, a, o = self._sig(g[:, :h]), self._sig(g[:, h : 2 * h]), np.tanh(g[:, 2 * h : 3 * h]), self._sig(g[:, 3 * h :])
            c0, s0 = c, s
            c = f * c + i * a
            s = o * np.tanh(c)
            kept.append((i, f, a, o, c0, c, s0))
        return self._sig(s @ self.p["o"] + self.p["c"]), [*kept, s]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: float) -> tuple[float, dict]:
        p, kept = self.forward(x)
        last = kept.pop()
        q = np.clip(p, 1e-12, 1 - 1e-12)
        loss = float(-(weight * y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
        d = (p * (weight * y + 1 - y) - weight * y) / len(x)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"], g["c"] = last.T @ d, np.array([d.sum()])
        ds, dc = np.outer(d, self.p["o"]), np.zeros_like(last)
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, a, o, c0, c, s0 = kept[t]
            th = np.tanh(c)
            dc = dc + ds * o * (1 - th**2)
            dg = np.hstack([dc * a * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - a**2), ds * th * o * (1 - o)])
            g["w"] += dg.T @ x[:, t]
            g["u"] += dg.T @ s0
            g["b"] += dg.sum(0)
            ds, dc = dg @ self.p["u"], dc * f
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 16, rate: float = 1e-3, decay: float = 1e-3, seed: int = 42) -> list[float]:
        r, losses = np.random.default_rng(seed), []
        weight = float((y == 0).sum() / max(1, (y == 1).sum()))
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            total = 0.0
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                loss, g = self.gradients(x[rows], y[rows], weight)
                norm = np.sqrt(sum((a**2).sum() for a in g.values()))
                step, total = step + 1, total + loss * len(rows)
                for k in self.p:
                    a = g[k] * min(1.0, 1.0 / max(norm, 1e-12)) + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.999 * v[k] + 0.001 * a**2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / len(x))
        return losses


def lstm_probability(sequences: DataFrame, keys: list[str], column: str, model: Recurrent) -> DataFrame:
    """keys, probability of each sequence (array of values a step); missing values count as 0, the standardised mean."""
    shared = sequences.sparkSession.sparkContext.broadcast((model.p, model.hidden))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p, hidden = shared.value
        net = Recurrent(p["w"].shape[1], hidden)
        net.p = p
        for b in batches:
            by = b[column].map(len)
            for _, g in b.groupby(by, sort=False):
                x = np.nan_to_num(np.array(g[column].to_list(), float))
                x = x[..., None] if x.ndim == 2 else x
                yield g[keys].assign(probability=net.forward(x)[0])

    kinds = ", ".join(f"{k} {sequences.schema[k].dataType.simpleString()}" for k in keys)
    return sequences.select(*keys, column).mapInPandas(run, f"{kinds}, probability double")


def cohort(runs: DataFrame, reviewed: str, name: str, size: int = 15) -> DataFrame:
    """name, place of the first ``size`` fully reviewed runs by name."""
    first = runs.where(reviewed).orderBy(name).limit(size)
    return first.select(name, F.row_number().over(Window.orderBy(name)).cast("long").alias("place"))
