"""Exact top-k search by inner product over M-trees.

An inner product becomes a distance when every vector gets one more
coordinate that brings all of them to the same norm and the query's extra
coordinate is 0: the nearest vectors are those with the largest products.
The vectors are dealt evenly over cells, and each cell is an M-tree, stored
as a table of pages. A page's entries have a routing vector, a covering
radius and their distance to the page's own routing vector. A query walks a
cell's pages best first; stored distances to the parent rule entries out by
the triangle inequality before any distance to them is computed. The best of
all cells are then merged.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.plans.scratch import Scratch

PAGE = 256
FANOUT = 32
#: Vectors of a cell and queries of a block, about. With both fixed, a task's memory is too.
CELL_ROWS, BLOCK_ROWS = 8192, 1024
#: Distances are doubles: their squares are off by less than this part of the norms.
SLACK = 1e-9

PAGES = "cell int, dim int, page int, leaf boolean, ids array<long>, vectors array<double>, radii array<double>, parents array<double>, norm double"
_PAGES = pa.schema([("cell", pa.int32()), ("dim", pa.int32()), ("page", pa.int32()), ("leaf", pa.bool_()), ("ids", pa.list_(pa.int64())), ("vectors", pa.list_(pa.float64())), ("radii", pa.list_(pa.float64())), ("parents", pa.list_(pa.float64())), ("norm", pa.float64())])
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, x array<long>: floor(64 * component). Null vectors and ones with null or non-finite components are left out."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return v.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("x"))


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Between every row of points and every row of to."""
    square = (points**2).sum(1)[:, None] + (to**2).sum(1)[None] - 2 * points @ to.T
    return np.sqrt(np.maximum(square, 0.0))


def build(ids: np.ndarray, x: np.ndarray, size: int = PAGE) -> list[dict]:
    """The pages of one cell's tree over the rows of x; page 0 is the root."""
    norm = float((x * x).sum(1).max()) if len(x) else 0.0
    points = np.column_stack([x, np.sqrt(np.maximum(norm - (x * x).sum(1), 0.0))])
    pages: list[dict] = []
    rng = np.random.default_rng(0)

    def page(rows: np.ndarray, centre: np.ndarray) -> int:
        at = len(pages)
        pages.append({})
        if len(rows) <= size:
            pages[at] = {"leaf": True, "ids": ids[rows], "vectors": points[rows], "radii": np.zeros(len(rows)), "parents": distances(points[rows], centre[None])[:, 0]}
            return at
        chosen = rng.choice(rows, min(FANOUT, -(-len(rows) // size) + 1), replace=False)
        far = distances(points[rows], points[chosen])
        owner = far.argmin(1)
        groups = [(c, rows[owner == k], far[owner == k, k].max(initial=0.0)) for k, c in enumerate(chosen)]
        groups = [g for g in groups if len(g[1])]
        if len(groups) == 1:  # equal rows, or nearly: parts of them side by side
            groups = [(chosen[0], part, groups[0][2]) for part in np.array_split(rows, min(FANOUT, -(-len(rows) // size)))]
        made = [(page(g, points[c]), c, r) for c, g, r in groups]
        routing = points[[c for _, c, _ in made]]
        pages[at] = {"leaf": False, "ids": np.array([p for p, _, _ in made]), "vectors": routing, "radii": np.array([r for _, _, r in made]), "parents": distances(routing, centre[None])[:, 0]}
        return at

    if len(x):
        page(np.arange(len(x)), points.mean(0))
    return [p | {"page": k, "norm": norm} for k, p in enumerate(pages)]


def search(pages: list[dict], q: np.ndarray, own: np.ndarray, k: int, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (rows of q by k) of the largest products with each row of q, ties to smaller ids; a row's own id is left out.

    All queries walk the tree together: a page waits with the queries that may
    still need it and their distances to its routing vector, and the page with
    the smallest bound of any of them is next. Places without a result have
    the score -2**62 and the id 2**62.
    """
    score, found = np.full((len(q), k), -(1 << 62)), np.full((len(q), k), 1 << 62)
    if not pages or not len(q):
        return score, found
    norm, q2 = pages[0]["norm"], (q * q).sum(1)
    to = np.column_stack([q, np.zeros(len(q))])
    if max(norm, q2.max()) >= 2.0**61:
        raise OverflowError("inner products of these vectors may not fit 62 bits")
    whole = q.astype(np.int64)

    def reach(rows: np.ndarray) -> np.ndarray:
        """For each query the distance beyond which nothing counts."""
        worst = score[rows, -1]
        return np.where(worst == -(1 << 62), np.inf, np.sqrt(np.maximum(0.0, q2[rows] + norm - 2.0 * worst + SLACK * (q2[rows] + norm))) + SLACK)

    order = itertools.count()
    waiting = [(0.0, next(order), 0, np.arange(len(q)), None, None)]
    while waiting:
        _, _, at, rows, low, to_parent = heapq.heappop(waiting)
        p = pages[at]
        most = reach(rows)
        if low is not None:
            open_ = low <= most
            rows, most, to_parent = rows[open_], most[open_], to_parent[open_]
            if not len(rows):
                continue
            # Stored distances to the parent, before any new distance.
            needed = np.abs(to_parent[:, None] - p["parents"][None]) - p["radii"][None] <= most[:, None]
        else:
            needed = np.ones((len(rows), len(p["ids"])), bool)
        entries = needed.any(0)
        if counts is not None:
            counts["computed"] = counts.get("computed", 0) + int(needed.sum())
            counts["avoided"] = counts.get("avoided", 0) + int((~needed).sum())
        if not entries.any():
            continue
        ids, vectors, needed = p["ids"][entries], p["vectors"][entries], needed[:, entries]
        if p["leaf"]:
            # A product of doubles is off by less than ``off``; those that may count are computed again in integers.
            near = q[rows] @ vectors[:, :-1].T
            off = np.sqrt(q2[rows] * norm) * (len(vectors[0]) * 2.0**-50)
            i, j = np.nonzero(needed & (ids[None] != own[rows][:, None]) & (near >= (score[rows, -1] - off)[:, None]))
            new = np.full(near.shape, -(1 << 62))
            for lo in range(0, len(i), 1 << 16):
                a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                new[a, b] = (whole[rows[a]] * vectors[b, :-1].astype(np.int64)).sum(1)
            better = ((new > score[rows, -1:]) | ((new == score[rows, -1:]) & (ids[None] < found[rows, -1:]))).any(1)
            if better.any():
                r = rows[better]
                s = np.concatenate([score[r], new[better]], 1)
                i = np.concatenate([found[r], np.where(new[better] == -(1 << 62), 1 << 62, ids[None])], 1)
                best = np.lexsort((i, -s), axis=1)[:, :k]
                score[r], found[r] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
        else:
            d = distances(to[rows], vectors)
            bound = np.where(needed, np.maximum(0.0, d - p["radii"][entries][None]), np.inf)
            for c, child in enumerate(ids.tolist()):
                use = bound[:, c] <= most
                if use.any():
                    heapq.heappush(waiting, (float(bound[use, c].min()), next(order), child, rows[use], bound[use, c], d[use, c]))
    return score, found


def _matrix(x: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(x.combine_chunks().flatten() if isinstance(x, pa.ChunkedArray) else x.flatten(), float)
    return flat.reshape(-1, dim) if dim else np.zeros((len(x), 0))


def index(vectors: DataFrame, cells: int) -> DataFrame:
    """The pages of all cells' trees. Rows are dealt to cells by a hash of their id and vector; equal rows are kept."""

    def make(key: tuple, table: pa.Table) -> pa.Table:
        cell, dim = (k.as_py() for k in key)
        pages = build(np.asarray(table["vec_id"]), _matrix(table["x"], dim))
        rows = [{"cell": cell, "dim": dim, "page": p["page"], "leaf": p["leaf"], "ids": p["ids"].tolist(), "vectors": p["vectors"].ravel().tolist(), "radii": p["radii"].tolist(), "parents": p["parents"].tolist(), "norm": p["norm"]} for p in pages]
        return pa.Table.from_pylist(rows, _PAGES)

    v = vectors.withColumn("cell", F.pmod(F.xxhash64("vec_id", "x"), F.lit(cells)).cast("int")).withColumn("dim", F.size("x"))
    return v.groupBy("cell", "dim").applyInArrow(make, PAGES)


def top_k(pages: DataFrame, queries: DataFrame, k: int, cells: int, blocks: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all cells. queries: vec_id, x.

    A task has one cell and one block of queries. Rows of another length than
    the query's are not compared with it. A query is not its own result; with
    fewer than k others it has all of them, and with none no row. A query that
    stands in several rows is searched once for each and counted once.
    """

    def run(key: tuple, tree: pa.Table, asked: pa.Table) -> pa.Table:
        dim = key[2].as_py()
        out = [np.zeros(0, np.int64)] * 3
        if tree.num_rows and asked.num_rows:
            tree = tree.sort_by("page").combine_chunks()
            cut = np.concatenate([[0], np.cumsum([len(x) for x in tree["ids"]])])
            flat = {c: np.asarray(pa.concat_arrays([x.values for x in tree[c]])) for c in ("ids", "vectors", "radii", "parents")}
            flat["vectors"] = flat["vectors"].reshape(cut[-1], dim + 1)
            stored = [{"leaf": leaf, "norm": norm} | {c: v[a:b] for c, v in flat.items()} for leaf, norm, a, b in zip(tree["leaf"].to_pylist(), tree["norm"].to_pylist(), cut[:-1], cut[1:], strict=True)]
            own = np.asarray(asked["vec_id"])
            score, ids = search(stored, _matrix(asked["x"], dim), own, k)
            there = ids != 1 << 62
            out = [np.repeat(own, there.sum(1)), ids[there], score[there]]
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    tree = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.dropDuplicates(["vec_id", "x"]).withColumn("dim", F.size("x")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    found = tree.groupBy("cell", "block", "dim").cogroup(asked.groupBy("cell", "block", "dim")).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_top_k(spark, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector with all others."""
    v = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    queries = v.where(F.col("vec_id") % 20 == 0)
    n = v.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % 20 == 0).alias("q")).first()
    cells, blocks = max(1, -(-n["n"] // CELL_ROWS)), max(1, -(-n["q"] // BLOCK_ROWS))
    pages = Scratch(spark, "m-tree").save(index(v, cells))
    return top_k(pages, queries, 20, cells, blocks)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
