"""Nearest neighbours by cosine through low-dimensional stable projections.

Unit vectors are projected with a Gaussian matrix, so the squared projected
distance of two points over their squared distance follows a chi-square law with
``DIMS`` degrees of freedom.  A kd-tree over projections yields the leaves nearest
to a query first; their vectors are verified at full precision, and the search
stops once a point closer than the present k-th best would lie beyond the next
leaf only with a small probability.

A shallow kd-tree, fitted on a bounded sample, cuts the space into cells that
spread over tasks; a crowded cell is split by id.  A query first searches its own
cell and then only those whose box does not pass the same test.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens.llm.records import thinned
from risklens.session import materialize

DIMS = 8
LEAF = 32


@dataclass(frozen=True)
class AnnRules:
    k: int = 5
    certainty: float = 0.97  # of the stopping test
    block: int = 4096  # vectors in one task's tree
    max_cells: int = 4096  # bounds what the driver holds of the index
    sample: int = 8192  # vectors that the cells are fitted on, by hash of the id
    seed: int = 17


def chi_square(x: np.ndarray) -> np.ndarray:
    """Distribution function with ``DIMS`` (even) degrees of freedom."""
    h = np.minimum(x, 1e6) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for i in range(1, DIMS // 2):
        term = term * h / i
        total = total + term
    return 1 - np.exp(-h) * total


def projection(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, DIMS))


def project(vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Projections of the unit vectors; equal vectors get equal projections."""
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return np.stack([np.einsum("ij,j->i", unit, matrix[:, c].copy()) for c in range(matrix.shape[1])], axis=1)


class Cells:
    """Median splits of the sample's projections, level by level."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, dtype=np.int64)
        self.value = np.zeros((1 << depth) - 1)
        groups = {0: points}
        for node in range((1 << depth) - 1):
            mine = groups.pop(node)
            if len(mine):
                axis = int(np.argmax(mine.max(axis=0) - mine.min(axis=0)))
                self.axis[node], self.value[node] = axis, np.median(mine[:, axis])
            right = mine[:, self.axis[node]] > self.value[node]
            groups[2 * node + 1], groups[2 * node + 2] = mine[~right], mine[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.value[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def box_distance(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance from a point to each box."""
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return np.einsum("ij,ij->i", gap, gap)


class Tree:
    """kd-tree of one block: leaves of ``LEAF`` vectors and their boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.leaves, stack = [], [np.arange(len(ids))]
        while stack:
            mine = stack.pop()
            if len(mine) <= LEAF:
                self.leaves.append(mine)
                continue
            own = points[mine]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order = np.argsort(own[:, axis], kind="stable")
            half = len(mine) // 2
            stack += [mine[order[:half]], mine[order[half:]]]
        self.low = np.stack([points[x].min(axis=0) for x in self.leaves])
        self.high = np.stack([points[x].max(axis=0) for x in self.leaves])

    def search(self, own: int, vector: np.ndarray, point: np.ndarray, bound: float, rules: AnnRules) -> list[tuple[float, int]]:
        """Best (score, id) pairs, found leaf by leaf; ``bound`` is a score that k
        vectors elsewhere reach."""
        near = box_distance(point, self.low, self.high)
        norm = math.sqrt(np.einsum("i,i->", vector, vector))
        best: list[tuple[float, int]] = []
        order, at, step = np.argsort(near, kind="stable"), 0, 1
        while at < len(order):
            kth = max(bound, -best[rules.k - 1][0] if len(best) >= rules.k else -2.0)
            # the leaves that the present k-th best does not rule out, a few at a time
            ahead = order[at : at + step]
            open_ = int((~((near[ahead] > 0) & passed(near[ahead], kth, rules))).sum())
            if not open_:
                break
            rows = np.concatenate([self.leaves[leaf] for leaf in ahead[:open_].tolist()])
            score = np.einsum("ij,j->i", self.vectors[rows], vector) / (self.norm[rows] * norm)
            ids = self.ids[rows]
            use = (score >= kth) & (ids != own)
            if use.any():
                best = sorted(best + list(zip((-score[use]).tolist(), ids[use].tolist())))[: rules.k]
            at, step = at + open_, min(2 * step, 16)
        return [(-s, i) for s, i in best]


@lru_cache
def chi_square_limit(certainty: float) -> float:
    """Where the distribution function reaches ``certainty``."""
    low, high = 0.0, 1000.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(np.array(middle)) < certainty else (low, middle)
    return high


def passed(near: np.ndarray, kth: float, rules: AnnRules) -> np.ndarray:
    """Whether vectors beyond squared projected distances ``near`` are unlikely to beat
    the score ``kth`` (below -1: there is none yet)."""
    if kth < -1.5:
        return np.zeros(len(near), dtype=bool)
    return near >= chi_square_limit(rules.certainty) * max(2 - 2 * kth, 1e-12)


def usable(vec: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite components, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


SEARCH = "query_id bigint, vec_id bigint, score double"


def _search(rows: DataFrame, dim: int, matrix: np.ndarray, rules: AnnRules) -> DataFrame:
    """Each block's best for each query sent to it.  Rows: cell, part, asks (false for
    the block's vectors), id, vec (doubles), bound."""

    def groups(batches: Iterator[pa.RecordBatch]):
        now, data, tree = None, [], None
        for b in batches:
            for cell, part, asks, i, vec, bound in zip(*(b.column(c).to_pylist() for c in ("cell", "part", "asks", "id", "vec", "bound"))):
                if (cell, part) != now:
                    now, data, tree = (cell, part), [], None
                if not asks:
                    data.append((i, vec))
                    continue
                if not data:
                    continue
                if tree is None:
                    ids = np.array([x for x, _ in data], dtype=np.int64)
                    vectors = np.frombuffer(b"".join([v for _, v in data]), dtype="<f8").reshape(-1, dim)
                    tree = Tree(ids, vectors, project(vectors, matrix))
                yield tree, i, np.frombuffer(vec, dtype="<f8"), bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, float]] = []
        for tree, query, vector, bound in groups(batches):
            point = project(vector[None, :], matrix)[0]
            out += [(query, i, s) for s, i in tree.search(query, vector, point, bound, rules)]
            if len(out) > 20000:
                yield _found(out)
                out = []
        if out:
            yield _found(out)

    placed = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")
    return placed.mapInArrow(run, SEARCH)


def _found(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    q, i, s = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(df: DataFrame, every: int = 50, rules: AnnRules = AnnRules(), vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """For each vector whose id is divisible by ``every``: query_id, rank (from 1),
    vec_id and score (cosine in double precision) of the k nearest found among
    all other vectors, ties to the smaller id.

    Vectors that are null, zero, hold null or non-finite components, have no id or
    another length than most take no part.  Of rows with one id the least vector
    counts.  Equal vectors have equal projections and are all examined, so ties are
    exact.  Only the two named columns are read.  An empty table gives an empty
    table.  Every vector is indexed; only the cells are fitted on a sample.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vec}`").cast("array<double>").alias("vec")).filter("id is not null and vec is not null")
    common = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").first()
    if common is None or common.dim == 0:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = int(common.dim)
    valid = materialize(rows.filter(usable(F.col("vec"), dim)).groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    total, matrix = valid.count(), projection(dim, rules.seed)
    # bounded: the sample, and below one box per cell
    sample = thinned(valid, F.xxhash64("id"), rules.sample).orderBy(F.xxhash64("id"), "id").limit(rules.sample).toLocalIterator()
    sampled = np.array([r.vec for r in sample], dtype=np.float64).reshape(-1, dim)
    depth = min(max(math.ceil(math.log2(max(total, 1) / rules.block)), 0), int(math.log2(rules.max_cells)))
    cells = Cells(project(sampled, matrix) if len(sampled) else np.zeros((0, DIMS)), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vectors = b.column("vec").flatten().to_numpy().astype("<f8").reshape(-1, dim)
            points = project(vectors, matrix)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(cells.of(points).astype(np.int32)), pa.array([v.tobytes() for v in vectors], pa.binary())],
                names=["id", "cell", "vec"],
            )

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            points, cell = project(_matrix(b.column("vec"), dim), matrix), b.column("cell").to_numpy()
            for c in np.unique(cell).tolist():
                own = points[cell == c]
                n, low, high = held.get(c, (0, np.full(DIMS, np.inf), np.full(DIMS, -np.inf)))
                held[c] = (n + len(own), np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0)))
        for c, (n, low, high) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * DIMS, pa.int32()), pa.array(range(DIMS), pa.int32()), pa.array([n] * DIMS, pa.int64()), pa.array(low), pa.array(high)],
                names=["cell", "axis", "n", "low", "high"],
            )

    placed = materialize(valid.mapInArrow(place, "id bigint, cell int, vec binary"), "placed")
    stats = placed.select("cell", "vec").mapInArrow(boxes, "cell int, axis int, n bigint, low double, high double")
    low, high = np.full((1 << depth, DIMS), np.inf), np.full((1 << depth, DIMS), np.inf)
    parts = np.zeros(1 << depth, dtype=np.int64)
    for r in stats.groupBy("cell", "axis").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r.cell, r.axis], high[r.cell, r.axis], parts[r.cell] = r.low, r.high, -(-r.n // rules.block)
    n_parts = F.array(*[F.lit(int(max(p, 1))) for p in parts])[F.col("cell")]
    data = placed.select(
        "cell", F.pmod(F.xxhash64("id"), n_parts).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "vec", F.lit(-2.0).alias("bound")
    )
    queries = placed.filter(F.col("id") % every == 0)
    home = queries.select(
        "cell", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"), F.lit(True).alias("asks"), "id", "vec", F.lit(-2.0).alias("bound")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= rules.k)
    first = materialize(ranked(_search(data.union(home), dim, matrix, rules)), "home")
    kth = first.filter(F.col("rank") == rules.k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    bounded = queries.join(kth, "id", "left").select("id", "cell", "vec", F.coalesce("bound", F.lit(-2.0)).alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, cell, vec, bound in zip(*(b.column(c).to_pylist() for c in ("id", "cell", "vec", "bound"))):
                point = project(np.frombuffer(vec, dtype="<f8")[None, :], matrix)[0]
                with np.errstate(invalid="ignore"):
                    near = np.where(parts > 0, box_distance(point, low, high), np.inf)
                go = np.flatnonzero(np.isfinite(near) & ~((near > 0) & passed(near, bound, rules)))
                go = [c for c in go.tolist() if c != cell]
                visits = [(c, p) for c in go for p in range(int(parts[c]))]
                if visits:
                    n = len(visits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c for c, _ in visits], pa.int32()), pa.array([p for _, p in visits], pa.int32()), pa.array([True] * n),
                         pa.array([i] * n, pa.int64()), pa.array([vec] * n, pa.binary()), pa.array([bound] * n)],
                        names=["cell", "part", "asks", "id", "vec", "bound"],
                    )

    visits = bounded.mapInArrow(route, "cell int, part int, asks boolean, id bigint, vec binary, bound double")
    second = _search(data.union(visits), dim, matrix, rules)
    return ranked(first.select("query_id", "vec_id", "score").union(second)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def ann_query(embeddings: DataFrame) -> DataFrame:
    """Five nearest neighbours of every fiftieth vector."""
    return nearest(embeddings)
