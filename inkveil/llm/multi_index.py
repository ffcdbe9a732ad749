"""Near-duplicate vectors through an inverted multi-index.

Each half of a vector has a codebook of its own; pairs of codewords are the cells of a grid.
A vector is kept in one cell and looks for partners in the cells that a multi-sequence
traversal reaches first.  How many is measured: as many as the target recall needs.  Vectors
found in one cell are then compared in double precision.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from inkveil.llm.common import prepare, read_table, stored
from inkveil.llm.graph import components
from inkveil.session import spread

LEAST = 0.95
#: Vectors that the codebooks and the number of cells are fitted on, by a hash of the id.
SAMPLE = 20_000
TARGET_RECALL = 0.995
#: Vectors to a cell on average, and most that a task takes from a cell's two sides on average.
CELL, BLOCK = 128, 2_048
ROUNDS, TRIALS = 8, 3


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return _distances(x, centers).argmin(axis=1)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x ** 2).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers ** 2).sum(axis=1))


def codebook(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centres of the rows of ``x``."""
    centers = x[rng.choice(len(x), size, replace=False)].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centers)
        n = np.bincount(near, minlength=size)
        for k in np.flatnonzero(n):
            centers[k] = x[near == k].mean(axis=0)
    return centers


def multi_sequence(p: list[float], q: list[float], n: int) -> list[tuple[int, int]]:
    """The ``n`` pairs (i, j) of least p[i] + q[j] in their order; ``p`` and ``q`` ascend.

    A heap holds the border of the pairs visited: a pair enters it once the one before it in its
    row and the one before it in its column are visited.
    """
    seen, heap = [], [(p[0] + q[0], 0, 0)]
    reached = [0] * (len(p) + 1)  # columns visited in each row
    while len(seen) < n:
        _, i, j = heapq.heappop(heap)
        seen.append((i, j))
        reached[i] = j + 1
        if i + 1 < len(p) and reached[i + 1] == j:
            heapq.heappush(heap, (p[i + 1] + q[j], i + 1, j))
        if j + 1 < len(q) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (p[i] + q[j + 1], i, j + 1))
    return seen


@dataclass
class Grid:
    first: np.ndarray
    second: np.ndarray
    visits: int  # cells that a traversal reaches

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _distances(x[:, :cut], self.first), _distances(x[:, cut:], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        p, q = self.halves(x)
        return p.argmin(axis=1) * len(self.second) + q.argmin(axis=1)

    def traverse(self, x: np.ndarray) -> np.ndarray:
        """For each row the cells in order of the sum of the two distances, ``visits`` of them."""
        p, q = self.halves(x)
        i, j = np.argsort(p, axis=1, kind="stable"), np.argsort(q, axis=1, kind="stable")
        p, q = np.take_along_axis(p, i, 1).tolist(), np.take_along_axis(q, j, 1).tolist()
        n = min(self.visits, i.shape[1] * j.shape[1])
        seen = np.array([multi_sequence(a, b, n) for a, b in zip(p, q, strict=True)], np.int64).reshape(len(x), n, 2)
        return np.take_along_axis(i, seen[:, :, 0], 1) * len(self.second) + np.take_along_axis(j, seen[:, :, 1], 1)


def fit(sample: np.ndarray, n: int, seed: int = 5) -> Grid:
    """Codebooks for ``n`` vectors from a sample of unit vectors, and the visits the recall needs.

    Partners are simulated at the least cosine, where they are hardest to find, in random
    directions: the visits are the TARGET_RECALL quantile of how many cells lie nearer to a
    vector than its partner's cell, or to the partner than the vector's.
    """
    rng = np.random.default_rng(seed)
    size = int(np.clip(round(np.sqrt(n / CELL)), 1, max(1, len(sample) // 4)))
    cut = sample.shape[1] // 2
    grid = Grid(codebook(sample[:, :cut], size, rng), codebook(sample[:, cut:], size, rng), 1)
    needed = []
    for _ in range(TRIALS):
        x = sample[rng.choice(len(sample), min(len(sample), 1_000), replace=False)]
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        y = LEAST * x + np.sqrt(1 - LEAST ** 2) * side / np.maximum(1e-12, np.linalg.norm(side, axis=1, keepdims=True))
        needed.append(np.minimum(_rank(grid, x, grid.home(y)), _rank(grid, y, grid.home(x))))
    grid.visits = int(np.quantile(np.concatenate(needed), TARGET_RECALL, method="higher")) + 1
    return grid


def _rank(grid: Grid, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How many cells lie nearer to each row than the given one."""
    p, q = grid.halves(x)
    at = np.arange(len(x))
    limit = p[at, cells // len(grid.second)] + q[at, cells % len(grid.second)]
    q = np.sort(q, axis=1)
    return np.array([np.searchsorted(b, m - a, side="left").sum() for a, b, m in zip(p, q, limit, strict=True)])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def vector_links(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b), a < b: links between different vectors of ``vectors`` (rep, v), v of equal length."""
    n = vectors.count()
    share = min(1.0, SAMPLE / max(1, n))
    place = F.pmod(F.xxhash64(F.lit("codebook"), "rep"), F.lit(1_000_000)) / 1e6
    rows = sorted(vectors.where(place < share).collect(), key=lambda r: r["rep"])
    if not rows:
        rows = vectors.limit(1).collect()
    if not rows:
        return vectors.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("a < b")
    grid = fit(unit(np.array([r["v"] for r in rows], np.float64)), n)

    def assign(batches):
        for batch in batches:
            v = batch.column("v")
            x = unit(_matrix(v))
            seen = grid.traverse(x)
            at = np.repeat(np.arange(len(x)), seen.shape[1])
            for cell, rows_, home in ((grid.home(x), np.arange(len(x)), True), (seen.ravel(), at, False)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int64()), pa.array(np.full(len(rows_), home)),
                     batch.column("rep").take(pa.array(rows_)), v.take(pa.array(rows_))], names=["cell", "home", "rep", "v"])

    def count(batches):
        here, seeking = Counter(), Counter()
        for batch in batches:
            x = unit(_matrix(batch.column("v")))
            here.update(grid.home(x).tolist())
            seeking.update(grid.traverse(x).ravel().tolist())
        cells = list(here | seeking)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells, pa.int64())] + [pa.array([c[k] for k in cells], pa.int64()) for c in (here, seeking)], names=["cell", "h", "s"])

    kind = vectors.schema["v"].dataType.simpleString()
    placed = spread(vectors).mapInArrow(assign, f"cell long, home boolean, rep long, v {kind}")
    counted = spread(vectors.select("v")).mapInArrow(count, "cell long, h long, s long")
    # A cell is cut into blocks of either side, so a crowded one is many tasks; each block of one side meets each of the other.
    sizes = counted.groupBy("cell").agg(F.sum("h").alias("h"), F.sum("s").alias("s"))
    blocks = sizes.where("h > 0 and s > 0").select(
        "cell", F.ceil(F.col("h") / BLOCK).alias("hb"), F.ceil(F.col("s") / BLOCK).alias("sb"))
    mine = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), (F.col(c) - 1).cast("int")))
    dealt = placed.join(blocks, "cell")
    both = (dealt.where("home").select("cell", "home", "rep", "v", mine("hb").alias("x"), every("sb").alias("y"))
            .union(dealt.where(~F.col("home")).select("cell", "home", "rep", "v", mine("sb").alias("y0"), every("hb").alias("x0"))
                   .select("cell", "home", "rep", "v", F.col("x0").alias("x"), F.col("y0").alias("y"))))

    def verify(table: pa.Table) -> pa.Table:
        home = table.column("home").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        reps = table.column("rep").to_numpy()
        x = unit(_matrix(table.column("v").combine_chunks()))
        here, seek = np.flatnonzero(home), np.flatnonzero(~home)
        found = [np.zeros((0, 2), np.int64)]
        for i in range(0, len(here), 1_024):
            block = here[i:i + 1_024]
            p, q = np.nonzero(x[block] @ x[seek].T >= least)
            pairs = np.stack((reps[block[p]], reps[seek[q]]), axis=1)
            found.append(pairs[pairs[:, 0] != pairs[:, 1]])
        pairs = np.sort(np.concatenate(found), axis=1)
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return both.groupBy("cell", "x", "y").applyInArrow(verify, "a long, b long").distinct()


def near_vectors(embeddings: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``embeddings`` (vec_id, embedding).

    Equal vectors are one node with its number of copies, so copies are never paired.  Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing; shorter
    vectors are filled up with zeros.  Rows without an id are left out; rows with equal ids and
    vectors count as copies.
    """
    element = embeddings.schema["embedding"].dataType.elementType
    kind = "float" if isinstance(element, FloatType) else "double"  # floats travel as such; cosines are of doubles
    cast = F.transform(F.col("embedding"), lambda c: c.cast(kind))
    rows = stored(embeddings.where(F.col("vec_id").isNotNull()).select("vec_id", cast.alias("v")), "vectors")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = F.coalesce(finite & F.exists("v", lambda c: c != 0.0), F.lit(False))
    width = rows.where(usable).agg(F.max(F.size("v"))).first()[0] or 0
    filled = F.concat("v", F.transform(F.sequence(F.lit(0), F.lit(width) - F.size("v")), lambda c: F.lit(0.0).cast(kind)))
    filled = F.slice(filled, 1, max(1, width))
    good = rows.where(usable).select("vec_id", filled.alias("v"))
    nodes = stored(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vector-nodes")
    links = stored(vector_links(nodes.select("rep", "v"), least), "vector-links")
    ends = links.union(links.select("b", "a")).toDF("rep", "other")
    other = nodes.select(F.col("rep").alias("other"), F.col("n").alias("m"))
    degree = ends.join(other, "other").groupBy("rep").agg(F.sum("m").alias("m"))
    named = (nodes.join(degree, "rep", "left").join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
             .select("v", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    linked = good.join(named, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op5_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(read_table(prepare(spark), folder, "embeddings"))
