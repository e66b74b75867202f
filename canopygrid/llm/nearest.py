"""Approximate nearest chips: balanced posting lists under an in-memory graph of centroids.

Centroids come from a bounded sample of chip vectors, with a clustering that charges full
lists more. Every chip goes to its nearest centroid's list and, near a boundary, to the other
lists whose centroids are about as close. A query walks the graph of centroids and reads only
the lists whose distance stays within a ratio of the nearest one; the ratio is fitted on the
sample, for a stated recall. Lists are read in blocks and
their queries too, so a list that holds a third of all chips is many small groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopygrid.llm.common import need
from canopygrid.session import cut_lineage

SAMPLE = 20_000  # chips the centroids are fitted on, at most
ITERATIONS = 8
BALANCE = 0.15  # what a list twice as long as the mean costs more, as a share of the mean distance
NEIGHBOURS, BEAM = 16, 48
REPLICA_RATIO, REPLICAS = 1.04, 4
RECALL = 0.97  # share of the sample's own nearest chips that the lists read must hold
PROBES = 256  # chips of the sample that the distance ratio is fitted on
ROWS = 1024  # chips, and queries, in one group


@dataclass
class Graph:
    """Centroids and, for each, its nearest others and a few far ones."""

    points: np.ndarray
    links: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 3) -> Graph:
        n = len(points)
        near = np.stack([np.argsort(((points - p) ** 2).sum(axis=1), kind="stable")[1:NEIGHBOURS + 1] for p in points]) if n > 1 else np.zeros((n, 0), int)
        far = np.random.default_rng(seed).integers(0, n, (n, 4))
        return cls(points, np.concatenate([near, far], axis=1))

    def search(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Per row of ``q`` the ids and distances of up to ``beam`` near centroids, nearest first.

        All rows walk at once: each expands its nearest unexpanded candidate until none is left
        in its beam. ``-1`` fills short results.
        """
        m, n = len(q), len(self.points)
        beam = min(beam, n)
        start = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
        ids = np.full((m, beam), -1)
        dist = np.full((m, beam), np.inf)
        done = np.zeros((m, beam), dtype=bool)
        seen = np.zeros((m, n), dtype=bool)
        rows = np.arange(m)

        def add(rows: np.ndarray, new: np.ndarray) -> None:
            fresh = ~seen[rows[:, None], new]
            first = np.sort(new, axis=1)
            if (first[:, 1:] == first[:, :-1]).any():  # the same neighbour twice in a row
                order = np.argsort(new, axis=1, kind="stable")
                again = np.zeros_like(fresh)
                np.put_along_axis(again, order[:, 1:], first[:, 1:] == first[:, :-1], axis=1)
                fresh &= ~again
            seen[rows[:, None], new] = True
            d = ((self.points[new] - q[rows][:, None, :]) ** 2).sum(axis=2)
            all_d = np.concatenate([dist[rows], np.where(fresh, d, np.inf)], axis=1)
            all_i = np.concatenate([ids[rows], np.where(fresh, new, -1)], axis=1)
            all_x = np.concatenate([done[rows], np.zeros_like(fresh)], axis=1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[rows], ids[rows], done[rows] = (np.take_along_axis(x, keep, axis=1) for x in (all_d, all_i, all_x))

        add(rows, np.tile(start, (m, 1)))
        while len(rows):
            open_ = ~done[rows] & (ids[rows] >= 0)
            rows = rows[open_.any(axis=1)]
            if not len(rows):
                break
            at = (~done[rows] & (ids[rows] >= 0)).argmax(axis=1)  # beams are sorted, so the first is the nearest
            done[rows, at] = True
            add(rows, self.links[ids[rows, at]])
        return ids, np.sqrt(dist)


def centroids(sample: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Balanced k-means: a list longer than the mean counts as farther away."""
    r = np.random.default_rng(seed)
    points = sample[r.choice(len(sample), k, replace=False)].copy()
    size = np.full(k, len(sample) / k)
    for _ in range(ITERATIONS):
        charge = BALANCE * np.maximum(size * k / len(sample) - 1, 0)
        owner, scale = np.empty(len(sample), dtype=int), None
        for at in range(0, len(sample), 4096):
            x = sample[at:at + 4096]
            d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ points.T + (points * points).sum(axis=1), 0)
            scale = d.min(axis=1).mean() if scale is None else scale
            owner[at:at + 4096] = (d + charge * scale).argmin(axis=1)
        size = np.bincount(owner, minlength=k).astype(float)
        total = np.zeros_like(points)
        np.add.at(total, owner, sample)
        has = size > 0
        points[has] = total[has] / size[has, None]
        points[~has] = sample[r.choice(len(sample), int((~has).sum()))]  # an empty list starts anew
    return points


def fitted_ratio(sample: np.ndarray, graph: Graph, k: int, recall: float = RECALL) -> float:
    """How much farther than the nearest centroid a list may lie and still be read.

    The ratio that reaches ``recall`` of the true ``k`` nearest among the sample. The sample is
    sparser than all chips, so its nearest lie farther out and the ratio errs to the wide side.
    """
    to_list = lambda x: np.sqrt(((x[:, None, :] - graph.points) ** 2).sum(axis=2))
    owner = np.concatenate([to_list(sample[a:a + 256]).argmin(axis=1) for a in range(0, len(sample), 256)])
    asked = sample[:PROBES]
    lists = to_list(asked)
    needed = []
    for i, q in enumerate(asked):
        d = ((sample - q) ** 2).sum(axis=1)
        d[i] = np.inf
        best = np.argsort(d, kind="stable")[:k]
        best = best[np.isfinite(d[best])]
        needed.append(lists[i, owner[best]] / max(lists[i].min(), 1e-12))
    needed = np.concatenate(needed)
    return float(np.quantile(needed, recall)) + 1e-9 if len(needed) else 1.0


def usable(chips: DataFrame, chip: str, bands: str) -> DataFrame:
    """``chip, v``: vectors without null or non-finite components and not all zero, as doubles."""
    v = F.col(bands).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return chips.select(F.col(chip).alias("chip"), v.alias("v")).where(
        F.col("chip").isNotNull() & F.col("v").isNotNull() & sound & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


POSTING = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("chip", T.LongType()),
                        T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("first", T.BooleanType())])


def postings(vectors: DataFrame, graph: Graph) -> DataFrame:
    """``list, chip, v, first``: each chip in its nearest list (``first``) and near boundaries in others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                ids, dist = graph.search(_matrix(b.column(1)))
                near = (ids >= 0) & (dist <= REPLICA_RATIO * dist[:, :1])
                near[:, REPLICAS:] = False
                near[:, 0] = True
                row, rank = np.nonzero(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row, rank].astype(np.int32)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(rank == 0)],
                    names=POSTING.names)

    return vectors.mapInArrow(run, POSTING)


PROBE = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("chip", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])


def probes(queries: DataFrame, graph: Graph, held: np.ndarray, k: int, ratio: float) -> DataFrame:
    """``list, chip, v``: the lists each query reads.

    Lists within ``ratio`` of the nearest centroid's distance, and as many more, nearest first,
    as it takes to hold ``k`` other chips; ``held`` is the number of first postings by list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(graph.points)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                beam = BEAM
                while True:  # a wider beam when the pruning ratio or the chips held reach beyond it
                    ids, dist = graph.search(_matrix(b.column(1)), beam)
                    have = np.cumsum(np.where(ids >= 0, held[ids], 0), axis=1)
                    take = (ids >= 0) & ((dist <= ratio * dist[:, :1]) | (have - held[ids] < k + 1))
                    if ids.shape[1] >= n or not take[:, -1].any():
                        break
                    beam *= 2
                row, rank = np.nonzero(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row, rank].astype(np.int32)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], names=PROBE.names)

    return queries.mapInArrow(run, PROBE)


FOUND = T.StructType([T.StructField("query", T.LongType()), T.StructField("chip", T.LongType()), T.StructField("score", T.DoubleType())])


def nearest_chips(chips: DataFrame, queries: DataFrame, k: int = 10, chip: str = "chip", bands: str = "v") -> DataFrame:
    """``query, rank, chip, score``: the ``k`` nearest found of each query chip, nearest first.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to
    the smaller id; a query never finds its own id. ``queries`` is a part of ``chips`` with the
    same columns. Vectors that are null, all zero or hold null or non-finite components take no
    part, nor do those of another length than most (of two equally common lengths the shorter). Repeated rows of an id count once (with one of their
    vectors). Other columns are ignored; an empty table gives no rows.
    """
    need(chips, chip, bands)
    need(queries, chip, bands)
    spark = chips.sparkSession
    vectors = usable(chips, chip, bands)
    lengths = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dims, size = lengths[0] if lengths else (0, 0)
    alike = lambda df: df.where(F.size("v") == dims)
    vectors = alike(vectors)
    fitted = np.array([r[0] for r in vectors.orderBy(F.xxhash64("chip"), "chip").limit(SAMPLE).select("v").collect()])
    if not size:
        return spark.createDataFrame([], "query long, rank int, chip long, score double")
    lists = int(max(1, min(len(fitted) // 4, round(size ** 0.5))))
    graph = Graph.build(centroids(fitted, lists))
    ratio = fitted_ratio(fitted, graph, k)
    rows = cut_lineage(postings(vectors.dropDuplicates(["chip"]), graph))
    sizes = {r["list"]: (r["n"], r["own"]) for r in rows.groupBy("list").agg(
        F.count("*").alias("n"), F.sum(F.col("first").cast("long")).alias("own")).collect()}  # one row per list
    held = np.array([sizes.get(i, (0, 0))[1] for i in range(lists)])
    asked = cut_lineage(probes(alike(usable(queries, chip, bands)).dropDuplicates(["chip"]), graph, held, k, ratio))
    # one row per list: how many blocks its chips and its queries make
    many = lambda n: F.ceil(F.col(n) / F.lit(ROWS)).cast("int")
    blocks = rows.groupBy("list").count().withColumnRenamed("count", "n").join(
        asked.groupBy("list").count().withColumnRenamed("count", "q"), "list").select("list", many("n").alias("rb"), many("q").alias("qb"))
    group = lambda: F.xxhash64("list", "r", "q").alias("gid")
    part = lambda n: F.pmod(F.xxhash64("chip"), F.col(n)).cast("int")
    left = rows.join(blocks, "list").select("list", "chip", "v", part("rb").alias("r"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"))
    right = asked.join(blocks, "list").select("list", "chip", "v", part("qb").alias("q"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("r"))
    both = left.select(group(), F.lit(False).alias("asks"), "chip", "v").unionByName(right.select(group(), F.lit(True).alias("asks"), "chip", "v"))

    def near(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        ids, v = t.column("chip").to_numpy(), _matrix(t.column("v").chunk(0) if t.column("v").num_chunks else t.column("v"))
        x, xi = v[~asks], ids[~asks]
        out_q, out_c, out_s = [], [], []
        for q, own in zip(v[asks], ids[asks], strict=True):
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            d[xi == own] = np.inf
            best = np.lexsort((xi, d))[:k]
            best = best[np.isfinite(d[best])]
            out_q.append(np.full(len(best), own))
            out_c.append(xi[best])
            out_s.append(d[best])
        cat = lambda a, kind: pa.array(np.concatenate(a) if a else np.empty(0), kind)
        return pa.table({"query": cat(out_q, pa.int64()), "chip": cat(out_c, pa.int64()), "score": cat(out_s, pa.float64())})

    found = both.groupBy("gid").applyInArrow(near, FOUND).groupBy("query", "chip").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query").orderBy("score", "chip")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "chip", "score")
