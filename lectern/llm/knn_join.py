"""Exact top-k search by inner product: a Voronoi join of queries with all rows.

Components become integers floor(scale * x), so scores are exact. Pivots (a bounded, hash-ordered sample of rows; about
the root of the rows' number of them, ``pivots`` at most) divide the rows into cells by the nearest pivot; a cell's
summary is its pivot, its largest distance from the pivot and its number of rows. Queries are grouped by nearest pivot
too, small groups together and large ones in parts.

1. A cell's queries are solved against the cells nearest to it, as many as hold k rows besides a query itself. Each query's
   k-th score there is one that its k-th best surely reaches.
2. A query q scores at most q.c + |q|r with a row at distance r from the pivot c. So of a cell it only needs rows from
   a distance on, the ring (reach - q.c) / |q|, and nothing of cells whose rows are all nearer. A group needs what any
   of its queries needs.
3. Only needed rows are replicated to a group, in blocks of bounded size, and each block is solved by one matrix
   product.

Bounds are rounded outwards. Index and result cover every row; only the pivots come from a sample, and they don't
affect the result.

Scores are exact: products run in float64 where no sum can reach 2**53, else in 64-bit integers; where even these
could overflow, a score would be no long, and OverflowError is raised before any work.

Cases: vectors that are null or hold null or non-finite components take no part. A query's candidates are the
vectors of its own length; each length among the queries is a join of its own. Equal scores go by the smaller id. A row is not its own candidate; rows with a query's id are
the query's own; a query id on several rows is asked with the least of its vectors. Repeated ids as candidates count as often as they occur. Null ids take no part. Fewer than k other
rows: all of them. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._run import cut, ship


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _packed(x: np.ndarray, kind: str) -> pa.Array:
    """Rows of a matrix as bytes of the smallest integers that hold them: less to shuffle and to decode than lists."""
    x = np.ascontiguousarray(x, dtype=kind)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _unpacked(column: pa.Array | pa.ChunkedArray, dim: int, kind: str) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, dim), dtype=kind)
    _, ends, data = column.buffers()
    first, last = (int(np.frombuffer(ends, dtype=np.int32)[column.offset + i]) for i in (0, len(column)))
    return np.frombuffer(data, dtype=np.uint8)[first:last].view(kind).reshape(-1, dim)


def _nearest(shared, kind: str):
    """Cell of each vector and its distance from the pivot, rounded up; vectors are packed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value.astype(np.float64)
        norms = (pivots * pivots).sum(axis=1)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                v = _matrix(b.column(1), pivots.shape[1])
                x = v.astype(np.float64)
                far = norms - 2 * (x @ pivots.T)
                cell = far.argmin(axis=1)
                radius = np.sqrt(np.maximum((x * x).sum(axis=1) + far[np.arange(len(x)), cell], 0)) * (1 + 1e-9) + 1e-6
                yield pa.RecordBatch.from_arrays([b.column(0), _packed(v, kind), pa.array(cell.astype(np.int32)), pa.array(radius)], names=["id", "v", "cell", "radius"])

    return each


def _rings(shared, packed: str):
    """Rows (v, group, reach) of queries -> the needed cells of each group, and the least distance from the pivot that is needed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, cell, largest = shared.value
        points = points.astype(np.float64)
        held: dict[int, np.ndarray] = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                q = _unpacked(b.column(0), points.shape[1], packed).astype(np.float64)
                group, reach = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
                mid, norm = q @ points[cell].T, np.sqrt((q * q).sum(axis=1))
                gap = reach[:, None] - mid
                gap -= 1e-9 * (np.abs(mid) + np.abs(np.where(np.isfinite(reach), reach, 0))[:, None]) + 1e-6
                with np.errstate(divide="ignore", invalid="ignore"):
                    ring = np.where(gap <= 0, 0.0, gap / norm[:, None])
                ring[ring > largest[None, :]] = np.inf
                for g in np.unique(group):
                    least = ring[group == g].min(axis=0)
                    held[g] = np.minimum(held[g], least) if g in held else least
        for g, least in held.items():
            at = np.flatnonzero(np.isfinite(least))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, dtype=np.int32)), pa.array(cell[at].astype(np.int32)), pa.array(least[at])], names=["group", "to", "ring"])

    return each


def _solve(k: int, dim: int, small: bool, packed: str):
    kind, none = (np.float64, -np.inf) if small else (np.int64, np.iinfo(np.int64).min)

    def each(queries: pa.Table, rows: pa.Table) -> pa.Table:
        qid, q = queries.column("id").to_numpy(), _unpacked(queries.column("v"), dim, packed).astype(kind)
        rid, x = rows.column("id").to_numpy(), _unpacked(rows.column("v"), dim, packed).astype(kind)
        who, what, score = [], [], []
        order = np.argsort(rid, kind="stable")
        rid, x = rid[order], x[order]
        for lo in range(0, len(qid) if len(rid) else 0, 256):
            s = q[lo : lo + 256] @ x.T  # integers, exact
            s[rid[None, :] == qid[lo : lo + 256, None]] = none
            for i in range(len(s)):
                row = s[i]
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    best = np.flatnonzero(row >= least)
                else:
                    best = np.arange(len(row))
                best = best[row[best] > none]
                best = best[np.lexsort((rid[best], -row[best]))][:k]
                who.append(np.full(len(best), qid[lo + i]))
                what.append(rid[best])
                score.append(row[best].astype(np.int64))
        cat = lambda a: pa.array(np.concatenate(a) if a else np.empty(0, dtype=np.int64))
        return pa.table({"query_id": cat(who), "id": cat(what), "score": cat(score)})

    return each


def knn_join(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64,
    pivots: int = 512, sample: int = 4096, group_rows: int = 2048, block_rows: int = 16384,
) -> DataFrame:
    """query_id, rank from 1, id, score for each query row (its id and vector), k best by inner product of integer vectors."""
    spark = vectors.sparkSession
    ship(spark)

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
        fine = df.where(F.col(id_col).isNotNull() & x.isNotNull()).where(F.forall(x, lambda e: finite(e.cast("double"))))
        return fine.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"), F.transform(x, lambda e: F.abs(e.cast("double"))).alias("far"))

    rows, asked = whole(vectors), whole(queries)
    sizes = asked.groupBy(F.size("v").alias("dim")).count().select("dim").collect()  # one, as a rule
    found = None
    for dim in sorted(r["dim"] for r in sizes) or [1]:
        one = _joined(rows.where(F.size("v") == dim), asked.where(F.size("v") == dim), dim, k, scale, pivots, sample, group_rows, block_rows)
        found = one if found is None else found.unionByName(one)
    return found


def _joined(rows: DataFrame, asked: DataFrame, dim: int, k: int, scale: int, pivots: int, sample: int, group_rows: int, block_rows: int) -> DataFrame:
    """The join of vectors of one length."""
    spark = rows.sparkSession
    if not dim:  # empty vectors: all scores are 0
        rows, asked, dim = *(d.select("id", F.array(F.lit(0).cast("long")).alias("v"), F.array(F.lit(0.0)).alias("far")) for d in (rows, asked)), 1
    n, far = rows.agg(F.count("*"), F.max(F.array_max("far"))).first()
    far = max(far or 0.0, asked.agg(F.max(F.array_max("far"))).first()[0] or 0.0) * scale + 1
    if dim * far * far >= 2.0**63:
        raise OverflowError(f"scores of {dim} components up to {far:.3g} do not fit a long")
    rows, asked = rows.select("id", "v"), asked.groupBy("id").agg(F.min("v").alias("v"))
    drawn = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    points = np.unique(np.array([list(v) for v in drawn], dtype=np.int64), axis=0) if len(drawn) else np.zeros((1, dim), dtype=np.int64)
    rng = np.random.default_rng(7)
    points = points[np.sort(rng.choice(len(points), min(pivots, max(int(n**0.5), 1), len(points)), replace=False))]
    shared = spark.sparkContext.broadcast(points)

    kind = "<i2" if far < 2.0**15 else "<i4" if far < 2.0**31 else "<i8"
    schema = "id long, v binary, cell int, radius double"
    placed = cut(rows.mapInArrow(_nearest(shared, kind), schema))
    asked = cut(asked.mapInArrow(_nearest(shared, kind), schema))
    sizes = placed.groupBy("cell").agg(F.max("radius").alias("radius"), F.count("*").alias("n")).orderBy("cell").toPandas()  # one row a pivot
    groups = asked.groupBy("cell").agg(F.count("*").alias("n")).toPandas()
    own = placed.groupBy("id").count().agg(F.max("count")).first()[0] or 1

    # query cells are packed into groups of about group_rows queries, near ones together
    near = groups.assign(by=[float(points[c] @ points[0]) for c in groups["cell"]]).sort_values(["by", "cell"])
    near["group"] = np.maximum(near["n"].cumsum() - 1, 0) // group_rows
    packed = near.groupby("group")["n"].sum()
    of_cell = spark.createDataFrame([(int(c), int(g)) for c, g in near[["cell", "group"]].itertuples(index=False)], "cell int, group int")
    ask = asked.join(F.broadcast(of_cell), "cell").select("id", "v", "group")
    parts = lambda sizes_: spark.createDataFrame([(int(g), -(-int(x) // (2 * group_rows))) for g, x in sizes_], "group int, shares int")
    blocks = spark.createDataFrame([(int(c), -(-int(x) // block_rows)) for c, x in sizes[["cell", "n"]].itertuples(index=False)], "to int, blocks int")

    def solved(ask: DataFrame, shares: DataFrame, need: DataFrame) -> DataFrame:
        """ask (id, v, group), need (group, to, ring): one row a group and cell, so one a pair of pivots at most."""
        plan = need.join(F.broadcast(shares), "group").join(F.broadcast(blocks), "to")
        spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = ask.join(F.broadcast(plan), "group").withColumn("part", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int"))
        left = left.withColumn("block", spread("blocks")).select("group", "part", "to", "block", "id", "v")
        by_cell = plan.select(F.col("group").alias("for"), F.col("to").alias("own"), "ring", F.col("shares").alias("parts"), F.col("blocks").alias("pieces"))
        right = placed.join(F.broadcast(by_cell), (F.col("cell") == F.col("own")) & (F.col("radius") >= F.col("ring"))).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        right = right.withColumn("share", spread("parts")).select("for", "share", "own", "piece", "id", "v")
        pairs = left.groupBy("group", "part", "to", "block").cogroup(right.groupBy("for", "share", "own", "piece"))
        found = pairs.applyInArrow(_solve(k, dim, dim * far * far < 2.0**53, kind), "query_id long, id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    homes = spark.createDataFrame(_homes(groups["cell"].to_numpy(np.int64), sizes, points, k + own), "group int, to int, ring double")
    by_home = asked.select("id", "v", F.col("cell").alias("group"))
    first = solved(by_home, parts(groups[["cell", "n"]].itertuples(index=False)), homes).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("reach"))
    reached = ask.join(first, F.col("id") == F.col("query_id"), "left").select("v", "group", F.coalesce("reach", F.lit(float("-inf"))).alias("reach"))
    summary = spark.sparkContext.broadcast((points, sizes["cell"].to_numpy(np.int64), sizes["radius"].to_numpy(np.float64)))
    need = cut(reached.mapInArrow(_rings(summary, kind), "group int, to int, ring double").groupBy("group", "to").agg(F.min("ring").alias("ring")))
    return solved(ask, parts(packed.items()), need).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _homes(own: np.ndarray, sizes: pd.DataFrame, points: np.ndarray, least: int) -> list[tuple[int, int, float]]:
    """Of each cell of queries the cells nearest to it, as many as hold so many rows."""
    p, cell, n = points.astype(np.float64), sizes["cell"].to_numpy(np.int64), sizes["n"].to_numpy()
    out = []
    for c in own:
        order = np.argsort(((p[cell] - p[c]) ** 2).sum(axis=1), kind="stable")
        out += [(int(c), int(x), 0.0) for x in cell[order[: int(np.searchsorted(np.cumsum(n[order]), least)) + 1]]]
    return out
