"""Near-duplicate vectors: int8 tile products with per-vector error bounds, doubtful pairs recomputed in full.

Exact copies are joined first. The distinct vectors are dealt to cells by their nearest pivot (pivots come from a
bounded sample) and cells are cut into tiles of bounded size; every pair of tiles is a task of its own unless the
triangle inequality on angles shows that no pair of their vectors can reach the threshold. In a task, unit vectors are
quantised to 8-bit integers with a scale each. With u = s q + e the product of two vectors differs from the integer
product by at most |e_u| |v| + |s_u q_u| |e_v|, whatever the rounding was, so only pairs whose integer product plus
this bound reaches the threshold are computed in double precision. A task returns, for each of its vectors that has
links, their number and one smaller vector it hangs together with; pairs are never written out.

The work is the square of the distinct vectors where they have no cells (as with vectors that point everywhere).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import components, cut, sample_ids, spread_join

THRESHOLD = 0.95
#: Vectors in a tile; pivots that are broadcast at most (more vectors make more tiles in a cell); vectors of the sample
#: that pivots come from, at least and at most.
TILE, MOST_CELLS, SAMPLE, MOST_SAMPLE = 4096, 16_384, 4096, 65_536
#: Integer products are exact in 32-bit floats up to so many places at once.
EXACT = 1024


def matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None for one that is null, empty, zero, or holds nulls or non-finite values.

    A vector whose squared length is beyond the normal range of doubles is first divided by its largest component.
    """
    out: list[np.ndarray | None] = []
    for value in column:
        v = value.values if value.is_valid else None
        if v is None or len(v) == 0 or v.null_count:
            out.append(None)
            continue
        x = v.to_numpy(zero_copy_only=False).astype(np.float64)
        if not np.isfinite(x).all() or not x.any():
            out.append(None)
            continue
        with np.errstate(over="ignore", under="ignore"):
            square = x @ x
        out.append(x if 1e-280 < square < 1e280 else x / np.abs(x).max())
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit places (as floats), scale and length of the error of each unit vector."""
    scale = np.abs(u).max(1) / 127
    q = np.rint(u / scale[:, None])
    return q.astype(np.int8), scale, np.linalg.norm(u - q * scale[:, None], axis=1)


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of rows of ``a`` and ``b`` whose cosine, in double precision, reaches the threshold."""
    ua, ub = unit(a), unit(b)
    (qa, sa, ea), (qb, sb, eb) = quantised(ua), quantised(ub)
    rows, cols = [], []
    fb, scale, worst = qb.astype(np.float32).T, sb.astype(np.float32), eb.max()
    for at in range(0, len(a), 1024):
        part = slice(at, at + 1024)
        product = np.zeros((len(qa[part]), len(b)), np.float32)
        for d in range(0, a.shape[1], EXACT):
            product += qa[part, d : d + EXACT].astype(np.float32) @ fb[d : d + EXACT]
        product *= scale
        # Unit vectors have length 1 and their quantised forms at most 1 + e; 1e-5 covers the 32-bit arithmetic.
        need = (threshold - ea[part] - (1 + ea[part]) * worst - 1e-5) / sa[part]
        i, j = np.nonzero(product >= need.astype(np.float32)[:, None])
        rows.append(i + at)
        cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    exact = np.concatenate([np.einsum("ij,ij->i", ua[i[k : k + 65536]], ub[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.empty(0)
    return i[exact >= threshold], j[exact >= threshold]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index each of n items hangs together with through the pairs, by repeated minima."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def nearest_pivot(centre: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pivot that each unit vector is nearest to, and the cosine, in blocks of bounded memory."""
    at, cosine = np.empty(len(x), np.int64), np.empty(len(x))
    for k in range(0, len(x), 512):
        c = x[k : k + 512] @ centre.T
        at[k : k + 512], cosine[k : k + 512] = c.argmax(1), c.max(1)
    return at, cosine


def pivots(nodes: DataFrame, most: int) -> dict[int, np.ndarray]:
    """For each length of vectors, at most ``most`` unit vectors, by a few rounds of k-means over a bounded sample."""
    by_dim: dict[int, list[np.ndarray]] = {}
    for (raw,) in sample_ids(nodes, F.col("node"), min(MOST_SAMPLE, max(SAMPLE, 4 * most))).select("vec").collect():
        v = np.frombuffer(raw)
        by_dim.setdefault(len(v), []).append(v)
    out = {}
    for dim, rows in sorted(by_dim.items()):
        x = unit(np.array(rows))
        centre = x[:most].copy()
        for _ in range(5):
            home, _ = nearest_pivot(centre, x)
            total = np.zeros_like(centre)
            np.add.at(total, home, x)
            norm = np.linalg.norm(total, axis=1)
            centre[norm > 1e-9] = total[norm > 1e-9] / norm[norm > 1e-9, None]
        out[dim] = centre
    return out


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, n_links, component_id, kept`` for every row of ``vectors``.

    Links join vectors of one length whose cosine is ``threshold`` or more; ``n_links`` counts the other rows linked
    with the row, equal vectors among them; ``component_id`` is the smallest ``key`` reachable by links, ``kept``
    whether it is the row's own. Null, empty and zero vectors and those with null or non-finite components link with
    nothing. Labels and other columns are not read. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vecs = [v.tobytes() if v is not None else None for v in matrix(part.column(1))]
                ids = [hashlib.md5(v).digest() if v is not None else None for v in vecs]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(vecs, pa.binary())], ["id", "node", "vec"])

    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).mapInArrow(read, f"id {kind}, node binary, vec binary")
    valid = rows.where(F.col("node").isNotNull())
    nodes = cut(valid.groupBy("node").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")))
    n = nodes.count()
    centres = pivots(nodes, int(min(MOST_CELLS, max(1, n // TILE))))
    known = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, angles, dims = [], [], []
            for raw in batch.column(1).to_pylist():
                v = np.frombuffer(raw)
                centre = known.value.get(len(v))
                c = centre @ (v / np.linalg.norm(v)) if centre is not None else np.zeros(1)
                dims.append(len(v))
                cells.append(int(c.argmax()))
                angles.append(float(np.arccos(np.clip(c.max(), -1, 1))) if centre is not None else np.pi)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(cells, pa.int32()), pa.array(angles, pa.float64())], ["node", "vec", "copies", "dim", "cell", "angle"])

    placed = cut(nodes.select("node", "vec", "copies").mapInArrow(place, "node binary, vec binary, copies long, dim int, cell int, angle double"))
    cells = cut(placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")))
    # At most MOST_CELLS cells for each length of vectors: a small table.
    tiled = placed.join(F.broadcast(cells.select("dim", "cell", "tiles")), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).drop("tiles")
    tiles = cut(tiled.groupBy("dim", "cell", "sub").agg(F.max("angle").alias("radius")))

    # Pairs of cells that may hold a link, each cell against all in a task of its own.
    reach = float(np.arccos(threshold)) + 1e-9
    radius = {dim: np.full(len(c), -np.inf) for dim, c in centres.items()}
    for dim, cell, wide in tiles.groupBy("dim", "cell").agg(F.max("radius")).collect():
        if dim in radius:
            radius[dim][cell] = wide
    wide_known = spark.sparkContext.broadcast(radius)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                centre = known.value.get(dim)
                if centre is None:
                    near, apart = np.zeros(1, int), np.zeros(1)
                else:
                    apart = np.arccos(np.clip(centre @ centre[cell], -1, 1))
                    apart[cell] = 0.0
                    near = np.flatnonzero(apart <= wide_known.value[dim] + wide_known.value[dim][cell] + reach)
                    near = near[near >= cell]
                    apart = apart[near]
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(near), pa.int32()), pa.array([cell] * len(near), pa.int32()), pa.array(near, pa.int32()), pa.array(apart, pa.float64())], ["dim", "cell", "other", "apart"])

    cell_pairs = cut(cells.select("dim", "cell").mapInArrow(neighbours, "dim int, cell int, other int, apart double"))
    one = tiles.join(cell_pairs, ["dim", "cell"])
    two = tiles.select("dim", F.col("cell").alias("other"), F.col("sub").alias("other_sub"), F.col("radius").alias("other_radius"))
    pairs = one.join(two, ["dim", "other"]).where((F.col("cell") != F.col("other")) | (F.col("sub") <= F.col("other_sub")))
    pairs = pairs.where((F.col("cell") == F.col("other")) | (F.col("apart") <= F.col("radius") + F.col("other_radius") + reach))
    task = ["dim", "c1", "s1", "c2", "s2"]
    pairs = cut(pairs.select("dim", F.col("cell").alias("c1"), F.col("sub").alias("s1"), F.col("other").alias("c2"), F.col("other_sub").alias("s2")))
    same = (F.col("c1") == F.col("c2")) & (F.col("s1") == F.col("s2"))
    left = pairs.select(*task, F.col("c1").alias("cell"), F.col("s1").alias("sub"), F.when(same, 2).otherwise(0).alias("side"))
    right = pairs.where(~same).select(*task, F.col("c2").alias("cell"), F.col("s2").alias("sub"), F.lit(1).alias("side"))
    dealt = tiled.select("dim", "cell", "sub", "node", "vec", "copies").join(left.unionByName(right), ["dim", "cell", "sub"]).select(*task, "side", "node", "vec", "copies")

    def compare(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        names = np.array(group.column("node").to_pylist(), object)[order]
        copies = group.column("copies").to_numpy()[order]
        raw = group.column("vec").to_pylist()
        x = np.array([np.frombuffer(raw[k]) for k in order])
        side = side[order]
        if side[0] == 2:
            i, j = close_pairs(x, x, threshold)
            i, j = i[i < j], j[i < j]
        else:
            cutoff = int((side == 0).sum())
            i, j = close_pairs(x[:cutoff], x[cutoff:], threshold) if 0 < cutoff < len(x) else (np.empty(0, int), np.empty(0, int))
            j = j + cutoff
        links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        root = _roots(len(x), i, j)
        has = np.flatnonzero(links > 0)
        return pa.table({"a": pa.array(names[has].tolist(), pa.binary()), "b": pa.array(names[root[has]].tolist(), pa.binary()), "links": pa.array(links[has].astype(np.int64))})

    found = cut(dealt.groupBy(*task).applyInArrow(compare, "a binary, b binary, links long"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = nodes.select("node", "first_id").join(components(found.select("a", "b")), "node")
    least = cut(classes.groupBy("comp").agg(F.min("first_id").alias("least"), F.count(F.lit(1)).alias("n")))
    named = spread_join(classes, least, ["comp"], "n", F.xxhash64("node")).select("node", "least")
    known_nodes = cut(nodes.select("node", F.col("copies").alias("n"), "copies", "first_id").join(counts, "node", "left").join(named, "node", "left"))
    out = spread_join(rows.select("id", "node"), known_nodes, ["node"], "n", F.xxhash64("id"), "left")
    component = F.coalesce("least", "first_id", "id")
    total = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select("id", total.cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
