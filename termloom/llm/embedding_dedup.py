"""Embedding near-dedup: PCA-ordered tiled comparison within labels, exact at the threshold.

Unit vectors are turned into the basis of principal components (of all vectors), so that most of a
dot product is in its first dimensions. Vectors are range-partitioned by label and first component;
a range of one label is a tile. Two tiles are compared only if the boxes around their leading
components are near enough, and in a comparison the leading dimensions are accumulated first: a
pair is given up as soon as its sum so far plus the product of the two suffix norms cannot reach
the threshold. What is left is decided by the cosine of the vectors as given, in double precision.

Equal vectors of a label are one node with a weight. A comparison returns each node's weight of
links and a spanning forest of the links found, never the pairs, so that a group of near copies
costs its comparisons but not its pairs in rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, nor do rows with a null label or vec_id; vectors of different lengths don't compare;
repeated rows (same vec_id, label and vector) count once; a vec_id with several vectors is one
class; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.components import connected_components
from termloom.llm.staging import stage

#: Vectors in a tile, leading dimensions of its box, and dimensions of the first accumulation.
TILE, BOX, LEAD = 1024, 4, 16
_SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _packed(batches):
    """Arrays of doubles as bytes."""
    for batch in batches:
        vecs = [np.asarray(v.values).astype(np.float64).tobytes() for v in batch.column("v")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(vecs, pa.binary())], batch.schema.names)


def _second_moments(batches):
    """Sum of the outer products of unit vectors, a row for each dimension that occurs."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for d in np.unique(dims):
            x = _matrix(batch.column("v").filter(pa.array(dims == d)))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            sums[int(d)] = sums.get(int(d), 0) + x.T @ x
    part = TaskContext.get().partitionId() % 64
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([d], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["part", "dim", "m"])


def _sum_moments(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m.as_py()) for m in table.column("m"))
    return pa.table({"part": table.column("part")[:1], "dim": table.column("dim")[:1], "m": pa.array([total.tobytes()], pa.binary())})


def principal_axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the axes by falling variance. At most 64 matrices come to the driver."""
    schema = "part int, dim int, m binary"
    rows = nodes.select("dim", "v").mapInArrow(_second_moments, schema).groupBy("part", "dim").applyInArrow(_sum_moments, schema).collect()
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out[r.dim] = out.get(r.dim, 0) + np.frombuffer(r.m).reshape(r.dim, r.dim)
    return {d: np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1]) for d, m in out.items()}


def _suffix(x: np.ndarray, steps: list[int]) -> list[np.ndarray]:
    squares = x * x
    return [np.sqrt(squares[:, k:].sum(1)) for k in steps]


def linked_pairs(x: np.ndarray, y: np.ndarray | None, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of ``x`` and ``y`` with a cosine of at least ``threshold``; i < j without ``y``."""
    own = y is None
    y = x if own else y
    dim = x.shape[1]
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    rx, ry = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    steps = [*range(min(LEAD, dim), dim, LEAD), dim]
    sx, sy = _suffix(rx, steps), _suffix(ry, steps)
    lead = steps[0]
    first = rx[:, :lead] @ ry[:, :lead].T
    near = first + np.outer(sx[0], sy[0]) >= threshold - _SLACK
    if own:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    out = []
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        p = first[a, b]
        for k in range(1, len(steps)):
            p = p + np.einsum("ij,ij->i", rx[a, steps[k - 1] : steps[k]], ry[b, steps[k - 1] : steps[k]])
            keep = p + sx[k][a] * sy[k][b] >= threshold - _SLACK
            a, b, p = a[keep], b[keep], p[keep]
        exact = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
        out.append((a[exact], b[exact]))
    none = np.zeros(0, np.int64)
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (none, none)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that the links of this comparison reach), without the smallest."""
    node, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = where[: len(a)], where[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(node))
    return node[moved], node[label[moved]]


def _compare(axes_shared, threshold: float):
    names = ["a", "b", "links"]

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        ids, weight = np.asarray(table.column("rep")), np.asarray(table.column("copies"))
        v = _matrix(table.column("v").combine_chunks())
        one, two = side == 0, side == 1
        axes = axes_shared.value[v.shape[1]]
        i, j = linked_pairs(v[one], v[two] if two.any() else None, axes, threshold)
        left, right = np.flatnonzero(one)[i], (np.flatnonzero(two) if two.any() else np.flatnonzero(one))[j]
        links = np.bincount(left, weight[right], len(ids)) + np.bincount(right, weight[left], len(ids))
        some = np.flatnonzero(links)
        node, root = _forest(ids[left], ids[right])
        none = pa.nulls(len(some), pa.int64())
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(ids[some], pa.int64()), pa.array(node, pa.int64())]),
                "b": pa.concat_arrays([none, pa.array(root, pa.int64())]),
                "links": pa.concat_arrays([pa.array(links[some].astype(np.int64)), pa.nulls(len(node), pa.int64())]),
            }
        ).select(names)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), "label")
    sound = F.expr("size(e) > 0 AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(e, x -> x <> 0)")
    valid = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL").filter(sound)
    nodes = valid.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))
    nodes = stage(nodes.select("rep", "copies", F.col("label").alias("lab"), F.size("e").alias("dim"), F.col("e").alias("v")), "vectors")
    packed = nodes.select("rep", "copies", "lab", "dim", "v")
    label_type = nodes.schema["lab"].dataType.simpleString()
    schema = f"rep long, copies long, lab {label_type}, dim int, v binary"
    packed = packed.mapInArrow(_packed, schema)

    axes = principal_axes(packed)
    shared = spark.sparkContext.broadcast(axes)

    def lead(batches):
        for batch in batches:
            c = np.zeros((len(batch), BOX))
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims):
                at = dims == d
                x = _matrix(batch.column("v").filter(pa.array(at)))
                k = min(BOX, int(d))
                c[at, :k] = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ shared.value[int(d)][:, :k]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c[:, k]) for k in range(BOX)]], [*batch.schema.names, *box])

    box = [f"c{k}" for k in range(BOX)]
    boxed = schema + "".join(f", {c} double" for c in box)

    def number(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int32())], [*batch.schema.names, "tile"])

    n = nodes.count()
    placed = packed.mapInArrow(lead, boxed).repartitionByRange(max(1, -(-n // tile)), "lab", "dim", "c0", "rep")
    placed = stage(placed.mapInArrow(number, boxed + ", tile int"), "tiles")
    tiles = placed.groupBy("lab", "dim", "tile").agg(*[f(c).alias(f"{p}_{c}") for c in box for p, f in (("lo", F.min), ("hi", F.max))])
    other = tiles.select("lab", "dim", F.col("tile").alias("tj"), *[F.col(f"{p}_{c}").alias(f"{p}j_{c}") for c in box for p in ("lo", "hi")])
    gaps = [F.greatest(F.col(f"loj_{c}") - F.col(f"hi_{c}"), F.col(f"lo_{c}") - F.col(f"hij_{c}"), F.lit(0.0)) for c in box]
    apart = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
    pairs = tiles.join(other, ["lab", "dim"]).filter(F.col("tile") <= F.col("tj")).filter(apart <= 2 - 2 * threshold + _SLACK).select("lab", "dim", F.col("tile").alias("ti"), "tj")
    pairs = stage(pairs, "tile-pairs")
    data = placed.select("rep", "copies", "lab", "dim", "v", "tile")
    left = data.join(pairs.withColumn("tile", F.col("ti")), ["lab", "dim", "tile"]).withColumn("side", F.lit(0))
    right = data.join(pairs.filter("ti < tj").withColumn("tile", F.col("tj")), ["lab", "dim", "tile"]).withColumn("side", F.lit(1))
    both = left.unionByName(right).select("lab", "dim", "ti", "tj", "side", "rep", "copies", "v")
    found = stage(both.groupBy("lab", "dim", "ti", "tj").applyInArrow(_compare(shared, threshold), "a long, b long, links long"), "found")

    links = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("far"))
    of_row = valid.withColumnRenamed("label", "lab").join(nodes.select("rep", "copies", "lab", F.col("v").alias("e")), ["lab", "e"]).select("vec_id", "rep", "copies").distinct()
    several = of_row.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    classes = connected_components(found.filter("b IS NOT NULL").select("a", "b").unionByName(several)).select(F.col("node").alias("rep"), F.col("component_id").alias("cls"))
    of_id = (
        of_row.join(links, "rep", "left").join(classes, "rep", "left")
        .groupBy("vec_id").agg(F.sum(F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n"), F.min(F.coalesce("cls", "rep")).alias("c"))
    )
    out = rows.select("vec_id").join(of_id, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
