"""Embedding near-dedup: a tiled cosine join in PCA order that stops early.

Only vectors with the same label (not null) are compared, by cosine in double precision. Vectors that are null or zero, or
hold null or non-finite components, link with nothing, and neither do vectors of different lengths.

Equal vectors of a label are one class with a weight. Unit vectors are rotated to the principal axes of a bounded sample
(SAMPLE classes by a hash of their id): a rotation changes no cosine, so the sample only decides how early comparisons stop.
Two unit vectors with a cosine of t are sqrt(2 - 2 t) apart, so in a grid of that width over the leading axes only
neighbouring cells can hold links. Cells are of the first two axes; a cell of more than CROWDED tiles is split by the next two,
and of two split cells only the parts that are neighbours there too meet. What is still crowded is dealt into tiles of about
TILE classes by a hash, and pairs of tiles are compared: leading axes are accumulated block by block, the rest of the product is bounded by the product of the
suffix norms, and a pair is given up as soon as sum plus bound is under the threshold. Pairs that stay are decided by the
cosine of the vectors themselves. Link counts are summed in each tile and links leave it as a spanning forest, so no crowded
group is ever expanded into rows of pairs.

Rows repeated with one vec_id are vectors of their own; a null vec_id links with nothing and has component null. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from phonoweave.llm.common import Scratch, broadcast_if_small, materialize
from phonoweave.llm.components import components

THRESHOLD, TILE, SAMPLE = 0.98, 1024, 4000
#: A cell of so many tiles is split by more axes; tiles that one tile meets in a task.
CROWDED, PARTNERS = 16, 24
#: Cells that are broadcast after a count: crowded ones and those of several tiles.
MOST_BROADCAST = 200_000
#: Axes that are accumulated before each bound.
STEPS = (8, 16, 32)
#: Rows of the left tile that are compared at a time.
STRIP = 128


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Columns are orthonormal axes, by falling variance about the origin."""
    _, axes = np.linalg.eigh(sample.T @ sample)
    return axes[:, ::-1]


def _forest(pairs) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def compare(left: np.ndarray, right: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of left and j of right whose cosine reaches the threshold."""
    with np.errstate(over="ignore", under="ignore"):
        unit = [m / np.abs(m).max(axis=1, keepdims=True) for m in (left, right)]
        unit = [m / np.sqrt((m * m).sum(axis=1, keepdims=True)) for m in unit]
    rotated = [m @ axes for m in unit]
    width = axes.shape[0]
    cuts = [k for k in STEPS if k < width] + [width]
    suffix = [np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])) for m in rotated]
    suffix = [np.concatenate([s, np.zeros((len(s), 1))], axis=1) for s in suffix]
    found_i, found_j = [], []
    slack = 1e-9
    for at in range(0, len(left), STRIP):
        a = rotated[0][at : at + STRIP]
        k = cuts[0]
        total = a[:, :k] @ rotated[1][:, :k].T
        i, j = np.nonzero(total + np.outer(suffix[0][at : at + STRIP, k], suffix[1][:, k]) >= threshold - slack)
        total = total[i, j]
        for k, end in zip(cuts, cuts[1:]):
            if not len(i):
                break
            total = total + np.einsum("nd,nd->n", a[i, k:end], rotated[1][j, k:end])
            stay = total + suffix[0][at + i, end] * suffix[1][j, end] >= threshold - slack
            i, j, total = i[stay], j[stay], total[stay]
        if len(i):
            exact = np.einsum("nd,nd->n", unit[0][at + i], unit[1][j])
            # Right at the threshold: by the plain formula.
            close = np.flatnonzero(np.abs(exact - threshold) < 1e-12)
            for c in close:
                x, y = left[at + i[c]], right[j[c]]
                exact[c] = np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))
            linked = exact >= threshold
            found_i.append(at + i[linked])
            found_j.append(j[linked])
    if not found_i:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(found_i), np.concatenate(found_j)


def _pack(kind: str):
    """One row with the ids, weights and vectors of a tile; kind: of the vectors' numbers, which it holds exactly."""

    def run(table: pa.Table) -> pa.Table:
        ids, weights = table.column("id").to_numpy(), table.column("weight").to_numpy()
        vectors = np.concatenate([np.asarray(v.values, dtype=np.float64) for v in table.column("v")])
        return pa.table({"tile": table.column("tile").slice(0, 1), "ids": [ids.astype("<i8").tobytes()], "weights": [weights.astype("<i8").tobytes()], "vectors": [vectors.astype(kind).tobytes()]})

    return run


def vector_links(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, found): vec_id, key of all rows; key, id, weight of the classes; a, b, n of links and link counts."""
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 + 0.0 is 0.0.
    rows = rows.withColumn("v", F.when(usable & sound, F.transform("v", lambda x: x + F.lit(0.0))))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.struct("label", F.size("v").alias("d"), F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = scratch.keep(classes, "vector-classes")

    axes: dict[int, np.ndarray] = {}
    for (d,) in classes.select("key.d").distinct().collect():
        sample = classes.where(F.col("key.d") == d).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
        m = np.array([r[0] for r in sample])
        m = m / np.abs(m).max(axis=1, keepdims=True)
        axes[d] = principal_axes(m / np.linalg.norm(m, axis=1, keepdims=True))
    sent = spark.sparkContext.broadcast(axes)
    width = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def place(batches):
        for batch in batches:
            cells = []
            for v in batch.column("v").to_pylist():
                m = np.array(v)
                m = m / np.abs(m).max()
                lead = (m / np.linalg.norm(m)) @ sent.value[len(v)][:, :4]
                cells.append([int(np.floor(x / width)) for x in lead] + [0] * (4 - len(lead)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([c[k] for c in cells], pa.int32()) for k in range(4))], names=["label", "d", "id", "weight", "v", "x", "y", "z", "w"])

    label_type = dict(rows.dtypes)["label"]
    flat = classes.select("key.label", "key.d", "id", "weight", "v")
    placed = scratch.keep(flat.mapInArrow(place, f"label {label_type}, d int, id long, weight long, v array<double>, x int, y int, z int, w int"), "vector-cells")
    cell = ["label", "d", "x", "y"]
    inner = [*cell, "z", "w"]
    # Parts of a cell: all of it under z = w = null, or those of a crowded one.
    crowded = placed.groupBy(cell).count().where(F.col("count") > CROWDED * tile).select(*cell, F.lit(True).alias("crowded"))
    placed = placed.join(broadcast_if_small(crowded, MOST_BROADCAST), cell, "left").withColumns({"z": F.when(F.col("crowded"), F.col("z")), "w": F.when(F.col("crowded"), F.col("w"))})
    placed = placed.withColumn("grp", F.xxhash64(*inner))
    counts = placed.groupBy("grp", *inner).agg(F.ceil(F.count("*") / F.lit(tile)).alias("parts"))
    counts = scratch.keep(counts, "vector-counts")
    several = broadcast_if_small(counts.where("parts > 1").select("grp", "parts"), MOST_BROADCAST)
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1).cast("long")))
    tiles = placed.select("id", "weight", "v", "grp", *inner).join(several, "grp", "left").withColumn("part", part).withColumn("tile", F.xxhash64(*inner, "part"))
    packed = tiles.select("tile", "id", "weight", "v").groupBy("tile").applyInArrow(_pack(kind), "tile long, ids binary, weights binary, vectors binary")
    packed = scratch.keep(packed, "vector-tiles")

    parts = scratch.keep(counts.select(*inner, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("tile", F.xxhash64(*inner, "part")), "vector-parts")
    ahead = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    near = parts.select(F.col("tile").alias("left"), "label", "d", "x", "y", F.col("z").alias("z1"), F.col("w").alias("w1"), F.explode(ahead).alias("s"))
    near = near.select("left", "label", "d", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "z1", "w1", ((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).alias("own"))
    pairs = near.join(parts.select(*cell, F.col("tile").alias("right"), "z", "w"), cell).where("not own or left <= right")
    beside = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= 1, F.lit(True))
    pairs = pairs.where(beside("z", "z1") & beside("w", "w1")).select("left", "right", "d")

    # A tile meets its partners in one task, or in as many as it takes for PARTNERS to each; itself it does not get again.
    pairs = scratch.keep(pairs, "vector-pairs")
    slots = pairs.groupBy("left").agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("slots"))
    pairs = pairs.join(slots, "left").withColumn("slot", F.pmod(F.xxhash64("right"), "slots"))
    own = packed.join(slots.withColumnRenamed("left", "tile"), "tile").select("*", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    columns = ["left", "slot", "d", "their_ids", "their_weights", "their_vectors"]
    others = pairs.where("left <> right").join(packed.toDF("right", *columns[3:]), "right").select(columns)
    others = others.union(pairs.where("left = right").withColumns({c: F.lit(None).cast("binary") for c in columns[3:]}).select(columns))
    others = others.toDF("to_tile", "to_slot", *columns[2:])

    def run(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        opened = lambda row, d, of="": (np.frombuffer(row[f"{of}ids"], "<i8"), np.frombuffer(row[f"{of}weights"], "<i8"), np.frombuffer(row[f"{of}vectors"], kind).astype(np.float64).reshape(-1, d))
        mine = left.to_pylist()[0]
        for row in right.to_pylist() if right.num_rows else ():
            d, same = row["d"], row["their_ids"] is None
            side = [opened(mine, d), opened(mine, d) if same else opened(row, d, "their_")]
            i, j = compare(side[0][2], side[1][2], sent.value[d], threshold)
            if same:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            for (ids, _, _), (_, weights, _), x, y in ((side[0], side[1], i, j), (side[1], side[0], j, i)):
                got = np.bincount(x, weights[y], len(ids)).astype(np.int64)
                found += [(int(ids[k]), None, int(got[k])) for k in np.flatnonzero(got)]
            found += [(a, b, None) for a, b in _forest(zip(side[0][0][i].tolist(), side[1][0][j].tolist()))]
        a, b, n = zip(*found) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    met = own.groupBy("tile", "slot").cogroup(others.groupBy("to_tile", "to_slot")).applyInArrow(run, "a long, b long, n long")
    found = scratch.keep(met, "vector-links")
    scratch.drop("vector-cells", "vector-tiles", "vector-parts", "vector-pairs", "vector-counts")
    return rows.select("vec_id", "key"), classes.select("key", "id", "weight"), found


def vector_components(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    with Scratch(vectors.sparkSession) as scratch:
        rows, classes, found = vector_links(vectors, scratch, threshold)
        of_class = components(found.where("b is not null").select("a", "b"), scratch).select(F.col("node").alias("id"), "component")
        counts = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
        full = classes.join(of_class, "id", "left").join(counts, "id", "left")
        full = materialize(full.select("key", F.coalesce("component", "id").alias("component"), (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n")), "vector-components")
    joined = rows.join(full, "key", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
