"""Centroid clustering with Elkan's bounds, exact in integers.

Vectors become integers, floor(64 * x) for each component. The first centroids are the vectors with the smallest hash of their
id; each round assigns every vector to the nearest centroid (ties: the smaller number) and moves each centroid that has
vectors to the exact floor of their mean.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound for each centroid. When centroids
move, bounds follow by the length of the move. A centroid is passed over when the upper bound is strictly below the lower bound,
or strictly below half the distance between the two centroids; so an equal distance is always looked at, and ties stay
exact. Bounds are rounded outwards, decisions use exact integer squares. Vectors and bounds live in packed blocks that
each round reads and writes; nothing is shuffled but sums, and those of a task are added up before they leave it.

Vectors that are null, of another length, or with null or non-finite components are left out. Rows repeated with one vec_id are
vectors of their own (as first centroids by their components); a null vec_id is assigned, but starts no centroid. With
fewer vectors than centroids there are as many as vectors; with none that may start one, cluster and what follows from it
are null. Components beyond 2^27 are computed with whole numbers of any size, without bounds; a distance or inertia beyond 64
bits is null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoweave.llm.common import Scratch, materialize, small_batches

#: Vectors of a block; components up to which squares fit 64 bits.
BLOCK, PLAIN = 512, 1 << 27
#: Sums travel as signed digits of this base.
_DIGIT = 10**17
_STATE = "ids binary, no_id binary, kind string, vectors binary, cluster binary, upper binary, lower binary, sums string"
_OUT, _IN = 1 + 1e-12, 1 - 1e-12


def whole(values: np.ndarray) -> np.ndarray:
    """floor(64 * x) of doubles, as 64-bit integers where squares of differences fit, as Python's integers otherwise."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * 64)
    if not values.size or np.abs(scaled).max() <= PLAIN:
        return scaled.astype(np.int64)
    exact = [int(s) if math.isfinite(s) else int(x) * 64 for s, x in zip(scaled.ravel().tolist(), values.ravel().tolist())]
    return np.array(exact, dtype=object).reshape(values.shape)


def squares(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    away = left - right
    return (away * away).sum(axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * _OUT).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((np.maximum(x, 0) * _IN).astype(np.float32), np.float32(-np.inf))


class Centroids:
    """Positions of one round, distances between them, and how far each has come since the round before."""

    def __init__(self, at: list[list[int]], before: list[list[int]] | None = None):
        biggest = max((abs(x) for c in [*at, *(before or [])] for x in c), default=0)
        self.plain = biggest <= PLAIN
        self.at = np.array(at, dtype=np.int64 if self.plain else object)
        if self.plain and len(at):
            apart = np.stack([squares(self.at, c) for c in self.at])
            self.half = np.sqrt(apart.astype(float)) * (0.5 * _IN)
            np.fill_diagonal(self.half, np.inf)
            self.nearest = self.half.min(axis=1)
            moved = squares(self.at, np.array(before, np.int64)) if before else np.zeros(len(at))
            self.moved = np.sqrt(moved.astype(float)) * _OUT

    def nearest_of_all(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distances to all) by comparison with every centroid."""
        all_squares = np.stack([squares(q, c) for c in self.at], axis=1)
        return all_squares.argmin(axis=1), all_squares

    def assign(self, q: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple:
        """(cluster, upper, lower) of a block; without bounds every centroid is looked at."""
        if not self.plain or q.dtype == object:
            return self.nearest_of_all(q)[0], None, None
        if upper is None:
            cluster, found = self.nearest_of_all(q)
            roots = np.sqrt(found.astype(float))
            return cluster, _up(roots[np.arange(len(q)), cluster]), _down(roots)
        cluster, upper, lower = cluster.copy(), _up(upper + self.moved[cluster]), _down(lower - self.moved)
        rows = np.flatnonzero(upper >= self.nearest[cluster])
        open_ = self._open(rows, cluster, upper, lower)
        rows = rows[open_.any(axis=1)]
        own = squares(q[rows], self.at[cluster[rows]])
        upper[rows] = _up(np.sqrt(own.astype(float)))
        open_ = self._open(rows, cluster, upper, lower)
        best, best_cluster = own.copy(), cluster[rows]
        for j in range(len(self.at)):
            k = np.flatnonzero(open_[:, j])
            if not len(k):
                continue
            found = squares(q[rows[k]], self.at[j])
            lower[rows[k], j] = _down(np.sqrt(found.astype(float)))
            better = (found < best[k]) | ((found == best[k]) & (j < best_cluster[k]))
            best[k[better]], best_cluster[k[better]] = found[better], j
        lower[rows, cluster[rows]] = _down(np.sqrt(own.astype(float)))
        cluster[rows], upper[rows] = best_cluster, _up(np.sqrt(best.astype(float)))
        return cluster, upper, lower

    def _open(self, rows, cluster, upper, lower) -> np.ndarray:
        """Pairs of rows and other centroids that the bounds don't rule out."""
        a, u = cluster[rows], upper[rows, None]
        out = (u >= lower[rows]) & (u >= self.half[a])
        out[np.arange(len(rows)), a] = False
        return out


def _packed(ids, no_id, q, cluster, upper, lower) -> tuple:
    if q.dtype == object:
        kind, raw = "json", json.dumps(q.tolist()).encode()
    else:
        most = int(np.abs(q).max()) if q.size else 0
        kind = "<i1" if most < 128 else "<i2" if most < 1 << 15 else "<i4"
        raw = q.astype(kind).tobytes()
    byte = lambda x, t: None if x is None else x.astype(t).tobytes()
    return ids.astype("<i8").tobytes(), no_id.tobytes(), kind, raw, byte(cluster, "<u4"), byte(upper, "<f4"), byte(lower, "<f4"), None


def _opened(row: dict, width: int, k: int) -> tuple:
    ids, no_id = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["no_id"], bool)
    if row["kind"] == "json":
        q = np.array(json.loads(row["vectors"]), dtype=object)
    else:
        q = np.frombuffer(row["vectors"], row["kind"]).astype(np.int64).reshape(-1, width)
    read = lambda name, t: None if row[name] is None else np.frombuffer(row[name], t)
    lower = read("lower", "<f4")
    return ids, no_id, q, read("cluster", "<u4").astype(np.int64), read("upper", "<f4"), None if lower is None else lower.reshape(-1, k)


class _Sums:
    """Counts and exact component sums of each cluster."""

    def __init__(self, k: int, width: int):
        self.n, self.total = [0] * k, [[0] * width for _ in range(k)]

    def add(self, q: np.ndarray, cluster: np.ndarray) -> None:
        for j in np.unique(cluster).tolist():
            mine = q[cluster == j]
            self.n[j] += len(mine)
            self.total[j] = [a + int(b) for a, b in zip(self.total[j], mine.sum(axis=0))]

    def row(self) -> tuple:
        """Digits: cluster, component (-1 for the count), place, digit."""
        digits = []
        for j, (n, total) in enumerate(zip(self.n, self.total)):
            for c, value in enumerate([n, *total] if n else []):
                sign, value, place = (-1 if value < 0 else 1), abs(value), 0
                while value:
                    value, digit = divmod(value, _DIGIT)
                    digits.append({"j": j, "c": c - 1, "place": place, "digit": sign * digit})
                    place += 1
        return *[None] * 7, json.dumps(digits)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _STATE.split(", ")])


def _moved(state: DataFrame, at: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floors of the means, from digits that Spark adds up."""
    digit = "array<struct<j:int,c:int,place:int,digit:bigint>>"
    flat = state.where("sums is not null").select(F.explode(F.from_json("sums", digit)).alias("s")).select("s.*")
    added = flat.groupBy("j", "c", "place").agg(F.sum(F.col("digit").cast("decimal(20,0)")).alias("digit")).collect()
    found: dict[tuple[int, int], int] = {}
    for j, c, place, value in added:
        found[j, c] = found.get((j, c), 0) + int(value) * _DIGIT**place
    return [[found.get((j, c), 0) // found[j, -1] for c in range(len(old))] if found.get((j, -1)) else old for j, old in enumerate(at)]


def clusters(vectors: DataFrame, k: int = 16, width: int = 64, rounds: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    spark = vectors.sparkSession
    small_batches(spark)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(F.col("embedding").isNotNull() & (F.size("embedding") == width) & sound)
    mark = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").orderBy(mark, "embedding").limit(k).select("embedding").collect()
    start = [[int(x) for x in whole(np.array([r[0]]))[0]] for r in first]
    if not start:
        empty = "cast(null as {}) AS {}"
        return kept.selectExpr("vec_id", *(empty.format(t, c) for t, c in (("int", "cluster"), ("bigint", "distance"), ("bigint", "cluster_inertia"), ("bigint", "inertia"), ("string", "centroid_sha256"))))
    k = len(start)
    centroids = Centroids(start)

    def begin(batches):
        sums, held = _Sums(k, width), []
        for batch in batches:
            ids = batch.column(0)
            no_id, values = np.asarray(ids.is_null()), np.asarray(batch.column(1).flatten(), float).reshape(-1, width)
            numbers = np.asarray(ids.fill_null(0), np.int64)
            for at in range(0, len(values), BLOCK):
                part = slice(at, at + BLOCK)
                q = whole(values[part])
                cluster, upper, lower = centroids.assign(q, None, None, None)
                sums.add(q, cluster)
                held.append(_packed(numbers[part], no_id[part], q, cluster, upper, lower))
            if held:
                yield _batch(held)
            held = []
        yield _batch([sums.row()])

    def again(now: Centroids):
        def run(batches):
            sums = _Sums(k, width)
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    ids, no_id, q, cluster, upper, lower = _opened(row, width, k)
                    cluster, upper, lower = now.assign(q, cluster, upper, lower)
                    sums.add(q, cluster)
                    rows.append(_packed(ids, no_id, q, cluster, upper, lower))
                if rows:
                    yield _batch(rows)
            yield _batch([sums.row()])

        return run

    def last(now: Centroids):
        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    ids, no_id, q, cluster, upper, lower = _opened(row, width, k)
                    cluster, _, _ = now.assign(q, cluster, upper, lower)
                    away = squares(q, now.at[cluster])
                    away = [int(d) if d < 1 << 63 else None for d in away]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=no_id), pa.array(cluster, pa.int32()), pa.array(away, pa.int64())], names=["vec_id", "cluster", "distance"])

        return run

    with Scratch(spark) as scratch:
        state, at = scratch.keep(kept.mapInArrow(begin, _STATE), "centroid-state"), start
        for step in range(rounds):
            before, at = at, _moved(state, at)
            now = Centroids(at, before)
            blocks = state.where("sums is null")
            if step < rounds - 1:
                state = scratch.keep(blocks.mapInArrow(again(now), _STATE), "centroid-state")
            else:
                rows = materialize(blocks.mapInArrow(last(now), "vec_id long, cluster int, distance long"), "centroid-rows")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total"), (F.count("*") == F.count("distance")).alias("all")).collect()
    each = {r.cluster: int(r.total) if r["all"] else None for r in sums}
    fits = lambda x: x if x is not None and x < 1 << 63 else None
    whole_sum = None if None in each.values() else sum(each.values())
    of = [(j, fits(each.get(j, 0)), fits(whole_sum), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(at)]
    # k rows: bounded by the parameter.
    table = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
