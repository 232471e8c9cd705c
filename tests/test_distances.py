"""Distances, alignments and row numbers against plain tables."""

import random
import time

import pytest
from pyspark.sql import functions as F

from phonoweave.operators import evaluation, similarity

SEGMENTS = ["p", "b", "a", "i", "t͡s", "ŋ", "aː"]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x is None or x != y))
    return row[-1]


def plain_align(left, right):
    d, w = similarity.distance, similarity.weight
    cost = [[0.0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, a in enumerate(left, 1):
        cost[i][0] = cost[i - 1][0] + w(a)
    for j, b in enumerate(right, 1):
        cost[0][j] = cost[0][j - 1] + w(b)
    for i, a in enumerate(left, 1):
        for j, b in enumerate(right, 1):
            cost[i][j] = min(cost[i - 1][j - 1] + d(a, b), cost[i - 1][j] + w(a), cost[i][j - 1] + w(b))
    steps, i, j = [], len(left), len(right)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + d(left[i - 1], right[j - 1]):
            i, j = i - 1, j - 1
            steps.append(("match" if left[i] == right[j] else "substitute", left[i], right[j], d(left[i], right[j])))
        elif i and cost[i][j] == cost[i - 1][j] + w(left[i - 1]):
            i -= 1
            steps.append(("delete", left[i], None, w(left[i])))
        else:
            j -= 1
            steps.append(("insert", None, right[j], w(right[j])))
    return cost[-1][-1], max(cost[-1][0], cost[0][-1]), steps[::-1]


def test_distance_equals_the_table():
    r = random.Random(2)
    for _ in range(400):
        a, b = ([r.choice(["x", "y", "z", None]) for _ in range(r.randrange(90))] for _ in range(2))
        assert evaluation.distance(a, b) == plain_distance(a, b)
    a, b = ([r.choice("abcdefgh") for _ in range(1500)] for _ in range(2))
    began = time.time()
    got = evaluation.distance(a, b)
    assert time.time() - began < 0.5 and got == plain_distance(a, b)


def test_distance_columns(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), (None, ["b"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(evaluation.edit_distance(F.col("a"), F.col("b"))).collect()] == [1, None, 0]


def test_alignments_equal_the_table():
    r = random.Random(5)
    pairs = [tuple([r.choice(SEGMENTS) for _ in range(r.randrange(1, 14))] for _ in range(2)) for _ in range(200)]
    for (a, b), got in zip(pairs, similarity.align_many(*zip(*pairs))):
        distance, most, steps = plain_align(a, b)
        assert got["distance"] == pytest.approx(distance) and got["maximum"] == pytest.approx(most) and got["steps"] == steps
        assert got == similarity.align(a, b)
    assert similarity.align_many([[], ["p"], ["?"], ["p"]], [["p"], [], ["p"], ["p"]])[:3] == ["nothing to compare", "nothing to compare", "no features for '?'"]


def test_alignment_of_long_sequences():
    r = random.Random(6)
    a, b = ([r.choice(SEGMENTS) for _ in range(1500)] for _ in range(2))
    began = time.time()
    similarity.align(a, b)
    assert time.time() - began < 3


@pytest.mark.parametrize("kind", ["long", "string", "struct<a:string,b:int>"])
def test_row_numbers(spark, kind):
    r = random.Random(8)
    # One value holds most rows, one lies far away, some are null.
    values = [5] * 600 + [r.randrange(-(2**62), 2**62) for _ in range(300)] + [2**63 - 1, -(2**63), None, None]
    r.shuffle(values)
    rows = spark.createDataFrame(list(enumerate(values)), "tie long, v long").repartition(6)
    key = {"long": F.col("v"), "string": F.col("v").cast("string"), "struct<a:string,b:int>": F.struct(F.col("v").cast("string").alias("a"), F.lit(1).alias("b"))}[kind]
    placed, n = evaluation.number_rows(rows.withColumn("key", key), ["key", "tie"], "place")
    got = placed.orderBy("place").collect()
    order = (lambda t, v: (v is not None, v or 0, t)) if kind == "long" else (lambda t, v: (v is not None, str(v), t))
    want = sorted(enumerate(values), key=lambda x: order(*x)) if kind != "struct<a:string,b:int>" else sorted(enumerate(values), key=lambda x: (x[1] is not None, str(x[1]), x[0]))
    assert n == len(values) and [x.place for x in got] == list(range(n)) and [(x.tie, x.v) for x in got] == want


def test_name_similarity_query(spark):
    """The registered query against the plain table over each converter's phones."""
    from phonoweave.operators.utterance import Converter, Options
    from phonoweave.plans import engine_queries

    sf = "/root/testdata/sf0.001"
    one = Converter(Options(output="ipa"))
    nations, regions = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("nation", "region"))
    pairs = nations.join(regions, nations["n_regionkey"] == regions["r_regionkey"]).select("n_nationkey", F.initcap("n_name"), F.initcap("r_name")).collect()
    got = {r.n_nationkey: (r.score, r.steps) for r in engine_queries.name_similarity(spark, sf).collect()}
    assert len(got) == len(pairs) > 0
    for key, left, right in pairs:
        distance, most, steps = plain_align(*(one.result(t).base_phones for t in (left, right)))
        score, n = got[key]
        assert score == pytest.approx(min(1.0, max(0.0, 1 - distance / most)), abs=2e-6) and n == len(steps)
