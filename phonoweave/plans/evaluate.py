"""Evaluation of the engine over cases with expected readings: scores as a table, a report of them, and a command line.

python -m phonoweave.plans.evaluate [DATASET | --corpus NAME --archive PATH] [--max-cases N --seed N --json --fail-under RATE ...]
"""

from __future__ import annotations

import argparse
import json
import sys
import time
import uuid
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from phonoweave.functions.columns import spread
from phonoweave.operators import evaluation
from phonoweave.operators.utterance import Converter, Options
from phonoweave.sources import corpora

MODES = ("mandarin", "cantonese")
_SPOKEN = "normalized string, units array<struct<native:string,source_spans:array<struct<start:int,end:int>>>>, error string, seconds double, edits array<int>"
#: By evaluation, mode and choice of sandhi.
_CONVERTERS: dict[tuple[str, str | None, bool], Converter] = {}


def spoken(mode: Column, text: Column, tone_sandhi: Column, targets: Column, options: Mapping[str, Mapping] | None = None) -> Column:
    """What the engine says to each text, and the distance of each target's units from those expected: one converter in a worker
    for each mode and choice of sandhi; options by mode."""
    options, key, kind = dict(options or {}), uuid.uuid4().hex, to_arrow_type(StructType.fromDDL(_SPOKEN))

    def converter(of_mode: str, sandhi: bool) -> Converter:
        chosen = key, of_mode, sandhi
        if chosen not in _CONVERTERS:
            if any(k[0] != key for k in _CONVERTERS):
                _CONVERTERS.clear()
            _CONVERTERS[chosen] = Converter(Options(**{"mode": of_mode, "tone_sandhi": sandhi, **options.get(of_mode, {})}))
        return _CONVERTERS[chosen]

    def distances(units: list[dict], wanted: list[dict] | None) -> list[int]:
        out = []
        for t in wanted or []:
            a, b = t["span"] or (0, sys.maxsize)
            mine = units if t["span"] is None else [u for u in units if any(s["start"] < b and a < s["end"] for s in u["source_spans"])]
            out.append(evaluation.distance(t["expected_native"] or [], [u["native"] for u in mine]))
        return out

    def one(of_mode: str | None, value: str | None, sandhi: bool | None, wanted: list[dict] | None) -> dict:
        began = time.perf_counter()
        try:
            r = converter(of_mode, sandhi is not False).result(value)
        except Exception as e:
            return {"normalized": None, "units": [], "error": f"{type(e).__name__}: {e}", "seconds": 0.0, "edits": distances([], wanted)}
        units = [{"native": u.native, "source_spans": [{"start": a, "end": b} for a, b in u.spans]} for t in r.tokens for u in r.units.get(t.id, ())]
        return {"normalized": None if r.error else r.normalized, "units": units, "error": r.error, "seconds": time.perf_counter() - began, "edits": distances(units, wanted)}

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([one(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)

    return F.arrow_udf(run, _SPOKEN)(mode, text, tone_sandhi, targets)


def evaluate(cases: DataFrame, options: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Scores of cases (id, mode, text, tone_sandhi, expected_normalized, expected_native or targets), in a row each.

    A case without targets is one target, its whole text. A unit belongs to every target that its source overlaps. A case
    with an error has none of its units right; `normalized_exact` is null where nothing is expected.
    """
    whole = F.array(F.struct(F.lit(None).cast("array<int>").alias("span"), F.col("text").alias("text"), F.coalesce("expected_native", F.array().cast("array<string>")).alias("expected_native")))
    said = cases.withColumn("_said", spoken(F.col("mode"), F.col("text"), F.coalesce("tone_sandhi", F.lit(True)), F.coalesce("targets", whole), options))
    native = lambda units: F.transform(units, lambda u: u["native"])

    def scored(t: Column) -> Column:
        inside = F.filter(F.col("_said.units"), lambda u: F.exists(u["source_spans"], lambda s: evaluation.overlaps(s["start"], s["end"], F.get(t["span"], 0), F.get(t["span"], 1))))
        actual = F.when(t["span"].isNull(), native(F.col("_said.units"))).otherwise(native(inside))
        return F.struct(t["span"].alias("span"), t["text"].alias("text"), t["expected_native"].alias("expected_native"), actual.alias("actual_native"))

    rows = said.withColumn("_targets", F.transform(F.coalesce("targets", whole), scored))
    rows = rows.withColumn("_edits", F.col("_said.edits"))
    right = F.size(F.filter("_edits", lambda e: e == 0))
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    error = F.col("_said.error")
    expected = F.col("expected_normalized")
    return rows.select(
        "id", "mode", "text", F.when(expected.isNotNull(), F.coalesce(expected == F.col("_said.normalized"), F.lit(False))).alias("normalized_exact"), (error.isNull() & (right == F.size("_edits"))).alias("exact"),
        F.size("_targets").alias("targets"), F.when(error.isNull(), right).otherwise(0).alias("targets_correct"), total(F.col("_edits")).alias("edits"), total(F.transform("_targets", lambda t: F.size(t["expected_native"]))).alias("expected_units"),
        F.col("_said.normalized").alias("actual_normalized"), native(F.col("_said.units")).alias("actual_native"), F.col("_targets").alias("target_results"), F.round(F.col("_said.seconds") * 1000, 3).alias("duration_ms"), error.alias("error"),
    )


def report(scores: DataFrame, name: str, most: int = 100) -> dict:
    """Summary, in all and by mode, and the first failures; the rows that come to the driver are these."""
    began = time.perf_counter()
    whole = evaluation.case_summary(scores).first().asDict()
    seconds = time.perf_counter() - began
    whole |= {"duration_seconds": round(seconds, 6), "cases_per_second": round(whole["cases"] / seconds, 3)}
    by = {r["mode"]: {k: v for k, v in r.asDict().items() if k != "mode"} for r in evaluation.case_summary(scores, "mode").collect()}
    failed = scores.where(evaluation.failed())
    worst = [r.asDict(True) for r in failed.orderBy(F.col("error").isNull(), "id").limit(most).collect()]
    return {"schema_version": 1, "dataset": name, "summary": whole, "by_mode": {m: by[m] for m in MODES if m in by}, "failure_count": failed.count(), "failures": worst}


def lines(of: Mapping) -> str:
    """The report for people."""
    s = of["summary"]
    normalized = f"{s['normalized_exact_rate']:.2%} of {s['normalized_cases']} cases" if s["normalized_cases"] else "no case says"
    out = [
        f"{of['dataset']}: {s['completed']} of {s['cases']} cases completed, {s['cases_per_second']:.2f} a second",
        f"normalized text exact: {normalized}", f"pronunciation exact: {s['pronunciation_exact_rate']:.2%}, targets exact: {s['target_exact_rate']:.2%}, unit errors: {s['unit_error_rate']:.2%}",
    ]
    if of["failure_count"]:
        out.append(f"{len(of['failures'])} of {of['failure_count']} failures:")
        out += [f"  {f['id']}: {f['error'] or 'normalized text differs' * (f['normalized_exact'] is False) or 'pronunciation differs'}" for f in of["failures"]]
    return "\n".join(out)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="phonoweave.plans.evaluate")
    parser.add_argument("dataset", nargs="?")
    parser.add_argument("--corpus", choices=tuple(corpora.CORPORA))
    parser.add_argument("--archive")
    parser.add_argument("--max-cases", type=int)
    parser.add_argument("--seed", type=int, default=0)
    for mode in MODES:
        parser.add_argument(f"--{mode}-backend")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--fail-under", type=float)
    a = parser.parse_args(arguments)
    if (a.dataset is None) == (a.corpus is None):
        parser.error("a dataset or a corpus, one of them")
    if a.corpus and not a.archive:
        parser.error("a corpus needs its --archive")
    if a.max_cases is not None and a.max_cases <= 0:
        parser.error("--max-cases must be positive")
    if a.fail_under is not None and not 0 <= a.fail_under <= 1:
        parser.error("--fail-under must be between 0 and 1")
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        cases = corpora.load_corpus(spark, a.corpus, a.archive) if a.corpus else corpora.load_dataset(spark, a.dataset)
        corpora.require_sound(cases)
    except ValueError as e:
        parser.error(str(e))
    if a.max_cases is not None:
        numbered, n = evaluation.number_rows(cases, ["i", "id"], "_place")
        cases = evaluation.sample(spark, numbered, "_place", n, a.max_cases, a.seed).drop("_place")
    options = {m: {"backend": b} for m in MODES if (b := getattr(a, f"{m}_backend"))}
    # Scored once: the report reads the rows several times.
    scores = evaluate(spread(cases), options).cache()
    try:
        out = report(scores, a.corpus or a.dataset)
    finally:
        scores.unpersist()
    print(json.dumps(out, ensure_ascii=False, indent=2) if a.json else lines(out))
    return int(a.fail_under is not None and out["summary"]["pronunciation_exact_rate"] < a.fail_under)


if __name__ == "__main__":
    sys.exit(main())
