"""The engine: a text column to structured phonetic results, in batch and on streams."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from phonoweave.functions.scan import slices
from phonoweave.operators import similarity
from phonoweave.operators.conversion import Reader, by_word
from phonoweave.operators.utterance import Converter, Options

_SPANS = "array<struct<start:int,end:int>>"
_UNIT = f"struct<text:string,source_spans:{_SPANS},phones:array<string>,rendered:array<string>,alphabet:string,native:string,tone:string,contour:string,stress:array<struct<index:int,stress:int>>,is_unknown:boolean,source_alphabet:string,source_phones:array<string>>"
_TOKEN = f"struct<id:int,text:string,start:int,end:int,language:string,kind:string,boundary:string,pos:string,units:array<{_UNIT}>,backend:string,source_spans:{_SPANS}>"
RESULT = f"original string, normalized string, output string, tokens array<{_TOKEN}>, phones array<string>, base_phones array<string>, warnings array<string>, error string"
#: Bytes of text whose results are in Python's memory at a time.
SLICE = 1 << 18

_CONVERTERS: dict[str, Converter] = {}
_READERS: dict[str, Reader] = {}


def _converter(key: str, options: Options) -> Converter:
    """One for each engine in a Python worker, so that words are looked up once."""
    if key not in _CONVERTERS:
        _CONVERTERS.clear()
        _READERS.clear()
        _CONVERTERS[key] = Converter(options)
    return _CONVERTERS[key]


def _reader(key: str, options: Options) -> Reader:
    converter = _converter(key, options)
    if key not in _READERS:
        _READERS[key] = Reader(converter)
    return _READERS[key]


class Engine:
    """Engine(mode="mandarin", output="native", ...).transform(df, "text"); options are those of Options."""

    def __init__(self, **options):
        self.options, self.key = Options(**options), uuid.uuid4().hex
        #: Whether lines() and summary() go by distinct words.
        self.by_word = by_word(self.options)

    def _column(self, text: Column, make, ddl: str, kind: pa.DataType) -> Column:
        """An Arrow UDF of make(converter, text), a few texts' values at a time."""
        options, engine = self.options, self.key

        def run(texts: pa.Array) -> pa.Array:
            converter = _converter(engine, options)
            parts = [pa.array([make(converter, t) for t in part.to_pylist()], kind) for part in slices(texts, SLICE)]
            return pa.concat_arrays(parts) if parts else pa.array([], kind)

        return F.arrow_udf(run, ddl)(text)

    def _by_word(self, text: Column, make, ddl: str, kind: pa.DataType) -> Column:
        """An Arrow UDF of make(batch): values of many texts from the readings of their distinct words."""
        options, engine = self.options, self.key

        def run(texts: pa.Array) -> pa.Array:
            reader = _reader(engine, options)
            parts = [make(reader.batch(part)) for part in slices(texts)]
            return pa.concat_arrays(parts) if parts else pa.array([], kind)

        return F.arrow_udf(run, ddl)(text)

    def convert(self, text: Column) -> Column:
        """The result of each utterance, as a struct; one Arrow UDF, stateless."""
        return self._column(text, Converter.convert, RESULT, to_arrow_type(StructType.fromDDL(RESULT)))

    def lines(self, text: Column) -> Column:
        """Only the text sink's lines of each utterance, as an array; none where there is an error."""
        kind = pa.list_(pa.string())
        if self.by_word:
            return self._by_word(text, lambda b: b.lines(), "array<string>", kind)
        return self._column(text, lambda c, t: c.result(t).lines(), "array<string>", kind)

    def summary(self, text: Column) -> Column:
        """Only normalized, n_tokens, phones (blanks between), warnings and error of each utterance."""
        ddl = "normalized string, n_tokens int, phones string, n_phones int, warnings array<string>, error string"
        kind = to_arrow_type(StructType.fromDDL(ddl))
        if self.by_word:
            return self._by_word(text, lambda b: pa.StructArray.from_arrays([b.normalized(), b.n_tokens(), b.phones(), b.n_phones(), b.warnings(), b.errors()], fields=list(kind)), ddl, kind)

        def make(converter: Converter, text: str | None) -> dict:
            r = converter.result(text)
            phones = r.phones
            return {"normalized": r.normalized, "n_tokens": len(r.tokens), "phones": " ".join(phones), "n_phones": len(phones), "warnings": r.warnings, "error": r.error}

        return self._column(text, make, ddl, kind)

    def summarize(self, df: DataFrame, text: str = "text", result: str = "result") -> DataFrame:
        """Adds summary() and, in `<result>_by`, which backend answered: first, then, or null where there is an error.

        A fallback is a second step over the same rows: it gets the texts whose first backend failed and nothing for the others, so that
        both go by distinct readings where they can, the input is read once, and no row moves. An error of normalization is no backend's.
        """
        o, by = self.options, f"{result}_by"
        if o.fallback is None:
            done = df.withColumn(result, self.summary(F.col(text)))
            return done.withColumn(by, F.when(F.col(f"{result}.error").isNull(), "first"))
        Converter(o)  # backends that can't go together are found here
        first, then = (Engine(**{**o.__dict__, "backend": b, "fallback": None, "unknown": "strict"}) for b in (o.backend, o.fallback))
        failed = F.coalesce(F.col("_first.error").startswith("BackendError: "), F.lit(False))
        one = df.withColumn("_first", first.summary(F.col(text)))
        two = one.withColumn("_failed", failed).withColumn("_then", then.summary(F.when(failed, F.col(text))))
        named = callable(o.fallback) and not hasattr(o.fallback, "predict")
        second = F.regexp_replace("_then.error", "^BackendError: (custom: )?", "fallback: ") if named else F.regexp_replace("_then.error", "^BackendError: ", "")
        # The same words from both are no backend for Chinese.
        both = F.when(F.col("_then.error") == F.col("_first.error"), F.col("_first.error")).when(F.col("_then.error").startswith("BackendError: "), F.concat("_first.error", F.lit("; "), second)).otherwise(F.col("_then.error"))
        chosen = F.when(F.col("_failed"), F.col("_then").withField("error", both)).otherwise(F.col("_first"))
        who = F.when(F.col(f"{result}.error").isNull(), F.when(F.col("_failed"), "then").otherwise("first"))
        return two.withColumn(result, chosen).withColumn(by, who).drop("_first", "_failed", "_then")

    def failures(self, df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """keep, error: a row for each utterance that can't be converted."""
        options, engine, words = self.options, self.key, self.by_word
        kinds = dict(df.select(*keep).dtypes)

        def run(batches):
            for batch in batches:
                at = 0
                for part in slices(batch.column(len(keep))):
                    if words:
                        errors = _reader(engine, options).batch(part).errors()
                    else:
                        errors = pa.array([_converter(engine, options).result(t).error for t in part.to_pylist()], pa.string())
                    bad = np.flatnonzero(np.asarray(errors.is_valid()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(bad + at)) for k in range(len(keep))), errors.take(pa.array(bad))], names=[*keep, "error"])
                    at += len(part)

        return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "error string"]))

    def transform(self, df: DataFrame, text: str = "text", result: str = "result", strict: bool = False) -> DataFrame:
        """Adds the result; strict: a row with an error fails the job when its phones are read."""
        out = df.withColumn(result, self.convert(F.col(text)))
        if strict:
            phones = F.when(F.col(f"{result}.error").isNotNull(), F.raise_error(F.col(f"{result}.error")).cast("array<string>")).otherwise(F.col(f"{result}.phones"))
            out = out.withColumn(result, F.col(result).withField("phones", phones))
        return out

    def compare(self, df: DataFrame, left: str, right: str, result: str = "similarity") -> DataFrame:
        """Phonetic similarity of two text columns, over IPA without tones and stress."""
        ipa = Engine(**{**self.options.__dict__, "output": "ipa"})
        both = ipa.transform(ipa.transform(df, left, "_left"), right, "_right")
        return both.withColumn(result, similarity.compare(F.col("_left.base_phones"), F.col("_right.base_phones"))).drop("_left", "_right")

    def register(self, spark, name: str = "phones") -> None:
        """A SQL function from a text to its phones, blanks between."""
        options, engine = self.options, self.key

        def run(texts: pa.Array) -> pa.Array:
            converter = _converter(engine, options)
            return pa.array([" ".join(converter.result(t).phones) for t in texts.to_pylist()], pa.string())

        spark.udf.register(name, F.arrow_udf(run, "string"))


def to_lines(df: DataFrame, result: str = "result") -> DataFrame:
    """Text sink: a line `token<TAB>phones` for each token with phones, in `value`; phones as rendered."""
    # Outer: an inner explode would compute the result once more, for a filter.
    t = df.select(F.explode_outer(f"{result}.tokens").alias("t")).select("t.text", F.flatten("t.units.rendered").alias("phones"))
    return t.where(F.size("phones") > 0).select(F.concat_ws("\t", "text", F.array_join("phones", " ")).alias("value"))


def to_json(df: DataFrame, result: str = "result") -> DataFrame:
    """JSON sink: a document for each row, in `value`; a row with an error has only its text and the error."""
    r = F.col(result)

    def unit(u: Column) -> Column:
        digits = F.filter(F.split(u["contour"], ""), lambda d: d != "")
        return F.struct(
            u["text"].alias("text"), u["phones"].alias("base_phones"), u["tone"].alias("tone"), u["alphabet"].alias("alphabet"), u["source_alphabet"].alias("source_alphabet"), u["source_phones"].alias("source_phones"),
            F.transform(digits, lambda d: d.cast("int")).alias("tone_contour"), F.transform(u["stress"], lambda s: F.array(s["index"], s["stress"])).alias("stress_marks"), u["is_unknown"].alias("is_unknown"),
        )

    tokens = F.transform(r["tokens"], lambda t: F.struct(t["text"].alias("text"), t["language"].alias("language"), t["pos"].alias("pos"), F.transform(t["units"], unit).alias("units")))
    done = F.to_json(F.struct(r["original"].alias("text"), r["normalized"].alias("normalized_text"), r["output"].alias("output"), r["phones"].alias("phones"), r["base_phones"].alias("base_phones"), r["warnings"].alias("warnings"), tokens.alias("tokens")), {"ignoreNullFields": "false"})
    return df.select(F.when(r["error"].isNull(), done).otherwise(F.to_json(F.struct(r["original"].alias("text"), r["error"].alias("error")))).alias("value"))
