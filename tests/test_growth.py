"""Work and memory that follow what is distinct, or a batch, and not a table's rows."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from phonoweave.functions import scan
from phonoweave.functions import text as texts
from phonoweave.operators import sandhi
from phonoweave.operators import tokens as T
from phonoweave.plans import text_queries

TEXTS = ["Hello hello world, hello", None, "", "ﬁne ① é ½ 好", "naïve don't don't 中文 hello", "é Ａ"]


def test_equal_runs_are_worked_out_once():
    kind = pa.list_(pa.struct([("text", pa.string()), ("pos", pa.string()), ("tones", pa.list_(pa.string()))]))
    word = lambda t, p, n: {"text": t, "pos": p, "tones": n}
    runs = [[word("不看", "v", ["4", "4"])], None, [word("不看", "v", ["4", "4"])], [word("不看", None, ["4", "4"])], [word("不", "v", ["4"]), word("看", "v", ["4"])], [], None, [word("不看", "v", ["4", None])], [word("不看", "v", ["4", ""])]]
    for made in (pa.array(runs, kind), pa.array([None, *runs, None], kind).slice(1, len(runs))):
        entry, first = sandhi.distinct_runs(made)
        assert [made.take(pa.array(first))[k].as_py() for k in entry.tolist()] == runs and len(first) == 7
    marked = pa.array([[word("a\x1d", "v", ["1", "1"])]] * 2, kind)
    assert len(sandhi.distinct_runs(marked)[1]) == 2


def test_sandhi_of_repeated_runs(spark):
    runs = [[("不看", "v", ["4", "4"])], [("你", "n", ["3"]), ("好", "a", ["3"])], [("一", "m", ["1"]), ("看", "v", ["4"])]] * 5
    df = spark.createDataFrame(list(enumerate(runs)), f"i int, run {sandhi.RUN}").coalesce(1)
    got = {r.i: r.new for r in df.select("i", sandhi.run_sandhi(F.col("run")).alias("new")).collect()}
    want = sandhi.Sandhi().tones([[(t, n, p) for t, p, n in run] for run in runs])
    assert [got[k] for k in range(len(runs))] == want


def test_words_are_counted_where_the_texts_are(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS * 2)), "doc_id int, text string").repartition(2)
    one = Counter((r.doc_id, r.text) for r in T.explode_tokens(df).where("language = 'en'").collect())
    assert {(r.doc_id, r.text): r.n for r in T.count_tokens(df).groupBy("doc_id", "text").agg(F.sum("n").alias("n")).collect()} == dict(one)
    of_all = T.count_tokens(df, keep=()).collect()
    total = Counter()
    for r in of_all:
        total[r.text] += r.n
    assert total == Counter(t for _, t in one.elements()) and len(of_all) < sum(one.values())
    assert T.count_tokens(df.limit(0)).count() == 0


def test_compatibility_spans(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    for r in df.select("i", texts.normalize_compatibility(F.col("text")).alias("r")).collect():
        text, spans = texts.compatibility(TEXTS[r.i] or "")
        assert (r.r.text, [tuple(s) for s in r.r.sources]) == (text, spans)


def test_texts_reach_python_in_bounded_batches(spark, tmp_path):
    spark.createDataFrame([(k, "ab好 " * 900) for k in range(3000)], "doc_id int, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [(k, spark.conf.get(k)) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")]
    try:
        sizes = lambda t: pa.array([sum(len(x.as_py().encode()) for x in t)] * len(t))
        got = text_queries.dealt(spark, str(tmp_path)).coalesce(1).select(F.arrow_udf(sizes, "long")("text").alias("size")).agg(F.max("size"), F.count("*")).first()
        assert got[0] <= 1.1 * (1 << 22) and got[1] == 3000 and scan.SLICE <= 1 << 20
    finally:
        for k, v in kept:
            spark.conf.set(k, v)
