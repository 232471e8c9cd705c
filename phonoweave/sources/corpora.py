"""Evaluation data: JSON datasets with checks, the polyphone corpus, the Cantonese corpus, and archive members."""

from __future__ import annotations

import hashlib
import os
import shutil
import urllib.request
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.functions import scripts
from phonoweave.sources import archives

CASES = "array<struct<id:string,mode:string,text:string,expected_normalized:string,tone_sandhi:boolean,expected_native:array<string>,targets:array<struct<span:array<int>,text:string,expected_native:array<string>>>>>"
SCHEMA = f"schema_version int, name string, description string, cases {CASES}"


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A row for each case of a JSON dataset, with `problem`: the first thing wrong with it, null if it is sound."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    rows = raw.select("schema_version", F.posexplode_outer("cases").alias("i", "c")).select("schema_version", "i", "c.*")
    counts = rows.groupBy("id").agg(F.count("*").alias("_same"))
    rows = rows.join(counts, "id", "left")
    ends = lambda t: F.get(t["span"], 1)
    begin = lambda t: F.get(t["span"], 0)
    bad_span = F.exists("targets", lambda t: (F.size(t["span"]) != 2) | (begin(t) < 0) | (ends(t) <= begin(t)) | (ends(t) > F.length("text")))
    other_text = F.exists("targets", lambda t: F.substring(F.col("text"), begin(t) + 1, ends(t) - begin(t)) != t["text"])
    problem = (
        F.when(~F.col("schema_version").eqNullSafe(1), "unsupported schema_version")
        .when(F.col("id").isNull() | (F.col("id") == ""), "no id")
        .when(F.col("_same") > 1, "repeated id")
        .when(~F.coalesce(F.col("mode").isin("mandarin", "cantonese"), F.lit(False)), "unknown mode")
        .when(F.col("text").isNull(), "no text")
        .when(F.col("expected_native").isNull() == F.col("targets").isNull(), "expected_native or targets, exactly one")
        .when(F.coalesce(bad_span, F.lit(False)), "span outside the text")
        .when(F.coalesce(other_text, F.lit(False)), "span and text differ")
    )
    return rows.withColumn("problem", problem).withColumn("tone_sandhi", F.coalesce("tone_sandhi", F.lit(True))).drop("_same")


def polyphones(sentences: DataFrame, labels: DataFrame) -> DataFrame:
    """Cases of the polyphone corpus: `left▁char▁right` lines (i, value) and their labels (i, value)."""
    parts = F.split("value", "▁")
    s = sentences.select("i", parts.alias("p"))
    joined = s.join(labels.select("i", F.col("value").alias("label")), "i", "full_outer")
    target = F.get("p", 1)
    start = F.length(F.get("p", 0))
    sound = (F.size("p") == 3) & (F.length(target) == 1)
    targets = F.array(F.struct(F.array(start, start + 1).alias("span"), target.alias("text"), F.array("label").alias("expected_native")))
    problem = F.when(F.col("label").isNull() | F.col("p").isNull(), "lines and labels differ in number").when(~sound, "one marked character expected")
    return joined.select(
        "i", F.format_string("cpp-test-%05d", F.col("i") + 1).alias("id"), F.lit("mandarin").alias("mode"), F.array_join("p", "").alias("text"),
        F.lit(False).alias("tone_sandhi"), targets.alias("targets"), problem.alias("problem"),
    )


def cantonese(files: DataFrame) -> DataFrame:
    """Cases of a tagged Cantonese corpus; files: name, content with <sent_tag> blocks of `token/pos/jyutping/` lines.

    `i` sorts as the source does, by path (or name) and sentence. Utterances with ASCII letters are left out; a Han token gives a target for each character where the syllables are as many.
    """
    block = F.regexp_extract_all("content", F.lit(r"(?s)<sent_tag>(.*?)</sent_tag>"), F.lit(1))
    line = F.transform(F.split("block", "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    pattern = r"^(.*)/([^/]*)/([^/]*)/$"
    tokens = F.transform(F.filter(line, lambda x: x.rlike(pattern)), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("text"), F.regexp_extract_all(F.lower(F.regexp_extract(x, pattern, 3)), F.lit("[a-z]+[1-6]"), F.lit(0)).alias("jyut")))
    path = F.col("path") if "path" in files.columns else F.col("name")
    rows = files.select("name", path.alias("path"), F.posexplode(block).alias("k", "block")).select("name", "path", tokens.alias("t"), "k").where(F.size("t") > 0)
    text = F.array_join(F.transform("t", lambda x: x["text"]), "")
    before = lambda i: F.aggregate(F.slice("t", 1, i), F.lit(0), lambda a, x: a + F.length(x["text"]))
    usable = lambda x: x["text"].rlike(f"^[{scripts.HAN}]+$") & (F.size(x["jyut"]) == F.length(x["text"]))
    targets = F.flatten(F.transform("t", lambda x, i: F.when(usable(x), F.transform(x["jyut"], lambda s, j: F.struct(F.array(before(i) + j, before(i) + j + 1).alias("span"), F.substring(x["text"], j + 1, F.lit(1)).alias("text"), F.array(s).alias("expected_native")))).otherwise(F.slice(F.transform(x["jyut"], lambda s: F.struct(F.array(F.lit(0), F.lit(0)).alias("span"), s.alias("text"), F.array(s).alias("expected_native"))), 1, 0))))
    cases = rows.select("name", "path", "k", text.alias("text"), targets.alias("targets"))
    return cases.where(~F.col("text").rlike("[A-Za-z]") & (F.size("targets") > 0)).select(F.concat(F.lit("hkcancor-"), "name", F.format_string("-%04d", F.col("k") + 1)).alias("id"), F.lit("cantonese").alias("mode"), "text", "targets", F.struct("path", "k").alias("i"))


def archive_members(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """name, content (UTF-8 text), sha256 of the members of tar and zip archives, a task each; archives nest once.

    A member that is no UTF-8 fails the job when its content is read.
    """
    members = archives.members(spark, path, suffix)
    text = F.decode("content", "UTF-8")
    text = F.when(F.startswith("content", F.lit(b"\xef\xbb\xbf")), F.decode(F.substring("content", F.lit(4), F.length("content")), "UTF-8")).otherwise(text)
    return members.select("name", text.alias("content"), F.sha2("content", 256).alias("sha256"))


def checked_members(members: DataFrame, wanted: Mapping[str, str | None]) -> DataFrame:
    """The members whose names end so, in a column `member`; ValueError if one is missing or has another SHA-256 than given."""
    ends = F.coalesce(*[F.when(F.col("name").endswith(w), F.lit(w)) for w in wanted])
    found = members.withColumn("member", ends).where("member is not null")
    digests = dict(found.select("member", "sha256").collect())
    for name, digest in wanted.items():
        if name not in digests:
            raise ValueError(f"no corpus file {name}")
        if digest is not None and digests[name] != digest:
            raise ValueError(f"{name} has another SHA-256: {digests[name]}, not {digest}")
    return found


def load_polyphones(spark: SparkSession, archive: str, digests: Mapping[str, str] | None = None) -> DataFrame:
    """Cases of the polyphone corpus in its archive: the lines of test.sent and test.lb."""
    members = checked_members(archive_members(spark, archive), {n: (digests or {}).get(n) for n in ("test.sent", "test.lb")})

    def numbered(name: str) -> DataFrame:
        text = F.regexp_replace(F.regexp_replace("content", "\r\n", "\n"), "\n+$", "")
        return members.where(F.col("member") == name).select(F.posexplode(F.split(text, "\n")).alias("i", "value"))

    return polyphones(numbered("test.sent"), numbered("test.lb"))


def load_cantonese(spark: SparkSession, archive: str) -> DataFrame:
    """Cases of the Cantonese corpus: the files below utf8/ in the archive, one inside another."""
    files = archive_members(spark, archive).where("name like 'utf8/%' or name like '%/utf8/%'")
    name = F.regexp_extract("name", "([^/]+?)(?:\\.[^./]*)?$", 1)
    return cantonese(files.select(name.alias("name"), "content", F.col("name").alias("path")))


#: Loaders by name.
CORPORA = {"cpp": load_polyphones, "hkcancor": load_cantonese}


def load_corpus(spark: SparkSession, name: str, archive: str, sha256: str | None = None) -> DataFrame:
    """Cases of a corpus by name, from an archive that may be checked first; ValueError for another name."""
    if name not in CORPORA:
        raise ValueError(f"no corpus {name!r}")
    if sha256 is not None:
        verify_file(archive, sha256)
    cases = CORPORA[name](spark, archive)
    missing = {"expected_normalized": "string", "expected_native": "array<string>", "tone_sandhi": "boolean", "problem": "string"}
    return cases.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in cases.columns})


def require_sound(cases: DataFrame) -> None:
    """ValueError with the first thing wrong with any case."""
    first = cases.where("problem is not null").orderBy("i").select("id", "problem").first()
    if first is not None:
        raise ValueError(f"{first.id}: {first.problem}")


def verify_bytes(data: bytes, sha256: str, label: str) -> None:
    if (digest := hashlib.sha256(data).hexdigest()) != sha256:
        raise ValueError(f"{label} has another SHA-256: {digest}, not {sha256}")


def verify_file(path: str, sha256: str) -> None:
    """ValueError if a file, read piece by piece, has another SHA-256."""
    with open(path, "rb") as f:
        if (digest := hashlib.file_digest(f, "sha256").hexdigest()) != sha256:
            raise ValueError(f"{path} has another SHA-256: {digest}, not {sha256}")


def fetch(url: str, folder: str, name: str, sha256: str) -> str:
    """The path of an archive in a folder: one that is there is checked, else it is copied from the address, checked, and then
    given its name, so that a broken copy never has it."""
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        try:
            with urllib.request.urlopen(url, timeout=60) as source, open(part, "wb") as out:
                shutil.copyfileobj(source, out, 1 << 20)
            verify_file(part, sha256)
            os.replace(part, path)
        finally:
            if os.path.exists(part):
                os.remove(part)
    verify_file(path, sha256)
    return path
