"""Text sources: trial tables, coordinate tables and run logs.

Paths may be folders or globs of any file system Spark reads.  Defined results:
an empty folder gives no rows; byte-identical files are read once, under the
first path; a missing optional column is null; malformed lines keep what their
fields give and null for the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spellings of the trial table's columns.
TRIAL_COLUMNS = {
    "sample": ("sample", "onset_sample", "samples"),
    "sample_offsets": ("sample_offsets", "offset_sample", "offset_samples"),
    "trial_end": ("trial_end", "end_sample"),
    "onset": ("onset", "onset_s", "time"),
    "onset_duration": ("onset_duration", "duration", "dur_s"),
    "condition_name": ("condition_name", "condition", "trial_type"),
    "resp_accuracy": ("resp_accuracy", "accuracy", "correct"),
    "trial_idx": ("trial_idx", "trial", "trial_number"),
}


def first_copies(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, digest`` of the files under ``path``, byte-identical ones once."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.md5("content").alias("digest")).groupBy("digest").agg(F.min("path").alias("path"))


def trial_lines(spark: SparkSession, path: str, pattern: str = "*.tsv", skip: str = "(?i)manual") -> DataFrame:
    """``source, line_no, fields, header``: lines split by the separator that
    their file's first line uses (tab before semicolon before comma), copies and
    manual trigger tables left out."""
    keep = first_copies(spark, path, pattern).filter(~F.element_at(F.split("path", "/"), -1).rlike(skip)).select("path")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    text = raw.join(keep, "path", "left_semi").select("path", F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("t"))
    lines = text.select("path", F.posexplode(F.split("t", "\r?\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    head = lines.groupBy("path").agg(F.min_by("line", "line_no").alias("head"), F.min("line_no").alias("first"))
    sep = F.when(F.col("head").contains("\t"), "\t").when(F.col("head").contains(";"), ";").otherwise(",")
    head = head.select("path", "first", sep.alias("sep"), F.transform(F.split("head", sep), lambda x: F.lower(F.trim(F.regexp_replace(x, '"', "")))).alias("header"))
    j = lines.join(head, "path").filter(F.col("line_no") > F.col("first"))
    return j.select(F.element_at(F.split("path", "/"), -1).alias("source"), "path", "line_no", "header", F.transform(F.split("line", F.col("sep")), lambda x: F.trim(F.regexp_replace(x, '"', ""))).alias("fields"))


def trials(spark: SparkSession, path: str, pattern: str = "*.tsv") -> DataFrame:
    """Trial tables of any separator and column spelling under one schema."""
    l = trial_lines(spark, path, pattern)

    def pick(names: Sequence[str]) -> Column:
        out = F.lit(None).cast("string")
        for n in reversed(list(names)):
            at = F.array_position("header", n).cast("int")
            out = F.when(at > 0, F.get("fields", at - 1)).otherwise(out)
        return F.nullif(out, F.lit(""))

    kind = {"sample": "long", "sample_offsets": "long", "trial_end": "long", "onset": "double", "onset_duration": "double", "trial_idx": "long"}
    cols = [(pick(v).try_cast("double").cast(kind[k]) if kind.get(k) == "long" else pick(v).try_cast(kind[k]) if k in kind else pick(v)).alias(k) for k, v in TRIAL_COLUMNS.items()]
    return l.select("source", "line_no", F.regexp_extract("source", r"^([A-Za-z]+_?\d+)", 1).alias("patient"), *cols)


def manual_triggers(spark: SparkSession, path: str, fs: float, pattern: str = "*manual*") -> DataFrame:
    """Onsets and offsets in samples, given in samples or in seconds."""
    l = trial_lines(spark, path, pattern, skip="^$")

    def value(*names: str) -> Column:
        found = [F.when(F.array_position("header", n) > 0, F.get("fields", F.array_position("header", n).cast("int") - 1).try_cast("double")) for n in names]
        return F.coalesce(*found)

    on = F.coalesce(value("onset_sample", "sample"), value("onset_s", "onset") * fs)
    off = F.coalesce(value("offset_sample", "sample_offsets"), value("offset_s", "offset") * fs)
    return l.select("source", F.round(on).cast("long").alias("onset"), F.round(off).cast("long").alias("offset"))


def onset_files(spark: SparkSession, path: str, prefer: Sequence[str] = ("txt", "tsv")) -> DataFrame:
    """One onset file per folder and stem, by the preferred extension."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rank = F.array_position(F.array(*[F.lit(x) for x in prefer]), ext)
    f = f.select("path", F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "").alias("stem"), rank.alias("r")).filter("r > 0")
    return f.groupBy("stem").agg(F.min_by("path", "r").alias("path"))


def coordinates(spark: SparkSession, path: str, skip: str = "(?i)all_|group") -> DataFrame:
    """Per-patient coordinate tables in one, the aggregate files left out."""
    from ..functions.keys import entity_key

    c = spark.read.option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    c = c.withColumn("source", name).filter(~F.col("source").rlike(skip))
    nums = [F.col(k).try_cast("double").alias(k) for k in ("x", "y", "z")]
    return c.select("source", F.regexp_extract("source", r"^([A-Za-z]+_?\d+)", 1).alias("patient"), F.col("name"), entity_key(F.col("name")).alias("contact"), *nums)


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """``at, patient, stage, status`` of run log lines; lines of another form are left out."""
    v = F.col(value)
    p = lines.select(
        F.regexp_extract(v, r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1).alias("at"),
        F.regexp_extract(v, r"patient=(\w+)", 1).alias("patient"),
        F.regexp_extract(v, r"stage=(\w+)", 1).alias("stage"),
        F.regexp_extract(v, r"status=(\w+)", 1).alias("status"),
    )
    return p.filter("at <> '' and patient <> ''")


def newest_finished(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished log line per patient and stage of the logs under ``path``."""
    p = parse_log(spark.read.option("recursiveFileLookup", "true").text(path)).filter(F.col("status").isin("done", "finished"))
    w = W.partitionBy("patient", "stage").orderBy(F.desc("at"))
    return p.withColumn("no", F.row_number().over(w)).filter("no = 1").drop("no")
