"""Readers of raw tables: every column text, several formats, rejected rows counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json"}


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; nothing is inferred, so every column is text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def texts(df: DataFrame) -> DataFrame:
    """df with every column as text."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """A file of any known format, chosen by its suffix."""
    for suffix, kind in FORMATS.items():
        if path.endswith(suffix):
            return csv(spark, path) if kind == "csv" else spark.read.format(kind).load(path)
    raise ValueError(f"no reader for {path}")


def directory(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """All files of one format in a directory, with the file of each row (source_file); raises if there are none."""
    reader = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True)
    df = reader.option("header", True).csv(path) if suffix == ".csv" else reader.format(FORMATS[suffix]).load(path)
    if not df.columns:
        raise ValueError(f"no {suffix} files in {path}")
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def evolving_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames as text; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [texts(f) for f in frames])


def canonical(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """df under canonical names: for each the first of its aliases that is there, else null; everything as text."""
    have = set(df.columns)
    return df.select(*[next((F.col(f"`{a}`").cast("string") for a in names if a in have), F.lit(None).cast("string")).alias(c) for c, names in aliases.items()])


def nested(df: DataFrame, array: str, fields: list[str], required: list[str], common: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) elements of an array column of structs, beside common columns; rejected ones lack a required field."""
    rows = df.select(*common, F.explode(array).alias("_x")).select(*common, *[F.col(f"_x.{f}").alias(f) for f in fields])
    return accept(rows, required)


def accept(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by whether all required columns have text that is not blank."""
    return df.where(filled(required)), df.where(~filled(required))


def json_lines(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a JSON-lines file. Only a line feed ends a line; malformed lines are rejected with their text."""
    whole = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_malformed", T.StringType())])
    rows = spark.read.text(path, lineSep="\n").where(F.trim("value") != "").select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}).alias("r")).select("r.*")
    good, lacking = accept(rows.where("_malformed is null"), required)
    return good.drop("_malformed"), rows.where("_malformed is not null").unionByName(lacking)


def section_concat(parts: list[Column], separator: str = "\n\n") -> Column:
    """Distinct sections in order, blank ones left out."""
    kept = F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(p), F.lit("")) for p in parts])))
    return F.when(F.size(kept) > 0, F.array_join(kept, separator))


def json_filter(df: DataFrame, column: str, path: str, value: str) -> DataFrame:
    """Rows whose JSON column has a value at a path; text that is no JSON does not."""
    return df.where(F.get_json_object(column, path) == value)


def identity(columns: list[Column]) -> Column:
    """Hash of several values in order; null and empty text differ."""
    return F.sha2(F.concat_ws("|", *[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), c.cast("string"))) for c in columns]), 256)


def row_hash(df: DataFrame) -> Column:
    """Hash of a row as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def with_provenance(df: DataFrame, mapping: dict[str, str], source: str, run: str, observed_at: str, artifact: str) -> DataFrame:
    """df under mapped names with source, run, time and a record id of source, artifact and content.

    Raw columns that would clash with mapped or provenance names get the prefix raw_input__. The id is a content hash, with a number for
    equal rows, so it does not depend on how rows are dealt out.
    """
    taken = {*mapping.values(), "source_id", "run_id", "observed_at", "source_record_id"}
    clash = {c: f"raw_input__{c}" for c in df.columns if c in taken and c not in mapping}
    named = df.withColumnsRenamed(clash | mapping)
    hashed = named.withColumn("_h", row_hash(named))
    from pyspark.sql import Window as W

    number = F.row_number().over(W.partitionBy("_h").orderBy("_h"))
    record = F.concat_ws(":", F.lit(source), F.lit(artifact[:16]), F.substring("_h", 1, 24), number.cast("string"))
    return hashed.withColumns({"source_record_id": record, "source_id": F.lit(source), "run_id": F.lit(run), "observed_at": F.lit(observed_at)}).drop("_h")


def filled(required: list[str]) -> Column:
    """Whether all required columns have text that is not blank."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "" for c in required], F.lit(True))


def import_counted(df: DataFrame, required: list[str], path: str, warnings: dict[str, Column] | None = None) -> dict[str, int]:
    """Writes the accepted rows to a new path and returns the numbers of raw, accepted and rejected rows and of each kind of warning.

    The numbers are observed while the rows are written, so df is read once. Warnings are conditions on accepted rows.
    """
    seen, ok = Observation(), filled(required)
    counts = [F.count(F.lit(1)).alias("raw"), F.count_if("_ok").alias("accepted"), F.count_if(~F.col("_ok")).alias("rejected")]
    counts += [F.count_if(F.col("_ok") & F.coalesce(c, F.lit(False))).alias(n) for n, c in (warnings or {}).items()]
    df.withColumn("_ok", ok).observe(seen, *counts).where("_ok").drop("_ok").write.mode("errorifexists").parquet(path)
    return seen.get


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    return df.groupBy(*keys).agg(F.min(row).alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])
