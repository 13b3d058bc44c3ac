"""Contracts of tables, manifests of imports, and sinks that never overwrite."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """Required columns, and optional ones with the type that an absent one gets."""

    required: tuple[str, ...]
    optional: dict[str, str] = field(default_factory=dict)


def missing(df: DataFrame, contract: Contract) -> list[str]:
    """Required columns that are not there; needs no job."""
    return sorted(set(contract.required) - set(df.columns))


def conform(df: DataFrame, contract: Contract) -> DataFrame:
    """df with absent optional columns as typed nulls; raises if a required one is absent."""
    if gone := missing(df, contract):
        raise ValueError(f"missing columns: {gone}")
    return df.withColumns({c: F.lit(None).cast(t) for c, t in contract.optional.items() if c not in df.columns})


def register(spark: SparkSession, path: str, name: str, contract: Contract) -> DataFrame:
    """A Parquet table as a temporary view that fits its contract."""
    df = conform(spark.read.parquet(path), contract)
    df.createOrReplaceTempView(name)
    return df


def write_once(df: DataFrame, path: str) -> None:
    """Parquet under a new path; raises if the path has data."""
    df.write.mode("errorifexists").parquet(path)


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[dict]:
    """The published versions of a replaceable table, oldest first: number, path, rows. What cannot be read as a whole is not published."""
    fs, at = _files(spark, f"{root}/manifests")
    if not fs.exists(at):
        return []
    out = []
    for number in sorted(int(n) for f in fs.listStatus(at) if (n := f.getPath().getName().removesuffix(".json")).isdigit()):
        text = "\n".join(r["value"] for r in spark.read.text(f"{root}/manifests/{number}.json").collect())
        try:
            out.append({"number": number} | json.loads(text))
        except ValueError:  # its writer was stopped
            continue
    return out


def replace(df: DataFrame, root: str, expected_rows: int | None = None, by: tuple[str, ...] = ()) -> int:
    """Replaces the table at root by df in one step and returns the number of its version.

    The rows are written beside the old ones, counted on the way and again when read back, and published by a small manifest that is
    created only if no other writer has created one of that number. Until then, and if the writer stops anywhere before, readers see the old
    table whole; those that read it already go on doing so until vacuum(). by: columns whose values get a folder each, so that readers of one skip the others.
    """
    spark, seen = df.sparkSession, Observation()
    before = versions(spark, root)
    number, path = (before[-1]["number"] if before else 0) + 1, f"{root}/data/{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*by).parquet(path)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)  # folder names would be read back as other types
    rows, there = seen.get["rows"], spark.read.schema(schema).parquet(path).count()
    if rows != there or expected_rows not in (None, rows):
        raise ValueError(f"{rows} rows were written, {there} are there, {expected_rows} were expected; {root} stays as it was")
    fs, at = _files(spark, f"{root}/manifests/{number}.json")
    while fs.exists(at) and number not in [v["number"] for v in versions(spark, root)]:  # of a writer that was stopped
        number += 1
        fs, at = _files(spark, f"{root}/manifests/{number}.json")
    out = fs.create(at, False)  # fails if another writer was first
    try:
        out.write(bytearray(json.dumps({"path": path, "rows": rows, "schema": schema}).encode()))
    finally:
        out.close()
    return number


def current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the last published version of a replaceable table; raises if there is none."""
    if not (published := versions(spark, root)):
        raise FileNotFoundError(f"nothing is published at {root}")
    last = published[-1]
    return spark.read.schema(last["schema"]).parquet(last["path"]) if "schema" in last else spark.read.parquet(last["path"])


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes what no version but the last keep refers to, also what stopped writers left behind, and returns how many folders that were."""
    stay = {v["path"].rpartition("/")[2] for v in versions(spark, root)[-keep:]}
    fs, at = _files(spark, f"{root}/data")
    gone = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName() not in stay] if fs.exists(at) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report of a few rows as one JSON or CSV file."""
    writer = df.coalesce(1).write.mode("errorifexists")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def artifacts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def new_artifacts(found: DataFrame, manifests: DataFrame, usage: str, allowed: tuple[str, ...] = ("approved",), expected: str | None = None) -> DataFrame:
    """The artifacts that may be imported: not imported before (by sha256), use allowed, and the expected hash if one is given."""
    if usage not in allowed:
        raise PermissionError(f"usage status {usage} does not allow an import")
    fresh = found.join(manifests.select("sha256"), "sha256", "left_anti")
    return fresh.where(F.col("sha256") == expected) if expected else fresh


def merged_manifests(manifests: DataFrame) -> DataFrame:
    """The last manifest of each source and run, by load order."""
    row = F.struct("load_order", *[c for c in manifests.columns if c not in ("source_id", "run_id", "load_order")])
    return manifests.groupBy("source_id", "run_id").agg(F.max(row).alias("_r")).select("source_id", "run_id", "_r.*")


def source_status(registry: DataFrame, manifests: DataFrame, as_of: str, fresh_days: int = 30) -> DataFrame:
    """Per registered source: last import, sum of records, and never, fresh or stale."""
    seen = manifests.groupBy("source_id").agg(F.max("imported_at").alias("last_sync"), F.sum("record_count").alias("record_count"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("last_sync"))
    status = F.when(F.col("last_sync").isNull(), "never").when(age <= fresh_days, "fresh").otherwise("stale")
    return registry.join(seen, "source_id", "left").fillna(0, ["record_count"]).withColumn("status", status)
