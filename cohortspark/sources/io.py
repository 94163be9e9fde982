"""Sources and sinks."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PREDICTIONS, omop_schema


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A .tsv (tab) or other file (comma) with a header; types as given, so ids stay text."""
    sep = "\t" if path.rstrip("/").removesuffix(".gz").endswith((".tsv", ".txt")) else ","
    return spark.read.schema(_schema(schema)).option("header", True).option("sep", sep).option("enforceSchema", False).csv(path)


def read_tolerant(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, a row with attempts, failures and rate): malformed rows go, and are counted in a pass of their own."""
    schema = _schema(schema)
    rows = spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    marked = spark.read.schema(T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    n, bad = F.count(F.lit(1)), F.count("_bad")
    parsed = F.coalesce(*(F.col(f"`{c}`").cast("string") for c in schema.names))  # Spark wants more than _bad alone
    report = marked.select("_bad", parsed.alias("_row")).agg(n.alias("attempts"), bad.alias("failures"), F.when(n > 0, bad / n).alias("rate"), F.count("_row").alias("_rows")).where("_rows >= 0").drop("_rows")
    return rows, report


def read_omop(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the common data model: Parquet where there is some, else CSV whose malformed rows go."""
    try:
        return spark.read.schema(omop_schema(table)).parquet(f"{folder}/{table}")
    except Exception as e:  # Spark's own class differs between its clients
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return read_tolerant(spark, f"{folder}/{table}.csv", omop_schema(table))[0]


def read_measurements(df: DataFrame, concept_ids: list[int]) -> DataFrame:
    """Five columns of the wanted concepts; on Parquet both reach the scan."""
    wanted = F.col("measurement_concept_id").isin([int(i) for i in concept_ids])
    return df.where(wanted).select("person_id", "measurement_concept_id", "measurement_date", "measurement_datetime", "value_as_number")


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> tuple[int, int]:
    """Writes a table; (rows, columns) as stored."""
    df.write.mode(mode).saveAsTable(name)
    stored = df.sparkSession.table(name)
    return stored.count(), len(stored.columns)


def create_table_from_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with inferred types; fails if it exists."""
    spark.read.option("header", True).option("inferSchema", True).csv(path).write.mode("errorifexists").saveAsTable(name)
    return spark.table(name)


def spec_key(spec: dict | str) -> str:
    return hashlib.sha256(json.dumps(spec, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, spec: dict | str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """What build() gives, kept as Parquet under the key of its spec, with the spec beside it; built anew only on refresh.

    A version is a folder of its own, named by its time, and counts once it is whole; the latest is read. So a refresh leaves
    what others are reading, and a build that fails leaves the version before it.
    """
    path, jvm = f"{folder}/{spec_key(spec)}", spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [] if refresh else [str(x.getPath().getName()) for x in fs.globStatus(jvm.Path(f"{path}/v-*")) or []]
    whole = [v for v in sorted(found) if fs.exists(jvm.Path(f"{path}/{v}/_SUCCESS"))]
    if not whole:
        whole = [f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"]
        _write_json(spark, spec, f"{path}/spec", "ignore")
        build().write.parquet(f"{path}/{whole[0]}")
    return spark.read.parquet(f"{path}/{whole[-1]}")


def _write_json(spark: SparkSession, value, path: str, mode: str = "overwrite") -> None:
    spark.range(1, numPartitions=1).select(F.lit(json.dumps(value, sort_keys=True, default=str)).alias("value")).write.mode(mode).text(path)


def export_matrix(long: DataFrame, studies: DataFrame, spec: dict, folder: str, drop_all_missing: bool = False) -> None:
    """A feature table (study_id, feature, value) as datasets X, mask, meta (study_id, y, tte_days, event), features and spec. The
    table is made once: what is written serves the other datasets."""
    cells = long.select("study_id", "feature", "value")
    if drop_all_missing:
        cells = written(cells)
        features = cells.groupBy("feature").agg(F.count("value").alias("n_observed")).where("n_observed > 0")
        cells = cells.join(features.select("feature"), "feature", "left_semi").select("study_id", "feature", "value")
    cells.write.mode("overwrite").parquet(f"{folder}/X")
    stored = long.sparkSession.read.schema(cells.schema).parquet(f"{folder}/X")
    stored.select("study_id", "feature", F.col("value").isNotNull().cast("byte").alias("observed")).write.mode("overwrite").parquet(f"{folder}/mask")
    studies.write.mode("overwrite").parquet(f"{folder}/meta")
    stored.groupBy("feature").agg(F.count("value").alias("n_observed")).write.mode("overwrite").parquet(f"{folder}/features")
    _write_json(long.sparkSession, spec, f"{folder}/spec")


def export_long(long: DataFrame, path: str, observed_only: bool = True) -> None:
    """As CSV, a file for each partition, in no order."""
    rows = long.where("value is not null and value <> 0") if observed_only else long
    rows.write.mode("overwrite").option("header", True).csv(path)


def export_timeline(timeline: DataFrame, path: str) -> None:
    """As Parquet, unsorted: a global sort is what doesn't fit."""
    timeline.write.mode("overwrite").parquet(path)


def write_events(events: DataFrame, path: str) -> None:
    """As Parquet, and from that as CSV: the events are made once."""
    events.write.mode("overwrite").parquet(f"{path}/parquet")
    stored = events.sparkSession.read.schema(events.schema).parquet(f"{path}/parquet")
    stored.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_by_split(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions of any model, in folders by model and task."""
    df.select(*(F.col(f.name).cast(f.dataType) for f in _schema(PREDICTIONS).fields)).write.mode("append").partitionBy("model", "task").parquet(path)


def load_predictions(spark: SparkSession, path: str, model: str | None = None, task: str | None = None, splits: DataFrame | None = None, split: str | None = None) -> DataFrame:
    df = spark.read.schema(PREDICTIONS).parquet(path)
    for c, want in (("model", model), ("task", task)):
        df = df if want is None else df.where(F.col(c) == want)
    if split is not None:
        df = df.join(splits.where(F.col("split") == split).select("patient_id").distinct(), "patient_id", "left_semi")
    return df


def split_prediction_id(df: DataFrame, c: str) -> DataFrame:
    """patient_id and time of a composite id, 'patient_time'."""
    return df.withColumns({"patient_id": F.substring_index(c, "_", 1).try_cast("long"), "time": F.try_to_timestamp(F.substring_index(c, "_", -1))})


def rewrite(spark: SparkSession, src: str, dst: str, codec: str = "none") -> None:
    spark.read.parquet(src).write.mode("overwrite").option("compression", codec).parquet(dst)


def validate_source(df: DataFrame, required: list[str]) -> DataFrame:
    """A row: rows, missing required columns, whether the header has empty names, and ok."""
    missing = [c for c in required if c not in df.columns]
    unnamed = any(not c.strip() or c.startswith("_c") and c[2:].isdigit() for c in df.columns)
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return rows.select("rows", F.lit(",".join(missing)).alias("missing"), F.lit(unnamed).alias("unnamed"), ((F.col("rows") > 0) & F.lit(not missing and not unnamed)).alias("ok"))


def fuse_sparse(long: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(study_id, indices, values, size, label; the layout): for each study the values (null as 0, left out) at the features'
    places and, after them, 1 for every observed one. The layout (feature, place) is in order of names. long is made once."""
    long = written(long.select("study_id", "feature", "value"))
    layout = numbered(long.select("feature").distinct(), [F.col("feature")], "place").withColumn("place", F.col("place").cast("int"))
    n = layout.count()
    cells = long.where("value is not null").join(layout, "feature")
    rows = cells.groupBy("study_id").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("c"))
    full = F.filter("c", lambda x: x.value != 0)
    out = rows.select("study_id", F.concat(F.transform(full, lambda x: x.place), F.transform("c", lambda x: x.place + n)).alias("indices"), F.concat(F.transform(full, lambda x: x.value), F.transform("c", lambda x: F.lit(1.0))).alias("values"), F.lit(2 * n).alias("size"))
    return labels.join(out, "study_id", "left"), layout


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; without one a local session makes its own, and a
    cluster is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return where


def written(df: DataFrame) -> DataFrame:
    """df written once in the shared folder and read back, for plans that read it twice: unlike a cache it outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place in the order, from 0. Rows are sorted by ranges and written; a part's place in the order and its
    rows' places in it make the number, so no task counts all rows."""
    part = written(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a part
    return part.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")
