"""Readers: base tables (Parquet or JDBC), preference JSON, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialectic.functions.ordering import order_index
from dialectic.sources import schemas
from dialectic.sources.records import CSV, JSON_VALUES, LINES, read_records


def read_table(spark: SparkSession, path: str, schema=None, fmt: str = "parquet") -> DataFrame:
    """A base table from files; the declared schema is applied when given."""
    r = spark.read.format(fmt)
    if schema is not None and fmt != "parquet":
        r = r.schema(schema)
    df = r.load(path)
    if schema is not None and fmt == "parquet":
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name)
                         for f in schema.fields if f.name in df.columns])
    return df


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, num_partitions: int,
              properties: dict[str, str] | None = None) -> DataFrame:
    """A database table read in parallel range slices (never one cursor).

    ``partition_column`` must be numeric/date; the bounds only shape the
    slices, rows outside them still land in the edge slices.
    """
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=num_partitions,
                           properties=properties or {})


def _parsed_preferences(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """One row per record: ``path, place, raw, row, reason`` and the parsed ``r``."""
    records = read_records(spark, path, JSON_VALUES if multiline else LINES)
    text = F.col("raw").cast("string")
    if multiline:
        # What separates records comes before them; the closing brace was cut off.
        rest = F.regexp_replace(text, r"^[\s,\[\x{FEFF}]+", "")
        records = records.where("whole").unionByName(records.where(~F.col("whole") & ~text.rlike(r"^[\s\[\],\x{FEFF}]*$")))
        text = F.when(F.col("whole"), F.concat(rest, F.lit("}"))).otherwise(rest)
    # As the one element of an array, so that anything behind a record shows.
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), T.ArrayType(schemas.PREFERENCE_JSON))
    d = records.select("path", "place", "raw", "row", "whole", F.is_valid_utf8(F.col("raw").cast("string")).alias("_utf8"),
                       parsed.alias("_p"))
    r = F.when(F.col("whole") & (F.size("_p") == 1), F.get("_p", F.lit(0)))
    reason = (F.when(~F.col("_utf8"), "invalid_utf8").when(F.col("r").isNull(), "malformed_json")
              .when(F.col("r.prompt").isNull(), "null_prompt"))
    return d.withColumn("r", r).select("path", "place", "raw", "row", reason.alias("reason"), "r")


def load_preferences(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Preference records ``{prompt, chosen, rejected}`` from JSON with a dense
    ``row_id`` that keeps the files' row order (the order is meaningful:
    positions, first-occurrence dedup and group order all depend on it).

    One record per line; ``multiline=True`` takes records of any layout instead,
    in arrays or one behind another. Both are split among tasks. A record that
    is not JSON or not UTF-8 raises, as the original's loader does; see
    ``load_preferences_checked`` for one that goes on.
    """
    d = _parsed_preferences(spark, path, multiline)
    bad = F.col("reason").isin("malformed_json", "invalid_utf8")
    what = F.concat_ws("", "reason", F.lit(" at byte "), F.col("place").cast("string"), F.lit(" of "), "path")
    d = d.where(F.when(bad, F.raise_error(what).cast("boolean")).otherwise(F.lit(True)))
    return d.select(F.col("row").alias("row_id"), "r.*")


def load_preferences_checked(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` of the records ``load_preferences`` reads.

    ``good``: ``row_id`` (dense over the good ones), ``record`` (over all), and the
    three fields. ``bad``: ``record, path, place`` (the byte where it begins),
    ``reason`` (``malformed_json``, ``invalid_utf8``, ``null_prompt``) and the ``raw`` bytes.
    """
    d = _parsed_preferences(spark, path, multiline).withColumnRenamed("row", "record").checkpoint(eager=True)
    bad = d.where(F.col("reason").isNotNull()).select("record", "path", "place", "reason", "raw")
    good = d.where(F.col("reason").isNull()).select("record", "r.*")
    if bad.limit(1).count():
        good = good.join(order_index(good.select("record"), ["record"], out="row_id"), "record")
    else:
        good = good.withColumn("row_id", F.col("record"))
    return good.select("row_id", "record", "prompt", "chosen", "rejected"), bad


def read_sample_log(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Per-sample metric log written by :func:`dialectic.sources.sinks.append_log`."""
    if fmt == "csv":
        return read_csv(spark, path, schemas.SAMPLE_LOG)
    return spark.read.schema(schemas.SAMPLE_LOG).format(fmt).load(path)


CSV_OPTIONS = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "FAILFAST"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV written by :func:`dialectic.sources.sinks.write_csv` (a header in every
    file, quoted multi-line text, no trimming), with a declared schema. Large
    files are split among tasks. Columns of the schema that are partition
    folders are taken from the paths. A quote that stays open at the end of a file,
    or a value of another type, raises.
    """
    folders = set(spark.read.text(path).columns) - {"value"}
    data = T.StructType([f for f in schema.fields if f.name not in folders])
    records = read_records(spark, path, CSV)
    text = F.regexp_replace(F.col("raw").cast("string"), r"^[\r\n]+", "")
    what = F.concat_ws("", F.lit("open quote at byte "), F.col("place").cast("string"), F.lit(" of "), "path")
    blank = F.trim(F.translate(F.col("raw").cast("string"), "\r\n\t", "")) == ""
    records = records.where(F.when(F.col("whole"), F.col("number") > 0).when(blank, F.lit(False)).otherwise(
        F.raise_error(what).cast("boolean")))
    # A header is no row even where a later filter is evaluated before this one.
    line = F.when(F.col("whole") & (F.col("number") > 0), F.regexp_replace(text, r"\r$", ""))
    row = records.select("path", F.from_csv(line, _ddl(data), CSV_OPTIONS).alias("r"))
    return row.select(*[_folder_value(f) if f.name in folders else F.col("r")[f.name].alias(f.name) for f in schema.fields])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _folder_value(f: T.StructField) -> F.Column:
    """A partition folder's value; file paths are URIs, so it is escaped twice."""
    value = F.regexp_extract("path", f"/{f.name}=([^/]*)/", 1)
    for _ in range(2):
        value = F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    return F.when(value != "__HIVE_DEFAULT_PARTITION__", value).cast(f.dataType).alias(f.name)
