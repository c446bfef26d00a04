"""Writers. All are distributed task-wise writes; nothing goes through the driver."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType


def replace_table(df: DataFrame, name: str, path: str | None = None,
                  bucket_by: tuple[int, str] | None = None) -> DataFrame:
    """Drop-and-recreate a derived table (CTAS). Optionally bucketed so later
    joins on the bucket key skip the shuffle of this side."""
    w = df.write.mode("overwrite").format("parquet")
    if path:
        w = w.option("path", path)
    if bucket_by:
        n, key = bucket_by
        w = w.bucketBy(n, key).sortBy(key)
    w.saveAsTable(name)
    return df.sparkSession.table(name)


def write_json_lines(df: DataFrame, path: str, keep_null_fields: bool = True) -> None:
    """One JSON document per line, UTF-8, non-ASCII kept; old output replaced.
    NULL fields are written as ``null`` like ``json.dump`` does."""
    (df.write.mode("overwrite")
       .option("ignoreNullFields", str(not keep_null_fields).lower())
       .json(path))


def append_log(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("run_id", "type"),
               fmt: str = "parquet") -> None:
    """Append rows to a log table, partitioned by run and type (each task
    writes its own files; readers prune by partition)."""
    w = df.write.mode("append").partitionBy(*partition_by)
    if fmt == "csv":
        w = _csv_options(w)
    w.format(fmt).save(path)


def _csv_options(w):
    # Text is kept byte for byte: quotes doubled, no whitespace trimming
    # (Spark trims by default when writing CSV).
    return (w.option("header", True).option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line in every part file; text kept exactly."""
    _csv_options(df.write.mode(mode)).csv(path)


def fingerprint(df: DataFrame) -> str:
    """A value of the rows and the schema of ``df`` that no order or partitioning
    changes: the count and two sums of 64-bit row hashes, in one aggregation."""
    cols = [F.to_json(c) if isinstance(f.dataType, (MapType, VariantType)) else F.col(f"`{c}`")
            for c, f in zip(df.columns, df.schema.fields)]
    whole = "decimal(38,0)"
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast(whole)),
                     F.sum(F.xxhash64(F.lit("second"), *cols).cast(whole))).first()
    return hashlib.sha256(f"{df.schema.json()}|{n}|{a}|{b}".encode()).hexdigest()[:32]


def stored_once(df: DataFrame, path: str, inputs: list[DataFrame]) -> DataFrame:
    """``df`` computed once for these ``inputs`` and read from ``path`` from then on.

    The rows go to a folder named by the inputs' fingerprint, so changed inputs
    are computed anew and old ones found again. A manifest with the number of rows
    is written last: a folder without it, left by a job that broke off, is
    written again.
    """
    spark = df.sparkSession
    base = f"{path}/inputs={hashlib.sha256('|'.join(map(fingerprint, inputs)).encode()).hexdigest()[:32]}"
    data = spark.read.schema(df.schema)
    if _manifest(spark, base) is None:
        df.write.mode("overwrite").parquet(f"{base}/rows")
        n = data.parquet(f"{base}/rows").count()
        spark.createDataFrame([(n,)], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest")
    return data.parquet(f"{base}/rows")


MANIFEST = "n_rows long"


def _manifest(spark: SparkSession, base: str) -> int | None:
    """The number of rows that a finished folder holds; None if it is not finished."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{base}/manifest").collect()
        found = spark.read.parquet(f"{base}/rows").count()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return rows[0][0] if len(rows) == 1 and rows[0][0] == found else None
