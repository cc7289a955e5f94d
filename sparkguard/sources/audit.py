"""The audit log: reading day files, appending, exports and metrics snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import ACTIONS, AUDIT, CHECKPOINTS, DECIDED_BY, DERIVED, REQUIRED, TURN_SUMMARY


def derive(rows: DataFrame) -> DataFrame:
    """rows with ts_utc and the derived columns, which replace any of that name."""
    ts = C.utc("ts")
    out = rows.withColumn("ts_utc", ts)
    return out.withColumns(
        {
            "date": F.to_date("ts_utc"),
            "hour": F.hour("ts_utc"),
            "minute": C.minute_text(F.col("ts_utc")),
            "is_block": F.col("action") == "block",
            "is_redact": F.col("action") == "redact",
            "is_flag": F.col("action") == "flag",
            "is_system_event": C.is_system_event(),
            "category": C.category(),
        }
    )


def read_audit(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Rows of the day files audit-YYYY-MM-DD.jsonl below path, derived; torn and invalid lines are skipped.

    since skips the files of earlier days by name, then rows with an earlier ts. A path without files gives no rows.
    """
    try:
        lines = spark.read.schema(AUDIT).option("mode", "PERMISSIVE").json(f"{path}/audit-*.jsonl")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return derive(spark.createDataFrame([], AUDIT))
    if since:
        lines = lines.filter(F.col("_metadata.file_name") >= f"audit-{since[:10]}")
    ok = F.lit(True)
    for name in REQUIRED:
        ok &= F.col(name).isNotNull()
    ok &= F.col("action").isin(*ACTIONS) & F.col("decided_by").isin(*DECIDED_BY) & (F.col("checkpoint").isNull() | F.col("checkpoint").isin(*CHECKPOINTS))
    rows = derive(lines.filter(ok)).filter("ts_utc IS NOT NULL")
    return rows.filter(F.col("ts_utc") >= F.try_to_timestamp(F.lit(since))) if since else rows


def write_audit(rows: DataFrame, path: str) -> None:
    """Append rows with derived columns, one folder per UTC day."""
    derive(rows).write.mode("append").partitionBy("date").parquet(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """Record fields, then derived columns, as CSV with a header."""
    derive(rows).select(*[f.name for f in AUDIT], *DERIVED).write.option("header", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    """Record fields as JSON lines, oldest first."""
    rows.select(*[f.name for f in AUDIT]).orderBy("id").write.option("ignoreNullFields", False).json(path)


def export_turns(rows: DataFrame, path: str) -> None:
    export_csv(rows.filter(F.col("check") == TURN_SUMMARY), path)


def write_snapshot(metrics: DataFrame, path: str) -> None:
    """Replace the latest snapshot and append it to the history; metrics has one row."""
    stamped = metrics.withColumn("taken_at", F.current_timestamp())
    stamped.write.mode("overwrite").json(f"{path}/latest")
    stamped.write.mode("append").parquet(f"{path}/history")


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def union_rows(*parts: DataFrame) -> DataFrame:
    """One audit table of check, tool-decision, system and summary rows."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
