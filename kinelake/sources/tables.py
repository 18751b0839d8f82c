"""Recordings as delimited text, and results written with their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.operators.timeline import filled, gaps, spread_blocks, trimmed_to_factor, without_repeated_times
from kinelake.operators.windows import KEY

GRAVITY = 9.81


class GapError(ValueError):
    """Time stamps are not continuous."""


def read_csv(
    spark: SparkSession,
    path: str,
    time_column: str,
    columns: dict[str, str],
    schema: str | None = None,
    time_format: str | None = None,
    tz: str = "UTC",
    whole_seconds: bool = False,
    repeated: str = "keep",
    trim_seconds: int | None = None,
    step: float | None = None,
    fills: dict[str, float] | None = None,
    on_gap: str = "fill",
    conversions: dict[str, float] | None = None,
    accel_in_g: bool = True,
    **options,
) -> DataFrame:
    """Samples (recording_id: the file, sample_idx, t, ...) of delimited files.

    columns maps names in the file to names of samples; those the file lacks are
    left out.  Time stamps are read as the wall clock of `tz`.  repeated: keep
    rows of one time, drop all but the first, or spread them over their second.
    With a step, gaps over 1.5 steps are filled (on_gap "fill", values in fills),
    raise an error ("raise") or stay ("ignore").  conversions divide columns;
    accelerations not in g are divided by gravity.
    """
    reader = spark.read.option("header", True)
    raw = (reader.schema(schema) if schema else reader.option("inferSchema", True)).options(**options).csv(path)
    present = {a: b for a, b in columns.items() if a in raw.columns}
    stamp = F.to_timestamp(F.col(time_column), time_format) if time_format else F.col(time_column).cast("timestamp")
    numeric = dict(raw.dtypes)[time_column] in ("double", "float", "int", "bigint")
    t = F.col(time_column).cast("double") if numeric else F.unix_micros(F.to_utc_timestamp(stamp, tz)) / 1e6
    t = F.floor(t).cast("double") if whole_seconds or repeated == "spread" else t
    divide = dict(conversions or {})
    if not accel_in_g:
        divide |= {c: GRAVITY for c in ("ax", "ay", "az") if c in present.values()}
    values = [(F.col(a).cast("double") / F.lit(float(divide.get(b, 1.0)))).alias(b) for a, b in present.items()]
    # rows of a file are in order of its bytes
    rows = raw.select(F.input_file_name().alias(KEY), F.monotonically_increasing_id().alias("_row"), t.alias("t"), *values).filter("t is not null")
    rows = rows.withColumn("sample_idx", (F.row_number().over(Window.partitionBy(KEY).orderBy("_row")) - 1).cast("long")).drop("_row")
    if trim_seconds:
        rows = trimmed_to_factor(rows, trim_seconds)
    if repeated == "drop":
        rows = without_repeated_times(rows)
    elif repeated == "spread":
        rows = spread_blocks(rows)
    if step is not None and on_gap == "fill":
        rows = filled(rows, step, {c: (fills or {}).get(c, 1.0 if c == "az" else 0.0) for c in present.values()})
    elif step is not None and on_gap == "raise" and gaps(rows, 1.5 * step).limit(1).count():
        raise GapError(f"time stamps lie more than {1.5 * step} s apart")
    return rows


def write_results(df: DataFrame, path: str, metadata: dict[str, str], partition_by: list[str] | None = None) -> None:
    """Delimited results in path, and a small file of metadata beside them."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(f"{path}/results")
    spark = df.sparkSession
    spark.createDataFrame(sorted(metadata.items()), "name string, value string").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/metadata")
