"""Point and granule tables: scans, name parsing, consolidation, sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cryoframe.functions.timecols import EPOCH_YEAR, SECONDS_PER_YEAR, year_from_delta
from cryoframe.schema import POINTS, cast_to, downcast, nan_to_null

FILL = 3.0e30
HEIGHT_MIN = -500.0


def scan_points(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-schema scan; the reader never infers, and NaN leaves as null."""
    return nan_to_null(spark.read.schema(POINTS).parquet(path))


def read_columns(spark: SparkSession, path: str, columns: Sequence[str], *, strict: bool = False, narrow: bool = False) -> DataFrame:
    """Only the named columns reach the Parquet reader. Absent ones are skipped unless ``strict``."""
    df = spark.read.parquet(path)
    absent = [c for c in columns if c not in df.columns]
    if strict and absent:
        raise ValueError(f"columns missing from {path}: {', '.join(absent)}")
    picked = nan_to_null(df.select(*[c for c in columns if c in df.columns]))
    return downcast(picked) if narrow else picked


def save_points(df: DataFrame, path: str, *, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Schema-checked write."""
    checked = cast_to(df, POINTS) if not partition_by else df
    checked.write.mode(mode).option("compression", "snappy").partitionBy(*partition_by).parquet(path)


# ------------------------------------------------------------------ file names
def granule_month(name: Column) -> Column:
    """Month from characters 5-6 of the second ``_`` token; null for a malformed name."""
    token = F.regexp_extract(name, r"^[^_]+_(\d{14})(?:_|\.|$)", 1)
    month = F.try_to_number(F.nullif(F.substring(token, 5, 2), F.lit("")), F.lit("99")).cast("int")
    return F.when(month.between(1, 12), month)


def granule_time(name: Column) -> Column:
    """Timestamp in a granule name; a second of 60 counts as 59."""
    p = r"ATL06_(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})"
    part = lambda i: F.nullif(F.regexp_extract(name, p, i), F.lit("")).cast("int")
    return F.try_make_timestamp(part(1), part(2), part(3), part(4), part(5), F.least(part(6), F.lit(59)).cast("double"))


def line_epoch(name: Column) -> Column:
    """Decimal year at the middle of the month, quarter or year a file name states, else null."""
    get = lambda p, i: F.nullif(F.regexp_extract(name, p, i), F.lit("")).cast("double")
    quarter, month, year = r"(?:^|[^0-9])(\d{4})Q([1-4])(?:[^0-9]|$)", r"(?:^|[^0-9])(\d{4})(0[1-9]|1[0-2])(?:[^0-9]|$)", r"(?:^|[^0-9])(\d{4})(?:[^0-9]|$)"
    return (
        F.when(name.rlike(quarter), get(quarter, 1) + (get(quarter, 2) - 0.5) / 4)
        .when(name.rlike(month), get(month, 1) + (get(month, 2) - 0.5) / 12)
        .when(name.rlike(year), get(year, 1) + 0.5)
    )


def in_months(name: Column, months: Sequence[int]) -> Column:
    return granule_month(name).isin(list(months))


# ------------------------------------------------------------------ segments
# Beam names in the order of their numbers.
BEAMS = ("gt1l", "gt1r", "gt2l", "gt2r", "gt3l", "gt3r")


def segment_valid(quality_max: int = 1, fill: float = FILL, h_min: float = HEIGHT_MIN) -> Column:
    """The one validity rule of points and flags, so that their rows stay aligned."""
    h, lat = F.col("h_li").cast("double"), F.col("latitude").cast("double")
    ok = (F.col("atl06_quality_summary") <= quality_max) & (h < fill) & (h > h_min) & ~F.isnan(h) & ~F.isnan(lat) & lat.isNotNull()
    return F.coalesce(ok, F.lit(False))


def normalise_segments(
    raw: DataFrame, *, epoch: float = EPOCH_YEAR, per_year: float = SECONDS_PER_YEAR, fill: float = 1.0e30, flags: Sequence[str] = ()
) -> DataFrame:
    """Flattened segment rows to the point contract. Flags, where asked for, stay in the same row."""
    beams = F.create_map(*[F.lit(v) for i, b in enumerate(BEAMS) for v in (b, i + 1)])
    corr = lambda c: F.when(F.abs(F.col(c)) < fill, F.col(c)) if c in raw.columns else F.lit(None)
    carried = [F.col(c) if c in raw.columns else F.lit(None).cast("float").alias(c) for c in flags]
    return nan_to_null(raw.where(segment_valid())).select(
        F.col("longitude").cast("double").alias("lon"),
        F.col("latitude").cast("double").alias("lat"),
        F.col("h_li").cast("float").alias("h_elv"),
        F.col("h_li_sigma").cast("float").alias("s_elv"),
        year_from_delta("delta_time", epoch, per_year).alias("t_year"),
        F.try_element_at(beams, F.col("beam_name")).cast("tinyint").alias("beam"),
        *[corr(c).cast("float").alias(c) for c in ("tide_ocean", "tide_equilibrium", "dac")],
        corr("geoid_h").cast("float").alias("geoid"),
        *carried,
    )


# ------------------------------------------------------------------ granules
def with_position(df: DataFrame) -> DataFrame:
    """Adds (file, row): the only place where row order carries meaning."""
    return df.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def positional_flags(points: DataFrame, flags: DataFrame, keep: Column, *, file: str = "file", row: str = "row") -> DataFrame:
    """Points whose flag row at the same position passes. A granule whose two row counts differ
    passes whole and is marked ``paired = false``."""
    count = lambda d, c: d.groupBy(file).agg(F.count(F.lit(1)).alias(c))
    equal = count(points, "_a").join(count(flags, "_b"), file).where(F.col("_a") == F.col("_b")).select(file, F.lit(True).alias("paired"))
    judged = flags.select(file, row, F.coalesce(keep, F.lit(False)).alias("_keep"))
    # One row a granule, as many as the listing names: without the hint, all rows of a granule may be sorted in one task.
    return (
        points.join(F.broadcast(equal), file, "left")
        .withColumn("paired", F.coalesce("paired", F.lit(False)))
        .join(judged, [file, row], "left")
        .where(~F.col("paired") | F.coalesce("_keep", F.lit(True)))
        .drop("_keep")
    )


def listed(spark: SparkSession, path: str, *, with_path: bool = False) -> DataFrame:
    """file (and path) of every Parquet file below ``path``: a listing only, no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), *["path"] * with_path)


def _granules(spark: SparkSession, path: str, schema, skip_unreadable: bool) -> DataFrame:
    # A reader keeps the schema it was given, so each scan gets its own.
    reader = spark.read.option("ignoreCorruptFiles", str(skip_unreadable).lower()).option("mergeSchema", "false")
    return with_position((reader.schema(schema) if schema is not None else reader).parquet(path))


def consolidate(
    spark: SparkSession, path: str, *, roi: Mapping[str, float] | None = None, flags_path: str | None = None, flag_keep: Column | None = None, skip_unreadable: bool = False
) -> DataFrame:
    """Union of per-granule files, filtered by flags at the same position and by the region.

    An unreadable file is an error. With ``skip_unreadable`` the others are consolidated without it, and
    :func:`granule_audit` names it; nothing vanishes uncounted.
    """
    pts = nan_to_null(_granules(spark, path, POINTS, skip_unreadable))
    if flags_path and flag_keep is not None:
        pts = positional_flags(pts, _granules(spark, flags_path, None, skip_unreadable), flag_keep)
    if roi:
        pts = pts.where(F.col("lon").between(roi["lon_min"], roi["lon_max"]) & F.col("lat").between(roi["lat_min"], roi["lat_max"]))
    return pts


def footers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, footer_rows, error of Parquet files, read in tasks: a file that is no Parquet has an error in place of a row count."""

    def read(batches):
        import io

        import pandas as pd
        import pyarrow.parquet as pq

        for pdf in batches:
            rows, errors = [], []
            for content in pdf["content"]:
                try:
                    rows.append(pq.ParquetFile(io.BytesIO(content)).metadata.num_rows)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever is wrong with the file is what is asked for
                    rows.append(None)
                    errors.append(f"{type(e).__name__}: {str(e)[:200]}")
            yield pd.DataFrame({"path": pdf["path"], "footer_rows": pd.array(rows, dtype="Int64"), "error": errors})

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInPandas(read, "path string, footer_rows bigint, error string")


def granule_audit(spark: SparkSession, path: str, *, flags_path: str | None = None) -> DataFrame:
    """file, n_rows, n_flags, status, error of every file listed: ``unreadable``, ``empty``, ``no flags``, ``flag rows differ``, ``ok``.

    Rows are counted by reading. Only files that give none are opened once more, to tell one that holds nothing from one
    that cannot be read; their names are part of the listing that the driver holds anyway.
    """
    count = lambda d, c: d.groupBy("file").agg(F.count(F.lit(1)).alias(c))
    out = listed(spark, path, with_path=True).join(count(_granules(spark, path, POINTS, True), "n_rows"), "file", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    without = [r["path"] for r in out.where(F.col("n_rows") == 0).select("path").collect()]
    if without:
        out = out.join(footers(spark, without), "path", "left")
    else:
        out = out.withColumn("footer_rows", F.lit(None).cast("bigint")).withColumn("error", F.lit(None).cast("string"))
    state = F.when((F.col("n_rows") == 0) & (F.col("footer_rows") == 0), "empty").when(F.col("n_rows") == 0, "unreadable")
    if flags_path is None:
        return out.select("file", "n_rows", F.lit(None).cast("bigint").alias("n_flags"), state.otherwise("ok").alias("status"), "error")
    flags = count(_granules(spark, flags_path, None, True), "n_flags")
    state = state.when(F.col("n_flags").isNull(), "no flags").when(F.col("n_flags") != F.col("n_rows"), "flag rows differ").otherwise("ok")
    return out.join(flags, "file", "left").select("file", "n_rows", "n_flags", state.alias("status"), "error")


def exclusion_audit(rows: DataFrame, kept: Column, *, file: str = "file") -> DataFrame:
    """Per file: rows before and after, percent kept, and whether the file is empty afterwards."""
    return (
        rows.groupBy(file)
        .agg(F.count(F.lit(1)).alias("n_before"), F.count_if(kept).alias("n_after"))
        .withColumn("pct_kept", 100.0 * F.col("n_after") / F.col("n_before"))
        .withColumn("excluded", F.col("n_after") == 0)
    )


def pending(listed: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Entries of a list that another list does not name."""
    return listed.join(done.select(key).distinct(), key, "left_anti")


def union_groups(groups: Mapping[str, DataFrame], tag: str = "feature_type") -> DataFrame:
    """Stack groups with a literal tag; a column some groups lack is null there."""
    out = None
    for name, df in groups.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no groups to stack")
    return out


#: Odd multipliers and a prime: a linear hash of integer ids.
HASH_STEPS, HASH_PRIME = (2654435761, 40503, 2246822519, 3266489917), 1_048_573


def bernoulli(df: DataFrame, n: int, total: int, ids: Sequence[str], *, seed: int = 0) -> DataFrame:
    """Keep each row with probability n / total, by arithmetic on its integer ids: the same rows at any partitioning."""
    mixed = sum((F.pmod(F.col(c).cast("bigint") * F.lit(k % HASH_PRIME), F.lit(HASH_PRIME)) * F.lit((k >> 7) % HASH_PRIME) for c, k in zip(ids, HASH_STEPS, strict=False)), F.lit(seed))
    return df.where(F.pmod(mixed, F.lit(HASH_PRIME)) < F.lit(min(1.0, n / total) * HASH_PRIME))


# ------------------------------------------------------------------ sinks and restarts
def write_tiles(tiled: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """One directory per tile, replaced tile by tile."""
    (
        tiled.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
        .partitionBy("tile_i", "tile_j").parquet(path)
    )


def unfinished(units: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work units without a result yet. A unit that produced no rows must still be listed in
    ``finished``, or it would run again on every restart."""
    return units.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def write_result(df: DataFrame, path: str, fmt: str = "parquet", *, mode: str = "errorifexists") -> None:
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown sink format {fmt!r}")
    writer = df.write.mode(mode)
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)
