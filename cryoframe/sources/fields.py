"""Gridded fields, moorings and text tables as long DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cryoframe.functions.physics import bearing, freezing_point, practical_salinity
from cryoframe.schema import nan_to_null


def monthly_long(grid: DataFrame, bbox: Mapping[str, float], *, value: str = "ssha", fill: float = 3.0e30, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Observed cells of a monthly grid: fill becomes null, null rows go, the box is on the cell centre."""
    if value not in grid.columns:
        raise ValueError(f"variable {value!r} is missing")
    held = nan_to_null(grid).withColumn(value, F.when(F.abs(value) < fill, F.col(value)))
    return held.where(
        F.col(value).isNotNull()
        & F.col(lon).between(bbox["lon_min"], bbox["lon_max"])
        & F.col(lat).between(bbox["lat_min"], bbox["lat_max"])
    )


def crop_field(field: DataFrame, box: Sequence[float], *, buffer_m: float = 100_000.0, year_start: float | None = None, xy=("x", "y"), time: str = "t_year") -> DataFrame:
    """Rows of a long (time, cell) field inside a buffered box; plain filters, so Parquet prunes on them."""
    x0, x1, y0, y1 = box
    out = field.where(F.col(xy[0]).between(x0 - buffer_m, x1 + buffer_m) & F.col(xy[1]).between(y0 - buffer_m, y1 + buffer_m))
    return out.where(F.col(time) >= year_start) if year_start is not None else out


def colatitude_table(lines: DataFrame, *, text: str = "value") -> DataFrame:
    """``colat lon rate sigma`` lines in mm per year to metres; ``%`` starts a comment."""
    parts = F.split(F.trim(F.col(text)), r"\s+")
    num = lambda i: F.try_element_at(parts, F.lit(i + 1)).try_cast("double")
    return lines.where(~F.col(text).rlike(r"^\s*(%|$)")).select(
        num(0).alias("colat"), num(1).alias("lon"), (num(2) / 1000).alias("vlm"), (num(3) / 1000).alias("vlm_sigma")
    )


def grid_is_complete(grid: DataFrame, a: str = "colat", b: str = "lon") -> DataFrame:
    """One row: axis sizes, rows, and whether every pair occurs exactly once."""
    return grid.agg(F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b"), F.count(F.lit(1)).alias("n")).withColumn(
        "complete", F.col("n") == F.col("n_a") * F.col("n_b")
    )


def require_complete(grid: DataFrame, a: str = "colat", b: str = "lon") -> DataFrame:
    if not grid_is_complete(grid, a, b).first()["complete"]:
        raise ValueError(f"{a} x {b} is not a complete grid")
    return grid


def mosaic(tiles: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Overlapping tiles to one field: per cell the value of the last tile. ``max_by`` combines on the map side."""
    return tiles.groupBy(*keys).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


# Header prefixes of the mooring table and the names they get.
#: How the names of the columns begin.
MOORING_HEADERS = {
    "timestamp": "time", "eastward": "u_cm_s", "northward": "v_cm_s", "temperature": "temperature_c", "conductivity": "conductivity_ms_cm",
}
MOORING_RANGES = {"u_cm_s": (-200.0, 200.0), "v_cm_s": (-200.0, 200.0), "temperature_c": (-3.0, 5.0), "conductivity_ms_cm": (5.0, 70.0)}
MOORING_PRESSURE_DBAR = 521.3


def read_mooring(spark: SparkSession, path: str) -> DataFrame:
    """Records of tab-separated mooring files, every value as text, in columns named by header prefix, with file and rejected.

    Each file has a header of its own, the line whose first field is the timestamp's, so columns may stand in any order
    and be more than are needed. A record whose number of fields is not its header's is kept with nulls and stands whole
    in ``rejected``; the row of units stays, as its timestamp does not parse. A file without a header, or whose header
    lacks a column, is an error.
    """
    lines = spark.read.text(path).where("value <> ''").select(F.col("_metadata.file_path").alias("file"), F.split("value", "\t").alias("fields"), "value")
    is_header = F.startswith(F.lower(F.trim(F.get("fields", F.lit(0)))), F.lit(next(iter(MOORING_HEADERS))))
    headers = lines.where(is_header).groupBy("file").agg(F.min("fields").alias("header"))
    rows = lines.where(~is_header).join(headers, "file", "left")
    place = lambda start: F.array_position(F.transform("header", lambda h: F.startswith(F.lower(F.trim(h)), F.lit(start))), F.lit(True)).cast("int")
    lacking = lambda start: F.raise_error(F.concat(F.lit(f"no column {start!r} in "), F.col("file"))).cast("string")
    whole = F.size("fields") == F.size("header")
    picks = [F.when(F.coalesce(place(start), F.lit(0)) == 0, lacking(start)).when(whole, F.trim(F.get("fields", place(start) - 1))).alias(name) for start, name in MOORING_HEADERS.items()]
    return rows.select("file", *picks, F.when(~whole, F.col("value")).alias("rejected"))


def mooring_audit(records: DataFrame) -> DataFrame:
    """file, n_records, n_rejected, n_undated of rows from :func:`read_mooring`."""
    undated = F.col("rejected").isNull() & F.expr("try_cast(time as timestamp)").isNull()
    return records.groupBy("file").agg(F.count(F.lit(1)).alias("n_records"), F.count("rejected").alias("n_rejected"), F.count_if(undated).alias("n_undated"))


def clean_mooring(
    raw: DataFrame, *, pressure_dbar: float = MOORING_PRESSURE_DBAR, ranges: Mapping[str, tuple[float, float]] = MOORING_RANGES, missing: float = -9000.0
) -> DataFrame:
    """Quality control and derived quantities of a mooring series, one row per time.

    A row outside any physical range goes; of rows with one time the smallest stays, whatever the file order.
    """

    def value(c: str) -> Column:
        v = F.expr(f"try_cast(`{c}` as double)")
        return F.when(v > missing, v).alias(c)

    typed = raw.select(F.expr("try_cast(time as timestamp)").alias("time"), *[value(c) for c in ranges])
    for c, (lo, hi) in ranges.items():
        typed = typed.where(F.col(c).between(lo, hi))
    one = typed.where(F.col("time").isNotNull()).groupBy("time").agg(F.min(F.struct(*ranges)).alias("_m")).select("time", "_m.*")
    return (
        one.withColumn("speed_cm_s", F.hypot("u_cm_s", "v_cm_s"))
        .withColumn("direction_deg", bearing("u_cm_s", "v_cm_s"))
        .withColumn("salinity", practical_salinity("conductivity_ms_cm", "temperature_c", pressure_dbar))
        .withColumn("freezing_c", freezing_point("salinity", F.lit(pressure_dbar)))
        .withColumn("thermal_driving", F.col("temperature_c") - F.col("freezing_c"))
        .withColumn("heat_proxy", F.col("speed_cm_s") / 100 * F.col("thermal_driving"))
    )
