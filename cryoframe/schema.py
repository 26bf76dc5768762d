"""Table contracts: explicit types, and null (never NaN) for a missing value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType(
    [
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("h_elv", T.FloatType()),
        T.StructField("s_elv", T.FloatType()),
        T.StructField("t_year", T.DoubleType()),
        T.StructField("beam", T.ByteType()),
        T.StructField("tide_ocean", T.FloatType()),
        T.StructField("tide_equilibrium", T.FloatType()),
        T.StructField("dac", T.FloatType()),
        T.StructField("geoid", T.FloatType()),
    ]
)

# Columns that keep 64 bits because their last digits carry meaning.
DOUBLE_COLUMNS = ("lon", "lat", "x", "y", "t_year", "delta_time")

# Flag columns that travel with a segment.
FLAG_COLUMNS = (
    "atl06_quality_summary", "segment_id", "sigma_geo_h", "h_robust_sprd", "n_fit_photons",
    "dh_fit_dx", "h_expected_rms", "snr", "snr_significance", "w_surface_window_final",
    "bsnow_conf", "bsnow_od", "bsnow_h", "cloud_flg_asr", "cloud_flg_atm", "msw_flag",
    "r_eff", "solar_elevation", "dem_h", "dem_flag",
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN in a floating column becomes null; Spark would otherwise treat it as a value."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns]
    )


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to a contract; extra columns go, a missing one is an error naming them all."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the input: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def downcast(df: DataFrame, keep: Sequence[str] = DOUBLE_COLUMNS) -> DataFrame:
    """float64 to float32 at rest, except where precision is meaning."""
    return df.select(
        *[
            F.col(f.name).cast("float").alias(f.name)
            if isinstance(f.dataType, T.DoubleType) and f.name not in keep
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def height_column(df: DataFrame) -> str:
    """The most corrected height the table carries."""
    for name in ("h_res", "h_corr", "h_elv", "h"):
        if name in df.columns:
            return name
    raise ValueError("no height column among h_res, h_corr, h_elv, h")
