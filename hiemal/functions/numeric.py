"""Row-level arithmetic, banding and decision helpers."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def all_nan_to_null(df):
    """Replace NaN by null in every floating column; applied once at a source."""
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            df = df.withColumn(f.name, F.when(~F.isnan(f.name), F.col(f.name)))
    return df


def fraction(num: Column, den: Column) -> Column:
    """num/den, null when the denominator is zero or missing."""
    return F.when(den != 0, num / den)


def changed(a: Column, b: Column, tol: float = 0.0) -> Column:
    """True where two nullable numbers differ (null equals null)."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.abs(a - b) > tol).otherwise(a.isNull() != b.isNull())


def first_match(choices: list[tuple[Column, str]], default: str) -> Column:
    """Ordered decision list; the first true condition names the outcome."""
    out = None
    for cond, label in choices:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


# --- unit conversions -------------------------------------------------------
def kelvin_to_celsius(x): return x - F.lit(273.15)
def pascal_to_hecto(x): return x / F.lit(100.0)
def geopotential_to_height(x): return x / F.lit(9.80665)
def metres_to_mm(x): return x * F.lit(1000.0)
def pv_to_pvu(x): return x * F.lit(1.0e6)


def joules_to_watts(x: Column, seconds: float = 3600.0) -> Column:
    return x / F.lit(seconds)


# --- thermodynamics ---------------------------------------------------------
# fixed values: Magnus coefficients, gas constant over gravity, lapse rate
MAGNUS_A, MAGNUS_B = 17.625, 243.04
GAS_OVER_GRAVITY = 287.05 / 9.80665
LAPSE_K_PER_M = 0.0065


def _vapour(t_c: Column) -> Column:
    return F.exp(F.lit(MAGNUS_A) * t_c / (F.lit(MAGNUS_B) + t_c))


def relative_humidity(t_c: Column, td_c: Column) -> Column:
    return F.lit(100.0) * _vapour(td_c) / _vapour(t_c)


def dewpoint_depression(t_c: Column, td_c: Column) -> Column:
    return t_c - td_c


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def pressure_at_height(msl_hpa: Column, t_c: Column, z_m: Column) -> Column:
    """Hypsometric reduction of sea-level pressure through the mean temperature of the column."""
    z = F.coalesce(z_m, F.lit(0.0))
    tv = t_c + F.lit(273.15) + F.lit(LAPSE_K_PER_M) * z / F.lit(2.0)
    return msl_hpa * F.exp(-z / (F.lit(GAS_OVER_GRAVITY) * tv))


# --- bands and labels -------------------------------------------------------
# fixed values: upper bounds (inclusive) of the cold categories, most severe first
COLD_BANDS = ((4.0, "very_severe"), (6.0, "severe"), (8.0, "moderate"), (10.0, "mild"))


def cold_band(x: Column, bands=COLD_BANDS, above: str = "above_cold_wave_threshold") -> Column:
    """Category of a minimum temperature; each upper bound belongs to the colder class."""
    out = F.when(x.isNull(), F.lit("missing"))
    for bound, label in bands:
        out = out.when(x <= bound, F.lit(label))
    return out.otherwise(F.lit(above))


def cold_band_rank(x: Column, bands=COLD_BANDS) -> Column:
    """Severity rank: highest for the most severe band, 0 above all of them, -1 if missing."""
    out = F.when(x.isNull(), F.lit(-1))
    for i, (bound, _) in enumerate(bands):
        out = out.when(x <= bound, F.lit(len(bands) - i))
    return out.otherwise(F.lit(0))


def index_phase(x: Column, limit: float = 0.5, labels=("el_nino", "la_nina", "neutral")) -> Column:
    up, down, mid = labels
    return F.when(x >= limit, up).when(x <= -limit, down).when(x.isNotNull(), mid)


# fixed values: lag classes of a day relative to an event
LAG_CLASSES = ("extended_precursor_minus45_to_minus11", "synoptic_precursor_minus10_to_minus1",
               "event_period", "post_event")


def lag_class(lag: Column, duration: Column, near: int = 10, labels=LAG_CLASSES) -> Column:
    return (
        F.when(lag < -near, labels[0]).when(lag < 0, labels[1])
        .when(lag < duration, labels[2]).otherwise(labels[3])
    )


def duration_group(days: Column) -> Column:
    return F.when(days == 3, "short").when(days >= 6, "persistent").otherwise("intermediate")


def decade_bin(year: Column, first: int = 1985, width: int = 10) -> Column:
    """First year of the fixed-width period a season belongs to."""
    return (F.floor((year - first) / F.lit(width)) * width + first).cast("int")
