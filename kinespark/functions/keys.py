"""Keys, tags, parsing and formatting: plain Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tested speeds in m/s and the suffix each has in trial file names.
SPEED_SUFFIX = {2.78: "278ms", 3.00: "3ms", 3.33: "333ms", 4.00: "4ms", 5.00: "5ms"}
# Spellings read as true.
TRUE_WORDS = ("true", "1", "yes", "y", "t")


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def require_columns(df: DataFrame, names: Iterable[str], table: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{table}: missing columns {missing}; found {df.columns}")
    return df


def first_present(df: DataFrame, names: Iterable[str]) -> str | None:
    """First of the candidate column names that the table has."""
    return next((n for n in names if n in df.columns), None)


def null_if_nan(value: Column | str) -> Column:
    """NaN and infinities become NULL, so comparisons and aggregates skip them."""
    v = _c(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def clean_floats(df: DataFrame) -> DataFrame:
    """Apply :func:`null_if_nan` to every floating column of a freshly read table."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(*[null_if_nan(F.col(f"`{n}`")).alias(n) if n in floats else F.col(f"`{n}`")
                       for n in df.columns])


def coerce_number(value: Column | str) -> Column:
    """Unparseable text becomes NULL."""
    return null_if_nan(_c(value).cast("string").try_cast("double"))


def truthy(value: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(_c(value).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def speed_key(value: Column | str) -> Column:
    """Speed in cm/s as an integer: the equi-join key for all speed matching."""
    return F.bround(_c(value).cast("double") * 100).cast("int")


def speed_tag(value: Column | str) -> Column:
    """Speed in cm/s with four digits or more."""
    digits = F.bround(null_if_nan(value) * 100).cast("bigint").cast("string")
    return F.coalesce(F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits), F.lit("nan"))


def trial_tag(value: Column | str) -> Column:
    v = F.trim(_c(value).cast("string"))
    return F.when(v.isNull() | F.lower(v).isin("", "nan"), F.lit("00")).otherwise(v)


def speed_suffix(value: Column | str) -> Column:
    """File-name suffix of a tested speed; any other speed is an error."""
    table = F.create_map(*[F.lit(x) for s, t in SPEED_SUFFIX.items() for x in (round(s * 100), t)])
    v = _c(value).cast("double")
    key = F.when(F.abs(v * 100 - F.bround(v * 100)) < 1e-4, speed_key(v))
    return F.coalesce(F.try_element_at(table, F.coalesce(key, F.lit(-1))),
                      F.raise_error(F.concat(F.lit("unexpected speed "), v.cast("string"))).cast("string"))


def condition_speed(value: Column | str) -> Column:
    """``'3.33 m/s'`` to 3.33, anything else to NULL."""
    text = F.regexp_extract(F.trim(_c(value)), r"^(.*)m/s$", 1)
    return F.when(text != "", F.trim(text).try_cast("double"))


def split_list(value: Column | str, sep: str = ";") -> Column:
    parts = F.transform(F.split(_c(value), sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def join_list(value: Column | str, sep: str = ";") -> Column:
    return F.array_join(_c(value), sep)


def seed32(*parts: Column | str) -> Column:
    """CRC-32 of the parts joined by a pipe: a stable unsigned 32-bit seed."""
    return F.crc32(F.concat_ws("|", *[_c(p).cast("string") for p in parts]).cast("binary"))


def pace(value: Column | str) -> Column:
    """Metres per second as minutes:seconds per kilometre."""
    v = null_if_nan(value)
    seconds = F.bround(F.lit(1000.0) / v).cast("int")
    text = F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), seconds % 60)
    return F.when(v > 0, text).otherwise(F.lit("N/A"))


def posix_path(value: Column | str) -> Column:
    return F.replace(_c(value), F.lit("\\"), F.lit("/"))


def first_failed(gates: Iterable[str]) -> Column:
    """Name of the first gate column that is not true, NULL when all pass."""
    return F.coalesce(*[F.when(~F.coalesce(F.col(g), F.lit(False)), F.lit(g)) for g in gates])


def label_index(labels: Column | str, target: str) -> Column:
    """0-based position of a channel label: exact spelling, else ignoring case, else an error."""
    names = _c(labels)
    exact = F.array_position(names, target)
    loose = F.array_position(F.transform(names, lambda x: F.lower(x)), target.lower())
    found = F.when(exact > 0, exact).when(loose > 0, loose)
    return F.coalesce(found, F.raise_error(F.lit(f"label not found: {target}")).cast("bigint")) - 1
