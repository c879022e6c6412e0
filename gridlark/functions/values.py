"""Value rules of a result: JSON-safe values, grid text, exact integers.

Every rule walks the schema and returns column expressions, so it stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The largest integer a 53-bit client holds exactly, and its safe digit count.
SAFE_INTEGER = 9007199254740991
SAFE_DIGITS = 15

Rule = Callable[[Column, T.DataType], "Column | None"]


def quoted(name: str) -> str:
    """Column name as a reference that may hold dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def binary_text(col: Column) -> Column:
    """Binary as text when it is valid UTF-8, otherwise as base64 on one line."""
    encoded = F.regexp_replace(F.base64(col), r"[\r\n]", "")
    return F.coalesce(F.try_validate_utf8(col.cast("string")), encoded)


def _is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def _touched(dtype: T.DataType, leaf: Rule, text_keys: bool) -> bool:
    """Does any value inside this type change under the rule?"""
    if leaf(F.lit(None), dtype) is not None:
        return True
    if isinstance(dtype, T.ArrayType):
        return _touched(dtype.elementType, leaf, text_keys)
    if isinstance(dtype, T.MapType):
        return (text_keys and not _is_text(dtype.keyType)) or _touched(dtype.valueType, leaf, text_keys)
    if isinstance(dtype, T.StructType):
        return any(_touched(f.dataType, leaf, text_keys) for f in dtype.fields)
    return False


def _last_of_each_key(entries: Column) -> Column:
    """Entries without those that a later entry with the same key replaces."""
    return F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
        ),
    )


def rewrite(col: Column, dtype: T.DataType, leaf: Rule, text_keys: bool = False) -> Column:
    """Apply ``leaf`` to every value inside ``col``; untouched branches are passed on as they are."""
    if not _touched(dtype, leaf, text_keys):
        return col
    changed = leaf(col, dtype)
    if changed is not None:
        return changed
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda v: rewrite(v, dtype.elementType, leaf, text_keys))
    if isinstance(dtype, T.MapType):
        return _rewrite_map(col, dtype, leaf, text_keys)
    fields = [
        rewrite(col.getField(f.name), f.dataType, leaf, text_keys).alias(f.name) for f in dtype.fields
    ]
    # A null struct stays null instead of turning into a struct of nulls.
    return F.when(col.isNotNull(), F.struct(*fields))


def _rewrite_map(col: Column, dtype: T.MapType, leaf: Rule, text_keys: bool) -> Column:
    def key(k: Column) -> Column:
        if not text_keys or _is_text(dtype.keyType):
            return k
        return binary_text(k) if isinstance(dtype.keyType, T.BinaryType) else k.cast("string")

    entries = F.transform(
        F.map_entries(col),
        lambda e: F.struct(
            key(e["key"]).alias("key"),
            rewrite(e["value"], dtype.valueType, leaf, text_keys).alias("value"),
        ),
    )
    if text_keys and isinstance(dtype.keyType, T.BinaryType):
        entries = _last_of_each_key(entries)
    return F.map_from_entries(entries)


def _rewrite_all(df: DataFrame, leaf: Rule, text_keys: bool = False) -> DataFrame:
    return df.select(
        *[
            rewrite(df[quoted(f.name)], f.dataType, leaf, text_keys).alias(f.name)
            for f in df.schema.fields
        ]
    )


def _binary_leaf(col: Column, dtype: T.DataType) -> Column | None:
    return binary_text(col) if isinstance(dtype, T.BinaryType) else None


def sanitize(df: DataFrame) -> DataFrame:
    """Make every value JSON-safe at any depth.

    Binary becomes UTF-8 text or else base64, map keys become text, all else is unchanged. Scalar
    map keys follow Spark's cast to string (``true``, ``1.0E20``), binary keys follow the binary
    rule. When two binary keys give the same text the later entry wins.
    """
    return _rewrite_all(df, _binary_leaf, text_keys=True)


def unsafe_integer(col: Column) -> Column:
    """True where an integer does not fit a 53-bit client."""
    return ~col.between(-SAFE_INTEGER, SAFE_INTEGER)


def _exact_leaf(col: Column, dtype: T.DataType) -> Column | None:
    if isinstance(dtype, T.LongType):
        return col.cast("string")
    if isinstance(dtype, T.DecimalType) and dtype.scale == 0 and dtype.precision > SAFE_DIGITS:
        return col.cast("string")
    return None


def exact_integers(df: DataFrame) -> DataFrame:
    """Turn integers of types that can exceed the client's range into text, at any depth.

    A column has one type, so the decision is made per type: LONG, and DECIMAL of scale 0 with more
    than 15 digits. A client that parses JSON decides per value and leaves small ones numbers; here a
    small LONG is text as well. That is a deliberate deviation: ``unsafe_integer`` tells the values that
    need it.
    """
    return _rewrite_all(df, _exact_leaf)


def _json_leaf(col: Column, dtype: T.DataType) -> Column | None:
    if isinstance(dtype, T.BinaryType):
        return binary_text(col)
    if isinstance(dtype, T.DecimalType) and dtype.precision > SAFE_DIGITS:
        return col.cast("string")
    if isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)):
        return col.cast("string")
    return None


# Text form of timestamps in JSON, always in UTC.
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, nested values as nested objects, nulls kept."""
    safe = _rewrite_all(df, _json_leaf, text_keys=True)
    return safe.select(F.to_json(F.struct(F.col("*")), JSON_OPTIONS).alias("json"))


def _plain(text: Column, scale: int) -> Column:
    """Scientific notation written out, without trailing zeros."""
    digits = text.cast(T.DecimalType(38, scale)).cast("string")
    return F.rtrim(F.rtrim(digits, F.lit("0")), F.lit("."))


def number_text(col: Column) -> Column:
    """A double the way a script client prints it: no trailing ``.0``, exponents as ``e+21``."""
    text = col.cast("double").cast("string")
    size = F.abs(col)
    mantissa, power = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2))
    sign = F.when(power.startswith("-"), F.lit("")).otherwise(F.lit("+"))
    return (
        F.when(F.isnan(col) | (size == float("inf")), text)
        .when(size == 0, F.lit("0"))
        .when((size >= 1e-3) & (size < 1e7), F.regexp_replace(text, r"\.0$", ""))
        .when((size >= 1e7) & (size < 1e21), _plain(text, 10))
        .when((size >= 1e-6) & (size < 1e-3), _plain(text, 30))
        .when(col.isNotNull(), F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), sign, power))
    )


def grid_text(df: DataFrame) -> DataFrame:
    """Every cell as text: nested values as JSON, null as the empty string."""

    def cell(col: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            safe = rewrite(col, dtype, _json_leaf, text_keys=True)
            text = F.to_json(safe, JSON_OPTIONS)
        elif isinstance(dtype, T.BinaryType):
            text = binary_text(col)
        elif isinstance(dtype, (T.DoubleType, T.FloatType)):
            text = number_text(col)
        else:
            text = col.cast("string")
        return F.coalesce(text, F.lit(""))

    return df.select(*[cell(df[quoted(f.name)], f.dataType).alias(f.name) for f in df.schema.fields])
