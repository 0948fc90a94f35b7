"""Text, number and date normalisation of feed values, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skyframe import constants as K

_BLANKS = " \t\n\r\x0b\x0c"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(_BLANKS))


def optional_string(value: Column) -> Column:
    """Trimmed text; blank becomes null."""
    return F.nullif(strip(value), F.lit(""))


def lenient_double(value: Column) -> Column:
    """Number, or null for unreadable text (JVM suffixes such as 1.5d are text)."""
    text = optional_string(value)
    return F.when(~text.rlike("(?i)[0-9.][df]$"), text.try_cast("double"))


def lenient_date(value: Column) -> Column:
    """ISO date from the first ten characters, or null."""
    head = F.substring(strip(value), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def _strict(value: Column, type_name: str, what: str) -> Column:
    parsed = value.try_cast(type_name)
    return (
        F.when(value.isNull() | (value == ""), F.lit(None).cast(type_name))
        .when(parsed.isNull(), F.raise_error(F.format_string(f"Invalid {what}: %s", value)).cast(type_name))
        .otherwise(parsed)
    )


def strict_double(value: Column) -> Column:
    """Blank is null; bad text fails the job."""
    return _strict(value, "double", "number")


def strict_int(value: Column) -> Column:
    return _strict(value, "int", "integer")


def strict_date(value: Column) -> Column:
    """Date from the first ten characters; blank is null; bad text fails the job."""
    return _strict(F.substring(value, 1, 10), "date", "date")


def strict_epoch(value: Column) -> Column:
    """ISO epoch as a UTC timestamp; ``Z`` accepted, naive text is UTC."""
    parsed = value.try_cast("timestamp")
    return (
        F.when(value.isNull() | (value == ""), F.raise_error(F.lit("record is missing EPOCH")).cast("timestamp"))
        .when(parsed.isNull(), F.raise_error(F.format_string("Invalid EPOCH: %s", value)).cast("timestamp"))
        .otherwise(parsed)
    )


def object_type(value: Column) -> Column:
    """Feed type text to the stored spelling; null and blank are UNKNOWN."""
    text = F.upper(strip(value))
    known = F.create_map(*[F.lit(part) for pair in K.OBJECT_TYPES.items() for part in pair])
    return F.when(text.isNull() | (text == ""), F.lit("UNKNOWN")).otherwise(
        F.coalesce(F.try_element_at(known, text), F.replace(text, F.lit(" "), F.lit("_")))
    )


def display_kind(value: Column) -> Column:
    """One of the four kinds shown to users; anything else is UNKNOWN."""
    text = F.translate(F.upper(strip(F.coalesce(value, F.lit("UNKNOWN")))), " -", "__")
    return F.when(text.isin(*K.DISPLAY_KINDS), text).otherwise(F.lit("UNKNOWN"))


def operational_status(value: Column) -> Column:
    """``label (code)``; an unknown code stays as it is; none is Unknown."""
    labels = F.create_map(*[F.lit(part) for pair in K.OPERATIONAL_STATUS_LABELS.items() for part in pair])
    label = F.try_element_at(labels, value)
    return (
        F.when(value.isNull() | (value == ""), F.lit("Unknown"))
        .when(label.isNull(), value)
        .otherwise(F.concat(label, F.lit(" ("), value, F.lit(")")))
    )


def group_name(value: Column) -> Column:
    """Upper-cased group name; a name outside the allowed form fails the job."""
    name = F.upper(strip(value))
    return F.when(name.rlike(K.GROUP_NAME_PATTERN), name).otherwise(
        F.raise_error(F.format_string("Invalid group name: %s", value)).cast("string")
    )


def nfkc():
    """Unicode compatibility normalisation, which Spark has no expression for."""

    @F.pandas_udf("string")
    def normalise(text: pd.Series) -> pd.Series:
        return text.str.normalize("NFKC")

    return normalise


def bounded_text(value: Column, maximum: int) -> Column:
    """NFKC text without control characters, blanks collapsed, cut to ``maximum``."""
    # Plain ASCII is normalised already and stays out of Python.
    foreign = F.when(value.rlike(r"[^\x00-\x7F]"), value)
    clean = F.regexp_replace(F.coalesce(nfkc()(foreign), value), r"\p{C}", "")
    words = F.trim(F.regexp_replace(clean, r"(?U)\s+", " "))
    return F.nullif(F.trim(F.substring(words, 1, maximum)), F.lit(""))
