"""Labels of runs and samples. Text for people: never compared, joined or stored as a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.sequence import col


def trimmed_number(value: Column | str, decimals: int = 6) -> Column:
    """A number with at most so many decimals and no trailing zeros: 0.5, 10, 0.000001."""
    text = F.format_string(f"%.{decimals}f", col(value).cast("double"))
    return F.when(col(value).isNotNull(), F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""))


def combination_label(**parts: Column | str) -> Column:
    """name=value of each part that isn't null, joined by underscores."""
    shown = [F.when(col(c).isNotNull(), F.concat(F.lit(f"{name}="), trimmed_number(c))) for name, c in parts.items()]
    return F.concat_ws("_", *shown)


def aligner_preset(simulator: Column | str, platform: Column | str) -> Column:
    """map-ont or map-pb for long reads of badread, sr for others."""
    return F.when(F.lower(col(simulator)) == "badread", F.when(F.lower(col(platform)).contains("pacbio"), "map-pb").otherwise("map-ont")).otherwise("sr")


def header_value(header: Column | str, name: str, kind: str = "bigint") -> Column:
    """The value of name= in a record's header; null without it."""
    return F.nullif(F.regexp_extract(col(header), rf"(?:^|\s){name}=(\S+)", 1), F.lit("")).try_cast(kind)
