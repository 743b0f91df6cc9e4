"""Names, sort keys and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetpulse.functions.numbers import fixed, mb, round_half_up

MISSING = "-"
GC_WAIT = "wait…"


def host_label(host_port: Column, host: Column) -> Column:
    return F.coalesce(F.nullif(host_port, F.lit("")), F.nullif(host, F.lit("")), F.lit(MISSING))


def natural_key(name: Column) -> Column:
    """Text whose plain order is case-insensitive and compares digit runs by value.

    Each digit run becomes its length followed by its digits, so runs of any length compare numerically.
    """
    runs = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def keyed(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=.)", "")
        return F.when(
            run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
        ).otherwise(run)

    return F.array_join(F.transform(runs, keyed), "")


def fixed_text(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", fixed(value, digits))


def _or_missing(value: Column, text: Column, missing: str = MISSING) -> Column:
    return F.when(value.isNull(), F.lit(missing)).otherwise(text)


def int_text(value: Column) -> Column:
    return _or_missing(value, round_half_up(value).cast("string"))


def mb_text(value_mb: Column) -> Column:
    return _or_missing(value_mb, fixed_text(value_mb, 1))


def bytes_as_mb_text(byte_count: Column) -> Column:
    return mb_text(mb(byte_count))


def pct_text(value: Column) -> Column:
    return _or_missing(value, F.concat(fixed_text(value, 1), F.lit("%")))


# Tags behind figures that come from a certain source.
SOURCE_TAGS = {"totalDuration": " (est.)", "OS": " (OS)", "rss": " (rss)"}


def with_source(text: Column, source: Column) -> Column:
    """A figure's text and, for some sources, their tag."""
    tag = F.lit("")
    for name, shown in SOURCE_TAGS.items():
        tag = F.when(source == name, shown).otherwise(tag)
    return F.concat(text, tag)


def seconds_text(value: Column) -> Column:
    return _or_missing(value, fixed_text(value, 1))


def gc_delta_text(ms: Column, missing: str = GC_WAIT) -> Column:
    short = F.concat(fixed_text(ms, 0), F.lit(" ms"))
    long = F.concat(fixed_text(ms / F.lit(1000.0), 2), F.lit(" s"))
    return _or_missing(ms, F.when(ms < 1000, short).otherwise(long), missing)


def short_id(executor_id: Column) -> Column:
    """Last eight characters of a long id."""
    return F.when(F.length(executor_id) > 8, F.right(executor_id, F.lit(8))).otherwise(executor_id)


def csv_field(value: Column) -> Column:
    """Field text, quoted only when it holds a quote, newline, semicolon or comma; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.isNull(), F.lit("")).when(value.rlike('["\n;,]'), quoted).otherwise(value)
