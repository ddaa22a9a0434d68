"""Identifiers, years, months and category labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, non_empty, strip

# The id, month and label formats that stored data use.
NEW_STYLE_ID = r"^(\d{2})\d{2}\.\d{4,5}(?:v\d+)?$"
OLD_STYLE_ID = r"(?i)^[a-z\-]+/(\d{2})\d{2}\d+(?:v\d+)?$"
TITLE_ID = r"arXiv:(\d+\.\d+)"
MONTH_PREFIX = r"^(\d{4})-(\d{2})"
CALENDAR_MONTH = r"^(\d{4}-(?:0[1-9]|1[0-2]))"
COMPACT_DATE = r"^(\d{4})(0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?:T.*)?$"
ISO_INSTANT = (
    r"^(\d{4}-(?:0[1-9]|1[0-2])-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
)
FIRST_OLD_YEAR = 91
INITIAL_LABEL = "init"


def iso_year(c: Column) -> Column:
    """The year an ISO date text starts with; null when it does not start with four digits."""
    return F.when(c.rlike(r"^\d{4}"), F.substring(c, 1, 4).cast("int"))


def year_from_id(c: Column) -> Column:
    """Year text coded in a document id (`yymm.nnnnn` or `archive/yymmnnn`), else null."""
    clean = strip(c)
    new = non_empty(F.regexp_extract(clean, NEW_STYLE_ID, 1))
    old = non_empty(F.regexp_extract(clean, OLD_STYLE_ID, 1))
    century = F.when(old.cast("int") >= FIRST_OLD_YEAR, F.lit("19")).otherwise(F.lit("20"))
    return F.coalesce(F.concat(F.lit("20"), new), F.concat(century, old))


def year_from_path(c: Column) -> Column:
    """First four-digit piece of the parent folder or file stem of a path, else null."""
    parts = F.split(c, "/")
    parent = blank(F.try_element_at(parts, F.lit(-2)))
    stem = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"(.)\.[^.]*$", "$1")
    pieces = F.split(F.concat_ws("-", parent, stem), "[-_]")
    return F.get(F.filter(pieces, lambda p: p.rlike(r"^\d{4}$")), F.lit(0))


def extract_id(c: Column) -> Column:
    """The document id quoted in a discussion title, else null."""
    return non_empty(F.regexp_extract(c, TITLE_ID, 1))


def _first_filled(candidates) -> Column:
    return strip(F.coalesce(*[non_empty(c) for c in candidates]))


def month_bucket(*candidates: Column) -> Column:
    """`YYYY-MM` of the first non-empty candidate, 'unknown' when it is not a date.

    The month is read from the text as written. Going through a timestamp would move a late evening
    with an offset into the next month.
    """
    value = _first_filled(candidates)
    dashed = non_empty(F.regexp_extract(value, CALENDAR_MONTH, 1))
    compact = non_empty(
        F.when(
            value.rlike(COMPACT_DATE),
            F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 5, 2)),
        )
    )
    return F.coalesce(dashed, compact, F.lit("unknown"))


def iso_instant(*candidates: Column) -> Column:
    """The first non-empty candidate as a full ISO time; '' when it is not a date.

    A text that only starts with a month stands for the first instant of that month in UTC.
    """
    value = _first_filled(candidates)

    def part(n: int) -> Column:
        return non_empty(F.regexp_extract(value, ISO_INSTANT, n))

    full = F.concat(
        part(1),
        F.lit("T"),
        F.coalesce(part(2), F.lit("00:00")),
        F.coalesce(part(3), F.lit(":00")),
        F.replace(blank(part(4)), F.lit("Z"), F.lit("+00:00")),
    )
    return F.coalesce(full, month_start(value, F.lit("")), F.lit(""))


def month_order(c: Column) -> Column:
    """Sort key of a month label: `init` first, then by month, anything else last."""
    def pair(year, month):
        return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"))

    return (
        F.when(
            c.rlike(MONTH_PREFIX),
            pair(F.substring(c, 1, 4), F.substring(c, 6, 2)),
        )
        .when(c == INITIAL_LABEL, pair(F.lit(-1), F.lit(-1)))
        .otherwise(pair(F.lit(9999), F.lit(12)))
    )


def month_start(c: Column, fallback: Column) -> Column:
    """First instant of a month label as ISO text in UTC, else `fallback`."""
    month = non_empty(F.regexp_extract(c, CALENDAR_MONTH, 1))
    return F.coalesce(F.concat(month, F.lit("-01T00:00:00+00:00")), fallback)


def label_year(c: Column) -> Column:
    """Year text of a month label, 'unknown' for any other label."""
    return F.coalesce(non_empty(F.regexp_extract(c, MONTH_PREFIX, 1)), F.lit("unknown"))


def category_setspec(c: Column) -> Column:
    """A category such as `cs.AI` in the set notation of the harvest protocol."""
    dot = F.instr(c, ".")
    group = F.substring_index(c, ".", 1)
    rest = F.substring(c, dot + 1, F.length(c))
    expanded = F.when(F.contains(rest, F.lit("-")), F.concat_ws(":", group, rest)).otherwise(
        F.concat_ws(":", group, group, rest)
    )
    return F.when(dot > 0, expanded).otherwise(c)
