"""Numbers, dates, truth values, identifiers and types out of text. What cannot be read gives null."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date patterns in the order they are tried.
DATE_PATTERNS = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "yyyyMMdd"]
TRUE_WORDS = ["true", "yes", "y", "1", "on", "available", "in stock", "enabled", "active"]
FALSE_WORDS = ["false", "no", "n", "0", "off", "unavailable", "out of stock", "disabled", "inactive"]
UNIT_EDGES = [("mm", "m", 0.001, 0.0), ("cm", "m", 0.01, 0.0), ("km", "m", 1000.0, 0.0), ("in", "m", 0.0254, 0.0), ("ft", "in", 12.0, 0.0), ("yd", "ft", 3.0, 0.0), ("mi", "yd", 1760.0, 0.0), ("g", "kg", 0.001, 0.0), ("lb", "kg", 0.45359237, 0.0), ("oz", "lb", 0.0625, 0.0), ("f", "c", 5 / 9, -160 / 9), ("k", "c", 1.0, -273.15)]


def to_number(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d.\-]", "").try_cast("double")


def to_boolean(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(TRUE_WORDS), True).when(low.isin(FALSE_WORDS), False)


def to_date(c: Column, patterns: list[str] | None = None) -> Column:
    """By the first pattern that fits."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(p)) for p in (patterns or DATE_PATTERNS)]).cast("date")


def relative_date(c: Column, as_of: Column) -> Column:
    """'3 days ago' before ``as_of``; a month is 30 and a year 365 days."""
    n = F.regexp_extract(F.lower(c), r"(\d+) (day|week|month|year)s? ago", 1).try_cast("int")
    unit = F.regexp_extract(F.lower(c), r"(\d+) (day|week|month|year)s? ago", 2)
    return F.date_sub(as_of, n * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365))


def is_email(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$")


def is_url(c: Column) -> Column:
    return c.rlike(r"^https?://[^\s/?#]+\.[^\s]+$")


def is_phone(c: Column) -> Column:
    return c.rlike(r"^\+?[0-9][0-9 ().\-]{5,}[0-9]$")


def inferred_type(c: Column) -> Column:
    """empty, integer, number, boolean, date, url, email, json or text."""
    t = F.trim(c)
    return (
        F.when(c.isNull() | (t == ""), "empty").when(t.rlike(r"^-?\d+$"), "integer").when(t.rlike(r"^-?\d*\.\d+$"), "number").when(F.lower(t).isin("true", "false"), "boolean")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), "date").when(is_url(t), "url").when(is_email(t), "email").when(t.rlike(r"^[\[{].*[\]}]$"), "json").otherwise("text")
    )


def isbn13_valid(c: Column) -> Column:
    """Whether the digits of an ISBN-13 have their checksum."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    each = F.filter(F.split(digits, ""), lambda d: d != "")
    total = F.aggregate(F.transform(each, lambda d, i: d.try_cast("int") * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, x: a + x)
    return (F.length(digits) == 13) & (total % 10 == 0)


def split_list(c: Column) -> Column:
    """Comma list to trimmed parts that are not empty."""
    return F.filter(F.transform(F.split(c, ","), F.trim), lambda x: x != "")


def canonical_json(c: Column) -> Column:
    """A flat JSON object with its entries in key order, for hashing."""
    return F.concat_ws(",", F.array_sort(F.transform(F.map_entries(F.from_json(c, "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))))


def is_empty(c: Column) -> Column:
    """Null or a text without characters."""
    return c.isNull() | (F.trim(c.cast("string")) == "")
