"""Names, addresses and identifiers of people and firms: Column in, STRUCT or string out; null in gives null out."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles before and marks after a name.
TITLES = "mr|mrs|ms|miss|dr|prof|sir"
SUFFIXES = "jr|sr|ii|iii|iv|phd|md|esq"


def name_parts(c: Column) -> Column:
    """STRUCT<title, given, middle, family, suffix> of 'Title Given Middle Family Suffix' or 'Family, Given Middle'."""
    tidy = F.trim(F.regexp_replace(c, r"[\s\x{a0}]+", " "))
    turned = F.when(tidy.rlike(rf"(?i)^[^,]+, (?!(?:{SUFFIXES})\.?$)"), F.regexp_replace(tidy, r"^([^,]+), (.+)$", "$2 $1")).otherwise(F.replace(tidy, F.lit(","), F.lit("")))
    title = F.nullif(F.regexp_extract(turned, rf"(?i)^({TITLES})\.? ", 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract(turned, rf"(?i) ({SUFFIXES})\.?$", 1), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(turned, rf"(?i)^(?:{TITLES})\.? ", ""), rf"(?i) (?:{SUFFIXES})\.?$", "")
    parts = F.split(bare, " ")
    n = F.size(parts)
    middle = F.when(n > 2, F.array_join(F.slice(parts, F.lit(2), n - 2), " "))
    return F.struct(title.alias("title"), F.nullif(F.get(parts, F.lit(0)), F.lit("")).alias("given"), middle.alias("middle"), F.when(n > 1, F.element_at(parts, -1)).alias("family"), suffix.alias("suffix"))


def address_parts(c: Column) -> Column:
    """STRUCT<street, city, state, zip> of 'street, city, ST 12345[-6789]'; null fields where the form differs."""
    form = r"^\s*(.+?),\s*([^,]+),\s*([A-Za-z]{2})\s+(\d{5}(?:-\d{4})?)\s*$"
    part = lambda k: F.nullif(F.regexp_extract(c, form, k), F.lit(""))
    return F.struct(part(1).alias("street"), part(2).alias("city"), F.upper(part(3)).alias("state"), part(4).alias("zip"))


def identifier_kind(c: Column) -> Column:
    """'uuid', 'isbn13', 'isbn10', 'ean', 'email', 'url' or 'other' by the form of an identifier; the check digits of codes count."""
    bare = F.regexp_replace(F.upper(c), r"[\s\-]", "")
    digits = F.transform(F.split(bare, ""), lambda x: x.try_cast("int"))
    check13 = F.pmod(F.aggregate(F.transform(digits, lambda x, i: F.coalesce(x, F.lit(0)) * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, x: a + x), F.lit(10)) == 0
    check10 = F.pmod(F.aggregate(F.transform(F.split(bare, ""), lambda x, i: F.when(x == "X", 10).otherwise(F.coalesce(x.try_cast("int"), F.lit(0))) * (10 - i)), F.lit(0), lambda a, x: a + x), F.lit(11)) == 0
    kind = F.when(c.rlike(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"), "uuid").when(bare.rlike(r"^97[89]\d{10}$") & check13, "isbn13").when(bare.rlike(r"^\d{13}$") & check13, "ean").when(bare.rlike(r"^\d{9}[\dX]$") & check10, "isbn10")
    return F.when(c.isNotNull(), kind.when(c.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"), "email").when(c.rlike(r"(?i)^https?://\S+$"), "url").otherwise("other"))
