"""Addresses: Column in, Column out. A null or malformed address gives nulls."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track a visit.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid msclkid dclid ref src".split()


def host(c: Column) -> Column:
    """Lower case, without user, port and a leading 'www.'."""
    found = F.regexp_extract(F.lower(F.trim(c)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit(""))


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def params(c: Column) -> Column:
    """Array of 'name=value', blank values left out, in the order given."""
    return F.filter(F.split(query(c), "&"), lambda p: p.rlike("^[^=]+=.+$"))


def canonical(c: Column) -> Column:
    """Lower-case scheme and host, no default port, '/' for an empty path, no tracking parameters, no fragment."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    authority = F.regexp_replace(authority, r"(?::80|:443)$", "")
    kept = F.array_join(F.filter(params(c), lambda p: ~F.substring_index(F.lower(p), "=", 1).isin(TRACKING)), "&")
    place = F.when(path(c) == "", "/").otherwise(path(c))
    return F.when(scheme == "", None).otherwise(F.concat(scheme, F.lit("://"), authority, place, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def parts(c: Column) -> Column:
    return F.struct(F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)).alias("scheme"), host(c).alias("host"), path(c).alias("path"), query(c).alias("query"), F.size(params(c)).alias("n_params"))


def depth(c: Column) -> Column:
    return F.size(F.filter(F.split(path(c), "/"), lambda s: s != ""))


def kind(c: Column) -> Column:
    """media, listing, detail, home or page, by the path."""
    p = F.lower(path(c))
    return (F.when(p.rlike(r"\.(jpg|jpeg|png|gif|svg|mp4|pdf|zip)$"), "media").when(p.isin("", "/"), "home").when(p.rlike(r"/(search|category|tag|list|page)(/|$)"), "listing").when(p.rlike(r"[-/]\d+/?$"), "detail").otherwise("page"))


def site_pattern(c: Column) -> Column:
    """host/first path segment."""
    return F.concat_ws("/", host(c), F.nullif(F.regexp_extract(path(c), r"^/([^/]+)", 1), F.lit("")))


def keyword_score(c: Column, keywords: list[str], penalties: list[str] = ()) -> Column:
    """0.3 for each keyword, -0.2 for each penalty, within 0..1; 0.5 without keywords."""
    if not keywords:
        return F.lit(0.5)
    low = F.lower(c)
    total = sum((F.when(F.contains(low, F.lit(k)), 0.3).otherwise(0.0) for k in keywords), F.lit(0.0)) - sum((F.when(F.contains(low, F.lit(k)), 0.2).otherwise(0.0) for k in penalties), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
