"""The tree's readings as columns: Arrow-batched UDFs, null for a null page."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwork.html import tree

TYPES = {
    "tables": "array<struct<table_no:int,caption:string,headers:array<string>,rows:array<array<string>>>>",
    "lists": "array<struct<kind:string,items:array<string>>>",
    "metadata": "map<string,string>",
    "headings": "array<struct<level:int,text:string>>",
    "forms": "array<struct<action:string,method:string,fields:array<string>>>",
    "repeated_items": "array<struct<parent:string,shape:string,n:int>>",
    "threats": "array<string>",
    "main_content": "string",
    "cleaned": "string",
    "needs_scripts": "double",
}
WITH_BASE = {"links": "array<struct<url:string,text:string,rel:string,internal:boolean>>", "pagination": "array<struct<next:string,last:int>>"}


def read(name: str, html: Column, base: Column | None = None) -> Column:
    """The reading ``name`` of tree.py; links and pagination also take the page's address."""
    if name in WITH_BASE:
        call = getattr(tree, name)
        many = name != "pagination"

        def two(h: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else (call(x, y or "") if many else [call(x, y or "")]) for x, y in zip(h, b, strict=True)], dtype=object)

        out = F.pandas_udf(two, WITH_BASE[name])(html, base if base is not None else F.lit(""))
        return out if many else out[0]
    if name == "structure":
        def one(h: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else [tree.structure(x)] for x in h], dtype=object)

        return F.pandas_udf(one, "array<struct<n_elements:int,depth:int,n_links:int,n_scripts:int,link_share:double,markup_share:double>>")(html)[0]
    call = getattr(tree, name)

    def plain(h: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else call(x) for x in h], dtype=object)

    return F.pandas_udf(plain, TYPES[name])(html)


def selected(html: Column, selector: str) -> Column:
    """Texts of the elements that match a selector."""
    def run(h: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [n.text(" ") for n in tree.select(tree.parse(x), selector)] for x in h], dtype=object)

    return F.pandas_udf(run, "array<string>")(html)


def escape(c: Column) -> Column:
    """Text as it stands in markup."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
