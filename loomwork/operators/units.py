"""Quantities recorded in different units: a graph of affine conversions, composed once and applied by an equi-join.

Nodes are units, an edge ``(src, dst, scale, offset)`` says dst = scale * src + offset and may be walked both ways.
``compose`` finds for each unit the shortest chain to the target and checks every other edge against it, so that a
contradictory table (two chains with different results) raises instead of giving one of the two. ``convert`` joins
the composed table on the source unit; its size is the number of unit spellings, which is bounded and checked.

Nulls: a null value or an unknown unit gives a null result; nothing is dropped.
"""

import re
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.plans.lineage import bounded_collect

MAX_UNITS = 200_000


def compose(edges: list[tuple[str, str, float, float]], target: str, tolerance: float = 1e-9) -> dict[str, tuple[float, float]]:
    """unit -> (scale, offset) towards ``target`` along the fewest edges. Raises on an inconsistent cycle."""
    out: dict[str, list[tuple[str, float, float]]] = {}
    for src, dst, scale, offset in edges:
        if not scale:
            raise ValueError(f"edge {src} -> {dst} has no inverse")
        out.setdefault(dst, []).append((src, scale, offset))
        out.setdefault(src, []).append((dst, 1 / scale, -offset / scale))
    found, queue = {target: (1.0, 0.0)}, deque([target])
    while queue:
        unit = queue.popleft()
        scale, offset = found[unit]
        for other, s, o in out.get(unit, []):
            if other not in found:
                found[other] = (scale * s, scale * o + offset)
                queue.append(other)
    for src, dst, scale, offset in edges:
        if dst in found:
            direct = (found[dst][0] * scale, found[dst][0] * offset + found[dst][1])
            if any(abs(a - b) > tolerance * max(1.0, abs(a)) for a, b in zip(direct, found[src], strict=True)):
                raise ValueError(f"conversions contradict each other at {src} -> {dst}")
    return found


def convert(df: DataFrame, value: str, unit: str, edges: list, target: str, out: str) -> DataFrame:
    """``df`` with ``out`` = the value of ``value`` in ``target``, by an equi-join on the unit's name."""
    composed = compose(edges, target)
    if len(composed) > MAX_UNITS:
        raise ValueError("more unit spellings than a conversion table may hold")
    rows = [(k, *v) for k, v in composed.items()]
    name = f"_{out}_unit"
    factors = df.sparkSession.createDataFrame(rows, f"{name} string, {name}_a double, {name}_b double")
    joined = df.join(F.broadcast(factors), F.col(unit) == F.col(name), "left")
    return joined.withColumn(out, F.col(value) * F.col(f"{name}_a") + F.col(f"{name}_b")).drop(name, f"{name}_a", f"{name}_b")


# ---- money -------------------------------------------------------------------------------------------------------

# How the currencies and their minor units are named.
NAMES = {
    "USD": ["us$", "$", "us dollars", "us dollar", "u.s. dollars", "u.s. dollar", "american dollars", "dollars", "dollar"],
    "EUR": ["€", "euro", "euros"],
    "GBP": ["£", "pounds sterling", "pound sterling", "british pounds", "british pound", "pounds", "sterling", "quid"],
    "CAD": ["ca$", "c$", "can$", "canadian dollars", "canadian dollar"],
    "AUD": ["au$", "a$", "aus$", "australian dollars", "australian dollar"],
    "CHF": ["fr.", "fr", "sfr.", "sfr", "swiss francs", "swiss franc", "francs"],
    "JPY": ["¥", "jp¥", "japanese yen", "yen"],
    "INR": ["₹", "rs.", "rs", "indian rupees", "indian rupee", "rupees", "rupee"],
    "SEK": ["swedish kronor", "swedish krona", "swedish crowns", "kronor", "kr.", "kr"],
    "MXN": ["mx$", "mex$", "mexican pesos", "mexican peso", "pesos", "peso"],
}
MINOR = {
    "USD": ["¢", "cents", "cent", "us cents", "us cent", "u.s. cents"],
    "EUR": ["euro cents", "euro cent", "eurocents", "eurocent"],
    "GBP": ["pence", "penny", "british pence", "gbx", "p"],
    "CAD": ["canadian cents", "canadian cent"],
    "AUD": ["australian cents", "australian cent"],
    "CHF": ["rappen", "swiss rappen", "centimes"],
    "INR": ["paise", "paisa"],
    "SEK": ["öre", "ore"],
    "MXN": ["centavos", "centavo"],
}
SCALES = {"thousand": 1e3, "k": 1e3, "tsd": 1e3, "million": 1e6, "millions": 1e6, "mio": 1e6, "mn": 1e6, "m": 1e6, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "crore": 1e7, "crores": 1e7, "billion": 1e9, "bn": 1e9}
#: Names that a running text uses for other things as well; they count where the text states a price's unit, or in a field of their own.
VAGUE = {"$", "€", "£", "¥", "₹", "¢", "dollars", "dollar", "pounds", "sterling", "quid", "fr.", "fr", "francs", "rs.", "rs", "rupee", "kr.", "kr", "kronor", "peso", "pesos", "cents", "cent", "p", "penny", "ore", "us$", "ca$", "c$", "can$", "au$", "a$", "aus$", "mx$", "mex$", "jp¥", "sfr", "sfr.", "centimes"}
#: Words by which a text states the unit of its prices.
STATES = r"(?:prices?|priced|amounts?|currency|billed|invoiced|charged|quotes?|quoted|totals?|figures?|values?|sums?|costs?)\b[^.!?\n:]{0,30}?(?::|\b(?:in|is|are|as|quotes?|quoted)\b)(?: in\b)? ?(?:whole |full )?"
NUMBER = r"\d(?:[\d.,'’ ]*\d)?"


def money_edges(rates: list[tuple[str, float, int]]) -> list[tuple[str, str, float, float]]:
    """Edges between currencies, minor units, multiples and their spellings, towards the node 'usd_cent'.

    ``rates``: (code, US dollars per unit, minor units per unit). Spellings are lower case; 'GBp' alone keeps its case.
    A multiple is a node of its own ('mio usd', 'usd thousand', 'kusd') with an edge to its currency; one
    that names no currency is read with the currency of the row's text.
    """
    edges = [("USD", "usd_cent", 100.0, 0.0)]
    for code, usd, minor in rates:
        low = code.lower()
        if code != "USD":
            edges.append((code, "USD", float(usd), 0.0))
        edges.append((f"{code} minor", code, 1 / minor, 0.0))
        spelled = [low, *NAMES.get(code, [])]
        edges += [(x, code, 1.0, 0.0) for x in spelled]
        for scale, factor in SCALES.items():
            edges += [(f"{scale} {x}", code, factor, 0.0) for x in spelled]
            if len(scale) > 3:
                edges += [(f"{x} {scale}", code, factor, 0.0) for x in spelled]
        edges += [(f"k{x}", code, 1e3, 0.0) for x in spelled]
        small = [*MINOR.get(code, []), f"{low} cents", f"{low} cent", f"{low} minor units"]
        edges += [(x, f"{code} minor", 1.0, 0.0) for x in small]
    edges.append(("GBp", "GBP minor", 1.0, 0.0))
    known = {code for code, *_ in rates} | {"USD", "usd_cent"}
    return [e for e in dict.fromkeys(edges) if e[1].split(" ")[0] in known or e[1] == "usd_cent"]


def _single(edges: list) -> list[str]:
    """The spellings of currencies and minor units, multiples left out."""
    marked = re.compile(rf"(?:^|.* )(?:{'|'.join(SCALES)})(?: .*|$)")
    return [src for src, dst, *_ in edges if src == src.lower() and dst != "usd_cent" and src != "usd_cent" and not marked.fullmatch(src) and not (src.startswith("k") and src[1:] in {e[0] for e in edges})]


def spell(c: Column) -> Column:
    """A unit as the graph spells it: blanks joined, lower case; 'GBp' keeps its case."""
    tidy = F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
    return F.when(tidy == "GBp", tidy).otherwise(F.lower(tidy))


def _alternation(names: list[str]) -> str:
    return "|".join(re.escape(x).replace(r"\ ", r"\s+") for x in sorted(set(names), key=lambda x: (-len(x), x)))


def named_in_text(c: Column, edges: list) -> Column:
    """The unit that a running text names, spelled as in the graph; null without one.

    A unit that the text states for its prices ('Price in ...', 'Shop currency: ...', 'The amount is in ...') counts
    before any other mention, whatever the order; there every name counts. Elsewhere only names that mean nothing else.
    """
    names = _single(edges)
    clear = [x for x in names if x not in VAGUE and (" " in x or len(x) > 2)]
    flat = F.lower(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
    words = [x for x in names if len(x) > 1 or not x.isalpha()]
    stated = F.regexp_extract(flat, rf"(?<![\p{{L}}\p{{N}}]){STATES}({_alternation(words)})(?![\p{{L}}\p{{N}}])", 1)
    hit = F.regexp_extract(flat, rf"(?<![\p{{L}}\p{{N}}])({_alternation(clear)})(?![\p{{L}}\p{{N}}])", 1)
    return F.coalesce(F.nullif(stated, F.lit("")), F.nullif(hit, F.lit("")))


def with_money(df: DataFrame, text: str, edges: list, out: str = "money") -> DataFrame:
    """``df`` with ``out``: (value, scale word or '', unit spelled as in the graph or null) of a free-text price.

    The number beside a currency counts, then the one before a scale word, then the first. A single separator before
    exactly three digits groups thousands unless a scale word or letter follows; with two kinds of separator the last
    one is the decimal mark. A text without digits gives a null value. Steps are columns of their own, so that no
    pattern is matched twice.
    """
    names = [x for x in _single(edges) if x != "p"]
    words = [x for x in names if x[0].isalpha() and x[-1].isalpha()]
    signs = [x for x in names if x not in words]
    unit = rf"(?:(?<!\p{{L}})(?:{_alternation(signs)})|(?<!\p{{L}})(?:{_alternation(words)})(?!\p{{L}}))"
    scale = rf"(?:[.,'’ -]*({'|'.join(sorted(SCALES, key=len, reverse=True))})\b\.?)"
    shapes = [rf"({unit})[ :]*({NUMBER}){scale}?", rf"({NUMBER}){scale}?[.,'’ -]*({unit})", rf"({NUMBER}){scale}", rf"({NUMBER})"]
    groups = [(2, 3, 1), (1, 2, 3), (1, 2, None), (1, None, None)]
    flat, at, part = f"_{out}_flat", f"_{out}_at", f"_{out}_part"
    df = df.withColumn(flat, F.lower(F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))))
    which = F.lit(None).cast("int")
    for k in reversed(range(4)):
        which = F.when(F.col(flat).rlike(shapes[k]), k).otherwise(which)
    df = df.withColumn(at, which)
    got = F.lit(None).cast("struct<number:string,scale:string,unit:string>")
    for k in reversed(range(4)):
        fields = [F.regexp_extract(flat, shapes[k], g).alias(n) if g else F.lit("").alias(n) for g, n in zip(groups[k], ("number", "scale", "unit"), strict=True)]
        got = F.when(F.col(at) == k, F.struct(*fields)).otherwise(got)
    df = df.withColumn(part, got)
    bare = F.regexp_replace(F.col(f"{part}.number"), "['’ ]", "")
    df = df.withColumn(f"{part}_bare", bare).withColumn(f"{part}_marks", F.regexp_replace(bare, r"\d", ""))
    bare, marks, scaled = F.col(f"{part}_bare"), F.col(f"{part}_marks"), F.col(f"{part}.scale") != ""
    last = F.length(bare) - F.greatest(F.instr(F.reverse(bare), "."), F.lit(0))
    comma = F.length(bare) - F.instr(F.reverse(bare), ",")
    end = F.when(~bare.contains("."), comma).when(~bare.contains(","), last).otherwise(F.greatest(last, comma))
    same = F.replace(marks, F.substring(marks, 1, 1), F.lit("")) == ""
    grouped = (F.length(marks) > 1) & same | (F.length(marks) == 1) & (F.length(bare) - end == 4) & ~scaled
    digits = F.regexp_replace(bare, "[.,]", "")
    point = F.concat(F.regexp_replace(F.substring(bare, F.lit(1), end), "[.,]", ""), F.lit("."), F.substring(bare, end + 2, F.length(bare)))
    value = F.when(F.coalesce(bare, F.lit("")) == "", None).otherwise(F.when((marks == "") | grouped, digits).otherwise(point).try_cast("double"))
    # Where no unit stands beside the number, one may stand elsewhere in the text.
    named = F.when(F.col(at) < 2, F.col(f"{part}.unit")).otherwise(F.regexp_extract(flat, rf"({unit})", 1))
    money = F.struct(value.alias("value"), F.coalesce(F.col(f"{part}.scale"), F.lit("")).alias("scale"), F.nullif(F.regexp_replace(named, r"\s+", " "), F.lit("")).alias("unit"))
    # Exploding one struct keeps filters on the value above the patterns; pushed below, they would repeat every one.
    return df.withColumn(out, F.explode(F.array(money))).drop(flat, at, part, f"{part}_bare", f"{part}_marks")


def prices_in_usd_cents(listings: DataFrame, brokers: DataFrame, rates: DataFrame) -> DataFrame:
    """(src_table, rec_id, usd_cents) of every row of both tables that states a price above zero.

    A currency named with the price counts first, then one named in the row's own text, else US dollars. Null, blank
    and wordy prices, zero and negative amounts give no row; equal rows delivered twice give one.
    """
    rows = [(r[0], r[1], r[2]) for r in bounded_collect(rates.select("currency_code", "usd_per_unit", "minor_per_unit"), 1000, "currency_rates")]
    edges = money_edges(rows)
    own = spell(F.col("price.currency"))
    a = listings.select(
        F.lit("listing_items").alias("src_table"), F.col("item_id").alias("rec_id"), F.col("price.amount").alias("value"),
        own.alias("own"), F.when(F.coalesce(own, F.lit("")).isin("", "null", "none"), named_in_text(F.col("description"), edges)).alias("hint"))
    priced = with_money(brokers.select(F.col("result_id").alias("rec_id"), "price", "full_text"), "price", edges)
    hint = F.when(F.col("money.unit").isNull() & (F.col("money.value") > 0), named_in_text(F.col("full_text"), edges))
    b = priced.select(F.lit("broker_results").alias("src_table"), "rec_id", "money.value", F.col("money.unit").alias("own"), hint.alias("hint"), "money.scale")
    known = F.when(F.coalesce(F.col("own"), F.lit("")) == "", None).otherwise(F.col("own"))
    both = a.withColumn("scale", F.lit("")).unionByName(b).filter("value > 0")
    both = both.select("src_table", "rec_id", "value", F.ltrim(F.concat("scale", F.lit(" "), F.coalesce(known, "hint", F.lit("usd")))).alias("unit"))
    done = convert(both, "value", "unit", edges, "usd_cent", "cents")
    return done.filter("cents is not null").select("src_table", "rec_id", F.round("cents").cast("bigint").alias("usd_cents")).distinct()
