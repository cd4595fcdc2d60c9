import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomwork.operators import units

RATES = [("USD", 1.0, 100), ("EUR", 1.1, 100), ("GBP", 1.25, 100), ("JPY", 0.007, 1), ("INR", 0.012, 100)]
EDGES = units.money_edges(RATES)


@pytest.mark.parametrize(("text", "amount", "unit"), [
    ("$28,400", 28400, "$"), ("1,346 Mio. EUR", 1346000, "eur"), ("AUD 24.800", 24800, None), ("EUR 684.700,00", 684700, "eur"), ("209'900.00 USD", 209900, "usd"), ("usd 34 800", 34800, "usd"),
    ("1.99m USD", 1990000, "usd"), ("INR 8.41 lac", 841000, "inr"), ("269 thousand US dollars", 269000, "us dollars"), ("$ 730,600,,", 730600, "$"), ("USD 31.500,-", 31500, "usd"),
    ("n/a", None, None), ("", None, None), (None, None, None), ("US$720k", 720000, "us$"), ("12.5 EUR", 12.5, "eur"), ("1.234.567", 1234567, None), ("£ 5", 5, "£"),
    ("3 bed, $450,000", 450000, "$"), ("2 bath home, 1.2 million EUR", 1200000, "eur"), ("2 rooms, 350k", 350000, None), ("1,234", 1234, None), ("1,23", 1.23, None), ("1.234,5 eur", 1234.5, "eur"),
])
def test_price_texts(spark, text, amount, unit):
    row = units.with_money(spark.createDataFrame([(text,)], "t string"), "t", EDGES).select("money.*").first()
    assert row.value is None if amount is None else row.value * units.SCALES.get(row.scale, 1.0) == pytest.approx(amount)
    assert row.unit == unit


@pytest.mark.parametrize(("text", "unit"), [
    ("The amount is in cents.", "cents"), ("Price in pounds.", "pounds"), ("Shop currency: £", "£"), ("He paid in yen last year. Shop currency: GBP.", "gbp"), ("The seller quotes pounds sterling throughout.", "pounds sterling"),
    ("AMOUNTS\u00a0SHOWN IN EUR", "eur"), ("It weighs ten pounds and has a red kr.", None), ("Sold for Indian rupees only", "indian rupees"), (None, None), ("", None), ("Billed in euros at checkout.", "euros"),
])
def test_units_that_texts_name(spark, text, unit):
    assert spark.createDataFrame([(text,)], "t string").select(units.named_in_text(F.col("t"), EDGES)).first()[0] == unit


def test_compose_is_shortest_and_checks_cycles():
    found = units.compose([("c", "f", 1.8, 32.0), ("k", "c", 1.0, -273.15)], "f")
    scale, offset = found["k"]
    assert scale * 373.15 + offset == pytest.approx(212)
    with pytest.raises(ValueError):
        units.compose([("a", "b", 2.0, 0.0), ("b", "c", 3.0, 0.0), ("a", "c", 7.0, 0.0)], "c")


LISTING = "item_id bigint, price struct<amount double, currency string, original_amount double>, description string, unit string"
BROKER = "result_id bigint, price string, full_text string, value string"


def prices(spark, listings, brokers):
    rates = spark.createDataFrame(RATES, "currency_code string, usd_per_unit double, minor_per_unit int")
    out = units.prices_in_usd_cents(spark.createDataFrame(listings, LISTING), spark.createDataFrame(brokers, BROKER), rates)
    return sorted(map(tuple, out.collect()))


def test_edges_of_prices(spark):
    p = lambda a, c: Row(amount=a, currency=c, original_amount=None)
    listings = [(1, p(10.0, "EUR"), None, "x"), (1, p(10.0, "EUR"), None, "y"), (2, p(0.0, "USD"), None, None), (3, p(-1.0, "USD"), None, None), (4, None, None, None), (5, p(5.0, None), "Price given in pence.", None),
                (6, p(5.0, " GBp "), "", None), (7, p(5.0, "gbp"), "", None), (8, p(2.0, "kEUR"), "x " * 50000, None), (9, p(None, "EUR"), None, None), (10, p(3.0, ""), None, None)]
    brokers = [(1, "1,000", "All prices on this page are in Japanese yen. Fine.", None), (2, "Call", "EUR", None), (3, None, None, None), (4, "7", None, None)]
    got = prices(spark, listings, brokers)
    assert got == [("broker_results", 1, 700), ("broker_results", 4, 700), ("listing_items", 1, 1100), ("listing_items", 5, 6), ("listing_items", 6, 6), ("listing_items", 7, 625), ("listing_items", 8, 220000), ("listing_items", 10, 300)]
    assert prices(spark, [], []) == []
