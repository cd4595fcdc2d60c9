"""Conditions from configuration, each with a defined result for null: a missing value meets no condition except 'not ...' ones."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {"string": "string", "number": "double", "integer": "bigint", "boolean": "boolean", "date": "date"}


def condition(field: str, operator: str, value=None, negate: bool = False) -> Column:
    """A predicate column; ``operator`` is a name of OPERATORS. matches is anchored at the start of the text."""
    c, text = F.col(field), F.col(field).cast("string")
    made = {
        "equals": lambda: c == F.lit(value),
        "not_equals": lambda: ~F.coalesce(c == F.lit(value), F.lit(False)),
        "contains": lambda: F.contains(text, F.lit(value)),
        "not_contains": lambda: ~F.coalesce(F.contains(text, F.lit(value)), F.lit(False)),
        "greater_than": lambda: c > F.lit(value),
        "less_than": lambda: c < F.lit(value),
        "greater_equal": lambda: c >= F.lit(value),
        "less_equal": lambda: c <= F.lit(value),
        "exists": lambda: c.isNotNull(),
        "not_exists": lambda: c.isNull(),
        "matches": lambda: text.rlike(f"^(?:{value})"),
        "in": lambda: c.isin(list(value)),
        "is_type": lambda: text.try_cast(TYPES[value]).isNotNull(),
    }
    if operator not in made:
        raise ValueError(f"no operator {operator}")
    out = F.coalesce(made[operator](), F.lit(False))
    return ~out if negate else out


def combine(conditions: list[Column], how: str = "and", default: bool = True) -> Column:
    if not conditions:
        return F.lit(default)
    return reduce((lambda a, b: a & b) if how == "and" else (lambda a, b: a | b), conditions)
