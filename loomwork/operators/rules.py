"""Sets of pattern rules as one expression: the first rule that holds by priority, or all of them."""

from pyspark.sql import Column
from pyspark.sql import functions as F


class RuleSet:
    """Rules are names with patterns per column; a rule holds when all its patterns match, or any with ``any_of``. A null column matches nothing."""

    def __init__(self) -> None:
        self.rules: list[tuple[int, str, Column]] = []

    def add(self, name: str, priority: int, any_of: bool = False, test: Column | None = None, **patterns: str) -> "RuleSet":
        tests = [F.coalesce(F.col(c).rlike(p), F.lit(False)) for c, p in patterns.items()] + ([F.coalesce(test, F.lit(False))] if test is not None else [])
        if not tests:
            raise ValueError(f"rule {name} has no test")
        whole = tests[0]
        for t in tests[1:]:
            whole = whole | t if any_of else whole & t
        self.rules.append((priority, name, whole))
        return self

    def _ordered(self) -> list[tuple[str, Column]]:
        return [(n, t) for _, n, t in sorted(self.rules, key=lambda r: -r[0])]

    def first(self) -> Column:
        """The name of the rule of highest priority that holds, or null."""
        return F.coalesce(*[F.when(t, F.lit(n)) for n, t in self._ordered()], F.lit(None).cast("string"))

    def every(self) -> Column:
        """The names of all rules that hold, in order of priority."""
        return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in self._ordered()]))
