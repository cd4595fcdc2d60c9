"""Pipelines of named stages over DataFrames, built by calls or from configuration. A pipeline only composes plans; nothing runs before an action."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import predicates, project, validate

Stage = Callable[..., DataFrame]
REGISTRY: dict[str, Stage] = {}


def stage(name: str) -> Callable[[Stage], Stage]:
    def add(f: Stage) -> Stage:
        if name in REGISTRY:
            raise ValueError(f"stage {name} exists")
        REGISTRY[name] = f
        return f

    return add


@stage("transform")
def _transform(df: DataFrame, **config) -> DataFrame:
    return project.transform(df, **config)


@stage("filter")
def _filter(df: DataFrame, conditions: list[dict], how: str = "and") -> DataFrame:
    return df.filter(predicates.combine([predicates.condition(**c) for c in conditions], how))


@stage("validate")
def _validate(df: DataFrame, rules: dict[str, dict], keep_invalid: bool = True) -> DataFrame:
    out = df.withColumn("_errors", validate.errors(*[validate.rule(f, **checks) for f, checks in rules.items()]))
    return out if keep_invalid else out.filter(F.size("_errors") == 0).drop("_errors")


@stage("aggregate")
def _aggregate(df: DataFrame, group_by: list[str], rules: dict[str, str], sort_by: list[str] = ()) -> DataFrame:
    out = df.groupBy(*group_by).agg(*[F.expr(e).alias(n) for n, e in rules.items()])
    return out.orderBy(*sort_by) if sort_by else out


@stage("sort_limit")
def _sort_limit(df: DataFrame, by: list[str], limit: int) -> DataFrame:
    return df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in by]).limit(limit)


class Pipeline:
    """Stages in order; branches run on the rows that meet a condition and are united, the rest passes by."""

    def __init__(self, name: str = "pipeline"):
        self.name, self.steps = name, []

    def add(self, step: str | Stage, when: bool = True, **config) -> "Pipeline":
        if when:
            call = REGISTRY[step] if isinstance(step, str) else step
            self.steps.append((step if isinstance(step, str) else getattr(step, "__name__", "stage"), lambda df: call(df, **config)))
        return self

    def branch(self, conditions: list[dict], then: "Pipeline", otherwise: "Pipeline | None" = None) -> "Pipeline":
        test = predicates.combine([predicates.condition(**c) for c in conditions])

        def run(df: DataFrame) -> DataFrame:
            rest = df.filter(~test)
            return then.run(df.filter(test)).unionByName(otherwise.run(rest) if otherwise else rest, allowMissingColumns=True)

        self.steps.append(("branch", run))
        return self

    def run(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step(df)
        return df


def from_config(config: dict, parameters: dict | None = None) -> Pipeline:
    """{"name", "stages": [{"type", "config", "enabled", "branch"}]}; '${x}' in a text takes the value of parameter x. An unknown type raises."""

    def fill(v):
        if isinstance(v, dict):
            return {k: fill(x) for k, x in v.items()}
        if isinstance(v, list):
            return [fill(x) for x in v]
        if isinstance(v, str) and v.startswith("${") and v.endswith("}"):
            return (parameters or {})[v[2:-1]]
        return v

    out = Pipeline(config.get("name", "pipeline"))
    for s in config.get("stages", []):
        if s["type"] == "branch":
            b = fill(s["config"])
            out.branch(b["conditions"], from_config({"stages": b["then"]}, parameters), from_config({"stages": b["otherwise"]}, parameters) if "otherwise" in b else None)
        elif s["type"] not in REGISTRY:
            raise ValueError(f"no stage type {s['type']}")
        else:
            out.add(s["type"], when=fill(s.get("enabled", True)), **fill(s.get("config", {})))
    return out
