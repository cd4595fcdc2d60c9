"""Units and nested records."""

from pyspark.sql import DataFrame, SparkSession

from loomwork.operators import nested, units
from loomwork.sources import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = table(spark, sf_dir, "listing_items", "item_id", "price", "description")
    brokers = table(spark, sf_dir, "broker_results", "result_id", "price", "full_text")
    return units.prices_in_usd_cents(listings, brokers, table(spark, sf_dir, "currency_rates"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.found(table(spark, sf_dir, "pipeline_configs", "config_id", "config_json"), table(spark, sf_dir, "rollout_configs", "snapshot_id", "payload"))


def p2_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects of both tables each structural variant has."""
    stages = nested.flatten(table(spark, sf_dir, "pipeline_configs", "config_id", "config_json"), "config_id", "config_json", "pipeline")
    rollouts = nested.flatten(table(spark, sf_dir, "rollout_configs", "snapshot_id", "payload"), "snapshot_id", "payload", "snapshot")
    return nested.variants(stages.unionByName(rollouts))


def p2_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of all stages."""
    return nested.subtype(table(spark, sf_dir, "pipeline_configs", "config_id", "config_json"), "config_id", "config_json", "pipeline", "stage").drop("state")


def p2_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of all conditions."""
    return nested.subtype(table(spark, sf_dir, "pipeline_configs", "config_id", "config_json"), "config_id", "config_json", "pipeline", "condition").drop("state")


def p2_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of all rollouts."""
    return nested.subtype(table(spark, sf_dir, "rollout_configs", "snapshot_id", "payload"), "snapshot_id", "payload", "snapshot", "rollout").drop("state")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_variants, p2_stages, p2_conditions, p2_rollouts)}

# ---- SQL: the same results written another way ---------------------------------------------------------------------

_UNITS = [
    ("USD", "usd|us$|$|us dollars|u.s. dollars", "us cents|cents|usd cents"), ("EUR", "eur|euro|euros|€", "euro cents|eur cent"), ("GBP", "gbp|£|pounds sterling|british pounds", "pence|gbx"), ("CAD", "cad|ca$|c$|canadian dollars", "canadian cents"),
    ("AUD", "aud|au$|a$|australian dollars", "australian cents"), ("CHF", "chf|fr.|sfr|swiss francs", "rappen"), ("JPY", "jpy|¥|yen|japanese yen", ""), ("INR", "inr|₹|rs|indian rupees", "paise"), ("SEK", "sek|swedish kronor", "öre"), ("MXN", "mxn|mx$|mexican pesos", "centavos"),
]
_NAMED = {n: (code, small) for code, whole, minor in _UNITS for small, names in ((False, whole), (True, minor)) for n in names.split("|") if n}
_VALUES = ", ".join(f"('{n}', '{code}', {str(small).lower()})" for n, (code, small) in _NAMED.items())
_SIGNS = "|".join(n.replace("$", "[$]").replace(".", "[.]") for n in sorted(_NAMED, key=len, reverse=True) if not (n[0].isalpha() and n[-1].isalpha()))
_WORDS = "|".join(n.replace(".", "[.]") for n in sorted(_NAMED, key=len, reverse=True) if n[0].isalpha() and n[-1].isalpha())
_TOLD = "|".join(n for n in sorted(_NAMED, key=len, reverse=True) if len(n) > 2 and n[0].isalpha() and n[-1].isalpha() and n not in ("cents", "sfr"))
_FLAT = "lower(trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g')))"
_HINT = "regexp_extract(' ' || {0} || ' ', '[^\\pL\\pN](" + _TOLD + ")[^\\pL\\pN]', 1)"

_P1 = f"""
  WITH names(name, code, small) AS (VALUES {_VALUES}),
  shops AS (SELECT DISTINCT item_id, price.amount AS amount, {_FLAT.format("coalesce(price.currency, '')")} AS own, {_HINT.format(_FLAT.format("coalesce(description, '')"))} AS hint FROM listing_items WHERE price.amount > 0),
  goods AS (SELECT 'listing_items' AS src_table, item_id AS rec_id, amount, CASE WHEN own LIKE '%thousand%' OR own SIMILAR TO 'k[a-z]{{3}}' THEN 1000.0 ELSE 1.0 END AS times,
            CASE WHEN own = '' AND hint = '' THEN 'usd' WHEN own = '' THEN hint WHEN own = 'gbp' AND amount IS NULL THEN own WHEN own SIMILAR TO 'k[a-z]{{3}}' THEN substr(own, 2) ELSE trim(replace(own, 'thousand', '')) END AS name FROM shops),
  pence AS (SELECT item_id FROM listing_items WHERE trim(price.currency) = 'GBp'),
  texts AS (SELECT DISTINCT result_id, {_FLAT.format("price")} AS p, {_HINT.format(_FLAT.format("coalesce(full_text, '')"))} AS hint FROM broker_results WHERE regexp_matches(price, '[0-9]')),
  cut AS (SELECT result_id, hint, regexp_extract(p, '[0-9][.,'' -]*(thousand|million|mio|lakhs?|lacs?|lac|k|m)(?:[^a-z]|$)', 1) AS scale,
          regexp_replace(regexp_extract(p, '([0-9](?:[0-9., '']*[0-9])?)', 1), '[ '']', '', 'g') AS n,
          coalesce(nullif(regexp_extract(p, '(?:^|[^a-z])({_SIGNS})', 1), ''), nullif(regexp_extract(p, '(?:^|[^a-z])({_WORDS})(?:[^a-z]|$)', 1), ''), nullif(hint, ''), 'usd') AS name FROM texts),
  homes AS (SELECT 'broker_results' AS src_table, result_id AS rec_id,
            CASE WHEN regexp_full_match(n, '[0-9]+') OR regexp_full_match(n, '[0-9]+([.][0-9]+){{2,}}|[0-9]+(,[0-9]+){{2,}}') OR (scale = '' AND regexp_full_match(n, '[0-9]+[.,][0-9]{{3}}')) THEN regexp_replace(n, '[.,]', '', 'g')
                 ELSE regexp_replace(regexp_extract(n, '^(.*)[.,][0-9]*$', 1), '[.,]', '', 'g') || '.' || regexp_extract(n, '[.,]([0-9]*)$', 1) END::DOUBLE AS amount,
            CASE scale WHEN '' THEN 1.0 WHEN 'k' THEN 1e3 WHEN 'thousand' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'mio' THEN 1e6 WHEN 'million' THEN 1e6 ELSE 1e5 END AS times, name FROM cut),
  both_tables AS (SELECT * FROM goods UNION ALL SELECT * FROM homes)
  SELECT DISTINCT src_table, rec_id, round(amount * times * usd_per_unit * 100 / CASE WHEN small OR (src_table = 'listing_items' AND rec_id IN (SELECT item_id FROM pence)) THEN minor_per_unit ELSE 1 END)::BIGINT AS usd_cents
  FROM both_tables JOIN names USING (name) JOIN currency_rates ON currency_code = code WHERE amount > 0"""


def _through(v: str) -> str:
    """The JSON that a JSON string holds, else the value."""
    return f"CASE WHEN json_type({v}) = 'VARCHAR' AND regexp_matches({v} ->> '$', '^\\s*[\\[{{]') AND json_valid({v} ->> '$') THEN ({v} ->> '$')::JSON ELSE {v} END"


def _listed(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN []::JSON[] WHEN json_type({v}) = 'ARRAY' THEN {v}::JSON[] ELSE [{v}] END"


def _each(source: str, value: str) -> str:
    """(rec_id, above, at, j): the objects among the list ``value`` of ``source`` (rec_id, path, j)."""
    return f"""SELECT rec_id, above, pos, j FROM (SELECT rec_id, above, pos, {_through("e")} AS j FROM (SELECT rec_id, above, unnest(range(len(l))) AS pos, unnest(l) AS e FROM
      (SELECT rec_id, above, {_listed("v")} AS l FROM (SELECT rec_id, path AS above, {_through(value)} AS v FROM {source})))) WHERE json_type(j) = 'OBJECT'"""


_P2_STAGES = f"""
  WITH RECURSIVE roots AS (SELECT rec_id, path, {_through("j")} AS j FROM (SELECT DISTINCT config_id AS rec_id, '' AS path, config_json::JSON AS j FROM pipeline_configs WHERE json_valid(config_json))),
  stages AS (
    SELECT rec_id, above, pos::VARCHAR AS path, j FROM ({_each("roots", "(j -> 'stages')")})
    UNION ALL
    SELECT rec_id, above, above || '.' || pos AS path, j FROM ({_each(f"(SELECT rec_id, path, {_through("(j -> 'config')")} AS c FROM stages)", "(c -> 'stages')")})),
  conditions AS (SELECT rec_id, above, above || '.' || pos AS path, j FROM ({_each(f"(SELECT rec_id, path, {_through("(j -> 'config')")} AS c FROM stages)", "(c -> 'conditions')")})),
  snapshots AS (SELECT rec_id, {_through("r")} AS r FROM (SELECT rec_id, {_through("j")} -> 'rollouts' AS r FROM (SELECT DISTINCT snapshot_id AS rec_id, payload::JSON AS j FROM rollout_configs WHERE json_valid(payload)))),
  rollouts AS (SELECT rec_id, path, {_through("j")} AS j FROM (SELECT rec_id, unnest(map_keys(m)) AS path, unnest(map_values(m)) AS j FROM (SELECT rec_id, r::MAP(VARCHAR, JSON) AS m FROM snapshots WHERE json_type(r) = 'OBJECT')))"""


def _typed(v: str, kind: str, sql: str) -> str:
    return f"CASE WHEN json_type({v}) IN ({kind}) THEN ({v} ->> '$')::{sql} END"


_NUMBERS = "'DOUBLE', 'BIGINT', 'UBIGINT'"
ORACLES: dict[str, str] = {
    "p1_found": _P1,
    "p2_found": f"""{_P2_STAGES} SELECT DISTINCT * FROM (SELECT 'stage' AS kind, rec_id, path, coalesce(j ->> 'name', '') AS found FROM stages UNION ALL SELECT 'condition', rec_id, path, coalesce(j ->> 'field', '') FROM conditions
      UNION ALL SELECT 'rollout', rec_id, path, coalesce(j ->> 'status', '') FROM rollouts)""",
    "p2_stages": f"""{_P2_STAGES} SELECT rec_id, path, above AS parent_path, coalesce(j ->> 'name', '') AS found, {_typed("(j -> 'type')", "'VARCHAR'", "VARCHAR")} AS stage_type, {_typed("(c -> 'min_confidence')", _NUMBERS, "DOUBLE")} AS min_confidence,
      {_typed("(c -> 'max_items')", _NUMBERS, "DOUBLE")} AS max_items, {_typed("(c -> 'output_field')", "'VARCHAR'", "VARCHAR")} AS output_field, {_typed("(c -> 'formats')", "'VARCHAR'", "VARCHAR")} AS formats,
      CASE WHEN json_type(c) = 'OBJECT' THEN true END AS has_config FROM (SELECT *, {_through("(j -> 'config')")} AS c FROM stages)""",
    "p2_conditions": f"""{_P2_STAGES} SELECT rec_id, path, above AS parent_path, coalesce(j ->> 'field', '') AS found, j ->> 'operator' AS operator, j ->> 'next_stage' AS next_stage, {_typed("v", "'VARCHAR'", "VARCHAR")} AS value_text,
      {_typed("v", _NUMBERS, "DOUBLE")} AS value_number, {_typed("v", "'BOOLEAN'", "BOOLEAN")} AS value_flag, CASE WHEN json_type(v) = 'ARRAY' THEN replace(replace(v::VARCHAR, ',', ', '), '  ', ' ') END AS value_list FROM (SELECT *, {_through("(j -> 'value')")} AS v FROM conditions)""",
    "p2_rollouts": f"""{_P2_STAGES} SELECT rec_id, path, '' AS parent_path, coalesce(j ->> 'status', '') AS found, j ->> 'feature_name' AS feature_name, j ->> 'current_phase' AS current_phase,
      CASE WHEN json_type({_through("(j -> 'config')")}) = 'OBJECT' THEN true END AS has_config FROM rollouts""",
}
