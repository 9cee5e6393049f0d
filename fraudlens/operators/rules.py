"""Declarative rule file -> Catalyst predicates.

A rule file is parsed once on the driver (it is a small config file) and each
condition tree is compiled into one ``Column``. The comparison semantics of the
original dynamic-typed evaluator are resolved at compile time from the
DataFrame schema, so evaluation is a single projection inside whole-stage
codegen with no Python per row.
"""
from __future__ import annotations

import logging
import math
import os
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.functions import features as fx

log = logging.getLogger(__name__)

DEFAULT_RULES_PATH = os.path.join(os.path.dirname(os.path.dirname(__file__)),
                                  "config", "rules.yaml")
RULE_FIELDS = ("rule_id", "name", "triggered", "action", "severity", "category", "description")

# Inputs the rules name, with the value used when the column is absent
# (absent, not null: a null value still never fires).
ENRICH_DEFAULTS: dict[str, Any] = {
    "card_txn_count_1min": 0,
    "card_txn_count_5min": 0,
    "card_txn_count_1hour": 0,
    "failed_txn_count_30min": 0,
    "amount_vs_avg_ratio": 1.0,
    "impossible_travel": False,
    "country_mismatch": False,
    "first_international": False,
}


@dataclass
class RuleSet:
    rules: list[dict] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)
    blacklists: dict[str, list[str]] = field(default_factory=dict)
    email_patterns: list[str] = field(default_factory=list)
    version: str = ""

    @property
    def rule_count(self) -> int:
        return len(self.rules)


def parse_rules(config: dict) -> RuleSet:
    config = config or {}
    rules = [r for r in config.get("rules", []) or [] if r.get("enabled", True)]
    bl = config.get("blacklists", {}) or {}
    return RuleSet(
        rules=rules,
        thresholds=dict(config.get("thresholds", {}) or {}),
        blacklists={
            "cards": [str(x) for x in bl.get("cards", []) or []],
            "merchants": [str(x) for x in bl.get("merchants", []) or []],
            "customers": [str(x) for x in bl.get("customers", []) or []],
            "email_domains": list(bl.get("email_domains", []) or []),
        },
        email_patterns=list(config.get("suspicious_email_patterns", []) or []),
        version=str(config.get("version", "")),
    )


def load_rules(path: str = DEFAULT_RULES_PATH) -> RuleSet:
    """Read the YAML rule file; a missing file gives an empty rule set."""
    if not os.path.exists(path):
        log.warning("rules file not found: %s", path)
        return RuleSet()
    with open(path) as fh:
        return parse_rules(yaml.safe_load(fh))


def with_overrides(rs: RuleSet, values: dict[str, Any]) -> RuleSet:
    """Copy of a rule set with some rule condition values replaced, by rule id."""
    import copy
    out = copy.deepcopy(rs)
    for r in out.rules:
        if r["id"] in values:
            r["conditions"]["value"] = values[r["id"]]
    return out


# ---------------------------------------------------------------------------
# Enrichment
# ---------------------------------------------------------------------------
def _as_key(c: Column) -> Column:
    return c.cast("string")


def blacklist_flag(df: DataFrame, column: str, keys: list[str] | DataFrame,
                   name: str, key_col: str = "key") -> DataFrame:
    """Existence test of a column's text form in a blacklist.

    A config list becomes an ``InSet`` literal; a blacklist table is joined
    (left, on distinct keys) and AQE broadcasts it when its runtime size is
    small.
    """
    if column not in df.columns:
        return df.withColumn(name, F.lit(False))
    if isinstance(keys, DataFrame):
        k = keys.select(_as_key(F.col(key_col)).alias("_blk")).distinct() \
                .withColumn(name, F.lit(True))
        j = df.join(k, _as_key(F.col(column)) == F.col("_blk"), "left").drop("_blk")
        return j.withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    if not keys:
        return df.withColumn(name, F.lit(False))
    return df.withColumn(name, F.coalesce(_as_key(F.col(column)).isin(keys), F.lit(False)))


def blacklist_select(df: DataFrame, column: str, table: DataFrame, key_col: str = "key",
                     keep: bool = True) -> DataFrame:
    """Semi (keep=True) or anti (keep=False) selection against a blacklist."""
    k = table.select(_as_key(F.col(key_col)).alias("_blk")).distinct()
    cond = _as_key(F.col(column)) == F.col("_blk")
    return df.join(k, cond, "left_semi" if keep else "left_anti")


def enrich(df: DataFrame, rs: RuleSet) -> DataFrame:
    df = blacklist_flag(df, "card1", rs.blacklists.get("cards", []), "card_blacklisted")
    df = blacklist_flag(df, "ProductCD", rs.blacklists.get("merchants", []), "merchant_blacklisted")
    df = blacklist_flag(df, "addr1", rs.blacklists.get("customers", []), "customer_blacklisted")
    email = F.col("P_emaildomain") if "P_emaildomain" in df.columns else F.lit(None)
    cols = {
        "suspicious_email": fx.suspicious_email(email, rs.blacklists.get("email_domains", []),
                                                rs.email_patterns),
        "is_round_amount": fx.rule_round_amount(
            "TransactionAmt" if "TransactionAmt" in df.columns else F.lit(0.0)),
        "is_night_transaction": (fx.rule_night(F.col("hour"))
                                 if "hour" in df.columns else F.lit(False)),
    }
    for name, default in ENRICH_DEFAULTS.items():
        if name not in df.columns:
            cols[name] = F.lit(default)
    return df.withColumns(cols)


# ---------------------------------------------------------------------------
# Condition compiler
# ---------------------------------------------------------------------------
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def _kind(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, _NUMERIC):
        return "num"
    if isinstance(dt, T.StringType):
        return "str"
    return "other"


def _lit_kind(v: Any) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "num"
    if isinstance(v, str):
        return "str"
    return "other"


def _to_float(v: Any) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _as_double(c: Column, kind: str) -> Column:
    if kind == "str":
        return F.trim(c).try_cast("double")         # unparsable text -> null -> false
    return c.cast("double")


def _not_nan(c: Column) -> Column:
    return ~F.isnan(c)


def _num_member(c: Column, vals: list[Any]) -> Column:
    """Python-style numeric set membership; NaN never matches."""
    nums = [float(v) for v in vals if _lit_kind(v) in ("num", "bool") and not
            (isinstance(v, float) and math.isnan(v))]
    if not nums:
        return F.lit(False)
    d = c.cast("double")
    return d.isin(nums) & _not_nan(d)


def compile_condition(cond: dict, schema: T.StructType) -> Column:
    if not cond:
        return F.lit(False)
    fields = {f.name: f.dataType for f in schema.fields}
    name, op, value = cond.get("field"), cond.get("operator"), cond.get("value")
    if name not in fields:
        return F.lit(False)                          # absent -> never fires
    c = F.col(name)
    kind = _kind(fields[name])

    if op in (">", ">=", "<", "<="):
        rhs = _to_float(value)
        if rhs is None or kind == "other" or math.isnan(rhs):
            res = F.lit(False)
        else:
            x = _as_double(c, kind)
            cmp = {">": x > F.lit(rhs), ">=": x >= F.lit(rhs),
                   "<": x < F.lit(rhs), "<=": x <= F.lit(rhs)}[op]
            res = cmp & _not_nan(x)
    elif op in ("==", "!="):
        vk = _lit_kind(value)
        if kind in ("num", "bool") and vk in ("num", "bool"):
            eq = _num_member(c, [value])
        elif kind == "str" and vk == "str":
            eq = c == F.lit(value)
        else:
            eq = F.lit(False)                        # no str/number coercion
        res = eq if op == "==" else ~eq
    elif op in ("in", "not_in"):
        vals = value if isinstance(value, list) else [value]
        if kind in ("num", "bool"):
            mem = _num_member(c, vals)
        elif kind == "str":
            strs = [v for v in vals if isinstance(v, str)]
            mem = c.isin(strs) if strs else F.lit(False)
        else:
            mem = F.lit(False)
        res = mem if op == "in" else ~mem
    elif op == "contains":
        text = str(value).lower()
        if kind == "bool":
            s = F.when(c, F.lit("true")).otherwise(F.lit("false"))
        else:
            s = F.lower(c.cast("string"))
        res = F.contains(s, F.lit(text))
    else:
        log.warning("unknown rule operator %r", op)
        res = F.lit(False)

    res = c.isNotNull() & F.coalesce(res, F.lit(False))
    sec = cond.get("secondary")
    if sec:
        res = res & compile_condition(sec, schema)
    return res


def rule_struct(rule: dict) -> Column:
    return F.struct(F.lit(str(rule["id"])).alias("rule_id"),
                    F.lit(str(rule["name"])).alias("name"),
                    F.lit(True).alias("triggered"),
                    F.lit(str(rule["action"])).alias("action"),
                    F.lit(str(rule["severity"])).alias("severity"),
                    F.lit(str(rule["category"])).alias("category"),
                    F.lit(str(rule.get("description", ""))).alias("description"))


def evaluate(df: DataFrame, rs: RuleSet, out_col: str = "triggered_rules",
             enriched: bool = False) -> DataFrame:
    """Ordered array of the triggered rules of each row."""
    e = df if enriched else enrich(df, rs)
    schema = e.schema
    parts = [F.when(compile_condition(r.get("conditions") or {}, schema), rule_struct(r))
             for r in rs.rules if r.get("conditions")]
    if not parts:
        return e.withColumn(out_col, F.array().cast(T.ArrayType(_RULE_TYPE)))
    return e.withColumn(out_col, F.filter(F.array(*parts), lambda x: x.isNotNull()))


_RULE_TYPE = T.StructType([T.StructField(n, T.BooleanType() if n == "triggered"
                                         else T.StringType(), n != "triggered")
                           for n in RULE_FIELDS])


def rules_frame(spark, rs: RuleSet) -> DataFrame:
    """The rule set as a table (for sync / upsert, U02 and K05)."""
    rows = [(str(r["id"]), str(r["name"]), str(r.get("description", "")),
             str(r["category"]), str(r["severity"]), str(r["action"]),
             bool(r.get("enabled", True))) for r in rs.rules]
    return spark.createDataFrame(rows, "rule_id string, name string, description string, "
                                       "category string, severity string, action string, "
                                       "enabled boolean")
