"""SQL text for rule conditions and decisions, used only by the DuckDB oracles.

It restates the rule semantics in plain SQL for a given column -> kind map
(``num`` / ``bool`` / ``str``), so the oracle checks the Spark compiler
against an independent expression of the same rules.
"""
from __future__ import annotations

import math

from fraudlens.operators import decisions as D
from fraudlens.operators.rules import RuleSet


def _q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def _num(v) -> float | None:
    try:
        f = float(v)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(f) else f


def cond_sql(cond: dict, kinds: dict[str, str]) -> str:
    if not cond:
        return "false"
    field, op, value = cond.get("field"), cond.get("operator"), cond.get("value")
    if field not in kinds:
        return "false"
    k, c = kinds[field], f'"{field}"'
    cd = f"CAST({c} AS DOUBLE)"
    if op in (">", ">=", "<", "<="):
        rhs = _num(value)
        if rhs is None:
            res = "false"
        elif k == "str":
            x = f"TRY_CAST(trim({c}) AS DOUBLE)"
            res = f"({x} {op} {rhs!r} AND NOT isnan({x}))"
        else:
            res = f"({cd} {op} {rhs!r} AND NOT isnan({cd}))"
    elif op in ("==", "!=", "in", "not_in"):
        vals = value if (op in ("in", "not_in") and isinstance(value, list)) else [value]
        if k in ("num", "bool"):
            nums = [float(v) for v in vals if isinstance(v, (int, float)) and _num(v) is not None]
            eq = (f"({cd} IN ({', '.join(repr(x) for x in nums)}) AND NOT isnan({cd}))"
                  if nums else "false")
        else:
            strs = [v for v in vals if isinstance(v, str)]
            eq = f"({c} IN ({', '.join(_q(s) for s in strs)}))" if strs else "false"
        res = eq if op in ("==", "in") else f"(NOT {eq})"
    elif op == "contains":
        text = _q(str(value).lower())
        s = (f"(CASE WHEN {c} THEN 'true' ELSE 'false' END)" if k == "bool"
             else f"lower(CAST({c} AS VARCHAR))")
        res = f"contains({s}, {text})"
    else:
        res = "false"
    out = f"({c} IS NOT NULL AND coalesce({res}, false))"
    if cond.get("secondary"):
        out = f"({out} AND {cond_sql(cond['secondary'], kinds)})"
    return out


def rule_lists_sql(rs: RuleSet, kinds: dict[str, str]) -> str:
    """Select-list items: the triggered rule ids / summaries / blocking names."""
    conds = [(r, cond_sql(r.get("conditions") or {}, kinds)) for r in rs.rules
             if r.get("conditions")]

    def lst(fn, pred=lambda r: True):
        items = ", ".join(f"CASE WHEN {c} THEN {_q(fn(r))} END" for r, c in conds if pred(r))
        return f"list_filter([{items}]::VARCHAR[], lambda x: x IS NOT NULL)" if items else \
            "[]::VARCHAR[]"

    def anyof(pred):
        cs = [c for r, c in conds if pred(r)]
        return "(" + " OR ".join(cs) + ")" if cs else "false"

    ids = lst(lambda r: r["id"])
    summ = lst(lambda r: f"{r['id']} ({r['name']}, severity={r['severity']})")
    blocks = lst(lambda r: r["name"], lambda r: r["action"] == D.BLOCK)
    return f"""{ids} AS _ids, {summ} AS _summ, {blocks} AS _blocks,
       {anyof(lambda r: r['action'] == D.BLOCK)} AS _any_block,
       {anyof(lambda r: r['action'] == D.REVIEW)} AS _any_review,
       {anyof(lambda r: r['severity'] == 'CRITICAL')} AS _any_critical,
       {anyof(lambda r: r['severity'] == 'HIGH')} AS _any_high"""


def decision_sql(score: str = "fraud_score", block_t: float = D.DEFAULT_BLOCK_THRESHOLD,
                 review_t: float = D.DEFAULT_REVIEW_THRESHOLD) -> str:
    """Select-list items computed from the columns produced by rule_lists_sql."""
    s = score
    pct = (f"CAST(CAST(round_even({s} * 1000, 0) AS BIGINT) // 10 AS VARCHAR) || '.' || "
           f"CAST(CAST(round_even({s} * 1000, 0) AS BIGINT) % 10 AS VARCHAR) || '%'")
    ra = f"CASE WHEN _any_block THEN 'BLOCK' WHEN _any_review THEN 'REVIEW' ELSE 'ALLOW' END"
    dec = (f"CASE WHEN _any_block THEN 'BLOCK' WHEN {s} >= {block_t!r} THEN 'BLOCK' "
           f"WHEN _any_review THEN 'REVIEW' WHEN {s} >= {review_t!r} THEN 'REVIEW' "
           f"ELSE 'ALLOW' END")
    risk = (f"CASE WHEN _any_critical OR {s} >= {D.RISK_CRITICAL_SCORE!r} THEN 'CRITICAL' "
            f"WHEN _any_high OR {s} >= {D.RISK_HIGH_SCORE!r} THEN 'HIGH' "
            f"WHEN len(_ids) > 0 OR {s} >= {review_t!r} THEN 'MEDIUM' ELSE 'LOW' END")
    head = (f"CASE WHEN {s} >= {block_t!r} THEN 'ML model assigned a fraud probability of ' || "
            f"{pct} || {_q(f', exceeding the block threshold of {block_t * 100:.0f}%.')} "
            f"WHEN {s} >= {review_t!r} THEN 'ML model assigned a fraud probability of ' || "
            f"{pct} || {_q(f', exceeding the review threshold of {review_t * 100:.0f}%.')} "
            f"ELSE 'ML model assigned a low fraud probability of ' || {pct} || '.' END")
    rules_part = (f"CASE WHEN len(_ids) > 0 THEN CAST(len(_ids) AS VARCHAR) || "
                  f"' rule(s) triggered: ' || array_to_string(list_slice(_summ, 1, "
                  f"{D.MAX_RULES_IN_TEXT}), '; ') || '.' END")
    block_part = ("CASE WHEN len(_blocks) > 0 THEN 'Blocking rule(s) triggered: ' || "
                  "array_to_string(_blocks, ', ') || '.' END")
    return f"""{ra} AS rule_action, {dec} AS decision, {risk} AS risk_level,
       {head} AS _head, {rules_part} AS _rules_part, {block_part} AS _block_part"""


def final_sql(inner: str, extra_cols: str = "") -> str:
    """Explanation and recommended action on top of decision_sql output."""
    rec = (f"CASE WHEN decision = 'BLOCK' THEN {_q(D.ACTION_BLOCK)} "
           f"WHEN decision = 'REVIEW' AND risk_level = 'HIGH' THEN {_q(D.ACTION_REVIEW_HIGH)} "
           f"WHEN decision = 'REVIEW' THEN {_q(D.ACTION_REVIEW)} "
           f"ELSE {_q(D.ACTION_ALLOW)} END")
    return f"""SELECT {extra_cols}array_to_string(_ids, ',') AS rule_ids, rule_action, decision,
       risk_level,
       concat_ws(' ', _head, _rules_part, _block_part, 'Final decision: ' || decision || '.')
         AS explanation,
       {rec} AS recommended_action
FROM ({inner})"""


def scorecard_sql(card: dict = D.SCORECARD) -> str:
    z = f"{float(card['intercept'])!r}"
    for name, coef in card["coefficients"].items():
        z = f"({z} + {float(coef)!r} * coalesce(CAST({name} AS DOUBLE), 0.0))"
    return f"round_even(1 / (1 + exp(-{z})), 6)"
