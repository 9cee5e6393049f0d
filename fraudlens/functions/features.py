"""Row-level feature expressions.

Every function returns ``pyspark.sql.Column`` objects built from Spark
built-ins, so all of them stay inside whole-stage codegen; none is a UDF.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour.
# ---------------------------------------------------------------------------
# Offset 0 of TransactionDT is midnight 2017-11-30 (UTC).
FEATURE_EPOCH = 1512000000
# Disposable / suspicious e-mail domains used by the feature pipeline.
SUSPICIOUS_EMAIL_DOMAINS = [
    "tempmail.com",
    "throwaway.email",
    "guerrillamail.com",
    "mailinator.com",
    "10minutemail.com",
    "trashmail.com",
    "yopmail.com",
    "sharklasers.com",
    "guerrillamailblock.com",
]
NIGHT_START_HOUR = 22
NIGHT_END_HOUR = 6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# F01 -----------------------------------------------------------------------
def event_time(dt="TransactionDT") -> Column:
    return F.timestamp_seconds(F.lit(FEATURE_EPOCH) + _c(dt))


def time_parts(dt="TransactionDT") -> dict[str, Column]:
    ts = event_time(dt)
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),          # Monday = 0
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
    }


# F02 -----------------------------------------------------------------------
def weekend_night(hour: Column, dow: Column) -> dict[str, Column]:
    return {
        "is_weekend": (dow >= 5).cast("int"),
        "is_night": ((hour >= NIGHT_START_HOUR) | (hour < NIGHT_END_HOUR)).cast("int"),
    }


# F03 -----------------------------------------------------------------------
def cyclic(hour: Column, dow: Column) -> dict[str, Column]:
    two_pi = 2 * math.pi
    return {
        "hour_sin": F.sin(F.lit(two_pi) * hour / 24),
        "hour_cos": F.cos(F.lit(two_pi) * hour / 24),
        "dow_sin": F.sin(F.lit(two_pi) * dow / 7),
        "dow_cos": F.cos(F.lit(two_pi) * dow / 7),
    }


# F04-F06 -------------------------------------------------------------------
def amount_features(amt="TransactionAmt") -> dict[str, Column]:
    a = _c(amt)
    cents = F.rint(a * 100).cast("long")          # half-even, like NumPy round
    return {
        "log_amount": F.log1p(a),
        "amount_cents": cents,
        "is_round_amount": (cents % 100 == 0).cast("int"),
        # characters of the truncated integer part; a minus sign counts
        "amount_digits": F.coalesce(F.length(a.cast("long").cast("string")), F.lit(0)),
    }


# F07-F09 -------------------------------------------------------------------
def email_tld(domain: Column) -> Column:
    return (F.when(domain.isNull(), F.lit("unknown"))
             .when(F.instr(domain, ".") > 0, F.substring_index(domain, ".", -1))
             .otherwise(F.lit("other")))


def email_features(df: DataFrame) -> dict[str, Column]:
    cols = set(df.columns)
    out: dict[str, Column] = {}
    has_p, has_r = "P_emaildomain" in cols, "R_emaildomain" in cols
    p = F.col("P_emaildomain")
    r = F.col("R_emaildomain") if has_r else F.lit("")
    same = F.coalesce(p == r, F.lit(False)).cast("int") if has_p else None
    for prefix, present in (("P_", has_p), ("R_", has_r)):
        if not present:
            continue
        c = F.col(f"{prefix}emaildomain")
        out[f"{prefix}email_suspicious"] = F.coalesce(
            c.isin(SUSPICIOUS_EMAIL_DOMAINS), F.lit(False)).cast("int")
        if has_p:
            out[f"{prefix}email_same_as_R"] = same
    if has_p:
        out["P_email_tld"] = email_tld(p)
    if has_r:
        out["R_email_tld"] = email_tld(F.col("R_emaildomain"))
    return out


# F10 -----------------------------------------------------------------------
def addr_features(a1="addr1", a2="addr2") -> dict[str, Column]:
    x, y = _c(a1), _c(a2)
    return {
        "addr_match": F.coalesce(x == y, F.lit(False)).cast("int"),
        "addr_combo": F.concat_ws(
            "_",
            F.coalesce(x, F.lit(-1.0)).cast("string"),
            F.coalesce(y, F.lit(-1.0)).cast("string")),
    }


# The rule engine's own derivations (differ from F01/F05 on purpose)
def rule_hour(dt="TransactionDT") -> Column:
    return F.pmod(F.floor(_c(dt) / 3600), F.lit(24)).cast("int")


def rule_round_amount(amt="TransactionAmt") -> Column:
    a = F.coalesce(_c(amt).cast("double"), F.lit(0.0))
    return ((a * 100).cast("long") % 100 == 0) & (a > 0)


def rule_night(hour: Column) -> Column:
    return F.coalesce((hour >= NIGHT_START_HOUR) | (hour < NIGHT_END_HOUR), F.lit(False))


# F14 -----------------------------------------------------------------------
def email_domain_part(email: Column) -> Column:
    e = F.coalesce(email.cast("string"), F.lit(""))
    return F.when(F.instr(e, "@") > 0, F.substring_index(e, "@", -1)).otherwise(e)


def suspicious_email(email: Column, domains: list[str], patterns: list[str]) -> Column:
    e = F.coalesce(email.cast("string"), F.lit(""))
    hit = email_domain_part(email).isin(domains) if domains else F.lit(False)
    for p in patterns:
        hit = hit | e.rlike(p)          # rlike is a search, like re.search
    return hit


# F15 -----------------------------------------------------------------------
ALERT_BLOCK_SCORE = 0.85
ALERT_REVIEW_SCORE = 0.5


def alert_colours(score: Column) -> dict[str, Column]:
    hi, mid = score >= ALERT_BLOCK_SCORE, score >= ALERT_REVIEW_SCORE
    return {
        "slack_color": F.when(hi, "#ff0000").when(mid, "#ff9900").otherwise("#36a64f"),
        "discord_color": F.when(hi, 0xFF0000).when(mid, 0xFF9900).otherwise(0x36A64F),
        "teams_color": F.when(hi, "FF0000").otherwise("FF9900"),
    }


def score_text(score: Column, places: int = 4) -> Column:
    """Fixed-point text of a score built from an integer (no locale/rounding
    differences between engines): half-even on the scaled double."""
    scale = 10 ** places
    n = F.rint(score * scale).cast("long")
    return F.concat((n / scale).cast("long").cast("string"), F.lit("."),
                    F.lpad((n % scale).cast("string"), places, "0"))


PRODUCT = "fraudlens"
SYSTEM_SCORE_CRITICAL, SYSTEM_SCORE = 1.0, 0.8


def system_alert_score(severity: Column) -> Column:
    """Score of an alert that belongs to no transaction."""
    return F.when(severity == "CRITICAL", SYSTEM_SCORE_CRITICAL).otherwise(SYSTEM_SCORE)


def alert_payloads(alert_type: Column, message: Column, score: Column, transaction_id: Column,
                   at: Column) -> dict[str, Column]:
    """JSON bodies of the three chat formats and the generic webhook. The
    field layout is the chat services' own; ``at`` is the time as text."""
    colour = alert_colours(score)
    title = F.concat(F.lit("Fraud alert: "), alert_type)
    facts = [("Transaction ID", transaction_id), ("Fraud Score", score_text(score)), ("Time", at)]

    def obj(**fields):
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def pairs(name: str, flag: str | None = None, wide: str | None = None):
        out = []
        for label, value in facts:
            item = {name: F.lit(label), "value": value}
            if flag:
                item[flag] = F.lit(label != wide)
            out.append(obj(**item))
        return F.array(*out)
    slack = obj(attachments=F.array(obj(
        color=colour["slack_color"], title=title, text=message, fields=pairs("title", "short"),
        footer=F.lit(PRODUCT))))
    discord = obj(embeds=F.array(obj(
        title=title, description=message, color=colour["discord_color"],
        fields=pairs("name", "inline", wide="Time"), footer=obj(text=F.lit(PRODUCT)))))
    teams = F.struct(
        F.lit("MessageCard").alias("@type"), F.lit("http://schema.org/extensions").alias("@context"),
        colour["teams_color"].alias("themeColor"), title.alias("summary"),
        F.array(obj(activityTitle=title, activitySubtitle=F.lit(PRODUCT), text=message,
                    facts=pairs("name"))).alias("sections"))
    generic = obj(source=F.lit(PRODUCT), alert_type=alert_type, message=message, fraud_score=score,
                  transaction_id=transaction_id, timestamp=at)
    return {"slack": F.to_json(slack), "discord": F.to_json(discord), "teams": F.to_json(teams),
            "webhook": F.to_json(generic)}
