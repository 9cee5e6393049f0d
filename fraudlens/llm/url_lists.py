"""URL filters from dated lists by a temporal join (operator 9).

A list entry says that from its day on a key (an exact URL, a host or a
registered domain) is blocked or allowed. Entries of a key become validity
intervals, each ending where the next begins, and every capture is joined as
of its fetch day with the entry then active for its URL, its host and its
domain; the most specific active entry decides.

The as-of join is an equi-join on (key, period) with a range condition:
intervals are repeated once per ``period_days`` window that they touch, so a
host with a third of all captures is spread over periods, and a key with many
dated entries compares a capture only with those of one period. Intervals of
a key are disjoint, so no join multiplies rows. Lists are read like any other
table; Spark broadcasts them only if their measured size is below its limit.

Defined results: a null URL or fetch day matches nothing and is not blocked;
entries with a null key or day are void; of entries for one key and day a
block outweighs an allow; repeated captures stay; a capture before a key's
first entry sees none.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: From the most specific to the least.
SCOPES = ("url", "host", "domain")
#: After the last day that any capture can have.
NO_END = 2 ** 31 - 1


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def domain(of_host: Column) -> Column:
    """The last three labels of a host (two or one if it has no more)."""
    return F.regexp_extract(of_host, r"([^.]+\.)?([^.]+\.)?[^.]+$", 0)


def intervals(entries: DataFrame) -> DataFrame:
    """(scope, key, action, day) -> (scope, key, action, start_day, end_day),
    end exclusive."""
    daily = (entries.where(F.col("key").isNotNull() & F.col("day").isNotNull())
             .groupBy("scope", "key", F.col("day").cast("int").alias("start_day"))
             .agg(F.max("action").alias("action")))           # 'block' > 'allow'
    order = W.partitionBy("scope", "key").orderBy("start_day")
    return daily.withColumn("end_day", F.coalesce(F.lead("start_day").over(order),
                                                  F.lit(NO_END)))


def as_of(captures: DataFrame, valid: DataFrame, scope: str, key: Column, day: Column,
          period_days: int, first: int, last: int) -> DataFrame:
    """Captures with ``entry_<scope>``: (action, start_day) of the active entry."""
    period = lambda c: F.floor(c / period_days).cast("int")
    own = (valid.where((F.col("scope") == scope) & (F.col("start_day") <= last)
                       & (F.col("end_day") > first))
           .select(F.col("key").alias("__key"),
                   F.explode(F.sequence(period(F.greatest("start_day", F.lit(first))),
                                        period(F.least(F.col("end_day") - 1, F.lit(last)))))
                   .alias("__period"),
                   F.col("start_day").alias("__start"), F.col("end_day").alias("__end"),
                   F.struct("action", "start_day").alias(f"entry_{scope}")))
    keyed = captures.withColumns({"__k": key, "__d": day, "__p": period(day)})
    match = ((F.col("__k") == F.col("__key")) & (F.col("__p") == F.col("__period"))
             & (F.col("__d") >= F.col("__start")) & (F.col("__d") < F.col("__end")))
    return keyed.join(own, match, "left").drop("__k", "__d", "__p", "__key", "__period",
                                               "__start", "__end")


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url",
                    day_col: str = "fetch_day", period_days: int = 30) -> DataFrame:
    """The captures with ``url_decision``: blocked, scope, key and entry_day."""
    span = captures.agg(F.min(day_col), F.max(day_col)).first()
    first, last = (span[0], span[1]) if span[0] is not None else (0, 0)
    valid = intervals(entries)
    out = captures.select(F.struct(*[F.col(c) for c in captures.columns]).alias("__row"))
    url, day = F.col("__row")[url_col], F.col("__row")[day_col].cast("int")
    keys = {"url": url, "host": host(url), "domain": domain(host(url))}
    for scope in SCOPES:
        out = as_of(out, valid, scope, F.nullif(keys[scope], F.lit("")), day, period_days,
                    int(first), int(last))
    found = F.lit(None).cast("struct<scope:string,key:string,action:string,start_day:int>")
    for scope in reversed(SCOPES):
        entry = F.col(f"entry_{scope}")
        found = F.when(entry.isNotNull(), F.struct(
            F.lit(scope).alias("scope"), keys[scope].alias("key"),
            entry["action"].alias("action"), entry["start_day"].alias("start_day"))).otherwise(found)
    return (out.withColumn("__found", found).select(
        *[F.col("__row")[c].alias(c) for c in captures.columns],
        F.struct(F.coalesce(F.col("__found.action") == "block", F.lit(False)).alias("blocked"),
                 F.col("__found.scope").alias("scope"), F.col("__found.key").alias("key"),
                 F.col("__found.start_day").alias("entry_day")).alias("url_decision")))
