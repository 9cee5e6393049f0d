"""Structured Streaming jobs.

* ``transaction_source``: JSON messages from Kafka (when the connector is on
  the classpath) or from a file directory (tests).
* ``score_stream``: one streaming plan: messages are parsed and validated
  (T02), repeats of an id are dropped by a state keyed by id (T03), every
  history-dependent input comes from one keyed state per card (T04), and a ``foreachBatch`` sink evaluates
  the rules as they are at that moment (R11) and writes decisions, alerts,
  predictions and dead letters. Decisions do not depend on how messages fall
  into batches. Each sink is keyed by the batch id, so a replayed batch
  overwrites itself.
* ``block_share_stream``: the 5-minute sliding BLOCK share with a watermark
  (T05); the batch twin is ``monitoring.block_share``.

State of a card: the events of its last hour (ids, times, failures, places),
the latest event, and daily amount sums of 30 days. Events are placed in time
order among what the state holds, so a late event gets its true predecessor
and never moves the card's latest event back. A lone time stamp far in the
future does not age the others out: the hour is counted from the latest event
that has another within the hour. A continuous stream forgets cards after
``EXPIRY_MS`` without a message. Rows without a card pass beside the state.

A card's messages of one micro-batch are sorted together in one task; the
trigger's limit (``maxOffsetsPerTrigger``, ``maxFilesPerTrigger``) bounds them.
With ``maps`` a card's batch passes in slices of hours instead (``card_maps``).
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.operators import decisions as D
from fraudlens.operators import monitoring as MO
from fraudlens.operators import rules as R
from fraudlens.operators import store as ST
from fraudlens.operators import windows as W
from fraudlens.sources import io as IO
from fraudlens.streaming import retries as RT

STATE_HORIZON = max([*W.VELOCITY_WINDOWS.values(), *W.FAILED_WINDOWS.values()])
DAY = 86400
AVG_DAYS = 30
LATE_SECONDS = 600      # default lateness allowance (10 minutes)
EXPIRY_MS = 31 * DAY * 1000


# S04 ------------------------------------------------------------------------
def transaction_source(spark: SparkSession, schema: T.StructType, path: str | None = None,
                       kafka: dict | None = None, topic: str = "txn-events",
                       max_offsets: int | None = None, max_files: int | None = 1) -> DataFrame:
    """Raw messages as (key string, value string). ``max_offsets`` and
    ``max_files`` limit one micro-batch; None reads all that is there."""
    if kafka is not None:
        options = {"subscribe": topic, "startingOffsets": "earliest", **kafka}
        if max_offsets is not None:
            options["maxOffsetsPerTrigger"] = max_offsets
        return (spark.readStream.format("kafka").options(**options).load()
                .select(F.col("key").cast("string"), F.col("value").cast("string")))
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.lit(None).cast("string").alias("key"), F.col("value"))


# Keyed state ------------------------------------------------------------
_LONGS, _DOUBLES = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
CARD_STATE = T.StructType([
    T.StructField("ids", _LONGS), T.StructField("times", _LONGS), T.StructField("failed", _LONGS),
    T.StructField("lats", _DOUBLES), T.StructField("lons", _DOUBLES),
    T.StructField("n_seen", T.LongType()), T.StructField("intl_seen", T.LongType()),
    T.StructField("last_dt", T.LongType()), T.StructField("last_lat", T.DoubleType()),
    T.StructField("last_lon", T.DoubleType()),
    T.StructField("day_keys", _LONGS), T.StructField("day_sums", _DOUBLES),
    T.StructField("day_counts", _LONGS),
])
STATE_COLUMNS = [
    ("card_txn_rank", T.LongType()), ("card_prev_dt", T.LongType()),
    ("time_since_last_txn", T.LongType()), ("rapid_succession", T.IntegerType()),
    *[(n, T.LongType()) for n in W.VELOCITY_WINDOWS],
    *[(n, T.LongType()) for n in W.FAILED_WINDOWS],
    ("amount_vs_avg_ratio", T.DoubleType()),
    ("first_international", T.BooleanType()), ("impossible_travel", T.BooleanType()),
    ("is_late", T.BooleanType()),
]


def _place(v) -> float:
    return np.nan if v is None else float(v)


def _confirmed(times: np.ndarray) -> int:
    """The latest time that has another within the hour, or the latest."""
    near = np.flatnonzero(np.diff(times) < STATE_HORIZON)
    return int(times[near[-1] + 1] if len(near) else times[-1])


def _daily_average(days, amounts, keys0, sums0, counts0):
    """Mean amount over the 30 days before each row (earlier rows of its own
    day included) and the updated daily totals. Rows are in time order."""
    own, at = np.unique(days, return_inverse=True)
    keys = np.union1d(keys0, own).astype(np.int64)
    start_s, start_n = np.zeros(len(keys)), np.zeros(len(keys))
    np.add.at(start_s, np.searchsorted(keys, keys0), sums0)
    np.add.at(start_n, np.searchsorted(keys, keys0), counts0)
    sums, counts = start_s.copy(), start_n.copy()
    row = np.searchsorted(keys, days)
    np.add.at(sums, row, amounts)
    np.add.at(counts, row, 1.0)
    cs, cn = np.concatenate([[0.0], np.cumsum(sums)]), np.concatenate([[0.0], np.cumsum(counts)])
    lo, hi = np.searchsorted(keys, days - AVG_DAYS), np.searchsorted(keys, days)
    first = np.searchsorted(days, own)                    # rows are in time order
    earlier_s = np.concatenate([np.cumsum(x) for x in np.split(amounts, first[1:])]) - amounts
    earlier_n = np.arange(len(days)) - first[at]
    s = cs[hi] - cs[lo] + start_s[row] + earlier_s
    n = cn[hi] - cn[lo] + start_n[row] + earlier_n
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where((n > 0) & (s > 0), s / n, np.nan)
    return mean, keys, sums, counts


NEW_CARD = ([], [], [], [], [], 0, 0, None, None, None, [], [], [])


def advance(held: tuple, batch: pd.DataFrame, names: dict[str, bool], late_seconds: int,
            more: bool = False) -> tuple[tuple, pd.DataFrame | None]:
    """What a card's state holds (a ``CARD_STATE`` row) after these events, and
    the events with ``STATE_COLUMNS`` (None if all are repeats). ``names``:
    which optional columns the rows have. With ``more`` later slices of the
    same batch follow, which need what lies before them."""
    (ids, times, failed, lats, lons, n_seen, intl_seen, last_dt, last_lat, last_lon,
     day_keys, day_sums, day_counts) = held
    # an id that the state holds, or a second one in the batch, is a repeat
    row_ids = batch["TransactionID"].to_numpy()
    rows = np.lexsort((row_ids, batch["TransactionDT"].to_numpy()))
    rows = rows[np.sort(np.unique(row_ids[rows], return_index=True)[1])]
    if len(ids):
        rows = rows[~np.isin(row_ids[rows], ids)]
    m = len(rows)
    if not m:
        return held, None
    batch = {c: batch[c].array.take(rows) for c in batch.columns}
    bt = batch["TransactionDT"].to_numpy(dtype=np.int64)
    column = lambda c: pd.Series(batch[c]).to_numpy(dtype=float) if names[c] else np.full(m, np.nan)
    bf = batch["failed"]
    bf = bf.to_numpy(dtype=np.int64) if bf.dtype == bool else pd.Series(bf).eq(True).to_numpy(dtype=np.int64)
    all_t = np.concatenate([np.asarray(times, np.int64), bt])
    order = np.argsort(all_t, kind="stable")
    take = lambda old, new, kind: np.concatenate([np.asarray(old, kind), new])[order]
    all_i = take(ids, batch["TransactionID"].to_numpy(dtype=np.int64), np.int64)
    all_f = take(failed, bf, np.int64)
    all_lat = take([_place(v) for v in lats], column("lat"), float)
    all_lon = take([_place(v) for v in lons], column("lon"), float)
    all_t = all_t[order]
    spot = np.empty(len(order), np.int64)
    spot[order] = np.arange(len(order))
    spot = spot[len(times):]                              # place of each batch row
    out = {}
    hi = np.searchsorted(all_t, bt, side="right")
    cum_f = np.concatenate([[0], np.cumsum(all_f)])
    for name, n in W.VELOCITY_WINDOWS.items():
        out[name] = hi - np.searchsorted(all_t, bt - n, side="right")
    for name, n in W.FAILED_WINDOWS.items():
        out[name] = cum_f[hi] - cum_f[np.searchsorted(all_t, bt - n, side="right")]
    out["is_late"] = bt < last_dt - late_seconds if last_dt is not None else np.zeros(m, bool)
    # previous event: the one before in time; else the card's latest, if earlier
    inside = spot > 0
    before = np.maximum(spot - 1, 0)
    older = ~inside & (last_dt is not None and last_dt <= bt)
    has_prev = inside | older
    prev = np.where(inside, all_t[before], last_dt if last_dt is not None else 0)
    gap = np.where(has_prev, bt - prev, -1)
    out["card_txn_rank"] = n_seen + np.arange(1, m + 1)
    out["card_prev_dt"] = pd.arrays.IntegerArray(prev.astype(np.int64), ~has_prev)
    out["time_since_last_txn"] = gap
    out["rapid_succession"] = ((gap > 0) & (gap < 60)).astype(np.int32)
    keys, sums, counts = (np.asarray(x, kind) for x, kind in
                          ((day_keys, np.int64), (day_sums, float), (day_counts, float)))
    if names["TransactionAmt"]:
        amounts = column("TransactionAmt")
        mean, keys, sums, counts = _daily_average(bt // DAY, amounts, keys, sums, counts)
        with np.errstate(invalid="ignore"):
            out["amount_vs_avg_ratio"] = np.where(np.isnan(mean), 1.0, amounts / mean)
    else:                                                 # no amounts, no daily totals
        out["amount_vs_avg_ratio"] = np.ones(m)
    out["first_international"] = out["impossible_travel"] = np.zeros(m, bool)
    if names["txn_country"] and names["home_country"]:
        intl = (pd.Series(batch["txn_country"]) != pd.Series(batch["home_country"])).fillna(False).to_numpy()
        out["first_international"] = intl & (intl_seen + np.cumsum(intl) - intl == 0)
        intl_seen = int(intl_seen + intl.sum())
    if names["lat"] and names["lon"]:
        plat = np.where(inside, all_lat[before], _place(last_lat))
        plon = np.where(inside, all_lon[before], _place(last_lon))
        r = np.pi / 180
        h = np.sin((column("lat") - plat) * r / 2) ** 2 + np.cos(plat * r) \
            * np.cos(column("lat") * r) * np.sin((column("lon") - plon) * r / 2) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            km = 2 * W.EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))
            speed = np.where(gap > 0, km / (gap / 3600.0), np.where(km > 0, np.inf, 0.0))
        out["impossible_travel"] = has_prev & (np.nan_to_num(speed, nan=0.0) > W.MAX_TRAVEL_KMH)
    if last_dt is None or all_t[-1] >= last_dt:
        last_dt, last_lat, last_lon = int(all_t[-1]), float(all_lat[-1]), float(all_lon[-1])
    anchor = _confirmed(all_t)
    keep = all_t > anchor - STATE_HORIZON
    kept = keys >= anchor // DAY - AVG_DAYS
    if more:
        keep |= all_t > bt[-1] - STATE_HORIZON
        kept |= keys >= bt[-1] // DAY - AVG_DAYS
    held = (all_i[keep].tolist(), all_t[keep].tolist(), all_f[keep].tolist(),
            all_lat[keep].tolist(), all_lon[keep].tolist(), int(n_seen + m), intl_seen,
            last_dt, last_lat, last_lon, keys[kept].tolist(), sums[kept].tolist(),
            counts[kept].astype(int).tolist())
    return held, pd.DataFrame({**batch, **{name: out[name] for name, _ in STATE_COLUMNS}}, copy=False)


#: Groups that the rows without a card of a micro-batch are dealt to.
ANONYMOUS = 1024


def _card_state_fn(names: dict[str, bool], late_seconds: int, expiry_ms: int | None):
    unknown = dict.fromkeys(n for n, _ in STATE_COLUMNS)

    def fn(key, pdfs, state):
        if pd.isna(key[0]):                 # nobody's history: no state, values follow
            for pdf in pdfs:
                yield pdf.assign(**unknown)
            return
        if state.hasTimedOut:
            state.remove()
            return
        held, rows = advance(state.get if state.exists else NEW_CARD,
                             pd.concat(list(pdfs), ignore_index=True), names, late_seconds)
        if rows is not None:
            state.update(held)
        if state.exists and expiry_ms is not None:
            state.setTimeoutDuration(expiry_ms)
        if rows is not None:
            yield rows
    return fn


def with_card_state(events: DataFrame, key: str = "card1", late_seconds: int = LATE_SECONDS,
                    expiry_ms: int | None = None, maps: bool = False) -> DataFrame:
    """Streaming (or batch) rows with ``STATE_COLUMNS`` from keyed state; rows
    without a card get neutral values beside it. ``expiry_ms`` forgets idle
    cards; it suits streams that run on, since Spark then never runs out of
    batches and an available-now trigger would not end. ``maps`` keeps the
    state as maps of minutes and days and takes a card's batch in slices (see
    ``card_maps``; streams only, needs the RocksDB state store)."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    if "failed" not in events.columns:
        events = events.withColumn("failed", F.lit(False))
    names = {c: c in events.columns for c in ("lat", "lon", "txn_country", "home_country",
                                              "TransactionAmt")}
    def state_schema(rows: DataFrame) -> T.StructType:
        return T.StructType(list(rows.schema.fields) + [T.StructField(n, t) for n, t in STATE_COLUMNS])
    if maps:
        from fraudlens.streaming.card_maps import CardMaps
        known = events.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(
            CardMaps(names, late_seconds, expiry_ms), state_schema(events), "Append",
            "None" if expiry_ms is None else "ProcessingTime")
        rows = events.where(F.col(key).isNull()).withColumn("is_late", F.lit(False))
        return W.with_anonymous(known, rows)
    # rows without a card pass in the same step, dealt out by id: a branch of
    # their own would read, parse and look up all events again
    dealt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64("TransactionID"), F.lit(ANONYMOUS)))
    events = events.withColumn("_dealt", dealt)
    known = events.groupBy(key, "_dealt").applyInPandasWithState(
        _card_state_fn(names, late_seconds, expiry_ms), state_schema(events), CARD_STATE, "append",
        GroupStateTimeout.NoTimeout if expiry_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    return W.neutral_without(known.drop("_dealt"), key, STATE_COLUMNS)


def card_velocity(events: DataFrame, key: str = "card1", maps: bool = False) -> DataFrame:
    """Per-card velocity counts from keyed state."""
    cols = ["TransactionID", key, "TransactionDT", *[c for c in ("failed",) if c in events.columns]]
    return with_card_state(events.select(*cols), key, maps=maps).select(
        "TransactionID", *W.VELOCITY_WINDOWS, *W.FAILED_WINDOWS)


# T01 + T04: one stateful scoring query -----------------------------------------
def stateful_features(events: DataFrame, card_stats: DataFrame | None = None,
                      key: str = "card1", expiry_ms: int | None = None) -> DataFrame:
    """The card's state for every history-dependent input (T04), row features
    and a stream-static join to fitted card statistics. The state comes first:
    the message's own columns are all that it needs and that pass through it."""
    from fraudlens.operators import aggregations as A
    from fraudlens.operators import pipeline as P
    df = P.row_features(with_card_state(events, key, expiry_ms=expiry_ms))
    if card_stats is not None:
        df = A.with_card_aggregations(df, key, stats=card_stats)
    if "txn_country" in df.columns and "home_country" in df.columns:          # W09
        df = df.withColumn("country_mismatch", F.coalesce(
            F.col("txn_country") != F.col("home_country"), F.lit(False)))
    return df


def scored_stream(events: DataFrame, card_stats: DataFrame | None = None,
                  card: dict = D.SCORECARD, expiry_ms: int | None = None) -> DataFrame:
    """Everything before the rules: features, state and score. Without fitted
    statistics every card is one that they do not know."""
    from fraudlens.functions import features as fx
    from fraudlens.operators import aggregations as A
    if card_stats is None:
        card_stats = A.no_card_stats(events.sparkSession)
    f = stateful_features(events, card_stats, expiry_ms=expiry_ms)
    return D.scorecard_score(f, card).withColumn("hour", fx.rule_hour("TransactionDT"))


def decide_stream(events: DataFrame, rs: R.RuleSet, card_stats: DataFrame | None = None,
                  card: dict = D.SCORECARD) -> DataFrame:
    """T01 as a plan with a fixed rule set."""
    return D.decide(R.evaluate(scored_stream(events, card_stats, card), rs))


def _write_sinks(decided: DataFrame, out_dir: str, epoch_id: int, card: dict) -> None:
    part = f"batch_id={epoch_id}"
    D.scoring_record(decided, card).withColumn("value", F.to_json(F.struct("*"))) \
        .select(F.col("transaction_id").alias("key"), "value") \
        .write.mode("overwrite").parquet(f"{out_dir}/decisions/{part}")
    ST.alerts_table(decided).write.mode("overwrite").parquet(f"{out_dir}/alerts/{part}")
    ST.predictions_table(decided, card).write.mode("overwrite") \
        .parquet(f"{out_dir}/predictions/{part}")


def _start(frame: DataFrame, run, checkpoint: str, available_now: bool):
    w = frame.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def unique_ids(events: DataFrame, key: str = "TransactionID", within: str | None = None,
               ts: str = "ts") -> DataFrame:
    """The first message of each id (any one of those in the same
    micro-batch), whatever its card and however much later the repeats come.
    The state has every id of the stream's life,
    spread by id; keep it in a state store on disk. ``within`` forgets ids that
    long after their time stamp instead, where repeats cannot come later."""
    if within is not None and events.isStreaming:
        stamped = events.withColumn(ts, F.timestamp_seconds("TransactionDT"))
        return MO.dedup_transactions(stamped, key, ts, within).drop(ts)
    return events.dropDuplicates([key])


def score_stream(raw: DataFrame, schema: T.StructType, out_dir: str, checkpoint: str,
                 rules=R.load_rules, topic: str = "txn-events", card_stats: DataFrame | None = None,
                 card: dict = D.SCORECARD, available_now: bool = True,
                 unique_within: str | None = None, attempt: RT.Attempt | None = None,
                 max_retries: int = RT.MAX_RETRIES):
    """Messages to all four sinks, one decision per id. ``rules`` is
    called for every micro-batch, so an edited rule file holds from the next
    one on (R11). With ``attempt`` failing rows are tried again (see
    ``retries``; ledger under ``out_dir``) and given up as dead letters; the
    query's ``sink`` then serves ``retries.drain`` once an available-now stream
    has ended."""
    good, dead = IO.route_messages(raw, schema, topic)
    scored = scored_stream(unique_ids(good, within=unique_within), card_stats, card,
                           None if available_now else EXPIRY_MS)
    letter = F.struct(*dead.columns)
    none = F.lit(None).cast(dead.select(letter.alias("x")).schema["x"].dataType)
    both = scored.withColumn("_dead", none) \
        .unionByName(dead.select(letter.alias("_dead")), allowMissingColumns=True)

    def run(batch: DataFrame, epoch_id: int):
        if "_dead" not in batch.columns:   # pending rows that are drained
            batch = batch.withColumn("_dead", none)
        # read by four sinks; on disk, since dead letters may be most of it
        rows = batch.persist(StorageLevel.DISK_ONLY)
        try:
            live = rows.where(F.col("_dead").isNull()).drop("_dead")
            letters = rows.where(F.col("_dead").isNotNull()).select("_dead.*")
            if attempt is not None:
                live, lost = RT.settle(live, attempt, out_dir, epoch_id, max_retries=max_retries)
                value = F.to_json(F.struct(*[f.name for f in schema.fields]))
                letters = letters.unionByName(lost.select(
                    F.lit(topic).alias("original_topic"), value.alias("original_value"),
                    F.concat(F.lit("failed: "), F.col(RT.ERROR)).alias("failure_reason"),
                    F.current_timestamp().alias("failed_at")))
            decided = D.decide(R.evaluate(live, rules()))
            _write_sinks(decided, out_dir, epoch_id, card)
            letters.write.mode("overwrite").parquet(f"{out_dir}/dead_letter/batch_id={epoch_id}")
        finally:
            rows.unpersist()
    query = _start(both, run, checkpoint, available_now)
    query.sink = run
    return query


def write_decisions(decided: DataFrame, out_dir: str, checkpoint: str,
                    card: dict = D.SCORECARD, available_now: bool = True):
    """Sinks of an already decided stream (see ``decide_stream``)."""
    def run(batch: DataFrame, epoch_id: int):
        rows = batch.persist()
        try:
            _write_sinks(rows, out_dir, epoch_id, card)
        finally:
            rows.unpersist()
    return _start(decided, run, checkpoint, available_now)


# T05 ------------------------------------------------------------------------
def block_share_stream(decided: DataFrame, ts: str = "ts",
                       watermark: str = MO.DEFAULT_WATERMARK) -> DataFrame:
    return MO.block_share(decided.withWatermark(ts, watermark), ts)
