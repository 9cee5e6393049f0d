"""Card state as maps (T04) against the state in one value and batch order."""
import json
import os
import random

import pytest
from pyspark.sql import types as T

from fraudlens.session import rocksdb
from fraudlens.streaming import jobs as J

SCHEMA = T.StructType([
    T.StructField("TransactionID", T.LongType()), T.StructField("TransactionDT", T.LongType()),
    T.StructField("TransactionAmt", T.DoubleType()), T.StructField("card1", T.LongType()),
    T.StructField("failed", T.BooleanType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()), T.StructField("txn_country", T.StringType()),
    T.StructField("home_country", T.StringType())])


def _event(rnd, i, dt, card):
    return {"TransactionID": i, "TransactionDT": dt, "TransactionAmt": round(rnd.uniform(1, 90), 2),
            "card1": card, "failed": rnd.random() < 0.3,
            "lat": None if rnd.random() < 0.2 else rnd.uniform(-60, 60), "lon": rnd.uniform(-170, 170),
            "txn_country": rnd.choice(["AT", "CH", None]), "home_country": "AT"}


def _rows(spark, folder, batches, maps, schema=SCHEMA):
    src = os.path.join(folder, f"in-{maps}")
    os.makedirs(src)
    for b, events in enumerate(batches):
        path = os.path.join(src, f"{b:03d}.json")
        with open(path, "w") as f:
            f.writelines(json.dumps(e) + "\n" for e in events)
        os.utime(path, (1_700_000_000 + b, 1_700_000_000 + b))
    name = f"maps_{os.path.basename(folder).replace('-', '_')}_{maps}"
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src)
    with rocksdb(spark):
        q = (J.with_card_state(s, maps=maps).writeStream.format("memory").queryName(name)
             .option("checkpointLocation", os.path.join(folder, f"ck-{maps}"))
             .trigger(availableNow=True).start())
    assert q.awaitTermination(240)
    return {r["TransactionID"]: r.asDict() for r in spark.sql(f"SELECT * FROM {name}").collect()}


@pytest.fixture()
def small_chunks(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "50")
    yield
    spark.conf.set(name, before)


def _same(a, b):
    assert a.keys() == b.keys()
    for i in a:
        for c in a[i]:
            x, y = a[i][c], b[i][c]
            assert x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-12)), (i, c, x, y)


def test_maps_equal_one_value(spark, tmpdir_path):
    """Several batches, some events late, a card-less row, a repeated id and a
    lone time stamp far ahead."""
    rnd = random.Random(11)
    dts = sorted(rnd.randrange(0, 40 * 86400) // 7 * 7 for _ in range(60)) + \
        [50 * 86400 + rnd.randrange(9000) for _ in range(120)]
    events = [_event(rnd, i, dt, rnd.choice([1, 1, 2, 3, None])) for i, dt in enumerate(sorted(dts))]
    third = len(events) // 3
    batches = [events[:third], events[third:2 * third], [*events[2 * third:], events[2 * third]]]
    batches[2].append(batches[0].pop(5))                          # late
    batches[1].append(_event(rnd, 900, 400 * 86400, 1))           # far ahead
    _same(_rows(spark, tmpdir_path, batches, True), _rows(spark, tmpdir_path, batches, False))


def test_a_hot_card_passes_in_slices(spark, tmpdir_path, small_chunks, monkeypatch):
    """Two of three rows are one card's, in no order, over many hours and
    chunks: results are those of the whole batch in time order."""
    rnd = random.Random(4)
    events = [_event(rnd, i, rnd.randrange(20 * 3600), rnd.choice([7, 7, rnd.randrange(8, 40)]))
              for i in range(900)]
    batches = [events[:450], [dict(e, TransactionDT=e["TransactionDT"] + 72000) for e in events[450:]]]
    _same(_rows(spark, tmpdir_path, batches, True), _rows(spark, tmpdir_path, batches, False))


def test_slices_hold_one_hour(monkeypatch):
    """What is handed on at once is one hour of events, however long the batch."""
    import pandas as pd

    from fraudlens.streaming.card_maps import CardMaps

    class Aside(dict):
        updateValue = dict.__setitem__
        getValue = dict.__getitem__
        removeKey = dict.pop
    maps = CardMaps({}, 600, None)
    maps.aside = Aside()
    dts = list(range(0, 36000, 10))
    random.Random(1).shuffle(dts)
    rows = pd.DataFrame({"TransactionID": range(len(dts)), "TransactionDT": dts})
    out = list(maps.slices(rows.iloc[k:k + 100] for k in range(0, len(rows), 100)))
    assert [len(x) for x, _ in out] == [360] * 10 and [m for _, m in out] == [True] * 9 + [False]
    assert [x["TransactionDT"].min() // 3600 for x, _ in out] == list(range(10)) and not maps.aside


def test_velocity_without_optional_columns(spark, tmpdir_path):
    schema = T.StructType([f for f in SCHEMA.fields if f.name in ("TransactionID", "TransactionDT", "card1")])
    events = [{"TransactionID": i, "TransactionDT": 20 * i, "card1": i % 2} for i in range(20)]
    rows = _rows(spark, tmpdir_path, [events[:10], events[10:]], True, schema)
    assert [rows[i]["card_txn_count_1min"] for i in (0, 2, 4, 19)] == [1, 2, 2, 2]
    assert rows[19]["card_txn_count_1hour"] == 10


class _Calls(dict):
    """A map state that counts what is asked of it."""
    def __init__(self):
        super().__init__()
        self.calls = 0

    def updateValue(self, k, v):
        self.calls += 1
        self[k] = v

    def getValue(self, k):
        self.calls += 1
        return self[k]

    def removeKey(self, k):
        self.calls += 1
        del self[k]

    def iterator(self):
        self.calls += 1
        return iter(self.items())


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v


def _card_maps():
    from fraudlens.streaming.card_maps import CardMaps
    maps = CardMaps({c: False for c in ("lat", "lon", "txn_country", "home_country", "TransactionAmt")},
                    600, None)
    maps.card, maps.minutes, maps.days, maps.aside = _Value(), _Calls(), _Calls(), _Calls()
    return maps


def _month(n):
    import pandas as pd
    step = 30 * 86400 // n
    return pd.DataFrame({"TransactionID": range(n), "TransactionDT": [step * i for i in range(n)],
                         "card1": 1, "failed": False})


def test_a_month_of_a_card_across_two_chunks_is_one_slice():
    """No hour is put aside, no day without amounts is stored, a new card's maps are not read."""
    maps, rows = _card_maps(), _month(60)
    out = list(maps.handleInputRows((1,), iter([rows.iloc[:20], rows.iloc[20:]]), None))
    assert [len(x) for x in out] == [60]
    assert maps.aside.calls == maps.days.calls == 0 and maps.minutes.calls == 1


def test_sparse_hours_are_handled_together():
    """Slices of a chunk's rows at most, not one per hour, with the whole batch's counts."""
    maps, rows = _card_maps(), _month(3000)
    out = list(maps.handleInputRows((1,), iter([rows.iloc[k:k + 1000] for k in (1000, 0, 2000)]), None))
    assert len(out) <= 4 and sum(len(x) for x in out) == 3000 and not maps.aside
    assert [r for x in out for r in x["card_txn_rank"]] == list(range(1, 3001))
    whole = J.advance(J.NEW_CARD, rows, maps.names, 600)[1]
    assert [r for x in out for r in x["card_txn_count_1hour"]] == list(whole["card_txn_count_1hour"])
