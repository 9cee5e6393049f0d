"""Card state as maps (T04): the state of ``jobs.with_card_state`` with one
entry per event minute and per day instead of one value with thirteen arrays.

* A micro-batch reads a card's entries and writes back only the minutes and
  days that it changed, so a card with a long month does not rewrite it.
* A card's rows come in Arrow chunks. Up to two chunks (a card whose rows lie
  across two of them) are handled as they are. If there are more, every chunk
  is first put aside in the state store by hour, and the hours are then handled
  in time order, as many at once as have a chunk's rows, so the worker holds a
  chunk or an hour of events and the hour before it, not the card's whole
  batch. Results are those of the whole batch in time order; a repeat of an id
  is told within an hour (``jobs.unique_ids`` tells it for the stream's life).
* With ``expiry_ms`` every entry has a time to live: idle cards are forgotten
  by the store, without a timer per card.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor

from fraudlens.streaming import jobs as J

MINUTE, HOUR = 60, 3600
EVENTS = ("ids array<bigint>, times array<bigint>, failed array<bigint>, "
          "lats array<double>, lons array<double>")
CARD = "n_seen long, intl_seen long, last_dt long, last_lat double, last_lon double"


def by_minute(events: tuple) -> dict[int, tuple]:
    """Minute to the (ids, times, failed, lats, lons) of its events."""
    found: dict[int, tuple] = {}
    for event in zip(*events):
        lists = found.setdefault(event[1] // MINUTE, ([], [], [], [], []))
        for values, v in zip(lists, event):
            values.append(v)
    return found


def packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class CardMaps(StatefulProcessor):
    def __init__(self, names: dict[str, bool], late_seconds: int, expiry_ms: int | None):
        self.names, self.late_seconds, self.expiry_ms = names, late_seconds, expiry_ms

    def init(self, handle):
        self.card = handle.getValueState("card", CARD, self.expiry_ms)
        self.minutes = handle.getMapState("minutes", "minute long", EVENTS, self.expiry_ms)
        self.days = handle.getMapState("days", "day long", "total double, n long", self.expiry_ms)
        self.aside = handle.getMapState("aside", "hour long, part int", "rows binary", self.expiry_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        minutes, days, held = {}, {}, J.NEW_CARD
        if self.card.exists():      # it is written with every entry and expires last
            minutes = {int(k[0]): tuple(list(x) for x in v) for k, v in self.minutes.iterator()}
            days = {int(k[0]): (float(v[0]), int(v[1])) for k, v in self.days.iterator()}
            held = self.held(minutes, days)
        for chunk, more in self.slices(rows):
            held, out = J.advance(held, chunk, self.names, self.late_seconds, more)
            if out is not None:
                yield out
        self.store(held, minutes, days)

    def held(self, minutes: dict, days: dict) -> tuple:
        events = [sum((minutes[m][i] for m in sorted(minutes)), []) for i in range(5)]
        order = sorted(days)
        return (*events, *self.card.get(), order, [days[d][0] for d in order],
                [days[d][1] for d in order])

    def store(self, held: tuple, minutes: dict, days: dict) -> None:
        now = by_minute(held[:5])
        for m in minutes.keys() - now.keys():
            self.minutes.removeKey((m,))
        for m, events in now.items():
            if m not in minutes or minutes[m][0] != events[0]:
                self.minutes.updateValue((m,), events)
        totals = {d: (s, n) for d, s, n in zip(*held[10:])}
        for d in days.keys() - totals.keys():
            self.days.removeKey((d,))
        for d, total in totals.items():
            if days.get(d) != total:
                self.days.updateValue((d,), total)
        if held[5:10] != J.NEW_CARD[5:10]:
            self.card.update(held[5:10])

    def slices(self, chunks: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
        """The card's rows in time order and whether more follow."""
        head = list(islice(chunks, 3))
        if len(head) < 3:
            yield (head[0] if len(head) == 1 else pd.concat(head, ignore_index=True)), False
            return
        parts: dict[int, list[int]] = {}
        most = 0
        for chunk in chain(head, chunks):
            most = max(most, len(chunk))
            for hour, rows in chunk.groupby(chunk["TransactionDT"] // HOUR):
                sizes = parts.setdefault(int(hour), [])
                self.aside.updateValue((int(hour), len(sizes)), (packed(rows),))
                sizes.append(len(rows))
        slices: list[list[int]] = []
        room = 0
        for hour in sorted(parts):
            n = sum(parts[hour])
            if n > room:
                slices.append([])
                room = most
            slices[-1].append(hour)
            room -= n
        for hours in slices:
            keys = [(hour, part) for hour in hours for part in range(len(parts[hour]))]
            rows = pd.concat([unpacked(bytes(self.aside.getValue(k)[0])) for k in keys],
                             ignore_index=True)
            for k in keys:
                self.aside.removeKey(k)
            yield rows, hours is not slices[-1]

    def close(self) -> None:
        pass
