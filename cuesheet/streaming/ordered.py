"""Stateful streams that take each key's rows in event-time order.

Rows newer than the watermark wait in the state of their key's group; once the watermark has passed them no earlier row can
come, so they are handed on in order, however they arrived. What a key carries from row to row is one small value. Timers
on event time wake a group when rows of it are due, or when the ``fold`` of one of its keys asked for it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

#: (rows to emit, value to carry on or None, milliseconds at which to wake or None) from
#: (key, carried value or None, due rows in order, watermark in milliseconds). Rows, values and results are tuples.
Fold = Callable[[tuple, Any, list[tuple], int], tuple[list[tuple], Any, int | None]]

#: Rows that wait in one value of a state: a value for each row costs more than all else that is done with it.
PACK = 1000

#: Groups of keys in ``first_of_each``; ``in_event_order`` has four times as many.
GROUPS = 256

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Keep the state of streams that are started from now on in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _plain(frame: pd.DataFrame, row: T.StructType) -> list[tuple]:
    """Rows as tuples of Python values; missing ones are None."""
    columns = []
    for field in row:
        whole = isinstance(field.dataType, T.IntegralType)
        columns.append([
            None if x is None or x is pd.NA or x != x else int(x) if whole else x for x in frame[field.name].astype(object)
        ] if not isinstance(field.dataType, (T.ArrayType, T.StructType)) else list(frame[field.name]))
    return list(zip(*columns))


def _packed(rows: list[tuple]) -> list[tuple]:
    return [(pickle.dumps(rows[start:start + PACK]),) for start in range(0, len(rows), PACK)]


def _nulls_first(value: Any) -> tuple:
    return (value is not None, value)


class _InOrder(StatefulProcessor):
    """One group of keys: their rows that wait, and what each key carries."""

    def __init__(self, row: T.StructType, keys: int, carried: T.StructType, out: list[str], order: list[int], fold: Fold):
        self.row, self.keys, self.out, self.order, self.fold = row, keys, out, order, fold
        self.open_type = T.StructType([*row.fields[:keys], T.StructField("_carried", carried), T.StructField("_wake", T.LongType())])

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getListState("open", self.open_type)
        self.done = handle.getValueState("done", "watermark long")

    def _wake(self, milliseconds: list[int], watermark: int) -> None:
        if milliseconds:
            self.handle.registerTimer(max(min(milliseconds), watermark + 1))

    def _due_at(self, rows: list[tuple]) -> list[int]:
        # the keys come first, then the event time in microseconds
        return [-(-min(r[self.keys] for r in rows) // 1000)] if rows else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        added = [r for frame in rows for r in _plain(frame, self.row)]
        self.waiting.appendList(_packed(added))
        self._wake(self._due_at(added), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.done.exists() and self.done.get()[0] == watermark:
            return  # another timer of this batch has done it all
        self.done.update((watermark,))
        due, rest, n = {}, [], self.keys
        for row in (row for (rows,) in self.waiting.get() for row in pickle.loads(rows)):
            if row[n] <= watermark * 1000:
                due.setdefault(row[:n], []).append(row[n:])
            else:
                rest.append(row)
        if due:
            self.waiting.put(_packed(rest)) if rest else self.waiting.clear()
        carried = {tuple(r[:n]): (tuple(r[n]) if r[n] is not None else None, r[n + 1]) for r in self.open.get()}
        woken = [*due, *[k for k, (_, wake) in carried.items() if k not in due and wake is not None and wake <= watermark]]
        found = []
        for one in woken:
            rows = sorted(due.get(one, ()), key=lambda r: tuple(_nulls_first(r[place]) for place in self.order))
            sent, value, wake = self.fold(one, carried.get(one, (None,))[0], rows, watermark)
            found.extend(sent)
            if value is None and wake is None:
                carried.pop(one, None)
            else:
                carried[one] = (value, wake)
        if woken:
            self.open.put([(*k, *kept) for k, kept in carried.items()]) if carried else self.open.clear()
        self._wake([*self._due_at(rest), *[wake for _, wake in carried.values() if wake is not None]], watermark)
        for start in range(0, len(found), 10_000):
            columns = list(zip(*found[start:start + 10_000]))
            yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in zip(self.out, columns)})

    def close(self) -> None:
        pass


class _FirstOfKey(StatefulProcessor):
    """One group of keys: which of them were sent, and until when that is remembered."""

    def __init__(self, at: int, out: list[str], remember: int):
        self.at, self.out, self.remember = at, out, remember

    def init(self, handle) -> None:
        self.sent = handle.getListState("sent", "key string, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # the key comes first
        due = sorted((r for frame in rows for r in zip(*(frame[c].tolist() for c in self.out))), key=lambda r: r[self.at])
        # all that comes later is at least as late as the first of these rows
        sent = {k: until for k, until in self.sent.get() if until > due[0][self.at]}
        found = []
        for row in due:
            if row[self.at] >= sent.get(row[0], row[self.at]):
                found.append(row)
                sent[row[0]] = row[self.at] + self.remember
        if found:
            self.sent.put(list(sent.items()))
            yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in zip(self.out, zip(*found))})

    def close(self) -> None:
        pass


def first_of_each(stream: DataFrame, key: str, at: str, remember_hours: int, groups: int = GROUPS) -> DataFrame:
    """The first row of each key by ``at`` (microseconds, never null); others within ``remember_hours`` after it are dropped.

    Needs a stream whose batches follow each other in event time, as an append-mode window or grouping by event time sends them.
    Keys share ``groups`` states, as a state of their own costs each key several round trips to its worker. A group is read
    whenever rows of it come and written when it sends some; choose the number so that a group remembers some ten thousand keys.
    """
    use_disk_state(stream.sparkSession)
    kind, others = stream.schema[key].dataType, [c for c in stream.columns if c != key]
    shaped = stream.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group"), F.col(key).cast("string").alias(key), *others)
    schema = T.StructType(list(shaped.schema)[1:])
    processor = _FirstOfKey(1 + others.index(at), schema.fieldNames(), remember_hours * 3_600_000_000)
    sent = shaped.groupBy("_group").transformWithStateInPandas(processor, schema, "append", "none")
    return sent.withColumn(key, F.col(key).cast(kind))


#: Rows of sessions in one value of a state.
SESSION_PACK = 20_000


def _rank(known: bool, value: Any) -> tuple:
    """Place of a value as Spark orders it: null, numbers, not a number."""
    return (True, value != value, value if value == value else 0) if known else (False,)


class _LastOfSession(StatefulProcessor):
    """One group of keys: their open sessions, which keys were sent, and until when that is remembered.

    Rows are columns: key, first and last event time, stage, and (known, value) of each tie. A new row is a session of one
    event; sessions are joined when the watermark has passed the end of some, all those of the group at once.
    """

    def __init__(self, ties: int, gap: int, final: list[str], remember: int, out: list[str]):
        self.names = ["key", "first", "last", "stage", *[f"{part}{i}" for i in range(ties) for part in ("known", "tie")]]
        self.ties, self.gap, self.final, self.remember, self.out = ties, gap, set(final), remember, out

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "rows binary")
        self.sent = handle.getListState("sent", "keys binary")
        self.done = handle.getValueState("done", "watermark long")

    def _packed(self, rows: pd.DataFrame) -> list[tuple]:
        return [
            (pickle.dumps([c.to_numpy() if c.dtype != object else c.tolist() for c in (part[n] for n in self.names)]),)
            for part in (rows.iloc[start:start + SESSION_PACK] for start in range(0, len(rows), SESSION_PACK))]

    def _wake(self, last: pd.Series, watermark: int) -> None:
        # a session is over once the watermark lies beyond the retention after its last event
        self.handle.registerTimer(max((int(last.min()) + self.gap) // 1000 + 1, watermark + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        added = pd.concat([frame[["key", "at", *self.names[3:]]] for frame in rows], ignore_index=True)
        added = added.rename(columns={"at": "last"}).assign(first=added["at"])
        self.open.appendList(self._packed(added))
        if int(added["last"].min()) + self.gap < watermark * 1000:
            yield from self._settled(watermark)
        else:
            self._wake(added["last"], watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.done.exists() and self.done.get()[0] == watermark:
            return  # another timer of this batch, or a row, has done it all
        yield from self._settled(watermark)

    def _sessions(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Rows no further apart than the gap, joined to one: its last event counts, by the ties among several at that time."""
        codes = pd.factorize(rows["key"], use_na_sentinel=False)[0]
        along = np.lexsort((rows["first"], codes))
        rows, codes = rows.iloc[along].reset_index(drop=True), codes[along]
        reached = rows["last"].groupby(codes).cummax().to_numpy()
        starts = np.ones(len(rows), bool)
        starts[1:] = (codes[1:] != codes[:-1]) | (rows["first"].to_numpy()[1:] > reached[:-1] + self.gap)
        number = np.cumsum(starts) - 1
        first, last = rows["first"].to_numpy()[starts], rows["last"].to_numpy()
        along = np.lexsort((last, number))
        best = along[np.append(np.flatnonzero(np.diff(number)), len(rows) - 1)]
        latest = np.flatnonzero(last == last[best][number])
        if self.ties and len(latest) > len(best):
            several = np.bincount(number[latest], minlength=len(best)) > 1
            candidates = latest[several[number[latest]]]
            values = rows.iloc[candidates][self.names[4:]].astype(object).itertuples(index=False, name=None)
            ranks = {}
            for place, tie in zip(candidates.tolist(), values):
                rank, session = tuple(_rank(*tie[i:i + 2]) for i in range(0, 2 * self.ties, 2)), number[place]
                if session not in ranks or rank > ranks[session]:
                    ranks[session], best[session] = rank, place
        return rows.iloc[best].assign(first=first)

    def _settled(self, watermark: int) -> Iterator[pd.DataFrame]:
        self.done.update((watermark,))
        parts = [pickle.loads(rows) for (rows,) in self.open.get()]
        if not parts:
            return
        rows = pd.DataFrame({name: np.concatenate(columns) if isinstance(columns[0], np.ndarray) else pd.Series(
            [x for c in columns for x in c], dtype=object) for name, columns in zip(self.names, zip(*parts))})
        sessions = self._sessions(rows)
        over = sessions["last"].to_numpy() + self.gap < watermark * 1000
        rest = sessions[~over]
        if len(rest):
            self.open.put(self._packed(rest))
            self._wake(rest["last"], watermark)
        else:
            self.open.clear()
        ended = sessions[over & sessions["stage"].isin(self.final).to_numpy()].sort_values("last", kind="stable")
        if not len(ended):
            return
        # all that ends later is at least as late as the first of these
        begin = int(ended["last"].iloc[0]) + self.gap
        sent = {k: until for (keys,) in self.sent.get() for k, until in zip(*pickle.loads(keys)) if until > begin}
        found = []
        for k, stage, at in zip(ended["key"].tolist(), ended["stage"].tolist(), ended["last"].tolist()):
            end = at + self.gap
            if end >= sent.get(k, end):
                found.append((k, stage, at))
                sent[k] = end + self.remember
        if found:
            keys, until = list(sent), list(sent.values())
            self.sent.put([(pickle.dumps((keys[i:i + SESSION_PACK], until[i:i + SESSION_PACK])),) for i in range(0, len(keys), SESSION_PACK)])
        for start in range(0, len(found), 10_000):
            yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in zip(self.out, zip(*found[start:start + 10_000]))})

    def close(self) -> None:
        pass


def last_of_sessions(
    stream: DataFrame, key: str, delay: str, gap: int, final: list[str], ties: list[str], remember_hours: int, groups: int = 4 * GROUPS,
) -> DataFrame:
    """(key, stage, at in microseconds): the last row by ``ts`` of each session of a key, if its stage is one of ``final``. Append mode.

    Rows of a key no further apart than ``gap`` (microseconds) are a session. Of a key that was sent nothing is sent for
    ``remember_hours``. A row is late once the watermark lies beyond the gap after it, as with a session window of Spark's
    own; that one costs each session several accesses to a store. ``ties`` are columns of simple types. ``groups``: see ``in_event_order``.
    """
    use_disk_state(stream.sparkSession)
    kind = stream.schema[key].dataType
    # the watermark of these times is that of ts: they are later by the gap, and so is the delay
    due = stream.filter(F.col("ts").isNotNull()).withColumn("_due", F.timestamp_micros(F.unix_micros("ts") + F.lit(gap + 1)))
    marked = due.withWatermark("_due", f"{delay} {gap // 1000} milliseconds")

    def pair(i: int, name: str) -> list:
        whole = isinstance(stream.schema[name].dataType, T.NumericType)
        value = F.coalesce(F.col(name), F.lit(0).cast(stream.schema[name].dataType)) if whole else F.col(name)
        return [F.col(name).isNotNull().alias(f"known{i}"), value.alias(f"tie{i}")]

    shaped = marked.select(
        F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group"), "_due", F.col(key).cast("string").alias("key"),
        F.unix_micros("ts").alias("at"), "stage", *[c for i, name in enumerate(ties) for c in pair(i, name)])
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("at", T.LongType())])
    processor = _LastOfSession(len(ties), gap, final, remember_hours * 3_600_000_000, schema.fieldNames())
    sent = shaped.groupBy("_group").transformWithStateInPandas(processor, schema, "append", "eventTime")
    return sent.select(F.col("key").cast(kind).alias(key), "stage", "at")


def in_event_order(
    stream: DataFrame, keys: list[str], order: list[str], delay: str, carried: str, out: str, fold: Fold,
    groups: int = 4 * GROUPS,
) -> DataFrame:
    """Append-mode stream of what ``fold`` emits. ``stream`` has a timestamp ``ts``; ``order`` breaks ties of it.

    The rows that ``fold`` gets are tuples of ts in microseconds and the other columns but the keys, in the order of the stream.
    Keys share ``groups`` states (see ``first_of_each``); a task holds the waiting rows of one group, so choose the number so that
    a group has some ten thousand rows that wait.
    """
    use_disk_state(stream.sparkSession)
    payload = [c for c in stream.columns if c not in (*keys, "ts")]
    marked = stream.withWatermark("ts", delay).withColumn("event_us", F.unix_micros("ts"))
    row = T.StructType([*[marked.schema[c] for c in keys], T.StructField("event_us", T.LongType()), *[marked.schema[c] for c in payload]])
    places = [0, *[1 + payload.index(c) for c in order]]
    value = T._parse_datatype_string(carried)
    schema = T._parse_datatype_string(out)
    processor = _InOrder(row, len(keys), value, schema.fieldNames(), places, fold)
    shaped = marked.select(F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group"), "ts", *keys, "event_us", *payload)
    return shaped.groupBy("_group").transformWithStateInPandas(processor, schema, "append", "eventTime")
