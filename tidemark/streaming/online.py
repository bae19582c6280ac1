"""Stays and hysteresis of unbounded streams: sequential state per key, in event time.

A row is folded in once the watermark has passed it, in the order of time and ties, so rows may come in any order up to
`late` behind the newest one; rows later than that are dropped by Spark and counted in the query's progress. A key that has
been silent for longer than `expire` ends: what it still holds is told and its state is removed, and rows after such a pause
begin anew. State lies in the state store and is restored with the checkpoint; it is bounded by the rows of `late`, plus
`ahead` rows of a stay or the rows of a run shorter than `least`. All that a key keeps is one value with its rows packed, as a
key's cost is its calls to the state store: it is read once and written once when rows come or the watermark passes one.

The session needs the RocksDB state store, which use_state_store() sets.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, StructField, StructType

from tidemark.sources.tables import ship


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed them and hands them to step() in order; finish() ends a key.

    rows are tuples (us, ...) of the columns. `state` is the type of what a fold keeps besides them.
    """

    def __init__(self, columns: list[str], state: StructType, result: StructType, expire_us: int):
        self._columns, self._state_type, self._result, self._expire = columns, state, result, expire_us

    def init(self, handle) -> None:
        self._handle = handle
        packed = [StructField(n, BinaryType()) for n in ("waiting", "queue")]
        self._kept = handle.getValueState("kept", StructType([*self._state_type, *packed]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [r for part in rows for r in self._tuples(part)]
        yield from self._advance(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _tuples(self, part: pd.DataFrame) -> list[tuple]:
        plain = lambda v: None if v is None or v is pd.NaT or v != v else v.item() if hasattr(v, "item") else v
        return list(zip(*([plain(v) for v in part[c].tolist()] for c in self._columns), strict=True))

    def _in_order(self, rows: list[tuple]) -> list[tuple]:
        try:
            return sorted(rows)
        except TypeError:  # nulls come first
            return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))

    def _advance(self, key, fresh: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        kept = self._kept.get()
        *fold, waiting, queue = kept or (None,) * (len(self._state_type) + 2)
        waiting, queue = (pickle.loads(bytes(rows)) if rows else [] for rows in (waiting, queue))
        waiting = self._in_order([*waiting, *fresh])
        passed = watermark_ms * 1000
        due = [r for r in waiting if r[0] <= passed]
        waiting = waiting[len(due) :]
        last, inner = (fold[0], fold[1:]) if fold[0] is not None else (None, None)
        told: list[tuple] = []
        for r in due:
            if last is not None and r[0] - last > self._expire:
                told += self.finish(inner, queue)
                inner, queue = None, []
            inner = self.step(inner, queue, r, told)
            last = r[0]
        if last is not None and not waiting and last + self._expire < passed:
            told += self.finish(inner, queue)
            last, queue = None, []
        if last is not None or waiting:
            ended = [None] * len(self._state_type)
            self._kept.update((*((last, *inner) if last is not None else ended), *(pickle.dumps(rows) if rows else None for rows in (waiting, queue))))
        elif kept:
            self._kept.clear()
        wake = waiting[0][0] if waiting else last + self._expire + 1000 if last is not None else None
        if wake is not None and -(-wake // 1000) > watermark_ms:
            self._handle.registerTimer(-(-wake // 1000))
        if told:
            yield pd.DataFrame([(*key, *r) for r in told], columns=self._result.names)

    def step(self, inner, queue: list[tuple], row: tuple, told: list[tuple]):
        raise NotImplementedError

    def finish(self, inner, queue: list[tuple]) -> list[tuple]:
        raise NotImplementedError


class _Stays(_InOrder):
    """inner: t0, t1, n, x, y and reach of the stay, or no t0 while its anchor still waits for rows ahead of it in the queue."""

    def __init__(self, *args, tolerance: float, least: int, ahead: int, floor: float):
        super().__init__(*args)
        self._tolerance, self._least, self._ahead, self._floor = tolerance, least, ahead, floor

    def step(self, inner, queue, row, told):
        queue.append(row)
        return self._settle(inner or [None] * 6, queue, told, False)

    def finish(self, inner, queue):
        told: list[tuple] = []
        inner = self._settle(inner, queue, told, True)
        return told + self._stay(inner)

    def _stay(self, inner) -> list[tuple]:
        return [tuple(inner[:3])] if inner[0] is not None and inner[1] - inner[0] >= self._least else []

    def _settle(self, inner, queue, told, all_of_it: bool):
        while queue:
            if inner[0] is None:
                if len(queue) < self._ahead and not all_of_it:
                    break
                us, x, y, *tall = queue[0]
                reach = self._tolerance * max(median(r[3] for r in queue[: self._ahead]), self._floor) if tall else self._tolerance
                inner = [us, us, 0, x, y, reach]
            us, x, y = queue[0][:3]
            if ((x - inner[3]) ** 2 + (y - inner[4]) ** 2) ** 0.5 > inner[5]:
                told += self._stay(inner)
                inner = [None] * 6
                continue
            inner = [inner[0], us, inner[2] + 1, *inner[3:]]
            queue.pop(0)
        return inner


class _Hysteresis(_InOrder):
    """inner: the run's flag, its t0, and whether its rows are told as they come; the queue holds rows of an open short run."""

    def __init__(self, *args, flag: int, least: int, step_us: int):
        super().__init__(*args)
        self._flag, self._least, self._step = flag, least, step_us

    def step(self, inner, queue, row, told):
        flag = row[self._flag]
        if inner is None:
            inner = [flag, row[0], True]  # the first run stays as it is
        elif flag != inner[0]:
            told += [self._other(r) for r in queue]
            queue.clear()
            inner = [flag, row[0], False]
        queue.append(row)
        if inner[2] or row[0] - inner[1] + self._step >= self._least:
            told += queue
            queue.clear()
            inner = [inner[0], inner[1], True]
        return inner

    def _other(self, row: tuple) -> tuple:
        f = row[self._flag]
        return (*row[: self._flag], None if f is None else not f, *row[self._flag + 1 :])

    def finish(self, inner, queue):
        return list(queue)  # so does the last run


def _run(stream: DataFrame, keys: list[str], time: str, late: str, columns: dict, make, result: StructType) -> DataFrame:
    ship(stream.sparkSession)
    typed = stream.withColumn(time, F.col(time).cast("timestamp")).filter(F.col(time).isNotNull()).withWatermark(time, late)
    rows = typed.select(*keys, time, *(c.alias(f"v_{n}") for n, c in columns.items()))
    return rows.groupBy(*keys).transformWithStateInPandas(make([f"v_{n}" for n in columns]), result, "append", "EventTime")


def online_stays(stream: DataFrame, keys: list[str], time: str, x: str, y: str, tolerance: float, least_us: int, late: str, expire_us: int, height: str | None = None, ahead: int = 11, floor: float = 8.0) -> DataFrame:
    """keys, t0, t1 (microseconds) and n of stays: operators.folds.anchored_stays over a stream."""
    columns = {"us": F.unix_micros(time), "x": F.col(x).cast("double"), "y": F.col(y).cast("double"), **({"tall": F.col(height).cast("double")} if height else {})}
    result = StructType([*(stream.schema[k] for k in keys), *StructType.fromDDL("t0 long, t1 long, n long").fields])
    state = StructType.fromDDL("last long, t0 long, t1 long, n long, x double, y double, reach double")
    make = lambda names: _Stays(names, state, result, expire_us, tolerance=tolerance, least=least_us, ahead=ahead if height else 1, floor=floor)
    return _run(stream.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, time, late, columns, make, result)


def online_hysteresis(stream: DataFrame, keys: list[str], time: str, tie: str, flag: str, least_us: int, late: str, expire_us: int, step_us: int = 0) -> DataFrame:
    """keys, us, tie and flag of each row with interior runs shorter than least inverted: operators.runs.flip_short_runs over a
    stream. Rows of one time come in the order of tie."""
    columns = {"us": F.unix_micros(time), tie: F.col(tie), flag: F.col(flag).cast("boolean")}
    result = StructType([*(stream.schema[k] for k in keys), *StructType.fromDDL("us long").fields, StructField(tie, stream.schema[tie].dataType), *StructType.fromDDL(f"`{flag}` boolean").fields])
    state = StructType.fromDDL("last long, flag boolean, t0 long, told boolean")
    make = lambda names: _Hysteresis(names, state, result, expire_us, flag=2, least=least_us, step_us=step_us)
    return _run(stream, keys, time, late, columns, make, result)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, appends its rows to a Parquet table, and gives that table as it is then."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
