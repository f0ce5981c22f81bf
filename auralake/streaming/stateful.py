"""Stateful streams that resume safely and take late rows.

What a stream keeps says who wrote it: a schema version, the kind of work, and a digest of its settings. State that another
version, kind or setting wrote is refused, whether it comes from the query's own checkpoint or is handed over from another
query's. State is read as a table by :func:`exported`, and given to a new query as its initial state.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, StructField, StructType

from auralake.streaming.machines import Machine, names, output_schema, plain

#: Changes when the meaning of what is kept changes.
VERSION = 1
HEADER = "version int, kind string, settings string, position long"
VALUE, HELD = "kept", "held"


class StateMismatch(ValueError):
    """State that this query must not go on from."""


def digest(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


class Kept(StatefulProcessor):
    """One value a stream: the header and the fields of ``fields``; ``position`` counts the rows it has taken."""

    def __init__(self, kind: str, settings: dict, fields: str):
        self.mark, self.fields = (VERSION, kind, digest(settings)), fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState(VALUE, f"{HEADER}, {self.fields}")

    def close(self) -> None:
        pass

    def checked(self, value: tuple) -> tuple:
        value = tuple(map(plain, value))
        if value[:3] != self.mark:
            raise StateMismatch(f"the state is of {value[:3]}, this query's of {self.mark}")
        return value

    def read(self) -> tuple[int, tuple] | None:
        value = self.kept.get()
        if value is None:
            return None
        value = self.checked(value)
        return value[3], value[4:]

    def write(self, position: int, state: tuple) -> None:
        self.kept.update((*self.mark, position, *state))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for value in initialState[names(f"{HEADER}, {self.fields}")].itertuples(index=False, name=None):
            self.kept.update(self.checked(value))


def in_order(parts: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable")


class Walk(Kept):
    """A machine over each stream, in the order of arrival from micro-batch to micro-batch and of ``order`` within each."""

    def __init__(self, machine: Machine, keep: list[str], order: str):
        super().__init__(type(machine).__name__, dataclasses.asdict(machine), machine.state)
        self.machine, self.keep, self.order = machine, keep, order

    def walk(self, rows: pd.DataFrame) -> pd.DataFrame:
        position, state = self.read() or (0, self.machine.start())
        out = []
        for row in rows[list(self.machine.inputs)].itertuples(index=False):
            state, result = self.machine.step(state, *map(plain, row))
            out.append(result)
        self.write(position + len(out), state)
        return pd.concat([rows[self.keep].reset_index(drop=True), pd.DataFrame(out, columns=names(self.machine.outputs))], axis=1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield self.walk(in_order(rows, [self.order]))


class LateWalk(Kept):
    """The same over rows that arrive in any order within the watermark: held until it has passed them, then walked in order.

    A stream holds its rows of one watermark's delay, beside its state in one value, so a micro-batch reads and writes a
    stream's state once. One timer a stream stands at the earliest of the held rows. What comes out is a row a stream with
    arrays of results: a task gathers what its timers give before it hands them on.
    """

    def __init__(self, machine: Machine, by: list[str], order: str, types: dict[str, str]):
        self.machine, self.by = machine, by
        self.columns = list(dict.fromkeys(["late_at", order, *machine.inputs]))
        self.places = [self.columns.index(c) for c in machine.inputs]
        self.results = [order, *names(machine.outputs)]
        held = ",".join(f"{c}:{types[c]}" for c in self.columns)
        super().__init__(type(machine).__name__, dataclasses.asdict(machine), f"{machine.state}, {HELD} array<struct<{held}>>")

    def wake(self, held: list[tuple], moved: list[tuple] = ()) -> None:
        """Sets the timer for the held rows; ``moved`` are those that it stood for before."""
        at, before = (-(-min(v[0] for v in rows) // 1000) if rows else None for rows in (held, moved))
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is not None:
                self.handle.registerTimer(at)

    def rows_of(self, value: tuple | None) -> tuple[int, tuple, list[tuple]]:
        position, (*state, held) = value or (0, (*self.machine.start(), ()))
        return position, tuple(state), [tuple(v.values() if isinstance(v, dict) else v) for v in held or ()]

    def passed(self, key: tuple, position: int, state: tuple, held: list[tuple], timerValues) -> tuple[list[tuple], list[Row]]:
        """What is still held, and the results of rows that the watermark has passed; both are kept."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for value in held:
            (due if value[0] <= passed else rest).append(value)
        due.sort(key=lambda v: (v[0], v[1] is None, v[1]))
        out = []
        for value in due:
            state, result = self.machine.step(state, *(value[i] for i in self.places))
            out.append((value[1], *result))
        self.write(position + len(due), (*state, rest))
        return rest, [Row(**dict(zip(self.by, key)), **dict(zip(self.results, map(list, zip(*out)))))] if out else []

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        position, state, held = self.rows_of(self.read())
        rest, out = self.passed(key, position, state, held + [tuple(plain(r[c]) for c in self.columns) for r in rows], timerValues)
        self.wake(rest, held)
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        rest, out = self.passed(key, *self.rows_of(self.read()), timerValues)
        self.wake(rest)
        return iter(out)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        columns = names(f"{HEADER}, {self.fields}")
        value = self.checked(tuple(initialState[c] if c in initialState else None for c in columns))
        position, state, held = self.rows_of((value[3], value[4:]))
        self.write(position, (*state, held))
        self.wake(held)


class Framer(Kept):
    """Chunks of samples of any length to hops of exactly ``hop``, whatever the chunks were; what is left over waits.

    A chunk marked as the last ends its stream: what is left is padded with zeros, and the next chunk begins anew.
    """

    def __init__(self, by: list[str], hop: int, order: str, samples: str, last: str | None):
        super().__init__("Framer", {"hop": hop}, "hops long, rest array<double>")
        self.by, self.hop, self.order, self.samples, self.last = by, hop, order, samples, last

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        position, (hops, rest) = self.read() or (0, (0, ()))
        rest, out = list(rest or ()), []
        rows = in_order(rows, [self.order])
        ends = rows[self.last] if self.last else [False] * len(rows)
        for samples, end in zip(rows[self.samples], ends):
            rest.extend(() if samples is None else samples)
            whole = len(rest) - len(rest) % self.hop
            taken, rest = rest[:whole], rest[whole:]
            if end and rest:
                taken, rest = taken + rest + [0.0] * (self.hop - len(rest)), []
            out += [(hops + i, taken[i * self.hop : (i + 1) * self.hop]) for i in range(len(taken) // self.hop)]
            hops += len(taken) // self.hop
            hops = 0 if end else hops
        self.write(position + len(rows), (hops, tuple(map(float, rest))))
        found = pd.DataFrame(out, columns=["hop", "samples"])
        for i, (name, value) in enumerate(zip(self.by, key)):
            found.insert(i, name, value)
        yield found


def over_stream(df: DataFrame, machine: Machine, by: list[str], order: str, initial: DataFrame | None = None) -> DataFrame:
    """(by, order, outputs) of every row of a streaming table; state is kept between micro-batches and runs.

    Rows of one stream must not arrive in a later micro-batch than rows that come after them; see :func:`over_late_stream`.
    ``initial`` has what :func:`exported` gives, with the columns of ``by``.
    """
    keep = [*by, order]
    rows = df.select(*keep, *[c for c in machine.inputs if c not in keep])
    return started(rows, by, Walk(machine, keep, order), output_schema(df, machine, keep), "none", initial)


def over_late_stream(df: DataFrame, machine: Machine, by: list[str], time: str, order: str, delay: str, initial: DataFrame | None = None) -> DataFrame:
    """(by, order, outputs) of a streaming table's rows, walked by (time, order) however they arrive within ``delay``.

    Rows come out once the watermark has passed their time. Rows later than the watermark are dropped by it, as ever.
    """
    keep = [*by, order]
    rows = df.withColumn("late_at", F.unix_micros(time)).select(*dict.fromkeys([*keep, *machine.inputs, "late_at", time])).withWatermark(time, delay)
    one = StructType.fromDDL(output_schema(df, machine, keep))
    lists = StructType([f if f.name in by else StructField(f.name, ArrayType(f.dataType)) for f in one])
    first = None if initial is None else initial.groupBy(*by)
    found = rows.groupBy(*by).transformWithState(LateWalk(machine, by, order, dict(rows.dtypes)), lists, "append", "eventTime", first)
    return found.select(*by, F.inline(F.arrays_zip(*[c for c in one.names if c not in by])))


def frames(df: DataFrame, by: list[str], order: str, samples: str, hop: int, last: str | None = None, initial: DataFrame | None = None) -> DataFrame:
    """(by, hop, samples) of a streaming table of chunks: array-valued rows, in ``order`` within each stream."""
    types = dict(df.dtypes)
    rows = df.select(*by, order, F.col(samples).cast("array<double>").alias(samples), *([last] if last else []))
    schema = ", ".join([*(f"{c} {types[c]}" for c in by), "hop long, samples array<double>"])
    return started(rows, by, Framer(by, hop, order, samples, last), schema, "none", initial)


def started(rows: DataFrame, by: list[str], processor: StatefulProcessor, schema: str, mode: str, initial: DataFrame | None) -> DataFrame:
    first = None if initial is None else initial.groupBy(*by)
    return rows.groupBy(*by).transformWithStateInPandas(processor, schema, "append", mode, first)


def exported(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a query's checkpoint holds of each stream: its key, the header, and the state."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", VALUE).load()
    return rows.select("key.*", "value.*")
