"""State machines over ordered hops, the same in a batch and in a stream.

A machine is a pure step from its state and one row to the next state and an output. What it decides depends on what it
decided before, so a stream's rows are walked in order; streams are independent of each other and run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Machine:
    """``inputs`` are the columns a step reads, ``state`` and ``outputs`` DDL; subclasses define ``start`` and ``step``."""

    inputs: tuple[str, ...] = field(init=False, default=())
    state: str = field(init=False, default="")
    outputs: str = field(init=False, default="")

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, *row: Any) -> tuple[tuple, tuple]:
        raise NotImplementedError


@dataclass(frozen=True)
class Hysteresis(Machine):
    """A channel's availability: lost after so many bad hops in a row, back after so many good ones."""

    bad_hops: int = 3
    good_hops: int = 8
    inputs = ("bad",)
    state = "valid boolean, run int"
    outputs = "valid boolean"

    def start(self) -> tuple:
        return True, 0

    def step(self, state, bad):
        valid, run = state
        against = bool(bad) == valid
        run = run + 1 if against else 0
        if against and run >= (self.bad_hops if valid else self.good_hops):
            valid, run = not valid, 0
        return (valid, run), (valid,)


@dataclass(frozen=True)
class SpeechDetector(Machine):
    """Energy above a floor that follows the quietest level down at once and rises slowly; with a hangover."""

    above_db: float = 6.0
    rise_db: float = 0.05
    hang_hops: int = 12
    least_db: float = -90.0
    inputs = ("level",)
    state = "floor double, hang int"
    outputs = "speech boolean, floor double"

    def start(self) -> tuple:
        return None, 0

    def step(self, state, level):
        floor, hang = state
        floor = level if floor is None or level < floor else floor + self.rise_db
        speech = level > self.least_db and level > floor + self.above_db
        hang, speech = (self.hang_hops, True) if speech else (hang - 1, True) if hang else (0, False)
        return (floor, hang), (speech, floor)


@dataclass(frozen=True)
class NeverVanish(Machine):
    """Falls back for a while when the output has stayed far below the input through enough speech."""

    drop_db: float = 25.0
    trigger_hops: int = 31
    fallback_hops: int = 125
    detector: SpeechDetector = SpeechDetector()
    inputs = ("level", "out_level")
    state = "floor double, hang int, active boolean, run int, left int"
    outputs = "fallback boolean, speech boolean"

    def start(self) -> tuple:
        return *self.detector.start(), False, 0, 0

    def step(self, state, level, out_level):
        floor, hang, active, run, left = state
        (floor, hang), (speech, _) = self.detector.step((floor, hang), level)
        if active:
            left -= 1
            if left <= 0:
                active, run = False, 0
        elif speech:  # hops without speech neither count nor start anew
            run = run + 1 if out_level < level - self.drop_db else 0
            if run > self.trigger_hops:
                active, run, left = True, 0, self.fallback_hops
        return (floor, hang, active, run, left), (active, speech)


@dataclass(frozen=True)
class Informative(Machine):
    """Whether a reference channel says anything of its own: lost to a copy of the primary, held through silence."""

    most_corr: float = 0.97
    least_ild: float = 1.0
    back_corr: float = 0.9
    back_ild: float = 2.0
    hold_hops: int = 31
    back_hops: int = 31
    inputs = ("corr", "ild", "silent")
    state = "informative boolean, run int"
    outputs = "informative boolean"

    def start(self) -> tuple:
        return True, 0

    def step(self, state, corr, ild, silent):
        informative, run = state
        if not silent:
            corr, ild = abs(corr), abs(ild)
            against = corr > self.most_corr and ild < self.least_ild if informative else corr < self.back_corr or ild > self.back_ild
            run = run + 1 if against else 0
            if run >= (self.hold_hops if informative else self.back_hops):
                informative, run = not informative, 0
        return (informative, run), (informative,)


@dataclass(frozen=True)
class BurstGate(Machine):
    """An adaptation gate: shut by a burst, which holds, by overload, dropout or speech; then ramped open."""

    jump_db: float = 12.0
    hold_hops: int = 4
    ramp_hops: int = 12
    inputs = ("jump", "far", "blocked")
    state = "hold int, ramp int"
    outputs = "gate double, burst boolean"

    def start(self) -> tuple:
        return 0, self.ramp_hops

    def step(self, state, jump, far, blocked):
        hold, ramp = state
        hold = self.hold_hops if jump >= self.jump_db and far else hold
        burst = hold > 0
        ramp = 0 if burst or blocked else min(self.ramp_hops, ramp + 1)
        return (max(0, hold - 1), ramp), (ramp / self.ramp_hops, burst)


@dataclass(frozen=True)
class Bypass(Machine):
    """After a missed deadline: some raw hops, then one that fades back to processed ones."""

    raw_hops: int = 4
    inputs = ("missed",)
    state = "left int"
    outputs = "mode string, weight double"

    def start(self) -> tuple:
        return (0,)

    def step(self, state, missed):
        (left,) = state
        left = self.raw_hops + 1 if missed else left
        mode, weight = ("processed", 1.0) if left == 0 else ("fade", 0.5) if left == 1 else ("raw", 0.0)
        return (max(0, left - 1),), (mode, weight)


@dataclass(frozen=True)
class FrameValidity(Machine):
    """Frames of the samples that pass: at each hop's last one, whether every sample of its window was there.

    Samples before a stream's first count as there. Other samples give no frame.
    """

    window: int = 512
    hop: int = 256
    inputs = ("available",)
    state = "sample long, last_bad long"
    outputs = "frame long, valid boolean"

    def start(self) -> tuple:
        return 0, -1 - self.window

    def step(self, state, available):
        sample, last_bad = state
        last_bad = last_bad if available else sample
        sample += 1
        result = (None, None) if sample % self.hop else (sample // self.hop - 1, last_bad < sample - self.window)
        return (sample, last_bad), result


@dataclass(frozen=True)
class ReconnectRamp(Machine):
    """Samples since a channel came back last, and a gain that is zero while it is away and then rises in a line to one."""

    ramp: int = 256
    inputs = ("available",)
    state = "there boolean, since long"
    outputs = "since long, gain double"

    def start(self) -> tuple:
        return True, None

    def step(self, state, available):
        there, since = state
        available = bool(available)
        since = 0 if available and not there else None if since is None else since + 1
        gain = min(1.0, ((self.ramp if since is None else since) + 1) / self.ramp) if available else 0.0
        return (available, since), (since, gain)


@dataclass(frozen=True)
class Refractory(Machine):
    """Candidates that lie at least ``gap`` after the last one accepted."""

    gap: float = 1.0
    inputs = ("at",)
    state = "last double"
    outputs = "kept boolean"

    def start(self) -> tuple:
        return (None,)

    def step(self, state, at):
        (last,) = state
        kept = last is None or at - last >= self.gap
        return (at if kept else last,), (kept,)


@dataclass(frozen=True)
class OnePole(Machine):
    """A smoother that rises with one coefficient and falls with another; it starts at the first value, and anew after a missing one."""

    attack: float = 0.5
    release: float = 0.9
    inputs = ("x",)
    state = "y double"
    outputs = "smooth double"

    def start(self) -> tuple:
        return (None,)

    def step(self, state, x):
        (y,) = state
        if x is None or y is None:
            y = x
        else:
            keep = self.attack if x > y else self.release
            y = keep * y + (1 - keep) * x
        return (y,), (y,)


@dataclass(frozen=True)
class Patience(Machine):
    """The best score so far, and for how many in a row none has beaten it by more than ``min_delta``."""

    min_delta: float = 0.0
    inputs = ("score",)
    state = "best double, stale int"
    outputs = "best double, stale int"

    def start(self) -> tuple:
        return float("-inf"), 0

    def step(self, state, score):
        best, stale = state
        better = score is not None and abs(score) < float("inf") and score > best + self.min_delta
        state = (score, 0) if better else (best, stale + 1)
        return state, state


def names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def plain(value: Any) -> Any:
    value = value.item() if hasattr(value, "item") else value
    return None if isinstance(value, float) and value != value else value


def output_schema(df: DataFrame, machine: Machine, keep: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"{c} {types[c]}" for c in keep), machine.outputs])


def over_batch(df: DataFrame, machine: Machine, by: list[str], order: str) -> DataFrame:
    """(by, order, outputs) of every row of a table; a group is one stream.

    Rows are sorted within partitions and walked as they pass, so a task holds one state, however long its streams are.
    """
    keep = [*by, order]
    rows = df.select(*keep, *[c for c in machine.inputs if c not in keep]).repartition(*by).sortWithinPartitions(*keep)
    found = to_arrow_schema(StructType.fromDDL(machine.outputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, state = None, None
        for batch in batches:
            out = []
            for key, row in zip(zip(*values(batch, by)), zip(*values(batch, machine.inputs))):
                if key != stream:
                    stream, state = key, machine.start()
                state, result = machine.step(state, *map(plain, row))
                out.append(result)
            results = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(found.types)]
            yield pa.record_batch([*(batch.column(c) for c in keep), *results], names=[*keep, *found.names])

    return rows.mapInArrow(run, output_schema(df, machine, keep))


def values(batch: pa.RecordBatch, columns: Iterable[str]) -> list[list]:
    return [batch.column(c).to_pylist() for c in columns]
