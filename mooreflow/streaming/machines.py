"""Machines over Structured Streaming: one state value per key, carried from batch to batch.

Rows of a key must arrive in order across batches; within a batch they are sorted. There is no late
data in the language, so rows that arrive late are an error of the source: with reject_late a row whose
order is not above the last one seen raises, else it is run where it arrives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from mooreflow.operators.run import Stimulus
from mooreflow.plans.language import Guard, Machine
from mooreflow.plans.lower import output_values

#: A stream needs this state store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Input bits up to which a machine's steps are looked up.
TABLE_BITS = 10
_OPS = {"==": int.__eq__, "!=": int.__ne__, "<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__}


def holds(g: Guard, m: Machine, row: dict[str, int]) -> bool:
    """The guard on one row of inputs."""
    return bool(_value(g, {p.name: p.low for p in m.inputs}, row))


def _value(g: Guard, low: dict[str, int], row: dict[str, int]) -> int:
    if g.kind == "signal":
        return row[g.name]
    if g.kind == "bit":
        return row[g.name] >> (g.value - low[g.name]) & 1
    if g.kind == "number":
        return g.value
    parts = [_value(p, low, row) for p in g.parts]
    if g.kind == "not":
        return int(not parts[0])
    if g.kind in ("and", "or"):
        return int(all(parts) if g.kind == "and" else any(parts))
    return int(_OPS[g.kind](*parts))


def next_state(m: Machine, state: int, row: dict[str, int]) -> int:
    chosen = next((t.target for t in m.states[state].transitions if t.guard is not None and holds(t.guard, m, row)), None)
    return m.ordinal(chosen or next(t.target for t in m.states[state].transitions if t.guard is None))


def table_of(m: Machine, inputs: Sequence[str]) -> list[list[int]] | None:
    """Next states by state and input word, the inputs' bits side by side, the first lowest; none for more
    than TABLE_BITS bits, whose rows are stepped through the guards."""
    width = {p.name: p.width for p in m.inputs}
    if sum(width[n] for n in inputs) > TABLE_BITS:
        return None
    rows = [{}]
    for n in inputs:
        rows = [r | {n: v} for v in range(1 << width[n]) for r in rows]
    return [[next_state(m, i, r) for r in rows] for i in range(len(m.states))]


class _Runner(StatefulProcessor):
    def __init__(self, m: Machine, keys: list[str], order: list[str], inputs: list[str], reset: bool, reject_late: bool):
        self.m, self.keys, self.order, self.inputs, self.reset, self.reject_late = m, keys, order, inputs, reset, reject_late
        self.values = {p.name: output_values(m, p.name) for p in m.outputs}
        self.table = table_of(m, inputs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("st", LongType()), *[StructField(f"last_{i}", LongType()) for i in range(len(self.order))]]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        kept = self.state.get() if self.state.exists() else None
        now, last = (self.m.ordinal(self.m.reset), None) if kept is None else (kept[0], tuple(kept[1:]))
        pre, post = [], []
        places = list(zip(*[self._number(batch[c]) for c in self.order], strict=True))
        if self.reject_late and last is not None and places and places[0] <= last:
            raise ValueError(f"key {key}: a row at {places[0]} came after {last}")
        first, resets = self.m.ordinal(self.m.reset), batch["in_rst"].tolist() if self.reset else [False] * len(batch)
        for rst, step in zip(resets, self._steps(batch), strict=True):
            pre.append(now)
            now = first if rst else step(now)
            post.append(now)
        self.state.update((now, *(max(places[-1], last) if last else places[-1])))
        out = batch[self.keys + self.order].assign(state_pre=pre, state_post=post)
        for n, v in self.values.items():
            out[n] = [v[s] for s in post]
        yield out

    def _steps(self, batch: pd.DataFrame) -> Iterator[Callable[[int], int]]:
        """For each row, its step from a state to the next."""
        if self.table is None:
            rows = zip(*[batch[f"in_{n}"].tolist() for n in self.inputs], strict=True)
            yield from (lambda now, r=dict(zip(self.inputs, r, strict=True)): next_state(self.m, now, r) for r in rows)
            return
        word, shift, width = np.zeros(len(batch), np.int64), 0, {p.name: p.width for p in self.m.inputs}
        for n in self.inputs:
            word |= batch[f"in_{n}"].to_numpy(np.int64) << shift
            shift += width[n]
        yield from (lambda now, w=w: self.table[now][w] for w in word.tolist())

    @staticmethod
    def _number(x: pd.Series) -> list[int]:
        return x.astype("int64").tolist()

    def close(self) -> None:
        pass


def run(m: Machine, s: Stimulus, reject_late: bool = True) -> DataFrame:
    """A streaming stimulus to the same columns as the batch trace. Order columns are timestamps or
    integers. The session's state store must be PROVIDER; no watermark is used."""
    from mooreflow.plans.lower import reads

    table = s.table(m)
    types = {f.name: f.dataType.simpleString() for f in table.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (*s.key, *s.order)), "state_pre long", "state_post long", *(f"`{p.name}` long" for p in m.outputs)])
    runner = _Runner(m, list(s.key), list(s.order), reads(m), s.reset is not None, reject_late)
    return table.groupBy(*[F.col(c) for c in s.key]).transformWithStateInPandas(runner, schema, "append", "none")
