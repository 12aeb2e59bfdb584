"""Running machines over stimulus tables: per-key folds and traces.

A stimulus is a table with key columns, order columns that are unique within a key, and a column for
each input. Two paths, one step: `fold` for what a key ends with, `trace` for every row's state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooreflow.plans.language import Machine
from mooreflow.plans.lower import outputs, reads, state_name, step
from mooreflow.session import staged

#: Rows of a chunk, and chunks of a group of chunks.
CHUNK = 64


@dataclass(frozen=True)
class Stimulus:
    """rows with key and order columns, inputs by port name, and a reset condition where there is one.
    Bits above an input's width are dropped; a null input counts as 0 and a null reset as false."""

    rows: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    inputs: dict[str, Column]
    reset: Column | None = None

    def table(self, m: Machine) -> DataFrame:
        """key, order, and only the inputs that the machine reads."""
        width = {p.name: p.width for p in m.inputs}
        own = [F.coalesce(self.inputs[n].cast("long").bitwiseAND((1 << width[n]) - 1), F.lit(0)).alias(f"in_{n}") for n in reads(m)]
        rst = [] if self.reset is None else [F.coalesce(self.reset, F.lit(False)).alias("in_rst")]
        return self.rows.select(*self.key, *self.order, *own, *rst)


def _step(m: Machine, s: Stimulus, state: Column, row: Column) -> Column:
    return step(m, state, lambda n: row[f"in_{n}"], None if s.reset is None else row["in_rst"])


def _fields(m: Machine, s: Stimulus) -> list[str]:
    return [f"in_{n}" for n in reads(m)] + ([] if s.reset is None else ["in_rst"])


def fold(m: Machine, s: Stimulus, counts: dict[str, Sequence[int]] | None = None) -> DataFrame:
    """Per key: rows, last_state, and for each name in counts how many rows ended in one of the given
    states. A key's rows are sorted and folded in one expression; for keys of any length use
    `trace`, which cuts keys into chunks."""
    counts = counts or {}
    rows = F.array_sort(F.collect_list(F.struct(*s.order, *_fields(m, s))))
    start = F.struct(F.lit(m.ordinal(m.reset)).alias("state"), *[F.lit(0).cast("long").alias(c) for c in counts])

    def merge(acc: Column, row: Column) -> Column:
        now = _step(m, s, acc["state"], row)
        return F.struct(now.alias("state"), *[(acc[c] + now.isin(list(v)).cast("long")).alias(c) for c, v in counts.items()])

    got = s.table(m).groupBy(*s.key).agg(F.count("*").alias("rows"), F.aggregate(rows, start, merge).alias("end"))
    return got.select(*s.key, "rows", state_name(m, F.col("end.state")).alias("last_state"), *[F.col(f"end.{c}").alias(c) for c in counts])


def _rows(machines: Sequence[Machine], s: Stimulus, keep: Sequence[str]) -> tuple[DataFrame, list[list[str]]]:
    """key, order, keep and the inputs that the machines read, each as wide as its machine has it; and the
    names of these columns, by machine."""
    fields, own = [], []
    for i, m in enumerate(machines):
        width = {p.name: p.width for p in m.inputs}
        own += [F.coalesce(s.inputs[n].cast("long").bitwiseAND((1 << width[n]) - 1), F.lit(0)).alias(f"in{i}_{n}") for n in reads(m)]
        fields.append([f"in{i}_{n}" for n in reads(m)])
    if s.reset is not None:
        own.append(F.coalesce(s.reset, F.lit(False)).alias("in_rst"))
    return s.rows.select(*s.key, *s.order, *own, *keep), fields


def _gathered(df: DataFrame, by: Sequence[str], at: str, states: Sequence[int]) -> DataFrame:
    """By group, the maps of its parts in order as `items` (at, map0, ...), and their compositions."""
    maps = [f"map{i}" for i in range(len(states))]
    items = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), *maps))).alias("items"))

    def through(i: int) -> Column:
        same = F.sequence(F.lit(0), F.lit(states[i] - 1))
        return F.aggregate("items", same, lambda acc, x: F.transform(acc, lambda j: F.get(x[f"map{i}"], j)))

    return items.withColumns({m: through(i) for i, m in enumerate(maps)})


def _entered(df: DataFrame, by: Sequence[str], at: str, enter: Sequence[Column]) -> DataFrame:
    """A row for each of a group's items with the states in which it is entered, given those of the group."""
    names = [f"enter{i}" for i in range(len(enter))]
    none = F.array().cast(f"array<struct<`{at}`:bigint,{','.join(f'{n}:int' for n in names)}>>")

    def merge(acc: Column, x: Column) -> Column:
        now = [F.get(x[f"map{i}"], acc[n]).alias(n) for i, n in enumerate(names)]
        return F.struct(*now, F.concat(acc["out"], F.array(F.struct(x["at"].cast("long").alias(at), *[acc[n].alias(n) for n in names]))).alias("out"))

    start = F.struct(*[c.cast("int").alias(n) for c, n in zip(enter, names, strict=True)], none.alias("out"))
    return df.select(*by, F.inline(F.aggregate("items", start, merge, lambda acc: acc["out"])))


def traces(machines: Sequence[Machine], s: Stimulus, keep: Sequence[str] = ()) -> DataFrame:
    """Per row: key, order, keep columns, and for the i-th machine pre{i} and post{i}, its states (ordinals)
    before and after the row; all machines in one pass over the rows.

    Rows are spread by ranges of key and order, so one key may span any number of tasks. Each chunk of
    rows becomes a map from the state before it to the state after it; the maps are composed in order,
    within groups of chunks, over the groups of a range, and over the ranges of a key. Then the states
    are handed down the same levels, and every chunk is replayed from its entry state. Each level is one
    pass over its parts. The chunks are written to the shared folder when this is called: two steps read
    them, and must see the same ranges.
    """
    states, key = [len(m.states) for m in machines], list(s.key)
    own, fields = _rows(machines, s, keep)
    ranged = own.repartitionByRange(*key, *s.order).sortWithinPartitions(*key, *s.order)
    rows = ranged.withColumns({"part": F.spark_partition_id().cast("long"), "n": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    inputs = [*dict.fromkeys(f for own in fields for f in own), *([] if s.reset is None else ["in_rst"])]
    chunks = rows.groupBy(*key, "part", F.floor(F.col("n") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("n", *s.order, *inputs, *keep))).alias("rows"))

    def move(i: int, state: Column, row: Column) -> Column:
        return step(machines[i], state, lambda n: row[f"in{i}_{n}"], None if s.reset is None else row["in_rst"])

    maps = {f"map{i}": F.array(*[F.aggregate("rows", F.lit(k), lambda acc, row: move(i, acc, row)) for k in range(n)]) for i, n in enumerate(states)}
    chunks = staged(chunks.withColumns(maps).withColumn("group", F.floor(F.col("chunk") / CHUNK)), "chunks")
    groups = _gathered(chunks, [*key, "part", "group"], "chunk", states)
    parts = _gathered(groups, [*key, "part"], "group", states)
    # One row for each key and range it spans: the only step that follows a key through its ranges.
    whole = _gathered(parts, key, "part", states)
    enter = [F.col(f"enter{i}") for i in range(len(machines))]
    down = _entered(whole, key, "part", [F.lit(m.ordinal(m.reset)) for m in machines])
    down = _entered(_joined(parts, down, [*key, "part"]), [*key, "part"], "group", enter)
    down = _entered(_joined(groups, down, [*key, "part", "group"]), [*key, "part"], "chunk", enter)
    out = [*s.order, *keep]
    types = dict(own.dtypes)
    none = F.array().cast(f"array<struct<{','.join([*(f'`{c}`:{types[c]}' for c in out), *(f'pre{i}:int,post{i}:int' for i in range(len(machines)))])}>>")

    def replay(acc: Column, row: Column) -> Column:
        now = [move(i, acc[f"s{i}"], row) for i in range(len(machines))]
        told = [c for i, x in enumerate(now) for c in (acc[f"s{i}"].alias(f"pre{i}"), x.alias(f"post{i}"))]
        return F.struct(*[x.alias(f"s{i}") for i, x in enumerate(now)], F.concat(acc["out"], F.array(F.struct(*[row[c].alias(c) for c in out], *told))).alias("out"))

    start = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(enter)], none.alias("out"))
    entered = _joined(chunks.drop(*maps), down, [*key, "part", "chunk"])
    return entered.select(*key, F.inline(F.aggregate("rows", start, replay, lambda acc: acc["out"])))


def _joined(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """a with the columns of b; null keys are keys."""
    b = b.withColumnsRenamed({c: f"{c}_" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return a.join(b, same).drop(*[f"{c}_" for c in on])


def trace(m: Machine, s: Stimulus, keep: Sequence[str] = ()) -> DataFrame:
    """Per row: key, order, keep columns, state_pre, state_post (ordinals), and the outputs after it."""
    out = traces([m], s, keep).withColumnsRenamed({"pre0": "state_pre", "post0": "state_post"})
    return out.withColumns(outputs(m, F.col("state_post")))
