"""A queue fed by two lanes with round-robin arbitration and backpressure, and its faulty variants."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MUTANTS = ("lane1_starved", "no_full_pop_push", "rr_stuck_lane0", "reset_pref_lane1", "bad_wrap", "bad_data_mux")
_INPUTS = ("rst", "valid0", "data0", "valid1", "data1", "yumi")
_OUT = "ready0 int, ready1 int, selected int, valid int, data int, count int"


def fold(rows: DataFrame, key: Sequence[str], order: Sequence[str], depth: int = 8) -> DataFrame:
    """Per key: accepted, popped, last count and a checksum of popped data, in one expression. The
    queue is part of the accumulator; its length is bounded by depth."""
    array = F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).cast("int").alias(c) for c in _INPUTS])))
    empty = F.array().cast("array<int>")
    zero = F.lit(0).cast("long")
    start = F.struct(empty.alias("queue"), F.lit(0).alias("rr"), zero.alias("accepted"), zero.alias("popped"), zero.alias("checksum"))

    def merge(acc: Column, row: Column) -> Column:
        valid = F.size(acc["queue"]) > 0
        pop = (row["yumi"] == 1) & valid
        room = (F.size(acc["queue"]) < depth) | pop
        both = (row["valid0"] == 1) & (row["valid1"] == 1)
        lane = F.when(both, acc["rr"]).when(row["valid1"] == 1, F.lit(1)).otherwise(F.lit(0))
        push = room & ((row["valid0"] == 1) | (row["valid1"] == 1))
        rest = F.when(pop, F.slice(acc["queue"], 2, depth)).otherwise(acc["queue"])
        data = F.when(lane == 0, row["data0"]).otherwise(row["data1"])
        live = row["rst"] != 1
        return F.struct(
            F.when(~live, empty).when(push, F.concat(rest, F.array(data))).otherwise(rest).alias("queue"),
            F.when(~live, F.lit(0)).when(push, (lane == 0).cast("int")).otherwise(acc["rr"]).alias("rr"),
            (acc["accepted"] + (live & push).cast("long")).alias("accepted"),
            (acc["popped"] + (live & pop).cast("long")).alias("popped"),
            (acc["checksum"] + F.when(live & pop, (acc["popped"] + 1) * F.get(acc["queue"], F.lit(0))).otherwise(0)).alias("checksum"),
        )

    got = rows.groupBy(*key).agg(F.aggregate(array, start, merge).alias("end"))
    return got.select(*key, "end.accepted", "end.popped", F.size("end.queue").cast("long").alias("count"), "end.checksum")


class Queue:
    """One cycle at a time: what is seen before the edge, then the edge. fault: one of MUTANTS."""

    def __init__(self, depth: int = 8, fault: str | None = None):
        self.depth, self.fault = depth, fault
        self.slots = [0] * depth
        self.wrap = depth - 1 if fault == "bad_wrap" else depth  # the pointers' range
        self.reset()

    def reset(self) -> None:
        self.write = self.read = self.count = 0
        self.rr = 1 if self.fault == "reset_pref_lane1" else 0

    def cycle(self, rst: int, valid0: int, data0: int, valid1: int, data1: int, yumi: int) -> tuple:
        valid = int(self.count > 0)
        pop = bool(yumi and valid)
        room = self.count < self.depth or pop and self.fault != "no_full_pop_push"
        lane = (0 if self.fault == "rr_stuck_lane0" else self.rr) if valid0 and valid1 else 1 if valid1 else 0
        offer = bool(room and (valid0 or valid1))
        push = offer and not (self.fault == "lane1_starved" and valid1 and not valid0)
        seen = (int(push and lane == 0), int(push and lane == 1), lane if offer else 0, valid, self.slots[self.read] if valid else None, self.count)
        if rst:
            self.reset()
            return seen
        if push:
            self.slots[self.write] = data0 if (lane == 0) != (self.fault == "bad_data_mux") else data1
            self.write = (self.write + 1) % self.wrap
            self.rr = int(lane == 0)
        if pop:
            self.read = (self.read + 1) % self.wrap
        self.count += int(push) - int(pop)
        return seen


def trace(rows: DataFrame, key: Sequence[str], order: Sequence[str], depth: int = 8, fault: str | None = None) -> DataFrame:
    """rows (key, order, rst, valid0, data0, valid1, data1, yumi) with what is seen before each edge:
    ready0, ready1, selected, valid, data (null unless valid), count.

    A task streams its keys one after the other, sorted, so a key's rows need not fit its memory.
    """
    own = rows.select(*key, *order, *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in _INPUTS])
    names, places = list(key), list(_INPUTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, queue = None, Queue(depth, fault)
        for batch in batches:
            seen = []
            for k, x in zip(batch[names].itertuples(index=False, name=None), batch[places].itertuples(index=False, name=None), strict=True):
                if k != now:
                    now, queue = k, Queue(depth, fault)
                seen.append(queue.cycle(*x))
            out = pd.DataFrame(seen, columns=["ready0", "ready1", "selected", "valid", "data", "count"], index=batch.index)
            yield pd.concat([batch, out.astype("Int64")], axis=1)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, f"{types}, {_OUT}")


def asserts(depth: int = 8) -> dict[str, Column]:
    """Per-cycle invariants over a trace that also has count_before (the previous cycle's count)."""
    c = F.col
    return {
        "count_in_range": c("count").between(0, depth),
        "valid_is_nonempty": (c("valid") == 1) == (c("count") > 0),
        "one_ready": c("ready0") + c("ready1") <= 1,
        "ready_needs_valid": ((c("ready0") == 0) | (c("valid0") == 1)) & ((c("ready1") == 0) | (c("valid1") == 1)),
        "count_steps": F.coalesce(F.abs(c("count") - c("count_before")) <= 1, F.lit(True)) | (c("rst_before") == 1),
    }


def covers(depth: int = 8) -> dict[str, Column]:
    """The seven points of functional coverage, over a trace that `with_before` has widened."""
    c = F.col
    pushed = c("ready0") + c("ready1") == 1
    both = (c("valid0") == 1) & (c("valid1") == 1)
    return {
        "reset": c("rst") == 1,
        "lane0_basic": (c("ready0") == 1) & (c("valid1") == 0),
        "lane1_only": (c("ready1") == 1) & (c("valid0") == 0),
        "round_robin_contention": both & (c("ready1") == 1),
        "full_pop_push": (c("count") == depth) & (c("yumi") == 1) & pushed,
        "reset_restarts_arbitration": (c("rst_before") == 1) & both & (c("ready0") == 1),
        "wraparound_order": (c("pushed_before") > depth) & (c("valid") == 1),
    }


def with_before(traced: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The trace with the previous cycle's count and reset, and the pushes since the last reset."""
    w = Window.partitionBy(*key).orderBy(*order)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    out = traced.withColumns({"count_before": F.lag("count").over(w), "rst_before": F.coalesce(F.lag("rst").over(w), F.lit(0)), "resets": F.coalesce(F.sum("rst").over(earlier), F.lit(0))})
    since = Window.partitionBy(*key, "resets").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("pushed_before", F.coalesce(F.sum(F.col("ready0") + F.col("ready1")).over(since), F.lit(0)))


def kills(rows: DataFrame, key: Sequence[str], order: Sequence[str], depth: int = 8, faults: Sequence[str] = MUTANTS) -> DataFrame:
    """One row per faulty variant: mismatching cycles against the sound queue, and whether it is killed. A task
    runs all variants beside the sound queue in one pass over its sorted keys and gives one row for each."""
    own = rows.select(*key, *order, *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in _INPUTS])
    names, places, variants = list(key), list(_INPUTS), list(faults)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, gold, others, n = None, Queue(depth), [], [0] * len(variants)
        for batch in batches:
            for k, x in zip(batch[names].itertuples(index=False, name=None), batch[places].itertuples(index=False, name=None), strict=True):
                if k != now:
                    now, gold, others = k, Queue(depth), [Queue(depth, f) for f in variants]
                seen = gold.cycle(*x)
                for i, q in enumerate(others):
                    n[i] += q.cycle(*x) != seen
        yield pd.DataFrame({"mutant": variants, "mismatches": n})

    found = own.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, "mutant string, mismatches long")
    return found.groupBy("mutant").agg(F.sum("mismatches").alias("mismatches")).withColumn("killed", F.col("mismatches") > 0)


_POP = (0, 0, 0, 0, 0, 1)
# The four directed scenarios, as (rst, valid0, data0, valid1, data1, yumi) a cycle.
SCENARIOS = {
    "lane1_only_order": [(0, 0, 0, 1, 0x81, 0), (0, 0, 0, 1, 0x82, 0), (0, 0, 0, 1, 0x83, 0), _POP, _POP, _POP],
    "round_robin_contention": [(0, 1, 0x10 + i, 1, 0xA0 + i, 0) for i in range(6)] + [_POP] * 6,
    "full_accepts_after_pop": [(0, 1, 0x30 + i, 0, 0, 0) for i in range(8)] + [(0, 0, 0, 1, 0xEE, 1)] + [_POP] * 8,
    "reset_flushes_and_restarts": [(0, 1, 0x44, 0, 0, 0), (0, 0, 0, 1, 0x99, 0), (1, 0, 0, 0, 0, 0), (1, 0, 0, 0, 0, 0), (0, 0, 0, 1, 0x55, 0), _POP],
}


def scenario_rows(spark) -> DataFrame:
    rows = [(name, i, *x) for name, steps in SCENARIOS.items() for i, x in enumerate(steps)]
    return spark.createDataFrame(rows, "scenario string, cycle int, rst int, valid0 int, data0 int, valid1 int, data1 int, yumi int")


def scenario_results(spark, fault: str | None = None, depth: int = 8) -> DataFrame:
    """scenario, status: PASS where a queue with the fault does as the sound one in every cycle."""
    rows, seen = scenario_rows(spark), ("ready0", "ready1", "selected", "valid", "data", "count")
    gold = trace(rows, ["scenario"], ["cycle"], depth)
    other = trace(rows, ["scenario"], ["cycle"], depth, fault).select("scenario", "cycle", *[F.col(c).alias(f"x_{c}") for c in seen])
    same = F.lit(True)
    for c in seen:
        same = same & F.col(c).eqNullSafe(F.col(f"x_{c}"))
    return gold.join(other, ["scenario", "cycle"]).groupBy("scenario").agg(F.when(F.bool_and(same), "PASS").otherwise("FAIL").alias("status"))
