"""Scores: weighted sub-scores, hard caps, pass rates and spreads, as columns and aggregates."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooreflow.plans.language import Machine, compile_text, strict_diagnostics
from mooreflow.plans.lower import output_values
from mooreflow.streaming.machines import next_state

# Weights and thresholds of the scores.
MACHINE_WEIGHTS = {"compile": 0.2, "lint": 0.1, "behavior": 0.7}
DV_WEIGHTS = {"golden": 0.25, "mutants": 0.45, "coverage": 0.20, "hygiene": 0.10}
FORMAL_WEIGHTS = {"golden": 0.20, "mutants": 0.65, "cover": 0.10, "hygiene": 0.05}
CLEAN, CORRECT = 0.999, 0.7
CELLS = (60, 1400)
COVERAGE_POINTS = ("reset", "lane0_basic", "lane1_only", "round_robin_contention", "full_pop_push", "reset_restarts_arbitration", "wraparound_order")


def weighted(parts: dict[str, Column], weights: dict[str, float], digits: int) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * parts[name]
    return F.round(total, digits)


def machine_reward(compiled: Column, lint: Column, behavior: Column) -> Column:
    """0.2 compile + 0.1 lint + 0.7 behaviour; nothing without a compile. A lint failure does not block
    the behaviour."""
    parts = {"compile": compiled, "lint": lint, "behavior": behavior}
    return F.when(compiled == 0, 0.0).otherwise(weighted(parts, MACHINE_WEIGHTS, 4))


def repair_reward(functional: Column, no_latch: Column, in_band: Column, synthesises: Column, lint: Column) -> Column:
    """0.5 functional + 0.1 for each of three synthesis checks + 0.2 lint; nothing if nothing functions."""
    return F.when(functional == 0, 0.0).otherwise(F.round(0.5 * functional + 0.1 * (no_latch + in_band + synthesises) + 0.2 * lint, 6))


def dv_reward(golden: Column, mutants: Column, coverage: Column, hygiene: Column) -> Column:
    """Capped to nothing if the sound design fails; mutants then count as none."""
    return F.when(golden == 0, 0.0).otherwise(weighted({"golden": golden, "mutants": mutants, "coverage": coverage, "hygiene": hygiene}, DV_WEIGHTS, 6))


def formal_reward(golden: Column, mutants: Column, cover: Column, hygiene: Column) -> Column:
    return F.when(golden == 0, 0.0).otherwise(weighted({"golden": golden, "mutants": mutants, "cover": cover, "hygiene": hygiene}, FORMAL_WEIGHTS, 6))


def kill_ratio(killed: Column, golden_passed: Column, total: int = 5) -> Column:
    return F.when(golden_passed, killed / total).otherwise(0.0)


def scenario_ratio(scenarios: DataFrame, keys: Sequence[str], total: int = 4) -> DataFrame:
    """Share of the fixed number of scenarios that passed; of a scenario's lines the last counts."""
    last = scenarios.groupBy(*keys, "scenario").agg(F.max_by("status", "line").alias("status"))
    return last.groupBy(*keys).agg((F.count_if(F.col("status") == "PASS") / total).alias("ratio"))


def coverage_ratio(reported: Column, points: Sequence[str] = COVERAGE_POINTS) -> Column:
    """Share of the required points that a map<string,boolean> reports as hit."""
    hit = F.map_keys(F.map_filter(F.coalesce(reported, F.create_map().cast("map<string,boolean>")), lambda k, v: F.coalesce(v, F.lit(False))))
    return F.size(F.array_intersect(hit, F.array(*map(F.lit, points)))) / len(points)


def cells(netlists: DataFrame, column: str = "netlist") -> DataFrame:
    """Cells of parsed netlists: the other columns, module, cell, type."""
    rest = [c for c in netlists.columns if c != column]
    modules = netlists.select(*rest, F.explode(F.col(f"{column}.modules")).alias("module", "m"))
    return modules.select(*rest, "module", F.explode("m.cells").alias("cell", "c")).select(*rest, "module", "cell", F.col("c.type").alias("type"))


def in_band(n: Column) -> Column:
    return n.between(*CELLS)


def latches(log: Column) -> Column:
    """Latches that a statistics listing counts: the numbers on its $dlatch lines."""
    found = F.regexp_extract_all(log, F.lit(r"(?m)^.*?\$_?(?:ad|d)latch\w*\s+([0-9]+)\s*$"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))


def subscore(raw: Column, weighted_score: Column, weight: Column) -> Column:
    """The raw score, or weighted over weight, between 0 and 1."""
    value = F.coalesce(raw, F.when(weight == 0, 0.0).otherwise(F.try_divide(F.coalesce(weighted_score, F.lit(0.0)), weight)), F.lit(0.0))
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def reconciled(subscores: DataFrame, rewards: DataFrame, keys: Sequence[str]) -> DataFrame:
    """subscores (keys, name, weight, value), with a hard_cap_penalty where the reward is below their sum."""
    sums = subscores.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("value")).alias("total")).join(rewards, list(keys))
    capped = sums.where(F.col("reward") + 1e-9 < F.col("total"))
    extra = capped.select(*keys, F.lit("hard_cap_penalty").alias("name"), (F.col("reward") - F.col("total")).alias("weight"), F.lit(1.0).alias("value"))
    return subscores.select(*keys, "name", "weight", "value").unionByName(extra)


def summary(grades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """tasks, compiled, functional_pass_at_1, fully_clean_pass_at_1, behavior_correct, avg_reward; zeros
    for an empty run. grades: reward, compile, behavior."""
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return grades.groupBy(*keys).agg(
        F.count("*").alias("tasks"),
        share(F.col("compile") == 1).alias("compiled"),
        share(F.col("behavior") == 1).alias("functional_pass_at_1"),
        share(F.col("reward") >= CLEAN).alias("fully_clean_pass_at_1"),
        share(F.col("reward") >= CORRECT).alias("behavior_correct"),
        F.coalesce(F.avg("reward"), F.lit(0.0)).alias("avg_reward"),
    )


def step_spread(rewards: DataFrame) -> DataFrame:
    return rewards.groupBy("step").agg(F.avg("reward").alias("mean"), (F.max("reward") - F.min("reward")).alias("spread"))


def histogram(rewards: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rewards.groupBy(*keys, F.round("reward", 2).alias("reward")).agg(F.count("*").alias("n"))


def answers_with_goldens(answers: DataFrame, goldens: DataFrame, on: str = "task", order: str | None = None) -> DataFrame:
    """Answers whose task has a golden; of goldens that share a task, the last by the order column counts
    (by their text, where none is given)."""
    return answers.join(goldens.groupBy(on).agg(F.max_by("golden", order or "golden").alias("golden")), on)


def per_arm(records: DataFrame, value: str = "reward", arms: Sequence[str] = ("dsl", "verilog")) -> DataFrame:
    """One row per task with the value of each arm."""
    return records.groupBy("task").pivot("arm", list(arms)).agg(F.first(value, ignorenulls=True))


def arm_records(records: DataFrame, arms: Sequence[str] = ("dsl", "verilog")) -> DataFrame:
    """One row per task with a record of each arm: code, reward, passed (a reward of CLEAN or more), tokens,
    latency, tokens per second (0 without a latency) and note; null for an arm without one."""
    c = F.col
    rate = F.when(c("latency") != 0, c("tokens") / c("latency")).otherwise(0.0)
    whole = F.struct("code", "reward", (c("reward") >= CLEAN).alias("passed"), "tokens", "latency", rate.alias("tokens_per_s"), "note")
    return records.select("task", "arm", whole.alias("record")).groupBy("task").pivot("arm", list(arms)).agg(F.first("record", ignorenulls=True))


def latest_batch(runs: DataFrame, keys: Sequence[str] = (), batch: str = "batch") -> DataFrame:
    """Rows of the last batch, of each key where keys are given."""
    last = runs.groupBy(*keys).agg(F.max(batch).alias(batch))
    return runs.join(F.broadcast(last) if not keys else last, [*keys, batch], "left_semi")


def with_specs(rows: DataFrame, specs: DataFrame, on: str = "task_id") -> DataFrame:
    """rows with the specification of their task; a task that the catalog lacks raises, as one listed twice does."""
    once = specs.groupBy(on).agg(F.count("*").alias("listed"), *[F.first(c).alias(c) for c in specs.columns if c != on])
    found = rows.join(once, on, "left")
    fine = F.when(F.col("listed") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no single specification of task "), F.col(on).cast("string"))).cast("boolean"))
    return found.where(fine).drop("listed")


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(order).limit(n)


def renumbered(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by order, named task_0000 and on."""
    from pyspark.sql import Window

    top = df.orderBy(order).limit(n)
    return top.withColumn("task", F.format_string("task_%04d", F.row_number().over(Window.orderBy(order)) - 1))


def cycled(pool: DataFrame, index: str, size: int, steps: int, batch: int) -> DataFrame:
    """Batches of a pool of `size` items numbered from 0: step, slot and the item each batch takes."""
    grid = pool.sparkSession.range(steps * batch).select(F.floor(F.col("id") / batch).alias("step"), (F.col("id") % batch).alias("slot"), F.pmod("id", F.lit(size)).alias(index))
    return grid.join(pool, index)


def repeated(tasks: DataFrame, times: int) -> DataFrame:
    """Each task so many times, numbered by rollout."""
    return tasks.crossJoin(F.broadcast(tasks.sparkSession.range(times).withColumnRenamed("id", "rollout")))


def every(steps: DataFrame, k: int, step: str = "step") -> DataFrame:
    return steps.where(F.col(step) % k == 0)


def random_task(tasks: DataFrame, seed: int = 0) -> DataFrame:
    """One task, chosen by the seed."""
    return tasks.orderBy(F.rand(seed)).limit(1)


def running_mean(rewards: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """The series of a run's chart: mean reward of each step."""
    return rewards.groupBy(run, step).agg(F.avg("reward").alias("mean"), F.count("*").alias("n"))


def gap(scores: DataFrame, arm: str, arms: tuple[str, str], keys: Sequence[str] = (), value: str = "score") -> DataFrame:
    """The series of a chart that sets two arms side by side: both means and the difference."""
    means = scores.groupBy(*keys).pivot(arm, list(arms)).agg(F.avg(value))
    return means.withColumn("gap", F.col(f"`{arms[1]}`") - F.col(f"`{arms[0]}`"))


GRADERS: dict[str, Callable[[str, str], dict]] = {}


def grader(name: str):
    """Registers a grading function (answer, golden) -> reward and parts."""
    return lambda f: GRADERS.setdefault(name, f)


#: Programs, and walks of them, that a worker keeps; answers share goldens and often each other's text.
PROGRAMS = 256


@lru_cache(PROGRAMS)
def _program(text: str) -> tuple[Machine, float, dict[str, list[int]]]:
    """The machine, whether it is strictly sound, and its outputs' values by state."""
    m = compile_text(text)
    return m, float(not strict_diagnostics(m)), {p.name: output_values(m, p.name) for p in m.outputs}


@lru_cache(PROGRAMS)
def _stimulus(inputs: tuple[tuple[str, int], ...], cycles: int, seed: int) -> tuple[tuple[int, ...], ...]:
    rng = random.Random(seed)
    return tuple(tuple(rng.getrandbits(width) for _, width in inputs) for _ in range(cycles))


@lru_cache(PROGRAMS)
def _walk(text: str, inputs: tuple[tuple[str, int], ...], cycles: int, seed: int) -> tuple[int, ...]:
    """The program's states after each of the random rows of inputs; each step is worked out once."""
    m, known, names = _program(text)[0], {}, [name for name, _ in inputs]
    state, found = m.ordinal(m.reset), []
    for row in _stimulus(inputs, cycles, seed):
        if (now := known.get((state, row))) is None:
            now = known[state, row] = next_state(m, state, dict(zip(names, row, strict=True)))
        found.append(state := now)
    return tuple(found)


@grader("machine")
def grade_machine(answer: str, golden: str, cycles: int = 200, seed: int = 0) -> dict:
    """Compile, strict diagnostics and behaviour against the golden over random inputs."""
    m = re.search(r"(?s)```(?:fsm|dsl)?\s*(.*?)```", answer)
    gold, _, va = _program(golden)
    own, lint, vb = _program(text := (m[1] if m else answer).strip())
    inputs = tuple((p.name, p.width) for p in gold.inputs)
    same = set(inputs) == {(p.name, p.width) for p in own.inputs} and set(va) <= set(vb)
    if same:
        met = set(zip(_walk(golden, inputs, cycles, seed), _walk(text, inputs, cycles, seed), strict=True))
        same = all(va[n][a] == vb[n][b] for a, b in met for n in va)
    return {"reward": round(0.2 + 0.1 * lint + 0.7 * same, 4), "compile": 1.0, "lint": lint, "behavior": float(same), "note": ""}


def graded(pairs: DataFrame, name: str = "machine", keys: Sequence[str] = ("task",)) -> DataFrame:
    """Grades of rows with answer and golden: keys, reward, compile, lint, behavior, note. Whatever goes
    wrong in a row scores 0 there and is told in its note. Batches go through Arrow. Rows are dealt out
    evenly first: a row costs far more to grade than to move, and a small file is read by one task."""
    f, names = GRADERS[name], list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for answer, golden in zip(batch["answer"], batch["golden"], strict=True):
                try:
                    out.append(f(answer, golden))
                except Exception as e:  # noqa: BLE001
                    out.append({"reward": 0.0, "compile": 0.0, "lint": 0.0, "behavior": 0.0, "note": f"{type(e).__name__}: {e}"})
            scores = pd.DataFrame(out, index=batch.index, columns=["reward", "compile", "lint", "behavior", "note"])
            yield pd.concat([batch[names], scores], axis=1)

    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = pairs.select(*names, "answer", "golden").repartition(tasks)
    types = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in own.schema if x.name in names)
    return own.mapInPandas(run, f"{types}, reward double, compile double, lint double, behavior double, note string")
