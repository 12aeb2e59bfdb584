"""Comparing machines: stimuli, traces side by side, exact equivalence, invariants and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mooreflow.operators.run import Stimulus, traces
from mooreflow.plans.language import Machine
from mooreflow.plans.lower import output_values, outputs, step


def stimulus(spark: SparkSession, m: Machine, cycles: int = 200, keys: int = 1, seed: int = 0) -> Stimulus:
    """Pseudo-random inputs, the same for the same seed: keys x cycles rows, uniform over each width."""
    rows = spark.range(keys * cycles).select(F.floor(F.col("id") / cycles).cast("long").alias("key"), (F.col("id") % cycles).alias("cycle"))
    ins = {p.name: F.xxhash64(F.lit(seed), F.lit(p.name), "key", "cycle").bitwiseAND((1 << p.width) - 1) for p in m.inputs}
    return Stimulus(rows, ("key",), ("cycle",), ins)


def combinational(rows: DataFrame, expected: dict[str, Column], actual: dict[str, Column]) -> DataFrame:
    """Clock-less comparison: rows with a column mismatch, true where any pair of columns differs."""
    differ = F.lit(False)
    for name, e in expected.items():
        differ = differ | ~e.eqNullSafe(actual[name])
    return rows.withColumn("mismatch", differ)


def is_sequential(port_names: Column) -> Column:
    """Whether a list of port names has a clock or reset."""
    return F.exists(port_names, lambda p: p.isin("clk", "rst"))


def compare(golden: Machine, candidate: Machine, s: Stimulus) -> DataFrame:
    """key, order, port, port_ord, gold, dut, mismatch for each row and output of the golden machine; an
    output that the candidate lacks is null there and mismatches. Both run in one pass over the rows."""
    at = [*s.key, *s.order]
    have = {p.name for p in candidate.outputs}
    gold, dut = outputs(golden, F.col("post0")), outputs(candidate, F.col("post1"))
    side = lambda n: dut[n] if n in have else F.lit(None).cast("long")
    rows = F.array(*[F.struct(F.lit(p.name).alias("port"), F.lit(i).alias("port_ord"), gold[p.name].alias("gold"), side(p.name).alias("dut")) for i, p in enumerate(golden.outputs)])
    return traces([golden, candidate], s).select(*at, F.inline(rows)).withColumn("mismatch", ~F.col("gold").eqNullSafe(F.col("dut")))


def mismatch_counts(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    return compared.groupBy(*keys).agg(F.count_if("mismatch").alias("mismatches"), (~F.bool_or("mismatch")).alias("pass"))


def first_mismatch(compared: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first mismatch of each key that has one: order columns, port and both values."""
    place = F.struct(*order, "port_ord")
    found = compared.where("mismatch").groupBy(*keys).agg(F.min_by(F.struct(*order, "port", "gold", "dut"), place).alias("x"))
    return found.select(*keys, "x.*")


def _symbols(spark: SparkSession, a: Machine, b: Machine) -> DataFrame:
    """All input rows over both machines' inputs; for the exact check, so few bits are assumed."""
    widths = {p.name: p.width for m in (b, a) for p in m.inputs}
    if (bits := sum(widths.values())) > 20:
        raise ValueError(f"{bits} input bits are too many for an exact comparison; use compare() on a stimulus")
    cols, at = [], 0
    for n, w in widths.items():
        cols.append(F.shiftright("id", at).bitwiseAND((1 << w) - 1).alias(f"in_{n}"))
        at += w
    return spark.range(1 << bits).select(*cols, F.lit(0).alias("one"))


def reachable_pairs(spark: SparkSession, a: Machine, b: Machine) -> DataFrame:
    """Pairs of states (a_state, b_state) that both machines reach on one input sequence from reset, and
    the least number of steps. The pairs are bounded by the product of the state counts; the distinct
    transitions between them are worked out once, in the engine."""
    inputs = _symbols(spark, a, b)
    grid = spark.range(len(a.states) * len(b.states)).select((F.col("id") % len(a.states)).cast("int").alias("a"), F.floor(F.col("id") / len(a.states)).cast("int").alias("b"))
    read = lambda n: F.col(f"in_{n}")
    moves = grid.crossJoin(F.broadcast(inputs)).select("a", "b", step(a, F.col("a"), read).alias("a2"), step(b, F.col("b"), read).alias("b2")).distinct()
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in moves.collect():  # at most (states of a x states of b) squared rows
        edges.setdefault((r["a"], r["b"]), []).append((r["a2"], r["b2"]))
    start = (a.ordinal(a.reset), b.ordinal(b.reset))
    depth, front = {start: 0}, [start]
    while front:
        front = [q for p in front for q in edges.get(p, ()) if q not in depth and depth.setdefault(q, depth[p] + 1)]
    rows = [(a.states[x].name, b.states[y].name, d) for (x, y), d in depth.items()]
    return spark.createDataFrame(rows, "a_state string, b_state string, steps int")


def equivalent(spark: SparkSession, a: Machine, b: Machine) -> bool:
    """Whether both give the same outputs on every input sequence, for as long as it may be."""
    names = [p.name for p in a.outputs]
    if sorted(names) != sorted(p.name for p in b.outputs):
        return False
    va, vb = ({n: output_values(m, n) for n in names} for m in (a, b))
    return all(va[n][a.ordinal(r["a_state"])] == vb[n][b.ordinal(r["b_state"])] for r in reachable_pairs(spark, a, b).collect() for n in names)


def transition_matrix(traced: DataFrame) -> DataFrame:
    return traced.groupBy("state_pre", "state_post").agg(F.count("*").alias("n"))


def coverage(traced: DataFrame, m: Machine) -> DataFrame:
    """Rows that end in each declared state, and whether there are any."""
    spark = traced.sparkSession
    states = spark.createDataFrame([(i, s.name) for i, s in enumerate(m.states)], "state_post int, state string")
    seen = traced.groupBy("state_post").agg(F.count("*").alias("n"))
    return states.join(seen, "state_post", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("covered"))


def properties(traced: DataFrame, asserts: dict[str, Column], covers: dict[str, Column]) -> DataFrame:
    """One row: for each assertion whether it holds on every row, for each goal whether a row reaches it."""
    return traced.agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(n) for n, c in asserts.items()], *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in covers.items()])
