import random

import pytest
from pyspark.sql import functions as F

from mooreflow.operators import cosim, fifo
from mooreflow.operators.run import Stimulus, fold, trace
from mooreflow.plans import fixtures
from mooreflow.plans.generate import random_machines
from mooreflow.plans.language import compile_text, parse
from mooreflow.plans.lower import _constant, guard, output_values, reads, step, unused_inputs
from mooreflow.streaming.machines import holds, next_state


def walk(m, rows):
    """A walk in plain Python: rows of (key, order, inputs, reset)."""
    out, now = {}, {}
    for key, order, ins, rst in sorted(rows, key=lambda r: r[:2]):
        pre = now.get(key, m.ordinal(m.reset))
        post = m.ordinal(m.reset) if rst else next_state(m, pre, ins)
        now[key] = post
        out[key, order] = (pre, post, *(output_values(m, p.name)[post] for p in m.outputs))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_traces_and_folds_match_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    for m in random_machines(2, seed=seed, rich=True, states=(2, 6)):
        names = [p.name for p in m.inputs]
        rows = [(k, i, {p.name: rng.getrandbits(p.width) for p in m.inputs}, rng.random() < 0.02) for k, n in ((1, 900), (2, 1), (3, 70), (4, 64)) for i in range(n)]
        rng.shuffle(rows)
        df = spark.createDataFrame([(k, i, *[x[n] for n in names], r) for k, i, x, r in rows], ", ".join(["k long", "i long", *[f"{n} long" for n in names], "r boolean"])).repartition(5)
        s = Stimulus(df, ("k",), ("i",), {n: F.col(n) for n in names}, F.col("r"))
        want = walk(m, rows)
        got = {(x["k"], x["i"]): (x["state_pre"], x["state_post"], *[x[p.name] for p in m.outputs]) for x in trace(m, s).collect()}
        assert got == want
        counts = {x["k"]: x["n"] for x in fold(m, s, {"n": [0, 1]}).collect()}
        assert counts == {k: sum(v[1] in (0, 1) for (kk, _), v in want.items() if kk == k) for k in (1, 2, 3, 4)}


def test_nulls_empty_tables_and_clashing_names(spark):
    m = fixtures.machine(fixtures.SEQ101)
    df = spark.createDataFrame([(1, 1, None, "a", 0), (1, 2, 3, "b", 0), (1, 3, 2, "c", 0)], "k long, i long, x long, part string, map int")
    s = Stimulus(df, ("k",), ("i",), {"x": F.col("x")})
    assert [r["state_post"] for r in trace(m, s).orderBy("i").collect()] == [0, 1, 2]  # null is 0; bits above the width are dropped
    none = Stimulus(df.limit(0), ("k",), ("i",), {"x": F.col("x")})
    assert trace(m, none).count() == 0 and fold(m, none).count() == 0


def test_outputs_wrap_and_the_last_assignment_counts():
    m = compile_text("machine m { out bit[1:0] y reset = S state S { y = 1 y = 7 else -> S } }")
    assert output_values(m, "y") == [3]


def test_an_early_else_is_the_default(spark):
    m = compile_text("machine m { in bit a out bit y reset = S state S { y = 0 else -> T when a -> S else -> S } state T { y = 1 else -> T } }")
    got = spark.range(2).select(step(m, F.lit(0), lambda n: F.col("id")).alias("s"), "id").orderBy("id").collect()
    assert [r["s"] for r in got] == [1, 0] and [next_state(m, 0, {"a": i}) for i in (0, 1)] == [1, 0]


def test_unknown_states_hold(spark):
    m = fixtures.machine(fixtures.TRAFFIC)
    assert spark.range(1).select(step(m, F.lit(9), lambda n: F.lit(1))).first()[0] == 9
    assert spark.range(1).select(step(m, F.lit(9), lambda n: F.lit(1), F.lit(True))).first()[0] == 0


@pytest.mark.parametrize("text", ["v", "v[4]", "v[6]", "!v == 3", "v < 0", "v <= 7", "v > 7", "v >= 0", "v != 7", "3 < v", "7 >= v", "1", "0", "a && (v == 2 || !a)", "(a || v) == 1", "v[5] == a", "v == w", "3 == 3"])
def test_guards(spark, text):
    m = parse(f"machine m {{ in bit a in bit[6:4] v in bit[2:0] w out bit y reset = S state S {{ y = 0 when {text} -> S else -> S }} }}")
    g = m.states[0].transitions[0].guard
    ports = {p.name: p for p in m.inputs}
    rows = [(a, v, w) for a in (0, 1) for v in range(8) for w in (0, 3, 7)]
    df = spark.createDataFrame(rows, "a int, v int, w int")
    for r in df.select("a", "v", "w", guard(g, ports, F.col).alias("g")).collect():
        assert r["g"] == holds(g, m, {"a": r["a"], "v": r["v"], "w": r["w"]}), (text, r)


def test_trivial_comparisons():
    ops = {"==": int.__eq__, "!=": int.__ne__, "<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__}
    for width in (1, 2, 3):
        for value in range((1 << width) + 2):
            for op, f in ops.items():
                seen = {f(x, value) for x in range(1 << width)}
                assert _constant(lambda x, f=f, v=value: f(x, v), value, op in ("==", "!="), width) == (seen.pop() if len(seen) == 1 else None), (width, value, op)


def test_only_read_inputs_are_kept(spark):
    m = compile_text("machine m { in bit a in bit b in bit[3:0] c out bit y reset = S state S { y = 0 when c[2] -> S else -> S } }")
    assert reads(m) == ["c"] and unused_inputs(m) == ["a", "b"]
    s = Stimulus(spark.range(1), ("id",), (), {n: F.lit(1) for n in "abc"})
    assert s.table(m).columns == ["id", "in_c"]


def test_comparison_and_equivalence(spark):
    a, b = fixtures.machine(fixtures.SEQ101), fixtures.machine(fixtures.SEQ101_PLAIN)
    s = cosim.stimulus(spark, a, cycles=300, keys=3)
    assert cosim.compare(a, a, s).where("mismatch").count() == 0
    found = cosim.compare(a, b, s)
    first = cosim.first_mismatch(found, ["key"], ["cycle"]).collect()
    for r in first:
        assert found.where((F.col("key") == r["key"]) & F.col("mismatch")).agg(F.min("cycle")).first()[0] == r["cycle"]
    assert cosim.equivalent(spark, a, a) and not cosim.equivalent(spark, a, b)
    renamed = parse(fixtures.SEQ101.replace("S1", "ONE"))
    assert cosim.equivalent(spark, a, renamed)
    no_output = parse("machine n { in bit x reset = S state S { else -> S } }")
    assert cosim.compare(a, no_output, s).where("not mismatch").count() == 0


def test_combinational(spark):
    rows = cosim.combinational(spark.range(4), {"y": F.col("id") % 2}, {"y": F.when(F.col("id") < 3, F.col("id") % 2)})
    assert [r["mismatch"] for r in rows.orderBy("id").collect()] == [False, False, False, True]
    assert spark.range(1).select(cosim.is_sequential(F.array(F.lit("a"), F.lit("clk")))).first()[0]


def test_queue_fold_and_trace_agree(spark):
    rng = random.Random(4)
    rows = [(k, i, int(rng.random() < 0.02), int(rng.random() < 0.7), rng.randrange(256), int(rng.random() < 0.7), rng.randrange(256), int(rng.random() < 0.5)) for k in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i int, rst int, valid0 int, data0 int, valid1 int, data1 int, yumi int")
    totals = {r["k"]: (r["accepted"], r["popped"], r["checksum"]) for r in fifo.fold(df, ["k"], ["i"]).collect()}
    seen: dict = {}
    for r in fifo.trace(df, ["k"], ["i"]).orderBy("k", "i").collect():
        a, p, c = seen.get(r["k"], (0, 0, 0))
        if not r["rst"]:
            a += r["ready0"] + r["ready1"]
            if r["yumi"] and r["valid"]:
                p += 1
                c += p * r["data"]
        seen[r["k"]] = (a, p, c)
    assert totals == seen
    wide = fifo.with_before(fifo.trace(df, ["k"], ["i"]), ["k"], ["i"])
    assert all(cosim.properties(wide, fifo.asserts(), {}).first())


def test_queue_variants(spark):
    for fault, failing in ((None, set()), ("lane1_starved", {"lane1_only_order", "full_accepts_after_pop", "reset_flushes_and_restarts"}), ("no_full_pop_push", {"full_accepts_after_pop"}), ("rr_stuck_lane0", {"round_robin_contention"}), ("reset_pref_lane1", {"round_robin_contention"}), ("bad_wrap", {"full_accepts_after_pop"})):
        got = {r["scenario"] for r in fifo.scenario_results(spark, fault).where("status = 'FAIL'").collect()}
        assert got == failing, (fault, got)
    assert fifo.scenario_results(spark, "bad_data_mux").where("status = 'FAIL'").count() == 4
