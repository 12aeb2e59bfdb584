"""More of the engine's queries: catalogs and grades made from the test tables, logs and reports, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mooreflow.functions import text as tx
from mooreflow.operators import catalog as cat
from mooreflow.operators import cosim, fifo, grade
from mooreflow.operators.run import Stimulus, trace
from mooreflow.plans import fixtures
from mooreflow.plans.language import Rule, compile_text
from mooreflow.queries import _EV, _HAND, _QUEUE_SQL, QUERIES, SQL, _click, _events, _queue_rows, _table, query, walk
from mooreflow.session import shared_dir
from mooreflow.sources import tasks as src


__all__ = ["QUERIES", "SQL"]


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# A program for each customer, with faults that follow from its key k: in state j an output is not
# assigned where (k + j) % 5 = 0, there is no else where (k + j) % 4 = 0 and no target where (k + j) % 7 = 0;
# the reset is no state where k % 11 = 0, an output of another machine is assigned where k % 6 = 0.
def _programs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    y, z = _cat("y", k % 3), _cat("y", (k + 1) % 3)

    def state(j: Column) -> Column:
        own = F.when((k + j) % 5 == 0, F.lit("# none")).otherwise(_cat(y, " = ", j))
        foreign = F.when((j == 0) & (k % 6 == 0), _cat(z, " = 1 ")).otherwise("")
        target = F.when((k + j) % 7 == 0, F.lit("GONE")).otherwise(_cat("S", (j + 1) % (k % 3 + 1)))
        last = F.when((k + j) % 4 == 0, F.lit("# no else")).otherwise(_cat("else -> S", j))
        return _cat("  state S", j, " {\n    ", foreign, own, "\n    when i -> ", target, "\n    ", last, "\n  }\n")

    spare = F.when(k % 2 == 0, " in bit spare").otherwise("")
    reset = F.when(k % 11 == 0, "NONE").otherwise("S0")
    states = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), k % 3), state), "")
    text = _cat("machine m", k, " {\n  in bit i", spare, "\n  out bit[1:0] ", y, "\n  reset = ", reset, "\n", states, "}\n")
    return _table(spark, d, "customer").select(k.alias("machine_id"), F.floor(k / 50).alias("unit"), _cat("c", k, ".fsm").alias("path"), text.alias("text"))


def _table_catalog(spark: SparkSession, d: str) -> cat.Catalog:
    return cat.catalog_of(_programs(spark, d))


# What the rules find in these programs, from the keys alone: d(machine_id, part, o, rule, line, col, message).
_FOUND = """WITH c AS (SELECT c_custkey AS k, c_custkey // 50 AS unit, 'y' || (c_custkey % 3) AS y, 'y' || ((c_custkey + 1) % 3) AS z FROM customer),
s AS (SELECT c.*, j, 5 + 5 * j AS line FROM c, LATERAL (SELECT unnest(range(0, c.k % 3 + 1)) AS j)),
own AS (SELECT c.*, row_number() OVER (PARTITION BY unit, y ORDER BY k) AS rn, string_agg('m' || k || ' (c' || k || '.fsm:3)', ', ' ORDER BY k) OVER (PARTITION BY unit, y ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS places FROM c),
d AS (SELECT k AS machine_id, 0 AS part, j AS o, 'total_outputs' AS rule, line, 9 AS col, 'state S' || j || ' does not assign output ''' || y || '''' AS message FROM s WHERE (k + j) % 5 = 0
UNION ALL SELECT k, 1, j, 'total_transitions', line, 9, 'state S' || j || ' does not end with a final ''else -> STATE'' transition' FROM s WHERE (k + j) % 4 = 0
UNION ALL SELECT k, 2, j, 'name_resolution', line + 2, 5, 'transition in state S' || j || ' targets undeclared state ''GONE''' FROM s WHERE (k + j) % 7 = 0
UNION ALL SELECT k, 3, 0, 'name_resolution', 1, 9, 'reset target ''NONE'' is not a declared state' FROM c WHERE k % 11 = 0
UNION ALL SELECT k, 4, 0, 'single_driver', 3, 16, 'output ''' || y || ''' is declared by more than one machine: ' || places FROM own WHERE rn > 1
UNION ALL SELECT c.k, 5, 0, 'single_driver', 6, 5, 'output ''' || c.z || ''' is assigned in state S0 of machine m' || c.k || ' but is declared by machine m' || own.k FROM c JOIN own ON own.unit = c.unit AND own.y = c.z AND own.rn = 1 WHERE c.k % 6 = 0)
"""


def _rule_sql(parts: str) -> str:
    return _FOUND + f"SELECT machine_id, CAST(line AS INT) AS line, CAST(col AS INT) AS col, message FROM d WHERE part IN ({parts})"


@query(_rule_sql("0"))
def safety_total_outputs(spark, d):
    return cat.total_outputs(_table_catalog(spark, d)).select("machine_id", "line", "col", "message")


@query(_rule_sql("1"))
def safety_total_transitions(spark, d):
    return cat.total_transitions(_table_catalog(spark, d)).select("machine_id", "line", "col", "message")


@query(_rule_sql("2, 3"))
def safety_name_resolution(spark, d):
    return cat.name_resolution(_table_catalog(spark, d)).select("machine_id", "line", "col", "message")


@query(_rule_sql("4, 5"))
def safety_single_driver(spark, d):
    return cat.single_driver(_table_catalog(spark, d)).select("machine_id", "line", "col", "message")


@query(_FOUND + """SELECT machine_id, CAST(row_number() OVER (PARTITION BY machine_id ORDER BY part, o) AS INT) AS position, rule, CAST(line AS INT) AS line, CAST(col AS INT) AS col,
'c' || machine_id || '.fsm:' || line || ':' || col || ': ' || message AS rendered FROM d""")
def catalog_diagnostics(spark, d):
    """All rules, in their order within each machine."""
    return cat.diagnostics(_table_catalog(spark, d)).select("machine_id", "position", "rule", "line", "col", "rendered")


@query(_FOUND + "SELECT k AS machine_id, 'm' || k AS name FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.machine_id = c.k)")
def valid_machines(spark, d):
    return cat.valid_machines(_table_catalog(spark, d)).select("machine_id", "name")


@query("SELECT c_custkey AS machine_id, 'spare' AS name FROM customer WHERE c_custkey % 2 = 0")
def unused_inputs(spark, d):
    return cat.unused_inputs(_table_catalog(spark, d)).select("machine_id", "name")


@query("SELECT c_custkey AS machine_id, c_custkey % 3 + 1 AS states, CASE WHEN c_custkey % 3 = 2 THEN 2 ELSE 1 END AS width FROM customer")
def state_width(spark, d):
    return cat.state_widths(_table_catalog(spark, d))


@query(_FOUND + """SELECT 'c' || c.k || '.fsm' AS path, f.rule IS NULL AS ok, f.rule, CAST(f.line AS BIGINT) AS line, CAST(f.col AS BIGINT) AS col, f.message FROM c LEFT JOIN (SELECT * FROM d WHERE part < 4) f ON f.machine_id = c.k""")
def compiled_programs(spark, d):
    """The compile gate over a table of programs: every error of each, or one row for a sound one."""
    return cat.compiled(_programs(spark, d)).drop("rendered")


@query(_FOUND + "SELECT rule, count(*) AS n FROM d WHERE rule IN ('total_outputs', 'single_driver') GROUP BY rule")
def rule_counts(spark, d):
    """Violations by rule, for two of the closed set of rules."""
    found = cat.diagnostics(_table_catalog(spark, d))
    return found.where(F.col("rule").isin([str(Rule.TOTAL_OUTPUTS), str(Rule.SINGLE_DRIVER)])).groupBy("rule").agg(F.count("*").alias("n"))


# Sources that cannot be parsed, one for each supplier; its key picks the fault.
_BROKEN = [
    ("machine m# { in bit clk out bit y reset = S state S { y = 0 else -> S } }", "clk", "port name 'clk' is reserved; clk and rst are implicit and must not be declared"),
    ("machine m# { out bit y reset = S state S { y = 0 else -> S } state  S { y = 1 else -> S } }", " S { y = 1", "duplicate state 'S' in machine 'm#'"),
    ("machine m# { out bit y state S { y = 0 else -> S } }", "m# {", "machine 'm#' has no reset declaration; exactly one 'reset = STATE' is required"),
    ("machine m# { out bit y reset = S  reset = S state S { y = 0 else -> S } }", "reset = S state", "machine 'm#' has 2 reset declarations; exactly one 'reset = STATE' is required"),
    ("machine m# { out bit y reset = S state S { y = 0 else -> S } }  machine n { out bit z reset = S state S { z = 0 else -> S } }", " n {", "source file declares 2 machines; exactly one machine per file is required"),
    ("machine m# { in bit[2:0] v out bit y reset = S state S { y = 0 when v == 8# -> S else -> S } }", "8# ->", "comparison literal 8# does not fit the 3-bit width of signal 'v'"),
    ("machine m# { in wire v out bit y reset = S state S { y = 0 else -> S } }", "wire", "unrecognized type 'wire'; expected 'bit' or 'bit[H:L]'"),
    ("machine m# { in bit[0:1#] v out bit y reset = S state S { y = 0 else -> S } }", "bit[0", "invalid index range bit[0:1#]: requires H >= L"),
    ("# nothing but #", None, "source file declares no machine; exactly one machine per file is required"),
]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("#", "' || s_suppkey || '") + "'"


def _broken_sql() -> str:
    at = "\n".join(f" WHEN {i} THEN {'1' if token is None else f'strpos({_quoted(text)}, {_quoted(token)})' + (' + 1' if token.startswith(' ') else '')}" for i, (text, token, _) in enumerate(_BROKEN))
    said = "\n".join(f" WHEN {i} THEN {_quoted(message)}" for i, (_, _, message) in enumerate(_BROKEN))
    n = len(_BROKEN)
    return f"SELECT s_suppkey AS supplier, CAST(1 AS BIGINT) AS line, CAST(CASE s_suppkey % {n}{at} END AS BIGINT) AS col, CASE s_suppkey % {n}{said} END AS message FROM supplier"


@query(_broken_sql())
def parse_errors(spark, d):
    """Errors of parsing, with their places."""
    k = F.col("s_suppkey")
    texts = F.array(*[F.lit(t) for t, _, _ in _BROKEN])
    own = F.replace(F.get(texts, (k % len(_BROKEN)).cast("int")), F.lit("#"), k.cast("string"))
    own = F.when(k % len(_BROKEN) == len(_BROKEN) - 1, F.lit("# nothing")).otherwise(own)
    found = cat.compiled(_table(spark, d, "supplier").select(k.cast("string").alias("path"), own.alias("text")))
    return found.select(F.col("path").cast("long").alias("supplier"), "line", "col", "message")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers to a task for each customer: right, wrong in one output, no program, right but for a value
    that is too wide."""
    k = F.col("c_custkey")
    program = lambda a, b: _cat("machine g { in bit i out bit[1:0] y reset = S0 state S0 { y = ", a, " when i -> S1 else -> S0 } state S1 { y = ", b, " else -> S0 } }")
    answer = F.when(k % 4 == 0, _cat("so:\n```fsm\n", program(k % 4, (k + 1) % 4), "\n```")).when(k % 4 == 1, program((k + 2) % 4, (k + 1) % 4)).when(k % 4 == 2, "no idea").otherwise(program(k % 4, (k + 1) % 4 + 4))
    return _table(spark, d, "customer").select(k.alias("task"), answer.alias("answer"), program(k % 4, (k + 1) % 4).alias("golden"))


@query("""SELECT c_custkey AS task, CAST(CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.0 ELSE 0.9 END AS DOUBLE) AS reward, CASE WHEN c_custkey % 4 = 2 THEN 0.0 ELSE 1.0 END AS compile,
CASE WHEN c_custkey % 4 < 2 THEN 1.0 ELSE 0.0 END AS lint, CASE WHEN c_custkey % 4 IN (0, 3) THEN 1.0 ELSE 0.0 END AS behavior FROM customer""")
def graded_machines(spark, d):
    """Answers graded against goldens, row by row; what goes wrong scores nothing."""
    return grade.graded(_answers(spark, d)).drop("note")


# The queue and its faulty variants as one recursive walk: slots with two pointers, as hardware has them.
def _queues_sql(source: str, key: str, faults: str) -> str:
    return f"""WITH RECURSIVE e AS ({source}), f(fault) AS (VALUES {faults}),
t AS (SELECT DISTINCT e.{key}, f.fault, CAST(0 AS BIGINT) AS rn, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS slots, 0 AS w, 0 AS r, 0 AS c, CASE WHEN f.fault = 'reset_pref_lane1' THEN 1 ELSE 0 END AS rr, CAST([] AS BIGINT[]) AS seen FROM e, f
 UNION ALL SELECT {key}, fault, rn, CASE WHEN rst = 0 AND push THEN slots[1:w] || [x] || slots[w + 2:8] ELSE slots END, CASE WHEN rst = 1 THEN 0 WHEN push THEN (w + 1) % wrap ELSE w END, CASE WHEN rst = 1 THEN 0 WHEN pop THEN (r + 1) % wrap ELSE r END,
  CASE WHEN rst = 1 THEN 0 ELSE c + CAST(push AS INT) - CAST(pop AS INT) END, CASE WHEN rst = 1 THEN CASE WHEN fault = 'reset_pref_lane1' THEN 1 ELSE 0 END WHEN push THEN 1 - lane ELSE rr END,
  [CAST(push AND lane = 0 AS BIGINT), CAST(push AND lane = 1 AS BIGINT), CASE WHEN offer THEN lane ELSE 0 END, CAST(c > 0 AS BIGINT), CASE WHEN c > 0 THEN slots[r + 1] END, c]
 FROM (SELECT *, offer AND NOT (fault = 'lane1_starved' AND v1 AND NOT v0) AS push, CASE WHEN (lane = 0) <> (fault = 'bad_data_mux') THEN d0 ELSE d1 END AS x
  FROM (SELECT *, (v0 OR v1) AND (c < 8 OR (pop AND fault <> 'no_full_pop_push')) AS offer
   FROM (SELECT e.*, t.fault, t.slots, t.w, t.r, t.c, t.rr, e.y AND t.c > 0 AS pop, CASE WHEN e.v0 AND e.v1 THEN CASE WHEN t.fault = 'rr_stuck_lane0' THEN 0 ELSE t.rr END WHEN e.v1 THEN 1 ELSE 0 END AS lane, CASE WHEN t.fault = 'bad_wrap' THEN 7 ELSE 8 END AS wrap
    FROM t JOIN e ON e.{key} = t.{key} AND e.rn = t.rn + 1))))
"""


_QUEUE_EVENTS = """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 1 ELSE 0 END AS rst,
 event_type IN ('click', 'view', 'purchase') AS v0, event_id % 256 AS d0, event_type IN ('view', 'signup', 'purchase') AS v1, event_id * 3 % 256 AS d1, event_id % 5 < 2 AS y FROM events"""
_ALL = ", ".join(f"('{x}')" for x in ("none", *fifo.MUTANTS))


@query(_queues_sql(_QUEUE_EVENTS, "user_id", _ALL) + """SELECT b.fault AS mutant, count(*) FILTER (WHERE a.seen IS DISTINCT FROM b.seen) AS mismatches, count(*) FILTER (WHERE a.seen IS DISTINCT FROM b.seen) > 0 AS killed
FROM t a JOIN t b ON a.user_id = b.user_id AND a.rn = b.rn WHERE a.fault = 'none' AND b.fault <> 'none' AND a.rn > 0 GROUP BY b.fault""")
def fifo_mutant_kill(spark, d):
    return fifo.kills(_queue_rows(spark, d), ["user_id"], ["ts", "event_id"])


@query(_QUEUE_SQL + """, x AS (SELECT e.*, seen[1] AS ready0, seen[2] AS ready1, seen[4] AS valid, seen[6] AS c, lag(seen[6]) OVER w AS c_before, coalesce(lag(e.rst) OVER w, 0) AS rst_before, coalesce(sum(e.rst) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS resets
 FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn WINDOW w AS (PARTITION BY e.user_id ORDER BY e.rn)),
z AS (SELECT *, coalesce(sum(ready0 + ready1) OVER (PARTITION BY user_id, resets ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pushed FROM x)
SELECT bool_and(c BETWEEN 0 AND 8) AS count_in_range, bool_and((valid = 1) = (c > 0)) AS valid_is_nonempty, bool_and(ready0 + ready1 <= 1) AS one_ready, bool_and((ready0 = 0 OR v0) AND (ready1 = 0 OR v1)) AS ready_needs_valid,
bool_and(coalesce(abs(c - c_before) <= 1, true) OR rst_before = 1) AS count_steps, bool_or(rst = 1) AS reset, bool_or(ready0 = 1 AND NOT v1) AS lane0_basic, bool_or(ready1 = 1 AND NOT v0) AS lane1_only, bool_or(v0 AND v1 AND ready1 = 1) AS round_robin_contention,
bool_or(c = 8 AND y AND ready0 + ready1 = 1) AS full_pop_push, bool_or(rst_before = 1 AND v0 AND v1 AND ready0 = 1) AS reset_restarts_arbitration, bool_or(pushed > 8 AND valid = 1) AS wraparound_order FROM z""")
def fifo_invariants(spark, d):
    """One row: each invariant holds, and which coverage points are reached."""
    key, order = ["user_id"], ["ts", "event_id"]
    traced = fifo.with_before(fifo.trace(_queue_rows(spark, d), key, order), key, order)
    return cosim.properties(traced, fifo.asserts(), fifo.covers())


_STEPS = ", ".join(f"('{name}', {i + 1}, {x[0]}, {x[1]} = 1, {x[2]}, {x[3]} = 1, {x[4]}, {x[5]} = 1)" for name, steps in fifo.SCENARIOS.items() for i, x in enumerate(steps))


@query(_queues_sql(f"SELECT * FROM (VALUES {_STEPS}) v(scenario, rn, rst, v0, d0, v1, d1, y)", "scenario", _ALL) + """SELECT b.fault, b.scenario, CASE WHEN bool_and(a.seen IS NOT DISTINCT FROM b.seen) THEN 'PASS' ELSE 'FAIL' END AS status
FROM t a JOIN t b ON a.scenario = b.scenario AND a.rn = b.rn WHERE a.fault = 'none' AND b.fault <> 'none' AND a.rn > 0 GROUP BY b.fault, b.scenario""")
def fifo_scenarios(spark, d):
    """The directed scenarios against every faulty variant."""
    out = None
    for fault in fifo.MUTANTS:
        one = fifo.scenario_results(spark, fault).withColumn("fault", F.lit(fault))
        out = one if out is None else out.unionByName(one)
    return out


# Guards of every form over one event stream.
GUARDS = """
machine guards { in bit[3:0] v  in bit a  in bit b  out bit[1:0] y  reset = S0
  state S0 { y = 0  when 0 -> S3  when (a && !b) == (v > 9) && 1 -> S1  when !a || v == 3 -> S2  else -> S0 }
  state S1 { y = 1  when v -> S2  when 12 < v -> S3  else -> S0 }
  state S2 { y = 2  when v[3] != b -> S3  when 0 <= v && b -> S1  else -> S2 }
  state S3 { y = 3  when a == b -> S0  when 5 != v && 4 >= v -> S2  else -> S3 } }
"""
_GUARD_EV = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_id % 16 AS v, CAST(event_type = 'click' AS INT) AS a, CAST(event_id % 3 = 0 AS INT) AS b FROM events"
_GUARD = """CASE t.s WHEN 0 THEN CASE WHEN (e.a = 1 AND e.b = 0) = (e.v > 9) THEN 1 WHEN e.a = 0 OR e.v = 3 THEN 2 ELSE 0 END WHEN 1 THEN CASE WHEN e.v <> 0 THEN 2 ELSE 0 END
WHEN 2 THEN CASE WHEN e.v // 8 <> e.b THEN 3 WHEN e.b = 1 THEN 1 ELSE 2 END ELSE CASE WHEN e.a = e.b THEN 0 WHEN e.v <> 5 AND e.v <= 4 THEN 2 ELSE 3 END END"""


@query(walk("user_id", _GUARD_EV, _GUARD) + " SELECT user_id, CAST(s AS BIGINT) AS y, count(*) AS n FROM t WHERE rn > 0 GROUP BY user_id, s")
def fsm_guard_forms(spark, d):
    """Numbers as guards, compound operands, comparisons with the number first."""
    s = _events(spark, d, v=F.col("event_id") % 16, a=F.col("event_type") == "click", b=F.col("event_id") % 3 == 0)
    return trace(compile_text(GUARDS), s).groupBy("user_id", "y").agg(F.count("*").alias("n"))


@query(walk("user_id", _EV, _HAND) + " SELECT e.user_id, e.event_id, CAST(t.p AS BIGINT) AS state_pre, CAST(t.s AS BIGINT) AS state_post, CAST(t.s = 2 AS BIGINT) AS ack FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn")
def stream_handshake(spark, d):
    """The machine over a stream of the events, one state value per key, to the same rows as the batch."""
    from mooreflow.streaming.machines import PROVIDER, run

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.conf.set(name, PROVIDER)
    try:
        rows = spark.readStream.schema(_table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
        traced = run(fixtures.machine(fixtures.HANDSHAKE), Stimulus(rows, ("user_id",), ("ts", "event_id"), {"req": _click()}))
        started = traced.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        started.awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(traced.schema).parquet(f"{folder}/out").select("user_id", "event_id", "state_pre", "state_post", "ack")


# Logs and reports, made from conversations: a line or entry for each turn.
def _logs(spark: SparkSession, d: str, line: Column) -> DataFrame:
    turns = _table(spark, d, "conversations").select("conv_id", "turn", line.alias("x"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda r: r["x"]), "\n").alias("log"))


_TURN = "CASE WHEN turn % 7 = 5 THEN 'note: SCENARIO s0 PASS' WHEN turn % 7 = 6 THEN 'nothing' ELSE '  SCENARIO lane-' || (turn % 3) || CASE WHEN (turn + conv_id) % 2 = 0 THEN '  PASS' ELSE ' FAIL now' END END"


@query("WITH l AS (SELECT conv_id, turn % 3 AS s, max_by((turn + conv_id) % 2 = 0, turn) AS ok FROM conversations WHERE turn % 7 < 5 GROUP BY conv_id, turn % 3) SELECT conv_id, count(*) FILTER (WHERE ok) / 4.0 AS ratio FROM l GROUP BY conv_id")
def scenario_ratios(spark, d):
    """Share of four scenarios that passed, by a log's lines; the last line of a scenario counts."""
    logs = _logs(spark, d, F.expr(_TURN))
    return grade.scenario_ratio(tx.scenarios(logs), ["conv_id"])


@query("SELECT conv_id, turn AS cycle, 'y' || turn % 3 AS port, conv_id % 5 AS dut, conv_id % 3 AS gold FROM conversations WHERE turn % 2 = 0")
def mismatch_lines(spark, d):
    line = F.expr("CASE WHEN turn % 2 = 0 THEN 'MISMATCH cycle=' || turn || ' port=y' || turn % 3 || ' dut=' || conv_id % 5 || ' gold=' || conv_id % 3 ELSE 'ok cycle=' || turn END")
    found = _table(spark, d, "conversations").select("conv_id", tx.mismatch(line).alias("m")).where("m.cycle is not null")
    return found.select("conv_id", "m.*")


@query("""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id, CAST(i AS INT) AS n, (turn % 11) / 10.0 AS reward, CAST(turn + 1 AS BIGINT) AS step FROM r WHERE i < 40""")
def log_rewards_and_steps(spark, d):
    """Rewards and step markers of logs, the first forty of each."""
    logs = _logs(spark, d, F.expr("'step ' || (turn + 1) || '/200 {''reward'': ' || format_string('%.1f', (turn % 11) / 10.0D) || '}'"))
    return tx.log_rewards(logs).join(tx.log_steps(logs), ["conv_id", "n"])


@query("SELECT conv_id, turn, CAST(turn % 20 / 20.0 AS DOUBLE) AS \"pass\", CAST(conv_id AS DOUBLE) AS n FROM conversations WHERE turn % 4 = 0")
def evaluation_values(spark, d):
    """The numbers of a log's evaluation lines; other lines go."""
    line = F.expr("CASE WHEN turn % 4 = 0 THEN '[EVAL] turn=' || turn || ' pass=' || (turn % 20 / 20.0D) || ' n: ' || conv_id ELSE 'turn=' || turn || ' pass=1' END")
    found = tx.evaluation_lines(_logs(spark, d, line))
    return found.select("conv_id", F.col("numbers.turn").cast("long").alias("turn"), F.col("numbers.pass").alias("pass"), F.col("numbers.n").alias("n"))


@query("SELECT conv_id, count(*) FILTER (WHERE turn % 5 = 1) > 0 AS warned, CAST(sum(CASE WHEN turn % 3 = 0 THEN turn ELSE 0 END) AS BIGINT) AS latches FROM conversations GROUP BY conv_id")
def lint_and_latches(spark, d):
    """Whether a lint log warns, and the latches that a statistics listing counts."""
    logs = _logs(spark, d, F.expr("CASE WHEN turn % 5 = 1 THEN '%Warning-WIDTH: ' || turn WHEN turn % 3 = 0 THEN '' ELSE 'fine' END || CASE WHEN turn % 3 = 0 THEN '\n     $_DLATCH_P_ 1\n     $dlatch   ' || turn ELSE '' END"))
    return logs.select("conv_id", (~tx.lint_clean(F.col("log"))).alias("warned"), grade.latches(F.col("log")).alias("latches"))


@query("""SELECT conv_id, count(*) FILTER (WHERE turn % 3 <> 0 AND turn < 7) / 7.0 AS ratio FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id""")
def coverage_ratios(spark, d):
    """Share of the required points that a JSON report has hit; a malformed report has hit none."""
    names = F.array(*[F.lit(x) for x in grade.COVERAGE_POINTS])
    turns = _table(spark, d, "conversations").select("conv_id", "turn").distinct()
    entry = F.format_string('"%s":%s', F.coalesce(F.get(names, F.col("turn").cast("int")), _cat("other", F.col("turn"))), (F.col("turn") % 3 != 0).cast("string"))
    reports = turns.groupBy("conv_id").agg(_cat("{", F.array_join(F.collect_list(entry), ","), "}").alias("report"))
    return reports.select("conv_id", grade.coverage_ratio(src.coverage(F.col("report"))).alias("ratio"))


@query("""SELECT conv_id, CAST(count(*) AS INT) AS tests, CAST(count(*) FILTER (WHERE turn % 5 = 1) AS INT) AS failures, CAST(count(*) FILTER (WHERE turn % 5 = 2) AS INT) AS errors, CAST(count(*) FILTER (WHERE turn % 5 = 3) AS INT) AS skipped, count(*) FILTER (WHERE turn % 5 IN (1, 2)) = 0 AS ok FROM conversations GROUP BY conv_id""")
def junit_reports(spark, d):
    line = F.expr("'<testcase name=\"t' || turn || '\">' || CASE turn % 5 WHEN 1 THEN '<failure/>' WHEN 2 THEN '<error message=\"x\"/>' WHEN 3 THEN '<skipped/>' ELSE '' END || '</testcase>'")
    return _logs(spark, d, line).select("conv_id", src.junit(_cat("<testsuites><testsuite>", F.col("log"), "</testsuite></testsuites>")).alias("r")).select("conv_id", "r.*")


@query("""SELECT conv_id, CASE WHEN turn % 4 IN (1, 2) THEN 'include' ELSE 'source' END AS kind, CASE turn % 4 WHEN 0 THEN 'rtl/f' || turn || '.sv' ELSE 'inc' || turn END AS entry, count(*) AS n FROM conversations WHERE turn % 4 <> 3 GROUP BY ALL""")
def file_lists(spark, d):
    line = F.expr("CASE turn % 4 WHEN 0 THEN '  rtl/f' || turn || '.sv  # file' WHEN 1 THEN '+incdir+inc' || turn WHEN 2 THEN '-Iinc' || turn ELSE '   # rest' END")
    found = src.file_list(_logs(spark, d, line), "log")
    return found.groupBy("conv_id", "kind", "entry").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 AS trainable, o_orderkey % 2 = 0 AS named FROM orders""")
def model_lists(spark, d):
    """Entries of JSON lists of models that can be trained, by either name, and those that have a name."""
    k = F.col("o_orderkey")
    one = _cat('[{"id":"', k, '","trainable":', (k % 3 == 0), ',"is_trainable":', (k % 5 == 0), ',"name":"', F.when(k % 2 == 0, "MyQwen-8").otherwise("other"), '"},{"id":"x"}]')
    return _table(spark, d, "orders").select(k.alias("id"), (F.size(src.models(one)) == 1).alias("trainable"), (F.size(src.models(one, "qwen")) == 1).alias("named"))


_WORDS = "(SELECT doc_id, text, n_chars, source FROM documents)"


@query(f"""SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) WHEN doc_id % 3 = 1 THEN 'x' ELSE 'module a; endmodule' END) AS code, md5(right(text, 60)) AS tail, md5(CASE WHEN doc_id % 3 = 2 THEN 'module top; endmodule' ELSE text END) AS renamed,
doc_id % 3 = 2 AS has_module, contains(text, source) AS contains, md5('guide' || chr(10) || chr(10) || source || chr(10) || chr(10) || text) AS prompt, 'f' || doc_id AS file, CASE WHEN n_chars % 4 = 0 THEN 0.0 ELSE doc_id / (n_chars % 4) END AS tokens_per_s FROM {_WORDS}""")
def text_functions(spark, d):
    """Fences, tails, renamed modules, prompts and rates, for each document."""
    i, t, m = F.col("doc_id"), F.col("text"), F.col("n_chars") % 4
    answer = F.when(i % 3 == 0, t).when(i % 3 == 1, "a ```systemverilog\nx\n``` b").otherwise("```sv module a; endmodule```")
    code = F.when(i % 3 == 2, "module a; endmodule").otherwise(t)
    return _table(spark, d, "documents").select(
        "doc_id", F.md5(tx.fenced(answer, tx.VERILOG_FENCE)).alias("code"), F.md5(tx.tail(t, 60)).alias("tail"), F.md5(F.when(i % 3 == 2, tx.rename_module(code, "top")).otherwise(t)).alias("renamed"), tx.has_module(code, "a;").alias("has_module"),
        tx.answer_contains(t, F.col("source")).alias("contains"), F.md5(tx.prompt(t, F.lit("guide"), [F.col("source")])).alias("prompt"), tx.module_name(_cat("f", i, ".sv")).alias("file"), tx.tokens_per_second(i, m).alias("tokens_per_s"),
    )


@query("""SELECT p_partkey, 'in' AS direction, 'a' || p_partkey AS name, CAST(p_size + 1 AS INT) AS width FROM part UNION ALL SELECT p_partkey, 'out', 'y', 1 FROM part""")
def header_ports(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    head = _cat("module m (\n input logic clk, input logic rst,\n input logic [", n, ":0] a", k, ",\n output logic y\n);\n input logic [3:0] hidden;")
    return _table(spark, d, "part").select("p_partkey", F.explode(tx.ports(head)).alias("p")).select("p_partkey", "p.*")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, min(CASE WHEN l_returnflag = 'R' THEN (l_linenumber % 6) / 5.0 ELSE 0.0 END) AS kill, bool_and(l_quantity * 30 BETWEEN 60 AND 1400) AS in_band, min(least(greatest(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 20.0 - 1 WHEN l_linenumber % 3 = 0 THEN 0.0 ELSE l_tax / 0.05 END, 0), 1)) AS subscore
FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def score_parts(spark, d):
    """Kill ratios, the band of cells and clamped sub-scores."""
    q, i = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    raw = F.when(i % 2 == 0, q / 20 - 1)
    weight = F.when(i % 3 == 0, 0.0).otherwise(0.05)
    parts = _table(spark, d, "lineitem").select(
        "l_orderkey", i, grade.kill_ratio((i % 6).cast("double"), F.col("l_returnflag") == "R").alias("k"), grade.in_band(q * 30).alias("b"), grade.subscore(raw, F.col("l_tax").cast("double"), weight).alias("s")
    )
    return parts.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("k").alias("kill"), F.bool_and("b").alias("in_band"), F.min("s").alias("subscore"))


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_orderkey // 1000 AS batch FROM orders) SELECT o_custkey, count(*) AS n FROM b WHERE batch = (SELECT max(batch) FROM b) GROUP BY o_custkey""")
def latest_batches(spark, d):
    rows = _table(spark, d, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 1000).alias("batch"))
    return grade.latest_batch(rows).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("""SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""")
def spec_lookup(spark, d):
    """Each row with the specification of its task."""
    specs = _table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), "c_mktsegment")
    return grade.with_specs(_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("task_id")), specs).select("o_orderkey", "c_mktsegment")


@query("""SELECT conv_id AS task, max_by(text, turn) AS golden FROM conversations GROUP BY conv_id""")
def last_golden(spark, d):
    """Of goldens under one key, the last counts."""
    goldens = _table(spark, d, "conversations").select(F.col("conv_id").alias("task"), F.col("text").alias("golden"), "turn")
    return grade.answers_with_goldens(goldens.select("task").distinct(), goldens, order="turn")


@query("""SELECT c_custkey AS task, c_custkey % 2 = 0 AS dsl_passed, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_custkey / (c_custkey % 3) END AS dsl_rate, CASE WHEN c_custkey % 5 <> 0 THEN 'v' || c_custkey END AS verilog_code FROM customer""")
def arm_records(spark, d):
    """Records of two arms side by side; an arm may lack one."""
    k = F.col("c_custkey")
    base = _table(spark, d, "customer").select(k.alias("task"), (k % 3).alias("latency"), k.alias("tokens"), F.lit("").alias("note"))
    t = F.col("task")
    dsl = base.select("*", F.lit("dsl").alias("arm"), _cat("d", t).alias("code"), F.when(t % 2 == 0, 1.0).otherwise(0.9).alias("reward"))
    verilog = base.where("task % 5 <> 0").select("*", F.lit("verilog").alias("arm"), _cat("v", t).alias("code"), F.lit(0.2).alias("reward"))
    return grade.arm_records(dsl.unionByName(verilog)).select("task", F.col("dsl.passed").alias("dsl_passed"), F.col("dsl.tokens_per_s").alias("dsl_rate"), F.col("verilog.code").alias("verilog_code"))


@query("""SELECT source, avg(CAST(quality AS DOUBLE)) FILTER (WHERE d.doc_id % 2 = 0) AS base, avg(CAST(quality AS DOUBLE)) FILTER (WHERE d.doc_id % 2 = 1) AS trained,
avg(CAST(quality AS DOUBLE)) FILTER (WHERE d.doc_id % 2 = 1) - avg(CAST(quality AS DOUBLE)) FILTER (WHERE d.doc_id % 2 = 0) AS gap FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""")
def arm_gaps(spark, d):
    """The series of a chart of two arms."""
    scores = _table(spark, d, "labels").join(_table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    scores = scores.select("source", F.col("quality").cast("double").alias("score"), F.when(F.col("doc_id") % 2 == 0, "base").otherwise("trained").alias("arm"))
    return grade.gap(scores, "arm", ("base", "trained"), ["source"])


@query("""SELECT source AS run, doc_id % 50 AS step, avg(CAST(quality AS DOUBLE)) AS mean, count(*) AS n FROM documents d JOIN labels l USING (doc_id) WHERE doc_id % 50 % 5 = 0 GROUP BY source, doc_id % 50""")
def running_means(spark, d):
    """Mean score of every fifth step of each run."""
    rows = _table(spark, d, "labels").join(_table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    means = grade.running_mean(rows.select(F.col("source").alias("run"), (F.col("doc_id") % 50).alias("step"), F.col("quality").cast("double").alias("reward")))
    return grade.every(means, 5)


@query("""SELECT event_type, count(*) FILTER (WHERE (event_id % 4) <> (event_id % 6) OR (value IS DISTINCT FROM nullif(value, 0))) AS mismatches FROM events GROUP BY event_type""")
def combinational_mismatches(spark, d):
    """Rows on which two sets of columns differ, without a clock."""
    i, v = F.col("event_id"), F.col("value")
    found = cosim.combinational(_table(spark, d, "events"), {"a": i % 4, "b": v}, {"a": i % 6, "b": F.nullif(v, F.lit(0))})
    return found.groupBy("event_type").agg(F.count_if("mismatch").alias("mismatches"))


@query("""SELECT p_partkey, p_partkey % 3 <> 0 AS sequential FROM part""")
def clock_detection(spark, d):
    k = F.col("p_partkey")
    names = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("clock"))).when(k % 3 == 1, F.array(F.lit("a"), F.lit("clk"))).otherwise(F.array(F.lit("rst")))
    return _table(spark, d, "part").select("p_partkey", cosim.is_sequential(names).alias("sequential"))


@query("""SELECT conv_id, max_by(text, turn) AS last FROM conversations GROUP BY conv_id""")
def last_messages(spark, d):
    rows = _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("content")))).alias("messages"))
    return rows.select("conv_id", tx.last_message(F.col("messages")).alias("last"))


@query("""SELECT item_id, CAST(r AS BIGINT) AS rollout FROM benchmark, LATERAL (SELECT unnest(range(8)) AS r)""")
def task_rollouts(spark, d):
    return grade.repeated(_table(spark, d, "benchmark").select("item_id"), 8)


@query("""SELECT item_id, md5(text) AS digest FROM benchmark""")
def written_tasks(spark, d):
    """Tasks written as text, a folder for each, and read back as whole files."""
    folder = f"{shared_dir(spark)}/tasks-{uuid.uuid4().hex}"
    src.write_tasks(_table(spark, d, "benchmark").withColumn("task", F.col("item_id")), folder, "text")
    back = src.texts(spark, f"{folder}/*/*.txt")
    return back.select(F.regexp_extract("path", r"task=(\d+)/", 1).cast("long").alias("item_id"), F.md5(F.regexp_replace("text", r"\n\z", "")).alias("digest"))


@query("""SELECT c_custkey, c_custkey % 2 = 0 AS found FROM customer""")
def whole_names(spark, d):
    """A name as a whole word of a text."""
    k = F.col("c_custkey")
    text = F.when(k % 2 == 0, _cat("see m", k, ", then")).otherwise(_cat("see m", k, "x and xm", k))
    return _table(spark, d, "customer").select("c_custkey", tx.names(text, _cat("m", k)).alias("found"))


@query("""SELECT * FROM (VALUES ('flat', CAST(1 AS BIGINT), 0.5::DOUBLE), ('flat', 2, 0.5::DOUBLE), ('up', 1, 0.25::DOUBLE), ('up', 2, 1.0::DOUBLE)) v(run, step, value)""")
def recorded_series(spark, d):
    return src.series(spark, {"flat": [0.5, 0.5], "up": [0.25, 1.0]})
