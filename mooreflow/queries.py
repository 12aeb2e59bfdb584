"""The engine's own queries over the test tables, each beside independent SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mooreflow.functions import text as tx
from mooreflow.operators import cosim, fifo, grade
from mooreflow.operators.run import Stimulus, fold, trace
from mooreflow.plans import fixtures
from mooreflow.sources import tasks as src

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str, reset: Column | None = None, **inputs: Column) -> Stimulus:
    return Stimulus(_table(spark, d, "events"), ("user_id",), ("ts", "event_id"), inputs, reset)


def _click() -> Column:
    return F.col("event_type") == "click"


def walk(key: str, source: str, step: str, first: str = "0") -> str:
    """Recursive SQL that walks each key's rows (key, rn, ...) with a step over t.s and the row e:
    tables e, and t (key, rn, s, p): state after and before row rn."""
    return f"""WITH RECURSIVE e AS ({source}), t AS (
  SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS rn, {first} AS s, {first} AS p FROM e
  UNION ALL SELECT e.{key}, e.rn, {step} AS s, t.s AS p FROM t JOIN e ON e.{key} = t.{key} AND e.rn = t.rn + 1)"""


_EV = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS x FROM events"
_S101 = "CASE t.s WHEN 0 THEN e.x WHEN 1 THEN CASE WHEN e.x = 1 THEN 1 ELSE 2 END WHEN 2 THEN CASE WHEN e.x = 1 THEN 3 ELSE 0 END ELSE CASE WHEN e.x = 1 THEN 1 ELSE 2 END END"
_S101_PLAIN = "CASE t.s WHEN 0 THEN e.x WHEN 1 THEN CASE WHEN e.x = 1 THEN 1 ELSE 2 END WHEN 2 THEN CASE WHEN e.x = 1 THEN 3 ELSE 0 END ELSE CASE WHEN e.x = 1 THEN 1 ELSE 0 END END"
_HAND = "CASE t.s WHEN 0 THEN e.x WHEN 1 THEN 2 ELSE CASE WHEN e.x = 1 THEN 2 ELSE 0 END END"
_GAUGE_EV = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, CAST(floor(value) AS BIGINT) & 255 AS level, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS alarm FROM events"
_GAUGE = """CASE t.s WHEN 0 THEN CASE WHEN e.alarm = 1 AND e.level >= 200 THEN 3 WHEN e.level > 100 THEN 1 ELSE 0 END
 WHEN 1 THEN CASE WHEN e.level <> 7 AND e.level % 2 = 1 THEN 0 WHEN e.level < 50 OR e.alarm = 1 THEN 2 ELSE 1 END
 WHEN 2 THEN CASE WHEN e.level <> 0 AND e.alarm = 0 THEN 1 ELSE 0 END ELSE CASE WHEN e.level >= 128 THEN 3 ELSE 0 END END"""


@query("""WITH o AS (SELECT user_id, event_type = 'click' AS x, lag(event_type = 'click', 1) OVER w AS x1, lag(event_type = 'click', 2) OVER w AS x2
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS "rows", count(*) FILTER (WHERE x AND NOT coalesce(x1, true) AND coalesce(x2, false)) AS detections FROM o GROUP BY user_id""")
def seq101_by_user(spark, d):
    """Overlapping 101 in each user's clicks; the SQL is the closed form over the last three rows."""
    return fold(fixtures.machine(fixtures.SEQ101), _events(spark, d, x=_click()), {"detections": [3]}).select("user_id", "rows", "detections")


@query(walk("user_id", _EV, _S101) + " SELECT CAST(sum(CASE WHEN s = 3 THEN 1 ELSE 0 END) AS BIGINT) AS detections, count(*) AS n FROM t WHERE rn > 0")
def seq101_trace_total(spark, d):
    traced = trace(fixtures.machine(fixtures.SEQ101), _events(spark, d, x=_click()))
    return traced.agg(F.sum("y").alias("detections"), F.count("*").alias("n"))


@query("""WITH o AS (SELECT event_type = 'click' AS x, lag(event_type = 'click', 1) OVER w AS x1, lag(event_type = 'click', 2) OVER w AS x2 FROM events WINDOW w AS (ORDER BY ts, event_id))
SELECT count(*) FILTER (WHERE x AND NOT coalesce(x1, true) AND coalesce(x2, false)) AS detections, count(*) AS n FROM o""")
def seq101_one_key(spark, d):
    """The whole table as one key: chunks spread it over the tasks."""
    rows = _table(spark, d, "events").withColumn("all", F.lit(1))
    traced = trace(fixtures.machine(fixtures.SEQ101), Stimulus(rows, ("all",), ("ts", "event_id"), {"x": _click()}))
    return traced.agg(F.sum("y").alias("detections"), F.count("*").alias("n"))


@query("""WITH o AS (SELECT CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) % 3 AS s FROM events)
SELECT CASE s WHEN 0 THEN 'RED' WHEN 1 THEN 'GREEN' ELSE 'YELLOW' END AS state, s AS light, count(*) AS n FROM o GROUP BY s""")
def traffic_occupancy(spark, d):
    from mooreflow.plans.lower import state_name

    m = fixtures.machine(fixtures.TRAFFIC)
    traced = trace(m, _events(spark, d, tick=_click()))
    return traced.groupBy(state_name(m, F.col("state_post")).alias("state"), "light").agg(F.count("*").alias("n"))


@query(walk("user_id", _EV, _HAND) + """ SELECT e.user_id, e.event_id, CAST(t.p AS BIGINT) AS state_pre, CAST(t.s AS BIGINT) AS state_post, CAST(CASE WHEN t.s = 1 THEN 1 ELSE 0 END AS BIGINT) AS busy, CAST(CASE WHEN t.s = 2 THEN 1 ELSE 0 END AS BIGINT) AS ack
FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn""")
def handshake_trace(spark, d):
    traced = trace(fixtures.machine(fixtures.HANDSHAKE), _events(spark, d, req=_click()))
    return traced.select("user_id", "event_id", F.col("state_pre").cast("long").alias("state_pre"), F.col("state_post").cast("long").alias("state_post"), "busy", "ack")


@query(walk("user_id", _EV, f"CASE WHEN e.event_type = 'error' THEN 0 ELSE {_S101} END") + " SELECT user_id, CAST(sum(CASE WHEN s = 3 THEN 1 ELSE 0 END) AS BIGINT) AS detections, CAST(max_by(s, rn) AS BIGINT) AS last FROM t WHERE rn > 0 GROUP BY user_id")
def fsm_reset_in_stream(spark, d):
    """A reset row puts the machine into its reset state, whatever its inputs."""
    traced = trace(fixtures.machine(fixtures.SEQ101), _events(spark, d, F.col("event_type") == "error", x=_click()))
    return traced.groupBy("user_id").agg(F.sum("y").alias("detections"), F.max_by("state_post", F.struct("ts", "event_id")).cast("long").alias("last"))


@query(walk("user_id", _GAUGE_EV, _GAUGE) + " SELECT user_id, s AS zone, count(*) AS n FROM t WHERE rn > 0 GROUP BY user_id, s")
def fsm_multi_input(spark, d):
    """Vectors, comparisons, a bit, negation and priority."""
    s = _events(spark, d, level=F.floor("value"), alarm=F.col("event_type") == "error")
    traced = trace(fixtures.machine(fixtures.GAUGE), s)
    return traced.groupBy("user_id", F.col("zone").alias("zone")).agg(F.count("*").alias("n"))


_LINE_COLS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(walk("l_orderkey", f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_COLS)}) AS rn, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS x FROM lineitem", _S101) + " SELECT CAST(s AS BIGINT) AS state, count(*) AS n FROM t WHERE rn > 0 GROUP BY s")
def fsm_by_order(spark, d):
    """Line numbers repeat within an order, so all columns order the rows."""
    s = Stimulus(_table(spark, d, "lineitem"), ("l_orderkey",), tuple(_LINE_COLS), {"x": F.col("l_returnflag") == "R"})
    counts = fold(fixtures.machine(fixtures.SEQ101), s, {str(i): [i] for i in range(4)})
    long = counts.select(F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("state"), F.col(str(i)).alias("n")) for i in range(4)])).alias("x"))
    return long.groupBy("x.state").agg(F.sum("x.n").alias("n")).where("n > 0")


@query(walk("conv_id", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS x FROM conversations", _HAND) + " SELECT conv_id, CAST(max_by(s, rn) AS BIGINT) AS last, CAST(sum(CASE WHEN s = 2 THEN 1 ELSE 0 END) AS BIGINT) AS acks FROM t WHERE rn > 0 GROUP BY conv_id")
def fsm_conversation(spark, d):
    s = Stimulus(_table(spark, d, "conversations"), ("conv_id",), ("turn",), {"req": F.col("role") == "user"})
    got = fold(fixtures.machine(fixtures.HANDSHAKE), s, {"acks": [2]})
    order = F.when(F.col("last_state") == "IDLE", 0).when(F.col("last_state") == "BUSY", 1).otherwise(2).cast("long")
    return got.select("conv_id", order.alias("last"), "acks")


@query(walk("user_id", _EV, _HAND) + " SELECT CAST(p AS BIGINT) AS state_pre, CAST(s AS BIGINT) AS state_post, count(*) AS n FROM t WHERE rn > 0 GROUP BY p, s")
def state_transition_matrix(spark, d):
    m = cosim.transition_matrix(trace(fixtures.machine(fixtures.HANDSHAKE), _events(spark, d, req=_click())))
    return m.select(F.col("state_pre").cast("long").alias("state_pre"), F.col("state_post").cast("long").alias("state_post"), "n")


@query(walk("user_id", _GAUGE_EV, _GAUGE) + ", n AS (SELECT s, count(*) AS n FROM t WHERE rn > 0 GROUP BY s) SELECT v.state, coalesce(n.n, 0) AS n, n.n IS NOT NULL AS covered FROM (VALUES (0, 'LOW'), (1, 'HIGH'), (2, 'MID'), (3, 'PANIC')) v(s, state) LEFT JOIN n ON n.s = v.s")
def state_coverage(spark, d):
    m = fixtures.machine(fixtures.GAUGE)
    return cosim.coverage(trace(m, _events(spark, d, level=F.floor("value"), alarm=F.col("event_type") == "error")), m)


def _two(step_b: str, then: str) -> str:
    a = walk("user_id", _EV, _S101)
    return f"{a}, u AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, 0 AS s FROM (SELECT DISTINCT user_id FROM e) UNION ALL SELECT e.user_id, e.rn, {step_b.replace('t.s', 'u.s')} FROM u JOIN e ON e.user_id = u.user_id AND e.rn = u.rn + 1), c AS (SELECT e.user_id, e.event_id, e.rn, CASE WHEN t.s = 3 THEN 1 ELSE 0 END AS gold, CASE WHEN u.s = 3 THEN 1 ELSE 0 END AS dut FROM e JOIN t ON t.user_id = e.user_id AND t.rn = e.rn JOIN u ON u.user_id = e.user_id AND u.rn = e.rn) {then}"


def _compared(spark, d):
    return cosim.compare(fixtures.machine(fixtures.SEQ101), fixtures.machine(fixtures.SEQ101_PLAIN), _events(spark, d, x=_click()))


@query(_two(_S101_PLAIN, 'SELECT user_id, count(*) FILTER (WHERE gold <> dut) AS mismatches, count(*) FILTER (WHERE gold <> dut) = 0 AS "pass" FROM c GROUP BY user_id'))
def cosim_mismatch_count(spark, d):
    return cosim.mismatch_counts(_compared(spark, d), ["user_id"])


@query(_two(_S101_PLAIN, "SELECT user_id, min_by(event_id, rn) AS event_id, 'y' AS port, CAST(min_by(gold, rn) AS BIGINT) AS gold, CAST(min_by(dut, rn) AS BIGINT) AS dut FROM c WHERE gold <> dut GROUP BY user_id"))
def cosim_first_mismatch(spark, d):
    return cosim.first_mismatch(_compared(spark, d), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""WITH RECURSIVE x AS (SELECT * FROM (VALUES (0), (1)) v(x)), r AS (SELECT 0 AS a, 0 AS b UNION
 SELECT CASE r.a WHEN 0 THEN x.x WHEN 1 THEN CASE WHEN x.x = 1 THEN 1 ELSE 2 END WHEN 2 THEN CASE WHEN x.x = 1 THEN 3 ELSE 0 END ELSE CASE WHEN x.x = 1 THEN 1 ELSE 2 END END,
        CASE r.b WHEN 0 THEN x.x WHEN 1 THEN CASE WHEN x.x = 1 THEN 1 ELSE 2 END WHEN 2 THEN CASE WHEN x.x = 1 THEN 3 ELSE 0 END ELSE CASE WHEN x.x = 1 THEN 1 ELSE 0 END END FROM r, x)
SELECT 'S' || a AS a_state, 'S' || b AS b_state FROM r""")
def product_reachability(spark, d):
    pairs = cosim.reachable_pairs(spark, fixtures.machine(fixtures.SEQ101), fixtures.machine(fixtures.SEQ101_PLAIN))
    return pairs.select("a_state", "b_state")


_SCORES = "SELECT d.doc_id, d.source, CAST(l.quality AS DOUBLE) AS q, CAST(1 - l.toxic AS DOUBLE) AS c, CASE WHEN d.n_chars % 5 < 3 THEN 1.0 ELSE 0.0 END AS b FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


def _scores(spark, d):
    joined = _table(spark, d, "labels").join(_table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return joined.select("doc_id", "source", F.col("quality").cast("double").alias("q"), (1 - F.col("toxic")).cast("double").alias("c"), F.when(F.col("n_chars") % 5 < 3, 1.0).otherwise(0.0).alias("b"))


def _rewards(spark, d):
    s = _scores(spark, d)
    return s.withColumns({"reward": grade.machine_reward(F.col("c"), F.col("q"), F.col("b")), "compile": F.col("c"), "behavior": F.col("b")})


_REWARDS = f"SELECT *, CASE WHEN c = 0 THEN 0.0 ELSE round(0.2 * c + 0.1 * q + 0.7 * b, 4) END AS reward FROM ({_SCORES})"


@query(f"SELECT doc_id, CAST(reward AS DOUBLE) AS reward FROM ({_REWARDS})")
def reward_blend(spark, d):
    return _rewards(spark, d).select("doc_id", "reward")


@query(f"""SELECT source, count(*) AS tasks, avg(CASE WHEN c = 1 THEN 1.0 ELSE 0.0 END) AS compiled, avg(CASE WHEN b = 1 THEN 1.0 ELSE 0.0 END) AS functional_pass_at_1, avg(CASE WHEN reward >= 0.999 THEN 1.0 ELSE 0.0 END) AS fully_clean_pass_at_1,
avg(CASE WHEN reward >= 0.7 THEN 1.0 ELSE 0.0 END) AS behavior_correct, avg(CAST(reward AS DOUBLE)) AS avg_reward FROM ({_REWARDS}) GROUP BY source""")
def pass_at_1(spark, d):
    return grade.summary(_rewards(spark, d), ["source"])


@query(f"""SELECT doc_id, CASE WHEN b = 0 THEN 0.0 ELSE CAST(round(0.25 * b + 0.45 * q + 0.20 * c + 0.10 * 1.0, 6) AS DOUBLE) END AS dv, CASE WHEN b = 0 THEN 0.0 ELSE CAST(round(0.20 * b + 0.65 * q + 0.10 * c + 0.05 * 1.0, 6) AS DOUBLE) END AS formal,
CASE WHEN q = 0 THEN 0.0 ELSE CAST(round(0.5 * q + 0.1 * (b + c + 1.0) + 0.2 * c, 6) AS DOUBLE) END AS repair FROM ({_SCORES})""")
def hard_cap(spark, d):
    q, c, b, one = F.col("q"), F.col("c"), F.col("b"), F.lit(1.0)
    return _scores(spark, d).select("doc_id", grade.dv_reward(b, q, c, one).alias("dv"), grade.formal_reward(b, q, c, one).alias("formal"), grade.repair_reward(q, b, c, one, c).alias("repair"))


@query(f"SELECT CAST(round(reward, 2) AS DOUBLE) AS reward, count(*) AS n FROM ({_REWARDS}) GROUP BY round(reward, 2)")
def reward_histogram(spark, d):
    return grade.histogram(_rewards(spark, d))


@query(f"SELECT doc_id % 10 AS step, avg(CAST(reward AS DOUBLE)) AS mean, CAST(max(reward) - min(reward) AS DOUBLE) AS spread FROM ({_REWARDS}) GROUP BY doc_id % 10")
def step_spread(spark, d):
    return grade.step_spread(_rewards(spark, d).withColumn("step", F.col("doc_id") % 10))


@query(f"""WITH r AS ({_REWARDS}), s AS (SELECT doc_id, 'quality' AS name, 0.4 AS weight, q AS value FROM r UNION ALL SELECT doc_id, 'behavior', 0.6, b FROM r), t AS (SELECT doc_id, sum(weight * value) AS total FROM s GROUP BY doc_id)
SELECT doc_id, name, CAST(weight AS DOUBLE) AS weight, CAST(value AS DOUBLE) AS value FROM s UNION ALL SELECT t.doc_id, 'hard_cap_penalty', CAST(r.reward * 0.5 - t.total AS DOUBLE), 1.0 FROM t JOIN r ON r.doc_id = t.doc_id WHERE r.reward * 0.5 + 1e-9 < t.total""")
def subscores_reconciled(spark, d):
    r = _rewards(spark, d)
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.col(c).alias("value")) for n, w, c in (("quality", 0.4, "q"), ("behavior", 0.6, "b"))])
    return grade.reconciled(r.select("doc_id", F.explode(parts).alias("x")).select("doc_id", "x.*"), r.select("doc_id", (F.col("reward") * 0.5).alias("reward")), ["doc_id"])


@query("SELECT d.source, count(*) AS pairs, CAST(sum(l.quality) AS BIGINT) AS quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source")
def answers_join_goldens(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("task"), "source")
    both = grade.answers_with_goldens(docs, _table(spark, d, "labels").select(F.col("doc_id").alias("task"), F.col("quality").alias("golden")))
    return both.groupBy("source").agg(F.count("*").alias("pairs"), F.sum("golden").cast("long").alias("quality"))


@query(f"SELECT doc_id AS task, max(CASE WHEN arm = 'dsl' THEN r END) AS dsl, max(CASE WHEN arm = 'verilog' THEN r END) AS verilog FROM (SELECT doc_id, a.arm, CAST(CASE WHEN a.arm = 'dsl' THEN reward ELSE 0.2 * c END AS DOUBLE) AS r FROM ({_REWARDS}) CROSS JOIN (VALUES ('dsl'), ('verilog')) a(arm)) GROUP BY doc_id")
def arm_cross(spark, d):
    """Each task under both arms, the scores side by side."""
    arms = spark.createDataFrame([("dsl",), ("verilog",)], "arm string")
    rows = _rewards(spark, d).crossJoin(F.broadcast(arms)).select(F.col("doc_id").alias("task"), "arm", F.when(F.col("arm") == "dsl", F.col("reward")).otherwise(0.2 * F.col("c")).alias("reward"))
    return grade.per_arm(rows)


_FENCED = "CASE turn % 4 WHEN 0 THEN 'see ```fsm' || chr(10) || text || chr(10) || '``` and ```fsm x```' WHEN 1 THEN '```' || text || '```' WHEN 2 THEN '  ' || text || chr(10) ELSE '``` ```' END"


@query(f"WITH a AS (SELECT conv_id, turn, {_FENCED} AS t FROM conversations) SELECT conv_id, turn, md5(trim(CASE WHEN regexp_matches(t, '```(fsm|dsl)?\\s*(.*?)```', 's') THEN regexp_extract(t, '```(?:fsm|dsl)?\\s*(.*?)```', 1, 's') ELSE t END, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS code FROM a")
def fence_extract(spark, d):
    x = F.col("text")
    fenced = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("see ```fsm\n"), x, F.lit("\n``` and ```fsm x```"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("```"), x, F.lit("```"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("  "), x, F.lit("\n"))).otherwise("``` ```")
    return _table(spark, d, "conversations").select("conv_id", "turn", F.md5(tx.fenced(fenced)).alias("code"))


@query("SELECT doc_id, length(lower(text)) - length(replace(lower(text), 'e', '')) AS n FROM documents")
def letter_count(spark, d):
    return _table(spark, d, "documents").select("doc_id", tx.letters(F.col("text"), "E").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN NOT contains(t, 'mutants') AND contains(t, 'assert(') AND contains(t, 'assume(') AND contains(t, 'cover(') THEN 1.0 ELSE 0.0 END AS score
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || ' assert(a) assume(b) cover(c)' WHEN turn % 3 = 1 THEN text || ' assert(a) assume(b) cover(c) mutants' ELSE text END AS t FROM conversations)""")
def hygiene_flags(spark, d):
    whole = F.concat(F.col("text"), F.when(F.col("turn") % 3 == 0, " assert(a) assume(b) cover(c)").when(F.col("turn") % 3 == 1, " assert(a) assume(b) cover(c) mutants").otherwise(""))
    return _table(spark, d, "conversations").select("conv_id", "turn", tx.hygiene(whole, "formal").alias("score"))


@query("SELECT count(*) AS n FROM (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT md5(text) FROM documents WHERE doc_id % 2 = 1)")
def prompt_overlap_md5(spark, d):
    """Texts that two splits share; the splits are the even and odd ids."""
    docs = _table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return docs.where("doc_id % 2 = 0").select("h").intersect(docs.where("doc_id % 2 = 1").select("h")).agg(F.count("*").alias("n"))


@query("SELECT source, count(DISTINCT md5(text)) AS n FROM documents GROUP BY source")
def distinct_hashes(spark, d):
    return _table(spark, d, "documents").groupBy("source").agg(F.count_distinct(F.md5("text")).alias("n"))


@query("SELECT doc_id, printf('task_%04d', row_number() OVER (ORDER BY doc_id) - 1) AS task FROM documents ORDER BY doc_id LIMIT 25")
def first_n_tasks(spark, d):
    """A top-n report: the first tasks, renumbered from 0."""
    return grade.renumbered(_table(spark, d, "documents").select("doc_id"), "doc_id", 25)


@query("SELECT g.i // 8 AS step, g.i % 8 AS slot, p.item_id FROM (SELECT unnest(range(100)) AS i) g JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS n FROM benchmark) p ON p.idx = g.i % p.n WHERE g.i < 96")
def cycle_batches(spark, d):
    from pyspark.sql import Window

    pool = _table(spark, d, "benchmark").select("item_id", (F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("idx"))
    return grade.cycled(pool, "idx", pool.count(), 12, 8).select("step", "slot", "item_id")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_counts(spark, d):
    return _table(spark, d, "events").withColumn("p", F.from_json("props", "k long")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query("""WITH j AS (SELECT user_id, event_id, '{"modules":{"top":{"cells":{"a":{"type":"$dff"},"b":{"type":"$' || event_type || '"}}}}}' AS n FROM events)
SELECT t AS "type", CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([json_extract_string(n, '$.modules.top.cells.a.type'), json_extract_string(n, '$.modules.top.cells.b.type')]) AS t FROM j) GROUP BY t""")
def netlist_cells(spark, d):
    raw = F.concat(F.lit('{"modules":{"top":{"cells":{"a":{"type":"$dff"},"b":{"type":"$'), "event_type", F.lit('"}}}}}'))
    found = _table(spark, d, "events").select("event_id", src.netlist(raw).alias("netlist"))
    return grade.cells(found).groupBy("type").agg(F.count("*").alias("n"))


def _queue_rows(spark, d):
    e = _table(spark, d, "events")
    kind = F.col("event_type")
    return e.select(
        "user_id", "ts", "event_id", F.when((kind == "error") & (F.col("event_id") % 7 == 0), 1).otherwise(0).alias("rst"),
        kind.isin("click", "view", "purchase").cast("int").alias("valid0"), (F.col("event_id") % 256).cast("int").alias("data0"),
        kind.isin("view", "signup", "purchase").cast("int").alias("valid1"), (F.col("event_id") * 3 % 256).cast("int").alias("data1"), (F.col("event_id") % 5 < 2).cast("int").alias("yumi"),
    )


_QUEUE_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 1 ELSE 0 END AS rst,
 event_type IN ('click', 'view', 'purchase') AS v0, event_id % 256 AS d0, event_type IN ('view', 'signup', 'purchase') AS v1, event_id * 3 % 256 AS d1, event_id % 5 < 2 AS y FROM events),
t AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS q, 0 AS rr, CAST([] AS BIGINT[]) AS seen FROM e
 UNION ALL SELECT user_id, rn, CASE WHEN rst = 1 THEN [] ELSE CASE WHEN pop THEN q[2:] ELSE q END || CASE WHEN push THEN [CASE WHEN lane = 0 THEN d0 ELSE d1 END] ELSE [] END END,
  CASE WHEN rst = 1 THEN 0 WHEN push THEN 1 - lane ELSE rr END, [CAST(push AND lane = 0 AS BIGINT), CAST(push AND lane = 1 AS BIGINT), CASE WHEN push THEN lane ELSE 0 END, CAST(len(q) > 0 AS BIGINT), q[1], len(q)]
 FROM (SELECT *, (v0 OR v1) AND (len(q) < 8 OR pop) AS push FROM (SELECT e.*, t.q, t.rr, e.y AND len(t.q) > 0 AS pop, CASE WHEN e.v0 AND e.v1 THEN t.rr WHEN e.v1 THEN 1 ELSE 0 END AS lane FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn + 1)))
"""


@query(_QUEUE_SQL + "SELECT e.user_id, e.event_id, CAST(seen[1] AS INT) AS ready0, CAST(seen[2] AS INT) AS ready1, CAST(seen[3] AS INT) AS selected, CAST(seen[4] AS INT) AS valid, CAST(seen[5] AS INT) AS data, CAST(seen[6] AS INT) AS \"count\" FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn")
def fifo_trace(spark, d):
    traced = fifo.trace(_queue_rows(spark, d), ["user_id"], ["ts", "event_id"])
    return traced.select("user_id", "event_id", "ready0", "ready1", "selected", "valid", "data", "count")


@query(_QUEUE_SQL + "SELECT e.user_id, CAST(sum((seen[1] + seen[2]) * (1 - e.rst)) AS BIGINT) AS accepted, CAST(sum(CASE WHEN e.y AND e.rst = 0 THEN seen[4] ELSE 0 END) AS BIGINT) AS popped, CAST(max_by(len(q), t.rn) AS BIGINT) AS \"count\" FROM t JOIN e ON e.user_id = t.user_id AND e.rn = t.rn GROUP BY e.user_id")
def fifo_totals(spark, d):
    return fifo.fold(_queue_rows(spark, d), ["user_id"], ["ts", "event_id"]).drop("checksum")
