import pytest
from pyspark.sql import functions as F

from mooreflow.operators.run import Stimulus, trace
from mooreflow.plans import fixtures
from mooreflow.streaming import machines


def parts(spark, path, orders):
    """One file of the same 60 rows for each range of orders, in that order of arrival."""
    import time

    for lo, hi in orders:
        spark.range(lo, hi).select((F.col("id") % 3).alias("k"), "id", (F.hash("id") % 2 == 0).cast("int").alias("x")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by their time


def streamed(spark, path, name, checkpoint, **options):
    source = spark.readStream.schema("k long, id long, x int").option("maxFilesPerTrigger", 1).parquet(path)
    out = machines.run(fixtures.machine(fixtures.SEQ101), Stimulus(source, ("k",), ("id",), {"x": F.col("x")}), **options)
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_batches_in_order_give_the_batch_result(spark, tmp_path):
    path = str(tmp_path / "in")
    parts(spark, path, [(0, 20), (20, 35), (35, 60)])
    got = {(r["k"], r["id"]): r["state_post"] for r in streamed(spark, path, "ordered", str(tmp_path / "c")).collect()}
    batch = trace(fixtures.machine(fixtures.SEQ101), Stimulus(spark.read.parquet(path), ("k",), ("id",), {"x": F.col("x")}))
    assert len(got) == 60 and got == {(r["k"], r["id"]): r["state_post"] for r in batch.collect()}


def test_late_rows_are_refused(spark, tmp_path):
    path = str(tmp_path / "in")
    parts(spark, path, [(30, 60), (0, 30)])
    with pytest.raises(Exception, match="came after"):
        streamed(spark, path, "late", str(tmp_path / "c"))
    kept = streamed(spark, path, "late_kept", str(tmp_path / "c2"), reject_late=False)
    assert kept.count() == 60


def test_steps_by_table():
    """The table holds what the guards say, for every state and input word."""
    from mooreflow.plans.generate import random_machines
    from mooreflow.plans.lower import reads
    from mooreflow.streaming.machines import next_state, table_of

    for m in random_machines(12, seed=4, rich=True):
        inputs, width = reads(m), {p.name: p.width for p in m.inputs}
        table = table_of(m, inputs)
        for word in range(1 << sum(width[n] for n in inputs)) if table else ():
            row, at = {}, 0
            for n in inputs:
                row[n], at = word >> at & ((1 << width[n]) - 1), at + width[n]
            assert [table[i][word] for i in range(len(m.states))] == [next_state(m, i, row) for i in range(len(m.states))]
