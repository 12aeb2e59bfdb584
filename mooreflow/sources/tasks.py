"""Sources and sinks: programs, task folders, answers, reports, and run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NETLIST = "struct<modules:map<string,struct<cells:map<string,struct<type:string>>>>>"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path, text. Glob patterns and any store that Spark reads."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def task_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of task folders: task, file, text."""
    found = texts(spark, f"{root}/task_*/*")
    part = lambda i: F.regexp_extract("path", r"/(task_[^/]*)/([^/]*)$", i)
    return found.select(part(1).alias("task"), part(2).alias("file"), "text").where("task <> ''")


def tasks(spark: SparkSession, root: str) -> DataFrame:
    """One row per task folder, by name: task, program, prompt (null if missing), golden."""
    one = lambda name: F.max(F.when(F.col("file") == name, F.col("text")))
    return task_files(spark, root).groupBy("task").agg(one("machine.fsm").alias("program"), one("prompt.txt").alias("prompt"), one("golden.sv").alias("golden")).orderBy("task")


def answers(spark: SparkSession, run: str) -> DataFrame:
    """Answer files of a run: task, answer."""
    return texts(spark, f"{run}/task_*.txt").select(F.regexp_extract("path", r"/(task_[^/]*)\.txt$", 1).alias("task"), F.col("text").alias("answer"))


def guide(files: DataFrame) -> DataFrame:
    """Example files (ord, text) as one text."""
    return files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("guide"))


def coverage(c: Column) -> Column:
    """A coverage report as map<string,boolean>; a malformed one is empty."""
    return F.coalesce(F.from_json(c, "map<string,boolean>"), F.create_map().cast("map<string,boolean>"))


def netlist(c: Column) -> Column:
    return F.from_json(c, NETLIST)


def junit(c: Column) -> Column:
    """tests, failures, errors, skipped and whether all is well, of a test report in XML."""
    count = lambda path: F.xpath_int(c, F.lit(f"count({path})"))
    n, bad, err, skip = (count(f"//testcase{x}") for x in ("", "[failure]", "[error]", "[skipped]"))
    return F.struct(n.alias("tests"), bad.alias("failures"), err.alias("errors"), skip.alias("skipped"), ((n > 0) & (bad + err == 0)).alias("ok"))


def file_list(df: DataFrame, text: str = "text") -> DataFrame:
    """Entries of file lists: line, kind (source or include), entry; comments and blank lines go."""
    lines = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    lines = lines.withColumn("entry", F.trim(F.regexp_replace("raw", "#.*$", ""))).where("entry <> ''")
    include = F.startswith("entry", F.lit("+incdir+")) | F.startswith("entry", F.lit("-I"))
    return lines.select(*[c for c in lines.columns if c not in ("raw", "entry")], F.when(include, "include").otherwise("source").alias("kind"), F.regexp_replace("entry", r"^(\+incdir\+|-I)", "").alias("entry"))


MODEL = "struct<name:string,model_name:string,provider:string,id:string,trainable:boolean,is_trainable:boolean>"


def models(c: Column, named: str | None = None) -> Column:
    """Trainable entries of a JSON list of models, by either of two names for that; with named, instead
    the entries in whose text the name occurs, whatever its case."""
    found = F.transform(F.from_json(c, "array<string>"), lambda raw: F.struct(F.from_json(raw, MODEL).alias("m"), raw.alias("raw")))
    if named is not None:
        kept = F.filter(found, lambda x: F.contains(F.lower(x["raw"]), F.lit(named.lower())))
    else:
        kept = F.filter(found, lambda x: F.coalesce(x["m"]["trainable"], F.lit(False)) | F.coalesce(x["m"]["is_trainable"], F.lit(False)))
    return F.transform(kept, lambda x: x["m"])


def series(spark: SparkSession, recorded: dict[str, list[float]]) -> DataFrame:
    """Recorded series as a table: run, step (from 1), value."""
    return spark.createDataFrame([(run, i, float(v)) for run, values in recorded.items() for i, v in enumerate(values, 1)], "run string, step long, value double")


def write_tasks(df: DataFrame, path: str, column: str) -> None:
    """One folder per task with the column as text."""
    df.select("task", F.col(column).alias("value")).write.partitionBy("task").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.json(path)
