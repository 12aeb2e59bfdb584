"""Scalar functions over answers, headers and logs, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\r\x0b\x0c"
# Patterns of fenced blocks, ports, scenario and mismatch lines, and log markers.
FSM_FENCE = r"(?s)```(?:fsm|dsl)?\s*(.*?)```"
VERILOG_FENCE = r"(?s)```(?:systemverilog|verilog|sv)?\s*(.*?)```"
PORT = r"(input|output)\s+logic\s*(?:\[(\d+):(\d+)\])?\s*(\w+)"
SCENARIO = r"^\s*SCENARIO\s+(\S+)\s+(PASS|FAIL)"
REWARD = r"'reward': ([0-9.]+)"
STEP = r"([0-9]+)/200"
EVALUATION = r"EVAL"
HYGIENE = {
    "testbench": {"forbidden": ("/donotaccess", "donotaccess", "stream_arb_fifo_golden", "run_cocotb_hidden"), "all": (("@cocotb.test",), ("RisingEdge", "FallingEdge")), "unsupported": (), "helper": r"\bmark_coverage\s*\("},
    "formal": {
        "forbidden": ("/donotaccess", "donotaccess", "stream_arb_fifo_golden", "mutants"),
        "all": (("assert(", "assert ("), ("assume(", "assume (", "reset_i <="), ("cover(", "cover (")),
        "unsupported": ("property ", "endproperty", "sequence ", "endsequence", "assert property"),
        "helper": None,
    },
}


def strip(c: Column) -> Column:
    """c without white space of ASCII at both ends."""
    return F.btrim(c, F.lit(_SPACE))


def fenced(c: Column, pattern: str = FSM_FENCE, empty_is_null: bool = False) -> Column:
    """The first fenced block of an answer, or the whole answer, stripped. A block that is there but
    empty stays empty, or is null with empty_is_null."""
    out = strip(F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c))
    return F.nullif(out, F.lit("")) if empty_is_null else out


def ports(c: Column) -> Column:
    """Ports of a module header as array<struct<direction,name,width>>, clock and reset left out."""
    head = F.substring_index(c, ");", 1)
    part = lambda i: F.regexp_extract_all(head, F.lit(PORT), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("direction"), part(2).alias("hi"), part(3).alias("lo"), part(4).alias("name"))
    width = lambda x: F.coalesce(x["hi"].try_cast("int") - x["lo"].try_cast("int") + 1, F.lit(1))
    kept = F.filter(zipped, lambda x: ~x["name"].isin("clk", "rst"))
    return F.transform(kept, lambda x: F.struct(F.when(x["direction"] == "input", "in").otherwise("out").alias("direction"), x["name"].alias("name"), width(x).alias("width")))


def rename_module(c: Column, name: str) -> Column:
    """The text with its first module called `name`."""
    return F.regexp_replace(c, r"(?s)^(.*?)\bmodule\s+\w+", f"$1module {name}")


def has_module(c: Column, name: Column | str) -> Column:
    return F.contains(c, F.concat(F.lit("module "), name if isinstance(name, Column) else F.lit(name)))


def scenarios(df: DataFrame, log: str = "log") -> DataFrame:
    """Scenario lines of logs, exploded: all columns but the log, line, scenario, status."""
    lines = df.select(*[c for c in df.columns if c != log], F.posexplode(F.split(log, "\n")).alias("line", "text"))
    found = lines.withColumns({"scenario": F.regexp_extract("text", SCENARIO, 1), "status": F.regexp_extract("text", SCENARIO, 2)})
    return found.where("scenario <> ''").drop("text")


def mismatch(c: Column) -> Column:
    """cycle, port, dut and gold of a line `MISMATCH cycle=N port=NAME dut=V gold=V`; null without one."""
    part = lambda name, kind: F.nullif(F.regexp_extract(c, rf"MISMATCH\b.*\b{name}=(\w+)", 1), F.lit("")).cast(kind)
    return F.struct(part("cycle", "long").alias("cycle"), part("port", "string").alias("port"), part("dut", "long").alias("dut"), part("gold", "long").alias("gold"))


def hygiene(c: Column, track: str) -> Column:
    """1.0 for a submission without forbidden or unsupported text and with all that is needed, else 0.0."""
    rules = HYGIENE[track]
    ok = F.lit(True)
    for word in (*rules["forbidden"], *rules["unsupported"]):
        ok = ok & ~F.contains(c, F.lit(word))
    for words in rules["all"]:
        some = F.lit(False)
        for w in words:
            some = some | F.contains(c, F.lit(w))
        ok = ok & some
    if rules["helper"]:
        ok = ok & (F.regexp_count(c, F.lit(rules["helper"])) > 1)
    return F.when(ok, 1.0).otherwise(0.0)


def lint_clean(log: Column) -> Column:
    return ~(F.contains(log, F.lit("%Warning")) | F.contains(log, F.lit("%Error")))


def letters(c: Column, letter: Column | str) -> Column:
    """How often the letter occurs, either case; an empty one occurs once more than there are characters."""
    x = F.lower(letter if isinstance(letter, Column) else F.lit(letter))
    low = F.lower(c)
    return F.when(F.length(x) == 0, F.length(c) + 1).otherwise((F.length(low) - F.length(F.replace(low, x, F.lit("")))) / F.nullif(F.length(x), F.lit(0))).cast("long")


def state_width(n: Column) -> Column:
    """Bits of an encoding of n states, one at least."""
    return F.when(n <= 2, 1).otherwise(F.length(F.bin(n.cast("long") - 1))).cast("int")


def last_message(messages: Column) -> Column:
    return F.try_element_at(messages, F.lit(-1))["content"]


def task_name(i: Column) -> Column:
    return F.format_string("task_%04d", i)


def prompt(spec: Column, guide: Column, examples: Sequence[Column] = ()) -> Column:
    """Guide, examples and spec, with a blank line between them; nulls are left out."""
    return F.concat_ws("\n\n", guide, *examples, spec)


def tail(log: Column, n: int = 6000) -> Column:
    return F.right(log, F.lit(n))


def answer_contains(answer: Column, correct: Column) -> Column:
    return F.contains(answer, correct)


def tokens_per_second(tokens: Column, latency: Column) -> Column:
    return F.when(latency != 0, tokens / latency).otherwise(0.0)


def module_name(file: Column) -> Column:
    return F.regexp_replace(file, r"\.sv$", "")


def _first(df: DataFrame, log: str, pattern: str, name: str, kind: str, first: int) -> DataFrame:
    found = F.slice(F.regexp_extract_all(F.col(log), F.lit(pattern), F.lit(1)), 1, first)
    return df.select(*[c for c in df.columns if c != log], F.posexplode(found).alias("n", name)).withColumn(name, F.col(name).cast(kind))


def log_rewards(df: DataFrame, log: str = "log", first: int = 40) -> DataFrame:
    """The first rewards of each log, in order: all columns but the log, n, reward."""
    return _first(df, log, REWARD, "reward", "double", first)


def log_steps(df: DataFrame, log: str = "log", first: int = 40) -> DataFrame:
    """The first step markers (`N/200`) of each log, in order: all columns but the log, n, step."""
    return _first(df, log, STEP, "step", "long", first)


def evaluation_lines(df: DataFrame, log: str = "log") -> DataFrame:
    """Lines of logs that tell an evaluation: all columns but the log, line, text, and the line's name=value
    numbers as a map (the last of a name counts)."""
    lines = df.select(*[c for c in df.columns if c != log], F.posexplode(F.split(log, "\n")).alias("line", "text"))
    pairs = lambda i: F.regexp_extract_all("text", F.lit(r"(\w+)[=:]\s*(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(i))
    numbers = F.aggregate(
        F.arrays_zip(pairs(1).alias("k"), pairs(2).alias("v")), F.create_map().cast("map<string,double>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"].cast("double")))
    )
    return lines.where(F.contains("text", F.lit(EVALUATION))).withColumn("numbers", numbers)


def names(c: Column, name: Column) -> Column:
    """Whether the text has the name as a whole word."""
    return F.rlike(c, F.concat(F.lit(r"\b"), F.regexp_replace(name, F.lit(r"([^\w])"), F.lit(r"\\$1")), F.lit(r"\b")))
