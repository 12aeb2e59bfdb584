"""Catalogs of machines as tables, and the safety rules over them as joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mooreflow.plans.language import MESSAGES, Machine, guard_text, subguards
from mooreflow.session import staged

_AT = "line int, col int"
SCHEMAS = {
    "machines": f"machine_id long, name string, reset_state string, source_file string, {_AT}",
    "ports": f"machine_id long, ord int, direction string, name string, high int, low int, {_AT}",
    "states": f"machine_id long, ord int, state string, {_AT}",
    "assignments": f"machine_id long, state string, ord int, output string, value decimal(38,0), {_AT}",
    "transitions": f"machine_id long, state string, ord int, kind string, guard string, target string, {_AT}",
    "guard_reads": "machine_id long, name string",
}


@dataclass(frozen=True)
class Catalog:
    machines: DataFrame
    ports: DataFrame
    states: DataFrame
    assignments: DataFrame
    transitions: DataFrame
    guard_reads: DataFrame


def rows_of(machines: Sequence[Machine], first_id: int = 0) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {k: [] for k in SCHEMAS}
    for i, m in enumerate(machines, first_id):
        out["machines"].append((i, m.name, m.reset, m.file, m.at.line, m.at.column))
        out["ports"] += [(i, k, p.direction, p.name, p.high, p.low, p.at.line, p.at.column) for k, p in enumerate(m.ports)]
        out["guard_reads"] += [(i, n) for n in sorted({g.name for s in m.states for t in s.transitions if t.guard for g in subguards(t.guard) if g.name})]
        for k, s in enumerate(m.states):
            out["states"].append((i, k, s.name, s.at.line, s.at.column))
            out["assignments"] += [(i, s.name, j, a.output, a.value, a.at.line, a.at.column) for j, a in enumerate(s.assignments)]
            out["transitions"] += [(i, s.name, j, "when" if t.guard else "else", guard_text(t.guard) if t.guard else None, t.target, t.at.line, t.at.column) for j, t in enumerate(s.transitions)]
    return out


def catalog(spark: SparkSession, machines: Sequence[Machine], separate: bool = False) -> Catalog:
    """The machines as tables; one unit in which an output has one driver, or with separate each its own."""
    from decimal import Decimal

    rows = rows_of(machines)
    rows["assignments"] = [(*r[:4], Decimal(r[4]), *r[5:]) for r in rows["assignments"]]
    tables = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}
    tables["machines"] = tables["machines"].withColumn("unit", F.col("machine_id") if separate else F.lit(0).cast("long"))
    return Catalog(**tables)


def catalog_of(programs: DataFrame) -> Catalog:
    """A catalog from a table of programs (machine_id, unit, path, text), read on the executors: each is one
    machine, and the machines of a unit must drive outputs once. Programs that cannot be parsed are left
    out; `compiled` tells why. The parts go to the shared folder once, whatever their number."""
    from collections.abc import Iterator
    from decimal import Decimal

    import pandas as pd

    from mooreflow.plans.language import MachineError, parse

    kinds = [(k, [f.split()[0] for f in v.split(", ")]) for k, v in SCHEMAS.items()]
    fields = {f.split()[0]: f.split()[1] for v in SCHEMAS.values() for f in v.split(", ")} | {"unit": "long"}

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {"part": [], **{f: [] for f in fields}}
            for i, unit, path, text in zip(batch["machine_id"], batch["unit"], batch["path"], batch["text"], strict=True):
                try:
                    rows = rows_of([parse(text or "", path or "<input>")], int(i))
                except MachineError:
                    continue
                for k, columns in kinds:
                    for row in rows[k]:
                        own = dict(zip(columns, row, strict=True)) | {"unit": int(unit)}
                        if k == "assignments":
                            own["value"] = Decimal(own["value"])
                        out["part"].append(k)
                        for f in fields:
                            out[f].append(own.get(f))
            frame = pd.DataFrame(out)
            yield frame.astype({f: "Int64" for f, t in fields.items() if t in ("int", "long")})

    schema = ", ".join(f"`{f}` {t}" for f, t in {"part": "string", **fields}.items())
    whole = staged(programs.select("machine_id", "unit", "path", "text").mapInPandas(parts, schema), "catalog")
    return Catalog(**{k: whole.where(F.col("part") == k).select(*columns, *(["unit"] if k == "machines" else [])) for k, columns in kinds})


def _message(key: str, *parts: Column) -> Column:
    text = MESSAGES[key]
    for i in range(len(parts)):
        text = text.replace(f"{{{i}}}", "%s")
    return F.format_string(text, *parts)


def _out(df: DataFrame, rule: str, part: int, message, order: Sequence) -> DataFrame:
    """Diagnostics of one rule with what sorts them: machine, part, then up to three numbers."""
    places = [*order, *[F.lit(0)] * (3 - len(order))]
    return df.select("machine_id", F.lit(rule).alias("rule"), F.lit(part).alias("part"), *[p.cast("int").alias(f"o{i}") for i, p in enumerate(places)], "line", "col", message.alias("message"))


def total_outputs(c: Catalog) -> DataFrame:
    """States that leave an output unassigned."""
    outs = c.ports.where("direction = 'out'").select("machine_id", F.col("ord").alias("port_ord"), F.col("name").alias("output"))
    grid = c.states.join(outs, "machine_id").join(c.assignments.select("machine_id", "state", "output"), ["machine_id", "state", "output"], "left_anti")
    return _out(grid, "total_outputs", 0, _message("total_outputs", F.col("state"), F.col("output")), [F.col("ord"), F.col("port_ord")])


def total_transitions(c: Catalog) -> DataFrame:
    """States whose last transition isn't an else, or that have none."""
    last = c.transitions.groupBy("machine_id", "state").agg(F.max_by("kind", "ord").alias("last"))
    bad = c.states.join(last, ["machine_id", "state"], "left").where("last is distinct from 'else'")
    return _out(bad, "total_transitions", 1, _message("total_transitions", F.col("state")), [F.col("ord")])


def name_resolution(c: Catalog) -> DataFrame:
    """Targets of transitions and resets that are no states."""
    names = c.states.select("machine_id", F.col("state").alias("target"))
    bad = c.transitions.join(names, ["machine_id", "target"], "left_anti").join(c.states.select("machine_id", "state", F.col("ord").alias("state_ord")), ["machine_id", "state"])
    resets = c.machines.withColumn("target", F.col("reset_state")).join(names, ["machine_id", "target"], "left_anti")
    return _out(bad, "name_resolution", 2, _message("target", F.col("state"), F.col("target")), [F.col("state_ord"), F.col("ord")]).unionByName(
        _out(resets, "name_resolution", 3, _message("reset_target", F.col("reset_state")), [])
    )


def single_driver(c: Catalog, unit: str = "unit") -> DataFrame:
    """Outputs that several machines of one unit declare, or that a machine assigns but another declares."""
    machines = c.machines
    own = c.ports.where("direction = 'out'").groupBy("machine_id", "name").agg(F.min_by(F.struct("ord", "line", "col"), "ord").alias("p"))
    own = own.select("machine_id", "name", "p.*").join(machines.select("machine_id", unit, F.col("name").alias("machine"), "source_file"), "machine_id")
    w = Window.partitionBy(unit, "name").orderBy("machine_id")
    place = F.format_string("%s (%s:%d)", "machine", "source_file", "line")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = own.withColumn("n", F.row_number().over(w)).withColumn("where", F.array_join(F.collect_list(place).over(whole), ", "))
    twice = _out(numbered.where("n > 1"), "single_driver", 4, _message("declared_twice", F.col("name"), F.col("where")), [F.col("ord")])
    owners = numbered.where("n = 1").select(unit, F.col("name").alias("output"), F.col("machine").alias("owner"))
    used = c.assignments.join(own.select("machine_id", F.col("name").alias("output")), ["machine_id", "output"], "left_anti")
    used = used.join(machines.select("machine_id", unit, F.col("name").alias("machine")), "machine_id").join(owners, [unit, "output"])
    used = used.join(c.states.select("machine_id", "state", F.col("ord").alias("state_ord")), ["machine_id", "state"])
    foreign = _out(used, "single_driver", 5, _message("foreign", F.col("output"), F.col("state"), F.col("machine"), F.col("owner")), [F.col("state_ord"), F.col("ord")])
    return twice.unionByName(foreign)


def diagnostics(c: Catalog) -> DataFrame:
    """All violations: machine_id, rule, file, line, col, message, rendered, and position, their order
    within the machine. No rule hides another."""
    found = total_outputs(c).unionByName(total_transitions(c)).unionByName(name_resolution(c)).unionByName(single_driver(c))
    found = found.join(c.machines.select("machine_id", F.col("source_file").alias("file")), "machine_id")
    w = Window.partitionBy("machine_id").orderBy("part", "o0", "o1", "o2", "line", "col", "message")
    return found.select("machine_id", F.row_number().over(w).alias("position"), "rule", "file", "line", "col", "message", F.format_string("%s:%d:%d: %s", "file", "line", "col", "message").alias("rendered"))


def valid_machines(c: Catalog) -> DataFrame:
    """Machines without a violation."""
    return c.machines.join(diagnostics(c).select("machine_id").distinct(), "machine_id", "left_anti")


def unused_inputs(c: Catalog) -> DataFrame:
    ins = c.ports.where("direction = 'in'").select("machine_id", "name", "ord")
    return ins.join(c.guard_reads, ["machine_id", "name"], "left_anti")


def state_widths(c: Catalog) -> DataFrame:
    n = c.states.groupBy("machine_id").agg(F.count("*").alias("states"))
    return n.withColumn("width", F.when(F.col("states") <= 2, F.lit(1)).otherwise(F.length(F.bin(F.col("states") - 1))).cast("int"))


def duplicate_states(c: Catalog) -> DataFrame:
    return c.states.groupBy("machine_id", "state").agg(F.count("*").alias("n")).where("n > 1")


def compiled(sources: DataFrame, strict: bool = False) -> DataFrame:
    """Programs as a table (path, text) to their diagnostics: path, ok, and for each error rule (null for
    one that isn't a safety rule), line, col, message and rendered. A sound program has one row."""
    from collections.abc import Iterator

    import pandas as pd

    from mooreflow.plans.language import MachineError, compile_text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    compile_text(text or "", path or "<input>", strict)
                    out.append((path, True, None, None, None, None, None))
                except MachineError as e:
                    out += [(path, False, x.rule, x.line, x.column, x.message, str(x)) for x in (e, *getattr(e, "more", ()))]
            frame = pd.DataFrame(out, columns=["path", "ok", "rule", "line", "col", "message", "rendered"])
            yield frame.astype({"line": "Int64", "col": "Int64"})

    return sources.select("path", "text").mapInPandas(run, "path string, ok boolean, rule string, line long, col long, message string, rendered string")
