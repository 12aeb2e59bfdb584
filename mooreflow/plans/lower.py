"""From a checked machine to Catalyst expressions: a step, its outputs, and what it reads."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mooreflow.plans.language import Guard, Machine, Port, subguards

Signals = Callable[[str], Column]
_OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def _constant(compare: Callable[[int], bool], value: int, equality: bool, width: int) -> bool | None:
    """What a comparison of a signal of the width with value is, if it is the same whatever the signal. An order
    holds for all signals or none just when it does for the least and the greatest; an equality is
    open only for a value that the signal can take."""
    least, greatest = 0, (1 << width) - 1
    if equality and value in range(least, greatest + 1):
        return None
    return compare(least) if compare(least) == compare(greatest) else None


def _value(g: Guard, ports: dict[str, Port], read: Signals) -> Column:
    """The guard as a number, for comparisons."""
    if g.kind == "signal":
        return read(g.name)
    if g.kind == "bit":
        return F.shiftright(read(g.name), g.value - ports[g.name].low).bitwiseAND(1)
    if g.kind == "number":
        return F.lit(g.value)
    return guard(g, ports, read).cast("int")


def _width(g: Guard, ports: dict[str, Port]) -> int | None:
    if g.kind == "number":
        return None
    return ports[g.name].width if g.kind == "signal" else 1


def decided(g: Guard, ports: dict[str, Port]) -> bool | None:
    """What a comparison with a number is, if it is the same whatever the other side."""
    compare, (left, right) = _OPS[g.kind], g.parts
    for number, other, told in ((right, left, lambda x: compare(x, right.value)), (left, right, lambda x: compare(left.value, x))):
        width = _width(other, ports)
        if number.kind == "number" and width is not None:
            return _constant(told, number.value, g.kind in ("==", "!="), width)
    return None


def guard(g: Guard, ports: dict[str, Port], read: Signals) -> Column:
    """The guard as a condition; a signal of any width holds when it isn't zero."""
    if g.kind == "number":
        return F.lit(g.value != 0)
    if g.kind in ("signal", "bit"):
        return _value(g, ports, read) != 0
    if g.kind == "not":
        return ~guard(g.parts[0], ports, read)
    if g.kind in ("and", "or"):
        a, b = (guard(p, ports, read) for p in g.parts)
        return a & b if g.kind == "and" else a | b
    if (known := decided(g, ports)) is not None:
        return F.lit(known)
    left, right = (_value(p, ports, read) for p in g.parts)
    return _OPS[g.kind](left, right)


def reads(m: Machine) -> list[str]:
    """Inputs that some guard reads, in declared order: what a stimulus needs."""
    used = {g.name for s in m.states for t in s.transitions if t.guard for g in subguards(t.guard)}
    return [p.name for p in m.inputs if p.name in used]


def unused_inputs(m: Machine) -> list[str]:
    """Inputs of which no guard reads a bit."""
    return [p.name for p in m.inputs if p.name not in set(reads(m))]


def step(m: Machine, state: Column, read: Signals, reset: Column | None = None) -> Column:
    """The next state's ordinal. The first guard that holds decides, in declared order, then the first
    `else`; an unknown state stays. reset, where given and true, beats every transition."""
    ports = {p.name: p for p in m.inputs}
    out = None if reset is None else F.when(reset, F.lit(m.ordinal(m.reset)))
    for i, s in enumerate(m.states):
        default = next(t.target for t in s.transitions if t.guard is None)
        chain = None
        for t in s.transitions:
            if t.guard is not None:
                pair = (guard(t.guard, ports, read), F.lit(m.ordinal(t.target)))
                chain = F.when(*pair) if chain is None else chain.when(*pair)
        target = F.lit(m.ordinal(default))
        arm = (state == i, target if chain is None else chain.otherwise(target))
        out = F.when(*arm) if out is None else out.when(*arm)
    return out.otherwise(state)


def output_values(m: Machine, name: str) -> list[int]:
    """The output's value in each state, cut to its width; the last assignment of a state counts."""
    port = next(p for p in m.outputs if p.name == name)
    return [next((a.value for a in reversed(s.assignments) if a.output == name), 0) & ((1 << port.width) - 1) for s in m.states]


def outputs(m: Machine, state: Column) -> dict[str, Column]:
    """Each output as a column of the state; an unknown state gives 0."""
    pick = lambda values: F.coalesce(F.get(F.array(*map(F.lit, values)), state), F.lit(0)).cast("long")
    return {p.name: pick(output_values(m, p.name)) for p in m.outputs}


def state_name(m: Machine, state: Column) -> Column:
    return F.get(F.array(*[F.lit(s.name) for s in m.states]), state)
