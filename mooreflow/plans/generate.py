"""Random machines, with a seed, and their English description."""

from __future__ import annotations

import random
from dataclasses import replace

from mooreflow.plans.language import Assignment, Guard, Machine, Port, State, Transition, check


def random_machine(rng: random.Random, states: tuple[int, int] = (2, 5), max_inputs: int = 3, max_outputs: int = 2, max_guards: int = 2, rich: bool = False) -> Machine:
    """A valid machine of one-bit inputs; rich ones have vectors, comparisons and compound guards."""
    names = [f"S{i}" for i in range(rng.randint(*states))]
    ins = [_vector(rng, j) if rich else Port(f"i{j}", "in", 0, 0) for j in range(rng.randint(1, max_inputs))]
    outs = [Port(f"o{k}", "out", rng.choice([0, 0, 1]), 0) for k in range(rng.randint(1, max_outputs))]
    made = []
    for name in names:
        values = tuple(Assignment(p.name, rng.randrange(1 << p.width)) for p in outs)
        guards = [Transition(_guard(rng, ins) if rich else Guard("signal", name=rng.choice(ins).name), rng.choice(names)) for _ in range(rng.randint(0, max_guards))]
        made.append(State(name, values, (*guards, Transition(None, rng.choice(names)))))
    return check(Machine(f"m{rng.randrange(10**6)}", (*ins, *outs), "S0", tuple(made)))


def _vector(rng: random.Random, j: int) -> Port:
    low = rng.choice([0, 0, 2])
    return Port(f"i{j}", "in", low + rng.randrange(4), low)


def _guard(rng: random.Random, ins: list[Port], depth: int = 2) -> Guard:
    pick = rng.random()
    if depth and pick < 0.4:
        kind = rng.choice(["and", "or", "not"])
        return Guard(kind, tuple(_guard(rng, ins, depth - 1) for _ in range(1 if kind == "not" else 2)))
    p = rng.choice(ins)
    if pick < 0.6:
        return Guard("signal", name=p.name)
    if pick < 0.75:
        return Guard("bit", name=p.name, value=rng.randint(p.low, p.high))
    sides = (Guard("signal", name=p.name), Guard("number", value=rng.randrange(1 << p.width)))
    return Guard(rng.choice(["==", "!=", "<", "<=", ">", ">="]), sides if rng.random() < 0.7 else sides[::-1])


def random_machines(n: int, seed: int = 0, **settings) -> list[Machine]:
    """n different machines; a draw that repeats an earlier one is drawn again, 5 n times at most."""
    rng, found = random.Random(seed), {}
    for _ in range(5 * n):
        if len(found) == n:
            break
        m = random_machine(rng, **settings)
        found.setdefault(m.states, m)
    return list(found.values())


def describe(m: Machine) -> str:
    """What the machine does, in English."""
    from mooreflow.plans.language import guard_text

    size = lambda p: "1-bit" if p.width == 1 else f"{p.width}-bit"
    lines = [f"Design a Moore machine named {m.name}.", "Inputs: " + ", ".join(f"{p.name} ({size(p)})" for p in m.inputs) + ".", "Outputs: " + ", ".join(f"{p.name} ({size(p)})" for p in m.outputs) + ".", f"It starts, and restarts on reset, in {m.reset}."]
    for s in m.states:
        lines.append(f"In {s.name}: " + ", ".join(f"{a.output} is {a.value}" for a in s.assignments) + ".")
        lines += [f"  If {guard_text(t.guard)}, go to {t.target}." if t.guard else f"  Otherwise go to {t.target}." for t in s.transitions]
    return "\n".join(lines)


#: What `perturbed` can do to a machine, and the rule that it then breaks.
FAULTS = {"drop_assignment": "total_outputs", "drop_else": "total_transitions", "wrong_target": "name_resolution", "wrong_reset": "name_resolution", "second_driver": "single_driver", "foreign_assignment": "single_driver"}


def perturbed(m: Machine, fault: str, rng: random.Random) -> tuple[Machine, ...]:
    """The machine with one fault of a kind in FAULTS; two machines where a fault takes two."""
    k = rng.randrange(len(m.states))
    s = m.states[k]
    put = lambda **x: replace(m, states=(*m.states[:k], replace(s, **x), *m.states[k + 1 :]))
    if fault == "drop_assignment":
        name = rng.choice(s.assignments).output
        return (put(assignments=tuple(a for a in s.assignments if a.output != name)),)
    if fault == "drop_else":
        return (put(transitions=s.transitions[:-1]),)
    if fault == "wrong_target":
        i = rng.randrange(len(s.transitions))
        return (put(transitions=(*s.transitions[:i], replace(s.transitions[i], target="NOWHERE"), *s.transitions[i + 1 :])),)
    if fault == "wrong_reset":
        return (replace(m, reset="NOWHERE"),)
    if fault == "second_driver":
        return m, replace(m, name=f"{m.name}_again")
    if fault == "foreign_assignment":
        other = Machine("other", (Port("only_here", "out", 0, 0),), "S", (State("S", (Assignment("only_here", 0),), (Transition(None, "S"),)),))
        return put(assignments=(*s.assignments, Assignment("only_here", 1))), other
    raise ValueError(f"unknown fault {fault!r}")
