"""Exact, line and near-duplicate operators against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mooreflow.llm import common, exact_dedup, line_dedup, near_dedup
from mooreflow.llm.common import ascii_words

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "two  words"), (8, "é ü 漢字  x"), (9, None), (10, "a\x00b")]


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    long = b"y" * 300
    data = b"foo bar " + long + b" foo\tbaz\x0b" + long + b" " + long[:-1] + b"z"
    whole = common.hash_bytes(data)[0]
    assert whole[0] == whole[3] and whole[2] == whole[5] != whole[6] and len(set(whole.tolist())) == 5
    monkeypatch.setattr(common, "_BLOCK", 64)
    monkeypatch.setattr(common, "_powers", [])
    assert (common.hash_bytes(data)[0] == whole).all()
    h, count, line = common.text_hashes([None, "", "a b\nc\n\nd A", " x "])
    assert count.tolist() == [0, 0, 5, 1] and line.tolist() == [0, 0, 1, 3, 3, 0] and h[0] == h[4]


def test_a_written_table_frees_the_drivers_heap(lspark, monkeypatch):
    jvm = lspark.sparkContext._jvm
    runtime, work = jvm.java.lang.Runtime.getRuntime(), common.Workspace(lspark, "heap")
    collected = lambda: sum(x.getCollectionCount() for x in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in x.getName() or "MarkSweep" in x.getName())
    assert runtime.maxMemory() > 0
    monkeypatch.setattr(common, "HEAP_SHARE", 1.0)
    before = collected()
    work.stage(lspark.range(3), "a")
    assert collected() == before
    monkeypatch.setattr(common, "HEAP_SHARE", 0.0)
    assert work.stage(lspark.range(3), "b").count() == 3 and collected() > before


def test_components(lspark):
    rng = random.Random(2)
    for n, m in ((60, 40), (300, 299), (50, 400)):
        edges = [(i, i + 1) for i in range(m)] if m == 299 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        parent = list(range(n + 1))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        got = common.components(lspark.createDataFrame(edges, "a long, b long"), common.Workspace(lspark, "cc"), "t").collect()
        comp = {r["node"]: r["comp"] for r in got}
        assert len(got) == len(comp) and all(comp.get(x, x) == find(x) for e in edges for x in e)


# exact


def exact_brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


@pytest.mark.parametrize("block", [3, 4096])
def test_exact(table, block):
    rng = random.Random(block)
    texts = ["".join(rng.choice("ab ") for _ in range(n)) for n in (0, 1, 3, 4, 5, 17, 64, 200)]
    rows = ODD + [(i, rng.choice(texts) + rng.choice(["", "", "a"])) for i in range(20, 160)] + [(500, "x" * 50_000), (501, "x" * 50_000), (502, "x" * 50_001)]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.duplicates(table(rows), block_chars=block).collect()}
    assert got == exact_brute(rows)


def test_exact_repeated_and_null_ids(table):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b")]
    got = exact_dedup.duplicates(table(rows, parts=1)).collect()
    assert sum(r["kept"] for r in got) == 2 and {r["keep_id"] for r in got} == {1, None} and len(got) == 4
    assert exact_dedup.duplicates(table([])).count() == 0


# lines


def lines_brute(rows):
    seen, without, gaps, out = set(), set(), set(), {}
    for i, t in sorted(rows):
        gone = []
        lines = t.split("\n") if t is not None else []
        for k, x in enumerate(lines):
            w = tuple(ascii_words(x))
            if len(w) < line_dedup.MIN_WORDS:
                continue
            less = [(p, w[:p] + w[p + 1 :]) for p in range(len(w))]
            if w in seen or w in gaps or any(x in without or x[1] in seen for x in less):
                gone.append(k)
            seen.add(w)
            without.update(less)
            gaps.update(x[1] for x in less)
        out[i] = (len(lines), gone)
    return out


def edited(rng, words, vocabulary):
    w = list(words)
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        p, o = rng.randrange(len(w)), rng.random()
        if o < 0.4:
            w[p] = rng.choice([*vocabulary, f"n{rng.randrange(10**6)}"])
        elif o < 0.7:
            w.insert(rng.randint(0, len(w)), rng.choice(vocabulary))
        elif len(w) > 1:
            del w[p]
    return " ".join(w)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(table, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (5, 6, 7, 11, 12, 13, 23, 24, 25, 50, 97)] + [["x"] * 9, ["x"] * 40]
    rows = ODD + [(i, "\n".join(edited(rng, rng.choice(base), vocabulary) for _ in range(rng.randint(1, 4)))) for i in range(20, 320)]
    got = {r["doc_id"]: (r["n_lines"], list(r["dropped"])) for r in line_dedup.dropped_lines(table(rows)).collect()}
    assert got == lines_brute(rows)


def test_one_word_of_many_lines_differs(table):
    """A template with a different word in each line is one group, without pairs."""
    rows = [(i, f"the order number {i} was sent to the customer on monday morning") for i in range(400)]
    got = {r["doc_id"]: list(r["dropped"]) for r in line_dedup.dropped_lines(table(rows)).collect()}
    assert got == {i: [] if i == 0 else [0] for i in range(400)}


def test_near_lines_share_a_half():
    """One word substituted or inserted anywhere in a line of any length leaves a half key as it was."""

    def keys(lines):
        count = np.array([len(x) for x in lines])
        found = list(line_dedup.halves(common.hash_words([w for x in lines for w in x]), np.cumsum(count) - count, count))
        return [{int(k[i]) for k, has in found if has[i]} for i in range(len(lines))]

    for m in [*range(2, 70), 127, 128, 129, 1023, 1024]:
        line = [b"%d" % i for i in range(m)]
        places = range(m + 1) if m < 70 else (0, 1, m // 2 - 1, m // 2, m // 2 + 1, m - 1, m)
        near = [line[:p] + [b"x"] + line[p + d :] for p in places for d in (0, 1)]
        own, *others = keys([line, *near])
        assert 2 <= len(own) <= 4 and all(own & k for k in others)


@pytest.mark.parametrize("broadcast", [True, False])
def test_only_lines_that_share_a_half_are_cut(table, monkeypatch, broadcast):
    """Lines whose halves no other line has don't come to the first step; a half that many lines share takes no other way."""
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    start, near = words(9), words(20)
    alone, begun = [words(rng.randint(5, 40)) for _ in range(150)], [f"{start} {words(9)}" for _ in range(60)]
    rows = list(enumerate([*alone, *begun, near, f"x {near}", *alone[:20], f"{begun[7]} y", "x".join(begun[9].rsplit("w", 1))]))
    written, stage = {}, line_dedup.Workspace.stage

    def counted(self, df, name):
        out = stage(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup.Workspace, "stage", counted)
    if not broadcast:
        monkeypatch.setattr(line_dedup, "is_small", lambda *_: False)
        monkeypatch.setattr(line_dedup, "small", lambda df, *_: df)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
    got = {r["doc_id"]: (r["n_lines"], list(r["dropped"])) for r in line_dedup.dropped_lines(table(rows)).collect()}
    assert got == lines_brute(rows) and sum(len(gone) for _, gone in got.values()) == 23
    assert written["firsts"] == 150 + 60 + 2 + 2 and written["words"] == 60 + 2 + 2


def test_lines_leave_all_else(table):
    text = "this line is repeated in both texts\nshort\n\nand this one only stands here once"
    df = table([(1, text), (2, text.replace("here once", "there two times x y")), (3, "THIS line is  repeated in both texts"), (4, None), (5, "")])
    got = {r["doc_id"]: r for r in line_dedup.dedup(df).collect()}
    assert sorted(got) == [1, 2, 4, 5] and line_dedup.dedup(df).columns == df.columns
    assert got[1]["text"] == text and got[2]["text"] == "short\n\nand this one only stands there two times x y" and got[2]["whole"] == "x"
    assert line_dedup.dedup(table([])).count() == 0


def test_short_lines_that_are_equal(table, lspark, tmp_path):
    """Equal lines go however short they are, and lines without ASCII spaces; one edit away they stay."""
    from mooreflow.llm.queries import op4_line_dedup

    wide = "中文" * 40
    table([(1, f"Read more\n\n{wide}\nRead"), (2, f"read  MORE\n\n{wide}\nread less\nRead more now"), (3, "Read\n" + wide + "x")]).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["dropped"] for r in op4_line_dedup(lspark, str(tmp_path)).collect()} == {1: "", 2: "0,2", 3: "0"}


def test_edit_distance():
    rng = random.Random(5)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(500):
        a, b = ([rng.choice("ab") for _ in range(rng.randint(0, 4))] for _ in "ab")
        assert line_dedup.within_one(a, b) == (distance(a, b) <= 1)


# near


def near_brute(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = ascii_words(t)
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        both = Counter(j for g in s for j in where[g])
        for j, c in both.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            where[g].append(i)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_near(table, n, percent):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = list(ODD)
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 30, 120, 400]))]
        for j in range(rng.choice([1, 2, 3, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((100 + i * 50 + j, " ".join(w)))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(table(rows), shingle=n, percent=percent).collect()}
    assert got == near_brute(rows, n, percent)


def test_near_pairs_in_a_crowded_region(table):
    """Pairs just above the threshold among hundreds of sets just below it, all variants of one text."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        w = list(base)
        for p in rng.sample(range(300), 6):
            w[p] = f"n{i}x{p}"
        rows.append((2 * i, " ".join(w)))
        if i % 10 == 0:
            for p in rng.sample(range(300), 7):
                w[p] = f"m{i}x{p}"
            rows.append((2 * i + 1, " ".join(w)))
    want = near_brute(rows, 3, 85)
    assert sum(not kept for _, _, kept in want.values()) == 68
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(table(rows), shingle=3, percent=85).collect()}
    assert got == want


@pytest.mark.parametrize("edits, kinds", [(15_000, 2), (1_500, None)])
def test_all_links_among_variants_of_one_text(table, edits, kinds):
    """Texts that each differ from one base in two words: most links follow from those of others, some don't."""
    rng = random.Random(edits)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(1500):
        w = list(base)
        for p in rng.sample(range(100), 2):
            w[p] = f"e{rng.randrange(edits)}"
        rows.append((i, " ".join(w)))
    number: dict = {}
    at = [(i, number.setdefault(tuple(t.split()[j : j + 3]), len(number))) for i, t in rows for j in range(98)]
    m = np.zeros((len(rows), len(number)), np.float32)
    m[tuple(np.array(at).T)] = 1
    size, both = m.sum(1), m @ m.T
    near = 100 * both >= 85 * (size[:, None] + size[None] - both)
    comp = np.arange(len(rows))
    while True:
        new = np.where(near, comp[None], len(rows)).min(1)
        if (new == comp).all():
            break
        comp = new
    found = near_dedup.groups(table(rows), shingle=3, percent=85).collect()
    got = {r["doc_id"]: r["component_id"] for r in found}
    assert len(found) == len(rows) and got == dict(enumerate(comp.tolist()))
    assert kinds is None or len(set(got.values())) >= kinds


@pytest.mark.parametrize("hot", [256, 1])
def test_near_plans_stay_small(table, monkeypatch, hot):
    """The driver holds each plan: a table that is read over and over is written first, whatever passes were made.
    Of the passes over crowded regions, one looks at all rows: another would find the same pairs."""
    scans, whole = [], []
    candidates = near_dedup._candidates
    monkeypatch.setattr(near_dedup, "_candidates", lambda orders, work, percent, tag, again=False, runs=False: whole.append(again and not runs) or candidates(orders, work, percent, tag, again, runs))
    stage = common.Workspace.stage

    def counted(self, df, name):
        scans.append((df._jdf.queryExecution().optimizedPlan().collectLeaves().size(), name))
        return stage(self, df, name)

    monkeypatch.setattr(common.Workspace, "stage", counted)
    for module in (common, near_dedup):
        monkeypatch.setattr(module, "HOT_ROWS", hot)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(400):
        w = list(base)
        for p in rng.sample(range(100), 3):
            w[p] = f"e{rng.randrange(200)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(table(rows), shingle=3, percent=85).collect()}
    assert got == near_brute(rows, 3, 85)
    assert sum(whole) == 1
    assert "pairs-exact" in {name for _, name in scans} and max(scans)[0] <= 32


def test_seams_by_levels(table, monkeypatch):
    """Many partitions, whose ends are themselves looked through in several."""
    monkeypatch.setattr(near_dedup, "SEAM_ROWS", 60)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(60)]
        for j in range(3):
            rows.append((3 * i + j, " ".join([*w, f"x{j}"])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(table(rows, parts=9), shingle=3, percent=85).collect()}
    assert got == near_brute(rows, 3, 85)


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_components_in_one_task_and_in_many(lspark, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (7, 7)]
    got = common.components(lspark.createDataFrame(edges, "a long, b long"), common.Workspace(lspark, "cc"), "t").collect()
    assert sorted((r["node"], r["comp"]) for r in got) == [(i, 0) for i in range(1, 31)] + [(50, 40), (60, 40)]


def test_near_on_the_test_data(lspark, data):
    df = lspark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.groups(df, shingle=3, percent=85).collect()} == near_brute(rows, 3, 85)


def test_near_repeated_and_null_ids(table):
    got = near_dedup.groups(table([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], parts=1)).collect()
    assert sum(r["kept"] for r in got) == 2 and len(got) == 4 and {r["component_id"] for r in got if r["n_shingles"]} == {1}
    assert near_dedup.groups(table([])).count() == 0 and near_dedup.groups(table([(1, None), (2, "  ")])).count() == 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    for shared in (500, 900):
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, 1000 - shared).astype(np.uint64)])
        true = shared / (2000 - shared)
        seen = (near_dedup.signature(np.unique(a)) == near_dedup.signature(np.unique(b))).mean()
        assert abs(seen - true) < 5 * (true * (1 - true) / near_dedup.HASHES) ** 0.5
