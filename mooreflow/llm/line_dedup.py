"""Line deduplication with a deletion-neighbourhood join, for an edit bound of one word.

Two lines are near when one word substituted, inserted or deleted turns one into the other. Near lines
have their first halves in common, or their last ones, so lines whose halves no other line has are done.
The neighbourhood of the others is taken in two steps. First a line is cut into a few units at words chosen by
their hash, and every variant with one unit or two adjacent units deleted is emitted as a hashed key; an
edit changes one unit, or splits or merges two, so near lines share a key. Then, for lines that share
a key with another line, the words of the deleted units are deleted one by one. All lines that share
a key of the second step are within one edit of each other, so the earliest of them stands for all:
no pairs within a group are made. The edit distance of each pair is verified on its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooreflow.llm.common import Workspace, again, hash_bytes, is_small, join_counted, lean, lower, mix, sampled, signed, small, steps, text_hashes, with_row

#: Shorter lines have no near ones: one edit in fewer than five words is a similarity below 0.8.
MIN_WORDS = 5
#: Units of a line below which a finer cut is taken too. With this many, something is left of both
#: lines when one has two units deleted and the other one.
FEW_UNITS = 3
#: Lines that share a key of the first step and are so few are paired at once, without a second step.
FEW_LINES = 3
#: A key that so many lines of a sample share is dealt by line, too; of such keys the most frequent.
OFTEN, OFTEN_KEYS = 64, 10_000
#: Columns of the keys of a line's halves.
HALVES = ["first_half", "last_half", "first_half_below", "last_half_below"]
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_THREE = np.uint64(3)


def _level(m: np.ndarray) -> np.ndarray:
    """Level at which a line of m words has 3 to 6 units on average; a unit has 2**level words."""
    return np.floor(np.log2(np.maximum(m, 3) / 3)).astype(np.int64)


def _before(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of x over the earlier entries of the same group; first: index where each entry's group begins."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return total[:-1] - total[first]


def line_hash(w: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One hash for each line of word hashes laid end to end."""
    if not len(count):
        return np.empty(0, np.uint64)
    at = np.arange(len(w)) - np.repeat(start, count)
    return mix(np.add.reduceat(mix(w + at.astype(np.uint64) * _K1), start) + count.astype(np.uint64) * _K3)


def _half(m: np.ndarray) -> np.ndarray:
    """Words of a half of a line of m words: m // 2, or a little less, so that most lines one word longer have the same."""
    unit = 1 << np.maximum(np.frexp(m)[1] - 3, 0)
    return np.maximum((m - m % unit) // 2, 1)


def halves(w: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, whether the line has it) of each line's first and last half, then of those of a line one word
    shorter where they have other lengths. Two halves are no longer than the shorter of two near lines, and
    the edit is in one of them at most, so near lines share a key. w: as for variants."""
    at = np.arange(len(w)) - np.repeat(start, count)
    back = np.repeat(count, count) - 1 - at
    zero = np.zeros(1, np.uint64)
    left = np.concatenate([zero, np.cumsum(mix(w + at.astype(np.uint64) * _K1 + _K2), dtype=np.uint64)])
    right = np.concatenate([zero, np.cumsum(mix(w + back.astype(np.uint64) * _K2 + _K3), dtype=np.uint64)])
    end = start + count
    own, below = _half(count), _half(np.maximum(count - 1, 1))
    for n, has in ((own, np.ones(len(count), bool)), (below, below != own)):
        salt = n.astype(np.uint64) * _K3
        yield mix(left[start + n] - left[start] + salt), has
        yield mix(right[end] - right[end - n] + salt + _K1), has


def variants(w: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(line, key, first deleted word, end of the deleted words) of the first step's variants, level by
    level. w: word hashes of all lines, laid end to end; every line has words."""
    if not len(count):
        return
    line = np.repeat(np.arange(len(count)), count)
    tops = [_level(count + d) for d in (-1, 0, 1)]
    active = np.zeros(len(count), bool)
    marks = mix(w ^ _K2)
    for level in range(int(max(t.max() for t in tops)), -1, -1):
        for t in tops:
            active |= t == level
        if not active.any():
            continue
        words = np.flatnonzero(active[line])
        own = line[words]
        ends = (marks[words] & np.uint64((1 << level) - 1)) == 0
        last = np.concatenate([own[1:] != own[:-1], [True]])
        ends |= last
        unit_end = np.flatnonzero(ends)  # index in words
        unit_start = np.concatenate([[0], unit_end[:-1] + 1])
        size = unit_end - unit_start + 1
        at = np.arange(len(words)) - np.repeat(unit_start, size)
        unit = np.add.reduceat(mix(w[words] + at.astype(np.uint64) * _K1), unit_start)
        of = own[unit_start]
        new = np.concatenate([[True], of[1:] != of[:-1]])
        head = np.flatnonzero(new)
        per = np.diff(np.concatenate([head, [len(of)]]))
        first = np.repeat(head, per)
        n = np.repeat(per, per)
        rank = np.arange(len(of)) - first
        a = mix(unit + rank.astype(np.uint64) * _K1 + _K2)
        b = mix(unit + (n - 1 - rank).astype(np.uint64) * _K2 + _K3)
        pre = _before(a, first)
        total_b = np.repeat(np.add.reduceat(b, head), per)
        post = total_b - _before(b, first)  # this unit and all after it
        after = post - b
        salt = np.uint64((level + 1) * int(_K3) % (1 << 64))
        begin, end = words[unit_start], words[unit_end] + 1
        one = n >= 2
        yield of[one], mix(pre * _THREE + mix(after + salt))[one], begin[one], end[one]
        two = (rank < n - 1) & (n >= 3)
        i = np.flatnonzero(two)
        yield of[i], mix(pre[i] * _THREE + mix(after[i + 1] + salt)), begin[i], end[i + 1]
        few = np.zeros(len(count), bool)
        few[of[head]] = per < FEW_UNITS
        active = active & few


def second_keys(key: np.ndarray, w: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variant, key) of the second step: the deleted words w[begin:end] of each variant with one of
    them left out, and whole with a gap at each place."""
    q = end - begin
    first = np.cumsum(q) - q
    of = np.repeat(np.arange(len(q)), q)
    j = np.arange(int(q.sum())) - first[of]
    own = w[begin[of] + j]
    a = mix(own + j.astype(np.uint64) * _K1 + _K2)
    b = mix(own + (q[of] - 1 - j).astype(np.uint64) * _K2 + _K3)
    before = _before(a, first[of])
    total_a, total_b = np.add.reduceat(a, first), np.add.reduceat(b, first)
    rest = total_b[of] - _before(b, first[of])  # from a place on
    out = mix(key[of] + before * _THREE + mix(rest - b))
    gaps = mix(key[of] + before * _THREE + mix(rest))
    last = mix(key + total_a * _THREE + mix(np.zeros(len(q), np.uint64)))
    return np.concatenate([of, of, np.arange(len(q))]), np.concatenate([out, gaps, last])


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word substituted, inserted or deleted, or none, turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _flat(texts: list[str | None], min_words: int):
    """Lines with enough words: text index, line number, and their word hashes laid end to end."""
    h, per, number = text_hashes(texts)
    who = np.repeat(np.arange(len(texts)), per)
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (number[1:] != number[:-1])]) if len(h) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    count = np.diff(np.concatenate([start, [len(h)]]))
    take = count >= min_words
    words = np.repeat(take, count)
    count = count[take]
    return who[start[take]], number[start[take]], h[words], np.cumsum(count) - count, count


def _lines(equal_words: int, min_words: int):
    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each row its number of lines (line -1), and each line with enough words to be compared as a
        whole, with the keys of its halves where it has enough words for near lines."""
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            row, doc = batch["row"].to_numpy(), batch["doc_id"].astype("Int64")
            none = pd.array([None] * len(row), "Int64")
            yield pd.DataFrame({"row": row, "doc_id": doc, "line": -1, "h": [0 if t is None else t.count("\n") + 1 for t in texts], "check": batch["check"].astype("Int64")} | dict.fromkeys(HALVES, none))
            for i, j in steps(texts):
                who, number, w, start, count = _flat(texts[i:j], equal_words)
                if len(who):
                    keys = {c: pd.arrays.IntegerArray(signed(key), ~(has & (count >= min_words))) for c, (key, has) in zip(HALVES, halves(w, start, count), strict=True)}
                    yield pd.DataFrame({"row": row[who + i], "doc_id": doc.iloc[who + i].to_numpy(), "line": number, "h": signed(line_hash(w, start, count)), "check": pd.array([None] * len(who), "Int64")} | keys).astype({"doc_id": "Int64"})

    return lines


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the marked lines."""
    for batch in batches:
        for i, j in steps(batch["text"].tolist()):
            part = batch.iloc[i:j]
            lines, hashes = [], []
            for t, marks in zip(part["text"], part["marks"], strict=True):
                own = lower(t).split(b"\n")
                for m in marks:
                    lines.append(own[m["line"]].split() if m["line"] < len(own) else [])
                    hashes.append(m["h"])
            count = np.array([len(x) for x in lines], np.int64)
            w, h = hash_bytes(b" ".join(x for own in lines for x in own))[0], np.array(hashes, np.int64)
            if not count.all() or (signed(line_hash(w, np.cumsum(count) - count, count)) != h).any():
                raise ValueError("the input's rows changed between two reads; write them to a table first")
            yield pd.DataFrame({"h": h, "words": [b" ".join(x).decode("utf-8", "replace") for x in lines]})


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of the first step."""
    for batch in batches:
        h, texts = batch["h"].to_numpy(), batch["words"].tolist()
        for i, j in steps(texts):
            w, count, _ = text_hashes(texts[i:j])
            for of, key, _, _ in variants(w, np.cumsum(count) - count, count):
                yield pd.DataFrame({"key": signed(key), "h": h[i:j][of]})


def _shared(hot):
    return lambda batches: _others(batches, hot.value)


def _others(batches: Iterator[pd.DataFrame], hot: np.ndarray) -> Iterator[pd.DataFrame]:
    """Of rows sorted by key and h, those whose key has another h, here or as one of the hot keys, each once."""
    key = h = None  # the last row so far, and whether it was given out
    out = True
    for batch in batches:
        k, v = batch["key"].to_numpy(), batch["h"].to_numpy()
        if not len(k):
            continue
        if key is not None:
            k, v = np.concatenate([[key], k]), np.concatenate([[h], v])
        same = k[1:] == k[:-1]
        other = same & (v[1:] != v[:-1])
        mark = np.zeros(len(k), bool)
        # a row is out if the next or previous row has its key and another line, and it is not a repeat
        mark[1:] |= other
        mark[:-1] |= other
        if len(hot):
            mark |= hot[np.minimum(np.searchsorted(hot, k), len(hot) - 1)] == k
        repeat = np.concatenate([[False], same & (v[1:] == v[:-1])])
        # a repeat's first row may see its other line only after the repeats: carry the mark back
        group = np.cumsum(~repeat) - 1
        any_ = np.zeros(group[-1] + 1, bool)
        np.logical_or.at(any_, group, mark)
        give = np.flatnonzero(~repeat)
        keep = any_[group[give]]
        tail_out = bool(any_[-1])
        if key is not None and out:
            keep[0] = False
        out = tail_out or (out and key is not None and group[-1] == 0)
        key, h = k[-1], v[-1]
        if keep.any():
            yield pd.DataFrame({"key": k[give][keep], "h": v[give][keep]})


def _needed(keys: list[int], groups: list[int], at: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the variants in `at` (line, key, begin, end, whether two units are deleted), those to go on
    with: those with a key that other lines share, and of the longer deletions those whose group, known
    by a hash of its lines, is not that of one of the two shorter deletions as well."""
    group_of = dict(zip(keys, groups, strict=True))
    singles: dict[tuple[int, int], int] = {}
    for of, key, begin, end, two in at:
        group = [group_of.get(k) for k in signed(key).tolist()]
        take = np.array([i for i, g in enumerate(group) if g is not None], np.int64)
        spans = list(zip(begin[take].tolist(), end[take].tolist(), (group[i] for i in take.tolist()), strict=True))
        if not two:
            singles = {k: g for x, y, g in spans for k in ((x, -1), (-1, y))}
        else:
            take = take[[singles.get((x, -1)) != g and singles.get((-1, y)) != g for x, y, g in spans]] if spans else take
        if len(take):
            yield of[take], key[take], begin[take], end[take]


def _second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second-step keys of lines, given with their words and those keys of the first step that lead on."""
    for batch in batches:
        for i, j in steps(batch["words"].tolist()):
            part = batch.iloc[i:j]
            h, found = part["h"].to_numpy(), [k for own in part["keys"] for k in own]
            w, count, _ = text_hashes(part["words"].tolist())
            at = [(*x, bool(k % 2)) for k, x in enumerate(variants(w, np.cumsum(count) - count, count))]
            for of, key, begin, end in _needed([k["key"] for k in found], [k["lines"] for k in found], at):
                who, sub = second_keys(key, w, begin, end)
                yield pd.DataFrame({"sub": signed(sub), "h": h[of[who]]})


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ok = [within_one(a.split(" "), b.split(" ")) for a, b in zip(batch["wa"], batch["wb"], strict=True)]
        yield batch.loc[ok, ["a", "b"]]


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, equal_words: int | None = None) -> DataFrame:
    """One row per row of docs: row, check, doc_id, n_lines, dropped (sorted numbers of the lines that go).

    A line goes if an earlier line, by doc_id, then line number, is equal or one word edit away, case
    and white space aside. A line of fewer than min_words words goes only if an earlier one is equal,
    and stays if it has fewer than equal_words (min_words where that is null; 1: every line with a
    word is compared). A null doc_id counts as the largest; rows that share a doc_id come in their order. A null text has no lines, an empty text
    one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "lines")
    src = with_row(docs, id_col, text_col, check=True)
    entry = "row long, doc_id long, line int, h long, check long, " + ", ".join(f"{c} long" for c in HALVES)
    lines = work.stage(src.mapInPandas(lean(_lines(min_words if equal_words is None else min(min_words, equal_words), min_words)), entry), "lines")
    meta, lines = lines.where("line = -1").select("row", "check", "doc_id", F.col("h").alias("n_lines")), lines.where("line >= 0").drop("check")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")
    firsts = work.stage(lines.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")), "firsts")
    # Lines with a half that another line has too; only those may have near ones.
    halved = lines.where(f"{HALVES[0]} is not null").select("h", F.explode(F.array(*HALVES)).alias("key")).where("key is not null")
    both = halved.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most"), F.count("*").alias("n"))
    both = work.stage(both.where("least <> most").select("key", "n"), "halves")
    meet = halved.join(F.broadcast(both), "key") if is_small(both) else join_counted(halved, both, ["key"], "n")
    meet = work.stage(meet.select("h").distinct(), "candidates")
    order = work.stage(firsts.select("h", "first").join(small(meet), "h"), "places")
    by_row = order.groupBy(F.col("first.row").alias("row")).agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "h")).alias("marks"))
    by_row = work.stage(by_row, "by-row")
    texts = src.select("row", "text").join(small(by_row, 1_000_000, F.size("marks") + 1), "row")
    words = work.stage(texts.select("text", "marks").mapInPandas(lean(_words), "h long, words string"), "words")
    keys = words.mapInPandas(lean(_keys), "key long, h long")
    # Keys that a sample shows to be in many lines are dealt by line as well: that others share them is known.
    often = sampled(words).mapInPandas(lean(_keys), "key long, h long").groupBy("key").agg(F.count_distinct("h").alias("n")).where(F.col("n") >= OFTEN)
    found = sorted(r["key"] for r in often.orderBy(F.desc("n"), "key").limit(OFTEN_KEYS).collect())
    hot = spark.sparkContext.broadcast(np.array(found, np.int64))
    dealt = keys.repartition("key", F.when(F.col("key").isin(found), F.pmod("h", F.lit(1 << 16))).otherwise(0)) if found else keys.repartition("key")
    shared = work.stage(dealt.sortWithinPartitions("key", "h").mapInPandas(lean(_shared(hot)), "key long, h long"), "shared")
    whole = work.stage(shared.groupBy("key").agg(F.count("*").alias("n"), F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("h"))).alias("lines")), "whole")
    shared = work.stage(join_counted(shared, whole, ["key"], "n", ["lines"]), "groups")
    work.drop("shared")
    marked = work.stage(shared.where(F.col("n") > FEW_LINES).groupBy("h").agg(F.collect_list(F.struct("key", "lines")).alias("keys")), "marked")
    subs = words.join(small(marked, 1_000_000, F.size("keys") + 1), "h").select("h", "words", "keys")
    subs = work.stage(subs.mapInPandas(lean(_second), "sub long, h long"), "second")
    places = small(order)
    best = work.stage(subs.join(places, "h").groupBy("sub").agg(F.min(F.struct("first", "h")).alias("best"), F.count("*").alias("n")).select("sub", "n", F.col("best.h").alias("b")).where("n > 1"), "best")
    pairs = join_counted(subs, best, ["sub"], "n", ["b"]).select(F.col("h").alias("a"), "b")
    few = shared.where(F.col("n") <= FEW_LINES).groupBy("key").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    two = F.transform("hs", lambda x, i: F.transform(F.filter("hs", lambda y: y > x), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    few = few.select(F.explode(F.flatten(two)).alias("p")).select("p.*").distinct()
    for x in "xy":
        few = few.join(places.select(F.col("h").alias(x), F.col("first").alias(f"at_{x}")), x)
    few = few.select(F.when(F.col("at_x") > F.col("at_y"), F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("at_x") > F.col("at_y"), F.col("y")).otherwise(F.col("x")).alias("b"))
    pairs = work.stage(pairs.unionAll(few).where("a <> b").distinct(), "pairs")
    per = pairs.groupBy("b").agg(F.count("*").alias("n"))
    pairs = join_counted(pairs, words.select(F.col("h").alias("b"), F.col("words").alias("wb")).join(per, "b"), ["b"], "n", ["wb"], text=True).drop("n")
    pairs = pairs.join(words.select(F.col("h").alias("a"), F.col("words").alias("wa")), "a")
    near = pairs.mapInPandas(lean(_verified), "a long, b long").select(F.col("a").alias("h")).distinct().withColumn("near", F.lit(True))
    near = work.stage(near, "near")
    gone = firsts.join(small(near), "h", "left").where("near or n > 1").select("h", "n", F.coalesce("near", F.lit(False)).alias("near"), "first")
    gone = work.stage(gone, "gone")
    work.keep("lines", "gone")
    lost = join_counted(lines.select("row", "line", "h"), gone, ["h"], "n", ["near", "first"]).where(F.col("near") | (F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line")))
    lost = lost.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("dropped"))
    return meta.join(lost, "row", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, equal_words: int | None = None) -> DataFrame:
    """docs without the lines that go; a row that loses lines and has no word left goes too. All other
    columns stay as they are. The rows must come in the same order each time docs is read."""
    lost = dropped_lines(docs, id_col, text_col, min_words, equal_words).where(F.size("dropped") > 0).select("row", "check", "dropped")
    lost = Workspace(docs.sparkSession, "line-drops").stage(lost, "dropped")
    rows = again(docs, small(lost, 1_000_000, F.size("dropped") + 3), text_col)
    left = F.filter(F.split(F.col("whole").getField(text_col), "\n"), lambda x, i: ~F.array_contains("dropped", i))
    text = F.when(F.col("dropped").isNull(), F.col("whole").getField(text_col)).otherwise(F.array_join(left, "\n"))
    kept = rows.withColumn("text", text).where(F.col("dropped").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in docs.columns])
