"""Packing of tokenised documents into sequences by minimum bin slack.

The plan works on the histogram of piece lengths, which has at most `capacity` entries however many
pieces there are. For each bin the longest length left is the seed, and a bitset subset-sum over the
other available lengths finds the fullest bin that holds it; the combination is taken as often as
the counts allow. As a fullest bin may spend short pieces that later bins would need, the search is run
for several slacks: within a slack, a bin of longer pieces is preferred to a fuller one. The plan with
the fewest bins counts. Pieces are then given their places by their rank among those of one length.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mooreflow.llm.common import Workspace, lean, small, with_row

CAPACITY = 1024
END_ID = 2
#: Slacks that are tried, in tokens.
SLACKS = (0, 1, 2, 4, 8, 12, 16, 24, 32, 48, 64)
#: Most pieces of one length that are ranked in one task, about, and shares of all pieces beyond which they are dealt to several.
RANKED, SHARES = 500_000, 512
_cache: dict[tuple[str, str], object] = {}


def default_tokenizer() -> tuple[str, str]:
    """Paths of one vocabulary, for the tokenizers library and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(paths: tuple[str, str]):
    """A function from a text to its ids. Both files hold one vocabulary and give the same ids; the
    ranks are several times faster. A text that spells a special token goes to the other library,
    which reads it as that token, and so does one on which the first gives up: its stack is too small
    for very long runs of white space."""
    if paths not in _cache:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        special = [t["content"] for t in json.load(open(paths[0], encoding="utf-8"))["added_tokens"]]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(paths[1], "rb"))}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        whole: list[Tokenizer] = []

        def encode(t: str) -> list[int]:
            if not any(x in t for x in special):
                try:
                    return fast.encode_ordinary(t)
                except BaseException as e:  # a panic of the library is no Exception
                    if type(e).__name__ != "PanicException":
                        raise
            if not whole:  # seldom needed, and large
                whole.append(Tokenizer.from_file(paths[0]))
            return whole[0].encode(t, add_special_tokens=False).ids

        _cache[paths] = encode
    return _cache[paths]


def _pieces(paths: tuple[str, str], capacity: int):
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(paths)
        for batch in batches:
            out = []
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*(encode(text) if isinstance(text, str) and text else ()), END_ID], "<u4")
                start, size = 0, len(ids) % capacity or capacity
                for p in range(-(-len(ids) // capacity)):
                    out.append((row, doc_id, p, start, size, zlib.crc32(ids[start : start + size].tobytes())))
                    start, size = start + size, capacity
            frame = pd.DataFrame(out, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return pieces


def fullest(counts: dict[int, int], seed: int, capacity: int, slack: int = 0) -> list[int]:
    """The lengths, seed first, of a fullest bin that holds seed, or if the longest lengths alone can leave
    no more than slack, of the fullest one of these. counts: length to how many are left, the seed
    included. Larger lengths are preferred."""
    room = capacity - seed
    if not room:
        return [seed]
    reach, states, mask = 1, [], (1 << (room + 1)) - 1
    for size in sorted((s for s in counts if s <= room), reverse=True):
        left, step = min(counts[size] - (size == seed), room // size), 1
        while left > 0:
            take = min(step, left)
            states.append((reach, size, take))
            reach |= (reach << (size * take)) & mask
            left, step = left - take, step * 2
        if reach >> max(0, room - slack):
            break
    total, chosen = reach.bit_length() - 1, [seed]
    for before, size, take in reversed(states):
        if not (before >> total) & 1:
            chosen += [size] * take
            total -= size * take
    return chosen


def _plan(histogram: dict[int, int], capacity: int, slack: int) -> list[tuple[list[int], int]]:
    left, out = {k: v for k, v in histogram.items() if v}, []
    while left:
        chosen = fullest(left, max(left), capacity, slack)
        need = {s: chosen.count(s) for s in chosen}
        times = min(left[s] // n for s, n in need.items())
        out.append((chosen, times))
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many bins are filled so), the fewest that one of SLACKS gives. Each step uses
    up some length or halves what it can, so the plan has few entries next to the histogram, whatever
    the counts."""
    fewest, best = None, []
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    for slack in SLACKS:
        found = _plan(histogram, capacity, slack)
        n = sum(times for _, times in found)
        if fewest is None or n < fewest:
            fewest, best = n, found
        if fewest == least:
            break
    return best


def _places(bins: list[tuple[list[int], int]]) -> dict[int, tuple[list[int], list[tuple[int, int, int, int]]]]:
    """By length: first ranks, and (first rank, first sequence, per bin, index in plan) of each entry."""
    out: dict[int, tuple[list[int], list]] = {}
    first = 0
    used: dict[int, int] = {}
    for chosen, times in bins:
        offset, offsets = 0, {}
        for s in chosen:
            offsets.setdefault(s, []).append(offset)
            offset += s
        for s, at in offsets.items():
            ranks, entries = out.setdefault(s, ([], []))
            ranks.append(used.get(s, 0))
            entries.append((used.get(s, 0), first, at))
            used[s] = used.get(s, 0) + times * len(at)
        first += times
    return out


def _placed(places):
    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seq, off = np.empty(len(batch), np.int64), np.empty(len(batch), np.int64)
            for i, (length, rank) in enumerate(zip(batch["length"], batch.pop("rank"), strict=True)):
                ranks, entries = places.value[length]
                start, first, at = entries[bisect_right(ranks, rank) - 1]
                each, slot = divmod(rank - start, len(at))
                seq[i], off[i] = first + each, at[slot]
            yield batch.assign(sequence_id=seq, offset=off)

    return placed


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its ids and END_ID; only documents longer than `capacity` are cut, the first
    piece taking the remainder. A null or empty text is END_ID alone. Rows that repeat are packed as
    often as they occur. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    src = with_row(docs, id_col, text_col)
    cut = src.mapInPandas(lean(_pieces(tokenizer or default_tokenizer(), capacity)), "row long, doc_id long, piece int, start long, length long, ids_crc32 long")
    cut = work.stage(cut, "pieces")
    # A piece as long as a sequence is one by itself; the others are planned by their lengths.
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < capacity)
    histogram = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))
    # Lengths are ranked in shares, of RANKED pieces where these are many: a row for each share.
    most = min(RANKED, max(100, sum(histogram.values()) // SHARES))
    shares = F.broadcast(spark.createDataFrame([(k, -(-n // most)) for k, n in histogram.items()], "length long, shares long"))
    salted = rest.join(shares, "length").withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.col("shares"))).drop("shares")
    counts = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")) - 1
    ranked = salted.withColumn("own", rank).join(small(starts), ["length", "salt"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked.select(*columns, (F.col("own") + F.col("before")).alias("rank")).mapInPandas(lean(_placed(places)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.unionAll(full.select(*columns, "sequence_id", "offset"))
