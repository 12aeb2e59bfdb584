"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed number of characters. Equal blocks get equal integer names by
sorting them; adjacent names are paired and the pairs named in the same way, level by level, until
each document has one name. No step trusts a hash for equality: hashes only route rows to tasks, in
which the blocks or pairs themselves are sorted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mooreflow.llm.common import Workspace, join_counted, sampled, with_row

BLOCK_CHARS = 4096
#: Sorted ranges in which names are given; a name is range * 2**40 + rank.
RANGES = 65_536
#: Blocks that are named in advance, at most; what isn't among them is named by sorting.
FREQUENT = 1_000
#: Runs that are not one plain space already.
_SPACES = re.compile(r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")


def normal(text: str | None) -> str:
    """Each run of ASCII white space becomes one space; null is empty."""
    return _SPACES.sub(" ", text) if text else ""


def _cut(block_chars: int, frequent=None):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {} if frequent is None else frequent.value
        for batch in batches:
            seen: dict[str, tuple[int, int]] = {}
            out = []
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                t = normal(text if isinstance(text, str) else None)
                n = max(1, -(-len(t) // block_chars))
                for p in range(n):
                    block = t[p * block_chars : (p + 1) * block_chars]
                    name = names.get(block)
                    first = (row, p) if name is not None else seen.setdefault(block, (row, p))
                    out.append((row, None if pd.isna(doc_id) else int(doc_id), p, n, hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() if not p else None, *first, block if name is None and first == (row, p) else None, name))
            frame = pd.DataFrame(out, columns=["row", "doc_id", "pos", "n", "sha", "at_row", "at_pos", "block", "name"])
            yield frame.astype({"doc_id": "Int64", "name": "Int64"})

    return cut


def _named(keys: DataFrame, cols: list[str]) -> Column:
    """Integer names of the keys: their dense rank in sorted order within one of RANGES ranges."""
    bucket = F.pmod(F.xxhash64(*cols), F.lit(RANGES))
    return bucket * F.lit(1 << 40) + F.dense_rank().over(Window.partitionBy(bucket).orderBy(*cols))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs: row, doc_id, text_sha256, level and name (the document's identity),
    group_size, keep_id and kept.

    Two rows share an identity just when their normalised texts are equal. The row with the smallest
    doc_id of a group stays; of rows that share that doc_id, one stays. A null doc_id counts as the
    largest, a null text as empty. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact")
    src = with_row(docs, id_col, text_col)
    schema = "row long, doc_id long, pos int, n int, sha string, at_row long, at_pos int, block string, name long"
    # Blocks that recur in a sample have names from the start; another block that recurs in a batch is sent
    # once for it. So no range of the sort gets a row for each copy of a frequent block.
    often = sampled(src).mapInPandas(_cut(block_chars), schema).select("block", "at_row")
    often = often.where("block is not null").groupBy("block").agg(F.count_distinct("at_row").alias("k")).where("k >= 3").orderBy(F.desc("k"), "block").limit(FREQUENT).collect()
    frequent = spark.sparkContext.broadcast({r["block"]: -2 - i for i, r in enumerate(often)})
    cut = work.stage(src.mapInPandas(_cut(block_chars, frequent), schema), "blocks")
    blocks = cut.where("block is not null").select(F.col("row").alias("at_row"), F.col("pos").alias("at_pos"), "block")
    names = blocks.select("at_row", "at_pos", _named(blocks, ["block"]).alias("name"))
    known = cut.where("name is not null").select("row", "pos", "n", "name")
    level = work.stage(cut.where("name is null").select("row", "pos", "n", "at_row", "at_pos").join(names, ["at_row", "at_pos"]).select("row", "pos", "n", "name").unionAll(known), "level-0")
    meta = work.stage(cut.where("pos = 0").select("row", "doc_id", F.col("sha").alias("text_sha256")), "meta")
    work.drop("blocks")
    done, k = level.where("n = 1").select("row", F.lit(0).alias("level"), "name"), 0
    longest = level.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        k, longest = k + 1, -(-longest // 2)
        half = F.shiftright("pos", 1)
        side = lambda bit: F.max(F.when(F.col("pos").bitwiseAND(1) == bit, F.col("name")))
        pairs = level.where("n > 1").groupBy("row", half.alias("pos")).agg(F.ceil(F.first("n") / 2).cast("int").alias("n"), side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        pairs = work.stage(pairs, f"pairs-{k}")
        keys = pairs.groupBy("a", "b").agg(F.count("*").alias("k"))
        named = work.stage(keys.select("a", "b", "k", _named(keys, ["a", "b"]).alias("name")), f"named-{k}")
        level = work.stage(join_counted(pairs, named, ["a", "b"], "k", ["name"]).select("row", "pos", "n", "name"), f"level-{k}")
        work.drop(f"pairs-{k}")
        work.drop(f"named-{k}")
        done = done.unionAll(level.where("n = 1").select("row", F.lit(k).alias("level"), "name"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    all_ = meta.join(done, "row")
    groups = work.stage(all_.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return join_counted(all_, groups, ["level", "name"], "group_size", ["best"]).select(
        "row", "doc_id", "text_sha256", "level", "name", "group_size", F.col("best.doc_id").alias("keep_id"), (F.col("row") == F.col("best.row")).alias("kept")
    )
