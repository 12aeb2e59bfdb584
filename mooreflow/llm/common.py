"""Shared pieces: staging in the cluster's shared folder, checked broadcasts, word hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mooreflow.session import shared_dir

#: Rows that a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Rows of a batch that goes to Python, where the session doesn't say.
BATCH_ROWS = 2_400
#: A key with more rows than the first, and than one of so many shares of all rows, is joined apart.
HOT_ROWS, HOT_KEYS = 256, 10_000
#: Edges that one task may unite.
LOCAL_EDGES = 1_000_000
#: Rows of a sample that only decides how work is dealt, never what comes out.
SAMPLE_ROWS = 5_000
#: Share of the driver's largest heap from which a table that was written has its garbage collected.
HEAP_SHARE = 0.5
#: Characters that one vectorised step works on in a Python worker.
STEP_CHARS = 1_500_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_U30, _U27, _U31 = np.uint64(30), np.uint64(27), np.uint64(31)


def settle(spark: SparkSession) -> None:
    """Bound the rows of a batch, and keep the number of files' splits from following the executors at hand: a lost one would else change
    how rows are numbered between two reads of one input."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:  # texts can be long
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Workspace:
    """Tables written to the shared folder to cut lineage; each can be dropped once unneeded."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        settle(spark)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.option("compression", "zstd").parquet(path)
        collect_garbage(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def together(self, schema: str, names: Sequence[str]) -> DataFrame:
        """Some columns of tables that were written, as one scan: a plan doesn't grow with their number."""
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}" for name in names])

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Drop all tables but these, which a result still reads."""
        for name in self.names - set(names):
            self.drop(name)


def lean(f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """f, with memory that it has freed given back to the system when it ends: workers live on, and what
    one stage has held would else count against the next."""

    @wraps(f)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    """Freed memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """A full collection in the driver, once its heap has grown to HEAP_SHARE of its bound. Plans and broadcasts
    of tables that are written are dead, but Spark lets go of them only when a collection finds them so, and
    till then the heap grows to its bound and keeps that memory."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        spark.sparkContext._jvm.System.gc()


def collect_executors(spark: SparkSession) -> None:
    """A full collection in the executors, which gives free heap back to the system. Else a heap may stay as large
    as any job before has made it, and what earlier work has left there counts against the work that follows. As many
    tasks as there are cores run at once, so each executor that is idle gets one; one that is not keeps its heap as it is."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> bool:
    """Whether df has at most so many rows, or so much weight: the sum of a column, for rows that may be long."""
    if weight is None:
        return df.limit(rows + 1).count() <= rows
    return (df.agg(F.sum(weight)).first()[0] or 0) <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it is small; else df, for a shuffle join."""
    return F.broadcast(df) if is_small(df, rows, weight) else df


def with_row(df: DataFrame, id_col: str, text_col: str, check: bool = False) -> DataFrame:
    """Columns row (unique), doc_id (long) and text of df, whatever else it has; with check, also the text's
    hash, by which a row is known again."""
    settle(df.sparkSession)
    text = F.col(f"`{text_col}`")
    own = [F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")]
    return df.select(*own, *([F.xxhash64(text).alias("check")] if check else []))


def join_counted(rows: DataFrame, one: DataFrame, on: list[str], n: str, others: Sequence[str] = (), text: bool = False) -> DataFrame:
    """rows joined with the row that `one` has for their key. n: column of `one` that is at least the number
    of rows with the key; it and the columns `others` of `one` are added. Keys that hold more than one of HOT_KEYS
    shares of all rows, fewer than HOT_KEYS, are joined apart, by broadcast, or with text, whose size nothing
    bounds, with their row repeated for each of many salts: no task gets all rows of such a key."""
    one = one.select(*on, n, *others)
    least = max(HOT_ROWS, (one.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS)
    hot, cold = one.where(F.col(n) > least), one.where(F.col(n) <= least)
    names = [F.col(c) for c in (*rows.columns, n, *others)]
    common = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    if text:
        salts = max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        salted = rows.join(F.broadcast(hot.select(*on)), on, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
        apart = salted.join(hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "_salt"])
    else:
        apart = rows.join(F.broadcast(hot), on)
    return common.select(*names).unionAll(apart.select(*names))


def _changed() -> Column:
    return F.raise_error(F.lit("the input's rows changed between two reads; write them to a table first")).cast("boolean")


def _numbered(df: DataFrame, text_col: str) -> DataFrame:
    settle(df.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.monotonically_increasing_id().alias("row"), whole.alias("whole"), F.xxhash64(F.col(f"`{text_col}`")).alias("now"))


def again(df: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """The rows of df, each whole in a struct `whole`, with what was found for their number when df was
    read before; found: row, check and other columns, null where a row has none. The numbers follow the
    order in which df is read: a row whose text has not the hash that its number had then raises."""
    same = F.col("check").isNull() | (F.col("check") == F.col("now"))
    return _numbered(df, text_col).join(found, "row", "left").where(F.when(same, F.lit(True)).otherwise(_changed())).drop("now", "check")


def without(df: DataFrame, bad: DataFrame, text_col: str) -> DataFrame:
    """df without the rows of bad (row, check), found again as by `again`."""
    rows = _numbered(df, text_col).join(small(bad.select("row", "check")), "row", "left")
    # One condition: split in two, rows to be dropped could go before their hash is looked at.
    stays = F.when(F.col("check").isNull(), F.lit(True)).when(F.col("check") == F.col("now"), F.lit(False)).otherwise(_changed())
    return rows.where(stays).select("whole.*")


def sampled(df: DataFrame) -> DataFrame:
    """About SAMPLE_ROWS rows of df, to see which keys are frequent: for how work is dealt, not for results."""
    return df.sample(min(1.0, SAMPLE_ROWS / max(1, df.count())), seed=1)


def steps(texts: Sequence[str | None], chars: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters each, at least one row."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > chars:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def lower(text: str) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


def ascii_words(text: str | None) -> list[bytes]:
    """Words as UTF-8, split at ASCII white space, A-Z in lower case."""
    return lower(text).split() if text else []


def hash_words(words: Sequence[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed with one table of powers; a longer word is hashed piece by piece.
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(_BLOCK, b, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x, dtype=np.uint64))
    return _powers


def hash_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a text in UTF-8, words being runs without ASCII white space. A word
    has the same hash wherever it stands: its polynomial in a fixed base, finalised with its length."""
    up, down = _tables()
    b = np.frombuffer(data, np.uint8)
    word = ~_SPACE[b]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = int(np.searchsorted(end, base + _BLOCK, "right"))
        if j > i:
            block = b[base : end[j - 1]]
            total = np.concatenate([[np.uint64(0)], np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], dtype=np.uint64)])
            h[i:j] = (total[end[i:j] - base] - total[start[i:j] - base]) * down[start[i:j] - base]
            i = j
            continue
        value, shift = 0, 1  # one word longer than a block
        for at in range(int(base), int(end[i]), _BLOCK):
            block = b[at : min(at + _BLOCK, end[i])].astype(np.uint64) + np.uint64(1)
            value += int(np.sum(block * up[: len(block)], dtype=np.uint64)) * shift
            shift = shift * pow(_BASE, _BLOCK, 1 << 64) % (1 << 64)
        h[i] = value % (1 << 64)
        i += 1
    return mix(h + (end - start).astype(np.uint64) * _M2), start


def text_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of many texts laid end to end, words of each text, and the line of each word."""
    parts = [lower(t) if t else b"" for t in texts]
    data = b" ".join(parts)
    h, start = hash_bytes(data)
    size = np.array([len(p) + 1 for p in parts], np.int64)
    begin = np.cumsum(size) - size
    first = np.searchsorted(start, begin)
    count = np.diff(np.concatenate([first, [len(start)]]))
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(breaks, start) - np.repeat(np.searchsorted(breaks, begin), count)
    return h, count, line


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = (x ^ (x >> _U30)) * _M1
    x = (x ^ (x >> _U27)) * _M2
    return x ^ (x >> _U31)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by a sort, which is faster than numpy's hash table on large arrays."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of a sequence of word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out) + h[i : len(h) - n + 1 + i]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of the edges of one task."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = [x for x in up if root(x) != x]  # as below, without the smallest nodes themselves
    for i in range(0, len(nodes), 100_000):
        yield pd.DataFrame({"node": nodes[i : i + 100_000], "comp": [root(x) for x in nodes[i : i + 100_000]]})


def components(edges: DataFrame, work: Workspace, tag: str) -> DataFrame:
    """Connected components by alternating large-star and small-star steps, each one shuffle with
    partial minima. edges: a, b (long). Returns node, comp: comp is the smallest node reachable.
    Those smallest nodes themselves and nodes without an edge to another are absent. No row of a group meets another; a node's
    whole neighbourhood is never gathered. LOCAL_EDGES edges or fewer are united in one task instead."""
    spark = work.spark
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = work.stage(e, f"{tag}-0")
    if is_small(e, LOCAL_EDGES):
        found = work.stage(e.coalesce(1).mapInPandas(lean(_united), "node long, comp long"), f"{tag}-1")
        work.drop(f"{tag}-0")
        return found
    k = 0
    while True:
        # large star: every larger neighbour of u goes to u's smallest neighbour or u itself
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low2 = big.groupBy("u").agg(F.min("v").alias("m"))
        new = big.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        k += 1
        new = work.stage(new, f"{tag}-{k}")
        left = new.select("u").groupBy("u").count().where("count > 1").limit(1).count()
        chained = new.alias("x").join(new.alias("y"), F.col("x.v") == F.col("y.u"), "left_semi").limit(1).count()
        work.drop(f"{tag}-{k - 1}")
        e = new
        if not left and not chained:
            return spark.read.schema(new.schema).parquet(f"{work.root}/{tag}-{k}").select(F.col("u").alias("node"), F.col("v").alias("comp"))
