"""Language-model scores with stupid backoff, from n-gram counts of the whole corpus.

The computation is relational: documents are exploded to n-grams, counted, joined with the corpus
totals and summed per document. `score_exploded` says so with a row for each n-gram of each document.
`score` is the same plan with rows packed for the shuffle: a chunk of documents sends each of its
distinct n-grams once, to the part of the count table that the n-gram's hash names, and gets the totals
back in the same order. Counts leave out the document itself, so a text is scored by what the rest of
the corpus says about it.

    S(w | context) = count(context w) / count(context)            if count(context w) > 0
                   = ALPHA * S(w | shorter context)               otherwise
    S(w)           = max(count(w), FLOOR) / words of the others
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooreflow.llm.common import Workspace, distinct, grams, join_counted, mix, steps, text_hashes, with_row

ORDER, ALPHA, FLOOR = 3, 0.4, 0.5
#: Characters of a chunk of documents, and of the corpus for each part of the count table.
CHUNK_CHARS, PART_CHARS = 10_000_000, 8_000_000
#: Numbers that are packed without compression.
PLAIN = 4
#: Keys of n-grams have 56 bits: one of 10**13 others has a given n-gram's key with a chance of 1 in 7000.
BITS = 56
_SPARE = np.uint64(64 - BITS)
#: The key under which the number of words is counted.
_TOTAL = np.uint64(0)


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers as bytes: by byte plane, so that small numbers leave planes of zeros; few ones
    as they are, as a frame around them would be longer."""
    if len(x) <= PLAIN:
        return b"p" + x.astype("<u8").tobytes()
    return b"z" + zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    if b[:1] == b"p":
        return np.frombuffer(b, "<u8", offset=1)
    planes = np.frombuffer(zstandard.decompress(b[1:]), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def ngrams(h: np.ndarray, text: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys of the n-grams of many texts and the places of their last words, for n from 1 to order. h:
    word hashes laid end to end; text: the text of each word."""
    out = []
    for n in range(1, order + 1):
        if len(h) < n:
            out.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
            continue
        at = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1])
        out.append(((mix(grams(h, n) + np.uint64(n)) >> _SPARE)[at], at + n - 1))
    return out


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Chunks of a partition's rows, by their first row; the same rows in the same order give the same."""
    for batch in batches:
        texts = [t if isinstance(t, str) else None for t in batch["text"]]
        batch = batch.assign(text=texts)
        for i, j in steps(texts, CHUNK_CHARS):
            yield int(batch["row"].iloc[i]), batch.iloc[i:j]


def _counted(order: int, parts: int):
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Distinct n-grams of each chunk and their counts, by part of the table."""
        for number, rows in _chunks(batches):
            h, count, _ = text_hashes(rows["text"].tolist())
            found = [g for g, _ in ngrams(h, np.repeat(np.arange(len(count)), count), order)]
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            keys, counts = np.concatenate([[_TOTAL], keys]), np.concatenate([[len(h)], counts])
            part = part_of(keys, parts)
            edges = [*np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist(), len(keys)]
            out = [(number, int(part[a]), pack_sorted(keys[a:b]), pack(counts[a:b])) for a, b in pairwise(edges)]
            yield pd.DataFrame(out, columns=["chunk", "part", "keys", "counts"])

    return counted


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the keys, so sorted keys have sorted parts. parts: a power of two."""
    return keys >> np.uint64(BITS - parts.bit_length() + 1)


def _totals(part: pd.DataFrame) -> pd.DataFrame:
    """One part of the count table: sums over chunks, sent back to each chunk in its own order."""
    sent = [unpack_sorted(k) for k in part["keys"]]
    keys = distinct(np.concatenate(sent))
    places = [np.searchsorted(keys, s) for s in sent]
    counts = np.zeros(len(keys), np.int64)
    for at, c in zip(places, part["counts"], strict=True):
        counts[at] += unpack(c).astype(np.int64)
    return pd.DataFrame({"chunk": part["chunk"], "part": part["part"], "body": [pack(counts[at]) for at in places], "rows": None})


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chunks' texts, compressed, to meet their totals."""
    for number, rows in _chunks(batches):
        sizes = np.array([0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in rows["text"]], np.int64)
        body = zstandard.compress("".join(t or "" for t in rows["text"]).encode("utf-8", "surrogatepass"), 3)
        packed = [{"row": int(a), "doc_id": None if pd.isna(b) else int(b), "size": int(c)} for a, b, c in zip(rows["row"], rows["doc_id"], sizes, strict=True)]
        yield pd.DataFrame({"chunk": [number], "part": [-1], "body": [body], "rows": [packed]})


def others(g: np.ndarray, text: np.ndarray, order: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Occurrences of each n-gram in other texts than its own. order: a stable sort of g, texts being in
    order; totals: the corpus counts of the distinct keys of g."""
    k, t = g[order], text[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    run = np.flatnonzero(new | np.concatenate([[True], t[1:] != t[:-1]]))
    own = np.repeat(np.diff(np.concatenate([run, [len(k)]])), np.diff(np.concatenate([run, [len(k)]])))
    out = np.empty(len(g), np.int64)
    out[order] = totals[np.cumsum(new) - 1] - own
    return out


def _scored(order: int, parts: int):
    def scored(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("part")
        head, back = chunk.iloc[0], chunk.iloc[1:]
        data, at, texts, rows = zstandard.decompress(head["body"]), 0, [], list(head["rows"])
        for r in rows:
            texts.append(data[at : at + r["size"]].decode("utf-8", "surrogatepass"))
            at += r["size"]
        h, count, _ = text_hashes(texts)
        text = np.repeat(np.arange(len(count)), count)
        found = [(g, ends, np.argsort(g, kind="stable")) for g, ends in ngrams(h, text, order)]
        single = [s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s := g[o]) else g for g, _, o in found]
        keys = distinct(np.concatenate(single))
        if len(keys) and keys[0] == _TOTAL:
            raise ValueError("an n-gram has the key of the total")
        totals, part = np.zeros(len(keys), np.int64), part_of(keys, parts)
        own = back["part"].to_numpy().astype(np.uint64)
        words, covered = 0, 0
        for p, a, b, body in zip(own.tolist(), np.searchsorted(part, own), np.searchsorted(part, own, "right"), back["body"], strict=True):
            c = unpack(body).astype(np.int64)
            if p == 0:  # this part begins with the number of words
                words, c = int(c[0]), c[1:]
            if len(c) != b - a:
                raise ValueError("the input's rows changed between two reads; write them to a table first")
            totals[a:b], covered = c, covered + len(c)
        if covered != len(keys):
            raise ValueError("the input's rows changed between two reads; write them to a table first")
        value, shorter = np.zeros(len(h)), np.zeros(len(h), np.int64)
        for n, ((g, ends, o), own) in enumerate(zip(found, single, strict=True), 1):
            if not len(g):
                break
            c = others(g, text[ends], o, totals[np.searchsorted(keys, own)])
            if n == 1:
                value = np.log(np.maximum(c, FLOOR) / np.maximum(1, words - count)[text])
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    value[ends] = np.where(c > 0, np.log(c / shorter[ends - 1]), np.log(ALPHA) + value[ends])
            shorter = np.zeros(len(h), np.int64)
            shorter[ends] = c
        frame = pd.DataFrame({"row": [r["row"] for r in rows], "doc_id": [r["doc_id"] for r in rows], "n_words": count, "log_score": np.bincount(text, value, len(count))})
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return scored


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """row, doc_id, n_words, log_score (natural log, summed over words) for each row of docs.

    A null, empty or wordless text has no words and score 0. Repeated rows are other documents to each
    other. An empty table gives an empty result. The rows must come in the same order each time docs
    is read; a change is noticed and raises. The table has a part for each PART_CHARS characters, and
    a part gets an n-gram at most once from each chunk, so no n-gram is hot.
    """
    src = with_row(docs, id_col, text_col)
    chars = src.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 << max(4, (-(-chars // PART_CHARS) - 1).bit_length())
    sent = src.mapInPandas(_counted(order, parts), "chunk long, part int, keys binary, counts binary")
    entry = "chunk long, part int, body binary, rows array<struct<row:long,doc_id:long,size:long>>"
    back = sent.groupBy("part").applyInPandas(_totals, entry)
    both = back.unionAll(src.mapInPandas(_texts, entry))
    return both.groupBy("chunk").applyInPandas(_scored(order, parts), "row long, doc_id long, n_words long, log_score double")


def score_exploded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """What `score` gives, to rounding, from tables with a row for each n-gram, by built-in functions alone:
    n-grams of each document with their own counts; the count table, summed by hash; the join, in which
    the rows of frequent n-grams are dealt apart; and each document's sum. Its rows grow with the corpus
    and every step spills, at several times the shuffle of the packed form.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "ngrams")
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), upper, low), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    src = with_row(docs, id_col, text_col).withColumn("w", words)

    def keys(n: int) -> Column:
        at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.lit(n), F.slice("w", i, n)))

    grams = src.select("row", F.explode(F.concat(*[keys(n) for n in range(1, order + 1)])).alias("key"))
    own = work.stage(grams.groupBy("row", "key").agg(F.count("*").alias("own")), "own")
    table = work.stage(own.groupBy("key").agg(F.sum("own").alias("total"), F.count("*").alias("documents")), "counts")
    total = src.agg(F.sum(F.size("w").cast("long"))).first()[0] or 0
    found = join_counted(own, table, ["key"], "documents", ["total"]).select("row", "key", (F.col("total") - F.col("own")).alias("others"))
    by_row = found.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("key", "others"))).alias("others"))
    rows = src.select("row", "doc_id", "w", *[keys(n).alias(f"k{n}") for n in range(1, order + 1)]).join(by_row, "row", "left")
    size = F.size("w").cast("long")
    count = lambda n, i: F.element_at("others", F.get(F.col(f"k{n}"), i))

    def log_s(n: int, i: Column) -> Column:
        """Of the word at i (from 0), with the n - 1 words before it."""
        if n == 1:
            return F.log(F.greatest(count(1, i), F.lit(FLOOR)) / F.greatest(F.lit(total) - size, F.lit(1)))
        first = i - (n - 1)
        seen = count(n, first)
        return F.when((first >= 0) & (seen > 0), F.log(seen / count(n - 1, first))).when(first >= 0, F.lit(math.log(ALPHA)) + log_s(n - 1, i)).otherwise(log_s(n - 1, i))

    places = F.when(size > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    value = F.aggregate(F.transform(places, lambda i: log_s(order, i)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("row", "doc_id", size.alias("n_words"), value.alias("log_score"))
