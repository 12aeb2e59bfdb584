"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers and names become typed placeholders. Windows of the resulting template
are hash-joined, in one pass over the documents, with the table of the benchmark's template windows;
items that differ only in the values of their slots are one class there, so a template with many
instances is joined once. Where enough windows of a class stand in a passage, in order and at one
alignment, the values in the slots are compared: if values that are equal in the item are equal in
the passage, and different ones different, the passage is the item, word for word or with other
parameters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooreflow.llm.common import Workspace, distinct, grams, is_small, lean, mix, signed, small, steps, with_row, without

#: Tokens of a window; least literal tokens in it, and so most slots.
WINDOW, LITERALS = 5, 3
SLOTS = WINDOW - LITERALS
#: Least share of an item's windows in a passage; least share of its slots that are consistent.
CONTAINED, CONSISTENT = 0.6, 0.8
#: A window may stand off its passage's alignment by a token for each so many of the item's, and one.
DRIFT = 4
#: Bits of the two filters that are broadcast, whatever the size of the benchmark.
FILTER_BITS = 1 << 26
#: Shares into which the places of one window in the documents are dealt.
SALTS = 16

# Units that count as such after a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams ton tons lb lbs oz pound pounds ml l liter liters litre litres gallon "
    "gallons second seconds sec s minute minutes min hour hours h hr day days week weeks month months year years percent pct dollar dollars usd cent cents "
    "euro euros eur yen degree degrees celsius fahrenheit kelvin watt watts kw kwh volt volts amp amps hz khz mhz ghz byte bytes kb mb gb tb mph kmh".split()
)
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
NUM, UNIT, NAME = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in ("<num>", "<unit>", "<name>"))
_IS_NUM, _IS_UNIT, _IS_CAP = 1, 2, 4
#: Keys of windows of literal tokens and of whole short texts; these differ from those of templates.
_RAW, _WHOLE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: A token's code is the hash of its lower case with flags in the last three bits.
_FLAGS = np.uint64(7)
_MEMO, _STEP = 120_000, 600_000


class _Memo(dict):
    """Token to its code, worked out once for each token."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        flags = _IS_NUM if token[0].isdigit() else (_IS_UNIT * (low in UNITS)) | (_IS_CAP * token[0].isupper())
        if len(self) > _MEMO:
            self.clear()
        self[token] = found = xxhash.xxh3_64_intdigest(low) & ~7 | flags
        return found


class Filter:
    """A set of hashes as a bitmap of fixed size: no member is missed, few others pass."""

    def __init__(self, hashes: int, words: np.ndarray | None = None):
        self.hashes, self.words = hashes, np.zeros(FILTER_BITS // 64, np.uint64) if words is None else words

    def places(self, x: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(self.hashes):
            yield (mix(x + np.uint64(i * int(_RAW) % (1 << 64))) % np.uint64(FILTER_BITS)).astype(np.int64)

    def bits(self, x: np.ndarray) -> pd.DataFrame:
        """The bitmap's words with bits for x."""
        at = np.concatenate(list(self.places(x))) if len(x) else np.empty(0, np.int64)
        return pd.DataFrame({"word": at >> 6, "bit": signed(np.uint64(1) << (at & 63).astype(np.uint64))})

    def __contains__(self, x: object) -> bool:
        return bool(self.holds(np.array([x], np.uint64))[0])

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for at in self.places(x):
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) > 0
        return out


def _filter(rows: DataFrame, hashes: int) -> Filter:
    """The filter from rows (word, bit); at most FILTER_BITS / 64 rows reach the driver."""
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = Filter(hashes)
    out.words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def coded(tokens: list[list[str]], memo: _Memo):
    """Tokens of many texts laid end to end: hashes of their lower case, flags, text, index in the text."""
    counts = np.array([len(t) for t in tokens], np.int64)
    codes = np.fromiter((memo[t] for own in tokens for t in own), np.uint64, int(counts.sum()))
    index = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts)
    return codes & ~_FLAGS, (codes & _FLAGS).astype(np.uint8), np.repeat(np.arange(len(tokens)), counts), index


def template(h: np.ndarray, flags: np.ndarray, text: np.ndarray, index: np.ndarray, vocabulary: Filter):
    """The templates of coded texts: hashes, is-a-slot, value, text, and the slots among the tokens
    themselves. A capitalised token that the benchmark does not use in lower case is a name; names in a
    row are one, their value all of them."""
    num = (flags & _IS_NUM) > 0
    after = np.concatenate([[False], num[:-1]]) & (index > 0)
    unit = ((flags & _IS_UNIT) > 0) & after
    cap = ((flags & _IS_CAP) > 0) & ~unit
    cap[cap] = ~vocabulary.holds(h[cap])
    slot = num | unit | cap
    kind = np.where(num, NUM, np.where(unit, UNIT, np.where(cap, NAME, h)))
    again = cap & np.concatenate([[False], cap[:-1]]) & (index > 0)
    keep = np.flatnonzero(~again)
    run = np.arange(len(h)) - np.repeat(keep, np.diff(np.append(keep, len(h)))) if len(h) else keep
    value = np.add.reduceat(mix(h + run.astype(np.uint64) * _RAW), keep) if len(h) else h
    return kind[keep], slot[keep], value, text[keep], slot


def _runs(h: np.ndarray, slot: np.ndarray, text: np.ndarray):
    """Hashes of all windows that lie in one text, with their places and literal tokens."""
    if len(h) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    total = np.concatenate([[0], np.cumsum(slot)])
    at = np.flatnonzero(text[: len(h) - WINDOW + 1] == text[WINDOW - 1 :])
    return grams(h, WINDOW)[at], at, WINDOW - (total[at + WINDOW] - total[at])


def windows(tokens: list[list[str]], memo: _Memo, vocabulary: Filter, wanted: Filter | None = None) -> pd.DataFrame:
    """The windows of many texts, only those in wanted where it is given: text, w (hash), at (place in the
    text's template, or the token for literal ones), size (of the template, in tokens), two slots as offset
    and value (o0, s0, o1, s1; offset -1: none) and literal. Three kinds: template windows with LITERALS
    literal tokens or more; literal windows where the tokens have fewer; a text shorter than a window."""
    h, flags, text, index = coded(tokens, memo)
    kind, slot, value, of, raw_slot = template(h, flags, text, index, vocabulary)
    counts, sizes = (np.bincount(x, minlength=len(tokens)) for x in (text, of))
    begin, first = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes

    def chosen(w: np.ndarray, at: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, at = w[ok], at[ok]
        ok = np.ones(len(w), bool) if wanted is None else wanted.holds(w)
        return w[ok], at[ok]

    w, at, literals = _runs(kind, slot, of)
    w, at = chosen(w, at, literals >= LITERALS)
    inside = slot[at[:, None] + np.arange(WINDOW)] if len(at) else np.zeros((0, WINDOW), bool)
    who = of[at]
    own = {"text": who, "w": w, "at": at - first[who], "size": sizes[who]}
    for i in range(SLOTS):
        has, o = inside.any(1), inside.argmax(1)
        own |= {f"o{i}": np.where(has, o, -1), f"s{i}": np.where(has, value[at + o], np.uint64(0))}
        inside[np.arange(len(at)), o] = False
    w, at, literals = _runs(h, raw_slot, text)
    w, at = chosen(mix(w + _RAW), at, literals < LITERALS)
    short = np.flatnonzero((counts > 0) & (counts < WINDOW))
    whole, short = chosen(np.array([mix(grams(h[begin[t] : begin[t] + counts[t]], int(counts[t])) + _WHOLE)[0] for t in short], np.uint64), short, np.ones(len(short), bool))
    who, n = np.concatenate([text[at], short]), len(at) + len(short)
    rest = {"text": who, "w": np.concatenate([w, whole]), "at": np.concatenate([index[at], np.zeros(len(short), np.int64)]), "size": counts[who]}
    for i in range(SLOTS):
        rest |= {f"o{i}": np.full(n, -1), f"s{i}": np.zeros(n, np.uint64)}
    both = {c: np.concatenate([own[c], rest[c]]) for c in own}
    return pd.DataFrame(both | {"literal": np.arange(len(both["w"])) >= len(own["w"])})


def item_rows(ids: list, texts: list[str], vocabulary: Filter) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The items (item_id, cls, values) and the windows of their classes (w, cls, q, total, size and for
    two slots offset o and name a). An item's literal windows, or it as a whole, count only if it has no
    template windows. A window that an item has several times counts once, at its first place."""
    tokens = [_TOKEN.findall(t or "") for t in texts]
    all_ = windows(tokens, _Memo(), vocabulary)
    templated = np.zeros(len(texts), bool)
    templated[all_.loc[~all_["literal"], "text"]] = True
    all_ = all_[all_["literal"].to_numpy() != templated[all_["text"]]]
    items, found = [], []
    for t, own in all_.sort_values(["text", "at"], kind="stable").groupby("text"):
        own = own.drop_duplicates("w")
        names: dict[int, int] = {}
        filled: dict[int, int] = {}  # place of a slot to its value
        out = []
        for r in own.itertuples(index=False):
            named = []
            for o, s in ((r.o0, r.s0), (r.o1, r.s1)):
                if o >= 0:
                    filled[r.at + o] = int(s)
                named.append(names.setdefault(int(s), len(names)) if o >= 0 else -1)
            out.append((r.w - (r.w >> 63 << 64), r.at, r.o0, named[0], r.o1, named[1]))
        size, total = int(own["size"].iloc[0]), len(own)
        cls = xxhash.xxh3_64_intdigest(repr((size, out)).encode()) - (1 << 63)
        items.append((ids[t], cls, values_hash(filled)))
        found += [(w, cls, q, total, size, o0, a0, o1, a1) for w, q, o0, a0, o1, a1 in out]
    return pd.DataFrame(items, columns=["item_id", "cls", "values"]), pd.DataFrame(found, columns=["w", "cls", "q", "total", "size", "o0", "a0", "o1", "a1"])


def values_hash(filled: dict[int, int]) -> int:
    """One number for the values in an item's slots."""
    return xxhash.xxh3_64_intdigest(repr(sorted(filled.items())).encode()) - (1 << 63)


def consistency(pairs: Counter) -> float:
    """Share of slot pairs that agree with a one-to-one choice of partners, the most frequent pairs first and
    of equally frequent ones the first counted; 1 without slots."""
    total = sum(pairs.values())
    if not total:
        return 1.0
    good, left, right = 0, set(), set()
    for (a, b), n in sorted(pairs.items(), key=lambda x: -x[1]):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            good += n
    return good / total


def ordered(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    ends: list[int] = []
    tails: list[int] = []
    before = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(ends, p)
        before[i] = tails[k - 1] if k else -1
        ends[k : k + 1], tails[k : k + 1] = [p], [i]
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def passages(hits: list[tuple[int, int]], size: int) -> Iterator[list[tuple[int, int]]]:
    """For each alignment (place in the document less place in the item) that a hit has, the hits that lie
    along it: of each of the item's places the nearest, at most size / DRIFT + 1 off, in order."""
    drift = size // DRIFT + 1
    by_shift = sorted((p - q, p, q) for p, q in hits)
    lo = hi = 0
    done = None
    for shift, _, _ in by_shift:
        if shift == done:
            continue
        done = shift
        while hi < len(by_shift) and by_shift[hi][0] <= shift + drift:
            hi += 1
        while by_shift[lo][0] < shift - drift:
            lo += 1
        own: dict[int, tuple[int, int]] = {}
        for other, p, q in by_shift[lo:hi]:
            if q not in own or (abs(other - shift), p) < own[q]:
                own[q] = abs(other - shift), p
        along = [(own[q][1], q) for q in sorted(own)]
        yield [along[i] for i in ordered([p for p, _ in along])]


def _hits(shared, wanted):
    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, known, memo = shared.value, wanted.value, _Memo()
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for i, j in steps(texts, _STEP):
                all_ = windows([_TOKEN.findall(t) for t in texts[i:j]], memo, vocabulary, known)
                if len(all_):
                    own = batch[["row", "doc_id", "check"]].iloc[i:j].iloc[all_["text"]].reset_index(drop=True)
                    own["doc_id"] = own["doc_id"].astype("Int64")
                    rest = {c: signed(all_[c].to_numpy()) for c in ("w", "s0", "s1")}
                    yield own.assign(p=all_["at"].to_numpy(), **rest)

    return hits


def _verified(contained: float, consistent: float):
    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, doc_id, check, cls, total, size, hits in zip(*(batch[c] for c in ("row", "doc_id", "check", "cls", "total", "size", "hits")), strict=True):
                at = {(h["p"], h["q"]): h for h in hits}
                for own in passages(list(at), size):
                    if len(own) < contained * total:
                        continue
                    filled: dict[tuple[int, int], tuple[int, int]] = {}
                    for place in own:
                        h = at[place]
                        for o, a, s in ((h["o0"], h["a0"], h["s0"]), (h["o1"], h["a1"], h["s1"])):
                            if o >= 0:
                                filled[h["p"] + o, h["q"] + o] = a, s
                    c = consistency(Counter(filled.values()))
                    if c >= consistent:
                        values = values_hash({q: s % (1 << 64) for (_, q), (_, s) in filled.items()})
                        out.append((row, doc_id, check, cls, total, len(own), c, own[0][0], values))
            frame = pd.DataFrame(out, columns=["row", "doc_id", "check", "cls", "n_windows", "n_found", "consistency", "place", "values"])
            yield frame.astype({"doc_id": "Int64"})

    return verified


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", contained: float = CONTAINED, consistent: float = CONSISTENT) -> DataFrame:
    """One row per document and class of benchmark items that it leaks: row, check, doc_id, item_id, n_items,
    n_windows, n_found, contained, consistency, verbatim.

    A class is the items that are one question with other values; item_id is the item whose very values
    the passage has (verbatim), else the smallest of the class, n_items their number. n_found is of the
    document's best passage: verbatim first, then the most windows. An item in which no window has
    LITERALS literal tokens is matched by its literal tokens instead, and one shorter than a window only
    by a document that says nothing else. Items without a token are never found; a null or empty text
    leaks nothing. Repeated rows each give their rows; items repeated under one id count once; of null
    item ids the class takes another where it has one. Empty tables give an empty result. What is broadcast
    has a fixed size, or is small by count; documents are read once, and only the windows that a fixed
    filter takes for the benchmark's are joined, dealt by window and a salt.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "leaks")
    src = with_row(docs, id_col, text_col, check=True)
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").distinct()

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            low = {t for x in batch["text"] for t in _TOKEN.findall(x) if t[0].islower()}
            yield Filter(3).bits(np.array([xxhash.xxh3_64_intdigest(t) & ~7 for t in low], np.uint64))

    vocabulary = spark.sparkContext.broadcast(_filter(bench.mapInPandas(lean(words), "word long, bit long"), 3))

    def itemised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["item_id"]]
            items, found = item_rows(ids, batch["text"].tolist(), vocabulary.value)
            yield pd.concat([items.assign(w=None), found.assign(item_id=None, values=None)]).astype("Int64")

    columns = "item_id long, cls long, values long, w long, q int, total int, size int, o0 int, a0 int, o1 int, a1 int"
    both = work.stage(bench.mapInPandas(lean(lambda batches: (f.reindex(columns=[c.split()[0] for c in columns.split(", ")]) for f in itemised(batches))), columns), "items")
    items = both.where("w is null").select("item_id", "cls", "values")
    table = both.where("w is not null").select("w", "cls", "q", "total", "size", "o0", "a0", "o1", "a1").distinct()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield Filter(1).bits(distinct(batch["w"].to_numpy(np.int64).view(np.uint64)))

    wanted = spark.sparkContext.broadcast(_filter(table.select("w").mapInPandas(lean(keys), "word long, bit long"), 1))
    hits = src.mapInPandas(lean(_hits(vocabulary, wanted)), "row long, doc_id long, check long, p int, w long, s0 long, s1 long")
    if is_small(table):
        joined = hits.join(F.broadcast(table), "w")
    else:  # a window that many documents have is dealt by a salt, the benchmark's side repeated for each
        dealt = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hits.withColumn("salt", F.pmod(F.xxhash64("row", "p"), F.lit(SALTS)).cast("int")).join(dealt, ["w", "salt"])
    by_class = joined.groupBy("row", "cls").agg(
        F.first("doc_id").alias("doc_id"), F.first("check").alias("check"), F.first("total").alias("total"), F.first("size").alias("size"), F.collect_list(F.struct("p", "q", "o0", "a0", "s0", "o1", "a1", "s1")).alias("hits")
    )
    enough = by_class.where(F.size(F.array_distinct("hits.q")) >= F.lit(contained) * F.col("total"))
    found = enough.mapInPandas(lean(_verified(contained, consistent)), "row long, doc_id long, check long, cls long, n_windows long, n_found long, consistency double, place long, values long")
    classes = items.groupBy("cls").agg(F.min("item_id").alias("least"), F.count("*").alias("n_items"))
    exact = items.groupBy("cls", "values").agg(F.min("item_id").alias("same"), F.lit(True).alias("is_same"))
    found = found.join(small(classes), "cls").join(small(exact), ["cls", "values"], "left")
    verbatim = F.coalesce("is_same", F.lit(False)) & (F.col("n_found") == F.col("n_windows"))
    found = found.withColumns({"verbatim": verbatim, "item_id": F.when(verbatim, F.coalesce("same", "least")).otherwise(F.col("least"))})
    best = F.max_by(F.struct("doc_id", "check", "item_id", "n_items", "n_windows", "n_found", "consistency", "verbatim"), F.struct("verbatim", "n_found", "consistency", -F.col("place"))).alias("x")
    out = found.groupBy("row", "cls").agg(best).select("row", "x.*")
    return out.select("row", "check", "doc_id", "item_id", "n_items", "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("contained"), "consistency", "verbatim")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """docs without the rows that leak an item, all columns as they are. The rows must come in the same
    order each time docs is read; a change is noticed and raises."""
    bad = leaks(docs, benchmark, id_col, text_col, **thresholds).select("row", "check").distinct()
    return without(docs, Workspace(docs.sparkSession, "leaks").stage(bad, "rows"), text_col)
