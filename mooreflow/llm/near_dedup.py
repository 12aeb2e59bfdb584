"""Near-duplicate groups with an LSH forest over MinHash signatures.

Every distinct shingle set gets a signature. The forest is a number of orders: in each, the sets are
sorted by a sequence of signature values of their own. Sets next to each other in an order share
their longest prefixes, and the depth to which they agree adapts to the region: neighbours meet at
depth 1 where sets are few, and deeper where many share a prefix. Neighbours become candidates, and
a candidate is a link when the full sets confirm it. Regions in which more sets share a prefix than
a window holds are passed once more with a wider window, and then with each run of one component
drawn together, until that finds no new link; what these may still miss there, an exact join of the
sets by their rarest shingles finds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooreflow.llm.common import HOT_ROWS, Workspace, ascii_words, components, distinct, grams, hash_words, join_counted, lean, mix, signed, small, with_row

#: Words of a shingle; least Jaccard similarity in hundredths.
SHINGLE, PERCENT = 5, 80
#: Orders, signature values in the key of each, values that no other order has.
TREES, DEPTH, OWN = 16, 16, 8
HASHES = TREES * OWN
#: Neighbours on each side in an order; prefix shared by a whole window from which a region is passed
#: again, and neighbours on each side then, of all rows and of the ends of runs of one component.
WINDOW, CROWDED, WINDOW_AGAIN, WINDOW_RUNS = 4, 3, 32, 8
#: Rows at the ends of partitions that one task may look through.
SEAM_ROWS = 200_000
#: Shares into which the sets with a frequent shingle are dealt.
SALTS = 64
#: A candidate's sketches may agree in so many standard deviations fewer values than at the least similarity.
DEVIATIONS = 4.0
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 31, HASHES, np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint32)
_ORDERS = [np.concatenate([np.arange(t * OWN, (t + 1) * OWN), (np.arange((t + 1) * OWN, (t + 1) * OWN + DEPTH - OWN)) % HASHES]) for t in range(TREES)]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a shorter text is one shingle, or none without words."""
    h = hash_words(ascii_words(text))
    if not len(h):
        return h
    return distinct(grams(h, n)) if len(h) >= n else mix(grams(h, len(h)) + np.uint64(len(h)))


def fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def signature(s: np.ndarray) -> np.ndarray:
    x = (mix(s) >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(out, (x[i : i + 512, None] * _A + _B).min(0), out=out)
    return out


def _featured(n: int):
    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch.pop("text"):
                s = shingle_set(text if isinstance(text, str) else None, n)
                out.append((len(s), fingerprint(s), signature(s).tobytes() if len(s) else None))
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch.assign(**dict(zip(("n", "print", "sig"), map(list, zip(*out, strict=True)), strict=True))) if out else batch.assign(n=[], print=[], sig=[])

    return featured


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each set and order."""
    for batch in batches:
        if not len(batch):
            continue
        for at in range(0, len(batch), 2000):
            part = batch.iloc[at : at + 2000]
            sig = np.frombuffer(b"".join(part["sig"]), np.uint32).reshape(-1, HASHES)
            sketch = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            own = part.drop(columns="sig").assign(sketch=[x.tobytes() for x in sketch])
            for t, order in enumerate(_ORDERS):
                keys = np.ascontiguousarray(sig[:, order].astype(">u4"))
                yield own.assign(tree=t, key=[k.tobytes() for k in keys])


def _neighbours(window: int, percent: int, again: bool, runs: bool, seam: bool, last: bool = False):
    """Candidates among the sorted rows of a partition, and the rows at its ends for the seams. again:
    not the first pass; runs: only the ends of each run of one component are looked at; seam: the rows
    are ends of earlier partitions, those of one of which have met; last: there are no more seams."""
    columns = ["kind", "a", "b", "rank", "tree", "key", "cid", "n", "comp", "sketch", "part"]

    mean = HASHES * (percent / 100 + (1 - percent / 100) / 256)
    least = mean - DEVIATIONS * (mean * (1 - mean / HASHES)) ** 0.5

    def pairs_of(f: pd.DataFrame, fresh: int) -> Iterator[pd.DataFrame]:
        size = len(f)
        if size < 2:
            return
        keys = np.frombuffer(b"".join(f["key"]), ">u4").reshape(size, DEPTH)
        sketch = np.frombuffer(b"".join(f["sketch"]), np.uint8).reshape(size, HASHES)
        cid, n, tree, comp, part = (f[c].to_numpy() for c in ("cid", "n", "tree", "comp", "part"))
        for g in range(1, min(window, size - 1) + 1):
            lo = np.arange(max(0, fresh - g), size - g)
            hi = lo + g
            ok = (tree[lo] == tree[hi]) & (keys[lo, 0] == keys[hi, 0]) & (comp[lo] != comp[hi])
            if seam:
                ok &= part[lo] != part[hi]
            lo, hi = lo[ok], hi[ok]
            if g == window and not again:
                depth = (keys[lo] == keys[hi])[:, :CROWDED].all(1)
                crowd = np.unique(np.concatenate([cid[lo[depth]], cid[hi[depth]]]))
                if len(crowd):
                    yield pd.DataFrame({"kind": 2, "cid": crowd})
            small_n, large_n = np.minimum(n[lo], n[hi]).astype(np.int64), np.maximum(n[lo], n[hi]).astype(np.int64)
            ok = 100 * small_n >= percent * large_n
            lo, hi = lo[ok], hi[ok]
            same = (sketch[lo] == sketch[hi]).sum(1)
            ok = same >= least
            lo, hi, same = lo[ok], hi[ok], same[ok]
            if len(lo):
                rank = np.where(same < mean, 3, 2)
                if g == 1 and not again:
                    rank = np.where(same < mean, 3, np.where(tree[lo] == 0, 0, np.where(tree[lo] < 4, 1, 2)))
                yield pd.DataFrame({"kind": 0, "a": np.minimum(cid[lo], cid[hi]), "b": np.maximum(cid[lo], cid[hi]), "rank": rank})

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        f = f.reindex(columns=columns)
        for c in ("a", "b", "cid", "comp", "n", "rank", "tree", "part", "kind"):
            f[c] = f[c].astype("Int64")
        return f

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = TaskContext.get().partitionId()
        kept, pending, ends = None, None, 0
        tail = None

        def step(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal kept, tail, ends
            if not last and ends < window:
                yield whole(f.iloc[: window - ends].assign(kind=1))
                ends += min(len(f), window - ends)
            fresh = 0 if kept is None else len(kept)
            f = f if kept is None else pd.concat([kept, f], ignore_index=True)
            for x in pairs_of(f, fresh):
                yield whole(x)
            kept = tail = f.iloc[-window:]

        for batch in batches:
            if not seam:
                batch = batch.assign(part=here)
            if not runs:
                yield from step(batch)
                continue
            f = batch if pending is None else pd.concat([pending, batch], ignore_index=True)
            comp, tree = f["comp"].to_numpy(), f["tree"].to_numpy()
            if not len(f):
                continue
            change = np.concatenate([[True], (comp[1:] != comp[:-1]) | (tree[1:] != tree[:-1])])
            keep = change | np.concatenate([change[1:], [True]])
            pending = f.iloc[-1:]
            if keep[:-1].any():
                yield from step(f.iloc[:-1][keep[:-1]])
        if pending is not None:
            yield from step(pending)
        if tail is not None and not last:
            yield whole(tail.assign(kind=1))

    return neighbours


_NEIGHBOURS = "kind long, a long, b long, rank long, tree long, key binary, cid long, n long, comp long, sketch binary, part long"


def _candidates(orders: DataFrame, work: Workspace, percent: int, tag: str, again: bool = False, runs: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a < b, rank) of the orders, and the sets in crowded regions."""
    order, window = ["tree", "key", "cid"], WINDOW_RUNS if runs else WINDOW_AGAIN if again else WINDOW
    found = lambda rows, *how: rows.sortWithinPartitions(*order).mapInPandas(lean(_neighbours(window, percent, again, runs, *how)), _NEIGHBOURS)
    near = work.stage(found(orders.repartitionByRange(*order), False), f"near-{tag}")
    level, parts = 0, [near]
    while True:
        # The ends of partitions, a few rows for each, are as many rows in order, with fewer partitions and seams.
        ends = parts[-1].where("kind = 1").dropDuplicates(["tree", "cid", "part"]).select("tree", "key", "cid", "n", "comp", "sketch", "part")
        if (rows := ends.count()) <= SEAM_ROWS:
            parts.append(found(ends.coalesce(1), True, True))
            break
        level += 1
        parts.append(work.stage(found(ends.repartitionByRange(-(-rows * 4 // SEAM_ROWS), *order), True), f"seams-{level}-{tag}"))
    near = reduce(DataFrame.unionAll, parts)
    both = work.stage(near.where("kind <> 1"), f"both-{tag}")
    for name in (f"near-{tag}", *(f"seams-{i + 1}-{tag}" for i in range(level))):
        work.drop(name)
    return both.where("kind = 0").groupBy("a", "b").agg(F.min("rank").alias("rank")), both.where("kind = 2").select("cid").distinct()


def _sets_of(n: int):
    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t if isinstance(t, str) else None, n) for t in batch["text"]]
            if any(fingerprint(s) != p for s, p in zip(sets, batch["print"], strict=True)):
                raise ValueError("the input's rows changed between two reads; write them to a table first")
            yield pd.DataFrame({"cid": batch["cid"], "set": [signed(s) for s in sets]})

    return sets_of


_SETS = "cid long, set array<long>"


def _comp(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """pairs with the components of both ends, where these differ."""
    if comps is None:
        return pairs.withColumns({"ca": F.col("a"), "cb": F.col("b")})
    for x in "ab":
        pairs = pairs.join(comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    return pairs.where("ca <> cb")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, counted: Workspace | None = None) -> DataFrame:
    """Those of pairs whose full sets are similar enough. counted: a set may be in many pairs, which are written
    and counted there first; else windows bound these."""
    known = pairs = counted.stage(pairs, "apart") if counted else pairs
    for x in "ab":
        own = sets.select(F.col("cid").alias(x), F.col("set").alias(f"s{x}"))
        per = counted.stage(known.groupBy(x).agg(F.count("*").alias("pairs")), f"per-{x}") if counted else None
        if per is not None and (per.agg(F.max("pairs")).first()[0] or 0) > HOT_ROWS:
            pairs = join_counted(pairs, own.join(per, x), [x], "pairs", [f"s{x}"], text=True).drop("pairs")
        else:
            pairs = pairs.join(own, x)
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b", "ca", "cb")


def _exact_pairs(sets: DataFrame, with_comp: Callable[[DataFrame], DataFrame], percent: int, work: Workspace) -> DataFrame:
    """All pairs of sets (cid, set) of different components that can be similar enough, and surely
    those that are: such sets share one of their first n - ceil(n * percent / 100) + 1 shingles in any
    one order, here the rarest first; the first that they share leaves enough others after it. What is read
    more than once is written first, or the plan would hold how it is made each time."""
    shingles = sets.select("cid", F.explode("set").alias("g"))
    often = shingles.groupBy("g").agg(F.count("*").alias("often")).where("often > 1")
    # A shingle of one set only comes first in its order and joins nothing: its number is enough.
    shared = shingles.join(often, "g").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("often", "g"))).alias("order"))
    n = F.col("n")
    first = F.floor((F.lit(100 - percent) * n) / 100).cast("int") + 1 - (n - F.size("order"))
    shared = with_comp(shared.join(sets.select("cid", F.size("set").alias("n")), "cid").withColumn("first", first).where("first > 0"))
    keys = shared.select("cid", "comp", "n", (n - F.size("order")).alias("alone"), F.posexplode(F.slice("order", 1, F.col("first"))).alias("at", "x"))
    keys = work.stage(keys.select(F.col("x.g").alias("g"), "cid", "comp", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left")), "prefixes")
    # Only links between components count: of the rows with a shingle, those of its most frequent component
    # need not meet each other. Those of a frequent shingle are dealt by a salt, the others repeated for each.
    seen = keys.groupBy("g", "comp").agg(F.count("*").alias("k")).groupBy("g").agg(F.max_by("comp", F.struct("k", "comp")).alias("most"), F.sum("k").alias("rows"), F.count("*").alias("comps"))
    seen = work.stage(seen.where("comps > 1").select("g", "most", "rows", F.when(F.col("rows") > HOT_ROWS, F.lit(SALTS)).otherwise(1).alias("salts")), "seen")
    keys = work.stage(join_counted(keys, seen, ["g"], "rows", ["most", "salts"]).drop("rows"), "meeting")
    for name in ("prefixes", "seen"):
        work.drop(name)
    one = keys.where(F.col("comp") != F.col("most")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    other = keys.select("g", F.pmod(F.xxhash64("cid"), F.col("salts")).alias("salt"), *[F.col(c).alias(f"{c}_") for c in ("cid", "comp", "n", "left")], (F.col("comp") == F.col("most")).alias("most_"))
    similar = (F.col("most_") | (F.col("cid") < F.col("cid_"))) & (F.col("comp") != F.col("comp_")) & (100 * F.least("n", "n_") >= percent * F.greatest("n", "n_"))
    enough = (100 + percent) * F.least("left", "left_") >= percent * (F.col("n") + F.col("n_"))
    found = one.join(other, ["g", "salt"]).where(similar & enough)
    return found.select(F.least("cid", "cid_").alias("a"), F.greatest("cid", "cid_").alias("b")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: row, check, doc_id, n_shingles, component_id, kept.

    Rows with equal shingle sets are one class; classes are linked when their sets have a Jaccard
    similarity of percent / 100 or more, and component_id is the smallest doc_id reachable. A null or
    wordless text has an empty set and is a group of its own. A null doc_id counts as the largest; of
    rows that share the smallest doc_id of a group, one is kept. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near")
    src = with_row(docs, id_col, text_col, check=True)
    features = work.stage(src.mapInPandas(lean(_featured(shingle)), "row long, doc_id long, check long, n long, print binary, sig binary"), "features")
    best: Column = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = features.where("n > 0").groupBy("print").agg(F.min("row").alias("cid"), F.first("n").alias("n"), F.first("sig").alias("sig"), best.alias("best"))
    classes = work.stage(classes, "classes")
    spread = lambda rows: rows.select("cid", "n", "sig").mapInPandas(lean(_spread), "cid long, n long, sketch binary, tree int, key binary")
    pairs, crowded = _candidates(spread(classes).withColumn("comp", F.col("cid")), work, percent, "0")
    pairs = work.stage(pairs, "pairs-0")
    crowded = work.stage(crowded, "crowded")
    work.drop("both-0")
    comps: DataFrame | None = None
    made: list[str] = []

    def ends_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("cid")).distinct().unionAll(pairs.select(F.col("b").alias("cid")).distinct()).distinct()

    def sets_for(need: DataFrame) -> DataFrame:
        if made:
            need = need.join(work.together("cid long", made), "cid", "left_anti")
        need = need.join(classes.select("cid", "print"), "cid")
        need = work.stage(need, f"need-{len(made)}")
        texts = src.select(F.col("row").alias("cid"), "text").join(small(need), "cid")
        work.stage(texts.select("cid", "print", "text").mapInPandas(lean(_sets_of(shingle)), _SETS), name := f"sets-{len(made)}")
        made.append(name)
        return work.together(_SETS, made)

    count = 0

    def link(pairs: DataFrame, sets: DataFrame, counted: Workspace | None = None) -> bool:
        """Confirm the pairs between components and join these; whether any was."""
        nonlocal comps, count
        count += 1
        links = work.stage(_confirmed(_comp(pairs.select("a", "b"), comps), sets, percent, counted).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), f"links-{count}")
        if not links.limit(1).count():
            return False
        joined = components(links, work, f"cc-{count}")
        if comps is not None:
            to = joined.select(F.col("node").alias("comp"), F.col("comp").alias("now"))
            joined = joined.unionAll(comps.join(to, "comp", "left").select("node", F.coalesce("now", "comp").alias("comp")))
        comps = work.stage(joined, f"comps-{count}")
        return True

    def with_comp(rows: DataFrame) -> DataFrame:
        if comps is None:
            return rows.withColumn("comp", F.col("cid"))
        return rows.join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))

    if pairs.limit(1).count():
        sets = sets_for(ends_of(pairs))
        # Most links of a large group follow from a few neighbours each: the others then lie within
        # one component and need no confirmation.
        for low, high in ((0, 1), (2, 3)):
            link(pairs.where(F.col("rank").between(low, high)), sets)
    if crowded.limit(1).count():
        # Crowded regions once more: all their rows, then the ends of runs of one component, until these
        # give no link. All rows again would be in the same order, each pair tested or in one component.
        orders = work.stage(spread(classes.join(small(crowded), "cid", "left_semi")), "crowded-orders")
        tested, again, idle = ["pairs-0"], 0, False
        while again < 2 or not idle:
            again += 1
            more, _ = _candidates(with_comp(orders), work, percent, str(again), True, again > 1)
            more = work.stage(more.join(work.together("a long, b long", tested), ["a", "b"], "left_anti"), f"pairs-{again}")
            idle = True
            if more.limit(1).count():
                idle = not link(more, sets_for(ends_of(more)))
                tested.append(f"pairs-{again}")
        # Then all that is left between components there, without windows or sketches.
        sets = sets_for(crowded)
        rest = _exact_pairs(sets.join(crowded, "cid", "left_semi"), with_comp, percent, work)
        rest = work.stage(rest.join(work.together("a long, b long", tested), ["a", "b"], "left_anti"), "pairs-exact")
        if rest.limit(1).count():
            link(rest, sets, work)
    home = classes.select("print", "cid", "best")
    if comps is not None:
        home = home.join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left").select("print", F.coalesce("comp", "cid").alias("comp"), "best")
        firsts = home.groupBy("comp").agg(F.min("best").alias("first"))
        home = home.join(firsts, "comp").select("print", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("stays"))
    else:
        home = home.select("print", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("stays"))
    home = work.stage(home, "home")
    work.keep("features", "home")
    full, empty = features.where("n > 0").join(home, "print"), features.where("n = 0")
    full = full.select("row", "check", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("row") == F.col("stays")).alias("kept"))
    return full.unionAll(empty.select("row", "check", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))
