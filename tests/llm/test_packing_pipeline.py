import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mooreflow.llm import packing

tokenizers = pytest.importorskip("tokenizers")


def test_both_files_give_the_same_ids():
    whole = tokenizers.Tokenizer.from_file(packing.default_tokenizer()[0])
    fast = packing.encoder(packing.default_tokenizer())
    rng = random.Random(1)
    odd = ["", " ", "a  b\n\n c", "don't WON'T", "é漢字🎉‍", "x" * 3000, "12345 6,7", "<|endoftext|> a", "\x00\x01", "  \t end  ", "a b c"]
    for t in odd + ["".join(chr(rng.choice([32, 10, 65, 97, 233, 0x4E00, 0x1F600, 39, 48])) for _ in range(80)) for _ in range(300)]:
        assert list(fast(t)) == whole.encode(t, add_special_tokens=False).ids, t


def test_very_long_runs():
    whole = tokenizers.Tokenizer.from_file(packing.default_tokenizer()[0])
    fast = packing.encoder(packing.default_tokenizer())
    for t in (" " * 1_000_000, "x" * 300_000, "a" + "\n \t" * 300_000 + "b", "é" * 100_000):
        assert list(fast(t)) == whole.encode(t, add_special_tokens=False).ids


def test_on_the_test_data(lspark, data):
    whole = tokenizers.Tokenizer.from_file(packing.default_tokenizer()[0])
    fast = packing.encoder(packing.default_tokenizer())
    for r in lspark.read.parquet(f"{data}/documents.parquet").collect():
        assert list(fast(r["text"])) == whole.encode(r["text"], add_special_tokens=False).ids


def test_random_code_points_and_added_tokens():
    path = packing.default_tokenizer()[0]
    whole, fast = tokenizers.Tokenizer.from_file(path), packing.encoder(packing.default_tokenizer())
    added = [t["content"] for t in json.load(open(path, encoding="utf-8"))["added_tokens"]]
    rng = random.Random(5)
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for k in range(2000):
        t = "".join(chr(rng.choice(points) if rng.random() < 0.5 else rng.randrange(0xE000, 0x1FFFF) if rng.random() < 0.2 else rng.randrange(128)) for _ in range(40))
        if k % 10 == 0 and added:
            t = t[:20] + rng.choice(added) + t[20:]
        assert list(fast(t)) == whole.encode(t, add_special_tokens=False).ids, t


def best_fit(histogram, capacity):
    """Bins that best-fit decreasing takes."""
    rooms, n = Counter(), 0
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            room = min((r for r, k in rooms.items() if k and r >= size), default=None)
            if room is None:
                n, room = n + 1, capacity
            else:
                rooms[room] -= 1
            rooms[room - size] += 1
    return n


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_no_more_sequences_than_best_fit(lspark, data, sf):
    docs = lspark.read.parquet(f"{data}/../{sf}/documents.parquet")
    packed = packing.pack(docs).groupBy("length").count().collect()
    histogram = {r["length"]: r["count"] for r in packed}
    assert sum(n for _, n in packing.plan(histogram)) <= best_fit(histogram, 1024)


def test_no_more_bins_than_best_fit_on_random_lengths():
    rng = random.Random(7)
    for k in range(12):
        histogram = Counter(min(1024, int(rng.expovariate(1 / (150 + 60 * k))) + 1) for _ in range(2000))
        assert sum(n for _, n in packing.plan(histogram)) <= best_fit(histogram, 1024)


def best_sum(counts, seed, capacity):
    sums = {seed}
    left = Counter(counts)
    left[seed] -= 1
    for s, n in left.items():
        for _ in range(n):
            sums |= {x + s for x in sums if x + s <= capacity}
    return max(sums)


def test_fullest_bin():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(6)}
        seed = max(counts)
        chosen = packing.fullest(counts, seed, 50)
        assert sum(chosen) == best_sum(counts, seed, 50) and not Counter(chosen) - Counter(counts) and chosen[0] == seed


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    counts = {rng.randint(1, 1024): rng.randint(1, 50_000) for _ in range(300)}
    bins = packing.plan(counts)
    used = Counter()
    for chosen, times in bins:
        assert sum(chosen) <= 1024
        for s in chosen:
            used[s] += times
    assert used == counts and len(bins) < 4000
    least = sum(s * n for s, n in counts.items()) / 1024
    assert sum(t for _, t in bins) < 1.35 * least and packing.plan({}) == [] and packing.plan({5: 1}, 5) == [([5], 1)]


def test_pack(table):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "a")] + [(10 + i, " ".join(rng.choice(["alpha", "beta", "x", "ß"]) for _ in range(rng.choice([1, 30, 400])))) for i in range(150)]
    encode = packing.encoder(packing.default_tokenizer())
    got = packing.pack(table(rows), capacity=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, t in rows:
        ids = [*encode(t or ""), 2]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 256 for r in own[1:]) and (len(own) == 1 or len(ids) > 256)
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))] and sum(r["length"] for r in own) <= 256
    assert len(by_sequence) <= 1.1 * sum(r["length"] for r in got) / 256 + 1
    assert packing.pack(table([])).count() == 0 and packing.pack(table([(1, "a"), (1, "a"), (None, "b")])).count() == 3


def test_pipeline(lspark, data):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = lspark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    work = p.Workspace(lspark, "t")
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        docs = work.stage(stage(lspark, docs, data), name)
        assert docs.columns == columns
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(now) == docs.count() and set(now) <= set(before)
        if name != "line_dedup":
            assert all(before[i] == t for i, t in now.items())
        if not k:
            assert len(now) == len(before)  # every text of the test data is in a language
        before = now
    bench = lspark.read.parquet(f"{data}/benchmark.parquet").collect()
    flat = " ".join(" ".join(t.split()) for t in before.values())
    assert not any(" ".join(r["text"].split()) in flat for r in bench)
    packed = p.run(lspark, data)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(before)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def pipeline_input(lspark, folder, rows):
    """documents and benchmark as the pipeline reads them, with columns whose names the stages use."""
    docs = lspark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("row", "check", "whole", "dropped", "kept", "h", "n", "w"):
        docs = docs.selectExpr("*", f"'x' as `{name}`")
    docs.repartition(3, "doc_id").write.parquet(f"{folder}/documents.parquet")
    lspark.createDataFrame([(0, "what is the sum of the first twelve prime numbers below ninety"), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_on_odd_rows(lspark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(3)
    words = {y: ["".join(rng.choice(a) for _ in range(rng.randint(3, 7))) for _ in range(300)] for y, a in (("en", "abcdefgh"), ("xx", "rstuvwz"))}
    text = lambda y: " ".join(rng.choice(words[y]) for _ in range(40))
    rows = [(i, text(y), y, "s") for i in range(60) for y in [("en", "xx")[i % 2]]]
    rows += [(100, None, "en", "s"), (101, "", "en", "s"), (102, "12 ½ 34 !?", "en", None), (None, text("en"), None, None), (None, text("xx"), "xx", "s")]
    rows += [rows[0], rows[0], (200, rows[2][1], "en", "s"), (201, "so what is the sum of the first twelve prime numbers below ninety then", "en", "s"), (202, "\n".join([rows[4][1], text("en")]), "en", "s")]
    folder = pipeline_input(lspark, tmp_path / "a", rows)
    docs = lspark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in p.STAGES[:-1]:
        docs = p.Workspace(lspark, "t").stage(stage(lspark, docs, folder), name)
        assert docs.columns == columns
        seen.append(sorted((r["doc_id"] for r in docs.collect()), key=str))
    assert not {100, 101, 102} & set(seen[0]) and len(seen[0]) == len(rows) - 3
    assert 200 not in seen[1] and seen[1].count(0) == 1 and 202 in seen[1] and seen[1].count(None) == 2
    assert seen[2] == seen[1] and 201 in seen[2] and set(seen[2]) - set(seen[3]) == {201}
    packed = p.run(lspark, folder)
    assert sorted((r["doc_id"] for r in packed.where("piece = 0").collect()), key=str) == seen[3]


def test_pipeline_without_rows_or_labels(lspark, tmp_path):
    import corpus_pipeline as p

    assert p.run(lspark, pipeline_input(lspark, tmp_path / "a", [])).count() == 0
    rows = [(i, f"some text about {i} and nothing else than {i * i} here", None, "s") for i in range(20)] + [(30, None, None, None)]
    folder = pipeline_input(lspark, tmp_path / "b", rows)
    assert p.language_id(lspark, lspark.read.parquet(f"{folder}/documents.parquet"), folder).count() == 21


def test_each_stage_begins_with_collected_executors(lspark, tmp_path, monkeypatch):
    """What a stage leaves in the executors' heaps must not count against the next one."""
    import corpus_pipeline as p
    from mooreflow.llm import common

    monkeypatch.setattr(common, "HEAP_SHARE", 1.0)  # no collection for the driver's sake, which is the same JVM here
    beans = lspark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collected = lambda: sum(x.getCollectionCount() for x in beans if "Old" in x.getName() or "MarkSweep" in x.getName())
    folder = pipeline_input(lspark, tmp_path / "a", [(i, f"some text about {i} and nothing else", "en", "s") for i in range(4)])
    docs = lspark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in p.STAGES:
        before = collected()
        assert stage(lspark, docs, folder).columns and collected() > before, name


def test_a_changed_input_raises(lspark, tmp_path):
    """Rows that are found again by number must have the text that they had."""
    from mooreflow.llm.common import with_row, without

    docs = lspark.createDataFrame([(i, f"t{i}") for i in range(9)], "doc_id long, text string").coalesce(1)
    bad = with_row(docs, "doc_id", "text", check=True).where("doc_id % 2 = 0").select("row", "check")
    assert sorted(r["doc_id"] for r in without(docs, bad, "text").collect()) == [1, 3, 5, 7]
    with pytest.raises(Exception, match="changed between two reads"):
        without(docs.orderBy(F.desc("doc_id")).coalesce(1), bad.where("row = 0"), "text").collect()


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
