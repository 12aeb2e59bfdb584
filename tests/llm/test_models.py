"""Language identification and language-model scores."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mooreflow.llm import langid, lm_score
from mooreflow.llm.common import ascii_words

WORDS = {"aa": "alba arka amara alta asta", "bb": "bolo brob bomo blob bobo", "cc": "cici criki cimi clik cinci"}


def text(rng, label, n):
    return " ".join(rng.choice(WORDS[label].split()) + rng.choice(["", "", rng.choice(WORDS[label].split())]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return langid.fit([(text(rng, y, 40), y) for y in WORDS for _ in range(30)], epochs=25)


def test_marginals_are_exact():
    """Against the sum over all label sequences, and chunked against a plain forward-backward."""
    rng = np.random.default_rng(0)
    a = rng.random((3, 3)) + 0.1
    e = rng.random((4, 3)) + 0.1
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = math.prod(e[i, y] for i, y in enumerate(path)) * math.prod(a[x, y] for x, y in zip(path, path[1:], strict=False))
        for i, y in enumerate(path):
            want[i, y] += p
    assert np.allclose(langid.marginals(e, a, np.array([4])), want / want.sum(1, keepdims=True))
    counts = np.array([200, 1, 64, 65, 130])
    e = rng.random((counts.sum(), 3)) + 0.1
    got, at = langid.marginals(e, a, counts), 0
    for c in counts:
        assert np.allclose(got[at : at + c], langid._log_z(e[None, at : at + c], a)[1][0])
        at += c


def test_many_new_words_take_little_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(4)
    words = [f"wort{''.join(chr(97 + c) for c in rng.integers(0, 26, 6))}" for _ in range(60_000)]
    own = langid.Model(("a", "b", "c", "d"), rng.random((langid.FEATURES, 4)).astype(np.float32), np.zeros((4, 4), np.float32), np.sort(langid.word_hashes(words[:1_000])))
    tracemalloc.start()
    got = langid.Tagger(own).potentials(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    monkeypatch.setattr(langid, "FEATURED_WORDS", len(words))
    assert np.array_equal(got, langid.Tagger(own).potentials(words))


def test_gradient_of_the_likelihood():
    rng = np.random.default_rng(3)
    s, t = rng.random((2, 5, 3)), rng.random((3, 3))
    z, m, pairs = langid._log_z(np.exp(s), np.exp(t))
    for index, got in (((0, 2, 1), m[0, 2, 1]), ((1, 4, 0), m[1, 4, 0])):
        s2 = s.copy()
        s2[index] += 1e-6
        assert abs((langid._log_z(np.exp(s2), np.exp(t))[0] - z) / 1e-6 - got) < 1e-4
    t2 = t.copy()
    t2[1, 2] += 1e-6
    assert abs((langid._log_z(np.exp(s), np.exp(t2))[0] - z) / 1e-6 - pairs[1, 2]) < 1e-4


def test_code_switched_words_get_their_own_labels(model):
    rng = random.Random(5)
    (words, m) = langid.Tagger(model).tag([text(rng, "aa", 30) + " " + text(rng, "bb", 30)])[0]
    found = [model.labels[i] for i in m.argmax(1)]
    assert Counter(found[:25]).most_common(1)[0][0] == "aa" and Counter(found[-25:]).most_common(1)[0][0] == "bb" and len(words) == 60
    assert model.transitions.diagonal().min() > (model.transitions - np.diag([9] * 3)).max()


def test_documents(table, model):
    rng = random.Random(7)
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "x" * 100_000), (5, text(rng, "cc", 4000))] + [(10 + i, text(rng, y, 20)) for i, y in enumerate(list(WORDS) * 5)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.detect(table(rows), model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3)) and got[4][0] in WORDS and got[5][0] == "cc"
    assert all(got[10 + i][0] == y and 0 < got[10 + i][1] <= 1 for i, y in enumerate(list(WORDS) * 5))
    assert langid.detect(table([]), model).count() == 0


def test_nothing_to_learn_from(table):
    empty = langid.fit(langid.training_sample(table([(1, None)]), F.lit(True)))
    assert langid.detect(table([(1, "word")]), empty).first()["lang_pred"] == "und"
    short = langid.fit([("hi", "en"), ("yo", "es")])
    assert short.labels == ("en", "es")


def test_letters_only():
    assert langid.words_of("½ ① Ⅷ ² 12 _ !") == [] and langid.words_of("a½b Été 漢字") == ["a", "b", "été", "漢字"]
    assert langid.words_of("x" * 70) == ["x" * 32, "x" * 32, "x" * 6]


def test_held_out_accuracy(lspark):
    from mooreflow.llm.queries import op2_language_id

    d = "/root/testdata/sf0.01"
    docs = lspark.read.parquet(f"{d}/documents.parquet")
    got = op2_language_id(lspark, d).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.96


def score_brute(rows):
    token = {i: ascii_words(t) for i, t in rows}
    grams = lambda w: [tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    total = Counter(g for w in token.values() for g in grams(w))
    words = sum(map(len, token.values()))
    out = {}
    for i, w in token.items():
        own = Counter(grams(w))

        def s(g, own=own, w=w):
            c = total[g] - own[g]
            if len(g) == 1:
                return max(c, 0.5) / max(1, words - len(w))
            return c / (total[g[:-1]] - own[g[:-1]]) if c > 0 else 0.4 * s(g[1:])

        out[i] = (len(w), sum(math.log(s(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w))))
    return out


@pytest.mark.parametrize("chunk", [200, 8_000_000, None])
def test_scores(table, monkeypatch, chunk):
    score = lm_score.score if chunk else lm_score.score_exploded
    chunk = chunk or 300
    rng = random.Random(chunk)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(1, None), (2, ""), (3, "one"), (4, "w1 w2"), (5, "w1 w2"), (6, "z" * 5000)] + [(10 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 40, 300])))) for i in range(60)]
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", chunk)
    got = {r["doc_id"]: (r["n_words"], r["log_score"]) for r in score(table(rows)).collect()}
    want = score_brute(rows)
    assert got.keys() == want.keys()
    for i, (n, s) in want.items():
        assert got[i][0] == n and math.isclose(got[i][1], s, rel_tol=1e-9, abs_tol=1e-9), i
    assert score(table([])).count() == 0


def test_packing_of_counts():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 1000).astype(np.uint64))
    assert (lm_score.unpack_sorted(lm_score.pack_sorted(x)) == x).all() and len(lm_score.unpack(lm_score.pack(x[:0]))) == 0
    for n in range(12):
        assert (lm_score.unpack(lm_score.pack(x[:n])) == x[:n]).all()
    parts = lm_score.part_of(x, 64)
    assert parts.max() < 64 and (np.diff(parts.astype(int)) >= 0).all()
