"""Language identification with a linear-chain conditional random field.

Words are labelled one by one: emissions are sums of learned weights over affix, character n-gram
and lexicon features, transitions between the languages of adjacent words are learned too, and
forward-backward gives each word's marginals, so code-switched text gets a label per word. A
document's language is the one with the largest mean marginal.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mooreflow.llm.common import give_back, lean, mix, steps, with_row

UNKNOWN = "und"
#: Bounds of the training sample: rows for each label and in all, characters of a row, words of a segment.
ROWS_PER_LABEL, ROWS, SAMPLE_CHARS, SEGMENT = 700, 6_000, 1_000, 16
FEATURES = 1 << 17
#: Segments whose marginals are in memory at once in training.
FIT_SEGMENTS = 8_192
#: Words whose features are in a worker's memory at once.
FEATURED_WORDS = 4_096
#: Words of the lexicon, taken from the training sample.
LEXICON = 20_000
CHUNK = 64
_RUN = re.compile(r"[^\W\d_]+")
_PIECE = 32
_MEMO = 200_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case; a run of over _PIECE letters, as scripts without spaces have, in pieces."""
    if not text:
        return []
    low = text.lower()
    found = _RUN.findall(low)
    if not low.isascii():  # numerals such as fractions and circled digits are in the pattern, but no letters
        found = [w for r in found for w in ([r] if r.isalpha() else "".join(c if c.isalpha() else " " for c in r).split())]
    if any(len(w) > _PIECE for w in found):
        found = [w[i : i + _PIECE] for w in found for i in range(0, len(w), _PIECE)]
    return found


def _slots(kind: int, *codes: np.ndarray) -> np.ndarray:
    h = np.full(len(codes[0]), kind, np.uint64)
    for c in codes:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    return (h & np.uint64(FEATURES - 1)).astype(np.int64)


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of all features of the words, sorted by word: affixes of 1 to 3 letters, character
    bigrams and trigrams with the word's ends, its length, and its entry in the lexicon, given as sorted
    hashes."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    start = end - size
    of = np.repeat(np.arange(len(words)), size)
    found = []
    for n in (2, 3):
        at = np.flatnonzero(of[n - 1 :] == of[: len(of) - n + 1])
        found.append((of[at], _slots(n, *[codes[at + i] for i in range(n)])))
    for n in (1, 2, 3):
        long = np.flatnonzero(size >= n + 2)
        found.append((long, _slots(10 + n, *[codes[start[long] + 1 + i] for i in range(n)])))
        found.append((long, _slots(20 + n, *[codes[end[long] - 1 - n + i] for i in range(n)])))
    all_ = np.arange(len(words))
    found.append((all_, _slots(30, np.minimum(size, 14))))
    h = word_hashes(words)
    known = lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h if len(lexicon) else np.zeros(len(h), bool)
    found.append((all_, _slots(40, np.where(known, h, np.uint64(0)))))
    word, slot = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(word, kind="stable")
    return word[order], slot[order]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _sums(weights: np.ndarray, word: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Summed weights of each word's features; every word has some."""
    return np.add.reduceat(weights[slot], np.flatnonzero(np.diff(word, prepend=-1)), axis=0)


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: np.ndarray  # FEATURES x labels
    transitions: np.ndarray  # labels x labels
    lexicon: np.ndarray  # sorted hashes of words


def _log_z(e: np.ndarray, a: np.ndarray):
    """Forward-backward over segments of equal length. e: n x T x L potentials, a: L x L, both
    positive. Returns log Z, marginals (n x T x L) and the sum of pair marginals (L x L)."""
    n, t, k = e.shape
    alpha, scale = np.empty_like(e), np.empty((n, t))
    for i in range(t):
        x = e[:, i] if i == 0 else (alpha[:, i - 1] @ a) * e[:, i]
        scale[:, i] = x.sum(1)
        alpha[:, i] = x / scale[:, i, None]
    beta, pairs = np.ones((n, k)), np.zeros((k, k))
    marginals = np.empty_like(e)
    marginals[:, -1] = alpha[:, -1]
    for i in range(t - 1, 0, -1):
        eb = e[:, i] * beta / scale[:, i, None]
        pairs += a * (alpha[:, i - 1].T @ eb)
        beta = eb @ a.T
        m = alpha[:, i - 1] * beta
        marginals[:, i - 1] = m / m.sum(1, keepdims=True)
    return np.log(scale).sum(), marginals, pairs


def fit(rows: list[tuple[str, str]], epochs: int = 40, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> Model:
    """Train on (text, label). Segments of different rows are joined, so that the transitions see
    changes of language. Full-batch Adam on the conditional log likelihood."""
    rng = np.random.default_rng(seed)
    labels = tuple(sorted({y for _, y in rows}))
    segments: list[tuple[list[str], int]] = []
    same: dict[str, str] = {}  # one object for a word, however often it occurs
    for text, y in rows:
        w = [same.setdefault(v, v) for v in words_of(text)]
        segments += [(w[i : i + SEGMENT // 2], labels.index(y)) for i in range(0, len(w) - SEGMENT // 2 + 1, SEGMENT // 2)]
        if 0 < len(w) < SEGMENT // 2:  # a short text still counts, its words repeated to the length
            segments.append(((w * SEGMENT)[: SEGMENT // 2], labels.index(y)))
    segments = [segments[i] for i in rng.permutation(len(segments))]
    lexicon = np.sort(word_hashes([w for w, c in Counter(w for s, _ in segments for w in s).most_common(LEXICON) if c > 1]))
    # Most neighbours share their language: sort half of the pairs by it, leave the other half mixed.
    half = len(segments) // 2
    order = sorted(range(half), key=lambda i: segments[i][1]) + list(range(half, len(segments)))
    order = order[: len(order) // 2 * 2]
    if not order:
        return Model(labels, np.zeros((FEATURES, len(labels)), np.float32), np.zeros((len(labels), len(labels)), np.float32), lexicon)
    types: dict[str, int] = {}
    x = np.array([[types.setdefault(w, len(types)) for w in segments[i][0]] for i in order]).reshape(-1, SEGMENT)
    y = np.repeat([segments[i][1] for i in order], SEGMENT // 2).reshape(-1, SEGMENT)
    known, found = list(types), []
    for i in range(0, len(known), FIT_SEGMENTS):
        word, slot = features(known[i : i + FIT_SEGMENTS], lexicon)
        found.append((word + i, slot))
    at, ids = (np.concatenate(c) for c in zip(*found, strict=True))
    del found, same
    k, n = len(labels), x.size
    w, a = np.zeros((FEATURES, k)), np.zeros((k, k))
    gold = np.zeros((len(types), k))
    np.add.at(gold, (x.ravel(), y.ravel()), 1.0)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]
    for step in range(1, epochs + 1):
        score = _sums(w, at, ids)
        score -= score.max(1, keepdims=True)
        potentials, per_type, pairs = np.exp(np.maximum(score, -30)), -gold, np.zeros((k, k))
        for i in range(0, len(x), FIT_SEGMENTS):  # sums over parts of the segments, to bound the driver's memory
            part = x[i : i + FIT_SEGMENTS]
            _, m, own = _log_z(potentials[part], np.exp(a))
            pairs += own
            per_type += np.stack([np.bincount(part.ravel(), m[:, :, j].ravel(), len(types)) for j in range(k)], 1)
        gw = np.stack([np.bincount(ids, per_type[at, j], FEATURES) for j in range(k)], 1) / n + decay * w
        ga = (pairs - gold_pairs) / n
        for p, g, i in ((w, gw, 0), (a, ga, 2)):
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 1] = 0.99 * moments[i + 1] + 0.01 * g * g
            p -= rate * (moments[i] / (1 - 0.9**step)) / (np.sqrt(moments[i + 1] / (1 - 0.99**step)) + 1e-9)
    del segments, types, x, y, at, ids, gold, per_type, gw, moments
    give_back()  # the driver has more to do than this
    return Model(labels, w.astype(np.float32), a.astype(np.float32), lexicon)


def marginals(e: np.ndarray, a: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Exact marginals of every word of many texts. e: all words' potentials (words x L), laid end to
    end; counts: words of each text, all positive. Texts are cut into chunks whose transfer matrices
    are multiplied first, so that the loop runs over CHUNK positions and over the chunks of the
    longest text, with all texts at once, instead of over all words."""
    k = e.shape[1]
    per = -(-counts // CHUNK)
    total = int(per.sum())
    first = np.cumsum(per) - per
    text = np.repeat(np.arange(len(counts)), per)
    begin = np.repeat(np.cumsum(counts) - counts, per) + (np.arange(total) - first[text]) * CHUNK
    size = np.minimum(CHUNK, np.repeat(np.cumsum(counts), per) - begin)
    place = begin[:, None] + np.arange(CHUNK)
    live = np.arange(CHUNK) < size[:, None]
    pot = np.where(live[:, :, None], e[np.minimum(place, len(e) - 1)], 1.0)
    norm = lambda x: x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)
    move = np.broadcast_to(np.eye(k), (total, k, k))  # product of (a, then potential) over the chunk
    for i in range(CHUNK):
        move = np.where(live[:, i, None, None], norm((move @ a) * pot[:, i, None, :]), move)
    left, right = np.full((total, k), 1.0 / k), np.full((total, k), 1.0 / k)  # before a chunk, after it
    # Before a text every label is as likely, whatever the transitions: a's inverse is not needed.
    for j in range(1, int(per.max())):
        c = (first + j)[per > j]
        x = norm(left[c - 1][:, None, :] @ _entered(move[c - 1], pot[c - 1], a, j == 1, live[c - 1]))
        left[c] = x[:, 0]
        d = (first + per - 1 - j)[per > j]
        right[d] = norm(move[d + 1] @ right[d + 1][:, :, None])[:, :, 0]
    out = np.empty_like(e)
    alpha = np.empty((total, CHUNK, k))
    x = left
    starts = np.isin(np.arange(total), first)
    for i in range(CHUNK):
        came = np.where(starts[:, None], 1.0 / k, x @ a) if i == 0 else x @ a
        x = np.where(live[:, i, None], norm(came * pot[:, i]), x)
        alpha[:, i] = x
    x = right
    for i in range(CHUNK - 1, -1, -1):
        out[place[live[:, i], i]] = norm(alpha[:, i] * x)[live[:, i]]
        x = np.where(live[:, i, None], norm((pot[:, i] * x) @ a.T), x)
    return out


def _entered(move, pot, a, at_start, live):
    """The chunk's transfer; the first chunk of a text is entered without a transition."""
    if not at_start:
        return move
    k = a.shape[0]
    x = np.broadcast_to(np.eye(k), move.shape) * pot[:, 0, None, :]
    for i in range(1, CHUNK):
        y = (x @ a) * pot[:, i, None, :]
        x = np.where(live[:, i, None, None], y / y.sum((1, 2), keepdims=True), x)
    return x


class Tagger:
    """Emissions are kept by word, for as many words as fit the memo."""

    def __init__(self, model: Model):
        self.model, self.known, self.table = model, {}, np.zeros((0, len(model.labels)), np.float32)
        self.a = np.exp(model.transitions.astype(np.float64))

    def potentials(self, words: list[str]) -> np.ndarray:
        if len(self.known) > _MEMO:
            self.known, self.table = {}, self.table[:0]
        known = self.known
        index = [known.setdefault(w, len(known)) for w in words]
        if (new := len(known) - len(self.table)) > 0:
            fresh, tables = list(islice(reversed(known), new))[::-1], [self.table]
            for i in range(0, new, FEATURED_WORDS):
                score = _sums(self.model.weights, *features(fresh[i : i + FEATURED_WORDS], self.model.lexicon))
                score -= score.max(1, keepdims=True)
                tables.append(np.exp(np.maximum(score, -30)))
            self.table = np.concatenate(tables)
        return self.table[np.array(index)].astype(np.float64)

    def tag(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """Words and their marginals, for each text."""
        words = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        k = len(self.model.labels)
        if not counts.sum() or not k:
            return [(w, np.zeros((len(w), k))) for w in words]
        m = marginals(self.potentials([w for ws in words for w in ws]), self.a, counts[counts > 0])
        return list(zip(words, np.split(m, np.cumsum(counts)[:-1]), strict=True))


def training_sample(docs: DataFrame, learn: Column, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> list[tuple[str, str]]:
    """At most ROWS rows with a label and text for which `learn` holds, about ROWS_PER_LABEL for each
    label, each a piece of at most SAMPLE_CHARS characters from a place given by its hash."""
    rows = docs.where(learn).select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")).where("label is not null and text is not null")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for y, n in counts.items() for x in (F.lit(y), F.lit(min(1.0, 1.2 * ROWS_PER_LABEL / n)))])
    part = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    at = F.pmod("h", F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    some = rows.where(part < share[F.col("label")]).select("h", F.substr("text", at.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"), "label")
    return [(r["text"], r["label"]) for r in some.orderBy("h", "text", "label").limit(ROWS).collect()]


def _predict(shared):
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value)
        labels = tagger.model.labels
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch.pop("text")]
            best, score = [], []
            for i, j in steps(texts):
                for words, m in tagger.tag(texts[i:j]):
                    if words and labels:
                        mean = m.mean(0)
                        best.append(labels[int(mean.argmax())])
                        score.append(float(min(1.0, mean.max())))
                    else:
                        best.append(UNKNOWN)
                        score.append(0.0)
            yield batch.assign(lang_pred=best, score=score)

    return predict


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, check, doc_id, lang_pred and score for each row of docs. A text that is null or has no letter
    is `und` with score 0, as is all text if the model has no labels. Rows that repeat, or have no id, each
    give their row; ties go to the first label in order; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = with_row(docs, id_col, text_col, check=True)
    return src.mapInPandas(lean(_predict(shared)), "row long, doc_id long, check long, lang_pred string, score double")
