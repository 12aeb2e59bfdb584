"""Secret scans: fixed patterns, and a password guess-cost estimate for credential-context values.

The cost of a value is the least number of guesses, in decimal digits, over all ways to cut it into
words, dates, repeats, keyboard walks and brute-force spans; a dynamic programme over its positions
finds it. Values in a credential context that cost enough are secrets; guessable ones ("changeme")
are placeholders.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooreflow.llm.common import with_row

# Patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of hex digits is one match, so its first 32 decide
KINDS = ("assign", "access", "hex")

# An identifier and what separates it from a value. All repeats are possessive and an identifier begins
# only where none goes on, so that long runs take linear time.
CONTEXT = re.compile(r"""(?<![\w-])([\w-]++)["']?+(?:[\x20\t]*+[:=][\x20\t]*+|[\x20\t]++(?:is|was)[\x20\t]++)["'`]?+""", re.IGNORECASE | re.ASCII)
VALUE = re.compile(r"""[^\s"'`<>,;]++""", re.ASCII)
# Words in an identifier that make it a credential's. What follows begins a new word, and where the word is
# part of common ones (compass), what stands before ends one.
_END = r"(?:(?![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))"
_BEGIN = r"(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))"
CREDENTIAL = re.compile(
    rf"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credential)s?{_END}|{_BEGIN}(?:pass|auth|bearer){_END}(?!-)",
    re.IGNORECASE | re.ASCII,
)
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
#: Decimal digits of guesses from which a value in context counts as a secret; its least length.
MIN_DIGITS, MIN_LENGTH = 10.0, 8
#: Words of the corpus that join the dictionary, the most frequent ones, if they are in so many documents.
DICTIONARY, IN_DOCUMENTS = 20_000, 3
#: Letters of the longest word of the dictionary; all other segments have any length.
LONGEST = 24

# Frequent words in passwords and placeholders, the most frequent first; the corpus's own words
# rank after them.
WORDS = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login princess football shadow sunshine iloveyou "
    "superman batman trustno1 hello freedom whatever secret test guest root changeme default example sample user pass "
    "token key access private public your my the insert here replace placeholder none null true false required optional "
    "value string hidden redacted unknown summer winter spring autumn love money star baseball soccer hockey ninja mustang "
    "michael jordan daniel jessica charlie thomas robert george andrew computer internet service server client database "
    "system account company office home work house family friend dog cat tiger lion eagle horse red blue green black white "
    "orange purple silver gold king queen prince angel devil heaven magic power world music game player happy lucky correct "
    "battery staple open close start stop new old big little this that with from have not and for you are was one two three"
).split()
RANKS = {w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))}
# Rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_LEET = str.maketrans("@4310$5!7", "aaeiossit")
_NEXT = {(r[i], r[i + d]) for r in ROWS for i in range(len(r)) for d in (-1, 1) if 0 <= i + d < len(r)}
_NEXT |= {(a, b) for x, y in zip(ROWS, ROWS[1:], strict=False) for i, a in enumerate(x) for b in y[max(0, i - 1) : i + 1]}
_NEXT |= {(b, a) for a, b in _NEXT}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


def _alphabet(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


def _word_cost(part: str, ranks: dict[str, int] = RANKS) -> float | None:
    low = part.lower()
    plain = low.translate(_LEET)
    rank = min((r for r in (ranks.get(low), ranks.get(plain), ranks.get(low[::-1])) if r), default=None)
    if rank is None:
        return None
    cases = 1 if part == low else 2 if part[0].isupper() and part[1:] == low[1:] or part.isupper() else 2 ** min(len(part), 10)
    return math.log10(rank * cases * (1 if low in ranks else 2) + 1)


def guess_digits(value: str, ranks: dict[str, int] = RANKS) -> tuple[float, list[tuple[str, int, int]]]:
    """Least cost in decimal digits of guesses, and the segments (kind, start, end) that reach it. ranks:
    the dictionary's words by frequency. An empty value costs nothing."""
    n = len(value)
    low = value.lower()
    best = [0.0] + [math.inf] * n
    came: list[tuple[str, int]] = [("", 0)] * (n + 1)
    brute, since = math.inf, 0  # least cost that ends here in a brute-force span; its start
    steps = 0.3  # of each segment more: the attacker has to guess the cut too
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if m := _DATE.match(value, i):
            dates.setdefault(i, []).extend({m.end(), *([i + 4] if re.match(r"(?:19|20)\d\d", value[i : i + 4]) else [])})
    for i in range(n):
        base = best[i] + (steps if i else 0.0)

        def offer(kind: str, end: int, cost: float, base: float = base, i: int = i) -> None:
            if base + cost < best[end]:
                best[end], came[end] = base + cost, (kind, i)

        if base < brute:
            brute, since = base, i
        brute += _alphabet(value[i])
        if brute < best[i + 1]:
            best[i + 1], came[i + 1] = brute, ("brute", since)
        for end in range(i + 3, min(n, i + LONGEST) + 1):
            if (cost := _word_cost(value[i:end], ranks)) is not None:
                offer("word", end, cost)
        for end in dates.get(i, ()):
            offer("date", end, math.log10(120 * (365 if end - i > 4 else 1)))
        end = i + 1
        while end < n and (low[end - 1], low[end]) in _NEXT:
            end += 1
            if end - i >= 3:
                offer("walk", end, math.log10(40 * (end - i) * 4))
                # A walk from further back that is no dearer here is none further on: it gains on this one.
                if came[end][0] == "walk" and came[end][1] < i:
                    break
        for unit in (1, 2, 3, 4):
            if i < unit or value[i : i + unit] != value[i - unit : i]:  # only where a run begins
                end = i + unit
                while end + unit <= n and value[end : end + unit] == value[i : i + unit]:
                    end += unit
                if end - i >= max(3, 2 * unit):
                    own = _word_cost(value[i : i + unit], ranks) or sum(map(_alphabet, value[i : i + unit]))
                    offer("repeat", end, own + math.log10((end - i) // unit))
    segments, j = [], n
    while j > 0:
        kind, k = came[j]
        segments.append((kind, k, j))
        j = k
    return best[n], segments[::-1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind as listed; offsets are code points."""
    found = []
    low = text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def costly_spans(text: str, digits: float = MIN_DIGITS, ranks: dict[str, int] = RANKS) -> list[tuple[str, int, int]]:
    """Values in a credential context whose guess cost reaches the threshold, as kind `costly`."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    found, at = [], 0
    while m := CONTEXT.search(text, at):
        at = m.end()
        if not CREDENTIAL.search(m[1]) or not (v := VALUE.match(text, at)):
            continue
        at = v.end()
        value = v[0].rstrip(".:!?)]}")
        if len(value) >= MIN_LENGTH and guess_digits(value, ranks)[0] >= digits:
            found.append(("costly", v.start(), v.start() + len(value)))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for s, e in sorted((s, e) for _, s, e in spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


_LETTERS = re.compile(r"[a-z]{3,%d}" % LONGEST)


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of the partition that have each word, in parts."""
    total: Counter[str] = Counter()
    for batch in batches:
        for text in batch["text"]:
            if isinstance(text, str):
                total.update(set(_LETTERS.findall(text.lower())))
        if len(total) > 200_000:
            yield pd.DataFrame({"word": list(total), "n": list(total.values())})
            total = Counter()
    yield pd.DataFrame({"word": list(total), "n": list(total.values())}).astype({"word": object, "n": "int64"})


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY, documents: int = IN_DOCUMENTS) -> dict[str, int]:
    """Ranks of the fixed words, then of the corpus's most frequent words of 3 to LONGEST letters, at most
    `words`, by the number of documents that have them, over all documents. Ties go by the word."""
    counts = docs.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= documents)
    ranks = dict(RANKS)
    for r in counts.orderBy(F.desc("n"), "word").limit(words).collect():
        ranks.setdefault(r["word"], len(ranks) + 1)
    return ranks


def _scan(with_text: bool, shared):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = shared.value
        for batch in batches:
            rows, texts = [], []
            for text in batch["text"]:
                t = text if isinstance(text, str) else ""
                base = base_spans(t)
                more = costly_spans(t, ranks=ranks)
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                order = {k: i for i, k in enumerate((*KINDS, "costly"))}
                all_ = sorted(base + more, key=lambda x: (x[1], order[x[0]], x[2]))
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_), len(more)))
                if with_text:
                    texts.append(redact(t, all_))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_costly"])
            out.insert(0, "row", batch["row"].to_numpy())
            out.insert(1, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out.assign(clean_text=texts) if with_text else out

    return scan


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """row, doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_costly for each row of docs, and
    with with_text the redacted text as clean_text. A null text is empty and has no spans. Rows that
    repeat, or have no id, each give their row; an empty table gives an empty result. Values are guessed with
    the dictionary of the whole corpus, which takes a pass of its own; the scan itself shuffles nothing."""
    schema = "row long, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_costly long"
    src = with_row(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text_col))  # at most DICTIONARY words and the fixed ones
    return src.mapInPandas(_scan(with_text, shared), schema + (", clean_text string" if with_text else ""))
