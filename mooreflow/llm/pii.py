"""Personal data: fixed patterns, and information-theoretic sanitisation of the words beside them.

Each value that a pattern finds is a protected entity. Over the whole corpus, a term's disclosure of
an entity is log2 P(entity with term) / P(entity), its pointwise mutual information over documents, with
P(entity given term) beside it. A term in a document of the entity that has enough support and exceeds both thresholds
reveals the entity even when the value itself is masked: it is generalised, or removed where it
all but determines the entity.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mooreflow.llm.common import Workspace, again, small, with_row

# Patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # from inside a run of digits none begins
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

#: Terms on either side of a term that are its context; letters and digits of the shortest term.
NEAR, TERM_CHARS = 6, 2
#: Distinct contexts that a term and entity must share; P(entity | term); bits of mutual information.
SUPPORT, SHARE, BITS = 3, 0.5, 8.0
#: From this share on a term is removed, below it generalised.
REMOVE_SHARE = 0.9
_TERM = re.compile(r"[^\W_]{%d,}" % TERM_CHARS)
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


_BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, found from each @ outwards: in linear time, for long runs without an @ too."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _BEFORE_AT:
            start -= 1
        if start < at and (m := EMAIL.match(text, max(start, at - 1))):
            end = m.end()
            yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind as listed, then start; offsets are code points."""
    found = []
    if "@" in text:
        found += [("email", s, e) for s, e in emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 64 and 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return found


def entity_key(kind: str, value: str) -> str:
    """The same entity however it is written: letter case and separators don't count."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _DIGITS.sub('', value)}"


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """(term, start, end, context) of the terms of a text outside all spans. Copies of a passage are one
    context: it is known by the terms around the term's first place."""
    taken = sorted((s, e) for _, s, e in spans)
    found, k = [], 0
    end = 0
    for m in _TERM.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            end = max(end, taken[k][1])
            k += 1
        if m.start() >= end:
            found.append((m[0].lower(), m.start(), m.end()))
    words = [w for w, _, _ in found]
    context: dict[str, int] = {}
    for n, w in enumerate(words):
        if w not in context:
            context[w] = xxhash.xxh64_intdigest("\0".join(words[max(0, n - NEAR) : n + NEAR + 1])) >> 1
    return [(w, s, e, context[w]) for w, s, e in found]


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row, doc_id, check, text in zip(batch["row"], batch["doc_id"], batch["check"], batch["text"], strict=True):
            t = text if isinstance(text, str) else ""
            base = base_spans(t)
            n = Counter(k for k, _, _ in base)
            joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
            keys = sorted({entity_key(k, t[s:e]) for k, s, e in base})
            own = terms_of(t, base) if keys else []
            out.append((row, doc_id, check, *(n[k] for k in KINDS), joined, hashlib.sha256(joined.encode()).hexdigest(), keys, [{"term": w, "s": s, "e": e, "context": c} for w, s, e, c in own]))
        frame = pd.DataFrame(out, columns=["row", "doc_id", "check", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "entities", "own"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of the partition in which each term occurs, as (hash, count)."""
    total: Counter[str] = Counter()
    for batch in batches:
        for text in batch["text"]:
            if isinstance(text, str):
                total.update({w.lower() for w in _TERM.findall(text)})
        if len(total) > 200_000:
            yield _hashed(total)
            total = Counter()
    yield _hashed(total)


def _hashed(total: Counter) -> pd.DataFrame:
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in total), np.uint64, len(total)).view(np.int64)
    return pd.DataFrame({"h": h, "n": np.fromiter(total.values(), np.int64, len(total))})


def _hash(term: pd.Series) -> pd.Series:
    return pd.Series(np.array([xxhash.xxh64_intdigest(w) for w in term], np.uint64).view(np.int64))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, share: float = SHARE, bits: float = BITS) -> DataFrame:
    """row, check, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, base, terms (the disclosing terms'
    start, end and whether they are to be removed) and spans for each row of docs.

    A null text is empty. Counts are over all rows: entities by documents that hold them, terms by
    documents, pairs by distinct contexts of the term (so copies of one passage count once), wherever in
    a document the two stand. An entity in a third of the documents has low information by definition.
    Rows that repeat, or have no id, are documents of their own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "pii")
    src = with_row(docs, id_col, text_col, check=True)
    found = src.mapInPandas(_find, "row long, doc_id long, check long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, entities array<string>, own array<struct<term:string,s:int,e:int,context:long>>")
    found = work.stage(found, "found")
    total = found.count()
    holds = found.where("size(entities) > 0").select("row", F.explode("entities").alias("entity"))
    entities = work.stage(holds.groupBy("entity").agg(F.count("*").alias("with_entity")), "entities")
    # Entities of so many documents reach the bits with no term: at most 2 ** bits for each that a document
    # holds on average. They go first, so that no entity that is dealt by its key is in a large share of rows.
    often = F.log2(F.lit(float(max(total, 1))) / F.col("with_entity")) < bits
    entities, hot = entities.where(~often & (F.col("with_entity") >= support)), entities.where(often).select("entity")
    holds = work.stage(holds.join(F.broadcast(hot), "entity", "left_anti").join(small(entities.select("entity")), "entity"), "holds")
    own = found.join(holds.select("row").distinct(), "row", "left_semi").select("row", F.explode("own").alias("x")).select("row", "x.*")
    once = own.select("row", "term", "context").distinct()
    pairs = holds.join(once, "row").groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts"), F.count("*").alias("together")).where(F.col("contexts") >= support)
    terms = src.select("text").mapInPandas(_term_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("with_term"))
    hashed = F.pandas_udf(_hash, "long")
    strong = pairs.join(entities, "entity").withColumn("h", hashed("term")).join(terms, "h")
    p = F.col("together") / F.col("with_term")
    strong = strong.where((p >= share) & (F.log2(p * F.lit(float(max(total, 1))) / F.col("with_entity")) >= bits))
    strong = work.stage(strong.select("entity", "term", (p >= REMOVE_SHARE).alias("remove")), "strong")
    work.keep("found", "holds", "strong")
    # Wherever the term stands in the documents that hold the entity.
    named = holds.join(small(strong), "entity").groupBy("row", "term").agg(F.max("remove").alias("remove"))
    marks = own.select("row", "term", "s", "e").join(named, ["row", "term"])
    marks = marks.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("s", "e", "remove"))).alias("terms"))
    none = F.array().cast("array<struct<s:int,e:int,remove:boolean>>")
    out = found.drop("own", "entities").join(marks, "row", "left").withColumn("terms", F.coalesce("terms", none))
    parts = F.transform("terms", lambda x: F.format_string("term:%d:%d", x["s"], x["e"]))
    return out.withColumn("spans", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, F.array_join(F.array_distinct(parts), ","))))


def masked(text: str | None, base: str, terms: list) -> str:
    """The sanitised text: patterns become their kind, terms a general word or nothing."""
    marks = [(int(s), int(e), f"<{k.upper()}>") for k, s, e in (x.split(":") for x in base.split(",") if x)]
    marks += [(x["s"], x["e"], "" if x["remove"] else "<TERM>") for x in terms]
    out, at, text = [], 0, text or ""
    for s, e, mark in sorted(marks):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """docs with the sanitised text as clean_text beside all other columns; a null text becomes empty.
    The rows must come in the same order each time docs is read; a change is noticed and raises."""
    found = sanitise(docs, id_col, text_col, **thresholds).select("row", "check", "base", "terms")
    mask = F.udf(masked, "string")
    return again(docs, found, text_col).select("whole.*", mask(F.col(f"whole.`{text_col}`"), "base", "terms").alias("clean_text"))
