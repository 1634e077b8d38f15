"""Toxicity by a weighted lexicon (operator 4).

Texts are folded first: compatibility forms, accents, homoglyphs of other
scripts, digit and symbol substitutions inside words, and spelled-out words
("i.d.i.o.t").  Lexicon entries are folded words (" idiot ") and word starts
(" lowei"), weighted by the lower bound of their log odds between toxic and
other training documents.  Exception phrases are words and word pairs around
matches that only the other documents hold; a match inside one doesn't count.
An Aho-Corasick automaton finds entries and exceptions in one pass.  A word
counts with its heaviest entry; the document's total and its total per length
go through a logistic curve fitted on the same training rows.

The lexicon is learned from at most `max_labels` labelled rows, those with the
least hash of their id, with equal texts counted once.  The lexicon keeps every
word and word start of these rows that `min_texts` toxic texts hold and whose
weight is at least `least`; as the rows are bounded, so is the model.

Cases: null and empty texts have no match and get the curve's value at zero;
labels that are null are not used; without a toxic label, or with toxic labels
alone, the share of toxic labels (or 0) is the score of all; repeated rows are
scored each; rows with a null id are kept; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._store import small_batches

# Letters of other scripts that look like Latin ones, and what digits and symbols stand for inside words.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y", "ϲ": "c", "ѡ": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ᴏ": "o", "ǀ": "l", "æ": "ae", "œ": "oe", "ß": "ss",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "+": "t"}
_LETTERS = str.maketrans(HOMOGLYPHS)
_DIGITS = str.maketrans(SUBSTITUTES)
_SPELLED = re.compile(r"(?:\w[.\-_*·]){2,}\w")
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
_RUN = re.compile(r"(.)\1{2,}")
_AFTER, _BEFORE = "!.,;:?\"')]}»”", "\"'([{«“¿¡"
PREFIXES = (4, 5, 6, 7)
#: At most so many labelled rows are learned from.
MAX_LABELS = 20_000


def fold_word(word: str) -> str:
    """A word as the lexicon has it; empty if nothing of it is left."""
    if word.isascii():
        # plain words, which are most, need nothing of the rest
        core = word.lower().rstrip(_AFTER).lstrip(_BEFORE)
        if core.isalpha():
            return _RUN.sub(r"\1", core)
    return _fold_any(word)


def _fold_any(word: str) -> str:
    s = unicodedata.normalize("NFKD", word.casefold())
    s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(_LETTERS)
    if any(c.isalpha() for c in s):
        core = s.rstrip(_AFTER).lstrip(_BEFORE)
        if _SPELLED.fullmatch(core):
            core = re.sub(r"[.\-_*·]", "", core)
        s = core.translate(_DIGITS)
    s = _RUN.sub(r"\1", s)
    return re.sub(r"[\W_]+", "", _TRIM.sub("", s))


class Folder:
    """Folds texts; remembers words."""

    def __init__(self, size: int = 200_000):
        self.known: dict[str, str] = {}
        self.size = size

    def words(self, text: str) -> list[str]:
        known = self.known
        if len(known) > self.size:
            known.clear()
        out = []
        for w in text.split():
            f = known.get(w)
            if f is None:
                f = known[w] = fold_word(w)
            if f:
                out.append(f)
        return out


@dataclass
class ToxicityModel:
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None  # the score of all, where there is nothing to learn

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The automaton of a model, built once per task."""

    def __init__(self, model: ToxicityModel):
        import ahocorasick

        self.model, self.folder, self.automaton = model, Folder(), None
        a = ahocorasick.Automaton()
        for e, w in model.entries.items():
            a.add_word(e, (len(e), w))
        for e in model.exceptions:
            a.add_word(e, (len(e), None))
        if len(a):
            a.make_automaton()
            self.automaton = a

    def hits(self, words: list[str]) -> dict[int, float]:
        """Weight by the offset in the joined text at which a matched word starts."""
        if self.automaton is None or not words:
            return {}
        best: dict[int, float] = {}
        excepted: list[tuple[int, int]] = []
        for end, (n, w) in self.automaton.iter(" " + " ".join(words) + " "):
            start = end - n + 1
            if w is None:
                excepted.append((start, end))
            elif w > best.get(start, 0.0):
                best[start] = w
        starts = sorted(best) if excepted else []
        for lo, hi in excepted:
            for s in starts[bisect_left(starts, lo) : bisect_left(starts, hi)]:
                best.pop(s, None)
        return best

    def features(self, text: str) -> tuple[float, float]:
        words = self.folder.words(text)
        total = sum(self.hits(words).values())
        return math.log1p(total), math.log1p(1000 * total / (len(words) + 50))

    def score(self, text: str) -> float:
        if self.model.constant is not None:
            return self.model.constant
        a, b = self.features(text)
        w = self.model.weights
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, w[0] + w[1] * a + w[2] * b))))


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in batch.column(name).cast(pa.binary()).to_pylist()]


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Newton's method with a small penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + l2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, max_labels: int = MAX_LABELS, min_texts: int = 4, least: float = 1.5) -> ToxicityModel:
    """Learn lexicon, exceptions and curve from labelled texts.

    min_texts: how many toxic texts must hold an entry; least: the least lower
    bound of an entry's log odds.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("label IS NOT NULL AND text IS NOT NULL")
    # equal texts count once: those with the least hash of (id, text) stay
    rows = rows.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.min_by("text", F.xxhash64("id", "text")).alias("text"), F.min(F.xxhash64("id", "text")).alias("k"))
    rows = rows.orderBy("k", "h", "label").limit(max_labels).select("text", "label").repartition(min(64, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = rows.persist()
    try:
        return _fit(rows, min_texts, least)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, min_texts: int, least: float) -> ToxicityModel:
    n = {r["label"]: r["count"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return ToxicityModel(constant=1.0 if toxic else 0.0)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, count = Folder(), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(_texts(batch), batch.column("label").to_pylist(), strict=True):
                words = set(fold.words(text))
                count[label > 0].update({f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) >= k})
        items = list(count[0].keys() | count[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array([count[1][i] for i in items], pa.int64()), pa.array([count[0][i] for i in items], pa.int64())], ["item", "a", "b"])

    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1)) - F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = (
        rows.mapInArrow(candidates, "item string, a long, b long").groupBy("item").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .filter(F.col("a") >= min_texts).withColumn("w", odds).filter(F.col("w") >= least)
        .orderBy(F.col("w").desc(), "item").collect()
    )
    entries = {r["item"]: float(r["w"]) for r in found}
    # a word start that nearly always goes on in one way gives way to the longer entry
    held = {r["item"]: r["a"] for r in found}
    longest: dict[str, int] = {}
    for e, a in held.items():
        for k in PREFIXES:
            if k + 1 < len(e):
                longest[e[: k + 1]] = max(longest.get(e[: k + 1], 0), a)
    entries = {e: w for e, w in entries.items() if longest.get(e, 0) < 0.9 * held[e]}
    # an entry that a shorter one covers with as much weight says nothing more
    entries = {e: w for e, w in entries.items() if not any(entries.get(e[: k + 1], -1.0) >= w for k in PREFIXES if k + 1 < len(e))}
    model = ToxicityModel(entries=entries)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, count = model.matcher(), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(_texts(batch), batch.column("label").to_pylist(), strict=True):
                words = m.folder.words(text)
                hits, at, mine = m.hits(words), 0, set()
                for k, w in enumerate(words):
                    if at in hits:
                        mine.add(f" {w} ")
                        if k:
                            mine.add(f" {words[k - 1]} {w} ")
                        if k + 1 < len(words):
                            mine.add(f" {w} {words[k + 1]} ")
                    at += len(w) + 1
                count[label > 0].update(mine)
        items = list(count[0].keys() | count[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array([count[1][i] for i in items], pa.int64()), pa.array([count[0][i] for i in items], pa.int64())], ["item", "a", "b"])

    seen = rows.mapInArrow(phrases, "item string, a long, b long").groupBy("item").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("b >= 2 AND a = 0")
    model.exceptions = [r["item"] for r in seen.orderBy(F.col("b").desc(), "item").collect()]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for batch in batches:
            got = [m.features(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column("label")], ["x", "y", "label"])

    fit = sorted(tuple(r) for r in rows.mapInArrow(totals, "x double, y double, label int").collect())
    xy = np.array([r[:2] for r in fit])
    model.weights = tuple(float(v) for v in _logistic(xy, np.array([float(r[2] > 0) for r in fit])))
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, n_matches, matches): matches are the folded words that counted, in text order."""
    small_batches(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for batch in batches:
            scores, found = [], []
            for text in _texts(batch):
                words = m.folder.words(text)
                hits = m.hits(words)
                total = sum(hits.values())
                w = model.weights
                if model.constant is not None:
                    s = model.constant
                else:
                    s = 1 / (1 + math.exp(-max(-50.0, min(50.0, w[0] + w[1] * math.log1p(total) + w[2] * math.log1p(1000 * total / (len(words) + 50))))))
                scores.append(s)
                mine = []
                if hits:
                    at = 0
                    for word in words:
                        if at in hits:
                            mine.append(word)
                        at += len(word) + 1
                found.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.string()))], ["id", "score", "predicted", "n_matches", "matches"])

    out = docs.mapInArrow(score, f"id {docs.schema['id'].dataType.simpleString()}, score double, predicted int, n_matches long, matches array<string>")
    return out.withColumnRenamed("id", id_col)


def op4_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents`, learned from the labels outside the held-out fifth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter("toxic IS NOT NULL AND crc32(CAST(doc_id AS string)) % 5 <> 0")
    # only ids and labels are sampled; the bound of the sample makes them small enough to broadcast
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(MAX_LABELS)
    model = fit_toxicity(docs.join(F.broadcast(chosen), "doc_id"), max_labels=MAX_LABELS)
    held = F.expr("coalesce(crc32(CAST(doc_id AS string)) % 5 = 0, false)").alias("held_out")
    return score_toxicity(docs, model).select("doc_id", held, "score", "predicted", "n_matches")

