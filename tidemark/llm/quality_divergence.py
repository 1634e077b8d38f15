"""Quality rules by distribution divergence (operator 10).

Each language's reference is learned from the whole table: the histogram of its
characters over eight classes, and the histogram of its `top` most common words
with everything else as one more bin.  A document is compared with the
reference of its language by Jensen-Shannon distance (base 2, so 0 to 1); it is
rejected where a distance is above its limit and the document is long enough
for the histogram to mean something.

The limit of the word distance depends on the document's length and on how
common its language's common words are: it lies `margin` of the way from what
sampling alone gives a text of as many words to the distance of a text without
any common word, and never above `max_word`.

All words of all documents are counted, each once per task before anything moves;
the most common of each slice of the vocabulary are ranked first, so that no
language's words meet in one task.

Cases: null and empty texts have no words and fail the base rule; null
languages form a language of their own; ties among common words go to the
smaller word; repeated rows count each time; rows with a null id are kept;
other columns are ignored, whatever their names; an empty table gives an empty
result; very long texts are read whole, in batches bounded by bytes.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._store import small_batches

SYMBOLS = "#*$%&|<>"
SPACE = "\t\n\v\f\r "
CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "letter", "other")
#: Languages whose references are sent with the tasks (about 3 KB each); with more, they are joined, each language's rows dealt to `SALTS` tasks.
MAX_SENT_LANGUAGES = 2000
SALTS = 16


def _class_table() -> np.ndarray:
    """The class of each code point below 65536."""
    out = np.full(65536, 7, dtype=np.uint8)
    for o in range(65536):
        c = chr(o)
        if c in SYMBOLS:
            k = 5
        elif c in SPACE:
            k = 3
        elif c.isdigit():
            k = 2
        elif o < 128:
            k = 0 if c.islower() else 1 if c.isupper() else 4 if o > 32 else 7
        else:
            k = 1 if c.isupper() else 6 if c.isalpha() else 7
        out[o] = k
    return out


_TABLE: list[np.ndarray] = []


def char_histogram(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_class_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(_TABLE[0][np.minimum(points, 65535)], minlength=8)


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three words that are found twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    hit = np.fromiter((count[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(windows)] |= hit
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line.strip(b" \t\n\v\f\r"):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that needn't sum to one."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = sum(np.where(x > 0, x * np.log2(x / m), 0.0).sum() for x in (p, q))
    return math.sqrt(min(1.0, max(0.0, d / 2)))


def _noise_table() -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of a bin's expected count, and the expected divergence over the bin's share, for Poisson counts."""
    means = np.geomspace(0.01, 100, 81)
    k = np.arange(1, 301)
    logs = np.concatenate(([0.0], np.cumsum(np.log(k))))
    k = np.arange(301)
    out = []
    for m in means:
        x = k / m
        f = (np.where(x > 0, x * np.log2(np.maximum(2 * x, 1e-300) / (1 + x)), 0.0) + np.log2(2 / (1 + x))) / 2
        out.append(float((np.exp(k * np.log(m) - m - logs) * f).sum()))
    return np.log(means), np.array(out)


_NOISE: list[tuple[np.ndarray, np.ndarray]] = []


def sampling_distance(share: np.ndarray, n: int) -> float:
    """The distance to expect between a histogram's shares and n draws from it."""
    if not _NOISE:
        _NOISE.append(_noise_table())
    share = share[share > 0]
    mean = n * share
    d = np.where(mean > 100, 1 / (8 * math.log(2) * mean), np.interp(np.log(mean), *_NOISE[0]))
    return math.sqrt(float((share * (1 - share) * d).sum()))


def language_references(df: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 64) -> DataFrame:
    """(lang, chars array<long>, words array<struct<word, n>>, n_words long): one row per language, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict = defaultdict(lambda: np.zeros(8, dtype=np.int64))
        words: dict = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            out = [(lang, 0, str(k), int(n)) for lang, h in chars.items() for k, n in enumerate(h)]
            out += [(lang, 1 if w else 2, w, n) for lang, c in words.items() for w, n in c.items()]
            chars.clear()
            words.clear()
            a, b, c, d = zip(*out, strict=True) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.string()), pa.array(d, pa.int64())], ["lang", "kind", "item", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text is None:
                    continue
                s = text.decode("utf-8", "replace")
                chars[lang] += char_histogram(s)
                got = s.encode("utf-8", "replace").split()
                c = words[lang]
                for w, n in Counter(got).items():
                    c[w.decode().lower()] += n
                c[""] += len(got)  # no word is empty: all words
            if sum(map(len, words.values())) > 300_000:
                yield flush()
        yield flush()

    small_batches(df.sparkSession)
    docs = df.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counts = docs.mapInArrow(count, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    best = (F.col("n").desc(), F.col("item"))
    # the most common of each slice first, so that no language's words are ranked in one task
    sliced = Window.partitionBy("lang", "kind", F.pmod(F.xxhash64("item"), F.lit(64))).orderBy(*best)
    few = counts.withColumn("r", F.row_number().over(sliced)).filter((F.col("kind") != 1) | (F.col("r") <= top)).drop("r")
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(*best))).filter((F.col("kind") != 1) | (F.col("r") <= top))
    return (
        few
        .groupBy("lang")
        .agg(
            F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == 0, F.struct("item", "n")))), lambda x: x["n"]).alias("chars"),
            F.sort_array(F.collect_list(F.when(F.col("kind") == 1, F.struct("item", "n")))).alias("words"),
            F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.lit(0).cast("long")).alias("n_words"),
        )
    )


class _Reference:
    def __init__(self, chars: list, words: list, n_words: int):
        self.chars = np.array(chars, dtype=float)
        self.place = {w["item"]: k for k, w in enumerate(words)}
        self.words = np.array([w["n"] for w in words] + [n_words - sum(w["n"] for w in words)], dtype=float)
        none = np.zeros(len(self.words))
        none[-1] = 1.0
        self.absent = js_distance(none, self.words)  # of a text without common words

    def word_limit(self, n: int, margin: float, most: float) -> float:
        total = self.words.sum()
        noise = sampling_distance(self.words / total, n) if total else most
        return min(most, noise + margin * (self.absent - noise)) if self.absent > noise else most


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_divergence double, word_divergence double, kept boolean"


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, max_char: float = 0.3, max_word: float = 0.47, margin: float = 0.6,
    min_chars: int = 200, min_words: int = 50, top: int = 64, references: DataFrame | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """A row per document: base counts, base_failed, both divergences, and kept.

    A document fails the base rule with fewer than 50 words, or with over half of
    its words in repeated three-word windows.  A divergence is null, and doesn't
    count, below `min_chars` characters or `min_words` words.  `keep` names
    columns of `df` to carry along.
    """
    references = language_references(df, text_col, lang_col, top) if references is None else references
    got = references.limit(MAX_SENT_LANGUAGES + 1).collect()
    sent = {r["lang"]: _Reference(r["chars"], r["words"], r["n_words"]) for r in got} if len(got) <= MAX_SENT_LANGUAGES else None
    carried = [F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep)]
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), *carried)
    if sent is None:
        salted = references.withColumnRenamed("lang", "lang2").withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn("salt", F.pmod(F.xxhash64("id", "text"), F.lit(SALTS)).cast("int"))
        docs = docs.join(salted, F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("salt") == F.col("salt2")), "left")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            refs = batch.select(["chars", "words", "n_words"]).to_pylist() if sent is None else None
            for k, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)):
                text = text or b""
                s = text.decode("utf-8", "replace")
                words, chars = text.split(), char_histogram(s)
                n, n_chars, repeats = len(words), len(s), repeat_words(words)
                failed = n < 50 or 100 * repeats > 50 * n
                ref = sent.get(lang) if sent is not None else _Reference(**refs[k]) if refs[k]["chars"] else None
                dc = dw = None
                if ref is not None and n_chars >= min_chars:
                    dc = js_distance(chars, ref.chars)
                if ref is not None and n >= min_words:
                    h = np.zeros(len(ref.words))
                    rest = len(h) - 1
                    for w, c in Counter(words).items():
                        h[ref.place.get(w.decode("utf-8", "replace").lower(), rest)] += c
                    dw = js_distance(h, ref.words)
                kept = not failed and not (dc is not None and dc > max_char) and not (dw is not None and dw > ref.word_limit(n, margin, max_word))
                out.append((n, n_chars - int(chars[3]), int(chars[5]), duplicate_lines(text), repeats, failed, dc, dw, kept))
            cols = list(zip(*out, strict=True)) if out else [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            mine = [batch.column("id"), *(batch.column(f"k{k}") for k in range(len(keep)))]
            yield pa.RecordBatch.from_arrays([*mine, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    head = [("id", docs.schema["id"].dataType), *((f"k{k}", docs.schema[f"k{k}"].dataType) for k in range(len(keep)))]
    names = [n for n, _ in head] + [x.split()[0] for x in SCHEMA.split(", ")]
    schema = ", ".join([f"{n} {t.simpleString()}" for n, t in head] + [SCHEMA])
    out = docs.mapInArrow(judge, schema)
    return out.select(F.col("id").alias(id_col), *(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)), *names[len(head) :])


def op10_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with its base counts and the verdict."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
