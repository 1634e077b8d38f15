"""Benchmark decontamination by spaced seeds (operator 8).

A mask is a pattern over some tokens that reads some positions and skips the
others.  The tokens a mask reads are hashed at each position of the benchmark
items and of the documents; equal hashes are hits, even where tokens at skipped
positions were replaced.  Around each hit the item and the document are laid
side by side on the hit's diagonal, and the best segment (1 for an equal token,
-2 for another) is the verified overlap.

Which seeds an item has, and what contaminates, follows from its length:

* from 12 tokens: `MASKS`; a segment with at least `min_match` equal tokens, at
  least `min_identity` of its positions equal;
* 8 to 24 tokens: `LIGHT` masks too; also the item as a whole, with at least
  `min_identity` of its tokens (and 7) equal;
* 5 to 7 tokens: a seed of five tokens in a row; all tokens equal.  One
  replaced token would leave no more evidence than common phrases have;
* below 5 tokens: a document that has these tokens and no others.

Hits come from a join of hashes.  A Bloom filter of the benchmark's hashes, of at
most `MOST_BITS` bits however large the benchmark is, goes to the tasks first, so
only positions that it lets pass are joined; the join decides.  Benchmark tables
are broadcast where they are counted as small and joined salted otherwise, so a
passage in a third of all documents is dealt to `SALTS` tasks.  What a document
may overlap with (items' tokens and diagonals) then meets the document.  Nothing
is gathered on the driver but the filter's words.

Cases: null and empty texts are clean; null items and items without tokens match
nothing; repeated items give the same item id once; repeated rows are judged
each; rows with a null id are kept; other columns are carried along only if
named; empty tables give empty results, and an empty benchmark none that is
contaminated; very long texts are read whole, in batches bounded by bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._chunks import mix, powers
from tidemark.llm._store import small_batches, stored

#: Fixed masks: eight of twelve positions; five of at most eight.
MASKS = ("110110110101", "111010011011", "101101110011", "110011010111")
LIGHT = ("110111", "1111001", "11001011", "10001111")
PLAIN = "11111"
#: Item lengths from which each kind of seed is used, and the equal tokens that a short item needs at least.
WHOLE, SHORT, HEAVY, LONG, LEAST_SHORT = 5, 8, 12, 25, 7
MIN_MATCH, MIN_IDENTITY = 12, 0.75
MOST_BITS = 28
#: Seeds of the benchmark, and bytes of a table of candidates, that are broadcast; more are joined by a shuffle.
MAX_SENT_SEEDS, MAX_SENT_BYTES = 200_000, 8 << 20
SALTS = 16
_STRIP = b".,;:!?\"'()[]{}<>-_*#&$%|/\\"


class Tokens:
    """Hashes of normalised words; remembers words."""

    def __init__(self, size: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.size = size

    def __call__(self, text: bytes | None) -> np.ndarray:
        known = self.known
        if len(known) > self.size:
            known.clear()
        out = []
        for w in (text or b"").split():
            h = known.get(w)
            if h is None:
                s = w.decode("utf-8", "replace").lower().encode().strip(_STRIP)
                h = known[w] = xxhash.xxh3_64_intdigest(s) if s else -1
            if h >= 0:
                out.append(h)
        return np.array(out, dtype=np.uint64)


_POWERS = powers(0x9E3779B97F4A7C15, 4096)


def masked(tokens: np.ndarray, mask: str, which: int) -> np.ndarray:
    """The hash of what the mask reads, at each position that has the mask's span."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, which, dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += tokens[k : k + n] * _POWERS[k + 1]
    return mix(out)


def whole(tokens: np.ndarray) -> np.ndarray:
    """The hash of a text of fewer than `WHOLE` tokens."""
    return masked(tokens, "1" * len(tokens), 100 + len(tokens)) if 0 < len(tokens) < WHOLE else np.zeros(0, dtype=np.uint64)


def kinds(n: int) -> list[tuple[int, str]]:
    """Numbers and masks of the seeds of an item of n tokens (from `WHOLE` on)."""
    out = list(enumerate(MASKS)) if n >= HEAVY else []
    if SHORT <= n < LONG:
        out += [(10 + k, m) for k, m in enumerate(LIGHT)]
    return out or [(20, PLAIN)]


def seeds_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of an item's seeds and where they are."""
    if len(tokens) < WHOLE:
        h = whole(tokens)
        return h, np.zeros(len(h), dtype=np.int64)
    got = [masked(tokens, mask, which) for which, mask in kinds(len(tokens))]
    return np.concatenate(got), np.concatenate([np.arange(len(h)) for h in got])


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int]:
    """Best segment on a diagonal: equal tokens, positions, where it starts in the document and in the item."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    equal = doc[lo + diagonal : hi + diagonal] == item[lo:hi]
    score = np.concatenate(([0], np.cumsum(np.where(equal, 1, -2))))
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.flatnonzero(score[: end + 1] == low[end])[0])
    return int(equal[start:end].sum()), end - start, lo + diagonal + start, lo + start


def contaminating(doc: np.ndarray, item: np.ndarray, diagonal: int, min_match: int = MIN_MATCH, min_identity: float = MIN_IDENTITY) -> tuple[int, int, int, int] | None:
    """The overlap on a diagonal (as `overlap` gives it) if it contaminates."""
    n = len(item)
    lo, hi = max(0, -diagonal), min(n, len(doc) - diagonal)
    if hi <= lo:
        return None
    if n >= HEAVY:
        got = overlap(doc, item, diagonal)
        if got[0] >= min_match and got[0] >= min_identity * got[1]:
            return got
    if n >= LONG:
        return None
    equal = int((doc[lo + diagonal : hi + diagonal] == item[lo:hi]).sum())
    if n < WHOLE:
        enough = equal == n == len(doc)
    elif n < SHORT:
        enough = equal == n
    else:
        enough = equal >= max(LEAST_SHORT, math.ceil(min_identity * n))
    return (equal, n, lo + diagonal, lo) if enough else None


class Filter:
    """A Bloom filter over 64-bit hashes: three bits each."""

    SHIFTS = (36, 18, 0)

    def __init__(self, bits: int, words: np.ndarray, values: np.ndarray):
        self.bits = bits
        table = np.zeros(1 << max(0, bits - 6), dtype=np.uint64)
        table[words] = values
        self.table = table.view(np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Positions whose hash may be known."""
        at = np.arange(len(h))
        for shift in self.SHIFTS:
            bit = ((h[at] >> np.uint64(shift)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            at = at[(self.table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        return at


def filter_of(seeds: DataFrame, n: int) -> Filter:
    """The filter of a seeds table with n rows: 32 to 64 bits a seed, 2**MOST_BITS at most."""
    bits = min(MOST_BITS, max(10, (32 * n).bit_length()))
    places = [F.shiftrightunsigned("hash", shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in Filter.SHIFTS]
    each = seeds.select(F.explode(F.array(*places)).alias("bit"))
    words = each.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("value")).toArrow()
    return Filter(bits, words.column("word").to_numpy(), words.column("value").to_numpy().view(np.uint64))


_HITS = "array<struct<item:{item},matched:int,length:int,doc_start:int,item_start:int>>"


def _keys(*columns: str) -> list:
    """128 bits of what a row says, as two numbers."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(7), *reversed(columns))]


def _seed_tables(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(i1, i2, item, tokens) of each distinct item, and (i1, i2, n, pos, hash) of their seeds."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text IS NOT NULL")
    i1, i2 = _keys("item", "text")
    items = items.select(i1.alias("i1"), i2.alias("i2"), "item", "text").dropDuplicates(["i1", "i2"])
    kind = items.schema["item"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            got = [tokens(t).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("i1", "i2", "item")] + [pa.array(got, pa.binary())], ["i1", "i2", "item", "tokens"])

    items = stored(items.mapInArrow(read, f"i1 long, i2 long, item {kind}, tokens binary"), "items")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, pos, n, take = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for k, raw in enumerate(batch.column("tokens").to_pylist()):
                t = np.frombuffer(raw, dtype=np.uint64)
                a, b = seeds_of(t)
                h.append(a)
                pos.append(b)
                n.append(np.full(len(a), len(t)))
                take.append(np.full(len(a), k))
            rows = pa.array(np.concatenate(take))
            yield pa.RecordBatch.from_arrays([batch.column("i1").take(rows), batch.column("i2").take(rows), *(pa.array(np.concatenate(x)) for x in (n, pos)), pa.array(np.concatenate(h).view(np.int64))], ["i1", "i2", "n", "pos", "hash"])

    return items, stored(items.select("i1", "i2", "tokens").mapInArrow(seed, "i1 long, i2 long, n long, pos long, hash long"), "seeds")


def _positions(docs: DataFrame, known: Filter, lengths: set[str]) -> DataFrame:
    """(k1, k2, pos, hash) for each seed of a document (k1, k2, text) that the filter lets pass."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    masks = (list(enumerate(MASKS)) if "heavy" in lengths else []) + ([(10 + k, m) for k, m in enumerate(LIGHT)] if "light" in lengths else []) + ([(20, PLAIN)] if "plain" in lengths else [])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, tokens = sent.value, Tokens()
        for batch in batches:
            got = [tokens(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.array([len(t) for t in got], dtype=np.int64)
            every = np.concatenate([np.zeros(0, dtype=np.uint64), *got])
            doc = np.repeat(np.arange(len(got)), sizes)
            start = np.cumsum(sizes) - sizes
            rows, pos, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
            for which, mask in masks:  # over all documents of the batch at once, but not across their borders
                h = masked(every, mask, which)
                at = may(h)
                at = at[doc[at] == doc[at + len(mask) - 1]]
                rows.append(doc[at])
                pos.append(at - start[doc[at]])
                hashes.append(h[at])
            if "whole" in lengths:
                for k in np.flatnonzero((sizes > 0) & (sizes < WHOLE)).tolist():
                    rows.append(np.array([k]))
                    pos.append(np.zeros(1, dtype=np.int64))
                    hashes.append(whole(got[k]))
            take = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(take), batch.column("k2").take(take), pa.array(np.concatenate(pos)), pa.array(np.concatenate(hashes).view(np.int64))], ["k1", "k2", "pos", "hash"])

    return docs.mapInArrow(search, "k1 long, k2 long, pos long, hash long")


def _joined(rows: DataFrame, table: DataFrame, on: list[str], small: bool) -> DataFrame:
    """rows and the benchmark's table by equal columns; salted by the document if the table isn't small."""
    if small:
        return rows.join(F.broadcast(table), on)
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(table, [*on, "salt"]).drop("salt")


def decontaminate(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, min_match: int = MIN_MATCH,
    min_identity: float = MIN_IDENTITY, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, keep..., contaminated, n_items, best_match, hits) for each row; hits: the best overlap with each item found."""
    spark = df.sparkSession
    small_batches(spark)
    items, seeds = _seed_tables(benchmark, item_col, item_text_col)
    n_seeds, heavy, light, plain, tiny = seeds.agg(
        F.count("*"), F.max(F.col("n") >= HEAVY), F.max((F.col("n") >= SHORT) & (F.col("n") < LONG)), F.max((F.col("n") >= WHOLE) & (F.col("n") < SHORT)), F.max(F.col("n") < WHOLE)
    ).first()
    k1, k2 = _keys("id", "text")
    cols = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"k_{k}") for k, c in enumerate(keep))]
    docs = df.select(*cols).withColumns({"k1": k1, "k2": k2})
    used = {name for name, is_used in (("heavy", heavy), ("light", light), ("plain", plain), ("whole", tiny)) if is_used}
    found = _positions(docs.select("k1", "k2", "text"), filter_of(seeds, n_seeds), used)
    small = n_seeds <= MAX_SENT_SEEDS
    hits = _joined(found, seeds.select("hash", "i1", "i2", F.col("pos").alias("at")), ["hash"], small)
    # rows that are equal give equal hits, and neighbouring seeds the same diagonal
    lanes = hits.select("k1", "k2", "i1", "i2", (F.col("pos") - F.col("at")).cast("int").alias("diagonal")).distinct()
    near = lanes.groupBy("k1", "k2", "i1", "i2").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    near = _joined(near, items, ["i1", "i2"], small).groupBy("k1", "k2").agg(F.collect_list(F.struct("item", "tokens", "diagonals")).alias("near"))
    near = stored(near, "candidates").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), "near")
    size = near.agg(F.sum(F.aggregate("near", F.lit(0).cast("long"), lambda t, x: t + F.length(x["tokens"]) + 4 * F.size(x["diagonals"]) + 64) + 64)).first()[0] or 0
    rows = docs.join(F.broadcast(near) if size <= MAX_SENT_BYTES else near, (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")), "left")
    names = ["id", *(f"k_{k}" for k in range(len(keep)))]
    hit_type = _HITS.format(item=items.schema["item"].dataType.simpleString())

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow_hits = to_arrow_type(_parse_datatype_string(hit_type))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            out: list[list[dict]] = []
            texts, beside = batch.column("text").cast(pa.binary()), batch.column("near")
            for k, is_near in enumerate(beside.is_valid().to_pylist()):
                best: dict = {}
                if is_near:
                    doc = tokens(texts[k].as_py())
                    for x in beside[k].as_py():
                        item = np.frombuffer(x["tokens"], dtype=np.uint64)
                        for diagonal in x["diagonals"]:
                            got = contaminating(doc, item, diagonal, min_match, min_identity)
                            if got is not None and (x["item"] not in best or (-got[0], *got[1:]) < (-best[x["item"]][0], *best[x["item"]][1:])):
                                best[x["item"]] = got
                out.append([dict(zip(("item", "matched", "length", "doc_start", "item_start"), (i, *best[i]), strict=True)) for i in sorted(best, key=lambda i: (i is None, i))])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, arrow_hits)], [*names, "hits"])

    schema = ", ".join([*(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names), f"hits {hit_type}"])
    judged = rows.select(*names, "text", "near").mapInArrow(verify, schema)
    n = F.size("hits").cast("long")
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["matched"])), F.lit(0)).cast("long")
    return judged.select(F.col("id").alias(id_col), *(F.col(f"k_{k}").alias(c) for k, c in enumerate(keep)), (n > 0).alias("contaminated"), n.alias("n_items"), best.alias("best_match"), "hits")


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` with the items of `benchmark` that they overlap."""
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(docs, benchmark)
    return out.select("doc_id", "contaminated", "n_items", "best_match", F.sort_array(F.transform("hits", lambda h: h["item"])).alias("item_ids"))
