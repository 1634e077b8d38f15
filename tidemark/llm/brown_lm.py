"""Language-model scores by Brown class n-grams (operator 1).

Words are assigned to classes in two steps.  The `top_words` most frequent go
by the exchange algorithm: each item in turn goes to the class that raises the
likelihood of the training bigrams most, until none moves.  Beside them,
`SHAPES` groups of all other words by their endings stand in for these as
neighbours, so the tables that are gathered and sent have a bound whatever the
vocabulary.  Then every other training word goes, on the executors, to the
class that raises the likelihood most (to first order) by the classes counted
before and after that word; only words that training lacks stay with the group
of their ending.  Class bigrams are counted again with these classes.  A
token's probability is

    share * P(class | class before) * P(word | class) + (1 - share) * P(word)

with P(class | class before) smoothed towards the class's frequency, P(word |
class) add-one over the class's words and a type for each of its groups of
unknown words, and P(word) add-one over vocabulary and unknown, which is also
the base score.

Every token of every training document is counted.  Counts of rare words never
leave the executors: chunks send their distinct words' hashes with counts, then
with class contexts, to buckets, and get the corpus's counts and classes back.

Cases: null and empty texts are an end token alone; without training documents
both scores follow the formulas with no counts; equal counts are ordered by
hash; repeated rows count and are scored each; rows with a null id are kept and
train; other columns are ignored, whatever their names; an empty table gives an
empty result.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import _chunks as X
from tidemark.llm._store import stored

SHAPES, TOP_WORDS, CLASSES, SHARE = 64, 1000, 64, 0.95
END = b""  # no word is empty
_PUNCTUATION = b".,;:!?\"')]}"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shape(word: bytes) -> int:
    """The group of a rare word, by how it ends."""
    core = word.rstrip(_PUNCTUATION)
    return zlib.crc32((b"." if len(core) < len(word) else b" ") + core.decode("utf-8", "replace")[-2:].encode()) % SHAPES


def exchange_classes(bigrams: np.ndarray, classes: int, sweeps: int = 20) -> np.ndarray:
    """A class for each item, by the exchange algorithm on a matrix of item bigram counts."""
    n = len(bigrams)
    bigrams = bigrams.astype(float)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    label = np.empty(n, dtype=np.int64)
    label[order] = np.minimum(np.arange(n), classes - 1)  # the most frequent alone, the rest together
    label[order[classes:]] = np.arange(max(0, n - classes)) % classes
    k = min(classes, n)
    one = np.zeros((n, k))
    one[np.arange(n), label] = 1.0
    table = one.T @ bigrams @ one

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moved = 0
        for w in order[weight[order] > 0].tolist():
            old = int(label[w])
            right = np.bincount(label, weights=bigrams[w], minlength=k)
            left = np.bincount(label, weights=bigrams[:, w], minlength=k)
            own = bigrams[w, w]
            right[old] -= own
            left[old] -= own
            table[old, :] -= right
            table[:, old] -= left
            table[old, old] -= own
            np.maximum(table, 0.0, out=table)
            # gain of joining each class: its row, its column, the diagonal cell, and its margins
            base = f(table)
            rows, cols = f(table + right) - base, f(table + left[:, None]) - base
            d = np.diagonal(table)
            gain = rows.sum(axis=1) - np.diagonal(rows) + cols.sum(axis=0) - np.diagonal(cols) + f(d + right + left + own) - f(d)
            first, second = table.sum(axis=1) + left, table.sum(axis=0) + right  # neighbours count it in any class
            gain -= f(first + right.sum() + own) - f(first) + f(second + left.sum() + own) - f(second)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            label[w] = new
            moved += new != old
            table[new, :] += right
            table[:, new] += left
            table[new, new] += own
        if not moved:
            break
    return label


@dataclass
class BrownModel:
    """All that scoring needs besides the counts and classes of rare words."""

    items: dict[int, int]  # hash of a top word -> item
    label: np.ndarray  # class of each item; items of groups come after the top words
    bigrams: np.ndarray  # class bigrams
    class_types: np.ndarray  # words of each class and groups of unknown words in it
    tokens: int
    types: int
    share: float = SHARE

    def __post_init__(self):
        k = len(self.bigrams)
        self.class_count = self.bigrams.sum(axis=0)
        prior = (self.class_count + 1) / (self.class_count.sum() + k)
        self.transition = (self.bigrams + 5.0 * prior[None, :]) / (self.bigrams.sum(axis=1)[:, None] + 5.0)

    def probabilities(self, kind: np.ndarray, before: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability by base and by model. kind, before: its class and the class before."""
        base = (count + 1) / (self.tokens + self.types + 1)
        p = self.transition[before, kind] * (count + 1) / (self.class_count + self.class_types)[kind]
        return np.log10(base), np.log10(self.share * p + (1 - self.share) * base)


class _Chunk:
    """Token numbers of a chunk's documents and its distinct words."""

    def __init__(self, table: pa.Table):
        ids, texts, self.order = X.rows(table)
        train = table.column("train").to_pylist()
        self.train = np.array([train[k] for k in self.order.tolist()], dtype=bool)
        known: dict[bytes, int] = {END: 0}
        tokens, lengths = [], []
        for t in texts:
            ws = words_of(t)
            tokens += [known.setdefault(w, len(known)) for w in ws]
            tokens.append(0)
            lengths.append(len(ws) + 1)
        self.tokens = np.array(tokens, dtype=np.int64)
        self.lengths = np.array(lengths, dtype=np.int64)
        self.words = list(known)
        self.keys = np.fromiter((word_key(w) for w in self.words), dtype=np.uint64, count=len(self.words))
        self.sorted = np.argsort(self.keys, kind="stable")  # distinct words with one hash would be one key twice; both get its count
        self.counts = np.bincount(self.tokens[np.repeat(self.train, self.lengths)], minlength=len(self.words))


def _press(keys: np.ndarray, counts: np.ndarray, shapes: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8).T)  # high bytes of sorted keys hardly change
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes() + np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() + shapes.astype(np.uint8).tobytes())


def _unpress(payload: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), dtype=np.uint8)
    keys = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(">u8").ravel().astype(np.uint64)
    return keys, np.ascontiguousarray(raw[8 * n : 12 * n].reshape(4, n).T).view("<u4").ravel().astype(np.int64), raw[12 * n :]


def _planes(x: np.ndarray, dtype: str) -> bytes:
    """Bytes by place: high ones hardly change."""
    x = x.astype(dtype)
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(raw: np.ndarray, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


@dataclass
class Vocabulary:
    """Items of words by their hashes: the top words, then the groups."""

    items: dict[int, int]

    def __post_init__(self):
        self.keys = np.fromiter(self.items, dtype=np.uint64, count=len(self.items))
        self.order = np.argsort(self.keys)
        self.place = np.fromiter(self.items.values(), dtype=np.int64, count=len(self.items))[self.order]
        self.keys = self.keys[self.order]

    def of(self, keys: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], len(self.keys) + shapes.astype(np.int64))


def _unpack_tokens(payload: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys and shapes of a chunk's words, and its training tokens as places among them; texts follow one another, each with its end."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), dtype=np.uint8)
    return _from_planes(raw[: 8 * n], ">u8").astype(np.uint64), raw[8 * n : 9 * n], _from_planes(raw[9 * n :], "<u4").astype(np.int64)


def _cuts(keys: np.ndarray, buckets: int) -> list[int]:
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]


ANSWER = "chunk int, bucket int, payload binary, tokens long, types array<long>, top array<struct<key:long,n:long,shape:int>>"


def sent_words(docs: DataFrame, buckets: int) -> DataFrame:
    """SENT rows: each chunk's words with counts to buckets, and for bucket -1 its training tokens."""

    def count(chunk: int, table: pa.Table) -> pa.Table:
        c = _Chunk(table)
        keys, counts = c.keys[c.sorted], c.counts[c.sorted]
        shapes = np.fromiter((shape(c.words[k]) for k in c.sorted.tolist()), dtype=np.uint8, count=len(keys))
        cuts = _cuts(keys, buckets)
        out = [(b, chunk, hi - lo, _press(keys[lo:hi], counts[lo:hi], shapes[lo:hi])) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo]
        place = np.empty(len(keys), dtype=np.int64)
        place[c.sorted] = np.arange(len(keys))
        tokens = place[c.tokens[np.repeat(c.train, c.lengths)]]
        out.append((-1, chunk, len(keys), zstandard.ZstdCompressor(level=1).compress(_planes(keys, ">u8") + shapes.tobytes() + _planes(tokens, "<u4"))))
        return X.sent_table(out)

    return X.per_chunk(docs, count, X.SENT)


def corpus_counts(sent: DataFrame, top_words: int) -> DataFrame:
    """ANSWER rows: counts for each chunk's words; and for each bucket a row with chunk -1 that has its sums and most frequent words."""

    def answer(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("chunk").to_pylist(), table.column("n").to_pylist(), table.column("payload").to_pylist(), strict=True))
        got = [_unpress(p, n) for _, n, p in rows]
        keys, place = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate([g[1] for g in got]), minlength=len(keys)).astype(np.int64)
        shapes = np.zeros(len(keys), dtype=np.int64)
        shapes[place] = np.concatenate([g[2] for g in got])
        bucket, at, out = table.column("bucket")[0].as_py(), 0, []
        press = zstandard.ZstdCompressor(level=1)
        for chunk, n, _ in rows:
            mine = total[place[at : at + n]]
            out.append((chunk, bucket, press.compress(np.ascontiguousarray(mine.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()), 0, None, None))
            at += n
        best = np.lexsort((keys, -total))[:top_words]
        top = [{"key": int(keys[k].astype(np.int64)), "n": int(total[k]), "shape": int(shapes[k])} for k in best.tolist() if total[k] > 0]
        out.append((-1, bucket, None, int(total.sum()), np.bincount(shapes[total > 0], minlength=SHAPES).tolist(), top))
        a, b, c, d, e, f = zip(*out, strict=True)
        return pa.table({"chunk": pa.array(a, pa.int32()), "bucket": pa.array(b, pa.int32()), "payload": pa.array(c, pa.binary()), "tokens": pa.array(d, pa.int64()), "types": pa.array(e, pa.list_(pa.int64())), "top": pa.array(f, pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64()), ("shape", pa.int32())])))})

    return sent.filter("bucket >= 0").groupBy("bucket").applyInArrow(answer, ANSWER)


CLASSED = "chunk int, bucket int, payload binary, types array<long>"
UNSEEN = 65535  # the class of a word without training counts
#: Piles in which the chunks' class bigrams are added up; the driver gets so many tables of counts.
PILES = 64
SLICE = 20_000


def rare_classes(tokens: DataFrame, buckets: int, items: dict[int, int], label: np.ndarray, table: np.ndarray) -> DataFrame:
    """CLASSED rows: a class for each of a chunk's words that isn't an item, from all its contexts; and for each bucket a row with chunk -1 that has the types of each class."""
    vocabulary, k = Vocabulary(items), len(table)
    total = table.sum()
    after, before = (table.sum(axis=0) + 1) / (total + k), (table.sum(axis=1) + 1) / (total + k)
    # what a context adds to the likelihood in each class: classes before the word, then classes after it
    gain = np.concatenate([
        np.log((table + 5.0 * before[:, None]) / (table.sum(axis=0)[None, :] + 5.0)),
        np.log((table + 5.0 * after[None, :]) / (table.sum(axis=1)[:, None] + 5.0)).T,
    ])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk, n, payload in zip(*(batch.column(x).to_pylist() for x in ("chunk", "n", "payload")), strict=True):
                keys, shapes, t = _unpack_tokens(payload, n)
                item = vocabulary.of(keys, shapes)
                rare, kind = item >= len(items), label[item]
                at = np.flatnonzero(rare[t])  # never the last token, which is an end
                left = np.concatenate((label[:1], kind[t[:-1]])) if len(t) else t
                code = np.concatenate((t[at] * 2 * k + left[at], t[at] * 2 * k + k + kind[t[at + 1]]))
                code, times = np.unique(code, return_counts=True)
                words = np.flatnonzero(rare)
                sizes = np.bincount(code // (2 * k), minlength=len(keys))[words]
                starts = np.concatenate(([0], np.cumsum(sizes)))
                cuts, out = _cuts(keys[words], buckets), []
                for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if hi > lo:
                        a, z = starts[lo], starts[hi]
                        out.append((b, chunk, hi - lo, press.compress(_planes(keys[words[lo:hi]], ">u8") + _planes(sizes[lo:hi], "<u4") + (code[a:z] % (2 * k)).astype("<u2").tobytes() + _planes(times[a:z], "<u4"))))
                yield from X.sent_table(out).to_batches()

    def assign(table: pa.Table) -> pa.Table:
        unpress, got = zstandard.ZstdDecompressor(), []
        rows = sorted(zip(table.column("chunk").to_pylist(), table.column("n").to_pylist(), table.column("payload").to_pylist(), strict=True))
        for _, n, payload in rows:
            raw = np.frombuffer(unpress.decompress(payload), dtype=np.uint8)
            sizes = _from_planes(raw[8 * n : 12 * n], "<u4").astype(np.int64)
            m = int(sizes.sum())
            got.append((_from_planes(raw[: 8 * n], ">u8").astype(np.uint64), sizes, np.concatenate(([0], np.cumsum(sizes))), raw[12 * n : 12 * n + 2 * m].view("<u2"), _from_planes(raw[12 * n + 2 * m :], "<u4")))
        keys = np.unique(np.concatenate([g[0] for g in got]))
        place = [np.searchsorted(keys, g[0]) for g in got]
        best = np.empty(len(keys), dtype=np.int64)
        for lo in range(0, len(keys), SLICE):
            n, codes, times = min(SLICE, len(keys) - lo), [], []
            for p, (_, sizes, starts, context, count) in zip(place, got, strict=True):
                a, z = np.searchsorted(p, (lo, lo + n))
                codes.append(np.repeat(p[a:z] - lo, sizes[a:z]) * 2 * k + context[starts[a] : starts[z]])
                times.append(count[starts[a] : starts[z]])
            seen = np.bincount(np.concatenate(codes), weights=np.concatenate(times), minlength=n * 2 * k).reshape(n, 2 * k)
            best[lo : lo + n] = np.where(seen.any(axis=1), np.argmax(seen @ gain, axis=1), UNSEEN)
        bucket, press = table.column("bucket")[0].as_py(), zstandard.ZstdCompressor(level=1)
        out = [(chunk, bucket, press.compress(best[p].astype("<u2").tobytes()), None) for (chunk, _, _), p in zip(rows, place, strict=True)]
        out.append((-1, bucket, None, np.bincount(best[best != UNSEEN], minlength=k).tolist()))
        a, b, c, d = zip(*out, strict=True)
        return pa.table({"chunk": pa.array(a, pa.int32()), "bucket": pa.array(b, pa.int32()), "payload": pa.array(c, pa.binary()), "types": pa.array(d, pa.list_(pa.int64()))})

    return tokens.select("chunk", "n", "payload").mapInArrow(contexts, X.SENT).groupBy("bucket").applyInArrow(assign, CLASSED)


def _kinds(keys: np.ndarray, item: np.ndarray, label: np.ndarray, top: int, buckets: int, got: dict[int, bytes]) -> np.ndarray:
    """Classes of a chunk's sorted words from the replies of its buckets; unknown words have their group's."""
    kind, words = label[item], np.flatnonzero(item >= top)
    cuts, unpress = _cuts(keys[words], buckets), zstandard.ZstdDecompressor()
    for b, p in got.items():
        mine = np.frombuffer(unpress.decompress(p), dtype="<u2").astype(np.int64)
        at = words[cuts[b] : cuts[b + 1]]
        kind[at] = np.where(mine == UNSEEN, kind[at], mine)
    return kind


def fit_brown(tokens: DataFrame, counts: DataFrame, buckets: int, top_words: int, classes: int, share: float) -> tuple[BrownModel, DataFrame]:
    """Classes and class bigrams from the chunks' tokens and the corpus's counts; the model and CLASSED rows."""
    about = counts.filter("chunk = -1")
    sums = about.agg(F.sum("tokens"), *(F.sum(F.col("types")[k]) for k in range(SHAPES))).first()
    n_tokens, n_types = sums[0] or 0, sum(x or 0 for x in sums[1:])
    best = (F.col("n").desc(), F.col("key"))
    # the best of 64 slices first: the driver gets as many rows however many buckets there are
    top = about.select(F.explode("top").alias("t")).select("t.*").withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(64)))
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("slice").orderBy(*best))).filter(F.col("r") <= top_words).groupBy().agg(F.array_agg(F.struct(F.col("n"), F.col("key"), F.col("shape"))).alias("t"))
    top = sorted((top.first()["t"] or []), key=lambda r: (-r["n"], r["key"]))[:top_words]
    end = word_key(END) - (1 << 64 if word_key(END) >= 1 << 63 else 0)
    rows = [r for r in top if r["key"] != end]
    keys = [word_key(END)] + [r["key"] % (1 << 64) for r in rows]  # item 0 is the end of a text, which also stands before a text
    items = {k: i for i, k in enumerate(keys)}
    top_n, size = len(items), len(items) + SHAPES
    vocabulary = Vocabulary(items)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for n, payload in zip(batch.column("n").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                keys, shapes, t = _unpack_tokens(payload, n)
                ids = vocabulary.of(keys, shapes)[t]
                table += np.bincount(np.concatenate(([0], ids[:-1])) * size + ids if len(ids) else ids, minlength=size * size)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["pair", "n"])

    # at most size * size rows
    found = tokens.select("n", "payload").mapInArrow(bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size)
    table[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    table = table.reshape(size, size)
    label = exchange_classes(table, min(classes, size))
    k = int(label.max()) + 1
    one = np.zeros((size, k))
    one[np.arange(size), label] = 1.0
    classed = stored(rare_classes(tokens, buckets, items, label, one.T @ table @ one), "classes")

    def class_bigrams(chunk: int, left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.column("n")[0].as_py()
        keys, shapes, t = _unpack_tokens(left.column("payload")[0].as_py(), n)
        got = dict(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True))
        ids = _kinds(keys, vocabulary.of(keys, shapes), label, top_n, buckets, got)[t]
        pairs = np.bincount(np.concatenate((label[:1], ids[:-1])) * k + ids if len(ids) else ids, minlength=k * k)
        return packed(chunk % PILES, pairs)

    def packed(pile: int, pairs: np.ndarray) -> pa.Table:
        return pa.table({"pile": pa.array([pile], pa.int32()), "pairs": pa.array([zstandard.ZstdCompressor(level=1).compress(pairs.astype("<i8").tobytes())], pa.binary())})

    def added(table: pa.Table) -> np.ndarray:
        unpress, total = zstandard.ZstdDecompressor(), np.zeros(k * k, dtype=np.int64)
        for p in table.column("pairs").to_pylist():
            total += np.frombuffer(unpress.decompress(p), dtype="<i8")
        return total

    # one packed table of k * k counts per chunk, then per pile
    pile = "pile int, pairs binary"
    replies = classed.filter("chunk >= 0").select("chunk", "bucket", "payload")
    piles = X.per_chunk_with(tokens.select("chunk", "n", "payload"), replies, class_bigrams, pile, packed(0, np.zeros(0)).schema)
    table = added(piles.groupBy("pile").applyInArrow(lambda t: packed(t.column("pile")[0].as_py(), added(t)), pile).toArrow()).astype(float)
    rare = classed.filter("chunk = -1").agg(*(F.sum(F.col("types")[c]) for c in range(k))).first()
    types = np.bincount(label, minlength=k) + np.array([x or 0 for x in rare])
    return BrownModel(items, label, table.reshape(k, k), types, int(n_tokens), int(n_types), share), classed


OUT = "id {id}, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def brown_scores(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", *, top_words: int = TOP_WORDS, classes: int = CLASSES, share: float = SHARE) -> tuple[DataFrame, BrownModel]:
    """Scores of all rows by a model of the rows where `train` is true, and the model.

    Rows: id, n_tokens, n_known (tokens that training has), train_tokens, base_score and score (log10 of the text's probability), perplexity.
    """
    marked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    docs = X.chunked(marked, "id", "text", extra=("train",))
    buckets = X.bucket_count(df)
    words = stored(sent_words(docs, buckets), "words")
    counts = stored(corpus_counts(words, top_words), "counts")
    model, classed = fit_brown(words.filter("bucket = -1"), counts, buckets, top_words, classes, share)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = marked.schema["id"].dataType.simpleString()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = OUT.format(id=kind)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def score(chunk: int, table: pa.Table, got: pa.Table) -> pa.Table:
        c, m = _Chunk(table), sent.value
        cuts, total = _cuts(c.keys[c.sorted], buckets), np.zeros(len(c.keys), dtype=np.int64)
        unpress = zstandard.ZstdDecompressor()
        for b, p in X.replies(got, 0).items():
            n = cuts[b + 1] - cuts[b]
            total[cuts[b] : cuts[b + 1]] = np.ascontiguousarray(np.frombuffer(unpress.decompress(p), dtype=np.uint8).reshape(8, n).T).view("<u8").ravel()
        count = np.empty_like(total)
        count[c.sorted] = total
        shapes = np.fromiter((shape(w) for w in c.words), dtype=np.int64, count=len(c.words))[c.sorted]
        kinds = np.empty(len(total), dtype=np.int64)
        kinds[c.sorted] = _kinds(c.keys[c.sorted], Vocabulary(m.items).of(c.keys[c.sorted], shapes), m.label, len(m.items), buckets, X.replies(got, 1))
        kind, cnt = kinds[c.tokens], count[c.tokens]
        starts = np.cumsum(c.lengths) - c.lengths
        before = np.concatenate((m.label[:1], kind[:-1]))
        before[starts] = m.label[0]
        base, own = m.probabilities(kind, before, cnt)
        take = pa.array(c.order)
        return pa.table(
            [table.column("id").combine_chunks().take(take), pa.array(c.lengths), pa.array(np.add.reduceat((cnt > 0).astype(np.int64), starts)), pa.array(np.full(len(starts), m.tokens, dtype=np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(own, starts))],
            names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    replies = [x.filter("chunk >= 0").select("chunk", "bucket", F.lit(k).alias("round"), "payload") for k, x in enumerate((counts, classed))]
    replies = replies[0].unionAll(replies[1])
    out = X.per_chunk_with(docs, replies, score, schema, arrow)
    return out.withColumnRenamed("id", id_col).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))), model


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents` by a model of those outside the held-out seventh."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.expr("coalesce(crc32(CAST(doc_id AS string)) % 7 = 2, false)")
    scores, _ = brown_scores(docs, ~held)
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
