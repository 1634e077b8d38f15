"""Chunks of documents that ask the whole corpus about 64-bit keys.

A *chunk* is a set of a few thousand documents dealt out by a hash of their
content.  A chunk sends each distinct key once to the bucket that owns the key
range, and gets back one answer per key in the order sent, so neither document
ids nor positions travel.  A key that a third of all documents hold reaches its
bucket once per chunk, not once per document.

Everything is plain shuffles of packed blobs: a lost executor's part is made
again from lineage.  Chunks sort their rows by content first, so a repeated run
sends the same blobs whatever order a shuffle delivered the rows in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._store import small_batches

U64 = np.uint64
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1
SENT = "bucket int, chunk int, n int, payload binary"
REPLY = "chunk int, bucket int, round int, payload binary"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(df: DataFrame) -> int:
    """Half the shuffle partitions: each chunk sends a blob to each bucket, so their number is kept low."""
    return max(1, partitions(df) // 2)


def chunked(df: DataFrame, id_col: str, text_col: str, chunks: int | None = None, extra: Iterable[str] = ()) -> DataFrame:
    """(chunk, id, text, extra...): rows dealt to chunks by a hash of id and text; other columns are left behind."""
    small_batches(df.sparkSession)
    n = chunks or 2 * partitions(df)
    cols = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(c) for c in extra)]
    return df.select(*cols).select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int").alias("chunk"), "*")


def rows(table: pa.Table) -> tuple[list, list[bytes | None], np.ndarray]:
    """Ids and texts (bytes, None for null) of a chunk in an order that only their content decides; the order itself."""
    ids, texts = table.column("id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
    key = [(xxhash.xxh3_128_digest(t or b""), t is None, str(i)) for i, t in zip(ids, texts, strict=True)]
    order = sorted(range(len(key)), key=key.__getitem__)
    return [ids[k] for k in order], [texts[k] for k in order], np.array(order, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which the high bits depend on all bits."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


class Rolling:
    """Polynomial hashes modulo 2**64 of all windows of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        n = len(values)
        inv = pow(base, -1, 1 << 64)
        self.pow = powers(base, n + 1)
        self.sum = np.zeros(n + 1, dtype=U64)
        np.cumsum(values * powers(inv, n), out=self.sum[1:])

    def windows(self, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Equal for equal windows, wherever they start."""
        ends = starts + length
        return (self.sum[ends] - self.sum[starts]) * self.pow[ends - 1]


def send(chunk: int, keys: np.ndarray, buckets: int, *columns: np.ndarray) -> list[tuple]:
    """SENT rows for sorted distinct keys; columns are per-key values that travel along."""
    if not len(keys):
        return []
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=U64)
    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    return [
        (b, chunk, hi - lo, b"".join([keys[lo:hi].tobytes(), *(c[lo:hi].tobytes() for c in columns)]))
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))
        if hi > lo
    ]


def sent_table(out: list[tuple]) -> pa.Table:
    b, c, n, p = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"bucket": pa.array(b, pa.int32()), "chunk": pa.array(c, pa.int32()), "n": pa.array(n, pa.int32()), "payload": pa.array(p, pa.binary())})


def reply_table(out: list[tuple]) -> pa.Table:
    c, b, r, p = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.table({"chunk": pa.array(c, pa.int32()), "bucket": pa.array(b, pa.int32()), "round": pa.array(r, pa.int32()), "payload": pa.array(p, pa.binary())})


def unpack(table: pa.Table, *dtypes: type) -> tuple[list, list, list[np.ndarray]]:
    """Chunk and length of each blob of a bucket, in chunk order, and the concatenated columns."""
    got = sorted(zip(table.column("chunk").to_pylist(), table.column("n").to_pylist(), table.column("payload").to_pylist(), strict=True), key=lambda x: x[0])
    columns: list[list[np.ndarray]] = [[] for _ in dtypes]
    for _, n, payload in got:
        at = 0
        for k, d in enumerate(dtypes):
            columns[k].append(np.frombuffer(payload, dtype=d, count=n, offset=at))
            at += n * np.dtype(d).itemsize
    return [x[0] for x in got], [x[1] for x in got], [np.concatenate(c) if c else np.zeros(0, dtype=d) for c, d in zip(columns, dtypes, strict=True)]


def repeated(keys: np.ndarray, many: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
    """For each key: is it there again, or marked as being there more than once by its sender? check: further key bits."""
    order = np.argsort(keys, kind="stable") if check is None else np.lexsort((check, keys))
    k = keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    if check is not None:
        c = check[order]
        new[1:] |= c[1:] != c[:-1]
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=1.0 + many[order])
    out = np.zeros(len(k), dtype=bool)
    out[order] = total[group] > 1
    return out


def ask_repeated(sent: DataFrame, round_no: int, checked: bool) -> DataFrame:
    """REPLY rows: a bit for each key sent, 1 if the corpus holds it twice or more.  sent carries u64 keys, u32 check bits if `checked`, u8 marks."""

    def answer(table: pa.Table) -> pa.Table:
        kinds = (np.uint64, np.uint32, np.uint8) if checked else (np.uint64, np.uint8)
        chunks, counts, cols = unpack(table, *kinds)
        flags = repeated(cols[0], cols[-1], cols[1] if checked else None)
        bucket, at, out = table.column("bucket")[0].as_py(), 0, []
        for c, n in zip(chunks, counts, strict=True):
            if flags[at : at + n].any():  # a missing reply means: none
                out.append((c, bucket, round_no, np.packbits(flags[at : at + n]).tobytes()))
            at += n
        return reply_table(out)

    return sent.groupBy("bucket").applyInArrow(answer, REPLY)


def replies(table: pa.Table, round_no: int) -> dict[int, bytes]:
    return {b: p for b, r, p in zip(table.column("bucket").to_pylist(), table.column("round").to_pylist(), table.column("payload").to_pylist(), strict=True) if r == round_no}


def flags_of(keys: np.ndarray, buckets: int, got: dict[int, bytes]) -> np.ndarray:
    """The bits of a chunk's sorted distinct keys, put together again from the replies of its buckets."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys) and got:
        bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=U64)
        cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
        for b, p in got.items():
            lo, hi = cuts[b], cuts[b + 1]
            out[lo:hi] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=hi - lo).astype(bool)
    return out


def per_chunk(docs: DataFrame, fn: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    return docs.groupBy("chunk").applyInArrow(lambda t: fn(t.column("chunk")[0].as_py(), t), schema)


def per_chunk_with(docs: DataFrame, got: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str, empty: pa.Schema) -> DataFrame:
    """fn(chunk, documents, replies) for each chunk, replies or not."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty.empty_table()
        return fn(left.column("chunk")[0].as_py(), left, right)

    return docs.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(both, schema)


SENT_ARROW = sent_table([]).schema
REPLY_ARROW = reply_table([]).schema
