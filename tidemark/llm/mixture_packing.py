"""Mixture-controlled packing (operator 6).

1. Documents become token ids with one end id each, once; the ids are written to
   the shared folder, in rows of at most `CHUNK` ids, each with its place among
   the tokens of its source within its input split.
2. Token counts by split and source give every row its place among all tokens of
   its source.  Partition p of P packs the tokens between the shares p / P and
   (p + 1) / P of *each* source, so it holds every source in the mixture of the
   whole, to a token; a row that lies across such a border is in both.
3. In a partition each source is a queue.  Deficit round-robin fills one window
   after the other: a window grants each queue its target share of the window's
   tokens, a queue whose deficit is at least the quantum sends that much, and the
   largest deficits fill what is left.  Deficits carry over from window to
   window, and from partition to partition: the deficit at a partition's start is
   what the target owes each source over all partitions before it, which follows
   from token counts alone.  So partitions are packed side by side.

While no queue has run dry, a source's tokens in a window are within about two
quanta of its target.  With targets left to the corpus, queues run dry together,
at the end.  All windows are full but the last of a partition.

Nothing is gathered but the number of all tokens.  The queue order is that of the
input's splits; another splitting of the same rows packs them otherwise.

Cases: null and empty texts are an end id alone; a null source is a source;
repeated rows are packed each; rows with a null id are packed; other columns
are ignored, whatever their names; an empty table gives an empty result; a very
long text is cut into rows of `CHUNK` ids before it is moved.  An end id may be
cut from its document, as any id may.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._store import small_batches, stored

SEQUENCE, QUANTUM, END_ID = 1024, 16, 0
#: Ids in a row at most.
CHUNK = 65_536
#: Tokens of a partition: at least the first, where there are enough, and at most about the second.
LEAST_PART, MOST_PART = 65_536, 1 << 23
#: Rows of counts (some 50 bytes each) that are broadcast; more are joined by a shuffle.
MAX_SENT_COUNTS = 100_000
SPECIAL = "<|endoftext|>"
_LOADED: dict = {}


def encoder(tokenizer: str):
    """A function from a list of texts to lists of ids, as `tokenizers` gives them with add_special_tokens=False.

    tokenizer: a path, or the name of a public tokenizer's file.  The byte-level
    vocabulary also exists as ranks, from which tiktoken makes the same ids in a
    fifth of the time; texts that hold a special token's string still go to
    `tokenizers`.
    """
    if tokenizer not in _LOADED:
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        exact = Tokenizer.from_file(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        exact.no_truncation()
        exact.no_padding()

        def slow(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in exact.encode_batch(texts, add_special_tokens=False)]

        fast = None
        if tokenizer == "byte_bpe_50k.json":
            import tiktoken

            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _LOADED[tokenizer] = (lambda texts: [slow([t])[0] if SPECIAL in t else fast(t) for t in texts]) if fast else slow
    return _LOADED[tokenizer]


def tokenized(df: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """(split, id, source, run, doc_tokens, start, n, ids): ids as compressed unsigned 32-bit integers, or 16-bit where all fit.

    run: tokens of the source before the row, in its split; start: ids of the document before the row.
    """
    docs = df.select(F.spark_partition_id().alias("split"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{source_col}`").cast("string").alias("source"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, press = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        seen: defaultdict[str | None, int] = defaultdict(int)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [(t or b"").decode("utf-8", "replace") for t in batch.column("text").cast(pa.binary()).to_pylist()]
                take, out = [], []
                for k, (source, got) in enumerate(zip(batch.column("source").to_pylist(), encode_texts(texts), strict=True)):
                    a = np.array([*got, end_id], dtype=np.uint32)
                    for start in range(0, len(a), CHUNK):
                        mine = a[start : start + CHUNK]
                        take.append(k)
                        out.append((seen[source], len(a), start, len(mine), press.compress((mine.astype("<u2") if mine.max() < 65536 else mine.astype("<u4")).tobytes())))
                        seen[source] += len(mine)
                rows = pa.array(take, pa.int64())
                cols = list(zip(*out, strict=True)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in ("split", "id", "source")), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())],
                    ["split", "id", "source", "run", "doc_tokens", "start", "n", "ids"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(encode, f"split int, id {kind}, source string, run long, doc_tokens long, start long, n long, ids binary")


class DeficitRoundRobin:
    """Cuts the documents of source queues into pieces and says which goes where.

    shares: target by source; credits: what each source is owed at the start.
    """

    def __init__(self, shares: Mapping[str | None, float], credits: Mapping[str | None, float], sequence: int = SEQUENCE, quantum: int = QUANTUM):
        self.shares, self.credits = dict(shares), dict(credits)
        self.sequence, self.quantum = sequence, quantum

    def pack(self, queues: Mapping[str | None, list[tuple[int, int]]]) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, start, length, window, offset), in order.  queues: per source (document, tokens), in queue order."""
        names = sorted((s for s, q in queues.items() if q), key=lambda s: (s is None, s or ""))
        left = np.array([sum(n for _, n in queues[s]) for s in names], dtype=np.int64)
        share = np.array([self.shares.get(s, 0.0) for s in names])
        credit = np.array([self.credits.get(s, 0.0) for s in names], dtype=float)
        head = [0] * len(names)  # document of each queue that is next
        begun = [0] * len(names)  # its tokens that are out already
        window = filled = turn = 0

        def send(q: int, n: int) -> Iterator[tuple[int, int, int, int, int]]:
            nonlocal filled
            credit[q] -= n
            left[q] -= n
            queue = queues[names[q]]
            while n:
                doc, tokens = queue[head[q]]
                part = min(n, tokens - begun[q])
                if part:
                    yield doc, begun[q], part, window, filled
                filled += part
                n -= part
                begun[q] += part
                if begun[q] == tokens:
                    head[q] += 1
                    begun[q] = 0

        while left.any():
            live = left > 0
            wanted = share[live].sum()
            # sources without a target go on once all others have run dry
            credit[live] += self.sequence * (share[live] / wanted if wanted > 0 else 1 / live.sum())
            sends = np.minimum(np.floor(credit + 1e-6).astype(np.int64), left)
            ready = np.flatnonzero(live & (sends >= np.minimum(self.quantum, left)) & (sends > 0))
            first = int(np.searchsorted(ready, turn))
            for q in [*ready[first:].tolist(), *ready[:first].tolist()]:
                if filled < self.sequence:
                    yield from send(q, min(int(sends[q]), self.sequence - filled))
            turn = (turn + 1) % len(names)
            while filled < self.sequence and left.any():
                q = int(np.argmax(np.where(left > 0, credit, -np.inf)))
                yield from send(q, min(self.sequence - filled, int(left[q]), max(self.quantum, int(credit[q]))))
            window, filled = window + 1, 0


SCHEMA = "id {id}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def _few(counts: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows."""
    return F.broadcast(counts) if counts.count() <= MAX_SENT_COUNTS else counts


def pack_mixture(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, tokenizer: str = "byte_bpe_50k.json", targets: Mapping[str, float] | None = None,
    sequence: int = SEQUENCE, quantum: int = QUANTUM, end_id: int = END_ID, parts: int | None = None, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: where it is in its document and in which sequence at what offset.

    targets: wanted share by source; left out, each source's share of all tokens,
    so that every sequence has the corpus's mixture.  With targets that some
    source cannot fill, the others go on when it has run out.
    """
    given = dict(targets) if targets is not None else None
    if given is not None and (not given or min(given.values()) < 0 or sum(given.values()) <= 0):
        raise ValueError("targets must be shares of at least 0, not all 0")
    spark = df.sparkSession
    small_batches(spark)
    rows = stored(tokenized(df, id_col, text_col, source_col, tokenizer, end_id), "tokens")
    counts = rows.groupBy("split", "source").agg(F.sum("n").alias("tokens"))
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    n_parts = parts or max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // LEAST_PART), -(-total // MOST_PART), 1)
    own = Window.partitionBy("source")
    earlier = F.coalesce(F.sum("tokens").over(own.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(counts.select(F.col("split").alias("split2"), F.col("source").alias("source2"), earlier.alias("earlier"), F.sum("tokens").over(own).alias("all_tokens")), "offsets")

    def placed(table: DataFrame) -> DataFrame:
        """A row per input row and partition that has some of it: ids from skip on, n of them."""
        at = table.join(_few(offsets), (F.col("split") == F.col("split2")) & F.col("source").eqNullSafe(F.col("source2"))).withColumn("pos", F.col("earlier") + F.col("run"))
        # partition p begins at floor(p * all / P) of each source, so position x lies in ((x + 1) * P - 1) div all
        at = at.withColumn("part", F.expr(f"explode(sequence(((pos + 1) * {n_parts} - 1) div all_tokens, ((pos + n) * {n_parts} - 1) div all_tokens))"))
        at = at.withColumn("low", F.expr(f"(part * all_tokens) div {n_parts}")).withColumn("lo", F.greatest("pos", "low"))
        hi = F.least(F.col("pos") + F.col("n"), F.expr(f"((part + 1) * all_tokens) div {n_parts}"))
        return at.withColumn("skip", F.col("lo") - F.col("pos")).withColumn("mine", hi - F.col("lo"))

    # without ids: the scan reads four columns of counts
    by_part = placed(rows.select("split", "source", "run", "n")).groupBy("part").agg(F.sum("mine").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    windows = F.ceil(F.col("tokens") / F.lit(sequence)).cast("long")
    by_part = stored(by_part.select(F.col("part").alias("part2"), *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(name) for x, name in ((F.col("tokens"), "before"), (windows, "first")))), "parts")
    docs = placed(rows).join(_few(by_part), F.col("part") == F.col("part2"))
    docs = docs.select("part", "id", "source", "lo", "skip", "mine", "doc_tokens", F.col("start"), "n", "ids", "low", "all_tokens", "before", "first")

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = SCHEMA.format(id=docs.schema["id"].dataType.simpleString())
    arrow = to_arrow_schema(_parse_datatype_string(out_schema))

    def pack(table: pa.Table) -> pa.Table:
        source, lo, skip, mine, doc_tokens, start, n = (table.column(c).to_pylist() for c in ("source", "lo", "skip", "mine", "doc_tokens", "start", "n"))
        done, first = table.column("before")[0].as_py(), table.column("first")[0].as_py()
        facts = dict(zip(source, zip(table.column("low").to_pylist(), table.column("all_tokens").to_pylist(), strict=True), strict=True))
        if given is None:
            shares = {s: every / total for s, (_, every) in facts.items()}
        else:
            shares = {s: given.get(s, 0.0) / sum(given.values()) for s in facts}
        # what targets that aren't the corpus's owe from earlier partitions, their sources had run out of there
        credits = {s: every / total * done - low for s, (low, every) in facts.items()} if given is None else {}
        queues: dict[str | None, list[tuple[int, int]]] = {}
        for k in sorted(range(len(lo)), key=lo.__getitem__):
            queues.setdefault(source[k], []).append((k, mine[k]))
        blobs, unpress = table.column("ids"), zstandard.ZstdDecompressor()
        held: dict[int, np.ndarray] = {}
        out = []
        for k, begun, length, window, offset in DeficitRoundRobin(shares, credits, sequence, quantum).pack(queues):
            a = held.get(k)
            if a is None:
                raw = unpress.decompress(blobs[k].as_py())
                a = held[k] = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n[k] else "<u4")[skip[k] : skip[k] + mine[k]].astype("<u4")
            ids = a[begun : begun + length]
            out.append((k, start[k] + skip[k] + begun, length, zlib.crc32(ids), doc_tokens[k], first + window, offset, ids.astype(np.int32) if with_ids else None))
            if begun + length == mine[k]:
                del held[k]
        cols = list(zip(*out, strict=True))
        take = pa.array(cols[0], pa.int64())
        return pa.table(
            [table.column("id").combine_chunks().take(take), table.column("source").combine_chunks().take(take), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.list_(pa.int32()))],
            schema=arrow,
        )

    return docs.groupBy("part").applyInArrow(pack, out_schema).withColumnRenamed("id", id_col)


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of at most 1024 tokens, as pieces with a digest of their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_mixture(docs, with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
