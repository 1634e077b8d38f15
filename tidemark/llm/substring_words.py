"""Substring dedup over words by difference-cover anchors (operator 2).

A set D of residues modulo v is a difference cover if each difference is one of
two of its members.  Windows of `window - v + 1` words are hashed only where
their start modulo v is in D.  If two stretches of `window` words are equal,
then some offset below v puts both on a cover position, so they share a hashed
anchor there, whatever their alignment.  Anchors that the corpus holds once end
the search; around the others the full windows are hashed and compared (the
extension), so each long match is found and no pair of documents is made.

Cases: null and empty texts have no words; texts with fewer words than a window
lose nothing; repeated rows are documents of their own, so their windows
repeat; rows with a null id are kept; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import _chunks as X

WINDOW = 35
#: A perfect difference set: each difference modulo 21 is that of two members.
PERIOD, COVER = 21, (0, 1, 6, 8, 18)


def difference_cover(period: int) -> tuple[int, ...]:
    """A small set of residues that has every difference modulo `period`, found greedily."""
    if period == PERIOD:
        return COVER
    cover, missing = [0], set(range(1, period))
    while missing:
        best = max(range(1, period), key=lambda r: (len({d for c in cover for d in ((r - c) % period, (c - r) % period)} & missing), -r))
        missing -= {d for c in cover for d in ((best - c) % period, (c - best) % period)}
        cover.append(best)
    return tuple(sorted(cover))


class _Words:
    """The words of a chunk's documents, one after the other, with hashes of their windows."""

    def __init__(self, table: pa.Table):
        self.ids, texts, self.order = X.rows(table)
        self.words = [(t or b"").split() for t in texts]  # bytes split at \x20 and \x09-\x0D only
        self.counts = np.array([len(w) for w in self.words], dtype=np.int64)
        self.ends = np.cumsum(self.counts)
        h = xxhash.xxh3_64_intdigest
        self.hashes = np.fromiter((h(w) for ws in self.words for w in ws), dtype=np.uint64, count=int(self.counts.sum()))
        self.doc_start = np.repeat(self.ends - self.counts, self.counts)
        self.left = np.repeat(self.ends, self.counts) - np.arange(len(self.hashes))  # words from here to the document's end
        self.rolling = X.Rolling(self.hashes)

    def anchors(self, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the cover's windows, and their hashes."""
        on = np.zeros(period, dtype=bool)
        on[list(cover)] = True
        length = window - period + 1
        at = np.flatnonzero(on[(np.arange(len(self.hashes)) - self.doc_start) % period] & (self.left >= length))
        return at, X.mix(self.rolling.windows(at, length))


def _unique(keys: np.ndarray, check: np.ndarray | None = None) -> tuple:
    """Sorted distinct keys, their check bits, marks of those there twice or more, and the place of each key among them."""
    order = np.argsort(keys, kind="stable") if check is None else np.lexsort((check, keys))
    k = keys[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    c = None
    if check is not None:
        c = check[order]
        new[1:] |= c[1:] != c[:-1]
        c = c[new]
    group = np.cumsum(new) - 1
    place = np.empty(len(k), dtype=np.int64)
    place[order] = group
    many = (np.bincount(group, minlength=int(new.sum())) > 1).astype(np.uint8)
    return k[new], c, many, place


OUT = "id {id}, n_words long, n_removed long, kept binary, kept_sha256 string, spans array<struct<start:int,length:int>>"


def remove_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, chunks: int | None = None, with_text: bool = True) -> DataFrame:
    """Remove each word covered by a window of `window` words that starts anywhere else too.

    Returns per row: the id, n_words, n_removed, kept_text (kept words joined by a
    space; null if not `with_text`), kept_sha256, and the removed spans of words.
    """
    if not 1 <= period <= window:
        raise ValueError("period must be between 1 and window")
    cover = difference_cover(period)
    docs = X.chunked(df, id_col, text_col, chunks)
    buckets = X.bucket_count(df)
    id_type = docs.schema["id"].dataType.simpleString()

    def anchors(chunk: int, table: pa.Table) -> pa.Table:
        w = _Words(table)
        _, hashes = w.anchors(window, period, cover)
        keys, _, many, _ = _unique(hashes)
        return X.sent_table(X.send(chunk, keys, buckets, many))

    def candidates(w: _Words, got: pa.Table) -> tuple:
        """Windows around an anchor that the corpus holds again, with their keys."""
        at, hashes = w.anchors(window, period, cover)
        keys, _, _, place = _unique(hashes)
        hit = np.zeros(len(w.hashes) + 1, dtype=np.int64)
        hit[at[X.flags_of(keys, buckets, X.replies(got, 1))[place]] + 1] = 1 if len(at) else 0
        seen = np.cumsum(hit)  # hits before each position
        starts = np.flatnonzero(w.left >= window)
        starts = starts[seen[starts + period] > seen[starts]] if len(starts) else starts
        second = X.Rolling(X.mix(w.hashes), X.BASE2)
        return starts, X.mix(w.rolling.windows(starts, window)), (X.mix(second.windows(starts, window)) >> np.uint64(32)).astype(np.uint32)

    def extend(chunk: int, table: pa.Table, got: pa.Table) -> pa.Table:
        _, keys, check = candidates(_Words(table), got)
        keys, check, many, _ = _unique(keys, check)
        return X.sent_table(X.send(chunk, keys, buckets, check, many))

    out_schema = OUT.format(id=id_type)

    def remove(chunk: int, table: pa.Table, got: pa.Table) -> pa.Table:
        w = _Words(table)
        starts, keys, check = candidates(w, got)
        keys, _, _, place = _unique(keys, check)
        starts = starts[X.flags_of(keys, buckets, X.replies(got, 2))[place]]
        edge = np.zeros(len(w.hashes) + 1, dtype=np.int64)
        edge[starts] += 1
        edge[starts + window] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        n_removed, kept, sha, spans = [], [], [], []
        for words, end, n in zip(w.words, w.ends.tolist(), w.counts.tolist(), strict=True):
            g = gone[end - n : end]
            k = int(g.sum())
            left = words if not k else [x for x, out in zip(words, g.tolist(), strict=True) if not out]
            text = b" ".join(left)
            n_removed.append(k)
            kept.append(text if with_text else None)
            sha.append(hashlib.sha256(text).hexdigest())
            step = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8))) if k else np.zeros(0, dtype=int)
            spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(step[::2], step[1::2], strict=True)])
        ids = table.column("id").combine_chunks().take(pa.array(w.order))
        return pa.table({"id": ids, "n_words": pa.array(w.counts), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))})

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(out_schema))
    first = X.ask_repeated(X.per_chunk(docs, anchors, X.SENT), 1, False)
    second = X.ask_repeated(X.per_chunk_with(docs, first, extend, X.SENT, X.SENT_ARROW), 2, True)
    out = X.per_chunk_with(docs, first.unionByName(second), remove, out_schema, arrow)
    return out.selectExpr(f"id AS `{id_col}`", "n_words", "n_removed", "CAST(kept AS string) AS kept_text", "kept_sha256", "spans")


def op2_substring_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of `documents` outside windows of 35 words that start anywhere else too, as counts and a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_windows(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP2_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM docs WHERE len(w) >= 35),
runs AS (SELECT r, s, array_to_string(w[s : s + 34], ' ') AS run FROM starts),
again AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY run) AS n FROM runs) WHERE n > 1),
covered AS (SELECT DISTINCT r, s + j AS p FROM again, (SELECT unnest(range(35)) AS j)),
removed AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN removed m USING (r) LEFT JOIN kept k USING (r)
"""
