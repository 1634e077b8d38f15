"""Substring dedup over bytes by a hash-compared suffix sort (operator 7).

Each byte covered by a string of `window` bytes that starts anywhere else too is
removed.  Sorting all suffixes of a corpus is too much to move, so only those
are sorted that can matter:

1. Positions are sampled by content: in each run of window - GRAM + 1 grams of
   GRAM bytes, those with the least hash.  Equal strings of `window` bytes hold
   equal samples at equal places, so each repeated string has a sample in it
   whose gram is found again.
2. Samples whose gram the corpus holds once are done.  The others send their
   surroundings to the gram's bucket: as far as a string of `window` bytes that
   holds the gram can reach, each distinct surrounding once per chunk.
3. A bucket sorts each gram's suffixes (and its prefixes, read backwards) by
   mergesort.  A comparison finds the common extension by binary search over
   prefix polynomial hashes and then looks at one byte, so it takes log(window)
   steps.  Clusters of suffixes are joined from the longest common extension
   down; the smaller cluster is looked up in the order of prefixes of the
   larger.  This gives each sample how far to the left and right it is repeated
   within strings of `window` bytes, without pairing the members of a group.
   Matches found through hashes are compared byte by byte; a group with a
   collision is done again without hashes.
4. Grams held more than `HOT` times send 96-bit hashes of their strings instead
   of surroundings, so that no group outgrows a task.

Cases: null and empty texts have no bytes; texts shorter than the window lose
nothing; matches never cross documents; repeated rows are documents of their
own; rows with a null id are kept; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import _chunks as X

WINDOW, GRAM, HOT = 200, 50, 2_000
_BYTES = np.random.default_rng(77).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTES2 = np.random.default_rng(78).integers(0, 1 << 64, 256, dtype=np.uint64)
_BATCH = 1 << 20
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over each run of `width` values, by doubling."""
    s = 1
    while 2 * s <= width:
        x = op(x[:-s], x[s:])
        s *= 2
    return op(x[: len(x) - (width - s)], x[width - s :]) if s < width else x


class Batch:
    """Some documents of a chunk, one after the other."""

    def __init__(self, first: int, texts: list[bytes]):
        self.first, self.texts = first, texts
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.ends = np.cumsum(self.lengths)

    @property
    def left(self) -> np.ndarray:
        """Bytes from each position to its document's end; made when asked for, as it takes four bytes a byte."""
        return (np.repeat(self.ends, self.lengths) - np.arange(len(self.bytes))).astype(np.int32)

    def samples(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled positions and the hashes of their grams, mixed again: as least values they would all be in the lowest bucket."""
        n = len(self.bytes)
        if n < window or not (self.lengths >= window).any():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        left = self.left
        h = X.mix(X.Rolling(_BYTES[self.bytes]).windows(np.arange(n - gram + 1), gram))
        h[left[: len(h)] < gram] = _TOP
        run = window - gram + 1
        least = _slide(np.minimum, h, run)
        least[left[: len(least)] < window] = 0
        pad = np.zeros(run - 1, dtype=np.uint64)
        most = _slide(np.maximum, np.concatenate([pad, least, pad]), run)[: len(h)]
        at = np.flatnonzero((most == h) & (h != _TOP))
        return at, X.mix(h[at])


def _batches(texts: list[bytes]) -> Iterator[Batch]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= _BATCH:
            yield Batch(start, texts[start : k + 1])
            start, size = k + 1, 0
    if start < len(texts):
        yield Batch(start, texts[start:])


class Order:
    """Suffixes from anchors to the right, or prefixes from them to the left, compared by hashes."""

    def __init__(self, data: np.ndarray, rolling: X.Rolling, anchors: np.ndarray, reach: np.ndarray, right: bool):
        self.data, self.rolling, self.anchors, self.reach, self.right = data, rolling, anchors, reach, right

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of pairs, by binary search."""
        lo, hi = np.zeros(len(x), dtype=np.int64), np.minimum(self.reach[x], self.reach[y])
        a, b = self.anchors[x], self.anchors[y]
        while True:
            go = lo < hi
            if not go.any():
                return lo
            mid = (lo + hi + 1) // 2
            if self.right:
                same = self.rolling.windows(a, mid) == self.rolling.windows(b, mid)
            else:
                same = self.rolling.windows(a - mid, mid) == self.rolling.windows(b - mid, mid)
            lo, hi = np.where(go & same, mid, lo), np.where(go & ~same, mid - 1, hi)

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Is x before y? The byte after the common extension decides, then the length, then the number."""
        n = self.common(x, y)
        end = (n == self.reach[x]) | (n == self.reach[y])
        step = n if self.right else -n - 1
        last = len(self.data) - 1
        p, q = self.data[np.clip(self.anchors[x] + step, 0, last)], self.data[np.clip(self.anchors[y] + step, 0, last)]
        shorter = np.where(self.reach[x] != self.reach[y], self.reach[x] < self.reach[y], x < y)
        return np.where(end, shorter, p < q)

    def sort(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mergesort of the items of each group. start, size: of each item's group; items of a group are neighbours."""
        n = len(start)
        order, local = np.arange(n), np.arange(n) - start
        run = 1
        while n and run < size.max():
            live = np.flatnonzero(size > run)  # of larger groups only
            s, d, k, item = start[live], size[live], local[live], order[live]
            block = k // run
            low = (block ^ 1) * run
            lo, hi = np.minimum(low, d), np.minimum(low + run, d)
            first = lo.copy()
            while True:
                go = np.flatnonzero(lo < hi)
                if not len(go):
                    break
                mid = (lo[go] + hi[go]) // 2
                other = order[s[go] + mid]
                less = self.before(other, item[go])
                lo[go], hi[go] = np.where(less, mid + 1, lo[go]), np.where(less, hi[go], mid)
            place = s + (block // 2) * 2 * run + (k - block * run) + (lo - first)
            new = order.copy()
            new[place] = item
            order = new
            run *= 2
        return order


def _common_left(x: bytes, y: bytes) -> int:
    """Length of the common prefix of two byte strings."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[:mid] == y[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _join_clusters(members: list[int], extension: list[int], rank: dict[int, int], at_rank: list[int], lefts: list[bytes], window: int, report) -> None:
    """Report matching pairs of a group: enough of them that each member's farthest reach to both sides is among them.

    members: in suffix order; extension[k]: common extension of members k and k + 1.
    """
    parent = list(range(len(members)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    ranks = [[rank[m]] for m in members]
    for k in sorted(range(len(extension)), key=lambda k: -extension[k]):
        r = extension[k]
        a, b = find(k), find(k + 1)
        if len(ranks[a]) < len(ranks[b]):
            a, b = b, a
        large, small = ranks[a], ranks[b]
        for x in small:
            at = bisect_left(large, x)
            for y in large[max(0, at - 1) : at + 1]:
                n = _common_left(lefts[at_rank[x]], lefts[at_rank[y]])
                if n + r >= window:
                    report(at_rank[x], at_rank[y], n, r)
        for x in small:
            insort(large, x)
        parent[b] = a
        ranks[b] = []


def reaches(gram: np.ndarray, left: np.ndarray, many: np.ndarray, contexts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each sample is repeated to the left and (with its gram) to the right; 0 and 0 if it isn't.

    contexts: what surrounds each sample; left: bytes of it before the sample; many: is it there again?
    """
    n = len(contexts)
    length = np.array([len(c) for c in contexts], dtype=np.int64)
    left = left.astype(np.int64)
    right = length - left
    out_left, out_right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    full = (many > 0) & (length >= window)
    out_left[full], out_right[full] = left[full], right[full]
    order = np.lexsort((np.arange(n), gram))
    g = gram[order]
    cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if n else np.zeros(0, dtype=np.int64)
    size = np.diff(np.concatenate((cut, [n])))
    open_ = np.add.reduceat((~full[order]).astype(np.int64), cut) if n else size
    use = (size > 1) & (open_ > 0)  # a group that is repeated as it is needs no more
    take = order[np.repeat(use, size)]
    if not len(take):
        return out_left, out_right
    # groups are sorted some at a time, so that hashes of a few MB of surroundings are held at once
    sizes, done, ends = size[use], 0, np.cumsum(length[take])
    stop = np.cumsum(sizes)
    while done < len(sizes):
        base = ends[stop[done - 1] - 1] if done else 0
        more = max(done + 1, int(np.searchsorted(ends[stop - 1], base + _BATCH, side="right")))
        lo, hi = (stop[done - 1] if done else 0), stop[more - 1]
        _sort_groups(take[lo:hi], sizes[done:more], contexts, left, length, window, out_left, out_right)
        done = more
    return out_left, out_right


def _sort_groups(take: np.ndarray, size: np.ndarray, contexts: list[bytes], left: np.ndarray, length: np.ndarray, window: int, out_left: np.ndarray, out_right: np.ndarray) -> None:
    """Sort the suffixes and prefixes of neighbouring groups and note how far their samples are repeated."""
    right = length - left
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(contexts[k] for k in take.tolist()), dtype=np.uint8)
    offset = np.cumsum(length[take]) - length[take]
    anchors = offset + left[take]
    rolling = X.Rolling(_BYTES[data])
    suffixes = Order(data, rolling, anchors, right[take], True)
    prefixes = Order(data, rolling, anchors, left[take], False)
    item_start, item_size = np.repeat(start, size), np.repeat(size, size)
    by_right, by_left = suffixes.sort(item_start, item_size), prefixes.sort(item_start, item_size)
    after = np.zeros(len(take), dtype=np.int64)
    inner = np.flatnonzero(item_start[1:] == item_start[:-1])
    after[inner] = suffixes.common(by_right[inner], by_right[inner + 1])
    rank = np.empty(len(take), dtype=np.int64)
    rank[by_left] = np.arange(len(take))
    texts = [contexts[k] for k in take.tolist()]
    lefts_of = left[take].tolist()
    for s, d in zip(start.tolist(), size.tolist(), strict=True):
        found: list[tuple[int, int, int, int]] = []
        members = by_right[s : s + d].tolist()
        lefts = {m: texts[m][: lefts_of[m]][::-1] for m in members}
        if d == 2:
            x, y = members
            m, r = _common_left(lefts[x], lefts[y]), int(after[s])
            if m + r >= window:
                found.append((x, y, m, r))
        else:
            low = s
            at_rank = {int(rank[m]) - low: m for m in members}
            _join_clusters(members, after[s : s + d - 1].tolist(), {m: int(rank[m]) - low for m in members}, [at_rank[k] for k in range(d)], lefts, window, lambda x, y, a, b: found.append((x, y, a, b)))  # noqa: B023
        # the bytes themselves, in case hashes met by chance
        right_of = {m: texts[m][lefts_of[m] :] for m in members}
        order_ok = all(_common_left(right_of[a], right_of[b]) == e for a, b, e in zip(members, members[1:], after[s : s + d - 1].tolist(), strict=False))
        if not order_ok:
            found = [(x, y, m, r) for k, x in enumerate(members) for y in members[:k] if (m := _common_left(lefts[x], lefts[y])) + (r := _common_left(right_of[x], right_of[y])) >= window]
        for x, y, m, r in found:
            for k in (take[x], take[y]):
                out_left[k], out_right[k] = max(out_left[k], m), max(out_right[k], r)


def _pack(gram: np.ndarray, left: np.ndarray, many: np.ndarray, contexts: list[bytes]) -> bytes:
    head = np.ascontiguousarray(gram.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    lengths = np.array([len(c) for c in contexts], dtype="<u2").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + left.astype("<u2").tobytes() + lengths + many.astype(np.uint8).tobytes() + b"".join(contexts))


def _unpack(payload: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    a = np.frombuffer(raw, dtype=np.uint8)
    gram = np.ascontiguousarray(a[: 8 * n].reshape(8, n).T).view(">u8").ravel().astype(np.uint64)
    left, lengths = np.frombuffer(raw, "<u2", n, 8 * n), np.frombuffer(raw, "<u2", n, 10 * n).astype(np.int64)
    ends = (13 * n + np.cumsum(lengths)).tolist()
    return gram, left, a[12 * n : 13 * n], [raw[e - k : e] for e, k in zip(ends, lengths.tolist(), strict=True)]


class _Found:
    """The samples of a chunk that the corpus holds again: surroundings of ordinary ones, strings around hot ones."""

    def __init__(self, table: pa.Table, got: pa.Table | None, window: int, gram: int, buckets: int):
        self.ids, texts, self.order = X.rows(table)
        self.texts = [t or b"" for t in texts]
        self.batches = list(_batches(self.texts))
        if not gram:  # the texts alone
            return
        sampled = [b.samples(window, gram) for b in self.batches]
        hashes = np.concatenate([s[1] for s in sampled]) if sampled else np.zeros(0, dtype=np.uint64)
        self.keys, place, self.counts = np.unique(hashes, return_inverse=True, return_counts=True)
        if got is None:
            return
        bits = X.replies(got, 1)
        repeated = X.flags_of(self.keys, buckets, {b: p[: len(p) // 2] for b, p in bits.items()})
        hot = X.flags_of(self.keys, buckets, {b: p[len(p) // 2 :] for b, p in bits.items()})
        reach = window - gram
        contexts: dict[tuple[int, int, bytes], list] = {}
        self.strings: list[np.ndarray] = []  # starts of strings around hot samples, by batch
        starts, checks, at = [], [], 0
        for k, (b, (pos, h)) in enumerate(zip(self.batches, sampled, strict=True)):
            mine = place[at : at + len(pos)]
            at += len(pos)
            size, left = len(b.bytes), b.left
            for p, g in zip(pos[repeated[mine] & ~hot[mine]].tolist(), h[repeated[mine] & ~hot[mine]].tolist(), strict=True):
                end = p + int(left[p])
                d = int(np.searchsorted(b.ends, p, side="right"))
                begin = int(b.ends[d] - b.lengths[d])
                lo = max(begin, p - reach)
                where = b.texts[d][lo - begin : min(end, p + window) - begin]
                contexts.setdefault((g, p - lo, where), []).append((k, p))
            mark = np.zeros(size + 1, dtype=np.int64)
            for p in pos[hot[mine]].tolist():
                mark[max(0, p - reach)] += 1
                mark[p + 1] -= 1
            s = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & (left >= window)) if hot.any() else np.zeros(0, dtype=np.int64)
            self.strings.append(s)
            if len(s):
                starts.append(X.mix(X.Rolling(_BYTES[b.bytes]).windows(s, window)))
                checks.append((X.mix(X.Rolling(_BYTES2[b.bytes], X.BASE2).windows(s, window)) >> np.uint64(32)).astype(np.uint32))
        self.contexts = sorted(contexts)
        self.places = [contexts[c] for c in self.contexts]
        self.string_keys = np.concatenate(starts) if starts else np.zeros(0, dtype=np.uint64)
        self.string_checks = np.concatenate(checks) if checks else np.zeros(0, dtype=np.uint32)

    def cuts(self, buckets: int) -> list[int]:
        return _cuts(np.array([c[0] for c in self.contexts], dtype=np.uint64), buckets)


def _cuts(keys: np.ndarray, buckets: int) -> list[int]:
    return [0, *np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)).tolist(), len(keys)]


def _distinct(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((check, keys))
    k, c = keys[order], check[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    place = np.empty(len(k), dtype=np.int64)
    place[order] = group
    return k[new], c[new], (np.bincount(group, minlength=int(new.sum())) > 1).astype(np.uint8), place


OUT = "id {id}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<start:long,length:long>>"


def remove_repeated_strings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT, chunks: int | None = None, with_text: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (remaining bytes; null if not `with_text`), kept_sha256 and the removed spans."""
    if not 1 <= gram <= window or 2 * window - gram > 65_535:
        raise ValueError("gram must be between 1 and window, and the window below 32,768")
    docs = X.chunked(df, id_col, text_col, chunks)
    buckets = X.bucket_count(df)

    def grams(chunk: int, table: pa.Table) -> pa.Table:
        f = _Found(table, None, window, gram, buckets)
        return X.sent_table(X.send(chunk, f.keys, buckets, f.counts.astype(np.uint32)))

    def tell(table: pa.Table) -> pa.Table:
        chunks, counts, (keys, n) = X.unpack(table, np.uint64, np.uint32)
        _, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, weights=n)[place]
        bucket, at, out = table.column("bucket")[0].as_py(), 0, []
        for c, k in zip(chunks, counts, strict=True):
            t = total[at : at + k]
            if (t > 1).any():
                out.append((c, bucket, 1, np.packbits(t > 1).tobytes() + np.packbits(t > hot).tobytes()))
            at += k
        return X.reply_table(out)

    def surroundings(chunk: int, table: pa.Table, got: pa.Table) -> pa.Table:
        f = _Found(table, got, window, gram, buckets)
        cuts, out = f.cuts(buckets), []
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if hi > lo:
                mine = f.contexts[lo:hi]
                out.append((b, chunk, hi - lo, _pack(np.array([c[0] for c in mine], dtype=np.uint64), np.array([c[1] for c in mine]), np.array([len(p) > 1 for p in f.places[lo:hi]]), [c[2] for c in mine])))
        keys, check, many, place = _distinct(f.string_keys, f.string_checks)
        # buckets from `buckets` on are for strings around hot grams
        out += [(buckets + b, c, n, p) for b, c, n, p in X.send(chunk, keys, buckets, check, many)]
        if out:
            # what was sent from where: back to the chunk by a bucket of its own, so that it needn't look for samples again
            where = [np.array([x[j] for p in f.places for x in p], dtype=np.int32) for j in range(2)]
            note = (cuts, np.array([len(p) for p in f.places], dtype=np.int32), *where, _cuts(keys, buckets), [s.astype(np.int32) for s in f.strings], place.astype(np.int32))
            out.append((2 * buckets + chunk, chunk, 0, zstandard.ZstdCompressor(level=1).compress(pickle.dumps(note))))
        return X.sent_table(out)

    def sort(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= 2 * buckets:
            return X.reply_table([(c, -1, 3, p) for c, p in zip(table.column("chunk").to_pylist(), table.column("payload").to_pylist(), strict=True)])
        if bucket >= buckets:
            chunks, counts, cols = X.unpack(table, np.uint64, np.uint32, np.uint8)
            flags, at, out = X.repeated(cols[0], cols[2], cols[1]), 0, []
            for c, n in zip(chunks, counts, strict=True):
                out.append((c, bucket, 2, np.packbits(flags[at : at + n]).tobytes()))
                at += n
            return X.reply_table(out)
        rows = sorted(zip(table.column("chunk").to_pylist(), table.column("n").to_pylist(), table.column("payload").to_pylist(), strict=True), key=lambda r: r[0])
        number: dict[tuple[int, int, bytes], int] = {}
        many: list[int] = []
        place = []
        for _, n, payload in rows:
            g, left, m, contexts = _unpack(payload, n)
            for key, again in zip(zip(g.tolist(), left.tolist(), contexts, strict=True), m.tolist(), strict=True):
                k = number.setdefault(key, len(number))
                if k == len(many):
                    many.append(again)
                else:
                    many[k] = 1
                place.append(k)
        keys = list(number)
        a, b = reaches(np.array([k[0] for k in keys], dtype=np.uint64), np.array([k[1] for k in keys]), np.array(many), [k[2] for k in keys], window)
        place, at, out = np.array(place), 0, []
        for c, n, _ in rows:
            mine = place[at : at + n]
            at += n
            if b[mine].any():
                out.append((c, bucket, 2, a[mine].astype("<u2").tobytes() + b[mine].astype("<u2").tobytes()))
        return X.reply_table(out)

    def remove(chunk: int, table: pa.Table, got: pa.Table) -> pa.Table:
        f = _Found(table, None, window, 0, buckets)
        begin: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(f.batches)  # covered stretches, by batch
        end_ = list(begin)
        note = X.replies(got, 3).get(-1)
        if note is not None:
            cuts, counts, batch_of, at, string_cuts, strings, place = pickle.loads(zstandard.ZstdDecompressor().decompress(note))  # noqa: S301 - our own bytes
            left, right = np.zeros((2, len(counts)), dtype=np.int64)
            flags = np.zeros(string_cuts[-1], dtype=bool)
            for b, p in X.replies(got, 2).items():
                if b < buckets:
                    left[cuts[b] : cuts[b + 1]], right[cuts[b] : cuts[b + 1]] = np.frombuffer(p, "<u2").reshape(2, cuts[b + 1] - cuts[b])
                else:
                    lo, hi = string_cuts[b - buckets], string_cuts[b - buckets + 1]
                    flags[lo:hi] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=hi - lo).astype(bool)
            left, right = np.repeat(left, counts), np.repeat(right, counts)
            hit = right > 0
            done = 0
            for k, s in enumerate(strings):
                mine = hit & (batch_of == k)
                again = s[flags[place[done : done + len(s)]]].astype(np.int64)
                done += len(s)
                begin[k] = np.concatenate([at[mine] - left[mine], again])
                end_[k] = np.concatenate([at[mine] + right[mine], again + window])
        n_removed, n_spans, kept, sha, spans = [], [], [], [], []
        for k, b in enumerate(f.batches):
            n_bytes = len(b.bytes) + 1
            gone = np.cumsum(np.bincount(begin[k], minlength=n_bytes) - np.bincount(end_[k], minlength=n_bytes))[:-1] > 0
            for text, end, n in zip(b.texts, b.ends.tolist(), b.lengths.tolist(), strict=True):
                g = gone[end - n : end]
                left = text
                step = np.zeros(0, dtype=np.int64)
                if g.any():
                    left = np.frombuffer(text, dtype=np.uint8)[~g].tobytes()
                    step = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8)))
                n_removed.append(len(text) - len(left))
                n_spans.append(len(step) // 2)
                kept.append(left if with_text else None)
                sha.append(hashlib.sha256(left).hexdigest())
                spans.append([{"start": x, "length": y - x} for x, y in zip(step[::2].tolist(), step[1::2].tolist(), strict=True)])
        ids = table.column("id").combine_chunks().take(pa.array(f.order))
        lengths = pa.array([len(t) for t in f.texts], pa.int64())
        return pa.table({"id": ids, "n_bytes": lengths, "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary()), "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))})

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_schema = OUT.format(id=docs.schema["id"].dataType.simpleString())
    arrow = to_arrow_schema(_parse_datatype_string(out_schema))
    first = X.per_chunk(docs, grams, X.SENT).groupBy("bucket").applyInArrow(tell, X.REPLY)
    second = X.per_chunk_with(docs, first, surroundings, X.SENT, X.SENT_ARROW).groupBy("bucket").applyInArrow(sort, X.REPLY)
    out = X.per_chunk_with(docs, first.unionByName(second), remove, out_schema, arrow)
    return out.withColumnRenamed("id", id_col)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of `documents` outside strings of 200 bytes that start anywhere else too, as counts and a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeated_strings(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
