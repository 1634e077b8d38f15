"""Near-duplicate documents by SetSketch registers (operator 9).

A document's set of word shingles becomes `REGISTERS` registers: the least of
the shingles' exponential hash values for each, on a scale of powers of 1.001
cut off at both ends (b = 1.001, a = 20, q = 2**16 - 2).  Registers of a union
are the larger ones of its parts, and equal registers are as likely as the sets
are similar.

1. Texts that are equal word for word are one class.
2. Bands of registers put classes into buckets.  Each bucket names a pivot,
   and each member is paired with it: as many pairs as members.
3. A pair's similarity is estimated by maximum likelihood from the counts of
   larger, smaller and equal registers and both set sizes; pairs five standard
   errors below the limit go.  The others are verified on their full sets.
4. Links give components.  Where members of a bucket are still in different
   components, those outside its largest component are held against all others
   in memory, in blocks; the likely pairs are verified there, and only links
   leave the task.  Pairs inside a component need no check, so one outlier among
   M copies costs M rows.
5. Components of all links; a document's component is the least id in it.

A pair at the limit is missed if all bands differ: 1 in 100,000, and far less
above it.

Cases: null and empty texts have an empty set and stay by themselves; texts
with fewer words than a shingle are one shingle; repeated rows and equal texts
link with each other; a null id has the component of its links (null if all
ids are null) and is kept only if that is null too; other columns are ignored;
an empty table gives an empty result; very long texts are read whole, in batches
bounded by bytes, and texts with the same words in a third of all rows are one
class, whose rows are told their class's component where they are.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._chunks import Rolling, mix
from tidemark.llm._components import connected_components
from tidemark.llm._store import small_batches, stored

REGISTERS = 256
B, A, Q = 1.001, 20.0, 2**16 - 2
SHINGLE, PERCENT = 5, 85
#: Members outside a bucket's largest component that one task holds against members of the bucket, and how many of these.
BLOCK, MEETS = 2048, 512
#: Classes that hold more than one in so many rows are sent to all tasks: there are fewer than so many of them.
HOT_SHARE = 1000
_rng = np.random.default_rng(20_211)
_MUL = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_MUL2 = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)


def shingles(words: list[bytes], length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((h(w) for w in words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - length + 1)
    return np.unique(mix(Rolling(hashes).windows(np.arange(n), min(length, len(words)))))


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    low, high = (items & np.uint64(0xFFFFFFFF)).astype(np.uint32), (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(items), 256):
        x = np.multiply.outer(low[at : at + 256], _MUL)
        x += np.multiply.outer(high[at : at + 256], _MUL2)
        np.minimum(least, x.min(axis=0), out=least)
    x = -np.log1p(-(least.astype(float) + 0.5) / 2.0**32) / A  # exponential values with rate A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merge_registers(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(one, other)


def banding(percent: int, miss: float = 1e-5) -> tuple[int, int]:
    """Registers in a band, and bands enough to miss a pair at the limit with probability `miss`; the longest bands that 256 registers allow, up to six."""
    for rows in range(6, 0, -1):
        n = math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows)) if percent < 100 else 1
        if n * rows <= REGISTERS:
            return rows, n
    return 1, REGISTERS


def bands(regs: np.ndarray, rows: int, n: int) -> list[int]:
    return [xxhash.xxh3_64_intdigest(regs[k * rows : (k + 1) * rows].tobytes(), seed=k) - (1 << 63) for k in range(n)]


def estimate(one: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs, from register matrices and set sizes."""
    up, down = (one > other).sum(axis=1).astype(float), (one < other).sum(axis=1).astype(float)
    same = one.shape[1] - up - down
    u, v = n / (n + m), m / (n + m)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return up * np.log(a) + down * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    lo, hi = np.zeros(len(n)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one maximum
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        right = likelihood(x) < likelihood(y)
        lo, hi = np.where(right, x, lo), np.where(right, hi, y)
    return (lo + hi) / 2


def likely_limit(percent: int) -> float:
    j = percent / 100
    return j - 5 * (j * (1 - j) / REGISTERS) ** 0.5


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z only


def _class(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _pairs_table(out: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})


def classes_of(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(v, rep, copies, n, regs): a row per distinct sequence of words, with its least id, number of rows, set size and registers."""
    kind = docs.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                v, n, regs, take = [], [], [], []
                for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                    words = _words(text)
                    if words:
                        s = shingles(words, shingle)
                        v.append(_class(words))
                        n.append(len(s))
                        regs.append(registers(s).tobytes())
                        take.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), batch.column("id").take(pa.array(take, pa.int64())), pa.array(n, pa.int64()), pa.array(regs, pa.binary())], ["v", "id", "n", "regs"])

    rows = docs.mapInArrow(sketch, f"v binary, id {kind}, n long, regs binary")
    return rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("regs").alias("regs"))


def near_duplicate_classes(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(v, rep, copies, n, first, component): each class of `docs` (id, text) with its least id, number of rows, set size, and the least id of its component; first: is it the class of its component that has that id?"""
    small_batches(docs.sparkSession)
    classes = stored(classes_of(docs, shingle), "classes")
    limit = likely_limit(percent)
    rows, n_bands = banding(percent)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [bands(r, rows, n_bands) for r in _matrix(batch.column("regs"))] if batch.num_rows else []
            v = batch.column("v").take(pa.array(np.repeat(np.arange(batch.num_rows), n_bands)))
            yield pa.RecordBatch.from_arrays([pa.array([x for g in got for x in g], pa.int64()), v], ["bucket", "v"])

    members = classes.select("v", "regs").mapInArrow(deal, "bucket long, v binary")
    pivots = members.groupBy("bucket").agg(F.min_by("v", F.xxhash64("v", "bucket")).alias("pivot"), F.count("*").alias("members")).filter("members > 1")
    members = stored(members.join(pivots, "bucket"), "members")  # of buckets with company only
    multi = members.select("v").distinct()
    known = stored(classes.join(multi, "v", "left_semi").select("v", "n", "regs"), "sketches")
    texts = stored(_payloads(docs).join(multi, "v", "left_semi").groupBy("v").agg(F.first("payload").alias("payload")), "texts")

    star = members.filter("v <> pivot").select(F.least("v", "pivot").alias("a"), F.greatest("v", "pivot").alias("b")).distinct()
    links = stored(_verified(_likely(star, known, limit, percent), texts, percent, shingle), "links")
    labels = connected_components(links)

    rest = _blocks(members.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))).join(known.join(texts, "v"), "v")
    further = stored(_rest_links(rest, limit, percent, shingle, rows, n_bands).distinct(), "links2")
    every = connected_components(links.unionByName(further)) if not further.isEmpty() else labels

    named = every.join(classes.select("v", "rep"), "v").groupBy("label").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "v")).alias("least"))
    found = every.join(named, "label").select("v", "least")
    about = classes.select("v", "rep", "copies", "n").join(found, "v", "left")
    return about.select("v", "rep", "copies", "n", F.coalesce(F.col("least.v") == F.col("v"), F.lit(True)).alias("first"), F.when(F.col("least").isNull(), F.col("rep")).otherwise(F.col("least.rep")).alias("component"))


def _with_class(docs: DataFrame) -> DataFrame:
    """docs and v, their class; null without words."""
    names = [f.name for f in docs.schema.fields]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = (_words(t) for t in batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([_class(w) if w else None for w in words], pa.binary())], [*names, "v"])

    return docs.mapInArrow(name, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields) + ", v binary")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: documents link where 100 * intersection >= percent * union."""
    docs = _docs(df, id_col, text_col)
    out = _told(_with_class(docs).select("id", "v"), stored(near_duplicate_classes(docs, percent, shingle).select("v", "copies", "n", "component"), "about"))
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _told(rows: DataFrame, about: DataFrame) -> DataFrame:
    """(id, v, n, component) of rows (id, v).

    Classes with more than a thousandth of all rows, fewer than a thousand, are
    broadcast; their rows, and those without words, are spread by id in the join
    with the others, where they match nothing.
    """
    total = about.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") * HOT_SHARE > total
    hot = about.filter(is_hot).select(F.col("v").alias("hv"), F.col("n").alias("hn"), F.col("component").alias("hc"))
    cold = about.filter(~is_hot).select(F.col("v").alias("j"), "n", "component")
    at = rows.join(F.broadcast(hot), F.col("v") == F.col("hv"), "left")
    alone = F.concat(F.lit("-" * 17), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")  # classes have 16 bytes
    at = at.withColumn("j", F.when(F.col("v").isNull() | F.col("hv").isNotNull(), alone).otherwise(F.col("v")))
    out = at.join(cold, "j", "left")
    return out.select("id", "v", F.coalesce("hn", "n").alias("n"), F.when(F.col("hv").isNotNull(), F.col("hc")).otherwise(F.col("component")).alias("component"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 80, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep...): one row of each component, that with its least id, and all rows without words.

    Of rows with the same id and words one stays.  Rows are joined by id and
    class, so that a class with a third of all rows is spread over all tasks.
    """
    about = near_duplicate_classes(_docs(df, id_col, text_col), percent, shingle)
    winners = about.filter("first").select(F.col("rep").alias("w_id"), F.col("v").alias("w"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep)))
    rows = _with_class(rows).withColumn("j", F.coalesce("v", F.unhex(F.md5(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))))))
    kept = rows.join(winners, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("j") == F.col("w")), "left").filter("w IS NOT NULL OR v IS NULL")
    again = Window.partitionBy("id", "j").orderBy(*(F.col(f"k{k}") for k in range(len(keep))), F.lit(0))
    kept = kept.withColumn("r", F.row_number().over(again)).filter("r = 1 OR v IS NULL")
    return kept.select(F.col("id").alias(id_col), *(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)))


def _payloads(docs: DataFrame) -> DataFrame:
    """(v, payload): the words of each class, compressed, once per task."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        press = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                v, payload = [], []
                for text in whole.column("text").slice(at, 512).cast(pa.binary()).to_pylist():
                    words = _words(text)
                    if words and (c := _class(words)) not in seen:
                        seen.add(c)
                        v.append(c)
                        payload.append(press.compress(b" ".join(words)))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), pa.array(payload, pa.binary())], ["v", "payload"])

    return docs.select("text").mapInArrow(pack, "v binary, payload binary")


def _likely(pairs: DataFrame, known: DataFrame, limit: float, percent: int) -> DataFrame:
    """Pairs whose sizes allow the limit and whose estimate is near it or above."""
    one = known.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    other = known.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
                ok = estimate(_matrix(batch.column("ra")), _matrix(batch.column("rb")), n, m) >= limit
                batch = batch.filter(pa.array(ok))
            yield batch.select(["a", "b"])

    sized = pairs.join(one, "a").join(other, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(judge, "a binary, b binary")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Pairs that link on their full sets."""
    one, other = texts.select(F.col("v").alias("a"), F.col("payload").alias("pa")), texts.select(F.col("v").alias("b"), F.col("payload").alias("pb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, cache = zstandard.ZstdDecompressor(), OrderedDict()

        def items(v: bytes, payload: bytes) -> np.ndarray:
            if v in cache:
                cache.move_to_end(v)
                return cache[v]
            cache[v] = got = shingles(unpress.decompress(payload).split(), shingle)
            if len(cache) > 256:
                cache.popitem(last=False)
            return got

        for batch in batches:
            ok = []
            for a, b, p, q in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "pa", "pb")), strict=True):
                x, y = items(a, p), items(b, q)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(one, "a").join(other, "b").select("a", "b", "pa", "pb").mapInArrow(check, "a binary, b binary")


def _blocks(open_: DataFrame) -> DataFrame:
    """(bucket, i, j, minor, v, label): who meets whom, from members (bucket, v, label, pivot).

    In a bucket, those outside its largest component (block j of them) meet all
    members (block i).  So a member is sent once per block of such, and those once
    per block of members.
    """
    sizes = open_.groupBy("bucket", "label").agg(F.count("*").alias("c")).groupBy("bucket")
    sizes = sizes.agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.sum("c").alias("every"), (F.sum("c") - F.max("c")).alias("others")).filter("others > 0")
    at = open_.select("bucket", "v", "label", "pivot").join(sizes, "bucket").filter("v <> pivot")
    blocks, other_blocks = (F.ceil(F.col(c) / size).cast("int") for c, size in (("every", MEETS), ("others", BLOCK)))
    i, j = F.pmod(F.xxhash64("v"), blocks).cast("int"), F.pmod(F.xxhash64("v", F.lit(1)), other_blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), other_blocks - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(False).alias("minor")))
    asked = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(True).alias("minor")))
    return at.withColumn("meet", F.explode(F.when(F.col("label") == F.col("major"), meets).otherwise(F.concat(meets, asked)))).select("bucket", "meet.i", "meet.j", "meet.minor", "v", "label")


def _rest_links(rest: DataFrame, limit: float, percent: int, shingle: int, rows: int, n_bands: int) -> DataFrame:
    """Links across components within buckets, from blocks of members held against each other in memory.

    Pairs with the bucket's pivot were judged before; a pair that shares an
    earlier band is judged there; members that a link has just put together
    need none.  So a block sends at most as many links as it has members.
    """

    def compare(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        v, payload = (table.column(c).to_pylist() for c in ("v", "payload"))
        numbers: dict[bytes, int] = {}
        label = np.array([numbers.setdefault(x, len(numbers)) for x in table.column("label").to_pylist()])
        parent = list(range(len(numbers)))

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        sets: dict[int, np.ndarray] = {}
        unpress = zstandard.ZstdDecompressor()

        def items(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = shingles(unpress.decompress(payload[k]).split(), shingle)
            return sets[k]

        asks, n = np.array(table.column("minor").to_pylist(), dtype=bool), table.column("n").to_numpy().astype(float)
        regs = _matrix(table.column("regs").combine_chunks())
        band = bands(regs[0], rows, n_bands).index(bucket)
        head = regs[:, : band * rows].reshape(len(regs), band, rows)
        out = []
        asked = np.flatnonzero(~asks)
        for x in np.flatnonzero(asks).tolist():
            y = asked[label[asked] != label[x]]
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            y = y[(regs[y] == regs[x]).sum(axis=1) >= (limit - 0.02) * REGISTERS]  # a cheap bound before the estimate
            if band and len(y):
                y = y[~(head[y] == head[x]).all(axis=2).any(axis=1)]
            if not len(y):
                continue
            e = estimate(np.broadcast_to(regs[x], (len(y), REGISTERS)), regs[y], np.full(len(y), n[x]), n[y])
            for k in y[np.argsort(-e, kind="stable")][: int((e >= limit).sum())].tolist():
                a, b = find(int(label[x])), find(int(label[k]))
                if a != b:
                    common = len(np.intersect1d(items(x), items(k), assume_unique=True))
                    if 100 * common >= percent * (len(items(x)) + len(items(k)) - common):
                        parent[a] = b
                        out.append((min(v[x], v[k]), max(v[x], v[k])))
        return _pairs_table(out)

    return rest.select("bucket", "i", "j", "minor", "v", "label", "n", "regs", "payload").groupBy("bucket", "i", "j").applyInArrow(compare, "a binary, b binary")


def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all `documents`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
starts AS (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS s FROM docs WHERE len(w) > 0),
sets AS (SELECT DISTINCT r, array_to_string(w[s : s + 4], ' ') AS shingle FROM starts),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.r < b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r AS x, r AS y FROM docs UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
comp AS (SELECT reach.x AS r, min(doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.y GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM docs LEFT JOIN sizes USING (r) JOIN comp USING (r)
"""
