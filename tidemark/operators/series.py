"""What all operators on ordered series share: order, positions, as-of lookups, and folds.

A series is the rows of one key (`series_id`), ordered by `ts` and then `seq`.
Undefined values are NULL; NaN and infinities in inputs are refused by
`require_finite`, which is an aggregate over the whole input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES, ORDER = "series_id", ("ts", "seq")


def by_series(df: DataFrame, order: Sequence[str] | None = None) -> WindowSpec:
    """The window of each series in order; order columns that the table lacks are left out."""
    return Window.partitionBy(SERIES).orderBy(*order_of(df, order))


def order_of(df: DataFrame, order: Sequence[str] | None = None) -> list[str]:
    return list(order) if order else [c for c in ("ts", "seq", "pos") if c in df.columns][:2]


def with_pos(df: DataFrame, order: Sequence[str] | None = None, name: str = "pos") -> DataFrame:
    """A 0-based position in each series."""
    return df.withColumn(name, (F.row_number().over(by_series(df, order)) - 1).cast("long"))


def with_long_pos(df: DataFrame, order: Sequence[str] | None = None, name: str = "pos", bucket: str = "day") -> DataFrame:
    """with_pos for series too long for one task: rows are numbered inside (series, bucket of ts), and the rows of earlier buckets are added.

    Bucket counts are combined before their shuffle, and only they are put in order per series.
    """
    keys = order_of(df, order)
    x = df.withColumn("__b", F.date_trunc(bucket, "ts"))
    counts = x.groupBy(SERIES, "__b").agg(F.count("*").alias("__n"))
    before = counts.select(SERIES, "__b", F.coalesce(F.sum("__n").over(Window.partitionBy(SERIES).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(SERIES, "__b").orderBy(*keys)) - 1
    return x.withColumn(name, inside).join(before, [SERIES, "__b"]).withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__b", "__before")


def require_finite(df: DataFrame, *columns: str, positive: Sequence[str] = (), unique: Sequence[str] = ()) -> DataFrame:
    """The same rows, if all are finite (and positive where asked, and unique by `unique`); else ValueError. One pass."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(f"{c}: not finite") for c in columns]
    bad += [F.count_if(F.col(c) <= 0).alias(f"{c}: not positive") for c in positive]
    found = df.agg(*bad).first().asDict() if bad else {}
    if unique:
        found["repeated keys"] = df.groupBy(*unique).count().filter("count > 1").limit(1).count()
    wrong = {k: v for k, v in found.items() if v}
    if wrong:
        raise ValueError(f"input refused: {wrong}")
    return df


def micros(column: str | Column) -> Column:
    """Microseconds since the epoch, of a TIMESTAMP or TIMESTAMP_NTZ (read as UTC)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))


def asof(left: DataFrame, right: DataFrame, at: str, value: Sequence[str], *, forward: bool = False, strict: bool = False, key: str = "ts") -> DataFrame:
    """For each row of `left`, the values of the last row of `right` at or before left[at] (first at or after it if `forward`).

    Both sides are put on one time line per series and looked up by a window, so
    there is no range join and no row more than went in.  `strict` leaves out
    equal times.
    """
    # rank of right rows at equal times: before the left ones if they may match
    mine, other = 1, (2 if strict else 0) if not forward else (0 if strict else 2)
    names = [c for c in left.columns]
    a = left.select(F.col(SERIES), F.col(at).alias("__t"), F.lit(mine).alias("__side"), F.struct(*names).alias("__row"), *(F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in value), F.lit(None).cast("boolean").alias("__is"))
    b = right.select(F.col(SERIES), F.col(key).alias("__t"), F.lit(other).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), *(F.col(v).alias(f"__{v}") for v in value), F.lit(True).alias("__is"))
    w = Window.partitionBy(SERIES).orderBy("__t", "__side")
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow) if not forward else w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    found = F.struct(*(F.col(f"__{v}").alias(v) for v in value))
    pick = F.last if not forward else F.first
    joined = a.unionByName(b).withColumn("__got", pick(F.when(F.col("__is"), found), ignorenulls=True).over(w)).filter("__is IS NULL AND __t IS NOT NULL")
    return joined.select("__row.*", *(F.col(f"__got.{v}").alias(v) for v in value))


def fold(df: DataFrame, step: Callable[[], Callable[[dict], list[tuple]]], schema: str, columns: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """A sequential pass over each series, with as much memory as its state takes.

    Rows are dealt by series and sorted inside partitions; batches stream through
    and the state lives across them.  step() gives a series' fresh state: a
    function from columns of a run of rows (lists) to result tuples; it is called
    with None at the series' end.
    """
    names = [x.strip().split()[0] for x in schema.split(",")]
    keys = order_of(df, order)
    cols = list(dict.fromkeys([SERIES, *columns]))
    dealt = df.repartition(SERIES).sortWithinPartitions(SERIES, *keys).select(*cols)
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = object(), None, []

        def emit() -> pa.RecordBatch:
            rows = list(zip(*out, strict=True)) if out else [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(r, t.type) for r, t in zip(rows, arrow, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            data = {c: batch.column(c).to_pylist() for c in cols}
            key = data[SERIES]
            at = 0
            while at < len(key):
                end = at
                while end < len(key) and key[end] == key[at]:
                    end += 1
                if state is None or key[at] != current:
                    if state is not None:
                        out += [(current, *r) for r in state(None)]
                    current, state = key[at], step()
                out += [(current, *r) for r in state({c: v[at:end] for c, v in data.items()})]
                at = end
            yield emit()
        if state is not None:
            out += [(current, *r) for r in state(None)]
        yield emit()

    return dealt.mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def per_series(df: DataFrame, fn: Callable[[dict], list[tuple]], schema: str, columns: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """fn(columns as NumPy arrays, in order) -> result tuples, once per series; for operators that need all of a series at once."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    keys = order_of(df, order)
    cols = list(dict.fromkeys([SERIES, *keys, *columns]))
    arrow = _arrow(schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in keys]) if keys else table
        key = table.column(SERIES)[0].as_py()
        rows = [(key, *r) for r in fn({c: table.column(c).to_numpy(zero_copy_only=False) if c in columns else table.column(c).to_pylist() for c in cols})]
        data = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.table([pa.array(d, f.type, from_pandas=True) for d, f in zip(data, arrow, strict=True)], names=names)

    return df.select(*cols).groupBy(SERIES).applyInArrow(run, schema)
