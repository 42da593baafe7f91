"""Exact ranks, quantiles and running totals that never sort a table in one task.

Quantiles and selections cut the value range into a bounded number of cells,
count them with map-side combining, and cut the cells that hold a wanted rank
again until those hold one value. Cells depend on the values alone, so recomputing
a lost partition gives the same answer, and every table takes the same plan.
Running totals add slice offsets to the totals within slices of the order.

Quantiles and selections run at call time, like ``DataFrame.approxQuantile``:
what reaches the driver is one interval per wanted rank or one boundary per
stratum, and what they return plans as plain expressions over literals.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.keys import KEY_BITS

# At most 2 * 512 * ln(max double), about 730,000 coarse cells per column.
CELLS_PER_E = 512.0
FINE_CELLS = 65536.0
# Selections look at their order in digits of so many bits.
DIGIT_BITS = 16
# Running totals are added up in slices of about so many rows of a group, and in at most so many slices a group.
SLICE_ROWS = 1 << 14
SLICES = 1 << 12


def _coarse_cell(x: Column) -> Column:
    """Logarithmic cell number, monotone in ``x`` for any sign and magnitude."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * F.lit(CELLS_PER_E))


def _equal_width_cell(x: Column, lo: Column, hi: Column, cells: Column) -> Column:
    return F.when(hi > lo, F.floor((x - lo) / (hi - lo) * cells)).otherwise(F.lit(0).cast("long"))


def _ranks_inside(counts: DataFrame, group: Sequence[str], order: str, wanted: Column) -> DataFrame:
    """Keep the rows of a count table that contain a wanted rank (0-based, in order).

    ``ranks`` on return holds the contained ones, still counted from the start
    of the group; ``start`` is the number of rows before this row.
    """
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy(order))
    contained = F.filter(wanted, lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
    return counts.withColumn("start", upto - F.col("n")).withColumn("ranks", contained).where(F.size("ranks") > 0)


def _order_statistics(
    values: DataFrame, column_keys: Sequence[str], probs_of: Column
) -> dict[tuple, dict[int, float]]:
    """``{(keys..., total): {rank: value}}`` for the ranks next to each quantile."""
    spark = values.sparkSession
    extremes = (F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    cell_keys = [*column_keys, "cell"]
    celled = values.withColumn("cell", _coarse_cell(F.col("x")))

    last = (F.col("total") - F.lit(1)).cast("double")
    near = F.flatten(F.transform(probs_of, lambda p: F.array(F.floor(p * last), F.ceil(p * last))))
    coarse = (
        celled.groupBy(*cell_keys)
        .agg(*extremes)
        .withColumn("total", F.sum("n").over(Window.partitionBy(*column_keys)))
    )
    intervals = _ranks_inside(coarse, column_keys, "cell", F.array_distinct(near)).collect()
    totals = {tuple(r[k] for k in column_keys): r["total"] for r in intervals}
    found: dict[tuple, dict[int, float]] = {k: {} for k in totals}
    # One interval per wanted rank at most: (keys, cell, lo, hi, rows, rows before it, ranks).
    todo = [
        ([r[k] for k in cell_keys], r["lo"], r["hi"], r["n"], r["start"], r["ranks"]) for r in intervals
    ]
    schema = T.StructType(
        [values.schema[k] for k in column_keys]
        + [
            T.StructField("cell", T.LongType()),
            T.StructField("id", T.IntegerType()),
            T.StructField("lo", T.DoubleType()),
            T.StructField("hi", T.DoubleType()),
            T.StructField("wanted", T.ArrayType(T.LongType())),
        ]
    )
    while True:
        for keys, lo, hi, _, _, ranks in todo:
            if lo == hi:
                found[tuple(keys[:-1])].update({r: lo for r in ranks})
        todo = [t for t in todo if t[1] < t[2]]
        if not todo:
            return {(*k, totals[k]): v for k, v in found.items()}
        local = spark.createDataFrame(
            [(*keys, i, lo, hi, [r - start for r in ranks]) for i, (keys, lo, hi, _, start, ranks) in enumerate(todo)],
            schema,
        )
        inside = celled.join(F.broadcast(local.drop("wanted")), cell_keys).where(
            F.col("x").between(F.col("lo"), F.col("hi"))
        )
        sub = _equal_width_cell(F.col("x"), F.col("lo"), F.col("hi"), F.lit(FINE_CELLS))
        counts = inside.groupBy("id", sub.alias("sub")).agg(*extremes)
        hits = _ranks_inside(
            counts.join(F.broadcast(local.select("id", "wanted")), "id"), ["id"], "sub", F.col("wanted")
        ).collect()
        narrowed = []
        for h in hits:
            keys, _, _, _, start, _ = todo[h["id"]]
            narrowed.append((keys, h["lo"], h["hi"], h["n"], start + h["start"], [start + r for r in h["ranks"]]))
        todo = narrowed


def quantile_rows(
    df: DataFrame,
    probs: Mapping[str, Sequence[float]],
    by: str | None = None,
    groups: Sequence | None = None,
    accuracy: int | None = None,
) -> list[tuple]:
    """Linear-interpolated quantiles as ``([group], column, p, value, n)``.

    Exact by default: counts over cells narrow each wanted rank to an interval
    of one value. Every pass reads only the needed columns and shuffles only
    counts. ``accuracy`` switches to one pass with Spark's mergeable sketch.

    NULL and NaN are ignored; a column without values gives no rows. With
    ``by``, ``groups`` lists the group values to report; it bounds what reaches
    the driver to ``groups * columns * 2 * probabilities`` intervals.
    """
    columns = list(probs)
    ids = [by] if by else []
    if by:
        if groups is None:
            raise ValueError("quantiles by group need the list of groups")
        df = df.where(F.col(by).isin(*groups))
    long = (
        df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(ids, columns, "column", "x")
        .where(F.col("x").isNotNull() & ~F.isnan("x"))
    )
    keys = [*ids, "column"]
    if accuracy is not None:
        every = sorted({float(p) for ps in probs.values() for p in ps})
        sketched = long.groupBy(*keys).agg(
            F.percentile_approx("x", every, accuracy).alias("values"), F.count(F.lit(1)).alias("n")
        )
        return [
            (*[r[k] for k in keys], p, v, r["n"])
            for r in sketched.collect()
            for p, v in zip(every, r["values"], strict=True)
            if p in {float(q) for q in probs[r["column"]]}
        ]
    probs_of = F.create_map(
        *[part for c in columns for part in (F.lit(c), F.array(*[F.lit(float(p)) for p in probs[c]]))]
    )[F.col("column")]
    out = []
    for key, values in _order_statistics(long, keys, probs_of).items():
        *group, column, total = key
        for p in probs[column]:
            at = float(p) * (total - 1)
            low, weight = int(at), at - int(at)
            high = low + 1 if weight > 0 else low
            value = values[low] * (1.0 - weight) + values[high] * weight
            out.append((*group, column, float(p), value, total))
    return out


def quantiles(
    df: DataFrame,
    probs: Mapping[str, Sequence[float]],
    by: str | None = None,
    groups: Sequence | None = None,
    accuracy: int | None = None,
) -> DataFrame:
    """``quantile_rows`` as a small frame ``([by], column, p, value, n)``."""
    schema = T.StructType(
        ([T.StructField(by, df.schema[by].dataType)] if by else [])
        + [
            T.StructField("column", T.StringType()),
            T.StructField("p", T.DoubleType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("n", T.LongType()),
        ]
    )
    return df.sparkSession.createDataFrame(quantile_rows(df, probs, by, groups, accuracy), schema)


def quantile_values(
    df: DataFrame, probs: Mapping[str, Sequence[float]], accuracy: int | None = None
) -> dict[str, dict[float, float | None]]:
    """``{column: {p: value}}`` as numbers; None where a column has no values."""
    out: dict[str, dict[float, float | None]] = {c: {float(p): None for p in ps} for c, ps in probs.items()}
    for column, p, value, _ in quantile_rows(df, probs, accuracy=accuracy):
        out[column][p] = value
    return out


def running_totals(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Add ``<name>_upto``: the sum of each column over all rows up to this one.

    ``order`` must be a number, unique within ``by``: aggregate first, and write
    what is costly, for this reads ``df`` when called and again in the result.
    Sketched quantiles of every group, as many as its rows need slices, cut the
    order; the slice of a row depends on its value alone, so that all branches of
    the plan agree. Slice totals are the offsets of the running sums inside the
    slices. ``by`` tells few groups apart: their quantiles reach the driver. A
    missing order comes first, NaN last.
    """
    by = list(by)
    value = F.col(order).cast("double")
    rows = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    slices = min(SLICES, -(-rows // SLICE_ROWS))
    shares = [i / slices for i in range(1, slices)]
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, shares, 20 * slices).alias("cuts")).collect() if shares else []
    edges = sorted({c for r in cuts for c in r["cuts"] or [] if c == c and abs(c) < float("inf")})
    splits = [float("-inf"), *(edges or [0.0]), float("inf")]
    named = Bucketizer(splits=splits, inputCol="_order", outputCol="_slice", handleInvalid="keep").transform(
        df.withColumn("_order", value)
    )
    # Missing values share the bucketizer's last slice with NaN.
    sliced = named.withColumn("_slice", F.when(value.isNull(), -1).otherwise(F.col("_slice").cast("int")))
    slice_keys = [*by, "_slice"]
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*slice_keys)
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(*slice_keys, *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"{s}_before") for s in sums])
    )
    inside = Window.partitionBy(*slice_keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    counted = sliced.withColumns({f"{s}_upto": F.sum(s).over(inside) for s in sums})
    return counted.join(offsets, slice_keys).select(
        *df.columns, *[(F.col(f"{s}_before") + F.col(f"{s}_upto")).alias(f"{s}_upto") for s in sums]
    )


def _digits(bits: Column, width: int) -> list[Column]:
    """The digits of a ``width``-bit number, the highest first; -1 where it is missing."""
    mask = (1 << DIGIT_BITS) - 1
    return [
        F.coalesce(F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(mask)), F.lit(-1).cast("long"))
        for shift in range(width - DIGIT_BITS, -1, -DIGIT_BITS)
    ]


def _unsigned(x: Column) -> Column:
    """A long moved so that its bits, read without a sign, rise with it."""
    return x.cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def mark_first(
    df: DataFrame,
    key: Column,
    tie: str,
    quota: Callable[[object, int], int],
    stratum: str | None = None,
    strata: Sequence = (),
) -> DataFrame:
    """Add ``selected``: true for the first rows of each stratum.

    The order is total: by ``key`` (a 32-bit shuffle key of the identifier
    ``tie``), then the identifier (an integer), then a hash of the whole row;
    missing values come first. ``quota(stratum, rows)`` says how many rows to
    select, and exactly so many are. The order is read in digits: counting the
    values of a digit, at most 2**16, finds the one at which the quota is used
    up, and only rows with that value are counted by the next digit. So no pass
    orders more than that, and the result is a plain comparison for each row.
    Rows outside ``strata`` are dropped.

    Rows that are equal in all columns can't be told apart. If the quota ends
    among them they are counted and written out anew, a part of them selected.
    """
    group = [stratum] if stratum else []
    if stratum:
        df = df.where(F.col(stratum).isin(*strata))
    row_hash = F.xxhash64(*[c for name in df.columns for c in (F.col(name), F.col(name).isNull())])
    known = F.when(F.col(tie).isNotNull(), key)
    digits = [
        *_digits(known, KEY_BITS),
        *_digits(F.when(F.col(tie).isNotNull(), _unsigned(F.col(tie))), 64),
        *_digits(_unsigned(row_hash), 64),
    ]
    keyed = df.withColumns({f"_digit_{i}": d for i, d in enumerate(digits)})
    path: dict[object, list[int]] = {}
    need: dict[object, int] = {}
    open_strata: list[object] = []

    def inside(names: Sequence[object]) -> Column:
        """Rows on the path of an unfinished stratum."""
        found = F.lit(False)
        for name in names:
            here = F.lit(True) if stratum is None else F.col(stratum) == name
            for i, value in enumerate(path[name]):
                here = here & (F.col(f"_digit_{i}") == value)
            found = found | here
        return found

    for depth in range(len(digits)):
        column = f"_digit_{depth}"
        rows = keyed if depth == 0 else keyed.where(inside(open_strata))
        counts = rows.groupBy(*group, column).agg(F.count(F.lit(1)).alias("n"))
        if depth == 0:
            counts = counts.persist()
            totals = {_name(r, stratum): r["n"] for r in counts.groupBy(*group).agg(F.sum("n").alias("n")).collect()}
            need = {s: quota(s, totals.get(s) or 0) for s in (strata if stratum else [None])}
            path = {s: [] for s in need}
            open_strata = [s for s, n in need.items() if n > 0]
        ends = _using_up(counts, group, [column], _per_stratum(stratum, {s: need[s] for s in open_strata}))
        if depth == 0:
            counts.unpersist()
        unfinished = []
        for r in ends:
            name = _name(r, stratum)
            path[name].append(r[column])
            need[name] -= r["before"]
            if need[name] < r["n"]:
                unfinished.append(name)
        open_strata = unfinished
        if not open_strata:
            break

    selected = F.lit(False)
    for name, values in path.items():
        reached = F.lit(False)
        for i, value in reversed(list(enumerate(values))):
            digit = F.col(f"_digit_{i}")
            last = i == len(values) - 1
            reached = (digit <= value) if last else (digit < value) | ((digit == value) & reached)
        selected = selected | ((F.lit(True) if stratum is None else F.col(stratum) == name) & reached)
    marked = keyed.withColumn("selected", selected)
    if open_strata:
        equal = inside(open_strata)
        part = _mark_copies(keyed.where(equal).select(*df.columns), group, _per_stratum(stratum, need))
        return marked.where(~equal).select(*df.columns, "selected").unionByName(part)
    return marked.select(*df.columns, "selected")


def _mark_copies(copies: DataFrame, group: Sequence[str], need: Column) -> DataFrame:
    """Mark ``need`` of the copies of each group; they are counted, not numbered one by one."""
    chunk = 1 << DIGIT_BITS
    counted = copies.groupBy(*copies.columns).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(*copies.columns))
    counted = counted.withColumn("_take", F.greatest(F.least(need - (upto - F.col("_n")), F.col("_n")), F.lit(0)))
    last_chunk = F.floor((F.col("_n") - 1) / chunk)
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)))
    left = F.least(F.col("_n") - F.col("_chunk") * chunk, F.lit(chunk))
    rows = chunks.repartition("_chunk").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    number = F.col("_chunk") * chunk + F.col("_i")
    return rows.select(*copies.columns, (number <= F.col("_take")).alias("selected"))


def _name(row: Row, stratum: str | None) -> object:
    return row[stratum] if stratum else None


def _using_up(counts: DataFrame, group: Sequence[str], order: Sequence[str], quota: Column) -> list[Row]:
    """Per group the row, with ``before``, at which the running count reaches the quota."""
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy(*order))
    running = counts.withColumn("before", upto - F.col("n"))
    return running.where((F.col("before") < quota) & (F.col("before") + F.col("n") >= quota)).collect()


def _per_stratum(stratum: str | None, values: Mapping[object, object]) -> Column:
    """The value of the row's stratum, NULL where it has none."""
    if stratum is None:
        return F.lit(values.get(None))
    out = F
    for s, v in values.items():
        out = out.when(F.col(stratum) == s, F.lit(v))
    return out if values else F.lit(None)
