"""Exact percentiles of groups of any size by radix selection: nothing is sorted by value and no group is gathered.

A double becomes a 64-bit whole number of the same order. The first round counts its leading 24 bits, combined before the
shuffle; running sums over these counts, one small row each, name the buckets that hold a wanted rank, and what lies
below them. Only values of those buckets go on, to the next 20 bits and then the last 20. A bucket whose smallest and
largest value agree is settled, so rounds end as soon as all are: after the first for whole numbers under 4,096. The
values are stored once as the narrow columns they are, and no round depends on how many or how skewed they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlib.operators.ordered import join_same
from flowlib.scratch import small_side, stored

#: Bits that are still to the right after each round.
ROUNDS = (40, 20, 0)
_MANTISSA = 1 << 52


def with_ordered_bits(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds a whole number ``name`` that orders doubles as their values do; 0.0 and -0.0 are one, null stays null.

    Exponent and mantissa of the IEEE form are found by arithmetic that is exact: powers of two, and division by them.
    The logarithm may be off by one at powers of two, which the comparison after it mends. Each step is a projection of its
    own, so that none is worked out twice.
    """
    size = f"abs({value})"
    guessed = df.withColumn("__e", F.expr(f"cast(greatest(-1022L, least(1023L, coalesce(floor(log2({size})), -1022L))) as int)"))
    scaled = guessed.withColumn("__p", F.expr("pow(2D, __e)"))
    exact = scaled.withColumn("__f", F.expr(f"case when {size} >= 2D * __p then 1 when __e > -1022 and {size} < __p then -1 else 0 end"))
    bits = f"(__e + __f + 1022L) * {_MANTISSA}L + cast({size} / __p / (case __f when 1 then 2D when -1 then 0.5D else 1D end) * {_MANTISSA}D as bigint)"
    signed = f"case when {value} is null then null when {size} = double('Infinity') then {2047 * _MANTISSA}L else {bits} end"
    return exact.withColumn(name, F.expr(f"({signed}) * (case when {value} < 0 then -1L else 1L end)")).drop("__e", "__p", "__f")


def _rank_sql(q: float, n: str, method: str) -> tuple[str, str, str]:
    exact = f"(cast({q!r} as double) * ({n} - 1))"
    if method == "nearest":
        nearest = f"cast(rint({exact}) as bigint)"
        return nearest, nearest, "0D"
    return f"floor{exact}", f"ceil{exact}", f"({exact} - floor{exact})"


def exact_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], method: str = "linear") -> DataFrame:
    """One row per group with ``wanted = {output: (column, q)}``; nulls and NaN are ignored.

    ``method="linear"`` interpolates between neighbours, ``"nearest"`` takes the value at the rank rounded
    half to even. A group without any value has nulls. Text that is no number counts as null.
    """
    columns = sorted({column for column, _ in wanted.values()})
    # Adding 0.0 makes -0.0 the same value as 0.0.
    cells = [F.expr(f"nanvl(try_cast(`{c}` as double), cast(null as double)) + 0D").alias(f"__v{i}") for i, c in enumerate(columns)]
    narrow = stored(df.select(*keys, *cells), "percentile_values")
    group = [*keys, "_m"]
    names = [f"`{k}`" for k in group]
    by = ", ".join(names)
    values = narrow.selectExpr(*names[:-1], f"posexplode(array({', '.join(f'__v{i}' for i in range(len(columns)))})) as (_m, _v)")

    qs = sorted({q for _, q in wanted.values()})
    ends = [r for q in qs for r in _rank_sql(q, "_n", method)[:2]]
    hit = " or ".join(f"({r} >= _base and {r} < _base + _c)" for r in dict.fromkeys(ends))
    counts = [F.count("_v").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    def wanted_buckets(counted: DataFrame, within: str, base: str, total: str) -> DataFrame:
        below = f"{base} + sum(_c) over (partition by {within} order by _b rows unbounded preceding) - _c as _base"
        placed = counted.selectExpr(*names, "_b", "_c", "_lo", "_hi", below, f"{total} as _n")
        # A row of nulls is kept, so that a group without values isn't lost. Stored, the buckets have a known size.
        return small_side(placed.where(f"_b is null or {hit}"), "percentile_buckets")

    first = with_ordered_bits(values, "_v", "_b").withColumn("_b", F.shiftright("_b", ROUNDS[0])).groupBy(*group, "_b").agg(*counts)
    found = wanted_buckets(first, by, "0L", f"sum(_c) over (partition by {by})")
    settled = found.where("_lo is null or _lo = _hi")
    for shift in ROUNDS[1:]:
        if not found.where("_lo < _hi").limit(1).count():
            break
        # An open bucket is a range of values: only those in it are looked at again.
        open_ = found.where("_lo < _hi").selectExpr(*names, "_b as _of", "_lo as _from", "_hi as _to", "_base as _under", "_n")
        inside = join_same(values, open_, group, "inner").where("_v >= _from and _v <= _to")
        inside = with_ordered_bits(inside, "_v", "_b").withColumn("_b", F.shiftright("_b", shift))
        counted = inside.groupBy(*group, "_of", "_under", "_n", "_b").agg(*counts)
        found = wanted_buckets(counted, f"{by}, _of", "_under", "_n")
        settled = settled.union(found.where("_lo = _hi"))

    picks = []
    for i, q in enumerate(qs):
        low, high, _ = _rank_sql(q, "_n", method)
        for side, r in (("lo", low), ("hi", high)):
            picks.append(F.expr(f"max(case when {r} >= _base and {r} < _base + _c then _lo end) as _{side}{i}"))
    per_column = settled.groupBy(*group).agg(F.expr("max(_n) as _n"), *picks)
    exprs = []
    for i, q in enumerate(qs):
        share = _rank_sql(q, "_n", method)[2]
        exprs.append(f"case when _lo{i} = _hi{i} then _lo{i} else _lo{i} * (1 - {share}) + _hi{i} * {share} end as _q{i}")
    out = [F.expr(f"max(case when _m = {columns.index(c)} then _q{qs.index(q)} end) as `{name}`") for name, (c, q) in wanted.items()]
    return per_column.selectExpr(*names, *exprs).groupBy(*keys).agg(*out)


def approx_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], accuracy: int = 10_000) -> DataFrame:
    """As :func:`exact_percentiles` from bounded sketches in one pass; ranks are off by at most ``n / accuracy``."""
    out = [
        F.percentile_approx(F.expr(f"nanvl(try_cast(`{c}` as double), cast(null as double))"), q, accuracy).alias(name)
        for name, (c, q) in wanted.items()
    ]
    return df.groupBy(*keys).agg(*out)


def percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], accuracy: int | None = None) -> DataFrame:
    """Exact percentiles, or approximate ones when an ``accuracy`` is given."""
    return exact_percentiles(df, keys, wanted) if accuracy is None else approx_percentiles(df, keys, wanted, accuracy)
