"""Exact order statistics per group without gathering a big group in one task.

Inputs estimated within ``SMALL_BYTES`` use the built-in exact ``percentile``. Beyond that, a first pass brackets every wanted rank with a mergeable sketch. A second pass counts the rows
below each bracket and the distinct values inside it; both collapse map-side, and only the thin
bracket (a ~1/ACCURACY share of a group) is ever sorted. A bracket that misses its rank is found anew
by counting cells of equal width, so the answer is exact whatever the sketch says and no group is
ever sorted whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import SMALL_BYTES, is_narrow, plan_bytes, written
from .joins import attach, keyed_join

ACCURACY = 20_000
MARGIN = 3.0 / ACCURACY
#: Targets whose 'below' bits share a cell: at most 2^CHUNK cells per key, so they collapse map-side.
CHUNK = 8
#: Cells that a missed bracket is cut into per round, and the rows from which on it is thin enough to sort.
CELLS, THIN = 1024, 100_000


def _sketch(df: DataFrame, keys: Sequence[str], columns: Sequence[str], targets: list[tuple[str, float]]) -> DataFrame:
    aggs = []
    for c in columns:
        probes = [p for t, p in targets if t == c]
        edges = [e for p in probes for e in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
        aggs += [
            F.count(c).alias(f"n_{c}"),
            F.min(c).alias(f"min_{c}"),
            F.max(c).alias(f"max_{c}"),
            F.percentile_approx(c, edges, ACCURACY).alias(f"edge_{c}"),
        ]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), *aggs)


def _brackets(sketch: DataFrame, keys: Sequence[str], targets: list[tuple[str, float]]) -> DataFrame:
    seen: dict[str, int] = {}
    out = []
    for i, (c, p) in enumerate(targets):
        j = seen.get(c, 0)
        seen[c] = j + 1
        lo = F.when(F.lit(p <= MARGIN), F.col(f"min_{c}")).otherwise(F.get(f"edge_{c}", F.lit(2 * j)))
        hi = F.when(F.lit(p >= 1 - MARGIN), F.col(f"max_{c}")).otherwise(F.get(f"edge_{c}", F.lit(2 * j + 1)))
        out += [lo.alias(f"lo{i}"), hi.alias(f"hi{i}"), F.col(f"n_{c}").alias(f"n{i}")]
    return sketch.select(*keys, "__rows", *out)


def _count_cells(df: DataFrame, brackets: DataFrame, keys: Sequence[str], targets: list[tuple[str, float]]) -> DataFrame:
    """(keys, target, value, rows): bracket values, plus rows of target -1 - k with the bit mask of 'below' for the k-th CHUNK of targets."""
    bounds = brackets.select(*keys, "__rows", *[f"{e}{i}" for i in range(len(targets)) for e in ("lo", "hi")])
    joined = attach(df, bounds, keys, rows_col="__rows")
    bits = [F.when(F.col(c) < F.col(f"lo{i}"), F.lit(float(1 << i % CHUNK))).otherwise(F.lit(0.0)) for i, (c, _) in enumerate(targets)]
    masks = [sum(bits[i : i + CHUNK], F.lit(0.0)) for i in range(0, len(bits), CHUNK)]
    cells = [F.struct(F.lit(-1 - k).alias("target"), mask.alias("value")) for k, mask in enumerate(masks)] + [
        F.when(
            F.col(c).between(F.col(f"lo{i}"), F.col(f"hi{i}")),
            F.struct(F.lit(i).alias("target"), F.col(c).alias("value")),
        )
        for i, (c, _) in enumerate(targets)
    ]
    return (
        joined.select(*keys, F.inline(F.array_compact(F.array(*cells))))
        .groupBy(*keys, "target", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _resolve(cells: DataFrame, brackets: DataFrame, keys: Sequence[str], targets: list[tuple[str, float]]) -> DataFrame:
    n_targets = len(targets)
    wide = brackets.select(
        *keys,
        F.inline(
            F.array(*[
                F.struct(F.lit(i).alias("target"), F.lit(p).alias("p"), F.col(f"n{i}").alias("n"))
                for i, (_, p) in enumerate(targets)
            ])
        ),
    )
    def under(i):
        return (F.col("target") == -1 - i // CHUNK) & (F.shiftright(F.col("value").cast("long"), i % CHUNK).bitwiseAND(F.lit(1)) == 1)

    below = cells.filter("target < 0").groupBy(*keys).agg(*[
        F.sum(F.when(under(i), F.col("rows")).otherwise(F.lit(0))).alias(f"b{i}") for i in range(n_targets)
    ]).select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("target"), F.col(f"b{i}").alias("below")) for i in range(n_targets)])))
    part = [*keys, "target"]
    ordered = W.partitionBy(*part).orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    inside = cells.filter("target >= 0").withColumn("cum", F.sum("rows").over(ordered))
    on = [*keys, "target"]
    j = keyed_join(keyed_join(wide, below, on), inside, on)
    pos = (F.col("n") - 1) * F.col("p")
    k_lo, k_hi = F.floor(pos) + 1, F.ceil(pos) + 1
    rank = F.coalesce("below", F.lit(0)) + F.col("cum")
    return (
        j.withColumn("pos", pos)
        .groupBy(*part)
        .agg(
            F.first("n").alias("n"),
            F.first("pos").alias("pos"),
            F.min(F.when(rank >= k_lo, F.col("value"))).alias("v_lo"),
            F.min(F.when(rank >= k_hi, F.col("value"))).alias("v_hi"),
            F.max(F.coalesce(F.col("below"), F.lit(0)) < k_lo).alias("starts_in_time"),
        )
        .withColumn("ok", F.coalesce(F.col("starts_in_time") & F.col("v_lo").isNotNull() & F.col("v_hi").isNotNull(), F.lit(False)) | (F.col("n") == 0))
    )


def _cell(value: Column, lo: Column, hi: Column) -> Column:
    """Cell 0..CELLS-1 of equal width; both ends have their own. Halved first, so that no difference overflows."""
    at = F.try_divide(value / 2 - lo / 2, hi / 2 - lo / 2)
    at = F.least(F.greatest(F.coalesce(F.nanvl(at, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    inner = F.least(F.floor(at * (CELLS - 2)) + 1, F.lit(CELLS - 2))
    return F.when(value <= lo, F.lit(0)).when(value >= hi, F.lit(CELLS - 1)).otherwise(inner).cast("int")


def _widened(state: DataFrame, keys: Sequence[str], n_targets: int) -> DataFrame:
    mine = [F.max(F.when(F.col("target") == i, F.col(c))).alias(f"{c}{i}") for i in range(n_targets) for c in ("lo", "hi", "n")]
    return state.groupBy(*keys).agg(F.max("n").alias("__rows"), *mine)


def _narrowed(df: DataFrame, missed: DataFrame, sketch: DataFrame, keys: Sequence[str], targets: list[tuple[str, float]]) -> DataFrame:
    """Brackets of the missed ranks, as ``_brackets`` gives them, each thin or of two neighbouring values.

    A round counts the cells between the bracket's ends; the cell holding the rank is the next bracket. Its ends are values
    with cells of their own, so every round sheds values and the search ends for any distribution.
    """
    part = [*keys, "target"]
    pos = [F.lit(p) * (F.col(f"n_{c}") - 1) for c, p in targets]
    every = F.array(*[
        F.struct(
            F.lit(i).alias("target"), F.col(f"n_{c}").alias("n"), F.col(f"n_{c}").alias("within"), F.floor(pos[i]).cast("long").alias("rank_lo"),
            F.ceil(pos[i]).cast("long").alias("rank_hi"), F.col(f"min_{c}").alias("lo"), F.col(f"max_{c}").alias("hi"),
        )
        for i, (c, _) in enumerate(targets)
    ])
    state = written(keyed_join(sketch.select(*keys, F.inline(every)), missed.select(*part), part, "left_semi"), "missed")
    wide = F.col("within") > THIN
    while not (todo := state.filter(wide & (F.col("lo") < F.col("hi")))).isEmpty():
        joined = attach(df, written(_widened(todo, keys, len(targets)), "ends"), keys, rows_col="__rows")
        hits = [
            F.when(
                F.col(c).between(F.col(f"lo{i}"), F.col(f"hi{i}")),
                F.struct(F.lit(i).alias("target"), _cell(F.col(c), F.col(f"lo{i}"), F.col(f"hi{i}")).alias("cell"), F.col(c).alias("value")),
            )
            for i, (c, _) in enumerate(targets)
        ]
        cells = joined.select(*keys, F.inline(F.array_compact(F.array(*hits)))).groupBy(*part, "cell").agg(
            F.count(F.lit(1)).alias("held"), F.min("value").alias("least"), F.max("value").alias("most"))
        cells = cells.withColumn("upto", F.sum("held").over(W.partitionBy(*part).orderBy("cell").rowsBetween(W.unboundedPreceding, 0)))
        cells = keyed_join(todo, cells, part, "inner").withColumn("before", F.col("upto") - F.col("held"))
        first, last = ((F.col("before") <= F.col(r)) & (F.col(r) < F.col("upto")) for r in ("rank_lo", "rank_hi"))
        found = cells.filter(first | last).groupBy(*part, "n", "rank_lo", "rank_hi").agg(
            F.count(F.lit(1)).alias("cells"), F.min("before").alias("before"), F.min(F.when(first, F.col("held"))).alias("held"),
            F.min(F.when(first, F.col("least"))).alias("a"), F.min(F.when(first, F.col("most"))).alias("b"),
            F.min(F.when(last, F.col("least"))).alias("c"), F.min(F.when(last, F.col("most"))).alias("d"),
        )
        one = F.col("cells") == 1
        found = found.select(
            *part, "n", F.when(one, F.col("held")).otherwise(F.lit(0)).alias("within"), (F.col("rank_lo") - F.col("before")).alias("rank_lo"),
            (F.col("rank_hi") - F.col("before")).alias("rank_hi"), F.when(one, F.col("a")).otherwise(F.col("b")).alias("lo"),
            F.when(one, F.col("d")).otherwise(F.col("c")).alias("hi"),
        )
        state = written(state.filter(~(wide & (F.col("lo") < F.col("hi")))).unionByName(found), "missed")
    return written(_widened(state, keys, len(targets)), "brackets")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, Sequence[float]],
    small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """One row per key: ``{column}_q{i}`` = linear-interpolated quantile ``wanted[column][i]``, plus ``rows``.

    NULL values are ignored, NULL keys form their own group.
    """
    keys = list(keys)
    targets = [(c, float(p)) for c, ps in wanted.items() for p in ps]
    cols = list(wanted)
    narrow = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    if plan_bytes(narrow) > small_bytes and not is_narrow(narrow):
        narrow = written(narrow, "values")  # read twice below: do not repeat the joins behind it
    if plan_bytes(narrow) <= small_bytes:
        aggs = [F.percentile(c, [float(p) for p in ps]).alias(c) for c, ps in wanted.items()]
        picks = [F.get(c, F.lit(i)).alias(f"{c}_q{i}") for c, ps in wanted.items() for i in range(len(ps))]
        return narrow.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("rows")).select(*keys, *picks, "rows")
    grouped = keys or ["__all"]
    if not keys:
        narrow = narrow.withColumn("__all", F.lit(0))
    sketch = written(_sketch(narrow, grouped, cols, targets), "sketch")
    brackets = _brackets(sketch, grouped, targets)
    found = written(_resolve(_count_cells(narrow, written(brackets, "brackets"), grouped, targets), brackets, grouped, targets), "ranks")
    missed = found.filter(~F.col("ok"))
    if not missed.isEmpty():
        full = _narrowed(narrow, missed, sketch, grouped, targets)
        again = keyed_join(narrow, missed.select(*grouped).distinct(), grouped, "left_semi")
        redo = _resolve(_count_cells(again, full, grouped, targets), full, grouped, targets)
        keep = found.filter("ok")
        found = keep.unionByName(keyed_join(missed.select(*grouped, "target"), redo, [*grouped, "target"]).select(*keep.columns))
    value = F.col("v_lo") + (F.col("pos") - F.floor("pos")) * (F.col("v_hi") - F.col("v_lo"))
    counters: dict[str, int] = {}
    picks = []
    for i, (c, _) in enumerate(targets):
        k = counters.get(c, 0)
        counters[c] = k + 1
        picks.append(F.max(F.when(F.col("target") == i, F.col("value"))).alias(f"{c}_q{k}"))
    out = found.withColumn("value", value).groupBy(*grouped).agg(*picks)
    out = keyed_join(out, sketch.select(*grouped, F.col("__rows").alias("rows")), grouped)
    return written(out.select(*keys, *[c for c in out.columns if c not in grouped]), "quantiles")
