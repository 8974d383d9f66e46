"""Equi-joins of a big table with a keyed state table, null-safe and safe against hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import plan_bytes, settled

BROADCAST_LIMIT_BYTES = 32 << 20
HOT_KEYS_MAX = 1000


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", null_safe: bool = True) -> DataFrame:
    """Join on same-named keys, NULL matching NULL by default; the keys come out once."""
    renamed = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(renamed)
    cond = reduce(
        lambda a, b: a & b,
        [left[k].eqNullSafe(r[n]) if null_safe else left[k] == r[n] for k, n in renamed.items()],
    )
    out = left.join(r, cond, how)
    if how != "full":
        return out.drop(*renamed.values())
    rest = [c for c in [*left.columns, *r.columns] if c not in keys and c not in renamed.values()]
    return out.select(*[F.coalesce(left[k], r[n]).alias(k) for k, n in renamed.items()], *rest)


def attach(
    df: DataFrame,
    state: DataFrame,
    keys: Sequence[str],
    *,
    rows_col: str | None = None,
    null_safe: bool = True,
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Left-join ``state`` (at most one row per key) to ``df``.

    * state within ``limit_bytes``: broadcast, no shuffle of ``df``;
    * beyond it, with ``rows_col`` (rows of ``df`` behind each key): keys holding more than a
      1/HOT_KEYS_MAX share of all rows number at most HOT_KEYS_MAX, so those are broadcast and
      only the remaining, evenly sized keys are shuffled;
    * beyond it without ``rows_col``: shuffle join, split by adaptive skew handling.
    """
    if not keys:
        return df.join(F.broadcast(state), F.lit(True), "left")
    state = settled(state)
    if plan_bytes(state) <= limit_bytes:
        return keyed_join(df, F.broadcast(state), keys, "left", null_safe)
    if rows_col is None:
        return keyed_join(df, state, keys, "left", null_safe)
    total = state.agg(F.sum(rows_col)).first()[0] or 0
    is_hot = F.coalesce(F.col(rows_col) * HOT_KEYS_MAX > F.lit(total), F.lit(False))
    hot = state.filter(is_hot)
    hot_keys = F.broadcast(hot.select(*keys))
    busy = keyed_join(keyed_join(df, hot_keys, keys, "left_semi", null_safe), F.broadcast(hot), keys, "left", null_safe)
    rest = keyed_join(keyed_join(df, hot_keys, keys, "left_anti", null_safe), state.filter(~is_hot), keys, "left", null_safe)
    return busy.unionByName(rest)
