"""Lookups between tables, positional merge and stacking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.cells import cell, col, norm_key
from ..streaming.guard import batch_only
from .ordering import first_rows, with_row_number
from .skew import join_salted

PREFIX = "_lkp_"


def _pairs(on) -> list[tuple[str, str]]:
    if isinstance(on, str):
        on = [on]
    return [(p, p) if isinstance(p, str) else (p[0], p[1]) for p in on]


def _keys(left: DataFrame, right: DataFrame, pairs) -> tuple[list[Column], list[Column]]:
    """Key expressions of both sides. Equal integer types are compared as they are."""
    lk, rk = [], []
    for a, b in pairs:
        ta, tb = left.schema[a].dataType, right.schema[b].dataType
        if isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType):
            wide = "bigint" if ta != tb else None
            lk.append(col(a).cast(wide) if wide else col(a))
            rk.append(col(b).cast(wide) if wide else col(b))
        else:
            lk.append(norm_key(cell(left, a)))
            rk.append(norm_key(cell(right, b)))
    if len(pairs) > 1:
        return [_present(k) for k in lk], [_present(k) for k in rk]
    return lk, rk


def _present(k: Column) -> Column:
    return F.coalesce(k.cast("string"), F.lit(""))


def _usable(keys: list[str]) -> Column:
    """A key is usable when at least one part is not blank."""
    return reduce(lambda a, b: a | b, [col(k).isNotNull() & (col(k).cast("string") != "") for k in keys])


def first_per_key(right: DataFrame, keys: list[Column], order_by) -> DataFrame:
    """Right side with one row per usable key, in columns ``_k0, _k1, ...``."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = right.withColumns(dict(zip(names, keys))).filter(_usable(names))
    order = [col(c) for c in (order_by or right.columns)]
    return first_rows(keyed, [F.col(n) for n in names], order)


def lookup(left: DataFrame, right: DataFrame, on, order_by=(), prefix: str = PREFIX, flag: str | None = None,
           unique_right: bool = False, skew: str = "aqe") -> DataFrame:
    """Left lookup: every left row once, the first matching right row beside it.

    ``on`` is a name, a list of names or of ``(left, right)`` pairs. Keys are
    compared without white space, width and case. Blank keys never match.
    ``order_by`` says which right row is first. The join side is chosen by the
    optimizer from measured sizes; nothing is forced to broadcast. A hot left
    key is split by adaptive skew handling, or with ``skew="salt"`` by salting.
    """
    pairs = _pairs(on)
    lk, rk = _keys(left, right, pairs)
    names = [f"_k{i}" for i in range(len(pairs))]
    if unique_right:
        keyed = right.withColumns(dict(zip(names, rk))).filter(_usable(names))
    else:
        keyed = first_per_key(right, rk, order_by)
    right_keys = {b for _, b in pairs}
    carried = [c for c in right.columns if c not in right_keys]
    out_names = _free_names(left.columns, carried, prefix)
    lean = keyed.select(*names, *[col(c).alias(n) for c, n in zip(carried, out_names)], F.lit(True).alias("_hit"))
    probe = left.withColumns(dict(zip(names, lk)))
    if skew == "salt":
        joined = join_salted(probe, lean, names, "left", F.struct(*[col(c) for c in left.columns]))
    elif skew == "aqe":
        joined = probe.join(lean, names, "left")
    else:
        raise ValueError("skew must be 'aqe' or 'salt'")
    extra = [F.coalesce(F.col("_hit"), F.lit(False)).alias(flag)] if flag else []
    return joined.select(*[col(c) for c in left.columns], *[col(n) for n in out_names], *extra)


def _free_names(taken, carried, prefix: str) -> list[str]:
    """Names for looked-up columns; a name already present gets a number."""
    used, out = set(taken), []
    for c in carried:
        name, i = prefix + c, 2
        while name in used:
            name, i = f"{prefix}{c}_{i}", i + 1
        used.add(name)
        out.append(name)
    return out


def lookup_chain(main: DataFrame, others, flags: bool = False) -> DataFrame:
    """Fold several lookups onto the main table.

    ``others`` holds ``(table, on, order_by)``; ``on=None`` takes the common
    columns, and a table without any is skipped. With ``flags`` each lookup
    adds ``_hit_<n>``.
    """
    out = main
    for i, (table, on, order_by) in enumerate(others, 1):
        keys = on if on is not None else [c for c in out.columns if c in table.columns]
        if not keys:
            continue
        out = lookup(out, table, keys, order_by, flag=f"_hit_{i}" if flags else None)
    return out


def lookup_stats(matched: DataFrame, flags) -> DataFrame:
    """One row per lookup: matched, unmatched and rate, from one scan."""
    batch_only(matched, "lookup_stats")
    flags = [flags] if isinstance(flags, str) else list(flags)
    counted = matched.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(col(f)).alias(f) for f in flags])
    rows = F.array(*[F.struct(F.lit(f).alias("lookup"), col(f).alias("matched")) for f in flags])
    return counted.select("n", F.inline(rows)).select(
        "lookup", "matched", (F.col("n") - F.col("matched")).alias("unmatched"),
        F.try_divide(F.col("matched").cast("double"), F.col("n")).alias("match_rate"),
    )


def zip_tables(tables, order_by, number: str = "_row") -> DataFrame:
    """Tables side by side by row position; shorter ones are padded with null.

    ``order_by`` gives the order of each table. A repeated column name gets a number.
    """
    numbered = [with_row_number(t, o, number) for t, o in zip(tables, order_by)]
    used: set[str] = set()
    out = None
    for t in numbered:
        names = _free_names(used, [c for c in t.columns if c != number], "")
        used |= set(names)
        side = t.select(col(number), *[col(c).alias(n) for c, n in zip([c for c in t.columns if c != number], names)])
        out = side if out is None else out.join(side, number, "full")
    return out


def stack_tables(*tables: DataFrame) -> DataFrame:
    """Tables below each other; columns are aligned by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
