"""Values at given ranks, without sorting: histograms of ever finer cells.

Numbers are mapped to 64-bit keys of the same order. A pass counts the rows in cells, runs of keys with the same leading
bits, with their least and largest key, and only cells that hold a wanted rank and more than one value are cut further in the next pass. Once the open cells have
``CELLS`` rows at most, these are counted by value instead. All columns share a pass, which moves one row per task and cell that is not empty; at most
``CELLS`` cells are counted at once, whatever the size of the table and however its values are spread. Nothing is estimated: the values are exact, with the number of rows below and at them.

Nulls and NaN have no rank. -0.0 counts as 0.0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import scan
from riskloom.functions.storage import stored

CELLS = 1 << 18
MOST_BITS, LEAST_BITS = 12, 3
SIGN = np.uint64(1 << 63)


@dataclass(frozen=True)
class Found:
    """The value at a rank, how many rows are less, and how many equal."""

    value: float | int
    below: int
    equal: int


def ordered_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of whole numbers or doubles."""
    if values.dtype.kind != "f":
        return values.astype(np.int64).view(np.uint64) ^ SIGN
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def value_of(key: int, real: bool) -> float | int:
    if not real:
        return key - (1 << 63)
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.uint64(bits).view(np.float64))


@dataclass
class _Open:
    """Cells of a column that still hold wanted ranks: their leading bits, ascending, and the rows below each."""

    real: bool
    rest: int  # bits that the cells leave open
    cells: np.ndarray
    below: list[int]
    wanted: list[list[int]]
    rows: int


def _numeric(df: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, list[bool]]:
    d = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns.values())])
    real = [not isinstance(f.dataType, (T.IntegralType, T.BooleanType)) for f in d.schema]
    return d.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) if r else F.col(c).cast("long").alias(c)
                      for c, r in zip(d.columns, real)]), real


def _counted(d: DataFrame, open_: dict[int, _Open], bits: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(column, place of its cell, finer cell, rows, least key, largest key), in order; one pass."""
    names = [f"c{i}" for i in open_]
    plan = [(i, o.cells, o.rest, bits[i]) for i, o in open_.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(cells) << b, np.int64) for _, cells, _, b in plan]
        least = [np.full(len(t), ~np.uint64(0)) for t in totals]
        most = [np.zeros(len(t), np.uint64) for t in totals]
        for batch in batches:
            for total, low, high, column, (_, cells, rest, b) in zip(totals, least, most, batch.columns, plan):
                keys = ordered_keys(column.drop_null().to_numpy(zero_copy_only=False))
                leading = keys >> np.uint64(rest) if rest < 64 else np.zeros(len(keys), np.uint64)
                place = np.minimum(np.searchsorted(cells, leading), len(cells) - 1)
                inside = cells[place] == leading
                kept = keys[inside]
                at = (place[inside] << b) + ((kept >> np.uint64(rest - b)) & np.uint64((1 << b) - 1)).astype(np.int64)
                total += np.bincount(at, minlength=len(total))
                np.minimum.at(low, at, kept)
                np.maximum.at(high, at, kept)
        for total, low, high, (i, _, _, b) in zip(totals, least, most, plan):
            at = np.flatnonzero(total)
            # as signed numbers in the same order
            signed = [pa.array((x[at] ^ SIGN).view(np.int64)) for x in (low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int64)), pa.array(at >> b), pa.array(at & ((1 << b) - 1)), pa.array(total[at]), *signed],
                                             names=["column", "place", "cell", "n", "low", "high"])

    parts = d.select(*names).mapInArrow(run, "column long, place long, cell long, n long, low long, high long")
    merged = parts.groupBy("column", "place", "cell").agg(F.sum("n"), F.min("low"), F.max("high")).orderBy("column", "place", "cell")
    return [(i, p, c, n, low + (1 << 63), high + (1 << 63)) for i, p, c, n, low, high in merged.collect()]  # CELLS rows at most


def _by_value(d: DataFrame, open_: dict[int, _Open]) -> list[tuple[int, int, int, int]]:
    """(column, place of its cell, key, rows) of all rows in the open cells, in order; called for few rows."""
    names = [f"c{i}" for i in open_]
    plan = [(i, o.cells, o.rest) for i, o in open_.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column, (i, cells, rest) in zip(batch.columns, plan):
                keys = ordered_keys(column.drop_null().to_numpy(zero_copy_only=False))
                leading = keys >> np.uint64(rest) if rest < 64 else np.zeros(len(keys), np.uint64)
                place = np.minimum(np.searchsorted(cells, leading), len(cells) - 1)
                inside = cells[place] == leading
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(inside.sum()), i, np.int64)), pa.array(place[inside]), pa.array((keys[inside] ^ SIGN).view(np.int64))],
                                                 names=["column", "place", "key"])

    parts = d.select(*names).mapInArrow(run, "column long, place long, key long").groupBy("column", "place", "key").agg(F.count("*").alias("n"))
    return [(i, p, k + (1 << 63), n) for i, p, k, n in parts.orderBy("column", "place", "key").collect()]  # CELLS rows at most


def values_at(df: DataFrame, columns: dict[str, Column], ranks: Callable[[str, int], list[int]]) -> dict[str, tuple[int, dict[int, Found]]]:
    """Per column: how many values it has, and what stands at the ranks (from 0) that ``ranks(name, count)`` asks for; ranks past the end
    are left out. ``df`` is read several times: pass a stored table."""
    d, real = _numeric(df, columns)
    sizes = d.agg(*[f(c) for c in d.columns for f in (F.count, F.min, F.max)]).first()
    out: dict[str, tuple[int, dict[int, Found]]] = {}
    open_: dict[int, _Open] = {}
    for i, name in enumerate(columns):
        n, low, high = sizes[3 * i:3 * i + 3]
        wanted = sorted({r for r in ranks(name, n) if 0 <= r < n})
        out[name] = (n, {})
        if wanted:
            a, b = (int(ordered_keys(np.array([x], np.float64 if real[i] else np.int64))[0]) for x in (low, high))
            if a == b:
                out[name][1].update({r: Found(value_of(a, real[i]), 0, n) for r in wanted})
                continue
            rest = (a ^ b).bit_length()
            open_[i] = _Open(real[i], rest, np.array([a >> rest], np.uint64), [0], [wanted], n)
    names = list(columns)
    while open_:
        few = sum(o.rows for o in open_.values()) <= CELLS
        share = CELLS // sum(len(o.cells) for o in open_.values())
        most = max(LEAST_BITS, min(MOST_BITS, share.bit_length() - 1))
        bits = {i: min(most, o.rest) for i, o in open_.items()}
        seen = [(i, p, k, n, k, k) for i, p, k, n in _by_value(d, open_)] if few else _counted(d, open_, bits)
        after = {i: _Open(o.real, o.rest - bits[i], np.zeros(0, np.uint64), [], [], 0) for i, o in open_.items()}
        cells: dict[int, list[int]] = {i: [] for i in open_}
        reached: dict[tuple[int, int], int] = {}
        for i, place, _, n, low, high in seen:
            o = open_[i]
            start = reached.get((i, place), o.below[place])
            reached[i, place] = start + n
            inside = [r for r in o.wanted[place] if start <= r < start + n]
            if inside and low == high:
                out[names[i]][1].update({r: Found(value_of(low, o.real), start, n) for r in inside})
            elif inside:
                cells[i].append(low >> after[i].rest)
                after[i].below.append(start)
                after[i].wanted.append(inside)
                after[i].rows += n
        for i, found in cells.items():
            after[i].cells = np.array(found, np.uint64)
        open_ = {i: o for i, o in after.items() if len(o.cells)}
    return out


def quantile_ranks(n: int, probs: list[float]) -> list[tuple[int, int, float]]:
    """Ranks below and above each probability among n values, and how far between them it lies."""
    return [(int(np.floor(p * (n - 1))), int(np.ceil(p * (n - 1))), p * (n - 1) - np.floor(p * (n - 1))) for p in probs] if n else []


def quantiles_of(df: DataFrame, columns: dict[str, Column], probs: list[float]) -> dict[str, list[float]]:
    """Interpolated quantiles of some columns, exact; an empty list for a column without values. ``df`` is read several times."""
    found = values_at(df, columns, lambda _, n: [r for low, high, _ in quantile_ranks(n, probs) for r in (low, high)])
    out = {}
    for name, (n, at) in found.items():
        out[name] = [float(at[low].value + (at[high].value - at[low].value) * w) for low, high, w in quantile_ranks(n, probs)]
    return out


def rows_at(df: DataFrame, order: list[str], ranks: Callable[[int], dict[str, int]]) -> tuple[int, dict[str, tuple | None]]:
    """The row count and the order values of the rows at some ranks in a total order, None past the end.

    The first order column, a number, is found by :func:`values_at`; only the rows that equal one of its values are ranked. ``df`` is read several
    times."""
    asked: dict[str, int] = {}

    def first(_: str, n: int) -> list[int]:
        asked.update(ranks(n))
        return list(asked.values())

    if isinstance(df.schema[order[0]].dataType, T.FractionalType):
        df = df.withColumn(order[0], F.col(order[0]).cast("double") + 0.0)  # one zero
    n, at = values_at(df, {"first": F.col(order[0])}, first)["first"]
    ties = {f.value: f for f in at.values()}
    out: dict[str, tuple | None] = {name: None for name in asked}
    if not ties:
        return n, out
    earlier, start = {}, 0
    for v in sorted(ties):
        earlier[v] = start
        start += ties[v].equal
    place = {name: earlier[at[r].value] + r - at[r].below for name, r in asked.items() if r in at}
    tied = df.select(*order).where(F.col(order[0]).isin(list(ties)))
    if start > len(ties):
        tied = scan.global_index(tied, order, "_place").where(F.col("_place").isin(sorted(set(place.values()))))
    else:
        tied = tied.withColumn("_place", F.element_at(F.create_map(*[F.lit(x) for v in earlier for x in (v, earlier[v])]), F.col(order[0])))
    rows = {r["_place"]: tuple(r[c] for c in order) for r in tied.select(*order, "_place").collect()}  # one row per rank asked for
    out.update({name: rows[p] for name, p in place.items()})
    return n, out


def at_or_before(order: list[str], row: tuple) -> Column:
    """Does a row stand at or before another in the order?"""
    return F.struct(*order) <= F.struct(*[F.lit(v).alias(c) for c, v in zip(order, row)])


def narrow(df: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns a selection reads, stored."""
    return stored(df.select(*columns), "selection")
