"""Products of the membership table with values of many traits.

Joined in long form, a membership meets every trait's value on a row of its own, and the sums of (set, trait) hardly shrink before the shuffle. Here
the values of a key stand side by side in rows of at most WIDTH columns, numbered by an axis of the names. A membership then meets one row for WIDTH
names, and what is shuffled is memberships, keys and sums. A bit for each column tells which names a key has, so a null value stays a row.

Sums by set are made where the entities are, so a set has a row of sums in each task that holds one of its members. Large membership tables are
therefore dealt in ranges of entities of a fixed number of memberships (``in_blocks``), not in as many tasks as the session shuffles to.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisets.plans.iterate import AXIS, heavy_keys, held, split_join, spread

WIDTH = 32  # values side by side in a row
CELLS = 12_000_000  # values that are broadcast at once, about 100 MB
PASSES = 8  # broadcasts in turn; values beyond are joined by shuffle
BLOCK = 1_000_000  # memberships in a range of entities


@dataclass
class Axis:
    table: DataFrame  # names..., _slot, _at: the row and the column of a name
    names: list[str]
    width: int


@dataclass
class Packed:
    rows: DataFrame  # keys..., _slot, _mask, _v0 ... of the width
    keys: list[str]
    axis: Axis


def name_axis(values: DataFrame, names: list[str]) -> Axis:
    """Rows and columns of the distinct names. Neighbours in order share a row, so values that lack whole parts of the names need fewer rows."""
    distinct = held(values.select(*names).distinct())
    n = max(1, distinct.count())
    width = -(-n // -(-n // WIDTH))
    lists = distinct.groupBy(F.pmod(F.xxhash64(*names), F.lit(-(-n // AXIS))).cast("int").alias("_bucket")).agg(
        F.array_sort(F.collect_list(F.struct(*names))).alias("_names"))
    rows = lists.select("_bucket", F.posexplode("_names").alias("_i", "_name"))
    slot = F.col("_bucket") * (1 << 16) + F.floor(F.col("_i") / width).cast("int")
    return Axis(rows.select("_name.*", slot.alias("_slot"), (F.col("_i") % width).alias("_at")), names, width)


def _sums(axis: Axis, weight: Column | None = None) -> list[Column]:
    cells = [F.col(f"_v{k}") if weight is None else weight * F.col(f"_v{k}") for k in range(axis.width)]
    return [F.bit_or("_mask").alias("_mask"), *[F.sum(c).alias(f"_v{k}") for k, c in enumerate(cells)]]


def pack(values: DataFrame, keys: list[str], axis: Axis, col: str) -> Packed:
    """``col`` of (keys, names) side by side; rows are brought together by the keys while they are still narrow."""
    rows = values.select(*keys, *axis.names, F.col(col).alias("_v")).join(F.broadcast(axis.table), axis.names).drop(*axis.names)
    rows = spread(rows, *keys).groupBy(*keys, "_slot").agg(
        F.bit_or(F.expr("shiftleft(1L, _at)")).alias("_mask"),
        *[F.sum(F.when(F.col("_at") == k, F.col("_v"))).alias(f"_v{k}") for k in range(axis.width)])
    return Packed(rows, keys, axis)


def unpack(packed: Packed, name: str) -> DataFrame:
    """(keys, names, ``name``), a row for each name that the key has."""
    cells = F.array(*[F.struct(F.lit(k).alias("_at"), F.col(f"_v{k}").alias(name)) for k in range(packed.axis.width)])
    rows = packed.rows.select(*packed.keys, "_slot", "_mask", F.explode(cells).alias("_c")).where("getbit(_mask, _c._at) = 1")
    rows = rows.select(*packed.keys, "_slot", "_c._at", F.col(f"_c.{name}").alias(name))
    return rows.join(F.broadcast(packed.axis.table), ["_slot", "_at"]).select(*packed.keys, *packed.axis.names, name)


def total(parts: list[Packed]) -> Packed:
    """Sum of packed tables with the same keys and axis."""
    keys, axis = parts[0].keys, parts[0].axis
    if len(parts) == 1:
        return parts[0]
    return Packed(reduce(DataFrame.unionByName, (p.rows for p in parts)).groupBy(*keys, "_slot").agg(*_sums(axis)), keys, axis)


def union(parts: list[Packed]) -> Packed:
    """Packed tables with the same keys and axis, one below the other, for products that sum anyway."""
    return Packed(reduce(DataFrame.unionByName, (p.rows for p in parts)), parts[0].keys, parts[0].axis)


def in_blocks(membership: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(a stored membership table, its popular entities): one of more than BLOCK rows is stored with ``_blk``, the range of its entity.

    Ranges hold about BLOCK rows; the order of entities decides which are together, so sets of neighbours are in few ranges. A table with popular
    entities, that would fill ranges of their own, has no ranges, and ``sum_over_entities`` splits these.
    """
    blocks = -(-membership.count() // BLOCK)
    if blocks < 2 or dict(membership.dtypes)["weight"] != "double":
        return membership, heavy_keys(membership, "entity_id")
    ranges = held(membership.repartitionByRange(blocks, "entity_id").withColumn("_blk", F.spark_partition_id()))
    heavy = heavy_keys(ranges, "entity_id")
    return (ranges, None) if heavy is None else (ranges.drop("_blk"), heavy)


def entity_keys(membership: DataFrame) -> list[str]:
    return ["entity_id", "_blk"] if "_blk" in membership.columns else ["entity_id"]


def with_blocks(values: Packed, membership: DataFrame) -> Packed:
    """Values of entities with the ``_blk`` of a membership table, if it has one; entities without a member are left out."""
    if "_blk" not in membership.columns:
        return values
    rows = values.rows.join(membership.select("entity_id", "_blk").distinct(), "entity_id")
    return Packed(rows, [*values.keys, "_blk"], values.axis)


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of the values of a column, and the distinct values; null is one of them."""
    d = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _sums_of_block(members: pa.Table, values: pa.Table, keys: list[str], width: int) -> pa.Table | None:
    """Sums of weight x value of one range of entities by ``keys`` (the set, then keys of the values) and ``_slot``."""
    layers = [*keys[1:], "_slot"]  # at most some tens of combinations
    values = values.filter(pc.is_valid(values["entity_id"]))
    entity, distinct = _codes(values["entity_id"])
    at = pc.fill_null(pc.index_in(members["entity_id"], value_set=distinct), -1).to_numpy()
    live = at >= 0
    at, members = at[live], members.filter(pa.array(live))
    of, sets = _codes(members["set_id"])
    order = np.argsort(of, kind="stable")
    at, of = at[order], of[order]
    known = members["weight"].is_valid().to_numpy()[order]
    weight = members["weight"].fill_null(0.0).to_numpy()[order]
    mask = values["_mask"].to_numpy()
    layer = np.zeros(len(mask), dtype=np.int64)
    for c in layers:
        code, names = _codes(values[c])
        layer = layer * max(1, len(names)) + code
    cells = [values[f"_v{k}"] for k in range(width)]
    valid = np.zeros(len(mask), dtype=np.int64)
    for k, c in enumerate(cells):
        valid |= c.is_valid().to_numpy().astype(np.int64) << k
    cells = [c.fill_null(0.0).to_numpy() for c in cells]
    done = []
    for one in np.unique(layer):
        rows = np.flatnonzero(layer == one)
        e, n = entity[rows], len(distinct)
        bits, sure = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        np.bitwise_or.at(bits, e, mask[rows])
        np.bitwise_or.at(sure, e, valid[rows])
        here = np.flatnonzero(np.bincount(e, minlength=n)[at] > 0)
        if not len(here):
            continue
        a, w, s = at[here], weight[here], of[here]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        some = np.bitwise_or.reduceat(np.where(known[here], sure[a], 0), first)
        out = {keys[0]: sets.take(pa.array(s[first]))}
        for c in layers:
            out[c] = values[c].combine_chunks().take(pa.array(np.full(len(first), rows[0])))
        out["_mask"] = pa.array(np.bitwise_or.reduceat(bits[a], first))
        for k, c in enumerate(cells):
            sums = np.add.reduceat(w * np.bincount(e, weights=c[rows], minlength=n)[a], first)
            out[f"_v{k}"] = pa.array(sums, mask=(some >> k) & 1 == 0)
        done.append(pa.table(out))
    return pa.concat_tables(done) if done else None  # no member has a value


def sum_over_entities(membership: DataFrame, values: Packed, keys: list[str], heavy: DataFrame | None = None) -> Packed:
    """sum of weight x value by ``keys``, the set first, through the shared entities; ``heavy`` are the popular ones (``heavy_keys``).

    Where both tables have ``_blk``, the rows of a range meet as one group, and a set has one row of sums for each range it is in.
    """
    axis = values.axis
    if "_blk" not in membership.columns or "_blk" not in values.keys:
        joined = split_join(membership, values.rows, "entity_id", "set_id", heavy)
        return Packed(joined.groupBy(*keys, "_slot").agg(*_sums(axis, F.col("weight"))), keys, axis)
    width = axis.width
    columns = [*keys, "_slot", "_mask", *[f"_v{k}" for k in range(width)]]
    left = membership.select("_blk", "set_id", "entity_id", "weight")
    right = values.rows.select("_blk", "entity_id", *keys[1:], "_slot", "_mask", *[F.col(f"_v{k}").cast("double").alias(f"_v{k}") for k in range(width)])
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own, as values may come from the members
    kinds = dict([*left.dtypes, *right.dtypes])

    def match(members: pa.Table, rows: pa.Table) -> pa.Table:
        sums = _sums_of_block(members, rows, keys, width) if len(members) and len(rows) else None
        if sums is not None:
            return sums
        return pa.table({c: pa.array([], (members if c == keys[0] else rows).schema.field(c).type) for c in columns})

    parts = left.groupBy("_blk").cogroup(right.groupBy("_blk")).applyInArrow(match, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
    return Packed(parts.groupBy(*keys, "_slot").agg(*_sums(axis)), keys, axis)


def sum_over_sets(membership: DataFrame, values: Packed, keys: list[str], where: str | None = None) -> Packed:
    """sum of weight x value by ``keys``, the entity first, over its sets; keys of ``values`` besides the set are part of them.

    The values of sets are few against memberships: they are stored and broadcast, CELLS at a time, to memberships that are dealt by entity; so no
    product is shuffled. Passes go by the other keys (folds, grid values), whose sums are apart, then by at most PASSES parts of the sets, whose sums
    are added. Beyond that values are joined by shuffle.
    """
    axis, rows = values.axis, held(values.rows)
    apart = [k for k in values.keys if k != "set_id"]
    on = [k for k in values.keys if k in membership.columns]
    cells = rows.count() * axis.width

    def product(left: DataFrame, right: DataFrame) -> Packed:
        joined = left.join(right, on)
        if where:
            joined = joined.where(where)
        return Packed(joined.groupBy(*keys, "_slot").agg(*_sums(axis, F.col("weight"))), keys, axis)

    if cells <= CELLS:
        return product(spread(membership, keys[0]), F.broadcast(rows))
    groups = sorted(rows.select(*apart).distinct().collect(), key=str) if apart else [()]
    size = max(1, len(groups) * CELLS // cells)  # groups in a pass
    passes = -(-(cells * size // len(groups)) // CELLS)
    if passes > PASSES:
        return product(membership, rows)
    done = []
    for first in range(0, len(groups), size):
        chosen = groups[first:first + size]
        only = lambda df, c=chosen: df.where(reduce(Column.__or__, (
            reduce(Column.__and__, (F.col(k).eqNullSafe(F.lit(r[k])) for k in apart if k in df.columns), F.lit(True)) for r in c))) if apart else df
        part = lambda df, i, only=only: only(df).where(F.pmod(F.xxhash64("set_id"), F.lit(passes)) == i)
        sums = [product(spread(part(membership, i), keys[0]), F.broadcast(part(rows, i))) for i in range(passes)]
        done.append(held(total([Packed(held(p.rows), keys, axis) if passes > 1 else p for p in sums]).rows))
    return Packed(reduce(DataFrame.unionByName, done), keys, axis)
