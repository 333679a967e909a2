"""Pairs of vectors whose cosine reaches a threshold, exactly.

Vectors are normalised once and dealt to cells of pivots where that prunes: a pair at the threshold can
stand in two cells only if one of its vectors lies near the plane between their pivots, so that
vector visits the other's cell. A cell that is large is cut into blocks, each one row, and every two of them meet in
a Cartesian product, which reads the blocks where they were saved: nothing is copied for it, so that disk grows with the
vectors and only the work with the pairs. In a task all pairs are multiplied in single precision, and
those that may reach the threshold, by a bound of its error, in double precision, which decides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .checkpoints import cut, short_batches

#: Rows that are multiplied at once, and rows of a block, at most about.
BLOCK, PACKED = 2048, 8192
#: Pivots, the vectors that they are drawn from, and the share of pairs up to which cells are worth their copies.
PIVOTS, SAMPLE, WORTH = 64, 2048, 0.5
#: Rows of two blocks whose products lie in a cache, and the share of such pairs from which all are multiplied in double precision at once.
TILE, DENSE = 1024, 0.05
#: Blocks of a partition, at most about, and how many of the next ones a block meets before what is connected by them is known.
HELD, NEAR = 8, 4
#: Rows of sizes that are broadcast; more are joined by shuffle.
BROADCAST = 100_000
_SLACK = 1e-9


def compare(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows of ``a`` and of ``b``, and cosines, of the pairs of unit vectors that reach ``least``; and how many pairs were multiplied in double precision."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    full, width = 0, a.shape[1]
    single = [x.astype(np.float32) for x in (a, b)]
    # Entries rounded once each and a sum of ``width`` products in any order: what unit vectors can lose.
    floor = np.nextafter(np.float32(least - (width + 8) * 2.0**-23 - _SLACK), np.float32(-2))
    for i in range(0, len(a), TILE):
        x = single[0][i : i + TILE]
        for j in range(0, len(b), TILE):
            y = single[1][j : j + TILE]
            p, q = _where(x @ y.T >= floor)
            if len(p) > DENSE * len(x) * len(y):
                product = a[i : i + TILE] @ b[j : j + TILE].T
                full += product.size
                p, q = np.nonzero(product >= least)
                s = product[p, q]
            elif len(p):
                full += len(p)
                s = np.concatenate([np.einsum("ij,ij->i", a[i + p[k : k + TILE]], b[j + q[k : k + TILE]]) for k in range(0, len(p), TILE)])
                p, q, s = p[s >= least], q[s >= least], s[s >= least]
            else:
                continue
            found.append((p + i, q + j, s))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), full
    return *(np.concatenate(c) for c in zip(*found)), full


def _where(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the few true entries; eight are looked at at once."""
    flat = true.reshape(-1)
    even = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:even].view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).reshape(-1)
    at = np.r_[at[flat[at]], even + np.flatnonzero(flat[even:])]
    return np.divmod(at, true.shape[1])


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors over their length, null entries as 0; None for those without length or with entries that aren't finite."""
    if isinstance(column, pa.ListArray) and not column.null_count and len(column):
        sizes = np.diff(column.offsets.to_numpy())
        if sizes[0] and (sizes == sizes[0]).all():
            x = pc.fill_null(column.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
            with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                size = np.sqrt((x * x).sum(axis=1))
                x = x / size[:, None]
            return [v if k else None for v, k in zip(x, np.isfinite(size) & (size > 0))]
    out: list[np.ndarray | None] = []
    for v in column:
        x = np.array(pc.fill_null(v.values, 0)) if v.is_valid else np.zeros(0)
        x = x.astype(np.float64)
        size = np.sqrt((x * x).sum())
        out.append(x / size if np.isfinite(size) and size > 0 else None)
    return out


class Cells:
    """Pivots of one dimension, and the cells that a vector belongs to."""

    def __init__(self, pivots: np.ndarray, least: float):
        self.pivots, self.reach = pivots, np.sqrt(max(0.0, 2 - 2 * least))
        self.apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's own cell, and whether it can have a partner in each: whether the plane between is within reach."""
        near = x @ self.pivots.T
        own = near.argmax(axis=1)
        return own, near[np.arange(len(x)), own][:, None] - near <= self.reach * self.apart[own] + _SLACK

    def share(self, x: np.ndarray) -> float:
        """Share of all pairs that meet in cells, by a sample."""
        own, can = self.of(x)
        home = np.bincount(own, minlength=len(self.pivots))
        visits = (can & (np.arange(len(self.pivots)) < own[:, None])).sum(axis=0)
        return float((home * (home - 1) / 2 + home * visits).sum() / max(1, len(x) * (len(x) - 1) / 2))


def _cells(rows: DataFrame, least: float) -> tuple[Cells | None, int | None]:
    """Cells, if they are worth it, and the number of rows if there are fewer than SAMPLE."""
    sample = [r["embedding"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()]
    units = [v for v in unit_rows(pa.array(sample, pa.list_(pa.float64()))) if v is not None]
    few = len(sample) if len(sample) < SAMPLE else None
    if len(units) < 4 * PIVOTS:
        return None, few
    sizes, counts = np.unique([len(v) for v in units], return_counts=True)
    x = np.array([v for v in units if len(v) == sizes[counts.argmax()]])
    found = Cells(np.unique(x[:PIVOTS], axis=0), least)
    return (found if found.share(x) <= WORTH else None), few


def _placed(rows: DataFrame, cells: Cells | None, both: bool) -> DataFrame:
    """Rows (id, v, group, side, cell, home): with cells, one for each cell that a vector is looked at in."""

    def run(batches):
        for batch in batches:
            take, place, home, out = [], [], [], []
            for k, v in enumerate(unit_rows(batch.column(1))):
                if v is None:
                    continue
                if cells is None or len(v) != cells.pivots.shape[1]:
                    own, others = 0, ()
                else:
                    nearest, can = cells.of(v[None])
                    own = int(nearest[0])
                    # of two vectors of one list the one from the later cell visits; stored ones visit new ones, which stay
                    others = np.flatnonzero(can[0])
                    others = others[others < own] if not both else others[others != own] if batch.column(3)[k].as_py() else ()
                for cell in (own, *others):
                    take.append(k)
                    place.append(int(cell))
                    home.append(cell == own)
                    out.append(v)
            took = pa.array(take, pa.int64())
            v = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), v, batch.column(2).take(took), batch.column(3).take(took), pa.array(place, pa.int32()), pa.array(home, pa.bool_())], ["id", "v", "group", "side", "cell", "home"])

    kind, group = (rows.schema[c].dataType.simpleString() for c in ("id", "group"))
    placed = rows.mapInArrow(run, f"id {kind}, v array<double>, `group` {group}, side boolean, cell int, home boolean")
    return placed.withColumn("cell", F.struct("cell", F.size("v").alias("size")))


def _sized(placed: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Groups' cells (g, c) of more than ``block`` rows with the number of their blocks, broadcast if they are few; and the blocks of all."""
    large = placed.groupBy("group", "cell").count().where(F.col("count") > block)
    large = cut(large.select(F.col("group").alias("g"), F.col("cell").alias("c"), F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    cells, blocks = large.agg(F.count(F.lit(1)), F.sum("blocks")).first()
    return (F.broadcast(large) if cells <= BROADCAST else large), blocks or 0


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    """A block as one row."""
    table = table.combine_chunks()
    lists = {c: pa.array([table[c].to_pylist()], pa.list_(table[c].type)) for c in ("id", "side", "home")}
    v = table["v"].combine_chunks().flatten().to_numpy()
    return pa.table({"group": pa.array([key[0].as_py()], key[0].type), "cell": pa.array([key[1].as_py()], key[1].type), "block": pa.array([key[2].as_py()], key[2].type), **lists, "v": pa.array([v.tobytes()], pa.binary())})


def _packed(dealt: DataFrame, blocks: int) -> DataFrame:
    kind, group = (dealt.schema[c].dataType.simpleString() for c in ("id", "group"))
    dealt = dealt.repartition(blocks, "group", "cell", "block")
    packed = dealt.groupBy("group", "cell", "block").applyInArrow(_pack, f"`group` {group}, cell struct<cell:int,size:int>, block int, id array<{kind}>, side array<boolean>, home array<boolean>, v binary")
    # Every two partitions meet in a task, which reads both: few partitions of several blocks are read less often.
    cores = dealt.sparkSession.sparkContext.defaultParallelism
    return cut(packed).coalesce(min(blocks, max(2 * cores, -(-blocks // HELD))))


def _meet(least: float, both: bool, emit: Callable, lo: int, hi: int, ids: np.ndarray, kind, block: np.ndarray, v: np.ndarray, side: np.ndarray, home: np.ndarray) -> pa.Table:
    """What ``emit`` makes of all matches of two blocks (or of one with itself)."""
    first = ~side if both else home
    rows = lambda condition: np.flatnonzero(condition)
    if both:  # new ones with stored ones
        meetings = [(rows(first & (block == lo)), rows(~first & (block == hi)))] + ([(rows(first & (block == hi)), rows(~first & (block == lo)))] if lo < hi else [])
    elif lo == hi:
        meetings = [(rows(first), rows(first)), (rows(first), rows(~first))]
    else:
        meetings = [(rows(first & (block == lo)), rows(block == hi)), (rows(~first & (block == lo)), rows(first & (block == hi)))]
    found = []
    for n, (a, b) in enumerate(meetings):
        for k in range(0, len(a), BLOCK):
            p, q, s, _ = compare(v[a[k : k + BLOCK]], v[b], least)
            p, q = a[k : k + BLOCK][p], b[q]
            once = p < q if not both and lo == hi and n == 0 else np.ones(len(p), bool)
            found.append(emit(ids[p[once]], ids[q[once]], s[once], kind))
    return pa.concat_tables(found) if found else emit(ids[:0], ids[:0], np.zeros(0), kind)


def _ordered(a, b):
    low = a < b
    return np.where(low, a, b), np.where(low, b, a)


def _emit_pairs(a, b, s, kind):
    low, high = _ordered(a, b)
    kept = low != high
    return pa.table({"a": pa.array(low[kept], kind), "b": pa.array(high[kept], kind), "similarity": pa.array(s[kept])})


def _emit_best(a, b, s, kind):
    """Of each larger id the most alike smaller one, the smallest of equally alike ones."""
    low, high = _ordered(a, b)
    kept = np.flatnonzero(low != high)
    kept = kept[np.lexsort((low[kept], -s[kept], high[kept]))]
    first = np.r_[True, high[kept][1:] != high[kept][:-1]] if len(kept) else np.zeros(0, bool)
    kept = kept[first]
    return pa.table({"a": pa.array(low[kept], kind), "b": pa.array(high[kept], kind), "similarity": pa.array(s[kept])})


def _emit_new(a, b, s, kind):
    one = np.unique(a)
    return pa.table({"a": pa.array(one, kind), "b": pa.array(one, kind), "similarity": pa.array(np.zeros(len(one)))})


def _emit_roots(a, b, s, kind):
    """Each id with the smallest one that the matches connect it to: no more rows than ids."""
    names, ends = np.unique(np.r_[a, b], return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while True:
        least = root.copy()
        np.minimum.at(least, u, root[v])
        np.minimum.at(least, v, root[u])
        least = least[least]
        if (least == root).all():
            break
        root = least
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pa.table({"a": pa.array(names[root[moved]], kind), "b": pa.array(names[moved], kind), "similarity": pa.array(np.zeros(len(moved)))})


def _rows(rows: DataFrame, within: Column | None, side: bool) -> DataFrame:
    group = within if within is not None else F.lit(0)
    return rows.select("id", F.col("embedding").cast("array<double>").alias("embedding"), group.alias("group"), F.lit(side).alias("side")).where(F.size("embedding") > 0)


def _outside(least: float, asking: tuple, asked: tuple, kind) -> pa.Table:
    """Links of rows (ids, home, v) with those of another block."""
    (ids, home, v), (others, at_home, w) = asking, asked
    found = []
    for a, b in ((np.flatnonzero(home), np.arange(len(others))), (np.flatnonzero(~home), np.flatnonzero(at_home))):
        if len(a) and len(b):
            p, q, s, _ = compare(v[a], w[b], least)
            found.append((ids[a[p]], others[b[q]], s))
    return _emit_roots(*(np.concatenate(c) for c in zip(*found)), kind) if found else _emit_roots(ids[:0], ids[:0], np.zeros(0), kind)


def _sides(packed: DataFrame, asked: DataFrame) -> DataFrame:
    """Every two blocks (lo, hi) of one group and cell."""
    sides = [p.select(F.col("group").alias(f"group_{e}"), F.col("cell").alias(f"cell_{e}"), F.col("block").alias(name), *[F.col(c).alias(f"{c}_{e}") for c in ("id", "side", "home", "v")]) for p, e, name in ((packed, "a", "lo"), (asked, "b", "hi"))]
    return sides[0].hint("shuffle_replicate_nl").join(sides[1], F.col("group_a").eqNullSafe(F.col("group_b")) & (F.col("cell_a") == F.col("cell_b")))


def _unpacked(batch: pa.RecordBatch, row: int, end: str) -> tuple:
    at = lambda c: batch.column(f"{c}_{end}")[row]
    ids = at("id").values.to_numpy(zero_copy_only=False)
    return ids, at("home").values.to_numpy(zero_copy_only=False), np.frombuffer(at("v").as_py(), np.float64).reshape(len(ids), -1)


def _connected(first: DataFrame, dealt: DataFrame, packed: DataFrame, meet: DataFrame, together: Callable, least: float, block: int, found: str) -> DataFrame:
    """Links (a, b, similarity) that connect what all pairs do, of which ``first`` and those of blocks that are NEAR come first.

    Rows of the largest component so far need no comparison with each other. If it holds half of the rows or more,
    only the others meet the blocks; else all blocks meet.
    """
    from .components import components

    near = meet.where(F.col("hi") - F.col("lo") <= NEAR).drop("group_a", "group_b", "cell_a", "cell_b").mapInArrow(together, found)
    roots = cut(components(first.unionByName(near).select(F.col("a").alias("u"), F.col("b").alias("v"))))
    links = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("similarity"))
    largest = roots.groupBy("root").count().orderBy(F.desc("count"), "root").first()
    ids = dealt.select("id").distinct()
    outside = cut(ids.join(roots.where(F.col("root") == largest["root"]).select(F.col("node").alias("id")), "id", "left_anti") if largest else ids)
    left = outside.count()
    if not left:
        return links
    if largest is None or left > largest["count"]:
        far = meet.where(F.col("hi") - F.col("lo") > NEAR)
        return links.unionByName(far.drop("group_a", "group_b", "cell_a", "cell_b").mapInArrow(together, found))

    def asking(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _outside(least, _unpacked(batch, row, "a"), _unpacked(batch, row, "b"), batch.schema.field("id_a").type.value_type).to_batches()

    parts = -(-left // block)
    few = dealt.join(F.broadcast(outside) if left <= BROADCAST else outside, "id").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int"))
    far = _sides(_packed(few.select(dealt.columns), parts), packed)
    return links.unionByName(far.drop("group_a", "group_b", "cell_a", "cell_b").mapInArrow(asking, found))


def _joined(rows: DataFrame, least: float, both: bool, emit: Callable, block: int) -> DataFrame:
    if not 0 < least <= 1:
        raise ValueError("the threshold must be above 0, and 1 at most")
    cells, few = _cells(rows, least)
    placed = _placed(rows, cells, both)
    kind = rows.schema["id"].dataType.simpleString()
    found = f"a {kind}, b {kind}, similarity double"

    def alone(key, table):
        table = table.combine_chunks()
        ids = table["id"].to_numpy()
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        return _meet(least, both, emit, 0, 0, ids, table["id"].type, np.zeros(len(ids), np.int64), v, table["side"].to_numpy(), table["home"].to_numpy())

    def together(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row] for c in batch.schema.names}
                lo, hi = at["lo"].as_py(), at["hi"].as_py()
                ends = "a" if lo == hi else "ab"
                held = {c: [at[f"{c}_{e}"].values.to_numpy(zero_copy_only=False) for e in ends] for c in ("id", "side", "home")}
                v = [np.frombuffer(at[f"v_{e}"].as_py(), np.float64).reshape(len(i), -1) for e, i in zip(ends, held["id"])]
                block = np.repeat([lo, hi][: len(ends)], [len(i) for i in held["id"]])
                ids, side, home = (np.concatenate(held[c]) for c in ("id", "side", "home"))
                yield from _meet(least, both, emit, lo, hi, ids, batch.schema.field("id_a").type.value_type, block, np.concatenate(v), side, home).to_batches()

    # a cell has a copy of a row at most, so that of few rows none is beyond one block
    large, blocks = (None, 0) if few is not None and few <= block else _sized(placed, block)
    if not blocks:
        return placed.groupBy("group", "cell").applyInArrow(alone, found)
    same = F.col("group").eqNullSafe(F.col("g")) & (F.col("cell") == F.col("c"))
    small = placed.join(large, same, "left_anti").groupBy("group", "cell").applyInArrow(alone, found)
    dealt = placed.join(large, same).drop("g", "c").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = _packed(dealt, blocks)
    meet = _sides(packed, packed).where(F.col("lo") <= F.col("hi"))
    short_batches(rows.sparkSession)
    if emit is _emit_roots and blocks > 4 * NEAR:
        return _connected(small, dealt, packed, meet, together, least, block, found)
    return small.unionByName(meet.drop("group_a", "group_b", "cell_a", "cell_b").mapInArrow(together, found))


def pairs(rows: DataFrame, least: float, within: Column | None = None, block: int = PACKED) -> DataFrame:
    """(a, b, similarity) with a < b: all pairs of rows (id, embedding) of one ``within`` whose cosine is ``least`` or more.

    Vectors of unlike lengths, without length, null, or with entries that aren't finite have no partner; null entries
    count as 0; rows of one id are no pair; a null ``within`` is a group of its own.
    """
    return _joined(_rows(rows, within, False), least, False, _emit_pairs, block)


def links(rows: DataFrame, least: float, block: int = PACKED) -> DataFrame:
    """(a, b) that connect the same rows as ``pairs``: of each two blocks no more than their rows, however many pairs they hold.

    Of many blocks, rows that the first meetings bring to one component aren't compared again with each other.
    """
    return _joined(_rows(rows, None, False), least, False, _emit_roots, block).select("a", "b")


def nearest_earlier(rows: DataFrame, least: float, within: Column | None = None, block: int = PACKED) -> DataFrame:
    """(id, other, similarity): of each row that has one, the most alike row of a smaller id, as ``pairs``; a task sends one row an id."""
    found = _joined(_rows(rows, within, False), least, False, _emit_best, block)
    return found.groupBy(F.col("b").alias("id")).agg(F.min_by("a", F.struct(-F.col("similarity"), "a")).alias("other"), F.max("similarity").alias("similarity"))


def alike(new: DataFrame, stored: DataFrame, least: float, within: Column | None = None, block: int = PACKED) -> DataFrame:
    """Ids of new rows with a cosine of ``least`` or more to a stored row of the same ``within``; stored rows need no id that differs."""
    rows = _rows(new, within, False).unionByName(_rows(stored, within, True))
    return _joined(rows, least, True, _emit_new, block).select(F.col("a").alias("id")).distinct()
