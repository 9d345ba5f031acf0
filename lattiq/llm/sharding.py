"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at ``VNODES`` places of a ring of hashes; a key belongs to
the next place clockwise.  The ring is cut into ``CELLS`` equal cells.  A shard is full when it holds ``(1 + SLACK)`` times the mean load in
bytes; a cell that doesn't fit continues clockwise to the next shard that has
room, so loads are near equal and only what overflows moves.  Cells go in order
of their load, largest first, then of their place, which makes the outcome the
same for any order of rows.  If a cell fits nowhere it goes to the least loaded
shard that its walk passes.

Loads are summed by cell with map-side combining; at most ``CELLS`` rows reach
the driver, whatever the input.  A cell that holds more than a ``HEAVY``-th of a
shard's bytes - repeated rows of one key - is dealt into ``SPLIT`` cells at the
same place, so it neither unbalances a shard nor lands in one task.  A slot is the cell's offset
in its shard plus the row's number in the cell, so no task sorts a shard.

Defined results: a null text has size 1 and CRC 0; null keys are told apart by
text; repeated rows (same key, same text) share a cell, unless it is heavy, and
get slots of their own; a very long text is one row, and may fill a shard beyond
its limit alone.  An empty table gives an empty table.  ``key`` rows keep all other columns.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.common import cut, free_name

VNODES = 64
CELLS = 1 << 15
HEAVY = 8
SPLIT = 64
SLACK = 0.0005
RING = 1 << 32


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, in order of place."""
    places = {xxhash.xxh3_64_intdigest(f"shard {s} node {v}") % RING: s for s in range(shards) for v in range(vnodes)}
    return sorted(places.items())


def size(text: Column) -> Column:
    """UTF-8 bytes plus 1; 1 for a null text."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def owners(nodes: list[tuple[int, int]], cells: int = CELLS) -> list[int]:
    """The index of the first virtual node at or after the start of each cell."""
    places = [p for p, _ in nodes]
    return [bisect.bisect_left(places, c * (RING // cells)) % len(nodes) for c in range(cells)]


def heavy(loads: dict[int, int], counts: dict[int, int], shards: int) -> list[int]:
    """Cells of more than a HEAVY-th of a shard's bytes in several rows: at most HEAVY times the shards."""
    limit = sum(loads.values()) / (shards * HEAVY)
    return sorted(c for c, load in loads.items() if load > limit and counts[c] > 1)


def place(loads: dict[int, int], nodes: list[tuple[int, int]], first: list[int], shards: int, slack: float = SLACK) -> dict[int, int]:
    """The shard of each cell, given the bytes in it."""
    limit = (1 + slack) * sum(loads.values()) / shards
    held = [0] * shards
    out = {}
    for cell, load in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        node = first[cell]
        passed: list[int] = []
        for step in range(len(nodes)):
            shard = nodes[(node + step) % len(nodes)][1]
            if shard in passed:
                continue
            if held[shard] + load <= limit:
                break
            passed.append(shard)
        else:
            shard = min(passed, key=lambda s: held[s])
        held[shard] += load
        out[cell] = shard
    return out


def shard(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16,
    vnodes: int = VNODES, cells: int = CELLS, slack: float = SLACK, keep: bool = False,
) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of each row; with ``keep``, all columns of ``docs`` and shard, slot."""
    nodes = ring(shards, vnodes)
    n_size, n_crc, n_cell, n_shard, n_slot, n_start, n_part = (free_name(docs, c) for c in ("size", "text_crc32", "__cell", "shard", "slot", "__start", "__part"))
    body = F.col(f"`{text}`")
    rows = docs.withColumns(
        {n_size: size(body), n_crc: F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long")}
    )
    spot = F.pmod(F.xxhash64(F.col(f"`{key}`"), n_crc, n_size), F.lit(RING))
    rows = rows.withColumn(n_cell, F.floor(spot / (RING // cells)).cast("int"))
    if not keep:
        rows = rows.select(f"`{key}`", n_size, n_crc, n_cell)
    sums = lambda df: df.groupBy(n_cell).agg(F.sum(n_size).alias("load"), F.count(F.lit(1)).alias("n")).collect()
    loads, first = sums(rows), owners(nodes, cells)
    hot = heavy({r[n_cell]: r["load"] for r in loads}, {r[n_cell]: r["n"] for r in loads}, shards)
    if hot:
        # Rows of one key and text share a cell; a heavy one is dealt into SPLIT cells at its place.  The rows
        # are written first, so that what a row is dealt by stays the same if an executor is lost.
        rows = cut(rows.withColumn(n_part, F.pmod(F.monotonically_increasing_id(), F.lit(SPLIT)).cast("int")))
        begin = F.create_map(*[x for k, c in enumerate(hot) for x in (F.lit(c), F.lit(cells + k * SPLIT))])
        dealt = F.get(F.array(begin[F.col(n_cell)]), F.lit(0)) + F.col(n_part)
        rows = rows.withColumn(n_cell, F.when(F.col(n_cell).isin(hot), dealt).otherwise(F.col(n_cell))).drop(n_part)
        loads = [r for r in loads if r[n_cell] not in set(hot)] + sums(rows.filter(F.col(n_cell) >= cells))
        first += [first[c] for c in hot for _ in range(SPLIT)]
    where = place({r[n_cell]: r["load"] for r in loads}, nodes, first, shards, slack)
    offset = [0] * shards
    table = []
    for r in sorted(loads, key=lambda r: r[n_cell]):
        s = where[r[n_cell]]
        table.append((r[n_cell], s, offset[s]))
        offset[s] += r["n"]
    spark = docs.sparkSession
    # At most as many rows as there are cells, a parameter.
    at = spark.createDataFrame(table, f"`{n_cell}` int, `{n_shard}` int, `{n_start}` bigint")
    rows = rows.join(F.broadcast(at), n_cell)
    order = Window.partitionBy(n_cell).orderBy(F.col(f"`{key}`").asc_nulls_last(), n_crc, n_size)
    rows = rows.withColumn(n_slot, F.col(n_start) + F.row_number().over(order) - 1)
    if keep:
        return rows.select(*[F.col(f"`{c}`") for c in docs.columns], n_shard, n_slot)
    made = {"size": n_size, "text_crc32": n_crc, "shard": n_shard, "slot": n_slot}
    return rows.select(F.col(f"`{key}`").alias("key"), *[F.col(c).alias(name) for name, c in made.items()])

