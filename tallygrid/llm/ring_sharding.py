"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A row's key has a place on a ring, and so have ``VNODES`` virtual nodes of each shard. A row belongs to
the first node clockwise from its place, unless that shard is full; then it goes on clockwise to
the first shard with room. The bound is exact: of n rows and k shards, n mod k shards take one
row more than the others, so counts are at most one apart (law ``rows``), while all rows that their
own shard has room for stay there.

The ring has a fixed number of cells, each cut into sub-cells by a hash of the row's place in the
staged table, so that one key with a third of all rows is spread over many. Rows are counted by
sub-cell; the plan of who takes which part of which sub-cell is made from these counts alone (at most
``CELLS * SPREAD`` numbers, whatever the input) and applied by numbering rows inside their sub-cell. No task
sees more than one sub-cell at a time.

Defined cases: a null text has no bytes and CRC-32 0; null and repeated ids, and repeated rows, are rows like
any other; ties are ordered by id, size and CRC; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window, functions as F

from tallygrid.llm.common import staged

SHARDS = 24
VNODES = 64
CELLS = 4_096
SPREAD = 16
LAW = "rows"


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    nodes = []
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.sha256(f"shard {shard} node {v}".encode()).digest()
            nodes.append((int.from_bytes(digest[:8], "little") % cells, digest, shard))
    return [(cell, shard) for cell, _, shard in sorted(nodes)]


def clockwise(nodes: list[tuple[int, int]], cell: int) -> list[int]:
    """The shards in the order in which a row in this cell meets them, each once."""
    first = bisect_left(nodes, (cell, -1))
    return list(dict.fromkeys(shard for _, shard in nodes[first:] + nodes[:first]))


def plan(counts: dict[tuple[int, int], int], shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int, int]]:
    """Who takes what: (cell, spread, from, to, shard, slot of the first) for rows ``from <= number < to`` of a sub-cell.

    First every shard takes from its own cells, clockwise, until it is full; then the rest goes on to the next shards with room."""
    total = sum(counts.values())
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    taken = [0] * shards
    nodes = ring(shards, vnodes, cells)
    orders: dict[int, list[int]] = {}
    made, left = [], []

    def take(key: tuple[int, int], start: int, end: int, shard: int) -> int:
        n = min(room[shard] - taken[shard], end - start)
        if n:
            made.append((*key, start, start + n, shard, taken[shard]))
            taken[shard] += n
        return start + n

    for key in sorted(counts):
        order = orders.setdefault(key[0], clockwise(nodes, key[0]))
        start = take(key, 0, counts[key], order[0])
        if start < counts[key]:
            left.append((key, start))
    for key, start in left:
        for shard in orders[key[0]][1:]:
            start = take(key, start, counts[key], shard)
            if start == counts[key]:
                break
    return made


def assign(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, cells: int = CELLS, spread: int = SPREAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` (null: for this law
    one more shard moves rows between the others too) of every row."""
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(cells)).cast("int").alias("cell"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(spread)).cast("int").alias("spread"),
    )
    rows = staged(rows, "ring-rows")
    counts = {(r["cell"], r["spread"]): r["count"] for r in rows.groupBy("cell", "spread").count().collect()}
    parts = "cell int, spread int, start long, end long, shard int, slot_start long"
    takes = F.broadcast(spark.createDataFrame(plan(counts, shards, vnodes, cells), parts))
    order = Window.partitionBy("cell", "spread").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("number", F.row_number().over(order) - 1)
    chosen = numbered.join(takes, ["cell", "spread"]).where((F.col("number") >= F.col("start")) & (F.col("number") < F.col("end")))
    return chosen.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("slot_start") + F.col("number") - F.col("start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
