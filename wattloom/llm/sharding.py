"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every key has a place on a ring, every shard owns many places (virtual nodes), and a key goes to the
first virtual node clockwise. A shard takes no more than its quota; what is over goes on clockwise to
the next shard with room. Only counts per arc (shards x virtual nodes, fixed) reach the driver, which
settles the overflow there; the rows themselves are ranked inside small cells of the ring.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.llm.common import inline_rows
from wattloom.session import materialize

RING_BITS = 48
MIN_CELL_BITS = 14


def virtual_nodes(n_shards: int, per_shard: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node in ring order. A shard's places don't depend on the other shards."""
    places: dict[int, int] = {}
    for shard in range(n_shards):
        for replica in range(per_shard):
            digest = hashlib.blake2b(f"{shard}/{replica}".encode(), digest_size=RING_BITS // 8).digest()
            places.setdefault(int.from_bytes(digest, "big"), shard)
    return sorted(places.items())


def quotas(total: int, n_shards: int, load_factor: float) -> list[int]:
    """Room of each shard. At load factor 1 the quotas add up to the total and differ by one at most."""
    if load_factor <= 1:
        return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    return [math.ceil(load_factor * total / n_shards)] * n_shards


def settle(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): which ranks of each arc land where.

    Each arc first fills its own shard; then the rest of each arc, in ring order, walks on clockwise
    to shards with room.
    """
    free, out, rest = list(room), [], []
    for arc, n in enumerate(counts):
        own = min(n, free[owners[arc]])
        free[owners[arc]] -= own
        if own:
            out.append((arc, 0, own, owners[arc]))
        if n > own:
            rest.append((arc, own, n))
    for arc, at, n in rest:
        step = arc
        while at < n:
            step = (step + 1) % len(counts)
            take = min(n - at, free[owners[step]])
            if take:
                free[owners[step]] -= take
                out.append((arc, at, at + take, owners[step]))
                at += take
    return out


def shard(
    docs: DataFrame,
    n_shards: int = 8,
    virtual: int = 128,
    load_factor: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
    rows_per_cell: int = 100_000,
) -> DataFrame:
    """(key, size, text_crc32, shard, slot): every row in exactly one shard, slots gapless from 0.

    A row's place on the ring is the hash of its key, or of its text if the key is null. Rows with
    equal keys share a place and are told apart by their text's checksum; equal rows are
    interchangeable. Null and empty texts have size 1 and checksum 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    place = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.crc32(body).cast("string"))))
    base = materialize(
        docs.select(
            F.col(key),
            (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
            F.crc32(body).cast("long").alias("text_crc32"),
            F.pmod(place, F.lit(1 << RING_BITS)).alias("__place"),
        ),
        "shard-base",
    )
    total = base.count()
    bits = max(MIN_CELL_BITS, math.ceil(math.log2(max(total / rows_per_cell, 1))))
    cells = 1 << bits
    cell = F.shiftright(F.col("__place"), RING_BITS - bits)

    nodes: dict[int, int] = {}
    for at, owner in virtual_nodes(n_shards, virtual):
        nodes.setdefault(at >> (RING_BITS - bits), owner)
    ends = sorted(nodes)
    owners = [nodes[e] for e in ends]
    # the cells after the last virtual node belong, first in order, to the arc of the first one
    arcs = [{"arc": 0, "turn": 0, "lo": ends[-1] + 1, "hi": cells - 1}] if ends[-1] + 1 < cells else []
    arcs += [{"arc": i, "turn": 1, "lo": (ends[i - 1] + 1) if i else 0, "hi": e} for i, e in enumerate(ends)]
    layout = inline_rows(spark, arcs, "arc int, turn int, lo long, hi long").select(
        "arc", "turn", F.explode(F.sequence("lo", "hi")).alias("__cell")
    )
    per_cell = materialize(
        base.groupBy(cell.alias("__cell")).agg(F.count(F.lit(1)).alias("n")).join(layout, "__cell"), "shard-cells"
    )
    counts = [0] * len(ends)
    for row in per_cell.groupBy("arc").agg(F.sum("n").alias("n")).collect():  # one row per virtual node at most
        counts[row["arc"]] = row["n"]
    plan = settle(counts, owners, quotas(total, n_shards, load_factor))
    pieces = inline_rows(
        spark, [dict(zip(("arc", "a", "b", "shard"), p, strict=True)) for p in plan], "arc int, a long, b long, shard int"
    )

    before = W.partitionBy("arc").orderBy("turn", "__cell").rowsBetween(W.unboundedPreceding, -1)
    placed = per_cell.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    lo, hi = F.greatest("a", "off") - F.col("off"), F.least(F.col("b"), F.col("off") + F.col("n")) - F.col("off")
    parts = placed.join(pieces, "arc").where((F.col("a") < F.col("off") + F.col("n")) & (F.col("b") > F.col("off")))
    parts = parts.select("__cell", "shard", lo.alias("lo"), hi.alias("hi"))
    earlier = W.partitionBy("shard").orderBy("__cell", "lo").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("slot", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(earlier), F.lit(0)))
    by_cell = parts.groupBy("__cell").agg(F.collect_list(F.struct("lo", "hi", "shard", "slot")).alias("__parts"))

    rank = F.row_number().over(W.partitionBy("__cell").orderBy("__place", key, "text_crc32", "size")) - 1
    ranked = base.withColumn("__cell", cell).withColumn("__rank", rank.cast("long"))
    joined = ranked.join(by_cell, "__cell").withColumn(
        "__part", F.expr("filter(__parts, p -> p.lo <= __rank and __rank < p.hi)[0]")
    )
    return joined.select(
        F.col(key),
        "size",
        "text_crc32",
        F.col("__part.shard").cast("int").alias("shard"),
        (F.col("__part.slot") + F.col("__rank") - F.col("__part.lo")).cast("long").alias("slot"),
    )
