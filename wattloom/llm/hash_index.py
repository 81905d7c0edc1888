"""Exact duplicates through an extendible-hash index that lies in shared files.

Every task first collapses the equal texts that it meets itself, so a text with many copies reaches its
owner at most once for each flush of a task. The directory grows by doubling: a bucket with too many
hashes is split by one bit more. A bucket is a range of hashes with one owner task, which chains the texts
of equal hash and compares their bytes. What the index says of an entry goes back to the rows by entry id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wattloom.session import materialize

BUCKET = 2048
ROUND_BITS = 12
FLUSH_BYTES = 32 << 20
FLUSH_ENTRIES = 200_000
SPACE = b" \t\n\x0b\f\r"


def sha_key(body: bytes) -> int:
    """The first 64 bits of the text's SHA-256, as a signed number."""
    return int.from_bytes(hashlib.sha256(body).digest()[:8], "big", signed=True)


def _rank(chars: int, doc, row: int) -> tuple:
    """Smallest first: most code points, then the smallest id (null last), then the first row."""
    return (-chars, doc is None, doc if doc is not None else 0, row)


class _Out:
    """Rows on their way into Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 64) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return self.bytes >= 4 << 20

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array(c, type=f.type) for c, f in zip(zip(*self.rows), self.schema)] if self.rows else [pa.array([], type=f.type) for f in self.schema]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


def local_entries(docs: DataFrame, doc_id: str, text: str, key_of: Callable[[bytes], int] = sha_key) -> DataFrame:
    """Two kinds of rows. One for each document: (doc, row, entry). One for each distinct text that a task
    met between two flushes: (entry, h, body, size) and its best row (doc, row, chars)."""
    body = docs.select(
        F.col(doc_id).alias("doc"), F.coalesce(F.length(text), F.lit(0)).alias("chars"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"),
    )
    schema = T.StructType([
        T.StructField("doc", body.schema["doc"].dataType), T.StructField("row", T.LongType()), T.StructField("entry", T.LongType()),
        T.StructField("chars", T.LongType()), T.StructField("size", T.LongType()), T.StructField("h", T.LongType()), T.StructField("body", T.BinaryType()),
    ])
    arrow, flush_bytes, flush_entries = to_arrow_schema(schema), FLUSH_BYTES, FLUSH_ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        row, made, held, out, met = first, first, 0, _Out(arrow), {}

        def flush():
            for bytes_, (entry, size, (_, _, _, best), chars, doc) in met.items():
                out.add((doc, best, entry, chars, size, key_of(bytes_), bytes_), 64 + len(bytes_))
                if out.full():
                    yield out.batch()
            met.clear()

        for batch in batches:
            for doc, chars, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = data.translate(None, SPACE)
                entry = met.get(data)  # a dict chains equal hashes and compares bytes itself
                rank = _rank(chars, doc, row)
                if entry is None:
                    entry = met[data] = [made, 1, rank, chars, doc]
                    made += 1
                    held += len(data) + 200
                else:
                    entry[1] += 1
                    if rank < entry[2]:
                        entry[2:] = rank, chars, doc
                out.add((doc, row, entry[0], None, None, None, None))
                row += 1
                if held >= flush_bytes or len(met) >= flush_entries:
                    yield from flush()
                    held = 0
                if out.full():
                    yield out.batch()
        yield from flush()
        yield out.batch()

    return body.mapInArrow(run, schema)


def prefix(h: str | Column, bits: int) -> Column:
    """The first ``bits`` bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def directory(hashes: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) of every used slot, and the number of bits of a slot.

    ``hashes`` has distinct values in ``h``. A bucket with more than ``bucket`` hashes is split by its next bit,
    and the directory doubles with the deepest bucket. The counts of ``ROUND_BITS`` doublings come from one
    aggregation; only hashes of buckets that are still overfull take part in the next one. A bucket that needs
    fewer bits than the directory has stands in several slots. All counting is done in tables.
    """
    left, low, leaves = hashes, 0, []
    while True:
        high = min(64, low + ROUND_BITS)
        cells = left.groupBy(prefix("h", high).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        nodes = cells.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "cell", "n")
        nodes = nodes.groupBy("depth", F.expr(f"shiftrightunsigned(cell, {high} - depth)").alias("at")).agg(F.sum("n").alias("n"))
        nodes = materialize(nodes, "index-counts")
        over = nodes.where(F.col("n") > bucket)
        parents = over.select((F.col("depth") + 1).alias("depth"), F.col("at").alias("up"))
        fits = nodes.where((F.col("n") <= bucket) & ((F.col("depth") > low) | F.lit(low == 0)))
        split = fits.withColumn("up", F.expr("shiftrightunsigned(at, 1)")).join(parents, ["depth", "up"], "left_semi")
        leaves.append(split.select("depth", "at").unionByName(fits.where("depth = 0").select("depth", "at")))
        still = over.where(F.col("depth") == high).select(F.col("at").alias("cell"))
        if high == 64 or still.isEmpty():
            break
        left = left.withColumn("cell", prefix("h", high)).join(still, "cell", "left_semi").select("h")
        low = high
    buckets = leaves[0]
    for more in leaves[1:]:
        buckets = buckets.unionByName(more)
    buckets = materialize(buckets, "index-buckets")
    bits = buckets.agg(F.max("depth")).first()[0] or 0
    copies = F.expr(f"sequence(0L, shiftleft(1L, {bits} - depth) - 1)")
    start = F.expr(f"shiftleft(at, {bits} - depth)")
    slots = buckets.select("depth", start.alias("bucket"), F.explode(copies).alias("k"))
    return slots.select((F.col("bucket") + F.col("k")).alias("slot"), "bucket", "depth"), bits


def owned(entries: DataFrame, slots: DataFrame, bits: int) -> DataFrame:
    """(bucket, h, place, entry, keep_id, keep_row, group_size, sha256) of every entry: the index pages.

    ``place`` is the text's place in the chain of its hash. The owner of a bucket reads its entries in the order of
    their hashes and holds one chain at a time: a text once, and 8 bytes for each entry of it.
    """
    at_home = entries.withColumn("slot", prefix("h", bits)).join(slots.select("slot", "bucket"), "slot").drop("slot")
    at_home = at_home.repartition("bucket").sortWithinPartitions("bucket", "h", "entry")
    names = ["bucket", "h", "entry", "doc", "row", "chars", "size", "body"]
    schema = T.StructType([
        T.StructField("bucket", T.LongType()), T.StructField("h", T.LongType()), T.StructField("place", T.IntegerType()),
        T.StructField("entry", T.LongType()), T.StructField("keep_id", entries.schema["doc"].dataType), T.StructField("keep_row", T.LongType()),
        T.StructField("group_size", T.LongType()), T.StructField("sha256", T.StringType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, out = None, [], _Out(arrow)

        def close():
            for place, (data, rank, doc, size, members) in enumerate(chain):
                sha = hashlib.sha256(data).hexdigest()
                for entry in members:
                    out.add((*now, place, entry, doc, rank[3], size, sha), 160)
                    if out.full():
                        yield out.batch()
            chain.clear()

        for batch in batches:
            for bucket, h, entry, doc, row, chars, size, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, h) != now:
                    yield from close()
                    now = (bucket, h)
                rank = _rank(chars, doc, row)
                for link in chain:
                    if link[0] == data:
                        link[3] += size
                        link[4].append(entry)
                        if rank < link[1]:
                            link[1], link[2] = rank, doc
                        break
                else:
                    chain.append([data, rank, doc, size, [entry]])
        yield from close()
        yield out.batch()

    return at_home.select(*names).mapInArrow(run, schema)


def exact_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket: int = BUCKET, key_of: Callable[[bytes], int] = sha_key
) -> DataFrame:
    """(doc, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    Texts are equal when their bytes are after all white space (blank, tab to carriage return) is deleted; a null
    text is empty, so null, empty and blank texts are one group. Of each group the row with the most code
    points in its own text stays, then the smallest id (null after all others), then the first row read: of
    rows that repeat an id and a text one is kept. ``keep_id`` is the id of the row that stays. Other
    columns are not read, whatever their names. An empty table gives no rows.

    ``key_of`` gives the 64-bit hash; hashes that collide cost time but change nothing.
    """
    met = materialize(local_entries(docs, doc_id, text, key_of), "index-entries")
    entries = met.where("h is not null")
    slots, bits = directory(entries.select("h").distinct(), bucket)
    pages = materialize(owned(entries, slots, bits), "index-pages")
    members = met.where("h is null").select("doc", "row", "entry")
    return members.join(pages, "entry").select(
        "doc", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha256").alias("text_sha256")
    )
