"""Line deduplication across documents, in DataFrame operations only.

Line hashes are range-partitioned with a secondary sort by document and position, so a partition
streams the occurrences of a line one document after another. What comes back is not text but, for
each document, a compressed bitmap of the lines to keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattloom.llm.common import SPACE_CHARS, ascii_lower
from wattloom.session import materialize

SLICES = 16
WORD_BITS = 62


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _identity(doc_id: str, text: str) -> Column:
    """The rows of one text and id lose the same lines. Never null. For the counts an id is one document, whatever its texts."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))


def occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(__d, pos, h, g, slice) of every line with a key of ``min_chars`` code points or more.

    ``h`` and ``g`` are two independent 64-bit hashes of the key. ``slice`` spreads one line's
    documents, so that a line which a third of all documents hold isn't one group; all texts of one id share one.
    """
    lines = docs.select(
        _identity(doc_id, text).alias("__d"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line")
    )
    keyed = lines.select("__d", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(
        "__d", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"),
        F.pmod(F.xxhash64("__d.id"), F.lit(SLICES)).cast("int").alias("slice"),
    )


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(__d, bitmap): documents that lose lines, with their keep bitmap.

    ``bitmap`` lists (word, bits): bit b of word w is 1 if line 62 w + b stays. Words in which every
    line stays are left out, and so are documents that keep all their lines. Keys found in
    ``min_docs`` documents or more stay only in the largest id holding them, there on every line.
    Null ids count as one document and as the smallest.
    """
    occ = materialize(occurrences(docs, doc_id, text, min_chars), "line-occurrences")
    ranged = occ.repartitionByRange("h", "g", "slice")
    stream = W.partitionBy("h", "g", "slice").orderBy(F.col("__d.id").desc_nulls_last(), F.col("__d.t"), "pos")
    place = F.row_number().over(stream)
    first = (place == 1) | ~F.lag("__d.id").over(stream).eqNullSafe(F.col("__d.id"))  # a document's first occurrence
    heads = ranged.withColumn("first", first).where("first").groupBy("h", "g", "slice").agg(
        F.count(F.lit(1)).alias("docs"), F.max("__d.id").alias("top")
    )
    keys = heads.groupBy("h", "g").agg(F.sum("docs").alias("docs"), F.max("top").alias("top")).where(F.col("docs") >= min_docs)
    keys = keys.select("h", "g", "top", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    lost = occ.join(keys, ["h", "g", "slice"]).where(~F.col("top").eqNullSafe(F.col("__d.id")))
    words = lost.groupBy("__d", F.expr(f"pos div {WORD_BITS}").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pos % {WORD_BITS} as int))")).alias("dropped")
    )
    full = (1 << WORD_BITS) - 1
    return words.groupBy("__d").agg(
        F.collect_list(F.struct(F.col("word"), F.col("dropped").bitwiseXOR(F.lit(full)).alias("bits"))).alias("bitmap")
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``__kept`` (the text of the kept lines), ``__n_lines`` and ``__n_dropped``."""
    own = bitmaps.select("__d", F.col("bitmap").alias("__bitmap"))
    joined = docs.withColumn("__d", _identity(doc_id, text)).join(own, "__d", "left")
    joined = joined.withColumn("__lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    full = (1 << WORD_BITS) - 1
    # bits and lines are zipped, not looked up by position: an array read inside a lambda may be built anew each time
    word = f"coalesce(get(filter(__bitmap, b -> b.word = w), 0).bits, {full}L)"
    dense = f"transform(sequence(0, (size(__lines) - 1) div {WORD_BITS}), w -> {word})"
    bits = f"flatten(transform({dense}, d -> transform(sequence(0, {WORD_BITS - 1}), b -> shiftright(d, b) & 1)))"
    zipped = f"arrays_zip(__lines, slice({bits}, 1, size(__lines)))"
    left = f"transform(filter({zipped}, z -> z['1'] = 1), z -> z['__lines'])"
    joined = joined.withColumn("__left", F.expr(f"case when __bitmap is null then __lines else {left} end"))
    return joined.withColumns({
        "__n_lines": F.size("__lines").cast("long"),
        "__n_dropped": (F.size("__lines") - F.size("__left")).cast("long"),
        "__kept": F.when(F.col("__bitmap").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join("__left", "\n")),
    }).drop("__d", "__bitmap", "__lines", "__left")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Every row of ``docs`` with ``__kept``, ``__n_lines`` and ``__n_dropped``. Null or empty text: one empty line."""
    return apply_bitmaps(docs, keep_bitmaps(docs, doc_id, text, min_chars, min_docs), doc_id, text)
