"""Cross-document line frequency and the base counts of a text, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import SPACE_CLASS, words_of
from wattloom.session import materialize

SYMBOLS = r"[#*$%&|<>]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SALTS = 16


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, runs of white space as one blank, none at the ends."""
    plain = F.regexp_replace(F.lower(line), r"[0-9]", "0")
    return F.trim(F.regexp_replace(plain, SPACE_CLASS + "+", " "))


def repeated_words(words: str, width: int = 8) -> Column:
    """Words inside ``width``-word windows that occur twice or more in the text, first ones included.

    Windows are compared by a 64-bit hash. Sorting (hash, position) puts equal windows side by side,
    so the work is n log n however repetitive a text is; a text without any repeat skips the sort.
    """
    at = ", ".join(f"{words}[i + {k}]" for k in range(width))
    hashes = f"transform(sequence(0, size({words}) - {width}), i -> xxhash64({at}))"
    several = f"size({words}) > {width}"
    return F.expr(f"case when {several} then {hashes} end")


def _covered(width: int) -> str:
    """Words covered by the sorted window starts in ``__starts``."""
    gap = f"least({width}, coalesce(get(__starts, i + 1) - s, {width}))"
    return f"aggregate(transform(__starts, (s, i) -> {gap}), 0L, (a, g) -> a + g)"


def text_counts(docs: DataFrame, text: str = "text", width: int = 8) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words; ``__text`` is the text, null as empty."""
    one = docs.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    two = one.withColumn("__words", words_of(F.col("__text")))
    three = two.withColumn("__wins", repeated_words("__words", width)).withColumn(
        "__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(NOT_SPACE))
    )
    repeats = F.size("__wins") > F.size(F.array_distinct("__wins"))
    four = three.withColumn(
        "__sorted", F.when(repeats, F.expr("array_sort(transform(__wins, (h, i) -> struct(h as h, i as i)))"))
    )
    equal = "x.h = get(__sorted, k - 1).h or x.h = get(__sorted, k + 1).h"
    starts = f"array_sort(transform(filter(__sorted, (x, k) -> {equal}), x -> x.i))"
    five = four.withColumn("__starts", F.expr(f"case when __sorted is not null then {starts} end"))
    return five.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(F.expr(f"case when __starts is not null then {_covered(width)} end"), F.lit(0)).cast("long"),
    }).drop("__words", "__wins", "__sorted", "__starts")


def assess(
    docs: DataFrame,
    doc_id: str = "doc_id",
    host: str = "source",
    text: str = "text",
    max_docs: int = 10,
    least_left: float = 0.3,
    min_words: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Base counts, removed share and verdict of each document; one row per input row.

    A line is found by the hash of its normalised form. Lines in more than ``max_docs`` documents of
    one host are removed; a document that keeps less than ``least_left`` of its line characters is
    rejected, besides those that fail the base rule. Null texts are empty and fail the base rule;
    documents without a host form one host; repeated rows count as documents of their own.
    """
    counted = text_counts(docs.select(F.col(doc_id), F.col(host).alias("__host"), F.col(text).alias("__raw")), "__raw")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    pairs = F.transform("__lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.length(x).alias("n")))
    base = materialize(
        counted.select(
            doc_id, F.coalesce("__host", F.lit("")).alias("__host"), F.monotonically_increasing_id().alias("__row"),
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"), pairs.alias("__pairs"),
        ),
        "line-frequency",
    )
    once = base.select("__host", F.explode(F.array_distinct(F.expr("transform(__pairs, p -> p.h)"))).alias("h"))
    # a line that a third of all documents hold is one key: its removals are spread over salts
    frequent = once.groupBy("__host", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_docs)
    frequent = frequent.select("__host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    lines = base.select("__host", "__row", F.pmod("__row", F.lit(SALTS)).cast("int").alias("salt"), F.explode("__pairs").alias("p"))
    lines = lines.select("__host", "__row", "salt", F.col("p.h").alias("h"), F.col("p.n").alias("n"))
    gone = lines.join(frequent, ["__host", "h", "salt"]).groupBy("__row").agg(
        F.sum("n").alias("gone"), F.count(F.lit(1)).alias("gone_lines")
    )
    all_chars = F.expr("aggregate(__pairs, 0L, (a, p) -> a + p.n)")
    left = all_chars - F.coalesce("gone", F.lit(0))
    depleted = left < least_left * all_chars
    return base.join(gone, "__row", "left").select(
        doc_id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"),
        F.coalesce("gone_lines", F.lit(0)).cast("long").alias("n_removed_lines"),
        left.cast("long").alias("chars_left"),
    )
