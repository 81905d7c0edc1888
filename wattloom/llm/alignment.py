"""Alignment of two tokenizers' tokens by merge-path partitioning.

The byte offsets at which tokens of A and of B end are two sorted lists. Diagonals of their merge are found
by binary search, all at once; between two diagonals lies a piece of equal work that is merged on its own
and emits the overlaps of its tokens. Where a piece begins with an end that the piece before it has met, the two are
stitched. How often two ids overlap in the whole corpus is counted in Spark: a block of texts asks for
each of its distinct pairs once and gets the counts back, so nothing is broadcast that grows with the data.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wattloom.llm.bpe_automaton import byte_characters
from wattloom.session import materialize

# Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORK = 1 << 16
BLOCK_BYTES = 2 << 20
SEGMENT = 1 << 16
CHUNK = 1 << 18
SLICE = 1 << 16
ROWS = 256
CODEC = "zstd"


def diagonals(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two sorted arrays (equal values: ``a`` first) crosses every ``work``-th diagonal: (i, j) with i + j a multiple of it."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work, dtype=np.int64), total)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at, other = np.where(open_, mid, 0), np.where(open_, d - mid - 1, 0)
        first = open_ & (a[at] <= b[other])
        low, high = np.where(first, mid + 1, low), np.where(open_ & ~first, mid, high)
    return low, d - low


def piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (i, j) that end inside a piece of the merge, and the common ends in it as indices of B tokens.

    An end of A lies in the first B token that ends there or later, and the other way round. Only ends
    inside the piece are looked at; an end of B that equals the last end of A before the piece is left to ``align``.
    """
    own_a, own_b = a[i0:i1], b[j0:j1]
    under_a = j0 + np.searchsorted(own_b, own_a, "left")
    at = np.searchsorted(own_a, own_b, "left")
    common = np.zeros(j1 - j0, bool)
    inside = at < i1 - i0
    common[inside] = own_a[at[inside]] == own_b[inside]
    lone = np.flatnonzero(~common)
    return np.concatenate([np.arange(i0, i1), i0 + at[lone]]), np.concatenate([under_a, j0 + lone]), j0 + np.flatnonzero(common)


def align(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping token pairs (i, j), and for each group the number of A and of B tokens up to its end.

    ``a`` and ``b`` are the ascending ends of tokens over the same bytes, no token is empty.
    """
    i_cut, j_cut = diagonals(a, b, work)
    left, right, ends = [], [], []
    for i0, i1, j0, j1 in zip(i_cut[:-1], i_cut[1:], j_cut[:-1], j_cut[1:]):
        i, j, common = piece(a, b, i0, i1, j0, j1)
        if j0 < j1 and i0 > 0 and a[i0 - 1] == b[j0]:  # stitch: the piece before has emitted this overlap already
            i, j, common = np.delete(i, i1 - i0), np.delete(j, i1 - i0), np.append(j0, common)
        left.append(i)
        right.append(j)
        ends.append(common)
    if not left:
        return (np.zeros(0, np.int64),) * 4
    cut_b = np.concatenate(ends) + 1
    cut_a = np.searchsorted(a, b[cut_b - 1], "left") + 1
    return np.concatenate(left), np.concatenate(right), cut_a, cut_b


class Tokenizers:
    """The two vocabularies with the bytes of their tokens, from the contents of their files."""

    def __init__(self, json_text: str, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        spec = json.loads(json_text)
        vocabulary, as_byte = dict(spec["model"]["vocab"]), byte_characters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = [vocabulary[x + y] for x, y in merges]
        if made != sorted(set(made)) or spec.get("normalizer") or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError("not supported: only byte-level vocabularies whose ids follow their merges")
        ranks = {bytes(as_byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.a = Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})  # so special strings are plain text
        self.b = SentencePieceProcessor(model_proto=model)
        self.size_a = max(ranks.values()) + 1
        self.bytes_a = [b""] * self.size_a
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.size_b = self.b.get_piece_size()
        self.bytes_b = [self._piece_bytes(i) for i in range(self.size_b)]
        self.len_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.len_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.text_a = [f"{i}{s}".encode() for s in ",|" for i in range(self.size_a)]
        self.text_b = [f"{i}{s}".encode() for s in ",;" for i in range(self.size_b)]
        # a text may be cut before a blank between letters if no piece of B goes on over a blank
        self.cuts = not any(re.search("[A-Za-z]▁", self.b.id_to_piece(i)) for i in range(self.size_b))

    def _piece_bytes(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def segments(self, text: str, size: int) -> list[str]:
        """Long texts cut at blanks between ASCII letters, without the blank: both vocabularies begin a word there."""
        out, at = [], 0
        while self.cuts and len(text) - at > size:
            found = _BORDER.search(text, at + size)
            if not found:
                break
            out.append(text[at : found.start() + 1])
            at = found.end() - 1
        return [*out, text[at:]]

    def encode(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """Ids by A of blank and segment, ids by B of the segment, and whether both spell blank and segment."""
        out = []
        for segment, y in zip(segments, self.b.encode(segments, num_threads=1)):
            text = " " + segment
            x, data = self.a.encode_ordinary(text), text.encode()
            x, same = np.array(x, np.int32), b"".join(map(self.bytes_b.__getitem__, y)) == data
            out.append((x, np.array(y, np.int32), same and self.len_a[x].sum() == len(data)))
        return out


_BORDER = re.compile("[A-Za-z] [A-Za-z]")


class _Block:
    """Texts that share one request for pair counts; about ``tokens`` tokens of A are aligned together."""

    def __init__(self, kit: Tokenizers, work: int, tokens: int = SLICE):
        self.kit, self.work, self.tokens = kit, work, tokens
        self.docs, self.ids, self.bytes = [], [], 0

    def add(self, doc, ids_a: list[np.ndarray], ids_b: list[np.ndarray], size: int) -> None:
        self.docs.append(doc)
        self.ids.append((np.concatenate(ids_a), np.concatenate(ids_b)) if ids_a else (_NONE, _NONE))
        self.bytes += size + 100

    def row(self) -> dict:
        kit, n_docs = self.kit, len(self.docs)
        n_a, n_b = (np.array([len(x[k]) for x in self.ids], np.int64) for k in (0, 1))
        n_links, n_groups = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
        digests, seen, kinds, times = [], [], [], []
        begins = np.searchsorted(np.cumsum(n_a), np.arange(0, n_a.sum(), self.tokens), "right")
        cuts = np.unique(np.concatenate([[0], begins, [n_docs]])).tolist()
        for first, last in zip(cuts[:-1], cuts[1:]):  # tokens of A and B both end where a text ends, so texts align apart
            own, of = slice(first, last), np.repeat(np.arange(last - first), n_a[first:last])
            ids_a, ids_b = (np.concatenate([x[k] for x in self.ids[own]]) for k in (0, 1))
            i, j, cut_a, cut_b = align(np.cumsum(kit.len_a[ids_a]), np.cumsum(kit.len_b[ids_b]), self.work)
            order = np.argsort(of[i], kind="stable")  # a piece emits its overlaps by A, then by B
            i, j = i[order], j[order]
            n_links[own], n_groups[own] = (np.bincount(of[x], minlength=last - first) for x in (i, cut_a - 1))
            digests += self._digests(ids_a, ids_b, (n_a + n_b)[own], cut_a, cut_b)
            found, index, n = np.unique(ids_a[i].astype(np.int64) * kit.size_b + ids_b[j], return_inverse=True, return_counts=True)
            seen.append(found)
            kinds.append(index.astype(np.uint32))
            times.append(n)
        codes, at = np.unique(np.concatenate([_NONE.astype(np.int64), *seen]), return_inverse=True)
        kind, ends = np.uint16 if len(codes) <= 1 << 16 else np.uint32, np.cumsum([len(x) for x in seen])
        links = b"".join(at[end - len(x) : end].astype(kind)[index].tobytes() for x, index, end in zip(seen, kinds, ends))
        return {
            "docs": self.docs, "n_a": n_a, "n_b": n_b, "n_links": n_links, "n_groups": n_groups, "groups_sha256": digests, "codes": codes,
            "times": np.bincount(at, np.concatenate([_NONE, *times]), len(codes)).astype(np.int64),
            "links": pa.compress(links, codec=CODEC, asbytes=True),
        }

    def _digests(self, ids_a, ids_b, lengths, cut_a, cut_b) -> list[str]:
        kit = self.kit
        size_a, size_b = (np.diff(c, prepend=0) for c in (cut_a, cut_b))
        group_a, group_b = (np.repeat(np.arange(len(cut_a)), s) for s in (size_a, size_b))
        at_a = np.arange(len(ids_a)) + (cut_b - size_b)[group_a]
        at_b = np.arange(len(ids_b)) + cut_a[group_b]
        last_a, last_b = np.arange(1, len(ids_a) + 1) == cut_a[group_a], np.arange(1, len(ids_b) + 1) == cut_b[group_b]
        line = np.empty(len(ids_a) + len(ids_b), np.int64)
        line[at_a] = ids_a + kit.size_a * last_a
        line[at_b] = 2 * kit.size_a + ids_b + kit.size_b * last_b
        texts, out, at = kit.text_a + kit.text_b, [], 0
        for n in lengths.tolist():
            out.append(hashlib.sha256(b"".join(map(texts.__getitem__, line[at : at + n].tolist()))[:-1]).hexdigest() if n else "")
            at += n
        return out


_NONE = np.zeros(0, np.int32)


def _kit(shared) -> Tokenizers:
    held = shared.value  # a worker keeps the shared value from task to task, and with it the loaded vocabularies
    return held.get("kit") or held.setdefault("kit", Tokenizers(held["json"], held["model"]))


def aligned_blocks(docs: DataFrame, shared, doc_id: str, text: str, block_bytes: int = BLOCK_BYTES, work: int = WORK, segment: int = SEGMENT) -> DataFrame:
    """One row for each block of texts: per text its counts and the digest of its groups; the block's distinct id
    pairs with their numbers of links; and for every link, text by text, which of those pairs it is."""
    body = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(body.schema["doc"].dataType)),
        *(T.StructField(c, longs) for c in ("n_a", "n_b", "n_groups", "n_links", "codes", "times")),
        T.StructField("groups_sha256", T.ArrayType(T.StringType())), T.StructField("links", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit, number = _kit(shared), TaskContext.get().partitionId() << 32
        block = _Block(kit, work)

        def closed():
            row = {"block": number, **block.row()}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], type=f.type) for f in arrow], schema=arrow)

        def chunks(batch):
            held, size = [], 0
            for first in range(0, batch.num_rows, ROWS):
                few = batch.slice(first, ROWS)
                for doc, value in zip(few.column(0).to_pylist(), few.column(1).to_pylist()):
                    held.append((doc, kit.segments(value, segment) if value else []))
                    size += len(value or "")
                    if size >= CHUNK:
                        yield held
                        held, size = [], 0
            yield held

        for batch in batches:
            for held in chunks(batch):
                flat = [s for _, parts in held for s in parts]
                coded = []
                for k in range(0, len(flat), 256):
                    coded.extend(kit.encode(flat[k : k + 256]))
                at = 0
                for doc, parts in held:
                    own = coded[at : at + len(parts)]
                    at += len(parts)
                    good = all(same for _, _, same in own)
                    block.add(doc, [x for x, _, _ in own if good], [y for _, y, _ in own if good], sum(map(len, parts)))
                    if block.bytes >= block_bytes:
                        yield closed()
                        number += 1
                        block = _Block(kit, work)
        if block.docs:
            yield closed()

    return body.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame, size_b: int) -> DataFrame:
    """(block, pos, total, best) of every pair that a block asks for: its links in the whole corpus, and whether that is
    the most of its B id. A pair stands once in a block, so no key has more rows than there are blocks."""
    asked = blocks.select("block", F.posexplode(F.arrays_zip("codes", "times")).alias("pos", "z"))
    asked = asked.select("block", "pos", F.col("z.codes").alias("code"), F.col("z.times").alias("n"))
    summed = asked.withColumn("total", F.sum("n").over(W.partitionBy("code"))).withColumn("b", F.col("code") % size_b)
    most = summed.groupBy("b").agg(F.max("total").alias("most"))
    joined = summed.join(F.broadcast(most), "b")  # one row for each id of B at most
    return joined.select("block", "pos", "total", (F.col("total") == F.col("most")).alias("best"))


def cross_alignment(
    docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
    block_bytes: int = BLOCK_BYTES, work: int = WORK, segment: int = SEGMENT,
) -> DataFrame:
    """(doc, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    A is a byte-level vocabulary file, read before a blank and the text; B a piece model, which adds the blank itself.
    Null and empty texts, and texts that the tokens of A or B do not spell, have no tokens: zeros and an empty digest.
    Repeated rows and reused ids are rows of their own and all count. Pairs of equal count are all best.
    Other columns are not read, whatever their names. An empty table gives no rows.

    Memory is that of one block of texts; a single text longer than a block is a block by itself.
    """
    spark = docs.sparkSession
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        held = {"json": f.read(), "model": g.read()}
    size_b = Tokenizers(held["json"], held["model"]).size_b
    shared = spark.sparkContext.broadcast(held)
    blocks = materialize(aligned_blocks(docs, shared, doc_id, text, block_bytes, work, segment), "aligned-blocks")
    answers = pair_counts(blocks, size_b).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pos", "total", "best"))).alias("answers"))
    both = blocks.join(answers, "block", "left").select(
        "docs", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links",
        F.col("answers.total").alias("total"), F.col("answers.best").alias("best"), F.size("codes").alias("n_codes"),
    )
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    schema = T.StructType([
        T.StructField("doc", docs.schema[doc_id].dataType), *(T.StructField(c, T.LongType()) for c in counts), T.StructField("groups_sha256", T.StringType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k] for c, name in enumerate(batch.schema.names)}
                n_links = row["n_links"].values.to_numpy()
                kind = np.uint16 if row["n_codes"].as_py() <= 1 << 16 else np.uint32
                size = int(n_links.sum()) * np.dtype(kind).itemsize
                index = np.frombuffer(pa.decompress(row["links"].as_py(), decompressed_size=size, codec=CODEC, asbytes=True), kind)
                of = np.repeat(np.arange(len(n_links)), n_links)
                if len(index):
                    total, best = row["total"].values.to_numpy(), row["best"].values.to_numpy(zero_copy_only=False)
                    sums = np.add.reduceat(np.append(total[index], 0), np.minimum(np.cumsum(n_links) - n_links, len(index)))
                    sums[n_links == 0] = 0
                    n_best = np.bincount(of[best[index]], minlength=len(n_links))
                else:
                    sums = n_best = np.zeros(len(n_links), np.int64)
                columns = [row["docs"].values, *(row[c].values for c in counts[:4]), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), row["groups_sha256"].values]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return both.mapInArrow(run, schema)
