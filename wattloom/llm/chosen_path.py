"""N-gram Jaccard join by chosen paths.

Texts become sets of word shingles; equal sets are one. Each run splits the sets recursively: a node
samples some coordinates of the sets' minhash vectors (the same for all its sets), and a set goes on to
the child of each sampled coordinate's value, so sets meet where they share a sampled token. Nodes that
are small enough are compared by brute force. Runs are repeated as often as the target recall needs.

Nodes that stay large, such as a large group of near copies, are compared in blocks: every pair of blocks is
a task of its own that returns link counts and a spanning forest, never the pairs. Of all nodes
that two sets share only the smallest one counts their link, so counts need no list of pairs either.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import map_texts
from wattloom.llm.components import connected
from wattloom.session import materialize

SHINGLE = 5
COORDINATES = 64
BLOCK = 1024
RUN_SHIFT = 56
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words:
    """Word hashes with a bounded memory."""

    def __init__(self, most: int = 500_000):
        self.known: dict[str, int] = {}
        self.most = most

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: _Words, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles. A text of fewer words is one shingle, one without words none."""
    h = words.hashes((text or "").lower().split())
    if not len(h):
        return h
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = _mixed(out * MIX + h[k : k + n] + np.uint64(k + 1))
    return np.unique(out)


def _coefficients(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    a = rng.integers(1, 2**63, coordinates, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 2**63, coordinates, dtype=np.uint64)


def set_id(s: np.ndarray) -> int:
    """Hash of a whole set from its size and two sums over it."""
    key = np.array([len(s), s.sum(dtype=np.uint64), _mixed(s).sum(dtype=np.uint64)], np.uint64)
    return xxhash.xxh64_intdigest(key.tobytes()) - 2**63


def _sketches(width: int, coordinates: int):
    def make():
        words, (a, b) = _Words(), _coefficients(coordinates)

        def work(texts):
            sid, size, low, byte = [], [], [], []
            for text in texts:
                s = shingles(text, words, width)
                sid.append(set_id(s))
                size.append(len(s))
                best = np.full(coordinates, 2**64 - 1, np.uint64)
                for at in range(0, len(s), 4096):
                    best = np.minimum(best, (s[at : at + 4096, None] * a + b).min(axis=0))
                values = (best >> np.uint64(32)).astype(np.uint32)
                low.append(values.view(np.int32))
                byte.append((_mixed(values.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes())
            return {"sid": sid, "size": size, "minhash": low, "bytes": byte}

        return work

    return make


def _full(width: int):
    def make():
        words = _Words()

        def work(texts):
            sets = [shingles(t, words, width) for t in texts]
            return {"sid": [set_id(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

        return work

    return make


def runs_for(target_recall: float, threshold: float, depth: int) -> int:
    """Runs after which a pair at the threshold has been in one leaf with the target probability.

    A node samples 1 / threshold coordinates on average, so a pair that shares each with the
    threshold's probability gets one shared child on average at every level.
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - target_recall) / math.log(1 - meet))


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """One row per member and pair of blocks of its node: ``size`` members go to size / block blocks."""
    n = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("sid", "node"), n).cast("int")
    wide = members.withColumn("n_blocks", n).withColumn("own", own)
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return wide.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("n_blocks", "other")


def _owned(nodes: list[np.ndarray], node: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs that share no smaller node than this one."""
    smaller = [set(x[x < node].tolist()) for x in nodes]
    names = {v: k for k, v in enumerate(sorted(set().union(*smaller)))}
    if not names:
        return np.ones((len(left), len(right)), bool)
    m = np.zeros((len(nodes), len(names)), np.float32)
    for row, s in enumerate(smaller):
        m[row, [names[v] for v in s]] = 1
    return (m[left] @ m[right].T) == 0


def _similar_bytes(rows: pd.DataFrame, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    x = np.frombuffer(b"".join(rows["bytes"]), np.uint8).reshape(len(rows), -1)
    same = np.zeros((len(left), len(right)), np.uint16)
    for c in range(x.shape[1]):
        same += x[left, c][:, None] == x[right, c][None, :]
    return same >= least * x.shape[1]


def _similar_sets(rows: pd.DataFrame, left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    sets = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
    sizes = np.array([len(s) for s in sets])
    where = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((len(left), len(right)), np.float32)
    place = np.cumsum(count > 1) - 1  # tokens of one set only can't be shared
    use = count[code] > 1
    where, code = where[use], place[code[use]]
    order = np.argsort(code, kind="stable")
    where, code = where[order], code[order]
    step = 4096
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, step):  # a bounded slice of the tokens at a time
        a, b = np.searchsorted(code, [at, at + step])
        m = np.zeros((len(sets), step), np.float32)
        m[where[a:b], code[a:b] - at] = 1
        shared += m[left] @ m[right].T
    return shared >= least * (sizes[left][:, None] + sizes[right][None, :] - shared)


def _forest(links: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the linked pairs."""
    root = np.arange(n)

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    edges = []
    for row in range(len(left)):
        a = find(left[row])
        others = right[links[row]]
        for b in np.unique(root[others]):
            r = find(b)
            if r != a:
                edges.append((left[row], others[root[others] == b][0]))
                root[r] = a
    return edges


def _pairs(rows: pd.DataFrame, similar, least: float):
    lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
    own = rows["own"].to_numpy()
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    if not len(left) or not len(right) or len(rows) < 2:
        return None
    links = similar(rows, left, right, least)
    if lo == hi:
        np.fill_diagonal(links, False)
    if links.any():
        nodes = [np.asarray(x, np.int64) for x in rows["nodes"]]
        links &= _owned(nodes, int(rows["node"].iloc[0]), left, right)
    return left, right, links


SMALL_GROUP = 64
PAIRS_AT_ONCE = 200_000


def _small_groups(cols: dict, starts: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Rows with a candidate partner, over all groups of up to ``SMALL_GROUP`` rows together."""
    use = []
    x = cols["bytes"]
    for size in np.unique(sizes):
        one, two = np.triu_indices(size, 1)
        first = starts[sizes == size]
        step = max(1, PAIRS_AT_ONCE // len(one))
        for at in range(0, len(first), step):
            i = (first[at : at + step, None] + one).ravel()
            j = (first[at : at + step, None] + two).ravel()
            across = (cols["lo"][i] == cols["hi"][i]) | (cols["own"][i] != cols["own"][j])
            near = across & ((x[i] == x[j]).sum(axis=1) >= least * x.shape[1])
            for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
                if min(set(cols["nodes"][a]).intersection(cols["nodes"][b])) == cols["node"][a]:
                    use += (a, b)
    return np.unique(np.array(use, np.int64))


def _whole_groups(table: pa.Table, least: float) -> pa.RecordBatch:
    cols = {c: table.column(c).to_numpy() for c in ("node", "lo", "hi", "own", "sid")}
    cols["bytes"] = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(table.num_rows, -1)
    cols["nodes"] = table.column("nodes").to_pylist()
    changes = np.flatnonzero((np.diff(cols["node"]) != 0) | (np.diff(cols["lo"]) != 0) | (np.diff(cols["hi"]) != 0)) + 1
    starts = np.concatenate(([0], changes))
    sizes = np.diff(np.concatenate((starts, [table.num_rows])))
    some = (sizes > 1) & (sizes <= SMALL_GROUP)
    use = [_small_groups(cols, starts[some], sizes[some], least)]
    for start, size in zip(starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
        got = _pairs(table.slice(start, size).to_pandas(), _similar_bytes, least)
        if got is not None and got[2].any():
            left, right, links = got
            use.append(start + np.union1d(left[links.any(axis=1)], right[links.any(axis=0)]))
    rows = np.concatenate(use)
    return pa.RecordBatch.from_arrays([pa.array(cols["node"][rows]), pa.array(cols["sid"][rows])], names=["node", "sid"])


def _candidates(least: float):
    """Streams a partition sorted by group: whole groups are compared, a batch's last group waits for its rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            key = np.stack([table.column(c).to_numpy() for c in ("node", "lo", "hi")])
            last = int(np.argmax((key == key[:, -1:]).all(axis=0)))
            held = table.slice(last)
            if last:
                yield _whole_groups(table.slice(0, last), least)
        if held is not None:
            yield _whole_groups(held, least)

    return run


def _links(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("sid").reset_index(drop=True)
        got = _pairs(rows, _similar_sets, least)
        if got is None or not got[2].any():
            return pd.DataFrame({"a": [], "b": [], "links": []})
        left, right, links = got
        sid, copies = rows["sid"].to_numpy(), rows["copies"].to_numpy(np.int64)
        n = np.zeros(len(rows), np.int64)
        n[left] += links.astype(np.int64) @ copies[right]
        if rows["lo"].iloc[0] != rows["hi"].iloc[0]:
            n[right] += links.T.astype(np.int64) @ copies[left]
        edges = _forest(links, left, right, len(rows))
        counted = np.flatnonzero(n)
        a = np.concatenate((sid[counted], sid[[e[0] for e in edges]] if edges else sid[:0]))
        b = np.concatenate((sid[counted], sid[[e[1] for e in edges]] if edges else sid[:0]))
        return pd.DataFrame({"a": a, "b": b, "links": np.concatenate((n[counted], np.zeros(len(edges), np.int64)))})

    return run


def _children(parents: DataFrame, threshold: float, coordinates: int) -> DataFrame:
    """(sid, node) of the next level: a node samples its coordinates by a hash of node and coordinate."""
    chance = int(2**20 / (threshold * coordinates))
    sampled = f"filter(sequence(0, {coordinates - 1}), j -> pmod(xxhash64(node, j), {2**20}) < {chance})"
    child = (
        f"transform({sampled}, j -> shiftleft(shiftright(node, {RUN_SHIFT}), {RUN_SHIFT})"
        f" + pmod(xxhash64(node, j, minhash[j], 'child'), {2**RUN_SHIFT}))"
    )
    return parents.select("sid", F.explode(F.expr(child)).alias("node"))


def _with_members(frontier: DataFrame) -> DataFrame:
    """Adds the number of members and drops nodes with a single one."""
    counts = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return frontier.join(counts, "node")


def near_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = 0.8,
    width: int = SHINGLE,
    target_recall: float = 0.99,
    leaf: int = 128,
    max_depth: int = 3,
    slack: float = 0.27,
) -> DataFrame:
    """(doc, t, label, class_id, n_links): one row per row of ``docs``; ``t`` is the hash of its text, ``label`` that of its class.

    ``class_id`` is the smallest id of the document's class, the connected component of links;
    ``n_links`` counts the other rows whose shingle sets have a Jaccard similarity of ``threshold`` or more with
    this one, exact copies included. Words are lower-cased runs without white space. Texts with fewer words than a
    shingle are one shingle; texts without words (null, empty) are equal to each other. Rows that
    repeat an id join its classes only through their texts. Null ids are allowed; a class of null ids only has a null id.
    A pair is compared exactly once it shares a leaf, unless its minhash vectors agree on less than ``threshold - slack``
    of the coordinates: at the threshold that befalls 3.2e-7 of the pairs. Runs follow from ``target_recall``.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    body = body.withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    sets = materialize(
        map_texts(body, "text", _sketches(width, COORDINATES), "sid long, size int, minhash array<int>, bytes binary", ["doc", "t"]),
        "path-sets",
    )
    reps = materialize(
        sets.groupBy("sid").agg(
            F.count(F.lit(1)).alias("copies"), F.min("doc").alias("least"), F.min(F.struct("doc", "t")).alias("rep"), F.first("size").alias("size"),
            F.first("minhash").alias("minhash"), F.first("bytes").alias("bytes"),
        ),
        "path-reps",
    )
    usable = reps.where("size > 0")

    runs = runs_for(target_recall, threshold, max_depth)
    rng = random.Random(f"{runs}/{threshold}")
    roots = [(r, j) for r in range(1, runs + 1) for j in range(COORDINATES) if rng.random() < 1 / (threshold * COORDINATES)]
    first = ", ".join(
        f"{r << RUN_SHIFT}L + pmod(xxhash64({r}, {j}, minhash[{j}]), {2**RUN_SHIFT})" for r, j in roots
    )
    frontier = usable.select("sid", F.explode(F.expr(f"array({first})")).alias("node"))
    leaves = None
    for level in range(1, max_depth + 1):
        # written first: the rows are both counted and joined, and would be made twice
        nodes = materialize(_with_members(materialize(frontier, "path-frontier")), "path-level")
        last = level == max_depth
        done = nodes if last else nodes.where(F.col("members") <= leaf)
        leaves = done if leaves is None else leaves.unionByName(done)
        large = nodes.where(F.col("members") > leaf)
        if last or large.isEmpty():
            break
        frontier = _children(large.join(usable.select("sid", "minhash"), "sid"), threshold, COORDINATES)

    # each set once with all its leaves, so that a task can tell which leaf counts a pair
    owners = leaves.groupBy("sid").agg(
        F.sort_array(F.collect_list("node")).alias("nodes"), F.collect_list(F.struct("node", "members")).alias("leaf")
    )
    owners = materialize(owners.join(usable.select("sid", "bytes", "copies", "rep"), "sid"), "path-owners")
    members = owners.select("sid", "nodes", "bytes", F.explode("leaf").alias("leaf"))
    members = members.select("sid", "nodes", "bytes", F.col("leaf.node").alias("node"), F.col("leaf.members").alias("members"))
    group = ["node", "lo", "hi"]
    active = materialize(
        _blocks(members, BLOCK).repartition(*group).sortWithinPartitions(*group)
        .mapInArrow(_candidates(threshold - slack), "node long, sid long").distinct(),
        "path-active",
    )
    wanted = active.select("sid").distinct().join(owners.select("sid", "rep", "copies", "nodes"), "sid")
    # one row stands for a set, told by its id and its text; the struct is never null, so ids may be
    texts = body.withColumn("rep", F.struct("doc", "t")).join(wanted.select("rep").distinct(), "rep", "left_semi")
    full = materialize(
        map_texts(texts, "text", _full(width), "sid long, shingles binary", []).groupBy("sid").agg(F.first("shingles").alias("shingles")),
        "path-full",
    )
    counts = active.groupBy("node").agg(F.count(F.lit(1)).alias("members"))
    exact = active.join(counts, "node").join(wanted.select("sid", "copies", "nodes"), "sid").join(full, "sid")
    found = materialize(
        _blocks(exact, BLOCK).groupBy(*group).applyInPandas(_links(threshold), "a long, b long, links long"), "path-links"
    )
    labels = connected(found.where("a <> b").select("a", "b"))
    links = found.where("a = b").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))

    per_set = reps.select("sid", "copies", "least").join(labels.withColumnRenamed("v", "sid"), "sid", "left").join(links, "sid", "left")
    per_set = per_set.withColumn("label", F.coalesce("label", "sid"))
    classes = per_set.groupBy("label").agg(F.min("least").alias("class_id"))
    per_set = per_set.join(classes, "label").select(
        "sid", "label", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links")
    )
    return sets.select("doc", "t", "sid").join(per_set, "sid").select("doc", "t", "label", "class_id", "n_links")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc, class_id, n_links): ``near_classes`` without the hashes of text and class."""
    return near_classes(docs, **options).select("doc", "class_id", "n_links")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Exactly one row of ``docs`` for each class of near copies: that with the smallest id, null after all others.

    A class is told by its texts, so an id that stands for texts of two classes keeps a row in both. Of ids
    that a class has with several texts the least hash of the text decides; of repeated rows any one stays.
    """
    classes = near_classes(docs, doc_id=doc_id, text=text, **options)
    first = classes.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "t")).alias("k"))
    leaders = first.select(F.struct(F.col("k.doc").alias("doc"), F.col("k.t").alias("t")).alias("__k"))
    keyed = docs.withColumn("__k", F.struct(F.col(doc_id).alias("doc"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("t")))
    return keyed.join(leaders, "__k", "left_semi").dropDuplicates(["__k"]).drop("__k")
