"""Benchmark decontamination by greedy string tiling.

Five-token windows of the texts are hashed; documents that share enough windows with a benchmark item are
compared with it. The longest match is found by running Karp-Rabin: rolling hashes of all runs of a length, the
length by bisection, every hit compared in full. It is marked, and the search repeats over what is not
marked until no match is long enough; matches never overlap in either text. The share of an item's tokens
under tiles decides, so a passage whose sentences were reordered is still found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import map_texts

MIN_MATCH = 5
#: A seed table of up to so many rows (about 40 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_SEEDS = 500_000
TOKEN = r"[\p{L}\p{N}]+"


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))


def windows(df: DataFrame, tokens: str, width: int, *keep: str) -> DataFrame:
    """(keep..., pos, h): the hash of every ``width``-token window; texts with fewer tokens have none."""
    at = ", ".join(f"{tokens}[i + {k}]" for k in range(width))
    hashes = F.expr(f"case when size({tokens}) >= {width} then transform(sequence(0, size({tokens}) - {width}), i -> xxhash64({at})) end")
    return df.select(*keep, F.posexplode(hashes).alias("pos", "h"))


BASE = np.uint64(0x9E3779B97F4A7C15)


def _runs(pos: np.ndarray, marks: np.ndarray, width: int) -> np.ndarray:
    """For each window how many windows follow each other from it on without a gap and without a marked token."""
    blocked = np.concatenate(([0], np.cumsum(marks)))
    free = blocked[np.minimum(pos + width, len(marks))] == blocked[pos]
    stop = np.append(~(free[:-1] & free[1:] & (np.diff(pos) == 1)), True) if len(pos) else np.zeros(0, bool)
    ends = np.flatnonzero(stop)
    return np.where(free, ends[np.searchsorted(ends, np.arange(len(pos)))] - np.arange(len(pos)) + 1, 0)


class _Rolling:
    """Karp-Rabin hashes of all runs of a sequence: the hash of any run is a difference of two running sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, BASE)))) if n else np.ones(1, np.uint64)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(values * self.powers[:n])))

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.powers[len(self.sums) - 1 - starts]


def tile(item_hash: np.ndarray, doc_pos: np.ndarray, doc_hash: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(item position, document position, length in tokens) of the tiles.

    ``item_hash`` has the hash of every window of the item, ``doc_hash`` those of the document's windows at ``doc_pos``
    (ascending) that the item has too. The longest match goes first; of equal ones that which starts first in
    the item, then in the document. Time is linear in both texts for each length that a tile has.
    """
    item_pos = np.arange(len(item_hash))
    item_hash, doc_hash, doc_pos = item_hash.view(np.uint64), doc_hash.view(np.uint64), doc_pos.astype(np.int64)
    item_marks = np.zeros(len(item_hash) + width, bool)
    first = int(doc_pos[0]) if len(doc_pos) else 0
    doc_at = doc_pos - first  # marks are needed between the first and the last hit only
    doc_marks = np.zeros((int(doc_at[-1]) if len(doc_pos) else 0) + width + 1, bool)
    # both are aligned to one power of the base
    longest = max(len(item_hash), len(doc_hash))
    pad = lambda x: np.concatenate((x, np.zeros(longest - len(x), np.uint64)))
    item_roll, doc_roll = _Rolling(pad(item_hash)), _Rolling(pad(doc_hash))
    tiles, most = [], len(item_hash)
    with np.errstate(over="ignore"):
        while True:
            item_run, doc_run = _runs(item_pos, item_marks, width), _runs(doc_at, doc_marks, width)
            most = min(most, int(item_run.max(initial=0)), int(doc_run.max(initial=0)))

            def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
                i, d = np.flatnonzero(item_run >= n), np.flatnonzero(doc_run >= n)  # noqa: B023
                hi, hd = item_roll.of(i, n), doc_roll.of(d, n)
                i, hi = (x[np.isin(hi, hd)] for x in (i, hi))
                if not len(i):
                    return None
                keep = np.isin(hd, hi)
                return i, hi, d[keep], hd[keep]

            if most < 1:
                break
            low, high, hits = 0, most, common(most)  # a passage copied whole is found at once
            if hits is not None:
                low = most
            else:
                high = most - 1
            while low < high:
                middle = (low + high + 1) // 2
                got = common(middle)
                if got is None:
                    high = middle - 1
                else:
                    low, hits = middle, got
            if low < 1:
                break
            most, size = low, low + width - 1
            i, hi, d, hd = hits
            waiting: dict[int, list[int]] = {}
            for at, h in zip(d[::-1].tolist(), hd[::-1].tolist()):
                waiting.setdefault(h, []).append(at)
            marked = False
            for a, h in zip(i.tolist(), hi.tolist()):
                if item_marks[a : a + size].any():
                    continue
                places = waiting[h]
                while places:
                    at = places[-1]
                    b = int(doc_at[at])
                    if doc_marks[b : b + size].any():
                        places.pop()  # marks stay, so this place is never free again at this length
                    elif not np.array_equal(item_hash[a : a + low], doc_hash[at : at + low]):
                        raise ValueError("two runs of windows have one hash")
                    else:
                        places.pop()
                        tiles.append((a, b + first, size))
                        item_marks[a : a + size] = True
                        doc_marks[b : b + size] = True
                        marked = True
                        break
            if not marked:
                most = low - 1
    return sorted(tiles)


TILED = "n_item_tokens long, n_covered long, coverage double, n_tiles long, tiles array<struct<item_pos: int, doc_pos: int, length: int>>"


def _tiled(width: int):
    def make():
        def work(pairs):
            out: dict[str, list] = {c: [] for c in ("n_item_tokens", "n_covered", "coverage", "n_tiles", "tiles")}
            for pair in pairs:
                n = pair["n"]
                hits = np.array([(h["dp"], h["h"]) for h in pair["hits"]], np.int64)
                hits = hits[np.argsort(hits[:, 0], kind="stable")]
                tiles = tile(np.array(pair["windows"], np.int64), hits[:, 0], np.ascontiguousarray(hits[:, 1]), width)
                covered = sum(t[2] for t in tiles)
                out["n_item_tokens"].append(n)
                out["n_covered"].append(covered)
                out["coverage"].append(covered / n)
                out["n_tiles"].append(len(tiles))
                out["tiles"].append([{"item_pos": a, "doc_pos": b, "length": c} for a, b, c in tiles])
            return out

        return work

    return make


def document_key(doc_id: str, text: str) -> Column:
    """A document is its id and its text. Never null, and null ids are equal to each other."""
    return F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"))


def matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = 0.5, width: int = MIN_MATCH,
) -> DataFrame:
    """``contaminated`` with the document's key ``d`` (see ``document_key``) instead of its id alone."""
    items = benchmark.select(F.col(item_id).alias("item"), tokens_of(F.col(item_text)).alias("tokens")).distinct()
    items = windows(items.withColumns({"n": F.size("tokens"), "item_key": F.xxhash64("item", "tokens")}), "tokens", width, "item", "item_key", "n")
    # of each item one row for a window, with the number of places where it stands
    seeds = items.groupBy("h", "item", "item_key", "n").agg(F.count(F.lit(1)).alias("places"))
    if seeds.count() <= BROADCAST_SEEDS:
        seeds = F.broadcast(seeds)
    body = docs.select(document_key(doc_id, text).alias("d"), tokens_of(F.col(text)).alias("tokens"))
    hits = windows(body, "tokens", width, "d").join(seeds, "h").select("d", "item", "item_key", "n", "places", "h", F.col("pos").alias("dp"))
    pairs = hits.groupBy("d", "item", "item_key", "n").agg(
        F.collect_set(F.struct("dp", "h")).alias("hits"), F.collect_set(F.struct("h", "places")).alias("found")
    )
    # m tokens under tiles need the seeds of m / width places of the item at least
    enough = F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["places"]) * width >= threshold * F.col("n")
    whole = items.groupBy("item_key").agg(F.array_sort(F.collect_set(F.struct("pos", "h"))).alias("w"))
    pairs = pairs.where(enough).join(whole.select("item_key", F.col("w.h").alias("windows")), "item_key")
    pairs = pairs.select("d", "item", F.struct("n", "hits", "windows").alias("pair"))
    return map_texts(pairs, "pair", _tiled(width), TILED, ["d", "item"]).where(F.col("coverage") >= threshold)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = 0.5,
    width: int = MIN_MATCH,
) -> DataFrame:
    """(doc, item, n_item_tokens, n_covered, coverage, n_tiles, tiles): pairs with enough of the item covered.

    Tokens are runs of letters and digits, in lower case. Items with fewer than ``width`` tokens, null and
    empty texts match nothing. A document is its id and text: repeated rows are one, a reused id with
    another text gives pairs of its own. Positions in ``tiles`` count tokens.
    """
    out = matches(docs, benchmark, doc_id, text, item_id, item_text, threshold, width)
    return out.select(F.col("d.id").alias("doc"), *[c for c in out.columns if c != "d"])
