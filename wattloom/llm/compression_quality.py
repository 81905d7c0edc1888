"""Quality by compression: Zstandard dictionaries of good and of bad text, and a calibrated size difference.

A text is cut into chunks, each chunk is compressed with the good, with the bad and without a dictionary,
and the sizes are summed, so a long text's later parts count as much as its beginning. The normalised
difference says which of the two languages of text it is closer to; a logistic curve fitted on texts
outside the dictionaries turns it into a probability.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import map_texts

#: Dictionaries and curve are fitted on about so many labelled texts of each class at most.
MAX_PER_CLASS = 2_000
DICTIONARY_BYTES = 112 << 10
CHUNK = 1_000
LEVEL = 3


def chunks(text: str | None, size: int = CHUNK) -> list[bytes]:
    """The whole text in pieces of ``size`` bytes."""
    data = (text or "").encode("utf-8", "replace")
    return [data[k : k + size] for k in range(0, len(data), size)]


def train_dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary, or the raw text itself where there is too little to train on."""
    samples = [c for t in texts for c in chunks(t)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Sizes:
    """Compressed sizes of a text under both dictionaries and without one."""

    def __init__(self, good: bytes, bad: bytes):
        # no checksum, no content size, no dictionary id: only what the text itself costs
        plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        self.compressors = [zstandard.ZstdCompressor(level=LEVEL, **plain)]
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **plain))

    def of(self, text: str | None) -> list[int]:
        """[raw, plain, good, bad] bytes; all 0 for an empty text."""
        parts = chunks(text)
        return [sum(map(len, parts)), *[sum(len(c.compress(p)) for p in parts) for c in self.compressors]]


def features(sizes: np.ndarray) -> np.ndarray:
    """Normalised difference (bad - good) / (bad + good), its slope by compressibility, and the ratios themselves."""
    raw, plain, good, bad = np.maximum(sizes.astype(float).T, 1e-9)
    empty = sizes[:, 0] == 0
    d = np.where(empty, 0, (bad - good) / (bad + good))
    rg, rb, rp = (np.where(empty, 0, np.minimum(x / raw, 2)) for x in (good, bad, plain))
    return np.column_stack([d, d * rp, rg, rb, rp, rp**2, d**2, np.log1p(raw) * d])


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> dict:
    """Logistic curve over standardised features, by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w))
        move = np.linalg.solve(h, z.T @ (y - p) - ridge * len(x) * w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "weights": w}


def probability(curve: dict, x: np.ndarray) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), (x - curve["mean"]) / curve["scale"]])
    return 1 / (1 + np.exp(-np.clip(z @ curve["weights"], -30, 30)))


def _scored(good: bytes, bad: bytes, curve: dict):
    def make():
        sizes = Sizes(good, bad)

        def work(texts):
            got = np.array([sizes.of(t) for t in texts], np.int64).reshape(-1, 4)
            return {
                "raw_bytes": got[:, 0], "good_bytes": got[:, 2], "bad_bytes": got[:, 3], "score": probability(curve, features(got)),
            }

        return work

    return make


class Model:
    """Two dictionaries and a curve: bounded by ``DICTIONARY_BYTES``."""

    def __init__(self, good: bytes, bad: bytes, curve: dict):
        self.good, self.bad, self.curve = good, bad, curve

    def score(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc, raw_bytes, good_bytes, bad_bytes, score): every whole text; null and empty ones get the curve's value at no difference."""
        body = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
        added = "raw_bytes long, good_bytes long, bad_bytes long, score double"
        return map_texts(body, "text", _scored(self.good, self.bad, self.curve), added, ["doc"])


def _flat(share: float) -> Model:
    """The same score for every text."""
    return Model(b"x" * 8, b"x" * 8, {"mean": np.zeros(8), "scale": np.ones(8), "weights": np.array([np.log(share / (1 - share)), *[0.0] * 8])})


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    max_per_class: int = MAX_PER_CLASS, dictionary_bytes: int = DICTIONARY_BYTES,
) -> Model:
    """Fit on about ``max_per_class`` labelled texts of each class, drawn by a hash of their ids.

    Two thirds of them make the dictionaries, the last third the curve, weighted to the labels' own
    shares. If a class or every labelled text is missing, all texts get the share of good labels (a half if there are no labels).
    """
    known = labels.where(F.col(label).isNotNull()).select(F.col(doc_id).alias("doc"), (F.col(label) > 0).alias("good")).distinct()
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else (0.99 if True in counts else 0.01)
        return _flat(share)
    draw = F.pmod(F.xxhash64("doc", F.lit("quality")), F.lit(1_000_000))
    share = {g: min(1.0, max_per_class / n) for g, n in counts.items()}
    drawn = known.where(draw < F.when(F.col("good"), int(share[True] * 1e6)).otherwise(int(share[False] * 1e6)))
    # about 2 x max_per_class ids, so they are broadcast and no text is shuffled to find its label
    body = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    rows = body.where(draw < int(max(share.values()) * 1e6)).join(F.broadcast(drawn), "doc").select("good", "text", draw.alias("draw"), "doc").collect()
    rows.sort(key=lambda r: (r["draw"], r["doc"], r["text"] or ""))
    if not rows:
        return _flat(counts[True] / (counts[True] + counts[False]))
    part = [(r["good"], r["text"], k % 3) for k, r in enumerate(rows)]
    good = train_dictionary([t for g, t, k in part if g and k], dictionary_bytes)
    bad = train_dictionary([t for g, t, k in part if not g and k], dictionary_bytes)
    sizes = Sizes(good, bad)
    held = [(g, sizes.of(t)) for g, t, k in part if not k] or [(g, sizes.of(t)) for g, t, _ in part]
    x, y = features(np.array([s for _, s in held], np.int64)), np.array([float(g) for g, _ in held])
    # classes were drawn at different rates: the curve's bias is moved back to the labels' own odds
    curve = calibrate(x, y)
    curve["weights"][0] += np.log(share[False] / share[True])
    return Model(good, bad, curve)
