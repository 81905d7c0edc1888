"""Near copies and benchmark leaks against brute force."""

from __future__ import annotations

import random
import time
from collections import defaultdict
from itertools import combinations

import numpy as np
from helpers import docs_of, empty_docs, odd_docs
from wattloom.llm import chosen_path, components, tiling


def sets_of(texts: dict) -> dict:
    def one(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    return {i: one(t) for i, t in texts.items()}


def classes_twin(texts: dict, least: float = 0.8) -> dict:
    sets, root, links = sets_of(texts), {i: i for i in texts}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if (not x and not y) or (x and y and len(x & y) >= least * len(x | y)):
            links[a] += 1
            links[b] += 1
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(i), links[i]) for i in texts}


def near_texts(rng, n_groups: int, size: int) -> dict:
    texts, i = {}, 0
    for g in range(n_groups):
        base = [f"g{g}w{rng.randint(0, 500)}" for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"edit{rng.randint(0, 10**6)}"
            texts[i] = " ".join(words)
            i += 1
    return texts


def test_classes_and_links_equal_brute_force(spark):
    texts = near_texts(random.Random(2), 40, 8) | {9000: None, 9001: "", 9002: "one two", 9003: "One  two", 9004: "one"}
    got = {r["doc"]: (r["class_id"], r["n_links"]) for r in chosen_path.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == classes_twin(texts)


def test_large_groups_go_through_blocks_and_levels(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    texts = {}
    for i in range(90):
        words = list(base)
        words[rng.randrange(200)] = f"e{i}"
        words[rng.randrange(200)] = f"f{i}"
        texts[i] = " ".join(words)
    texts |= {1000 + i: " ".join(f"other{i}x{k}" for k in range(60)) for i in range(20)}
    got = {r["doc"]: (r["class_id"], r["n_links"]) for r in chosen_path.near_duplicates(docs_of(spark, texts), leaf=8).collect()}
    want = classes_twin(texts)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
    # nodes that stay large split at random, so a link is found with the target probability
    assert all(n <= want[i][1] for i, (_, n) in got.items())
    assert sum(n for _, n in got.values()) >= 0.99 * sum(n for _, n in want.values())


def test_recall_sets_the_runs():
    assert chosen_path.runs_for(0.9, 0.8, 3) < chosen_path.runs_for(0.99, 0.8, 3) < chosen_path.runs_for(0.999, 0.8, 3)


def test_near_duplicates_of_odd_and_empty_tables(spark):
    odd = odd_docs(spark)
    rows = chosen_path.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    same = [r for r in rows if r["doc"] in (5, 6) and r["n_links"]]
    assert len(same) == 3 and {r["class_id"] for r in same} == {5} and {r["n_links"] for r in same} == {2}
    assert {r["n_links"] for r in rows if r["doc"] in (2, 3, 7)} == {3}
    assert chosen_path.near_duplicates(empty_docs(spark)).collect() == []


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["v"]: r["label"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root if any(a != b and v in (a, b) for a, b in edges)}


def tiles_twin(item: list, doc: list, least: int) -> int:
    """Greedy string tiling by plain search: covered item tokens."""
    used_i, used_d, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                k = 0
                while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] and not used_i[i + k] and not used_d[d + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, d)
        k, i, d = best
        if k < least:
            return covered
        for j in range(k):
            used_i[i + j] = used_d[d + j] = True
        covered += k


def test_tiling_equals_plain_search(spark):
    rng = random.Random(6)
    items = {k: [f"i{k}t{rng.randint(0, 400)}" for _ in range(rng.choice([3, 12, 40]))] for k in range(12)}
    items[20] = ["a", "b"] * 10
    docs = {}
    for d in range(40):
        parts = []
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(list(items.values()))
            a = rng.randrange(len(item))
            parts.append(item[a:] + item[:a])
            parts.append([f"f{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 6))])
        docs[d] = [w for p in parts for w in p]
    got = {
        (r["doc"], r["item"]): (r["n_item_tokens"], r["n_covered"])
        for r in tiling.contaminated(
            docs_of(spark, {d: ", ".join(w).upper() for d, w in docs.items()}),
            spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"), threshold=0.5,
        ).collect()
    }
    want = {}
    for d, words in docs.items():
        for k, item in items.items():
            n = tiles_twin(item, words, 5)
            if n and n >= 0.5 * len(item):
                want[d, k] = (len(item), n)
    assert got == want and any(0 < n < size for size, n in want.values())


def test_reordered_passages_are_caught(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    rows = tiling.contaminated(
        docs_of(spark, {1: f"x {b}. y {a}. z", 2: f"{a} unrelated words only", 3: "nothing here at all to see"}),
        spark.createDataFrame([(9, f"{a} {b}"), (8, None), (7, "")], "item_id long, text string"), threshold=0.8,
    ).collect()
    assert [(r["doc"], r["item"], r["coverage"], r["n_tiles"]) for r in rows] == [(1, 9, 1.0, 2)]


def test_seeds_too_many_to_broadcast_give_the_same(spark, monkeypatch):
    docs = docs_of(spark, {1: "p q r s t u v w", 2: "q r s t u"})
    items = spark.createDataFrame([(1, "p q r s t u v w")], "item_id long, text string")
    pick = lambda: sorted((r["doc"], r["item"], r["n_covered"]) for r in tiling.contaminated(docs, items).collect())
    small = pick()
    monkeypatch.setattr(tiling, "BROADCAST_SEEDS", -1)
    assert pick() == small == [(1, 1, 8), (2, 1, 5)]


def test_tiling_of_odd_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "plain words in a short text"), (2, None)], "item_id long, text string")
    assert [(r["doc"], r["item"]) for r in tiling.contaminated(odd_docs(spark), items).collect()] == [(1, 1)]
    assert tiling.contaminated(empty_docs(spark), items).collect() == []
    assert tiling.contaminated(odd_docs(spark), items.limit(0)).collect() == []


def tiles_of(item: list, doc: list, width: int) -> list:
    """``tile`` on token lists: every window of the item, and the document's windows that the item has."""
    of = lambda t: [hash(tuple(t[k : k + width])) for k in range(len(t) - width + 1)]
    wanted = set(of(item))
    found = [(p, h) for p, h in enumerate(of(doc)) if h in wanted]
    if not found:
        return []
    pos, hashes = (np.array(x, np.int64) for x in zip(*found))
    return tiling.tile(np.array(of(item), np.int64), pos, hashes, width)


def test_tiles_equal_plain_search_on_few_words():
    rng = random.Random(9)
    for _ in range(300):
        words = "abc"[: rng.randint(1, 3)]
        item = [rng.choice(words) for _ in range(rng.randint(3, 25))]
        doc = [rng.choice(words + "x") for _ in range(rng.randint(3, 40))]
        tiles = tiles_of(item, doc, 3)
        assert sum(n for _, _, n in tiles) == tiles_twin(item, doc, 3)
        for at in (0, 1):
            places = [t[at] + k for t in tiles for k in range(t[2])]
            assert len(places) == len(set(places))
        assert all(item[a : a + n] == doc[b : b + n] for a, b, n in tiles)


def test_one_repeated_word_takes_seconds(spark):
    start = time.time()
    assert tiles_of(["a"] * 300, ["a"] * 20_000, 5) == [(0, 0, 300)]
    doc = (["a"] * 50 + ["x"]) * 400
    assert len(tiles_of(["a"] * 300, doc, 5)) == 6
    rows = tiling.contaminated(
        docs_of(spark, {1: "a " * 20_000}), spark.createDataFrame([(7, "a " * 300)], "item_id long, text string")
    ).collect()
    assert [(r["doc"], r["item"], r["coverage"]) for r in rows] == [(1, 7, 1.0)] and time.time() - start < 30


def test_near_copies_without_an_id_keep_their_links(spark):
    """Null and reused ids: a text is found by its set, never by an id."""
    base = [f"w{k}" for k in range(60)]
    near = [" ".join(base[:-1] + [f"e{k}"]) for k in range(4)]
    rows = [(None, near[0]), (7, near[1]), (8, near[2]), (8, "quite another text with seven words"), (None, near[3]), (None, "alone without an id here")]
    got = sorted(((r["doc"] or 0, r["class_id"] or 0, r["n_links"]) for r in chosen_path.near_duplicates(docs_of(spark, rows)).collect()))
    assert got == [(0, 0, 0), (0, 7, 3), (0, 7, 3), (7, 7, 3), (8, 7, 3), (8, 8, 0)]
