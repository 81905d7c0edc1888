"""Learned operators by held-out accuracy and, where numbers are fixed, against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs_of, empty_docs, odd_docs
from wattloom.llm import class_lm, compression_quality, toxicity
from wattloom.llm.common import held_out

SYLLABLES = "ba ko mi ru te sa lo ni fe du".split()


def word(rng, start=""):
    return start + "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


@pytest.fixture(scope="module")
def toxic_corpus(spark):
    rng, texts, toxic = random.Random(1), {}, []
    for i in range(900):
        words = [word(rng) for _ in range(rng.choice([20, 80, 400]))]
        if i % 8 == 0:
            for _ in range(max(2, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(["zork", word(rng, "vrex")])
            toxic.append(i)
        texts[i] = " ".join(words) + "."
    return texts, toxic


def test_toxic_texts_are_found_among_unlabelled_ones(spark, toxic_corpus):
    texts, toxic = toxic_corpus
    docs = docs_of(spark, texts)
    train = docs.where("doc_id < 700")
    confirmed = spark.createDataFrame([(i,) for i in toxic if i < 700 and i % 16 == 0], "doc_id long")  # half of them
    model = toxicity.fit(train, confirmed, prior=0.125)
    rows = model.with_score(docs.where("doc_id >= 700"), keep=["doc_id"]).collect()
    wrong = [r for r in rows if (r["score"] >= 0.5) != (r["doc_id"] in set(toxic))]
    assert len(rows) == 200 and len(wrong) <= 2 and all(0 <= r["score"] <= 1 for r in rows)


def test_risk_never_rewards_overfitting():
    """With as many features as rows the plain estimator would call every unlabelled text clean."""
    rng = np.random.default_rng(0)
    rows = lambda n, hot: [([int(k)] + ([99] if hot else []), [1.0] * (2 if hot else 1)) for k in rng.integers(0, 99, n)]
    p = toxicity.Sparse(rows(60, True), 100)
    u = toxicity.Sparse(rows(30, True) + rows(270, False), 100)
    w, b = toxicity.nn_pu_fit(p, u, prior=0.1, seed=0)
    scores = 1 / (1 + np.exp(-(u.dot(w) + b)))
    assert scores[:30].min() > 0.5 > scores[30:].max()


def test_toxicity_of_odd_and_empty_tables(spark, toxic_corpus):
    odd = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long")
    model = toxicity.fit(odd, none, prior=0.2)
    assert {round(r["new"], 6) for r in model.with_score(odd, column="new").collect()} == {0.2}
    model = toxicity.fit(odd, spark.createDataFrame([(5,), (None,), (77,)], "doc_id long"), prior=0.2)
    rows = model.with_score(odd, column="new").collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() == {*odd.columns, "new"}
    assert 2**60 + 1 in {r["doc_id"] for r in rows}  # an id beyond the floats beside null ids
    assert toxicity.fit(empty_docs(spark), none, prior=0.2).with_score(empty_docs(spark)).collect() == []
    assert toxicity.prior_of(spark.createDataFrame([], "toxic int")) == 0.1


def test_quality_by_compression(spark):
    rng, texts, labels = random.Random(2), {}, []
    vocabulary = [word(rng) for _ in range(300)]
    for i in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([15, 60, 600]))]
        good = i % 5 != 0
        texts[i] = " ".join(words) + "." if good else " | ".join(w.upper() + "!!" for w in words)
        labels.append((i, int(good)))
    docs, known = docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")
    model = compression_quality.fit(docs.where("doc_id < 450"), known.where("doc_id < 450"))
    rows = model.score(docs.where("doc_id >= 450")).collect()
    assert sum((r["score"] >= 0.5) == (r["doc"] % 5 != 0) for r in rows) >= 147
    assert all(0 <= r["score"] <= 1 and r["raw_bytes"] == len(texts[r["doc"]]) for r in rows)


def test_chunks_hold_the_whole_text():
    text = "äöü 日本 " * 999
    assert b"".join(compression_quality.chunks(text)).decode() == text and compression_quality.chunks(None) == []


def test_quality_of_odd_and_empty_tables(spark):
    odd = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (3, 1), (5, 0), (6, 0), (2, None), (None, 1)], "doc_id long, quality int")
    rows = compression_quality.fit(odd, labels).score(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    flat = compression_quality.fit(odd, labels.limit(0)).score(odd).collect()
    assert {r["score"] for r in flat} == {0.5}
    assert compression_quality.fit(empty_docs(spark), labels).score(empty_docs(spark)).collect() == []


def base_twin(texts: dict, train: dict) -> tuple[dict, int]:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [""]
    c = Counter(w for t in train.values() for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in texts.items():
        k = tokens(t)
        out[i] = (len(k), sum(w in c for w in k), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in k))
    return out, n


def test_base_scores_and_gain_over_them(spark):
    rng, texts = random.Random(3), {}
    nouns, verbs = [word(rng, "n") for _ in range(60)], [word(rng, "v") for _ in range(60)]
    for i in range(400):
        texts[i] = " ".join(rng.choice(nouns) + " " + rng.choice(verbs) for _ in range(rng.choice([0, 5, 60])))
    texts |= {500: None, 501: "Ünseen WORDS only", 502: "\x0b"}
    train = {i: t for i, t in texts.items() if i < 320}
    docs = docs_of(spark, texts)
    model = class_lm.fit(docs.where("doc_id < 320"), known_words=50, placed_words=40, clustered_words=20, n_classes=6)
    want, n = base_twin(texts, train)
    rows = {r["doc"]: r for r in model.score(docs).collect()}
    assert model.total == n and set(rows) == set(texts)
    for i, r in rows.items():
        assert (r["n_tokens"], r["n_known"]) == want[i][:2] and math.isclose(r["base_score"], want[i][2], rel_tol=1e-9)
    held = [i for i in range(320, 400)]
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held) + 500


def test_exchange_finds_the_two_halves():
    rng = np.random.default_rng(1)
    pairs = np.zeros((22, 22))
    for a in range(20):
        for b in range(20):
            pairs[a, b] = rng.integers(20, 40) if (a < 10) != (b < 10) else 1
    label = class_lm.exchange(pairs, 2, 2)
    assert len(set(label[:10])) == len(set(label[10:20])) == 1 and label[0] != label[10] and list(label[20:]) == [2, 3]


def test_gains_are_differences_of_the_likelihood():
    rng = np.random.default_rng(2)
    n, k = 12, 4
    pairs = rng.integers(0, 6, (n, n)).astype(float)
    label = rng.integers(0, k, n)
    table_of = lambda x, use: np.eye(k)[x][use].T @ pairs[np.ix_(use, use)] @ np.eye(k)[x][use]
    everything = np.arange(n)
    hot = np.eye(k)[label]
    left, right, own = pairs.T @ hot, pairs @ hot, np.diag(pairs)
    left[everything, label] -= own
    right[everything, label] -= own
    got = class_lm.gains(table_of(label, everything), left, right, own.copy(), label)
    for w in range(n):
        want = []
        for g in range(k):
            moved = label.copy()
            moved[w] = g
            want.append(class_lm.likelihood(table_of(moved, everything)))
        assert np.allclose(got[w] - got[w, 0], np.array(want) - want[0])


def test_neighbourhoods_and_sweeps_over_all_words(spark):
    rng, texts = random.Random(5), {1: None, 2: "", 3: "q0 q0 q0"}
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    for i in range(10, 400):
        texts[i] = " ".join(f"{rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(rng.choice([1, 12])))
    number = {w: i for i, w in enumerate([*nouns, *verbs])} | {"": 61}
    beside = class_lm.neighbourhoods(docs_of(spark, texts).select("text"), number, 60)
    want = Counter()
    for t in texts.values():
        walk = [number.get(w, 60) for w in ["", *(t or "").split(), ""]]
        want.update(zip(walk, walk[1:]))
    after, before = {}, {}
    for r in beside.collect():
        after |= {(r["word"], b): n for b, n in zip(r["after"], r["after_n"], strict=True)}
        before |= {(a, r["word"]): n for a, n in zip(r["before"], r["before_n"], strict=True)}
    assert after == want and before == {p: n for p, n in want.items() if p[1] < 60}

    # of each kind only five words start in a class; the others wait in that of words outside the table
    start = np.array([*[0] * 5, *[2] * 25, *[1] * 5, *[2] * 25, 2, 3])
    pairs = np.zeros((62, 62))
    for p, n in want.items():
        pairs[p] = n
    table_of = lambda x: np.eye(4)[x].T @ pairs @ np.eye(4)[x]
    assert (class_lm.fold(beside, start, 4) == table_of(start)).all()
    label, table = class_lm.exchange_all(beside, start, 2, 2)
    assert set(label[:30]) == {0} and set(label[30:60]) == {1} and list(label[60:]) == [2, 3]
    assert (table == table_of(label)).all() and class_lm.likelihood(table) > class_lm.likelihood(table_of(start))


def test_pairs_travel_packed(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(150)]
    texts = [None, "", "w0 w0 other"] + [" ".join(rng.choices([*words, "other"], k=rng.choice([3, 40]))) for _ in range(200)]
    number = {w: i for i, w in enumerate(words)} | {"": 151}
    want = Counter()
    for t in texts:
        walk = [number.get(w, 150) for w in ["", *(t or "").split(), ""]]
        want.update(zip(walk, walk[1:]))
    keys = np.array([3, 1, 7], np.int32)
    rows, = class_lm._count_pairs(number, 150, keys)(iter([pa.record_batch([pa.array(texts, pa.string())], names=["text"])]))
    assert rows.num_rows == 3 < len(want)  # a row for each key, not for each pair
    pairs, n = class_lm._unpacked(rows.column(1), np.int64), class_lm._unpacked(rows.column(2), np.int32)
    assert Counter({(p >> 31, p & (1 << 31) - 1): c for p, c in zip(pairs.tolist(), n.tolist(), strict=True)}) == want

    # however many lots the words are dealt in, each word has one row, and its whole neighbourhood
    body = docs_of(spark, enumerate(texts)).select("text").repartition(3)
    for tokens in (0, 3 * class_lm.LOT, 10**12):
        got = class_lm.neighbourhoods(body, number, 150, tokens).collect()
        assert len(got) == len({r["word"] for r in got})
        after = {(r["word"], b): n for r in got for b, n in zip(r["after"], r["after_n"], strict=True)}
        before = {(a, r["word"]): n for r in got for a, n in zip(r["before"], r["before_n"], strict=True)}
        assert after == want and before == {p: n for p, n in want.items() if p[1] < 150}


def test_endings_of_many_words_and_shipped_words_outside_the_table(spark):
    classes = class_lm.Classes({}, {"ing": 1, "ab": 2, "öß!": 3}, 5)
    words = ["sing", "ing", "ab", "cab", "xöß!", "", "𝒳ing"]
    assert classes.by_ending(pa.array(words)).tolist() == [classes.of(w) for w in words]
    assert classes.by_ending(pa.array([], pa.string())).tolist() == []
    # shipped words are marked as they are settled; counts of all others meet the texts in a join
    docs = docs_of(spark, [(i, "a b c a b d e " + "f g " * (i % 2)) for i in range(20)])
    model = class_lm.fit(docs, known_words=5, placed_words=2, clustered_words=2, n_classes=2)
    shipped = {r["word"]: r["shipped"] for r in model.words.collect()}
    assert {w for w, x in shipped.items() if x} == set(model.counts) and len(shipped) == 8 and None not in shipped.values()


def test_probabilities_add_up(spark):
    """Over all known words and one unknown word for each class, the next token's probabilities add up to one."""
    docs = docs_of(spark, {1: "a b a c", 2: "b a d", 3: ""})
    model = class_lm.fit(docs, known_words=3, placed_words=3, clustered_words=2, n_classes=2)
    words = {r["word"]: r["n"] for r in model.words.collect()}
    step = 10 ** model.transition
    assert np.allclose(step.sum(axis=1), 1)
    for g in range(len(step)):
        inside = [n for w, n in words.items() if model.classes.of(w) == g]
        assert math.isclose((sum(n + 0.1 for n in inside) + 0.1) / 10 ** model.room[g], 1)


def test_language_model_of_odd_and_empty_tables(spark):
    odd = odd_docs(spark)
    rows = class_lm.score_documents(odd).collect()
    assert len(rows) == odd.count() and all(r["score"] < 0 and r["base_score"] < 0 for r in rows)
    assert class_lm.score_documents(empty_docs(spark)).collect() == []
    alone = docs_of(spark, {10: "no training text"}).where(held_out("doc_id", 10) | ~held_out("doc_id", 10))
    assert class_lm.fit(empty_docs(spark)).score(alone).first()["n_known"] == 0


def test_rare_words_are_placed_by_their_neighbours(spark):
    """Words beyond all tables whose ending speaks for the wrong class; scores as a plain walk over the stored classes gives them."""
    rng, texts = random.Random(4), {}
    nouns, verbs = [f"n{i}aaa" for i in range(12)], [f"v{i}ooo" for i in range(12)]
    for i in range(300):
        texts[i] = " ".join(f"{rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(20))
    odd = [f"x{i}ooo" for i in range(30)]  # used as nouns, written like verbs
    for i, w in enumerate(odd * 3):
        texts[1000 + i] = f"{rng.choice(nouns)} {rng.choice(verbs)} {w} {rng.choice(verbs)}"
    texts |= {2000: "once1ooo twice1ooo once2ooo", 2001: "twice1ooo"}
    docs = docs_of(spark, texts)
    model = class_lm.fit(docs, known_words=20, placed_words=20, clustered_words=16, n_classes=2)
    stored = {r["word"]: r["g"] for r in model.words.collect()}
    assert {stored[w] for w in odd} == {stored["n0aaa"]} != {stored["v0ooo"]}
    walks = {i: ["", *t.split(), ""] for i, t in texts.items()}
    steps = Counter((stored[a], stored[b]) for w in walks.values() for a, b in zip(w, w[1:]))
    k = len(model.room)
    table = np.array([[steps[g, h] for h in range(k)] for g in range(k)], float)
    prior = (table.sum(axis=0) + 1) / (table.sum() + k)
    assert np.allclose(10**model.transition, (table + 5 * prior) / (table.sum(axis=1, keepdims=True) + 5))
    n = Counter(t for w in walks.values() for t in w[1:])
    new = {3000: "x1ooo x2ooo unseen1ooo v1ooo once1ooo", 3001: "", 3002: "n1aaa x3ooo n2aaa"}
    of = lambda w: stored[w] if w in stored else model.classes.of(w)
    for r in model.score(docs_of(spark, texts | new)).collect():
        w = ["", *(texts | new)[r["doc"]].split(), ""]
        want = sum(model.transition[of(a), of(b)] - model.room[of(b)] + math.log10(n[b] + 0.1) for a, b in zip(w, w[1:]))
        assert math.isclose(r["score"], want, rel_tol=1e-9)


def test_runs_hold_the_words_of_the_contract():
    rng = random.Random(12)
    bits = ["a", "B", "É", "ß", "İ", "K", "日", "🙂", "\x1c", "\x1f", "\x85", "\xa0", "\u3000", "\0", "\x7f", " ", "\t", "\n", "\x0b", "\x0c", "\r", " "]
    texts = [None, "", " ", "\n \n"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    want = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [""] for t in texts]
    for array in (pa.array(texts), pa.array(["cut off", *texts])[1:]):
        (words, seq, ends), = class_lm.runs_of(array)
        tokens = [words[k].as_py() for k in seq.tolist()]
        assert tokens == ["", *(w for t in want for w in t)]
        assert ends.tolist() == np.cumsum([len(t) for t in want]).tolist()
    assert list(class_lm.runs_of(pa.array([], pa.string()))) == []


def test_rows_of_a_key_stay_together_over_batches():
    keys = [None] * 3 + sorted("aabbbbbccd" * 3)
    whole = pa.record_batch({"n": list(range(len(keys))), "word": pa.array(keys, pa.string())})
    for size in (1, 2, 5, 100):
        got = list(class_lm._whole_keys((whole.slice(k, size) for k in range(0, len(keys), size)), "word"))
        assert pa.Table.from_batches(got).to_pydict() == whole.to_pydict()
        of = [set(b.column("word").to_pylist()) - {None} for b in got]
        assert sum(map(len, of)) == len(set.union(*of)) == 4
