"""Token alignment, the hash index and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import docs_of, empty_docs, odd_docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from wattloom.llm import alignment, hash_index, repair

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACE = " \t\n\x0b\f\r"


# --- alignment -------------------------------------------------------------------------------------------------------


def ends_of(rng, total: int) -> np.ndarray:
    return np.array(sorted({total, *(rng.randrange(1, total) for _ in range(rng.randint(0, total)))}), np.int64)


def spans(ends) -> list[tuple[int, int]]:
    return list(zip([0, *ends[:-1]], ends))


@pytest.mark.parametrize("work", [1, 2, 3, 7, 1000])
def test_pieces_of_the_merge_path_give_all_overlaps(work):
    rng = random.Random(work)
    for _ in range(150):
        total = rng.randint(2, 40)
        a, b = ends_of(rng, total), ends_of(rng, total)
        i, j, cut_a, cut_b = alignment.align(a, b, work)
        want = {(x, y) for x, (s, e) in enumerate(spans(a)) for y, (t, f) in enumerate(spans(b)) if s < f and t < e}
        got = list(zip(i.tolist(), j.tolist()))
        assert len(got) == len(set(got)) and set(got) == want
        common = sorted(set(a.tolist()) & set(b.tolist()))
        assert [a[k - 1] for k in cut_a] == common and [b[k - 1] for k in cut_b] == common


def test_diagonals_cut_equal_work():
    rng = random.Random(1)
    a, b = ends_of(rng, 500), ends_of(rng, 500)
    i, j = alignment.diagonals(a, b, 16)
    assert ((i + j)[:-1] == np.arange(0, len(a) + len(b), 16)).all() and i[-1] == len(a) and j[-1] == len(b)
    merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
    assert [sum(s == 0 for _, s in merged[: x + y]) for x, y in zip(i, j)] == i.tolist()


def alignment_twin(rows: list[tuple]) -> list[tuple]:
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        kit = alignment.Tokenizers(f.read(), g.read())
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    docs, counts = [], Counter()
    for doc, text in rows:
        ids_a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = kit.b.encode(text) if text else []
        data = (" " + (text or "")).encode()
        if b"".join(kit.bytes_a[x] for x in ids_a) != data or b"".join(kit.bytes_b[y] for y in ids_b) != data:
            ids_a, ids_b = [], []
        sa, sb = (spans(np.cumsum([len(t[x]) for x in ids]).tolist()) if ids else [] for ids, t in ((ids_a, kit.bytes_a), (ids_b, kit.bytes_b)))
        links, y0 = [], 0
        for x, (s, e) in enumerate(sa):
            while sb[y0][1] <= s:
                y0 += 1
            y = y0
            while y < len(sb) and sb[y][0] < e:
                links.append((ids_a[x], ids_b[y]))
                y += 1
        counts.update(links)
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        text_of = [[[], []] for _ in cuts]
        for side, (ids, sp) in enumerate(((ids_a, sa), (ids_b, sb))):
            for token, (_, e) in zip(ids, sp):
                text_of[bisect_left(cuts, e)][side].append(str(token))
        text_of = ["|".join(",".join(side) for side in group) for group in text_of]
        docs.append((doc, len(ids_a), len(ids_b), len(cuts), links, hashlib.sha256(";".join(text_of).encode()).hexdigest() if cuts else ""))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(d, a, b, g, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for d, a, b, g, ls, sha in docs]


NAMES = ("doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def in_order(rows) -> list[tuple]:
    return sorted((tuple(r[n] for n in NAMES) if not isinstance(r, tuple) or hasattr(r, "asDict") else r for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_alignment_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["Straße", "naïve", "日本語", "the", "counter", "-measures", "<s>", "<|endoftext|>", "'ll", "🙂", "\n", "\t", "1234567", "électricité", "  ", "", "\n ", " \t", "\u3000", "\xa0", "\u2581"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for k in range(60)]
    texts += [(60, None), (61, ""), (62, " "), (63, "has ▁ the mark of B"), (64, "ends in nul \0"), (5, "a reused id"), (None, "no id"), (None, "no id"), (65, "plain words " * 400)]
    docs = docs_of(spark, texts).repartition(3)
    want = in_order(alignment_twin(texts))
    for block_bytes, work, segment in ((alignment.BLOCK_BYTES, alignment.WORK, alignment.SEGMENT), (300, 5, 40)):
        assert in_order(alignment.cross_alignment(docs, A, B, block_bytes=block_bytes, work=work, segment=segment).collect()) == want
    assert [r for r in want if r[0] == 63] == [(63, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    got = in_order(alignment.cross_alignment(docs, A, B).collect())
    assert got == in_order(alignment_twin([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    assert alignment.cross_alignment(empty_docs(spark), A, B).collect() == []


def test_a_block_is_aligned_in_slices_of_bounded_memory():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        kit = alignment.Tokenizers(f.read(), g.read())
    rng = random.Random(8)
    parts = [kit.encode([" ".join(rng.choice(["the", "unaligned", "Straße", "counter-measures", "tokens", "日本"]) for _ in range(1500))])[0] for _ in range(5)]

    def block(docs: int, **options):
        made = alignment._Block(kit, 500, **options)
        for k in range(docs):
            ids = [] if k % 7 == 3 else [parts[k % 5]]
            made.add(k, [x for x, _, _ in ids], [y for _, y, _ in ids], 10_000)
        return made

    small, whole = block(12, tokens=1).row(), block(12, tokens=1 << 30).row()
    for row in (small, whole):  # the order of a text's links is free
        index = np.frombuffer(pa.decompress(row.pop("links"), 2 * row["n_links"].sum(), codec=alignment.CODEC), np.uint16)
        row["of"] = [np.sort(x).tolist() for x in np.split(index, np.cumsum(row["n_links"]))]
    assert all(list(small[c]) == list(whole[c]) for c in whole)
    assert block(0).row()["docs"] == [] and block(4, tokens=1).row()["n_links"][3] == 0
    large = block(180)
    tracemalloc.start()
    links = int(large.row()["n_links"].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links > 400_000 and peak < 40 * links  # all at once: over 100 bytes a link


# --- hash index ------------------------------------------------------------------------------------------------------


def copies_twin(rows: list[tuple]) -> list[tuple]:
    groups, table = defaultdict(list), str.maketrans("", "", SPACE)
    for doc, text in rows:
        groups[(text or "").translate(table)].append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for body, members in groups.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return out


def copy_rows(df) -> list[tuple]:
    return by_id((r["doc"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def by_id(rows) -> list[tuple]:
    return sorted(rows, key=lambda r: tuple((v is None, v or 0) for v in r[:3]) + tuple(r[3:]))


def copy_texts(rng) -> list[tuple]:
    rows = [(k, f"text {k % 37}" + " " * rng.randint(0, 4)) for k in range(400)]
    rows += [(k, "hot text\nin a third of all rows") for k in range(400, 600)]
    return rows + [(600, None), (601, ""), (602, " \t\r\n"), (None, "hottext in a third of all rows"), (None, None), (3, "text 3"), (3, "text 3"), (603, "text 3")]


def test_copies_equal_brute_force_through_splits_flushes_and_collisions(spark, monkeypatch):
    rows = copy_texts(random.Random(5))
    rows += [(1000 + k, f"single {k}") for k in range(300)]
    want = by_id(copies_twin(rows))
    assert copy_rows(hash_index.exact_copies(docs_of(spark, rows).repartition(4))) == want
    monkeypatch.setattr(hash_index, "FLUSH_ENTRIES", 7)
    monkeypatch.setattr(hash_index, "ROUND_BITS", 3)
    assert copy_rows(hash_index.exact_copies(docs_of(spark, rows).repartition(5), bucket=4)) == want
    collide = lambda body: (len(body) % 3) << 61  # noqa: E731  (three hashes for all texts)
    assert copy_rows(hash_index.exact_copies(docs_of(spark, rows).repartition(2), bucket=2, key_of=collide)) == want


def test_directory_doubles_where_buckets_are_overfull(spark, monkeypatch):
    monkeypatch.setattr(hash_index, "ROUND_BITS", 3)
    rng = random.Random(9)
    values = {rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)} | {k for k in range(20)}  # and twenty that differ in their last bits only
    hashes = spark.createDataFrame([(v,) for v in values], "h long")
    slots, bits = hash_index.directory(hashes, bucket=8)
    assert bits > 60
    hashes = spark.createDataFrame([(v,) for v in values if not 0 <= v < 20], "h long")
    slots, bits = hash_index.directory(hashes, bucket=8)
    slots = {r["slot"]: (r["bucket"], r["depth"]) for r in slots.collect()}
    held = Counter()
    for v in values:
        if not 0 <= v < 20:
            bucket, depth = slots[(v % (1 << 64)) >> (64 - bits)]
            assert bucket == ((v % (1 << 64)) >> (64 - depth)) << (bits - depth)
            held[bucket] += 1
    assert max(held.values()) <= 8 and sum(held.values()) == 60 and max(d for _, d in slots.values()) == bits


def test_copies_in_odd_and_empty_tables(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert copy_rows(hash_index.exact_copies(docs)) == by_id(copies_twin(rows))
    assert hash_index.exact_copies(empty_docs(spark)).collect() == []


# --- conversation repair ---------------------------------------------------------------------------------------------


def repair_twin(rows: list[tuple]) -> tuple:
    """rows: (turn, role, text) of one conversation, damaged already."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, fault = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    # states: what may come next; all paths are kept by their least (cost, audit)
    now = {"": (0, "", [])}
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserts(now):
        todo = list(now.items())
        now = dict(now)
        while todo:
            q, (c, audit, out) = todo.pop()
            new = "a" if q == "u" else "u"
            way = (c + 2, audit + "I", out + [{"u": "user:", "a": "assistant:"}[new]])
            if new not in now or way[:2] < now[new][:2]:
                now[new] = way
                todo.append((new, way))
        return now

    for (_, role, text), f in zip(rows, fault):
        new = {}

        def put(q, way):
            if q not in new or way[:2] < new[q][:2]:
                new[q] = way

        for q, (c, audit, out) in inserts(now).items():
            put(q, (c + 3, audit + "D", out))
            if f in "-t":
                more = f == "t"
                if role[:1] and role[:1] in allowed[q]:
                    put(role[:1], (c + more, audit + "K", out + [f"{role}:{text}"]))
                to = "a" if q == "u" else "u"
                put(to, (c + 2 + more, audit + "R", out + [{"u": "user", "a": "assistant"}[to] + ":" + text]))
        now = new
    cost, audit, out = min((inserts(now)[q] for q in ("", "a") if q in inserts(now)), key=lambda w: w[:2])
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, fault.count("b"), fault.count("d"), fault.count("t"), illegal, cost, audit, digest)


def random_rows(rng, n: int) -> list[tuple]:
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", "admin", "User"]
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why? ", "and", "done.\n", "Again."]
    return [(rng.choice([None, *range(n + 3)]) if rng.random() < 0.2 else k, rng.choice(roles), rng.choice(texts) + rng.choice(["", "", str(k), f"{k}."])) for k in range(n)]


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("piece", [256, 1, 4])
def test_repair_equals_dynamic_programming(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rng = random.Random(piece)
    convs = {k: random_rows(rng, rng.choice([1, 2, 3, 5, 9, 30])) for k in range(150)}
    convs[None] = random_rows(rng, 40)
    df = spark.createDataFrame([(c, *r) for c, rows in convs.items() for r in rows], "conv_id long, turn long, role string, text string")
    got = {r["conv"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(df.repartition(5)).collect()}
    assert got == {c: repair_twin(rows) for c, rows in convs.items()}


def test_both_heaps_find_the_least_audit_of_the_least_cost():
    rng = random.Random(11)
    for _ in range(150):
        n = rng.randint(0, 4)
        codes = "".join(rng.choice("suax") + rng.choice("--tbd") for _ in range(n))
        rows = [(k, {"s": "system", "u": "user", "a": "assistant", "x": "tool"}[codes[2 * k]], "w") for k in range(n)]
        best = None
        todo = [(0, "", 0, 0)]  # every path up to a length, without any ordering
        while todo:
            c, audit, i, q = todo.pop()
            if best is not None and c > best[0]:
                continue
            if i == n and q in repair.ACCEPTING:
                best = min(best or (c, audit), (c, audit))
            if audit[-2:] != "II":
                todo.append((c + 2, audit + "I", i, repair.NEXT[q]))
            if i < n:
                todo.append((c + 3, audit + "D", i + 1, q))
                if codes[2 * i + 1] in "-t":
                    more = codes[2 * i + 1] == "t"
                    todo.append((c + 2 + more, audit + "R", i + 1, repair.NEXT[q]))
                    if (q, codes[2 * i]) in repair.STEP:
                        todo.append((c + more, audit + "K", i + 1, repair.STEP[q, codes[2 * i]]))
        assert repair.cheapest(codes, 0, repair.ACCEPTING) == best
        assert len([x for x in best[1] if x != "I"]) == len(rows)


def test_damaged_and_odd_conversations(spark):
    rows = [(1, t, r, x) for t, r, x in random_rows(random.Random(1), 300)] + [
        (2, None, None, None), (2, None, None, None), (3, 0, "user", "Hi."), (3, 0, "user", "Hi."), (None, 1, "assistant", "x" * 200_000), (4, 2**40, "system", ""),
    ] + [(k, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for k in range(10, 60) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("gone", "conv", "fault", "copy"):
        df = df.withColumn(name, F.lit("clash"))
    hurt, gone = repair.damage(df)
    got = {r["conv"]: tuple(r[c] for c in COLUMNS) for r in repair.repair(hurt, gone=gone).collect()}
    damaged = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        damaged[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == {c: repair_twin(kept) if kept else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, kept in damaged.items()}
    assert repair.repair(df.limit(0)).collect() == []
