"""Brown class-based bigrams.

Exchange clustering takes a word out of its class and puts it where the likelihood of the class bigrams becomes
largest. The head of the vocabulary starts it, one word at a time. Then sweeps over the exchange table follow, which
holds every word met ``EXCHANGED_TIMES`` times or more, up to ``PLACED_WORDS`` of them: every task moves its words by
their whole neighbourhoods and by its own copy of the class table, and a sweep counts if the likelihood of the whole
corpus rose. The first sweep places all words, each later one moves every second word, so that words don't chase each
other. Every further word that occurs ``PLACED_TIMES`` times or more makes one move, to the class that its neighbours
speak for; fewer occurrences would overfit in an exchange. Words met less often, and words without neighbours in
the table, go to the class that words of the same ending belong to most. A text's probability is the product of
class transitions and of word emissions from the class.

All counts come from the whole training corpus, as Spark aggregations of what each task has combined.
Tables of the most frequent words are bounded by parameters and shipped to the tasks; the counts and classes of
all other words stay distributed and meet the texts in a join. Ties in frequency go to the smaller word, ties in
gain to the class with the smaller number. Ids are only passed through, so null and repeated ids are rows like any other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom.llm.common import held_out
from wattloom.session import materialize

END = ""
#: Words with shipped counts; words of the exchange table; words of the head that starts it; classes besides the end's.
KNOWN_WORDS, PLACED_WORDS, CLUSTERED_WORDS, CLASSES = 100_000, 100_000, 1_000, 48
#: Sweeps over the exchange table; words of a task that move by one state of its class table.
SWEEPS, BLOCK = 4, 64
#: Words met less often than this make one move only; words met less often than that go by their ending.
EXCHANGED_TIMES, PLACED_TIMES = 5, 2
FLUSH = 400_000
#: Words that travel together; tokens of the corpus for each lot of words, at least.
GROUP, LOT = 64, 150_000
#: Bytes of text that are worked on at once.
RUN = 4 << 20
ADD = 0.1


def runs_of(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Texts in a row, each closed by END, with END before the first: the distinct tokens, the run as places among them, and
    where the texts' ends stand. A run has about ``RUN`` bytes. Arrow's ASCII functions know the contract's white space and
    lower-case A-Z, and leave every other character alone."""
    step = max(1, int(len(texts) * min(1.0, RUN / max(1, texts.nbytes))))
    for first in range(0, len(texts), step):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.slice(first, step), END)))
        coded = lists.flatten().dictionary_encode()
        words, place = coded.dictionary, coded.indices.to_numpy()
        end = pc.index(words, END).as_py()  # white space at a text's border leaves an empty string
        if end < 0:
            words, end = pa.concat_arrays([words, pa.array([END], words.type)]), len(words)
        use = place != end
        owner, place = _owner(lists)[use], place[use]
        ends = np.cumsum(np.bincount(owner, minlength=len(lists)) + 1)
        seq = np.full(ends[-1] + 1, end, np.int64)
        seq[1 + np.arange(len(place)) + owner] = place
        yield words, seq, ends


def _codes(number: dict[str, int], other: int):
    """A function from an array of words to their numbers, ``other`` where a word has none."""
    known, value = pa.array(list(number), pa.string()), np.append(np.fromiter(number.values(), np.int64, len(number)), other)

    def of(words: pa.Array) -> np.ndarray:
        return value[pc.index_in(words, value_set=known).fill_null(len(known)).to_numpy()]

    return of


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n), combined within the task as far as ``FLUSH`` words go."""
    found, held = [], 0

    def joined():
        coded = pa.concat_arrays([w for w, _ in found]).dictionary_encode()
        n = np.bincount(coded.indices.to_numpy(), np.concatenate([n for _, n in found]), len(coded.dictionary))
        return coded.dictionary, n.astype(np.int64)

    for batch in batches:
        for words, seq, _ in runs_of(batch.column(0)):
            found.append((words, np.bincount(seq[1:], minlength=len(words))))
            held += len(words)
            if held > 2 * FLUSH:
                found = [joined()]
                held = len(found[0][0])
                if held > FLUSH:
                    yield pa.RecordBatch.from_arrays([found[0][0], pa.array(found[0][1])], names=["word", "n"])
                    found, held = [], 0
    if found:
        yield pa.RecordBatch.from_arrays([(last := joined())[0], pa.array(last[1])], names=["word", "n"])


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([f[1] for f in found]), len(keys)).astype(np.int64)


def _count_pairs(number: dict[str, int], other: int, keys: np.ndarray):
    """(key, pair, n): neighbouring tokens by their numbers, a << 31 | b, combined within the task as far as ``10 * FLUSH``
    tokens go. The pairs of a row are those that fall to its key.

    Words without a number count as ``other``, texts begin and end with END.
    """

    def rows(found):
        whole = np.concatenate(found)
        found.clear()
        whole.sort()
        at = np.flatnonzero(np.append(True, whole[1:] != whole[:-1]))
        pairs, n = whole[at], np.diff(np.append(at, len(whole))).astype(np.int32)
        del whole, at
        # a plain mix of both numbers, so that no key has all pairs of a frequent word
        part = ((pairs >> 31) * 40_503 + (pairs & (1 << 31) - 1) * 2_654_435_761 >> 9) % len(keys)
        order = np.argsort(part.astype(np.uint16) if len(keys) < 1 << 16 else part, kind="stable")
        size = np.bincount(part, minlength=len(keys))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), _packed(size, pairs[order]), _packed(size, n[order])], names=["key", "pair", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, codes = [], 0, _codes(number, other)
        for batch in batches:
            for words, seq, _ in runs_of(batch.column(0)):
                seq = codes(words)[seq]
                found.append((seq[:-1] << 31) + seq[1:])
                held += len(seq)
                if held > 10 * FLUSH:
                    yield rows(found)
                    found, held = [], 0
        if found:
            yield rows(found)

    return run


def _packed(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    """Numbers in a row become one binary value for each length; ``_unpacked`` joins them again."""
    ends = np.cumsum(lengths).tolist()
    return pa.array([values[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _sides(lot: np.ndarray, group: np.ndarray, first: np.ndarray, other: int):
    """(lot, key, word, near, n): the pairs of a task, added up, go to both of their words; ``near`` is twice the other word's
    number, plus 1 if it follows. Words travel in groups; ``first`` is a group's first word, its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, most = [], 0, 10 * FLUSH
        for batch in batches:
            pairs, n = _unpacked(batch.column(1), np.int64), _unpacked(batch.column(2), np.int32)
            found.append((pairs, n))
            held += len(pairs)
            if held > most:
                found = [_summed(found)]
                held = len(found[0][0])
                most = max(most, 2 * held)
        if held:
            pairs, n = _summed(found)
            found.clear()
            a, b = (pairs >> 31).astype(np.int32), (pairs & (1 << 31) - 1).astype(np.int32)
            use = b < other
            word, near, n = np.append(a, b[use]), np.append(2 * b + 1, 2 * a[use]), np.append(n, n[use])
            del pairs, a, b, use
            owner = group[word]
            order = np.argsort(owner.astype(np.uint16) if len(first) < 1 << 16 else owner, kind="stable")
            size = np.bincount(owner, minlength=len(first))
            met = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([
                pa.array(lot[first[met]]), pa.array(first[met]), _packed(size[met], word[order]),
                _packed(size[met], near[order]), _packed(size[met], n[order]),
            ], names=["lot", "key", "word", "near", "n"])

    return run


BESIDE = "word int, before array<int>, before_n array<long>, after array<int>, after_n array<long>"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_sides`` in order of the key become one row a word, in order: what stands before it and after it."""
    for batch in _whole_keys(batches, "key"):
        word, near, n = (_unpacked(batch.column(c), kind) for c, kind in ((2, np.int32), (3, np.int32), (4, np.int64)))
        order = np.argsort((word.astype(np.int64) << 32) + near)
        word, near, n = word[order], near[order], n[order]
        at = np.append(True, word[1:] != word[:-1])
        owner, size, follows = np.cumsum(at) - 1, int(at.sum()), near % 2 == 1
        out = [pa.array(word[at])]
        for use in (~follows, follows):
            lengths = np.bincount(owner[use], minlength=size)
            out += [_ragged(lengths, pa.array(near[use] >> 1)), _ragged(lengths, pa.array(n[use]))]
        yield pa.RecordBatch.from_arrays(out, names=["word", "before", "before_n", "after", "after_n"])


def neighbourhoods(body: DataFrame, number: dict[str, int], other: int, tokens: int = 0) -> DataFrame:
    """``BESIDE`` of every numbered token. A pair is summed before it goes to its two words, so a frequent word is no hot
    key: its row has at most one entry for each token of the table and side. What stands before ``other`` and END is left out.

    Pairs travel packed: those of a task that go the same way share a row. Words are dealt to tasks by Spark's hash, in as
    many lots as there are shuffle partitions, or fewer where a lot would have less than ``LOT`` of the corpus' ``tokens``.
    """
    spark, size = body.sparkSession, other + 2
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lots = max(1, min(most, tokens // LOT))
    dealt = spark.range(max(size, 64 * most)).select("id", F.hash(F.col("id").cast("int")).alias("hash")).toPandas()
    dealt = dealt.sort_values("id")["hash"].to_numpy(np.int64)
    # numbers that Spark deals to different partitions
    keys, ways = (np.unique(dealt % n, return_index=True)[1].astype(np.int32) for n in (most, lots))
    lot = dealt[:size] % most * lots // most
    order = np.lexsort((np.arange(size), lot))
    place = np.arange(size) - np.searchsorted(lot[order], lot[order])
    begins = np.append(True, (np.diff(lot[order]) != 0) | (place[1:] % GROUP == 0))
    group = np.zeros(size, np.int64)
    group[order] = np.cumsum(begins) - 1
    first = order[begins].astype(np.int32)
    pairs = body.mapInArrow(_count_pairs(number, other, keys), "key int, pair binary, n binary").repartition("key")
    sides = pairs.mapInArrow(_sides(ways[lot % len(ways)], group, first, other), "lot int, key int, word binary, near binary, n binary")
    sides = sides.repartition(lots, "lot").sortWithinPartitions("key")
    return materialize(sides.mapInArrow(_lists, BESIDE), "lm-beside")


def _owner(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def fold(beside: DataFrame, group: np.ndarray, size: int) -> np.ndarray:
    """Bigram counts between groups of tokens, ``group`` by token number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size)
        for batch in batches:
            word, after, n = batch.columns
            cell = group[word.to_numpy()[_owner(after)]] * size + group[after.flatten().to_numpy()]
            total += np.bincount(cell, n.flatten().to_numpy(), size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["cell", "n"])

    got = beside.select("word", "after", "after_n").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(size * size)
    table[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return table.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def likelihood(table: np.ndarray) -> float:
    """What exchange raises: sum N(g,h) log N(g,h) - sum N(g) log N(g) over left and right."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def gains(table: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, old: np.ndarray) -> np.ndarray:
    """(word, class): the likelihood with the word in the class, less that without the word.

    ``left`` and ``right`` say how often classes stand before and after each word, pairs of the word with itself (``own``)
    left out; ``table`` has every word in its class ``old``.
    """
    m = np.arange(len(old))
    bare = np.repeat(table[None], len(old), axis=0)
    bare[m, :, old] -= left
    bare[m, old, :] -= right
    bare[m, old, old] -= own
    # logarithms only of cells that change: row and column of the old class, then where a class stands beside the word
    base = np.repeat(_xlogx(table)[None], len(old), axis=0)
    base[m, :, old], base[m, old, :] = _xlogx(bare[m, :, old]), _xlogx(bare[m, old, :])
    # column g gains left, row g gains right, the corner gains both and own
    more = np.zeros_like(base)
    w, h = np.nonzero(left)
    more[w, h, :] = _xlogx(bare[w, h, :] + left[w, h, None]) - base[w, h, :]
    gain = more.sum(axis=1)
    more[:] = 0
    w, h = np.nonzero(right)
    more[w, :, h] = _xlogx(bare[w, :, h] + right[w, h, None]) - base[w, :, h]
    gain = gain + more.sum(axis=2)
    corner, own = np.diagonal(bare, axis1=1, axis2=2), own[:, None]
    gain += _xlogx(corner + left + right + own) - _xlogx(corner + left) - _xlogx(corner + right) + _xlogx(corner)
    # totals of all other words' tokens, those beside the word included
    rows, cols = bare.sum(axis=2) + left, bare.sum(axis=1) + right
    r, c = right.sum(axis=1, keepdims=True) + own, left.sum(axis=1, keepdims=True) + own
    return gain - (_xlogx(rows + r) - _xlogx(rows) + _xlogx(cols + c) - _xlogx(cols))


def _move(table: np.ndarray, left: np.ndarray, right: np.ndarray, own: float, old: int, new: int) -> None:
    for g, sign in ((old, -1), (new, 1)):
        table[:, g] += sign * left
        table[g, :] += sign * right
        table[g, g] += sign * own


def exchange(pairs: np.ndarray, classes: int, fixed: int, sweeps: int = 12) -> np.ndarray:
    """Classes of words from their bigram counts (a square matrix), one move at a time.

    The last ``fixed`` words keep classes of their own, numbered from ``classes`` on. Words start dealt
    out by frequency.
    """
    n = len(pairs)
    label = np.arange(n) % classes
    label[n - fixed :] = classes + np.arange(fixed)
    k = classes + fixed
    hot = np.eye(k)[label]
    table = hot.T @ pairs @ hot
    for _ in range(sweeps):
        moved = 0
        into, out = pairs.T @ np.eye(k)[label], pairs @ np.eye(k)[label]  # per word: from classes, to classes
        for w in range(n - fixed):
            old, own = label[w], pairs[w, w]
            left, right = into[w].copy(), out[w].copy()
            left[old] -= own
            right[old] -= own
            new = int(gains(table, left[None], right[None], np.array([own]), np.array([old]))[0, :classes].argmax())
            if new != old:
                _move(table, left, right, own, old, new)
                moved += 1
                label[w] = new
                into[:, old] -= pairs[w, :]
                into[:, new] += pairs[w, :]
                out[:, old] -= pairs[:, w]
                out[:, new] += pairs[:, w]
        if not moved:
            break
    return label


def _sweep(label: np.ndarray, table: np.ndarray, classes: int):
    """(word, g): each word's best class. A task moves ``BLOCK`` words by one state of its own copy of the class table."""
    k = len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = table.copy()
        for batch in batches:
            word, size = batch.column(0).to_numpy(), batch.num_rows
            around, own = [], np.zeros(size)
            for lists, n in ((batch.column(1), batch.column(2)), (batch.column(3), batch.column(4))):
                row, near, times = _owner(lists), lists.flatten().to_numpy(), n.flatten().to_numpy()
                itself = near == word[row]
                own[row[itself]] = times[itself]
                row, near, times = row[~itself], near[~itself], times[~itself]
                around.append(np.bincount(row * k + label[near], times, size * k).reshape(size, k))
            left, right = around
            old = label[word].astype(np.int64)
            new = old.copy()
            for at in range(0, size, BLOCK):
                cut = slice(at, at + BLOCK)
                new[cut] = gains(mine, left[cut], right[cut], own[cut], old[cut])[:, :classes].argmax(axis=1)
                for w in (np.flatnonzero(new[cut] != old[cut]) + at).tolist():
                    _move(mine, left[w], right[w], own[w], old[w], new[w])
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(new.astype(np.int32))], names=["word", "g"])

    return run


def exchange_all(beside: DataFrame, label: np.ndarray, classes: int, fixed: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Classes by token number after sweeps over all words but the last ``fixed`` tokens, and the table of class bigrams.

    ``label`` says where the words start. A sweep that doesn't raise the likelihood is taken back and is the last.
    """
    k, words = classes + fixed, len(label) - fixed
    table = fold(beside, label, k)
    for sweep in range(sweeps if words else 0):
        mine = F.col("word") < words
        if sweep:
            mine &= (F.col("word") + sweep) % 2 == 0
        got = beside.where(mine).mapInArrow(_sweep(label, table, classes), "word int, g int").toPandas()
        new = label.copy()
        new[got["word"].to_numpy(np.int64)] = got["g"].to_numpy(np.int64)
        after = fold(beside, new, k)
        if likelihood(after) <= likelihood(table):
            break
        label, table = new, after
    return label, table


def ending(word: str) -> str:
    return word[-3:]


class Classes:
    """Classes that a task knows: of shipped words by table, and for words that no class is stored for by their ending."""

    def __init__(self, of_word: dict[str, int], of_ending: dict[str, int], rest: int):
        self.of_word, self.of_ending, self.rest = of_word, of_ending, rest

    def of(self, word: str) -> int:
        got = self.of_word.get(word)
        return self.of_ending.get(ending(word), self.rest) if got is None else got

    def by_ending(self, words: pa.Array) -> np.ndarray:
        """The same for many words, none of which has a table entry."""
        ends = pc.utf8_slice_codeunits(words, -3).dictionary_encode()
        g = np.array([self.of_ending.get(e, self.rest) for e in ends.dictionary.to_pylist()], np.int64)
        return g[ends.indices.to_numpy()]


def _whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches in order of the key, cut anew so that all rows of a key lie in one; rows without a key may part."""
    kept = None
    for batch in batches:
        if kept is not None:
            batch = pa.concat_batches([kept, batch])
        col = batch.column(batch.schema.get_field_index(key))
        cut = batch.num_rows
        if cut and col[-1].is_valid:
            cut -= pc.sum(pc.equal(col, col[-1])).as_py()
        if cut:
            yield batch.slice(0, cut)
        kept = batch.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept


def _ragged(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)


STEPS = "part int, word string, n long, slots array<int>, slot_n array<long>, after array<string>, after_n array<long>"


def _steps(of_word: dict[str, int], k: int):
    """What each word outside the table has beside it, combined within the task as far as ``4 * FLUSH`` pairs go.

    ``slots`` holds the class before the word, or k + the class after it; ``after`` the words outside the table that
    follow it. The row without a word has the transitions g * k + h between words of the table.
    """

    def rows(number, keys, counts, times, part):
        words = pa.array(list(number), pa.string())
        ids, slots = keys >> 31, keys & (1 << 31) - 1
        known = slots < 2 * k
        size = len(number)
        per = lambda use, values: _ragged(np.bincount(ids[use], minlength=size), values)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(size, part), pa.int32()), words, pa.array(times),
            per(known, pa.array(slots[known], pa.int32())), per(known, pa.array(counts[known])),
            per(~known, words.take(pa.array(slots[~known] - 2 * k))), per(~known, pa.array(counts[~known])),
        ], names=["part", "word", "n", "slots", "slot_n", "after", "after_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(k * k, np.int64)
        number: dict[str, int] = {}
        codes = _codes(of_word, -1)
        times, found, held = np.zeros(0, np.int64), [], 0
        for batch in batches:
            for words, seq, _ in runs_of(batch.column(0)):
                code = codes(words)
                new = np.flatnonzero(code < 0)
                code[new] = [-1 - number.setdefault(w, len(number)) for w in words.take(pa.array(new)).to_pylist()]
                seq = code[seq]
                ids = -1 - seq[seq < 0]
                more = np.bincount(ids, minlength=len(number))
                more[: len(times)] += times
                times = more
                a, b = seq[:-1], seq[1:]
                both = (a >= 0) & (b >= 0)
                table += np.bincount(a[both] * k + b[both], minlength=k * k)
                first, second = a < 0, (a >= 0) & (b < 0)
                keys = np.concatenate([
                    (-1 - a[first] << 31) + np.where(b[first] < 0, 2 * k - 1 - b[first], k + b[first]), (-1 - b[second] << 31) + a[second],
                ])
                found.append(np.unique(keys, return_counts=True))
                held += len(found[-1][0])
                if held > 4 * FLUSH or len(number) > FLUSH:
                    found = [_summed(found)]
                    held = len(found[0][0])
                    if held > 2 * FLUSH or len(number) > FLUSH:
                        yield rows(number, *found[0], times, -1)
                        number, times, found, held = {}, np.zeros(0, np.int64), [], 0
        if number:
            yield rows(number, *_summed(found), times, -1)
        at = np.flatnonzero(table)
        none = np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([None], pa.string()), pa.array([0], pa.int64()),
            _ragged(np.array([len(at)]), pa.array(at, pa.int32())), _ragged(np.array([len(at)]), pa.array(table[at])),
            _ragged(none, pa.array([], pa.string())), _ragged(none, pa.array([], pa.int64())),
        ], names=["part", "word", "n", "slots", "slot_n", "after", "after_n"])

    return run


SETTLED = "word string, n long, g int, step int, shipped boolean"
PLACED, FOLLOWS = -1, -2


def _settle(classes: Classes, speaks: np.ndarray, k: int, shipped: list[str]):
    """Classes of words from what stands beside them (step ``PLACED``), and transitions that follow from them.

    Rows come in order of the word, so what tasks have counted of a word is added up here.
    Rows with a step of 0 or more are transitions g * k + h, added up within the task. A row with ``FOLLOWS`` says
    how often the word follows words of class g outside the table. ``shipped`` marks words whose counts are shipped though
    they are outside the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        known = pa.array(shipped, pa.string())
        for batch in _whole_keys(batches, "word"):
            col = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            slot_lists, after_lists = col("slots"), col("after")
            slots, slot_n = slot_lists.flatten().to_numpy(), col("slot_n").flatten().to_numpy()
            coded = col("word").dictionary_encode("encode")
            word, of = coded.dictionary, coded.indices.to_numpy()
            n, is_table = np.bincount(of, col("n").to_numpy(), len(word)).astype(np.int64), np.asarray(word.is_null())
            row = of[_owner(slot_lists)]
            of_table = is_table[row]
            total += np.bincount(slots[of_table], slot_n[of_table], k * k).astype(np.int64)
            row, slots, slot_n = row[~of_table], slots[~of_table], slot_n[~of_table]
            beside = np.bincount(row * (2 * k) + slots, slot_n, len(n) * 2 * k).reshape(len(n), 2 * k)
            g = (beside @ speaks).argmax(axis=1)
            at = np.flatnonzero(~is_table & ((n < PLACED_TIMES) | ~beside.any(axis=1)))
            g[at] = classes.by_ending(word.take(pa.array(at)))
            before = slots < k
            steps = np.where(before, slots * k + g[row], g[row] * k + slots - k)
            total += np.bincount(steps, slot_n, k * k).astype(np.int64)
            use = np.flatnonzero(~is_table)
            after = after_lists.flatten()
            settled = pa.concat_arrays([word.take(pa.array(use)), after])
            yield pa.RecordBatch.from_arrays([
                settled, pa.concat_arrays([pa.array(n[use]), col("after_n").flatten()]),
                pa.array(np.append(g[use], g[of[_owner(after_lists)]]), pa.int32()),
                pa.array(np.repeat([PLACED, FOLLOWS], [len(use), len(after)]), pa.int32()), pc.is_in(settled, value_set=known),
            ], names=["word", "n", "g", "step", "shipped"])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(at), pa.string()), pa.array(total[at]), pa.nulls(len(at), pa.int32()), pa.array(at, pa.int32()), pa.nulls(len(at), pa.bool_()),
        ], names=["word", "n", "g", "step", "shipped"])

    return run


BODY = ["n_tokens", "n_known", "path", "sure", "guess", "left", "right"]


def _bend(transition: np.ndarray, room: np.ndarray, k: int, doc: T.StructField):
    """Texts in order of their row, each beside its words that the join found: (doc, n_tokens, n_known, counts, path).

    Steps at such words take the classes that came by the join, or by their ending (``guess``) where none came.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches, "row"):
            is_text = batch.column(batch.schema.get_field_index("body")).is_valid()
            texts, found = batch.filter(is_text), batch.filter(pc.invert(is_text))
            body = dict(zip(["doc", *BODY], texts.column(texts.schema.get_field_index("body")).flatten(), strict=True))
            plain = lambda part, name: part.column(part.schema.get_field_index(name)).to_numpy()
            flat = lambda name: body[name].flatten().to_numpy().astype(np.int64)  # noqa: E731, B023
            size = texts.num_rows
            owner = np.searchsorted(plain(texts, "row"), plain(found, "row"))
            g, sizes = flat("guess"), body["guess"].value_lengths().to_numpy().astype(np.int64)
            begins = np.cumsum(sizes) - sizes
            met = plain(found, "met")
            g[begins[owner] + met // k] = met % k
            row = np.repeat(np.arange(size), body["left"].value_lengths().to_numpy())
            a, b = flat("left"), flat("right")
            for x in (a, b):
                at = np.flatnonzero(x < 0)
                x[at] = g[begins[row[at]] - 1 - x[at]]
            path = body["path"].to_numpy() + np.bincount(row, transition[a, b] - room[b], size)
            counts = body["sure"].to_numpy() + np.bincount(owner, plain(found, "more"), size)
            known = body["n_known"].to_numpy() + np.bincount(owner, plain(found, "times"), size).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [body["doc"], body["n_tokens"], *map(pa.array, (known, counts, path))], names=["doc", "n_tokens", "n_known", "counts", "path"]
            )

    return run, T.StructType([doc, *T.StructType.fromDDL("n_tokens long, n_known long, counts double, path double")])


SCORED = (
    "n_tokens long, n_known long, path double, sure double, words array<string>, times array<long>, "
    "guess array<int>, left array<int>, right array<int>"
)


def _score(classes: Classes, counts: dict[str, int], transition: np.ndarray, room: np.ndarray):
    """Per text: what needs no join (``sure`` takes words without a shipped count for unseen), the words whose counts and
    classes are not shipped, with how often they stand in it, and the steps at them: classes before and after, or -1 - the word's place in the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = len(counts)
        codes = _codes({w: v for v, w in enumerate(counts)}, other)
        end_log, end_known = float(np.log10(counts.get(END, 0) + ADD)), int(END in counts)
        logs = np.log10(np.fromiter(counts.values(), float, other) + ADD)
        class_of = np.fromiter(map(classes.of, counts), np.int64, other)
        # the last entries stand for words without a number
        logs, class_of = np.append(logs, np.log10(ADD)), np.append(class_of, classes.rest)
        for batch in batches:
            at_row = 0
            for words, seq, ends in runs_of(batch.column(1)):
                docs, size = batch.column(0).slice(at_row, len(ends)), len(ends)
                at_row += size
                code = codes(words)
                starts = np.append(0, ends[:-1])
                # the end token is counted apart, since it may have no number
                closing = np.zeros(len(seq), bool)
                closing[ends] = closing[0] = True
                known = code[seq]
                count_logs = logs[known]
                count_logs[closing] = 0.0
                is_open = (known == other) & ~closing
                around = class_of[known]
                around[closing] = classes.of(END)
                bent = is_open[:-1] | is_open[1:]
                steps = np.where(bent, 0.0, transition[around[:-1], around[1:]] - room[around[1:]])
                # distinct open words of each text, and where each open token's word stands among them
                opened = np.flatnonzero(is_open)
                keys, place, times = np.unique(
                    (np.searchsorted(ends, opened) << 32) + seq[opened], return_inverse=True, return_counts=True
                )
                text, word = keys >> 32, keys & (1 << 32) - 1
                n_words, n_distinct = ends - starts - 1, np.bincount(text, minlength=size)
                around[opened] = -1 - (place - (np.cumsum(n_distinct) - n_distinct)[text[place]])
                at_open = np.unique(word)
                guess = np.zeros(len(words), np.int32)
                guess[at_open] = classes.by_ending(words.take(pa.array(at_open)))
                at_bent = np.flatnonzero(bent)
                n_bent = np.diff(np.searchsorted(at_bent, np.append(starts, len(bent))))
                yield pa.RecordBatch.from_arrays([
                    docs, pa.array(n_words + 1), pa.array(n_words - np.bincount(text[place], minlength=size) + end_known),
                    pa.array(np.add.reduceat(steps, starts)), pa.array(np.add.reduceat(count_logs, starts) + end_log),
                    _ragged(n_distinct, words.take(pa.array(word))), _ragged(n_distinct, pa.array(times)), _ragged(n_distinct, pa.array(guess[word])),
                    *(_ragged(n_bent, pa.array(around[at_bent + after], pa.int32())) for after in (0, 1)),
                ], names=["doc", *(c.split()[0] for c in SCORED.split(", "))])

    return run


class Model:
    """Bounded tables (frequent words, endings, class transitions) and the distributed table of all words: word, n, class g, shipped."""

    def __init__(self, classes: Classes, counts: dict[str, int], words: DataFrame, transition: np.ndarray, room: np.ndarray, total: int, distinct: int):
        self.classes, self.counts, self.words = classes, counts, words
        self.transition, self.room, self.total, self.distinct = transition, room, total, distinct

    def score(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc, n_tokens, n_known, base_score, score): one row per row of ``docs``; null texts are one end token."""
        body = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
        k = len(self.room)
        schema = T.StructType([body.schema["doc"], *T.StructType.fromDDL(SCORED)])
        parts = body.mapInArrow(_score(self.classes, self.counts, self.transition, self.room), schema)
        parts = materialize(parts.withColumn("row", F.monotonically_increasing_id()), "lm-parts")
        open_words = parts.select("row", F.posexplode(F.arrays_zip("words", "times")).alias("i", "w"))
        open_words = open_words.select("row", "i", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
        rare = self.words.where(~F.col("shipped")).select("word", "n", "g")
        seen = F.col("times") * (F.log10(F.col("n") + F.lit(ADD)) - F.lit(float(np.log10(ADD))))
        found = open_words.join(rare, "word").select("row", (F.col("i").cast("long") * k + F.col("g")).alias("met"), "times", seen.alias("more"))
        # texts and what was found for them meet in order of the row
        both = parts.select("row", F.struct("doc", *BODY).alias("body")).unionByName(found, allowMissingColumns=True)
        both = both.repartition("row").sortWithinPartitions("row").mapInArrow(*_bend(self.transition, self.room, k, body.schema["doc"]))
        log_all = float(np.log10(self.total + ADD * (self.distinct + 1)))
        return both.select(
            "doc", "n_tokens", "n_known", (F.col("counts") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
            (F.col("counts") + F.col("path")).alias("score"),
        )


def fit(
    train: DataFrame, text: str = "text", known_words: int = KNOWN_WORDS, placed_words: int = PLACED_WORDS,
    clustered_words: int = CLUSTERED_WORDS, n_classes: int = CLASSES, exchanged_times: int = EXCHANGED_TIMES,
) -> Model:
    """Learn from every text of ``train``. Without any text every token is unknown."""
    spark = train.sparkSession
    body = train.select(F.col(text).cast("string").alias("text"))
    words = materialize(
        body.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words"
    )
    size = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == END, F.col("n"))).alias("end")).first()
    total, distinct = size["n"] or 0, size["v"]
    ranked = [(r["word"], r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(known_words).collect()]
    counts = dict(ranked) | ({END: size["end"]} if size["end"] else {})
    table_words = [w for w, n in ranked if w != END and n >= exchanged_times][:placed_words]
    other, end = len(table_words), len(table_words) + 1
    number = {w: v for v, w in enumerate(table_words)} | {END: end}
    beside = neighbourhoods(body, number, other, total)

    # the head, one move at a time: a square of bounded size, all other words in a class of their own
    head = min(clustered_words, other)
    group = np.minimum(np.arange(other + 2), head)
    group[end] = head + 1
    begin = exchange(fold(beside, group, head + 2), n_classes, 2)
    k = n_classes + 2  # the end has a class of its own, and so have the words outside the table
    label, table = exchange_all(beside, begin[group], n_classes, 2)
    of_word = {w: int(label[v]) for w, v in number.items()}
    table = table + 0.5
    affinity = np.log(table * table.sum() / table.sum(axis=1)[:, None] / table.sum(axis=0)[None, :])

    by_ending: dict[str, Counter] = {}
    for w, g in of_word.items():
        if w != END:
            by_ending.setdefault(ending(w), Counter())[g] += 1
    of_ending = {e: min(c, key=lambda g: (-c[g], g)) for e, c in by_ending.items()}
    classes = Classes(of_word, of_ending, n_classes)

    # all other words by their neighbours too, keyed by word; class transitions come along
    speaks = np.concatenate([affinity, affinity.T])[:, :n_classes]
    beside = body.mapInArrow(_steps(of_word, k), STEPS).repartition("word", "part").sortWithinPartitions("word")
    shipped = [w for w in counts if w not in of_word]
    settled = materialize(beside.mapInArrow(_settle(classes, speaks, k, shipped), SETTLED), "lm-settled")
    open_words = settled.where(F.col("step") == PLACED).select("word", "n", "g", "shipped")
    follows = settled.where(F.col("step") == FOLLOWS).groupBy("word", F.col("g").alias("a")).agg(F.sum("n").alias("n"))
    follows = follows.join(open_words.select("word", "g"), "word").select((F.col("a") * k + F.col("g")).alias("step"), "n")
    steps = settled.where(F.col("step") >= 0).select("step", "n").unionByName(follows)
    steps = steps.groupBy("step").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(k * k)
    table[steps["step"].to_numpy(np.int64)] = steps["n"].to_numpy(float)
    table = table.reshape(k, k)
    prior = (table.sum(axis=0) + 1) / (table.sum() + k)
    strength = 5.0
    transition = np.log10((table + strength * prior) / (table.sum(axis=1, keepdims=True) + strength))

    # emission: (c(w) + ADD) / (C(g) + ADD (V(g) + 1)), so each class keeps room for one unknown word
    in_table = {w: counts[w] for w in of_word if w in counts}
    in_table = pd.DataFrame({"word": list(in_table), "n": list(in_table.values()), "g": [of_word[w] for w in in_table], "shipped": True})
    words = spark.createDataFrame(in_table, "word string, n long, g int, shipped boolean").unionByName(open_words)
    per_class = words.groupBy("g").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    room = np.full(k, np.log10(ADD))
    for r in per_class.collect():
        room[r["g"]] = np.log10(r["n"] + ADD * (r["v"] + 1))
    of_word = of_word | {r["word"]: r["g"] for r in open_words.where("shipped").select("word", "g").collect()}
    return Model(Classes(of_word, of_ending, n_classes), counts, words, transition, room, total, distinct)


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 10) -> DataFrame:
    """Learn from the documents that are not held out, score all: adds held_out and train_tokens to ``Model.score``."""
    model = fit(docs.where(~held_out(doc_id, modulus)), text)
    return model.score(docs, doc_id, text).select(
        "doc", held_out("doc", modulus).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
