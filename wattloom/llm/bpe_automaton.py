"""Byte-pair encoding by a tokenization automaton.

The merges are compiled one after another. A merge of x and y into w changes the automaton by one
gadget: the state behind x is split so that it has no arc y any more, and wherever an arc x led to it an arc w leads
to the state behind y. A state is therefore the list of its right parts, each with the rank until which
its removed arcs count, and an arc stands for the list of its left parts, each with the rank until
which it was there to be removed. Every text has exactly one path that spells it, and that path is
its byte-pair encoding; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from wattloom.llm.common import map_texts

# White space and the pre-split pattern of byte-level vocabularies.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
NEVER = 1 << 60
CACHED_WORDS = 300_000
SLICE_BYTES = 2 << 20


def byte_characters() -> dict[str, int]:
    """The printable stand-in of every byte: itself where it is a visible character, else the next free one from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """Compiled merges. ``added`` maps the text of added tokens, found before all else, to their ids."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        as_byte = byte_characters()
        self.labels: dict[int, bytes] = {i: bytes(as_byte[c] for c in t) for t, i in vocabulary.items()}
        self.labels |= {i: t.encode() for t, i in added.items()}
        self.arc_of: dict[bytes, int] = {}
        self.state: dict[int, tuple] = {}
        self.entry: dict[int, tuple] = {}
        self.removed: dict[tuple[int, int], int] = {}
        for c, b in as_byte.items():
            if c in vocabulary:
                self._arc(vocabulary[c], bytes([b]), (), ())
        for rank, (x, y) in enumerate(merges):
            self._merge(rank, vocabulary[x], vocabulary[y], vocabulary[x + y])
        #: Length of the longest arc that begins with two bytes.
        self.reach: dict[bytes, int] = {}
        for label in self.arc_of:
            self.reach[label[:2]] = max(len(label), self.reach.get(label[:2], 1))
        self.added = dict(added)
        self._start()

    def _arc(self, token: int, label: bytes, state: tuple, entry: tuple) -> None:
        if label in self.arc_of:
            raise ValueError(f"two merges make {label!r}")
        self.arc_of[label] = token
        self.state[token] = ((token, NEVER), *state)
        self.entry[token] = ((token, NEVER), *entry)

    def _merge(self, rank: int, x: int, y: int, made: int) -> None:
        if x not in self.state or y not in self.state or not self._leads(x, y):
            return  # no arc x leads to a state with an arc y, so this merge never happens
        self.removed[x, y] = rank
        self._arc(
            made, self.labels[x] + self.labels[y],
            tuple((t, min(until, rank)) for t, until in self.state[y]),
            tuple((t, min(until, rank)) for t, until in self.entry[x]),
        )

    def _start(self) -> None:
        self.table: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(SPLIT).findall
        names = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.words = _Words(self)

    def tables(self) -> dict:
        """What was compiled, in plain types; ``from_tables`` goes on from it without the merges."""
        return {k: getattr(self, k) for k in ("labels", "arc_of", "state", "entry", "removed", "reach", "added")}

    @classmethod
    def from_tables(cls, tables: dict) -> Automaton:
        made = cls.__new__(cls)
        made.__dict__.update(tables)
        made._start()
        return made

    def _leads(self, last: int, token: int) -> bool:
        """The state behind ``last`` has the arc ``token``, as far as gadgets have been added."""
        for x, until in self.state[last]:
            for y, there in self.entry[token]:
                rank = self.removed.get((x, y))
                # at equal ranks the pair further left merges first: inside the left token, not inside the right one
                if rank is not None and rank < until and rank <= there:
                    return False
        return True

    def follows(self, last: int, token: int) -> bool:
        """``_leads`` as an entry of the transition table, filled in when first asked for."""
        known = self.table.get((last, token))
        if known is None:
            if len(self.table) > 4_000_000:
                self.table.clear()
            known = self.table[last, token] = self._leads(last, token)
        return known

    def word(self, data: bytes) -> tuple[int, ...]:
        """Tokens of the one path that spells ``data``.

        Arcs are tried longest first. A path that reaches a place is the only one that does, so a place
        from which no arc leads on is left for good: every place is tried once at most.
        """
        arcs, follows, reach, n = self.arc_of, self.follows, self.reach, len(data)
        path: list[int] = []
        dead: set[int] = set()
        at, most = 0, n
        while at < n:
            length = min(most, n - at, reach.get(data[at : at + 2], 1))
            while length:
                token = arcs.get(data[at : at + length])
                if token is not None and at + length not in dead and (not path or follows(path[-1], token)):
                    break
                length -= 1
            if length:
                path.append(token)
                at, most = at + length, n
            else:
                if not path:
                    raise ValueError("a byte has no token")
                dead.add(at)
                most = len(self.labels[path.pop()])
                at -= most
                most -= 1
        return tuple(path)

    def encode(self, text: str) -> list[int]:
        words = self.words
        if self.cut is None or not any(name in text for name in self.added):
            return list(chain.from_iterable(map(words.__getitem__, self.split(text))))
        out: list[int] = []
        for part in self.cut(text):
            if part in self.added:
                out.append(self.added[part])
            else:
                out.extend(chain.from_iterable(map(words.__getitem__, self.split(part))))
        return out

    def decode(self, ids) -> str:
        """The labels of the arcs; bytes that are no UTF-8 become the replacement character, unknown ids nothing."""
        return b"".join([self.labels.get(i, b"") for i in ids]).decode("utf-8", "replace")


class _Words(dict):
    """Encoded words, looked up at the speed of a dict and forgotten when they are too many."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHED_WORDS:
            self.clear()
        got = self.automaton.word(word.encode("utf-8", "replace"))
        if len(word) <= 64:
            self[word] = got
        return got


def load(path: str) -> Automaton:
    """Automaton of a vocabulary file with byte-level BPE. Options that change the result and aren't built are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    for name, good in (
        ("model type", model.get("type") == "BPE"), ("normalizer", spec.get("normalizer") is None),
        ("pre-tokenizer", pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")),
        ("ignore_merges", not model.get("ignore_merges")), ("dropout", not model.get("dropout")),
    ):
        if not good:
            raise ValueError(f"not supported: {name}")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    added = {}
    for token in spec.get("added_tokens", []):
        if token["single_word"] or token["lstrip"] or token["rstrip"]:
            raise ValueError("not supported: added tokens that take white space or whole words only")
        added[token["content"]] = token["id"]
    return Automaton(model["vocab"], merges, added)


def _both(shared):
    def make():
        # a worker keeps the shared value from task to task, and with it the words it has met
        held = shared.value
        automaton = held.get("automaton") or held.setdefault("automaton", Automaton.from_tables(held["tables"]))

        def work(texts):
            ids, decoded = [], []
            for text in texts:
                got = automaton.encode(text or "")
                ids.append(np.array(got, np.int32))
                decoded.append(automaton.decode(got))
            return {"ids": ids, "decoded": decoded}

        return work

    return make


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, ids, decoded): token ids of every whole text and the text they decode to; null texts are empty. Repeated rows give repeated rows.

    The automaton is compiled once and shipped to the executors; its size follows from the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"tables": load(path).tables()})
    body = docs.selectExpr(f"`{doc_id}` as doc", f"cast(`{text}` as string) as text")
    return map_texts(body, "text", _both(shared), "ids array<int>, decoded string", ["doc"], SLICE_BYTES)
