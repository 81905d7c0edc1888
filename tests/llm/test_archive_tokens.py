"""WARC bundles and the tokenization automaton by exact round trips."""

from __future__ import annotations

import hashlib
import os
import random

import pytest
import zstandard
from helpers import docs_of, empty_docs, odd_docs
from pyspark.sql import types as T
from wattloom.llm import bpe_automaton, warc
from wattloom.llm.queries import vocabulary_path

VOCABULARY = vocabulary_path("byte_bpe_50k.json")
PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def test_round_trip_and_revisits(spark):
    long = "é" * 60
    rows = [(k, f"http://x/{k}", f"<p>{k}</p>" * (k % 40)) for k in range(200)]
    rows += [(900, "u", long), (700, "u", long), (800, "u", long), (700, "u", long), (1, None, "dup"), (2, "a\r\nb", "dup"), (5000, None, None)]
    archive = warc.bundles(pages(spark, rows), frame_bytes=2_000, bundle_bytes=9_000).cache()
    got = sorted((r["record_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.records(archive).collect())
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = min(p for p, _, h in rows if (h or "") == (html or ""))
        visit = len(data) >= 100 and page != first
        want.append((
            f"<urn:page:{page}>", "revisit" if visit else "response", len(data), hashlib.sha256(data).hexdigest(),
            f"<urn:page:{first}>" if visit else None,
        ))
    assert got == sorted(want)
    files = archive.collect()
    assert len(files) > 2 and all(f["n_frames"] > 1 for f in files[:-1])
    for f in files:  # any reader of .zst files gets all records in order, past the seek table
        whole = zstandard.ZstdDecompressor().stream_reader(bytes(f["data"]), read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == f["n_records"] == len(f["index"])
        place = f["index"][-1]
        record = warc.BundleReader(bytes(f["data"])).read(place["frame"], place["offset"], place["length"])
        assert place["record_id"].encode() in record
    assert warc.index(archive).count() == len(rows)


def test_a_damaged_bundle_is_noticed(spark):
    data = bytearray(warc.bundles(pages(spark, [(1, "u", "abc" * 100)])).first()["data"])
    with pytest.raises(ValueError):
        warc.BundleReader(bytes(data[:-4]) + b"abcd")
    data[20] ^= 255
    reader = warc.BundleReader(bytes(data))
    with pytest.raises(zstandard.ZstdError):
        reader.read(0, 0, 10)


def test_warc_of_odd_and_empty_pages(spark):
    big = "z" * 9_000_000
    rows = [(None, None, None), (None, "u", "q" * 200), (3, "u", "q" * 200), (None, "u", "n" * 200), (2**60 + 1, "u", big), (3, "u", "q" * 200)]
    got = sorted(
        ((r["record_id"], r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.records(warc.bundles(pages(spark, rows))).collect()), key=str
    )
    assert got == sorted([
        ("<urn:page:null>", "response", 0, None), ("<urn:page:null>", "revisit", 200, "<urn:page:3>"), ("<urn:page:3>", "response", 200, None),
        ("<urn:page:3>", "response", 200, None), ("<urn:page:null>", "response", 200, None), (f"<urn:page:{2**60 + 1}>", "response", 9_000_000, None),
    ], key=str)
    assert warc.records(warc.bundles(pages(spark, []))).collect() == []


@pytest.fixture(scope="module")
def automaton():
    return bpe_automaton.load(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


def test_automaton_equals_the_library(automaton, library):
    rng = random.Random(1)
    pool = [" ", "  ", "\n", "\t", "a", "aa", "e", "the", "ing", "é", "ß", "<|endoftext|>", "<|endoftext|", "'s", "'re", "!!", "123", "日本", "\xa0", "\x1c", "🙂", "----", "\r\n", "x" * 50, "ÃÂ"]
    texts = ["", "".join(["ab"] * 500), " " * 300] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(97, 122)] * 6 + [rng.randint(32, 126), rng.randint(160, 767)])) for _ in range(30)) for _ in range(3000)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text) == ids
        assert automaton.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_gadgets_equal_merging_by_rank():
    """Random small vocabularies: the path of the automaton is what merging the lowest rank first gives."""
    rng = random.Random(4)
    for _ in range(60):
        vocabulary, merges = {c: k for k, c in enumerate("abc")}, []
        while len(merges) < 12:
            x, y = rng.choice(list(vocabulary)), rng.choice(list(vocabulary))
            if x + y not in vocabulary and len(x + y) < 7:
                vocabulary[x + y] = len(vocabulary)
                merges.append((x, y))
        built = bpe_automaton.Automaton(vocabulary, merges, {})
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
            parts = list(word)
            for x, y in merges:
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == (x, y):
                        parts[k : k + 2] = [x + y]
                    k += 1
            assert built.word(word.encode()) == tuple(vocabulary[p] for p in parts), (merges, word)


def test_tokens_of_odd_and_empty_tables(spark, library):
    odd = odd_docs(spark)
    rows = bpe_automaton.round_trip(odd, VOCABULARY).collect()
    want = sorted((str(r["doc_id"]), r["text"] or "") for r in odd.select("doc_id", "text").collect())
    assert sorted((str(r["doc"]), r["decoded"]) for r in rows) == want
    assert all(r["ids"] == library.encode(r["decoded"], add_special_tokens=False).ids for r in rows)
    assert bpe_automaton.round_trip(empty_docs(spark), VOCABULARY).collect() == []


def test_unknown_settings_are_refused(tmp_path):
    import json

    with open(VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "NFC"}
    path = os.path.join(tmp_path, "v.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    with pytest.raises(ValueError, match="normalizer"):
        bpe_automaton.load(path)


def test_bytes_that_are_no_text(automaton):
    assert automaton.decode(automaton.word("é".encode()[:1])) == "�"
    assert docs_of is not None
