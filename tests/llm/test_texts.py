import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalsieve.llm import bpe
from signalsieve.llm.bpe import Bpe, encode_documents
from signalsieve.llm.huffman import STRIDE, Codebook, code_lengths
from signalsieve.llm.licenses import BASE_PHRASES, scan
from signalsieve.llm.queries import digests, vocabulary
from signalsieve.llm.separator_scan import scan_flat_files, token_counts
from signalsieve.llm.token_files import read_token_files, write_token_files
from signalsieve.llm.token_ids import LibraryIds
from tests.llm.conftest import make


@pytest.fixture(scope="module")
def spec():
    return vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


ODD = "aAbBé ÉΣσςİıßẞ²½Ⅷ٣中文'sdtrevmĺ  \x1c\x85\n😀KÅ_-​　﻿\x00ǅﬁ"


def test_bpe_equals_the_library(spec, library):
    own, rnd = Bpe(spec), random.Random(1)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    texts += [f"{a}<|endoftext|>{b}<|startoftext|><|endoftext|>" for a, b in zip(texts[:200], texts[200:400])]
    cached = LibraryIds(spec, special_as_text=False)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(cached.ids([text])[0], cached.kind).tolist() == ids


def test_long_words_merge_alike(spec, library):
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(5000))
    assert Bpe(spec).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_caches_of_a_worker_stay_small(spec, monkeypatch):
    own, texts = Bpe(spec), [" ".join(f"W{k}x{'qzjk'[k % 4]}{i}," for k in range(100)) for i in range(200)]
    own.encode("a")
    tracemalloc.start()
    own.encode_texts(texts)
    own.encode("a")
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held / 20_000 < 200  # bytes per run; with decoded strings 282

    monkeypatch.setattr(bpe, "CACHED", 300)
    small = Bpe(spec)
    assert [small.encode(t) for t in texts] == [own.encode(t) for t in texts]
    assert all(len(c.young) + len(c.old) <= 2 * (300 + 100) for c in (small._pieces, small._words))


def test_encoded_documents(spec, library, edge_docs, edge_rows, no_docs):
    got = encode_documents(edge_docs.select("doc_id", "text", "ids"), spec)
    expected = sorted((r[0] or -1, library.encode(r[1] or "", add_special_tokens=False).ids) for r in edge_rows)
    assert sorted((r.doc_id or -1, r.ids) for r in got.collect()) == expected
    assert digests(encode_documents(no_docs.select("doc_id", "text"), spec)).count() == 0


def test_token_files_round_trip(spark, spec, library, edge_docs, edge_rows):
    path = write_token_files(edge_docs, spec, end=2)
    rows = read_token_files(spark, path).collect()
    expected = sorted((r[0] or -1, library.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in edge_rows)
    assert sorted((r.doc_id or -1, r.ids) for r in rows) == expected
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids)
    assert [r.doc_id or -1 for r in sorted(rows, key=lambda r: r.start)] == sorted(r[0] or -1 for r in edge_rows)
    crcs = {(r.start, r.ids_crc32, r.n_tokens) for r in read_token_files(spark, path, digest=True).collect()}
    assert crcs == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes()), len(r.ids)) for r in rows}


def test_token_files_of_no_documents(spark, spec, no_docs):
    assert read_token_files(spark, write_token_files(no_docs, spec)).count() == 0


def test_huffman_is_optimal_canonical_and_limited():
    rnd = np.random.default_rng(1)
    for n, limit in ((2, 16), (3, 2), (300, 16), (300, 9), (65, 7)):
        counts = rnd.zipf(1.3, n).clip(1, 10**9)
        lengths = code_lengths(counts, limit)
        assert lengths.max() <= limit and abs(sum(2.0 ** -int(x) for x in lengths) - 1) < 1e-12
        entropy = -(counts * np.log2(counts / counts.sum())).sum() / counts.sum()
        if limit == 16:
            assert entropy - 1e-9 <= (counts * lengths).sum() / counts.sum() <= entropy + 1
        book = Codebook(lengths)
        numbers = rnd.integers(0, n, 4 * STRIDE + 5)
        runs = np.array([1, STRIDE, 2 * STRIDE + 4, STRIDE])
        parts, checkpoints = book.encode(numbers, runs)
        marks = -(-runs // STRIDE)
        byte_starts = np.cumsum([0, *map(len, parts)])[:-1]
        starts = checkpoints + np.repeat(byte_starts * 8, marks)
        lanes = np.concatenate([[STRIDE] * (m - 1) + [r - STRIDE * (m - 1)] for m, r in zip(marks, runs)])
        assert (book.decode(b"".join(parts), starts, lanes) == numbers).all()
        # any block alone, from its own bytes
        assert (book.decode(parts[2], checkpoints[2:5], lanes[2:5]) == numbers[1 + STRIDE : 1 + STRIDE + runs[2]]).all()
    assert code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
    assert code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_separators_across_blocks(spark, block):
    rnd = random.Random(block)
    rows, expected = [], []
    for file in "xy":
        ids = [rnd.choice([9, 1, 2, 3]) for _ in range(200)] + [1]  # 9 ends; the tail is no document
        start = 0
        for ordinal, end in enumerate([i for i, x in enumerate(ids) if x == 9]):
            expected.append((file, ordinal, start, end + 1 - start))
            start = end + 1
        for part in (0, 1):
            half = ids[:90] if part == 0 else ids[90:]
            for b in range(0, len(half), block):
                rows.append((file, part * 50, b // block, bytearray(np.array(half[b : b + block], "<u2").tobytes())))
    flat = spark.createDataFrame(rows, "file string, part long, block int, tokens binary")
    assert sorted(map(tuple, scan_flat_files(flat, 9).collect())) == sorted(expected)
    assert scan_flat_files(flat.limit(0), 9).count() == 0


def test_token_counts_on_edge_cases(spec, library, edge_docs, edge_rows, no_docs):
    library.encode_special_tokens = True
    expected = sorted((r[0] or -1, len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in edge_rows)
    library.encode_special_tokens = False
    got = token_counts(edge_docs, spec, 49407)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == expected
    assert token_counts(no_docs, spec, 49407).count() == 0


def _base(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = []
    for phrase, label in BASE_PHRASES:
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), sorted(places)


def test_licences(spark, no_docs):
    texts = [
        None, "", "Under THE mit license, and Under the MIT-License!", "under the mıt license", "cc by-nc",
        "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License version 3",
        "gnu public general license 3 version", "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.",
        "Kc by nc", "the BSD 3-Clause license", "under the mit", "mit " * 3000 + "license", "version 3 " * 2000,
    ]
    got = {r.doc_id: r for r in scan(make(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        words, places = _base(text)
        assert got[i].n_words == words
        assert [tuple(x) for x in got[i].base_starts] == places
        assert set(got[i].base_labels) == {label for _, label in places} <= set(got[i].labels)
        assert 0 <= got[i].score <= 1
    assert got[5].labels == ["gpl-3"] and got[5].score == 1
    assert got[6].labels == ["gpl-3"] and got[7].labels == [] and got[10].labels == ["bsd-3"]
    assert got[8].labels == ["apache-2", "cc-by-nc"]
    assert scan(no_docs).count() == 0


def test_licence_scan_shuffles_nothing(spark, edge_rows):
    edge_docs = make(spark, edge_rows)
    plan = scan(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert scan(edge_docs).filter(F.col("score") > 0).count() == 0


def test_a_filter_on_licences_splits_each_text_once(spark):
    long = "mit license " * 50_000  # 100,000 words
    docs = make(spark, [(1, long, "en", "a"), (1, long, "en", "a"), (None, "cc by nc", None, None), (2, None, None, None)])
    licensed = scan(docs).filter((F.col("score") > 0) & (F.size("labels") > 0) & (F.size("base_starts") >= 0))
    assert licensed._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r.doc_id for r in licensed.collect()] == [None]
    assert sorted((r.doc_id or -1, r.n_words) for r in scan(docs).collect()) == [(-1, 3), (1, 100_000), (1, 100_000), (2, 0)]
