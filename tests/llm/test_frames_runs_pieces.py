import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from signalsieve.llm.fill_middle import draws, fill_in_middle, frame_digests, output_texts, restored, transform
from signalsieve.llm.frames import Frames, compressor, stream, text_slices, write_frames
from signalsieve.llm.periodic_runs import collapsed, context_words, periodic_runs, recurring, runs_of
from signalsieve.llm.piece_bpe import PieceBpe
from signalsieve.llm.queries import (
    op11_fill_middle, op12_periodic_runs, op13_sentence_pieces, piece_vocabulary, with_planted_period,
)
from signalsieve.llm.sentence_pieces import encode_pieces, long, packed, short, unpacked
from tests.llm.conftest import make

SMALL = "/root/testdata/sf0.001"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_key(rows):
    return sorted(map(tuple, rows), key=repr)


# --- Fill in the middle ---


def plain_middle(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("frame_units", [1, 3, 1024])
def test_middles_of_edge_cases(edge_docs, edge_rows, frame_units):
    if frame_units == 1:
        edge_docs, edge_rows = edge_docs.filter("length(text) < 1000 or text is null"), [r for r in edge_rows if len(r[1] or "") < 1000]
    got = output_texts(fill_in_middle(edge_docs, rate=100, spm_rate=50, frame_units=frame_units)).collect()
    assert by_key(got) == by_key(plain_middle(r[0], r[1], rate=100, spm=50) for r in edge_rows)
    digests = frame_digests(fill_in_middle(edge_docs, rate=100, spm_rate=50, frame_units=frame_units)).collect()
    assert sorted((r.doc_id or -1, r.restored_sha256) for r in digests) == sorted((r[0] or -1, sha(r[1] or "")) for r in edge_rows)


def test_markers_white_space_and_rates(spark, no_docs):
    texts = ["<P> a b", "a <S", "x<M>", "  a  b  ", "<<S <P <M", "\t\n", "é 中文 😀  z ", "<S"] * 20
    docs = make(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = output_texts(fill_in_middle(docs)).collect()
    assert by_key(got) == by_key(plain_middle(i, t) for i, t in enumerate(texts))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert frame_digests(fill_in_middle(no_docs)).count() == output_texts(fill_in_middle(no_docs)).count() == 0
    assert {r.form for r in fill_in_middle(docs, rate=0).select("form").collect()} == {"plain"}
    with pytest.raises(ValueError):
        fill_in_middle(docs, rate=101)


def test_frames_are_one_stream_and_cuts_open_only_their_frames(spark):
    text = " ".join(f"w{i}" for i in range(5000)) + "  "
    row = write_frames(make(spark, [(1, text, None, None)]), frame_units=100).first()
    assert len(row.frames) == 51 and row.units[-1] == 5001 and row.chars[-1] == len(text)
    assert zstandard.ZstdDecompressor().stream_reader(b"".join(row.frames), read_across_frames=True).read().decode() == text
    # Frames that no cut falls into are moved without being opened, so they may hold anything.
    frames = [f if k in (7, 30) else b"closed" for k, f in enumerate(row.frames)]
    framed = Frames(frames, row.units, row.chars)
    form, prefix, middle, output = transform(framed, False, [755, 3001, 0, 0], 50, 80, compressor())
    assert form == "spm" and output.count(b"closed") == 49
    assert prefix == len("".join(UNITS.findall(text)[:755])) and middle == len("".join(UNITS.findall(text)[755:3001]))


def test_restoring_finds_markers_wherever_frames_end():
    compress, rnd = compressor(), random.Random(4)
    for _ in range(300):
        parts = ["".join(rnd.choice("<PSM> x") for _ in range(rnd.randint(0, 6))) for _ in range(3)]
        text = "".join(parts)
        if any(m in text for m in ("<P>", "<S>", "<M>")):
            continue
        output = f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}".encode()
        cuts = sorted({0, len(output), *(rnd.randrange(len(output)) for _ in range(rnd.randint(0, 9)))})
        frames = [compress(output[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert b"".join(restored(frames, "psm")).decode() == text and b"".join(stream(frames)) == output


def test_draws_are_those_of_the_id():
    assert draws(42, 7) == [int(sha("42:7")[i : i + 8], 16) for i in (0, 8, 16, 24)] and draws(42, None) != draws(42, 0)


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["x" * 3_000_000, None, "y" * 2_000_000, *["z"] * 600, "w" * 9_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    sizes = [(s.num_rows, sum(len(t or "") for t in s.column("text").to_pylist())) for s in text_slices([batch])]
    assert sum(n for n, _ in sizes) == len(texts) and all(n <= 256 and (size <= 1 << 22 or n == 1) for n, size in sizes)


# --- Periodic runs ---


def plain_runs(words, least=24, repeats=3):
    found, n = {}, len(words)
    for p in range(1, n // repeats + 1):
        i = p
        while i < n:
            start = i
            while i < n and words[i] == words[i - p]:
                i += 1
            if i > start and i - start + p >= max(least, repeats * p):
                found.setdefault((start - p, i - start + p), p)  # periods ascend: the smallest stays
            i += i == start
    return sorted(((s, length, p) for (s, length), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rnd, some = random.Random(5), 0
    for t in range(1500):
        least, repeats = rnd.choice([(24, 3), (6, 3), (1, 3), (10, 4), (5, 3)])
        words: list = []
        for _ in range(rnd.randint(0, 6)):
            part = [rnd.randrange(1 + t % 4) for _ in range(rnd.randint(1, 12))]
            words += (part * rnd.randint(1, 9))[: rnd.randint(1, 90)]
        expected = plain_runs(words, least, repeats)
        assert runs_of(words, least, repeats) == expected
        if expected:
            hashes = np.array([hash(str(w)) for w in words], np.int64)
            assert recurring(hashes, np.zeros(len(words), int), context_words(least, repeats)) == {0}
        some += len(expected)
    assert some > 1000


def test_runs_of_repetitive_texts_take_few_steps():
    assert runs_of(["x"] * 200_000) == [(0, 200_000, 1)]
    nested = (["x"] * 30 + ["y"]) * 2_000
    assert len(runs_of(nested)) == 2_001 and runs_of(nested)[0] == (0, 30, 1) and (0, 62_000, 31) in runs_of(nested)
    assert collapsed(list("ababab"), [(0, 6, 2)]) == ["a", "b"]
    with pytest.raises(ValueError):
        runs_of(["x"] * 9, 3, 2)


def plain_period(doc_id, text):
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def plain_row(doc_id, words):
    runs = plain_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    best = [None] * 4
    if runs:
        s, n, p = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = [s, n, p, 1000 * n // p]
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(kept)))


def test_periodic_runs_of_edge_cases(spark, edge_docs, edge_rows, no_docs):
    short = [r for r in edge_rows if len(r[1] or "") < 10_000]
    docs = edge_docs.filter("length(text) < 10000 or text is null")
    got = periodic_runs(docs).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.collapsed) for r in got) == sorted(
        (r[0] or -1, len(WORDS.findall(r[1] or "")), " ".join(WORDS.findall(r[1] or ""))) for r in short
    )
    assert periodic_runs(edge_docs).count() == len(edge_rows) and periodic_runs(no_docs).count() == 0
    texts = ["a b c " * 9, "a b c\n" * 9 + "a b d", "x\x1cy " * 30, "é　z " * 24, "w " * 23, "w " * 100_000]
    got = periodic_runs(make(spark, [(7, t, None, None) for t in texts]))
    expected = [[(0, 27, 3)], [(0, 29, 3)], [(0, 30, 1)], [(0, 24, 1)], [], [(0, 100_000, 1)]]
    assert sorted([tuple(x) for x in r.runs] for r in got.collect()) == sorted(expected)


def test_op12_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("n_chars < 6000")
    rows = docs.select("doc_id", "text").collect()
    planted = {r.doc_id: r.text for r in with_planted_period(docs).collect()}
    assert {i: WORDS.findall(t or "") for i, t in planted.items()} == {r.doc_id: plain_period(r.doc_id, r.text) for r in rows}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path)).collect()
    assert by_key(got) == by_key(plain_row(r.doc_id, plain_period(r.doc_id, r.text)) for r in rows)


# --- SentencePiece ---


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


ODD = "aAbBé ÉΣσςİıßẞ²½Ⅷ٣中文'sdtrevmĺ  \x1c\x85\n\t😀KÅ_-​　﻿\x00ǅﬁ▁▁  \n<s>0x41"


def test_words_and_pieces_equal_the_library(pieces):
    own, rnd = PieceBpe(piece_vocabulary()), random.Random(1)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(rnd.choice("abcdefgh") for _ in range(5000)), "é" * 20_000, " " * 5000, "<s></s><0x41><unk>", "a" * 20_000]
    for text in texts:
        words = own.words(text)
        ids = [i for w in words for i in own.encode_word(w)]
        assert ids == pieces.encode(text)
        assert b"".join(own.decode_word(own.encode_word(w)) for w in words)[1:].decode() == pieces.decode(ids)


@pytest.mark.parametrize("options", [{}, {"block_words": 1, "table_words": 3}, {"block_characters": 500}])
def test_encoded_pieces_of_edge_cases(edge_docs, edge_rows, pieces, options):
    got = encode_pieces(edge_docs, piece_vocabulary(), **options).collect()
    expected = [(r[0], pieces.encode(r[1] or "")) for r in edge_rows]
    assert by_key((r.doc_id, r.ids, r.decoded) for r in got) == by_key((i, ids, pieces.decode(ids)) for i, ids in expected)


def test_other_models_are_refused():
    with pytest.raises(Exception):
        PieceBpe(b"no model")


def test_encoded_pieces_of_no_documents(no_docs):
    assert encode_pieces(no_docs, piece_vocabulary()).count() == 0


def test_each_distinct_word_is_shuffled_once_per_block(spark):
    docs = make(spark, [(i, "same words again", None, None) for i in range(2000)]).coalesce(1)
    numbers = np.random.default_rng(1).integers(0, 2**32, 999)
    assert (unpacked(packed(numbers)) == numbers).all() and len(unpacked(packed(numbers[:0]))) == 0
    edges = np.array([0, 1, 191, 192, 193, 447, 448, 16319, 16320, 16321, 70_000, 2**23, 2**24 + 16319, 2**31])
    for some in (edges, edges[:3], edges[:0], edges[-2:], np.random.default_rng(2).permutation(40_000)):
        assert (long(short(some), len(some)) == some).all()
    plan = encode_pieces(docs, piece_vocabulary())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(bucket") == 1 and plan.count("hashpartitioning(block") == 1


# --- The registered queries ---


def test_op11_and_op13_on_a_whole_table(spark, pieces):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    expected = [plain_middle(r.doc_id, r.text) for r in rows]
    got = op11_fill_middle(spark, SMALL).collect()
    assert by_key(got) == by_key((*e[:5], sha(e[5]), sha(r.text or "")) for e, r in zip(expected, rows))
    ids = [pieces.encode(r.text or "") for r in rows]
    got = op13_sentence_pieces(spark, SMALL).collect()
    assert by_key(got) == by_key((r.doc_id, len(x), sha(",".join(map(str, x))), sha(pieces.decode(x))) for r, x in zip(rows, ids))


def test_a_null_id_is_not_planted(spark):
    docs = make(spark, [(None, "a b c", None, None)])
    assert with_planted_period(docs).filter(F.col("text") == "a b c").count() == 1
