import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from signalsieve.llm.components import components
from signalsieve.llm.exact_dedup import group_copies, without_copies
from signalsieve.llm.simhash_dedup import forest, hex_print, near_duplicates, simhash, without_near_duplicates
from tests.llm.conftest import make


def _expected_groups(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_copies_on_edge_cases(edge_docs, edge_rows):
    groups = _expected_groups(edge_rows)
    got = group_copies(edge_docs).collect()
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    assert len(got) == len(edge_rows)
    assert all((r.keep_id, r.group_size) == by_digest[r.digest] for r in got)
    assert sum(r.kept for r in got) == len(groups)  # one row, also where ids repeat or are null


def test_weak_digests_are_told_apart_by_bytes(edge_docs, edge_rows):
    groups = _expected_groups(edge_rows)
    weak = lambda text: F.pmod(F.crc32(text), F.lit(5)).cast("string")
    got = group_copies(edge_docs, digest=weak).collect()
    assert len(got) == len(edge_rows) and sum(r.kept for r in got) == len(groups)
    sizes = sorted(r.group_size for r in got)
    assert sizes == sorted(n for _, n in groups.values() for _ in range(n))


def test_state_carries_over_batches(spark, edge_docs):
    one = group_copies(edge_docs, files_per_batch=1).drop("_file", "_row").collect()
    assert sorted(map(str, one)) == sorted(map(str, group_copies(edge_docs).drop("_file", "_row").collect()))


def test_kept_rows_have_their_own_columns(edge_docs, edge_rows):
    kept = without_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert kept.count() == len(_expected_groups(edge_rows))


def test_empty_tables(no_docs):
    assert group_copies(no_docs).count() == 0
    assert without_copies(no_docs).count() == 0
    assert near_duplicates(no_docs.select("doc_id", "text")).count() == 0
    assert without_near_duplicates(no_docs).count() == 0


def test_fingerprint_by_definition():
    for text in ("", "  ", "A b", "Über den Fluß geht der WEG weiter", "a a a a a a"):
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        expected = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert simhash(text) == expected


def _classes(ids, prints):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, p) in enumerate(zip(ids, prints)):
        for j, q in zip(ids[a + 1 :], prints[a + 1 :]):
            if bin(p ^ q).count("1") <= 2:
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("cell_rows, levels", [(200_000, 4), (20, 4), (200_000, 8), (3, 16)])
def test_forest_loses_no_link(spark, cell_rows, levels):
    """Clusters, chains and single points, with cells that have to be split and without."""
    rnd = np.random.default_rng(3)
    prints = {int(x) for x in rnd.integers(0, 2**63, 60)}
    for seed in list(prints)[:6]:
        for _ in range(25):
            seed ^= 1 << int(rnd.integers(0, 63)) ^ (1 << int(rnd.integers(0, 63)) if rnd.random() < 0.5 else 0)
            prints.add(seed)
    prints = sorted(prints)
    points = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "print long, node long")
    got = {r.node: r.component for r in components(forest(points, cell_rows=cell_rows, levels=levels)).collect()}
    expected = _classes(list(range(len(prints))), prints)
    assert {i: got.get(i, i) for i in expected} == expected


def test_near_duplicates_on_edge_cases(edge_docs, edge_rows):
    got = near_duplicates(edge_docs.select("doc_id", "text", "print")).select("doc_id", hex_print().alias("h"), "component_id").collect()
    assert len(got) == len(edge_rows)
    pairs = [(i, simhash(t or "")) for i, t, *_ in edge_rows if i is not None]
    expected = _classes(*zip(*sorted({i: p for i, p in pairs}.items())))
    assert all(r.component_id == expected[r.doc_id] for r in got if r.doc_id is not None)
    assert {r.component_id for r in got if r.doc_id is None} == {4, 1}
    assert {r.h for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}


def test_one_row_of_each_component_stays(edge_docs, edge_rows):
    kept = without_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    pairs = sorted({i: simhash(t or "") for i, t, *_ in edge_rows if i is not None}.items())
    assert sorted(ids) == sorted(set(_classes(*zip(*pairs)).values()))


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(50)] + [(300, 300), (301, 300), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(50)} | {300: 300, 301: 300}


def test_rows_sharing_an_id_and_text(spark):
    docs = make(spark, [(1, "same", "en", "a")] * 5)
    assert without_copies(docs).count() == 1
    assert without_near_duplicates(docs).count() == 1
