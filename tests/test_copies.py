"""Entities under different names, and near copies of texts."""

import random
from collections import defaultdict
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from signalsieve.operators import near_copies as nc
from signalsieve.operators.entities import (
    BLOCK, candidate_pairs, merge_entities, plain_handle, plain_name, resolve_profiles, site_of, sorted_name,
)
from signalsieve.operators.graph import connected
from signalsieve.plans import bindings as b

SMALL = "/root/testdata/sf0.001"


def components(nodes, links):
    top = {n: n for n in nodes}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for x, y in links:
        x, y = sorted((root(x), root(y)))
        top[y] = x
    return {n: root(n) for n in nodes}


# --- Components ---


def test_components_of_chains_stars_and_loops(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (8, 9), (9, 8), (8, 9)]
    links += [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(80)]
    rnd.shuffle(links)
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "x long, y long")).collect()}
    nodes = {n for pair in links if pair[0] != pair[1] for n in pair}
    assert got == components(nodes, [p for p in links if p[0] != p[1]])
    assert connected(spark.createDataFrame([], "x long, y long")).count() == 0
    with pytest.raises(RuntimeError):
        connected(spark.createDataFrame(links, "x long, y long"), rounds=1)


# --- Entities ---

PROFILE = "profile_id long, name string, host string, handle string"


def test_plain_fields(one):
    names = ["The Acme Co., Ltd.", "acme", " Zed  alpha ", "Ltd", "", None, "--", "Ünïon GmbH"]
    assert one(names, plain_name) == ["acme", "acme", "zedalpha", "ltd", None, None, None, "ünïon"]
    assert one(names, sorted_name) == ["acme", "acme", "alphazed", "ltd", None, None, None, "ünïon"]
    assert one(["@a_b.C", "", None, "@"], plain_handle) == ["abc", None, None, None]
    hosts = ["www.acme.com", "shop.acme.co.uk", "acme.co.uk", "localhost", "", None, "A.B.Forum.Example"]
    assert one(hosts, lambda c: site_of(c, ["forum.example"])) == ["acme.com", "acme.co.uk", "acme.co.uk", None, None, None, None]


def test_planted_aliases_merge(spark):
    got = {r.profile_id: r.entity_id for r in resolve_profiles(b.customer_profiles(spark, SMALL), b.SHARED_SITES).collect()}
    groups = defaultdict(list)
    for p in got:
        groups[p // 8].append(p)
    true = {pair for g in groups.values() for pair in combinations(sorted(g), 2)}
    merged = defaultdict(list)
    for p, e in got.items():
        merged[e].append(p)
    found = {pair for g in merged.values() for pair in combinations(sorted(g), 2)}
    assert len(true) > 200
    assert len(true & found) / len(true) >= 0.95 and len(true & found) / len(found) >= 0.95


def test_hot_blocks_are_split(spark):
    # A third of all profiles are one name on one site; only some of them share more than that.
    rows = [(i, "Admin", "a.hot.example", f"user{i:05d}x") for i in range(1000)]
    rows += [(2000 + i, "Admin", "b.hot.example", f"user{i:05d}x") for i in range(0, 1000, 100)]  # again, with their handles
    rows += [(3000 + i, f"Firm {i:05d}", f"firm{i:05d}.example", None) for i in range(1000)]
    rows += [(5000, "Rare Bird Alpha", "hot.example", None), (5001, "Rare Bird Alpha", "c.hot.example", "rarebird")]
    profiles = spark.createDataFrame(rows, PROFILE)
    got = {r.profile_id: r.entity_id for r in resolve_profiles(profiles).collect()}
    expected = {r[0]: r[0] for r in rows} | {2000 + i: i for i in range(0, 1000, 100)} | {5001: 5000}
    assert got == expected
    forms = profiles.select(
        F.col("profile_id").alias("form"), plain_name("name").alias("name"), sorted_name("name").alias("sorted"), plain_handle("handle").alias("handle"),
        site_of("host").alias("site"), plain_handle(F.substring_index(site_of("host"), ".", 1)).alias("label"),
    )
    assert candidate_pairs(forms).count() <= len(rows) * BLOCK
    plan = candidate_pairs(forms)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_pair_in_hot_blocks_that_shares_a_rare_combination(spark):
    rows = [(i, "Guest", f"s{i}.example", f"other{i}") for i in range(60)]  # a common name
    rows += [(100 + i, "".join(sentence(random.Random(i), 4)), "big.example", f"more{i}") for i in range(60)]  # a common site
    rows += [(300, "Guest", "big.example", None), (301, "guest", "www.big.example", "someone")]
    got = {r.profile_id: r.entity_id for r in resolve_profiles(spark.createDataFrame(rows, PROFILE)).collect()}
    assert got[301] == got[300] == 300 and len(set(got.values())) == len(rows) - 1


def test_profiles_of_edge_cases(spark):
    rows = [
        (1, None, None, None), (2, None, None, None), (3, "", " ", "@"), (4, "Solo", None, None), (4, "Solo", None, None),
        (5, "Northwind Trading 12", None, None), (6, "Northwind Trading 13", None, None), (7, "Northwind Tradin 12", None, None),
        (8, None, "northwind.example", None), (9, None, None, "north-wind"), (None, "Solo", None, None),
    ]
    got = sorted(map(tuple, resolve_profiles(spark.createDataFrame(rows, PROFILE)).collect()), key=str)
    expected = [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 5), (6, 6), (7, 5), (8, 8), (9, 8), (None, 4)]
    assert got == sorted(expected, key=str)
    assert resolve_profiles(spark.createDataFrame([], PROFILE)).count() == 0
    assert resolve_profiles(spark.createDataFrame([(1, "x")], "profile_id long, name string")).first().entity_id == 1


def test_equal_profiles_are_one_before_pairs_are_made(spark):
    rows = [(i, "Same Harbour", "same.example", None) for i in range(3000)] + [(9000, "Same Harbur", None, None)]
    got = resolve_profiles(spark.createDataFrame(rows, PROFILE))
    assert {r.entity_id for r in got.collect()} == {0}


def test_signals_move_to_the_resolved_entity(spark):
    profiles = spark.createDataFrame([(1, "Acme Works", None, None), (2, "Acme Works Inc", None, "acmeworks")], PROFILE)
    signals = spark.createDataFrame([(10, 1, "a"), (11, 2, "b"), (12, 3, "c"), (13, None, "d")], "signal_id long, entity_key long, text string")
    got = {r.signal_id: (r.entity_key, r.profile_id, r.text) for r in merge_entities(signals, profiles).collect()}
    assert got == {10: (1, 1, "a"), 11: (1, 2, "b"), 12: (3, 3, "c"), 13: (None, None, "d")}


# --- Near copies ---

TEXT = "signal_id long, text string, other string"


def sentence(rnd, words):
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(words)]


def plain_sets(texts, words=5):
    out = {}
    for i, text in texts.items():
        split = (text or "").lower().split()
        out[i] = {tuple(split[k : k + words]) for k in range(max(len(split) - words, 0) + 1)} if split else set()
    return out


def plain_classes(texts, least=0.8):
    sets = plain_sets(texts)
    links = [
        (x, y) for x, y in combinations(sorted(texts), 2)
        if sets[x] and sets[y] and len(sets[x] & sets[y]) >= least * len(sets[x] | sets[y])
    ]
    return components(texts, links), links


@pytest.fixture(scope="module")
def reposts():
    """Texts with copies of which several per cent of the words are changed, and a family of very many."""
    rnd, texts = random.Random(11), {}
    for i in range(60):
        base = sentence(rnd, rnd.randint(60, 200))
        texts[i * 20] = " ".join(base)
        for k in range(1, rnd.randint(2, 5)):
            changed = list(base)
            for _ in range(max(1, int(len(base) * rnd.choice([0.01, 0.02, 0.03])))):
                changed[rnd.randrange(len(changed))] = "new" + str(rnd.random())
            texts[i * 20 + k] = "  ".join(changed).upper() if k == 1 else " ".join(changed)
    base = sentence(rnd, 150)
    for k in range(60):  # neighbours in a chain are similar, its ends are not
        base[(2 * k) % 150] = f"step{k}"
        texts[5000 + k] = " ".join(base)
    texts |= {9000: None, 9001: "", 9002: " \n", 9003: "two words", 9004: "Two  words", 9005: "two words more"}
    return texts


@pytest.mark.parametrize("block", [nc.BLOCK, 5, 1])
def test_near_classes_equal_brute_force(spark, reposts, block):
    signals = spark.createDataFrame([(i, t, "x") for i, t in reposts.items()], TEXT)
    expected, links = plain_classes(reposts)
    assert len(links) > 150
    got = {r.signal_id: r.class_id for r in nc.near_classes(signals, block=block).collect()}
    assert got == expected


def test_links_are_exact_and_few_are_missed(spark, reposts):
    sets = plain_sets(reposts)
    _, links = plain_classes(reposts)
    signals = spark.createDataFrame([(i, t, "x") for i, t in reposts.items()], TEXT)
    hashed = signals.select(F.col("signal_id").alias("id"), nc.shingles("text").alias("shingles"))
    assert {r.id: len(r.shingles) for r in hashed.collect()} == {i: len(s) for i, s in sets.items()}
    got = {(r.a, r.b) for r in nc.near_links(hashed, block=10_000).collect()}
    assert got <= set(links) and len(got) / len(links) >= 0.99


def test_edited_copies_of_one_text_do_not_all_meet(spark, monkeypatch):
    rnd, compared, similar_pairs = random.Random(6), [], nc.similar_pairs
    base, texts = sentence(rnd, 400), {}
    for i in range(500):
        words = list(base)
        for _ in range(rnd.randint(1, 20)):
            words[rnd.randrange(400)] = f"new{rnd.random()}"
        texts[i] = " ".join(words)

    def counted(pairs, *args):
        compared.append(pairs.count())
        return similar_pairs(pairs, *args)

    monkeypatch.setattr(nc, "similar_pairs", counted)
    got = {r.signal_id: r.class_id for r in nc.near_classes(spark.createDataFrame([(i, t, "x") for i, t in texts.items()], TEXT)).collect()}
    assert got == plain_classes(texts)[0]
    assert sum(compared[1:]) <= 3 * len(texts)


@pytest.mark.parametrize("words", [1, 2, 5])
def test_runs_of_words_hash_alike_wherever_they_stand(words):
    folded = ["a b c d e f", None, "", "x a b c d e f", "b", "a b c d e f a b c d e f", "é ü", "b a", "b", "a b  c", "ab c", "a bc"]
    batch = pa.record_batch({"_row": pa.array(range(len(folded))), "id": pa.array(range(len(folded))), "_text": folded})
    made = pa.Table.from_batches(nc._hashed_texts(words, 3, 2)([batch.slice(0, 3), batch.slice(3, 0), batch.slice(3)])).to_pylist()
    split = [t.split(" ") if t else [] for t in folded]
    sets = [{tuple(w[k : k + words]) for k in range(max(len(w) - words, 0) + 1)} if w else set() for w in split]
    known = {}
    for run, row in zip(sets, made, strict=True):
        assert len(run) == len(row["shingles"]) and row["shingles"] == sorted(row["shingles"], key=lambda x: x % 2**64)
    for x, one in zip(sets, made):
        for y, other in zip(sets, made):
            assert len(x & y) == len(set(one["shingles"]) & set(other["shingles"]))
        known.setdefault(one["_key"], set()).add(folded[one["_row"]])
    assert all(len(texts) == 1 for texts in known.values() if None not in texts and "" not in texts)


def test_copies_repeated_rows_and_empty_tables(spark):
    rnd = random.Random(3)
    text = " ".join(sentence(rnd, 80))
    rows = [(i, text, "x") for i in range(2000)] + [(3000, text + " more", "y"), (3001, "other", "z"), (3001, "other", "z"), (None, None, "n")]
    signals = spark.createDataFrame(rows, TEXT)
    kept = nc.dedup_near_signals(signals).collect()
    assert sorted((-1 if r.signal_id is None else r.signal_id, r.other) for r in kept) == [(-1, "n"), (0, "x"), (3001, "z"), (3001, "z")]
    assert nc.near_copies_of(signals).count() == 2000
    assert nc.near_classes(signals.limit(0)).count() == 0
    with pytest.raises(ValueError):
        nc.near_classes(signals, least=0)
