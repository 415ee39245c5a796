"""Originals of pages, triggers by time and sketches of counts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from signalsieve.operators.asof import current_triggers, latest_within
from signalsieve.operators.originals import declared_original, follow_pointers, page_originals, resolved_url, with_original
from signalsieve.operators.sketches import daily_sketches, estimated_patterns, fold_sketches, refresh_sketches, relative_error
from signalsieve.sources.keyed_tables import read_keyed

# --- Originals ---

BASE = "https://www.a.example/dir/page?x=1#top"


def test_links_are_resolved_against_their_page(one):
    links = ["https://b.example/x", "HTTP://B.example", "//c.example/y", "/root", "file.html", "?q=2", "#part", "mailto:a@b", "", "../up"]
    got = one(links, lambda c: resolved_url(F.col(c), F.lit(BASE)))
    assert got == [
        "https://b.example/x", "HTTP://B.example", "https://c.example/y", "https://www.a.example/root", "https://www.a.example/dir/file.html",
        "https://www.a.example/dir/page?q=2", "https://www.a.example/dir/page#part", "mailto:a@b", None, "https://www.a.example/dir/../up",
    ]
    assert one(["x"], lambda c: resolved_url(F.col(c), F.lit("https://a.example"))) == ["https://a.example/x"]


def test_what_pages_declare(one):
    pages = {
        '<link rel="canonical" href="https://b.example/1">': "https://b.example/1",
        "<LINK HREF='/2' REL=Canonical />": "https://www.a.example/2",
        "<link href=three rel=canonical>": "https://www.a.example/dir/three",
        '<link rel="stylesheet" href="/s"><link rel="canonical" href="/4?a=1&amp;b=2">': "https://www.a.example/4?a=1&b=2",
        '<link\nrel="canonical"\nhref="/5">': "https://www.a.example/5",
        '<meta http-equiv="Refresh" content="5; URL=\'/6\'">': "https://www.a.example/6",
        '<meta content="0;url=/7" http-equiv=refresh><link rel=canonical href=/8>': "https://www.a.example/8",
        '<!-- <link rel="canonical" href="/9"> -->': None,
        '<script>var a = \'<link rel="canonical" href="/10">\'</script>': None,
        '<link rel="canonical" data-href="/11">': None,
        '<link rel="canonical" href="">': None,
        '<meta http-equiv="refresh" content="30">': None,
        "canonical refresh": None,
        "": None,
    }
    assert one(list(pages), lambda c: declared_original(c, F.lit(BASE))) == list(pages.values())
    assert one([None], lambda c: declared_original(c, F.lit(BASE))) == [None]


def plain_originals(pointers):
    to = {}
    for page, target in pointers:
        if page is not None:
            to[page] = min(filter(None, (to.get(page), target)), default=None)
    for target in list(to.values()):
        if target is not None:
            to.setdefault(target, None)
    out = {}
    for page in to:
        path, at = [], page
        while at not in path and to[at] not in (None, at):
            path.append(at)
            at = to[at]
        out[page] = (min(path[path.index(at) :]), True) if at in path else (at, False)
    return out


def test_pointers_are_followed_through_chains_and_cycles(spark):
    rnd = random.Random(5)
    cases = [
        [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(100)],
        [(f"c{i:02d}", f"c{(i + 1) % 37:02d}") for i in range(37)] + [(f"t{i}", "c11" if i == 0 else f"t{i - 1}") for i in range(50)],
        [("a", "b"), ("b", "a"), ("x", "x"), ("y", None), ("z", "y"), (None, "q"), ("a", "b"), ("m", "n"), ("m", "k")],
        [(f"s{i}", "hub") for i in range(500)] + [("hub", "end")],
        [(f"r{i}", f"r{rnd.randrange(300)}" if rnd.random() < 0.9 else None) for i in range(300)],
    ]
    for pointers in cases:
        rnd.shuffle(pointers)
        got = follow_pointers(spark.createDataFrame(pointers, "page string, target string")).collect()
        assert {r.page: (r.original, r.cyclic) for r in got} == plain_originals(pointers) and len(got) == len(plain_originals(pointers))
    assert follow_pointers(spark.createDataFrame([], "page string, target string")).count() == 0
    with pytest.raises(RuntimeError):
        follow_pointers(spark.createDataFrame(cases[0], "page string, target string"), rounds=2)


def test_signals_get_the_page_behind_their_own(spark):
    pages = spark.createDataFrame(
        [("https://m.a.example/1?ref=x", '<link rel="canonical" href="https://www.a.example/2">'), ("https://a.example/2", "<meta http-equiv=refresh content='0; url=3'>"), ("no url", "x")],
        "source_url string, text string",
    )
    got = {r.page: r.original for r in page_originals(pages).collect()}
    assert got == {"a.example/1": "a.example/3", "a.example/2": "a.example/3", "a.example/3": "a.example/3"}
    signals = spark.createDataFrame([(1, "https://a.example/1"), (2, "https://z.example/"), (3, None)], "signal_id long, source_url string")
    seen = {r.signal_id: r.original for r in with_original(signals, page_originals(pages)).collect()}
    assert seen == {1: "a.example/3", 2: "z.example", 3: None}


# --- Triggers ---


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_latest_events_equal_brute_force(spark, slices):
    rnd, start = random.Random(slices), dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(seconds=rnd.randrange(5000))
    rows = [(i, rnd.choice(["hot"] * 5 + ["b", None]), rnd.choice([at(), at(), at(), None])) for i in range(600)]
    events = [(rnd.choice(["hot"] * 5 + ["b", "c", None]), at(), i) for i in range(80)] + [("hot", start, 900), ("hot", start, 901), ("b", None, 999)]
    found = latest_within(
        spark.createDataFrame(rows, "id long, k string, t timestamp"), spark.createDataFrame(events, "k string, e timestamp, n long"),
        ["k"], "t", "e", 300, slices,
    )
    expected = {}
    for i, k, t in rows:
        near = [(e, n) for key, e, n in events if k is not None and key == k and e is not None and t is not None and e <= t and (t - e).total_seconds() <= 300]
        expected[i] = max(near, default=None)
    got = {r.id: (r.event.e, r.event.n) if r.event else None for r in found.collect()}
    assert got == expected and sum(v is not None for v in expected.values()) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_triggers_of_edge_cases(spark):
    day = dt.datetime(2024, 3, 1)
    signals = spark.createDataFrame([(1, "p", day), (1, "p", day), (2, "p", None), (3, None, day)], "signal_id long, product_id string, signal_time timestamp")
    triggers = spark.createDataFrame([("p", day, 7), ("p", day - dt.timedelta(9), 8), (None, day, 9)], "product_id string, trigger_time timestamp, trigger_id long")
    got = sorted((r.signal_id, r.trigger_id, r.trigger_age) for r in current_triggers(signals, triggers, 5).collect())
    assert got == [(1, 7, 0.0), (1, 7, 0.0), (2, None, None), (3, None, None)]
    assert {r.trigger_id for r in current_triggers(signals, triggers.limit(0), 5).collect()} == {None}
    assert current_triggers(signals.limit(0), triggers, 5).count() == 0


# --- Sketches ---


def test_sketches_of_batches_count_like_one_pass(spark, tmp_path):
    rows = [(f"p{i % 2}", i % 3000, ["pain"] if i % 3 else ["pain", "timing"], dt.date(2024, 1, 1 + i % 5) if i % 7 else None) for i in range(12_000)]
    rows += [("p0", None, ["pain"], None), ("p0", 1, [], None)]
    evidence = spark.createDataFrame(rows, "product_id string, entity_key long, buckets array<string>, signal_date date")
    whole = daily_sketches(evidence)
    for batch in range(3):
        mine = evidence.filter(F.pmod(F.xxhash64("entity_key", "signal_date"), F.lit(3)) == batch)
        refresh_sketches(f"{tmp_path}/t", mine, batch, buckets=4)
    stored = read_keyed(spark, f"{tmp_path}/t", whole.schema)
    assert stored.count() == whole.count() == 2 * 2 * 6
    hits = lambda df: sorted((r.product_id, r.bucket, r.n_hits) for r in df.collect())
    assert hits(estimated_patterns(stored)) == hits(estimated_patterns(whole)) == hits(estimated_patterns(fold_sketches(whole)))
    exact = {}
    for p, e, buckets, day in rows:
        for b in buckets:
            if e is not None:
                exact.setdefault((p, b), set()).add(e)
    for r in estimated_patterns(stored).collect():
        assert abs(r.n_prospects - len(exact[r.product_id, r.bucket])) <= 4 * relative_error() * len(exact[r.product_id, r.bucket])
    some = estimated_patterns(stored, days=F.col("day") <= dt.date(2024, 1, 2)).filter("bucket = 'pain'").collect()
    for r in some:
        seen = {e for p, e, buckets, day in rows if p == r.product_id and "pain" in buckets and day and day <= dt.date(2024, 1, 2)}
        assert abs(r.n_prospects - len(seen)) <= 4 * relative_error() * len(seen)
    assert estimated_patterns(daily_sketches(evidence.limit(0))).count() == 0


def test_tags_are_looked_for_once(spark):
    pages = spark.createDataFrame([("https://a.example/x", "<link rel=canonical href=y>")], "source_url string, text string")
    named = pages.select(declared_original("text", "source_url").alias("target"))
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2
    assert named.first().target == "https://a.example/y"


def test_customers_of_one_row_group_are_named_by_all_cores(spark):
    from signalsieve.plans.bindings import customer_profiles

    profiles = customer_profiles(spark, "/root/testdata/sf0.001")
    assert profiles.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
