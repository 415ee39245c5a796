import random

import numpy as np
from pyspark.sql import functions as F

from signalsieve.llm import language_crf, quality, toxicity
from signalsieve.llm.mixing import mix, mixed_documents, source_targets
from tests.llm.conftest import make, prose


def _statistics(text):
    words = (text or "").replace("\v", " ").split() if text else []
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {w: windows.count(w) for w in set(windows)} if len(windows) < 500 else {}
    covered = {j for i, w in enumerate(windows) if seen.get(w, 0) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rnd = random.Random(1)
    texts = [None, "", "a", "a b c a b c", "x\nx\n\n \nx", "a a a a", "#*$%&|<>[]", "a b c d a b c b c d"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    rows = quality.judge(make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == _statistics(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_outliers_go_and_clean_rows_stay(spark):
    clean = [(i, prose(i, 60 + i % 90), "en", ("a", "b")[i % 3 == 0]) for i in range(400)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(i, 80).split()), "en", "a") for i in range(30)]
    few = [(2000, " ".join(w + "###" for w in prose(7, 80).split()), "xx", None), (2001, prose(8, 80), "xx", None)]
    docs = make(spark, clean + junk + few)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert all(got[i].kept for i, *_ in clean) and not any(got[i].kept for i, *_ in junk)
    # Two rows of a language are measured by all rows.
    assert not got[2000].kept and got[2001].kept and all(r.distance is not None for r in got.values())
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 401
    # A table with too few rows for any estimate is judged by the base rule alone.
    small = quality.judge(make(spark, clean[:40] + few)).collect()
    assert all(r.kept and r.distance is None for r in small)


def _plain_distances(x, of, inner=0.75, steps=5):
    """Squared distances of ``of`` by an estimate of ``x``, in plain numpy."""
    floor = np.diag([(f * quality.UNIT) ** 2 for f in quality.FLOOR])

    def squared(rows, centre, scatter):
        away = rows - centre
        return np.einsum("ij,jk,ik->i", away, np.linalg.inv(scatter + floor), away)

    bins = lambda d: np.floor(16 * np.log2(d + 2.0**-10))
    low, centre, high = np.percentile(x, [25, 50, 75], axis=0)
    scatter = np.diag(((high - low) / 1.349) ** 2)
    for _ in range(steps):
        at = bins(squared(x, centre, scatter))
        before = np.array([np.count_nonzero(at < b) for b in at])
        near = x[before < inner * len(x)]
        centre, scatter = near.mean(axis=0), np.cov(near.T, bias=True)
    at = np.sort(bins(squared(x, centre, scatter)))
    median = at[-(-len(x) // 2) - 1]
    scale = max(1.0, 2 ** ((median + 1) / 16) / quality.CHI2_MEDIAN)
    return squared(of, centre, scatter) / scale


def test_whole_verdict_equals_numpy(spark):
    """Groups of their own, pooled sources of a language, and languages measured by all rows."""
    texts = [(i, prose(i, 55 + i % 120), "en", "a") for i in range(200)] + [(300 + i, prose(300 + i, 60 + i), "en", "bcd"[i % 3]) for i in range(150)]
    texts += [(600 + i, prose(600 + i, 70 + i) + " %" * (i % 9) * 3, "fr", None) for i in range(30)]
    texts += [(800 + i, " ".join(w + "##" for w in prose(i, 90).split()), ("en", "fr")[i % 2], "a") for i in range(20)] + [(900, "few words", "en", "a")]
    docs = make(spark, texts)
    counted = quality.with_features(quality.with_statistics(docs.select("doc_id", "text"))).collect()
    vector = {r.doc_id: np.array([r[f] for f in quality.FEATURES], float) for r in counted if r.n_words >= 50}
    group = {i: (s if lang == "en" and s == "a" else lang) for i, _, lang, s in texts if i in vector}
    every = np.array(list(vector.values()))
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for name in ("a", "en", "fr"):
        mine = [i for i in group if group[i] == name]
        x = np.array([vector[i] for i in mine])
        expected = _plain_distances(every if name == "fr" else x, x)
        assert np.allclose([got[i].distance for i in mine], expected, rtol=1e-6)
        assert [got[i].kept for i in mine] == [bool(d <= quality.CHI2_CUTOFF) for d in expected]
    assert got[900].base_failed and not got[900].kept and not any(got[800 + i].kept for i in range(20))


def test_outliers_in_each_feature_go(spark):
    """Planted rows pass the base rule and stand out in one feature each."""

    def lines(words):
        return "\n".join(" ".join(words[i : i + 2]) for i in range(0, len(words), 2))

    def mixed(words, phrase, every):
        return [w for i in range(0, len(words), every) for w in (*phrase, *words[i : i + every])]

    clean = [(i, lines(prose(i, 60 + i % 90).split()), "en", "a") for i in range(400)]
    planted = {"x_words": [], "x_length": [], "x_symbols": [], "x_lines": [], "x_repeats": []}
    for k in range(12):
        words = prose(5000 + k, 80 + 2 * k).split()
        planted["x_words"].append(lines(prose(6000 + k, 6000).split()))
        planted["x_length"].append(lines([(w + "klmnopqr")[:8] for w in words]))
        planted["x_symbols"].append(lines([w + "#" if i % 4 == 0 else w for i, w in enumerate(words)]))
        planted["x_lines"].append("\n".join("aa bb" if i % 3 == 0 else f"{words[i]} {words[i - 1]}" for i in range(len(words))))
        planted["x_repeats"].append(lines(mixed(words, ("aa", "bb", "cc"), 5)))
    rows = {1000 * (f + 1) + k: (name, t) for f, (name, texts) in enumerate(planted.items()) for k, t in enumerate(texts)}
    docs = make(spark, clean + [(i, t, "en", "a") for i, (_, t) in rows.items()])
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert not any(got[i].base_failed for i in got)
    assert {name for i, (name, _) in rows.items() if got[i].kept} == set()
    assert all(got[i].kept for i, *_ in clean)


def test_quality_on_edge_cases(edge_docs, edge_rows, no_docs):
    got = quality.judge(edge_docs)
    assert got.count() == len(edge_rows)
    assert quality.kept_documents(edge_docs).count() == got.filter("kept").count()
    assert quality.judge(no_docs).count() == 0 and quality.kept_documents(no_docs).count() == 0


def test_concentration_equals_numpy(spark):
    """One step against the same step on arrays: the nearest rows, by whole bins."""
    rnd = np.random.default_rng(2)
    x = np.rint(rnd.normal(0, 200, (300, quality.P)) @ rnd.normal(0, 1, (quality.P, quality.P))).astype(int)
    rows = spark.createDataFrame([("g", *map(int, r)) for r in x], ["group", *quality.FEATURES])
    start = quality._start(rows)
    s = start.first()
    factor = np.zeros((quality.P, quality.P))
    for i in range(quality.P):
        for j in range(i + 1):
            factor[i, j] = s[f"w{i}{j}"]
    centre = np.array([s[f"m{i}"] for i in range(quality.P)])
    bins = np.floor(16 * np.log2((((x - centre) @ factor.T) ** 2).sum(axis=1) + 2.0**-10))
    order = np.sort(bins)
    last = order[int(np.ceil(0.75 * len(x))) - 1]
    near = x[bins <= last]
    got = quality._concentrate(rows, start, 0.75).first()
    scatter = np.cov(near.T, bias=True) + np.diag([(f * quality.UNIT) ** 2 for f in quality.FLOOR])
    expected = np.linalg.inv(np.linalg.cholesky(scatter))
    assert np.allclose([got[f"m{i}"] for i in range(quality.P)], near.mean(axis=0))
    assert np.allclose([got[f"w{i}{j}"] for i in range(quality.P) for j in range(i + 1)], expected[np.tril_indices(quality.P)])


def _fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        give = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, g in give.items():
            target[s] += g
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_targets(spark):
    for sizes in ({"b": 10, "a": 100, None: 5, "c": 0}, {"x": 1000, "y": 1, "z": 1, "w": 30}, {"a": 0}, {"a": 7}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(rows).collect()}
        expected = _fill(sizes)
        assert got.keys() == expected.keys() and all(abs(got[s] - expected[s]) < 1e-6 for s in got)


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = make(spark, [(i, prose(i, 1 + i % 50), "en", ("a", "b", None)[min(i % 7, 2)]) for i in range(3000)])
    first = mix(docs, bucket_rows=64, fan_in=4).collect()
    again = mix(docs.repartition(5), bucket_rows=64, fan_in=4).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    by = {}
    for r in first:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 50  # one document at most
    assert {s: rows[0].target for s, rows in by.items()}.keys() == {"a", "b", None}
    out = mixed_documents(docs, bucket_rows=64, fan_in=4)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in first)


def test_rounding_keeps_expectations(spark):
    docs = make(spark, [(i, prose(i, 3 + i % 5), "en", "a") for i in range(20)] + [(100 + i, prose(i, 9), "en", "b") for i in range(20)])
    counts = np.zeros(20)
    for seed in range(30):
        rows = mix(docs, share=1.0, weights=(1,), seed=seed).filter("source = 'a'").collect()
        rate = rows[0].target / rows[0].source_size
        for r in rows:
            counts[r.doc_id] += r.copies / 30
    assert abs(counts.mean() - rate) < 0.1 and np.abs(counts - rate).max() < 0.45


def test_repeated_rows_are_rounded_as_a_number(spark):
    """One row repeated 2,000 times is over half of its source, which still comes within one row of its target."""
    rows = [(1, prose(1, 40), "en", "a")] * 2000 + [(10 + i, prose(i, 30), "en", "a") for i in range(300)]
    docs = make(spark, rows + [(5000 + i, prose(i, 30), "en", "b") for i in range(700)])
    got = mix(docs, bucket_rows=64, fan_in=4).collect()
    assert len(got) == 3000
    for source in "ab":
        here = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in here) - here[0].target) <= 40
    rate = next(r.target / r.source_size for r in got if r.source == "a")
    repeated = [r.copies for r in got if r.doc_id == 1]
    assert rate % 1 > 0.01 and set(repeated) == {int(rate), int(rate) + 1}
    assert abs(sum(repeated) - 2000 * rate) <= 1
    again = mix(docs.repartition(5), bucket_rows=64, fan_in=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixed_documents(docs, bucket_rows=64, fan_in=4)
    assert out.filter("doc_id = 1").count() == sum(repeated) and out.count() == sum(r.copies for r in got)


def test_mix_on_edge_cases(edge_docs, edge_rows, no_docs):
    got = mix(edge_docs).collect()
    assert len(got) == len(edge_rows) and all(r.taken <= 2 * r.size for r in got)
    assert mix(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0
    assert mixed_documents(edge_docs).count() == sum(r.copies for r in got)


def test_toxicity(spark, edge_docs, edge_rows, no_docs):
    bad = ["rudeword", "vileterm", "foulness"]
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        words = prose(i, 80).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(80), rnd.choice(bad))
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(i % 4 == 0), None))
    labels += [(None, 1, 1, None), (5, 1, None, None), (5, 1, 0, "x")]
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = toxicity.toxicity(make(spark, rows), tags).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 300 and 60 < len(held) < 140
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    edge = toxicity.toxicity(edge_docs, tags).collect()
    assert len(edge) == len(edge_rows) and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.toxicity(no_docs, tags).count() == 0
    none = toxicity.toxicity(edge_docs, tags.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {0}


def test_ngrams_do_not_depend_on_company():
    texts = ["abc abc", None, "", "x", "long " * 300_000]
    together = {}
    for t, b in zip(*toxicity.hits(texts)):
        together.setdefault(int(t), set()).add(int(b))
    for i, text in enumerate(texts):
        assert together.get(i, set()) == set(toxicity.hits([text])[1].tolist())


def _model():
    rnd = np.random.default_rng(5)
    return language_crf.Model(["a", "b", "c"], np.zeros((1, 3)), rnd.normal(0, 1, (3, 3)), rnd.normal(0, 1, 3), {})


def test_forward_backward_equals_enumeration():
    from itertools import product

    model, rnd = _model(), np.random.default_rng(6)
    sizes = np.array([1, 5, 2, 7])
    scores = rnd.normal(0, 1, (int(sizes.sum()), 3))
    for lane in (1, 2, 3, 100):
        got = language_crf.posteriors(scores, sizes, model, lane)
        at = 0
        for n in sizes:
            part, total = np.zeros((n, 3)), 0.0
            for path in product(range(3), repeat=int(n)):
                s = model.first[path[0]] + sum(scores[at + t, y] for t, y in enumerate(path))
                s += sum(model.transitions[a, b] for a, b in zip(path, path[1:]))
                total += np.exp(s)
                for t, y in enumerate(path):
                    part[t, y] += np.exp(s)
            assert np.allclose(got[at : at + n], part / total, atol=1e-9)
            at += n


def test_languages(spark, edge_docs, edge_rows, no_docs):
    kinds = {"xx": "abcde", "yy": "fghij", "zz": "klmüé"}
    rows = [(i, prose(i, 40, kinds[k]), k, "s") for i in range(240) for k in [list(kinds)[i % 3]]]
    rows += [(900, None, "xx", "s"), (901, "12 34!", "yy", "s"), (902, prose(1, 30, "abcde") + " " + prose(2, 10, "fghij"), None, None), (None, "abc", "xx", None)]
    got = {r.doc_id: r for r in language_crf.language_ids(make(spark, rows)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:240])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert got[902].lang_pred == "xx" and 0.6 < got[902].score < 0.9  # a quarter is in another language
    edge = language_crf.language_ids(edge_docs).collect()
    assert len(edge) == len(edge_rows) and all(0 <= r.score <= 1 for r in edge)
    assert language_crf.language_ids(no_docs).count() == 0
    untaught = language_crf.language_ids(edge_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}
