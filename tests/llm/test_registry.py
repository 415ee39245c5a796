import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from signalsieve.llm.oracles import llm_oracles
from signalsieve.llm.quality import judge
from signalsieve.llm.queries import llm_queries
from tests.llm.conftest import prose
from tests.llm.test_near_texts import classes, edited, jaccard
from tests.oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_all_operators_and_the_pipeline_are_registered():
    names = list(contract.queries())
    assert [n for n in names if re.match(r"op\d", n)] == list(llm_queries())
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries()) == list(range(1, 14))
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    assert contract.oracle_sql().keys() >= llm_oracles().keys()


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_its_sql(spark, name):
    assert compare(llm_queries()[name](spark, SMALL), connect(SMALL), llm_oracles()[name]) == ""


COLUMNS = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op4": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op6": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op7": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op10": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op11": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
    "op12": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op13": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_each_query_returns_its_columns_for_every_document(spark, name):
    df = llm_queries()[name](spark, SMALL)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name.split("_")[0]]} == COLUMNS[name.split("_")[0]]
    ids = [r.doc_id for r in df.select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())


def _kept_by_rule(text):
    words = (text or "").split()
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words) >= 50 and 100 * len(covered) <= 50 * len(words)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The outlier test's verdict is compared with numpy elsewhere; here it has to take effect."""
    texts = {i: prose(i, 40 + i % 40) for i in range(80)}
    texts |= {200 + i: texts[i] for i in range(0, 60, 3)}  # exact copies
    texts |= {300 + i: prose(1000, 4000) + f" end{i}" for i in range(4)}  # near copies
    texts |= {310 + i: edited(prose(2000 + i // 2, 300), 0.015 * (i % 2), i) for i in range(40)}  # edited throughout
    texts |= {400: None, 401: "", 402: "x y z " * 40}
    rows = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in texts.items()]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    verdict = {r.doc_id for r in judge(spark.read.parquet(f"{folder}/documents.parquet")).filter("kept").collect()}
    assert verdict < {i for i, t in texts.items() if _kept_by_rule(t)}
    kept = {i: texts[i] for i in verdict}
    last = {}
    for i, t in kept.items():
        last[t] = max(i, last.get(t, i))
    kept = {i: t for t, i in last.items()}
    top = classes((a, b) for a, b in combinations(sorted(kept), 2) if jaccard(kept[a], kept[b]) >= 0.8)
    assert len(top) >= 40
    kept = {i: t for i, t in kept.items() if top.get(i, i) == i}
    assert len(kept) < len(last)
    got = corpus_pipeline.run(spark, folder).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= set(kept) and max(copies.values()) <= 2
    sizes = defaultdict(int)
    taken = defaultdict(int)
    for i, t in kept.items():
        sizes[i % 2] += len(t.split())
        taken[i % 2] += copies[i] * len(t.split())
    total = 1.5 * sum(sizes.values())
    first = min(2 * sizes[0], max(total * 3 / 4, total - 2 * sizes[1]))
    longest = max(len(t.split()) for t in kept.values())
    assert math.isclose(taken[0], first, abs_tol=longest) and math.isclose(taken[1], total - first, abs_tol=longest)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in got:
        ids = library.encode(kept[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
