"""Report documents: import, defaults, quirks, golden example, writing."""

import json

import pytest
from pyspark.sql import functions as F

from signalsieve.config import DEFAULT_LIMIT, PROSPECT_DEFAULTS
from signalsieve.operators.scoring import reconcile_scores
from signalsieve.sources.reports import import_reports, imported_patterns, imported_prospects, parse_documents, read_reports, write_reports

GOLDEN = {
    "title": "Report",
    "product": "Dunning helper",
    "product_url": "https://dunning.example",
    "prospects": [
        {
            "name": "Harbor Gym",
            "stage": "Problem aware",
            "score": 82,
            "source_url": "https://forum.example/t/1",
            "why_now": "asked this month",
            "dimensions": {"pain_strength": 5, "product_fit": 5, "timing": 4, "reachability": 4, "evidence_quality": 4},
        }
    ],
    "patterns": [{"title": "By hand", "count": 4, "insight": "lists"}],
}


def documents(spark, *bodies):
    texts = [b if isinstance(b, str) else json.dumps(b) for b in bodies]
    return spark.createDataFrame(list(enumerate(texts)), "document_id int, body string")


def test_quarantine(spark):
    good, bad = parse_documents(documents(spark, {}, "[1]", "3", "{bad", "null", '"{"', "", "  {} "))
    assert sorted(r.document_id for r in good.collect()) == [0, 7]
    assert {r.document_id: r.reason for r in bad.collect()} == {
        1: "not_an_object", 2: "not_an_object", 3: "not_json", 4: "not_an_object", 5: "not_an_object", 6: "not_json",
    }


def test_golden_example(spark):
    good, _ = parse_documents(documents(spark, GOLDEN))
    report = import_reports(good).first()
    assert (report.n_prospects, report.n_high_intent, report.average_score) == (1, 0, 82)
    assert (report.top_name, report.top_score, report.top_text) == ("Harbor Gym", 82, "asked this month")
    assert report.patterns[0]["count"] == 4
    row = reconcile_scores(imported_prospects(good).withColumnRenamed("score", "reported_score")).first()
    assert (row.stage_class, row.reported_score, row.computed_score, row.delta) == ("warm", 82, 90, 8)
    assert (row.mismatch, row.band_changed, row.computed_band) == (True, False, "strong")


@pytest.mark.parametrize(
    ("value", "positions"),
    [(None, []), ({}, [1]), ([{}, 7, "x", {}], [1, 2]), ("text", []), ([], []), ([None, [{}]], []), (7, [])],
)
def test_list_or_single_item(spark, value, positions):
    good, _ = parse_documents(documents(spark, {"prospects": value}, {}))
    rows = imported_prospects(good).filter("document_id = 0").orderBy("input_position").collect()
    assert [r.input_position for r in rows] == positions
    assert imported_prospects(good).filter("document_id = 1").count() == 0


def test_absent_and_null_differ(spark):
    good, _ = parse_documents(documents(spark, {"prospects": [{}, dict.fromkeys(["name", *PROSPECT_DEFAULTS])]}))
    absent, null = imported_prospects(good).orderBy("input_position").collect()
    assert absent.name == "Prospect 1" and null.name == ""
    for field, default in PROSPECT_DEFAULTS.items():
        assert absent[field] == default and null[field] == ""


def test_values_of_other_types(spark):
    prospect = {"name": True, "type": "true", "stage": 7, "score": True, "caution": {"a": 1}, "dimensions": [1]}
    good, _ = parse_documents(documents(spark, {"prospects": prospect, "limits": ["a", None, 3, False], "outreach_plan": [1]}))
    row = imported_prospects(good).first()
    assert (row.name, row.type, row.stage, row.score, row.caution) == ("True", "true", "7", 1, '{"a":1}')
    assert set(row.dimensions) == {0}
    report = import_reports(good).first()
    assert report.limits == ["a", "", "3", "False"]
    assert report.outreach_plan.angle == "Validate the pain before pitching the product."


def test_score_texts(spark):
    values = ["82.5", " 82.5 ", "true", "1_0", 1e2, "inf", [1], -3, 101, None, 2.5]
    good, _ = parse_documents(documents(spark, {"prospects": [{"score": v} for v in values]}, '{"prospects":{"score":1e999}}'))
    rows = imported_prospects(good).orderBy("document_id", "input_position").collect()
    assert [r.score for r in rows] == [82, 82, 0, 0, 100, 100, 0, 0, 100, 0, 2, 100]


def test_top_prospect_and_average(spark):
    def scored(*scores):
        return {"prospects": [{"name": f"n{i}", "score": s, "pain_signal": "p"} for i, s in enumerate(scores)]}

    quirk = {"prospects": {"score": 5, "why_now": None, "pain_signal": "p"}}
    good, _ = parse_documents(documents(spark, scored(90, 90, 10), scored(82, 83), scored(83, 84), {}, quirk))
    rows = import_reports(good).orderBy("document_id").collect()
    assert [r.top_name for r in rows] == ["n0", "n1", "n1", "No qualified prospect", "No qualified prospect"]
    assert [r.average_score for r in rows] == [63, 82, 84, 0, 5]
    assert [r.top_text for r in rows] == ["p", "p", "p", "", ""]
    assert rows[3].limits == [DEFAULT_LIMIT] and rows[3].top_score == 0


def test_patterns_and_high_intent(spark):
    body = {"prospects": [{"stage": "Not highly relevant"}, {"stage": "cold"}], "patterns": [{"count": 1200}, 3, {"title": None, "count": "x"}]}
    good, _ = parse_documents(documents(spark, body))
    assert import_reports(good).first().n_high_intent == 1
    rows = imported_patterns(good).orderBy("input_position").collect()
    assert [(r.title, r["count"]) for r in rows] == [("Repeated signal", 999), ("", 0)]


def test_read_files_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOLDEN, indent=1))
    (tmp_path / "b.json").write_text("[1]")
    good, bad = read_reports(spark, str(tmp_path))
    assert good.count() == 1 and bad.count() == 1
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "x.jsonl").write_text("\n".join([json.dumps(GOLDEN), "", "oops", json.dumps(GOLDEN)]))
    good, bad = read_reports(spark, str(lines), one_per_line=True)
    assert good.select("document_id").distinct().count() == 2 and bad.count() == 1


def test_writing_replaces_only_the_written_products(spark, tmp_path):
    out = str(tmp_path / "deep" / "out")
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "product_id string, v int")
    write_reports(rows, out)
    write_reports(rows.filter("product_id = 'a'").withColumn("v", F.lit(2)), out)
    back = {r.product_id: r.v for r in spark.read.json(out).collect()}
    assert back == {"a": 2, "b": 1}
