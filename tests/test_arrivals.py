"""Report documents taken in from a stream."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from signalsieve.streaming import reports as arrivals

BODIES = {
    "a.json": '{"title": "A"}', "b.json": '  {"title": "B", "prospects": []}', "c.json": "[1, 2]", "d.json": "7", "e.json": '{"title": ',
    "f.json": " ", "g.json": "null", "h.json": '"text"', "i.json": '{"title": "I"}',
}
REASONS = {"c": "not_an_object", "d": "not_an_object", "e": "not_json", "f": "not_json", "g": "not_an_object", "h": "not_an_object"}


def put(folder, names):
    folder.mkdir(exist_ok=True)
    for name in names:
        (folder / name).write_text(BODIES[name])


def name_of(document_id):
    return document_id.rsplit("/", 1)[1].split(".")[0]


def read(spark, path):
    good, quarantine = arrivals.taken_in(spark, path)
    titles = good.select("document_id", F.try_variant_get("document", "$.title", "string").alias("title")).collect()
    return sorted((name_of(r.document_id), r.title) for r in titles), sorted((name_of(r.document_id), r.reason) for r in quarantine.collect())


def test_files_are_taken_in_once_over_restarts(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    assert read(spark, out) == ([], [])
    names = sorted(BODIES)
    for part in (names[:4], names[4:7], [], names[7:]):
        put(source, part)
        stream = arrivals.arriving_documents(spark, str(source), files_per_batch=2)
        arrivals.take_in(stream, out, checkpoint).awaitTermination()
    assert read(spark, out) == ([("a", "A"), ("b", "B"), ("i", "I")], sorted(REASONS.items()))


def test_a_batch_that_broke_off_is_replaced(spark, tmp_path, monkeypatch):
    source, out, checkpoint = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    put(source, sorted(BODIES))
    whole = arrivals.take_batch

    def breaking(rows, batch, path):
        whole(rows, batch, path)  # all is written, but the batch is not yet known as done
        if batch == 1:
            raise OSError("lost")

    monkeypatch.setattr(arrivals, "take_batch", breaking)
    with pytest.raises(StreamingQueryException):
        arrivals.take_in(arrivals.arriving_documents(spark, str(source), files_per_batch=3), out, checkpoint).awaitTermination()
    monkeypatch.setattr(arrivals, "take_batch", whole)
    arrivals.take_in(arrivals.arriving_documents(spark, str(source), files_per_batch=3), out, checkpoint).awaitTermination()
    good, quarantine = read(spark, out)
    assert [g[0] for g in good] == ["a", "b", "i"] and quarantine == sorted(REASONS.items())


def test_lines_are_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text("\n".join([json.dumps({"title": "one"}), "", "  ", "[]", '{"a"', json.dumps({"title": "two"})]))
    stream = arrivals.arriving_documents(spark, f"{tmp_path}/in", one_per_line=True)
    arrivals.take_in(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    good, quarantine = arrivals.taken_in(spark, f"{tmp_path}/out")
    assert good.count() == 2 and sorted(r.reason for r in quarantine.collect()) == ["not_an_object", "not_json"]
    ids = [r.document_id for r in good.select("document_id").collect()] + [r.document_id for r in quarantine.select("document_id").collect()]
    assert len(set(ids)) == 4
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
