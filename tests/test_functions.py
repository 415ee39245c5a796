"""Column functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from signalsieve.config import DIMENSION_WEIGHTS
from signalsieve.functions.dates import date_label, normalise_date
from signalsieve.functions.numbers import clamp, clamp_text
from signalsieve.functions.scores import band, stage_class, weighted_score
from signalsieve.functions.texts import (
    contact_flags,
    fold_text,
    has_any_phrase,
    name_key,
    opener_problems,
    redact_contacts,
)
from signalsieve.functions.urls import has_valid_url, safe_url, url_host, url_key


def test_clamp_rounds_half_to_even_and_bounds(one):
    values = [82.5, 1.5, 2.5, 0.5, -3.0, 101.0, 100.0, None, float("nan"), float("inf"), float("-inf")]
    assert one(values, clamp, "double") == [82, 2, 2, 0, 0, 100, 100, 0, 0, 100, 0]
    assert one([1.5, 2.5, 0.5, 7.0], lambda c: clamp(c, 5), "double") == [2, 2, 0, 5]
    assert one([1200.0, 998.5], lambda c: clamp(c, 999), "double") == [999, 998]
    assert one([True, False], clamp, "boolean") == [1, 0]


def test_clamp_text_takes_plain_numbers_only(one):
    texts = ["82.5", " 82.5 ", "1e2", "abc", "", "1d", "0x1A", "nan", "inf", "-Infinity", "1_0", "1e999", "+7", ".5", "5.", None, " 41 "]
    expected = [82, 82, 100, 0, 0, 0, 0, 0, 100, 0, 0, 100, 7, 0, 5, 0, 41]
    assert one(texts, clamp_text) == expected


VALID = ["https://example.com/a", "HTTP://Ex.com", "  https://x.io  ", "https://a_b.com/x", "http://[::1]/x", "http://h?q", "https://user@h:8080/#f"]
INVALID = ["javascript:alert(1)", "http:///x", "ftp://x.com", "//x.com", "https:x.com", "http://?q", "", None, "http://[bad", "http://", "http://   "]


def test_url_gate(one):
    assert one(VALID, has_valid_url) == [True] * len(VALID)
    assert one(INVALID, has_valid_url) == [False] * len(INVALID)
    assert one(["  https://x.io  ", "ftp://x"], safe_url) == ["https://x.io", "#"]


def test_url_keys(one):
    same = ["https://www.x.com/a/?utm_source=n&p=2#top", "http://x.com/a?p=2", "HTTPS://M.X.com/a?p=2&ref=z"]
    assert set(one(same, url_key)) == {"x.com/a?p=2"}
    assert one(["http://x.com/t?id=1", "http://x.com/t?id=2"], url_key) == ["x.com/t?id=1", "x.com/t?id=2"]
    assert one(["http://user@www.X.com:80/p", "nope"], url_host) == ["x.com", None]


def test_dates(one):
    texts = ["2024-02-29", " 2024-01-05 ", "2024-02-30", "5 May 2024", "date unavailable", None, "2024"]
    found = one(texts, lambda c: date_label(normalise_date(c)))
    assert found == ["2024-02-29", "2024-01-05"] + ["date unavailable"] * 5


def test_stage_class(one):
    stages = ["High intent", "Problem aware", "TRIGGER present", "High-problem", "Potential fit", None, "Not highly relevant"]
    assert one(stages, stage_class) == ["hot", "warm", "warm", "hot", "cool", "cool", "hot"]


def test_band_edges(one):
    scores = [100, 80, 79, 65, 64, 50, 49, 0]
    names = ["strong", "strong", "promising", "promising", "plausible", "plausible", "excluded", "excluded"]
    assert one(scores, band, "int") == names
    assert one([79.5], lambda c: band(clamp(c)), "double") == ["strong"]


@pytest.mark.parametrize(
    ("ratings", "score"), [((5,) * 5, 100), ((0,) * 5, 0), ((3,) * 5, 60), ((5, 5, 4, 4, 4), 90), ((9, -1, 5, 5, 5), 75)]
)
def test_weighted_score(spark, ratings, score):
    columns = {name: F.lit(float(r)) for name, r in zip(DIMENSION_WEIGHTS, ratings, strict=True)}
    assert spark.range(1).select(weighted_score(**columns)).first()[0] == score


def test_score_grows_with_every_dimension(spark):
    for name in DIMENSION_WEIGHTS:
        columns = {n: F.lit(2.0) for n in DIMENSION_WEIGHTS} | {name: F.col("id") / 2}
        scores = [r[0] for r in spark.range(0, 12).orderBy("id").select(weighted_score(**columns)).collect()]
        assert scores == sorted(scores) and scores[0] < scores[-1]


def test_phrases_match_whole_words_only(one):
    texts = ["I hate this", "whatever", "HATE!", "chate", "copy-paste all day", "copy\npaste", "a copy. Paste it", None, "é-hate-é"]
    found = one(texts, lambda c: has_any_phrase(F.col(c), ["hate", "copy-paste"]))
    assert found == [True, False, True, False, True, True, False, False, True]


def test_folding(one):
    assert one([" A  b\n\tC ", "a b c", "  ", None], fold_text) == ["a b c", "a b c", None, None]
    assert one(["  Example-Gym, Inc. ", "--"], name_key) == ["example gym inc", None]


def test_contact_redaction(one):
    texts = [
        "write to jo.doe+x@mail.example.com now",
        "call +1 (743) 555-3824 today",
        "ring 0301 555 1234",
        "visit 12 High Oak Street soon",
        "version 3.13 of 2024-01-05",
        None,
    ]
    assert one(texts, contact_flags) == [["email"], ["phone"], ["phone"], ["address"], [], []]
    masked = one(texts, redact_contacts)
    assert masked[:4] == ["write to [email] now", "call [phone] today", "ring [phone]", "visit [address] soon"]
    assert masked[4:] == texts[4:]
    assert one(masked[:5], contact_flags) == [[]] * 5


def test_opener_rules(one):
    long = "word " * 90 + "ok?"
    texts = ["Saw your post. How do you do it?", long, "Mail a@b.co?", "I have sent you a note. Ok?", "No question.", "A? B?"]
    assert one(texts, opener_problems) == [[], ["too_long"], ["contact_data"], ["claims_sent"], ["not_one_question"], ["not_one_question"]]
    assert one(["word " * 88 + "ok?"], opener_problems) == [[]]


def test_contact_formats_and_other_numbers(one):
    texts = [
        "Call (743)555-3824 now", "7435553824", "555-3824", "743.555.3824 or 743 555 3824", "+1 (743) 555-3824.",
        "12 High St. please", "47 elm street", "at 5 Old Mill Road", "100 200 300", "12345 678 90123", "id 123456789012345",
        "in 10 minutes drive",
    ]
    masked = [
        "Call [phone] now", "[phone]", "[phone]", "[phone] or [phone]", "[phone].",
        "[address] please", "[address]", "at [address]", "100 200 300", "12345 678 90123", "id 123456789012345",
        "in 10 minutes drive",
    ]
    assert one(texts, redact_contacts) == masked
