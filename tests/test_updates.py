"""Tables kept up to date by batches, and streams against the batch result."""

import datetime as dt
import random
import shutil
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from signalsieve.config import ScoringConfig
from signalsieve.operators import incremental
from signalsieve.operators.scoring import score_prospects
from signalsieve.plans import bindings as b
from signalsieve.sources.keyed_tables import FOLDER, bucket_of, commits, current_folders, merge_keyed, read_keyed
from signalsieve.streaming.dedup import append_first_signals, first_of_sessions

SMALL = "/root/testdata/sf0.001"
COUNTED = "k long, n long, top long"


def fold(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def test_any_split_into_batches_folds_alike(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 7, *range(40)]), 1, rnd.randrange(1000)) for _ in range(900)] + [(7, 1, 5)] * 400
    rnd.shuffle(rows)
    expected = defaultdict(lambda: [0, -1])
    for k, n, top in rows:
        expected[k][0] += n
        expected[k][1] = max(expected[k][1], top)
    for cuts in ([0, 1300], [0, 1, 500, 500, 1299, 1300]):
        path = f"{tmp_path}/t{len(cuts)}"
        for batch, (x, y) in enumerate(zip(cuts, cuts[1:])):
            merge_keyed(path, spark.createDataFrame(rows[x:y], COUNTED), ["k"], fold, batch, 5)
        got = {r.k: [r.n, r.top] for r in read_keyed(spark, path, COUNTED).collect()}
        assert got == expected


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/t"
    merge_keyed(path, spark.createDataFrame([(k, 1, 1) for k in range(200)], COUNTED), ["k"], fold, 10, 16)
    before = current_folders(spark, path)
    assert sorted(before) == list(range(16))
    new = spark.createDataFrame([(3, 1, 9), (3, 1, 8)], COUNTED)
    bucket = new.select(bucket_of(["k"], 16)).first()[0]
    assert merge_keyed(path, new, ["k"], fold, 11, 16) == [bucket]
    after = current_folders(spark, path)
    assert {k for k in after if after[k] != before[k]} == {bucket}
    assert read_keyed(spark, path, COUNTED).filter("k = 3").first()[1:] == (3, 9)
    assert {r.k for r in read_keyed(spark, path, COUNTED, [bucket]).collect()} < set(range(200))


def test_a_batch_counts_once_whatever_breaks(spark, tmp_path):
    path, rows = f"{tmp_path}/t", spark.createDataFrame([(1, 1, 1), (2, 1, 1)], COUNTED)
    assert read_keyed(spark, path, COUNTED).count() == 0 and commits(spark, path).count() == 0
    merge_keyed(path, rows, ["k"], fold, 0, 4)
    assert merge_keyed(path, rows, ["k"], fold, 0, 4) == []  # sent again
    # A job that wrote its files and was lost before the commit.
    lost = spark.createDataFrame([(1, 100, 100)], COUNTED).withColumn(FOLDER, bucket_of(["k"], 4))
    lost.write.partitionBy(FOLDER).parquet(f"{path}/data/batch-1-lost")
    assert {r.k: r.n for r in read_keyed(spark, path, COUNTED).collect()} == {1: 1, 2: 1}
    merge_keyed(path, rows, ["k"], fold, 1, 4)
    assert merge_keyed(path, rows.limit(0), ["k"], fold, 2, 4) == []
    assert merge_keyed(path, rows, ["k"], fold, 2, 4) == []  # an empty batch is in as well
    assert {r.k: r.n for r in read_keyed(spark, path, COUNTED).collect()} == {1: 2, 2: 2}
    with pytest.raises(ValueError):
        merge_keyed(path, rows, ["k"], fold, 3, 8)


@pytest.fixture(scope="module")
def evidence(spark):
    signals = b.order_evidence(spark, SMALL)
    return signals.withColumns(
        {
            "fit_terms": F.when(F.col("signal_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))),
            "disqualified": F.col("signal_id") % 50 == 0,
            "entity_type": F.when(F.col("signal_id") % 2 == 0, F.lit("company")),
        }
    ).cache()


RATED = ["product_id", "entity_key", "n_signals", "dimensions", "score", "band", "stage", "n_channels", "is_disqualified", "is_company"]


def rows_of(df):
    return sorted(str(r) for r in df.select(*RATED).collect())


def test_profiles_by_batches_rate_like_one_run(spark, tmp_path, evidence):
    config = ScoringConfig()
    expected = rows_of(score_prospects(evidence, config))
    rnd = random.Random(4)
    for name, parts in (("days", 3), ("many", 5)):
        path, seed = f"{tmp_path}/{name}", rnd.randrange(1000)
        for batch in range(parts):
            mine = evidence.filter(F.pmod(F.xxhash64("signal_id", F.lit(seed)), F.lit(parts)) == batch)
            incremental.refresh_profiles(path, mine, batch, buckets=4)
        stored = incremental.stored_profiles(spark, path, evidence)
        assert rows_of(incremental.rated_profiles(stored, b.AS_OF, config)) == expected
    # Later days rate the same stored rows lower in timing.
    later = incremental.rated_profiles(stored, b.AS_OF + dt.timedelta(3650), config)
    assert later.filter("dimensions.timing > 2").count() == 0


def test_profiles_of_a_stream_that_is_started_again(spark, tmp_path, evidence):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/profiles"
    columns = evidence.drop("as_of", "scope_months")
    for part in range(3):
        columns.filter(F.col("signal_id") % 3 == part).write.mode("append").parquet(folder)
        for _ in range(2):  # the second start finds nothing new
            stream = spark.readStream.schema(columns.schema).parquet(folder)
            incremental.keep_profiles(stream, path, f"{tmp_path}/checkpoint", buckets=4).awaitTermination()
    # The checkpoint is lost: all batches come again from the first on, and numbers that are in are skipped.
    before = rows_of(incremental.rated_profiles(incremental.stored_profiles(spark, path, columns), b.AS_OF))
    assert before == rows_of(score_prospects(evidence))
    shutil.rmtree(f"{tmp_path}/checkpoint")
    stream = spark.readStream.schema(columns.schema).parquet(folder)
    incremental.keep_profiles(stream, path, f"{tmp_path}/checkpoint", buckets=4).awaitTermination()
    assert rows_of(incremental.rated_profiles(incremental.stored_profiles(spark, path, columns), b.AS_OF)) == before


TIMED = "signal_id long, at timestamp, text string, other string"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def plain_sessions(rows, gap):
    by_text = defaultdict(list)
    for i, time, text, other in rows:
        if time is not None:
            key = " ".join((text or "").lower().split()) or f"row {i}"
            by_text[key].append((time, i, text, other))
    out = []
    for found in by_text.values():
        session: list = []
        for row in sorted(found, key=lambda r: r[:2]):
            if session and (row[0] - session[-1][0]) > gap:
                out.append(session)
                session = []
            session.append(row)
        out.append(session)
    return sorted((s[0][1], s[0][2], s[0][3], s[0][0], s[-1][0] + gap, len(s)) for s in out)


def found(df):
    columns = ["signal_id", "text", "other", "session_start", "session_end", "n_copies"]
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_sessions_of_a_table(spark):
    rnd = random.Random(6)
    rows = [(i, at(rnd.randrange(4000)), rnd.choice(["A  b", "a B", "c", "d e"]), "x") for i in range(300)]
    rows += [(1000, at(5), "", "y"), (1001, at(5), None, "y"), (1002, None, "c", "y"), (1003, at(7), "tie", "b"), (1004, at(7), "tie", "a")]
    got = found(first_of_sessions(spark.createDataFrame(rows, TIMED), "at", "30 minutes"))
    assert got == sorted(plain_sessions(rows, dt.timedelta(minutes=30)))
    assert first_of_sessions(spark.createDataFrame([], TIMED), "at", "30 minutes").count() == 0


def test_late_repeated_and_restarted_input_gives_the_batch_result(spark, tmp_path):
    rnd, gap = random.Random(8), dt.timedelta(minutes=60)
    rows = []
    for i in range(600):
        time = rnd.randrange(6000)
        rows.append((i, at(time), rnd.choice(["a b", "A  B", "c", "d", "e f g"]), "x", time + rnd.randrange(0, 240)))
    rows.sort(key=lambda r: r[4])  # arrival: up to four hours late
    rows += [(*r[:4], 6300) for r in rows[-20:]]  # the last ones come again
    rows.append((9000, at(6600), "closing", "z", 6600))
    columns = spark.createDataFrame([r[:4] for r in rows], TIMED)
    parts = [rows[:150], rows[150:151], rows[151:500], rows[500:]]
    for k, part in enumerate(parts):
        spark.createDataFrame([r[:4] for r in part], TIMED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2 if k == 1 else 1):
            stream = spark.readStream.schema(columns.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            first = first_of_sessions(stream, "at", "60 minutes", "5 hours")
            append_first_signals(first, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = found(spark.read.schema(first.schema).parquet(f"{tmp_path}/out"))
    limit = at(6600) - dt.timedelta(hours=5)
    expected = [s for s in plain_sessions([r[:4] for r in rows], gap) if s[4] <= limit]
    assert got == sorted(expected) and len(got) > 50
    # What is later than the state waits changes nothing that was given out.
    late = [(9999, at(10), "a b", "late")]
    spark.createDataFrame(late, TIMED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(columns.schema).parquet(f"{tmp_path}/in")
    append_first_signals(first_of_sessions(stream, "at", "60 minutes", "5 hours"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    assert found(spark.read.schema(first.schema).parquet(f"{tmp_path}/out")) == got
