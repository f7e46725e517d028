import datetime

from surveyq.streaming import attempts as A

SCHEMA = "survey string, at timestamp, id long, ok boolean"
T0 = datetime.datetime(2024, 1, 1)


def rows(*specs):
    return [(s, T0 + datetime.timedelta(hours=h), i, ok) for s, h, i, ok in specs]


def run(spark, where, out, state, **options):
    session = A.state_session(spark)
    stream = session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(where)
    A.run_attempts(A.attempt_decisions(stream, "survey", "at", "id", "ok", **options), out, state)
    return sorted((tuple(r)[:3] for r in spark.read.parquet(out).collect()), key=str)


def test_state_survives_a_restart(spark, tmp_path):
    where, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    keep = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    first = rows(("a", 0, 1, False), ("a", 1, 2, True), ("b", 0, 3, False), ("b", 0, 4, False), ("c", 0, 5, False), (None, 0, 6, True), ("d", 0, 7, None))
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(where)
    assert run(spark, where, out, state, late="30 days") == [("a", "valid", 2), (None, "valid", 1)]
    # a second run: b fails for the third time, c is valid at its second attempt, a's decision stays
    more = rows(("a", 2, 8, False), ("b", 2, 9, False), ("b", 3, 10, True), ("c", 2, 11, True))
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(where)
    assert run(spark, where, out, state, late="30 days") == [("a", "valid", 2), ("b", "given_up", 3), ("c", "valid", 2), (None, "valid", 1)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == keep


def test_timers_tell_when_an_attempt_is_due(spark, tmp_path):
    where, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame(rows(("a", 0, 1, False), ("a", 0, 2, False), ("z", 9, 3, True)), SCHEMA).coalesce(1).write.parquet(where)
    found = run(spark, where, out, state, wait=3600.0, late="1 hour")
    assert found == [("a", "due", 2), ("z", "valid", 1)]
    at = [r.at_us for r in spark.read.parquet(out).where("status = 'due'").collect()]
    assert at == [int((T0 + datetime.timedelta(hours=2)).timestamp() * 1e6)]  # two failures: two hours
