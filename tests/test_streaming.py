"""Streams run to the end of their input and agree with their batch twins."""

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.plans import bindings
from framewell.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(4, "event_id").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}")


def same(stream, twin):
    columns = sorted(stream.columns)
    return sorted(map(str, stream.select(*columns).collect())) == sorted(map(str, twin.select(*columns).collect()))


@pytest.mark.parametrize(("job", "twin"), [(jobs.latest_status, "st1_latest_status"), (jobs.lifecycle, "st2_job_lifecycle")])
def test_aggregates(spark, events, tmp_path, job, twin):
    assert same(drained(job(events), "complete", tmp_path, twin), bindings.queries()[twin](spark, SF))


def test_retries(spark, events, tmp_path):
    out = drained(jobs.retries(events), "complete", tmp_path, "retries")
    assert same(out, bindings.queries()["st6_retries"](spark, SF).select(*out.columns))


def test_bounded_log(spark, events, tmp_path):
    out = drained(jobs.bounded_log(events, 5), "update", tmp_path, "logs")
    last = {r.user_id: r.log for r in out.collect()}  # a key's last row stands last
    want = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect():
        want.setdefault(r.user_id, []).append(f"{r.event_id} {r.event_type}")
    assert last == {k: "\n".join(v[-5:]) for k, v in want.items()}


def test_not_done(spark, events, tmp_path):
    done = spark.read.parquet(f"{SF}/events.parquet").where("event_type = 'view'")
    out = drained(jobs.not_done(jobs.timed(events), done).select("user_id", "event_type"), "append", tmp_path, "todo")
    keys = [(r.user_id, r.event_type) for r in out.collect()]
    assert len(keys) == len(set(keys)) and "view" not in {k for _, k in keys} and len(keys) > 50


def test_upsert(spark, events, tmp_path):
    at = str(tmp_path / "table")
    sink = jobs.upsert_sink(at, parts=4)

    def twice(batch, epoch):
        sink(batch, epoch)
        sink(batch, epoch)  # a batch that is run again changes nothing

    q = events.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    out = spark.read.parquet(at).select("user_id", "event_type", "event_id", "value")
    assert same(out, bindings.queries()["s8_keyed_upsert"](spark, SF))


def states(spark, files, out, checkpoint, **options):
    """Runs job_state over `files` to their end and returns all rows that `out` has got so far, newest last."""
    from framewell.streaming import lifecycle

    spark.conf.set(*lifecycle.STORE)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)

    def keep(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = lifecycle.job_state(stream, **options).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination(240)
    finally:
        spark.conf.unset(lifecycle.STORE[0])
    last = {}
    for r in spark.read.parquet(*sorted(map(str, Path(out).glob("epoch=*")))).orderBy("epoch").collect():
        last[r.user_id] = tuple(r)[:-1]
    return last


def test_job_state_after_a_restart(spark, tmp_path):
    """Half of the events, a new query from the checkpoint for the others: the same as the batch twin."""
    from framewell.streaming import lifecycle

    events = spark.read.parquet(f"{SF}/events.parquet")
    cut = events.agg(F.percentile_approx("ts", 0.5).alias("t")).first().t
    files, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    events.where(F.col("ts") <= F.lit(cut)).coalesce(1).write.parquet(files)
    half = states(spark, files, out, ck)
    events.where(F.col("ts") > F.lit(cut)).coalesce(1).write.mode("append").parquet(files)
    got = states(spark, files, out, ck)
    want = {r.user_id: tuple(r) for r in lifecycle.job_state_twin(events).collect()}
    assert {k: tuple(map(str, v)) for k, v in got.items()} == {k: tuple(map(str, v)) for k, v in want.items()}
    assert half != got and {v[4] for v in got.values()} >= {"succeeded", "failed"}


def test_job_state_stalls_and_goes_on(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    files, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")

    def add(*rows):
        made = [{"event_id": i, "user_id": u, "event_type": k, "ts": datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h), "value": float(i), "props": '{"k": 1}'} for i, u, k, h in rows]
        frame = spark.createDataFrame([[m.get(f.name) for f in schema] for m in made], T.StructType([T.StructField(f.name, {"ts": T.TimestampType()}.get(f.name, f.dataType)) for f in schema]))
        frame.select(*[F.col(f.name).cast(f.dataType) for f in schema]).coalesce(1).write.mode("append").parquet(files)
        return {k: (v[4], v[6], v[7]) for k, v in states(spark, files, out, ck, delay="1 hour", stall_hours=5).items()}

    assert add((1, 1, "view", 0), (2, 2, "view", 1), (3, 2, "purchase", 2)) == {1: ("running", 1, 1.0), 2: ("succeeded", 1, 2.0)}
    assert add((4, 3, "view", 20)) == {1: ("stalled", 1, 1.0), 2: ("succeeded", 1, 2.0), 3: ("running", 1, 4.0)}
    assert add((5, 1, "click", 21), (6, 3, "error", 22)) == {1: ("running", 2, 5.0), 2: ("succeeded", 1, 2.0), 3: ("failed", 1, 4.0)}


def test_upsert_table_commits_at_once(spark, tmp_path, monkeypatch):
    from framewell.streaming.upserts import Conflict, UpsertTable

    def rows(*r):
        return spark.createDataFrame(list(r), "owner string, clip string, ord long, value double")

    def content():
        return sorted((tuple(r) for r in store.read().collect()), key=str)

    store = UpsertTable(spark, str(tmp_path / "table"), ["owner", "clip"], ["ord"], parts=3)
    assert store.read() is None and store.upsert(rows().limit(0))["version"] == 0
    first = rows(("a", "x", 1, 1.0), ("a", None, 1, 2.0), ("b", "x", 1, 3.0), ("a", "x", 0, 9.0))
    store.upsert(first)
    want = content()
    assert [r[3] for r in sorted(want, key=lambda r: r[3])] == [1.0, 2.0, 3.0]
    store.upsert(first)
    assert content() == want, "the same batch again"
    # a writer that is lost after its data and before its manifest
    monkeypatch.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.upsert(rows(("a", "x", 5, 5.0), ("c", "y", 1, 6.0)))
    monkeypatch.undo()
    assert content() == want
    before = store.manifest()
    store.upsert(rows(("a", "x", 5, 5.0), ("c", "y", 1, 6.0)))
    assert {r[:2]: r[3] for r in content()} == {("a", "x"): 5.0, ("a", None): 2.0, ("b", "x"): 3.0, ("c", "y"): 6.0}
    assert sorted((tuple(r) for r in store.read(before).collect()), key=str) == want, "older readers keep their version"
    with pytest.raises(Conflict):
        store.commit(before, before["schema"], {})
    now, tried = store.manifest(), []

    def stale():
        tried.append(1)
        return before if len(tried) == 1 else now

    monkeypatch.setattr(store, "manifest", stale)
    store.upsert(rows(("d", "z", 1, 7.0)))
    monkeypatch.undo()
    assert len(tried) == 2 and len(content()) == 5 and store.manifest()["version"] == now["version"] + 1
    store.upsert(spark.createDataFrame([("e", "z", 1, "new")], "owner string, clip string, ord long, note string"))
    assert store.read().columns == ["owner", "clip", "ord", "note", "value"] and store.read().count() == 6
    held = content()
    store.vacuum()
    assert content() == held and len(store._names("manifests")) <= 3


def test_upsert_table_as_a_sink(spark, events, tmp_path):
    from framewell.streaming.upserts import UpsertTable

    store = UpsertTable(spark, str(tmp_path / "table"), ["user_id", "event_type"], ["ts", "event_id"], parts=4)
    q = events.writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    out = store.read().select("user_id", "event_type", "event_id", "value")
    assert same(out, bindings.queries()["s8_keyed_upsert"](spark, SF))
    assert store.manifest()["version"] == 4
