import datetime
import json

import pytest
from pyspark.sql import functions as F

from shelltrail.functions.policy import EnvPolicy
from shelltrail.operators import live, sequence, usage
from shelltrail.sources import events as source, history
from shelltrail.streaming import feeds, totals

NOW = {"availableNow": True}


def wire(number, **more):
    return json.dumps(
        {
            "command": f"cmd {number}",
            "return_code": number % 2,
            "start_timestamp": f"2024-03-01T10:{number // 60:02d}:{number % 60:02d}Z",
            "end_timestamp": f"2024-03-01T10:{number // 60:02d}:{number % 60:02d}Z",
            "pwd": f"/src/{number % 4}",
            "hostname": f"h{number % 2}",
            "env": {"USER": "u", "PWD": f"/src/{number % 4}", "API_KEY": "x"},
            **more,
        }
    )


@pytest.fixture
def arriving(spark, tmp_path):
    """A folder with three files, read one per micro-batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    for part in range(3):
        lines = [wire(number) for number in range(part * 40, part * 40 + 40)]
        (folder / f"{part}.json").write_text("\n".join(lines) + "\n")
    return str(folder)


def run(spark, output, tmp_path, mode="update"):
    out = str(tmp_path / "out")
    feeds.store_batches(output, out, str(tmp_path / "check"), mode, NOW).awaitTermination()
    return spark.read.parquet(out)


def stream(spark, folder):
    return source.stream_events(spark, folder, max_files=1)


def rows(frame, *names):
    return sorted(tuple(row) for row in frame.select(*names).collect())


def test_subscribe(spark, arriving, tmp_path):
    feed = run(spark, feeds.subscribe(stream(spark, arriving), "hostname=h1,return_code=1"), tmp_path, "append")
    assert feed.count() == 60 and feed.select("batch").distinct().count() == 3


def test_last_events_over_several_batches(spark, arriving, tmp_path):
    lines = [wire(number, start_timestamp=None) for number in (200, 201, 202)] + [wire(0, hostname="h0")]
    (tmp_path / "in" / "odd.json").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    feeds.recent_events_stream(stream(spark, arriving), out, str(tmp_path / "check"), 7).awaitTermination()
    found = feeds.latest_lists(spark, out)
    assert len(list((tmp_path / "out").glob("version=*"))) <= 3
    whole = source.read_events(spark, arriving)
    want = sequence.last_n_events(whole, 7)
    assert rows(found, "hostname", "user", "event_id", "command") == rows(want, "hostname", "user", "event_id", "command")
    assert rows(live.live_suggestions(found), "hostname", "place", "suggestion") == rows(
        live.live_suggestions(want), "hostname", "place", "suggestion"
    )


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    everyone = [wire(number, env={"USER": f"u{number}"}) for number in range(200)]
    (folder / "0.json").write_text("\n".join(everyone) + "\n")

    def arrive(name, lines):
        if lines:
            (folder / name).write_text("\n".join(lines) + "\n")
        feeds.recent_events_stream(stream(spark, str(folder)), str(out), str(tmp_path / "check"), 3, buckets=32).awaitTermination()

    def rows_of(version):
        return spark.read.parquet(f"{out}/rows/version={version}").count()

    arrive("0.json", None)
    assert rows_of(0) == 200
    late = [wire(500 + k, hostname="h0", env={"USER": "u4"}) for k in range(5)]
    arrive("1.json", late)
    # One key has come: its bucket is written, about one in 32 of the rows.
    assert len(list((out / "rows" / "version=1").glob("bucket=*"))) == 1 and rows_of(1) < 40
    for number in range(2, 7):
        arrive(f"{number}.json", [wire(600 + number, hostname="h1", env={"USER": "u5"})])
    found = feeds.latest_lists(spark, str(out))
    want = sequence.last_n_events(source.read_events(spark, str(folder)), 3)
    names = ("hostname", "user", "event_id", "command")
    assert rows(found, *names) == rows(want, *names)
    # Lists that count no more are gone, and what only they named.
    kept = {path.name for path in (out / "rows").glob("version=*/bucket=*")}
    assert len(list(out.glob("version=*"))) == 3 and sum(1 for _ in (out / "rows").glob("version=*/bucket=*/*.parquet")) <= len(kept) + 3


def test_a_replayed_batch_gives_the_same_last_events(spark, arriving, tmp_path):
    out, check = tmp_path / "out", tmp_path / "check"

    def go():
        feeds.recent_events_stream(stream(spark, arriving), str(out), str(check), 7).awaitTermination()
        return rows(feeds.latest_lists(spark, str(out)), "hostname", "user", "event_id")

    first = go()
    newest = max((check / "commits").glob("[0-9]*"), key=lambda path: int(path.name))
    for path in (newest, check / "commits" / f".{newest.name}.crc"):
        path.unlink(missing_ok=True)
    assert go() == first


def test_latest_directory(spark, arriving, tmp_path):
    updates = run(spark, feeds.latest_directory_stream(stream(spark, arriving)), tmp_path)
    newest = updates.groupBy("hostname", "user").agg(F.max_by("pwd", "batch").alias("pwd"))
    want = sequence.latest_directory(source.read_events(spark, arriving))
    assert rows(newest, "hostname", "user", "pwd") == rows(want, "hostname", "user", "pwd")


def test_counts_over_time(spark, arriving, tmp_path):
    updates = run(spark, feeds.commands_over_time_stream(stream(spark, arriving), "1 minute"), tmp_path)
    newest = updates.groupBy("bucket").agg(F.max_by("n", "batch").alias("n"))
    want = usage.commands_over_time(source.read_events(spark, arriving), "1 minute")
    assert rows(newest, "bucket", "n") == rows(want, "bucket", "n")


def test_repeated_and_late_delivery(spark, arriving, tmp_path):
    late = wire(7, start_timestamp="2024-02-29T07:00:00Z")
    odd = [wire(8, start_timestamp=None), wire(8, start_timestamp=None)]
    (tmp_path / "in" / "again.json").write_text("\n".join([*(wire(number) for number in range(100, 120)), late, *odd]) + "\n")
    (tmp_path / "in" / "later.json").write_text("\n".join([wire(3), late, odd[0], wire(3, env={"USER": "other"})]) + "\n")
    out = str(tmp_path / "out")
    feeds.dedupe_stream(stream(spark, arriving), out, str(tmp_path / "check"), NOW).awaitTermination()
    assert spark.read.parquet(out).count() == 120 + 1 + 1 + 1


def delivered(spark, folder, tmp_path, monkeypatch, **options):
    """(archive, folders of identities that each batch asked for)."""
    asked, plain = [], feeds.known_identities
    monkeypatch.setattr(feeds, "known_identities", lambda spark, path, folders: asked.append(sorted(folders)) or plain(spark, path, folders))
    out = str(tmp_path / "out")
    feeds.dedupe_stream(stream(spark, folder), out, str(tmp_path / "check"), NOW, **options).awaitTermination()
    return spark.read.parquet(out), asked


def test_fresh_events_do_not_ask_the_archive(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    fresh = [wire(number, start_timestamp=now, end_timestamp=now) for number in range(30)]
    old = [wire(number) for number in (1, 2)]
    (tmp_path / "in" / "0.json").write_text("\n".join(fresh + old) + "\n")
    (tmp_path / "in" / "1.json").write_text("\n".join([*fresh, *old, wire(3)]) + "\n")
    archive, asked = delivered(spark, str(tmp_path / "in"), tmp_path, monkeypatch)
    assert archive.count() == 33
    # Old events ask for the day and bucket they are in; second deliveries that the state knows ask nothing.
    assert all(slot == "2024-03-01" for folders in asked for slot, _ in folders)
    assert [len(folders) for folders in asked if folders] == [len({b for _, b in asked[0]}), 1]


def test_identities_that_the_state_has_forgotten(spark, arriving, tmp_path, monkeypatch):
    """With no time in the state, only the table knows."""
    (tmp_path / "in" / "again.json").write_text("\n".join(wire(number) for number in range(0, 120, 7)) + "\n")
    archive, _ = delivered(spark, arriving, tmp_path, monkeypatch, keep="0 seconds")
    assert archive.count() == 120
    known = str(tmp_path / "out-identities")
    files = lambda: len(list((tmp_path / "out-identities").glob("slot=*/bucket=*/batch=*/*.parquet")))
    before = files()
    assert feeds.compact_identities(spark, known, str(tmp_path / "check"), "2024-03-02") == ["2024-03-01"]
    assert files() == 16 < before and feeds.compact_identities(spark, known, str(tmp_path / "check"), "2024-03-02") == []
    (tmp_path / "in" / "once_more.json").write_text("\n".join(wire(number) for number in range(110, 130)) + "\n")
    archive, _ = delivered(spark, arriving, tmp_path, monkeypatch, keep="0 seconds")
    assert archive.count() == 130


def test_a_replayed_batch_replaces_itself(spark, arriving, tmp_path, monkeypatch):
    archive, _ = delivered(spark, arriving, tmp_path, monkeypatch)
    check = tmp_path / "check"
    newest = max(int(path.name) for path in (check / "commits").glob("[0-9]*"))
    for path in (check / "commits" / str(newest), check / "commits" / f".{newest}.crc"):
        path.unlink(missing_ok=True)
    archive, _ = delivered(spark, arriving, tmp_path, monkeypatch)
    assert archive.count() == 120


def test_late_events_are_counted(spark, arriving, tmp_path):
    (tmp_path / "in" / "late.json").write_text(wire(7, start_timestamp="2024-03-01T07:00:00Z") + "\n")
    updates = run(spark, feeds.commands_over_time_stream(stream(spark, arriving), "1 minute"), tmp_path)
    newest = updates.groupBy("bucket").agg(F.max_by("n", "batch").alias("n"))
    want = usage.commands_over_time(source.read_events(spark, arriving), "1 minute")
    assert rows(newest, "bucket", "n") == rows(want, "bucket", "n") and newest.agg(F.sum("n")).first()[0] == 121


def test_masked_lines_keep_their_hashes(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.txt").write_text(wire(1, env={"API_KEY": "h8_fcf730b6"}) + "\n" + wire(2, env={"API_KEY": "secret123"}) + "\n")
    raw, archive = spark.readStream.text(str(tmp_path / "raw")), str(tmp_path / "archive")
    feeds.ingest_stream(raw, EnvPolicy(), archive, str(tmp_path / "check"), trigger=NOW).awaitTermination()
    assert {row[0] for row in spark.read.parquet(archive).select(F.col("env")["API_KEY"]).collect()} == {"h8_fcf730b6"}


def test_ingest(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    lines = [wire(number) for number in range(10)] + ["broken", "[1]", "", wire(10, return_code="x")]
    (folder / "a.txt").write_text("\n".join(lines) + "\n")
    (folder / "b.txt").write_text("broken too\n")
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))
    published = []

    def publish(archived, number):
        published.append((number, archived.count(), archived.where("return_code = 0").count()))

    archive, bad = str(tmp_path / "archive"), str(tmp_path / "bad")
    feeds.ingest_stream(
        raw, EnvPolicy(), archive, str(tmp_path / "check"), publish, bad, trigger=NOW
    ).awaitTermination()
    stored = spark.read.parquet(archive)
    assert stored.count() == 11 and stored.where("return_code IS NULL").count() == 1
    assert {row[0] for row in stored.select(F.col("env")["API_KEY"]).collect()} == {"h8_2d711642"}
    assert sorted(row["value"] for row in spark.read.parquet(bad).collect()) == ["[1]", "broken", "broken too"]
    # The batch without a good line publishes nothing.
    assert [entry[1:] for entry in published] == [(11, 5)]


def test_many_subscriptions(spark, make_events):
    events = make_events(
        [{"command": f"c{i}", "return_code": i % 3, "hostname": f"h{i % 2}", "env": {"USER": "u"}} for i in range(12)]
    )
    asked = [("all", {}), ("fails", {"return_code": "1"}), ("both", {"return_code": "1", "hostname": "h0"}),
             ("none", {"env.USER": "u"}), ("odd", {"hostname": "h0", "missing": "1"})]
    frame = spark.createDataFrame(asked, "subscriber_id string, filter map<string,string>")
    found = feeds.match_subscriptions(events, frame).groupBy("subscriber_id").count()
    assert {row[0]: row[1] for row in found.collect()} == {"all": 12, "fails": 4, "both": 2}


def test_odd_subscriptions(spark, make_events):
    events = make_events([{"command": "x", "return_code": None, "hostname": "h"}, {"command": "y", "return_code": 0, "hostname": "h"}])
    asked = [(1, None), (2, {"hostname": None}), (3, {"return_code": "0", "command": "y"}), (4, {"config_version": "1"}), (5, {"command": "z"}), (3, {"hostname": "h"})]
    frame = spark.createDataFrame(asked, "subscriber_id long, filter map<string,string>")
    found = feeds.match_subscriptions(events, frame)
    assert sorted((row["subscriber_id"], row["command"]) for row in found.collect()) == [(1, "x"), (1, "y"), (3, "x"), (3, "y"), (3, "y")]
    assert feeds.match_subscriptions(events, frame.where("subscriber_id = 2")).count() == 0
    assert feeds.match_subscriptions(events, frame.where("subscriber_id = 2")).columns == found.columns


def test_filters_that_begin_alike_meet_only_their_events(spark, make_events):
    events = make_events([{"command": f"c{i}", "hostname": f"h{i}", "config_version": "1"} for i in range(50)])
    asked = [(i, {"_config_version": "1", "hostname": f"h{i}"}) for i in range(10_000)]
    frame = spark.createDataFrame(asked, "subscriber_id long, filter map<string,string>")
    found = feeds.match_subscriptions(events, frame)
    assert sorted(row["subscriber_id"] for row in found.collect()) == list(range(50))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # One join on key set and values, and nothing to be checked after it.
    assert plan.count("Join Inner, (") == 1 and "forall" not in plan.split("Join Inner")[1].split("\n")[0]


def test_metrics(spark, arriving, tmp_path):
    watched = feeds.stream_metrics(stream(spark, arriving), "feed")
    running = feeds.store_batches(watched.drop("env"), str(tmp_path / "o"), str(tmp_path / "c"), "append", NOW)
    running.awaitTermination()
    reports = [p["observedMetrics"]["feed"] for p in running.recentProgress if p["numInputRows"]]
    assert [(r["published"], r["failed"]) for r in reports] == [(40, 20)] * 3


def test_totals_survive_forgotten_reports_and_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    kept = str(tmp_path / "kept")
    listener = totals.MetricTotals(spark, kept)
    spark.streams.addListener(listener)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        for part in range(2):  # two runs of four batches each
            for number in range(part * 4, part * 4 + 4):
                (folder / f"{number}.json").write_text("\n".join(wire(number * 10 + k) for k in range(10)) + "\n")
            watched = feeds.stream_metrics(stream(spark, str(folder)), "feed").drop("env")
            running = feeds.store_batches(watched, str(tmp_path / "o"), str(tmp_path / "c"), "append", NOW)
            running.awaitTermination()
            listener.catch_up(running)
            assert len(running.recentProgress) <= 2
    finally:
        spark.streams.removeListener(listener)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    want = [("feed.failed", 40, 8), ("feed.published", 80, 8)]
    assert rows(totals.metric_totals(spark, kept), "metric", "total", "batches") == want
    assert len(list((tmp_path / "kept").glob("query=*/batch=*"))) == 2
    # A batch that is reported again, by another driver, counts once.
    again = totals.MetricTotals(spark, kept)
    query = next(path.name.partition("=")[2] for path in (tmp_path / "kept").glob("query=*"))
    again.add(query, 7, {"feed.failed": 5, "feed.published": 10})
    assert rows(totals.metric_totals(spark, kept), "metric", "total", "batches") == want


def test_closed_days_are_compacted(spark, arriving, tmp_path):
    (tmp_path / "in" / "next.json").write_text(wire(500, start_timestamp="2024-03-02T07:00:00Z") + "\n")
    archive, kept = str(tmp_path / "archive"), str(tmp_path / "kept")

    def ingest():
        lines = spark.readStream.option("maxFilesPerTrigger", 1).text(arriving)
        feeds.ingest_stream(lines, EnvPolicy(), archive, str(tmp_path / "check"), trigger=NOW).awaitTermination()

    ingest()
    assert [str(day) for day in history.compact_days(spark, archive, kept, "2024-03-02")] == ["2024-03-01"]
    assert history.read_history(spark, kept).count() == 120 and spark.read.parquet(archive).count() == 1
    (tmp_path / "in" / "late.json").write_text(wire(501, start_timestamp="2024-03-01T08:00:00Z") + "\n" + wire(3) + "\n")
    ingest()
    history.compact_days(spark, archive, kept, "2024-03-02")
    assert history.read_history(spark, kept).count() == 121 and history.compact_days(spark, archive, kept, "2024-03-02") == []


def test_events_that_arrive_during_compaction_stay(spark, make_events, tmp_path, monkeypatch):
    archive, kept = str(tmp_path / "archive"), str(tmp_path / "kept")
    first, late = (make_events([{"event_id": i, "start_timestamp": "2024-03-01T08:00:00Z"}]) for i in (1, 2))
    feeds._archive(first, archive, 0)
    plain = history.write_history

    def beside(*args, **named):
        plain(*args, **named)
        feeds._archive(late, archive, 1)

    monkeypatch.setattr(history, "write_history", beside)
    history.compact_days(spark, archive, kept, "2024-03-02")
    monkeypatch.undo()
    assert spark.read.parquet(archive).count() == 1
    history.compact_days(spark, archive, kept, "2024-03-02")
    assert history.read_history(spark, kept).count() == 2
