import base64
import json

from pyspark.sql import functions as F

from shelltrail.functions.policy import EnvPolicy
from shelltrail.operators.filters import filter_env_equals, filter_time_range
from shelltrail.sources import captures, events as source, history

EVENT = {
    "command": "make test",
    "return_code": 2,
    "start_timestamp": "2024-03-01T10:00:00.123456789Z",
    "end_timestamp": "2024-03-01T10:00:01Z",
    "pwd": "/tmp",
    "hostname": "box",
    "env": {"CI": "1"},
    "_config_version": "1.0.0",
    "unknown": [1, 2],
}


def b64(text):
    return base64.b64encode(text.encode()).decode()


def test_lines(spark, tmp_path):
    lines = [
        json.dumps(EVENT), "not json", "[1]", "3", json.dumps({**EVENT, "return_code": "xx"}), "", "null",
        json.dumps(EVENT) + " tail", json.dumps(EVENT) + "}", json.dumps(EVENT) + "]", json.dumps(EVENT) + "\r",
    ]
    frame = spark.createDataFrame([(line,) for line in lines], "value string")
    good, bad = source.split_valid_invalid(frame)
    assert {row["value"] for row in good.collect()} == {lines[0], lines[4], lines[10]}
    assert {row["value"] for row in bad.collect()} == {lines[i] for i in (1, 2, 3, 6, 7, 8, 9)}
    assert sorted(str(row["return_code"]) for row in source.parse_lines(good).collect()) == ["2", "2", "None"]
    counts = history.ingest_metrics(frame).first()
    assert (counts["received"], counts["sent"], counts["errors"]) == (10, 3, 7)
    seen, observation = history.observe_ingest(frame)
    assert seen.count() == 11 and observation.get["errors"] == 7


def test_read_events(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps({**EVENT, "hostname": name, "ip_address": "10.0.0.x"}) + "\n")
    (tmp_path / "c.json").write_text(json.dumps({"command": "ls", "end_timestamp": "nonsense", "ip_address": "::1"}) + "\n")
    rows = source.read_events(spark, [str(tmp_path / "a.json"), str(tmp_path / "[bc].json")]).collect()
    by_host = {row["hostname"]: row for row in rows}
    assert len(rows) == 3 and by_host["a"]["ip_address"] is None and by_host[None]["ip_address"] == "::1"
    assert by_host["a"]["start_timestamp"].microsecond == 123456 and by_host["a"]["env"] == {"CI": "1"}
    assert by_host[None]["end_timestamp"] is None and by_host["a"]["config_version"] == "1.0.0"


def test_damaged_lines_are_no_events(spark, tmp_path):
    lines = [json.dumps(EVENT), "not json", "[1]", "3", "", "null", json.dumps({**EVENT, "return_code": "xx"})]
    (tmp_path / "bad.json").write_text("\n".join(lines) + "\n")
    assert sorted(str(row["return_code"]) for row in source.read_events(spark, str(tmp_path)).collect()) == ["2", "None"]
    stream = source.stream_events(spark, str(tmp_path))
    running = stream.writeStream.format("memory").queryName("damaged").trigger(availableNow=True).start()
    running.awaitTermination()
    assert spark.table("damaged").count() == 2


def test_captures(spark):
    record = {"command": " ls ", "pwd": "/tmp", "start_timestamp": "2024-03-01T10:00:00Z"}
    env = ["CI=1", "CI=2", "no equals", "GIT_PAGER=", "GIT_EDITOR=a=b", "PS1=$", "BASH_X=1", "API_KEY=secret123"]
    rows = [
        (1, b64(json.dumps({**record, "environment": env}))),
        (2, "%%%"),
        (3, b64("{not json")),
        (4, b64(json.dumps({**record, "environment": None}))),
        (5, b64(json.dumps({**record, "start_timestamp": "yesterday"}))),
        (6, b64("[1]")),
    ]
    good, bad = captures.decode_captures(spark.createDataFrame(rows, "n int, capture string"), EnvPolicy())
    found = {row["n"]: row for row in good.collect()}
    assert sorted(found) == [1, 4] and sorted(row["n"] for row in bad.collect()) == [2, 3, 5, 6]
    assert found[1]["env"] == {"CI": "2", "GIT_PAGER": "", "GIT_EDITOR": "a=b", "API_KEY": "h8_fcf730b6"}
    assert found[4]["env"] is None


def test_blobs(spark):
    rows = [(1, b64("CI=1\n\nbroken\nCI=2\nGIT_X=a=b")), (2, "%%%"), (3, "")]
    good, bad = captures.decode_env_blobs(spark.createDataFrame(rows, "n int, blob string"), EnvPolicy())
    assert {row["n"]: row["env"] for row in good.collect()} == {1: {"CI": "2", "GIT_X": "a=b"}, 3: None}
    assert [row["n"] for row in bad.collect()] == [2]


def test_assemble(spark):
    rows = [
        ("\t ls \n", "0", "2024-03-01T10:00:01.5Z", "box", "10.0.0.1"),
        ("blank", "1", "2024-03-01 10:00:01+02:00", None, ""),
        ("now", "-1", "", "box", "zzz"),
        ("code", "1x", "2024-03-01T10:00:01Z", "box", ""),
        ("end", "0", "soon", "box", ""),
        ("short", "0", "2024", "box", ""),
        ("huge", "99999999999", None, "box", ""),
    ]
    decoded = spark.createDataFrame(
        rows, "command string, return_code string, end_timestamp string, hostname string, ip_address string"
    ).withColumns(
        {
            "start_timestamp": F.lit("2024-03-01 10:00:00").cast("timestamp"),
            "pwd": F.lit("/"),
            "env": F.lit(None).cast("map<string,string>"),
        }
    )
    good, bad = captures.assemble_events(decoded, "2024-03-02 00:00:00")
    found = {row["command"]: row for row in good.collect()}
    assert sorted(found) == ["blank", "ls", "now"]
    assert found["blank"]["hostname"] == "unknown" and found["blank"]["end_timestamp"].hour == 8
    assert found["now"]["end_timestamp"].day == 2 and found["now"]["ip_address"] is None
    assert found["ls"]["ip_address"] == "10.0.0.1" and found["ls"]["end_timestamp"].microsecond == 500000
    assert sorted(row["command"] for row in bad.collect()) == ["code", "end", "huge", "short"]


def test_history(spark, make_events, tmp_path):
    events = make_events(
        [
            {"command": f"c{i}", "start_timestamp": f"2024-03-{1 + i % 5:02d} 12:00:00", "env": {"API_KEY": "x", "CI": str(i % 2)}}
            for i in range(50)
        ]
    )
    path = str(tmp_path / "h")
    history.write_history(events, path, promote=("CI",))
    history.write_history(events.withColumn("event_id", F.col("event_id") + 100), path, promote=("CI",))
    stored = history.read_history(spark, path)
    assert stored.count() == 100
    recent = filter_time_range(stored, 30, "2024-03-05 13:00:00")
    assert recent.count() == 40
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    own = filter_env_equals(stored, "CI", "1")
    assert own.count() == 50 and "EqualTo(env_CI,1)" in own._jdf.queryExecution().executedPlan().toString()
    out = str(tmp_path / "h2")
    again = history.rewrite_history(stored, EnvPolicy(version="9"), out)
    twice = history.rewrite_history(history.read_history(spark, out), EnvPolicy(version="9"))
    for frame in (again, twice):
        assert {(r["env"]["API_KEY"], r["config_version"]) for r in frame.collect()} == {("h8_2d711642", "9")}


def test_union_of_logs(make_events):
    one, other = make_events([{"command": "a"}]), make_events([{"command": "b"}]).drop("config_version")
    assert sorted(row["command"] for row in source.union_logs([one, other]).collect()) == ["a", "b"]
