import pytest
from pyspark.sql import functions as F

from shelltrail.functions.policy import EnvPolicy
from shelltrail.operators import directories, drift, filters, live, suggest, usage
from shelltrail.operators.policy import mask_environment

AS_OF = "2024-02-01 00:00:00"


def test_scored_keys():
    assert [key for key in ("NODE_ENV", "ENVIRONMENT", "USER", "TERMINAL", "PWD", "_", "X") if suggest.is_scored(key)] == [
        "ENVIRONMENT", "USER", "X",
    ]
    assert suggest.is_scored("NODE_ENV", "intended") and not suggest.is_scored("_", "intended")
    assert (suggest.boost("AWS_PROFILE"), suggest.boost("HOME"), suggest.boost("X")) == (3.0, 2.0, 1.5)


@pytest.mark.parametrize("age, expected", [(0.5, 2.0), (1, 1.0), (3, 1.0), (10, 0.5), (30, 0.0)])
def test_recency(spark, age, expected):
    last = F.expr(f"timestamp'{AS_OF}' - make_dt_interval(0, {int(age * 24)})")
    assert spark.range(1).select(suggest.recency_score(last, AS_OF)).first()[0] == expected


def test_newest_score_and_best_context(make_events):
    events = make_events(
        [
            {"command": "git x", "pwd": "/p", "start_timestamp": "2024-01-01 00:00:00", "env": {"USER": "u", "ENVIRONMENT": "p"}},
            {"command": "git x", "pwd": "/p", "start_timestamp": "2024-01-31 12:00:00", "env": {"USER": "v"}},
            {"command": "failed", "pwd": "/p", "return_code": 1, "start_timestamp": "2024-01-31 12:00:00"},
            {"command": "elsewhere", "pwd": "/q", "start_timestamp": "2024-01-31 12:00:00"},
            {"command": "make", "pwd": "/p", "start_timestamp": "2024-01-20 12:00:00", "env": {"USER": "v"}},
        ]
    )
    found = suggest.suggest_commands(events, "/p", {"USER": "u", "ENVIRONMENT": "p"}, 10, AS_OF, scoring="boost", best_hits=20)
    rows = [tuple(row)[:3] + (row["context"],) for row in found.collect()]
    assert rows == [
        ("git x", pytest.approx(0.0 + 0.2 + 2.0), 2, "2 env vars match, git workflow"),
        ("make", pytest.approx(0.1 + 0.5), 1, "similar directory"),
    ]
    whole = suggest.suggest_commands(
        events, "/p", {"USER": "u", "ENVIRONMENT": "p"}, 10, AS_OF, scoring="boost"
    )
    assert [tuple(row)[:3] for row in whole.collect()] == [row[:3] for row in rows]


def test_hits_are_cut_before_counting(make_events):
    events = make_events(
        [{"command": f"c{i % 2}", "pwd": "/p", "start_timestamp": f"2024-01-01 00:{i:02d}:00"} for i in range(10)]
    )
    found = suggest.suggest_commands(events, "/p", {}, 2, AS_OF, best_hits=4)
    assert {row["command"]: row["frequency"] for row in found.collect()} == {"c0": 2, "c1": 2}


def test_every_hit_counts_by_default(make_events):
    events = make_events(
        [{"command": f"c{i % 2}", "pwd": "/p", "start_timestamp": f"2024-01-01 00:{i:02d}:00"} for i in range(40)]
    )
    for limit in (1, 2):
        found = suggest.suggest_commands(events, "/p", {}, limit, AS_OF)
        assert {row["frequency"] for row in found.collect()} == {20}


def test_hashed_variables_match_through_the_policy(spark, make_events):
    policy = EnvPolicy()
    stored = mask_environment(make_events([{"command": "x", "pwd": "/p", "start_timestamp": AS_OF, "env": {"API_KEY": "s"}}]), policy)
    plain = suggest.suggest_commands(stored, "/p", {"API_KEY": "s"}, 1, AS_OF).first()["context"]
    masked = suggest.suggest_commands(stored, "/p", {"API_KEY": "s"}, 1, AS_OF, mask=policy).first()["context"]
    assert (plain, masked) == ("similar directory", "1 env vars match")
    asked = spark.createDataFrame([(1, "/p", {"API_KEY": "s"})], "context_id int, pwd string, env map<string,string>")
    assert suggest.suggest_commands_bulk(stored, asked, 1, AS_OF, mask=policy).first()["context"] == "1 env vars match"


def test_kept_statistics_give_the_same_scores(make_events):
    rows = [{"command": f"c{i % 3}", "pwd": f"/p{i % 2}", "start_timestamp": f"2024-01-{1 + i % 20:02d} 00:00:00", "env": {"USER": f"u{i % 4}", "X": str(i % 5)}} for i in range(60)]
    events = make_events([*rows, {"command": "x", "pwd": None, "env": None}, {"command": "y", "pwd": "/p0", "env": {"USER": None}}])
    first, second = events.where("event_id < 30"), events.where("event_id >= 30")
    kept = suggest.match_statistics(first).unionByName(suggest.match_statistics(second))
    for env in ({"USER": "u1", "X": "3", "NEW": "z"}, {}):
        want = sorted(tuple(r) for r in suggest.context_score(events, "/p0", env).select("event_id", "score").collect())
        assert sorted(tuple(r) for r in suggest.context_score(events, "/p0", env, statistics=kept).select("event_id", "score").collect()) == want


def test_bulk_equals_one_by_one(spark, make_events):
    events = make_events(
        [
            {
                "command": f"c{i % 5}",
                "pwd": f"/p{i % 2}",
                "return_code": int(i % 7 == 0),
                "start_timestamp": f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00",
                "env": {"USER": f"u{i % 3}", "ENVIRONMENT": f"e{i % 2}", "X_Y": str(i)},
            }
            for i in range(120)
        ]
    )
    contexts = [(0, "/p0", {"USER": "u1", "ENVIRONMENT": "e0"}), (1, "/p1", {"USER": "u2", "X_Y": "5"}), (2, "/p0", {}),
                (3, "/p0", {"USER": "u1", "ENVIRONMENT": "e0"}), (4, "/nowhere", {"USER": "u1"}), (5, "/p1", None)]
    frame = spark.createDataFrame(contexts, "context_id int, pwd string, env map<string,string>")
    for scoring, best_hits in (("bm25", 6), ("boost", 6), ("bm25", None)):
        bulk = suggest.suggest_commands_bulk(events, frame, 3, AS_OF, scoring=scoring, best_hits=best_hits).orderBy("context_id", "place")
        got = [(r["context_id"], r["command"], r["score"], r["frequency"], r["context"]) for r in bulk.collect()]
        want = []
        for number, pwd, env in contexts:
            single = suggest.suggest_commands(events, pwd, env or {}, 3, AS_OF, scoring=scoring, best_hits=best_hits)
            want += [(number, r["command"], r["score"], r["frequency"], r["context"]) for r in single.collect()]
        assert [row[:2] + row[3:] for row in got] == [row[:2] + row[3:] for row in want]
        assert [row[2] for row in got] == pytest.approx([row[2] for row in want])


@pytest.mark.parametrize(
    "command, pwd, expected",
    [
        ("cd ~", "/w", "/home/u"),
        ("cd ~/src~", "/w", "/home/u/src~"),
        ('cd "a b"', "/w", "/w/a b"),
        ("cd ..", "/w", "/w/.."),
        ("cd x", None, "x"),
        ("cd '/var/log'", None, "/var/log"),
    ],
)
def test_cd_target(spark, command, pwd, expected):
    frame = spark.createDataFrame([(command, pwd, "/home/u")], "c string, p string, h string")
    assert frame.select(directories.cd_target(F.col("c"), F.col("p"), F.col("h"))).first()[0] == expected


def test_decoys_use_up_the_cap(make_events):
    commands = ["cd /old", "cdrecord x", "echo cd /tmp", "cd /new"]
    events = make_events(
        [{"command": c, "start_timestamp": f"2024-01-31 0{i}:00:00", "env": {}} for i, c in enumerate(commands)]
    )
    paths = lambda cap: {r["path"] for r in directories.rank_directories(events, AS_OF, cap_cd=cap).collect()}
    assert paths(3) == {"/new"} and paths(4) == {"/new", "/old"}


def test_frecency(spark, make_events):
    events = make_events(
        [{"command": "ls", "start_timestamp": "2024-01-31 00:00:00", "env": {"PWD": "/often"}} for _ in range(10)]
        + [{"command": "ls", "start_timestamp": AS_OF, "env": {"PWD": "/now"}}]
        + [{"command": "ls", "start_timestamp": None, "env": {"PWD": "/undated"}}]
    )
    found = {r["path"]: (r["frequency"], round(r["score"], 6)) for r in directories.rank_directories(events, AS_OF).collect()}
    assert found == {"/often": (10, 38.0), "/now": (1, 70.3), "/undated": (1, 35.3)}


def test_current_directory_and_ancestors(make_events):
    events = make_events([{"command": "ls", "start_timestamp": "2024-01-01 00:00:00", "env": {"PWD": "/a"}}])
    found = {r["path"]: (r["frequency"], str(r["last_used"])) for r in directories.rank_directories(events, AS_OF, cwd="/a/b/c").collect()}
    assert found == {
        "/a/b/c": (1, "2024-02-01 00:00:00"),
        "/a/b": (1, "2024-01-31 22:00:00"),
        "/a": (2, "2024-01-01 00:00:00"),
    }
    root = directories.rank_directories(events.limit(0), AS_OF, cwd="/").collect()
    assert [r["path"] for r in root] == ["/"]


def test_inventory(spark, make_events):
    events = make_events(
        [{"command": "ls", "start_timestamp": AS_OF, "hostname": h, "env": {"PWD": "/x"}} for h in ("h1", "h2")]
    )
    inventory = spark.createDataFrame([("h1", "/x")], "hostname string, path string")
    found = directories.rank_directories(events, AS_OF, cwd="/gone", inventory=inventory).collect()
    assert {r["path"]: r["frequency"] for r in found} == {"/x": 1, "/gone": 1}


def window(make_events, rows):
    return make_events(
        [{"command": c, "pwd": p, "return_code": rc, "start_timestamp": f"2024-01-01 00:0{i}:00"} for i, (c, p, rc) in enumerate(rows)]
    ).withColumn("user", F.lit("u"))


def test_live_suggestions(make_events):
    rows = [("git a", "/src", 0), ("ls", "/tmp", 0), ("ls", "/src", 0), ("ls", "/src", 0), ("ls", "/src", 0)]
    offered = [r["suggestion"] for r in live.live_suggestions(window(make_events, rows)).orderBy("place").collect()]
    assert offered == ["git status", "git log --oneline -10", "ls -la"]
    failed = [("git a", "/src", 1), *rows[1:]]
    offered = [r["suggestion"] for r in live.live_suggestions(window(make_events, failed)).orderBy("place").collect()]
    assert offered == ["ls -la", "find . -name '*.go' -o -name '*.py' -o -name '*.js'"]
    assert live.live_suggestions(window(make_events, rows[:4])).count() == 0


def test_subscription_filters(make_events):
    events = make_events(
        [
            {"command": "a", "return_code": 130, "start_timestamp": "2024-01-01 00:00:00.500000", "env": {"USER": "u"}},
            {"command": "b", "return_code": None, "start_timestamp": "2024-01-01 00:00:00"},
        ]
    )
    got = lambda text: [r["command"] for r in filters.filter_subscription(events, text).collect()]
    assert got("") == ["a", "b"] and got("nonsense") == ["a", "b"]
    assert got(" return_code = 130 ") == ["a"] and got("missing=1") == [] and got("env=x") == [] and got("env.USER=u") == []
    assert got("start_timestamp=2024-01-01T00:00:00.5Z") == ["a"] and got("start_timestamp=2024-01-01T00:00:00Z") == ["b"]


def test_outcome_filters(make_events):
    events = make_events([{"command": str(rc), "return_code": rc} for rc in (0, 1, None)])
    assert [r["command"] for r in filters.successful_commands(events).collect()] == ["0"]
    assert [r["command"] for r in filters.failed_commands(events).collect()] == ["1", "None"]


def test_all_variables_are_counted(spark, make_events):
    events = make_events([{"command": "x", "start_timestamp": AS_OF, "env": {f"V{i}": "1" for i in range(1500)}}])
    mapped = spark.createDataFrame([("V0",)], "key string")
    assert drift.unmapped_fields(events, mapped, 24, AS_OF).count() == 1499
    assert drift.unmapped_fields(events, mapped, 24, AS_OF, 1000).count() == 1000
    counts = {r["section"]: r["n"] for r in drift.drift_report(events, mapped, AS_OF).collect() if r["place"] == 1}
    assert counts["status"] == 1499 and counts["fields_in_use"] == 1500


def test_long_commands_are_counted(make_events):
    events = make_events([{"command": "a" * 2000}] * 2)
    assert usage.top_commands(events).first()["n"] == 2 and usage.top_commands(events, longest=1024).count() == 0


def test_drift_report(spark, make_events):
    env = {f"V{i:02d}_PORT" if i % 2 else f"V{i:02d}": "x" for i in range(30)}
    events = make_events([{"command": "x", "start_timestamp": "2024-01-31 20:00:00", "env": {**env, "PWD": "/"}}])
    mapped = spark.createDataFrame([("PWD",), ("PWD",)], "key string")
    report = drift.drift_report(events, mapped, AS_OF).collect()
    sections = {name: [r["key"] for r in report if r["section"] == name] for name in {r["section"] for r in report}}
    assert sections["status"] == ["alert"] and len(sections["unmapped"]) == 20 and len(sections["suggestion"]) == 10
    assert [r["n"] for r in report if r["section"] in ("status", "fields_in_use")] == [30, 31]
    calm = drift.drift_report(events, mapped, AS_OF, threshold=30).collect()
    assert {r["section"] for r in calm} == {"status", "fields_in_use"} and calm[0]["key"] == "ok"


def test_oversized_values(make_events):
    events = make_events(
        [{"command": "c" * 1025, "pwd": "/" + "p" * 512, "env": {"A": "v" * 257, "B": "/" + "p" * 511, "C": "1." + "0" * 300}}]
    )
    assert {r["field"]: r["n_events"] for r in drift.oversized_values(events).collect()} == {"command": 1, "pwd": 1, "env.A": 1}


def test_type_consistency(make_events):
    events = make_events([{"env": {"A": "/x", "B": "y"}}, {"env": {"A": "https://x", "B": "z"}}])
    found = {(r["key"], r["value_class"]): (r["n_events"], r["consistent"]) for r in drift.env_type_consistency(events).collect()}
    assert found == {("A", "path"): (1, False), ("A", "url"): (1, False), ("B", "string"): (2, True)}
