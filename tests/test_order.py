import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from shelltrail.operators import sequence
from shelltrail.plans.ordered import Cuts, cut_into_pieces, with_neighbour
from shelltrail.plans.top import first_per_key

TIGHT = Cuts(20)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, many of them at the very same moment; some keys and times are null."""
    chance, start = random.Random(1), dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else chance.choice(["a", "b", None])
        at = None if i % 50 == 0 else start + dt.timedelta(hours=chance.choice([0, 0, 0, chance.randint(0, 200)]))
        rows.append((i, key, at, f"c{chance.randint(0, 9)}"))
    return spark.createDataFrame(rows, "id long, k string, at timestamp, c string").repartition(5).cache()


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("cuts", [Cuts(), TIGHT])
def test_neighbours_equal_a_plain_window(skewed, ahead, cuts):
    found = with_neighbour(skewed, ["k"], "at", "id", {"n": F.col("c"), "m": F.col("id")}, ahead, cuts)
    look, window = F.lead if ahead else F.lag, Window.partitionBy("k").orderBy("at", "id")
    plain = skewed.withColumn("n", look("c").over(window)).withColumn("m", look("id").over(window))
    key = lambda row: row["id"]
    assert sorted(found.collect(), key=key) == sorted(plain.collect(), key=key)


def test_one_order_over_everything(skewed):
    found = with_neighbour(skewed, [], "at", "id", {"m": F.col("id")}, cuts=TIGHT)
    plain = skewed.withColumn("m", F.lag("id").over(Window.orderBy("at", "id")))
    assert sorted(found.select("id", "m").collect()) == sorted(plain.select("id", "m").collect())


def test_hot_keys_are_cut(skewed):
    pieces = cut_into_pieces(skewed, ["k"], "at", "id", TIGHT)
    sizes = pieces.where("at IS NOT NULL").groupBy("k", "_day", "_piece").count()
    assert sizes.agg(F.max("count")).first()[0] <= 3 * TIGHT.rows
    uncut = cut_into_pieces(skewed, ["k"], "at", "id").groupBy("k", "_day", "_piece").count()
    assert uncut.agg(F.max("count")).first()[0] > 1000


def test_one_sort_and_one_window_over_the_rows(skewed):
    found = with_neighbour(skewed, ["k"], "at", "id", {"m": F.col("id")})
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    windows = [line for line in plan.splitlines() if "Window [" in line or "Window(" in line]
    assert sum("_seen" in line for line in windows) == 1


def test_first_per_key(skewed):
    found = first_per_key(skewed, ["k"], [F.desc("at"), F.desc("id")], 7, "id", rank="place")
    window = Window.partitionBy("k").orderBy(F.desc("at"), F.desc("id"))
    plain = skewed.withColumn("place", F.row_number().over(window)).where("place <= 7")
    assert sorted(found.collect(), key=str) == sorted(plain.collect(), key=str)
    assert found._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 4


def history(make_events, commands, **more):
    return make_events(
        [
            {"command": command, "start_timestamp": f"2024-01-01 00:{i:02d}:00", "env": {"USER": "u"}, **more}
            for i, command in enumerate(commands)
        ]
    )


def test_blank_commands(make_events):
    events = history(make_events, ["git a", "  ", "ls", None, "cd x", "", "pwd"])
    before = {row["command"]: row["previous_cmd"] for row in sequence.previous_command(events).collect()}
    assert before == {"git a": "", "ls": "  ", "cd x": "ls", "pwd": ""}
    after = {row["command"]: row["next_cmd"] for row in sequence.next_command(events).collect()}
    assert after == {"git a": "ls", "ls": "cd x", "cd x": "pwd"}


def test_transitions(make_events):
    events = history(make_events, ["git a", "ls", "git b", "git c", "ls -l", "", "ls"])
    found = {
        (row["prev_name"], row["next_name"]): (row["n"], row["probability"])
        for row in sequence.transition_probabilities(events).collect()
    }
    assert found[("git", "ls")] == (2, 2 / 3) and found[("git", "git")] == (1, 1 / 3)
    assert found[("ls", "git")] == (1, 1.0) and ("", "ls") not in found
    best = {(row["prev_name"], row["rank"]): row["next_name"] for row in sequence.markov_next_command(events, 1).collect()}
    assert best == {("git", 1): "ls", ("ls", 1): "git"}


def test_failed_commands_are_no_predecessors(make_events):
    events = history(make_events, ["a", "b", "c"])
    events = events.withColumn("return_code", F.when(F.col("command") == "b", 1).otherwise(0))
    assert [row["prev_name"] for row in sequence.transition_counts(events).collect()] == ["a"]


def test_directory_probabilities(make_events):
    events = make_events(
        [
            {"command": "ls -l", "env": {"OLDPWD": "/a/src"}},
            {"command": "ls", "env": {"OLDPWD": "/b/src"}},
            {"command": "git x", "env": {"OLDPWD": "/b/src"}},
            {"command": "git x", "env": {"OLDPWD": "/"}},
            {"command": "git x", "env": None},
        ]
    )
    found = {tuple(row) for row in sequence.directory_command_probabilities(events).collect()}
    assert found == {("src", "ls", 2, 2 / 3), ("src", "git", 1, 1 / 3)}


def test_recent_commands_cut_before_dropping(make_events):
    events = history(make_events, ["a", "b", None, "c"], pwd="/x")
    assert [row["command"] for row in sequence.recent_commands(events, 2, "/x").collect()] == ["c"]
    assert [row["command"] for row in sequence.recent_commands(events, 2).collect()] == ["c"]
    assert [row["command"] for row in sequence.recent_commands(events, 3, "/x").collect()] == ["b", "c"]


def test_windows_never_use_one_task(make_events):
    events = history(make_events, ["a", "b"])
    for frame in (
        sequence.previous_command(events),
        sequence.next_command(events),
        sequence.transition_probabilities(events),
        sequence.last_n_events(events),
        sequence.recent_commands(events),
        sequence.command_records(events),
    ):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        # The one allowed is the count behind the sample, which is a sum of partial counts.
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "SinglePartition" in line:
                assert "partial_count(1)" in "".join(lines[i : i + 2])
        assert "Python" not in plan
