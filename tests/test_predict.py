from collections import Counter

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from shelltrail.operators import predict
from shelltrail.sources import history
from test_text import python_ngrams

CYCLE = ["git add .", "git commit -m 'x y'", "git push", "make test", "ls -la"]


@pytest.fixture(scope="module")
def log(make_events):
    """A history that repeats itself, with some noise, for two people."""
    rows = []
    for user in ("a", "b"):
        for i in range(400):
            command = CYCLE[i % 5] if i % 17 else f"vim file{i % 3}"
            rows.append(
                {
                    "command": command,
                    "start_timestamp": f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00",
                    "pwd": f"/{user}",
                    "env": {"USER": user},
                }
            )
    return make_events(rows).cache()


@pytest.fixture(scope="module")
def model(log):
    return predict.train_next_command(log, trees=10, max_depth=6, max_classes=6)


def test_vocabulary(log):
    counts = Counter(gram for row in log.collect() for gram in python_ngrams(row["command"]))
    want = sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:200]
    assert [tuple(row) for row in predict.ngram_vocabulary(log).collect()] == want


def test_features(log, model):
    features, position = model.features, {gram: i for i, gram in enumerate(model.features.vocabulary)}
    weights, days = dict(features.hours), dict(features.weekdays)
    assert sum(weights.values()) == pytest.approx(1) and sum(days.values()) == pytest.approx(1)
    for row in features.transform(log).limit(50).collect():
        values = row["features"].toArray()
        size = len(position)
        assert len(values) == size + 4
        want = [0.0] * size
        for gram in python_ngrams(row["command"]):
            if gram in position:
                want[position[gram]] += 1
        assert list(values[:size]) == want
        at = row["end_timestamp"]
        assert values[size] == pytest.approx(weights[at.hour]) and values[size + 1] == pytest.approx(days[at.weekday()])
        assert values[size + 2] == 1.0 and values[size + 3] == row["num_args"]


def test_unknown_names_and_hours(log, model, make_events):
    odd = make_events([{"command": "zzz q", "start_timestamp": None, "env": {"USER": "a"}}])
    row = model.features.numbers(odd).first()
    assert row["is_common"] == 0 and row["hour_weight"] == dict(model.features.hours)[0]


def test_accuracy_beats_the_majority(model):
    assert model.accuracy > 0.6


def test_predictions(log, model):
    rows = predict.predict_next_command(model, log, ["user"], 3).collect()
    for user in ("a", "b"):
        mine = sorted((row["place"], row["probability"]) for row in rows if row["user"] == user)
        assert [place for place, _ in mine] == [1, 2, 3]
        assert mine[0][1] >= mine[1][1] >= mine[2][1] and sum(p for _, p in mine) <= 1 + 1e-9
    everything = predict.predict_next_command(model, log, ["user"], 100).where("user = 'a'").collect()
    assert 0.5 < sum(row["probability"] for row in everything) <= 1 + 1e-9
    assert {row["command"] for row in everything} == set(model.labels)


def test_other_commands_are_never_offered(log):
    narrow = predict.train_next_command(log, trees=5, max_depth=4, max_classes=2)
    rows = predict.predict_next_command(narrow, log, ["user"], 100).collect()
    assert {row["command"] for row in rows} == set(narrow.labels) and len(narrow.labels) == 2


def test_a_command_called_other(make_events):
    commands = ["OTHER", "ls", "OTHER", "cd"]
    events = make_events([{"command": commands[i % 4], "start_timestamp": f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", "env": {"USER": "u"}} for i in range(200)])
    model = predict.train_next_command(events, trees=5, max_depth=4)
    assert sorted(model.labels) == ["OTHER", "cd", "ls"] and model.train_rows + model.test_rows == 199


def test_too_many_labels_are_refused(log, monkeypatch):
    monkeypatch.setattr(predict, "MOST_CLASSES", 3)
    with pytest.raises(ValueError, match="max_classes"):
        predict.train_next_command(log, trees=2, max_depth=2)


def test_same_seed_same_model(log, model):
    again = predict.train_next_command(log, trees=10, max_depth=6, max_classes=6)
    assert again.accuracy == model.accuracy and again.labels == model.labels


def test_rare_labels_are_errors_not_hits(log):
    narrow = predict.train_next_command(log, trees=5, max_depth=4, max_classes=1)
    assert len(narrow.labels) == 1 and narrow.accuracy <= 0.25


def test_two_classes_after_an_observation(log, spark):
    lines = log.select(F.to_json(F.struct("command")).alias("value"))
    watched, counts = history.observe_ingest(lines)
    assert watched.count() == 800 and counts.get["received"] == 800
    found = predict.train_next_command(log, trees=3, max_depth=4, max_classes=1)
    listed = predict.predict_next_command(found, log, ["hostname", "user"], 1).collect()
    assert len(listed) == 2 and {row["command"] for row in listed} == set(found.labels)


def test_many_labels_do_not_grow_the_plan(spark):
    def scored(n):
        rows = [(i, Vectors.dense([float((j * 37 + i) % 11 == 0) * (j % 5) for j in range(n)] + [99.0])) for i in range(6)]
        names = [f"command {j}" for j in range(n)]
        frame = spark.createDataFrame(rows, ["id", "probability"])
        return rows, names, predict.top_k_probabilities(frame, names, ["id"], 4)

    sizes = []
    for n in (50, 10_000):
        rows, names, best = scored(n)
        got = {}
        for row in best.orderBy("id", "place").collect():
            got.setdefault(row["id"], []).append((row["place"], row["command"], row["probability"]))
        for i, vector in rows:
            want = sorted(((-p, j) for j, p in enumerate(vector.toArray()[:n])))[:4]
            assert got[i] == [(place, names[j], -p) for place, (p, j) in enumerate(want, 1)]
        plan = best._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan))
    assert sizes[1] < sizes[0] + 200
