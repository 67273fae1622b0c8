"""Predicting the next command with a random forest over the text and time of the current one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from shelltrail.functions.text import char_ngrams, command_name, is_blank, shell_words, word_ngrams, words
from shelltrail.operators.sequence import BY, newest_first, next_command, scan_cap
from shelltrail.operators.usage import count_rows, command_name_frequency, time_unit
from shelltrail.plans.ordered import DEFAULT_CUTS, Cuts
from shelltrail.plans.top import first_per_key
from shelltrail.schema import with_user
from shelltrail.session import Folder, scratch_path

#: More labels than this are refused, unless the caller asks for the most frequent ones only.
MOST_CLASSES = 10_000


def ngram_vocabulary(rows: DataFrame, size: int = 200, column: str = "command") -> DataFrame:
    """The most frequent character n-grams. Words are counted first, so each distinct word is cut up once."""
    counted = rows.select(F.explode(words(F.col(column))).alias("word")).groupBy("word").agg(count_rows().alias("n"))
    grams = counted.select(F.explode(word_ngrams(F.col("word"))).alias("ngram"), "n")
    return grams.groupBy("ngram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ngram").limit(size)


def weight_lookup(rows: DataFrame, weights: DataFrame, unit: str) -> DataFrame:
    """Adds the weight of the row's hour or weekday, 0 where it has none. ``weights`` has at most 24 rows."""
    found = weights.select(F.col(unit).alias("_unit"), F.col("weight").alias("_weight"))
    joined = rows.join(F.broadcast(found), time_unit(unit) == F.col("_unit"), "left")
    return joined.withColumn(f"{unit}_weight", F.coalesce("_weight", F.lit(0.0))).drop("_unit", "_weight")


def common_flag(rows: DataFrame, common: DataFrame) -> DataFrame:
    """Adds 1 for a command name in ``common``, else 0. Its size is the caller's choice, so Spark picks the join."""
    found = common.select(F.col("command_name").alias("_name"))
    joined = rows.join(found, F.col("command_name") == F.col("_name"), "left")
    return joined.withColumn("is_common", F.col("_name").isNotNull().cast("int")).drop("_name")


def _commands(events: DataFrame) -> DataFrame:
    return events.where(F.col("command").isNotNull() & ~is_blank(F.col("command")))


def with_parts(events: DataFrame) -> DataFrame:
    return _commands(events).withColumns(
        {
            "command_name": command_name(F.col("command")),
            "num_args": F.size(shell_words(F.col("command"))) - 1,
        }
    )


def _shares(counts: list[tuple]) -> list[tuple]:
    total, found = sum(n for _, n in counts), {}
    for unit, n in counts:
        found[unit] = found.get(unit, 0) + n
    return [(unit, n / total) for unit, n in sorted(found.items())]


@dataclass
class CommandFeatures:
    """Fitted feature tables. All of them are small whatever the size of the log:
    at most 200 n-grams, 24 hours, 7 weekdays and 100 names."""

    vocabulary: list[str]
    hours: list[tuple]
    weekdays: list[tuple]
    common: list[str]

    @staticmethod
    def fit(events: DataFrame, vocabulary_size: int = 200, common_size: int = 100) -> CommandFeatures:
        commands = _commands(events)
        # At most 168 rows, which give the shares of both units.
        timed = commands.groupBy(time_unit("hour").alias("hour"), time_unit("weekday").alias("weekday")).agg(count_rows().alias("n"))
        counted = [(row["hour"], row["weekday"], row["n"]) for row in timed.collect()]
        return CommandFeatures(
            vocabulary=[row["ngram"] for row in ngram_vocabulary(commands, vocabulary_size).collect()],
            hours=_shares([(hour, n) for hour, _, n in counted]),
            weekdays=_shares([(weekday, n) for _, weekday, n in counted]),
            common=[row["command_name"] for row in command_name_frequency(commands, common_size).collect()],
        )

    def numbers(self, events: DataFrame) -> DataFrame:
        """The four features that are not text."""
        spark = events.sparkSession
        hours = spark.createDataFrame(self.hours, "hour int, weight double")
        weekdays = spark.createDataFrame(self.weekdays, "weekday int, weight double")
        common = spark.createDataFrame([(name,) for name in self.common], "command_name string")
        rows = weight_lookup(weight_lookup(with_parts(events), hours, "hour"), weekdays, "weekday")
        return common_flag(rows, common)

    def transform(self, events: DataFrame) -> DataFrame:
        """Adds ``features``: n-gram counts, hour weight, weekday weight, common flag, number of arguments."""
        rows = self.numbers(events).withColumn("_ngrams", char_ngrams(F.col("command")))
        counts = CountVectorizerModel.from_vocabulary(self.vocabulary, "_ngrams", "_counts")
        inputs = ["_counts", "hour_weight", "weekday_weight", "is_common", "num_args"]
        return (
            VectorAssembler(inputCols=inputs, outputCol="features")
            .transform(counts.transform(rows))
            .drop("_ngrams", "_counts")
        )


@dataclass
class NextCommandModel:
    """``labels`` are commands; a row beyond them has the class after the last, which has no name."""

    features: CommandFeatures
    labels: list[str]
    forest: RandomForestClassificationModel
    accuracy: float | None
    train_rows: int
    test_rows: int


def _indexed(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Adds ``label``; commands that are not among the labels get the number after the last."""
    return StringIndexerModel.from_labels(labels, "next_cmd", "label", handleInvalid="keep").transform(rows)


def is_training_row() -> Column:
    """Four fifths of the rows, by their id, so that the split survives a retry. Neighbouring ids are spread."""
    return F.pmod(F.pmod(F.col("event_id"), F.lit(1_000_003)) * 7919, F.lit(1000)) < 800


def train_next_command(
    events: DataFrame,
    trees: int = 100,
    max_depth: int = 30,
    max_classes: int | None = None,
    seed: int = 42,
    by: list[str] = BY,
    max_commands: int | None = None,
    cuts: Cuts = DEFAULT_CUTS,
) -> NextCommandModel:
    """Learns from the successful history; the label is the next whole command.

    With ``max_classes`` only the most frequent commands are labels, and all
    others one class that is never offered and never a hit. Training rows give
    the forest, the others its accuracy.
    """
    spark = events.sparkSession
    good = events.where(F.col("return_code") == 0)
    if max_commands is not None:
        good = scan_cap(good, max_commands)
    paths: list[str] = []

    def written(rows: DataFrame, label: str) -> DataFrame:
        # In between: many passes follow, and after a lost executor they must see the same rows.
        paths.append(scratch_path(spark, label))
        rows.write.parquet(paths[-1])
        return spark.read.parquet(paths[-1])

    try:
        times = ["event_id", "command", "ingest_timestamp", "end_timestamp"]
        good = written((with_user(good) if "user" in by else good).select(*times, *by), "successful")
        features = CommandFeatures.fit(good)
        labelled = written(next_command(good, by, cuts).select(*times, "next_cmd"), "labelled")
        counted = labelled.groupBy("next_cmd").agg(count_rows().alias("n")).orderBy(F.desc("n"), "next_cmd")
        labels = [row["next_cmd"] for row in counted.limit(max_classes or MOST_CLASSES + 1).collect()]
        if max_classes is None and len(labels) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} different commands; pass max_classes")
        prepared = written(
            features.transform(_indexed(labelled, labels)).select("event_id", "features", "label", (F.col("label") < len(labels)).alias("known")),
            "training",
        )
        train, test = prepared.where(is_training_row()), prepared.where(~is_training_row())
        forest = RandomForestClassifier(
            numTrees=trees, maxDepth=max_depth, seed=seed, featuresCol="features", labelCol="label", maxMemoryInMB=1024
        ).fit(train)
        # A forest of two classes holds on to its training summary, and through it to the session, which tasks cannot
        # take along; one that was saved and loaded does not.
        paths.append(scratch_path(spark, "forest"))
        forest.write().save(paths[-1])
        forest = RandomForestClassificationModel.load(paths[-1])
        return NextCommandModel(features, labels, forest, evaluate_accuracy(forest, test), train.count(), test.count())
    finally:
        for path in paths:
            Folder(spark, path).delete()


def evaluate_accuracy(forest: RandomForestClassificationModel, test: DataFrame) -> float | None:
    """The share of exact matches; a command that is no label counts as an error."""
    hit = F.col("known") & (F.col("label") == F.col("prediction"))
    return forest.transform(test).agg(F.avg(hit.cast("double"))).first()[0]


def top_k_probabilities(predicted: DataFrame, labels: list[str], keys: list[str], k: int = 5) -> DataFrame:
    """The ``k`` most probable labels per row, best first; of equal ones the more frequent label, which has the lower number.
    The class without a name is never among them.

    Rows carry numbers: the k-th largest probability is found first, and only the classes that reach it are put in order.
    Names, MOST_CLASSES at most, come from one broadcast join with the places; the plan does not grow with them.
    """
    named = F.slice(vector_to_array("probability"), 1, len(labels))
    least = F.element_at(F.sort_array("_named", asc=False), F.least(F.lit(k), F.size("_named")))
    classes = F.transform("_named", lambda p, i: F.struct((-p).alias("order"), i.alias("label")))
    best = F.slice(F.array_sort(F.filter(classes, lambda c: -c["order"] >= F.col("_least"))), 1, k)
    rows = predicted.select(*keys, named.alias("_named")).where(F.size("_named") > 0).withColumn("_least", least)
    placed = rows.select(*keys, F.posexplode(best).alias("place", "_class"))
    names = predicted.sparkSession.createDataFrame(list(enumerate(labels)), "_label int, command string")
    return placed.join(F.broadcast(names), F.col("_class.label") == F.col("_label")).select(
        *keys, (F.col("place") + 1).alias("place"), "command", (-F.col("_class.order")).alias("probability")
    )


def predict_next_command(
    model: NextCommandModel, events: DataFrame, keys: list[str] | None = None, k: int = 5
) -> DataFrame:
    """After the latest successful command of every key, the ``k`` most likely next ones."""
    keys = keys or ["pwd"]
    source = with_user(events) if "user" in keys else events
    good = _commands(source).where(F.col("return_code") == 0)
    latest = first_per_key(good, keys, newest_first(), 1, "event_id")
    predicted = model.forest.transform(model.features.transform(latest))
    return top_k_probabilities(predicted, model.labels, keys, k)
