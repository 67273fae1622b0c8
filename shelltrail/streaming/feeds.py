"""The log as it arrives: validation, archiving, filtered feeds and live state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from shelltrail.functions.policy import EnvPolicy
from shelltrail.operators.filters import WIRE_NAMES, as_on_wire, filter_subscription
from shelltrail.operators.policy import mask_environment
from shelltrail.plans.once import worked_out
from shelltrail.plans.top import first_per_key
from shelltrail.schema import ACTOR, with_user
from shelltrail.session import Folder, scratch_path
from shelltrail.sources.events import line_status, parse_lines
from shelltrail.sources.history import DAY, with_day

BY = list(ACTOR)


def subscribe(stream: DataFrame, filter_text: str) -> DataFrame:
    """One subscriber's feed: the events that match ``k=v,k2=v2``."""
    return filter_subscription(stream, filter_text)


def match_subscriptions(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Many stored filters (subscriber_id, filter map) against a batch of events, for use per micro-batch.

    Filters are indexed by the set of their keys. For every such set an event shows the values it has there, and meets
    the filters with exactly these values in one join: no event is compared with a filter that it does not match. The
    driver sees the sets of keys, which are sets of the events' columns. A filter with a key that events do not have,
    or with a null value, matches nothing; an empty or null one everything.
    """
    wire = {plain: name for name, plain in WIRE_NAMES.items()}
    shown = {wire.get(name, name): name for name in events.columns if name not in ("env", "event_id")}
    entries = F.array_sort(F.map_entries(F.coalesce("filter", F.create_map().cast("map<string,string>"))))
    known = F.forall(entries, lambda e: e["key"].isin(*shown) & e["value"].isNotNull())
    asked = subscriptions.where(known).select(
        F.col("subscriber_id").alias("_subscriber"),
        F.array_join(F.transform(entries, lambda e: e["key"]), "\n").alias("_keys"),
        F.transform(entries, lambda e: e["value"]).alias("_values"),
    )
    key_sets = sorted(row["_keys"] for row in asked.select("_keys").distinct().collect())
    if not key_sets:
        return events.select(F.lit(None).cast(subscriptions.schema["subscriber_id"].dataType).alias("subscriber_id"), "*").where(F.lit(False))

    def seen(keys: str) -> Column:
        values = [as_on_wire(shown[key]).alias("v") for key in keys.split("\n")] if keys else []
        there = F.lit(True)
        for value in values:
            there = there & value.isNotNull()
        found = F.array(*values) if values else F.array().cast("array<string>")
        return F.when(there, F.struct(F.lit(keys).alias("_keys"), found.alias("_values")))

    met = events.withColumn("_seen", F.explode(F.array_compact(F.array(*[seen(keys) for keys in key_sets]))))
    return met.join(asked, (F.col("_seen._keys") == F.col("_keys")) & (F.col("_seen._values") == F.col("_values"))).select(
        F.col("_subscriber").alias("subscriber_id"), *events.columns
    )


def _archive(good: DataFrame, path: str, batch: int) -> None:
    # Per day one folder for each micro-batch: a batch that is replayed replaces its own files.
    with_day(good).withColumn("batch", F.lit(batch)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(DAY, "batch").parquet(path)


def write_history_stream(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream of events to the dated history, each of them once."""
    return (
        with_day(events)
        .writeStream.format("parquet")
        .partitionBy(DAY)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def ingest_stream(
    lines: DataFrame,
    policy: EnvPolicy,
    path: str,
    checkpoint: str,
    publish: Callable[[DataFrame, int], None] | None = None,
    quarantine: str | None = None,
    carried: tuple[str, ...] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Validates raw lines, archives the events under the policy and then publishes them.

    Lines that the capture side has masked already keep their hashed values.
    Publishing starts when the archive holds the batch, and reads it from there.
    A failure in between replays the batch: subscribers see it at least once.
    """
    judged = worked_out(lines, {"_status": line_status()})

    def archive(frame: DataFrame, number: int) -> None:
        good = parse_lines(frame.where(F.col("_status") == "valid"), carried)
        archived = Observation()
        _archive(mask_environment(good, policy, keep_hashed=True).observe(archived, F.count(F.lit(1)).alias("n")), path, number)
        if quarantine:
            frame.where(F.col("_status") == "invalid").drop("_status").withColumn("batch", F.lit(number)).write.mode(
                "overwrite"
            ).option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(quarantine)
        if publish and archived.get["n"]:
            reader = frame.sparkSession.read.schema(with_day(good).schema).option("basePath", path)
            publish(reader.parquet(f"{path}/{DAY}=*/batch={number}"), number)

    def batch(frame: DataFrame, number: int) -> None:
        # Lines are judged once for the archive and the quarantine.
        frame.persist()
        try:
            archive(frame, number)
        finally:
            frame.unpersist()

    return (
        judged.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


RECENT = ["event_id", "start_timestamp", "command", "return_code", "pwd"]


def recent_events_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    n: int = 20,
    by: list[str] = BY,
    trigger: dict | None = None,
    buckets: int = 64,
) -> StreamingQuery:
    """Keeps the last ``n`` events per key of a stream as a table under ``path``; ``latest_lists`` reads it.

    The table is cut into ``buckets`` by a hash of the key. A micro-batch is cut to ``n`` rows per key before its
    shuffle, and joined with and replaces only the buckets that its keys fall into. Which version of a bucket counts is
    said by a list of at most ``buckets`` rows, written last; the last three lists stay, and what they name, so that a
    replayed batch finds what it started from. ``buckets`` must not change during the life of a table.
    """
    order = [F.desc("start_timestamp"), F.desc("event_id")]

    def batch(frame: DataFrame, number: int) -> None:
        spark = frame.sparkSession
        fresh = with_user(frame).select(*by, *RECENT).withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
        before = [version for version in _versions(spark, path) if version < number]
        placed = _bucket_versions(spark, path, before[-1]) if before else {}
        fresh = first_per_key(fresh, by, order, n, "event_id").persist()
        try:
            touched = {row["bucket"] for row in fresh.select("bucket").distinct().collect()}
            old = {bucket: placed[bucket] for bucket in touched & placed.keys()}
            known = fresh.unionByName(_buckets(spark, path, fresh.schema, old)) if old else fresh
            if touched:
                kept = first_per_key(known, by, order, n, "event_id") if old else known
                # One file per bucket.
                kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/version={number}")
        finally:
            fresh.unpersist()
        now = sorted({**placed, **dict.fromkeys(touched, number)}.items())
        pointers = spark.createDataFrame(now, "bucket int, version long").coalesce(1)
        pointers.write.mode("overwrite").parquet(_version(path, number))
        _forget(spark, path, before[:-2], before[-2:])

    return (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_lists(spark: SparkSession, path: str) -> DataFrame:
    """The current last events per key that ``recent_events_stream`` keeps under ``path``."""
    placed = _bucket_versions(spark, path, _versions(spark, path)[-1])
    if not placed:
        raise ValueError(f"no events have come to {path} yet")
    # Without a schema of its own: the key columns are the stream's.
    first = next(iter(placed.items()))
    schema = spark.read.parquet(_bucket(path, *first)).schema.add("bucket", IntegerType())
    return _buckets(spark, path, schema, placed).drop("bucket")


def _bucket(path: str, bucket: int, version: int) -> str:
    return f"{path}/rows/version={version}/bucket={bucket}"


def _buckets(spark: SparkSession, path: str, schema: StructType, placed: dict[int, int]) -> DataFrame:
    """Rows of the named versions of buckets; no other folder is listed."""
    paths = [_bucket(path, bucket, version) for bucket, version in sorted(placed.items())]
    found = spark.read.schema(StructType([*schema.fields, StructField("version", LongType())])).option("basePath", f"{path}/rows")
    return found.parquet(*paths).select(*schema.names)


def _bucket_versions(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    rows = spark.read.schema("bucket int, version long").parquet(_version(path, version)).collect()
    return {row["bucket"]: row["version"] for row in rows}


def _forget(spark: SparkSession, path: str, old: list[int], kept: list[int]) -> None:
    """Deletes old lists, and the versions of buckets that only they name. A list goes after what it names."""
    still = set().union(*(_bucket_versions(spark, path, version).items() for version in kept))
    for version in old:
        for bucket, written in set(_bucket_versions(spark, path, version).items()) - still:
            Folder(spark, _bucket(path, bucket, written)).delete()
        Folder(spark, _version(path, version)).delete()


def _version(path: str, number: int) -> str:
    return f"{path}/version={number}"


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    numbers = [int(name.partition("=")[2]) for name in Folder(spark, path).names() if name.startswith("version=")]
    return sorted(number for number in numbers if Folder(spark, _version(path, number)).has("_SUCCESS"))


def latest_directory_stream(stream: DataFrame, by: list[str] = BY) -> DataFrame:
    """The newest directory per key, for update mode. Events without one are ignored."""
    known = with_user(stream).withColumn("_pwd", F.col("env")["PWD"]).where(F.col("_pwd") != "")
    newest = F.max(F.struct("start_timestamp", "event_id", F.col("_pwd").alias("pwd")))
    return known.groupBy(*by).agg(newest.alias("_newest")).select(*by, "_newest.pwd", "_newest.start_timestamp")


def commands_over_time_stream(stream: DataFrame, interval: str = "1 hour", late: str | None = None) -> DataFrame:
    """Live counts per interval. The state is one row per interval that ever had an event, and late events are counted.

    With ``late`` closed intervals leave the state; events later than that are then not counted.
    """
    timed = stream.withWatermark("start_timestamp", late) if late else stream
    counted = timed.groupBy(F.window("start_timestamp", interval).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("_w.start").alias("bucket"), "n")


#: What makes two deliveries the same event.
IDENTITY = ["hostname", "user", "start_timestamp", "end_timestamp", "command"]


def dedupe_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    keep: str = "1 day",
    identities: str | None = None,
    slot: str = "yyyy-MM-dd",
    buckets: int = 16,
) -> StreamingQuery:
    """Archives a stream under ``path``, each event once, however late it or its second delivery comes.

    Identities stay in the query's state for ``keep`` after they came; that settles second deliveries that follow soon.
    The clock is that of arrival, so no event is too late for it. All identities are also written to a table
    (``identities``, by default beside ``path``) with a folder per day of the event and bucket of its hash (``slot`` is a
    date pattern; a large fleet has hours and more buckets). A second
    delivery has the times of the first, so one that comes when the state has forgotten it is older than half of ``keep``:
    only such events, and those without a time, ask that table, in the folders they would be in. A batch costs what it
    brings and these folders, whatever the archive has. A clock that is ahead by more than half of ``keep`` can hide a
    second delivery that comes later than ``keep``. A replayed batch replaces its own files. Null parts of an identity are
    equal. ``slot`` and ``buckets`` must not change during the life of a table.
    """
    known = identities or f"{path.rstrip('/')}-identities"
    named = with_day(with_user(stream)).withColumn("_same", F.xxhash64(*IDENTITY)).withColumn("_same2", F.sha2(F.to_json(F.struct(*IDENTITY)), 256))
    fresh = named.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", keep).dropDuplicatesWithinWatermark(["_same2"])
    placed = fresh.withColumn("slot", F.coalesce(F.date_format("start_timestamp", slot), F.lit("none"))).withColumn(
        "bucket", F.pmod("_same", F.lit(buckets)).cast("int")
    )
    old = F.col("start_timestamp").isNull() | (F.col("start_timestamp") < F.expr(f"_arrived - (INTERVAL {keep}) / 2"))
    same = [DAY, "_same", "_same2"]

    def batch(frame: DataFrame, number: int) -> None:
        frame.persist()
        try:
            rows = frame
            asked = [(row["slot"], row["bucket"]) for row in frame.where(old).select("slot", "bucket").distinct().collect()]
            before = known_identities(frame.sparkSession, known, asked)
            if before is not None:
                before = before.where(F.col("batch") != number).select(F.col("_same").alias("k_same"), F.col("_same2").alias("k_same2"))
                rows = frame.join(before, (F.col("_same") == F.col("k_same")) & (F.col("_same2") == F.col("k_same2")), "left_anti")
            rows = rows.withColumn("batch", F.lit(number))
            columns = [*stream.columns, *[c for c in same if c not in stream.columns], "batch"]
            # One file of identities per folder.
            marks = rows.select("_same", "_same2", "slot", "bucket", "batch").repartition("slot", "bucket")
            for table, folders, target in ((rows.select(*columns), [DAY], path), (marks, ["slot", "bucket"], known)):
                table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders, "batch").parquet(target)
        finally:
            frame.unpersist()

    return (
        placed.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def known_identities(spark: SparkSession, path: str, asked: list[tuple[str, int]]) -> DataFrame | None:
    """What the table of identities under ``path`` has in the asked folders (slot, bucket); None if there are none of them."""
    found = []
    for slot in sorted({slot for slot, _ in asked}):
        there = set(Folder(spark, f"{path}/slot={slot}").names())
        found += [f"{path}/slot={slot}/bucket={bucket}" for of, bucket in sorted(asked) if of == slot and f"bucket={bucket}" in there]
    schema = "_same long, _same2 string, slot string, bucket int, batch long"
    return spark.read.schema(schema).option("basePath", path).parquet(*found) if found else None


def compact_identities(spark: SparkSession, path: str, checkpoint: str, before: str) -> list[str]:
    """Makes one file of each bucket's micro-batches, for the slots before ``before``. Returns these slots.

    For a stream that stands still. Only batches that its checkpoint has committed are merged, under the number of the last
    of them, as these are never replayed. A run that broke off is run again.
    """
    committed = max((int(name) for name in Folder(spark, f"{checkpoint}/commits").names() if name.isdigit()), default=-1)
    done = []
    for slot in sorted(name.partition("=")[2] for name in Folder(spark, path).names() if name.startswith("slot=")):
        folder = f"{path}/slot={slot}"
        if not "0" <= slot < before:
            continue
        rows = spark.read.schema("_same long, _same2 string, bucket int, batch long").parquet(folder).where(F.col("batch") <= committed)
        found: dict[int, list[int]] = {}
        for row in rows.select("bucket", "batch").distinct().orderBy("batch").collect():
            found.setdefault(row["bucket"], []).append(row["batch"])
        many = {bucket: batches for bucket, batches in found.items() if len(batches) > 1}
        if not many:
            continue
        staged = scratch_path(spark, "identities")
        try:
            newest = spark.createDataFrame([(bucket, batches[-1]) for bucket, batches in many.items()], "bucket int, newest long")
            one = rows.join(F.broadcast(newest), "bucket").select("_same", "_same2", "bucket", F.col("newest").alias("batch")).distinct()
            one.write.parquet(staged)
            merged = spark.read.parquet(staged).repartition("bucket")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(folder)
        finally:
            Folder(spark, staged).delete()
        for bucket, batches in many.items():
            for number in batches[:-1]:
                Folder(spark, f"{folder}/bucket={bucket}/batch={number}").delete()
        done.append(slot)
    return done


def stream_metrics(stream: DataFrame, name: str = "feed") -> DataFrame:
    """The stream unchanged; every micro-batch reports its counts in the query progress under ``name``."""
    return stream.observe(
        name,
        F.count(F.lit(1)).alias("published"),
        F.count_if(~F.col("return_code").eqNullSafe(0)).alias("failed"),
        F.max("start_timestamp").alias("latest"),
    )


def store_batches(output: DataFrame, path: str, checkpoint: str, mode: str = "update", trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch of ``output`` into its own ``batch=`` folder; a replay replaces that folder."""

    def batch(frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        output.writeStream.outputMode(mode)
        .foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
