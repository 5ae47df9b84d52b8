"""The log: Kafka or files, JSON codecs, inspection, positions and lag, result sinks.

Kafka needs the public ``spark-sql-kafka`` connector on the class path. A log may also lie in Parquet files with the columns of
``LOG_RECORD``, appended to by ``write_log``: readers, positions, codecs and sinks are the same for both.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.schema import AUCTION, BID, LOG_RECORD, OUTPUT_ROW, PERSON


def kafka_options(servers: str, topic: str, partitions: list[int], positions: dict[int, int] | None = None) -> dict[str, str]:
    """Manual assignment from the earliest record, or from given positions on a first start."""
    start = json.dumps({topic: {str(p): positions.get(p, -2) for p in partitions}}) if positions else "earliest"
    return {"kafka.bootstrap.servers": servers, "assign": json.dumps({topic: partitions}), "startingOffsets": start}


def read_log(spark: SparkSession, options: dict[str, str], streaming: bool = True, path: str | None = None) -> DataFrame:
    """The records of the assigned partitions, from the given positions on (``kafka_options``).

    With ``path``, the log lies in Parquet files there, and the same options select its partitions and positions.
    """
    reader = spark.readStream if streaming else spark.read
    if path is None:
        return reader.format("kafka").options(**options).load()
    records = reader.schema(LOG_RECORD).option("recursiveFileLookup", "true").parquet(path)
    ((topic, partitions),) = json.loads(options["assign"]).items()
    start = options.get("startingOffsets", "earliest")
    positions = {} if start == "earliest" else json.loads(start).get(topic, {})
    wanted = F.col("partition").isin([int(p) for p in partitions])
    for p, offset in positions.items():
        if offset >= 0:  # -2 is the earliest record
            wanted &= (F.col("partition") != int(p)) | (F.col("offset") >= offset)
    return records.filter(wanted)


def as_records(rows: DataFrame, after: dict[int, int] | None = None, order: tuple[str, ...] = ("append_ts",)) -> DataFrame:
    """Encoded rows (key, value, partition, append_ts) as records of a file log, numbered within their partition in ``order``.
    ``after``: the last offset that each partition holds."""
    place = F.row_number().over(Window.partitionBy("partition").orderBy(*order, "value")).cast("long")
    base = F.create_map(*(F.lit(x) for kv in (after or {}).items() for x in kv)) if after else None
    first = F.coalesce(base[F.col("partition")], F.lit(-1)).cast("long") if base is not None else F.lit(-1).cast("long")
    return rows.select("key", "value", F.col("partition").cast("int").alias("partition"), (first + place).alias("offset"), F.timestamp_millis("append_ts").alias("timestamp"))


def write_log(rows: DataFrame, path: str | None = None, options: dict[str, str] | None = None) -> None:
    """Append encoded rows to a log: of Kafka (``options`` name servers and topic), or of files at ``path``.

    In files, one partition's records lie in one folder, in offset order.
    """
    if path is None:
        rows.select("key", "value", "partition").write.format("kafka").options(**(options or {})).save()
        return
    rows.withColumn("p", F.col("partition")).repartitionById(1 + (rows.agg(F.max("partition")).first()[0] or 0), F.col("partition")).sortWithinPartitions("offset").write.mode("append").partitionBy("p").parquet(path)


def encode_json(events: DataFrame) -> DataFrame:
    """(key, value, partition, offset, append_ts): the partition number as key, the event as JSON text in UTF-8."""
    kind = F.col("event_type").alias("$type")
    payload = F.coalesce(
        *(F.when(F.col("event_type") == name, F.to_json(F.struct(F.struct(kind, f"{column}.*").alias("event"), F.col("t").alias("timestamp")))) for name, column in (("Bid", "bid"), ("Auction", "auction"), ("Person", "person")))
    )
    return events.select(F.encode(F.col("partition").cast("string"), "UTF-8").alias("key"), F.encode(payload, "UTF-8").alias("value"), F.col("partition").cast("int").alias("partition"), "offset", "append_ts")


def decode_json_envelope(records: DataFrame) -> DataFrame:
    """Type and time only. Records that do not parse are dropped."""
    text = F.decode(F.col("value"), "UTF-8")
    parsed = records.withColumn("__e", F.from_json(text, "struct<event: struct<`$type`: string>, timestamp: bigint>"))
    return parsed.select(F.col("__e.event.$type").alias("event_type"), F.col("__e.timestamp").alias("t"), "partition", "append_ts").filter(F.col("event_type").isNotNull() & F.col("t").isNotNull())


def decode_json_events(records: DataFrame) -> DataFrame:
    """The whole event model back from JSON."""
    text = F.decode(F.col("value"), "UTF-8")
    envelope = F.from_json(text, "struct<event: struct<`$type`: string>, timestamp: bigint>")
    wide = records.withColumn("__e", envelope).withColumn("__t", F.col("__e.event.$type"))
    part = lambda name, schema: F.when(F.col("__t") == name, F.from_json(F.get_json_object(text, "$.event"), schema))
    return wide.select(F.col("__t").alias("event_type"), F.col("__e.timestamp").alias("t"), "partition", "append_ts", part("Bid", BID).alias("bid"), part("Auction", AUCTION).alias("auction"), part("Person", PERSON).alias("person")).filter(
        F.col("event_type").isNotNull()
    )


def decode_output_rows(records: DataFrame) -> DataFrame:
    """Result rows of the joined highest-bid query, from JSON."""
    return records.withColumn("__r", F.from_json(F.decode(F.col("value"), "UTF-8"), OUTPUT_ROW)).select("__r.*", "append_ts").filter(F.col("auction").isNotNull())


def encode_output_rows(rows: DataFrame) -> DataFrame:
    """Result rows of the joined highest-bid query as JSON records (value only), UTF-8."""
    fields = [F.col(f.name).cast(f.dataType).alias(f.name) for f in OUTPUT_ROW.fields]
    return rows.select(F.lit(None).cast("binary").alias("key"), F.encode(F.to_json(F.struct(*fields)), "UTF-8").alias("value"), *(c for c in ("partition", "append_ts") if c in rows.columns))


def list_topics(log: DataFrame, topic: str = "topic") -> DataFrame:
    """The topics that a log holds, sorted. On Kafka: ``read_log`` with ``subscribePattern`` instead of ``assign``."""
    return log.select(F.col(topic).alias("topic")).distinct().orderBy("topic")


def inspect(log: DataFrame, wanted: Column) -> DataFrame:
    """Records of the partitions that satisfy ``wanted``, in log order."""
    return log.filter(wanted).orderBy("partition", "offset")


def route_by_partition(df: DataFrame, n_partitions: int, partition: str = "partition") -> DataFrame:
    """The partition column is the physical partition: no hashing."""
    return df.repartitionById(n_partitions, F.col(partition).cast("int"))


def positions(query: StreamingQuery) -> list[str]:
    """End offsets of each source after the last micro-batch."""
    return [s.endOffset for s in query.lastProgress.sources] if query.lastProgress else []


def _by_partition(offsets: str | None) -> dict[tuple[str, int], int] | None:
    """{(topic, partition): offset} of a source's offsets, or None if they are not of that kind."""
    try:
        parsed = json.loads(offsets) if offsets else None
    except ValueError:
        return None
    if not isinstance(parsed, dict) or not all(isinstance(v, dict) for v in parsed.values()):
        return None
    return {(topic, int(p)): int(n) for topic, found in parsed.items() for p, n in found.items()}


def lag_of(query: StreamingQuery) -> dict[tuple[str, int], int]:
    """Records that each assigned partition holds beyond what the query has read, by its last progress report. Empty if
    unknown: before the first report, or for sources without offsets per partition."""
    lags: dict[tuple[str, int], int] = {}
    for source in query.lastProgress.sources if query.lastProgress else []:
        latest, reached = _by_partition(source.latestOffset), _by_partition(source.endOffset)
        for key, newest in (latest or {}).items():
            lags[key] = max(0, newest - (reached or {}).get(key, 0))
    return lags


def lags(log: DataFrame, consumed: DataFrame) -> DataFrame:
    """(partition, lag): records of each partition at or beyond the consumer's next offset. ``consumed``: (partition, next)."""
    newest = log.groupBy("partition").agg(F.max("offset").alias("newest"))
    joined = newest.join(consumed, "partition", "left")
    return joined.select("partition", F.greatest(F.col("newest") + 1 - F.coalesce("next", F.lit(0)), F.lit(0)).alias("lag"))


def result_text(rows: DataFrame, value: Column) -> DataFrame:
    """(partition, window, value) rows, key 0: one per window by construction."""
    return rows.select(F.lit(0).alias("partition"), F.col("w").alias("window"), value.alias("value"))


def first_per_window(results: DataFrame) -> DataFrame:
    """One of the equal copies that several writers have left per window."""
    return results.dropDuplicates(["window"])


def write_results(df: DataFrame, path: str | None, checkpoint: str, fmt: str = "parquet", trigger: dict | None = None, options: dict[str, str] | None = None, name: str | None = None) -> StreamingQuery:
    """Append results exactly once; ``fmt`` may be parquet, json, csv, orc, console, memory or kafka. For Kafka, ``options`` name
    ``kafka.bootstrap.servers`` and ``topic``, and ``df`` holds ``value`` (and ``key``). ``name`` is the query's, and that of the table of a memory sink."""
    if fmt == "kafka" and (missing := {"kafka.bootstrap.servers", "topic"} - set(options or {})):
        raise ValueError(f"a Kafka sink needs the options {sorted(missing)}")
    writer = df.writeStream.outputMode("append").format(fmt).option("checkpointLocation", checkpoint).options(**(options or {})).trigger(**(trigger or {"availableNow": True}))
    writer = writer.queryName(name) if name else writer
    return writer.start(path) if fmt in ("parquet", "json", "csv", "orc") else writer.start()
