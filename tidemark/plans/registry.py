"""All queries of the engine by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cluster, latency
from tidemark.operators.aggregates import AUCTION_CATEGORIES, BID_COUNT, BIDS_PER_AUCTION, HIGHEST_BID, HIGHEST_PER_AUCTION
from tidemark.operators.closing import clock_array, merge_clock_arrays, vector_clock
from tidemark.plans import queries as q
from tidemark.runtime import scratch_path
from tidemark.sources import log
from tidemark.sources.events import auctions, bids, read_events, stream_events
from tidemark.sources.generator import closing_bids, generate
from tidemark.streaming.clock import bid_count_with_clock
from tidemark.streaming.host import Hosted, WindowedHost
from tidemark.streaming.runner import clocked_union, run_bounded, run_to_end, stream_session

DAY, HOUR = 86_400_000, 3_600_000
Query = Callable[[SparkSession, str], DataFrame]


def _partial_merge(events: DataFrame, aggregate, length: int) -> DataFrame:
    return aggregate.value(aggregate.merge(aggregate.partials(events, length)))


# Tables of the control plane, derived from the given ones: ownership claims and snapshots from orders, heartbeats and messages from
# events, lags and requests from line items and parts. The same derivations stand in SQL below.
_ME, _VERSION, _NODES = 3, 1_000, 200
_STARTED, _NOW, _THRESHOLD = 1_704_844_800_000, 1_705_708_800_000, 12 * HOUR
_EARLIER = _NOW - DAY


def _of(spark: SparkSession, sf_dir: str, table: str, *columns: str, where: str = "true") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").filter(where).selectExpr(*columns)


def _claims(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    return _of(spark, sf_dir, "orders", "int(o_custkey) AS partition", "int(o_orderkey % 7) AS node_id", "o_orderkey % 97 AS version", where=f"o_orderkey % 2 = {odd}")


def _maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A node's map and one that arrives: each partition's best claim among even, and among odd orders."""
    return cluster.merge_ownership(_claims(spark, sf_dir, 0)), cluster.merge_ownership(_claims(spark, sf_dir, 1))


def _losing_maps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same, but only of partitions that the node has to release: it would lose all that it holds."""
    current, new = _maps(spark, sf_dir)
    lost = cluster.to_release(current, new, _ME)
    return current.join(lost, "partition", "left_semi"), new.join(lost, "partition", "left_semi")


def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "customer", "int(c_custkey) AS partition")


def _beats(spark: SparkSession, sf_dir: str, now: int) -> DataFrame:
    events = read_events(spark, sf_dir)
    return events.select(F.coalesce("bid.bidder", "auction.seller", "person.id").cast("int").alias("node_id"), F.col("t").alias("ts")).filter(F.col("ts") <= now)


def _failed(spark: SparkSession, sf_dir: str, now: int = _NOW) -> DataFrame:
    nodes = spark.range(_NODES).select(F.col("id").cast("int").alias("node_id"))
    return cluster.failed_nodes(_beats(spark, sf_dir, now), nodes, now, _THRESHOLD, _STARTED, now - _THRESHOLD - 1)


def _lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _of(spark, sf_dir, "lineitem", "int(l_suppkey % 10) AS node_id", "int(l_partkey - 50) AS partition", "bigint(l_quantity) AS lag")
    return rows.groupBy("node_id", "partition").agg(F.sum("lag").alias("lag"))


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "part", "int(p_partkey - 50) AS partition", where="p_partkey % 20 = 0")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir, "orders", "int(o_custkey) AS partition", "o_orderkey % 50 AS offset", "concat(o_orderpriority, ':', o_orderstatus) AS snapshot", "o_orderkey AS arrival")


def _own_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lags(spark, sf_dir).filter(F.col("node_id") == _ME)


def _consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    consumed = events.filter((F.col("t") < _NOW) & (F.col("partition") < 3)).groupBy("partition").agg((F.max("offset") + 1).alias("next"))
    return log.lags(events, consumed)


_ASSIGNED, _FROM = [1, 3], {1: 700}


def _file_log(spark: SparkSession, sf_dir: str) -> str:
    """The events as JSON records of a log in files."""
    path = scratch_path(spark, "log")
    records = log.encode_json(read_events(spark, sf_dir))
    log.write_log(log.as_records(records, order=("offset",)), path)
    return path


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some partitions of the file log, one of them from a given position on."""
    records = log.read_log(spark, log.kafka_options("files", "in", _ASSIGNED, _FROM), streaming=False, path=_file_log(spark, sf_dir))
    timed = records.withColumn("append_ts", F.unix_millis("timestamp"))
    return log.decode_json_envelope(timed).select("event_type", "t", F.col("partition").cast("long").alias("partition"), "append_ts")


def _stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: read from the log, decoded, written as JSON results, and read back."""
    session = stream_session(spark)
    records = log.read_log(session, log.kafka_options("files", "in", _ASSIGNED, _FROM), path=_file_log(spark, sf_dir))
    rows = log.decode_json_envelope(records.withColumn("append_ts", F.unix_millis("timestamp")))
    path = scratch_path(spark, "log-results")
    log.write_results(rows, f"{path}/out", f"{path}/checkpoint", fmt="json").awaitTermination()
    return spark.read.schema("event_type string, t long, partition long, append_ts long").json(f"{path}/out")


def _output_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of the joined highest bid, to JSON and back."""
    found = q.q7_join(read_events(spark, sf_dir), HOUR)
    rows = found.select("auction", "price", "bidder", F.col("dateTime").cast("string").alias("dateTime"), F.col("dateTime").alias("timestamp"), "extra", (F.col("dateTime") + 5_000).alias("append_ts"))
    return log.decode_output_rows(log.encode_output_rows(rows))


def _output_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest append time of the output records of each window, read from their JSON."""
    return latency.in_order(latency.output_time(_output_rows(spark, sf_dir).withColumn("w", q.window_id(F.col("timestamp"), HOUR))))


def _snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "snapshots")
    cluster.store_snapshots(_snapshots(spark, sf_dir).filter("partition % 25 = 0"), path)
    return cluster.load_snapshots(spark, path)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = log.route_by_partition(read_events(spark, sf_dir).select("partition", "offset"), 4)
    return routed.groupBy("partition", F.spark_partition_id().cast("long").alias("task")).agg(F.count("*").alias("n"))


def _clock_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clocks of two halves of the log, as arrays, merged place by place."""
    events = bids(read_events(spark, sf_dir))
    halves = [clock_array(vector_clock(events.filter(F.col("offset") % 2 == k)), 4).select(F.col("clock").alias(f"c{k}")) for k in (0, 1)]
    both = halves[0].withColumn("c1", halves[1].scalar())
    return both.select(F.posexplode(merge_clock_arrays(F.col("c0"), F.col("c1"))).alias("partition", "clock")).withColumn("partition", F.col("partition").cast("long"))


def _results_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = log.result_text(q.q5_text(q.q5_top_auction(read_events(spark, sf_dir), HOUR)), F.col("value"))
    return log.first_per_window(text.unionByName(text))


_MADE = 200_000


def _generated(spark: SparkSession, _: str) -> DataFrame:
    return generate(spark, _MADE).select("offset", "event_type", "t", "partition")


def _generated_unevenly(spark: SparkSession, _: str) -> DataFrame:
    rows = generate(spark, _MADE, skew="uneven")
    return rows.groupBy((F.col("offset") < 20 * 1024).alias("early"), (F.col("partition") < 2).alias("low")).agg(F.count("*").alias("n"))


def _scattered(events: DataFrame) -> DataFrame:
    """The bids in another order than that of their times."""
    return bids(events).withColumn("offset", F.col("offset") % 89 * 1_000_000_000 + F.col("offset"))


HOSTED = {
    "bid_count": ({"n": Hosted(bids, BID_COUNT)}, lambda s: BID_COUNT.value(s["n"]), "w long, n long"),
    "q4": ({"m": Hosted(bids, HIGHEST_PER_AUCTION), "c": Hosted(auctions, AUCTION_CATEGORIES)}, q.average_of_states, "w long, category long, avg_price double"),
    "q5": ({"n": Hosted(bids, BIDS_PER_AUCTION)}, lambda s: BIDS_PER_AUCTION.value(s["n"]), "w long, auction long, n long"),
    "q7": ({"best": Hosted(bids, HIGHEST_BID)}, lambda s: HIGHEST_BID.value(s["best"]), "w long, bidder long, price long"),
}


def _hosted(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hosted, combine, schema = HOSTED[name]
        host = WindowedHost(scratch_path(spark, f"host-{name}"), hosted, combine, DAY, 4)
        host.start(stream_events(stream_session(spark), sf_dir)).awaitTermination()
        return host.results(spark, schema)

    return run


def _stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = stream_session(spark)
    result = q.stream_q7_join(bids(stream_events(session, sf_dir)), bids(stream_events(session, sf_dir)), DAY)
    path = scratch_path(spark, "q7-join")
    run_to_end(result, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(result.schema).parquet(f"{path}/out")


def _window_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.window_assignment(read_events(spark, sf_dir), HOUR)


def _json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    back = log.decode_json_events(log.encode_json(events))
    return back.select("event_type", "t", F.col("partition").cast("long").alias("partition"), "bid.auction", "bid.bidder", "bid.price", F.col("auction.category").alias("category"), F.col("person.id").alias("person"))


def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    found = bids(events).withColumn("event_type", F.lit("Bid"))
    outputs = found.withColumn("w", q.window_id(F.col("t"), DAY)).withColumn("append_ts", F.col("append_ts") + 5_000)
    return latency.window_latency(latency.input_completion(found, DAY), latency.output_time(outputs))


def _streamed(build, name: str) -> Query:
    return lambda spark, sf_dir: run_bounded(spark, sf_dir, build, name)


def queries() -> dict[str, Query]:
    def over(f) -> Query:
        return lambda spark, sf_dir: f(read_events(spark, sf_dir))

    bid_events = lambda e: bids(e).withColumn("event_type", F.lit("Bid"))
    return {
        "window_assign": _window_assign,
        "bid_count": over(lambda e: q.bid_count(e, DAY)),
        "bid_count_closed": over(lambda e: q.closed(e, q.bid_count(e, DAY), DAY)),
        "q0_passthrough": over(lambda e: q.q0_passthrough(e).select("partition", "offset", "t", "auction", "bidder", "price", "extra")),
        "q0_sample": over(lambda e: latency.pass_through_sample(e, deterministic=F.col("offset"))),
        "q0_throughput": over(lambda e: latency.per_second(e)),
        "q4_avg_by_category": over(lambda e: q.q4_average_by_category(e, HOUR)),
        "q4_closed": over(lambda e: q.closed(e, q.q4_average_by_category(e, DAY), DAY, (bids, auctions))),
        "q5_top_auction": over(lambda e: q.q5_top_auction(e, HOUR)),
        "q5_closed": over(lambda e: q.closed(e, q.q5_top_auction(e, DAY), DAY)),
        "q5_text": over(lambda e: q.q5_text(q.q5_top_auction(e, HOUR))),
        "q7_highest_bid": over(lambda e: q.q7_highest_bid(e, HOUR)),
        "q7_closed": over(lambda e: q.closed(e, q.q7_highest_bid(e, DAY), DAY)),
        "q7_text": over(lambda e: q.q7_text(q.q7_highest_bid(e, HOUR))),
        "q7_join": over(lambda e: q.q7_join(e, HOUR)),
        "append_lag_input": over(lambda e: latency.in_order(latency.input_completion(bid_events(e), HOUR, per_partition=True))),
        "append_lag_input_scaled": over(lambda e: latency.in_order(latency.input_completion(bid_events(e), DAY, scale=10))),
        "append_lag_output": over(lambda e: latency.in_order(latency.output_time(bid_events(e).withColumn("w", q.window_id(F.col("t"), HOUR))))),
        "window_latency": _latency,
        "partial_merge_count": over(lambda e: _partial_merge(bids(e), BID_COUNT, HOUR)),
        "partial_merge_keyed_count": over(lambda e: _partial_merge(bids(e), BIDS_PER_AUCTION, DAY)),
        "partial_merge_highest": over(lambda e: _partial_merge(bids(e), HIGHEST_BID, HOUR)),
        "partial_merge_max": over(lambda e: _partial_merge(bids(e), HIGHEST_PER_AUCTION, DAY)),
        "partial_merge_set": over(lambda e: _partial_merge(auctions(e), AUCTION_CATEGORIES, DAY)),
        "vector_clock": over(lambda e: vector_clock(e, ("event_type", "partition"))),
        "ownership_init": lambda s, d: cluster.initial_ownership(_partitions(s, d), 3),
        "ownership_set": lambda s, d: cluster.set_owner(_maps(s, d)[0], _partitions(s, d).filter("partition % 5 = 0"), _ME, _VERSION),
        "ownership_merge": lambda s, d: cluster.merge_ownership(_claims(s, d, 0), _claims(s, d, 1)),
        "ownership_lookup": lambda s, d: cluster.owner_of(_partitions(s, d), _maps(s, d)[0]),
        "ownership_gain": lambda s, d: cluster.newly_owned(*_maps(s, d), _ME),
        "ownership_release": lambda s, d: cluster.to_release(*_maps(s, d), _ME),
        "ownership_drop": lambda s, d: cluster.dropped(*_maps(s, d), _ME),
        "ownership_keep_last": lambda s, d: cluster.dropped(*_losing_maps(s, d), _ME),
        "ownership_settled": lambda s, d: cluster.settled(*_losing_maps(s, d), _ME, _VERSION),
        "last_heartbeats": lambda s, d: cluster.last_seen(_beats(s, d, _NOW), s.range(_NODES).select(F.col("id").cast("int").alias("node_id")), _STARTED, _THRESHOLD),
        "failed_nodes": _failed,
        "newly_failed": lambda s, d: cluster.newly_failed(_failed(s, d), _failed(s, d, _EARLIER)),
        "ring_successor": lambda s, d: cluster.ring_successor(_failed(s, d), _NODES),
        "max_lag_node": lambda s, d: cluster.node_with_most_lag(_lags(s, d).groupBy("node_id").agg(F.sum("lag").alias("lag"))),
        "max_lag_partition": lambda s, d: cluster.partition_with_most_lag(_lags(s, d)),
        "total_lag": lambda s, d: cluster.total_lag(_lags(s, d)),
        "consumer_lag": _consumer_lag,
        "hand_over": lambda s, d: cluster.hand_over(_requested(s, d).limit(0), _own_lags(s, d)),
        "hand_over_asked": lambda s, d: cluster.hand_over(_requested(s, d), _own_lags(s, d)),
        "others_messages": lambda s, d: cluster.others_messages(read_events(s, d).select((F.col("offset") % 5).alias("sender_id"), "offset"), 2),
        "snapshot_merge": lambda s, d: cluster.merge_snapshots(_snapshots(s, d)),
        "snapshot_codec": lambda s, d: cluster.decode_snapshot(cluster.encode_snapshot(_snapshots(s, d))),
        "snapshot_files": _snapshot_files,
        "clock_arrays": _clock_arrays,
        "out_of_order": over(lambda e: latency.out_of_order(_scattered(e))),
        "skipped_windows": over(lambda e: latency.skipped_windows(_scattered(e), DAY)),
        "sample_ids": over(lambda e: latency.sample_ids(latency.pass_through_sample(e, deterministic=F.col("offset"))).filter("seen_at > 0").agg(F.countDistinct("uuid").alias("n"))),
        "generated_events": _generated,
        "generated_unevenly": _generated_unevenly,
        "closing_bids": over(lambda e: bids(closing_bids(e, 4)).select("partition", "t", "price")),
        "topic_list": over(lambda e: log.list_topics(e, "event_type")),
        "identity_partitioner": _routed,
        "json_envelope": over(lambda e: log.decode_json_envelope(log.encode_json(e)).withColumn("partition", F.col("partition").cast("long"))),
        "output_rows_json": _output_rows,
        "append_lag_output_json": _output_lag,
        "results_once": _results_once,
        "log_replay": _replay,
        "stream_log": _stream_log,
        "json_roundtrip": _json_roundtrip,
        "partition_inspect": over(lambda e: log.inspect(e.select("partition", "offset", "t"), F.col("partition").isin(1, 3))),
        "stream_bid_count": _streamed(lambda s: q.stream_bid_count(clocked_union(s, bids, DAY), DAY), "bid-count"),
        "stream_q4": _streamed(lambda s: q.stream_q4(clocked_union(s, bids, DAY), clocked_union(s, auctions, DAY), DAY), "q4"),
        "stream_q5": _streamed(lambda s: q.stream_q5(clocked_union(s, bids, DAY), DAY), "q5"),
        "stream_q7": _streamed(lambda s: q.stream_q7(clocked_union(s, bids, DAY), DAY), "q7"),
        "stream_clock_bid_count": bid_count_with_clock(DAY),
        "stream_q7_join": _stream_join,
        **{f"stream_host_{name}": _hosted(name) for name in HOSTED},
    }


_EVENTS = """WITH x AS (
  SELECT event_id, epoch_us(ts) // 1000 AS t, user_id % 4 AS p, (epoch_us(ts) // 1000) + event_id % 1000 AS append_ts,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id, CAST(round(value * 100) AS BIGINT) AS price, event_type AS et,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'Bid' WHEN event_type = 'signup' THEN 'Auction' WHEN event_type = 'error' THEN 'Person' END AS kind
  FROM events),
y AS (SELECT *, CASE WHEN t % {L} = 0 THEN t // {L} ELSE t // {L} + 1 END AS w FROM x),
b AS (SELECT *, k AS auction, user_id AS bidder FROM y WHERE kind = 'Bid'),
a AS (SELECT *, k AS auction, 10 + user_id % 5 AS category FROM y WHERE kind = 'Auction') """
_FINAL = "w BETWEEN 1 AND (SELECT CASE WHEN count(*) = {n} THEN min(mw) - 2 END FROM ({clocks}))"
_BIDS_FINAL = _FINAL.format(n=4, clocks="SELECT max(w) AS mw FROM b GROUP BY p")
_BOTH_FINAL = _FINAL.format(n=8, clocks="SELECT max(w) AS mw FROM b GROUP BY p UNION ALL SELECT max(w) FROM a GROUP BY p")
_COUNT = "SELECT w, count(*) AS n FROM b GROUP BY w"
_TOP = "SELECT w, auction, n FROM (SELECT w, auction, count(*) AS n, row_number() OVER (PARTITION BY w ORDER BY count(*) DESC, auction) AS r FROM b GROUP BY w, auction) WHERE r = 1"
_HIGHEST = (
    "SELECT w, CASE WHEN price > 0 THEN bidder ELSE 0 END AS bidder, CASE WHEN price > 0 THEN price ELSE 0 END AS price "
    "FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY price DESC, p, event_id) AS r FROM b) WHERE r = 1"
)
_PER_AUCTION = "SELECT w, auction, max(price) AS m FROM b WHERE price > 0 GROUP BY w, auction"
_CATEGORIES = "SELECT DISTINCT w, auction, category FROM a"
_AVERAGE = f"SELECT m.w AS w, c.category AS category, avg(m.m) AS avg_price FROM ({_PER_AUCTION}) m JOIN ({_CATEGORIES}) c ON c.w = m.w AND c.auction = m.auction GROUP BY m.w, c.category"


def _sql(body: str, length: int) -> str:
    return _EVENTS.format(L=length) + body


def _final(body: str, rule: str = _BIDS_FINAL) -> str:
    return _sql(f"SELECT * FROM ({body}) WHERE {rule}", DAY)


def _finished(body: str, length: int) -> str:
    return _sql(f"SELECT * FROM ({body}) WHERE w < (SELECT max(w) - 1 FROM ({body}))", length)


def oracle_sql() -> dict[str, str]:
    best = "SELECT partition, node_id, version FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY version DESC, node_id) AS r FROM {}) WHERE r = 1"
    claims = "WITH claims AS (SELECT CAST(o_custkey AS INTEGER) AS partition, CAST(o_orderkey % 7 AS INTEGER) AS node_id, o_orderkey % 97 AS version, o_orderkey % 2 AS odd FROM orders), "
    maps = claims + f"old AS ({best.format('(SELECT * FROM claims WHERE odd = 0)')}), new AS ({best.format('(SELECT * FROM claims WHERE odd = 1)')}), "
    maps += f"gain AS (SELECT n.partition FROM new n LEFT JOIN old o ON o.partition = n.partition WHERE n.node_id = {_ME} AND (o.node_id IS NULL OR (o.node_id <> {_ME} AND n.version > o.version))), "
    maps += f"release AS (SELECT n.partition FROM new n JOIN old o ON o.partition = n.partition WHERE o.node_id = {_ME} AND n.node_id <> {_ME} AND n.version > o.version) "
    parts = "SELECT CAST(c_custkey AS INTEGER) AS partition FROM customer"

    def silent(now: int) -> str:
        return (
            f"(SELECT node_id FROM (SELECT coalesce(n.node_id, b.node_id) AS node_id, coalesce(b.ts, {_STARTED + _THRESHOLD}) AS ts "
            f"FROM (SELECT CAST(range AS INTEGER) AS node_id FROM range({_NODES})) n FULL JOIN "
            f"(SELECT CAST(user_id AS INTEGER) AS node_id, max(epoch_us(ts) // 1000) AS ts FROM events WHERE epoch_us(ts) // 1000 BETWEEN {_STARTED} AND {now} GROUP BY 1) b ON b.node_id = n.node_id) "
            f"WHERE {now} - ts > {_THRESHOLD})"
        )

    lags = "(SELECT CAST(l_suppkey % 10 AS INTEGER) AS node_id, CAST(l_partkey - 50 AS INTEGER) AS partition, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lag FROM lineitem GROUP BY 1, 2)"
    own = f"(SELECT * FROM {lags} WHERE node_id = {_ME} AND partition >= 0)"
    asked = "(SELECT CAST(p_partkey - 50 AS INTEGER) AS partition FROM part WHERE p_partkey % 20 = 0)"
    snapshots = "(SELECT CAST(o_custkey AS INTEGER) AS partition, o_orderkey % 50 AS offset_, o_orderpriority || ':' || o_orderstatus AS snapshot, o_orderkey AS arrival FROM orders)"
    scattered = "(SELECT *, event_id % 89 * 1000000000 + event_id AS place FROM b)"
    newest = f"(SELECT *, max(t) OVER (PARTITION BY p ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM {scattered})"
    replay = (
        "SELECT kind AS event_type, t, p AS partition, append_ts FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY event_id) - 1 AS place FROM x) "
        f"WHERE p = 3 OR (p = 1 AND place >= {_FROM[1]})"
    )
    joined = f"""FROM b JOIN (SELECT t // {{length}} AS w, max(price) AS price FROM b GROUP BY 1) m ON b.price = m.price AND b.t BETWEEN m.w * {{length}} AND (m.w + 1) * {{length}}"""
    one_in_fifty = "SELECT range AS seq, range % 50 AS place, range // 1024 AS block FROM range({n})"
    in_done = "SELECT w, max(append_ts) AS input_ts FROM b GROUP BY w"
    out_done = "SELECT w, min(append_ts + 5000) AS output_ts FROM b GROUP BY w"
    return {
        "window_assign": _sql('SELECT event_id AS "offset", t, w FROM y', HOUR),
        "bid_count": _sql(_COUNT, DAY),
        "bid_count_closed": _final(_COUNT),
        "q0_passthrough": _sql('SELECT p AS partition, event_id AS "offset", t, auction, bidder, price, et AS extra FROM b', DAY),
        "q0_sample": _sql('SELECT p AS partition, CAST(0 AS BIGINT) AS w, event_id AS "offset", append_ts FROM x WHERE event_id % 400 = 1', DAY),
        "q0_throughput": _sql("SELECT p AS partition, append_ts // 1000 AS second, count(*) AS n FROM x GROUP BY 1, 2", DAY),
        "q4_avg_by_category": _sql(_AVERAGE, HOUR),
        "q4_closed": _final(_AVERAGE, _BOTH_FINAL),
        "q5_top_auction": _sql(_TOP, HOUR),
        "q5_closed": _final(_TOP),
        "q5_text": _sql(f"SELECT w, 'Auction ID: ' || auction || ', Bid Count: ' || n AS value FROM ({_TOP})", HOUR),
        "q7_highest_bid": _sql(_HIGHEST, HOUR),
        "q7_closed": _final(_HIGHEST),
        "q7_text": _sql(f"SELECT w, 'Highest bid by bidder ' || bidder || ' at price ' || price AS value FROM ({_HIGHEST})", HOUR),
        "q7_join": _sql(
            f"""SELECT m.w AS w, b.auction, b.price, b.bidder, b.t AS "dateTime", b.et AS extra, b.event_id AS "offset"
            FROM b JOIN (SELECT t // {HOUR} AS w, max(price) AS price FROM b GROUP BY 1) m ON b.price = m.price AND b.t BETWEEN m.w * {HOUR} AND (m.w + 1) * {HOUR}""",
            HOUR,
        ),
        "append_lag_input": _finished("SELECT p AS partition, w, max(append_ts) AS input_ts FROM b GROUP BY p, w", HOUR),
        "append_lag_input_scaled": _sql(
            f"SELECT * FROM (SELECT v AS w, max(append_ts) AS input_ts FROM (SELECT *, CASE WHEN (t // 10) % {DAY} = 0 THEN (t // 10) // {DAY} ELSE (t // 10) // {DAY} + 1 END AS v FROM b) GROUP BY v) "
            f"WHERE w < (SELECT max(CASE WHEN (t // 10) % {DAY} = 0 THEN (t // 10) // {DAY} ELSE (t // 10) // {DAY} + 1 END) - 1 FROM b)",
            DAY,
        ),
        "append_lag_output": _finished("SELECT w, min(append_ts) AS output_ts FROM b GROUP BY w", HOUR),
        "window_latency": _sql(
            f"SELECT i.w AS w, output_ts - input_ts AS latency_ms FROM ({in_done}) i JOIN ({out_done}) o ON i.w = o.w WHERE i.w < (SELECT max(w) - 1 FROM b)", DAY
        ),
        "partial_merge_count": _sql(_COUNT, HOUR),
        "partial_merge_keyed_count": _sql(_TOP, DAY),
        "partial_merge_highest": _sql(_HIGHEST, HOUR),
        "partial_merge_max": _sql(_PER_AUCTION, DAY),
        "partial_merge_set": _sql(_CATEGORIES, DAY),
        "vector_clock": _sql("SELECT kind AS event_type, p AS partition, max(t) AS clock FROM x GROUP BY 1, 2", DAY),
        "ownership_init": f"SELECT partition, CAST(partition // 3 AS INTEGER) AS node_id, CAST(0 AS BIGINT) AS version FROM ({parts})",
        "ownership_set": maps + f"SELECT * FROM old WHERE partition % 5 <> 0 UNION ALL SELECT partition, {_ME}, {_VERSION} FROM ({parts}) WHERE partition % 5 = 0",
        "ownership_merge": claims + f"every AS ({best.format('claims')}) SELECT * FROM every",
        "ownership_lookup": maps + f"SELECT p.partition AS partition, coalesce(node_id, -1) AS node_id FROM ({parts}) p LEFT JOIN old o ON o.partition = p.partition",
        "ownership_gain": maps + "SELECT * FROM gain",
        "ownership_release": maps + "SELECT * FROM release",
        "ownership_drop": maps + f"SELECT partition FROM release WHERE partition < (SELECT max(partition) FROM release) OR (SELECT count(*) FROM release) < (SELECT count(*) FROM (SELECT partition FROM old WHERE node_id = {_ME} UNION SELECT partition FROM gain))",
        "ownership_keep_last": maps + "SELECT partition FROM release WHERE partition < (SELECT max(partition) FROM release)",
        "ownership_settled": maps + f"SELECT n.partition AS partition, CASE WHEN n.partition = m.last THEN {_ME} ELSE n.node_id END AS node_id, CASE WHEN n.partition = m.last THEN {_VERSION} ELSE n.version END AS version "
        "FROM new n JOIN release r ON r.partition = n.partition, (SELECT max(partition) AS last FROM release) m",
        "last_heartbeats": f"SELECT coalesce(n.node_id, b.node_id) AS node_id, coalesce(b.ts, {_STARTED + _THRESHOLD}) AS ts FROM (SELECT CAST(range AS INTEGER) AS node_id FROM range({_NODES})) n FULL JOIN "
        f"(SELECT CAST(user_id AS INTEGER) AS node_id, max(epoch_us(ts) // 1000) AS ts FROM events WHERE epoch_us(ts) // 1000 BETWEEN {_STARTED} AND {_NOW} GROUP BY 1) b ON b.node_id = n.node_id",
        "failed_nodes": f"SELECT * FROM {silent(_NOW)}",
        "newly_failed": f"SELECT * FROM {silent(_NOW)} EXCEPT SELECT * FROM {silent(_EARLIER)}",
        "ring_successor": f"WITH f AS {silent(_NOW)} SELECT f.node_id AS node_id, CAST(min_by((f.node_id + d) % {_NODES}, d) AS INTEGER) AS successor FROM f, range(1, {_NODES}) t(d) "
        f"WHERE (f.node_id + d) % {_NODES} NOT IN (SELECT node_id FROM f) GROUP BY f.node_id",
        "max_lag_node": f"SELECT node_id FROM {lags} GROUP BY node_id ORDER BY sum(lag) DESC, node_id LIMIT 1",
        "max_lag_partition": f"SELECT partition, lag FROM {lags} WHERE partition >= 0 ORDER BY lag DESC, partition LIMIT 1",
        "total_lag": f"SELECT CAST(coalesce(sum(lag), 0) AS BIGINT) AS lag FROM {lags}",
        "consumer_lag": _sql(
            f"SELECT a.p AS partition, greatest(newest + 1 - coalesce(c.next, 0), 0) AS lag FROM (SELECT p, max(event_id) AS newest FROM x GROUP BY p) a "
            f"LEFT JOIN (SELECT p, max(event_id) + 1 AS next FROM x WHERE t < {_NOW} AND p < 3 GROUP BY p) c ON c.p = a.p",
            DAY,
        ),
        "hand_over": f"SELECT partition FROM {own} WHERE lag > 0 AND (SELECT count(*) FROM {own}) <> 1 ORDER BY lag DESC, partition LIMIT 1",
        "hand_over_asked": f"SELECT partition FROM {asked} WHERE partition IN (SELECT partition FROM {own}) AND (SELECT count(*) FROM {asked}) <> (SELECT count(*) FROM {own})",
        "others_messages": 'SELECT event_id % 5 AS sender_id, event_id AS "offset" FROM events WHERE event_id % 5 <> 2',
        "snapshot_merge": f'SELECT partition, offset_ AS "offset", snapshot FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY offset_ DESC, arrival) AS r FROM {snapshots}) WHERE r = 1',
        "snapshot_codec": f'SELECT partition, offset_ AS "offset", snapshot FROM {snapshots}',
        "snapshot_files": f'SELECT partition, offset_ AS "offset", snapshot FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY offset_ DESC, arrival) AS r FROM {snapshots}) WHERE r = 1 AND partition % 25 = 0',
        "clock_arrays": _sql("SELECT p AS partition, max(t) AS clock FROM b GROUP BY p", DAY),
        "out_of_order": _sql(f"SELECT p AS partition, count(*) AS n FROM {newest} WHERE t < newest GROUP BY p", DAY),
        "skipped_windows": _sql(f'SELECT p AS partition, place AS "offset", f AS from_w, w AS to_w FROM (SELECT *, CASE WHEN newest % {DAY} = 0 THEN newest // {DAY} ELSE newest // {DAY} + 1 END AS f FROM {newest}) WHERE w - f > 1', DAY),
        "sample_ids": "SELECT count(*) AS n FROM events WHERE event_id % 400 = 1",
        "generated_events": f"""SELECT seq AS "offset", CASE WHEN place < 1 THEN 'Person' WHEN place < 4 THEN 'Auction' ELSE 'Bid' END AS event_type, seq * 10 AS t, block % 4 AS partition FROM ({one_in_fifty.format(n=_MADE)})""",
        "generated_unevenly": f"SELECT block < 20 AS early, block < 20 AS low, count(*) AS n FROM ({one_in_fifty.format(n=_MADE)}) GROUP BY 1, 2",
        "closing_bids": _sql("SELECT range AS partition, (SELECT max(t) + 10 FROM x) AS t, CAST(0 AS BIGINT) AS price FROM range(4)", DAY),
        "topic_list": _sql("SELECT DISTINCT kind AS topic FROM x", DAY),
        "identity_partitioner": _sql("SELECT p AS partition, p AS task, count(*) AS n FROM x GROUP BY p", DAY),
        "json_envelope": _sql("SELECT kind AS event_type, t, p AS partition, append_ts FROM x", DAY),
        "output_rows_json": _sql(
            f"""SELECT b.auction, b.price, b.bidder, CAST(b.t AS VARCHAR) AS "dateTime", b.t AS timestamp, b.et AS extra, b.t + 5000 AS append_ts {joined.format(length=HOUR)}""",
            HOUR,
        ),
        "append_lag_output_json": _sql(
            f"SELECT w, min(append_ts) AS output_ts FROM (SELECT b.w AS w, b.t + 5000 AS append_ts {joined.format(length=HOUR)}) GROUP BY w HAVING w < (SELECT max(b.w) - 1 {joined.format(length=HOUR)})",
            HOUR,
        ),
        "results_once": _sql(f"SELECT CAST(0 AS INTEGER) AS partition, w AS \"window\", 'Auction ID: ' || auction || ', Bid Count: ' || n AS value FROM ({_TOP})", HOUR),
        "log_replay": _sql(replay, DAY),
        "stream_log": _sql(replay, DAY),
        "json_roundtrip": _sql(
            "SELECT kind AS event_type, t, p AS partition, CASE WHEN kind = 'Bid' THEN k END AS auction, CASE WHEN kind = 'Bid' THEN user_id END AS bidder, CASE WHEN kind = 'Bid' THEN price END AS price, "
            "CASE WHEN kind = 'Auction' THEN 10 + user_id % 5 END AS category, CASE WHEN kind = 'Person' THEN user_id END AS person FROM x",
            DAY,
        ),
        "partition_inspect": _sql('SELECT p AS partition, event_id AS "offset", t FROM x WHERE p IN (1, 3)', DAY),
        "stream_bid_count": _final(_COUNT),
        "stream_q4": _final(_AVERAGE, _BOTH_FINAL),
        "stream_q5": _final(_TOP),
        "stream_q7": _final(_HIGHEST),
        "stream_clock_bid_count": _final(_COUNT),
        "stream_q7_join": _sql(
            f"""SELECT m.w AS w, b.auction, b.price, b.bidder, b.t AS "dateTime", b.et AS extra, b.event_id AS "offset" {joined.format(length=DAY)} WHERE (m.w + 1) * {DAY} <= (SELECT max(t) - 4 FROM b)""",
            DAY,
        ),
        "stream_host_bid_count": _final(_COUNT),
        "stream_host_q4": _final(_AVERAGE, _BOTH_FINAL),
        "stream_host_q5": _final(_TOP),
        "stream_host_q7": _final(_HIGHEST),
    }
