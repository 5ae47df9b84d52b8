"""Rules, boundaries and fixtures of the windowed engine."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.windows import event_time, event_window, id_of_window, scaled_window_id, window_id
from tidemark.operators import cluster, latency
from tidemark.operators.aggregates import AUCTION_CATEGORIES, BID_COUNT, BIDS_PER_AUCTION, HIGHEST_BID, HIGHEST_PER_AUCTION
from tidemark.operators.closing import closed_only, last_closed, vector_clock
from tidemark.plans import queries as q
from tidemark.plans import registry
from tidemark.sources import log
from tidemark.sources.events import auctions, bids
from tidemark.sources.generator import closing_bids, generate, generate_stream

L = 10_000
BIDS = "partition long, offset long, t long, auction long, bidder long, price long"


def ceil_div(t):
    return -(-t // L)


def test_window_boundaries(spark):
    times = {0: 0, 1: 1, 9_999: 1, 10_000: 1, 10_001: 2, 19_999: 2, 20_000: 2, 20_001: 3, 100_000: 10}
    frame = spark.createDataFrame([(t,) for t in times], "t long")
    assert {r["t"]: r["w"] for r in frame.select("t", window_id(F.col("t"), L).alias("w")).collect()} == times
    spark_window = frame.withColumn("x", event_window(event_time(F.col("t")), L)).select("t", id_of_window(F.col("x"), L).alias("w"))
    assert {r["t"]: r["w"] for r in spark_window.collect()} == times
    bad = spark.createDataFrame([(-15,), (None,)], "t long").select(window_id(F.col("t"), 10).alias("w")).collect()
    assert [r["w"] for r in bad] == [None, None]
    assert spark.createDataFrame([(100_009,)], "t long").select(scaled_window_id(F.col("t"), L)).first()[0] == 1


@pytest.mark.parametrize(("clocks", "emitted"), [((29_999, 20_000), []), ((29_999, 20_001), [1]), ((50_001, 30_000), [1]), ((50_001, 30_001), [1, 2]), ((50_001, None), [])])
def test_closing(spark, clocks, emitted):
    rows = [(p, t, t, 1, 1, 5) for p, c in enumerate(clocks) if c is not None for t in (0, 5, 10_005, 20_000, c) if t <= c]
    frame = spark.createDataFrame(rows, BIDS)
    counts = BID_COUNT.value(BID_COUNT.partials(frame, L, by=()))
    last = last_closed([vector_clock(frame)], L, 2)
    assert sorted(r["w"] for r in closed_only(counts, last).collect()) == emitted


def test_only_matching_types_move_the_clock(spark):
    events = generate(spark, 5000, 2, interval_ms=20)
    both = last_closed([vector_clock(bids(events)), vector_clock(auctions(events))], L, 2).first()[0]
    assert both <= last_closed([vector_clock(bids(events))], L, 2).first()[0]


def test_edge_results(spark):
    frame = spark.createDataFrame([(0, 1, 5, 7, 3, 0), (1, 2, 6, 7, 4, -2)], BIDS)
    assert [tuple(r) for r in HIGHEST_BID.value(HIGHEST_BID.partials(frame, L, by=())).collect()] == [(1, 0, 0)]
    assert HIGHEST_PER_AUCTION.value(HIGHEST_PER_AUCTION.partials(frame, L, by=())).count() == 0
    tie = spark.createDataFrame([(1, 1, 5, 7, 3, 9), (0, 2, 6, 8, 4, 9), (0, 3, 7, 8, 5, 9)], BIDS)
    assert [tuple(r) for r in HIGHEST_BID.value(HIGHEST_BID.partials(tie, L, by=())).collect()] == [(1, 4, 9)]
    assert [tuple(r) for r in BIDS_PER_AUCTION.value(BIDS_PER_AUCTION.partials(tie, L, by=())).collect()] == [(1, 8, 2)]


AGGREGATES = {"count": BID_COUNT, "keyed": BIDS_PER_AUCTION, "highest": HIGHEST_BID, "max": HIGHEST_PER_AUCTION, "set": AUCTION_CATEGORIES}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 5), st.integers(0, 4), st.integers(-2, 30)), min_size=1, max_size=40), st.integers(0, 2**32), st.sampled_from(sorted(AGGREGATES)))
def test_merging_partials_in_any_grouping_is_the_global_answer(spark, rows, seed, name):
    agg = AGGREGATES[name]
    frame = spark.createDataFrame([(p, i, t, a, b, x, 10 + b) for i, (p, t, a, b, x) in enumerate(rows)], BIDS + ", category long")
    want = sorted(map(tuple, agg.value(agg.partials(frame, L, by=())).collect()))
    partials = agg.partials(frame, L).drop("partition").collect()
    random.Random(seed).shuffle(partials)
    schema = agg.partials(frame, L).drop("partition").schema
    cut = len(partials) // 2
    halves = [agg.merge(spark.createDataFrame(part, schema)) for part in (partials[:cut], partials[cut:])]
    merged = agg.merge(halves[0].unionByName(halves[1]))
    assert sorted(map(tuple, agg.value(merged).collect())) == want
    if name in ("highest", "max", "set"):  # repeats of a state change nothing
        again = agg.merge(merged.unionByName(halves[0]).select(merged.columns))
        assert sorted(map(tuple, agg.value(again).select(agg.value(merged).columns).collect())) == want


def test_exactly_once_count_with_closing_bids(spark):
    events = generate(spark, 20_000, 4, interval_ms=7)
    total = bids(events).count()
    newest = events.agg(F.max("t")).first()[0]
    far = events.unionByName(closing_bids(events, 4, ahead_ms=3 * L).select(events.columns))
    found = q.closed(far, q.bid_count(far, L), L).agg(F.sum("n")).first()[0]
    zero = bids(events).filter("t = 0").count()
    assert found == total - zero and newest < 3 * L + newest


def test_generator_proportions_and_blocks(spark):
    events = generate(spark, 50_000, 4)
    counts = {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}
    assert counts == {"Person": 1000, "Auction": 3000, "Bid": 46_000}
    assert events.filter(F.col("partition") != F.expr("offset div 1024 % 4")).count() == 0
    assert auctions(events).filter("category < 10 or category > 14").count() == 0
    uneven = generate(spark, 40_000, 4, skew="uneven")
    assert {r[0] for r in uneven.filter("offset < 20480").select("partition").distinct().collect()} <= {0, 1}
    assert {r[0] for r in uneven.filter("offset >= 20480").select("partition").distinct().collect()} <= {2, 3}


def test_json_codec_skips_what_does_not_parse(spark):
    events = generate(spark, 300, 2)
    records = log.encode_json(events)
    back = log.decode_json_events(records)
    assert sorted(map(str, back.select("event_type", "t", "bid", "auction", "person").collect())) == sorted(map(str, events.select("event_type", "t", "bid", "auction", "person").collect()))
    broken = records.limit(1).withColumn("value", F.encode(F.lit("{not json"), "UTF-8"))
    assert log.decode_json_envelope(records.unionByName(broken)).count() == 300


def test_routing_results_and_inspection(spark):
    events = generate(spark, 8_000, 4)
    routed = log.route_by_partition(events, 4).select("partition", F.spark_partition_id().alias("task")).distinct().collect()
    assert all(r["partition"] == r["task"] for r in routed)
    seen = log.inspect(events.select("partition", "offset"), F.col("partition") == 2).collect()
    assert [r["offset"] for r in seen] == sorted(r["offset"] for r in seen) and {r["partition"] for r in seen} == {2}
    text = log.result_text(q.q5_top_auction(events, L), F.lit("x"))
    assert text.columns == ["partition", "window", "value"]
    assert log.first_per_window(text.unionByName(text)).count() == text.count()
    assert '"assign"' not in log.kafka_options("h:1", "in", [0, 1])["assign"] and log.kafka_options("h:1", "in", [0], {0: 7})["startingOffsets"] == '{"in": {"0": 7}}'


class Report:
    """What a query's progress says of one Kafka source."""

    def __init__(self, latest, end):
        self.latestOffset, self.endOffset, self.sources = latest, end, [self]

    @property
    def lastProgress(self):  # noqa: N802
        return self if self.latestOffset != "none" else None


def test_lag_of_a_stream():
    assert log.lag_of(Report('{"in": {"0": 120, "1": 7}}', '{"in": {"0": 100, "1": 7}}')) == {("in", 0): 20, ("in", 1): 0}
    assert log.lag_of(Report('{"in": {"0": 5}}', None)) == {("in", 0): 5}
    assert log.lag_of(Report(None, '{"in": {"0": 5}}')) == {} and log.lag_of(Report('{"logOffset": 3}', '{"logOffset": 3}')) == {} and log.lag_of(Report("none", None)) == {}
    assert log.positions(Report(None, '{"in": {"0": 5}}')) == ['{"in": {"0": 5}}']


def test_lag_of_tables(spark):
    held = spark.createDataFrame([(p, o) for p, n in ((0, 10), (1, 5), (2, 3)) for o in range(n)], "partition int, offset long")
    consumed = spark.createDataFrame([(0, 4), (1, 5), (2, 9)], "partition int, next long")
    assert {r["partition"]: r["lag"] for r in log.lags(held, consumed).collect()} == {0: 6, 1: 0, 2: 0}
    assert {r["partition"]: r["lag"] for r in log.lags(held, consumed.limit(0)).collect()} == {0: 10, 1: 5, 2: 3}


def test_file_log_positions_and_appending(spark, tmp_path):
    path = f"{tmp_path}/log"
    events = generate(spark, 8_000, 4)
    log.write_log(log.as_records(log.encode_json(events.filter("offset < 5000")), order=("offset",)), path)
    held = {r["partition"]: r["last"] for r in spark.read.parquet(path).groupBy("partition").agg(F.max("offset").alias("last")).collect()}
    log.write_log(log.as_records(log.encode_json(events.filter("offset >= 5000")), held, order=("offset",)), path)
    options = log.kafka_options("none", "in", [0, 2], {2: 100})
    found = log.read_log(spark, options, streaming=False, path=path).collect()
    sizes = {r["partition"]: r["n"] for r in events.groupBy("partition").agg(F.count("*").alias("n")).collect()}
    by = {p: sorted(r["offset"] for r in found if r["partition"] == p) for p in (0, 1, 2)}
    assert by == {0: list(range(sizes[0])), 1: [], 2: list(range(100, sizes[2]))}
    assert sorted(r["n"] for r in spark.read.parquet(path).groupBy("partition", "offset").agg(F.count("*").alias("n")).select("n").distinct().collect()) == [1]


def test_kafka_sinks_need_servers_and_topic(spark):
    stream = generate_stream(spark, 10).select("offset")
    with pytest.raises(ValueError, match="topic"):
        log.write_results(stream, None, "unused", fmt="kafka", options={"kafka.bootstrap.servers": "h:1"})


def test_generated_stream(spark, tmp_path):
    query = generate_stream(spark, 2_000, 4).writeStream.format("memory").queryName("made").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            if spark.table("made").count() >= 100:
                break
        rows = spark.table("made").filter("offset < 100").select("offset", "event_type", "t", "partition", "bid").collect()
    finally:
        query.stop()
    want = {r["offset"]: r for r in generate(spark, 100, 4).select("offset", "event_type", "t", "partition", "bid").collect()}
    assert len(rows) == 100 and all(r == want[r["offset"]] for r in rows)


def test_output_rows_codec_drops_what_does_not_parse(spark):
    rows = spark.createDataFrame([(7, 100, 3, "1", 1, "x", 9)], "auction long, price long, bidder long, dateTime string, timestamp long, extra string, append_ts long")
    records = log.encode_output_rows(rows)
    broken = records.withColumn("value", F.encode(F.lit("{"), "UTF-8"))
    assert [tuple(r) for r in log.decode_output_rows(records.unionByName(broken)).collect()] == [(7, 100, 3, "1", 1, "x", 9)]


def test_notices_of_order(spark):
    rows = spark.createDataFrame([(0, 0, 5), (0, 1, 25_000), (0, 2, 24_000), (1, 0, 5), (1, 1, 10_001)], "partition long, offset long, t long")
    assert [tuple(r) for r in latency.out_of_order(rows).collect()] == [(0, 1)]
    assert [tuple(r) for r in latency.skipped_windows(rows, L).collect()] == [(0, 1, 1, 3)]


def test_sampling_and_reports(spark):
    events = generate(spark, 40_000, 2)
    assert 50 < latency.pass_through_sample(events).count() < 160
    assert latency.sample_ids(latency.pass_through_sample(events)).select("uuid").distinct().count() > 50
    assert latency.per_second(events).agg(F.sum("n")).first()[0] == 40_000


MAP = "partition int, node_id int, version long"


def test_control_plane_cases(spark):
    table = spark.createDataFrame
    successor = lambda failed, n: {r["node_id"]: r["successor"] for r in cluster.ring_successor(table([(f,) for f in failed], "node_id int"), n).collect()}
    assert successor([0, 1], 3)[0] == 2
    assert successor([1, 2], 4)[1] == 3
    assert successor([1, 2], 3)[1] == 0
    assert successor([0, 1, 2], 3) == {}
    merged = cluster.merge_ownership(*(table([(2 * i, i, 0), (2 * i + 1, i, 0)], MAP) for i in range(3)))
    assert merged.count() == 6
    assert cluster.merge_ownership(table([(0, 1, 0)], MAP), table([(0, 0, 0)], MAP)).first()["node_id"] == 0
    old, new = table([(0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 1, 0)], MAP), table([(2, 0, 4), (3, 1, 4), (4, 0, 4)], MAP)
    assert sorted(r[0] for r in cluster.newly_owned(old, new, 0).collect()) == [2, 4]
    assert cluster.newly_owned(cluster.merge_ownership(old, new), table([(3, 0, 4)], MAP), 0).count() == 0
    release = cluster.to_release(table([(0, 0, 0), (1, 0, 0), (2, 0, 0)], MAP), table([(0, 0, 0), (1, 1, 1), (2, 1, 2)], MAP), 0)
    assert sorted(r[0] for r in release.collect()) == [1, 2]
    lags = lambda rows: table(rows, "partition int, lag long")
    assert tuple(cluster.partition_with_most_lag(lags([(0, 10), (1, 20), (2, 15)])).first()) == (1, 20)
    assert tuple(cluster.partition_with_most_lag(lags([(0, 10), (1, 20), (2, 20)])).first()) == (1, 20)
    assert cluster.partition_with_most_lag(lags([(-1, 5), (-2, 9)])).count() == 0
    assert cluster.node_with_most_lag(table([(0, 10), (1, 20), (2, 19)], "node_id int, lag long")).first()[0] == 1
    assert cluster.node_with_most_lag(table([], "node_id int, lag long")).count() == 0
    assert cluster.total_lag(lags([(0, 10), (1, 20), (2, 15)])).first()[0] == 45 and cluster.total_lag(lags([])).first()[0] == 0
    beats, nodes = table([(1, 0)], "node_id int, ts long"), table([(1,), (2,)], "node_id int")
    failed = lambda now, started=0, last_check=None, b=beats: sorted(r[0] for r in cluster.failed_nodes(b, nodes, now, 1_000, started, last_check).collect())
    assert failed(10_000) == [1, 2]  # node 2 never beat: it had until the start and two thresholds
    assert failed(1_001) == [1] and failed(1_000) == [] and failed(2_000) == [1]
    assert failed(10_000, started=None) == []
    assert failed(10_000, last_check=9_000) == [] and failed(10_000, last_check=8_999) == [1, 2]
    assert failed(10_000, started=9_500) == []  # a beat before the start does not count: both have until 11,500
    assert failed(10_000, b=table([(1, 10_000), (7, 0)], "node_id int, ts long")) == [2, 7]
    asked = lambda rows: table([(r,) for r in rows], "partition int")
    give = lambda a, rows: sorted(r[0] for r in cluster.hand_over(asked(a), lags(rows)).collect())
    assert give([], [(0, 3), (1, 9)]) == [1] and give([], [(0, 0), (1, 0)]) == [] and give([], [(0, 5)]) == []
    assert give([0], [(0, 3), (1, 9)]) == [0] and give([0, 1], [(0, 3), (1, 9)]) == []
    assert give([99], [(0, 3), (1, 9)]) == [] and give([99, 1], [(0, 3), (1, 9), (2, 0)]) == [1] and give([98, 99], [(0, 3), (1, 9)]) == []
    held, arrived = table([(0, 0, 0), (1, 0, 0), (2, 1, 0)], MAP), table([(0, 1, 4), (1, 1, 4), (2, 1, 4)], MAP)
    assert [r[0] for r in cluster.dropped(held, arrived, 0).collect()] == [0]  # the last one is kept
    assert sorted(map(tuple, cluster.settled(held, arrived, 0, 9).collect())) == [(0, 1, 4), (1, 0, 9), (2, 1, 4)]
    gaining = table([(0, 1, 4), (1, 1, 4), (2, 0, 4)], MAP)
    assert sorted(r[0] for r in cluster.dropped(held, gaining, 0).collect()) == [0, 1]  # it has another one now
    assert cluster.dropped(held, held, 0).count() == 0
    assert sorted(map(tuple, cluster.set_owner(held, table([(1,), (5,)], "partition int"), 3, 7).collect())) == [(0, 0, 0), (1, 3, 7), (2, 1, 0), (5, 3, 7)]
    assert cluster.others_messages(table([(0,), (1,)], "sender_id int"), 0).count() == 1


def test_a_cluster_needs_a_shared_folder():
    from tidemark.runtime import checkpoint_dir

    class Context:
        master = "spark://host:7077"
        getConf = conf = property(lambda self: lambda: {})  # noqa: N815
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
