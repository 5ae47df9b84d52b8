"""Streams against the bounded answers: closing, late rows, restarts."""

import shutil

from pyspark.sql import functions as F

from tidemark.plans import queries as q
from tidemark.sources.events import N_PARTITIONS, bids
from tidemark.streaming.clock import count_with_clock
from tidemark.streaming.runner import clocked_union, run_to_end, stream_session

L = 10_000
SCHEMA = "partition long, offset long, append_ts long, t long, auction long, bidder long, price long"


class Log:
    """A log of bids in files, one folder per partition."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, root, 0

    def write(self, rows):
        for p, t in rows:
            self.n += 1
            self.spark.createDataFrame([(p, self.n, t, t, 1, 1, 5)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/{p}")

    def streams(self, session, n):
        return [session.readStream.schema(SCHEMA).parquet(f"{self.root}/{p}") for p in range(n)]


def _count(streams):
    return q.stream_bid_count(clocked_union(streams, lambda s: s, L), L)


def test_min_clock_and_restart(spark, tmp_path):
    session, source = stream_session(spark), Log(spark, f"{tmp_path}/in")
    read = lambda: sorted((r["w"], r["n"]) for r in spark.read.schema("w long, n long").parquet(f"{tmp_path}/out").collect())
    run = lambda: run_to_end(_count(source.streams(session, 2)), f"{tmp_path}/out", f"{tmp_path}/cp")
    source.write([(0, 5), (1, 7), (0, 29_999), (1, 20_000)])
    run()
    assert read() == []
    source.write([(0, 50_001), (1, 20_001)])
    run()
    assert read() == [(1, 2)]
    source.write([(0, 6), (1, 8)])  # late rows of an emitted window
    run()
    assert read() == [(1, 2)]
    source.write([(0, 50_002), (1, 30_001)])
    run()
    assert read() == [(1, 2), (2, 1)]


def test_explicit_clock_survives_a_restart(spark, tmp_path):
    from tidemark.runtime import ship

    ship(spark)
    session, source = stream_session(spark), Log(spark, f"{tmp_path}/in")
    read = lambda: sorted((r["w"], r["n"]) for r in spark.read.schema("w long, n long").parquet(f"{tmp_path}/out").collect())

    def run():
        stream = session.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        run_to_end(count_with_clock(stream, L, 2), f"{tmp_path}/out", f"{tmp_path}/cp")

    source.write([(0, 5), (1, 7), (0, 50_001), (1, 20_001)])
    run()
    assert read() == [(1, 2)]
    source.write([(1, 30_001)])  # only one partition moves: its clock and the other's stored one suffice
    run()
    assert read() == [(1, 2)]  # window 2 is over, and had no bids
    source.write([(0, 6), (1, 60_000), (0, 60_000)])
    run()
    assert read() == [(1, 2), (3, 1), (4, 1)]


def _host(path, name="bid_count", n=2, length=L):
    from tidemark.plans.registry import HOSTED
    from tidemark.streaming.host import Hosted, WindowedHost

    hosted, combine, schema = HOSTED[name]
    return WindowedHost(path, {k: Hosted(lambda s: s, h.aggregate) for k, h in hosted.items()}, combine, length, n), schema


def _one_stream(session, source):
    return session.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{source.root}")


def test_host_closes_restarts_and_forgets(spark, tmp_path):
    session, source = stream_session(spark), Log(spark, f"{tmp_path}/in")

    def run():
        host, schema = _host(f"{tmp_path}/host")  # a new object: everything it knows is in its tables
        host.start(_one_stream(session, source)).awaitTermination()
        return host, sorted((r["w"], r["n"]) for r in host.results(spark, schema).collect()) if (tmp_path / "host/out").exists() else []

    source.write([(0, 5), (1, 7), (0, 29_999), (1, 20_000)])
    assert run()[1] == []
    source.write([(0, 50_001), (1, 20_001)])
    assert run()[1] == [(1, 2)]
    source.write([(0, 6), (1, 8)])  # late rows of an emitted window
    host, found = run()
    assert found == [(1, 2)]
    assert {(r["partition"], r["out_of_order"], r["to_w"] - r["from_w"]) for r in host.notices(spark).collect()} >= {(0, 0, 3), (0, 1, 0), (1, 1, 0)}
    source.write([(0, 50_002), (1, 30_001)])
    host, found = run()
    assert found == [(1, 2), (2, 1)]
    state = host.snapshot(spark)
    assert state["emitted"].first()[0] == 2 and sorted(r["w"] for r in state["n"].collect()) == [3, 4, 6]  # closed windows are gone
    assert {r["partition"]: r["clock"] for r in state["clocks"].collect()} == {0: 50_002, 1: 30_001}


def test_host_repeats_a_batch_without_a_trace(spark, tmp_path):
    """A batch that was cut off is run again under its number: the same results and state."""
    host, schema = _host(f"{tmp_path}/host", "q7")
    rows = lambda *r: spark.createDataFrame([(p, i, t, t, 1, b, x) for i, (p, t, b, x) in enumerate(r)], SCHEMA)
    host.process(rows((0, 5, 1, 10), (1, 7, 2, 30)), 0)
    second = rows((0, 8, 3, 20), (0, 30_001, 4, 1), (1, 30_001, 5, 1))
    host.process(second, 1)
    once = (sorted(map(tuple, host.results(spark, schema).collect())), sorted(map(str, host.snapshot(spark)["best"].collect())))
    host.process(second, 1)
    assert (sorted(map(tuple, host.results(spark, schema).collect())), sorted(map(str, host.snapshot(spark)["best"].collect()))) == once
    assert once[0] == [(1, 2, 30)]


def test_host_waits_for_an_idle_partition(spark, tmp_path):
    session, source = stream_session(spark), Log(spark, f"{tmp_path}/in")
    source.write([(0, t) for t in (5, 20_001, 90_000)])
    host, _ = _host(f"{tmp_path}/host")
    host.start(_one_stream(session, source)).awaitTermination()
    assert not (tmp_path / "host/out").exists()


def test_log_stream_goes_on_where_it_stopped(spark, tmp_path):
    """A file log read as a stream from given positions, decoded and written; what is appended later is read once."""
    from tidemark.sources import log
    from tidemark.sources.generator import generate

    session, path = stream_session(spark), f"{tmp_path}/log"
    events = generate(spark, 4_000, 2)
    records = log.as_records(log.encode_json(events), order=("offset",)).cache()
    log.write_log(records.filter("offset < 1500"), path)

    def run():
        stream = log.read_log(session, log.kafka_options("none", "in", [0, 1], {1: 1000}), path=path)
        rows = log.decode_json_envelope(stream.withColumn("append_ts", F.unix_millis("timestamp")))
        log.write_results(rows, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        return spark.read.schema("event_type string, t long, partition int, append_ts long").parquet(f"{tmp_path}/out").count()

    assert run() == 1500 + 500
    log.write_log(records.filter("offset >= 1500"), path)
    assert run() == events.count() - 1000


def test_output_consumer(spark, tmp_path):
    """Results as text, written by a stream, read by another one that shows them in a table."""
    from tidemark.sources import log

    session, source = stream_session(spark), Log(spark, f"{tmp_path}/in")
    source.write([(p, t) for p in (0, 1) for t in (5, 7, 20_001, 40_001)])
    counts = _count(source.streams(session, 2))
    log.write_results(log.result_text(counts, F.col("n").cast("string")), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    results = session.readStream.schema("partition int, window long, value string").parquet(f"{tmp_path}/out")
    log.write_results(results, None, f"{tmp_path}/cp2", fmt="memory", name="shown").awaitTermination()
    assert sorted((r["window"], r["value"]) for r in session.table("shown").collect()) == [(1, "4"), (3, "2")]  # the clocks are in window 5


def test_watermark_state_is_evicted(spark, tmp_path):
    """The built-in aggregation drops what has closed: the state holds the open windows only."""
    session, source = stream_session(spark), Log(spark, f"{tmp_path}/in")
    source.write([(p, 1 + 10_000 * i) for i in range(8) for p in (0, 1)])
    query = _count(source.streams(session, 2)).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(held) >= 8 and held[-1] <= 3


def test_stream_counts_add_up(spark, tmp_path):
    """Bids produced = sum of the emitted counts, after closing rows for each partition."""
    session, source = stream_session(spark), Log(spark, f"{tmp_path}/in")
    source.write([(p, 1 + 997 * i) for i in range(12) for p in (0, 1)])
    source.write([(0, 60_000), (1, 60_000)])
    run_to_end(_count(source.streams(session, 2)), f"{tmp_path}/out", f"{tmp_path}/cp")
    total = spark.read.schema("w long, n long").parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0]
    assert total == 24
    shutil.rmtree(f"{tmp_path}/cp")


def test_partition_count_of_the_fixture(spark):
    from tidemark.sources.events import read_events

    assert bids(read_events(spark, "/root/testdata/sf0.001")).select("partition").distinct().count() == N_PARTITIONS


def test_observed_metrics(spark, tmp_path):
    from tidemark.streaming.metrics import NAME, observed, throughput

    session, source = stream_session(spark), Log(spark, f"{tmp_path}/in")
    source.write([(0, 5), (0, 25_000)])
    stream = observed(source.streams(session, 1)[0], L)
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    found = [p.observedMetrics[NAME].asDict() for p in query.recentProgress if NAME in p.observedMetrics]
    assert {"rows": 2, "oldest": 5, "newest": 25_000, "windows": 3} in found
    assert len(throughput(query)) >= 1
