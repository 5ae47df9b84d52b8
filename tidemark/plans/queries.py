"""The queries. One body serves bounded and streaming input; streams carry watermarks already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import event_time, event_window, id_of_window, window_id
from tidemark.operators.aggregates import AUCTION_CATEGORIES, BID_COUNT, BIDS_PER_AUCTION, HIGHEST_BID, HIGHEST_PER_AUCTION, windowed
from tidemark.operators.closing import closed_only, last_closed, vector_clock
from tidemark.sources.events import N_PARTITIONS, auctions, bids


def bid_count(events: DataFrame, length_ms: int) -> DataFrame:
    return windowed(bids(events), BID_COUNT, length_ms)


def closed(events: DataFrame, results: DataFrame, length_ms: int, kinds: tuple = (bids,), n_partitions: int = N_PARTITIONS) -> DataFrame:
    """The results of final windows only; ``kinds`` are the event types whose clocks count."""
    return closed_only(results, last_closed([vector_clock(kind(events)) for kind in kinds], length_ms, n_partitions))


def q0_passthrough(events: DataFrame) -> DataFrame:
    return bids(events)


def q4_average_by_category(events: DataFrame, length_ms: int) -> DataFrame:
    """Average over auctions of the highest bid, by category, for auctions made in the same window.

    Both sides are aggregated by (w, auction) first, so the join reuses their partitioning.
    """
    best = windowed(bids(events), HIGHEST_PER_AUCTION, length_ms)
    made = windowed(auctions(events), AUCTION_CATEGORIES, length_ms)
    return best.join(made, ["w", "auction"]).groupBy("w", "category").agg(F.avg("m").alias("avg_price"))


def average_of_states(states: dict[str, DataFrame]) -> DataFrame:
    """The same from merged states: ``m`` by (w, auction), ``c`` by (w, auction, category)."""
    best, made = HIGHEST_PER_AUCTION.value(states["m"]), AUCTION_CATEGORIES.value(states["c"])
    return best.join(made, ["w", "auction"]).groupBy("w", "category").agg(F.avg("m").alias("avg_price"))


def q5_top_auction(events: DataFrame, length_ms: int) -> DataFrame:
    return windowed(bids(events), BIDS_PER_AUCTION, length_ms)


def q5_text(top: DataFrame) -> DataFrame:
    return top.select("w", F.format_string("Auction ID: %d, Bid Count: %d", "auction", "n").alias("value"))


def q7_highest_bid(events: DataFrame, length_ms: int) -> DataFrame:
    return windowed(bids(events), HIGHEST_BID, length_ms)


def q7_text(highest: DataFrame) -> DataFrame:
    return highest.select("w", F.format_string("Highest bid by bidder %d at price %d", "bidder", "price").alias("value"))


def q7_join(events: DataFrame, length_ms: int) -> DataFrame:
    """Every bid that equals a window's maximum and lies in its closed time range (left-closed windows).

    The price is the hash key. A bid lies in the closed range of its own window and, if it is exactly on
    a boundary, of the one before: that makes the window id a second hash key, instead of a time range
    over all bids of a price.
    """
    found = bids(events)
    length = F.lit(length_ms).cast("long")
    start = F.call_function("div", F.col("t"), length)
    best = found.withColumn("w", start).groupBy("w").agg(F.max("price").alias("price"))
    near = F.when(F.col("t") % length_ms == 0, F.array(start, start - 1)).otherwise(F.array(start))
    return found.withColumn("w", F.explode(near)).join(best, ["w", "price"]).select("w", "auction", "price", "bidder", F.col("t").alias("dateTime"), "extra", "offset")


# Streaming forms: the same aggregates over Spark's window column, which the state store evicts by.


def _id(length_ms: int):
    return id_of_window(F.col("window"), length_ms).alias("w")


def stream_bid_count(bid_stream: DataFrame, length_ms: int) -> DataFrame:
    return bid_stream.groupBy(event_window(F.col("et"), length_ms)).agg(F.count("*").alias("n")).select(_id(length_ms), "n")


def stream_q5(bid_stream: DataFrame, length_ms: int) -> DataFrame:
    counts = bid_stream.groupBy(event_window(F.col("et"), length_ms), "auction").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("auction", "n"), F.struct((-F.col("n")).alias("n"), F.col("auction").alias("a"))).alias("top")
    return counts.groupBy("window").agg(best).select(_id(length_ms), "top.auction", "top.n")


def stream_q7(bid_stream: DataFrame, length_ms: int) -> DataFrame:
    best = F.min_by(F.struct("bidder", "price"), F.struct((-F.col("price")).alias("p"), F.col("partition"), F.col("offset"))).alias("best")
    won = F.col("best.price") > 0
    return (
        bid_stream.groupBy(event_window(F.col("et"), length_ms)).agg(best).select(_id(length_ms), F.when(won, F.col("best.bidder")).otherwise(0).cast("long").alias("bidder"), F.when(won, F.col("best.price")).otherwise(0).cast("long").alias("price"))
    )


def stream_q7_join(bid_stream: DataFrame, again: DataFrame, length_ms: int, delay_ms: int = 4) -> DataFrame:
    """The joined form on a stream: windows closed on the left, one clock for all partitions, a watermark delay of ``delay_ms`` of
    event time. A window's maximum is emitted when the watermark has passed its end; the bids wait for it as join state.

    ``again`` is the same stream, read a second time for the maxima. A bid on a boundary is also in the closed range of the window before.
    """
    size, delay = f"{length_ms} milliseconds", f"{delay_ms} milliseconds"
    timed = lambda s: s.withColumn("et", event_time(F.col("t"))).withWatermark("et", delay)
    best = timed(again).groupBy(F.window("et", size).alias("window")).agg(F.max("price").alias("best_price"))
    best = best.select(F.col("window.start").alias("best_start"), F.window_time("window").alias("best_time"), "best_price")
    length = F.lit(length_ms).cast("long")
    start = F.call_function("div", F.col("t"), length)
    near = F.when(F.col("t") % length_ms == 0, F.array(start, start - 1)).otherwise(F.array(start))
    bid_rows = timed(bid_stream).withColumn("w", F.explode(near)).withColumn("start", F.timestamp_millis(F.col("w") * length))
    # The time range lets the store drop bids whose window is long over.
    inside = (F.col("et") >= F.col("best_time") - F.expr(f"INTERVAL {length_ms + 1} MILLISECONDS")) & (F.col("et") <= F.col("best_time") + F.expr("INTERVAL 1 MILLISECOND"))
    joined = bid_rows.join(best, (F.col("start") == F.col("best_start")) & (F.col("price") == F.col("best_price")) & inside)
    return joined.select("w", "auction", "price", "bidder", F.col("t").alias("dateTime"), "extra", "offset")


def stream_q4(bid_stream: DataFrame, auction_stream: DataFrame, length_ms: int) -> DataFrame:
    """Union form: one keyed state per (window, auction) holds the highest bid and the set of categories."""
    none = F.lit(None).cast("long")
    both = bid_stream.select("et", "auction", "price", none.alias("category")).unionByName(auction_stream.select("et", "auction", none.alias("price"), "category"))
    merged = both.groupBy(event_window(F.col("et"), length_ms), "auction").agg(F.max(F.when(F.col("price") > 0, F.col("price"))).alias("m"), F.collect_set("category").alias("categories"))
    rows = merged.filter(F.col("m").isNotNull()).select("window", "m", F.explode("categories").alias("category"))
    return rows.groupBy("window", "category").agg(F.avg("m").alias("avg_price")).select(_id(length_ms), "category", "avg_price")


def clocked(stream: DataFrame, length_ms: int) -> DataFrame:
    """Event time with a watermark one window behind: a window closes when the clock is past the next one."""
    return stream.withColumn("et", event_time(F.col("t"))).withWatermark("et", f"{length_ms} milliseconds")


def window_assignment(events: DataFrame, length_ms: int) -> DataFrame:
    return events.select("offset", "t", window_id(F.col("t"), length_ms).alias("w"))
