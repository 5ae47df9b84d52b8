"""A deterministic auction event generator: every row is a function of its sequence number.

The same expressions run over ``spark.range`` (bounded) and over the ``rate`` source (unbounded), so
there is no generator state to recover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Of 50 consecutive events 1 is a person, 3 are auctions and 46 are bids; one of
# HOT_AUCTION / HOT_BIDDER / HOT_SELLER draws is not from the hot ones; 1024 consecutive events go to
# one partition before the next one gets its block.
PERSONS, AUCTIONS, CYCLE = 1, 3, 50
HOT_AUCTION, HOT_BIDDER, HOT_SELLER = 2, 4, 4
FIRST_ID, FIRST_CATEGORY, CATEGORIES = 1000, 10, 5
BLOCK = 1024


def _draw(seq: Column, salt: str, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), seq), F.lit(n) if isinstance(n, int) else n)


def events_from_sequence(seq: Column, n_partitions: int, interval_ms: int = 10, start_ms: int = 0, skew: str = "even") -> list[Column]:
    """Columns of the event model as functions of ``seq``. ``skew="uneven"`` sends the first five blocks of
    each partition count to partitions 0 and 1 and all later ones to the upper half."""
    cycle = F.call_function("div", seq, F.lit(CYCLE))
    place = seq % CYCLE
    t = F.lit(start_ms) + seq * interval_ms
    persons = cycle + 1
    known_auctions = cycle * AUCTIONS + F.least(F.greatest(place - PERSONS, F.lit(0)) + 1, F.lit(AUCTIONS))
    kind = F.when(place < PERSONS, "Person").when(place < PERSONS + AUCTIONS, "Auction").otherwise("Bid")
    hot = lambda salt, ratio, newest: F.when(_draw(seq, salt, ratio) > 0, newest)
    auction = F.lit(FIRST_ID) + hot("a?", HOT_AUCTION, known_auctions - 1 - (known_auctions - 1) % 100).otherwise(_draw(seq, "a", known_auctions))
    bidder = F.lit(FIRST_ID) + hot("b?", HOT_BIDDER, persons - 1 - (persons - 1) % 100).otherwise(_draw(seq, "b", persons))
    seller = F.lit(FIRST_ID) + hot("s?", HOT_SELLER, persons - 1 - (persons - 1) % 100).otherwise(_draw(seq, "s", persons))
    price = F.round(F.pow(F.lit(10.0), _draw(seq, "p", 6_000) / 1000.0) * 100).cast("long")
    block = F.call_function("div", seq, F.lit(BLOCK))
    if skew == "uneven":
        half = max(1, n_partitions // 2)
        partition = F.when(block < 5 * n_partitions, _draw(block, "u", half)).otherwise(half + _draw(block, "u", max(1, n_partitions - half)))
    else:
        partition = block % n_partitions
    text = lambda prefix, salt: F.concat(F.lit(prefix), F.hex(_draw(seq, salt, 1 << 32)))
    return [
        kind.alias("event_type"),
        t.alias("t"),
        partition.cast("long").alias("partition"),
        seq.alias("offset"),
        (t + _draw(seq, "lag", 50)).alias("append_ts"),
        F.when(kind == "Bid", F.struct(auction.alias("auction"), bidder.alias("bidder"), price.alias("price"), t.alias("dateTime"), text("", "x").alias("extra"))).alias("bid"),
        F.when(
            kind == "Auction",
            F.struct(
                (F.lit(FIRST_ID) + known_auctions - 1).alias("id"), text("item ", "i").alias("itemName"), text("about ", "d").alias("description"), price.alias("initialBid"), (price * 2).alias("reserve"),
                t.alias("dateTime"), (t + 1 + _draw(seq, "e", 20_000)).alias("expires"), seller.alias("seller"), (F.lit(FIRST_CATEGORY) + _draw(seq, "c", CATEGORIES)).alias("category"),
                text("", "x").alias("extra"),
            ),
        ).alias("auction"),
        F.when(
            kind == "Person",
            F.struct(
                (F.lit(FIRST_ID) + cycle).alias("id"), text("name ", "n").alias("name"), F.concat(text("", "m"), F.lit("@example.com")).alias("emailAddress"), text("", "cc").alias("creditCard"),
                text("city ", "ct").alias("city"), text("", "st").alias("state"), t.alias("dateTime"), text("", "x").alias("extra"),
            ),
        ).alias("person"),
    ]


def generate(spark: SparkSession, n_events: int, n_partitions: int = 4, **options) -> DataFrame:
    return spark.range(n_events).select(*events_from_sequence(F.col("id"), n_partitions, **options))


def generate_stream(spark: SparkSession, rows_per_second: int = 10_000, n_partitions: int = 4, **options) -> DataFrame:
    source = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return source.select(*events_from_sequence(F.col("value"), n_partitions, **options))


def closing_bids(events: DataFrame, n_partitions: int, ahead_ms: int = 10) -> DataFrame:
    """One bid of price 0 per partition, ``ahead_ms`` past the newest event: it moves every clock on."""
    newest = events.agg(F.max("t").alias("t"))
    t = F.col("t") + ahead_ms
    bid = F.struct(F.lit(0).cast("long").alias("auction"), F.lit(0).cast("long").alias("bidder"), F.lit(0).cast("long").alias("price"), t.alias("dateTime"), F.lit("").alias("extra"))
    missing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name in ("auction", "person")}
    rows = newest.withColumn("partition", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_partitions - 1).cast("long"))))
    return rows.select(F.lit("Bid").alias("event_type"), t.alias("t"), "partition", F.lit(1 << 62).alias("offset"), t.alias("append_ts"), bid.alias("bid"), *missing.values())
