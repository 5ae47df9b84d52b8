"""The ``events`` table as a partitioned, time-stamped log of bids, auctions and persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_PARTITIONS = 4
BID_TYPES = ("click", "view", "purchase")
AUCTION_TYPE = "signup"
SOURCE_TYPE = "source_type"  # the stored type as it is, so that type filters reach the Parquet scan
RAW = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def _only(condition: Column, **fields: Column) -> Column:
    return F.when(condition, F.struct(*(c.alias(k) for k, c in fields.items())))


def as_events(raw: DataFrame, n_partitions: int = N_PARTITIONS) -> DataFrame:
    """Rows of the event model. Unused structs are pruned by the optimizer."""
    kind = F.col("event_type")
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    key = F.get_json_object("props", "$.k").cast("long")
    price = F.round(F.col("value") * 100).cast("long")
    user, none = F.col("user_id"), F.lit(None)
    return raw.select(
        F.when(kind.isin(*BID_TYPES), "Bid").when(kind == AUCTION_TYPE, "Auction").when(kind == "error", "Person").alias("event_type"),
        kind.alias(SOURCE_TYPE),
        t.alias("t"),
        (user % n_partitions).alias("partition"),
        F.col("event_id").alias("offset"),
        (t + F.col("event_id") % 1000).alias("append_ts"),
        _only(kind.isin(*BID_TYPES), auction=key, bidder=user, price=price, dateTime=t, extra=kind).alias("bid"),
        _only(
            kind == AUCTION_TYPE, id=key, itemName=none.cast("string"), description=none.cast("string"), initialBid=price, reserve=none.cast("long"), dateTime=t, expires=none.cast("long"), seller=user,
            category=10 + user % 5, extra=kind,
        ).alias("auction"),
        _only(
            kind == "error", id=user, name=none.cast("string"), emailAddress=none.cast("string"), creditCard=none.cast("string"), city=none.cast("string"), state=none.cast("string"), dateTime=t,
            extra=kind,
        ).alias("person"),
    )


def read_events(spark: SparkSession, sf_dir: str, n_partitions: int = N_PARTITIONS) -> DataFrame:
    return as_events(spark.read.schema(RAW).parquet(f"{sf_dir}/events.parquet"), n_partitions)


def stream_events(spark: SparkSession, sf_dir: str, n_partitions: int = N_PARTITIONS) -> DataFrame:
    """The same rows as a stream over the folder's event files."""
    reader = spark.readStream.schema(RAW).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true")
    return as_events(reader.parquet(sf_dir), n_partitions)


def partition_streams(spark: SparkSession, sf_dir: str, n_partitions: int = N_PARTITIONS) -> list[DataFrame]:
    """One stream per source partition: each gets its own watermark, hence its own clock."""
    return [stream_events(spark, sf_dir, n_partitions).filter(F.col("partition") == p) for p in range(n_partitions)]


def _of_type(events: DataFrame, name: str, stored: tuple[str, ...]) -> DataFrame:
    found = events.filter(F.col("event_type") == name)
    return found.filter(F.col(SOURCE_TYPE).isin(*stored)) if SOURCE_TYPE in events.columns else found


def bids(events: DataFrame) -> DataFrame:
    """Filter by type and narrow; the event time is the bid's own, not the envelope's."""
    return _of_type(events, "Bid", BID_TYPES).select("partition", "offset", "append_ts", F.col("bid.dateTime").alias("t"), "bid.auction", "bid.bidder", "bid.price", "bid.extra")


def auctions(events: DataFrame) -> DataFrame:
    return _of_type(events, "Auction", (AUCTION_TYPE,)).select("partition", "offset", F.col("auction.dateTime").alias("t"), F.col("auction.id").alias("auction"), "auction.category", "auction.seller")
