"""The mergeable aggregates: partial states per partition, a merge that is a second aggregation, a value.

Every merge is associative and commutative over disjoint partials; the max and set ones are idempotent
too. Spark does the same split by itself inside one ``groupBy``; these functions expose it, so that
partials can be stored, shipped and merged later.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import window_id


@dataclass(frozen=True)
class MergeableAggregate:
    """``keys`` below the window; ``update`` folds events, ``combine`` folds states, ``value`` reads one window."""

    keys: tuple[str, ...]
    update: dict[str, Callable[[], Column]]
    combine: dict[str, Callable[[], Column]]
    value: Callable[[DataFrame], DataFrame]

    def partials(self, events: DataFrame, length_ms: int, by: tuple[str, ...] = ("partition",), extra: dict[str, Column] | None = None) -> DataFrame:
        """One state per key of ``by``, window and own key; ``extra`` are further aggregates of the same groups."""
        windowed = events.withColumn("w", window_id(F.col("t"), length_ms))
        return windowed.groupBy(*by, "w", *self.keys).agg(*(f().alias(n) for n, f in self.update.items()), *(c.alias(n) for n, c in (extra or {}).items()))

    def merge(self, partials: DataFrame) -> DataFrame:
        return partials.groupBy("w", *self.keys).agg(*(f().alias(n) for n, f in self.combine.items()))


def windowed(events: DataFrame, aggregate: MergeableAggregate, length_ms: int) -> DataFrame:
    """One answer per window, by one shuffle: Spark's partial and final aggregation."""
    return aggregate.value(aggregate.partials(events, length_ms, by=()))


def top_auction(counts: DataFrame, by: list | None = None) -> DataFrame:
    """The auction with most bids; ties go to the lowest id."""
    best = F.min_by(F.struct("auction", "n"), F.struct((-F.col("n")).alias("n"), F.col("auction").alias("a"))).alias("top")
    return counts.groupBy(*(by or ["w"])).agg(best)


#: Ties go to the lowest partition, then to the lowest offset.
def _best_bid(price: str = "price") -> Column:
    return F.min_by(F.struct("bidder", F.col(price).alias("price"), "partition", "offset"), F.struct((-F.col(price)).alias("p"), F.col("partition"), F.col("offset")))


def highest_bid_value(states: DataFrame) -> DataFrame:
    """Prices of 0 or less never win: such a window answers bidder 0 at price 0."""
    won = F.col("best.price") > 0
    return states.select("w", F.when(won, F.col("best.bidder")).otherwise(0).cast("long").alias("bidder"), F.when(won, F.col("best.price")).otherwise(0).cast("long").alias("price"))


BID_COUNT = MergeableAggregate((), {"n": lambda: F.count("*")}, {"n": lambda: F.sum("n")}, lambda s: s.select("w", F.col("n").cast("long").alias("n")))
BIDS_PER_AUCTION = MergeableAggregate(
    ("auction",), {"n": lambda: F.count("*")}, {"n": lambda: F.sum("n")}, lambda s: top_auction(s).select("w", F.col("top.auction").alias("auction"), F.col("top.n").cast("long").alias("n"))
)
HIGHEST_BID = MergeableAggregate(
    (),
    {"best": _best_bid},
    {"best": lambda: F.min_by("best", F.struct((-F.col("best.price")).alias("p"), F.col("best.partition").alias("q"), F.col("best.offset").alias("o")))},
    highest_bid_value,
)
#: The price filter sits inside the aggregate: bids without a price still make the window.
HIGHEST_PER_AUCTION = MergeableAggregate(("auction",), {"m": lambda: F.max(F.when(F.col("price") > 0, F.col("price")))}, {"m": lambda: F.max("m")}, lambda s: s.filter(F.col("m").isNotNull()))
AUCTION_CATEGORIES = MergeableAggregate(("auction", "category"), {"seen": lambda: F.count("*")}, {"seen": lambda: F.sum("seen")}, lambda s: s.select("w", "auction", "category"))
