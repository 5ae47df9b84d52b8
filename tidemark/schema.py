"""Event model: one wide row with a type, the envelope and three nullable structs."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


L, S = T.LongType(), T.StringType()

BID = _struct(("auction", L), ("bidder", L), ("price", L), ("dateTime", L), ("extra", S))
PERSON = _struct(("id", L), ("name", S), ("emailAddress", S), ("creditCard", S), ("city", S), ("state", S), ("dateTime", L), ("extra", S))
AUCTION = _struct(("id", L), ("itemName", S), ("description", S), ("initialBid", L), ("reserve", L), ("dateTime", L), ("expires", L), ("seller", L), ("category", L), ("extra", S))

EVENT = _struct(("event_type", S), ("t", L), ("partition", L), ("offset", L), ("append_ts", L), ("bid", BID), ("auction", AUCTION), ("person", PERSON))
#: A record of the log: what a Kafka source delivers.
LOG_RECORD = _struct(("key", T.BinaryType()), ("value", T.BinaryType()), ("partition", T.IntegerType()), ("offset", L), ("timestamp", T.TimestampType()))
#: A result as text, one per window.
RESULT = _struct(("partition", T.IntegerType()), ("window", L), ("value", S))
#: Result rows of the joined highest-bid query as JSON.
OUTPUT_ROW = _struct(("auction", L), ("price", L), ("bidder", L), ("dateTime", S), ("timestamp", L), ("extra", S))
