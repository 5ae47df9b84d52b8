import random
import zlib
from collections import Counter

from helpers import docs, messy

from tidemark.llm.sharding import communication_matrix, document_shards, draw_hypergeometric, shard_uniformly


def test_matrix_has_exact_margins():
    sizes = [0, 1, 1000, 37, 512]
    matrix = communication_matrix(sizes, 7, seed=3)
    assert [sum(r) for r in matrix] == sizes
    columns = [sum(r[s] for r in matrix) for s in range(7)]
    assert max(columns) - min(columns) <= 1


def test_draw_follows_the_law():
    rng = random.Random(1)
    draws = [draw_hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    mean = sum(draws) / len(draws)
    variance = sum((d - mean) ** 2 for d in draws) / len(draws)
    assert abs(mean - 6) < 0.05
    assert abs(variance - 20 * 0.3 * 0.7 * 80 / 99) < 0.15
    assert draw_hypergeometric(rng, 5, 0, 3) == 3 and draw_hypergeometric(rng, 0, 5, 3) == 0
    assert 0 <= draw_hypergeometric(rng, 10**12, 10**13, 10**6) <= 10**6


def test_rows_law_and_columns(spark):
    rows = [(i, f"text {i % 3}") for i in range(1000)] + [(1000, None)]
    got = document_shards(docs(spark, rows, 5)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1001))
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    by = dict(rows)
    for r in got:
        body = (by[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 8, zlib.crc32(body), "rows", None)


def test_shards_are_mixed(spark):
    got = document_shards(docs(spark, [(i, "x") for i in range(4800)], 4)).collect()
    for s in range(24):
        mean = sum(r["doc_id"] for r in got if r["shard"] == s) / 200
        assert abs(mean - 2400) < 500


def test_many_slices(spark):
    got = shard_uniformly(docs(spark, [(i, "x") for i in range(500)]), ["doc_id"], shards=3, slice_rows=20).collect()
    for s in range(3):
        mine = sorted(r["slot"] for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))


def test_equal_rows_and_shuffled_tables(spark, monkeypatch):
    """A table of one row repeated is spread over the slices, and small tables that are not broadcast give the same rows."""
    from tidemark.llm import sharding

    frame = docs(spark, [(7, "x")] * 900, 4).cache()
    got = shard_uniformly(frame, ["doc_id", "text"], shards=3, slice_rows=30).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, n) for s in range(3) for n in range(300)]
    other = docs(spark, [(i, "x") for i in range(300)], 4).cache()
    one = sorted(map(tuple, shard_uniformly(other, ["doc_id"], shards=3, slice_rows=30).collect()))
    monkeypatch.setattr(sharding, "BROADCAST_PARTITIONS", 0)
    assert sorted(map(tuple, shard_uniformly(other, ["doc_id"], shards=3, slice_rows=30).collect())) == one


def test_messy_and_empty(spark):
    assert document_shards(messy(spark)).count() == 9
    assert document_shards(docs(spark, [])).count() == 0
    clash = docs(spark, [(1, "a")]).selectExpr("*", "5 AS shard", "'y' AS slot")
    row = shard_uniformly(clash, ["doc_id"], 2).collect()[0]
    assert row["text"] == "a" and row["shard"] in (0, 1) and row["slot"] == 0
