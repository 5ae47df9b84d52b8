import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import docs, messy
from tokenizers import Tokenizer

from tidemark.llm import tokens
from tidemark.llm.packing import combinations, make_plan, pack, round_counts, solve
from tidemark.llm.records import build_index, document_records, frame, masked, read_at, read_at_offsets, shuffled_reads, walk, write_records
from tidemark.llm.vocabulary import vocabulary_path
from tidemark.runtime import scratch_path

PATH = vocabulary_path()


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


TRICKY = ["", " ", "\n", "a", " a", "a ", "a  b", "a   b", "a \nb", "a\n b", "a\n\nb", "it's we'll", "x.y", "end.", "end..", "a, b. c", "1,000.", "é ñ.", "日本 語\nx", "a\tb", "a\0b", "a b", "a　b c", "x<|endoftext|>y", "²³ Ⅷ ½", "'s 's", "…", " .", ". .", "a\r\nb", "𝔘𝔫𝔦 ☃."]


def test_memo_equals_the_library(plain, monkeypatch):
    rng = random.Random(1)
    alphabet = ["ab", "c", "É", ".", ",", " ", "\n", "'s", "7", "!", "\t", "  ", "ß", "Word", "-"]
    texts = TRICKY + ["".join(rng.choices(alphabet, k=rng.randint(1, 25))) for _ in range(3000)]
    for bound in (10**8, 10**4):
        monkeypatch.setattr(tokens, "MEMO_BYTES", bound)
        got = list(tokens.Memo(PATH).encode(texts + texts))
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [plain(t) for t in texts] * 2


def test_frame_round_trip_and_damage():
    content = b"".join(frame(struct.pack("<BqQ", 1, i, i) + b"\x0a\x00" * i) for i in range(5))
    assert [(d, len(ids) // 2) for _, _, d, ids in walk(content)] == [(i, i) for i in range(5)]
    assert masked(b"abc") != zlib.crc32(b"abc")
    for at in (0, 9, 14, len(content) - 3):
        broken = bytearray(content)
        broken[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            list(walk(bytes(broken)))


def test_records_contract(spark, plain):
    rows = [(i * 3 % 101, t) for i, t in enumerate(TRICKY + ["some words here " * 50] * 3)] + [(500, None)]
    want, start = {}, 0
    for d, t in sorted(rows):
        ids = [*plain(t), 0]
        want[d] = (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in document_records(docs(spark, rows, 4), PATH).collect()}
    assert got == want


def test_shards_index_and_shuffled_reads(spark, plain):
    rows = [(i, f"document number {i} " * (i % 7)) for i in range(60)]
    path = scratch_path(spark, "test-records")
    write_records(docs(spark, rows, 3), f"{path}/data", PATH, shard_bytes=800)
    index = build_index(spark, f"{path}/data", f"{path}/index")
    assert index.select("shard").distinct().count() > 3
    order = shuffled_reads(index, seed=5)
    assert sorted(r["doc_id"] for r in order.collect()) == list(range(60)) != [r["doc_id"] for r in order.collect()]
    picked = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in read_at_offsets(spark, f"{path}/data", order.filter("doc_id % 3 = 0")).collect()}
    assert picked == {i: [*plain(t), 0] for i, t in rows if i % 3 == 0}


def test_records_messy(spark):
    got = document_records(messy(spark), PATH).collect()
    assert len(got) == 9 and min(got, key=lambda r: r["start"])["doc_id"] is None
    assert document_records(docs(spark, []), PATH).count() == 0
    assert read_at(frame(struct.pack("<BqQ", 0, 0, 0)), 0)[:2] == (None, b"")


def test_least_squares_uses_up_a_matching_histogram():
    histogram = np.zeros(65, dtype=np.int64)
    for a, b, c, n in ((40, 24, 0, 300), (30, 18, 16, 200), (32, 32, 0, 100)):
        for v in (a, b, c):
            histogram[v] += n if v else 0
    combos = combinations(np.flatnonzero(histogram), 64)
    assert all(sum(c) == 64 for c in combos.tolist())
    chosen, left = round_counts(solve(histogram, combos), combos, histogram)
    assert (left >= 0).all() and left.sum() <= 0.05 * histogram.sum()
    for combo, _ in chosen:
        assert sum(combo) == 64


def test_counts_are_the_least_squares_ones():
    """The conditions of the optimum: no count can be raised with profit, and those above zero not lowered."""
    rng = np.random.default_rng(3)
    histogram = np.zeros(33, dtype=np.int64)
    histogram[1:32] = rng.integers(0, 50, size=31)
    combos = combinations(np.flatnonzero(histogram), 32)
    a = np.zeros((33, len(combos)))
    for k, combo in enumerate(combos.tolist()):
        for v in combo:
            a[v, k] += v > 0
    x = solve(histogram, combos, rounds=20_000)
    gradient = a.T @ (a @ x - histogram)
    assert (x >= 0).all() and (gradient > -0.05).all() and np.abs(x * gradient).max() < 0.5
    assert len(combos) == len({tuple(c) for c in combos.tolist()})
    every = {tuple(sorted((p, q, 32 - p - q), reverse=True)) for p in range(33) for q in range(33 - p) if all(n == 0 or histogram[n] for n in (p, q, 32 - p - q))}
    assert {tuple(c) for c in combos.tolist()} == {c for c in every if c[1] > 0}


def test_most_rests_come_through_the_combinations():
    rng = random.Random(6)
    histogram = np.zeros(2049, dtype=np.int64)
    for _ in range(10_000):
        histogram[min(2047, max(1, int(rng.lognormvariate(6.5, 0.8)) % 2048))] += 1
    combos = combinations(np.flatnonzero(histogram), 2048)
    _, left = round_counts(solve(histogram, combos), combos, histogram)
    assert left.sum() < 0.15 * histogram.sum()  # lengths up to 2,047, a median of 665


def test_ranks_by_shuffle_give_the_same_pieces(spark, monkeypatch):
    from tidemark.llm import packing

    rows = [(i, " ".join(["river"] * (i * 37 % 900))) for i in range(60)] + [(3, "x"), (3, "x")]
    frame = docs(spark, rows, 4).selectExpr("*", "1 AS start", "'q' AS rest", "2 AS sequence_id").cache()
    one = sorted(map(tuple, pack(frame, PATH).collect()))
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, pack(frame, PATH).collect())) == one


def test_clashing_columns_of_records(spark):
    frame = docs(spark, [(1, "a b"), (2, None)]).selectExpr("*", "'q' AS shard", "7 AS frame", "8 AS start")
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in document_records(frame, PATH).collect()) == [(1, 0, 3), (2, 3, 1)]


def test_other_tokenizers_encode_whole_texts():
    """A file whose pieces are not those of byte-level BPE: no cuts, the library's own ids."""
    path = PATH.replace("byte_bpe_50k.json", "word_bpe_49k.json")
    texts = ["Some Words, here", "a  b", "", "x\ny"]
    memo = tokens.Memo(path)
    tokenizer = tokens.Memo(path).tokenizer
    assert not memo.by_words
    assert [np.frombuffer(g, "<u2").tolist() for g in memo.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_fills_every_sequence():
    rng = random.Random(4)
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 64), 40)}
    plan = make_plan(counts, 64, 10)
    filled = defaultdict(list)
    for n, number in counts.items():
        for rank in range(number):
            pieces = plan.place(n, rank)
            assert [p[0] for p in pieces] == [sum(x[1] for x in pieces[:i]) for i in range(len(pieces))] and sum(p[1] for p in pieces) == n
            for _, size, sequence, offset in pieces:
                filled[sequence].append((offset, size))
    assert sorted(filled) == list(range(10, 10 + len(filled)))
    for spans in filled.values():
        reached = 0
        for offset, size in sorted(spans):
            assert offset == reached
            reached += size
        assert reached == 64 or reached & (reached - 1) == 0


def check_pieces(got, want_ids):
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for d, ids in want_ids.items():
        reached = 0
        for start, length, crc, total in sorted(pieces[d]):
            assert start == reached and total == len(ids)
            assert crc == zlib.crc32(np.asarray(ids[start : start + length], "<u4").tobytes())
            reached += length
        assert reached == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for spans in sequences.values():
        reached = 0
        for offset, length in sorted(spans):
            assert offset == reached and length > 0
            reached += length
        assert reached <= 2048


def test_packing_contract(spark, plain):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["river", "bread", "unfathomable", "x"], k=rng.randint(0, 5000 if i % 10 == 0 else 900)))) for i in range(80)] + [(90, None), (91, "")]
    check_pieces(pack(docs(spark, rows, 4), PATH).collect(), {d: [*plain(t), 1] for d, t in rows})


def test_packing_messy(spark):
    got = pack(messy(spark), PATH).collect()
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 4
    assert pack(docs(spark, []), PATH).count() == 0
