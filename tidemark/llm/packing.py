"""Sequence packing by non-negative least squares over the histogram of lengths.

A document of ``n`` ids gives ``n // window`` full sequences and one rest of ``n % window`` ids. The rests are
packed whole where possible:

1. Shallow combinations of lengths that fill the window exactly are enumerated: all pairs and all triples, about a twelfth of
   the window's square.
2. Repeat counts ``x >= 0`` minimise ``|A x - h|`` for the histogram ``h`` of rests (multiplicative updates).
3. The counts are rounded by error diffusion along the longest member, never beyond the histogram; then combinations that the
   rounding has left possible are taken whole, those of the highest counts first.
4. What is left over is packed greedily, longest first, each sequence filled to the brim by cutting the rest
   that crosses its end. The very last sequence is cut at powers of two, which need no padding.

The histogram (at most ``window`` rows) and the plan (bounded by the number of combinations) are the
only things on the driver. The n-th rest of a length, in the order (input partition, row), takes the n-th
slot of that length, so assignment is arithmetic on ranks: per input partition and length the first rank
is a running sum of counts, and no group of rows meets in one task.

Defined cases: a null or empty text is the end id alone; repeated rows and equal ids are packed separately; an
empty table gives no pieces; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import memo, slices
from tidemark.runtime import materialize, ship

WINDOW = 2048
BROADCAST_ROWS = 200_000  # (input partition, length) rows up to which the ranks are broadcast: 6 MB


@dataclass
class Plan:
    """Slots by length: from rank ``froms[i]`` on, the rests of a length go to sequences ``sequences[i]`` and up, at
    ``offsets[i]``. Ranks from ``used[length]`` on lie on the line of left-overs, from ``line[length]`` on."""

    window: int
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    used: dict[int, int]
    line: dict[int, int]
    line_end: int
    first_line_sequence: int

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Pieces (start in the rest, length, sequence, offset) of a rest."""
        if rank < self.used.get(length, 0):
            froms, sequences, offsets = self.slots[length]
            i = int(np.searchsorted(froms, rank, side="right")) - 1
            return [(0, length, int(sequences[i]) + rank - int(froms[i]), int(offsets[i]))]
        at = self.line[length] + (rank - self.used.get(length, 0)) * length
        pieces, done = [], 0
        while done < length:
            sequence, offset, room = self._where(at + done)
            size = min(room, length - done)
            pieces.append((done, size, sequence, offset))
            done += size
        return pieces

    def _where(self, at: int) -> tuple[int, int, int]:
        """Sequence, offset and room to its end, of a position on the line."""
        row, offset = divmod(at, self.window)
        whole, tail = divmod(self.line_end, self.window)
        if row < whole:
            return self.first_line_sequence + row, offset, self.window - offset
        # The last row is cut into its powers of two, largest first.
        sequence, begin = self.first_line_sequence + whole, 0
        for bit in reversed(range(tail.bit_length())):
            if tail >> bit & 1:
                if offset < begin + (1 << bit):
                    return sequence, offset - begin, begin + (1 << bit) - offset
                begin += 1 << bit
                sequence += 1
        raise ValueError("beyond the line")


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c, a + b + c = window, all present; c = 0 marks a pair."""
    there = np.zeros(window + 1, dtype=bool)
    there[lengths] = True
    there[0] = False
    found = []
    for c in range(window // 3 + 1):
        if c and not there[c]:
            continue
        b = np.arange(max(c, 1), (window - c) // 2 + 1)
        a = window - c - b
        ok = there[a] & there[b]
        found.append(np.stack([a[ok], b[ok], np.full(int(ok.sum()), c)], axis=1).astype(np.int32))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int32)


def solve(histogram: np.ndarray, combos: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Non-negative least squares for the repeat counts, by multiplicative updates."""
    x = np.full(len(combos), max(1.0, histogram.sum()) / max(1, 3 * len(combos)))
    real = combos > 0

    def gather(v: np.ndarray) -> np.ndarray:
        return (v[combos] * real).sum(axis=1)

    target = gather(histogram.astype(float))
    for _ in range(rounds):
        fill = np.bincount(combos.ravel(), weights=(np.repeat(x, 3) * real.ravel()), minlength=len(histogram))
        x *= target / np.maximum(gather(fill), 1e-12)
    return x


def round_counts(x: np.ndarray, combos: np.ndarray, histogram: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole counts within the histogram, by error diffusion along the longest member and then as many as there is still room for;
    and what is left."""
    left, carry, chosen = histogram.copy(), 0.0, []
    last = -1
    for i in np.lexsort((-x, -combos[:, 0])):
        combo = tuple(int(v) for v in combos[i] if v)
        if combo[0] != last:
            last, carry = combo[0], 0.5
        carry += x[i]
        count = min(int(carry), *(int(left[v]) // n for v, n in Counter(combo).items()))
        if count > 0:
            carry -= count
            chosen.append((combo, count))
            for v in combo:
                left[v] -= count
    room = left.tolist()
    for a, b, c in combos[np.argsort(-x, kind="stable")].tolist():
        if room[a] and room[b] and (not c or room[c]):
            combo = (a, b, c) if c else (a, b)
            members = Counter(combo)
            if count := min(room[v] // n for v, n in members.items()):
                chosen.append((combo, count))
                for v, n in members.items():
                    room[v] -= n * count
    return chosen, np.asarray(room)


def make_plan(counts: dict[int, int], window: int, first_sequence: int) -> Plan:
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in counts.items():
        histogram[length] = n
    combos = combinations(np.flatnonzero(histogram), window)
    chosen, left = round_counts(solve(histogram, combos), combos, histogram) if len(combos) else ([], histogram)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = first_sequence
    for combo, count in chosen:
        offset = 0
        for length in combo:
            slots.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    line, reached = {}, 0
    for length in range(window - 1, 0, -1):
        if left[length]:
            line[length] = reached
            reached += length * int(left[length])
    tables = {k: tuple(np.asarray(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in slots.items()}
    return Plan(window, tables, used, line, reached, sequence)


ENCODED = "part int, doc_id long, n long, rest int, nth long, full_before long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode(docs: DataFrame, vocabulary: str, end_id: int, window: int) -> DataFrame:
    """Each document's ids, and its rank among the rests of its length within its input partition."""
    ship(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, full = memo(vocabulary), Counter(), 0
        for batch in slices(batches):
            ids = [i + end for i in words.encode([t or "" for t in batch.column(2).to_pylist()])]
            lengths = [len(i) // 2 for i in ids]
            ranks, before = [], []
            for n in lengths:
                ranks.append(seen[n % window])
                seen[n % window] += 1
                before.append(full)
                full += n // window
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array([n % window for n in lengths], pa.int32()), pa.array(ranks, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                ["part", "doc_id", "n", "rest", "nth", "full_before", "ids"],
            )

    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(run, ENCODED), "packing-ids")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """All pieces: which ids of which document lie where in which sequence, with their checksum."""
    encoded = encode(docs, vocabulary, end_id, window)
    by_part = encoded.groupBy("part", "rest").agg(F.count("*").alias("n_rests"), F.sum(F.floor(F.col("n") / window)).cast("long").alias("n_full"))
    ranks = materialize(
        by_part.withColumn("first", F.coalesce(F.sum("n_rests").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "packing-ranks"
    )
    per_part = ranks.groupBy("part").agg(F.sum("n_full").alias("full"))
    full_first = per_part.select("part", F.coalesce(F.sum("full").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_first"))  # one row per input partition
    counts = {r["rest"]: r["n"] for r in ranks.groupBy("rest").agg(F.sum("n_rests").alias("n")).collect() if r["rest"]}
    totals = ranks.agg(F.sum("n_full").alias("full"), F.count("*").alias("rows")).first()
    plan = make_plan(counts, window, totals["full"] or 0)
    starts = ranks.join(full_first, "part").select("part", "rest", "first", "full_first")
    if totals["rows"] <= BROADCAST_ROWS:
        starts = F.broadcast(starts)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, n, rest, nth, full_before, ids, first, full_first in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4")
                pieces = [(k * window, window, full_first + full_before + k, 0) for k in range(n // window)]
                if rest:
                    pieces += [(n - rest + s, size, q, o) for s, size, q, o in plan.place(rest, first + nth)]
                out += [(doc_id, s, size, zlib.crc32(wide[s : s + size].tobytes()), n, q, o) for s, size, q, o in pieces]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    joined = encoded.join(starts, ["part", "rest"]).select("doc_id", "n", "rest", "nth", "full_before", "ids", "first", "full_first")
    return joined.mapInArrow(assign, PIECES)
