"""Binary tries of 64-bit words, joined with themselves by walking pairs of nodes.

The words below a node are a range of the sorted words, and its children the two parts of that range with a 0 and a 1 at the
next bit. Pairs of nodes are walked together from the top, many pairs at a time: the bits in which they differ are added up,
and a pair is pruned when its budget is spent. Budgets are ``Limits``: how many bits may differ down to a depth. A pair of
leaves, of up to ``LEAF`` words each, is compared over the bits that are left at once. Pairs of nodes whose members are all known to be connected
are pruned too, so that a crowd of near copies does not cost all its pairs.

On a cluster the top ``depth`` levels are walked first, for all words at once: every word goes to each pair of top nodes
that it belongs to and whose differing bits are within the budget, and such a pair is walked by one task. A top node that
holds many more words than others is cut into chunks by a hash, so that no task holds more than a few times the others' share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import ship

BITS = 64
STEP = 1 << 16  # pairs of nodes that are walked at once
LEAF = 4  # words of a leaf
MEMBERS = 1 << 16  # words below a top node, about
LEAST_CHUNK = 1024

Limits = tuple[tuple[int, int], ...]  # (depth, differing bits down to there), deepest last


@dataclass(frozen=True)
class Trie:
    """Which word of a row, by how many bits it is turned to the left, and the budget."""

    word: int
    turn: int
    limits: Limits

    def turned(self, words: np.ndarray) -> np.ndarray:
        return words if not self.turn else (words << np.uint64(self.turn)) | (words >> np.uint64(BITS - self.turn))

    def within(self, apart: np.ndarray) -> np.ndarray:
        """Whether the differing bits of turned words keep to the budget."""
        return np.logical_and.reduce([np.bitwise_count(apart >> np.uint64(BITS - depth)) <= limit for depth, limit in self.limits])

    def allowed(self) -> np.ndarray:
        """Differing bits allowed at each level, from 0 to 64."""
        return np.asarray([min(limit for depth, limit in self.limits if depth >= level) for level in range(BITS + 1)])


@dataclass
class Counts:
    """Pairs of nodes that were visited, pruned by the budget, pruned as connected; pairs of words compared, and found."""

    visited: int = 0
    spent: int = 0
    connected: int = 0
    compared: int = 0
    found: int = 0


class Labels:
    """Classes of the words of a walk. ``runs`` tells whether all words of a range are of one class."""

    def __init__(self, groups: np.ndarray):
        self.label = np.unique(groups, return_inverse=True)[1] if len(groups) else np.zeros(0, dtype=np.int64)
        self.parent = list(range(int(self.label.max(initial=-1)) + 1))
        self._runs()

    def _runs(self) -> None:
        self.runs = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Connect the words; the pairs that connected two classes."""
        x, y = self.label[i], self.label[j]
        low, high = np.minimum(x, y), np.maximum(x, y)
        first = np.unique(low * len(self.parent) + high, return_index=True)[1]
        first = np.sort(first[low[first] != high[first]])  # in the order given
        kept = []
        for at, a, b in zip(first.tolist(), x[first].tolist(), y[first].tolist(), strict=True):
            a, b = self._root(a), self._root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                kept.append(at)
        if kept:
            roots = np.asarray(self.parent)
            while (roots[roots] != roots).any():
                roots = roots[roots]
            self.label = roots[self.label]
            self._runs()
        return i[kept], j[kept]


def combined(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) of the ranges a..b and c..d of each pair of nodes, those of a node with itself once; some at a time."""
    width = d - c
    size = (b - a) * width
    ends = np.cumsum(size)
    for at in range(0, int(ends[-1]) if len(ends) else 0, 4 * STEP):
        place = np.arange(at, min(at + 4 * STEP, int(ends[-1])))
        pair = np.searchsorted(ends, place, side="right")
        inside = place - (ends[pair] - size[pair])
        i, j = a[pair] + inside // width[pair], c[pair] + inside % width[pair]
        once = (a[pair] != c[pair]) | (i < j)
        yield i[once], j[once]


def near_pairs(turned: np.ndarray, start: tuple[int, int, int, int], level: int, differing: int, trie: Trie, labels: Labels, counts: Counts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in ``turned``, within the budget and of different classes, from a pair of nodes down.

    ``start`` holds the two nodes' ranges in ``turned``, each sorted. ``labels`` may change between two results.
    """
    allowed, cumulative = trie.allowed(), {}
    stack = [(level, np.asarray([*start, differing], dtype=np.int64).reshape(5, 1))]

    def words_apart(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts.compared += len(i)
        good = (labels.label[i] != labels.label[j]) & trie.within(turned[i] ^ turned[j])
        counts.found += int(good.sum())
        return i[good], j[good]

    while stack:
        level, pairs = stack.pop()
        counts.visited += pairs.shape[1]
        a, b, c, d, h = pairs
        runs = labels.runs
        one = (runs[b - 1] == runs[a]) & (runs[d - 1] == runs[c]) & (labels.label[a] == labels.label[c])
        counts.connected += int((one & ~((a == c) & (b - a == 1))).sum())
        leaf = ((b - a <= LEAF) & (d - c <= LEAF) | (level == BITS)) & ~one
        for i, j in combined(a[leaf], b[leaf], c[leaf], d[leaf]):
            i, j = words_apart(i, j)
            if len(i):
                yield i, j
        more = ~one & ~leaf
        a, b, c, d, h = a[more], b[more], c[more], d[more], h[more]
        if not len(a):
            continue
        if level not in cumulative:
            cumulative[level] = np.concatenate([[0], np.cumsum((turned >> np.uint64(BITS - 1 - level)) & np.uint64(1), dtype=np.int64)])
        ones, same = cumulative[level], a == c
        m, n = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        children = []
        for lo, hi, low, high, more in ((a, m, c, n, 0), (m, b, n, d, 0), (a, m, n, d, 1), (m, b, c, n, 1)):
            there = (lo < hi) & (low < high)
            if lo is m and low is c:
                there &= ~same  # the mirror image of the pair before
            inside = there & (h + more <= allowed[level + 1])
            counts.spent += int(there.sum()) - int(inside.sum())
            children.append(np.stack([lo[inside], hi[inside], low[inside], high[inside], h[inside] + more]))
        below = np.concatenate(children, axis=1)
        for at in range(0, below.shape[1], STEP):
            stack.append((level + 1, below[:, at : at + STEP]))


def walked(turned: np.ndarray, start: tuple[int, int, int, int], level: int, differing: int, trie: Trie, labels: Labels, thin: bool, counts: Counts | None = None, apart=None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``near_pairs`` that ``apart`` (distance or -1 for none) accepts; if ``thin``, those that connect something new, nearest first."""
    us, vs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    held: list[tuple[np.ndarray, ...]] = []  # links that wait to be put in order of their distance

    def connect() -> None:
        i, j, distance = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(distance, kind="stable")
        i, j = labels.join(i[by], j[by])
        us.append(i)
        vs.append(j)
        held.clear()

    for i, j in near_pairs(turned, start, level, differing, trie, labels, counts or Counts()):
        distance = apart(i, j) if apart is not None else np.zeros(len(i), dtype=np.int64)
        good = distance >= 0
        if thin:
            held.append((i[good], j[good], distance[good]))
            if sum(len(h[0]) for h in held) >= STEP:
                connect()
        else:
            us.append(i[good])
            vs.append(j[good])
    if held:
        connect()
    return np.concatenate(us), np.concatenate(vs)


def _spread(values: np.ndarray) -> np.ndarray:
    mixed = values * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(32))


def joined(nodes: DataFrame, tries: list[Trie], words: list[str], thin: bool, whole: int | None = None, group: str | None = None, min_depth: int = 3, members: int = MEMBERS) -> DataFrame:
    """(u, v): distinct pairs of ``nodes`` (node long, the ``words``) that some trie finds, the smaller node first.

    ``whole``: how many bits of all words together may differ. ``group``: nodes of equal values there are known to be
    connected, and not paired. If ``thin``, each task gives just the pairs that connect something new.
    """
    ship(nodes.sparkSession)
    columns = ["node", *words, *([group] if group else [])]
    rows = nodes.select(*columns)
    n = rows.count()
    depth = max(min_depth, int(np.ceil(np.log2(max(1, n) / members))))
    shift = np.uint64(BITS - depth)

    def words_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(1 + k).to_numpy().view(np.uint64) for k in range(len(words))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(tries), 1 << depth), dtype=np.int64)
        for batch in batches:
            own = words_of(batch)
            for t, trie in enumerate(tries):
                sums[t] += np.bincount((trie.turned(own[trie.word]) >> shift).astype(np.int64), minlength=1 << depth)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.reshape(-1)[at])], ["top", "n"])

    # One row per top node: words / MEMBERS of them.
    sizes = np.zeros(len(tries) << depth, dtype=np.int64)
    for top, size in rows.mapInArrow(count, "top long, n long").groupBy("top").agg(F.sum("n")).collect():
        sizes[top] = size
    chunk = max(LEAST_CHUNK, 2 * n >> depth)
    chunks = (-(-sizes // chunk)).reshape(len(tries), 1 << depth)
    first = np.cumsum(chunks, axis=1) - chunks
    masks = [[sum(1 << bit for bit in bits) for k in range(int(trie.allowed()[depth]) + 1) for bits in combinations(range(depth), k)] for trie in tries]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["trie", "low", "high", "side", "turned", *columns]
        for batch in batches:
            if not batch.num_rows:
                continue
            own, mixed = words_of(batch), _spread(batch.column(0).to_numpy().view(np.uint64))
            for t, trie in enumerate(tries):
                turned = trie.turned(own[trie.word])
                top = (turned >> shift).astype(np.int64)
                mine = first[t, top] + (mixed % chunks[t, top].astype(np.uint64)).astype(np.int64)
                for mask in masks[t]:
                    other = top ^ mask
                    for k in range(int(chunks[t, other].max())):
                        at = np.flatnonzero(chunks[t, other] > k)
                        theirs = first[t, other[at]] + k
                        low, high = np.minimum(mine[at], theirs), np.maximum(mine[at], theirs)
                        taken = pa.array(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), t, dtype=np.int32)), pa.array(low), pa.array(high), pa.array((mine[at] > theirs).astype(np.int32)), pa.array(turned[at].view(np.int64))]
                            + [c.take(taken) for c in batch.columns],
                            names,
                        )

    kinds = ", ".join(f"{c} long" for c in columns)
    dealt = rows.mapInArrow(spread, f"trie int, low long, high long, side int, turned long, {kinds}").repartition("trie", "low", "high")
    # Sorted runs of one pair of top nodes after the other, unsigned order of the turned words.
    ordered = dealt.sortWithinPartitions("trie", "low", "high", "side", F.col("turned").bitwiseXOR(F.lit(-(1 << 63))))

    def links(key: tuple[int, int, int], held: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
        side, turned, node, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
        a = int((side == 0).sum())
        turned, own = turned.view(np.uint64), [w.view(np.uint64) for w in rest[: len(words)]]
        if key[1] == key[2]:
            start, differing = (0, a, 0, a), 0
        else:
            start = (0, a, a, len(turned))
            if not 0 < a < len(turned):
                return None
            differing = int((turned[0] ^ turned[a]) >> shift).bit_count()
        if len(turned) < 2:
            return None

        def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            distance = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in own)
            return np.where(distance <= whole, distance, -1)

        labels = Labels(rest[-1] if group else np.arange(len(turned)))
        i, j = walked(turned, start, depth, differing, tries[key[0]], labels, thin, apart=None if whole is None else apart)
        if not thin:  # a pair is given by the first trie that finds it
            for earlier in tries[: key[0]]:
                word = earlier.turned(own[earlier.word])
                new = ~earlier.within(word[i] ^ word[j])
                i, j = i[new], j[new]
        return np.minimum(node[i], node[j]), np.maximum(node[i], node[j])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the pair of nodes that the last batch ended in
        key = None

        def finish() -> Iterator[pa.RecordBatch]:
            found = links(key, held) if held else None
            for at in range(0, len(found[0]) if found else 0, 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 18)]) for x in found], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            changes = np.zeros(batch.num_rows - 1, dtype=bool)
            for p in parts[:3]:
                changes |= p[1:] != p[:-1]
            cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905
                here = tuple(int(p[lo]) for p in parts[:3])
                if here != key:
                    yield from finish()
                    held, key = [], here
                held.append([p[lo:hi] for p in parts[3:]])
        yield from finish()

    return ordered.mapInArrow(join, "u long, v long").filter("u <> v").distinct()
