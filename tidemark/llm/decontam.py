"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are words (lower-cased, common punctuation apart; in scripts that do not put spaces between words, each
character is one). A document leaks an item of ``L`` words if
some window of it is within ``k = floor(0.2 L)`` word edits, that is at an edit similarity of 0.8 or more.

1. Embedding. A CGK random walk reads a window: at each step it puts out the word that it stands on, and moves on or not
   by a random bit of that word and step. Walks over windows that are few edits apart fall into step again after an edit,
   so their outputs differ in few places: edit distance becomes Hamming distance.
2. Sampling. A table's key is the output at a few steps, drawn at random. Windows of every size begin with the same walk, so a
   document is walked once from each word that some item has, whatever the items' lengths. An item has windows of the largest
   size that is ``SPARE`` words below its own, every ``STRIDE`` words, so that long items are found at least as well as short ones. Each size has tables of its own, whose steps lie within its windows.
3. Counts. ``L - k`` words of the item are left unedited, so at least as many must be somewhere around a window that shares
   a key: a necessary condition, which stops nearly all chance hits.
4. Verification. The exact edit distance of the item to the best part of the stretch.

Recall is that of the tables, and stated with the tests, by brute force: see the README. Precision is exact.

The items are the query side: they are taken in chunks of at most ``CHUNK_WORDS`` words, which bounds what a task
holds, one pass over the documents per chunk. No document or link reaches the driver.

Defined cases: null or empty texts leak nothing; an item of fewer than ``MIN_WORDS`` words is no evidence and is
skipped, as is a null one; equal items each get a row; repeated documents each get theirs; the best window
(fewest edits, then first) is reported once per document and item; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.worker import release, trim
from tidemark.runtime import ship

SIMILARITY_EDITS = 0.2
MIN_WORDS = 5
CHUNK_WORDS = 200_000
STRIDE = 3  # words from one window of an item to the next
SPARE = 4  # an item has so many words more than its windows' size, so that it has more than one window
WALKS = 6
#: Windows of at least so many words: tables of each walk, steps of a table, steps between two of those at least.
SIZES = {5: (8, 3, 1), 8: (6, 4, 1), 12: (5, 4, 3)}
TABLE_BITS = 20  # of a table's bitmap at most; less for few keys, so that a worker does not hold 114 full ones
PUNCTUATION = ".,!?;:\"|()[]"
#: Scripts without spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, bopomofo, Han. And their punctuation.
UNSPACED = re.compile(
    "([\u0e01-\u0e4e\u0e81-\u0ece\u0f40-\u0fbc\u1000-\u103f\u1780-\u17d3\u3005-\u3007\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f"
    "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])"
)
UNSPACED_MARKS = re.compile("[\u3000-\u3003\u3008-\u3020\u30a0\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
BATCH_WORDS = 1 << 17
SHIFT = 2  # words by which a walk may be out of step where it shares a key, besides the edits
BLOCK = 4096  # places whose words are counted at once


def words_of(text: str) -> list[str]:
    text = text.lower()
    for c in PUNCTUATION:
        text = text.replace(c, " ")
    if not text.isascii():
        text = UNSPACED.sub(r" \1 ", UNSPACED_MARKS.sub(" ", text))
    return text.split()


class Items:
    """The items of one chunk, ready for lookup."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(item, words_of(text)) for item, text in items]
        self.texts = [(item, w) for item, w in texts if len(w) >= MIN_WORDS]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in self.texts for w in ws}))}
        self.pad = len(self.vocabulary) + 1  # 0 is any word that no item has
        self.ids = [np.asarray([self.vocabulary[w] for w in ws], dtype=np.int64) for _, ws in self.texts]
        self.lengths = np.asarray([len(ids) for ids in self.ids], dtype=np.int64)
        self.longest = max([*map(len, self.ids), 2 * max(SIZES)])  # pads after each document: no walk reaches the next one
        self._pieces()

    @staticmethod
    def edits(length: int) -> int:
        return int(SIMILARITY_EDITS * length + 1e-9)

    def _pieces(self) -> None:
        """The windows of all items, and their keys in each table, sorted."""
        self.random = [spread_bits(np.arange(self.pad + 1, dtype=np.uint64) + np.uint64((w + 1) << 32)) for w in range(WALKS)]
        self.tables: list[tuple[int, tuple[int, ...], np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        windows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by size: item, begin, length
        for i, ids in enumerate(self.ids):
            size = max(s for s in SIZES if s <= max(MIN_WORDS, len(ids) - SPARE))
            for at in sorted({*range(0, len(ids) - size + 1, STRIDE), len(ids) - size}):
                windows[size].append((i, at, min(len(ids) - at, 2 * size)))
        draw = np.random.default_rng(7)
        for size in SIZES:
            tables, sampled_steps, apart = SIZES[size]
            steps = [drawn_steps(draw, 2 * size, sampled_steps, apart) for _ in range(WALKS * tables)]
            found = windows.get(size)
            if not found:
                continue
            # All windows of the size in a row, each followed by pads: they are walked like a document.
            flat = np.full(sum(n + 2 * size for *_, n in found), self.pad, dtype=np.int64)
            starts, reached = [], 0
            for i, at, n in found:
                starts.append(reached)
                flat[reached : reached + n] = self.ids[i][at : at + n]
                reached += n + 2 * size
            places = np.asarray(found, dtype=np.int64)[:, :2]
            for walk in range(WALKS):
                own = steps[walk * tables : (walk + 1) * tables]
                outputs = self.walk(walk, flat, np.asarray(starts, dtype=np.int64), own)
                for sampled in own:
                    keys = key_of(outputs, sampled)
                    by = np.argsort(keys, kind="stable")
                    bits = min(TABLE_BITS, 6 + len(keys).bit_length())
                    bitmap = np.zeros(1 << bits, dtype=bool)
                    bitmap[keys >> np.uint64(64 - bits)] = True
                    self.tables.append((walk, sampled, keys[by], places[by, 0], places[by, 1], bitmap))

    def walk(self, walk: int, flat: np.ndarray, starts: np.ndarray, tables: list[tuple[int, ...]]) -> dict[int, np.ndarray]:
        """Hashed outputs, by step, of the walks that begin at ``starts``, at the steps that some table samples."""
        wanted = {step for sampled in tables for step in sampled}
        bits, at = self.random[walk][flat], starts.copy()
        outputs = {}
        for step in range(max(wanted) + 1):
            here = bits[at]
            if step in wanted:
                outputs[step] = here * STEP_KEYS[step]
            at += ((here >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        return outputs

    def places(self, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, begins): where a shared key puts an item, each once, in blocks. ``flat`` ends with pads."""
        starts = np.flatnonzero((flat[: len(flat) - self.longest] > 0) & (flat[: len(flat) - self.longest] != self.pad))
        held = []
        for walk in range(WALKS):
            own = [t for t in self.tables if t[0] == walk]
            if not own or not len(starts):
                continue
            outputs = self.walk(walk, flat, starts, [t[1] for t in own])
            for _, sampled, keys, items, offsets, bitmap in own:
                mixed = key_of(outputs, sampled)
                maybe = np.flatnonzero(bitmap[mixed >> np.uint64(65 - len(bitmap).bit_length())])
                low = np.searchsorted(keys, mixed[maybe], side="left")
                count = np.searchsorted(keys, mixed[maybe], side="right") - low
                hit = np.flatnonzero(count)
                if not len(hit):
                    continue
                each = np.repeat(hit, count[hit])
                nth = np.arange(len(each)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
                row = low[each] + nth
                held.append(items[row] * np.int64(1 << 40) + (starts[maybe[each]] - offsets[row] + self.longest))
        found = np.unique(np.concatenate(held)) if held else np.zeros(0, dtype=np.int64)
        for at in range(0, len(found), BLOCK):
            part = found[at : at + BLOCK]
            yield part >> 40, (part & ((1 << 40) - 1)) - self.longest

    def plausible(self, flat: np.ndarray, items: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Whether the stretch around each place holds enough of the item's words (of any document: an upper bound)."""
        lengths = self.lengths[items]
        good = np.zeros(len(items), dtype=bool)
        for length in np.unique(lengths).tolist():
            k, of_length = self.edits(length), np.flatnonzero(lengths == length)
            slack = k + SHIFT
            step = max(1, BLOCK * 64 // length)
            for at in (of_length[i : i + step] for i in range(0, len(of_length), step)):
                words = np.stack([self.ids[i] for i in items[at].tolist()])
                around = flat[np.clip(begins[at, None] + np.arange(-slack, length + slack), 0, len(flat) - 1)]
                there = np.zeros(len(at), dtype=np.int64)
                for j in range(length):
                    there += (around == words[:, j : j + 1]).any(axis=1)
                good[at] = there >= length - k
        return good

    def search(self, flat: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, item, begin, end, edits): verified matches. ``flat`` holds all documents, each followed by
        ``longest`` pads; ``bounds`` are their begins."""
        begins: dict[tuple[int, int], set[int]] = defaultdict(set)
        for items, at in self.places(flat):
            good = self.plausible(flat, items, at)
            items, at = items[good], at[good]
            # A window lies inside its document, the item's begin may lie before it.
            owner = np.searchsorted(bounds, at + self.lengths[items] - 1, side="right") - 1
            for doc, i, begin in zip(owner.tolist(), items.tolist(), at.tolist(), strict=True):
                begins[doc, i].add(begin)
        ends = np.append(bounds[1:], len(flat)) - self.longest
        for (doc, i), found in sorted(begins.items()):
            k, length = self.edits(len(self.ids[i])), len(self.ids[i])
            stretches: list[list[int]] = []  # overlapping ones are compared as one
            for begin in sorted(found):
                low, high = max(int(bounds[doc]), begin - k - SHIFT), min(begin + length + k + SHIFT, int(ends[doc]))
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = high
                else:
                    stretches.append([low, high])
            best = None
            for low, high in stretches:
                edits, begin, end = closest(self.ids[i], flat[low:high])
                if edits <= k and (best is None or edits < best[0]):
                    best = (edits, low + begin - int(bounds[doc]), low + end - int(bounds[doc]))
            if best:
                yield doc, i, best[1], best[2], best[0]


def spread_bits(values: np.ndarray) -> np.ndarray:
    """Random-looking 64 bits for each value."""
    x = values * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn_steps(draw: np.random.Generator, steps: int, number: int, apart: int) -> tuple[int, ...]:
    """Random steps, at least ``apart`` from each other: a walk often stands on one word for some steps."""
    room = steps - (number - 1) * apart
    return tuple(int(x) + apart * k for k, x in enumerate(sorted(draw.choice(room, number, replace=True).tolist())))


STEP_KEYS = spread_bits(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def key_of(outputs: dict[int, np.ndarray], sampled: tuple[int, ...]) -> np.ndarray:
    """One table's keys: the outputs at its steps, mixed."""
    key = outputs[sampled[0]]
    for step in sampled[1:]:
        key = key ^ outputs[step]
    return key


def closest(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """Fewest edits from the item to any part of the stretch, and that part: dynamic programming by rows."""
    n = len(stretch)
    cost, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    for i, word in enumerate(item.tolist(), 1):
        new = np.empty_like(cost)
        new[0] = i
        new[1:] = np.minimum(cost[:-1] + (stretch != word), cost[1:] + 1)
        origin = np.empty_like(begin)
        origin[0] = 0
        diagonal = cost[:-1] + (stretch != word) <= cost[1:] + 1
        origin[1:] = np.where(diagonal, begin[:-1], begin[1:])
        # Insertions run along the row: a running minimum of cost minus place.
        slack = new - ramp
        reached = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == reached, ramp, 0))
        cost, begin = reached + ramp, origin[source]
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


LEAKS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("begin_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("similarity", T.DoubleType())])


def _chunks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    chunk, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("long"), F.col(text)).filter(F.col(text).isNotNull()).orderBy(item_id, text).toLocalIterator():
        chunk.append((row[0], row[1]))
        size += len(row[1]) // 4
        if size >= CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, item_id, begin_word, end_word, edits, similarity) for every document and item that it leaks, and the
    columns of the document that ``also`` names."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *also)
    schema = T.StructType([rows.schema["doc_id"], *LEAKS.fields, *(rows.schema[c] for c in also)])
    arrow = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def finder(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            trim()  # what the stages before left in this worker
            look = Items(items)
            if not look.ids:
                return
            get, pads = look.vocabulary.get, [look.pad] * look.longest
            for batch in batches:
                ids, bounds, numbers = list(pads), [], []

                def flush(ids=ids, bounds=bounds, numbers=numbers, batch=batch):
                    found = list(look.search(np.asarray(ids, dtype=np.int64), np.asarray(bounds, dtype=np.int64)))
                    if found:
                        columns = [[look.texts[i][0] for _, i, *_ in found], [b for _, _, b, _, _ in found], [e for *_, e, _ in found], [d for *_, d in found], [1 - d / len(look.ids[i]) for _, i, _, _, d in found]]
                        taken = pa.array([numbers[d] for d, *_ in found])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(taken), *(pa.array(c, k) for c, k in zip(columns, arrow, strict=True)), *(batch.column(c).take(taken) for c in also)], ["doc_id", *LEAKS.names, *also]
                        )

                for number, body in enumerate(batch.column(1).to_pylist()):
                    bounds.append(len(ids))
                    numbers.append(number)
                    ids += [get(w, 0) for w in words_of(body)]
                    ids += pads
                    if len(ids) > BATCH_WORDS:
                        yield from flush()
                        del ids[:], bounds[:], numbers[:]
                        ids += pads
                if bounds:
                    yield from flush()

        return run

    result = None
    for items in _chunks(benchmark, item_id, item_text):
        found = rows.mapInArrow(finder(items), schema)
        result = found if result is None else result.unionByName(found)
    return result if result is not None else spark.createDataFrame([], schema)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose text leaks an item. Rows of one id, or of none, are told apart by a hash of the text."""
    marked = docs.withColumn("__body", F.xxhash64("text"))
    found = find_leaks(marked, benchmark, doc_id, also=("__body",)).select(F.col("doc_id").alias("__leaks"), F.col("__body").alias("__leaking")).distinct()
    return marked.join(found, marked[doc_id].eqNullSafe(found["__leaks"]) & (marked["__body"] == found["__leaking"]), "left_anti").drop("__body")
