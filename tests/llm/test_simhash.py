import random
import re

import numpy as np
import pytest
import xxhash
from helpers import docs, messy

from tidemark.llm.components import connected_components
from tidemark.llm.simhash import document_classes, fingerprint_links, keep_one, near_duplicates, shingle_hashes, simhash, tries_of
from tidemark.llm.trie import Counts, Labels, Trie, walked

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, budget):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def walk(values, tries, thin, counts=None):
    """Links between the places of ``values``, by walks of the whole tries in one task."""
    found = set()
    for trie in tries:
        turned = trie.turned(values)
        by = np.argsort(turned)
        i, j = walked(turned[by], (0, len(by), 0, len(by)), 0, 0, trie, Labels(np.arange(len(by))), thin, counts)
        found |= {tuple(sorted(p)) for p in zip(by[i].tolist(), by[j].tolist(), strict=True)}
    return found


def components(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("budget", [0, 1, 2, 4, 7])
def test_walks_find_what_brute_force_finds(budget):
    rng = random.Random(budget)
    for _ in range(10):
        base = [rng.getrandbits(64) for _ in range(4)]
        values = sorted({rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(8))) & (1 << 64) - 1 for _ in range(400)})
        near = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= budget}
        array = np.asarray(values, dtype=np.uint64)
        assert walk(array, tries_of(budget), thin=False) == near
        thin = walk(array, tries_of(budget), thin=True)
        assert thin <= near and len(thin) < 2 * len(values)
        assert components(len(values), thin) == components(len(values), near) == classes(values, budget)


def test_equal_words_and_known_classes():
    values = np.asarray([5] * 300 + [7], dtype=np.uint64)
    trie = Trie(0, 0, ((64, 1),))
    i, j = walked(values, (0, 301, 0, 301), 0, 0, trie, Labels(np.arange(301)), False)
    assert len(i) == 301 * 300 // 2
    i, j = walked(values, (0, 301, 0, 301), 0, 0, trie, Labels(np.arange(301)), True)
    assert len(i) == 300
    i, j = walked(values, (0, 301, 0, 301), 0, 0, trie, Labels(np.asarray([1] * 300 + [2])), False)
    assert len(i) == 300


def test_most_pairs_are_pruned_inside_the_walk():
    """The fingerprints of a whole table: the walk goes down in pairs of nodes, and the budget stops nearly all of them."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    values = np.unique(np.asarray([simhash(shingle_hashes(t, 4)) for t in texts], dtype=np.uint64))
    counts = Counts()
    found = walk(values, tries_of(4), True, counts)
    pairs = len(values) * (len(values) - 1) // 2
    assert counts.spent > 50_000 and counts.visited > 50_000
    assert counts.compared < pairs / 40  # leaves of four words: the rest is pruned above them
    near = set()
    for i in range(len(values)):
        near |= {(i, i + 1 + j) for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4).tolist()}
    assert found <= near and components(len(values), found) == components(len(values), near)


def test_dealt_tries_with_hot_nodes(spark):
    """A crowd below one top node is cut into chunks; the classes are those of brute force."""
    rng = random.Random(3)
    crowd = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(300)} | {crowd ^ sum(1 << rng.randrange(40) for _ in range(rng.randrange(6))) for _ in range(3000)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3)).collect()
    place = {v: i for i, v in enumerate(signed)}
    assert components(len(values), [(place[r["u"]], place[r["v"]]) for r in links]) == classes(values, 4)


def test_document_classes_by_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["É", "ABC", "abc"]
    rows = []
    for i in range(40):
        base = rng.choices(words, k=400)
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(400)] = rng.choice(words)
            rows.append((1000 - len(rows), rng.choice([" ", "\n", "\t "]).join(copy)))
    rows += [(3, None), (2, ""), (5, " \n"), (6, "one two"), (7, "ONE\ttwo"), (8, "é É")]
    rows.sort()
    values = [fingerprint(t) for _, t in rows]
    roots = classes(values, 4)
    want = {d: (f"{v:016x}", rows[r][0]) for (d, _), v, r in zip(rows, values, roots, strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in document_classes(docs(spark, rows, 3)).collect()}
    assert got == want


def test_keep_one(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10_000)}" for _ in range(300)]
    near = base[:150] + ["changed"] + base[151:]
    far = base[:150] + [f"v{i}" for i in range(150)]
    rows = [(5, " ".join(base)), (4, " ".join(base)), (9, " ".join(near)), (7, " ".join(far)), (None, " ".join(base)), (4, " ".join(base))]
    kept = keep_one(docs(spark, rows), width=5, min_jaccard=0.8).collect()
    assert sorted(r["doc_id"] for r in kept) == [4, 7]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    nodes = {x for u, v in edges if u != v for x in (u, v)}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for x in nodes}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_messy(spark):
    for least in (None, 0.8):
        extra = near_duplicates(messy(spark).selectExpr("*", "5 AS w0", "6 AS node", "7 AS grp", "8 AS row"), min_jaccard=least).collect()
        assert len(extra) == 9 and {(r["w0"], r["node"], r["grp"], r["row"]) for r in extra} == {(5, 6, 7, 8)}
    got = near_duplicates(messy(spark).selectExpr("*", "1 AS fp", "2 AS component_id")).collect()
    assert len(got) == 9
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    assert {v for (d, f), v in by.items() if f == 0} == {1}
    assert near_duplicates(docs(spark, [])).count() == 0
