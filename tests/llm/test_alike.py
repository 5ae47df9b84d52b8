import random

from helpers import docs, messy

from tidemark.llm.simhash import keep_one, near_duplicates


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def brute(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(x & y)
            if both >= 0.8 * (len(x) + len(y) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [rows[root(i)][0] for i in range(len(rows))]


def check(spark, rows):
    want = dict(zip((d for d, _ in rows), brute(rows), strict=True))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, rows, 3), width=5, min_jaccard=0.8).collect()}
    assert got == want
    return len(rows) - len(set(want.values()))


def test_copies_within_a_template(spark):
    """Pages of one template are near each other without being similar enough; each has a copy that is."""
    rng = random.Random(4)
    template = [f"t{i}" for i in range(300)]
    rows = []
    for page in range(80):
        own = list(template)
        own[100:100] = [f"p{page}x{i}" for i in range(34)]
        copy = list(own)
        copy[rng.randrange(300)] = f"c{page}"
        rows += [(2 * page, " ".join(own)), (2 * page + 1, " ".join(copy))]
    assert check(spark, rows) == 80


def test_pairs_just_over_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        copy = list(base)
        for _ in range(max(1, round(len(base) * rng.uniform(0.01, 0.03)))):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(5000)}"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy if rng.random() < 0.7 else base[: int(len(base) * rng.uniform(0.75, 0.9))]))]
    assert check(spark, rows) >= 70


def test_recall_by_similarity(spark):
    """Pairs at chosen similarities: the tries' candidates hold the promised share of them."""
    rng = random.Random(6)
    rows, bands = [], {}
    for similarity, least in ((0.81, 0.95), (0.86, 0.99), (0.92, 1.0)):
        for _ in range(120):
            n = rng.randint(150, 250)
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            new = round(n * (1 - similarity) / (1 + similarity))
            copy = base[new:] + [f"v{rng.randrange(10**6)}" for _ in range(new)]  # one end replaced: Jaccard (n - new) / (n + new)
            pair = (" ".join(base), " ".join(copy))
            if jaccard(*pair) >= 0.8:
                bands.setdefault((similarity, least), []).append(len(rows))
                rows += [(len(rows), pair[0]), (len(rows) + 1, pair[1])]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs(spark, rows, 3), width=5, min_jaccard=0.8).collect()}
    for (_, least), starts in bands.items():
        assert len(starts) > 50
        assert sum(got[i + 1] == i for i in starts) >= least * len(starts)
    assert all(got[i] in (i, i - 1) for i in got)


def test_classes_do_not_depend_on_partitions(spark):
    rng = random.Random(7)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(200):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(120)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    found = [sorted(map(tuple, near_duplicates(docs(spark, rows, p), width=5, min_jaccard=0.8).select("doc_id", "component_id").collect())) for p in (1, 4, 13)]
    assert found[0] == found[1] == found[2]


def test_messy(spark):
    got = near_duplicates(messy(spark), width=5, min_jaccard=0.8).collect()
    by = {(r["doc_id"], r["component_id"]) for r in got}
    assert len(got) == 9 and {c for d, c in by if d in (1, 2, 5)} == {1}
    assert keep_one(messy(spark), width=5, min_jaccard=0.8).count() == 5
    assert keep_one(docs(spark, []), width=5, min_jaccard=0.8).count() == 0
