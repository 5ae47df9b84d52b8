import random

import numpy as np
from helpers import docs, messy

from tidemark.llm.decontam import Items, closest, drop_leaking, find_leaks, words_of


def sellers(item, text):
    """Fewest edits of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(out))
        if kind == 0:
            out[at] = f"new{rng.randrange(1000)}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, f"more{rng.randrange(1000)}")
    return out


def test_closest_by_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.randint(1, 4) for _ in range(rng.randint(1, 9))]
        text = [rng.randint(0, 4) for _ in range(rng.randint(0, 16))]
        edits, begin, end = closest(np.asarray(item), np.asarray(text, dtype=np.int64))
        assert edits == sellers(item, text) and 0 <= begin <= end <= len(text)


def _corpus(seed=2, n_docs=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 50)))) for i in range(25)]
    rows = []
    for d in range(n_docs):
        body = rng.choices(vocabulary, k=rng.randint(60, 300))
        if d % 2 == 0:
            words = items[rng.randrange(25)][1].split()
            part = edited(rng, words, rng.randrange(int(0.2 * len(words)) + 1))
            at = rng.randrange(len(body))
            body[at:at] = part
        rows.append((d, " ".join(body).replace("w7 ", "W7, ")))
    return items, rows


def test_recall_and_precision_by_brute_force(spark):
    items, rows = _corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in find_leaks(docs(spark, rows, 3), bench).collect()}
    want = {}
    for d, text in rows:
        for i, item in items:
            a, b = words_of(item), words_of(text)
            edits = sellers(a, b)
            if edits <= Items.edits(len(a)):
                want[d, i] = edits
    assert len(want) >= 70
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.97 * len(got)


def test_recall_of_the_tables_by_length():
    """Items with as many edits as a leak may have, of every kind, inside other text: each is a leak by definition."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(2000)]
    found_in_all = planted = 0
    for length in (5, 7, 8, 11, 12, 15, 20, 30, 60, 200):
        items = [(i, " ".join(rng.choices(vocabulary, k=length))) for i in range(60)]
        look = Items(items)
        get, pads = look.vocabulary.get, [look.pad] * look.longest
        ids, bounds = list(pads), []
        for i, item in items:
            words, k = item.split(), Items.edits(length)
            if i % 2:
                words = edited(rng, words, k)
            else:
                for _ in range(k):
                    del words[rng.randrange(len(words))]
            bounds.append(len(ids))
            ids += [get(w, 0) for w in rng.choices(vocabulary, k=20) + words + rng.choices(vocabulary, k=20)] + pads
        found = {(d, i) for d, i, *_ in look.search(np.asarray(ids), np.asarray(bounds))}
        caught = sum((i, i) in found for i in range(60))
        assert caught >= 0.95 * 60, length
        found_in_all, planted = found_in_all + caught, planted + 60
    assert found_in_all >= 0.985 * planted


def test_the_windows_come_from_the_tables(monkeypatch):
    """Without a table there is no candidate: nothing else finds windows."""
    look = Items([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")])
    flat = np.asarray([look.pad] * look.longest + look.ids[0].tolist() + [look.pad] * look.longest)
    assert len(list(look.search(flat, np.asarray([look.longest])))) == 1
    look.tables = []
    assert list(look.search(flat, np.asarray([look.longest]))) == []


def test_clashing_columns(spark):
    frame = docs(spark, [(1, "a b c d e f g h"), (2, "x")]).selectExpr("*", "'k' AS item_id", "1 AS edits")
    bench = spark.createDataFrame([(9, "a b c d e f")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in find_leaks(frame, bench).collect()] == [(1, 9)]
    assert [tuple(r) for r in drop_leaking(frame, bench).collect()] == [(2, "x", "k", 1)]


def test_chunks_change_nothing(spark, monkeypatch):
    from tidemark.llm import decontam

    items, rows = _corpus(5, 40)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(spark, rows), bench).collect()}
    monkeypatch.setattr(decontam, "CHUNK_WORDS", 200)
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(spark, rows), bench).collect()} == one


def test_messy(spark):
    bench = spark.createDataFrame([(1, None), (2, "too short"), (3, "word100 word101 word102 word103 word104 word105 word106"), (3, "word100 word101 word102 word103 word104 word105 word106")], "item_id long, text string")
    got = find_leaks(messy(spark), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in got] == [(4, 3, 0)] * 2
    assert drop_leaking(messy(spark), bench).count() == 8
    assert find_leaks(docs(spark, []), bench).count() == 0
    assert find_leaks(messy(spark), bench.filter("false")).count() == 0


def test_rows_without_a_leak_stay_whatever_their_id(spark):
    item = " ".join(f"w{i}" for i in range(20))
    clean = " ".join(f"v{i}" for i in range(40))
    rows = [(None, f"{clean} {item}"), (None, clean), (None, None), (7, f"{item} {clean}"), (7, clean), (7, clean), (8, item), (9, clean)]
    kept = drop_leaking(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text"]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(repr, [(None, clean), (None, None), (7, clean), (7, clean), (9, clean)]))


def test_long_items_by_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(n, " ".join(rng.choices(vocabulary, k=n))) for n in (50, 100, 200, 400)]
    rows = []
    for n, item in items:
        for d in range(12):
            words = item.split()
            if d % 2:
                words = edited(rng, words, n // 5)
            else:
                for _ in range(n // 5):
                    del words[rng.randrange(len(words))]
            rows.append((1000 * n + d, " ".join(rng.choices(vocabulary, k=40) + words + rng.choices(vocabulary, k=40))))
    want = {(d, n): edits for d, text in rows for n, item in items if (edits := sellers(item.split(), text.split())) <= n // 5}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in find_leaks(docs(spark, rows, 3), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) >= 48 and got == want


def test_scripts_without_spaces(spark):
    rng = random.Random(13)
    han, thai = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(40)), "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(40))
    other = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(60))
    rows = [(1, f"{other}\u3002{han}\u3002abc"), (2, other + han[:10] + "\u4e00" + han[12:] + other), (3, other), (4, f"{other}{thai}x"), (5, f"Words, {han[:20]}\uff0c{han[20:]}words")]
    got = find_leaks(docs(spark, rows), spark.createDataFrame([(1, han), (2, thai), (3, "\u4e00\u4e8c")], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got) == [(1, 1, 0), (2, 1, 2), (4, 2, 0), (5, 1, 0)]
    assert words_of("It's caf\u00e9 \uac00\ub098.") == ["it's", "caf\u00e9", "\uac00\ub098"]


def test_bitmaps_grow_with_the_keys():
    """A worker holds 114 tables: a few items do not take a full bitmap in each."""
    rng = random.Random(13)
    few = Items([(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(5 + i % 40))) for i in range(200)])
    assert len(few.tables) == 114
    assert sum(t[5].nbytes for t in few.tables) < 20_000_000
