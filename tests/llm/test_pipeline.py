import random

import corpus_pipeline
from test_tokens import PATH, check_pieces
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _write(spark, folder, rows, items):
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_whole_pipeline(spark, tmp_path):
    rng = random.Random(1)
    en = "the and of to in is that it was for on with as his they be at one have this from or had by".split()
    de = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split()
    text = lambda words, n: " ".join(f"{rng.choice(words)}{rng.choice(['', 'x', 'en', 'ing'])}{rng.randrange(50)}" for _ in range(n))
    rows = [(i, text(en if i % 2 else de, 120), "en" if i % 2 else "de") for i in range(40)]
    item = text(en, 30)
    boiler = "all rights reserved by the people of the town"
    rows += [(100, rows[1][1], "en"), (101, rows[3][1].replace(rows[3][1].split()[60], "changed", 1), "en")]  # an exact and a near copy
    rows += [(110, text(en, 50) + " " + item + " " + text(en, 50), "en")]  # a leak
    rows += [(120, None, "en"), (121, "123 456", "en")]  # no letters
    rows += [(130 + i, text(en, 80) + "\n" + boiler + f"\n{text(en, 40)}", "en") for i in range(4)]
    folder = f"file://{tmp_path}"
    _write(spark, folder, rows, [(0, item)])
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
        if name != "packed":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: {r["doc_id"] for r in out} for name, out in kept.items()}
    everything = {r[0] for r in rows}
    assert ids["language"] == everything - {120, 121}
    assert ids["lines"] == ids["language"]
    assert sum(boiler in r["text"] for r in kept["lines"]) == 1
    assert all(r["n_chars"] == len(r["text"]) for r in kept["lines"])
    assert ids["near_copies"] == ids["lines"] - {100, 101}
    assert ids["benchmark_free"] == ids["near_copies"] - {110}
    tokenizer = Tokenizer.from_file(PATH)
    check_pieces(kept["packed"], {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1] for r in kept["benchmark_free"]})
    assert sorted(map(repr, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").groupBy("doc_id").sum("length").collect())) == sorted(
        map(repr, spark.createDataFrame(kept["packed"]).groupBy("doc_id").sum("length").collect())
    )


def _prose(rng, n):
    en = "the and of to in is that it was for on with as his they be at one have this from or had by".split()
    return " ".join(f"{rng.choice(en)}{rng.choice(['', 'x', 'en', 'ing'])}{rng.randrange(50)}" for _ in range(n))


def test_stages_by_brute_force(spark, tmp_path):
    """Each stage's rows against its rule worked out by hand over what the stage before it kept."""
    rng = random.Random(11)
    items = [(i, _prose(rng, rng.randint(15, 30))) for i in range(4)]
    line = "every page of this site has the same long footer"
    rows = [(i, _prose(rng, rng.randint(60, 150)), "en") for i in range(50)]
    for i in range(12):  # copies, exact and near
        words = rows[i][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((60 + i, rows[i][1] if i % 2 else " ".join(words), None if i % 3 else "en"))
    rows += [(80 + i, f"{_prose(rng, 60)}\n{line}\n{_prose(rng, 50)}", "en") for i in range(6)]
    for i, (_, item) in enumerate(items):
        words = item.split()
        words[3] = "other"
        rows.append((90 + i, f"{_prose(rng, 40)} {' '.join(words)} {_prose(rng, 40)}", "en"))
    rows += [(None, _prose(rng, 80), "en"), (None, rows[0][1], "en"), (7, _prose(rng, 90), "en"), (7, rows[7][1], "en"), (98, None, "en"), (99, "", "en")]
    folder = f"file://{tmp_path}"
    _write(spark, folder, rows, items)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS fp", "'q' AS body", "2 AS n_lines"), []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    language, lines, copies, free = kept
    order = lambda found: sorted(found, key=repr)
    assert order(language) == order((d, t) for d, t, _ in rows if t)
    number = lambda d: -1 if d is None else d
    held = {}
    for d, t in language:
        for x in set(t.split("\n")):
            held.setdefault(x, []).append(number(d))  # no line here needs stripping or lower-casing
    gone = lambda x, d: len(x) >= 20 and len(held[x]) >= 3 and number(d) < max(held[x])
    assert order(lines) == order((d, "\n".join(x for x in t.split("\n") if not gone(x, d))) for d, t in language)
    assert sum(line in t for _, t in lines) == 1

    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in lines]
    classes = list(range(len(lines)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y):
                old, new = max(classes[i], classes[j]), min(classes[i], classes[j])
                classes = [new if c == old else c for c in classes]
    first = {}
    for c, (d, t) in zip(classes, lines, strict=True):
        first.setdefault(c, []).append((d is None, d, t))
    assert sorted(repr(d) for d, _ in copies) == sorted(repr(min(c, key=lambda x: (x[0], x[1] or 0))[1]) for c in first.values())
    assert {t for _, t in copies} <= {t for _, t in lines}

    def leaks(text):
        words = text.split()
        for _, item in items:
            w = item.split()
            row = [0] * (len(words) + 1)
            for i, x in enumerate(w, 1):
                new = [i]
                for j, y in enumerate(words, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            if min(row) <= len(w) // 5:
                return True
        return False

    assert order(free) == order((d, t) for d, t in copies if not leaks(t))


def test_scratch_tables_are_dropped(spark, tmp_path):
    import os

    from tidemark.runtime import checkpoint_dir

    folder = f"file://{tmp_path}"
    rng = random.Random(12)
    _write(spark, folder, [(i, _prose(rng, 80), "en") for i in range(12)], [(0, _prose(rng, 20))])
    scratch = checkpoint_dir(spark).removeprefix("file://") + "/tidemark"
    before = set(os.listdir(scratch)) if os.path.exists(scratch) else set()
    assert corpus_pipeline.run(spark, folder).count() >= 12
    left = set(os.listdir(scratch)) - before
    assert len(left) == 1 and next(iter(left)).startswith("stage-packed")


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}"
    _write(spark, folder, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
