import hashlib
import random
from collections import defaultdict

from helpers import docs, messy

from pyspark.sql import functions as F

from tidemark.llm.lines import LineRuns, dedup_lines, document_lines

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows):
    held = defaultdict(list)
    for n, (d, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(d)
    out = []
    for d, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if not (len(held[key(x)]) >= 3 and d < max(held[key(x)]))]
        out.append((d, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_brute_force(spark):
    rng = random.Random(3)
    pool = [f"This is line number {i} of the common pool" for i in range(12)] + ["ÉCOLE " * 5, "école " * 5, "  THIS is line number 3 of the common pool\r", "short", "", "\x0bx\x0c"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 8)) + ([f"own line of the document {i}"] if rng.random() < 0.5 else []))) for i in range(80)]
    rows.append((80, None))
    got = sorted(tuple(r) for r in document_lines(docs(spark, rows, 3)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert got == brute(rows)


def test_keeper_and_repeats(spark):
    line = "a line that is long enough to count"
    rows = [(1, line), (2, f"{line}\n{line}"), (3, f"x\n{line}\n{line}\ny")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: "", 2: "", 3: f"x\n{line}\n{line}\ny"}


def _hashes(spark, pairs):
    frame = spark.createDataFrame(pairs, "doc long, line string").distinct()
    return frame.select("doc", F.struct(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).alias("h"), "line")


def test_levels_of_runs(spark):
    """Many batches, largest ids first: levels fill up and are compacted, and the frequent lines are those of all pairs."""
    rng = random.Random(5)
    pairs = [(d, f"line {int(rng.random() ** 3 * 60)}") for d in range(70) for _ in range(8)]
    named = {(r["h1"], r["h2"]): r["line"] for r in _hashes(spark, pairs).select("h.h1", "h.h2", "line").collect()}
    runs, shapes = LineRuns(spark, 3, fanout=2), []
    for batch in range(7):
        runs.add(_hashes(spark, [(d, x) for d, x in pairs if 69 - d in range(10 * batch, 10 * batch + 10)]).select("doc", "h"))
        shapes.append([len(level) for level in runs.levels])
    assert shapes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1], [1, 1, 1]]
    want = defaultdict(set)
    for d, x in pairs:
        want[x].add(d)
    got = {named[r["h1"], r["h2"]]: r["keeper"] for r in runs.frequent().collect()}
    assert got == {x: max(held) for x, held in want.items() if len(held) >= 3}


def test_a_batch_reads_no_rare_line_of_the_runs(spark):
    """The runs grow by lines that are not frequent; what a batch reads of them does not."""
    runs = LineRuns(spark, 3, fanout=3)
    read = []
    for batch in range(8):
        top = 1000 - 100 * batch
        pairs = [(top - i, f"own line {batch} {i}") for i in range(50)] + [(top - i, "common") for i in range(50)]
        if batch:
            plan = runs.known()._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") == plan.count("PartitionFilters: [isnotnull(frequent") == len(runs.paths())
            read.append(runs.known().count())
            assert runs.left_of(_hashes(spark, pairs).select("doc", "h")).count() == 50  # the common line is known already
        runs.add(_hashes(spark, pairs).select("doc", "h"))
    assert set(read) == {1}


def test_messy(spark):
    extra = messy(spark).selectExpr("*", "'z' AS n_lines", "9 AS h1")
    got = dedup_lines(extra)
    assert got.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped"] and got.count() == 9
    assert dedup_lines(docs(spark, [])).count() == 0
    line = "the same line in rows of one document id"
    rows = [(1, line), (1, line + "\nmore"), (1, line), (None, line)]
    got = sorted((r["doc_id"] or 0, r["text"], r["n_dropped"]) for r in dedup_lines(docs(spark, rows)).collect())
    assert got == [(0, "", 1), (1, line, 0), (1, line, 0), (1, line + "\nmore", 0)]
