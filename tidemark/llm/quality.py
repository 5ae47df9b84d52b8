"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every fault is seen by several rules from different sides, so that they can confirm or outvote each other. Each rule looks at per-document counts and votes good (1), bad (-1) or abstains (0). The votes of all
documents that pass the base rules are counted by vote vector (at most 3^rules rows, whatever the number of documents). EM runs
over those counts on the driver and estimates, for each rule, the accuracy of its votes on good and on bad
documents, and the share of good documents. A document's quality is the posterior probability of
good given its votes, computed as a sum of log odds inside the plan. No rule has a veto: a bad vote of a rule that often
votes bad on documents which all others find good is outvoted. A rule that is no better than chance has no weight.

Defined cases: a null or empty text has no words and fails the base rules; if no rule votes, the
posterior is the prior; an empty table leaves the starting accuracies; repeated rows each get a result;
other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import materialize

SPACE = r"[\x20\x09-\x0D]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_chars", "n_ends", "n_upper")
START_GOOD, START_BAD = 0.99, 0.3  # prior mean accuracies: rules are mostly right on good documents, and miss most faults
PSEUDO = 0.001  # weight of those means, as a share of the documents (of one at least)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text, each word once.

    The windows' hashes are sorted with their places; equal neighbours are repeats. This is n log n in one
    row's own memory: nothing is exploded or shuffled.
    """

    def marked(w: Column) -> Column:
        last = F.size(w) - 3
        hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.when(last < 0, F.lit(0)).otherwise(F.transform(F.array(F.sort_array(hashed)), covered)[0])

    def covered(s: Column) -> Column:
        same = lambda x, i, d: F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False))
        repeats = F.filter(s, lambda x, i: same(x, i, 1) | same(x, i, -1))
        return F.size(F.array_distinct(F.flatten(F.transform(repeats, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.transform(F.array(words), marked)[0]


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    only = lambda keep: F.length(F.regexp_replace(body, keep, "")).cast("long")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = df.drop(*COUNTS).withColumns({"__words": _words(body), "__lines": lines})
    return counted.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": only(r"[^#*$%&|<>]+"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("__words")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_letters": only(r"[^\p{L}]+"),
            "n_chars": F.length(body).cast("long"),
            "n_ends": only(r"[^.!?]+"),
            "n_upper": only(r"[^\p{Lu}]+"),
        }
    ).drop("__words", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """Votes from the counts. All divisions are by at least 1."""
    words, lines, chars, in_words = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "n_chars", "word_chars"))
    mean_word = F.col("word_chars") / words
    return {
        "word_size": _vote((mean_word >= 3) & (mean_word <= 10), (mean_word < 2) | (mean_word > 14)),
        "symbols": _vote(F.col("n_symbols") / words <= 0.02, F.col("n_symbols") / words > 0.1),
        "dup_lines": _vote(F.col("n_dup_lines") / lines <= 0.1, F.col("n_dup_lines") / lines > 0.3),
        "repeats": _vote(F.col("n_repeat_words") / words <= 0.1, F.col("n_repeat_words") / words > 0.3),
        "letters": _vote(F.col("n_letters") / chars >= 0.75, F.col("n_letters") / chars < 0.6),
        "spelt": _vote(F.col("n_letters") / in_words >= 0.9, F.col("n_letters") / in_words < 0.8),
        "sentences": _vote((F.col("n_ends") / words >= 0.01) & (F.col("n_ends") / words <= 0.4), ((F.col("n_words") >= 50) & (F.col("n_ends") == 0)) | (F.col("n_ends") / words > 0.8)),
        "capitals": _vote(F.col("n_upper") / F.greatest("n_letters", F.lit(1)) <= 0.2, F.col("n_upper") / F.greatest("n_letters", F.lit(1)) > 0.5),
    }


@dataclass(frozen=True)
class LabelModel:
    """``prior`` of good; per rule the accuracy of its votes on good and on bad documents."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log odds that a good vote and a bad vote of each rule add."""
        return [(log(g / (1 - b)), log((1 - g) / b)) if g + b > 1 else (0.0, 0.0) for g, b in zip(self.on_good, self.on_bad, strict=True)]

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return log(self.prior / (1 - self.prior)) + sum(w[0] if v > 0 else w[1] for v, w in zip(votes, self.weights(), strict=True) if v)

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(log(self.prior / (1 - self.prior)))
        for vote, (good, bad) in zip(votes, self.weights(), strict=True):
            odds = odds + F.when(vote > 0, good).when(vote < 0, bad).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 500, settled: float = 1e-9) -> LabelModel:
    """EM over counted vote vectors, from the start that a document with any bad vote is probably bad, until no belief
    moves by more than ``settled``. The accuracies have a weak prior, which scales with the documents; nothing else bounds them."""
    total = sum(n for _, n in patterns)
    model = LabelModel(0.9, (START_GOOD,) * n_rules, (START_BAD,) * n_rules)
    belief = [0.05 if min(votes, default=0) < 0 else 0.95 for votes, _ in patterns]
    for _ in range(rounds if total else 0):
        pseudo = max(1.0, PSEUDO * total)
        good = sum(n * p for (_, n), p in zip(patterns, belief, strict=True))
        on_good, on_bad = [], []
        for i in range(n_rules):
            cast = [(votes[i], n, p) for (votes, n), p in zip(patterns, belief, strict=True) if votes[i]]
            right_good, all_good = sum(n * p for v, n, p in cast if v > 0), sum(n * p for _, n, p in cast)
            right_bad, all_bad = sum(n * (1 - p) for v, n, p in cast if v < 0), sum(n * (1 - p) for _, n, p in cast)
            on_good.append((right_good + pseudo * START_GOOD) / (all_good + pseudo))
            on_bad.append((right_bad + pseudo * START_BAD) / (all_bad + pseudo))
        model = LabelModel((good + pseudo * 0.9) / (total + pseudo), tuple(on_good), tuple(on_bad))
        old, belief = belief, [1 / (1 + exp(-model.log_odds(votes))) for votes, _ in patterns]
        if max(abs(a - b) for a, b in zip(old, belief, strict=True)) < settled:
            break
    return model


def judge(df: DataFrame, text: str = "text", keep_from: float = 0.5) -> DataFrame:
    """``df`` without its text, with the counts, one vote per rule, ``quality`` and ``kept``."""
    votes = rules()
    counted = materialize(with_counts(df, text).drop(text).withColumns({f"vote_{k}": v for k, v in votes.items()}), "quality-counts")
    names = [f"vote_{k}" for k in votes]
    patterns = [(tuple(r[n] for n in names), r["__n"]) for r in counted.filter(~base_failed()).groupBy(*names).agg(F.count("*").alias("__n")).collect()]
    model = fit(sorted(patterns), len(names))
    failed = base_failed()
    return counted.withColumns({"quality": model.posterior([F.col(n) for n in names]), "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))


def document_quality(docs: DataFrame) -> DataFrame:
    """Contract rows."""
    judged = judge(docs.select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
