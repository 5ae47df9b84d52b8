"""Secret scans: fixed patterns, plus strings that a character Markov model finds random.

Two first-order character Markov models are trained from labelled samples, one of random strings and
one of ordinary identifiers. A candidate (a long run of key characters that no base span overlaps) is a
secret if the mean log-likelihood ratio of its transitions is above a threshold that was set on
held-out identifiers for a stated false-positive rate.

The default samples are drawn by a seeded generator: random strings over the usual key alphabets, and
identifiers composed of the words of a public tokenizer's vocabulary (snake, camel, kebab and dotted
forms, paths, dates, versions). ``SAMPLES`` bounds them. Callers may pass their own labelled rows.

Defined cases: a null or empty text has no spans; offsets are code points, ends exclusive; repeated rows
each get their own result; other columns pass through, one named like the result is replaced.
"""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.runtime import ship

KINDS = ("assign", "access", "hex", "markov")
SAMPLES = 20_000  # labelled samples of either class
FALSE_POSITIVES = 1e-4

# "Letters in either case" means A-Z and a-z; IGNORECASE would also admit the long s and the Kelvin sign.
_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


@dataclass(frozen=True)
class MarkovRatio:
    """log P(b | a, random) - log P(b | a, identifier) by transition, and the threshold on its mean."""

    ratio: dict[str, float]
    unseen: float
    threshold: float

    def score(self, text: str) -> float:
        get, unseen = self.ratio.get, self.unseen
        return sum(get(text[i : i + 2], unseen) for i in range(len(text) - 1)) / max(1, len(text) - 1)


def random_strings(rng: random.Random, count: int) -> list[str]:
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [lower + lower.upper() + digits, lower + lower.upper() + digits + "+/", lower + lower.upper() + digits + "-_", lower + digits, lower.upper() + digits]
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 64))) for _ in range(count)]


def identifiers(rng: random.Random, words: list[str], count: int) -> list[str]:
    out = []
    for _ in range(count):
        parts = [rng.choice(words).lower() for _ in range(rng.randint(2, 6))]
        if rng.random() < 0.25:
            parts.append(rng.choice([f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"v{rng.randint(0, 20)}", str(rng.randint(0, 9999))]))
        form = rng.randrange(7)
        out.append(
            "_".join(parts) if form == 0
            else parts[0] + "".join(p.capitalize() for p in parts[1:]) if form == 1
            else "".join(p.capitalize() for p in parts) if form == 2
            else "-".join(parts) if form == 3
            else "/".join(parts) if form == 4
            else "_".join(parts).upper() if form == 5
            else "".join(parts)
        )
    return out


def vocabulary_words(path: str) -> list[str]:
    """Alphabetic ASCII pieces of at least three letters of a public tokenizer's vocabulary, in id order."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    pieces = (p.lstrip("Ġ") for p, _ in sorted(vocabulary.items(), key=lambda kv: kv[1]))
    return list(dict.fromkeys(p.lower() for p in pieces if len(p) >= 3 and p.isascii() and p.isalpha()))


def _transitions(samples: Iterable[str]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for s in samples:
        for i in range(len(s) - 1):
            pair = s[i : i + 2]
            counts[pair] = counts.get(pair, 0) + 1
    return counts


def fit(random_samples: list[str], ordinary_samples: list[str], false_positives: float = FALSE_POSITIVES) -> MarkovRatio:
    """Train on four fifths of the ordinary samples; the rest sets the threshold."""
    symbols = sorted(set("".join(random_samples)) | set("".join(ordinary_samples)))
    held = [s for i, s in enumerate(ordinary_samples) if i % 5 == 0]
    noise, plain = _transitions(random_samples), _transitions(s for i, s in enumerate(ordinary_samples) if i % 5)

    def log_probabilities(counts: dict[str, int]) -> dict[str, float]:
        table = {}
        for a in symbols:
            total = sum(counts.get(a + b, 0) for b in symbols) + 0.5 * len(symbols)
            for b in symbols:
                table[a + b] = math.log((counts.get(a + b, 0) + 0.5) / total)
        return table

    p_noise, p_plain = log_probabilities(noise), log_probabilities(plain)
    model = MarkovRatio({k: p_noise[k] - p_plain[k] for k in p_noise}, 0.0, 0.0)
    scores = sorted((model.score(s) for s in held if len(s) >= 16), reverse=True)
    cut = scores[min(len(scores) - 1, int(false_positives * len(scores)))] if scores else 0.0
    return MarkovRatio(model.ratio, 0.0, max(cut, 0.0) + 0.05)


def default_model(vocabulary: str, seed: int = 7, samples: int = SAMPLES) -> MarkovRatio:
    rng = random.Random(seed)
    return fit(random_strings(rng, samples), identifiers(rng, vocabulary_words(vocabulary), samples))


def scan(text: str | None, model: MarkovRatio) -> list[tuple[str, int, int, float]]:
    """All spans of one text, by start, then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int, float]] = []
    if ":" in text or "=" in text:
        # A failing match still uses up its characters, so the length is tested afterwards.
        found += [("assign", m.start(), m.end(), math.inf) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), math.inf) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), math.inf) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in found)
    at, reached = 0, 0  # both run from left to right: base spans that begin before the candidate's end, and the farthest end of those
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reached = max(reached, base[at][1])
            at += 1
        if reached > m.start():
            continue
        if (score := model.score(m[0])) > model.threshold:
            found.append(("markov", m.start(), m.end(), score))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda x: (x[1], order[x[0]]))


def find_secrets(df: DataFrame, model: MarkovRatio, text: str = "text", result: str = "spans") -> DataFrame:
    """``df`` with an array of (kind, start, end, score) under ``result``; base spans have an infinite score."""
    ship(df.sparkSession)
    kept = df.drop(result)
    schema = T.StructType([*kept.schema.fields, T.StructField(result, SPANS)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in scan(t.as_py(), model)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, arrow)], [*batch.schema.names, result])

    return kept.mapInArrow(run, schema)


def document_secrets(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Contract rows: counts by kind, the digest of the base spans, and all spans as text."""
    found = find_secrets(docs.select("doc_id", "text"), default_model(vocabulary)).drop("text")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        number("markov").alias("n_markov"),
    )
