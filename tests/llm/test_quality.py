import random
import re

import numpy as np
from helpers import docs, messy

from tidemark.llm.quality import PSEUDO, START_BAD, START_GOOD, document_quality, fit, judge, rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + j for v in places.values() if len(v) > 1 for i in v for j in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def test_counts_by_brute_force(spark):
    rng = random.Random(2)
    pieces = ["alpha", "beta", "é", "#", "a|b", "\n", " ", "\t", "  \n", "gamma delta", "\x0b", "<x>"]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randint(0, 120)))) for i in range(150)] + [(150, None), (151, ""), (152, "one two three"), (153, "a b c a b c")]
    for r in document_quality(docs(spark, rows)).collect():
        want = brute(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_em_finds_good_and_bad():
    rng = random.Random(4)
    on_good, on_bad = [0.999, 0.998, 0.999, 0.999], [0.6, 0.3, 0.5, 0.4]
    counts, truth = {}, []
    for _ in range(20_000):
        good = rng.random() < 0.85
        votes = tuple(0 if rng.random() < 0.1 else (1 if rng.random() < (on_good[i] if good else 1 - on_bad[i]) else -1) for i in range(4))
        counts[votes] = counts.get(votes, 0) + 1
        truth.append((votes, good))
    model = fit(sorted(counts.items()), 4)
    right = sum((model.log_odds(v) > 0) == g for v, g in truth)
    assert right / len(truth) > 0.96
    assert all(abs(a - b) < 0.15 for a, b in zip(model.on_bad, on_bad, strict=True))


def test_an_erring_rule_is_outvoted():
    """The last rule condemns a twentieth of the good documents: they stay, where all-must-pass would drop them."""
    rng = random.Random(5)
    counts, truth = {}, []
    for _ in range(20_000):
        good = rng.random() < 0.9
        votes = tuple(1 if rng.random() < (0.999 if good else 0.15) else -1 for _ in range(3)) + (-1 if rng.random() < 0.05 else 1,)
        counts[votes] = counts.get(votes, 0) + 1
        truth.append((votes, good))
    model = fit(sorted(counts.items()), 4)
    kept = [model.log_odds(v) > 0 for v, _ in truth]
    outvoted = [k for k, (v, good) in zip(kept, truth, strict=True) if good and v == (1, 1, 1, -1)]
    assert len(outvoted) > 500 and all(outvoted)
    assert sum(k == good for k, (_, good) in zip(kept, truth, strict=True)) / len(truth) > 0.99
    assert abs(model.on_good[3] - 0.95) < 0.02


def independent_em(votes):
    """EM over a matrix of votes, a row for each document, written with arrays."""
    votes = np.asarray(votes)
    n, pseudo = len(votes), max(1.0, PSEUDO * len(votes))
    belief = np.where((votes < 0).any(axis=1), 0.05, 0.95)
    for _ in range(500):
        prior = (belief.sum() + 0.9 * pseudo) / (n + pseudo)
        good = (((votes > 0) * belief[:, None]).sum(axis=0) + pseudo * START_GOOD) / (((votes != 0) * belief[:, None]).sum(axis=0) + pseudo)
        bad = (((votes < 0) * (1 - belief)[:, None]).sum(axis=0) + pseudo * START_BAD) / (((votes != 0) * (1 - belief)[:, None]).sum(axis=0) + pseudo)
        useful = good + bad > 1
        odds = np.log(prior / (1 - prior)) + ((votes > 0) * useful) @ np.log(good / (1 - bad)) + ((votes < 0) * useful) @ np.log((1 - good) / bad)
        old, belief = belief, 1 / (1 + np.exp(-odds))
        if np.abs(old - belief).max() < 1e-9:
            break
    return belief


def test_kept_by_an_independent_em(spark):
    rng = random.Random(8)
    words = ["the", "river", "runs", "down", "between", "old", "hills", "toward", "a", "quiet", "town", "people", "sell", "bread", "each", "morning", "work", "begins"]

    def prose(n, mark=""):
        return " ".join(rng.choice(words) + (mark if rng.random() < 0.7 else rng.choice(["", "."])) for _ in range(n))

    texts = [prose(rng.randint(60, 200)) for _ in range(80)]
    texts += [prose(150, rng.choice(["***", "#", "|$"])) for _ in range(15)]
    texts += ["\n".join([prose(40)] + [prose(4)] * 5) for _ in range(4)]  # repeated lines alone: prose otherwise
    texts += ["short", prose(60).upper(), "7 4 " * 60]
    got = {r["doc_id"]: r for r in judge(docs(spark, list(enumerate(texts)))).collect()}
    passed = [i for i in range(len(texts)) if not got[i]["base_failed"]]
    names = [f"vote_{k}" for k in rules()]
    belief = independent_em([[got[i][n] for n in names] for i in passed])
    assert np.allclose([got[i]["quality"] for i in passed], belief, atol=1e-6)
    assert {i for i in got if got[i]["kept"]} == {i for i, b in zip(passed, belief, strict=True) if b >= 0.5}
    condemned = [i for i in passed if min(got[i][n] for n in names) < 0]
    assert any(got[i]["kept"] for i in condemned) and not all(got[i]["kept"] for i in condemned)


def test_symbol_soup_goes_and_prose_stays(spark):
    rng = random.Random(6)
    words = ["the", "river", "runs", "down", "between", "old", "hills", "toward", "a", "quiet", "town", "where", "people", "sell", "bread", "each", "morning", "before", "work", "begins"]
    prose = [" ".join(rng.choice(words) for _ in range(120)).replace("town", "town.") for _ in range(60)]
    soup = [" ".join(w + "***" for w in t.split()) for t in prose[:8]]
    rows = list(enumerate(prose + soup))
    got = {r["doc_id"]: r["kept"] for r in document_quality(docs(spark, rows)).collect()}
    assert all(got[i] for i in range(60)) and not any(got[i] for i in range(60, 68))


def test_messy(spark):
    got = judge(messy(spark).selectExpr("*", "'q' AS kept", "3 AS n_words"))
    assert got.count() == 9 and not got.filter("doc_id = 1").first()["kept"]
    assert document_quality(docs(spark, [])).count() == 0
