import random

import numpy as np
from helpers import docs, messy
from pyspark.sql import functions as F

from tidemark.llm.langid import Lattice, LanguageModel, Memo, document_languages, expected_uses, identify, train, words_of
from tidemark.llm.vocabulary import vocabulary_path

SAMPLES = {
    "en": "the and of to in is that it was for on with as his they be at one have this from or had by".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero".split(),
}


def brute(word, table, index, unknown):
    """All segmentations, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for j in range(1, len(word) + 1):
        piece = index.get(word[:j], unknown if j == 1 else None)
        if piece is not None:
            total += table[piece] * brute(word[j:], table, index, unknown)
    return total


def test_forward_and_expected_by_enumeration():
    pieces = ["a", "b", "ab", "ba", "aba", "c"]
    lattice, index = Lattice(pieces), {p: i for i, p in enumerate(pieces)}
    rng = np.random.default_rng(1)
    table = rng.random((8, 2)) / 4
    table[-1] = 0
    words = ["abab", "baca", "xaba", "cccc"]
    got = lattice.forward(words, table)
    for w, row in zip(words, got, strict=True):
        for k in range(2):
            assert abs(row[k] - brute(w, table[:, k], index, lattice.unknown)) < 1e-12
    language, weight = np.asarray([0, 1, 0, 1]), np.asarray([1.0, 2.0, 3.0, 4.0])
    keys, uses, likelihood = lattice.expected(words, language, weight, table)
    assert abs(likelihood - sum(w * np.log(row[k]) for w, k, row in zip(weight, language, got, strict=True))) < 1e-9
    sums = np.bincount(keys, weights=uses, minlength=16)
    # Moving one log probability moves the log-likelihood by the expected uses.
    for key in range(12):
        bumped = table.copy().reshape(-1)
        bumped[key] *= 1 + 1e-6
        change = sum(w * (np.log(a[k]) - np.log(b[k])) for w, k, a, b in zip(weight, language, lattice.forward(words, bumped.reshape(table.shape)), got, strict=True))
        assert abs(change / np.log1p(1e-6) - sums[key]) < 1e-4


def test_crowded_slots_are_found():
    pieces = sorted({f"{i:x}" for i in range(30_000)})
    lattice = Lattice(pieces)
    lattice.SLOT_BITS = 20
    for word in ("7abc", "1f2e", "00ff"):
        found = {(i, j): pieces[int(ids[0])] for i, j, rows, ids in lattice.spans([word]) if len(rows)}
        assert found == {(i, j): word[i:j] for i in range(4) for j in range(i + 1, 5) if word[i:j] in set(pieces)}


def test_long_words_are_summed_whole():
    """The rescaled sums of one word equal those of many words at a time, also beyond the length that those take."""
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "c"]
    lattice, rng = Lattice(pieces), random.Random(2)
    table = np.random.default_rng(1).random((len(pieces) + 2, 2)) / 4
    table[-1] = 0
    for n in (1, 2, 5, 20):
        word = "▁" + "".join(rng.choices("abcx", k=n))
        assert np.allclose(np.exp(lattice.log_forward(word, table)), lattice.forward([word], table)[0])
        keys, uses, _ = lattice.expected([word], np.asarray([1]), np.asarray([3.0]), table)
        long_keys, long_uses, likelihood = lattice.long_expected(word, 1, 3.0, table)
        assert np.allclose(np.bincount(keys, weights=uses, minlength=18), np.bincount(long_keys, weights=long_uses, minlength=18))
        assert abs(likelihood - 3 * lattice.log_forward(word, table)[1]) < 1e-9
    word = "ab" * 2000
    # One character more multiplies the sum by about the same factor everywhere: no cut, no underflow.
    assert np.all(np.isfinite(lattice.log_forward("▁" + word, table)))
    sums, _ = expected_uses(lattice, [(0, word, 1)], table)
    lengths = np.asarray([len(x) for x in pieces] + [1, 0])
    assert abs((sums.reshape(table.shape)[:, 0] * lengths).sum() - len(word) - 1) < 1e-6


def test_prediction_by_enumeration():
    """The language of the largest product of all words' sums and the prior, each sum by enumerating the segmentations."""
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "c"]
    index = {p: i for i, p in enumerate(pieces)}
    rng, draw = random.Random(4), np.random.default_rng(4)
    table = draw.random((len(pieces) + 2, 3)) / 4
    table[-1] = 0
    prior = np.asarray([0.5, 0.3, 0.2])
    model = LanguageModel(["x", "y", "z"], pieces, table, np.log(prior))
    texts = [" ".join("".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    for text, (language, score) in zip(texts, model.predict(texts), strict=True):
        odds = prior.copy()
        for word in words_of(text):
            odds *= [brute("▁" + word, table[:, k], index, len(pieces)) for k in range(3)]
        assert language == "xyz"[int(odds.argmax())] and abs(score - odds.max() / odds.sum()) < 1e-4


def test_memo_is_bounded(monkeypatch):
    model = LanguageModel(["x", "y"], ["a", "b", "ab"], np.full((5, 2), 0.2), np.zeros(2))
    texts = [" ".join("".join(random.Random(i).choices("ab", k=12)) for _ in range(5)) for i in range(200)]
    want = list(model.predict(texts))
    monkeypatch.setattr("tidemark.llm.langid.MEMO_BYTES", 2000)
    monkeypatch.setattr("tidemark.llm.langid.PIECE_CHARS", 100)
    other = LanguageModel(model.languages, model.pieces, model.table, model.log_prior)
    memo = Memo(other)
    assert [x for i in range(0, 200, 10) for x in other._predict(texts[i : i + 10], memo)] == want
    assert memo.size <= 2000 and len(memo.known) < 20


def test_ties_go_to_the_first_language():
    model = LanguageModel(["x", "y"], ["a", "b"], np.full((4, 2), 0.25), np.log([0.5, 0.5]))
    assert list(model.predict(["ab ba"])) == [("x", 0.5)]


def test_words():
    assert words_of("Ab,  cD") == ["ab", "cd"]
    assert words_of("x" * 60 + " a\0b") == ["x" * 60, "a\0b"]


def _rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(SAMPLES[lang], k=30)), lang) for i, lang in enumerate(rng.choices(list(SAMPLES), k=150))]
    rows += [(200, None, "en"), (201, "12 34 !!", "en"), (202, "", None), (203, "the and of to", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_held_out_accuracy(spark):
    frame = _rows(spark)
    got = document_languages(frame, vocabulary_path("piece_bpe_32k.model")).join(frame, "doc_id").collect()
    assert len(got) == 154
    tested = [r for r in got if r["held_out"] and r["doc_id"] < 200]
    assert len(tested) > 20 and all(r["lang_pred"] == r["lang"] for r in tested)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (200, 201, 202)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)


def test_prediction_sees_the_text_only(spark):
    model = train(_rows(spark), vocabulary_path("piece_bpe_32k.model"))
    frame = spark.createDataFrame([(1, "der die und", "en"), (2, "der die und", "es")], "doc_id long, text string, lang string")
    got = identify(frame, model).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("de", got[0]["score"])}


def test_messy(spark):
    model = train(_rows(spark), vocabulary_path("piece_bpe_32k.model"))
    assert identify(messy(spark).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit("x")), model).filter("lang_pred <> 'x'").count() == 9
    assert identify(docs(spark, []), model).count() == 0
    none = train(spark.createDataFrame([], "doc_id long, text string, lang string"), vocabulary_path("piece_bpe_32k.model"))
    assert [r["lang_pred"] for r in identify(docs(spark, [(1, "the")]), none).collect()] == ["und"]
