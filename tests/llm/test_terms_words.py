from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillvec.llm import words as words_module
from quillvec.llm.terms import term_counts, term_mark
from quillvec.llm.words import WordHashes, hash_words, hashed, sequences, words_of

SCHEMA = "doc_id bigint, tokens array<string>, term string, records int"


def brute(rows):
    once = {}
    for doc, tokens in rows:
        if doc is not None and tokens:
            once.setdefault(doc, tokens)
    occurrences, records = Counter(), Counter()
    for tokens in once.values():
        clean = [t.strip().lower() for t in tokens if t is not None and t.strip()]
        occurrences.update(clean)
        records.update(set(clean))
    return {t: (occurrences[t], records[t], len(once)) for t in occurrences}


def counted(spark, rows):
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], SCHEMA)
    return {r.term: (r.occurrences, r.records, r.total_records) for r in term_counts(df).collect()}


def test_counts_dirty_tokens_like_brute_force(spark):
    rows = [(1, ["A ", "a", "\tb ", "", None, "  "]), (1, ["A ", "a", "\tb ", "", None, "  "]), (2, []), (3, None), (None, ["x"]), (4, [" ", ""]), (5, ["É", "é", "straße"])]
    rows += [(i, ["common", f"w{i}", "a"]) for i in range(10, 400)]
    assert counted(spark, rows) == brute(rows)


def test_hot_repeated_row_and_heavy_terms(spark):
    rows = [(7, ["same"] * 50)] * 500 + [(i, ["same", "other"]) for i in range(100, 400)]
    assert counted(spark, rows) == brute(rows)


def test_empty_table_and_marks(spark):
    assert counted(spark, []) == {}
    rows = [(i, ["all"] + (["twice"] if i < 2 else []) + (["five"] if i < 5 else [])) for i in range(40)] + [(99, ["many"] * 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")
    marks = {r.term: r.mark for r in term_counts(df).select("term", term_mark().alias("mark")).collect()}
    assert marks == {"all": "common", "twice": "rare", "five": None, "many": "rare"}


def test_sequences_never_cross_texts():
    texts = [words_of("a b c d"), words_of("b c"), [], words_of("x a b c")]
    h, text, at = sequences(*hashed(texts, WordHashes()), 3)
    assert list(zip(text.tolist(), at.tolist())) == [(0, 0), (0, 1), (3, 0), (3, 1)]
    assert h[0] == h[3] and len(set(h.tolist())) == 3


def test_words():
    assert words_of("Don't stop_2 — naïve ÉTÉ 42!") == ["don", "t", "stop", "2", "naïve", "été", "42"]
    assert words_of(None) == words_of("") == []


def test_hashed_words_are_those_of_the_pattern(monkeypatch):
    texts = ["Don't stop_2 — naïve ÉTÉ 42!", None, "", "  ", "İstanbul ΣΑΣ ΣΑΣ\nⅣ ½ x²", "漢字かな 한국어 ไทย हिन्दी", "a" * 3000, "a b a\x00b퟿", "_x_ y__z", "𝔘𝔫𝔦 😀 ok"] * 3
    flat, offsets = hash_words(texts)
    words = [words_of(t) for t in texts]
    assert np.diff(offsets).tolist() == [len(w) for w in words]
    same, other = {}, {}
    for h, w in zip(flat.tolist(), [w for t in words for w in t], strict=True):
        assert same.setdefault(w, h) == h and other.setdefault(h, w) == w
    monkeypatch.setattr(words_module, "CHARACTERS_AT_ONCE", 7)
    again = hash_words(texts)
    assert (again[0] == flat).all() and (again[1] == offsets).all()
    assert (hashed(words, WordHashes())[0] == flat).all()
    assert hash_words([])[1].tolist() == [0] and hash_words([None])[1].tolist() == [0, 0]


def test_hashes_of_many_words_differ():
    words = [f"{a}{b}" for a in range(700) for b in "abcdefghij" * 30]
    flat, _ = hash_words([" ".join(words)])
    assert len(set(flat.tolist())) == len(set(words))
    anagrams = ["ab ba abc bca cab aab aba baa a aa aaa aaaa"]
    assert len(set(hash_words(anagrams)[0].tolist())) == 12
