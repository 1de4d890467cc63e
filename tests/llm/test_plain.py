"""Models beside plain versions of what they compute, number by number."""

import math
from collections import Counter

import numpy as np
import pytest

from lectern.llm import langid, toxicity

SF = "/root/testdata/sf0.001"


def grams(text):
    """Hashed n-grams of one to three signs: ends of words count, what is no letter is a space."""
    codes = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    one = [c * 0x9E3779B1 & 0xFFFFFFFF for c in codes]
    two = [((one[i] ^ (codes[i + 1] * 0x85EBCA6B & 0xFFFFFFFF)) * 0xC2B2AE35) & 0xFFFFFFFF for i in range(len(codes) - 1)]
    three = [((two[i] ^ (codes[i + 2] * 0x27D4EB2F & 0xFFFFFFFF)) * 0x165667B1) & 0xFFFFFFFF for i in range(len(codes) - 2)]
    letter = [c != 32 for c in codes]
    kept = [h for h, k in zip(one, letter, strict=True) if k] + [h for i, h in enumerate(two) if letter[i] or letter[i + 1]] + [h for i, h in enumerate(three) if letter[i + 1]]
    return Counter(h >> 20 for h in kept), sum(letter)


def test_languages_by_plain_cosines(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.text and r.lang]
    train, asked = rows[:120], [t for t, _ in rows[120:170]] + ["", None, "12 34", "x", "ab" * 200_000]
    model = langid.fit(train)
    counted = [c for c, n in (grams(t) for t, _ in train) if n]
    idf = {b: math.log((1 + len(counted)) / (1 + sum(b in c for c in counted))) + 1 for b in range(langid.BUCKETS)}
    assert model.idf == pytest.approx([idf[b] for b in range(langid.BUCKETS)], rel=1e-5)
    assert all(np.linalg.norm(c) == pytest.approx(1, abs=1e-4) for c in model.centroids) and max(Counter(model.owner.tolist()).values()) > 1
    for text, (lang, score, _) in zip(asked, model.predict(asked), strict=True):
        c, letters = grams(text or "")
        if not letters:
            assert (lang, score) == ("und", 0.0)
            continue
        v = {b: math.sqrt(n) * idf[b] for b, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(centre[b]) for b, x in v.items()) / size for centre in model.centroids]
        assert score == pytest.approx(max(cosines), abs=1e-4)
        assert max(x for x, own in zip(cosines, model.owner, strict=True) if model.languages[own] == lang) == pytest.approx(max(cosines), abs=1e-4)


def test_toxicity_by_a_plain_forward_pass(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [(docs[r.doc_id] or "", r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").orderBy("doc_id").collect() if r.doc_id in docs and r.toxic is not None]
    net = toxicity.fit(rows, epochs=2)
    net.shift += np.arange(len(net.shift)) / 10  # so that it matters which group a text falls in
    asked = [t for t, _ in rows[:40]] + ["", None, "one", "one two", "ß ü ö schön", "? ?"]

    def plain(text):
        words = toxicity.words_of(text)
        vectors = [np.mean([net.table[p] for p in toxicity.pieces(w)], axis=0) for w in words]
        pooled = []
        for n, f in enumerate(net.filters):
            for k in range(toxicity.FILTERS):
                along = [sum(float(f[j, :, k] @ vectors[i + j]) for j in range(len(f))) for i in range(len(words) - len(f) + 1)]
                pooled.append(max(0.0, max(along) + net.bias[n * toxicity.FILTERS + k]) if along else 0.0)
        z = sum(p * o for p, o in zip(pooled, net.out, strict=True)) + net.off[0] - net.shift[toxicity.group_of(text)]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    assert net.scores(asked).tolist() == pytest.approx([plain(t) for t in asked], abs=1e-4)
    assert len(set(np.round(net.scores(asked), 3).tolist())) > 20


def test_features_of_many_words_are_those_of_each():
    words = ["a", "é", "日本語", "straße", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg", "abcdefgh", "ñandúñandú", "𝒜𝒷𝒸𝒹ef", "x" * 300]
    flat, sizes = toxicity.pieces_of(words)
    parts, each = toxicity.Parts(flat, sizes), [sorted(toxicity.pieces(w)) for w in words]
    assert [sorted(parts.of(np.array([i])).tolist()) for i in range(len(words))] == each and sizes.tolist() == list(map(len, each))
    assert sorted(parts.of(np.array([13, 2, 2])).tolist()) == sorted(each[13] + 2 * each[2]) and not len(parts.of(np.zeros(0, dtype=np.int64)))
    assert [len(x) for x in toxicity.pieces_of([])] == [0, 0]
