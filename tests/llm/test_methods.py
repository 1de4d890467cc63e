"""What the methods promise: plain patterns and naive versions beside them, starts that know nothing, repeated ids."""

import hashlib
import math
import random
import re
import string
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import ann, chat, decontam, langid, packing, pii, ppm, queries, secrets, simhash, toxicity
from lectern.llm._common import by_size

SF = "/root/testdata/sf0.01"


def docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def plain_pii(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(((k, *m.span()) for k, m in found), key=lambda s: (s[1], pii.KINDS.index(s[0])))


def plain_secrets(text):
    words = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = [("assign", m) for m in re.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(((k, *m.span()) for k, m in found), key=lambda s: (s[1], secrets.KINDS.index(s[0])))


PIECES = ["+", "1", "4111 1111 1111 1111", "5", "-", " ", "(", ")", ".", "@", "a", "b.c", "10.0.0.1", "+49 (30) 123456", "555-0100", "é", "x@y.z", "%"]
KEYS = ["password", "Token", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGHIJKLMN", "0123456789abcdef", "deadbeef", "x", "/", "_", "Z9", "\n", "é", "token"]


@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_personal_data_by_plain_patterns(text):
    assert pii.base_spans(text) == plain_pii(text)


@given(st.lists(st.sampled_from(KEYS), max_size=14).map("".join))
@settings(max_examples=400, deadline=None)
def test_secrets_by_plain_patterns(text):
    assert secrets.base_spans(text) == plain_secrets(text)
    assert {s[:3] for s in secrets.spans_of(text) if not s[3]} == set(plain_secrets(text))


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op1_pii", plain_pii, pii.KINDS), ("op5_secrets", plain_secrets, secrets.KINDS)])
def test_digest_columns_by_plain_patterns(spark, name, plain, kinds):
    text = {r.doc_id: r.text or "" for r in docs(spark).collect()}
    for r in queries.QUERIES[name](spark, SF).collect():
        want = plain(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(w[0] == k for w in want) for k in kinds]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_ordinary_identifiers_are_no_secrets():
    r = random.Random(4)
    h = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    for _ in range(300):
        u = str(uuid.UUID(int=r.getrandbits(128)))
        for s in (u, u.upper(), f"user-{u}", f"v1/items/{u}/edit", f"objects/{h(2)}/{h(14)}", f"main.{h(8)}.chunk.js", f"2024-10-{r.randint(10, 28)}T10-11-12.123456Z", str(r.randint(10**15, 10**19)), "_" * 30):
            assert not [x for x in secrets.spans_of(f"see {s} there") if x[3]], s
        token = "ghp_" + "".join(r.choices(string.ascii_letters, k=36))
        assert ("github", 4, 44, True) in secrets.spans_of(f"see {token} there")


# partial matching by definition


def naive_score(train, text, order=ppm.ORDER):
    table = defaultdict(Counter)
    for t in train:
        padded = [0xFE] * order + [*t, 0xFF]
        for i in range(order, len(padded)):
            for k in range(order + 1):
                table[tuple(padded[i - k : i])][padded[i]] += 1
    total, padded = 0.0, [0xFE] * order + [*text, 0xFF]
    for i in range(order, len(padded)):
        excluded = set()
        for k in range(order, -1, -1):
            followers = table.get(tuple(padded[i - k : i]), {})
            left = {c: n for c, n in followers.items() if c not in excluded}
            whole = sum(left.values()) + len(left)
            if padded[i] in left:
                total += math.log10(left[padded[i]] / whole)
                break
            if left:
                total += math.log10(len(left) / whole)
            excluded |= followers.keys()
        else:
            total -= math.log10(256 - len(excluded))
    return total


def test_partial_matching_by_definition(spark):
    r = random.Random(8)
    rows = [(i, "".join(r.choices("ab cé", k=r.randint(0, 40)))) for i in range(40)] + [(90, None), (91, "zebra"), (92, "abcab " * 30)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    for head_bits in (2, ppm.NODE_BITS):
        for x in ppm.score_documents(d, head_bits=head_bits).collect():
            assert math.isclose(x.score, naive_score(train, (dict(rows)[x.doc_id] or "").encode()), rel_tol=1e-9), x


# starts that know nothing


def test_training_earns_the_toxicity_scores(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    d = docs(spark, "/root/testdata/sf0.1")
    rows = toxicity.sample(d, labels, "doc_id", "text", "toxic", 5, toxicity.SAMPLE)
    held = d.join(labels, "doc_id").filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 and toxic is not null").select("text", "toxic").collect()
    y = np.array([r.toxic for r in held])

    def balanced(epochs):
        p = toxicity.fit(rows, epochs).scores([r.text for r in held]) >= 0.5
        return (p[y == 1].mean() + 1 - p[y == 0].mean()) / 2

    assert balanced(0) < 0.7 and balanced(toxicity.EPOCHS) > 0.9


def test_a_text_too_long_to_learn_from_costs_no_other_its_place(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 100)
    monkeypatch.setattr(toxicity, "SAMPLE_TEXT", 50)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5][:12]
    first = [r.i for r in spark.createDataFrame([(i,) for i in ids], "i bigint").orderBy(F.xxhash64("i")).collect()]
    d = spark.createDataFrame([(i, "long " * 30 if i in first[:3] else f"text {i:04d}") for i in ids], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id bigint, toxic int")
    got = toxicity.sample(d, labels, "doc_id", "text", "toxic", 5, 100)
    assert sorted(t for t, _ in got) == sorted(f"text {i:04d}" for i in first[3:])


def test_toxicity_is_learned_from_every_labelled_row_in_shards(spark, monkeypatch):
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5]
    said = lambda i: ("vile" if i % 9 == 0 else "kind") + f" word{i % 7} thing{i % 11} end"
    late = max((i for i in ids if i % 9 == 0), key=lambda i: zlib.crc32(b"x%d" % i))
    d = spark.createDataFrame([(i, said(i) + (" long" * 900 if i == late else "")) for i in ids], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in ids], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_TEXT", 50)
    monkeypatch.setattr(toxicity, "SAMPLE", 1)
    assert toxicity.labelled(d, labels, "doc_id", "text", "toxic", 5).count() == len(ids)  # with the long one
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 200)
    net = toxicity.fit_all(d, labels)
    new = [said(i) for i in range(900, 1100)]
    assert ((net.scores(new) >= 0.5) == [i % 9 == 0 for i in range(900, 1100)]).mean() > 0.97
    again = toxicity.fit_all(d, labels)
    assert (again.weights == net.weights).all() and (again.shift == net.shift).all()


def test_only_short_candidates_are_remembered():
    long = "aB3" * 20_000
    before = secrets._remembered.cache_info().currsize
    assert secrets.score(long) == secrets._score(long) and secrets._remembered.cache_info().currsize == before
    assert secrets.score(long[:60]) == secrets._score(long[:60]) == secrets._remembered(long[:60])


def test_every_language_is_learned(spark):
    words = {f"l{n}": "".join(chr(0x4E00 + 40 * n + k) for k in range(12)) for n in range(60)}
    d = spark.createDataFrame([(100 * n + i, text, lang) for n, (lang, text) in enumerate(words.items()) for i in range(5)], "doc_id bigint, text string, lang string")
    assert langid.fitted(d).languages == sorted(words)


def test_long_texts_are_counted_whole():
    text = "der Hund und die Katze " * 30_000
    whole, letters = langid.counts(text)
    part, n = langid.counts("der Hund und die Katze " * 100)
    assert letters == 300 * n and abs(whole.sum() - 300 * part.sum()) < 1000


# packing


def test_long_texts_have_the_ids_of_the_library():
    import public_tokenizers

    w = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))
    r = random.Random(7)
    word = lambda signs: "".join(r.choices(signs, k=r.randint(1, 9)))
    texts = [" ".join(word("abcdeé1.,") for _ in range(120_000)), " ".join(word("abc'12中ñ ") for _ in range(120_000)), "short", ""]
    assert w.encode(texts) == w._packed(texts)


@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=20), st.integers(1, 60))
def test_runs_of_texts_hold_each_once(texts, most):
    parts = list(by_size(texts, most))
    assert [t for p in parts for t in texts[p]] == texts and all(p.start < p.stop for p in parts)


# simhash


def test_keep_one_goes_by_component_and_not_by_id(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "lorem ipsum dolor sit amet consectetur", None, ""]
    rows = [(5, texts[0], "a"), (5, texts[1], "b"), (6, texts[0], "c"), (7, texts[1], "d"), (None, texts[2], "e"), (None, texts[2], "f"), (8, texts[3], "g"), (9, texts[4], "h"), (5, texts[0], "a")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, row_number string")
    got = sorted((tuple(r) for r in simhash.keep_one(d).collect()), key=repr)
    assert [r for r in got if r[0] is not None] == [(5, texts[0], "a"), (5, texts[1], "b"), (8, None, "g")]
    assert [r[1] for r in got if r[0] is None] == [texts[2]] and simhash.keep_one(d.limit(0)).count() == 0


def test_large_groups_are_dealt_anew(spark):
    r = random.Random(6)
    base, fps = r.getrandbits(64), set()
    while len(fps) < 1500:  # a dense cloud around one fingerprint
        f = base
        for _ in range(r.randint(0, 4)):
            f ^= 1 << r.randrange(64)
        fps.add(f)
    d = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp bigint")
    classes = lambda most: {x.fp: x.root for x in simhash.rooted_by(d, most).collect()}
    assert classes(20) == classes(10**6)
    one = simhash.pruning(d).first()
    x = np.array(sorted(fps), dtype=np.uint64)
    near = (np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, 1)).sum()
    assert one.near >= near and one.pairs > one.discarded > 0.5 * one.pairs


@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=40, unique=True), st.integers(0, 5))
@settings(max_examples=100, deadline=None)
def test_classes_as_by_all_pairs(fps, bits):
    fps = sorted({f & ~((1 << 58) - 1) | (f & ((1 << bits) - 1)) for f in fps})
    x = np.array(fps, dtype=np.uint64)
    first, (pairs, discarded, near) = simhash.near_classes(x, np.zeros(len(x), dtype=np.int64))
    close = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([root[close[i]].min() for i in range(len(x))])
    assert len({(a, b) for a, b in zip(first.tolist(), root.tolist(), strict=True)}) == len(set(first.tolist())) == len(set(root.tolist()))
    assert near == np.triu(close, 1).sum() and pairs == len(x) * (len(x) - 1) // 2 and near <= pairs - discarded


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choices(["one", "TWO", "three", "four", "a"], k=5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 7)
    assert simhash.fingerprint(text) == whole


# awkward rows


def test_chat_of_awkward_rows(spark):
    rows = [(1, 0, "user", "hi", "x"), (1, 1, "assistant", None, "y"), (1, 1, "assistant", None, "y"), (None, None, None, None, None), (2, 0, "assistant", "a" * 300_000, "z")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in queries.chat_digest(chat.format_conversations(d)).collect()}
    assert got[1].n_turns == 3 and got[2].loss_chars == 300_000 and got[None].n_turns == 1
    assert queries.chat_digest(chat.format_conversations(d.limit(0))).count() == 0


def test_neighbours_of_repeated_rows_and_extra_columns(spark):
    rows = [(0, [1.0, 0.0], "a")] * 2000 + [(i, [1.0, i / 100], "b") for i in range(1, 50)] + [(40, [0.0, 1.0], "c")]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, code string")
    got = ann.nearest(d, candidates=16, queries=2)
    assert {r.query_id: r.n for r in got.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {0: 20, 20: 20, 40: 20}
    assert [r.vec_id for r in got.filter("query_id = 0").orderBy("rank").collect()] == list(range(1, 21))


def test_repeated_items_count_once(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps")] * 500 + [(2, "the quick brown fox jumps")], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "see the quick brown fox jumps", 3)], "doc_id bigint, text string, edits int")
    assert sorted((r.doc_id, r.item_id) for r in decontam.matches(d, bench, block_chars=30).collect()) == [(1, 1), (1, 2)]
