"""Hard negatives, mixtures and resampling: SQL over whole tables, plain versions beside them, awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same
from pyspark.sql import functions as F

from lectern.llm import hardneg, mixture, queries, resample
from lectern.llm._ranks import cell_starts, step

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_mixture", "op13_resample"])
def test_whole_tables_equal_sql(spark, name):
    for sf in ("sf0.001", "sf0.01"):
        same(spark, queries.QUERIES[name], queries.ORACLES[name], f"/root/testdata/{sf}")


# places over all rows


@given(st.lists(st.integers(-(2**40), 2**40), min_size=2, max_size=60), st.sampled_from([2, 5, 12]))
@settings(max_examples=5, deadline=None)
def test_steps_keep_the_order(spark, values, bits):
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").withColumn("s", step(F.col("v"), bits)).collect()
    rows.sort(key=lambda r: r.v)
    assert [r.s for r in rows] == sorted(r.s for r in rows) and all((a.s == b.s) <= (a.v == b.v or abs(a.v) >= 2**bits) for a, b in zip(rows, rows[1:], strict=False))


def test_starts_of_cells(spark):
    deal = random.Random(3)
    rows = [(deal.choice("ab"), deal.randrange(-500, 500), deal.randrange(1, 4)) for _ in range(400)]
    for bits in ((), (3,), (2, 4)):
        got = {(r.g, r.cell): r.before for r in cell_starts(spark.createDataFrame(rows, "g string, cell bigint, n bigint"), ["g"], "cell", "n", bits).collect()}
        assert got == {(g, c): sum(n for h, d, n in rows if h == g and d < c) for g, c, _ in rows}
    flat = cell_starts(spark.createDataFrame(rows, "g string, cell bigint, n bigint"), [], "cell", "n", (4,)).collect()
    assert {r.cell: r.before for r in flat} == {c: sum(n for _, d, n in rows if d < c) for _, c, _ in rows}


# hard negatives

VEC = "vec_id bigint, label int, embedding array<double>, score int, rank string"


def plain_negatives(rows, k=5, positives=5, every=100):
    """By definition, with whole numbers of any size."""
    seen = sorted({(i, lab, tuple(math.floor(x * 256) for x in v)) for i, lab, v in rows})
    out = []
    for a in (r for r in seen if r[0] % every == 0):
        scored = sorted(((-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in seen if r != a), key=lambda s: s[:2])
        for neg, pid, _ in [s for s in scored if s[2] == a[1]][:positives]:
            p = -neg
            fit = [(-n, i) for n, i, lab in scored if lab != a[1] and 80 * p <= 100 * -n <= 100 * p][:k]
            out += [(a[0], pid, r, i, p, s) for r, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, lab, v, 1, "x") for i, lab, v in rows], VEC).repartition(5)


def mined(df, **more):
    return sorted(tuple(r) for r in hardneg.mine(df, **more).collect())


@pytest.mark.parametrize("block", [37, 1000])
def test_negatives_by_definition(spark, block):
    deal = random.Random(block)
    rows = [(i * 10, 0 if i % 3 else deal.randrange(4), [deal.choice([0.0, 0.25, 0.5, -0.5, deal.gauss(0, 1)]) for _ in range(6)]) for i in range(300)]  # many ties, a label of two thirds
    rows += rows[:7] + [(50, 3, [0.5] * 6), (100, 1, [9.0] * 6)]  # repeated rows, ids with several rows
    want = plain_negatives(rows)
    assert mined(table(spark, rows), block=block) == want and len(want) > 50


def test_scores_of_large_components_are_exact(spark):
    deal = random.Random(5)
    top = hardneg.largest(4) / 256
    rows = [(i, i % 2, [deal.uniform(0.5, 1) * top for _ in range(4)]) for i in range(40)]
    assert mined(table(spark, rows), every=10) == plain_negatives(rows, every=10) != []
    assert mined(table(spark, [*rows, (100, 0, [top * 2, 0.0, 0.0, 0.0])]), every=10) == plain_negatives(rows, every=10)  # too large to take part


def test_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(100, 1, [1.0, 0.0]), (1, 1, [0.9, 0.0]), (2, 2, [0.8, 0.0]), (3, 2, [0.85, 0.1])]
    bad = [(4, None, [1.0, 0.0]), (5, 2, None), (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, [None, 1.0]), (None, 2, [0.85, 0.0]), (9, 2, [1.0]), (10, 2, [])]
    assert mined(table(spark, good + bad)) == plain_negatives(good) == [(100, 1, 1, 3, 230 * 256, 217 * 256), (100, 1, 2, 2, 230 * 256, 204 * 256)]
    assert mined(table(spark, [])) == [] and mined(table(spark, bad)) == [] and mined(table(spark, [(100, 1, [1.0])])) == []
    assert hardneg.mine(table(spark, [])).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


# mixtures


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        now = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if now[s] > most * sizes[s]}
        if not over:
            return {**{s: most * sizes[s] for s in capped}, **now}
        capped |= over


@given(st.dictionaries(st.one_of(st.none(), st.text(alphabet="abé\U0001f642", max_size=3)), st.integers(0, 10**6), min_size=1, max_size=9))
@settings(max_examples=12, deadline=None)
def test_targets_as_by_sharing_again(spark, sizes):
    got = mixture.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"))
    want = plain_targets(sizes)
    assert {r.source: r.target for r in got.collect()} == pytest.approx({s: float(t) for s, t in want.items()})


def test_a_mix_is_near_its_targets_and_agrees_with_itself(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = (sorted(map(tuple, mixture.mix(d).select("doc_id", "nth", "size", "copies", "taken").collect())) for d in (docs, docs.repartition(13)))
    assert one == two
    by = {}
    for r in mixture.mix(docs).collect():
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        t = by.setdefault(r.source, [0, 0, r.target, r.source_size, 0])
        t[0], t[1], t[4] = t[0] + r.taken, max(t[1], r.size), t[4] + r.size
    assert all(abs(taken - target) <= 1.5 * largest and own == size for taken, largest, target, size, own in by.values())
    assert any(target < 3 * size for _, _, target, size, _ in by.values())
    assert queries.QUERIES["op12_mixture"](spark, SF)._jdf.queryExecution().toString().count("Python") == 0


def test_a_mix_of_awkward_rows(spark, awkward, empty):
    got = mixture.mix(awkward)
    assert got.count() == awkward.count() and empty.count() == 0 == mixture.mix(empty).count()
    rows = got.collect()
    assert [r.size for r in rows if r.doc_id in (2, 3, 5)] == [0, 0, 0] and sorted(r.nth for r in rows if r.doc_id == 1) == [1, 2]
    assert {r.source for r in rows} == {"s", None} and all(r.target <= 3 * r.source_size for r in rows)
    out = mixture.emitted(awkward, got)
    assert out.columns == awkward.columns and out.count() == sum(r.copies for r in rows)
    many = spark.range(9000).select(F.lit(1).alias("doc_id"), F.lit("a b").alias("text"), F.lit("x").alias("source")).unionByName(spark.range(10).select("id", F.lit("c").alias("text"), F.lit("y").alias("source")).toDF("doc_id", "text", "source"))
    mixed = mixture.mix(many)  # one row nine thousand times
    assert mixed.count() == 9010 and abs(mixed.filter("source = 'x'").agg(F.sum("taken")).first()[0] - mixed.filter("source = 'x'").first().target) <= 4
    none = mixture.mix(spark.createDataFrame([(1, None, "x"), (2, "", "y")], "doc_id bigint, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in none] == [(0, 0.0, 0)] * 2


# resampling

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, order):
    words = WORDS.findall((text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    return len(words), [b" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aZ09 -é\U0001f642\n", max_size=30), st.text(alphabet="abé", min_size=60, max_size=300)), max_size=6)


@given(TEXTS, st.integers(1, 4), st.sampled_from([7, 64, 1 << 20]))
@settings(max_examples=300, deadline=None)
def test_crcs_of_features_are_those_of_their_strings(texts, order, piece):
    was, resample._PIECE = resample._PIECE, piece
    try:
        words, doc, crc = resample.feature_crcs(pa.array(texts, pa.string()), order)
    finally:
        resample._PIECE = was
    want = [plain_features(t, order) for t in texts]
    assert words.tolist() == [w for w, _ in want]
    assert [sorted(crc[doc == i].tolist()) for i in range(len(texts))] == [sorted(map(zlib.crc32, f)) for _, f in want]


def test_crcs_of_slices_and_long_words():
    texts = pa.array(["x", "a" * 3_000_000 + " b", None, "", "z" * 65])
    words, doc, crc = resample.feature_crcs(texts.slice(1), 2)
    assert words.tolist() == [2, 0, 0, 1] and crc.tolist() == [zlib.crc32(x) for x in (b"a" * 3_000_000, b"b", b"z" * 65, b"a" * 3_000_000 + b" b")] and doc.tolist() == [0, 0, 3, 0]
    a, b = b"one", b"and another"
    assert resample.joined(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([zlib.crc32(b)], dtype=np.uint32), np.array([len(b)]))[0] == zlib.crc32(a + b)


@pytest.mark.parametrize("order", [1, 3])
def test_draws_by_definition(spark, order):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.doc_id: plain_features(r.text, order) for r in docs.collect()}
    s, t = [0] * 1000, [0] * 1000
    for _, f in texts.values():
        for x in f:
            s[zlib.crc32(x) % 1000] += 1
    for r in target.collect():
        for x in plain_features(r.text, order)[1]:
            t[zlib.crc32(x) % 1000] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 1000) / ((a + 1) * (sum(t) + 1000)))) for a, b in zip(s, t, strict=True)]
    want = {}
    for i, (n, f) in texts.items():
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[zlib.crc32(x) % 1000] for x in f)
        want[i] = (len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n)
    eligible = sorted((-v[2], i) for i, v in want.items() if v[3] >= 20)
    rank = {i: r for r, (_, i) in enumerate(eligible[: len(eligible) * 10 // 100], 1)}
    got = resample.resample(docs, target, order=order, buckets=1000).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in got} == {i: (*v[:3], rank.get(i)) for i, v in want.items()}
    assert len(got) == len(want) and len(rank) > 50


def test_draws_of_awkward_rows(spark, awkward, empty):
    target = spark.createDataFrame([("the cat",), (None,)], "text string")
    got = resample.resample(awkward, target, least=1, share=50).collect()
    assert len(got) == awkward.count() and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert {(r.n_features, r.weight) for r in got if r.doc_id in (2, 3, 5)} == {(0, 0)} and all(r["rank"] is None for r in got if r.n_features == 0)
    twice = [(r.n_features, r.weight, r.score) for r in got if r.doc_id == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert resample.resample(empty, target).collect() == [] and resample.resample(awkward, empty.select("text")).count() == awkward.count()
    assert [r["rank"] for r in resample.resample(awkward, target, least=10**9).collect()] == [None] * awkward.count()
