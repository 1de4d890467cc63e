"""Searches and fits that SQL cannot say, against plain numpy and plain Python over whole tables."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import answers as A
from lectern.operators import corpus as C
from lectern.operators import retrieval as R
from lectern.plans import retrieval as P
from lectern.plans.catalogue import QUERIES
from lectern.plans.stored import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def books(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    return v["vec_id"].to_numpy(), v["label"].to_numpy(), np.stack(v["embedding"].tolist()).astype(np.float64)


@pytest.fixture(scope="module")
def profiles(spark):
    rows = stored(spark, SF, "centroids").orderBy("book_id", "ix").collect()
    return np.array([r.book_id for r in rows]), np.array([r.direction for r in rows]), {r.book_id: r.built_from for r in rows}


def test_profiles_fit_all_vectors_of_a_book(spark, books, profiles):
    _, label, x = books
    of, c, built = profiles
    objective = {r.book_id: r.objective for r in QUERIES["kmeans_objective"](spark, SF).collect()}
    shown = {}
    for r in QUERIES["kmeans_centroids"](spark, SF).collect():
        shown.setdefault(r.book_id, set()).add(tuple(r.direction))
    rng = np.random.default_rng(0)
    for b in np.unique(label):
        mine, near = x[label == b], c[of == b]
        assert built[b] == len(mine) and len(near) == min(16, len(mine))
        best = (mine @ near.T).max(axis=1).sum()
        assert objective[b] == pytest.approx(best, abs=1e-5)
        assert len(shown[b]) == len(near)
        if len(mine) > 16:
            assert best >= max((mine @ mine[rng.permutation(len(mine))[:16]].T).max(axis=1).sum() for _ in range(20)) - 1e-9
            dealt = (mine @ near.T).argmax(axis=1)  # each direction is that of the sum of its rows
            for j in np.unique(dealt):
                total = mine[dealt == j].sum(axis=0)
                assert near[j] @ total / np.linalg.norm(total) > 0.99


def test_routed_search_equals_plain(spark, books, profiles):
    ids, label, x = books
    of, c, _ = profiles
    q = x[ids == 0][0]
    score = {b: (c[of == b] @ q).max() for b in np.unique(of)}
    best = sorted(score, key=lambda b: (-score[b], b))[:3]
    assert [(r.book_id, r.score) for r in QUERIES["route_best_centroid"](spark, SF).collect()] == [(b, pytest.approx(score[b], abs=1e-6)) for b in best]
    inside = np.isin(label, best)
    order = np.lexsort((ids[inside], -(x[inside] @ q)))[: P.K]
    got = QUERIES["two_stage_search"](spark, SF)
    assert [r.chunk_id for r in got.collect()] == ids[inside][order].tolist()
    assert "bucket" in got._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_routing_recall_equals_plain(spark, books, profiles):
    ids, label, x = books
    of, c, _ = profiles
    got = {r.query_id: (r.kept, r.kept_flat_top) for r in QUERIES["routing_recall"](spark, SF).collect()}
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    for i in got:
        q = x[ids == i][0]
        score = {b: (c[of == b] @ q).max() for b in np.unique(of)}
        routed = sorted(score, key=lambda b: (-score[b], b))[:5]
        top = label[np.lexsort((ids, -(x @ q)))[0]]
        assert got[i] == (int(label[ids == i][0] in routed), int(top in routed))


def test_passes_over_a_large_book_equal_the_fit_in_one_task(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sums, totals, best = R._tally(x, x[None, :5])
    cos = x @ x[:5].T
    for j in range(5):
        mine = cos.argmax(axis=1) == j
        assert np.allclose(sums[0, j], x[mine].sum(axis=0)) and totals[0, j] == pytest.approx(cos[mine, j].sum())
    assert np.allclose(best, cos.max(axis=1))
    turned = R._turned(x[None, :2].copy(), np.stack([np.zeros(6), 2 * x[7]])[None], x[9:10])
    assert np.allclose(turned[0], [x[9], x[7]])


def test_phrases_by_places(spark):
    c = spark.createDataFrame([(1, "a b a b a"), (2, "b a"), (3, "a x b"), (4, "Á b"), (5, None), (6, "")], "chunk_id bigint, text string")
    index = R.postings(c)
    assert {(r.chunk_id, r.f, r.len) for r in R.phrase_places(index, ["a", "b"]).collect()} == {(1, 2.0, 5), (4, 1.0, 2)}
    assert {(r.chunk_id, r.f) for r in R.phrase_places(index, ["a", "b", "a"]).collect()} == {(1, 2.0)}
    assert R.phrase_places(index, ["a", "zz"]).count() == 0
    asked = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "a"]), (3, ["zz", "a"]), (4, ["x"])], "query_id int, terms array<string>")
    assert {tuple(r) for r in R.phrases_many(index, asked).select("query_id", "chunk_id", "f").collect()} == {(1, 1, 2.0), (2, 1, 2.0), (2, 2, 1.0), (4, 3, 1.0)}
    size = R.size_of(R.lengths(c.filter("text is not null")))
    assert size[0] == 5 and R.bm25_indexed(index, size, ["zz"]).count() == 0


def test_indexed_scores_equal_those_of_a_pass_over_the_texts(spark):
    c = P.chunks(spark, SF)
    index, sizes = R.postings(c), R.lengths(c)
    for terms in (["the", "ering"], ["the", "the", "on"]):
        one = {r.chunk_id: r.score for r in R.bm25_indexed(index, R.size_of(sizes), terms).collect()}
        other = {r.chunk_id: r.score for r in R.bm25(c, [[t] for t in terms]).collect()}
        assert one == pytest.approx(other)
        asked = spark.createDataFrame([(7, terms)], "query_id int, terms array<string>")
        many = {r.chunk_id: r.score for r in R.bm25_many(index, sizes, asked, 1 << 20).collect()}
        assert many == pytest.approx(other)


def test_postings_in_blocks_are_the_postings(spark, monkeypatch):
    odd = [(1, None), (2, ""), (3, " .;!"), (4, "İstanbul É e\u0301e ΣΑΣ 漢字 ½ x²y _a_b"), (5, "a a b a"), (6, "b\u0000a")]
    c = P.chunks(spark, SF).select("chunk_id", "text").union(spark.createDataFrame([(-i, t) for i, t in odd], "chunk_id bigint, text string"))
    names = ["term", "chunk_id", "tf", "len", "at"]
    rows = lambda d: sorted((r.term, r.chunk_id, r.tf, r.len, tuple(r.at)) for r in d.select(*names).collect())
    held = R.postings_in_blocks(c)
    plain = rows(R.postings(c))
    assert rows(R.opened(held)) == plain and rows(R.of_terms(held, ["the", "a", ""])) == [r for r in plain if r[0] in ("the", "a")]
    assert held.count() < len(plain) / 2  # a row for a term and block, not for a term and chunk
    assert sorted(map(tuple, R.lengths_of(held).collect())) == sorted(map(tuple, R.lengths(c).select("chunk_id", "len").collect()))
    assert sorted(map(tuple, R.terms_of(held).collect())) == sorted(map(tuple, R.terms_of(R.postings(c)).collect()))
    made = R._block(*[pa.array(x) for x in ([7, 8, 9], ["b", "a", "b", "a"])], np.array([3, 0, 1]), pa.array([True, False, True]))
    assert [r for b in made for r in b.to_pylist()] == [
        {"term": "", "chunk_ids": [7, 8, 9], "lens": [3, None, 1], "starts": [], "at": []},
        {"term": "b", "chunk_ids": [7], "lens": [3], "starts": [0], "at": [0, 2]},
        {"term": "a", "chunk_ids": [7, 9], "lens": [3, 1], "starts": [0, 1], "at": [1, 0]},
    ]
    few = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a b", "a", None])], ["chunk_id", "text"])
    monkeypatch.setattr(R, "BLOCK_WORDS", 2)
    assert [r["chunk_ids"] for b in R._in_blocks(iter([few.slice(0, 1), few.slice(1, 2)])) for r in b.to_pylist() if r["term"] == "a"] == [[1], [2]]
    assert not [r for b in R._in_blocks(iter([few.slice(2, 1)])) for r in b.to_pylist() if r["term"]]  # no words at all


def test_many_questions_and_beginnings_of_words_through_blocks(spark):
    c = P.chunks(spark, SF)
    held, plain, sizes = R.postings_in_blocks(c), R.postings(c), R.lengths(c)
    asked = spark.createDataFrame([(7, ["the", "ering"]), (8, ["on"])], "query_id int, terms array<string>")
    many = lambda i: {(r.query_id, r.chunk_id, r["rank"]): r.score for r in R.bm25_many(i, sizes, asked, 9).collect()}
    assert many(held) == pytest.approx(many(plain))
    begins = spark.createDataFrame([(1, "ering"), (2, "the")], "query_id int, prefix string")
    found = lambda i: sorted(map(tuple, R.chunks_of_prefixes(R.terms_of(i), i, begins, 3).collect()))
    assert found(held) == found(plain) != []
    assert {r.chunk_id: r.f for r in R.phrase_places(held, ["the", "ering"]).collect()} == {r.chunk_id: r.f for r in R.phrase_places(plain, ["the", "ering"]).collect()}
    assert R.bm25_indexed(held, R.size_of(sizes), ["zz zz"]).count() == 0


def test_hits_of_one_question_need_no_index(spark, monkeypatch):
    def never(*_):
        raise AssertionError("an index was built")

    was = {name: sorted(map(tuple, QUERIES[name](spark, SF).collect())) for name in ("near_dup_greedy", "rerank_stub_order", "shingles_jaccard_pairs")}
    monkeypatch.setattr(P, "stored", never)
    assert all(sorted(map(tuple, QUERIES[name](spark, SF).collect())) == rows != [] for name, rows in was.items())


def test_folding_takes_marks_off_latin_letters(spark):
    got = spark.createDataFrame([("Ếà ŝ ñ Ọ é Ø й Ž",)], "t string").select(X.tokens(F.col("t"))).first()[0]
    assert got == ["ea", "s", "n", "o", "e", "ø", "й", "z"]


def _words(text):
    return re.findall("[a-z0-9]+", text.lower())


def test_greedy_suppression_of_whole_hits(spark):
    hits = P.found_texts(spark, SF).orderBy("rank").collect()
    assert len(hits) == P.K
    kept = []
    for h in hits:
        if h.text is None:
            kept.append((h.chunk_id, set()))
            continue
        w = _words(h.text)
        s = set(zip(w, w[1:], w[2:], strict=False))
        if all(len(s & o) / max(1, len(s | o)) < 0.10 for _, o in kept):
            kept.append((h.chunk_id, s))
    assert {r.chunk_id for r in QUERIES["near_dup_greedy"](spark, SF).collect()} == {i for i, _ in kept}
    three = spark.createDataFrame([(i, i, f"{i} {i + 1} {i + 2} {i + 3}") for i in range(6)] + [(9, 9, None)], "rank int, chunk_id bigint, text string")
    assert [r.chunk_id for r in R.drop_near(three, k=2).orderBy("rank").collect()] == [0, 2]


def test_chunk_queries_cover_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for name in ("chunk_spans", "chunk_spans_utf8"):
        rows = QUERIES[name](spark, SF).collect()
        assert rows
    windows = {}
    for r in QUERIES["reading_windows"](spark, SF).collect():
        windows.setdefault(r.book_id, []).append((r.offset, r.text))
    for i, t in texts.items():
        spans = C.chunk_spans((t or "").encode(), 600)
        assert len(windows.get(i, [])) == len(spans)
        assert all((t or "").encode()[o : o + len(w.encode())].decode() == w for o, w in windows.get(i, []))


def test_claims_of_whole_turns(spark):
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = {(r.conv_id, r.turn): r.quote for r in QUERIES["find_claims"](spark, SF).filter("quoted").collect()}
    for key, t in turns.items():
        said = re.sub('["“”\n]', " ", t).strip()
        if len(said) >= 2 and key in got:
            assert got[key] == said
    assert len(got) > 0.9 * len(turns)
    assert A.find_claims('He said "one two" [1].') == [("one two", 1, True)]


def plain_extract(text, terms, limit=700):
    """By definition: every run of sentences in turn."""
    import re

    if not terms or len(text) <= limit:
        return text[:limit], False, len(text) > limit
    parts = [p for p in re.findall(r"[^.!?]*[.!?]+\s*|[^.!?]+$", text) if p.strip()] or [text]
    runs = [(i, j) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1) if j == i + 1 or len("".join(parts[i:j])) <= limit]
    best, held = None, -1
    for i, j in runs:
        hits = sum(t in p.lower() for p in parts[i:j] for t in terms)
        if hits > held or (hits == held and j - i > best[1] - best[0] + 1):
            best, held = (i, j), hits
    return "".join(parts[best[0] : best[1]]).strip(), best[0] > 0, best[1] < len(parts)


def test_extracts_of_whole_turns(spark):
    from lectern.functions import text as X
    from lectern.plans.catalogue import QUERIES

    c = spark.read.parquet(f"{SF}/conversations.parquet")
    first = {r.conv_id: r.terms for r in c.filter("turn = 0").groupBy("conv_id").agg(F.min("text").alias("text")).select("conv_id", X.marked_terms(F.col("text")).alias("terms")).collect()}
    texts = {(r.conv_id, r.turn): r.text for r in c.collect() if r.conv_id in first}
    got = {(r.conv_id, r.turn): (r.extract, r.cut_before, r.cut_after) for r in QUERIES["best_extracts"](spark, SF).collect()}
    assert got == {k: plain_extract(t, first[k[0]]) for k, t in texts.items()}
    from lectern.operators import answers as A

    long = "Short one. " * 90 + "The wanted words stand here. " + "Then more. " * 90
    assert A.best_extract(long, ["wanted", "words"]) == plain_extract(long, ["wanted", "words"]) and "wanted" in A.best_extract(long, ["wanted"])[0]
    assert A.best_extract(long, []) == (long[:700], False, True) and A.best_extract(None, ["x"]) == ("", False, False)
    endless = "x" * 900 + ". End."
    assert A.best_extract(endless, ["x"], 100) == plain_extract(endless, ["x"], 100)


def test_batches_of_questions_keep_ties_and_skip_nulls(spark):
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(40, 8)), 6, axis=0)  # every vector six times
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "chunk_id bigint, embedding array<double>").repartition(7)
    asked = spark.createDataFrame([(f"q{i}", x[6 * i].tolist()) for i in range(9)] + [("none", None)], "query_id string, query array<double>")
    expected = {}
    for i in range(9):
        score = [sum(a * b for a, b in zip(v, x[6 * i], strict=True)) for v in x]
        expected[f"q{i}"] = sorted(range(len(x)), key=lambda n: (-round(score[n], 9), n))[:8]
    for limit, digits in ((4096, None), (4, None), (4096, 9)):
        got = R.flat_many(rows, asked, 8, limit, digits).orderBy("query_id", "rank").collect()
        assert {q: [g.chunk_id for g in got if g.query_id == q] for q in expected} == expected and len(got) == 72
    assert R.flat_many(rows, asked.limit(0), 8).collect() == [] and R.flat_many(rows.limit(0), asked, 8).collect() == []


def test_word_lengths_as_by_definition(spark):
    texts = [" lead  12 a1 b22 ....  x.y  é\u00a0z \t\n" + "word " * 60 + "w" * n for n in (1, 3, 40)] + ["", "   ", None, "too few words"]

    def p90(text):
        words = [w for w in re.split(r"[ \t\n\r\x0b\x0c]+", text or "") if 0 < sum(c.isalpha() for c in w) and 2 * sum(c.isalpha() for c in w) >= len(w)]
        return sorted(map(len, words))[int(len(words) * 0.9)] if len(words) >= 50 else None

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select(C.word_p90(F.col("text"))).collect()
    assert [g[0] for g in got] == [p90(t) for t in texts]


def test_postings_of_awkward_texts(spark):
    rows = [(1, "b a b  A"), (2, ""), (3, None), (4, "..."), (5, "zz")]
    got = R.postings(spark.createDataFrame(rows, "chunk_id bigint, text string")).collect()
    assert sorted((g.term, g.chunk_id, g.tf, g.len, g.at) for g in got) == [("a", 1, 2, 4, [1, 3]), ("b", 1, 2, 4, [0, 2]), ("zz", 5, 1, 1, [0])]


def test_phrases_of_many_texts_make_no_rows_for_each_pair(spark):
    c = spark.createDataFrame([(i, "p q r") for i in range(40)] + [(50, "a b a b a"), (51, "x p q"), (52, "r p"), (53, None), (54, ""), (55, "Á b á")], "chunk_id bigint, text string")
    asked = spark.createDataFrame([(i, ["p", "q", "r"]) for i in range(40)] + [(50, ["a", "b", "a"]), (51, ["q", "r", "p"]), (52, ["p", "q"])], "query_id bigint, terms array<string>")
    got = {tuple(r) for r in R.phrases_in(c, asked, 3).collect()}
    assert got == {("p q r", i, 3, 1.0) for i in range(40)} | {("a b a", 50, 5, 2.0), ("a b a", 55, 3, 1.0)}
    assert R.phrases_in(c, asked.limit(0), 3).count() == 0


def test_fused_words_read_the_texts_once(spark):
    for name in ("rrf_fuse", "rrf_weighted"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "text:string" not in plan  # what the one pass counted is read, twice, instead


def test_runs_and_words_are_counted_as_spelled(spark):
    rows = {1: "a b a b a", 2: "b a", 3: "ab b", 4: "", 5: None}
    c = spark.createDataFrame(list(rows.items()), "chunk_id bigint, text string")
    got = {r.chunk_id: (r.len, r.f) for r in R.units(c, [["a"], ["a", "b", "a"], ["b"]]).collect()}
    assert got == {1: (5, [3, 2, 2]), 2: (2, [1, 0, 1]), 3: (2, [0, 0, 1]), 4: (0, [0, 0, 0]), 5: (0, [0, 0, 0])}


def test_many_questions_shuffle_their_best_only(spark):
    c = spark.createDataFrame([(i, "p q " * (1 + i % 5) + f"r{i % 3}") for i in range(300)] + [(900, None), (901, "")], "chunk_id bigint, text string")
    index, sizes = R.postings(c), R.lengths(c.filter("text is not null"))
    asked = spark.createDataFrame([(q, ["p", "q", "q", f"r{q % 4}"]) for q in range(9)], "query_id bigint, terms array<string>")
    everything = R.bm25_many(index, sizes, asked, 1 << 20)
    assert everything.count() == 9 * 300
    want = {(r.query_id, r.chunk_id, r["rank"]) for r in everything.filter("rank <= 4").collect()}
    for limits in ({}, {"limit_queries": 2}, {"limit_terms": 5}):
        got = R.bm25_many(index, sizes, asked, 4, **limits)
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in got.collect()} == want
    plan = R.bm25_many(index, sizes, asked, 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and not re.search(r"hashpartitioning\(query_id#\d+L, chunk_id", plan)
    assert R.bm25_many(index, sizes, asked.limit(0), 4).count() == 0
