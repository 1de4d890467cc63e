"""Operators that SQL cannot express, and their edge cases."""

import json
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import answers as A
from lectern.operators import corpus as C
from lectern.operators import retrieval as R
from lectern.sources import readers
from lectern.streaming import incremental


@given(st.text(max_size=400), st.integers(1, 60), st.integers(0, 10))
@settings(max_examples=300, deadline=None)
def test_chunks_are_ordered_whole_characters_and_lose_nothing(text, target, overlap):
    data = text.encode()
    spans = C.chunk_spans(data, target, min(overlap, target - 1))
    assert all(a <= b for (a, _), (b, _) in zip(spans, spans[1:], strict=False))
    if not overlap or target == 1:
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    for a, n in spans:
        data[a : a + n].decode()
    covered = set()
    for a, n in spans:
        covered.update(range(a, a + n))
    assert all(i in covered or data[i] in C._BLANK for i in range(len(data)))


def test_chunks_prefer_paragraphs():
    data = (b"x" * 30 + b"\n\n") * 4
    assert C.chunk_spans(data, 40) == [(0, 30), (32, 30), (64, 30), (96, 30)]
    assert C.chunk_spans(b"", 10) == [] and C.chunk_spans(b"   \n", 10) == []


def test_a_large_book_is_fitted_on_all_its_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "FIT_ROWS", 40)
    ids = [r.id for r in spark.range(200).orderBy(F.xxhash64("id"), "id").collect()]
    rng = np.random.default_rng(3)

    def near(j):
        x = np.eye(8)[j] + rng.normal(size=8) * 0.05
        return (x / np.linalg.norm(x)).tolist()

    rows = [(1, i, near(0 if at < 40 else 1 + at % 2)) for at, i in enumerate(ids)] + [(2, i, near(i % 3)) for i in range(9)]
    v = spark.createDataFrame(rows, "book_id bigint, chunk_id bigint, embedding array<double>")
    c = R.build_centroids(v, 3)
    assert sorted(int(np.argmax(r.direction)) for r in c.filter("book_id = 1").collect()) == [0, 1, 2]
    assert {(r.book_id, r.built_from) for r in c.collect()} == {(1, 200), (2, 9)}
    assert R.kmeans_objective(v, c).filter("book_id = 1").first().objective > 195


def test_kmeans_is_the_best_of_its_runs():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = R.spherical_kmeans(x, 4)
    assert c.shape == (4, 8) and np.allclose(np.linalg.norm(c, axis=1), 1)
    assert (x @ c.T).max(axis=1).sum() >= (x @ R.spherical_kmeans(x, 4, restarts=1).T).max(axis=1).sum() - 1e-9
    assert np.array_equal(R.spherical_kmeans(x[:3], 4), x[:3])


def test_fusion_ties_go_to_the_earlier_list(spark):
    a = spark.createDataFrame([(11, 0), (12, 1)], "chunk_id bigint, rank int")
    b = spark.createDataFrame([(21, 0), (22, 1)], "chunk_id bigint, rank int")
    assert [r.chunk_id for r in R.fuse([a, b], 4).collect()] == [11, 21, 12, 22]


def test_claims_and_redaction():
    found = A.find_claims('It is "blue" [1]. Or red [2].')
    assert found == [("blue", 1, True), ("Or red", 2, False)]
    assert A.redact_claims('It is "blue" [1]. Or red [2].', found) == f"It is {A.REMOVED}. Or red {A.PARAPHRASE}."
    assert A.find_claims("One. Two [1] and [2].\n“a b”[3] [4]") == [("a b", 3, True), ("Two", 1, False), ("Two [1] and", 2, False), ("“a b”[3]".strip("“”"), 4, False)]
    assert A.find_claims("[1]") == [] and A.find_claims(None) == []
    assert A.parse_expansion("<think>lex: no no</think>lex: two words\nlex: one\nvec: what is it\nvec: What is\nvec: what is it now", "Give two words.") == {"lex": [], "vec": ["what is it"], "hyde": []}
    text, before, after = A.best_extract("Alpha. Beta gamma. Delta.", ["gamma"], 13)
    assert text == "Beta gamma." and before and after


def test_summary_removes_what_it_cannot_prove():
    answer = A.summarise(lambda _: 'True: "b c" [1]. False: "xy" [1].', "q", ["a b c d"]).prose
    assert '"b c" [1]' in answer and A.REMOVED in answer
    assert A.summarise(lambda _: "It holds a “quote” and a ﬁne thing [1].", "q", ['It  holds a "quote" and a fine thing']).prose.endswith("thing [1].")


def test_reading_window_keeps_the_passage_and_ends_with_sentences():
    data = "Cut off here. Önly then the passage stands. And more! Then a rest".encode()
    at = data.index(b"the")
    assert C.reading_window(data, at, 7) == ("Önly then the passage stands. And more!", data.index("Ö".encode()))
    assert C.reading_window(data, at, 7, 0, 0) == ("then th", at)
    assert C.reading_window(b"", 0, 0) == ("", 0)


@given(st.text(max_size=200), st.integers(0, 60), st.integers(0, 60), st.integers(0, 30))
@settings(max_examples=300, deadline=None)
def test_reading_window_offsets_are_those_of_the_text(text, a, n, around):
    data = text.encode()
    start, stop = len(text[:a].encode()), len(text[: a + n].encode())
    window, at = C.reading_window(data, start, stop - start, around, around)
    assert data[at : at + len(window.encode())].decode() == window
    assert text[a : a + n].strip() in window


def test_upper_median_and_rates(spark):
    runs = spark.createDataFrame([(i, 1, 100.0, 100 * i, None) for i in range(1, 5)], "id bigint, model_id bigint, seconds double, embedded bigint, duty double")
    assert C.observed_rate(runs).first().rate == 3.0


def test_files_as_books(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é one".encode())
    (tmp_path / "b.pdf").write_bytes(b"no")
    books = readers.read_books(spark, str(tmp_path))
    assert books.count() == 1 and books.first().size_bytes == 6
    assert readers.found_instead(readers.walk(spark, str(tmp_path))).count() == 2
    (tmp_path / "q.json").write_text(json.dumps([{"q": "a", "a": "b", "kind": "oblique"}, ["c", "d"]]))
    assert {tuple(r) for r in readers.read_questions(spark, str(tmp_path / "q.json")).collect()} == {("a", "b", "oblique"), ("c", "d", "lookup")}


def test_embed_marks_unreadable(spark):
    c = spark.createDataFrame([(1, "x"), (2, None)], "chunk_id bigint, text string")
    rows = {r.chunk_id: r for r in readers.embed(c, lambda ts: [[1.0, 0.0] for _ in ts], 2).collect()}
    assert rows[1].embedding == [1.0, 0.0] and rows[2].embedding == [0.0, 0.0] and rows[2].failed


def test_backup_round_trip(spark, tmp_path):
    readers.backup(spark, {"t": spark.range(3)}, str(tmp_path / "b"))
    assert readers.restore(spark, str(tmp_path / "b"))["t"].count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        readers.backup(spark, {"t": spark.range(3)}, str(tmp_path / "b"))


def test_stream_resumes(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).coalesce(1).write.parquet(src)
    sink = lambda df, _: df.write.mode("append").parquet(out)
    for expected in (5, 8):
        incremental.ingest(spark, src, "id bigint", str(tmp_path / "cp"), sink).awaitTermination()
        assert spark.read.parquet(out).count() == expected
        spark.range(3).coalesce(1).write.mode("append").parquet(src)


def test_scope_patterns(spark):
    d = spark.createDataFrame([("Book One",), ("other",), (None,)], "t string")
    assert d.filter(C.matches("book*", F.col("t"))).count() == 1
    assert d.filter(C.matches("OTH", F.col("t"))).count() == 1
    assert d.filter(C.matches("boo?", F.col("t"))).count() == 0


def test_merge_touching_ranges(spark):
    r = spark.createDataFrame([(1, 3), (3, 5), (7, 9), (8, 12)], "start bigint, stop bigint")
    assert sorted(map(tuple, C.merge_ranges(r).collect())) == [(1, 5), (7, 12)]


def test_chunks_leave_a_worker_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "AT_ONCE", 5000)
    text = "word and word. " * 3000
    d = spark.createDataFrame([(1, text), (2, None), (3, "ü" * 9000), (4, "")], "book_id bigint, text string")
    want = {(b, i, o, n) for b, t in ((1, text), (3, "ü" * 9000)) for i, (o, n) in enumerate(C.chunk_spans(t.encode(), 101))}
    rows = C.chunk(d, 101)
    assert {tuple(r) for r in rows.select("book_id", "ordinal", "byte_offset", "byte_length").collect()} == want
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "5000"


def test_word_lengths_in_parts_are_those_of_the_whole():
    text = "ab  c1 d12 \x0bèé\t12345 \n" * 40 + "x" * 90
    want = [len(w) for w in re.split(r"[ \t\n\x0b\f\r]+", text) if (n := sum(c.isalpha() for c in w)) and n * 2 >= len(w)]
    assert sorted(C._word_sizes(text, 7).tolist()) == sorted(C._word_sizes(text).tolist()) == sorted(want)
    assert C._word_sizes("").size == 0 and C._word_sizes(" \n").size == 0
