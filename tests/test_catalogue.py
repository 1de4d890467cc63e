"""Chunkings side by side, progress as ranges, books of several files, vectors of whole numbers, compaction and backups that survive a stop, streams, and searches that are watched and stopped."""

import datetime
import hashlib
import json
import threading
import time

import pytest

from pyspark.sql import functions as F

from lectern import errors as E
from lectern.engine import Engine
from lectern.operators import retrieval as R
from lectern.store import Store
from lectern.streaming import incremental as S

COLUMNS = "key string, title string, shelf string, text string"
pytestmark = pytest.mark.usefixtures("small_plans")
vectors = lambda texts: [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]


def rows(n, extra="", of=1):
    return [(f"s/{i:03}.txt", f"Book {i}", f"shelf{i % 2}", "\n\n".join(f"Paragraph {j} of book {i} about neurons and glia{extra if i == of and j == 0 else ''}." for j in range(12))) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, COLUMNS)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_two_chunkings_at_once(spark, tmp_path):
    fine, wide = (Engine(spark, str(tmp_path / "index"), target=t) for t in (120, 400))
    fine.add(frame(spark, rows(3)))
    fine.embed("small", vectors, 8)
    n = fine.table("chunks").count()
    again = dict(map(tuple, wide.add(frame(spark, rows(3))).collect()))
    assert set(again.values()) == {"rechunked"}
    assert {r.status for r in wide.add(frame(spark, rows(3))).collect()} == {"unchanged"}
    assert fine.table("chunks").count() > n and fine.table("vectors").count() == n
    counts = {r.target: (r.segments, r.chunks) for r in wide.chunkings().collect()}
    assert counts[120] == (3, n) and counts[400][0] == 3 and 0 < counts[400][1] < n and list(counts) == [400, 120]
    with pytest.raises(E.OtherChunking):
        wide.embed("small", vectors, 8)
    with pytest.raises(E.WrongDimension):
        fine.embed("small", vectors, 4)
    assert fine.embed("small", vectors, 8) == 0 and wide.embed("large", vectors, 8) == counts[400][1]
    cover = {r.model: (r.live, r.done, r.coverage) for r in fine.models().collect()}
    assert cover == {"small": (n, n, 1.0), "large": (counts[400][1], counts[400][1], 1.0)}
    for model, target in (("small", 120), ("large", 400)):  # each model's hits are of its own chunking
        hits = fine.ask("neurons and glia", embed_query=vectors, model=model, k=5).collect()
        assert hits and all(h.byte_length <= target + 1 for h in hits) and (target == 120 or max(h.byte_length for h in hits) > 130)
    book = fine.books().first()
    assert sum(book.by_chunking.values()) == book.chunks and set(book.by_model) == {"small", "large"} and book.sources == 1
    # an edit under one chunking makes the other's split of the book stale
    fine.add(frame(spark, [rows(2, " EDIT")[1]]))
    assert {r.target: r.segments for r in fine.chunkings().collect()} == {400: 2, 120: 3}
    assert fine.models().filter("model = 'large'").first().live < counts[400][1]


def test_resuming_reads_no_vectors(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), target=120)
    e.add(frame(spark, rows(4)))
    e.embed("m", vectors, 8, limit=7)
    from lectern.operators import segments as G

    left = G.first_ids(G.pending(e._standing("m")), 10)
    assert {f.split("/index/")[1].split("/")[0] for f in left.inputFiles()} == {"segments", "models", "progress"}
    assert sum(r.n for r in left.collect()) == 10 and min(r.start for r in left.collect()) == 8
    assert [r.chunk_id for r in e.table("vectors").orderBy("chunk_id").collect()] == list(range(1, 8))
    assert e._tasks(100_000) > 1
    done = G.embedded(e._standing("m"))
    assert sum(r.chunk_count for r in done.collect()) == 7
    e.embed("m", vectors, 8, step=5)
    assert e.outstanding("m").first().to_embed == 0 and e.check().first().pending == 0


def test_an_embedding_step_has_many_tasks(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def noting(texts, at=str(seen)):
        import pathlib

        from pyspark import TaskContext

        pathlib.Path(at, str(TaskContext.get().partitionId())).touch()
        return [[float(len(t)), 1.0] for t in texts]

    e = Engine(spark, str(tmp_path / "index"), target=120)
    e.add(frame(spark, rows(4)))
    e.embed("m", noting, 2)
    assert len(list(seen.iterdir())) > 1


def test_an_edit_writes_little(spark, tmp_path):
    import random

    deal = random.Random(2)
    wide = [(f"s/{i:03}.txt", f"Book {i}", "x", "\n\n".join("".join(deal.choices("abcdefghijklmnopqrstuvwxyz     ", k=1000)) for _ in range(12))) for i in range(100)]
    e = Engine(spark, str(tmp_path / "index"), target=1000)
    e.add(frame(spark, wide))
    size = lambda: {t: sum(f.stat().st_size for f in (tmp_path / "index" / t).rglob("*.parquet")) for t in ("chunks", "postings")}
    was, parts = size(), e.store.parts()
    e.add(frame(spark, [(*wide[7][:3], "An EDIT of it. " + wide[7][3])]))
    now = size()
    assert all(set(parts[t]) < set(e.store.parts()[t]) for t in was)
    assert all(now[t] - was[t] < 0.1 * was[t] for t in was) and e.table("chunks").filter("text LIKE '%EDIT%'").count() == 1
    assert e.table("chunks").select("book_id", "byte_offset").distinct().count() == e.table("chunks").count()
    hits = e.ask("EDIT", mode="lexical", k=10).collect()
    assert len(hits) == 1 and "EDIT" in hits[0].text


def test_searching_while_adding(spark, tmp_path, monkeypatch):
    """A search that is noted while an add is under way is no change of the index: both succeed."""
    e = Engine(spark, str(tmp_path / "index"), target=120)
    e.add(frame(spark, rows(2)))
    other, write, asked = Engine(spark, e.store.path, target=120), Store._write, []

    def slow(self, name, df):
        if name == "postings" and not asked:
            asked.append(1)
            asked.append(other.ask("neurons", mode="lexical").count())
        return write(self, name, df)

    monkeypatch.setattr(Store, "_write", slow)
    e.add(frame(spark, rows(4)))
    assert asked == [1, 5] and e.table("books").count() == 4 and e.asked().count() == 1
    monkeypatch.undo()
    e.ask("glia", mode="lexical")
    e.store.tidy()
    assert e.asked().count() == 2 and len(e.store._listed("asked")) == 1


def test_a_search_reads_its_hits_only(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "index"), target=120)
    e.add(frame(spark, rows(4)))
    reads, read = [], Store.read
    monkeypatch.setattr(Store, "read", lambda self, name: reads.append(name) or read(self, name))
    hits = e.ask("paragraph 3", mode="lexical", k=2).collect()
    assert len(hits) == 2 and reads.count("chunks") == 1 and "lengths" not in reads
    ids = [h.chunk_id for h in hits]
    found = e.store.read("chunks").filter(F.col("chunk_id").isin(ids))
    assert "PushedFilters: [In(chunk_id" in plan(found)


def test_measured_by_the_search_itself(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), target=120)
    e.add(frame(spark, rows(6)))
    e.embed("m", vectors, 8)
    e.route()
    whole = e.search("neurons", embed_query=vectors, mode="vector")
    assert whole.scanned_fraction() == 1.0 and whole.read == whole.population == e.table("vectors").count()
    part = e.search("neurons", embed_query=vectors, mode="vector", route=2, scope=("Book*",))
    assert 0 < part.read < part.population and part.read == e.table("vectors").filter(F.col("book_id").isin(list(part.routed))).count()
    e.set_aside(keys=["s/000.txt"])
    assert e.search("neurons", embed_query=vectors, mode="vector").population < whole.population


def test_whole_numbers_take_a_quarter(spark, tmp_path):
    import random

    deal = random.Random(1)
    wide = {}
    e = Engine(spark, str(tmp_path / "index"), target=120)
    e.add(frame(spark, rows(20)))
    for r in e.table("chunks").collect():
        wide[r.text] = [deal.gauss(0, 1) for _ in range(1024)]
    embed = lambda texts: [wide[t] for t in texts]
    e.embed("m", embed, 1024, limit=100)
    on_disk = lambda: sum(f.stat().st_size for p in e.store.parts()["vectors"] for f in (tmp_path / "index" / p).rglob("*.parquet"))
    e.store.replace("vectors", e.store.read("vectors"))
    was = on_disk()
    query = wide[e.table("chunks").filter("chunk_id = 3").first().text]
    before = e.ask("q", embed_query=lambda _: [query], mode="vector", k=5).collect()
    e.quantise("m")
    assert on_disk() < 0.4 * was and e.table("vectors").agg(F.max(F.length("data"))).first()[0] * 4 == 4096 and e.models().first().quantisation == "int8"
    after = e.search("q", embed_query=lambda _: [query], mode="vector", k=5)
    assert after.hits.first().chunk_id == before[0].chunk_id == 3 and after.scanned_fraction() == 1.0
    import numpy as np

    r = e.table("vectors").filter("chunk_id = 3").first()
    kept = np.frombuffer(r.data, dtype=np.int8) * r.scale / 127
    flat = R.flat_packed(e.table("vectors"), query, 1).first()
    assert flat.chunk_id == 3 and flat.score == pytest.approx(float(kept @ np.array(query)))
    assert e.embed("m", embed, 1024) > 0 and e.table("vectors").filter("data IS NULL").count() == 0  # later ones are kept so too
    e.truncate("m", 16)  # questions are cut as well
    assert e.ask("q", embed_query=lambda _: [query], mode="vector", k=1).first().chunk_id == 3
    with pytest.raises(E.WrongDimension):
        e.ask("q", embed_query=lambda _: [query[:3]], mode="vector")


def test_books_of_several_files(spark, tmp_path):
    book = tmp_path / "in" / "saga"
    book.mkdir(parents=True)
    (book / "b.txt").write_text("The second chapter speaks of glia.")
    (book / "a.txt").write_text("The first chapter speaks of neurons.")
    (book / "notes.pdf").write_bytes(b"x")
    e = Engine(spark, str(tmp_path / "index"))
    with pytest.raises(E.NothingToIngest) as none:
        e.add_files(str(tmp_path / "in"), suffixes=("md",))
    assert set(none.value.found) == {"txt", "pdf"}
    assert [r.status for r in e.add_files(str(book), chapters=True).collect()] == ["added"]
    assert e.books().first().title == "saga" and e.books().first().sources == 2
    first, second = e.table("sources").orderBy("ordinal").collect()
    assert first.path.endswith("a.txt") and second.path.endswith("b.txt")
    assert e.pane(e.books().first().key, part=1)["text"] == "The second chapter speaks of glia."
    read = []
    from lectern.sources import readers

    contents = readers.contents
    readers.contents = lambda s, paths: read.extend(paths) or contents(s, paths)
    try:
        assert [r.status for r in e.add_files([str(book), str(book) + "/"], chapters=True).collect()] == ["unchanged"] and read == []
        assert [r.status for r in e.add_files(str(book), chapters=True, deep=True).collect()] == ["unchanged"] and len(read) == 2
        time.sleep(1.1)
        (book / "b.txt").write_text("The second chapter speaks of axons.")
        read.clear()
        assert [r.status for r in e.add_files(str(book), chapters=True).collect()] == ["updated"]
    finally:
        readers.contents = contents
    assert e.ask("axons", mode="lexical").count() == 1 and e.ask("glia", mode="lexical").count() == 0
    assert {r.state for r in e.drift().collect()} == {"intact"} == {r.state for r in e.drift(deep=True).collect()}
    moved = tmp_path / "in" / "tale"
    book.rename(moved)
    assert e.unreadable().count() == 2
    assert [r.status for r in e.add_files(str(moved), chapters=True, whole=True).collect()] == ["moved"]
    assert e.unreadable().count() == 0 and e.books().first().title == "tale" and e.books().count() == 1
    bare = tmp_path / "in" / "README"
    bare.write_text("A file that is named itself.")
    assert [r.status for r in e.add_files(str(bare)).collect()] == ["added"]
    with pytest.raises(E.NothingToIngest):
        e.add_files(str(moved / "notes.pdf"))


def test_compaction_goes_on_after_a_stop(spark, tmp_path):
    made = []
    for name, stops in (("one", 0), ("two", 3)):
        e = Engine(spark, str(tmp_path / name), target=120)
        e.add(frame(spark, rows(8)))
        e.embed("m", vectors, 8)
        e.remove(keys=["s/001.txt", "s/004.txt"])
        n, was = e.table("chunks").count(), {r.text for r in e.table("chunks").collect()}
        for k in range(1, stops + 1):  # each run ends after so many steps
            calls = []
            assert e.compact(stop=lambda k=k, calls=calls: calls.append(1) or len(calls) > 1, at_once=20) == 0
            assert e.store.read("compaction").count() == k + 1 and {r.text for r in e.table("chunks").collect()} == was
            assert e.ask("neurons", mode="lexical").count() == 5  # what is there stays in use
        steps = []
        assert e.compact(stop=lambda steps=steps: steps.append(1) and False, at_once=20) > 0
        made.append((len(steps), e.table("chunks").orderBy("chunk_id").drop("segment_id").collect(), sorted((r.chunk_id, tuple(r.embedding)) for r in e.table("vectors").collect())))
        assert [r.chunk_id for r in made[-1][1]] == list(range(1, n + 1)) and e.store.read("compaction").count() == 0
        assert e.compact() == 0 and e.check().first().dead == 0
        assert e.add(frame(spark, [("s/new", "New", "x", "brand new")])).first().status == "added" and e.table("chunks").agg({"chunk_id": "max"}).first()[0] == n + 1
    assert made[0][0] - made[1][0] == 3 and made[0][1:] == made[1][1:]


def test_compaction_begins_anew_if_the_library_changed(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), target=120)
    e.add(frame(spark, rows(4)))
    e.remove(keys=["s/001.txt"])
    calls = []
    e.compact(stop=lambda: calls.append(1) or len(calls) > 1)
    e.remove(keys=["s/002.txt"])
    n = e.table("chunks").count()
    e.compact()
    assert sorted(r.chunk_id for r in e.store.read("chunks").collect()) == list(range(1, n + 1))


def test_compaction_loses_nothing_that_comes_meanwhile(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), target=120)
    e.add(frame(spark, rows(3)))
    e.remove(keys=["s/001.txt"])
    other = Engine(spark, e.store.path, target=120)
    with pytest.raises(E.Busy):  # the last step but one adds a book
        e.compact(stop=lambda: other.add(frame(spark, [("s/new", "New", "x", "brand new")])) is None)
    assert e.ask("brand new", mode="lexical").count() == 1 and e.compact() > 0 and e.ask("brand new", mode="lexical").count() == 1
    with pytest.raises(E.Busy), e.store.change():  # two that add at once: the second is refused, and may be repeated
        e.add(frame(spark, [("s/one", "One", "x", "one more")]))
        other.add(frame(spark, [("s/two", "Two", "x", "two more")]))
    assert {r.key for r in e.table("books").collect()} == {"s/000.txt", "s/002.txt", "s/new", "s/two"}


def test_damaged_backups_are_named(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), target=120)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("words of a file")
    e.add_files(str(tmp_path / "in"))
    e.embed("m", vectors, 8)
    e.backup(str(tmp_path / "saved"), files=True)
    assert spark.read.parquet(str(tmp_path / "saved" / "files")).first().text == "words of a file"
    old, new = (f"file:{tmp_path}/{x}" for x in ("in", "elsewhere"))
    back = Engine.restore(spark, str(tmp_path / "saved"), str(tmp_path / "two"), moved=(old, new), target=120)
    assert back.status().first() == e.status().first() and back.books().first().key.startswith(new)
    assert [r.path.rsplit("/", 2)[1:] for r in back.unreadable().collect()] == [["elsewhere", "a.txt"]]
    assert back.ask("words", mode="lexical").count() == 1
    lost = sorted((tmp_path / "saved" / "books").glob("*.parquet"))[0]
    hurt = sorted((tmp_path / "saved" / "chunks").glob("*.parquet"))[0]
    lost.unlink()
    hurt.write_bytes(hurt.read_bytes()[:-1] + b"x")
    with pytest.raises(E.Damaged) as damaged:
        Engine.restore(spark, str(tmp_path / "saved"), str(tmp_path / "three"))
    assert damaged.value.missing == [f"books/{lost.name}"] and damaged.value.changed == [f"chunks/{hurt.name}"]


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, minute)


def test_streams_take_each_batch_once_and_late_edits(spark, tmp_path):
    source = tmp_path / "in"
    e = Engine(spark, str(tmp_path / "index"), target=120)

    def arrive(data):
        spark.createDataFrame(data, S.BOOKS).coalesce(1).write.mode("append").parquet(str(source))

    frames = []
    watch = S.Watch(frames.append)
    spark.streams.addListener(watch)
    try:
        arrive([(*r, at(10)) for r in rows(2)])
        go = lambda: S.follow(e, str(source), str(tmp_path / "cp"), embed=lambda x: x.embed("m", vectors, 8), files_per_batch=1).awaitTermination()
        go()
        n = e.table("chunks").count()
        assert e.table("books").count() == 2 and e.outstanding("m").first().to_embed == 0
        commit = e.store.commits()[-1]
        assert not e.take_batch("books", 0, spark.createDataFrame([("s/x", "X", "x", "x", at(50))], S.BOOKS)) and e.store.commits()[-1] == commit
        arrive([(*rows(2, " EDIT")[1], at(30))])
        go()
        run = e.history().first()
        assert run.embedded <= 2 and run.copied >= n // 2 - 2 and e.ask("EDIT", mode="lexical").count() == 1  # vectors of what stayed are copied
        arrive([(*rows(2, " STALE")[1], at(20))])  # written before the edit, come after it
        go()
        assert e.ask("STALE", mode="lexical").count() == 0 and e.ask("EDIT", mode="lexical").count() == 1 and e.store.read("batches").first().batch == 2
        until = time.time() + 20
        while sum(bool(f.get("final")) for f in frames) < 3 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(watch)
    assert sum(bool(f.get("final")) for f in frames) == 3 and [f["rows"] for f in frames if f["stage"] == "batch" and f["rows"]] == [2, 1, 1]


def test_a_search_is_stopped_in_its_reranking(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), target=120)
    e.add(frame(spark, rows(3)))

    def endless(question, texts):
        import time

        time.sleep(600)
        return [0.0 for _ in texts]

    job = e.start("neurons and glia", mode="lexical", rerank=5, score=endless)
    frames = []
    for f in job.frames():
        frames.append(f)
        if f["stage"] == "rerank":
            threading.Timer(1.0, job.cancel).start()
    with pytest.raises(E.Cancelled):
        job.result(60)
    assert [f["stage"] for f in frames] == ["lexical", "fuse", "read", "rerank", "end"] and [f.get("final") for f in frames] == [None] * 4 + [True] and frames[-1]["state"] == "cancelled"
    good = e.start("neurons and glia", mode="lexical", rerank=5, score=lambda q, ts: [1.0 for _ in ts])
    lines = [json.loads(x) for x in good.lines()]
    assert good.result(60).hits.count() == 5 and lines[-1] == {"stage": "end", "state": "done", "final": True, "hits": 5, "ms": lines[-1]["ms"]}
    bad = e.start("neurons", mode="lexical", depth=1)
    with pytest.raises(E.BadOption):
        bad.result(60)
