"""One library from adding books to asking, edits, upkeep and backup."""

import hashlib

import pytest

from lectern import errors as E
from lectern.engine import Engine

pytestmark = pytest.mark.usefixtures("small_plans")
COLUMNS = "key string, title string, shelf string, text string"


#: A lambda, so that it is sent to workers by value.
vectors = lambda texts: [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]


def rows(n, extra=""):
    return [(f"s/{i}.txt", f"Book {i}", f"shelf{i % 2}", "\n\n".join(f"Paragraph {j} of book {i} about neurons and glia{extra if i == 1 and j == 0 else ''}." for j in range(12))) for i in range(n)]


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"), target=120)
    with pytest.raises(E.NothingIndexed):
        e.ask("x", mode="lexical")
    e.add(spark.createDataFrame([*rows(3), ("s/empty", None, "shelf0", None)], COLUMNS))
    return e


def test_add_edit_move(spark, engine):
    first = engine.table("chunks").orderBy("chunk_id").collect()
    assert [r.chunk_id for r in first] == list(range(1, len(first) + 1))
    assert [(r.book_id, r.ordinal) for r in first] == sorted((r.book_id, r.ordinal) for r in first)
    engine.embed("m", vectors, 8)
    n = engine.table("vectors").count()
    again = [("t/0.txt", *rows(1)[0][1:]), rows(2, " EDIT")[1], rows(3)[2], ("s/new", "New", "x", "brand new")]
    got = dict(map(tuple, engine.add(spark.createDataFrame(again, COLUMNS), whole=True).collect()))
    assert got == {"t/0.txt": "moved", "s/1.txt": "updated", "s/2.txt": "unchanged", "s/new": "added"}
    assert {r.key for r in engine.table("books").collect()} == {"t/0.txt", "s/1.txt", "s/2.txt", "s/new", "s/empty"}
    ids = [r.chunk_id for r in engine.table("chunks").collect()]
    assert len(ids) == len(set(ids)) and min(set(ids) - {r.chunk_id for r in first}) > len(first)
    carried = engine.table("vectors").count() + engine.waiting().count()
    assert n - 2 <= carried < n and engine.waiting().count() > 0
    with pytest.raises(E.CarriesWait):
        engine.compact()
    assert 0 < engine.embed("m", vectors, 8) <= 4 and engine.embed("m", vectors, 8) == 0
    from lectern.operators import retrieval as R

    def same_words():
        kept, anew = engine.table("postings").drop("bucket"), R.postings(engine.table("chunks"), ("segment_id", "book_id"))
        anew = anew.select(*kept.columns)
        words = engine.table("segments").selectExpr("sum(words)").first()[0]
        return kept.count() == anew.count() and kept.exceptAll(anew).count() == 0 and words == R.lengths(engine.table("chunks")).selectExpr("sum(len)").first()[0]

    assert engine.waiting().count() == 0 and same_words()
    assert engine.compact() > 0
    assert same_words()
    ids = sorted(r.chunk_id for r in engine.table("chunks").collect())
    assert ids == list(range(1, len(ids) + 1)) == sorted(r.chunk_id for r in engine.table("vectors").collect())
    texts = {r.chunk_id: r.text for r in engine.table("chunks").collect()}
    for r in engine.table("vectors").collect():
        assert r.embedding == pytest.approx(vectors([texts[r.chunk_id]])[0])


def test_ask(spark, engine):
    hits = engine.ask("Paragraph 7 of book 2", mode="lexical", k=3).collect()
    assert "Paragraph 7 of book 2 " in hits[0].text and hits[0].why == "lex 1" and [h.rank for h in hits] == [1, 2, 3]
    engine.embed("model-one", vectors, 8)
    want = engine.table("chunks").filter("book_id = 2").first()
    hit = engine.ask(want.text, embed_query=vectors, mode="vector", k=1).first()
    assert hit.score > 0 and len(engine.ask(want.text, embed_query=vectors, k=4, dedupe=True).collect()) <= 4
    with pytest.raises(E.NotRouted):
        engine.ask("x y", embed_query=vectors, route=1)
    engine.route()
    routed = engine.ask("x y", embed_query=vectors, mode="vector", route=1, k=50, model="one").collect()
    assert len({r.key for r in routed}) == 1
    best = engine.ask("neurons", embed_query=vectors, rerank=10, score=lambda q, ts: [float("book 1 " in t) for t in ts], k=2)
    assert best.count() == 2
    assert {r.key for r in engine.ask("neurons glia", mode="lexical", scope=("Book 1",), k=5).filter("why <> ''").collect()} >= {"s/1.txt"}
    with pytest.raises(E.ScopeMissed):
        engine.ask("neurons", mode="lexical", scope=("nowhere*",))
    assert engine.set_aside(shelf="shelf1") == 1 and engine.set_aside(keys=["s/1.txt"]) == 0
    assert "s/1.txt" not in {r.key for r in engine.ask("neurons", mode="lexical", k=50).collect()}
    with pytest.raises(E.SetAside):
        engine.ask("neurons", mode="lexical", scope=("Book 1",))
    with pytest.raises(E.BadOption):
        engine.ask("neurons", depth=3)
    with pytest.raises(E.BadOption):
        engine.ask("neurons", mode="lexical", k=0)
    with pytest.raises(E.AmbiguousModel):
        engine.model("two")
    assert engine.ask("?!", mode="lexical").count() == 0
    assert engine.asked("NEURONS").count() >= 2
    engine.forget_questions()
    assert engine.asked().count() == 0


def test_reports_and_upkeep(spark, engine, tmp_path):
    assert tuple(engine.status().select("books", "set_aside", "vectors").first()) == (4, 0, 0)
    assert engine.check().first().step == "embed"
    engine.embed("m", vectors, 8, limit=2)
    assert engine.table("vectors").count() == 2 and engine.models().first().done == 2
    engine.embed("m", vectors, 8)
    assert engine.check().first().step == "route"
    engine.route()
    assert engine.check().first().step == "ask" and engine.models().first().coverage == 1.0
    engine.describe("s/0.txt", label="Zzz", note="n")
    assert engine.books().collect()[-1].label == "Zzz" and engine.shelves().count() == 2
    assert engine.history().count() == 2 and engine.garbled().count() == 0
    engine.relocate("s", "moved")
    with pytest.raises(E.UnknownBook):
        engine.remove(keys=["s/0.txt"])
    assert engine.remove(keys=["moved/0.txt"]) == 1 and engine.books().count() == 3
    engine.backup(str(tmp_path / "saved"))
    back = Engine.restore(spark, str(tmp_path / "saved"), str(tmp_path / "two"))
    assert back.status().first() == engine.status().first()
    with pytest.raises(E.BadOption):
        Engine.restore(spark, str(tmp_path / "saved"), str(tmp_path / "two"))
    engine.drop_model("m")
    with pytest.raises(E.NotEmbedded):
        engine.model()
    engine.store.clear_work()


def test_add_files(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "one.txt").write_bytes(b"alpha \xff beta")
    e = Engine(spark, str(tmp_path / "index"))
    assert [r.status for r in e.add_files(str(tmp_path / "in")).collect()] == ["added"]
    assert [r.status for r in e.add_files(str(tmp_path / "in")).collect()] == ["unchanged"]
    assert e.books().first().title == "one"


def test_add_is_safe_to_repeat(spark, engine, monkeypatch):
    """Each write fails in turn; what was there stays, and after a repeat every span is there once."""
    from lectern.store import Store

    engine.embed("m", vectors, 8)
    was = {t: engine.table(t).count() for t in ("books", "sources", "segments", "chunks", "postings", "vectors", "carries")}
    again = [rows(2, " EDIT")[1], ("s/new", "New", "x", "brand new")]
    write = Store._write
    for n in range(20):
        calls = []

        def failing(self, name, df, n=n, calls=calls):
            calls.append(name)
            if len(calls) > n:
                raise OSError("no space")
            return write(self, name, df)

        monkeypatch.setattr(Store, "_write", failing)
        try:
            engine.add(spark.createDataFrame(again, COLUMNS))
        except OSError:
            assert was == {t: engine.table(t).count() for t in was}
        else:
            break
    monkeypatch.undo()
    assert n >= 4
    spans = [(r.book_id, r.byte_offset) for r in engine.table("chunks").collect()]
    assert len(spans) == len(set(spans)) == engine.table("segments").selectExpr("sum(chunk_count)").first()[0] and engine.table("books").count() == was["books"] + 1
    one = Engine(spark, engine.store.path, target=120)
    with pytest.raises(E.Busy), engine.store.change():  # two writers: the second to end is told so
        engine.store.replace("books", engine.table("books"))
        one.describe("s/0.txt", note="x")
    assert one.table("books").filter("note = 'x'").count() == 1
    with engine.store.change():  # of tables that no other change wrote, both count
        engine.store.replace("centroids", engine.table("centroids"))
        one.describe("s/0.txt", note="y")
    assert engine.table("books").filter("note = 'y'").count() == 1


def test_searches_open_only_their_folders(spark, engine):
    from lectern.operators import retrieval as R

    found = R.of_terms(engine.store.read("postings"), ["neurons"])
    assert found.count() > 0
    files = lambda df: {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    assert len({r.bucket for r in found.select("bucket").distinct().collect()}) == 1 < len(files(engine.store.read("postings")))
    assert "PartitionFilters: [" in found._jdf.queryExecution().toString() and "bucket" in found._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_embed_goes_on_where_it_stopped(spark, engine):
    n = engine.table("chunks").count()
    asked = []
    assert engine.embed("m", vectors, 8, step=4, stop=lambda: len(asked) >= 2 or asked.append(1)) == 8
    assert engine.table("vectors").agg({"chunk_id": "max"}).first()[0] == 8
    row = engine.outstanding("m").first()
    assert (row.live, row.done, row.to_embed, row.complete, row.part_way) == (n, 8, n - 8, 1, 1)
    assert row.at_work == engine.table("chunks").filter("chunk_id = 8").first().book_id
    assert engine.outstanding("m", ("Book 2",)).first().done == 0 and engine.check().first().step == "embed the rest"
    assert engine.embed("m", vectors, 8, seconds=0) == 0 and engine.embed("m", vectors, 8, step=100) == n - 8
    with pytest.raises(E.BadOption):
        engine.embed("m", vectors, 8, duty=0)
    before = {r.chunk_id: r.embedding for r in engine.table("vectors").collect()}
    engine.quantise("m")
    assert engine.table("vectors").filter("embedding IS NOT NULL OR length(data) <> 8").count() == 0
    for r in engine._vectors("m").collect():
        assert r.embedding == pytest.approx(before[r.chunk_id], abs=max(before[r.chunk_id]) / 254 + 1e-6)
    engine.route()
    engine.truncate("m", 4)
    v = engine._vectors("m").first().embedding  # in eight bits still
    assert len(v) == 4 and sum(x * x for x in v) == pytest.approx(1, abs=0.02) and engine.table("centroids").count() == 0
    assert engine.removal(shelf="shelf1").first().books == 1
