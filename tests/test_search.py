"""Searches with other words, warnings, summaries with their proof; names of models and libraries."""

import hashlib
import json

import pytest

from lectern import errors as E
from lectern.engine import Engine
from lectern.operators import answers as A
from lectern.registry import Registry, checked_name
from lectern.sources import models

pytestmark = pytest.mark.usefixtures("small_plans")
vectors = lambda texts: [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:8]] for t in texts]
TEXT = "The first sentence is plain. Neurons é speak by spikes. Glia keep the house in order.\n\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("search") / "index"), target=100)
    books = [(f"s/{i}", f"Book {i}", f"shelf{i % 2}", "".join(TEXT.replace("spikes", f"spikes of kind {i} and {j}") for j in range(5))) for i in range(3)]
    e.add(spark.createDataFrame(books, "key string, title string, shelf string, text string"))
    e.embed("m-one", vectors, 8)
    e.route()
    return e


def test_other_words_are_searched_too(engine):
    one, two = engine.table("chunks").orderBy("chunk_id").limit(2).collect()
    reply = f"lex: some words\nvec: {one.text.splitlines()[0]} zz\nhyde: {two.text.splitlines()[0]}\nvec: lone\n"
    asked = []
    got = engine.search("what do they speak", embed_query=vectors, mode="vector", k=3, expand=lambda q: asked.append(q) or reply)
    alone = engine.search("what do they speak", embed_query=vectors, mode="vector", k=3)
    assert len(asked) == 1 and "what do they speak" in asked[0]
    assert [r.rank for r in got.hits.collect()] == [1, 2, 3] and all(r.why.startswith("vec ") and "·" not in r.why for r in got.hits.collect())
    assert [r.chunk_id for r in got.hits.collect()] != [r.chunk_id for r in alone.hits.collect()]
    same = engine.search("what do they speak", embed_query=vectors, mode="vector", k=3, expand=lambda _: "nothing of use")
    assert [tuple(r)[:3] for r in same.hits.collect()] == [tuple(r)[:3] for r in alone.hits.collect()]


def test_payload_and_warnings(engine):
    whole = json.loads(engine.search("neurons speak", embed_query=vectors, k=2).payload())
    assert (whole["query"], whole["mode"], whole["routed"], whole["reranked"], whole["scanned_fraction"], whole["warnings"]) == ("neurons speak", "hybrid", None, 0, 1.0, [])
    assert [r["rank"] for r in whole["results"]] == [1, 2] and whole["elapsed_ms"] > 0
    routed = json.loads(engine.search("neurons speak", embed_query=vectors, route=1, mode="vector").payload())
    assert routed["routed"] == 1 and 0 < routed["scanned_fraction"] < 0.5
    assert json.loads(engine.search("neurons speak", mode="lexical").payload())["scanned_fraction"] == 0.0
    engine.set_aside(keys=["s/1"])
    try:
        assert engine.search("neurons", mode="lexical", scope=("Book*",)).warnings == ("set aside: Book 1",)
    finally:
        engine.set_aside(keys=["s/1"], excluded=False)
    was = engine.table("centroids")
    engine.store.replace("centroids", was.filter("book_id <> 1"))
    assert engine.search("neurons", embed_query=vectors, mode="vector", route=2).warnings == ("not profiled: Book 0",)
    engine.route()


def test_widened_passages_are_the_books_text(engine):
    hits = engine.ask("glia keep the house", mode="lexical", k=50)
    texts = {f"s/{i}": "".join(TEXT.replace("spikes", f"spikes of kind {i} and {j}") for j in range(5)).encode() for i in range(3)}
    chunks = {r.chunk_id: r for r in engine.table("chunks").collect()}
    passages = engine.widened(hits)
    assert len(passages) == hits.count() > 3 and any(p.at > 0 for p in passages) and any(p.upto < len(p.text) for p in passages)
    for p in passages:
        assert p.found.strip() == chunks[p.chunk_id].text.strip()
        assert texts[p.key][p.byte_offset :].decode().split()[:8] == p.text.split()[:8]
        assert " ".join(p.text.split()) in " ".join(texts[p.key].decode().split())
    assert engine.widened(hits.filter("false")) == []


def test_pane_reads_a_part_of_a_book(engine):
    book = "".join(TEXT.replace("spikes", f"spikes of kind 1 and {j}") for j in range(5)).encode()
    whole = engine.pane("s/1")
    assert whole["size"] == len(book) and whole["text"].split() == book.decode().split() and whole["start"] == 0
    inside = book.index("é".encode()) + 1  # within a character
    part = engine.pane("s/1", inside, 60)
    assert part["start"] == inside + 1 and part["text"].split() == book[inside + 1 : part["end"]].decode().split()
    assert engine.pane("s/1", inside - 20, 20)["end"] == inside - 1 and engine.pane("s/1", 10_000)["text"] == ""
    with pytest.raises(E.UnknownBook):
        engine.pane("nowhere")
    with pytest.raises(E.BadOption):
        engine.pane("s/1", 0, 200_001)


def test_summaries_prove_and_retry(engine):
    said = iter(['They "speak by spikes" [1]. They "sing at night" [1].'])
    good = engine.summarise("how do neurons speak", lambda _: next(said), mode="lexical", k=3)
    assert "speak by spikes" in good.answer.prose and "sing" not in good.answer.prose and good.retried is None
    assert [c.verified for c in good.answer.claims] == [True, False] and not good.answer.trustworthy and good.answer.claims[0].place == "passage"
    said = iter(["what keeps the house in order", '"Glia keep the house in order" [1]'])
    again = engine.summarise("qqq", lambda _: next(said), mode="lexical", k=2)
    assert again.retried == "what keeps the house in order" and again.answer.trustworthy and again.passages
    said = iter([A.REFUSAL, "what keeps the house in order", f"Sorry.\n{A.REFUSAL}"])
    none = engine.summarise("neurons speak", lambda _: next(said), mode="lexical", k=2)
    assert none.answer.refused and none.failed and none.passages == tuple(engine.widened(engine.ask("neurons speak", mode="lexical", k=2)))
    kept = [json.loads(r.record) for r in engine.table("summaries").orderBy("id").collect()]
    assert [bool(r["retried"]) for r in kept] == [False, True, False] and kept[2]["answer"] == A.REFUSAL
    margin = A.checked('"before it" [1] and "inside" [1] and "gone" [2]', ["before it. inside. after"], ["inside."])
    assert [(c.place, c.verified) for c in margin.claims] == [("margin", True), ("passage", True), (None, False)]


def test_evaluation_asks_as_a_reader_would(spark, engine):
    asked = [("what do neurons speak by", "SPIKES of kind 1 and 1", "lookup"), ("glia order", "the house", "lookup"), ("neurons", "dragons", None), ("what is plain", "sentence is pl", "odd")]
    got = engine.evaluate(spark.createDataFrame(asked, "q string, a string, kind string"), mode="lexical", k=50)
    rows = {r.q: (r.kind, r.band, r.at1, r.atk) for r in got.rows.collect()}
    assert rows["neurons"] == ("lookup", "unanswerable", 0, 0) and rows["glia order"][2:] == (1, 1) and rows["what do neurons speak by"][3] == 1 and rows["what is plain"][0] == "odd"
    assert sum(r.questions for r in got.tallies().collect()) == 4 and len(got.took) == 4 and 0 < got.quantile(0.5) <= got.quantile(0.95)


def test_models_are_known_by_name(engine, tmp_path):
    weights = tmp_path / "w.gguf"
    weights.write_bytes(b"weights")
    engine.embed("m-two", vectors, 8, limit=2)
    with pytest.raises(E.AmbiguousModel):
        engine.model()
    engine.know("m-one", alias="uno", preferred=True, path=str(weights))
    engine.know("m-two", alias="due")
    assert (engine.model(), engine.model("due"), engine.model("two"), engine.preferred("embed"), engine.preferred("rerank")) == ("m-one", "m-two", "m-two", "m-one", None)
    engine.know("m-two", preferred=True)
    assert engine.model() == "m-two" and engine.verify_weights() == {"m-one": "same"}
    weights.write_bytes(b"others")
    assert engine.verify_weights() == {"m-one": "changed"}
    weights.unlink()
    assert engine.verify_weights() == {"m-one": "missing"}
    with pytest.raises(E.BadOption):
        engine.know("m-two", alias="uno")
    with pytest.raises(E.BadOption):
        engine.know("x", role="cook")
    engine.drop_model("m-two")
    files = engine.spark.createDataFrame([("d/BGE-base.gguf", None), ("x.gguf", "modern-bert"), ("x.gguf", None), ("qwen.gguf", None)], "file string, family string")
    kinds = [r[0] for r in files.select(models.template(files.file, files.family)).collect()]
    assert [k == models.TEMPLATES["bge"] for k in kinds] == [True, True, False, False]


def test_a_models_prompts_are_used(spark, tmp_path):
    said = tmp_path / "said"
    said.mkdir()

    def embed(texts, at=str(said)):
        import pathlib
        import uuid

        pathlib.Path(at, uuid.uuid4().hex).write_text("\n".join(texts))
        return [[1.0, 0.0] for _ in texts]

    e = Engine(spark, str(tmp_path / "index"))
    e.add(spark.createDataFrame([("k", "t", "s", "words here")], "key string, title string, shelf string, text string"))
    e.know("n", family="nomic-bert", preferred=True)
    e.embed("n", embed, 2)
    e.search("who speaks", embed_query=embed, mode="vector")
    assert {p.read_text() for p in said.iterdir()} == {"search_document: words here", "search_query: who speaks"}
    e.know("r", role="rerank", path=None, family="bert")
    assert e.template("r") == models.TEMPLATES["bge"] and e.template("n") is None


def test_libraries_have_names(spark, engine, tmp_path):
    names = Registry(spark, str(tmp_path / "names"))
    assert names.names() == [] and names.default() is None
    with pytest.raises(E.UnknownLibrary):
        names.resolve()
    for bad in ("", "a/b", "a b", "..", None):
        with pytest.raises(E.BadName):
            checked_name(bad)
    with pytest.raises(E.UnknownLibrary):
        names.add("gone", str(tmp_path / "gone"))
    names.add("one", engine.store.path)
    assert names.default() == "one" and names.open().status().first().books == 3
    own = Engine(spark, str(tmp_path / "two"))
    own.add(spark.createDataFrame([("k", "t", "s", "words here")], "key string, title string, shelf string, text string"))
    (tmp_path / "two" / "notes.txt").write_text("mine")
    names.add("two", own.store.path)
    with pytest.raises(E.BadName):
        names.add("two", engine.store.path)
    names.use("two")
    assert names.default() == "two" and names.names() == ["one", "two"]
    names.delete("two")
    assert (tmp_path / "two" / "notes.txt").exists() and not (tmp_path / "two" / "chunks").exists() and names.names() == ["one"] and names.default() is None
    names.forget("one")
    assert engine.status().first().books == 3
