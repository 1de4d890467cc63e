"""One library of books: add, embed, route, ask, inspect and keep up. Every table is a DataFrame, every answer too.

A book has one source or more; a source split one way is a segment, which owns a run of chunk ids. Rows of chunks, words and
vectors name their segment and are never changed: an edit or a removal takes segments away, and what they owned is not
seen any more until ``compact`` drops it and closes up the ids. Texts of chunks are kept beside their spans, so
that a search reads no files.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, fields
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern import errors as E
from lectern.functions import text as X
from lectern.functions import vectors as V
from lectern.jobs import Frames, SearchJob
from lectern.operators import answers as A
from lectern.operators import corpus as C
from lectern.operators import retrieval as R
from lectern.operators import segments as S
from lectern.sources import models, readers
from lectern.store import JOURNALS, NEXT, SCHEMAS, Store

EmbedFn = Callable[[list[str]], list[list[float]]]
ScoreFn = Callable[[str, list[str]], list[float]]
TalkFn = Callable[[str], str]
MODES = ("hybrid", "vector", "lexical")
#: Tables whose rows belong to a segment.
OWNED = ("chunks", "postings", "vectors", "failures", "carries", "progress")
#: Parts of a table of progress after which its rows are put together.
_FOLD = 64
#: Old ids that one step of a compaction moves.
_MOVED_AT_ONCE = 50_000_000


@dataclass(frozen=True)
class SearchOptions:
    """How to search. ``route`` is how many books are routed to (none: all), ``rerank`` how many candidates are reranked."""

    k: int = 5
    mode: str = "hybrid"
    scope: tuple[str, ...] = ()
    model: str | None = None
    route: int | None = None
    dedupe: bool = False
    rerank: int | None = None

    @classmethod
    def of(cls, **given: object) -> SearchOptions:
        known = {f.name for f in fields(cls)}
        if odd := sorted(set(given) - known):
            raise E.BadOption(f"unknown: {', '.join(odd)}")
        return cls(**given)

    def check(self) -> None:
        if self.mode not in MODES:
            raise E.BadOption(f"mode is one of {', '.join(MODES)}")
        for name in ("k", "route", "rerank"):
            if (n := getattr(self, name)) is not None and n < 1:
                raise E.BadOption(f"{name} is at least 1")


@dataclass(frozen=True)
class SearchResult:
    """``hits`` with what a reader should know of them. ``routed`` holds the books that the question was routed to, if it was."""

    question: str
    options: SearchOptions
    hits: DataFrame
    warnings: tuple[str, ...]
    routed: tuple[int, ...] | None
    read: int
    population: int
    elapsed_ms: float

    def scanned_fraction(self) -> float:
        """Vectors that the search itself read (it counted them) of all that it might have seen; 0 if there are none."""
        return self.read / self.population if self.population else 0.0

    def payload(self) -> str:
        """One JSON object for a program: query, mode, routed, reranked, scanned_fraction, elapsed_ms, warnings, results."""
        results = [json.loads(r["json"]) for r in readers.results_json(self.hits).collect()]  # at most k rows
        head = {"query": self.question, "mode": self.options.mode, "routed": None if self.routed is None else len(self.routed), "reranked": self.options.rerank or 0}
        return json.dumps({**head, "scanned_fraction": round(self.scanned_fraction(), 4), "elapsed_ms": round(self.elapsed_ms, 1), "warnings": list(self.warnings), "results": results}, ensure_ascii=False)


@dataclass(frozen=True)
class Passage:
    """A hit with whole sentences around it; ``text[at:upto]`` is what the search found."""

    rank: int
    chunk_id: int
    key: str
    title: str | None
    byte_offset: int
    text: str
    at: int
    upto: int

    @property
    def found(self) -> str:
        return self.text[self.at : self.upto]


@dataclass(frozen=True)
class Summary:
    """An answer with the passages it cites. ``retried`` are the words that found them; ``failed`` words that found no answer either."""

    question: str
    answer: A.Answer
    passages: tuple[Passage, ...]
    retried: str | None = None
    failed: str | None = None


@dataclass(frozen=True)
class Evaluation:
    """``rows``: q, kind, band, at1, atk of each question; ``took``: milliseconds of each search, ascending."""

    rows: DataFrame
    took: tuple[float, ...]

    def tallies(self) -> DataFrame:
        """kind, band, questions, recall_at_1, recall_at_k."""
        return self.rows.groupBy("kind", "band").agg(F.count(F.lit(1)).alias("questions"), F.sum("at1").alias("recall_at_1"), F.sum("atk").alias("recall_at_k"))

    def quantile(self, share: float) -> float:
        """Milliseconds that so large a share of the searches stayed within."""
        return self.took[min(len(self.took) - 1, int(share * len(self.took)))] if self.took else 0.0


def _whole(change: Callable) -> Callable:
    """A change that is worked out from one commit; refused if another of the same tables comes meanwhile."""

    @wraps(change)
    def run(self, *args: object, **more: object):  # noqa: ANN001, ANN202
        with self.store.change():
            return change(self, *args, **more)

    return run


class Engine:
    def __init__(self, spark: SparkSession, path: str, target: int = C.TARGET, overlap: int = 0) -> None:
        self.spark, self.store, self.target, self.overlap = spark, Store(spark, path), target, overlap

    def table(self, name: str) -> DataFrame:
        """A table's rows. Those of segments that an edit or a removal took away are not among them."""
        rows = self.store.read(name)
        return rows.join(self.store.read("segments").select("segment_id"), "segment_id", "left_semi") if name in OWNED else rows

    # ingest

    def add_files(self, paths: str | list[str], whole: bool = False, chapters: bool = False, deep: bool = False, suffixes: tuple[str, ...] = readers.SUFFIXES) -> DataFrame:
        """Text files as books; a file's folder is its shelf.

        A folder stands for the files of a wanted suffix below it; with ``chapters`` it is one book and they are its parts, in the
        order of their paths. A file that is named itself needs no suffix. Files of the size and time that are recorded are not
        read again, unless ``deep``.
        """
        files = self.store.keep(readers.books_of(self.spark, [paths] if isinstance(paths, str) else list(paths), suffixes, chapters))
        known = self.store.read("sources").select("path", F.col("size_bytes").alias("was"), F.col("mtime").alias("then"), "book_id")
        mine = self.store.read("segments").filter(F.col("chunking_id") == (self._chunking() or -1)).select("book_id").distinct()
        j = files.join(known, "path", "left")
        same = (F.col("was") == F.col("size_bytes")) & F.col("then").eqNullSafe(F.col("mtime")) if not deep else F.lit(False)
        of_book = self.store.read("books").join(mine, "book_id", "left_semi").join(self.store.read("sources").groupBy("book_id").agg(F.count(F.lit(1)).alias("had")), "book_id").select("key", "had")
        rest = j.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(same, F.lit(False))).alias("same")).join(of_book, "key", "left")
        quiet = rest.filter(F.col("same") & (F.col("n") == F.col("had"))).select("key")
        suspects = files.join(quiet, "key", "left_anti")
        read = readers.contents(self.spark, [r["path"] for r in suspects.select("path").collect()])  # Spark lists files on the driver too
        done = quiet.select("key", F.lit("unchanged").alias("status"))
        if read is None:
            return done
        found = suspects.join(read, "path")
        return self.add_parts(found, whole, files.select("key").distinct()).unionByName(done)

    def add(self, found: DataFrame, whole: bool = False) -> DataFrame:
        """Take in books of one text each (key, title, shelf, text); see ``add_parts``."""
        none = [F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("timestamp").alias("mtime")]
        return self.add_parts(found.select("key", "title", "shelf", F.col("key").alias("path"), "text", *none), whole)

    @_whole
    def add_parts(self, found: DataFrame, whole: bool = False, all_keys: DataFrame | None = None) -> DataFrame:
        """Take in books (key, title, shelf, path, text, size_bytes, mtime; a row a file); key, status of each.

        A book is added, unchanged, moved, updated, or rechunked: the same text, in a chunking that it was not split by yet; the
        chunks of others stay. With ``whole``, ``found`` (or ``all_keys``, if more were seen) is all there is: a book
        that it lacks has moved to a new key with the same list of texts, if there is one. A file that comes twice is taken once. All tables
        change at once or not at all, so a call that failed can be repeated. Vectors of text that an edit left alone
        wait as carries until the next embedding takes them over.
        """
        text = F.coalesce("text", F.lit(""))
        order = F.row_number().over(W.partitionBy("key").orderBy("path")) - 1
        rows = found.select("key", "title", "shelf", "path", text.alias("text"), F.coalesce("size_bytes", F.octet_length(text).cast("bigint")).alias("size_bytes"), "mtime").dropDuplicates(["key", "path"])
        found = self.store.keep(rows.withColumn("ordinal", order).withColumn("content_sha256", F.sha2(F.col("text").cast("binary"), 256)))
        books, sources, segments = (self.store.read(t) for t in ("books", "sources", "segments"))
        chunking = self._chunking()
        mark = self.store.read("marks").first() or dict.fromkeys(("books", "sources", "segments", "chunks"), 0)

        old = books.join(S.identity(sources, "book_id").drop("size_bytes"), "book_id").select("key", F.col("content").alias("was"), F.col("paths").alias("was_paths"), F.col("book_id").alias("old_id"))
        split = segments.filter(F.col("chunking_id") == (chunking or -1)).select(F.col("book_id").alias("old_id")).distinct().withColumn("split", F.lit(True))
        now = S.identity(found, "key").join(found.filter("ordinal = 0").select("key", "title", "shelf"), "key")
        j = now.join(old, "key", "left").join(split, "old_id", "left")
        same = (F.col("was") == F.col("content")) & (F.col("was_paths") == F.col("paths"))
        j = j.withColumn("status", F.when(F.col("old_id").isNull(), "added").when(~same, "updated").when(F.col("split"), "unchanged").otherwise("rechunked"))
        if whole:  # one new key takes over one old book
            there = found.select("key") if all_keys is None else all_keys
            gone = old.join(there, "key", "left_anti").groupBy(F.col("was").alias("content")).agg(F.min_by("old_id", "key").alias("moved_id"))
            first = j.filter("status = 'added'").groupBy("content").agg(F.min("key").alias("key")).join(gone, "content").select("key", "moved_id")
            j = j.join(first, "key", "left").withColumn("status", F.when(F.col("moved_id").isNotNull(), "moved").otherwise(F.col("status")))
        else:
            j = j.withColumn("moved_id", F.lit(None).cast("bigint"))
        j = self.store.keep(j)
        if not j.filter("status <> 'unchanged'").head(1):
            return j.select("key", "status")
        ids = self._numbered(j.filter("status = 'added'").select("key"), mark["books"])
        ids = ids.unionByName(j.filter("status IN ('updated', 'rechunked')").select("key", F.col("old_id").alias("book_id")))
        parts = found.join(ids, "key").join(j.select("key", "status"), "key")
        fresh = parts.filter("status <> 'rechunked'")
        numbers = C.allocate(fresh.select("book_id", "ordinal", F.lit(1).alias("n"))).select("book_id", "ordinal", (F.col("chunk_start") + mark["sources"]).alias("source_id"))
        new_sources = self.store.keep(fresh.join(numbers, ["book_id", "ordinal"]).select(*sources.columns))
        to_split = new_sources.unionByName(sources.join(j.filter("status = 'rechunked'").select(F.col("old_id").alias("book_id")), "book_id", "left_semi")).select("source_id", "book_id", "ordinal")
        texts = parts.join(to_split, ["book_id", "ordinal"]).select(F.col("source_id").alias("book_id"), "text")
        spans = self.store.keep(C.chunk(texts, self.target, self.overlap, with_text=True).withColumnRenamed("book_id", "source_id"))
        sizes = to_split.join(spans.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")), "source_id", "left").fillna(0, ["n"])
        own = C.allocate(sizes.select("book_id", "ordinal", "n")).select("book_id", "ordinal", (F.col("chunk_start") + mark["chunks"]).alias("chunk_start"), "chunk_count")
        number = C.allocate(sizes.select("book_id", "ordinal", F.lit(1).alias("n"))).select("book_id", "ordinal", (F.col("chunk_start") + mark["segments"]).alias("segment_id"))
        new_segments = self.store.keep(to_split.join(own, ["book_id", "ordinal"]).join(number, ["book_id", "ordinal"]))
        chunks = spans.join(new_segments.select("source_id", "segment_id", "book_id", "chunk_start"), "source_id").withColumn("chunk_id", F.col("chunk_start") + F.col("ordinal"))
        edited = j.filter("status = 'updated'").select(F.col("old_id").alias("book_id"))
        with self.store.change():
            if chunking is None:
                chunking = (self.store.read("chunkings").agg(F.max("chunking_id")).first()[0] or 0) + 1
                self.store.append("chunkings", self.spark.createDataFrame([(chunking, S.VERSION, self.target, self.overlap)], SCHEMAS["chunkings"]))
            new = self.store.append("chunks", chunks)
            if edited.head(1):
                self._carry(segments.join(edited, "book_id", "left_semi"), new.join(edited, "book_id", "left_semi"), chunking)
            words = self._posted(new)
            rows = new_segments.withColumn("chunking_id", F.lit(chunking)).join(words, "segment_id", "left").fillna(0, ["words"])
            self.store.replace("segments", segments.join(edited, "book_id", "left_anti").unionByName(rows.select(*segments.columns)))
            moved = found.join(j.filter("status = 'moved'").select("key", F.col("moved_id").alias("book_id")), "key")
            at_new = moved.select("book_id", "ordinal", F.col("path").alias("new_path"), F.col("mtime").alias("new_mtime"))
            kept = sources.join(edited, "book_id", "left_anti").join(at_new, ["book_id", "ordinal"], "left")
            kept = kept.withColumn("path", F.coalesce("new_path", "path")).withColumn("mtime", F.coalesce("new_mtime", "mtime")).select(*sources.columns)
            self.store.replace("sources", kept.unionByName(new_sources))
            at_new = moved.filter("ordinal = 0").select("book_id", F.col("key").alias("new_key"), F.col("title").alias("new_title"), F.col("shelf").alias("new_shelf"))
            stay = books.join(at_new, "book_id", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in ("key", "title", "shelf")}).select(*books.columns)
            what = j.join(ids, "key").select("book_id", F.col("content").alias("sha"), F.col("size_bytes").alias("bytes"))
            stay = stay.join(what, "book_id", "left").withColumn("content_sha256", F.coalesce("sha", "content_sha256")).withColumn("size_bytes", F.coalesce("bytes", "size_bytes")).select(*books.columns)
            none = F.lit(None).cast("string")
            added = j.filter("status = 'added'").join(ids, "key").select("book_id", "key", "title", "shelf", none.alias("label"), none.alias("note"), F.lit(False).alias("excluded"), F.col("content").alias("content_sha256"), "size_bytes")
            self.store.replace("books", stay.unionByName(added))
            last = new_segments.agg(F.coalesce(F.max("segment_id"), F.lit(mark["segments"])), F.coalesce(F.max(F.col("chunk_start") + F.col("chunk_count") - 1), F.lit(mark["chunks"]))).first()
            top = [max(mark["books"], ids.agg(F.max("book_id")).first()[0] or 0), max(mark["sources"], new_sources.agg(F.max("source_id")).first()[0] or 0), max(mark["segments"], last[0]), max(mark["chunks"], last[1])]
            self.store.replace("marks", self.spark.createDataFrame([tuple(top)], SCHEMAS["marks"]))
        return j.select("key", "status")

    @_whole
    def take_batch(self, stream: str, number: int, found: DataFrame) -> bool:
        """Take in a batch of a stream (key, title, shelf, text, at) once: False, and nothing changes, if a batch of its number or a later one has been taken.

        Of a key's texts the one written last counts: an older one that comes late is left out.
        """
        batches = self.store.read("batches")
        last = batches.filter(F.col("stream") == stream).agg(F.max("batch")).first()[0]
        if last is not None and last >= number:
            return False
        newest = found.groupBy("key").agg(F.max_by(F.struct("title", "shelf", "text"), F.struct("at", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))).alias("b"), F.max("at").alias("at"))
        newest = self.store.keep(newest)
        edits = self.store.read("edits")
        due = newest.join(edits.select("key", F.col("at").alias("was")), "key", "left").filter(F.col("was").isNull() | (F.col("at") > F.col("was"))).drop("was")
        with self.store.change():
            self.add(due.select("key", "b.title", "b.shelf", "b.text"))
            self.store.replace("edits", edits.join(due, "key", "left_anti").unionByName(due.filter("at IS NOT NULL").select("key", "at")))
            row = self.spark.createDataFrame([(stream, number)], SCHEMAS["batches"])
            self.store.replace("batches", batches.filter(F.col("stream") != stream).unionByName(row))
        return True

    def _chunking(self) -> int | None:
        """The number of this engine's way to split, if anything was split so."""
        row = self.store.read("chunkings").filter((F.col("version") == S.VERSION) & (F.col("target") == self.target) & (F.col("overlap") == self.overlap)).first()
        return row["chunking_id"] if row else None

    def _numbered(self, keys: DataFrame, after: int) -> DataFrame:
        """``keys`` with book_id from ``after`` + 1, in the order of key: numbered within ranges, then the ranges' totals added up."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = self.store.keep(keys.repartitionByRange(parts, "key").withColumn("p", F.spark_partition_id()))
        totals = ranged.groupBy("p").agg(F.count(F.lit(1)).alias("n")).withColumn("skip", F.sum("n").over(W.orderBy("p")) - F.col("n")).select("p", "skip")  # a row for each range
        within = F.row_number().over(W.partitionBy("p").orderBy("key"))
        return ranged.withColumn("r", within).join(F.broadcast(totals), "p").select("key", (F.col("r") + F.col("skip") + F.lit(after)).alias("book_id"))

    def _carry(self, gone: DataFrame, new: DataFrame, chunking: int) -> None:
        """Vectors of chunks that an edit left alone wait beside the text's new ids, for the models of this chunking. What waited before goes on waiting."""
        models_ = self.store.read("models").filter(F.col("chunking_id") == chunking).select("model")  # a row a model
        kept = ["model", "chunk_id", "embedding", "data", "scale"]
        have = self.table("vectors").join(gone.select("segment_id"), "segment_id", "left_semi").select(*kept).unionByName(self.table("carries").join(gone.select("segment_id"), "segment_id", "left_semi").select(*kept))
        have = have.join(F.broadcast(models_), "model", "left_semi").join(self.table("failures").select("model", "chunk_id"), ["model", "chunk_id"], "left_anti")
        was = self.table("chunks").join(gone.select("segment_id"), "segment_id", "left_semi").select("chunk_id", "content_hash", "book_id")
        pairs = C.carries(was.join(have.select("chunk_id"), "chunk_id", "left_semi"), new.select("chunk_id", "content_hash", "book_id"), same_book=True)
        moved = have.withColumnRenamed("chunk_id", "old_chunk").join(pairs, "old_chunk").withColumn("chunk_id", F.col("new_chunk"))
        self.store.append("carries", moved.join(new.select("chunk_id", "segment_id"), "chunk_id"))

    def _posted(self, chunks: DataFrame) -> DataFrame:
        """Index the words of chunks; segment_id and how many words each segment has."""
        made = self.store.append("postings", R.postings(chunks, ("segment_id", "book_id")))
        return made.groupBy("segment_id").agg(F.sum("tf").alias("words"))

    @_whole
    def index_words(self) -> None:
        """Index the words of all chunks anew, where an index has none or an old one."""
        with self.store.change():
            chunks, segments = self.table("chunks"), self.store.read("segments")
            self.store.discard("postings")
            self.store.replace("segments", segments.drop("words").join(self._posted(chunks), "segment_id", "left").fillna(0, ["words"]).select(*segments.columns))

    # embedding and routing

    def embed(self, model: str, embed_fn: EmbedFn, dim: int, limit: int | None = None, seconds: float | None = None, step: int = 100_000, stop: Callable[[], bool] | None = None, duty: float = 1.0, scope: tuple[str, ...] = ()) -> int:
        """Vectors for chunks that have none, in order of their ids; how many the model made.

        The first run binds the model to this engine's chunking. What is left is known from segments and progress alone; a step
        takes the next ``step`` ids, copies the vectors that an edit left waiting, and has the rest embedded in many
        tasks. Each step's vectors, failures and progress count at once, so a run that is cut short loses one step and the next goes on
        from there. It ends after ``limit`` chunks, after ``seconds``, or when ``stop`` says so; with a ``duty`` below 1 it rests
        between steps.
        """
        if not 0 < duty <= 1 or step < 1 or (limit is not None and limit < 0):
            raise E.BadOption("duty is in (0, 1], step at least 1, limit at least 0")
        begun, seen, bad, copied = time.time(), 0, 0, 0
        known = self._bind(model, dim)
        chosen = self._scope(scope)
        passage, _ = self._prompts(model)
        while (limit is None or seen < limit) and not (stop and stop()) and (seconds is None or time.time() - begun < seconds):
            at = time.time()
            left = S.pending(self._standing(model))
            left = left if chosen is None else left.join(chosen, "book_id", "left_semi")
            ranges = self.store.keep(S.first_ids(left, step if limit is None else min(step, limit - seen)))
            n, low, high = ranges.agg(F.sum("n"), F.min("start"), F.max(F.col("start") + F.col("n"))).first()
            if not n:
                break
            ids = (F.col("chunk_id") >= F.col("start")) & (F.col("chunk_id") < F.col("start") + F.col("n"))
            of_step = lambda rows: rows.filter(F.col("chunk_id").between(low, high - 1)).join(F.broadcast(ranges.select("segment_id", "start", "n")), "segment_id").filter(ids).drop("start", "n")  # noqa: E731, B023  at most ``step`` ranges
            carried = of_step(self.store.read("carries").filter(F.col("model") == model)).select("chunk_id", "segment_id", "embedding", "data", "scale")
            todo = of_step(self.store.read("chunks")).select("chunk_id", "segment_id", "book_id", "text")
            carried = self.store.keep(carried.join(todo.select("chunk_id", "book_id"), "chunk_id"))
            todo = todo.join(carried.select("chunk_id"), "chunk_id", "left_anti").repartition(self._tasks(n))
            made = self.store.keep(readers.embed(todo, embed_fn, dim, ("segment_id", "book_id"), passage))
            fresh, failed = made.agg(F.count(F.lit(1)), F.count("failed")).first()
            vectors = made.withColumn("data", F.lit(None).cast("binary")).withColumn("scale", F.lit(None).cast("double"))
            if known["quantisation"] == "int8":
                vectors = _pack(vectors)
            with self.store.change():
                if not self.store.read("models").filter(F.col("model") == model).head(1):
                    self.store.append("models", self.spark.createDataFrame([tuple(known.values())], SCHEMAS["models"]))
                self.store.append("vectors", vectors.drop("failed").unionByName(carried).withColumn("model", F.lit(model)))
                self.store.append("failures", made.filter("failed IS NOT NULL").select(F.lit(model).alias("model"), "chunk_id", "segment_id", F.col("failed").alias("reason")))
                now = ranges.select(F.lit(model).alias("model"), "segment_id", (F.col("start") + F.col("n") - F.col("chunk_start")).alias("n_embedded"))
                if len(self.store.parts().get("progress", ())) < _FOLD:
                    self.store.append("progress", now)
                else:
                    self.store.replace("progress", self.table("progress").unionByName(now).groupBy("model", "segment_id").agg(F.max("n_embedded").alias("n_embedded")))
            seen, bad, copied = seen + n, bad + failed, copied + n - fresh
            if duty < 1:
                time.sleep((time.time() - at) * (1 / duty - 1))
        if copied:
            self.store.replace("carries", self.waiting())
        self._log("runs", model=model, seconds=time.time() - begun, embedded=seen - copied - bad, copied=copied, failed=bad, duty=duty)
        return seen - copied

    def _tasks(self, rows: int) -> int:
        """Into how many tasks to deal rows for a model: all that can run several times over, but not a task for a few rows."""
        return max(1, min(4 * self.spark.sparkContext.defaultParallelism, -(-rows // 4)))

    def _bind(self, model: str, dim: int) -> dict[str, object]:
        """What is known of a model, as it will be recorded; refused if it embeds another chunking or has another dimension."""
        chunking = self._chunking()
        row = self.store.read("models").filter(F.col("model") == model).first()
        if row is None:
            if chunking is None:
                raise E.NothingIndexed("nothing is split this way")
            return {"model": model, "dim": dim, "chunking_id": chunking, "quantisation": "fp32"}
        if row["chunking_id"] != chunking:
            raise E.OtherChunking(f"{model} embeds chunking {row['chunking_id']}, and one only; this is {chunking}")
        if row["dim"] != dim:
            raise E.WrongDimension(f"{model} has {row['dim']} dimensions, not {dim}")
        return row.asDict()

    def _standing(self, model: str | None = None) -> DataFrame:
        """How far a model, or each, has come in every segment of its chunking. A model that has embedded nothing yet would take this engine's."""
        known = self.store.read("models")
        if model is not None:
            known = known.filter(F.col("model") == model)
            if not known.head(1):
                known = self.spark.createDataFrame([(model, 0, self._chunking(), "fp32")], SCHEMAS["models"])
        return S.standing(self.store.read("segments"), self.store.read("progress"), known)

    def waiting(self) -> DataFrame:
        """Carries that no embedding has taken over yet."""
        return S.waiting(self._standing(), self.store.read("carries"))

    def chunkings(self) -> DataFrame:
        """Every way the library is split, with its segments and chunks."""
        return S.per_chunking(self.store.read("chunkings"), self.store.read("segments"))

    def outstanding(self, model: str, scope: tuple[str, ...] = ()) -> DataFrame:
        """One row: live, done, to_embed, and the book at work (the largest backlog begun; the earliest of several)."""
        books = S.of_books(self._standing(model)).filter("live > 0")
        if (chosen := self._scope(scope)) is not None:
            books = books.join(chosen, "book_id", "left_semi")
        return C.outstanding(books.select("book_id", F.col("live").alias("n")), books.select("book_id", "done"))

    @_whole
    def quantise(self, model: str) -> None:
        """Keep a model's vectors as whole numbers of eight bits and a scale: a quarter of the bytes. Its later vectors are kept so too."""
        name = self.model(model)
        rows = self._vectors(name)
        self._rewritten(name, _pack(rows.drop("model")).withColumn("model", F.lit(name)), quantisation=F.lit("int8"))

    @_whole
    def truncate(self, model: str, dim: int) -> None:
        """Keep the first ``dim`` components of a model's vectors, at unit length, and of its questions; its profile goes, as it no longer fits."""
        name = self.model(model)
        known = self.store.read("models").filter(F.col("model") == name).first()
        if not 0 < dim <= known["dim"]:
            raise E.WrongDimension(f"{name} has {known['dim']} dimensions")
        rows = self._vectors(name).withColumn("embedding", V.truncate(F.col("embedding"), dim).cast("array<float>"))
        with self.store.change():
            self._rewritten(name, _pack(rows.drop("model")).withColumn("model", F.lit(name)) if known["quantisation"] == "int8" else rows, dim=F.lit(dim))
            self.store.replace("centroids", self.table("centroids").filter(F.col("model") != name))

    def _vectors(self, model: str) -> DataFrame:
        """A model's vectors as single precision, however they are kept."""
        rows = self.table("vectors").drop("bucket").filter(F.col("model") == model)
        if self.store.read("models").filter((F.col("model") == model) & (F.col("quantisation") == "int8")).head(1):
            rows = rows.withColumn("embedding", V.unpacked(F.col("data"), F.col("scale")).cast("array<float>"))
        return rows.withColumn("data", F.lit(None).cast("binary")).withColumn("scale", F.lit(None).cast("double"))

    def _rewritten(self, name: str, rows: DataFrame, **known: Column) -> None:
        with self.store.change():
            vectors, all_models = self.table("vectors").drop("bucket"), self.store.read("models")
            self.store.replace("vectors", vectors.filter(F.col("model") != name).unionByName(rows.select(*vectors.columns)))
            self.store.replace("models", all_models.withColumns({c: F.when(F.col("model") == name, v).otherwise(F.col(c)) for c, v in known.items()}))
            self.store.replace("carries", self.waiting().filter(F.col("model") != name))  # of another kind now: embedded anew

    def _log(self, name: str, **row: object) -> None:
        at = self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(time.time_ns()).alias("id"), *[F.lit(v).alias(c) for c, v in row.items()])
        kinds = self.spark.createDataFrame([], SCHEMAS[name]).schema
        self.store.append(name, at.select(*[F.col(f.name).cast(f.dataType) for f in kinds]))

    @_whole
    def know(self, model: str, role: str = "embed", alias: str | None = None, preferred: bool = False, source: str | None = None, path: str | None = None, family: str | None = None) -> None:
        """Remember a model: its other name, whether it is the preferred one of its role, its family (by which it is prompted), and where its weights are, with their digest."""
        if role not in models.ROLES:
            raise E.BadOption(f"role is one of {', '.join(models.ROLES)}")
        known = self.table("known")
        if alias and known.filter((F.col("alias") == alias) & ~((F.col("model") == model) & (F.col("role") == role))).head(1):
            raise E.BadOption(f"{alias} is the name of another model")
        digest = models.digest_of(self.spark, path) if path else None
        if path and digest is None:
            raise E.BadOption(f"{path} is not there")
        others = known.filter(~((F.col("model") == model) & (F.col("role") == role)))
        if preferred:  # one for each role
            others = others.withColumn("preferred", F.when(F.col("role") == role, F.lit(False)).otherwise(F.col("preferred")))
        row = self.spark.createDataFrame([(model, role, alias, preferred, source, path, digest, family)], SCHEMAS["known"])
        self.store.replace("known", others.unionByName(row))

    def _prompts(self, model: str) -> tuple[str, str]:
        """How the model wants passages and questions put."""
        row = self.store.read("known").filter((F.col("model") == model) & (F.col("role") == "embed")).select(models.prompt("passage", F.col("family")), models.prompt("question", F.col("family"))).first()
        return tuple(row) if row else ("{}", "{}")

    def template(self, model: str) -> str | None:
        """The text that a reranker that is known wants a question and a passage put in."""
        row = self.store.read("known").filter((F.col("model") == model) & (F.col("role") == "rerank")).select(models.template(F.coalesce("path", "model"), F.col("family"))).first()
        return row[0] if row else None

    def preferred(self, role: str) -> str | None:
        row = self.table("known").filter((F.col("role") == role) & F.col("preferred")).first()
        return row["model"] if row else None

    def verify_weights(self) -> dict[str, str]:
        """same, changed or missing for each model whose weights are recorded."""
        rows = self.table("known").filter("path IS NOT NULL").collect()  # a row a model
        now = {r["model"]: (models.digest_of(self.spark, r["path"]), r["digest"]) for r in rows}
        return {m: "missing" if a is None else "same" if a == b else "changed" for m, (a, b) in now.items()}

    def model(self, wanted: str | None = None) -> str:
        """The model of that name or alias, or the only one whose name holds it; without a name the preferred one."""
        names = sorted(r[0] for r in self.store.read("models").select("model").collect())  # a row a model
        if not names:
            raise E.NotEmbedded("nothing is embedded")
        named = self.table("known").filter("role = 'embed'").filter(F.col("preferred") if wanted is None else F.col("alias") == wanted).first()
        if named and named["model"] in names:
            return named["model"]
        fit = [n for n in names if n == wanted] or [n for n in names if wanted is None or wanted in n]
        if len(fit) != 1:
            raise E.AmbiguousModel(fit)
        return fit[0]

    @_whole
    def route(self, model: str | None = None, k: int = 16) -> None:
        """Profile every embedded book of a model anew."""
        name = self.model(model)
        built = R.build_centroids(self._vectors(name), k).withColumn("model", F.lit(name))
        self.store.replace("centroids", self.table("centroids").filter(F.col("model") != name).unionByName(built.select(*self.table("centroids").columns)))

    # search

    def _scope(self, patterns: tuple[str, ...]) -> DataFrame | None:
        if not patterns:
            return None
        books = self.table("books")
        fits = [C.matches(p, F.col("title"), F.col("key"), F.col("label")) for p in patterns]
        counts = books.agg(*[F.count_if(f).alias(f"n{i}") for i, f in enumerate(fits)]).first()
        if missed := [p for p, n in zip(patterns, counts, strict=True) if not n]:
            raise E.ScopeMissed(missed)
        any_fit = fits[0]
        for f in fits[1:]:
            any_fit = any_fit | f
        chosen = books.filter(any_fit)
        if not chosen.filter("NOT excluded").head(1):
            raise E.SetAside("all books of this scope are set aside")
        return chosen.select("book_id")

    def ask(self, question: str, embed_query: EmbedFn | None = None, score: ScoreFn | None = None, record: bool = True, **more: object) -> DataFrame:
        """The best passages: rank, chunk_id, score, why, key, title, shelf, byte_offset, byte_length, text."""
        return self.search(question, embed_query, score, record, **more).hits

    def search(self, question: str, embed_query: EmbedFn | None = None, score: ScoreFn | None = None, record: bool = True, expand: TalkFn | None = None, embed_documents: EmbedFn | None = None, frames: Frames | None = None, **options: object) -> SearchResult:
        """The best passages with warnings.

        ``expand`` is a model that is asked for other words: its vec: lines are searched as questions, its hyde: lines as
        passages (by ``embed_documents``, else ``embed_query``). The vector lists become one ranking before they meet
        that of words, so the balance of the two does not hang on how many lines there are. Words are searched in the
        chunking of the model, so that no text is found twice at two widths. ``frames`` hears of every stage.
        """
        frames = frames or Frames()
        try:
            o = SearchOptions.of(**options)
            with self.store.pinned():
                found = self._search(question, o, embed_query, score, expand, embed_documents, frames)
        except BaseException as e:
            frames.end(e)
            raise
        if record:
            self._log("asked", question=question, mode=o.mode, ms=found.elapsed_ms)
        frames.end(hits=found.hits.count())  # at most k
        return found

    def start(self, question: str, **more: object) -> SearchJob:
        """The same search beside the caller: it can be watched and stopped."""
        return SearchJob(self, question, **more)

    def _search(self, question: str, o: SearchOptions, embed_query: EmbedFn | None, score: ScoreFn | None, expand: TalkFn | None, embed_documents: EmbedFn | None, frames: Frames) -> SearchResult:
        begun = time.time()
        o.check()
        books, segments = self.table("books"), self.table("segments")
        if not segments.filter("chunk_count > 0").head(1):
            raise E.NothingIndexed("nothing is indexed")
        if o.mode != "lexical" and embed_query is None:
            raise E.BadOption("a vector search needs embed_query")
        if o.rerank and score is None:
            raise E.BadOption("reranking needs score")
        scope = self._scope(o.scope)
        want = max(o.k, o.rerank or 0) * (4 if o.dedupe else 1)
        known = None if o.mode == "lexical" else self.store.read("models").filter(F.col("model") == self.model(o.model)).first()
        chunking = known["chunking_id"] if known else self._chunking() or self.chunkings().first()["chunking_id"]
        split = segments.filter(F.col("chunking_id") == chunking)
        seen = C.searchable(split, books, scope).select("segment_id", "book_id")
        lists, names, routed, read, population, name = [], [], None, 0, 0, None
        if known:
            name, (passage, asking) = known["model"], self._prompts(known["model"])
            population = self._standing(name).join(seen.select("segment_id"), "segment_id", "left_semi").agg(F.coalesce(F.sum("n_embedded"), F.lit(0))).first()[0]
            queries = [embed_query([asking.replace("{}", question)])[0]]
            if expand is not None:
                frames.stage("expand")
                other = A.parse_expansion(expand(A.EXPAND.format(question=question)), A.EXPAND.format(question=""))
                queries += [embed_query([asking.replace("{}", q)])[0] for q in other["vec"]] + [(embed_documents or embed_query)([passage.replace("{}", d)])[0] for d in other["hyde"]]
            queries = [_fitted(q, known["dim"]) for q in queries]  # the question and at most six lines more
            centroids = None
            if o.route:
                frames.stage("route")
                centroids = self.table("centroids").filter(F.col("model") == name)
                if not centroids.head(1):
                    raise E.NotRouted("no book is profiled")
                centroids = C.searchable(centroids, books, scope)
            near, routed = [], set() if o.route else None
            frames.stage("vector", population=population)
            for query in queries:
                rows = self.store.read("vectors").filter(F.col("model") == name)
                if o.route:
                    chosen = [r["book_id"] for r in R.route(centroids, query, o.route).collect()]  # at most ``route`` rows
                    rows, routed = R.of_books(rows, chosen), routed | set(chosen)
                counted = Observation()
                rows = rows.join(seen.select("segment_id"), "segment_id", "left_semi").observe(counted, F.count(F.lit(1)).alias("rows"))
                hits = (R.flat_packed if known["quantisation"] == "int8" else R.flat)(rows, query, want).collect()
                read += counted.get["rows"]
                near.append(self._ranks(r["chunk_id"] for r in hits))
            read = min(read, population)  # several questions read the same vectors
            lists, names = [near[0] if len(near) == 1 else _one_ranking(near, want)], ["vec"]
        if o.mode != "vector":
            frames.stage("lexical")
            lists.append(self._lexical(question, split, seen, C.searchable(split, books), want))
            names.append("lex")
        frames.stage("fuse")
        fused = R.fuse(lists, want)
        place = F.row_number().over(W.orderBy(F.desc("score"), "first_list", "chunk_id"))  # at most ``want`` rows
        hits = fused.select("chunk_id", "score", R.provenance(F.col("s"), names).alias("why"), place.alias("rank")).collect()
        frames.stage("read", hits=len(hits))
        found = self._resolved(hits)
        if o.rerank:
            frames.stage("rerank")
            best = R.rerank(found.filter(F.col("rank") <= max(o.rerank, o.k)), _scorer(question, score)(F.col("text")))
            found = self._local(best.withColumn("rank", F.row_number().over(W.orderBy(F.col("text").isNull(), F.desc_nulls_last("score"), "rank"))))
        if o.dedupe:
            frames.stage("dedupe")
            kept = [r["chunk_id"] for r in R.drop_near(found, k=o.k).collect()]  # at most k
            found = found.filter(F.col("chunk_id").isin(kept))
        found = found.withColumn("rank", F.row_number().over(W.orderBy("rank"))).filter(F.col("rank") <= o.k)
        hits = self._local(found.select("rank", "chunk_id", "score", "why", "key", "title", "shelf", "byte_offset", "byte_length", "text").orderBy("rank"))
        took = 1000 * (time.time() - begun)
        return SearchResult(question, o, hits, self._warnings(scope, name if o.route else None), None if routed is None else tuple(sorted(routed)), read, population, took)

    def _local(self, few: DataFrame) -> DataFrame:
        """The few rows of a search's hits as rows that are there."""
        return self.spark.createDataFrame(few.collect(), few.schema)

    def _ranks(self, ids: Iterator[int]) -> DataFrame:
        return self.spark.createDataFrame([(c, i) for i, c in enumerate(ids)], "chunk_id bigint, rank int")

    def _resolved(self, hits: list) -> DataFrame:
        """Hits with their passages and books. Their ids, at most as many as hits, are pushed to the scans: nothing else is read."""
        ids = [h["chunk_id"] for h in hits]
        chunks = {c["chunk_id"]: c for c in self.store.read("chunks").filter(F.col("chunk_id").isin(ids)).collect()}
        books = {b["book_id"]: b for b in self.store.read("books").filter(F.col("book_id").isin(sorted({c["book_id"] for c in chunks.values()}))).collect()}
        rows = []
        for h in hits:
            c = chunks[h["chunk_id"]]
            b = books[c["book_id"]]
            rows.append((h["rank"], h["chunk_id"], h["score"], h["why"], b["key"], b["title"], b["shelf"], c["byte_offset"], c["byte_length"], c["text"]))
        return self.spark.createDataFrame(rows, "rank int, chunk_id bigint, score double, why string, key string, title string, shelf string, byte_offset bigint, byte_length bigint, text string")

    def _warnings(self, scope: DataFrame | None, routed_by: str | None) -> tuple[str, ...]:
        """Books that a search of this scope leaves out without having been told to; six are named."""
        books, said = self.table("books"), []
        left_out = []
        if scope is not None:
            left_out.append(("set aside", books.filter("excluded").join(scope, "book_id", "left_semi")))
        if routed_by is not None:
            begun = S.of_books(self._standing(routed_by)).filter("done > 0")
            bare = begun.join(self.table("centroids").filter(F.col("model") == routed_by), "book_id", "left_anti")
            bare = C.searchable(books.join(bare, "book_id", "left_semi"), books, scope)
            left_out.append(("not profiled", bare))
        for why, them in left_out:
            six = [r[0] for r in them.select(F.coalesce("title", "key").alias("t")).orderBy("t").limit(7).collect()]
            if six:
                said.append(f"{why}: {', '.join(six[:6])}{' and others' if len(six) > 6 else ''}")
        return tuple(said)

    def widened(self, hits: DataFrame, before: int = 500, after: int = 500) -> list[Passage]:
        """Each of k hits with whole sentences around it, out of the chunks next to it in its book."""
        rows = hits.orderBy("rank").collect()  # k rows
        around = {r["chunk_id"] + d for r in rows for d in (-1, 0, 1)}
        near = {c["chunk_id"]: c for c in self.table("chunks").filter(F.col("chunk_id").isin(*around)).collect()} if rows else {}  # three a hit
        out = []
        for r in rows:
            own = near[r["chunk_id"]]
            three = [c for d in (-1, 0, 1) if (c := near.get(r["chunk_id"] + d)) is not None and c["segment_id"] == own["segment_id"]]
            start, data = _laid_out(three)
            text, low = C.reading_window(data, own["byte_offset"] - start, own["byte_length"], before, after)
            at = len(data[low : own["byte_offset"] - start].decode("utf-8", "ignore"))
            out.append(Passage(r["rank"], r["chunk_id"], r["key"], r["title"], start + low, text, at, at + len(own["text"].rstrip())))
        return out

    def pane(self, key: str, start: int = 0, length: int = 4000, part: int = 0) -> dict[str, object]:
        """A stretch of a book's file number ``part`` to read, of at most 200,000 bytes: text, start, end and the file's size, whole characters only."""
        book = self.table("books").filter(F.col("key") == key).first()
        source = book and self.table("sources").filter((F.col("book_id") == book["book_id"]) & (F.col("ordinal") == part)).first()
        if not source:
            raise E.UnknownBook(f"{key} is not there" if book is None else f"{key} has no part {part}")
        if start < 0 or not 0 < length <= 200_000:
            raise E.BadOption("start is at least 0, length 1 to 200,000")
        size = source["size_bytes"]
        end = min(start + length, size)
        own = self.table("segments").filter(F.col("source_id") == source["source_id"]).orderBy("chunking_id").first()
        within = (F.col("segment_id") == own["segment_id"]) & F.col("chunk_id").between(own["chunk_start"], own["chunk_start"] + own["chunk_count"] - 1)
        rows = self.store.read("chunks").filter(within & (F.col("byte_offset") < end) & (F.col("byte_offset") + F.col("byte_length") > start)).orderBy("byte_offset").collect()  # of ``length`` bytes
        if not rows:
            return {"text": "", "start": start, "end": start, "size": size}
        at, data = _laid_out(rows)
        low, high = max(start - at, 0), min(end - at, len(data))
        while low < high and data[low] & 0xC0 == 0x80:
            low += 1
        while low < high < len(data) and data[high] & 0xC0 == 0x80:
            high -= 1
        return {"text": data[low:high].decode(), "start": at + low, "end": at + high, "size": size}

    def summarise(self, question: str, talk: TalkFn, embed_query: EmbedFn | None = None, record: bool = True, **more: object) -> Summary:
        """An answer drawn from what a search finds, with its proof.

        If the model finds none, it is asked once for other words and reads what these find. If that holds no answer
        either, the first passages stay, as they are what the reader sees.
        """

        def attempt(words: str) -> tuple[A.Answer, tuple[Passage, ...]]:
            read = tuple(self.widened(self.ask(words, embed_query, record=record, **more)))
            return A.summarise(talk, question if words == question else words, [p.text for p in read], [p.found for p in read]), read

        answer, read = attempt(question)
        retried = failed = None
        if answer.refused:
            reply = talk(A.REPHRASE.format(question=question))
            other = self.spark.range(1).select(X.rephrasing(F.lit(reply or ""))).first()[0]
            if other:
                again, found = attempt(other)
                if again.refused:
                    failed = other
                else:
                    answer, read, retried = again, found, other
        made = Summary(question, answer, read, retried, failed)
        if record:
            said = {"answer": answer.prose, "claims": [asdict(c) for c in answer.claims], "passages": [p.chunk_id for p in read], "retried": retried, "failed": failed}
            self._log("summaries", question=question, record=json.dumps(said, ensure_ascii=False))
        return made

    def evaluate(self, questions: DataFrame, embed_query: EmbedFn | None = None, **options: object) -> Evaluation:
        """Ask each of a set of questions (q, a, kind) as a reader would, one search a question, and see whether a hit holds its answer.

        Answers and texts are folded alike; an answer counts at the beginning of a word. Only the searches are timed. A question whose answer
        is in no chunk is unanswerable and says nothing of the search.
        """
        asked = questions.select("q", "a", "kind", X.tokens(F.col("a")).alias("words")).collect()  # a set that a person wrote
        of_model = None if options.get("mode") == "lexical" else self.store.read("models").filter(F.col("model") == self.model(options.get("model"))).first()
        chunking = of_model["chunking_id"] if of_model else self._chunking() or self.chunkings().first()["chunking_id"]
        index = self.store.read("postings").join(C.searchable(self.table("segments").filter(F.col("chunking_id") == chunking), self.table("books")).select("segment_id"), "segment_id", "left_semi")
        rows, took = [], []
        for n, r in enumerate(asked):
            held = R.first_holder(index, r["words"])
            text = None if held is None else self.store.read("chunks").filter(F.col("chunk_id") == held).first()["text"]
            found = self.search(r["q"], embed_query, record=False, **options)
            took.append(found.elapsed_ms)
            holds = X.contains_term(X.fold(F.col("text")), X.fold(F.lit(r["a"])))
            ranks = sorted(h["rank"] for h in found.hits.filter(holds).select("rank").collect())  # at most k
            rows.append((n, r["q"], r["kind"] or "lookup", text, int(ranks[:1] == [1]), int(bool(ranks))))
        made = self.spark.createDataFrame(rows, "n int, q string, kind string, text string, at1 int, atk int")
        return Evaluation(made.select("q", "kind", R.band(F.col("q"), F.col("text")).alias("band"), "at1", "atk"), tuple(sorted(took)))

    def _lexical(self, question: str, split: DataFrame, scoped: DataFrame, seen: DataFrame, want: int) -> DataFrame:
        """The phrase over all books that are not set aside, then any of its words within scope: chunk_id, rank. Sizes come from the catalogue of segments."""
        terms = self.spark.range(1).select(F.filter(X.tokens(F.lit(question)), lambda t: (F.length(t) > 1) | t.rlike(r"^\d$"))).first()[0]
        if not terms:
            return self._ranks(iter(()))
        n, words = split.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        index = self.store.read("postings").join(split.select("segment_id"), "segment_id", "left_semi")
        found = R.two_attempts_indexed(index, (n, words / n if words else 1.0), terms, want, scoped.select("segment_id"), seen.select("segment_id"))
        return self._ranks(r["chunk_id"] for r in found.collect())  # at most ``want`` rows

    # reports

    def status(self) -> DataFrame:
        """One row: books, set_aside, bytes, chunks, vectors."""
        b = self.table("books").agg(F.count(F.lit(1)).alias("books"), F.count_if("excluded").alias("set_aside"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
        c = self.table("segments").agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))
        v = self._standing().agg(F.coalesce(F.sum("n_embedded"), F.lit(0)).alias("vectors"))
        return b.join(F.broadcast(c)).join(F.broadcast(v))  # one row each

    def books(self) -> DataFrame:
        """Every book with its sources, its chunks in each chunking, and what each model has embedded of it (``embedded``: the most of any), by label or title."""
        sources = self.table("sources").groupBy("book_id").agg(F.count(F.lit(1)).alias("sources"))
        per = self.table("segments").groupBy("book_id", "chunking_id").agg(F.sum("chunk_count").alias("n"))
        split = per.groupBy("book_id").agg(F.sum("n").alias("chunks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunking_id", "n")))).alias("by_chunking"))
        done = S.of_books(self._standing()).groupBy("book_id").agg(F.max("done").alias("embedded"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "done")))).alias("by_model"))
        j = self.table("books").join(sources, "book_id", "left").join(split, "book_id", "left").join(done, "book_id", "left").fillna(0, ["sources", "chunks", "embedded"])
        return j.orderBy(F.coalesce("label", "title"), "book_id")

    def shelves(self) -> DataFrame:
        b = self.books()
        return b.groupBy("shelf").agg(F.count(F.lit(1)).alias("books"), F.count_if("excluded").alias("set_aside"), F.sum("chunks").alias("chunks"), F.sum("size_bytes").alias("bytes"), F.sum("embedded").alias("embedded")).orderBy("shelf")

    def models(self) -> DataFrame:
        """model, live (in its own chunking), done, coverage, dim, chunking_id, quantisation."""
        return S.coverage(self._standing()).join(self.store.read("models"), "model")

    def failures(self) -> DataFrame:
        """Of each model: chunks that it could not read, and vectors that wait to be taken over."""
        return S.troubles(self.store.read("models"), self.table("failures"), self.waiting())

    def check(self) -> DataFrame:
        """One row of counts, and the next step. Only catalogues are read."""
        mark = self.store.read("marks").agg(F.coalesce(F.max("chunks"), F.lit(0)).alias("last"))
        n = F.coalesce(F.sum("chunk_count"), F.lit(0))
        c = self.table("segments").agg(n.alias("live"), F.coalesce(F.sum(F.when(F.col("words").isNotNull(), F.col("chunk_count"))), F.lit(0)).alias("lexical"))
        standing = self._standing()
        m = self.store.read("models").agg(F.count(F.lit(1)).alias("models"))
        p = standing.agg(F.coalesce(F.sum("n_embedded"), F.lit(0)).alias("done"), F.coalesce(F.sum(F.col("chunk_count") - F.col("n_embedded")), F.lit(0)).alias("pending"))
        profiled = self.table("centroids").groupBy("model", "book_id").agg(F.max("built_from").alias("was"))
        gap = S.of_books(standing).filter("done > 0").join(profiled, ["model", "book_id"], "full")
        u = gap.agg(F.count_if(~F.col("was").eqNullSafe(F.col("done"))).alias("unprofiled"))
        one = c
        for part in (mark, m, p, u):
            one = one.join(F.broadcast(part))  # one row each
        return C.next_step(one.withColumn("dead", F.col("last") - F.col("live")).drop("last"))

    def garbled(self, over: int = 30) -> DataFrame:
        """Books with chunks whose longest tenth of words is over ``over`` characters."""
        p = self.table("chunks").select("book_id", C.word_p90(F.col("text")).alias("p90")).filter(F.col("p90") > over)
        return p.groupBy("book_id").agg(F.max("p90").alias("p90"))

    def drift(self, deep: bool = False) -> DataFrame:
        """path, state of every file that books came from: missing, changed, or intact (by size and time; by its bytes, if ``deep``)."""
        own = self.table("sources").filter("mtime IS NOT NULL").select("path", "size_bytes", "mtime", "content_sha256")
        now = readers.stat(self.spark, own.select("path"))
        j = own.join(now.withColumnsRenamed({"size_bytes": "size", "mtime": "time"}), "path", "left")
        changed = (F.col("size") != F.col("size_bytes")) | (F.col("time") != F.col("mtime"))
        if deep:
            read = readers.contents(self.spark, [r["path"] for r in now.select("path").collect()])  # Spark lists files on the driver too
            sha = read.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("sha")) if read is not None else self.spark.createDataFrame([], "path string, sha string")
            j, changed = j.join(sha, "path", "left"), F.col("sha") != F.col("content_sha256")
        return j.select("path", F.when(F.col("size").isNull(), "missing").when(changed, "changed").otherwise("intact").alias("state"))

    def unreadable(self) -> DataFrame:
        """Files of books that are not there any more: path, key."""
        gone = self.drift().filter("state = 'missing'")
        return self.table("sources").join(gone, "path").join(self.table("books").select("book_id", "key"), "book_id").select("path", "key")

    def history(self, last: int = 20) -> DataFrame:
        return self.table("runs").orderBy(F.desc("id")).limit(last)

    def rates(self) -> DataFrame:
        return C.observed_rate(self.table("runs").withColumnRenamed("model", "model_id"))

    def asked(self, holds: str = "", last: int = 20) -> DataFrame:
        return self.table("asked").filter(F.contains(F.lower("question"), F.lit(holds.lower()))).orderBy(F.desc("id")).limit(last)

    # upkeep

    def _named(self, keys: list[str] | None, shelf: str | None) -> Column:
        if (keys is None) == (shelf is None):
            raise E.BadOption("name either keys or a shelf")
        named = F.col("key").isin(*keys) if keys is not None else F.col("shelf") == shelf
        found = self.table("books").filter(named).count()
        if not found or (keys is not None and found < len(set(keys))):
            raise E.UnknownBook("not all of these books are there")
        return named

    @_whole
    def set_aside(self, keys: list[str] | None = None, shelf: str | None = None, excluded: bool = True) -> int:
        """Keep books out of every search, or let them back; how many rows changed."""
        named, books = self._named(keys, shelf), self.table("books")
        n = books.filter(named & (F.col("excluded") != excluded)).count()
        self.store.replace("books", books.withColumn("excluded", F.when(named, excluded).otherwise(F.col("excluded"))))
        return n

    @_whole
    def describe(self, key: str, label: str | None = None, note: str | None = None) -> None:
        named, books = self._named([key], None), self.table("books")
        given = {c: F.when(named, v).otherwise(F.col(c)) for c, v in (("label", label), ("note", note)) if v is not None}
        self.store.replace("books", books.withColumns(given))

    @_whole
    def remove(self, keys: list[str] | None = None, shelf: str | None = None) -> int:
        """Forget books. What they owned is not seen any more; ``compact`` drops it. Only catalogues are written."""
        gone = self.store.keep(self.table("books").filter(self._named(keys, shelf)).select("book_id"))
        with self.store.change():
            for name in ("segments", "sources", "centroids", "books"):
                self.store.replace(name, self.table(name).join(gone, "book_id", "left_anti"))
        return gone.count()

    def removal(self, keys: list[str] | None = None, shelf: str | None = None) -> DataFrame:
        """What ``remove`` would take: one row of books, bytes, chunks, vectors."""
        gone = self.table("books").filter(self._named(keys, shelf))
        b = gone.agg(F.count(F.lit(1)).alias("books"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
        of = lambda rows, n, name: rows.join(gone, "book_id", "left_semi").agg(F.coalesce(F.sum(n), F.lit(0)).alias(name))
        return b.join(F.broadcast(of(self.table("segments"), "chunk_count", "chunks"))).join(F.broadcast(of(self._standing(), "n_embedded", "vectors")))  # one row each

    @_whole
    def relocate(self, old: str, new: str) -> None:
        """Books and files below ``old`` are below ``new`` now."""
        books, sources = self.table("books"), self.table("sources")
        with self.store.change():
            self.store.replace("books", books.withColumns({c: C.relocated(F.col(c), old, new) for c in ("key", "shelf")}))
            self.store.replace("sources", sources.withColumn("path", C.relocated(F.col("path"), old, new)))

    def compact(self, stop: Callable[[], bool] | None = None, at_once: int = _MOVED_AT_ONCE) -> int:
        """Drop what no segment owns and close up the ids; how many ids were dead.

        Refused while carries wait, as they would be lost. The moves are written down first; then each table is prepared beside what
        is there, in steps of ``at_once`` old ids, each counted against what it should hold; at the end all tables change at once. A
        run that is cut short (or ended by ``stop``) changes nothing, and the next goes on with the steps that are left, unless the library has changed meanwhile.
        """
        if n := self.waiting().count():
            raise E.CarriesWait(f"{n} vectors of edited books wait: embed first")
        owned = ("chunks", "postings", "vectors", "failures")
        made_from = self._shape()
        done = {r["step"]: r["made_from"] for r in self.store.read("compaction").collect()}  # a row a step
        segments = self.table("segments")
        if done.get("plan") != made_from:
            plan = C.compaction_plan(segments.select("segment_id", "chunk_start", "chunk_count")).select("segment_id", "chunk_start", "chunk_count", "new_start")
            with self.store.change():
                self.store.discard(*[NEXT + t for t in owned])
                self.store.replace("moves", plan)
                self._step(made_from, "plan", 0, first=True)
            done = {"plan": made_from}
        moves = self.store.read("moves")
        live, last = moves.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)), F.coalesce(F.max(F.col("chunk_start") + F.col("chunk_count") - 1), F.lit(0))).first()
        for name in owned:
            whole = name in ("postings", "failures")  # of which a step reads all rows, wherever their ids lie
            for low in range(1, last + 1, max(1, last if whole else at_once)):
                step, high = f"{name} {low}", last if whole else low + at_once - 1
                if step in done:
                    continue
                if stop and stop():
                    return 0
                at = F.col("chunk_id") + (F.col("new_start") - F.col("chunk_start"))
                rows = self.store.read(name).filter(F.col("chunk_id").between(low, high)).join(moves.drop("chunk_count"), "segment_id")
                with self.store.change():
                    made = self.store.append(NEXT + name, rows.withColumn("chunk_id", at)).count()
                    if name == "chunks" and made != self._between(moves, low, high):
                        raise E.Damaged("chunks of live segments are not there", [step], [])
                    self._step(made_from, step, made)
        dead = (self.store.read("marks").first() or {"chunks": 0})["chunks"] - live
        with self.store.change():
            if self._shape() != made_from:
                raise E.Busy("the library changed during the compaction")
            for name in owned:
                self.store.take_over(name)
            self.store.replace("segments", segments.join(moves.select("segment_id", "new_start"), "segment_id", "left").withColumn("chunk_start", F.coalesce("new_start", F.lit(1))).select(*segments.columns))
            self.store.replace("progress", self.table("progress").groupBy("model", "segment_id").agg(F.max("n_embedded").alias("n_embedded")))
            self.store.replace("marks", self.store.read("marks").withColumn("chunks", F.lit(live)))
            self.store.discard("compaction", "moves", "carries")
        self.store.tidy()
        return dead

    def _shape(self) -> str:
        """What a compaction starts from."""
        listed = {t: self.store.parts().get(t) for t in ("chunks", "postings", "vectors", "failures", "segments", "models", "progress")}
        return hashlib.sha256(json.dumps(listed, sort_keys=True).encode()).hexdigest()

    def _between(self, moves: DataFrame, low: int, high: int) -> int:
        """How many live ids lie from ``low`` to ``high``."""
        n = F.least(F.col("chunk_start") + F.col("chunk_count") - 1, F.lit(high)) - F.greatest("chunk_start", F.lit(low)) + 1
        return moves.agg(F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0))).first()[0]

    def _step(self, made_from: str, step: str, rows: int, first: bool = False) -> None:
        row = self.spark.createDataFrame([(made_from, step, rows)], SCHEMAS["compaction"])
        (self.store.replace if first else self.store.append)("compaction", row)

    @_whole
    def drop_model(self, model: str) -> None:
        with self.store.change():
            for name in ("vectors", "centroids", "failures", "progress", "carries", "models"):
                self.store.replace(name, self.store.read(name).filter(F.col("model") != model))

    def forget_questions(self, before: int | None = None) -> None:
        """Forget what was asked: all, or what has a smaller id than ``before``."""
        asked = self.table("asked")
        self.store.replace("asked", asked.filter(F.lit(False) if before is None else F.col("id") >= before))

    def backup(self, path: str, files: bool = False) -> None:
        """Copies of all tables as of one commit (and, with ``files``, of the files that books came from), then a manifest with the digest of every part."""
        tables = {t: self.store.read(t) for t in SCHEMAS if self.store.has(t)}
        if files and (read := readers.contents(self.spark, [r["path"] for r in readers.stat(self.spark, self.table("sources").filter("mtime IS NOT NULL").select("path")).select("path").collect()])) is not None:
            tables["files"] = read
        readers.backup(self.spark, tables, path)

    @classmethod
    def restore(cls, spark: SparkSession, saved: str, path: str, moved: tuple[str, str] | None = None, **own: object) -> Engine:
        """An index from a backup, at a path that holds none. The backup is held against its manifest first. ``moved``: files below the one folder are below the other now."""
        engine = cls(spark, path, **own)
        if any(engine.store.has(t) for t in SCHEMAS):
            raise E.BadOption("an index is there already")
        states = readers.verify_backup(spark, saved).filter("state <> 'intact'").collect()  # what is wrong; a row a part
        if states:
            named = {s: sorted(r["part"] for r in states if r["state"] == s) for s in ("missing", "changed")}
            raise E.Damaged("the backup is not what was saved", named["missing"], named["changed"])
        with engine.store.change():
            for name, rows in readers.restore(spark, saved).items():
                if name in SCHEMAS:
                    engine.store.replace(name, rows)
            if moved:
                engine.relocate(*moved)
        return engine


def _pack(vectors: DataFrame) -> DataFrame:
    """Embeddings as whole numbers and a scale."""
    p = vectors.withColumn("p", V.packed(F.col("embedding")))
    return p.withColumn("data", F.col("p.data")).withColumn("scale", F.col("p.scale")).withColumn("embedding", F.lit(None).cast("array<float>")).drop("p")


def _fitted(query: list[float], dim: int) -> list[float]:
    """A question's vector for vectors of ``dim`` components: cut as they were, at unit length."""
    if len(query) < dim:
        raise E.WrongDimension(f"a question of {len(query)} dimensions for vectors of {dim}")
    if len(query) == dim:
        return list(query)
    head = [float(x) for x in query[:dim]]
    size = sum(x * x for x in head) ** 0.5
    return [x / size for x in head] if size else head


def _scorer(question: str, score: ScoreFn):  # noqa: ANN202
    """Scores of texts by an injected model, in Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(question, texts.fillna("").tolist()), dtype=float)

    return run


def _laid_out(chunks: list) -> tuple[int, bytes]:
    """Bytes of chunks of one book in order, from the first one's offset; they may overlap, and what lies between them is blank."""
    start, data = chunks[0]["byte_offset"], bytearray()
    for c in chunks:
        place = c["byte_offset"] - start
        data.extend(b" " * (place - len(data)))
        data[place : place + c["byte_length"]] = c["text"].encode()
    return start, bytes(data)


def _one_ranking(lists: list[DataFrame], want: int) -> DataFrame:
    """Several rankings as one (chunk_id, rank from 0)."""
    order = W.orderBy(F.desc("score"), "first_list", "chunk_id")  # at most ``want`` rows
    return R.fuse(lists, want).select("chunk_id", (F.row_number().over(order) - 1).alias("rank"))
