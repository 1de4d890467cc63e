"""Readers and sinks: files as books, question sets, tables of an index, backups."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import errors as E

SUFFIXES = ("txt",)


def walk(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length of all files below; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def acceptable(path: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    return suffix(path).isin(*suffixes)


def found_instead(files: DataFrame, most: int = 6) -> DataFrame:
    """The commonest suffixes, for when nothing fits."""
    return files.groupBy(suffix(F.col("path")).alias("suffix")).count().orderBy(F.desc("count"), "suffix").limit(most)


def read_books(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """key, content, size_bytes, mtime, content_sha256 of text files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(acceptable(F.col("path"), suffixes))
    return files.select(F.col("path").alias("key"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("content_sha256"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """q, a, kind of a JSON list of objects or pairs."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("v")).select(F.explode("v").alias("v"))
    pair, obj = F.from_json("v", "array<string>"), F.from_json("v", "q string, a string, kind string")
    is_pair = F.col("v").startswith("[")
    return whole.select(F.when(is_pair, pair[0]).otherwise(obj["q"]).alias("q"), F.when(is_pair, pair[1]).otherwise(obj["a"]).alias("a"), F.coalesce(F.when(~is_pair, obj["kind"]), F.lit("lookup")).alias("kind"))


def embed(chunks: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]], dim: int, beside: tuple[str, ...] = (), passage: str = "{}") -> DataFrame:
    """chunk_id, embedding of chunks (chunk_id, text) by an injected model; unreadable texts get a zero vector and a reason.

    ``beside`` are columns to keep; ``passage`` is how the model wants a passage put.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = b["text"].notna()
            made = iter(embed_fn([passage.replace("{}", t) for t in b.loc[ok, "text"]])) if ok.any() else iter(())
            rows = {"embedding": [next(made) if x else [0.0] * dim for x in ok], "failed": [None if x else "unreadable" for x in ok]}
            yield b.drop(columns="text").assign(**rows)

    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    names = ["chunk_id", *beside]
    return chunks.select(*names, "text").mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", embedding array<float>, failed string")


def _parents(paths: DataFrame) -> list[str]:
    """The folders of files, without those that lie in another one of them. Spark lists them on the driver."""
    found = sorted(r[0] for r in paths.select(F.regexp_replace("path", "/[^/]*$", "").alias("p")).distinct().collect())
    return [f for i, f in enumerate(found) if not any(f.startswith(g + "/") for g in found[:i])]


def _there(spark: SparkSession, path: str):  # noqa: ANN202
    """What a path is: None, or its status."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getFileStatus(at) if files.exists(at) else None


def stat(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """path, size_bytes, mtime of those files of ``paths`` that are there now; contents are not read."""
    there = [f for f in _parents(paths) if _there(spark, f) is not None]
    if not there:
        return spark.createDataFrame([], "path string, size_bytes bigint, mtime timestamp")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    return listed.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")).join(paths.select("path"), "path", "left_semi")


def books_of(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = SUFFIXES, chapters: bool = False) -> DataFrame:
    """Files grouped to books: key, title, shelf, path, size_bytes, mtime; contents are not read.

    A folder gives a book for each file of a wanted suffix below it; with ``chapters`` the folder is the book. A file that is named itself is taken if
    it has such a suffix or none. What is named twice counts once. Without any file it is refused, with the suffixes that are there.
    """
    out, seen = None, None
    for path in dict.fromkeys(p.rstrip("/") for p in paths):  # as many as were named
        status = _there(spark, path)
        if status is None:
            raise E.BadOption(f"{path} is not there")
        if chapters and not status.isDirectory():
            raise E.BadOption(f"{path} is no folder, so it has no chapters")
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        files = listed.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
        seen = files if seen is None else seen.unionByName(files)
        fit = acceptable(F.col("path"), suffixes)
        files = files.filter(fit if status.isDirectory() else fit | (suffix(F.col("path")) == ""))
        whole = status.getPath().toString()
        files = files.withColumn("key", F.lit(whole) if chapters else F.col("path"))
        out = files if out is None else out.unionByName(files)
    if out is None or not out.head(1):
        raise E.NothingToIngest(suffixes, [r["suffix"] for r in found_instead(seen).collect()] if seen is not None else [])
    name = F.element_at(F.split("key", "/"), -1)
    title = name if chapters else F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return out.dropDuplicates(["key", "path"]).select("key", title.alias("title"), F.regexp_replace("key", "/[^/]*$", "").alias("shelf"), "path", "size_bytes", "mtime")


def contents(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """path, text of files; bytes that are no UTF-8 are replaced. None without files."""
    if not paths:
        return None
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.expr("make_valid_utf8(cast(content AS string))").alias("text"))


def _digests(spark: SparkSession, path: str, read: bool = True) -> DataFrame:
    """part, length and, unless they are only to be listed, sha256 of every data file below a path, each hashed where it is read. What can't be read has no row."""
    root = _there(spark, path).getPath().toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true").load(path)
    part = F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("part")
    return files.select(part, "length", *([F.sha2("content", 256).alias("sha256")] if read else [])).filter(~F.col("part").startswith("manifest/"))


#: Rows in one file of a backup at most, so that each can be hashed in memory.
_ROWS_A_FILE = 1_000_000


def backup(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Copies of tables, then a manifest of the digests of their files; a copy without its manifest is not complete."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("maxRecordsPerFile", _ROWS_A_FILE).parquet(f"{path}/{name}")
    _digests(spark, path).withColumn("tables", F.lit(json.dumps(sorted(tables)))).write.parquet(f"{path}/manifest")


def verify_backup(spark: SparkSession, path: str) -> DataFrame:
    """part, state of every file of a backup against its manifest: intact, changed, missing or extra."""
    was = spark.read.parquet(f"{path}/manifest").select("part", F.col("length").alias("n"), F.col("sha256").alias("then"))
    j = was.join(_digests(spark, path, read=False), "part", "full").join(_digests(spark, path).drop("length"), "part", "left")
    same = (F.col("length") == F.col("n")) & F.col("sha256").eqNullSafe(F.col("then"))
    return j.select("part", F.when(F.col("length").isNull(), "missing").when(F.col("n").isNull(), "extra").when(same, "intact").otherwise("changed").alias("state"))


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    listed = json.loads(spark.read.parquet(f"{path}/manifest").select("tables").first()[0])
    return {name: spark.read.parquet(f"{path}/{name}") for name in listed}


def results_json(results: DataFrame) -> DataFrame:
    """One JSON text of each result row."""
    return results.select(F.to_json(F.struct("*")).alias("json"))
