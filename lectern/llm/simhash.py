"""SimHash near-duplicates, linked through a table of distances to pivots.

A fingerprint has 64 bits: bit i is set if more than half of a text's shingle hashes have it set. For each distinct
fingerprint the Hamming distances to ``PIVOTS`` reference fingerprints are computed. Two fingerprints within r bits
differ by at most r in every such coordinate: pairs with a larger difference are discarded, and what survives is
verified by the distance itself. ``pruning`` counts how many pairs go which way.

Candidates come from the same table, so that not all pairs meet. The references are an anchor, for each of 8 blocks of
8 bits 8 patterns that differ from the anchor within that block only, and a few that differ from it everywhere. The
coordinates of a block's references less the anchor's depend on that block alone. Two differing bits lie in at most
two of the four quarters of a fingerprint, so the coordinates of two quarters agree: grouping by each choice of two
(6 keys) brings every pair within two bits together. Only groups of over ``GROUP`` fingerprints are dealt anew, by the
coordinates of two more blocks (again 6 choices), and then hold at most 2^16: the size of a group is bounded whatever
the corpus. Of a batch of groups only its classes are handed on, never all its pairs. Copies of a fingerprint
collapse before anything is compared.

Defined results: a null text is an empty text; texts without words have fingerprint zero and link like others;
fewer words than a shingle make one shingle of the whole sequence; a very long text is read in pieces; an empty table
gives an empty result; repeated rows each have a result; documents with a null id take part, and a component of such
documents alone has a null id. Other columns than those named are not read, and may have any names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm._common import fresh, materialise, prepare

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 8
#: Fingerprints of one group from which it is dealt anew by more coordinates.
GROUP = 1024

#: The anchor, any fixed number.
_ANCHOR = 0x9E3779B97F4A7C15
#: Patterns within a block of 8 bits. As rows of a matrix over the whole numbers, less half their weight, they are independent, so their coordinates tell all blocks apart.
_PATTERNS = (0x01, 0x03, 0x07, 0x0F, 0x1F, 0x3F, 0x7F, 0xFF)
#: Patterns over all blocks: every second bit, every second pair of bits, and so on.
_WIDE = tuple(sum(1 << i for i in range(64) if i >> j & 1) for j in range(6))
PIVOTS = np.array([_ANCHOR] + [_ANCHOR ^ (p << (8 * b)) for b in range(BLOCKS) for p in _PATTERNS] + [_ANCHOR ^ w for w in _WIDE], dtype=np.uint64)
#: For each choice of two quarters, their blocks and the blocks that are left.
_CHOICES = [(tuple(b for q in two for b in (2 * q, 2 * q + 1)), tuple(b for b in range(BLOCKS) if b // 2 not in two)) for two in itertools.combinations(range(4), 2)]
_SPACE, _PIECE = re.compile(rb"[\t-\r ]"), 1 << 20


def _word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, of a piece of it at a time."""
    a = 0
    while a < len(data):
        end = _SPACE.search(data, min(len(data), a + _PIECE))
        z = end.start() if end else len(data)
        yield data[a:z].split()
        a = z


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text."""
    import xxhash

    hashed, n, ones, held = xxhash.xxh64_intdigest, 0, np.zeros(64, dtype=np.int64), []
    for words in _word_runs(text.encode().lower() if text else b""):  # of bytes: A-Z alone, and ASCII white space alone
        words = held + words
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        h = np.fromiter((hashed(s, seed) for s in joined), dtype=np.uint64)
        n += len(h)
        for i in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        held = words[len(words) - (shingle - 1) :] if len(words) >= shingle else words
    if not n:
        return hashed(b" ".join(held), seed) if held else 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed 64-bit numbers."""
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to each pivot."""
    return np.stack([np.bitwise_count(fps ^ p) for p in PIVOTS], axis=1) if len(fps) else np.zeros((0, len(PIVOTS)), dtype=np.uint8)


def _marks(fps: np.ndarray) -> np.ndarray:
    """For each block the coordinates of its pivots, less the anchor's, as one number."""
    table = pivot_table(fps)[:, : 1 + BLOCKS * len(_PATTERNS)].astype(np.int64)
    rest = (table[:, 1:] - table[:, :1] + 8).reshape(-1, BLOCKS, len(_PATTERNS)).astype(np.uint64)
    mark = np.zeros((len(fps), BLOCKS), dtype=np.uint64)
    for j in range(len(_PATTERNS)):  # each coordinate lies in 0..16: five bits
        mark |= rest[:, :, j] << np.uint64(5 * j)
    return mark


def _key(mark: np.ndarray, blocks: tuple[int, ...], salt: int) -> np.ndarray:
    """A 64-bit hash of the coordinates of some blocks."""
    key = np.full(len(mark), salt * 0x5851F42D4C957F2D & (2**64 - 1), dtype=np.uint64)
    for b in blocks:
        key = (key ^ mark[:, b]) * np.uint64(0x9E3779B185EBCA87)
        key ^= key >> np.uint64(29)
    return key


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = batch["fp"].to_numpy(np.int64).view(np.uint64)
        mark = _marks(fps)
        for n, (blocks, _) in enumerate(_CHOICES):
            yield pd.DataFrame({"key": _key(mark, blocks, n + 1).view(np.int64), "choice": n, "fp": fps.view(np.int64)})


def _keyed_again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for n, part in batch.groupby("choice"):
            fps = part["fp"].to_numpy(np.int64).view(np.uint64)
            mark, (blocks, left) = _marks(fps), _CHOICES[n]
            for m, more in enumerate(itertools.combinations(left, len(left) - RADIUS)):
                yield pd.DataFrame({"key": _key(mark, (*blocks, *more), 7 + 6 * n + m).view(np.int64), "fp": fps.view(np.int64)})


def near_classes(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, tuple[int, int, int]]:
    """For each row the first row it is linked to, through rows of its group within ``radius`` bits; ``group`` is sorted.

    Also how many pairs the groups hold, how many of them the coordinates discard, and how many are verified as near.
    """
    table = pivot_table(fps).astype(np.int16)
    order = np.lexsort((table[:, 0], group))
    table, fps, group = table[order], fps[order], group[order]
    lead, root = table[:, 0], np.arange(len(fps))
    sizes = np.unique(group, return_counts=True)[1].astype(np.int64)
    compared = near = 0
    i, step = np.arange(len(fps)), 0
    while len(i):  # neighbours in the order of the anchor's coordinate, one place farther each time
        step += 1
        i = i[i + step < len(fps)]
        i = i[(group[i] == group[i + step]) & (lead[i + step] - lead[i] <= radius)]
        a, b = i, i + step
        for p in range(1, table.shape[1], 10):  # discard by the largest coordinate difference, a few pivots at a time
            if not len(a):
                break
            close = (np.abs(table[a, p : p + 10] - table[b, p : p + 10]) <= radius).all(axis=1)
            a, b = a[close], b[close]
        compared += len(a)
        close = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        a, b = a[close], b[close]
        near += len(a)
        while len(a):  # join the classes of all pairs at once; until none is left that differs
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    pairs = int((sizes * (sizes - 1) // 2).sum())
    out = np.empty(len(fps), dtype=np.int64)
    out[order] = order[root]
    return out, (pairs, pairs - compared, near)


def _groups(batches: Iterator[pd.DataFrame], at_once: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints and their groups, of about ``at_once`` fingerprints or one group."""
    for batch in batches:
        held, size = [], 0
        for fps in batch["fps"]:
            held.append(np.asarray(fps, dtype=np.int64).view(np.uint64))
            size += len(fps)
            if size >= at_once:
                yield np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
                held, size = [], 0
        if held:
            yield np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for fps, group in _groups(batches):
        first, _ = near_classes(fps, group)
        other = np.flatnonzero(first != np.arange(len(fps)))
        x, y = fps[other].view(np.int64), fps[first[other]].view(np.int64)
        yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for fps, group in _groups(batches):
        yield pd.DataFrame([near_classes(fps, group)[1]], columns=["pairs", "discarded", "near"])


def groups(fps: DataFrame, most: int = GROUP) -> DataFrame:
    """Arrays ``fps`` of at most 2^16 distinct fingerprints: every pair of ``fp`` within two bits is in one of them."""
    keyed = materialise(fps.mapInPandas(_keyed, "key bigint, choice int, fp bigint"))
    sizes = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    few = keyed.join(sizes.filter(F.col("n") <= most).select("key"), "key", "left_semi").select("key", "fp")
    large = sizes.filter(F.col("n") > most).select("key")
    if large.head(1):
        again = keyed.join(large, "key", "left_semi").select("choice", "fp").mapInPandas(_keyed_again, "key bigint, fp bigint")
        few = few.unionByName(again)
    return few.groupBy("key").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")


def links(fps: DataFrame, most: int = GROUP) -> DataFrame:
    """Links (a, b), a < b, that connect the same distinct fingerprints ``fp`` as all links within two bits do."""
    return groups(fps, most).mapInPandas(_linked, "a bigint, b bigint").distinct()


def pruning(fps: DataFrame, most: int = GROUP) -> DataFrame:
    """One row: pairs that meet in groups, those that the pivot coordinates discard, and those verified as near."""
    found = groups(fps, most).mapInPandas(_counted, "pairs bigint, discarded bigint, near bigint")
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "discarded", "near")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the smallest node that it reaches.

    Alternating large and small stars: every round sends all nodes closer to the smallest of their component, in a
    number of rounds that grows with the logarithm of the longest path. Each round is written to the shared folder.
    """
    here = materialise(edges.select("a", "b"))
    while True:
        both = here.union(here.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node go to the smallest in its reach
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its neighbours below it go to the smallest of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        new = materialise(small)
        changed = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() != here.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        here = new
        if not changed:
            break
    nodes = here.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(here.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def rooted_by(fps: DataFrame, most: int = GROUP) -> DataFrame:
    """``fps`` (one row each distinct ``fp``) with ``root``, the same for all fingerprints of a component."""
    roots = components(links(fps.select("fp"), most))
    return fps.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp")).drop("node", "component")


def fingerprint_components(slim: DataFrame) -> DataFrame:
    """(fp, component_id) for each distinct ``fp`` of ``slim`` (doc_id, fp): the smallest document reachable."""
    per = rooted_by(materialise(slim.groupBy("fp").agg(F.min("doc_id").alias("least"))))
    best = per.groupBy("root").agg(F.min("least").alias("component_id"))
    return per.join(best, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id."""
    prepare(docs.sparkSession)
    slim = materialise(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")))
    return slim.join(fingerprint_components(slim), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each component: of its rows with an id the one of the smallest, else one without.

    Of several such rows that of the smallest hash of all columns stays. The rows are written once with a number of
    their own, slim keys of it decide, and the rows are shuffled once, by that number: no group of copies is hot.
    """
    prepare(docs.sparkSession)
    row, tag, fp = fresh(docs, "row_number"), fresh(docs, "row_tag"), fresh(docs, "row_fp")
    whole = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])
    held = materialise(docs.withColumns({tag: whole, fp: fingerprints(F.col(text_col))}).withColumn(row, F.monotonically_increasing_id()))
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(tag).alias("tag"), F.col(row).alias("row"))
    per = materialise(held.groupBy(F.col(fp).alias("fp")).agg(F.min(place).alias("first")))
    chosen = rooted_by(per).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return held.join(chosen.hint("shuffle_hash"), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
