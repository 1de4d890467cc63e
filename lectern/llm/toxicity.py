"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the mean of hashed vectors of the word and of its beginnings and ends, so unseen words
share what they are made of. Filters of widths 1, 2 and 3 run over the word sequence, the largest value of each filter
over the whole text is taken, and a linear layer gives a logit. All weights start at random; training is by Adam on
balanced batches of all labelled rows, of whose words each step sees a random part. The language of a
text is guessed by the letters that its words hold (three groups, and one for all other languages); for each group the
logit is shifted so that 0.5 is the threshold that best separates the labels of a held-back fifth of the rows. A
group with fewer than ``LEAST`` held-back rows of either label takes the threshold of all.

Scoring goes through all words of a text: what each filter makes of a word is worked out once for each distinct
word and added along the text, so long texts cost little and no prefix is taken.

Every labelled row of the training part is learned from, whole and however long. Rows are dealt to shards by the hash of
their id, a task each. In each of ``ROUNDS`` rounds every shard trains the same weights on its rows, and the changes of
the shards are averaged: of an embedding over the shards that met it. One shard trains in one round. A label that is too
rare for every shard has its rows in several. ``sample`` and ``fit`` fit a bounded sample in memory; scoring uses neither.

Defined results: a null or empty text has the bias alone; without both labels in the training part every score is
the share of the label 1 (0 if there are none); an empty table gives an empty result; repeated rows each have a result;
rows of ``labels`` with a null label are not used; of several labels of one document the larger counts, of several
texts of one id that of the smallest hash is learned from. Other columns may have any names.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import by_size, materialise, prepare, remainder, worker_state

BUCKETS, DIM = 1 << 15, 12
WIDTHS, FILTERS = (1, 2, 3), 8
#: Rows and characters of one shard, about, and how often the weights of several shards are averaged.
SHARD_ROWS, SHARD_CHARS, ROUNDS = 4000, 15_000_000, 3
#: Rows of the rarer label that each shard has at least.
SHARD_LEAST = 8
#: Bounds of ``sample``: rows of each label, characters in all and of one text.
SAMPLE = 2500
SAMPLE_CHARS = 30_000_000
SAMPLE_TEXT = SAMPLE_CHARS // 10
EPOCHS, BATCH, RATE, SEED = 5, 32, 0.05, 7
#: Share of a longer text's words that a training step sees; scoring sees all.
KEEP = 0.4
#: Characters of texts that are scored at once; a longer text is scored alone.
AT_ONCE = 1_000_000
_WORD = re.compile(r"[^\W\d_]+")
#: Words that a worker keeps the filter values of.
KEPT_WORDS = 200_000
#: Held-back rows of either label that a group of languages has a threshold of its own from.
LEAST = 40


def pieces(word: str) -> list[int]:
    """Hashed features of a word: itself, its beginnings of 3 to 7 and its ends of 3 to 5 letters."""
    marked = f"^{word}$"
    parts = {marked, *(marked[:k] for k in range(4, 9)), *(marked[-k:] for k in range(4, 7))}
    return [zlib.crc32(p.encode()) % BUCKETS for p in sorted(parts)]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def pieces_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The features of many words at once, as ``pieces`` gives them for each but in another order, and how many each word has."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    data = "".join([f"^{w}$" for w in words]).encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    letter = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # where each letter begins
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    first = np.cumsum(sizes) - sizes
    bounds = letter[np.r_[first, len(letter) - 1]].tolist()
    out, has = np.zeros((len(words), 9), dtype=np.int64), np.zeros((len(words), 9), dtype=bool)
    out[:, 0], has[:, 0] = [zlib.crc32(data[a:z]) for a, z in zip(bounds, bounds[1:], strict=False)], True
    for column, (k, back) in enumerate([(k, False) for k in range(4, 9)] + [(k, True) for k in range(4, 7)], 1):
        own = np.flatnonzero(sizes > k)
        start = first[own] + (sizes[own] - k if back else 0)
        at, end = letter[start], letter[start + k]
        crc = np.full(len(own), 0xFFFFFFFF, dtype=np.uint32)
        for j in range(int((end - at).max()) if len(own) else 0):
            some = slice(None) if j < k else np.flatnonzero(at + j < end)  # a letter is a byte at least
            crc[some] = _CRC[(crc[some] ^ raw[at[some] + j]) & 0xFF] ^ (crc[some] >> np.uint32(8))
        out[own, column], has[own, column] = crc ^ np.uint32(0xFFFFFFFF), True
    return out[has] % BUCKETS, has.sum(axis=1)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


# Letters that set groups of languages apart.
_GROUPS = ("ßüöä", "ñóíúá", "çèêàéù")


def group_of(text: str | None) -> int:
    """A group of languages, by the letters a text holds most of; the last for none of them."""
    low = (text or "").lower()
    found = [sum(map(low.count, g)) for g in _GROUPS]
    return int(np.argmax(found)) if any(found) else len(_GROUPS)


class Parts:
    """The features of numbered words, one after another in one array."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.sizes, self.start = flat, sizes, np.cumsum(sizes) - sizes

    def of(self, words: np.ndarray) -> np.ndarray:
        many = self.sizes[words]
        return self.flat[np.repeat(self.start[words] - (np.cumsum(many) - many), many) + np.arange(many.sum())]


class Net:
    """Weights of the classifier, with a forward pass by distinct words and a training pass."""

    def __init__(self, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.05, (BUCKETS, DIM))
        self.filters = [r.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS)
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS)
        self.off = np.zeros(1)
        self.shift = np.zeros(len(_GROUPS) + 1)
        self.constant: float | None = None
        self.forget()

    def embed(self, words: list[str]) -> np.ndarray:
        flat, sizes = pieces_of(words)
        return np.add.reduceat(self.table[flat], np.cumsum(sizes) - sizes) / sizes[:, None] if len(words) else np.zeros((0, DIM))

    def _ids(self, docs: list[list[str]]) -> np.ndarray:
        new = set().union(*docs).difference(self.seen)
        if len(self.seen) + len(new) > KEPT_WORDS:
            self.seen, self.values = {}, self.values[:0]
            new = set().union(*docs)
        if new:
            new = sorted(new)
            e = self.embed(new)
            v = np.concatenate([e @ f[j] for f in self.filters for j in range(len(f))], axis=1).astype(np.float32)
            self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new)), strict=True))
            self.values = np.concatenate([self.values, v])
        return np.fromiter((self.seen[w] for d in docs for w in d), dtype=np.int64)

    def logits(self, docs: list[list[str]]) -> np.ndarray:
        """Of whole texts, given as words."""
        ids = self._ids(docs)
        sizes = np.array([len(d) for d in docs])
        start = np.cumsum(sizes) - sizes
        pooled = np.zeros((len(docs), len(self.bias)), dtype=np.float32)
        column = 0
        for n, w in enumerate(WIDTHS):
            rows = np.flatnonzero(sizes >= w)
            block = self.values[:, column : column + w * FILTERS]
            column += w * FILTERS
            if not len(rows):
                continue
            along = block[ids, :FILTERS].copy()
            for j in range(1, w):
                along[: len(ids) - j] += block[ids[j:], j * FILTERS : (j + 1) * FILTERS]
            valid = np.ones(len(ids), dtype=bool)
            for j in range(1, w):  # a filter never runs over the end of its text
                ends = (start + sizes - j)[sizes >= j]
                valid[ends] = False
            along[~valid] = -np.inf
            pooled[rows, n * FILTERS : (n + 1) * FILTERS] = np.maximum(np.maximum.reduceat(along, start[rows])[:, :] + self.bias[n * FILTERS : (n + 1) * FILTERS], 0)
        return pooled @ self.out + self.off[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.logits([words_of(t) for t in texts])
        g = np.array([group_of(t) for t in texts], dtype=int)
        return 1 / (1 + np.exp(-np.clip(z - self.shift[g], -30, 30)))

    @property
    def weights(self) -> np.ndarray:
        """All weights as rows of ``DIM`` numbers: the embeddings, then the others."""
        rest = np.concatenate([x.ravel() for x in (*self.filters, self.bias, self.out, self.off)])
        return np.concatenate([self.table, np.r_[rest, np.zeros(-len(rest) % DIM)].reshape(-1, DIM)])

    @weights.setter
    def weights(self, rows: np.ndarray) -> None:
        self.table, rest = np.array(rows[:BUCKETS], dtype=np.float64), rows[BUCKETS:].ravel().astype(np.float64)
        for x in (*self.filters, self.bias, self.out, self.off):
            x[...] = rest[: x.size].reshape(x.shape)
            rest = rest[x.size :]
        self.forget()

    def train(self, texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED + 1, since: float = 0.0, until: float = 1.0) -> None:
        """Adam on batches with as many documents of either label, worked out for all documents of a batch at once.

        ``since`` and ``until`` say which part of the whole training this is, for the rate.
        """
        r = np.random.default_rng(seed)
        number: dict[str, int] = defaultdict(lambda: len(number))  # a new word takes the next number
        ids = [np.array([number[w] for w in words_of(t)], dtype=np.int32) for t in texts]
        parts = Parts(*pieces_of(list(number)))
        sides = [np.flatnonzero((labels == v) & np.array([len(d) > 0 for d in ids])) for v in (0, 1)]
        if not all(len(s) for s in sides):
            return
        weights = {"out": self.out, "off": self.off, "bias": self.bias, **{f"f{n}": f for n, f in enumerate(self.filters)}}
        state = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in weights.items()}
        moment, spread = np.zeros_like(self.table), np.zeros_like(self.table)
        steps, half = epochs * -(-max(map(len, sides)) // (BATCH // 2)), BATCH // 2
        order: list[list[int]] = [[], []]
        for t in range(1, steps + 1):
            rows = []
            for side, left in zip(sides, order, strict=True):  # every document once before any comes again
                while len(left) < half:
                    left += r.permutation(side).tolist()
                rows += left[:half]
                del left[:half]
            seen = [d if len(d) < 8 else d[r.random(len(d)) < KEEP] for d in (ids[i] for i in rows)]  # word dropout
            some = [n for n, d in enumerate(seen) if len(d)]
            grads, touched, slopes = self._gradients([seen[n] for n in some], labels[rows][some], parts)
            rate = RATE * (1 - since - (until - since) * (t - 1) / steps)
            fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
            for name, x in weights.items():
                m, v = state[name]
                g = grads[name] + 1e-4 * x
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= rate * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
            moment[touched] += 0.1 * (slopes - moment[touched])  # the embeddings: only what was looked at
            spread[touched] += 0.001 * (slopes * slopes - spread[touched])
            self.table[touched] -= rate * (moment[touched] / fix1) / (np.sqrt(spread[touched] / fix2) + 1e-8)
        self.forget()

    def forget(self) -> None:
        """Drop the filter values of words met so far."""
        self.seen, self.values = {}, np.zeros((0, sum(WIDTHS) * FILTERS), dtype=np.float32)

    def _gradients(self, docs: list[np.ndarray], labels: np.ndarray, parts: Parts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Mean gradients of the loss over documents of at least one word: of the weights, and of the rows of the table that were looked at."""
        sizes = np.array([len(d) for d in docs])
        start, words, owner = np.cumsum(sizes) - sizes, np.concatenate(docs), np.repeat(np.arange(len(docs)), sizes)
        unique, at = np.unique(words, return_inverse=True)
        many = parts.sizes[unique]
        e = np.add.reduceat(self.table[parts.of(unique)], np.cumsum(many) - many) / many[:, None]
        pooled, where = np.zeros((len(docs), len(self.bias))), np.zeros((len(docs), len(self.bias)), dtype=np.int64)
        for n, f in enumerate(self.filters):
            w, along = len(f), np.zeros((FILTERS, len(words)), dtype=np.float32)
            for j in range(w):
                along[:, : len(words) - j] += (f[j].T @ e.T).astype(np.float32)[:, at[j:]]
            for j in range(1, w):  # a filter never runs over the end of its text
                along[:, (start + sizes - j)[sizes >= j]] = -np.inf
            best = np.maximum.reduceat(along, start, axis=1)
            filter_of, place = np.nonzero(along == best[:, owner])
            where[owner[place], n * FILTERS + filter_of] = place
            pooled[:, n * FILTERS : (n + 1) * FILTERS] = np.maximum(best.T + self.bias[n * FILTERS : (n + 1) * FILTERS], 0)
        err = (1 / (1 + np.exp(-np.clip(pooled @ self.out + self.off[0], -30, 30))) - labels) / len(docs)
        back = err[:, None] * self.out * (pooled > 0)
        grads = {"out": err @ pooled, "off": np.array([err.sum()]), "bias": back.sum(axis=0)}
        looked, flows = [], []
        for n, f in enumerate(self.filters):
            g = grads[f"f{n}"] = np.zeros_like(f)
            own = back[:, n * FILTERS : (n + 1) * FILTERS]
            doc, k = np.nonzero(own)  # what did not reach the output gives nothing back
            for j in range(len(f)):
                word = at[where[doc, n * FILTERS + k] + j]
                np.add.at(g[j].T, k, e[word] * own[doc, k][:, None])
                looked.append(word)
                flows.append(own[doc, k][:, None] * f[j].T[k])
        word, row = np.unique(np.concatenate(looked), return_inverse=True)
        slope = np.zeros((len(word), DIM))
        np.add.at(slope, row, np.concatenate(flows))
        rows, row = np.unique(parts.of(unique[word]), return_inverse=True)
        slopes = np.zeros((len(rows), DIM))
        np.add.at(slopes, row, np.repeat(slope / many[word][:, None], many[word], axis=0))
        return grads, rows, slopes

    def calibrate(self, texts: list[str], labels: np.ndarray) -> None:
        """For each group the shift that separates the held-back labels best; groups with few labels take that of all."""
        z = np.concatenate([self.logits([words_of(t) for t in texts[part]]) for part in by_size(texts, AT_ONCE)])
        g = np.array([group_of(t) for t in texts])
        self.forget()
        whole = _best_cut(z, labels)
        for i in range(len(self.shift)):
            own = g == i
            enough = min((labels[own] == 1).sum(), (labels[own] == 0).sum()) >= LEAST
            self.shift[i] = _best_cut(z[own], labels[own]) if enough else whole


def _best_cut(z: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest gap between logits among the cuts of best accuracy."""
    if not len(z) or len(set(labels.tolist())) < 2:
        return 0.0
    order = np.argsort(z, kind="stable")
    z, y = z[order], labels[order]
    quality = np.r_[0, np.cumsum(y == 0)] - np.r_[0, np.cumsum(y == 1)]
    edges = np.r_[z[0] - 1, z, z[-1] + 1]
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    lo, hi = edges[best[0]], edges[best[-1] + 1]
    return float((lo + hi) / 2)


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS) -> Net:
    """The classifier of (text, label) rows; every fifth row is held back for the thresholds."""
    net = Net()
    labels = np.array([y for _, y in rows])
    if not len(rows) or len(set(labels.tolist())) < 2:
        net.constant = float(labels.mean()) if len(rows) else 0.0
        return net
    back = np.arange(len(rows)) % 5 == 4
    if min((labels[~back] == 0).sum(), (labels[~back] == 1).sum()) == 0:
        back[:] = False
    net.train([t for (t, _), b in zip(rows, back, strict=True) if not b], labels[~back], epochs)
    held = [t for (t, _), b in zip(rows, back, strict=True) if b]
    net.calibrate(held, labels[back]) if held else None
    return net


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: int, size: int) -> list[tuple[str, int]]:
    """At most ``size`` labelled training rows of each label: those of smallest hash of the id, up to ``SAMPLE_CHARS`` in all.

    Texts of over ``SAMPLE_TEXT`` characters are scored like all others but take no part in the fit, so none uses up the sample.
    """
    marks = labels.filter(F.col(label_col).isin(0, 1) & (remainder(id_col, fold) != 0)).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    chosen = None
    for y in (0, 1):
        part = marks.filter(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(size)
        chosen = part if chosen is None else chosen.union(part)
    chosen = F.broadcast(chosen)  # 2 * size rows of an id and a label
    text = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.length("t") <= SAMPLE_TEXT)
    one = text.join(chosen, "i").groupBy("i").agg(F.min_by(F.struct("t", "y"), F.xxhash64("t")).alias("r")).select("i", "r.*")
    order = W.orderBy(F.xxhash64("i"), "i")  # of at most 2 * size rows
    rows = one.withColumn("so_far", F.sum(F.length("t")).over(order)).filter(F.col("so_far") <= SAMPLE_CHARS).orderBy(F.xxhash64("i"), "i").collect()
    return [(r["t"], r["y"]) for r in rows]


#: Bins of one unit of a logit, for the thresholds.
_BINS = 64
#: Rows of weights that are averaged in one group.
_BLOCK = 512


def _binned_cut(bins: pd.DataFrame) -> float:
    """``_best_cut`` between bins (lo, hi, n0, n1) of logits."""
    b = bins.sort_values("lo")
    if not len(b) or not b["n0"].sum() or not b["n1"].sum():
        return 0.0
    quality = np.r_[0, np.cumsum(b["n0"].to_numpy() - b["n1"].to_numpy())]
    below, above = np.r_[b["lo"].iloc[0] - 1, b["hi"]], np.r_[b["lo"], b["hi"].iloc[-1] + 1]
    best = np.flatnonzero(quality == quality.max())
    return float((below[best[0]] + above[best[-1]]) / 2)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fold: int) -> DataFrame:
    """i, t, y, back of every labelled row of the training part; ``back`` marks the fifth that is held back."""
    marks = labels.filter(F.col(label_col).isin(0, 1) & (remainder(id_col, fold) != 0)).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col)).cast("int").alias("y"))
    text = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    one = text.join(marks, "i").groupBy("i").agg(F.min_by(F.struct("t", "y"), F.xxhash64("t")).alias("r")).select("i", "r.*")
    return one.withColumn("back", F.pmod(F.xxhash64("i", F.lit("back")), F.lit(5)) == 4)


def _round(rows: DataFrame, net: Net, shards: int, epochs: int, since: float, until: float) -> np.ndarray:
    """The weights after every shard of ``rows`` (i, t, y, shard) has trained those of ``net`` and the changes are averaged."""
    sent = rows.sparkSession.sparkContext.broadcast(net.weights)
    at = round(since * ROUNDS)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own = pdf.sort_values(["h", "i"]), Net()
        own.weights = sent.value
        own.train(pdf["t"].tolist(), pdf["y"].to_numpy(), epochs, SEED + 1 + 1000 * at + int(pdf["shard"].iloc[0]), since, until)
        change = (own.weights - sent.value).astype(np.float32)
        return pd.DataFrame([(b, change[b * _BLOCK : (b + 1) * _BLOCK].tobytes()) for b in range(-(-len(change) // _BLOCK))], columns=["block", "change"])

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        total, met = 0.0, 0
        for c in sorted(pdf["change"]):  # in one order, so that reruns agree
            c = np.frombuffer(c, dtype=np.float32).reshape(-1, DIM).astype(np.float64)
            total, met = total + c, met + (c != 0).any(axis=1)
        return pd.DataFrame([(pdf["block"].iloc[0], (total / np.maximum(met, 1)[:, None]).tobytes())], columns=["block", "change"])

    schema = "block int, change binary"
    changes = rows.withColumn("h", F.xxhash64("i")).repartition(2 * shards, "shard").groupBy("shard").applyInPandas(train, schema)
    got = changes.groupBy("block").applyInPandas(mean, schema).collect()  # as many bytes as the net has
    whole = np.concatenate([np.frombuffer(r["change"]).reshape(-1, DIM) for r in sorted(got, key=lambda r: r["block"])])
    sent.destroy()
    return net.weights + whole


def _calibrated(held: DataFrame, net: Net) -> np.ndarray:
    """The shift of each group, from counts of the logits of all held-back rows (t, y) by bins."""
    sent = held.sparkSession.sparkContext.broadcast(net)

    def logits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = sent.value
        for b in batches:
            texts = b["t"].tolist()
            for part in by_size(texts, AT_ONCE):
                yield pd.DataFrame({"z": net.logits([words_of(t) for t in texts[part]]).astype(float), "g": [group_of(t) for t in texts[part]], "y": b["y"].to_numpy()[part]})

    z = held.select("t", "y").mapInPandas(logits, "z double, g int, y int")
    bins = z.groupBy("g", F.floor(F.greatest(F.least("z", F.lit(64.0)), F.lit(-64.0)) * _BINS).alias("bin"))
    got = bins.agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    got = pd.DataFrame([r.asDict() for r in got.collect()], columns=["g", "bin", "lo", "hi", "n0", "n1"])  # at most 128 * _BINS a group
    whole = _binned_cut(got.groupby("bin", as_index=False).agg({"lo": "min", "hi": "max", "n0": "sum", "n1": "sum"}))
    own = {g: b for g, b in got.groupby("g") if min(b["n0"].sum(), b["n1"].sum()) >= LEAST}
    return np.array([_binned_cut(own[g]) if g in own else whole for g in range(len(_GROUPS) + 1)])


def fit_all(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 5) -> Net:
    """The classifier of every labelled row of the training part, trained in shards."""
    prepare(docs.sparkSession)
    rows, net = materialise(labelled(docs, labels, id_col, text_col, label_col, fold)), Net()
    counts = rows.groupBy("back", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("chars")).collect()  # at most 4 rows
    sides = [sum(r["n"] for r in counts if r["y"] == y) for y in (0, 1)]
    if not all(sides):
        net.constant = sides[1] / sum(sides) if sum(sides) else 0.0
        return net
    kept = [r for r in counts if not r["back"]]
    if {r["y"] for r in kept} != {0, 1}:  # too few to hold any back
        rows, kept = rows.withColumn("back", F.lit(False)), counts
    size = {y: sum(r["n"] for r in kept if r["y"] == y) for y in (0, 1)}
    shards = max(1, -(-sum(size.values()) // SHARD_ROWS), -(-sum(r["chars"] for r in kept) // SHARD_CHARS))
    times = {y: min(shards, -(-SHARD_LEAST * shards // n)) for y, n in size.items()}  # shards that a row of the label is in
    first, copies = F.pmod(F.xxhash64("i"), F.lit(shards)), F.when(F.col("y") == 1, times[1]).otherwise(times[0])
    dealt = rows.filter("not back").select("i", "t", "y", F.explode(F.sequence(first, first + copies - 1)).alias("s")).select("i", "t", "y", F.pmod("s", F.lit(shards)).alias("shard"))
    for n in range(ROUNDS if shards > 1 else 1):
        net.weights = _round(dealt, net, shards, *((1, n / ROUNDS, (n + 1) / ROUNDS) if shards > 1 else (EPOCHS, 0.0, 1.0)))
    if len(kept) < len(counts):
        net.shift = _calibrated(rows.filter("back"), net)
    return net


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: int = 5, net: Net | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted. Learns from ids whose crc32 modulo ``fold`` is not 0."""
    spark = docs.sparkSession
    prepare(spark)
    net = net or fit_all(docs, labels, id_col, text_col, label_col, fold)
    sent, key = spark.sparkContext.broadcast(net), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = worker_state(key, lambda: sent.value)  # with the words it has met
        for texts in batches:
            held = texts.tolist()
            yield pd.Series(np.concatenate([net.scores(held[part]) for part in by_size(held, AT_ONCE)]) if held else [], dtype=float)

    scored = docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, fold) == 0).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
