"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is an embedding of the word itself joined with the mean embedding
of its character trigrams (both hashed, so no vocabulary is kept). One value of
either embedding starts from how much more often toxic training documents hold
the word or trigram, one document left out; the rest starts at random. Two gated
recurrent layers read a window of words in both directions, attention weighs
their states, and a logistic unit scores the window. Texts are scored whole:
windows overlap by half, and a document's score is that of its worst window.

Only documents carry labels, so training looks for the windows that earn them:
it takes each toxic document's highest window, at first by its most telling word
and then by the network's score, against the highest and some random windows of
clean documents. It fits on a
bounded sample, ``TRAIN_DOCS`` labelled rows of either class in hash order;
scoring is one Arrow pass over every text.

Null, empty and blank texts are one empty window. Null labels are left out;
repeated rows score alike. Without labelled rows every score is 0.5. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.words import mix, slabs, span_hashes, tidy, word_spans

WINDOW, STEP = 24, 12
WORD_ROWS, CHAR_ROWS = 1 << 16, 1 << 13
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 6, 10, 8, 8
#: Labelled rows of either class that the network is fitted on.
TRAIN_DOCS = 1500
#: Bytes of all training texts together, in the same order.
TRAIN_BYTES = 64 << 20
EPOCHS, BATCH, RATE, SEED = 5, 256, 0.01, 3
#: Embeddings move slower than the rest, by this factor.
EMBEDDING_RATE = 0.6
#: Small samples are read more often, up to about so many batches.
LEAST_BATCHES, MOST_EPOCHS = 250, 60
#: Windows of a clean document per epoch, of the highest and at random; share of words hidden in training.
CLEAN_WINDOWS, HIDDEN_WORDS = 6, 0.6
PREDICT_AT = 0.7
_CHUNK, _SLAB = 4096, 8 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tanh(x: np.ndarray) -> np.ndarray:
    return 2 / (1 + np.exp(-2 * np.clip(x, -15, 15))) - 1


class Inputs:
    """Distinct words of some texts (row numbers into the embeddings) and the windows over them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        start, end, row = word_spans(data, offsets)
        codes, distinct = pd.factorize(span_hashes(data, start, end, fold=True))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        self.words = (distinct >> np.uint64(40)).astype(np.int64) % WORD_ROWS
        s, e = start[first], end[first]
        self.sizes = e - s
        self.begins = np.cumsum(self.sizes) - self.sizes
        at = np.arange(self.sizes.sum()) + np.repeat(s - self.begins, self.sizes)
        char = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint64) if len(at) else np.empty(0, np.uint64)
        body = char[at] if len(at) else char
        before, after = np.append(np.uint64(2), body[:-1]), np.append(body[1:], np.uint64(3))
        before[self.begins] = 2
        after[self.begins + self.sizes - 1] = 3
        self.chars = (mix((before << np.uint64(16)) | (body << np.uint64(8)) | after) % np.uint64(CHAR_ROWS)).astype(np.int64) if len(at) else at
        # Windows: one at least per text, the last one flush with its end.
        n = np.bincount(row, minlength=len(offsets) - 1)
        count = np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STEP) + 1)
        self.doc = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(self.doc)) - np.repeat(np.cumsum(count) - count, count)
        head = np.minimum(k * STEP, np.maximum(n[self.doc] - WINDOW, 0)) + (np.cumsum(n) - n)[self.doc]
        self.head, self.length = head, np.minimum(n[self.doc], WINDOW)
        self.rows = row
        self.codes, self.doc_start = np.append(codes, len(distinct)), np.cumsum(count) - count

    def window(self, which: np.ndarray) -> np.ndarray:
        """Distinct word numbers per window and place; the number after the last stands for none."""
        place = np.arange(WINDOW)
        at = np.where(place < self.length[which, None], self.head[which, None] + place, len(self.codes) - 1)
        return self.codes[at]


class Network:
    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": draw(WORD_ROWS, WORD_DIM, scale=0.1), "char": draw(CHAR_ROWS, CHAR_DIM, scale=0.3),
                  "Wa": draw(2 * h, ATTEND, scale=0.3), "ba": np.zeros(ATTEND, np.float32), "v": draw(ATTEND, scale=0.3),
                  "w": draw(2 * h, scale=0.3), "b": np.full(1, -1.0, np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": draw(d, 3 * h, scale=d ** -0.5), f"U{side}": draw(h, 3 * h, scale=h ** -0.5), f"c{side}": np.zeros(3 * h, np.float32)}

    def embed(self, words: np.ndarray, chars: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Inputs of distinct words, with a row of zeros behind them."""
        x = np.zeros((len(words) + 1, WORD_DIM + CHAR_DIM), self.p["word"].dtype)
        if len(words):
            x[:-1, :WORD_DIM] = self.p["word"][words]
            for lo in range(0, len(words), 1 << 15):
                hi = min(lo + (1 << 15), len(words))
                a, b = begins[lo], begins[hi - 1] + sizes[hi - 1]
                x[lo:hi, WORD_DIM:] = np.add.reduceat(self.p["char"][chars[a:b]], begins[lo:hi] - a) / sizes[lo:hi, None]
        return x

    def _read(self, side: str, gates: np.ndarray, codes: np.ndarray, real: np.ndarray, keep: list | None) -> np.ndarray:
        """States at every place, read forward or backward; shape (places, windows, HIDDEN)."""
        u = self.p[f"U{side}"]
        h, states = np.zeros((len(codes), HIDDEN), u.dtype), np.empty((WINDOW, len(codes), HIDDEN), u.dtype)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            g, m = gates[codes[:, t]], real[:, t, None]
            hu = h @ u
            zr = _sigmoid(g[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = _tanh(g[:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * HIDDEN:], m))
            h = h + m * ((1 - z) * (n - h))
            states[t] = h
        return states

    def forward(self, x: np.ndarray, codes: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        real = (np.arange(WINDOW) < length[:, None]).astype(x.dtype)
        lists = {s: [] if keep is not None else None for s in "fb"}
        states = np.concatenate([self._read(s, x @ self.p[f"W{s}"] + self.p[f"c{s}"], codes, real, lists[s]) for s in "fb"], axis=2)
        a = _tanh(states @ self.p["Wa"] + self.p["ba"])
        score = np.where(real.T > 0, a @ self.p["v"], -1e9)
        alpha = np.exp(score - score.max(axis=0)) * real.T
        alpha /= np.maximum(alpha.sum(axis=0), 1e-9)
        pooled = (alpha[..., None] * states).sum(axis=0)
        if keep is not None:
            keep |= {"lists": lists, "states": states, "a": a, "alpha": alpha, "pooled": pooled, "real": real}
        return pooled @ self.p["w"] + self.p["b"]

    def gradients(self, x: np.ndarray, codes: np.ndarray, length: np.ndarray, want: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean logistic loss, and the one of ``x``."""
        k: dict = {}
        logit = self.forward(x, codes, length, k)
        d = ((_sigmoid(logit) - want) / len(want)).astype(x.dtype)
        states, a, alpha = k["states"], k["a"], k["alpha"]
        g = {"w": k["pooled"].T @ d, "b": d.sum(keepdims=True)}
        dp = d[:, None] * self.p["w"]
        dalpha = (states * dp).sum(axis=2)
        dscore = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["v"] = (a * dscore[..., None]).sum(axis=(0, 1))
        da = dscore[..., None] * self.p["v"] * (1 - a * a)
        g["Wa"], g["ba"] = np.einsum("tnh,tna->ha", states, da), da.sum(axis=(0, 1))
        ds = alpha[..., None] * dp + da @ self.p["Wa"].T
        dx = np.zeros_like(x)
        for i, side in enumerate("fb"):
            u, dh = self.p[f"U{side}"], np.zeros((len(codes), HIDDEN), x.dtype)
            du, own = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), x.dtype)
            for t, h, z, r, n, hn, m in reversed(k["lists"][side]):
                total = dh + ds[t][:, i * HIDDEN:(i + 1) * HIDDEN]
                inner = total * m
                dn = inner * (1 - z) * (1 - n * n)
                dz, dr = inner * (h - n) * z * (1 - z), dn * hn * r * (1 - r)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                du += h.T @ dg
                dh = total * (1 - m) + inner * z + dg @ u.T
                np.add.at(own, codes[:, t], np.concatenate([dz, dr, dn], axis=1))
            own[-1] *= 0
            g[f"U{side}"], g[f"W{side}"], g[f"c{side}"] = du, x.T @ own, own.sum(axis=0)
            dx += own @ self.p[f"W{side}"].T
        return g, dx

    def logits(self, inputs: Inputs, which: np.ndarray | None = None) -> np.ndarray:
        x = self.embed(inputs.words, inputs.chars, inputs.begins, inputs.sizes)
        which = np.arange(len(inputs.doc)) if which is None else which
        return np.concatenate([self.forward(x, inputs.window(c), inputs.length[c]) for c in np.split(
            which, range(_CHUNK, len(which), _CHUNK))]) if len(which) else np.empty(0, np.float32)

    def scores(self, inputs: Inputs) -> np.ndarray:
        """Score of each text: its worst window's."""
        return _sigmoid(np.maximum.reduceat(self.logits(inputs), inputs.doc_start)).astype(np.float64)


class _Adam:
    def __init__(self, params: dict, rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, grads: dict) -> None:
        self.t += 1
        scale = self.rate * (1 - 0.999 ** self.t) ** 0.5 / (1 - 0.9 ** self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= scale * (EMBEDDING_RATE if k in ("word", "char") else 1) * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def _lean(rows: np.ndarray, docs: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """Log odds of toxic documents among those that hold a row, one of either class left out, against all."""
    seen = np.unique(docs * size + rows)
    bad = np.bincount(seen % size, weights=toxic[seen // size], minlength=size)
    fine = np.maximum(np.bincount(seen % size, minlength=size) - bad - 1, 0)
    bad, share = np.maximum(bad - 1, 0), np.clip(toxic.mean(), 0.01, 0.99)
    return np.clip(np.log((bad + share) / (fine + 1 - share)) - np.log(share / (1 - share)), -4, 4) / 2


def _chosen(value: np.ndarray, inputs: Inputs, toxic: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows an epoch trains on: a toxic text's highest, a clean one's highest and some at random."""
    dice = rng.random(len(inputs.doc))
    rank_of = lambda v: np.argsort(np.lexsort((-v, inputs.doc))) - np.repeat(
        inputs.doc_start, np.diff(np.append(inputs.doc_start, len(v))))
    ranked, drawn, bad = rank_of(value), rank_of(dice), toxic[inputs.doc] == 1
    take = np.where(bad, ranked < 1, (ranked < CLEAN_WINDOWS) | (drawn < CLEAN_WINDOWS))
    return rng.permutation(np.flatnonzero(take))


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network fitted on whole texts with document labels."""
    net, rng = Network(seed), np.random.default_rng(seed)
    blob = [t.encode() for t in texts]
    inputs = Inputs(np.frombuffer(b"".join(blob), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blob])]))
    labels = np.array(toxic, dtype=np.int64)
    # Which texts hold a distinct word, and so its trigrams.
    words, doc_of_word = inputs.codes[:-1], inputs.rows
    net.p["word"][:, 0] = _lean(inputs.words[words], doc_of_word, labels, WORD_ROWS)
    pairs = np.unique(doc_of_word * len(inputs.words) + words)
    own, sizes = pairs % max(len(inputs.words), 1), inputs.sizes[pairs % max(len(inputs.words), 1)]
    ends = np.cumsum(sizes)
    chars = inputs.chars[np.arange(ends[-1]) + np.repeat(inputs.begins[own] - ends + sizes, sizes)] if len(own) else own
    net.p["char"][:, 0] = _lean(chars, np.repeat(pairs // max(len(inputs.words), 1), sizes), labels, CHAR_ROWS)
    adam = _Adam(net.p, RATE)
    # Before the network can tell, a window counts as its most telling word.
    telling = np.append(net.p["word"][inputs.words, 0], np.float32(-9))
    first = np.concatenate([telling[inputs.window(c)].max(axis=1) for c in np.split(
        np.arange(len(inputs.doc)), range(_CHUNK, len(inputs.doc), _CHUNK))])
    which = _chosen(first, inputs, labels, rng)
    epochs = max(epochs, min(LEAST_BATCHES * BATCH // max(len(which), 1), MOST_EPOCHS))
    for epoch in range(epochs):
        adam.rate = RATE * (1 - epoch / epochs * 0.8)
        which = _chosen(first if epoch < max(1, epochs // 3) else net.logits(inputs), inputs, labels, rng)
        for lo in range(0, len(which), BATCH):
            own = which[lo:lo + BATCH]
            used, codes = np.unique(inputs.window(own), return_inverse=True)
            codes, used = codes.reshape(len(own), WINDOW), used[used < len(inputs.words)]
            codes = np.minimum(codes, len(used))
            sizes = inputs.sizes[used]
            begins = np.cumsum(sizes) - sizes
            chars = inputs.chars[np.arange(sizes.sum()) + np.repeat(inputs.begins[used] - begins, sizes)]
            x = net.embed(inputs.words[used], chars, begins, sizes)
            # Words are hidden at random, so that their characters must tell as well.
            hidden = np.append(rng.random(len(used)) < HIDDEN_WORDS, False)
            x[hidden, :WORD_DIM] = 0
            grads, dx = net.gradients(x, codes, inputs.length[own], labels[inputs.doc[own]].astype(np.float32))
            dx[hidden, :WORD_DIM] = 0
            grads["word"], grads["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(grads["word"], inputs.words[used], dx[:-1, :WORD_DIM])
            np.add.at(grads["char"], chars, np.repeat(dx[:-1, WORD_DIM:] / sizes[:, None], sizes, axis=0))
            adam.step(grads)
    return net


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
                  per_class: int = TRAIN_DOCS) -> list:
    """A bounded sample of labelled rows outside the held-out fold, in hash order: at most ``per_class`` ids of each label and ``TRAIN_BYTES`` of text.

    Where an id stands on several rows, the text with the least hash is taken.
    """
    usable = labels.where(F.col(label).isin(0, 1) & (fold(F.col(id_col)) != 1)).select(id_col, F.col(label).cast("int").alias("_label"))
    drawn = None
    for value in (0, 1):
        one = usable.where(F.col("_label") == value).distinct().orderBy(F.xxhash64(F.lit(SEED), id_col), id_col).limit(per_class)
        drawn = one if drawn is None else drawn.unionByName(one)
    found = docs.select(id_col, F.coalesce(text, F.lit("")).alias("_text")).join(F.broadcast(drawn), id_col)
    found = found.groupBy(id_col, "_label").agg(F.min(F.struct(F.xxhash64("_text"), "_text"))["_text"].alias("_text"))
    # At most ``2 * per_class`` rows are left.
    order = Window.orderBy(F.xxhash64(F.lit(SEED), id_col), id_col, "_label")
    fits = found.withColumn("_sum", F.sum(F.octet_length("_text")).over(order)).where(F.col("_sum") <= TRAIN_BYTES)
    return sorted(((r["_label"], r["_text"]) for r in fits.collect()), key=lambda r: (r[1], r[0]))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
                   predict_at: float = PREDICT_AT) -> DataFrame:
    """Per document: id, ``held_out, score, predicted``. Labels train the network and go nowhere else."""
    rows = training_rows(docs, labels, id_col, text, label)
    net = train([t for _, t in rows], [y for y, _ in rows]) if len({y for y, _ in rows}) == 2 else None
    model = docs.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for at, data, offsets in slabs(batch.column(2), _SLAB):
                part = batch.slice(at, len(offsets) - 1)
                score = own.scores(Inputs(data, offsets)) if own else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= predict_at).astype(np.int32))],
                                                 names=[id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, F.coalesce(fold(F.col(id_col)) == 1, F.lit(False)).alias("held_out"), text).mapInArrow(run, schema)
