"""Masked pseudo-likelihood scores from a bidirectional window network.

A token is a folded byte (ASCII case folded, digits and white space one symbol each,
the 63 most frequent in the corpus; the rest share symbol 0).  The network predicts a
token from the ``SIDE`` tokens on either side, never from itself: one embedding per
position and symbol, summed, tanh, softmax.  A text's score is the sum over all its
tokens of the log-probability given both sides.

Training.  Windows of 2 * SIDE + 1 tokens are counted over every text of the corpus and
dealt by a hash into parts, about one for each ``PART_BYTES`` of text; a part is merged,
sorted, and written once.  That table is what the objective needs, and it grows with the
corpus.  Each round every part starts from the shared weights and takes Adam steps (numpy)
over its windows, weighted by their counts, in an order that its content alone decides;
then all parts' weights are averaged.  They are rounded to multiples of 2**-``FIXED`` and
added as integers, so neither the order of rows nor the number of partitions or tasks
changes a bit of the model.  Only the averaged weights (14,432 numbers) and a 256-bin
histogram reach the driver.

Scoring runs the network once for each distinct window of a slice of texts; its matrix
product is exact, so that a window has one score wherever it is met.

Defined results: a null or empty text has no tokens, log-probability 0 and null mean;
rows with the same id stand each for itself; an empty table gives an empty table;
other columns are ignored.  Scores are rounded to 4 decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .language_id import FOLD
from .runtime import stored
from .substring_dedup import pack, unpack

SIDE = 3
SYMBOLS = 64
HIDDEN = 32
ROUNDS = 3
BATCH = 1024
RATE = 0.01
SEED = 17
#: Bytes of text whose windows make a part, and the binary places of the weights that are averaged.
PART_BYTES = 8 << 20
FIXED = 24
#: Windows scored at once.
SCORED = 1 << 13
_UNIT = float(1 << 20)
_BITS = 6
_SLOTS = 2 * SIDE + 1


def windows(data: np.ndarray, offs: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each byte its window, ``_BITS`` bits a token, own token lowest; outside a text stands white space."""
    own = code[data]
    lengths = np.diff(offs)
    since = np.arange(len(data)) - np.repeat(offs[:-1], lengths)
    until = np.repeat(offs[1:], lengths) - np.arange(len(data)) - 1
    blank = code[0x20]
    key = own.copy()
    slot = 1
    for k in range(1, SIDE + 1):
        left, right = np.full(len(own), blank), np.full(len(own), blank)
        left[k:] = own[:-k]
        right[:-k] = own[k:]
        left[since < k] = blank
        right[until < k] = blank
        key |= left << (_BITS * slot)
        key |= right << (_BITS * (slot + 1))
        slot += 2
    return key


def _tokens(keys: np.ndarray) -> np.ndarray:
    """(n, slots) tokens of windows, own token first."""
    return (keys[:, None] >> (_BITS * np.arange(_SLOTS))) & (SYMBOLS - 1)


class Network:
    """Weights as one flat float32 vector: embeddings, hidden bias, output, output bias."""

    SHAPES = ((_SLOTS - 1, SYMBOLS, HIDDEN), (HIDDEN,), (HIDDEN, SYMBOLS), (SYMBOLS,))

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        self.parts, at = [], 0
        for shape in self.SHAPES:
            size = int(np.prod(shape))
            self.parts.append(flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def start(cls, frequency: np.ndarray) -> "Network":
        rnd = np.random.default_rng(SEED)
        flat = rnd.normal(0, 0.15, sum(int(np.prod(s)) for s in cls.SHAPES)).astype(np.float32)
        net = cls(flat)
        net.parts[1][:] = 0
        net.parts[3][:] = np.log((frequency + 1) / (frequency.sum() + SYMBOLS))
        return net

    def forward(self, tokens: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hidden, log-probabilities) from the tokens around; the own token is not read.

        With ``exact`` both factors of the matrix product are rounded to multiples of
        2**-20.  Its sums then fit a double without rounding, so they do not depend on the
        order in which a kernel adds, nor on a window's place in its batch.
        """
        table, bias, out, out_bias = self.parts
        total = np.broadcast_to(bias, (len(tokens), HIDDEN)).copy()
        for k in range(_SLOTS - 1):
            total += table[k][tokens[:, k + 1]]
        hidden = np.tanh(total)
        if exact:
            logits = (np.round(hidden.astype(np.float64) * _UNIT) @ np.round(out.astype(np.float64) * _UNIT) / _UNIT**2).astype(np.float32) + out_bias
        else:
            logits = hidden @ out + out_bias
        logits -= logits.max(axis=1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return hidden, logits

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys))
        for a in range(0, len(keys), SCORED):
            tokens = _tokens(keys[a : a + SCORED])
            out[a : a + len(tokens)] = self.forward(tokens, exact=True)[1][np.arange(len(tokens)), tokens[:, 0]]
        return out

    def gradient(self, tokens: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of the weighted mean negative log-probability."""
        hidden, logs = self.forward(tokens)
        grad = Network(np.zeros_like(self.flat))
        delta = np.exp(logs)
        delta[np.arange(len(tokens)), tokens[:, 0]] -= 1
        delta *= (weight / weight.sum())[:, None].astype(np.float32)
        grad.parts[2][:] = hidden.T @ delta
        grad.parts[3][:] = delta.sum(axis=0)
        inner = (delta @ self.parts[2].T) * (1 - hidden**2)
        grad.parts[1][:] = inner.sum(axis=0)
        hot = np.arange(SYMBOLS)
        for k in range(_SLOTS - 1):
            grad.parts[0][k] = (tokens[:, k + 1][None, :] == hot[:, None]).astype(np.float32) @ inner
        return grad.flat


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        for part in bytescan.slices(batch, "text", 1 << 20):
            total += np.bincount(FOLD[bytescan.raw(part.column("text"))[0]], minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["byte", "n"])


def _count(code: np.ndarray, parts: int):
    """Windows and how often each occurs, packed, one row for each part met."""

    def settle(held: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, n = _added(held, counts)
        part = (bytescan.mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        keys, n, part = keys[order], n[order], part[order]
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for i in range(0, len(cuts) - 1, 1024):
            spans = list(zip(cuts[i:-1], cuts[i + 1 :]))[:1024]
            data = [pack(keys[x:y], n[x:y]) for x, y in spans]
            yield pa.RecordBatch.from_arrays([pa.array(part[[x for x, _ in spans]]), pa.array(data, pa.binary())], ["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size = [], [], 0
        for batch in batches:
            for some in bytescan.slices(batch, "text", 1 << 20):
                keys, n = np.unique(windows(*bytescan.raw(some.column("text")), code), return_counts=True)
                held.append(keys)
                counts.append(n)
                size += len(keys)
                if size > 1 << 22:
                    yield from settle(held, counts)
                    held, counts, size = [], [], 0
        if size:
            yield from settle(held, counts)

    return run


def _added(held: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate(held), return_inverse=True)
    return keys, np.bincount(back.reshape(-1), np.concatenate(counts), len(keys)).astype(np.int64)


def _merge(table: pa.Table) -> pa.Table:
    """One row for a part: its windows in order, and their counts."""
    rows = [unpack(x.as_buffer()) for x in table.column("data")]
    keys, n = _added([r[0] for r in rows], [r[1] for r in rows])
    return pa.table([table.column("part")[:1].cast(pa.int64()), pa.array([pack(keys, n)], pa.binary())], ["part", "data"])


def _train(start: np.ndarray):
    """A part's weights after its steps, as integers."""

    def run(table: pa.Table) -> pa.Table:
        net = Network(start.copy())
        first, second = np.zeros_like(start), np.zeros_like(start)
        keys, n = unpack(table.column("data")[0].as_buffer())
        order = np.random.default_rng(SEED).permutation(len(keys))
        for step, a in enumerate(range(0, len(keys), BATCH), 1):
            pick = order[a : a + BATCH]
            grad = net.gradient(_tokens(keys[pick]), n[pick].astype(np.float64))
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            net.flat -= (RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        weights = np.round(net.flat.astype(np.float64) * (1 << FIXED)).astype(np.int64)
        return pa.table([pa.array([weights], pa.list_(pa.int64()))], ["weights"])

    return run


def train(texts: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(code, weights) from all texts of the column ``text``."""
    histogram = np.zeros(256, np.int64)
    for row in texts.mapInArrow(_histogram, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        histogram[row.byte] = row.n
    top = [b for b in np.lexsort((np.arange(256), -histogram)).tolist() if histogram[b] > 0][: SYMBOLS - 1]
    symbol = np.zeros(256, np.int64)
    symbol[top] = np.arange(1, len(top) + 1)
    code = symbol[FOLD]
    frequency = np.bincount(symbol, histogram, SYMBOLS)
    parts = max(1, int(histogram.sum()) // PART_BYTES)
    counted = texts.mapInArrow(_count(code, parts), "part long, data binary")
    table = stored(counted.groupBy("part").applyInArrow(_merge, "part long, data binary"))
    flat = Network.start(frequency).flat
    for _ in range(rounds):
        each = table.groupBy("part").applyInArrow(_train(flat), "weights array<long>")
        sums = each.select(F.posexplode("weights").alias("at", "w")).groupBy("at").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
        rows = sums.toPandas().sort_values("at")  # one row for each weight
        if len(rows):
            flat = (rows["w"].to_numpy() / rows["n"].to_numpy() / (1 << FIXED)).astype(np.float32)
    return code, flat


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, flat = shared.value
        net = Network(flat)
        for batch in batches:
            for part in bytescan.slices(batch, "text"):
                data, offs = bytescan.raw(part.column("text"))
                keys, back = np.unique(windows(data, offs, code), return_inverse=True)
                logs = net.log_probability(keys)[back.reshape(-1)]
                n = np.diff(offs)
                total = np.zeros(len(n))
                some = np.flatnonzero(n)
                if len(some):
                    total[some] = np.add.reduceat(logs, offs[some])
                mean = pa.array(np.round(total / np.maximum(n, 1), 4), mask=n == 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(np.round(total, 4)), mean], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return run


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob, perplexity): trains on all texts, then scores them."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows.select("text"), rounds))
    scored = rows.mapInArrow(_score(model), "doc_id long, n_tokens long, log_prob double, mean_log_prob double")
    return scored.withColumn("perplexity", F.round(F.exp(-F.col("mean_log_prob")), 4))
