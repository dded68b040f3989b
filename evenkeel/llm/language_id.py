"""Language identification by prediction by partial matching over bytes.

For each language a variable-order byte context tree (contexts of 0 to ``ORDER``
symbols) is counted on labelled text.  The trees are then frozen: a symbol not seen
in a context costs that context's escape (PPM method C, without exclusions) plus its
cost in the next shorter one, down to a uniform code over the alphabet.  A text's exact
code length under each language is the sum over all its bytes; the shortest wins, and
the score is that language's posterior under a uniform prior.

Bytes are first mapped to an alphabet: ASCII upper to lower case, digits and white
space to one symbol each, bytes never seen in training to one symbol.  Contexts of
the longest order that are too rare are left out of the trees (their suffix decides);
costs for every kept context and symbol are tabulated, so scoring is two lookups a byte.

Training reads only text and language, and whole texts.  The rows are a hash sample with
an expected ``MAX_TRAIN_DOCS`` per language, and ``MAX_TRAIN_TOTAL`` in all, shared evenly;
every symbol of the sample counts, whether seen once or often.  Contexts of two symbols
and more are kept in turns, each language's most frequent first, so none is starved by
others, until the tables reach ``MAX_CELLS``; that bounds the model that is broadcast,
whatever the number of languages.  Prediction reads nothing but the text.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if there
is nothing to learn from; a tie goes to the first language in code-point order; rows
with the same id stand each for itself; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .runtime import small_batches

ORDER = 3
#: Expected number of training documents of a language.
MAX_TRAIN_DOCS = 4000
#: Expected number of training documents of all languages together.
MAX_TRAIN_TOTAL = 100_000
#: Contexts of an order that are kept, and how often one of the longest order must have occurred.
MAX_CONTEXTS = 20_000
MIN_COUNT = 4
#: Costs (context, symbol, language) of an order: 64 MB in single precision.
MAX_CELLS = 1 << 24
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}").search


def _fold() -> np.ndarray:
    out = np.arange(256, dtype=np.int64)
    out[ord("A") : ord("Z") + 1] += 32
    out[ord("0") : ord("9") + 1] = ord("0")
    out[bytescan.SEPARATOR] = 0x20
    return out


FOLD = _fold()


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte its document and the last ``ORDER`` symbols and itself, 8 bits each.

    A text starts in the context of white space.
    """
    folded = FOLD[data]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    since = np.arange(len(data)) - offs[doc]
    key = folded.copy()
    for k in range(1, ORDER + 1):
        before = np.full(len(data), 0x20, np.int64)
        before[k:] = folded[:-k] if k else folded
        before[since < k] = 0x20
        key |= before << (8 * k)
    return doc, key


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bytescan.slices(batch, "text", 1 << 20):
            names = part.column("lang").dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc, key = _grams(*bytescan.raw(part.column("text")))
            found, n = np.unique((codes[doc] << 32) | key, return_counts=True)
            lang = names.dictionary.take(pa.array(found >> 32))
            yield pa.RecordBatch.from_arrays([lang, pa.array(found & 0xFFFFFFFF), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _turns(kept: np.ndarray, context: np.ndarray, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each kept context its best place in any language's list, most frequent first."""
    pair, back = np.unique(lang * (int(context.max()) + 1) + context, return_inverse=True)
    count = np.bincount(back.reshape(-1), n)
    which, own = pair // (int(context.max()) + 1), pair % (int(context.max()) + 1)
    order = np.lexsort((own, -count, which))
    place = np.empty(len(pair), np.int64)
    place[order] = np.arange(len(pair)) - np.searchsorted(which[order], which[order])
    best = np.full(len(kept), len(pair), np.int64)
    at = np.searchsorted(kept, own)
    ours = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == own)
    np.minimum.at(best, at[ours], place[ours])
    return best


class Model:
    """Frozen code lengths: ``state`` maps a context to a row of ``cost``."""

    def __init__(self, languages: list[str], alphabet: np.ndarray, state: np.ndarray, cost: np.ndarray):
        self.languages, self.alphabet, self.state, self.cost = languages, alphabet, state, cost

    @staticmethod
    def train(names: list[str], which: np.ndarray, gram: np.ndarray, n: np.ndarray) -> "Model":
        """From counted grams of ORDER + 1 symbols; ``which`` numbers their languages in ``names``."""
        languages = sorted(names)
        place = np.array([languages.index(x) for x in names], np.int64)
        lang, gram, n = place[which], gram.astype(np.int64), n.astype(np.float64)
        symbols = [(gram >> (8 * k)) & 255 for k in range(ORDER + 1)]
        seen = np.unique(np.concatenate(symbols))
        alphabet = np.zeros(256, np.int64)  # symbol 0 stands for all that was never seen
        alphabet[seen] = np.arange(1, len(seen) + 1)
        alphabet = alphabet[FOLD]
        size = len(seen) + 1
        code = np.zeros(256, np.int64)
        code[seen] = np.arange(1, len(seen) + 1)
        symbols = [code[s] for s in symbols]
        target = symbols[0]
        cost = np.full((1, size, len(languages)), np.log2(size))  # the uniform code below order 0
        state = np.zeros(1, np.int64)
        context = np.zeros(len(gram), np.int64)
        for order in range(ORDER + 1):
            if order:
                context = context + symbols[order] * size ** (order - 1)
            total = np.zeros(size**order)
            np.add.at(total, context, n)
            kept = np.flatnonzero(total > 0)
            if order == ORDER:
                kept = np.flatnonzero(total >= MIN_COUNT)
            most = min(MAX_CONTEXTS, max(1, MAX_CELLS // (size * len(languages))))
            if order >= 2 and len(kept) > most:
                kept = np.sort(kept[np.argsort(_turns(kept, context, lang, n), kind="stable")[:most]])
            shorter = state[np.arange(size**order) % max(1, size ** (order - 1))] if order else np.zeros(1, np.int64)
            row_of = np.full(size**order, -1, np.int64)
            row_of[kept] = np.arange(len(kept))
            below = cost[shorter[kept]]
            counts_here = np.zeros((len(kept), size, len(languages)))
            ours = row_of[context] >= 0
            np.add.at(counts_here, (row_of[context[ours]], target[ours], lang[ours]), n[ours])
            sums = counts_here.sum(axis=1, keepdims=True)
            kinds = (counts_here > 0).sum(axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = np.log2(sums + kinds) - np.log2(counts_here)
                escape = np.where(sums > 0, np.log2(sums + kinds) - np.log2(np.maximum(kinds, 1)), 0.0)
            here = np.where(counts_here > 0, direct, escape + below)
            base = len(cost)
            cost = np.concatenate([cost, here])
            new = shorter.copy()
            new[kept] = base + np.arange(len(kept))
            state = new
        used, rows = np.unique(state, return_inverse=True)
        return Model(languages, alphabet.astype(np.int32), rows.reshape(-1).astype(np.int32), np.ascontiguousarray(cost[used], np.float32))

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """(texts, languages): bits."""
        data, offs = bytescan.raw(column)
        out = np.zeros((len(offs) - 1, len(self.languages)))
        if len(data) == 0:
            return out
        size = self.cost.shape[1]
        own = self.alphabet[data].astype(np.int64)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        since = np.arange(len(data)) - offs[doc]
        start = int(self.alphabet[0x20])
        context = np.zeros(len(data), np.int64)
        for k in range(1, ORDER + 1):
            before = np.full(len(data), start, np.int64)
            before[k:] = own[:-k]
            before[since < k] = start
            context += before * size ** (k - 1)
        at = self.state[context].astype(np.int64) * size + own
        flat = self.cost.reshape(-1, len(self.languages))
        full = np.flatnonzero(np.diff(offs))
        for j in range(len(self.languages)):
            out[full, j] = np.add.reduceat(flat[at, j], offs[full], dtype=np.float64)
        return out


def train(rows: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model | None:
    """A model from (text, lang, pick), ``pick`` being a uniform hash in 0..2**20 - 1; None without labelled text."""
    labelled = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("docs"))
    # A row per language, the MAX_TRAIN_TOTAL most frequent at most, so it can be broadcast: sampling shuffles no text.
    # With very many languages each has less than ``max_docs``, so that the sample stays bounded.
    share = F.least(F.lit(float(max_docs)), F.lit(float(MAX_TRAIN_TOTAL)) / F.count("*").over(Window.partitionBy(F.lit(1))))
    rates = sizes.select(F.col("lang").alias("l"), (share / F.col("docs") * (1 << 20)).alias("below"))
    rates = F.broadcast(rates.orderBy("below", "l").limit(MAX_TRAIN_TOTAL))
    sample = labelled.join(rates, F.col("lang") == F.col("l")).where("pick < below").select("text", "lang")
    grams = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The grams of a bounded sample, whatever the input; as Arrow columns, not as objects.
    counts = grams.orderBy("lang", "gram").toArrow()
    if not counts.num_rows:
        return None
    lang = counts.column("lang").combine_chunks().dictionary_encode()
    return Model.train(lang.dictionary.to_pylist(), lang.indices.to_numpy(), counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def _predict(model, keep_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for part in bytescan.slices(batch, "text", 1 << 20):
                texts = part.column("text").to_pylist()
                letters = [t is not None and _LETTER(t) is not None for t in texts]
                if own is None:
                    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                else:
                    bits = own.code_lengths(part.column("text"))
                    best = bits.argmin(axis=1)
                    excess = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
                    scores = np.where(letters, 1 / np.exp2(-excess).sum(axis=1), 0.0)
                    names = [own.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters)]
                kept = [c for c in part.schema.names if keep_text or c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores)], [*kept, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from the rows that are not held out.

    With ``carry``: ``row``, a struct of these columns of ``docs`` unchanged (whatever
    their names), ``text``, ``lang_pred`` and ``score``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = docs["doc_id"].cast("string")
    # Without an id the text decides, so that rows without one are sampled like others.
    pick = F.pmod(F.when(key.isNull(), F.xxhash64(docs["text"].cast("string"))).otherwise(F.xxhash64(key)), F.lit(1 << 20)).alias("pick")
    model = train(docs.where(~held_out(docs["doc_id"])).select(docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"), pick), max_docs)
    shared = spark.sparkContext.broadcast(model)
    text = docs["text"].cast("string").alias("text")
    if carry is not None:
        rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), text)
        inner = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in carry)
        return rows.mapInArrow(_predict(shared, keep_text=True), f"row struct<{inner}>, text string, lang_pred string, score double")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), text)
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")
