"""Substring deduplication: a count-min prefilter, then exact grouping of what may repeat.

A window is ``width`` consecutive words of one document.  Every word covered by a
window whose word sequence also starts earlier (smaller id, or same document and
earlier start) is removed; windows are judged on the input.

Pass 1.  Each task sketches its windows: two rows of counters that stop at 2, sent as
sorted cell offsets per slice of 65,536 cells.  Merging adds the counters slice by
slice, streaming, and keeps one bit per cell: "counted twice or more".  A window's
estimate is the smaller of its two counters, so it never falls below the true count
and no repeated window is lost.  The rows are at least twice as wide as the estimated
number of windows, up to ``MAX_CELLS_LOG2``; the merged sketch, which is broadcast, is
thereby at most 2 * 2**MAX_CELLS_LOG2 bits (64 MB) at any input size.  Beyond that
bound it lets more windows through, which costs shuffle but changes no result.

Pass 2.  Only windows estimated repeated are grouped, by the 128 bits of a BLAKE2b digest
of their words, joined by one space; the sketch's own hashes decide nothing.  Each task
first settles its own repeats: of equal windows it holds, all but the first are removed
at once and leave as runs, so a window that is in a third of all documents is sent once
by each task.  What is left travels packed, one row for each hash bucket; a bucket is
sorted by hash, id and start, and all but the earliest start of a hash become marks.
Marks travel packed too, one row for each bucket of documents, and meet the texts in
one shuffle, sorted so that a bucket's marks stream in before its texts.  The numbers
of buckets follow the input's size, so a bucket stays a few megabytes.

Defined results: a null or empty text has no words and nothing removed; rows with the
same id and text are the same document for "earlier", so equal rows do not remove each
other's words; different texts under one id, or without an id, are documents of their
own, in the order of a hash of the text, the tag; null ids come first; fewer than ``width`` words are never removed; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .runtime import NULL_ID, small_batches

WIDTH = 20
#: Largest number of cells in a row of the sketch, as a power of two.
MAX_CELLS_LOG2 = 28
MIN_CELLS_LOG2 = 16
SLICE_LOG2 = 16
#: Windows that a task holds before it settles them or sends its part of the sketch.
HELD = 1 << 19
#: About how many windows a hash bucket covers, and bytes of text a bucket of documents.
BUCKET_WINDOWS = 1 << 17
BUCKET_BYTES = 4 << 20
_ROWS = 2
#: Up to so many ids of several texts are sent to the tasks; beyond, every row travels with its tag.
MAX_CLASHES = 1 << 16


def clashing(rows: DataFrame) -> np.ndarray | None:
    """The ids of (doc, tag) that stand for several texts, in order; None if they are more than ``MAX_CLASHES``."""
    several = rows.groupBy("doc").agg(F.min("tag").alias("x"), F.max("tag").alias("y")).where("x != y").select("doc")
    ids = np.array([r[0] for r in several.limit(MAX_CLASHES + 1).collect()], np.int64)
    return np.sort(ids) if len(ids) <= MAX_CLASHES else None


def _keys(batch: pa.RecordBatch, clashes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and tags; 0 for the tag where the id alone tells the text, which packs to nothing."""
    ids = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
    tags = batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return ids, tags if clashes is None else np.where(np.isin(ids, clashes), tags, np.uint64(0))


class Windows:
    """All windows of the documents of a batch: ``row``, ``start``, and two hashes for the sketch."""

    def __init__(self, part: pa.RecordBatch, width: int):
        self.data, offs = bytescan.raw(part.column("text"))
        self.starts, self.ends, first = bytescan.word_spans(self.data, offs)
        self.width = width
        words = bytescan.hash_words(self.data, self.starts, self.ends)
        h1, h2 = (bytescan.hash_windows(words, width, k) for k in (1, 2))
        row = np.repeat(np.arange(len(offs) - 1), np.diff(first))[: len(h1)]
        word = np.arange(len(h1))
        inside = word + width <= first[row + 1]
        self.row, self.start, self.word, self.h1, self.h2 = row[inside], (word - first[row])[inside], word[inside], h1[inside], h2[inside]

    def digests(self, some: np.ndarray) -> np.ndarray:
        """(n, 2): 128 bits of a cryptographic digest of the chosen windows' words, joined by one space."""
        flat, at = bytescan.joined(self.data, self.starts, self.ends)
        first = self.word[some]
        last = first + self.width - 1
        return bytescan.digests(flat, at[first], at[last] + (self.ends - self.starts)[last])


def _cells(h1: np.ndarray, h2: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - log2)
    return (h1 >> shift).astype(np.uint32), (h2 >> shift).astype(np.uint32)


def _sketch(width: int, log2: int):
    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for row in range(_ROWS):
            cells = np.sort(np.concatenate([x[row] for x in held]))
            if len(cells) > 2:  # counters stop at 2
                cells = cells[np.concatenate([[True, True], cells[2:] != cells[:-2]])]
            which = cells >> np.uint32(SLICE_LOG2)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(cells)]])
            low = cells.astype(np.uint16)
            # Gaps in bytes, 255 standing for "255 further", or offsets in two bytes: whichever is shorter.
            gap = low.astype(np.int64)
            gap[1:] -= low[:-1]
            gap[cuts[:-1]] = low[cuts[:-1]]
            ends = np.cumsum(gap // 255 + 1)
            coded = len(ends) > 0 and ends[-1] < 2 * len(low)
            if coded:
                body = np.full(int(ends[-1]), 255, np.uint8)
                body[ends - 1] = gap % 255
                offsets = np.concatenate([[0], ends])[cuts]
            else:
                body, offsets = low, cuts * 2
            n = len(cuts) - 1
            parts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row, np.int32)), pa.array(which[cuts[:-1]].astype(np.int32)), pa.array(np.full(n, coded)), parts], ["row", "slice", "coded", "cells"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in bytescan.slices(batch, "text"):
                found = Windows(part, width)
                if len(found.row):
                    held.append(_cells(found.h1, found.h2, log2))
                    n += len(found.row)
                if n > 6 * HELD:
                    yield from send(held)
                    held, n = [], 0
        if held:
            yield from send(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row, which, coded, cells in zip(*(batch.column(c).to_pylist() for c in ("row", "slice", "coded")), batch.column("cells")):
            own = counts.setdefault((row, which), np.zeros(1 << SLICE_LOG2, np.uint8))
            if coded:
                gap = np.frombuffer(cells.as_buffer(), np.uint8)
                found = np.cumsum(gap, dtype=np.int64)[gap != 255]
            else:
                found = np.frombuffer(cells.as_buffer(), np.uint16)
            again = found[1:][found[1:] == found[:-1]]
            own[found] = np.minimum(own[found] + 1, 2)
            own[again] = 2
    for (row, which), own in counts.items():
        if (own > 1).any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([row], pa.int32()), pa.array([which], pa.int32()), pa.array([np.packbits(own > 1, bitorder="little").tobytes()], pa.binary())], ["row", "slice", "bits"]
            )


def sketch(docs: DataFrame, width: int, log2: int) -> np.ndarray:
    """The merged sketch: (2, 2**log2 / 8) bytes, a bit for each cell counted twice or more."""
    parts = docs.select("text").mapInArrow(_sketch(width, log2), "row int, slice int, coded boolean, cells binary")
    merged = parts.repartition("row", "slice").mapInArrow(_merge, "row int, slice int, bits binary")
    out = np.zeros((_ROWS, (1 << log2) // 8), np.uint8)
    size = (1 << SLICE_LOG2) // 8
    for row, which, bits in merged.toLocalIterator():
        own = np.frombuffer(bits, np.uint8)
        out[row, which * size : which * size + size] = own[: out.shape[1]]
    return out


def pack(doc: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ids in rising order (as gaps) and columns of natural numbers, each in as few bytes as it needs: none if all are 0."""
    gaps = np.diff(doc, prepend=doc[:1]).astype(np.uint64)
    arrays = []
    for x in (gaps, *columns):
        top = int(x.max())
        arrays.append(x.astype(np.min_scalar_type(top)) if top else x[:0])
    head = np.array([len(doc), len(arrays), *(x.itemsize if len(x) else 0 for x in arrays)], "<u4").tobytes() + np.array([doc[0]], "<i8").tobytes()
    return head + b"".join(x.tobytes() for x in arrays)


def unpack(data: pa.Buffer) -> list[np.ndarray]:
    """[ids, *columns] of :func:`pack`."""
    n, k = np.frombuffer(data, "<u4", 2).tolist()
    sizes = np.frombuffer(data, "<u4", k, 8).tolist()
    at = 8 + 4 * k
    first = int(np.frombuffer(data, "<i8", 1, at)[0])
    at += 8
    out = []
    for size in sizes:
        out.append(np.frombuffer(data, f"<u{size}", n, at) if size else np.zeros(n, np.uint8))
        at += size * n
    out[0] = np.cumsum(out[0], dtype=np.uint64).view(np.int64) + first
    return out


def _bucket(ids: np.ndarray, tags: np.ndarray, buckets: int) -> np.ndarray:
    return (bytescan.mix(ids.view(np.uint64) ^ tags.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _by(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, packed rows) for each key; rows in order of id and position."""
    order = np.lexsort((pos, doc, key))
    key, doc, pos = key[order], doc[order], pos[order]
    columns = tuple(c[order] for c in columns)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b > a:
            yield int(key[a]), pack(doc[a:b], pos[a:b], *(c[a:b] for c in columns))


def _batches(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    if rows:
        bucket, kind, data = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


#: What a packed row holds: windows to group, or runs of words already settled.
_GROUP, _RUNS = 0, 1


def _repeated(width: int, log2: int, bucket_log2: int, merged, clashes):
    def settle(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, tag, pos, h1, h2 = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((pos, tag, doc, h2, h1))
        doc, tag, pos, h1, h2 = doc[order], tag[order], pos[order], h1[order], h2[order]
        lead = np.ones(len(doc), bool)
        lead[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.maximum.accumulate(np.where(lead, np.arange(len(doc)), 0))
        later = (doc != doc[at]) | (tag != tag[at]) | (pos != pos[at])
        top = (h1[lead] >> np.uint64(64 - bucket_log2)).astype(np.int64)
        rows = [(k, _GROUP, data) for k, data in _by(top, doc[lead], pos[lead], tag[lead], h1[lead], h2[lead])]
        if later.any():
            d, t, p = doc[later], tag[later], pos[later]
            order = np.lexsort((p, t, d))
            d, t, p = d[order], t[order], p[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] > p[:-1] + width)
            heads = np.flatnonzero(new)
            tails = np.concatenate([heads[1:] - 1, [len(d) - 1]])
            d, t, p, size = d[heads], t[heads], p[heads], p[tails] + width - p[heads]
            rows += [(k, _RUNS, data) for k, data in _by(_bucket(d, t, 1 << bucket_log2), d, p, t, size)]
        yield from _batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = merged.value
        held, n = [], 0
        for batch in batches:
            for part in bytescan.slices(batch, "text"):
                windows = Windows(part, width)
                maybe = np.ones(len(windows.row), bool)
                for k, cell in enumerate(_cells(windows.h1, windows.h2, log2)):
                    maybe &= (bits[k][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
                if maybe.any():
                    ids, tags = _keys(part, clashes.value)
                    row, digest = windows.row[maybe], windows.digests(maybe)
                    held.append((ids[row], tags[row], windows.start[maybe].astype(np.int64), digest[:, 0], digest[:, 1]))
                    n += len(row)
                if n > HELD:
                    yield from settle(held)
                    held, n = [], 0
        if held:
            yield from settle(held)

    return run


def _mark(width: int, doc_buckets: int):
    """Buckets of windows, rows of one bucket in sequence, to marks for buckets of documents."""

    def settle(held: list[list[np.ndarray]], runs: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found = [tuple(x) for x in runs]
        if held:
            doc, pos, tag, h1, h2 = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((pos, tag, doc, h2, h1))
            doc, pos, tag, h1, h2 = doc[order], pos[order].astype(np.int64), tag[order], h1[order], h2[order]
            lead = np.ones(len(doc), bool)
            lead[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            at = np.maximum.accumulate(np.where(lead, np.arange(len(doc)), 0))
            later = (doc != doc[at]) | (tag != tag[at]) | (pos != pos[at])
            found.append((doc[later], pos[later], tag[later], np.full(int(later.sum()), width)))
        doc, pos, tag, size = (np.concatenate(x) for x in zip(*found))
        yield from _batches([(k, 0, data) for k, data in _by(_bucket(doc, tag, doc_buckets), doc, pos.astype(np.int64), tag, size)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, runs = None, [], []
        for batch in batches:
            for bucket, kind, data in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("data")):
                if bucket != current:
                    if held or runs:
                        yield from settle(held, runs)
                    current, held, runs = bucket, [], []
                (held if kind == _GROUP else runs).append([x.copy() for x in unpack(data.as_buffer())])
        if held or runs:
            yield from settle(held, runs)

    return run


def _apply(carried: bool):
    """Marks and texts of each bucket of documents, marks first, to kept texts.

    With ``carried`` the rows' other columns come along, and a text that loses nothing
    stays as it is, white space included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, packed, marks = None, [], None
        for whole in batches:
            for batch in bytescan.slices(whole, "text"):
                texts = bytescan.as_binary(batch.column("text"))
                rows, at = [], []
                for i, (bucket, kind, doc, tag, data, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "doc", "tag")), batch.column("data"), texts)):
                    if bucket != current:
                        current, packed, marks = bucket, [], None
                    if kind == 0:
                        packed.append([x.copy() for x in unpack(data.as_buffer())])
                        continue
                    if marks is None:
                        marks = [np.concatenate(x) for x in zip(*packed)] if packed else [np.zeros(0, np.int64)] * 4
                        marks = [x.astype(np.int64) for x in marks]
                        order = np.lexsort((marks[2], marks[0]))
                        marks = [x[order] for x in marks]
                        packed = []
                    at.append(i)
                    text = text.as_py()
                    words = text.split()
                    a, b = np.searchsorted(marks[0], [doc, doc + 1]) if doc < (1 << 63) - 1 else (np.searchsorted(marks[0], doc), len(marks[0]))
                    own = marks[2][a:b]
                    a, b = a + np.searchsorted(own, tag), a + np.searchsorted(own, tag, "right")
                    if a == b:
                        rows.append((doc, len(words), 0, text if carried else b" ".join(words)))
                        continue
                    begin = marks[1][a:b]
                    change = np.bincount(begin, minlength=len(words) + 1) - np.bincount(begin + marks[3][a:b], minlength=len(words) + 1)
                    keep = np.cumsum(change[:-1]) == 0
                    rows.append((doc, len(words), len(words) - int(keep.sum()), b" ".join(compress(words, keep.tolist()))))
                if rows:
                    d, n, r, t = zip(*rows)
                    columns = [pa.array(d, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(t, pa.binary()).cast(pa.string())]
                    names = ["doc", "n_words", "n_removed", "kept"]
                    if carried:
                        columns.append(batch.column("row").take(pa.array(at)))
                        names.append("row")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _with_bucket(buckets: int, clashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = _keys(batch, clashes.value)
            names = batch.schema.names
            own = {"tag": pa.array(tags.view(np.int64))}
            yield pa.RecordBatch.from_arrays([*(own.get(c, batch.column(c)) for c in names), pa.array(_bucket(ids, tags, buckets).astype(np.int32))], [*names, "bucket"])

    return run


def dedup_substrings(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document's words after removal, joined by one space.

    With ``carry`` also ``row``, a struct of these columns of ``docs``, and ``kept`` is the
    text itself where nothing is removed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc")
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    tag = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("tag")
    rows = docs.select(key, tag, text)
    # About six bytes a word; only the widths of the sketch and the buckets depend on this estimate.
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    log2 = min(MAX_CELLS_LOG2, max(MIN_CELLS_LOG2, (size // 3).bit_length()))
    bucket_log2 = max(6, (size // 6 // BUCKET_WINDOWS).bit_length())
    doc_buckets = max(64, size // BUCKET_BYTES)
    merged = spark.sparkContext.broadcast(sketch(rows, width, log2))
    clashes = spark.sparkContext.broadcast(clashing(rows))
    found = rows.mapInArrow(_repeated(width, log2, bucket_log2, merged, clashes), "bucket int, kind int, data binary")
    found = found.repartition("bucket").sortWithinPartitions("bucket")
    marks = found.mapInArrow(_mark(width, doc_buckets), "bucket int, kind int, data binary")
    marks = marks.select("bucket", "kind", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("tag"), "data", F.lit(None).cast("string").alias("text"))
    if carry is None:
        inner, texts = "", rows.mapInArrow(_with_bucket(doc_buckets, clashes), "doc long, tag long, text string, bucket int")
    else:
        inner = ", row struct<" + ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in carry) + ">"
        own = docs.select(key, tag, text, F.struct(*[docs[c] for c in carry]).alias("row"))
        texts = own.mapInArrow(_with_bucket(doc_buckets, clashes), f"doc long, tag long, text string{inner}, bucket int")
        marks = marks.withColumn("row", F.lit(None).cast(texts.schema["row"].dataType))
    texts = texts.select("bucket", F.lit(1).alias("kind"), "doc", "tag", F.lit(None).cast("binary").alias("data"), "text", *(["row"] if inner else []))
    both = marks.unionByName(texts).repartition("bucket").sortWithinPartitions("bucket", "kind")
    kept = both.mapInArrow(_apply(bool(inner)), "doc long, n_words long, n_removed long, kept string" + inner)
    return kept.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept", *(["row"] if inner else []))


def substring_digest(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
