"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, 4-word shingles with
repeats (the whole sequence if shorter), XXH64 with seed 42 of each shingle; a bit is 1
if it is set in over half of the hashes.  No words: fingerprint zero.

Two fingerprints of 8 bytes that differ in at most 4 bits share the byte at 4 or more
of the 8 positions.  A posting for a single position holds 1/256 of everything, so a
posting here is a byte at each of 3 of the first 7 positions: of 4 or more shared
positions at least 3 are among those 7, so every pair meets in one of the 35 postings
it can share.  In a posting the shared positional bytes of a pair are tallied, pairs
that reach 4 are kept, and the number of differing bits verifies them.

Only distinct fingerprints are indexed.  A posting gives a spanning forest of its
links, found by a search that drops what it has reached, never all pairs; a posting
over ``TILE`` entries is dealt out as pairs of chunks, each a group of its own.

Defined results: a null text has no words; all texts without words share fingerprint
zero and are linked; rows are linked by what they say only, so different texts under one
id, or without an id, are rows of their own; a component is named by its smallest id,
null only if none of its rows has one; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .runtime import NULL_ID, connected_components, dealt, small_batches, stored

SHINGLE = 4
SEED = 42
MAX_BITS = 4
MIN_BYTES = 8 - MAX_BITS
#: Positions in a posting's key, and the positions they are taken from.
KEY_BYTES, KEY_FROM = 3, 7
TILE = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Spans longer than this are hashed one by one.
_LONG = 512


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of ``data[start : start + size]`` for many spans, all spans of one size at a time."""
    out = np.empty(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    fours = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    seed64 = np.uint64(seed)
    order = np.argsort(sizes, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(sizes[order])) + 1, [len(order)]])
    with np.errstate(over="ignore"):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            own = order[a:b]
            s, size = starts[own], int(sizes[own[0]])
            if size > _LONG:
                out[own] = [xxhash.xxh64_intdigest(padded[x : x + size], seed) for x in s.tolist()]
                continue
            at = 0
            if size >= 32:
                lanes = [np.broadcast_to(v, s.shape) for v in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
                while at + 32 <= size:
                    lanes = [_round(v, eights[s + (at + 8 * k)]) for k, v in enumerate(lanes)]
                    at += 32
                h = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
                for v in lanes:
                    h = (h ^ _round(np.uint64(0), v)) * _P1 + _P4
            else:
                h = np.full(len(s), seed64 + _P5, np.uint64)
            h = h + np.uint64(size)
            while at + 8 <= size:
                h = _turn(h ^ _round(np.uint64(0), eights[s + at]), 27) * _P1 + _P4
                at += 8
            if at + 4 <= size:
                h = _turn(h ^ (fours[s + at].astype(np.uint64) * _P1), 23) * _P2 + _P3
                at += 4
            while at < size:
                h = _turn(h ^ (padded[s + at].astype(np.uint64) * _P5), 11) * _P1
                at += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[own] = h ^ (h >> np.uint64(32))
    return out


def fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text of an Arrow column."""
    data, offs = bytescan.raw(column)
    starts, ends, first = bytescan.word_spans(data, offs)
    out = np.zeros(len(offs) - 1, np.uint64)
    if len(starts) == 0:
        return out
    sizes = ends - starts
    flat, at = bytescan.joined(data, starts, ends)
    flat = _LOWER[flat]
    words = np.diff(first)
    row = np.repeat(np.arange(len(words)), words)
    i = np.arange(len(starts))
    full = i + SHINGLE <= first[row + 1]
    head = full | ((i == first[row]) & (words[row] < SHINGLE))
    i, row = i[head], row[head]
    last = np.minimum(i + SHINGLE, first[row + 1]) - 1
    hashes = xxh64_spans(flat, at[i], at[last] + sizes[last] - at[i]).astype(">u8").view(np.uint8).reshape(-1, 8)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))])
    for d in np.flatnonzero(words).tolist():
        a, b = int(cuts[d]), int(cuts[d + 1])
        ones = np.zeros(64, np.int64)
        for x in range(a, b, 1 << 16):
            ones += np.unpackbits(hashes[x : min(b, x + (1 << 16))], axis=1).sum(axis=0, dtype=np.int64)
        out[d] = int.from_bytes(np.packbits(2 * ones > b - a).tobytes(), "big")
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bytescan.slices(batch, "text"):
            rest = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(fingerprints(part.column("text")).view(np.int64))], [*rest, "fp"])


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally shared positional bytes, keep those that reach the minimum, verify the bits."""
    differ = np.ascontiguousarray(a ^ b)
    ok = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= MIN_BYTES
    ok[ok] = np.bitwise_count(differ[ok]) <= MAX_BITS
    return ok


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among fingerprints."""
    edges, left = [], np.arange(len(fps))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            hit = linked(fps[left], np.broadcast_to(fps[x], left.shape))
            if hit.any():
                reached = left[hit].tolist()
                edges += [(x, y) for y in reached]
                front += reached
                left = left[~hit]
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("entries")
        offs = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values
        fps = values.field(0).to_numpy().view(np.uint64)
        reps = values.field(1).to_numpy()
        sizes = np.diff(offs)
        two = offs[:-1][sizes == 2]
        hit = two[linked(fps[two], fps[two + 1])] if len(two) else two
        a, b = [reps[hit]], [reps[hit + 1]]
        for k in np.flatnonzero(sizes > 2).tolist():
            own = slice(offs[k], offs[k + 1])
            if found := forest(fps[own]):
                x, y = np.array(found).T
                a.append(reps[own][x])
                b.append(reps[own][y])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def link_edges(distinct: DataFrame) -> DataFrame:
    """(a, b): edges that join all linked fingerprints of (fp, rep), fp distinct."""
    at = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = []
    for n, positions in enumerate(combinations(range(KEY_FROM), KEY_BYTES)):
        key = F.lit(n).cast("long")
        for p in positions:
            key = key * 256 + at(p)
        keys.append(key)
    # Few bytes become 35 times as many rows: a stated number of partitions keeps them from being coalesced before that.
    spark = distinct.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    postings = distinct.repartition(parts, "fp").select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    sizes = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = postings.join(dealt(sizes), "key").withColumn("chunks", F.ceil(F.col("n") / TILE).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    shared = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # A chunk meets each chunk of its posting, itself included; with one chunk that is the posting.
    groups = shared.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    lists = groups.agg(F.collect_list(F.struct("fp", "rep")).alias("entries")).where(F.size("entries") > 1)
    return lists.select("entries").mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"))
    prints = stored(rows.mapInArrow(_fingerprint, "doc long, fp long"))
    distinct = prints.groupBy("fp").agg(F.min("doc").alias("first"))
    components = connected_components(link_edges(distinct.select("fp", F.col("fp").alias("rep"))))
    classes = distinct.join(dealt(components), distinct["fp"] == components["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("class"))
    names = classes.groupBy("class").agg(F.min("first").alias("component"))
    out = prints.join(dealt(classes.join(dealt(names), "class").select("fp", "component")), "fp")
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def row_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """(doc, tag): what tells documents apart where ids are null or repeated, the id and a hash of the text."""
    return [F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(docs[text_col].cast("string")).alias("tag")]


def leaders(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tag): of each component of linked fingerprints the smallest key of :func:`row_keys`."""
    small_batches(docs.sparkSession)
    rows = docs.select(*row_keys(docs, id_col, text_col), docs[text_col].cast("string").alias("text"))
    prints = stored(rows.mapInArrow(_fingerprint, "doc long, tag long, fp long"))
    distinct = prints.groupBy("fp").agg(F.min(F.struct("doc", "tag")).alias("first"))
    components = connected_components(link_edges(distinct.select("fp", F.col("fp").alias("rep"))))
    classes = distinct.join(dealt(components), distinct["fp"] == components["node"], "left").select("first", F.coalesce("component", "fp").alias("component"))
    return classes.groupBy("component").agg(F.min("first").alias("first")).select("first.doc", "first.tag")
