"""Byte-level BPE encoding and decoding as a tree reduction.

A text is cut into halves until leaves are small, each leaf is encoded by itself, and
neighbours are joined up the tree.  A join re-encodes a window around the seam and
grows it, left and right, until the tokens outside provably stay as they are: a place
where a character that is not white space is followed by white space ends a match of
the pattern whatever stands around it, because no alternative goes from one to the
other and none looks further ahead than a white-space run.  So tokens up to such a
place in the left part, and from such a place on in the right part, are those of the
whole text.

One match can itself be very long (a run of letters without spaces).  Such a match is
encoded by the same scheme over its bytes: halves are encoded recursively and joined
by re-encoding the tokens around the seam, more of them each time, until the token
pair on each edge of the window encodes to itself.  A sequence in which every
neighbouring pair encodes to itself is the encoding of its bytes, so the tokens
outside stay.  This keeps long matches near-linear.

Decoding concatenates byte strings up a balanced tree over the ids.

Defined results: a null text counts as empty and has no ids; ids may be null or
repeated; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .runtime import small_batches

LEAF_CHARS = 4096
LEAF_BYTES = 256
#: Characters around a seam that a join looks at first.
REACH = 64
#: A character that no engine takes for white space before one that all do.
_ENDS = regex.compile(r"[^\s\x1c-\x1f\x85\u180e\u200b](?=[ \t\n\r])").finditer


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Encoder and decoder for one rank file and one pattern.

    Joins are right for patterns in which no match goes on from a character that is not
    white space into white space, and none looks further ahead than a white-space run.
    """

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.name_of = {i: str(i) for i in self.bytes_of}
        self._coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self._piece = self._coder._core_bpe.encode_single_piece
        self._find = regex.compile(pattern).findall
        self.leaf_chars, self.leaf_bytes = max(leaf_chars, 2), max(leaf_bytes, 2)

    # A match, by its bytes.

    def _steady(self, a: int, b: int) -> bool:
        return self._piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        reach = 4
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = self._piece(b"".join(self.bytes_of[t] for t in left[a:] + right[:b]))
            if (a == 0 or self._steady(left[a - 1], window[0])) and (b == len(right) or self._steady(window[-1], right[b])):
                return left[:a] + window + right[b:]
            reach *= 2

    def encode_bytes(self, piece: bytes) -> list[int]:
        """The ids of one match."""
        if len(piece) <= self.leaf_bytes:
            return self._piece(piece)
        parts = [self._piece(piece[i : i + self.leaf_bytes]) for i in range(0, len(piece), self.leaf_bytes)]
        while len(parts) > 1:
            parts = [self._join_tokens(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    # A text, by its characters.

    def _whole(self, text: str) -> list[int]:
        """The ids of a text without regard to its length; long matches go by their bytes."""
        if len(text) <= self.leaf_chars:
            return self._coder.encode_ordinary(text)
        return [t for match in self._find(text) for t in self.encode_bytes(match.encode("utf-8"))]

    def _join(self, text: str, left: list[int], right: list[int], seam: int, start: int, end: int) -> list[int]:
        """The ids of ``text[start:end]`` from those of its parts before and after ``seam``."""
        reach, p, q = REACH, -1, -1
        while p < 0:
            low = max(start, seam - reach)
            p = max((m.start() + 1 for m in _ENDS(text, low, seam)), default=-1)
            if p < 0 and low == start:
                p = start
            reach *= 2
        reach = REACH
        while q < 0:
            high = min(end, seam + reach)
            q = next((m.start() + 1 for m in _ENDS(text, seam, high)), -1)
            if q < 0 and high == end:
                q = end
            reach *= 2
        size, cut, skip = self.size_of, len(left), 0
        rest = len(text[p:seam].encode("utf-8"))
        while rest > 0:
            cut -= 1
            rest -= size[left[cut]]
        rest = len(text[seam:q].encode("utf-8"))
        while rest > 0:
            rest -= size[right[skip]]
            skip += 1
        return left[:cut] + self._whole(text[p:q]) + right[skip:]

    def encode(self, text: str, start: int = 0, end: int | None = None) -> list[int]:
        end = len(text) if end is None else end
        if end - start <= self.leaf_chars:
            return self._coder.encode_ordinary(text[start:end])
        seam = (start + end) // 2
        return self._join(text, self.encode(text, start, seam), self.encode(text, seam, end), seam, start, end)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_CHARS:
            return b"".join([self.bytes_of[t] for t in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_codecs: dict[tuple, Codec] = {}


def codec(ranks_path: str | None = None) -> Codec:
    """One codec for each worker and vocabulary; the pattern is the one that the joins are proven for."""
    key = (ranks_path or default_ranks(), default_pattern())
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            for part in bytescan.slices(batch, "text", 1 << 20):
                ids = [own.encode(x or "") for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>")


def decode(df: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(id, data) from (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            data = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(data, pa.binary())], ["id", "data"])

    return df.select("id", "ids").mapInArrow(run, "id long, data binary")


def round_trip(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns, n_tokens, ids, and the text decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            for part in bytescan.slices(batch, "text", 1 << 20):
                ids = [own.encode(x or "") for x in part.column("text").to_pylist()]
                back = pa.array([own.decode(x) for x in ids], pa.binary()).cast(pa.string())
                columns = [part.column("row"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), back]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_tokens", "ids", "decoded"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("row"), docs[text_col].cast("string").alias("text"))
    inner = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"row struct<{inner}>, n_tokens long, ids array<int>, decoded string").select("row.*", "n_tokens", "ids", "decoded")


def bpe_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded bytes.

    Encodes a slice of texts, then decodes the ids just made, in one pass: the ids
    would be several times the text if they were handed over as rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            for part in bytescan.slices(batch, "text", 1 << 20):
                rows = []
                for text in part.column("text").to_pylist():
                    ids = own.encode(text or "")
                    rows.append((len(ids), hashlib.sha256(" ".join([own.name_of[t] for t in ids]).encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
                n, a, b = zip(*rows)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
