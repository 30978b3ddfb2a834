"""Byte-level byte-pair encoding and decoding with a rank file, in Arrow batches.

Texts are cut by the scans of :mod:`pretokens`; the slices of their UTF-8 bytes go through pair
merging, whose results are remembered. Nothing is trained: ranks come from a file in the form
"base64 rank" a line, whose path is a parameter.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import Splitter, split

CACHED = 200_000  # slices remembered by one task, and those of one run of texts
NEVER = np.int64(1) << np.int64(62)  # rank of a pair that does not join
LONG = 96  # slices of more bytes take a heap
ROWS_BYTES = 1 << 20  # text that one Arrow batch of results covers, if a text is no longer by itself
MOST_RANKS = 1 << 20  # a rank file is broadcast: larger ones are refused


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is the token's id."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    if len(pairs) > MOST_RANKS:
        raise ValueError(f"{path} holds {len(pairs)} ranks, more than {MOST_RANKS}")
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Merges:
    """All pairs of tokens that join to a token, sorted for look-up; made on the driver, used in tasks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.base = max(ranks.values(), default=0) + 1
        found = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    found[left * self.base + right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.lengths = np.zeros(self.base, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NEVER)


def merge_many(pieces: Sequence[bytes], merges: Merges) -> list[bytes]:
    """Ids of slices, four bytes each: in each, the pair of least rank is joined first, the leftmost among equals.

    All slices advance together, by one pair a round; those without a pair left leave.
    """
    out = [b""] * len(pieces)
    count = np.fromiter(map(len, pieces), np.int64, len(pieces))
    names = np.flatnonzero(count)
    count = count[names]
    ids = merges.single[np.frombuffer(b"".join(pieces), np.uint8)]
    if len(ids) and ids.min() < 0:
        raise ValueError("the rank file lacks a byte")
    pairs = np.full(len(ids), NEVER)
    if len(ids) > 1 and len(merges.keys):
        pairs[:-1] = merges.ranks_of(ids[:-1], ids[1:])
    pairs[np.cumsum(count) - 1] = NEVER  # the last token of a slice has no right neighbour
    while len(names):
        starts = np.cumsum(count) - count
        least = np.minimum.reduceat(pairs, starts)
        done = least == NEVER
        if done.any():
            flat = ids.astype("<u4").tobytes()
            for name, a, n in zip(names[done].tolist(), starts[done].tolist(), count[done].tolist()):
                out[name] = flat[4 * a: 4 * (a + n)]
            stays = ~np.repeat(done, count)
            ids, pairs = ids[stays], pairs[stays]
            names, count, least = names[~done], count[~done], least[~done]
            starts = np.cumsum(count) - count
            if not len(names):
                break
        hits = np.flatnonzero(pairs == np.repeat(least, count))
        at = hits[np.searchsorted(hits, starts)]  # the first hit of each slice
        ids[at] = least
        pairs[at] = NEVER
        right = at[at + 2 < starts + count]
        pairs[right] = merges.ranks_of(ids[right], ids[right + 2])
        left = at[at > starts]
        pairs[left - 1] = merges.ranks_of(ids[left - 1], ids[left])
        stays = np.ones(len(ids), bool)
        stays[at + 1] = False
        ids, pairs, count = ids[stays], pairs[stays], count - 1
    return out


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> bytes:
    """The same for long slices, in n log n: a heap of pairs over linked parts."""
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is joined to another
    before = list(range(-1, n - 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i: i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:  # one of the two has changed since
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(piece[i: end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if i and (rank := ranks.get(piece[before[i]: stop])) is not None:
            heapq.heappush(heap, (rank, before[i], stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i: end[i]]])
        i = end[i]
    return np.array(ids, "<u4").tobytes()


class Encoder:
    """Encodes whole texts; lives in one task and remembers what it merged."""

    def __init__(self, ranks: dict[bytes, int], merges: Merges, splitter: Splitter) -> None:
        self.ranks, self.merges, self.splitter, self.classes = ranks, merges, splitter, splitter.classes()
        self.known: dict[bytes, bytes] = {}

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Token ids of each text, as unsigned 32-bit numbers, low byte first."""
        data, starts, upto = split(texts, self.splitter, self.classes)
        pieces = [data[a:b] for a, b in zip(starts, starts[1:])]
        found = list(map(self._learned(pieces).__getitem__, pieces))
        sizes = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4))
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.append(0, upto[:-1] + 1)  # the byte behind a text is a piece too, of no text
        return [flat[a:b] for a, b in zip(sizes[begin].tolist(), sizes[upto].tolist())]

    def _learned(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of all ``pieces`` at least; what is new is merged at once."""
        if len(self.known) > CACHED:
            self.known = {}
        fresh = set(pieces).difference(self.known)
        short = []
        for piece in fresh:
            whole = self.ranks.get(piece)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(piece) > LONG:
                self.known[piece] = _merge_long(piece, self.ranks)
            else:
                short.append(piece)
        self.known.update(zip(short, merge_many(short, self.merges)))
        return self.known


def _shared(spark: SparkSession, path: str):
    """Ranks and merges of a file, sent to each executor once: at most ``MOST_RANKS`` entries."""
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast((ranks, Merges(ranks)))


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts come to about ``ROWS_BYTES``; one longer text is a run of its own."""
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and total + size > ROWS_BYTES:
            yield at, i
            at, total = i, 0
        total += size
    if len(sizes):
        yield at, len(sizes)


def _sizes(column: pa.Array) -> np.ndarray:
    return pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)


def _text(value: bytes | None) -> str:
    return "" if value is None else value.decode("utf-8", "replace")


Batches = Iterator[pa.RecordBatch]


def _encoding(shared, splitter: Splitter) -> Callable[[Batches], Batches]:
    def encoded(batches: Batches) -> Batches:
        import pyarrow.compute  # noqa: F401

        encoder = Encoder(*shared.value, splitter)
        lengths = encoder.merges.lengths
        for batch in batches:
            texts = batch.column("text")
            for a, b in _slices(_sizes(texts)):
                found = encoder.ids([_text(t.as_py()) for t in texts[a:b]])
                offsets = [(np.cumsum(lengths[x]) - lengths[x]).astype("<i8") for x in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array([x.tobytes() for x in found], pa.binary()),
                     pa.array([x.tobytes() for x in offsets], pa.binary())], names=["doc_id", "ids", "offsets"])
    return encoded


def _decoding(shared) -> Callable[[Batches], Batches]:
    def decoded(batches: Batches) -> Batches:
        import pyarrow.compute  # noqa: F401

        ranks, merges = shared.value
        pieces = {rank: token for token, rank in ranks.items()}
        for batch in batches:
            ids, offsets = batch.column("ids"), batch.column("offsets")
            for a, b in _slices(_sizes(ids)):
                out = [_placed(i.as_py(), o.as_py(), pieces, merges.lengths) for i, o in zip(ids[a:b], offsets[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], ids[a:b], offsets[a:b], pa.array(out, pa.binary())],
                    names=["doc_id", "ids", "offsets", "decoded"])
    return decoded


def _placed(ids: bytes | None, offsets: bytes | None, pieces: dict[int, bytes], lengths: np.ndarray) -> bytes | None:
    if ids is None:
        return None
    found = np.frombuffer(ids, "<u4")
    text = b"".join(map(pieces.__getitem__, found.tolist()))
    if offsets is not None:
        sizes = lengths[found]
        if not np.array_equal(np.cumsum(sizes) - sizes, np.frombuffer(offsets, "<i8")):
            raise ValueError("offsets do not belong to these ids")
    return text


def _slim(docs: DataFrame) -> tuple[DataFrame, str]:
    # as bytes: whatever the text column holds is read the same way on both sides
    slim = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return slim, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}"


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, offsets) for every row of ``docs(doc_id, text, ...)``.

    ``ids`` holds the token ids as little-endian unsigned 32-bit numbers, four bytes each;
    ``offsets`` the byte of the text's UTF-8 form at which each token starts, eight bytes each.
    A null or empty text has no ids. Repeated rows give repeated results, a null doc_id passes
    through, other columns are ignored; a table without rows gives none. Texts are encoded whole,
    a run of a megabyte without any boundary included.
    """
    slim, key = _slim(docs)
    return slim.mapInArrow(_encoding(_shared(docs.sparkSession, path), Splitter()), f"{key}, ids binary, offsets binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens(doc_id, ids, offsets)`` with ``decoded``, the bytes that the ids stand for.

    The offsets must be those at which the ids' bytes fall. Null ids decode to null, no ids to
    no bytes; an id that the file lacks is an error.
    """
    slim = tokens.select("doc_id", "ids", "offsets")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_decoding(_shared(tokens.sparkSession, path)),
                           f"doc_id {kind}, ids binary, offsets binary, decoded binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``decode(encode(docs))`` in one pass of the same workers."""
    slim, key = _slim(docs)
    shared = _shared(docs.sparkSession, path)
    encoded, decoded = _encoding(shared, Splitter()), _decoding(shared)
    return slim.mapInArrow(lambda batches: decoded(encoded(batches)), f"{key}, ids binary, offsets binary, decoded binary")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded tokens."""
    return tokens.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
