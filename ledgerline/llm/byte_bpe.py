"""Byte-level BPE encoding and decoding as a tree reduction.

A piece of text (one match of the tokenizer's pattern) is halved until single bytes are left, and
the token lists of neighbouring halves are joined on the way up. A token list is the encoding of
its bytes if, and only if, every two neighbours in it encode to themselves: merges run by lowest
rank, then leftmost, so the first merge across a token's edge would also be the first across it in
those two tokens alone. A join therefore encodes a window of the last tokens of the left list and
the first of the right one anew; where the window's outermost token comes out as it went in, the
pair across the window's edge is one that stood before, and nothing beyond it can change. A side
whose outermost token changes doubles its part of the window, at most to the whole list. Joining
is associative and the empty list its unit, and so are lists of pieces: whole texts are
concatenations, and decoding is the same concatenation over bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import weakref
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.names import fresh

#: vocabulary files beyond this size are refused: they are sent to every executor
MAX_VOCABULARY = 64 << 20
#: encodings that a worker remembers, and the longest text that it remembers one for
REMEMBERED, REMEMBERED_CHARS = 200_000, 64
#: a task hands its rows on whenever it has read so many characters
SLICE = 8 << 20
LEAF = 1 << 16
#: windows of so many bytes are merged by looking at all pairs, and byte strings of so many are remembered
SHORT, STEM = 64, 6
NEVER = 1 << 62
# White space, first that of ASCII, then the rest.
SPACES = "\t\n\x0b\x0c\r ", "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = tuple(tuple(c + " " for c in chars) for chars in SPACES)


def run_before_space(text: str) -> bool:
    """Whether a space follows other white space."""
    return any(run in text for run in RUNS[0]) or not text.isascii() and any(run in text for run in RUNS[1])


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: one line a token, its bytes in base64 and its id."""
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Memo(dict):
    """Results of a function: a bounded number of recent ones, and those of the generation before."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.before = compute, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes texts by ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cut_at_spaces: bool = True):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.first_piece = regex.compile(pattern).match
        self.cut_at_spaces = cut_at_spaces
        self.single = [ranks[bytes([a])] for a in range(256)]
        self.two = [ranks.get(bytes([a, b]), NEVER) for a in range(256) for b in range(256)]
        own = weakref.ref(self)  # else encoder and memos hold each other, and outlast their task
        self.window = Memo(lambda data: own().merged(data))
        self.stem = Memo(lambda data: own()._stem(data))
        self.packed_piece = Memo(lambda piece: own()._packed_piece(piece))
        self.packed_unit = Memo(lambda unit: own()._packed_unit(unit))
        self.packed_spaced = Memo(lambda unit: own()._packed_unit(" " + unit))

    # --- one piece ------------------------------------------------------------------------

    def merged(self, data: bytes) -> tuple[int, ...]:
        """The encoding of a window, merge by merge: least rank first, then leftmost."""
        return self._merged_short(data) if len(data) <= SHORT else self._merged_long(data)

    def _merged_short(self, data: bytes) -> tuple[int, ...]:
        rank_of, two = self.ranks.get, self.two
        ids = [self.single[byte] for byte in data]
        costs = [two[a << 8 | b] for a, b in zip(data, data[1:])]
        edges = list(range(len(data) + 1))
        while costs:
            least = min(costs)
            if least == NEVER:
                break
            at = costs.index(least)
            ids[at] = least
            del ids[at + 1], edges[at + 1], costs[at]
            if at:
                costs[at - 1] = rank_of(data[edges[at - 1] : edges[at + 1]], NEVER)
            if at < len(costs):
                costs[at] = rank_of(data[edges[at] : edges[at + 2]], NEVER)
        return tuple(ids)

    def _merged_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap of offers instead of a look at all pairs for each merge."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # where the part that starts here ends
        start = list(range(-1, n))  # where the part that ends here starts
        start[0] = 0
        heap = [(ranks[data[i : i + 2]], i, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapq.heapify(heap)
        gone = bytearray(n)

        def offer(left: int, right: int) -> None:
            rank = ranks.get(data[left : end[right]])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end[right]))

        while heap:
            _, left, stop = heapq.heappop(heap)
            right = end[left]
            if gone[left] or right >= n or gone[right] or end[right] != stop:
                continue
            gone[right] = 1
            end[left], start[stop] = stop, left
            if left:
                offer(start[left], left)
            if stop < n:
                offer(left, stop)
        at, out = 0, []
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return tuple(out)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of both lists, each the encoding of its own."""
        if not left or not right:
            return left + right
        edge = (left[-1], right[0])
        window = self.window[self.bytes_of[edge[0]] + self.bytes_of[edge[1]]]
        if window == edge:
            return left + right
        i = j = 1
        while True:
            grow_left = i < len(left) and window[0] != left[-i]
            grow_right = j < len(right) and window[-1] != right[j - 1]
            if not grow_left and not grow_right:
                return left[: len(left) - i] + window + right[j:]
            i = min(2 * i, len(left)) if grow_left else i
            j = min(2 * j, len(right)) if grow_right else j
            window = self.window[b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j]))]

    def reduced(self, data: bytes) -> tuple[int, ...]:
        """Halve, encode the halves, join."""
        if len(data) <= STEM:
            return self.stem[data]
        half = len(data) // 2
        return self.join(self.reduced(data[:half]), self.reduced(data[half:]))

    def _stem(self, data: bytes) -> tuple[int, ...]:
        if len(data) < 2:
            return (self.ranks[data],) if data else ()
        half = len(data) // 2
        return self.join(self.stem[data[:half]], self.stem[data[half:]])

    def piece(self, piece: str) -> tuple[int, ...]:
        """A piece that is a token itself stays whole, even if no merges lead to it."""
        data = piece.encode("utf-8", "replace")
        rank = self.ranks.get(data)
        return self.reduced(data) if rank is None else (rank,)

    # --- whole texts ----------------------------------------------------------------------

    def _packed_piece(self, piece: str) -> bytes:
        return array("i", self.piece(piece)).tobytes()

    def _packed_text(self, text: str) -> bytes:
        return b"".join(map(self.packed_piece.__getitem__, self.pieces(text)))

    def _packed_unit(self, unit: str) -> bytes:
        first = self.first_piece(unit)
        if first is not None and first.end() == len(unit):
            return self._packed_piece(unit)
        return self._packed_text(unit)

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text, four bytes each.

        Between a character and a space after it every match of the pattern ends, so a text is the
        concatenation of its parts between spaces, unless a space follows other white space.
        """
        if not text:
            return b""
        if not self.cut_at_spaces or run_before_space(text):
            return self._packed_text(text)
        first, *rest = text.split(" ")
        return self.packed_unit[first] + b"".join(map(self.packed_spaced.__getitem__, rest))


class Decoder:
    """Bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def decoded(self, ids: np.ndarray) -> bytes:
        """Leaves of many ids each, concatenated; an id that is no token's is an error."""
        leaves = (ids[at : at + LEAF].tolist() for at in range(0, len(ids), LEAF))
        try:
            return b"".join(b"".join(map(self.bytes_of.__getitem__, leaf)) for leaf in leaves)
        except KeyError as unknown:
            raise ValueError(f"no token has the id {unknown.args[0]}") from None


#: of this Python worker: the encoder and decoder that its last task used
_KEPT: dict[tuple, tuple[Encoder, Decoder]] = {}


def kept_coders(vocabulary: bytes, pattern: str, cut_at_spaces: bool) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a worker, which a later task with the same settings finds with what they remember.

    Others take their place: a worker never holds the memos of two encoders.
    """
    key = (hashlib.sha256(vocabulary).digest(), pattern, cut_at_spaces)
    if key not in _KEPT:
        _KEPT.clear()
        ranks = read_ranks(vocabulary)
        _KEPT[key] = Encoder(ranks, pattern, cut_at_spaces), Decoder(ranks)
    return _KEPT[key]


def load_vocabulary(path: str) -> bytes:
    """A rank file on the driver, which sends it to the executors; bounded by ``MAX_VOCABULARY``."""
    with open(path, "rb") as file:
        raw = file.read(MAX_VOCABULARY + 1)
    if len(raw) > MAX_VOCABULARY:
        raise ValueError(f"{path} holds more than {MAX_VOCABULARY} bytes")
    return raw


def _map_column(df: DataFrame, column: str, added: dict[str, T.DataType], keep: bool, work) -> DataFrame:
    """``df`` with the columns that ``work`` gives for its last column, which goes unless kept."""
    kept = [F.col(f"`{c}`") for c in df.columns if keep or c != column]
    source = df.select(*kept, F.col(f"`{column}`").alias("__in"))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(name, kind) for name, kind in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = work()
        for batch in batches:
            for part in _slices(batch):
                columns = [*part.columns[:-1], *apply(part.column(part.num_columns - 1))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``SLICE`` bytes; a longer row alone."""
    column = batch.column(batch.num_columns - 1)
    per_row = max(column.nbytes // max(batch.num_rows, 1), 1)
    step = max(SLICE // per_row, 1)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def _encoded(encoder: Encoder, texts: pa.Array) -> pa.Array:
    """The ids of each text of a column."""
    rows = [encoder.packed(text) for text in texts.to_pylist()]
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(row) // 4 for row in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype="i4")))


def _decoded(decoder: Decoder, lists: pa.Array) -> pa.Array:
    """The bytes of each list of a column of ids."""
    out = []
    for ids in lists:
        values = ids.values.drop_null() if ids.is_valid else None
        out.append(None if values is None else decoder.decoded(values.to_numpy(zero_copy_only=False)))
    return pa.array(out, type=pa.binary())


def encode(
    docs: DataFrame,
    vocabulary: bytes,
    pattern: str,
    column: str = "text",
    keep_text: bool = False,
    cut_at_spaces: bool = True,
) -> DataFrame:
    """The rows of ``docs`` with ``ids`` (array<int>; underscores follow if that name is taken).

    ``vocabulary`` is the content of a rank file. Each match of ``pattern`` is encoded by itself;
    what no match covers is left out, and no text stands for a special token. ``cut_at_spaces``
    says that no match goes on from another character to a space, which holds for the patterns of
    public byte-level tokenizers. Null and empty texts get no ids; repeated rows stay as they are;
    an empty table gives no rows. The column read is dropped unless ``keep_text``.
    """
    vocabulary_b = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        encoder, _ = kept_coders(vocabulary_b.value, pattern, cut_at_spaces)
        return lambda texts: (_encoded(encoder, texts),)

    added = {fresh(docs, "ids"): T.ArrayType(T.IntegerType())}
    return _map_column(docs.withColumn(column, F.col(f"`{column}`").cast("string")), column, added, keep_text, work)


def decode(encoded: DataFrame, vocabulary: bytes, column: str = "ids", keep_ids: bool = True) -> DataFrame:
    """The rows with ``decoded``, the bytes of their ids (underscores follow if the name is taken).

    Null ids give null, empty ones empty bytes; null elements count for nothing. An id outside the
    vocabulary fails the job, as silently wrong bytes would be worse.
    """
    vocabulary_b = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        decoder = Decoder(read_ranks(vocabulary_b.value))
        return lambda lists: (_decoded(decoder, lists),)

    added = {fresh(encoded, "decoded"): T.BinaryType()}
    return _map_column(encoded.withColumn(column, F.col(f"`{column}`").cast("array<int>")), column, added, keep_ids, work)


def round_trip(
    docs: DataFrame,
    vocabulary: bytes,
    pattern: str,
    column: str = "text",
    keep_text: bool = False,
    cut_at_spaces: bool = True,
) -> DataFrame:
    """The rows with ``ids`` and ``decoded``, as ``encode`` and then ``decode`` give them.

    Both run in one Python worker a task, where one after the other holds two.
    """
    vocabulary_b = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        encoder, decoder = kept_coders(vocabulary_b.value, pattern, cut_at_spaces)

        def apply(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
            ids = _encoded(encoder, texts)
            return ids, _decoded(decoder, ids)

        return apply

    added = {fresh(docs, "ids"): T.ArrayType(T.IntegerType()), fresh(docs, "decoded"): T.BinaryType()}
    return _map_column(docs.withColumn(column, F.col(f"`{column}`").cast("string")), column, added, keep_text, work)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text.

    One row for each row of ``docs``, whatever doc_id it has, null included.
    """
    both = round_trip(docs.select("doc_id", "text"), load_vocabulary(path), pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
