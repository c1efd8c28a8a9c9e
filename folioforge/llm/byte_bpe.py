"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encoded pieces form a monoid under ``join``: the encoding of a concatenation is found from the encodings of
its halves. ``join`` re-encodes a window around the seam and widens it until both of its edge pairs are
stable. A pair of tokens is stable when encoding the concatenation of their bytes gives the same two tokens;
a token sequence of which every neighbouring pair is stable is the encoding of its bytes, so what lies
outside a window with stable edges cannot change. Decoding concatenates up the same tree. The leaves of all
pieces of a batch are merged together, one merge a round in each leaf.

Defined cases: nulls count as empty texts; an empty text has no tokens; texts of any length are encoded whole;
repeated rows give repeated results; of equal ranks' pairs the first is merged; an empty table gives no rows.
Other columns of the input are carried along; output columns replace input columns of the same name.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioforge.llm.common import mapped

#: Above every rank: the pair is no token.
NO_RANK = 1 << 40
#: Pieces up to this many bytes are leaves of the reduction tree.
LEAF_BYTES = 12
#: Entries of each cache (pieces, seams) of a Python worker, kept from task to task; a full cache restarts.
CACHED_PIECES, CACHED_SEAMS = 240_000, 60_000
#: Longer pieces, in characters, are not remembered.
CACHED_LENGTH = 48
#: Pieces whose leaves are merged together.
MERGED_TOGETHER = 20_000
#: Rows of an output batch.
BATCH_ROWS = 256


class ByteBpe:
    """An encoder and decoder for a vocabulary of byte strings with ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.seams: dict[tuple[int, int], list[int]] = {}
        pairs = sorted(
            (ranks[token[:k]] << 32 | ranks[token[k:]], rank) for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks
        )
        #: keys of token pairs that make a token, in order, and the rank of what they make
        self.pairs, self.made = np.array([k for k, _ in pairs] + [1 << 63], np.uint64), np.array([r for _, r in pairs] + [NO_RANK], np.int64)
        self.of_byte = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        self.pieces: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge the neighbouring pair of lowest rank, the first of equals, until none has a rank."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 128:
            return self._merge_with_heap(piece)
        rank_of = self.ranks.get
        cuts = list(range(len(piece) + 1))
        pairs = [rank_of(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) < NO_RANK:
            at = pairs.index(best)
            del pairs[at], cuts[at + 1]
            if at < len(pairs):
                pairs[at] = rank_of(piece[cuts[at] : cuts[at + 2]], NO_RANK)
            if at:
                pairs[at - 1] = rank_of(piece[cuts[at - 1] : cuts[at + 1]], NO_RANK)
        return [self.ranks[piece[i:j]] for i, j in zip(cuts, cuts[1:])]

    def _merge_with_heap(self, piece: bytes) -> list[int]:
        """The same merges for long pieces in n log n: a linked list of parts and a heap of pairs."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = ranks.get(piece[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j] = False
            end[i], after[i] = stop, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def seam(self, left: int, right: int) -> list[int]:
        """The encoding of two tokens' bytes; the pair is stable if these are the two tokens."""
        found = self.seams.get((left, right))
        if found is None:
            if len(self.seams) >= CACHED_SEAMS:
                self.seams.clear()
            found = self.seams[left, right] = self.merge(self.token_bytes[left] + self.token_bytes[right])
        return found

    def stable(self, left: int, right: int) -> bool:
        return self.seam(left, right) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of a concatenation from the encodings of its two parts."""
        if not left or not right:
            return left or right
        window = self.seam(left[-1], right[0])
        if window == [left[-1], right[0]]:
            return left + right
        i = j = 1
        while True:
            cut = len(left) - i
            left_holds = cut == 0 or self.stable(left[cut - 1], window[0])
            right_holds = j == len(right) or self.stable(window[-1], right[j])
            if left_holds and right_holds:
                return left[:cut] + window + right[j:]
            i = i if left_holds else min(2 * i, len(left))
            j = j if right_holds else min(2 * j, len(right))
            window = self.merge(self.decode(left[len(left) - i :] + right[:j]))

    def rank_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.made[at], NO_RANK)

    def merge_leaves(self, leaves: list[bytes]) -> list[bytes]:
        """What ``merge`` gives for each leaf, as bytes of int32: rounds over a matrix with a row for each leaf."""
        if not leaves:
            return []
        size = np.array([len(x) for x in leaves])
        width = int(size.max())
        ids = self.of_byte[np.frombuffer(b"".join(x.ljust(width, b"\0") for x in leaves), np.uint8).reshape(-1, width)]
        span = np.arange(width)
        pairs = np.full((len(leaves), width), NO_RANK, np.int64)  # of each place and the next
        inside = span[:-1] + 1 < size[:, None]
        pairs[:, :-1][inside] = self.rank_of_pairs(ids[:, :-1][inside], ids[:, 1:][inside])
        live = np.flatnonzero(pairs.min(1) < NO_RANK)
        while len(live):
            some, rank = ids[live], pairs[live]
            at = rank.argmin(1)  # the first of equals
            n, row = size[live] - 1, np.arange(len(live))
            shift = np.minimum(span + (span > at[:, None]), width - 1)
            some, rank = np.take_along_axis(some, shift, 1), np.take_along_axis(rank, shift, 1)
            some[row, at] = pairs[live, at]
            rank[row, at] = NO_RANK
            rank[row, n - 1] = NO_RANK
            right, left = np.flatnonzero(at + 1 < n), np.flatnonzero(at > 0)
            rank[right, at[right]] = self.rank_of_pairs(some[right, at[right]], some[right, at[right] + 1])
            rank[left, at[left] - 1] = self.rank_of_pairs(some[left, at[left] - 1], some[left, at[left]])
            ids[live], pairs[live], size[live] = some, rank, n
            live = live[rank.min(1) < NO_RANK]
        data = ids[span < size[:, None]].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(size)).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def is_leaf(self, piece: bytes) -> bool:
        return len(piece) <= LEAF_BYTES or piece in self.ranks

    def leaves_of(self, piece: bytes) -> Iterator[bytes]:
        if self.is_leaf(piece):
            yield piece
        else:
            yield from self.leaves_of(piece[: len(piece) // 2])
            yield from self.leaves_of(piece[len(piece) // 2 :])

    def reduce(self, piece: bytes, leaves: dict[bytes, bytes]) -> list[int]:
        """Tree reduction of one piece: halves, then their join. The bytes of a token are encoded as that token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) <= LEAF_BYTES:
            return np.frombuffer(leaves[piece], np.int32).tolist()
        return self.join(self.reduce(piece[: len(piece) // 2], leaves), self.reduce(piece[len(piece) // 2 :], leaves))

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not in the cache."""
        for at in range(0, len(pieces), MERGED_TOGETHER):
            some = pieces[at : at + MERGED_TOGETHER]
            coded = [p.encode() for p in some]
            wanted = list(dict.fromkeys(x for c in coded for x in self.leaves_of(c) if x not in self.ranks))
            leaves = dict(zip(wanted, self.merge_leaves(wanted)))
            for piece, c in zip(some, coded):
                found = leaves.get(c)
                self.pieces[piece] = np.array(self.reduce(c, leaves), np.int32).tobytes() if found is None else found

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text: each match of the pattern is encoded separately, a piece that comes again once."""
        split = [self.split(t) for t in texts]
        pieces = set(chain.from_iterable(split))
        fresh = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(fresh) > CACHED_PIECES:
            self.pieces.clear()
            fresh = list(pieces)
        self.learn(fresh)
        found = [np.frombuffer(b"".join(map(self.pieces.__getitem__, x)), np.int32) for x in split]
        for p in fresh:
            if len(p) > CACHED_LENGTH:
                del self.pieces[p]
        return found

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.token_bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def id_lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """The tokenizer of a rank file (base64 token and rank on each line), once per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def _append(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), values], [*keep, name])


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in schema if f.name != name), T.StructField(name, kind)])


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as array<int> in ``ids``; a map without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                found = bpe.encode_all([t or "" for t in batch.column(text).to_pylist()])
                yield _append(batch, ids, id_lists(found))

    return mapped(docs, run, _with(docs.schema, ids, T.ArrayType(T.IntegerType())))


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of the token ids in ``ids`` as binary in ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                lists = batch.column(ids)
                flat = lists.flatten().to_numpy().tolist()  # of this slice alone; nulls have no values
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
                ends = [0, *accumulate(sizes)]
                found = [bpe.decode(flat[i:j]) for i, j in zip(ends, ends[1:])]
                yield _append(batch, decoded, pa.array(found, pa.binary()))

    return mapped(docs, run, _with(docs.schema, decoded, T.BinaryType()))


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both of the above in one pass: a task has one Python worker, and the ids cross over once. ``text`` is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                found = bpe.encode_all([t or "" for t in batch.column(text).to_pylist()])
                back = pa.array([bpe.decode(x.tolist()) for x in found], pa.binary())
                batch = batch.select([c for c in batch.schema.names if c != text])
                yield _append(_append(batch, ids, id_lists(found)), decoded, back)

    kept = T.StructType([f for f in docs.schema if f.name != text])
    return mapped(docs, run, _with(_with(kept, ids, T.ArrayType(T.IntegerType())), decoded, T.BinaryType()))
