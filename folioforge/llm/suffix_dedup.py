"""Removal of byte passages that an earlier document already holds, by a hash-compared suffix sort.

A byte is removed when some window of WINDOW bytes that covers it also starts in a document with a smaller id.

1. Anchors (``anchors``) find the segments whose anchor occurs elsewhere: a scan block sends each anchor once,
   so an anchor is never more than the number of blocks in its bucket. Segments with a lone anchor hold no
   repeated window and are left out of all that follows.
2. The other segments meet by anchor, one for each content and block. Equal segments are resolved by digest,
   their bytes compared. What is left are segments that agree around their anchor only: their windows are the
   suffixes of a text made of these segments, and are put in order by a merge sort whose comparisons find the
   common extension of two suffixes by binary search over prefix polynomial hashes. Neighbours that agree over
   a whole window are compared byte by byte, and the least document of each class owns it.
3. An anchor with many contents in one block (a common line with any text after it) is split: its windows are
   sent on by their own content, so that no bucket has to hold them all, and meet by two hashes and their bytes.
4. The windows found cover the bytes to remove.

A row's address, by which its marks find it, is its doc_id, or a digest of id and text where the id is null or
stands for several texts; what decides which document is earlier is the doc_id alone.

Defined cases: a null text is empty; texts under WINDOW bytes keep all bytes; matches never cross documents;
a null doc_id counts as the largest; rows that share a doc_id, null included, are documents of their own, none of
them earlier than another; repeated rows get the same result each; an empty table gives no rows; other columns of
the input are carried along if ``carry`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.llm.anchors import SEGMENT, SPAN, WINDOW, pieces, prefix_sums, segments, substring_hash
from folioforge.llm.common import bucket_keys, mapped, spread, stash, unstash
from folioforge.llm.shingles import mix

#: Segments that a block gathers before it sends them.
BLOCK_SEGMENTS = 1_500_000
#: Contents of one anchor in one block from which its windows go by content.
MANY = 16
#: Bytes of a segment's row: the longest segment.
ROW = WINDOW + SPAN - 1
NO_ID = (1 << 63) - 1

SENT = "kind int, bucket int, data binary"
ANCHORS, MARKS, SEGMENTS, WINDOWS = 0, 1, 2, 3
#: What an address is XORed with to get the number that orders documents: 0 for nearly all.
SHIFT = [("shift", "<i8")]
MARK = [("doc", "<i8"), ("start", "<u4"), ("windows", "<u1")]
ANCHOR = [("anchor", "<u8"), ("doc", "<i8"), ("start", "<u4")]
SENT_SEGMENT = SEGMENT + SHIFT
BY_CONTENT = [("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("start", "<u4")] + SHIFT
WEIGHTS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def pack(fields: dict[str, np.ndarray]) -> bytes:
    """Columns as planes of bytes: the high planes of small numbers are zeros, which shuffles compress."""
    out = []
    for x in fields.values():
        x = np.ascontiguousarray(x)
        out.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())
    return b"".join(out)


def unpack(data: bytes, kinds: list[tuple[str, str]], extra: int = 0) -> dict[str, np.ndarray]:
    """The columns of ``pack``; ``extra`` bytes a row follow as the matrix ``rows``."""
    widths = [np.dtype(k).itemsize for _, k in kinds]
    n = len(data) // (sum(widths) + extra)
    out, at = {}, 0
    for (name, kind), width in zip(kinds, widths):
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out[name] = np.ascontiguousarray(planes.T).view(kind).reshape(n)
        at += n * width
    if extra:
        out["rows"] = np.frombuffer(data, np.uint8, n * extra, at).reshape(n, extra)
    return out


def join(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}


def take(fields: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {name: x[which] for name, x in fields.items()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["kind", "bucket", "data"])


def by_bucket(kind: int, fields: dict[str, np.ndarray], key: np.ndarray, buckets: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows of the packed columns, one for each bucket of ``key``."""
    if not len(key):
        return
    bucket = (mix(key.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(len(buckets))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(edges, [*edges[1:], len(order)]):
        some = order[a:b]
        packed = pack({n: fields[n][some] for n, _ in LAYOUT[kind]})
        if "rows" in fields:
            packed += fields["rows"][some].tobytes()
        yield _batch([(kind, buckets[bucket[some[0]]], packed)])


#: Columns of each kind of row, in the order in which they are packed.
LAYOUT = {ANCHORS: ANCHOR, MARKS: MARK, SEGMENTS: SENT_SEGMENT, WINDOWS: BY_CONTENT}


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return new


def _texts(batch: pa.RecordBatch) -> tuple[list[int], list[bytes]]:
    return batch.column("doc_id").to_pylist(), [(t or "").encode() for t in batch.column("text").to_pylist()]


def _send_anchors(buckets: list[int]):
    """Each anchor of a block once; segments whose anchor the block holds more than once are marked here."""

    def block(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s = np.concatenate(parts)
        parts.clear()
        s = s[np.argsort(s["anchor"], kind="stable")]
        new = heads(s["anchor"])
        again = ~new
        again[:-1] |= ~new[1:]
        first = s[new]
        yield from by_bucket(ANCHORS, {n: first[n] for n, _ in ANCHOR}, first["anchor"], buckets)
        here = s[again]
        yield from by_bucket(MARKS, {n: here[n] for n, _ in MARK}, here["doc"].copy(), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                ids, texts = _texts(whole.slice(at, 1000))
                for piece in pieces(texts):
                    parts.append(segments(piece, ids)[[n for n, _ in ANCHOR] + ["windows"]])
                    size += len(parts[-1])
                    if size >= BLOCK_SEGMENTS:
                        yield from block(parts)
                        parts, size = [], 0
        if parts:
            yield from block(parts)

    return run


def _meet_anchors(buckets: list[int]):
    """Marks of the segments whose anchor came from several blocks; marks pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for kind, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if kind == MARKS:
                    yield _batch([(kind, bucket, data)])
                else:
                    parts.append(unpack(data, ANCHOR))
        if not parts:
            return
        s = join(parts)
        s = take(s, np.argsort(s["anchor"], kind="stable"))
        new = heads(s["anchor"])
        again = ~new
        again[:-1] |= ~new[1:]
        s = take(s, again)
        yield from by_bucket(MARKS, {"doc": s["doc"], "start": s["start"], "windows": np.ones(len(s["doc"]), np.uint8)}, s["doc"], buckets)

    return run


def _gather_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, marks): the packed starts and window counts of each document in this partition."""
    parts = [unpack(d, MARK) for batch in batches for d in batch.column("data").to_pylist()]
    if not parts:
        return
    s = join(parts)
    s = take(s, np.lexsort((s["start"], s["doc"])))
    edges = np.flatnonzero(heads(s["doc"]))
    ends = [*edges[1:].tolist(), len(s["doc"])]
    docs = s["doc"][edges].tolist()
    for i in range(0, len(docs), 2000):
        data = [pack({"start": s["start"][a:b], "windows": s["windows"][a:b]}) for a, b in zip(edges[i : i + 2000], ends[i : i + 2000])]
        yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 2000], pa.int64()), pa.array(data, pa.binary())], ["doc_id", "marks"])


def _true_digest(s: dict[str, np.ndarray], rows: np.ndarray) -> bool:
    """Equal digests must be equal bytes: compare neighbours; after a collision (True) the bytes themselves are numbered."""
    same = np.flatnonzero(~heads(s["anchor"], s["digest"]))
    for a in range(0, len(same), 20_000):
        k = same[a : a + 20_000]
        if (rows[s["row"][k]] != rows[s["row"][k - 1]]).any():
            view = np.ascontiguousarray(rows[s["row"]]).view([("", f"V{ROW}")]).ravel()
            s["digest"] = np.unique(view, return_inverse=True)[1].astype(np.uint64)
            return True
    return False


def order_of(s: dict[str, np.ndarray]) -> np.ndarray:
    """The number that orders documents."""
    return s["doc"] ^ s["shift"]


def split_later(s: dict[str, np.ndarray], *by: str) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The rows sorted by ``by`` and document: those of each group's least document, and the later ones."""
    s = take(s, np.lexsort((s["doc"], order_of(s), *(s[c] for c in reversed(by)))))
    new, order = heads(*(s[c] for c in by)), order_of(s)
    later = order > order[new][np.cumsum(new) - 1]
    return take(s, ~later), take(s, later)


def marks(s: dict[str, np.ndarray], buckets: list[int]) -> Iterator[pa.RecordBatch]:
    windows = s["windows"] if "windows" in s else np.ones(len(s["doc"]), np.uint8)
    yield from by_bucket(MARKS, {"doc": s["doc"], "start": s["start"], "windows": windows}, s["doc"], buckets)


def windows_of(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Each window of the segments by two independent hashes of its bytes."""
    row = np.repeat(np.arange(len(s["doc"])), s["windows"])
    first = np.cumsum(s["windows"].astype(np.int64)) - s["windows"]
    j = np.arange(len(row)) - first[row]
    one, two, rows = np.empty(len(row), np.uint64), np.empty(len(row), np.uint64), np.empty((len(row), WINDOW), np.uint8)
    for a in range(0, len(row), 20_000):
        r, k = row[a : a + 20_000], j[a : a + 20_000]
        rows[a : a + 20_000] = s["rows"][r[:, None], k[:, None] + np.arange(WINDOW)]
        body = rows[a : a + 20_000].astype(np.uint64) + np.uint64(1)
        one[a : a + 20_000] = mix((body * WEIGHTS).sum(1, dtype=np.uint64))
        words = np.ascontiguousarray(rows[a : a + 20_000, :48]).view("<u8")
        x = mix(body[:, 48] * np.uint64(257) + body[:, 49])
        for c in range(6):
            x = mix(x ^ words[:, c])
        two[a : a + 20_000] = x
    return {"one": one, "two": two, "doc": s["doc"][row], "start": (s["start"][row] + j).astype(np.uint32), "shift": s["shift"][row], "rows": rows}


def told_apart(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Windows of equal hashes must have equal bytes: compare neighbours; after a collision the bytes themselves are numbered."""
    w = take(w, np.lexsort((w["two"], w["one"])))
    same = np.flatnonzero(~heads(w["one"], w["two"]))
    for a in range(0, len(same), 20_000):
        k = same[a : a + 20_000]
        if (w["rows"][k] != w["rows"][k - 1]).any():
            w["two"] = np.unique(w["rows"].view([("", f"V{WINDOW}")]).ravel(), return_inverse=True)[1].astype(np.uint64)
            break
    return w


def send_windows(w: dict[str, np.ndarray], buckets: list[int]) -> Iterator[pa.RecordBatch]:
    """Windows by content: the least document of each content goes on, the others are resolved here."""
    w, later = split_later(told_apart(w), "one", "two")
    yield from marks(later, buckets)
    del later
    yield from by_bucket(WINDOWS, w, w["one"], buckets)


def _send_segments(buckets: list[int]):
    """A block's marked segments: one document of each content goes on by anchor, later ones are resolved here."""

    def block(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        s = join(parts)
        parts.clear()
        rows = s.pop("rows")
        s["row"] = np.arange(len(rows))
        s = take(s, np.lexsort((s["digest"], s["anchor"])))
        _true_digest(s, rows)
        s, later = split_later(s, "anchor", "digest")
        yield from marks(later, buckets)
        del later
        s["rows"] = rows[s.pop("row")]
        del rows
        anchor_of = np.cumsum(heads(s["anchor"])) - 1
        contents = np.bincount(anchor_of, weights=heads(s["anchor"], s["digest"]))
        many = contents[anchor_of] > MANY
        if many.any():
            yield from send_windows(windows_of(take(s, many)), buckets)
            sign = many & heads(s["anchor"])  # tells the anchor's bucket that its windows go by content
            signs = take(s, sign) | {"windows": np.zeros(int(sign.sum()), np.uint8)}
            s = join([take(s, ~many), signs])
        yield from by_bucket(SEGMENTS, s, s["anchor"], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids, texts = _texts(batch)
                shifts = batch.column("shift").to_numpy()
                marked = [unpack(m, MARK[1:])["start"] for m in batch.column("marks").to_pylist()]
                for piece in pieces(texts):
                    s = segments(piece, list(range(len(ids))))  # documents by their place in the batch
                    wanted = np.concatenate([(np.uint64(i) << np.uint64(32)) | marked[i].astype(np.uint64) for i in sorted({i for i, _, _ in piece})])
                    s = s[np.isin((s["doc"].astype(np.uint64) << np.uint64(32)) | s["start"], wanted)]
                    if not len(s):
                        continue
                    fields = {n: np.ascontiguousarray(s[n]) for n, _ in SEGMENT} | {"rows": rows_of(s, texts)}
                    fields["shift"] = shifts[s["doc"]]
                    fields["doc"] = np.array(ids, np.int64)[s["doc"]]
                    parts.append(fields)
                    size += len(s)
                    if size >= BLOCK_SEGMENTS // 4:
                        yield from block(parts)
                        parts, size = [], 0
        if parts:
            yield from block(parts)

    return run


def rows_of(s: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """The bytes of each segment, zeros after its end."""
    docs = np.unique(s["doc"])
    base = np.zeros(len(texts) + 1, np.int64)
    lengths = np.array([len(texts[d]) for d in docs], np.int64)
    base[docs] = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts[d] for d in docs) + bytes(ROW), np.uint8)
    at = base[s["doc"]] + s["start"]
    rows = data[at[:, None] + np.arange(ROW)]
    rows[np.arange(ROW) >= (s["windows"].astype(np.int64) + WINDOW - 1)[:, None]] = 0
    return rows


def common_extension(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length, up to WINDOW, over which the suffixes at a and b agree: binary search over prefix hashes."""
    length = np.zeros(len(a), np.int64)
    step = 1 << (WINDOW.bit_length() - 1)
    while step:
        fits = length + step <= WINDOW
        x, y = a + length, b + length
        x, y = np.where(fits, x, a), np.where(fits, y, b)
        length += step * (fits & (substring_hash(sums, x, step) == substring_hash(sums, y, step)))
        step >>= 1
    return length


def suffix_order(data: np.ndarray, sums: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of suffixes, compared over WINDOW bytes, inside groups (``group`` ascends): a bottom-up merge sort.

    All merges of a level run together: each suffix finds its rank in the sibling run by binary search.
    """
    n = len(at)
    new = heads(group)
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]
    size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    order = np.arange(n)
    inside = np.arange(n) - begin
    width = 1
    while width < size.max(initial=0):
        pair = inside // (2 * width) * (2 * width)
        left = inside - pair < width
        low = np.where(left, pair + width, pair)
        high = np.minimum(np.where(left, pair + 2 * width, pair + width), size)
        low = np.minimum(low, size)
        start = low.copy()
        me = at[order]
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) // 2
            other = at[order[begin[live] + middle]]
            agree = common_extension(sums, me[live], other)
            ended = agree >= WINDOW
            mine, theirs = data[me[live] + np.minimum(agree, WINDOW - 1)], data[other + np.minimum(agree, WINDOW - 1)]
            above = np.where(ended, ~left[live], mine > theirs)  # of equals, the left run's come first
            low[live] = np.where(above, middle + 1, low[live])
            high[live] = np.where(above, high[live], middle)
            live = live[low[live] < high[live]]
        to = begin + pair + np.where(left, inside - pair, inside - pair - width) + (low - start)
        moved = np.empty(n, np.int64)
        moved[to] = order
        order = moved
        width *= 2
    return order


def owned_earlier(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of the windows of ``s`` that a smaller document's segment of the same anchor holds too.

    ``s`` is sorted by anchor and holds one document's row for each content.
    """
    row = np.repeat(np.arange(len(s["doc"])), s["windows"])
    first = np.cumsum(s["windows"].astype(np.int64)) - s["windows"]
    j = np.arange(len(row)) - first[row]
    place = s["at"][row] - j
    anchor = np.cumsum(heads(s["anchor"]))[row]
    key = anchor * (SPAN + 1) + place
    order = np.argsort(key, kind="stable")
    new = heads(key[order])
    single = new & np.concatenate((new[1:], [True]))
    order = order[~single]
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = s["rows"].ravel()
    sums = prefix_sums(data)
    at = row[order] * ROW + j[order]
    group = key[order]
    ranked = suffix_order(data, sums, at, group)
    order, at, group = order[ranked], at[ranked], group[ranked]
    equal = np.zeros(len(at), bool)
    equal[1:] = (group[1:] == group[:-1]) & (common_extension(sums, at[1:], at[:-1]) >= WINDOW)
    where = np.flatnonzero(equal)
    for a in range(0, len(where), 50_000):  # hashes agree; so must the bytes
        w = where[a : a + 50_000]
        span = np.arange(WINDOW)
        equal[w] = (data[at[w][:, None] + span] == data[at[w - 1][:, None] + span]).all(1)
    doc = order_of(s)[row[order]]
    starts = np.flatnonzero(~equal)
    least = np.minimum.reduceat(doc, starts)[np.cumsum(~equal) - 1]
    found = order[doc > least]
    return row[found], j[found]


def _meet_segments(buckets: list[int]):
    """Marks of the windows that a smaller document's segment holds; marks and windows of the blocks pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for kind, bucket, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if kind == SEGMENTS:
                    parts.append(unpack(data, SENT_SEGMENT, ROW))
                else:
                    yield _batch([(kind, bucket, data)])
        if not parts:
            return
        s = join(parts)
        parts.clear()
        s = take(s, np.lexsort((s["digest"], s["anchor"])))
        anchor_of = np.cumsum(heads(s["anchor"])) - 1
        split = np.bincount(anchor_of, weights=s["windows"] == 0)[anchor_of] > 0
        if split.any():
            yield from send_windows(windows_of(take(s, split & (s["windows"] > 0))), buckets)
            s = take(s, ~split)
        if not len(s["doc"]):
            return
        s["row"] = np.arange(len(s["doc"]))
        _true_digest(s, s["rows"])
        del s["row"]
        s, later = split_later(s, "anchor", "digest")
        yield from marks(later, buckets)
        del later
        anchor_of = np.cumsum(heads(s["anchor"])) - 1
        contents = np.bincount(anchor_of, weights=heads(s["anchor"], s["digest"]))
        s = take(s, contents[anchor_of] > 1)
        # runs of whole anchors of a bounded size
        edges = np.flatnonzero(heads(s["anchor"]))
        cut = [0]
        for e in edges.tolist():
            if e - cut[-1] >= 20_000:
                cut.append(e)
        for a, b in zip(cut, [*cut[1:], len(s["doc"])]):
            some = {n: x[a:b] for n, x in s.items()}
            one = heads(some["anchor"], some["digest"])
            content = np.cumsum(one) - 1  # a document may hold a content several times
            segment, j = owned_earlier(take(some, one))
            if not len(segment):
                continue
            order = np.lexsort((j, segment))
            segment, j = segment[order], j[order]
            new = np.ones(len(j), bool)
            new[1:] = (segment[1:] != segment[:-1]) | (j[1:] != j[:-1] + 1)
            begin = np.flatnonzero(new)
            length = np.diff(np.concatenate((begin, [len(j)])))
            by_content = np.argsort(segment[begin], kind="stable")
            low = np.searchsorted(segment[begin], content, "left")
            high = np.searchsorted(segment[begin], content, "right")
            holder = np.repeat(np.arange(len(content)), high - low)
            offset = np.arange(len(holder)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            which = by_content[low[holder] + offset]
            yield from marks({"doc": some["doc"][holder], "start": (some["start"][holder] + j[begin][which]).astype(np.uint32), "windows": length[which].astype(np.uint8)}, buckets)

    return run


def _meet_windows(buckets: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(d, BY_CONTENT, WINDOW) for batch in batches for d in batch.column("data").to_pylist()]
        if parts:
            yield from marks(split_later(told_apart(join(parts)), "one", "two")[1], buckets)

    return run


CLEANED = "kept {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>"


def spans_of(data: bytes) -> list[tuple[int, int]]:
    """The runs of bytes that marked windows cover."""
    m = unpack(data, MARK[1:])
    begin = m["start"].astype(np.int64)
    reach = np.maximum.accumulate(begin + m["windows"] + WINDOW - 1)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return list(zip(begin[first].tolist(), reach[np.append(first[1:], len(begin)) - 1].tolist()))


def _cut(carry: list[str], as_text: bool):
    """Each document without the bytes that its marked windows cover."""
    kinds = (pa.string() if as_text else pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                out: list[list] = [[], [], [], []]
                for text, copy, data in zip(batch.column("text").to_pylist(), batch.column("copy").to_pylist(), batch.column("marks").to_pylist()):
                    text = (text or "").encode()
                    spans = [(0, len(text))] if copy and len(text) >= WINDOW else spans_of(data) if data else []
                    ends = [0, *(x for span in spans for x in span), len(text)]
                    rest = b"".join(text[a:b] for a, b in zip(ends[0::2], ends[1::2]))
                    # as text: characters that a cut went through are left out
                    kept = rest.decode(errors="ignore") if as_text else rest
                    for column, value in zip(out, (kept, len(text), len(text) - len(rest), [{"start": a, "end": b} for a, b in spans])):
                        column.append(value)
                arrays = [batch.column("others").field(c) for c in carry] + [pa.array(x, k) for x, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, [*carry, "kept", "n_bytes", "n_removed", "spans"])

    return run


def _address(of: Column) -> Column:
    """An address that no doc_id has in practice: below -2**62."""
    return F.lit(-(1 << 63)) + F.shiftrightunsigned(of, 2)


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), as_text: bool = False) -> DataFrame:
    """(*carry, kept, n_bytes, n_removed, spans) of ``docs`` (doc_id, text): remaining bytes, or text, and removed runs."""
    spark = docs.sparkSession
    buckets = bucket_keys(spark)
    text = F.coalesce("text", F.lit(""))
    # the first address needs the row alone; ids of several texts share it, which marks more segments than there are
    rows = docs.select(F.coalesce("doc_id", _address(F.xxhash64(text))).alias("address"), text.alias("text"), F.col("doc_id").alias("id"), F.struct(*carry).alias("others"))
    hashed = rows.select("address", F.coalesce("id", F.lit(NO_ID)).alias("place"), F.sha2("text", 256).alias("sha")).distinct()
    nth = F.row_number().over(Window.partitionBy("address").orderBy("sha", "place"))
    own = F.when(nth == 1, F.col("address")).otherwise(_address(F.xxhash64("place", "sha")))
    hashed = stash(hashed.withColumn("own", own), "hashed")
    # equal texts: all but those of the least id are removed whole
    firsts = hashed.groupBy("sha").agg(F.min("place").alias("first"))
    known = hashed.join(spread(firsts, "sha"), "sha")
    known = stash(known.select("address", "sha", "own", F.col("place").bitwiseXOR(F.col("own")).alias("shift"), (F.col("place") != F.col("first")).alias("copy")), "known")
    unstash(hashed)

    gather = lambda sent: mapped(sent.repartition("bucket").select("data"), _gather_marks, "address long, marks binary")
    sources = rows.select(F.col("address").alias("doc_id"), "text")
    anchors = mapped(mapped(sources, _send_anchors(buckets), SENT).repartition("bucket"), _meet_anchors(buckets), SENT)
    marked = stash(gather(anchors), "marked")

    same = ["address", "sha"]
    hashed_rows = rows.withColumn("sha", F.sha2("text", 256))
    wanted = known.where("NOT copy").join(marked, "address").select("address", "sha", "own", "shift", "marks")
    held = hashed_rows.select("address", "sha", "text").join(wanted, same).select(F.col("own").alias("doc_id"), "text", "marks", "shift")
    sent = mapped(held, _send_segments(buckets), SENT)
    met = stash(mapped(sent.repartition("bucket"), _meet_segments(buckets), SENT), "met")
    unstash(marked)
    by_kind = lambda df, kind: df.where(F.col("kind") == kind)
    windows = mapped(by_kind(met, WINDOWS).repartition("bucket").select("data"), _meet_windows(buckets), SENT)
    found = stash(gather(by_kind(met, MARKS).union(windows)), "found")
    unstash(met)

    plan = known.join(found.withColumnRenamed("address", "own"), "own", "left").select("address", "sha", "copy", "marks")
    schema = T.StructType([*(docs.schema[c] for c in carry), *T._parse_datatype_string(CLEANED.format(kind="string" if as_text else "binary"))])
    held = hashed_rows.select("address", "sha", "text", "others").join(plan, same).select("text", "copy", "marks", "others")
    return mapped(held, _cut(list(carry), as_text), schema)
