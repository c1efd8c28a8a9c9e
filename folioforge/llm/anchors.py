"""Content-defined anchors of byte strings.

Every window of WINDOW bytes has an anchor, the GRAM-byte string inside it with the least hash (the first of
equals). Equal windows have equal anchors at equal places, so windows that are to meet can be sent by anchor;
neighbouring windows mostly share theirs, and a run of windows with one anchor travels as one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from folioforge.llm.shingles import SLICE_BYTES, mix

WINDOW = 50
GRAM = 24
SPAN = WINDOW - GRAM + 1
PLACE = np.uint64((1 << 22) - 1)

SEGMENT = [("anchor", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("windows", "u1"), ("at", "u1"), ("digest", "<u8")]
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * SLICE_BYTES)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, step in (("up", BASE), ("down", inverse)):
            each = np.full(size, step, np.uint64)
            each[0] = 1
            _powers[name] = np.multiply.accumulate(each)
    return _powers["up"][:n], _powers["down"][:n]


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Runs of (index, offset, bytes) of about SLICE_BYTES. Longer texts are cut so that each window is in one piece."""
    run: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - WINDOW + 1), SLICE_BYTES):
            piece = text[offset : offset + SLICE_BYTES + WINDOW - 1]
            if len(piece) < WINDOW:
                continue
            if run and size + len(piece) > SLICE_BYTES:
                yield run
                run, size = [], 0
            run.append((i, offset, piece))
            size += len(piece)
    if run:
        yield run


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes modulo 2**64."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    """The polynomial hash of a substring, free of its place."""
    _, down = powers(len(sums))
    return (sums[start + length] - sums[start]) * down[start]


def segments(run: list[tuple[int, int, bytes]], ids: list[int]) -> np.ndarray:
    """The segments of the pieces of a run: anchor hash, document, first window, windows, anchor's place in the first, digest."""
    data = np.frombuffer(b"".join(p for _, _, p in run), np.uint8)
    sums = prefix_sums(data)
    n = len(data) - GRAM + 1
    _, down = powers(len(sums))
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[:n])
    least = (grams & ~PLACE) | np.arange(n, dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    place = (least & PLACE).astype(np.int64)
    lengths = np.array([len(p) for _, _, p in run])
    ends = np.cumsum(lengths)
    piece = np.repeat(np.arange(len(run)), lengths)[: len(place)]
    valid = np.arange(len(place)) + WINDOW <= ends[piece]
    change = np.empty(len(place), bool)
    change[0] = True
    change[1:] = (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(change & valid)
    until = np.cumsum(valid)
    count = np.diff(np.concatenate((until[first] - 1, until[-1:])))
    found = np.empty(len(first), SEGMENT)
    of = piece[first]
    found["anchor"] = grams[place[first]]
    found["doc"] = np.array([ids[i] for i, _, _ in run], np.int64)[of]
    found["start"] = first - (ends - lengths)[of] + np.array([o for _, o, _ in run])[of]
    found["windows"], found["at"] = count, place[first] - first
    found["digest"] = mix(substring_hash(sums, first, count + WINDOW - 1) + (count * 64 + found["at"]).astype(np.uint64))
    return found
