"""Word-shingle sets of texts as sorted 64-bit hashes, computed for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes of text that are hashed together.
SLICE_BYTES = 1 << 19
STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * STEPS[0]
    x = (x ^ (x >> np.uint64(27))) * STEPS[1]
    return x ^ (x >> np.uint64(31))


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) in runs of about SLICE_BYTES; a longer text is a run of its own."""
    run: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        if run and size + len(data) > SLICE_BYTES:
            yield first, run
            run, first, size = [], i, 0
        run.append(data)
        size += len(data)
    if run:
        yield first, run


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles: WIDTH words, or all words of a shorter text."""
    joined = b"\n".join(t.lower() for t in texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return [np.empty(0, np.uint64) for _ in texts]
    # a word is the sum of one mixed value for each byte and its place in the word: no polynomial, which
    # has colliding words of its own for every base modulo a power of two
    place = np.arange(len(data), dtype=np.uint64)
    from_word = np.concatenate(([0], begin))
    place -= np.repeat(place[from_word], np.diff(np.append(from_word, len(data))))
    each = mix((place << np.uint64(8) | data) * STEPS[3] + STEPS[4])
    each[space] = 0
    words = mix(np.add.reduceat(each, begin) + (end - begin).astype(np.uint64) * STEPS[2])
    stops = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(stops, begin, side="right")
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    grams = np.empty(0, np.uint64)
    if len(words) >= WIDTH:
        grams = mix(sum(words[k : len(words) - WIDTH + 1 + k] * STEPS[k] for k in range(WIDTH)))
    found = []
    for a, b in zip(first, first[1:]):
        if b - a >= WIDTH:
            found.append(np.unique(grams[a : b - WIDTH + 1]))
        elif b > a:
            few = words[a:b] * STEPS[: b - a]
            found.append(mix(few.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def digests(hashes: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit digests of a set of hashes."""
    n = len(hashes)
    place = mix(np.arange(1, n + 1, dtype=np.uint64) * STEPS[3]) | np.uint64(1)
    one = (mix(hashes) * place).sum(dtype=np.uint64, keepdims=True)
    two = (mix(hashes ^ STEPS[4]) * (place + np.uint64(2))).sum(dtype=np.uint64, keepdims=True)
    both = mix(np.concatenate((one, two)) + np.uint64(n)).astype(np.int64)
    return int(both[0]), int(both[1])
