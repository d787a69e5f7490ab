"""Content-defined positions of texts: for every window of `length` bytes the one that decides for it."""

from __future__ import annotations

#: Bytes hashed at once; with positions in 24 bits a window's least hash names its place.
SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15


def powers(n: int):
    """The base's powers and those of its inverse modulo 2^64."""
    import numpy as np

    from quern.llm._common import worker_cache

    cache = worker_cache()
    if "powers" not in cache or len(cache["powers"][0]) < n:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(n, np.uint64(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        cache["powers"] = out
    return cache["powers"]


def anchors(texts: list[bytes], length: int, size: int):
    """(text, position, first, last, key) arrays: the anchors of all texts' windows of `length` bytes.

    A window's anchor is the place of the `size` bytes of least hash in it, the
    leftmost of equals, which its bytes alone decide; `first` to `last` are the
    starts of the windows that share it, `key` is the hash at the anchor.
    """
    import numpy as np

    out: list[tuple] = []
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def flush():
        nonlocal held, total
        if held:
            out.append(segment(held, length, size))
        held, total = [], 0

    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), SEGMENT):
            piece = text[at : at + SEGMENT + length - 1]
            if total + len(piece) > SEGMENT + length:
                flush()
            held.append((i, at, piece))
            total += len(piece)
    flush()
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(5))


def segment(held: list[tuple[int, int, bytes]], length: int, size: int):
    import numpy as np

    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    n, span = len(data), length - size + 1
    up, down = powers(SEGMENT + 2 * length + 2)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(up[:n] * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    m = len(h)
    keyed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // span)
    square = np.full(blocks * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    square[:m] = keyed
    square = square.reshape(blocks, span)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = (np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts]) & np.uint64(0xFFFFFF)).astype(np.int64)
    # Windows that cross from one text to the next aren't windows.
    sizes = np.array([len(p) for _, _, p in held])
    begin = np.concatenate([[0], sizes.cumsum()])
    good = np.ones(starts, bool)
    for e in begin[1:-1]:
        good[max(0, e - length + 1) : e] = False
    where = np.flatnonzero(good)
    of = np.searchsorted(begin, where, side="right") - 1
    at = least[where]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
    first = where[new]
    last = where[np.concatenate([new[1:] - 1, [len(where) - 1]])]
    of, at = of[new], at[new]
    text = np.array([i for i, _, _ in held])[of]
    shift = np.array([a for _, a, _ in held])[of] - begin[of]
    return text, at + shift, first + shift, last + shift, h[at].view(np.int64)
