"""Word and shingle hashes of whole texts, computed over byte arrays."""

from __future__ import annotations

import numpy as np

#: What parts words: space, tab, newline, vertical tab, form feed, return (a fixed value of the contract).
BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes that are hashed at once; a longer text is taken in parts that end at a blank.
PART = 1 << 20

_seeds = np.random.default_rng(20240607)
_BYTE = _seeds.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(BLANKS)] = False
_BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data``, A-Z as a-z, and where each begins.

    A word's hash is a polynomial of random byte values, taken as a difference of prefix sums.
    """
    raw = np.frombuffer(data, np.uint8)
    word = np.zeros(len(raw) + 2, np.int8)
    word[1:-1] = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(word))
    first, last = edge[::2], edge[1::2]
    power, inverse = _power(len(raw) + 1)
    prefix = np.empty(len(raw) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=prefix[1:])
    return mix64((prefix[last] - prefix[first]) * inverse[first] + (last - first).astype(np.uint64)), first


def words_of(texts: list[bytes]) -> list[np.ndarray]:
    """The word hashes of each text, several texts at a time."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            hashes, first = hash_words(b"\n".join(held))
            ends = np.cumsum([len(x) + 1 for x in held])
            cuts = np.searchsorted(first, ends)
            out.extend(hashes[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()))
        held, size = [], 0

    for text in texts:
        if len(text) > PART:
            flush()
            out.append(np.concatenate([hash_words(x)[0] for x in parts(text)]))
            continue
        if size + len(text) > PART:
            flush()
        held.append(text)
        size += len(text) + 1
    flush()
    return out


def parts(text: bytes, most: int = PART):
    """``text`` in parts of about ``most`` bytes that end before a blank."""
    at = 0
    while at < len(text):
        end = at + most
        if end < len(text):
            found = [x for x in (text.find(bytes([b]), end) for b in BLANKS) if x >= 0]
            end = min(found) if found else len(text)
        yield text[at:end]
        at = end


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of the ``width``-word shingles; fewer words make one shingle; none, none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    take = min(width, n)
    acc = np.full(n - take + 1, np.uint64(take), np.uint64)
    for k in range(take):
        acc = acc * _STEP + words[k : k + len(acc)]
    acc = mix64(acc)
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]
