"""Word shingles of texts as 64-bit numbers, inside tasks.

A text is lower-cased in A-Z, its words are runs of anything but space, tab, line feed, vertical tab, form
feed and carriage return. Its shingles are the runs of ``SIZE`` words; with fewer words the whole sequence is
its one shingle; without words there is none. A shingle is hashed as the bytes of its words joined by one
space: a polynomial over all its bytes, mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SIZE = 5
#: Bytes of words hashed at a time; a longer text is hashed in runs that overlap by SIZE - 1 words.
_RUN_BYTES = 1 << 18
_RUN_WORDS = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ShingleReader:
    """Shingle sets of texts; keeps the powers of the polynomial for one task."""

    def __init__(self) -> None:
        self._grow(_RUN_BYTES * 2)

    def _grow(self, size: int) -> None:
        self._powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(_BASE), np.uint64)]), dtype=np.uint64)
        self._inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(_INVERSE), np.uint64)]), dtype=np.uint64)

    def _hash(self, runs: list[list[bytes]]) -> list[np.ndarray]:
        words = [w for run in runs for w in run]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b" ".join(words), np.uint8)
        if len(data) >= len(self._powers):
            self._grow(len(data))
        starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[: len(data)], dtype=np.uint64)])
        first, last, cuts, at = [], [], [], 0
        for run in runs:
            n = max(1, len(run) - SIZE + 1)
            places = np.arange(at, at + n)
            first.append(places)
            last.append(places + (min(SIZE, len(run)) - 1))
            cuts.append(n)
            at += len(run)
        first, last = np.concatenate(first), np.concatenate(last)
        begin, end = starts[first], starts[last] + lengths[last]
        hashes = mix((sums[end] - sums[begin]) * self._inverses[begin])
        return np.split(hashes, np.cumsum(cuts)[:-1])

    def sets(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text, in order."""
        waiting: list[list[list[bytes]]] = []
        size = 0
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            step = _RUN_WORDS - SIZE + 1
            runs = [words[i : i + _RUN_WORDS] for i in range(0, max(1, len(words) - SIZE + 1), step)] if words else []
            waiting.append(runs)
            size += len(text or "")
            if size >= _RUN_BYTES:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[list[bytes]]]) -> Iterator[np.ndarray]:
        short = [runs[0] for runs in waiting if len(runs) == 1]
        hashed = iter(self._hash(short) if short else [])
        for runs in waiting:
            if not runs:
                yield np.empty(0, np.uint64)
            elif len(runs) == 1:
                yield np.unique(next(hashed))
            else:
                yield np.unique(np.concatenate([self._hash([run])[0] for run in runs]))
