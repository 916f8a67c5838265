"""Words and runs of words as 64-bit numbers, for tasks that work on whole texts in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words remembered by a task before it starts anew.
KNOWN = 300_000
#: Fixed odd multipliers of the mixing steps.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHash(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def lower_words(text: str) -> list[bytes]:
    """The same with A-Z lower-cased, and no other letter."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """A number for every run of k words; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, total = np.uint64(1), np.zeros(n, np.uint64)
    for t in range(k):
        total += hashes[t:t + n] * power
        power = np.uint64(int(power) * int(MIX[0]) % 2 ** 64)
    return mixed(total)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The set of k-word runs; all words as one run if there are fewer; empty without words."""
    if 0 < len(hashes) < k:
        return runs_of(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return distinct(runs_of(hashes, k))
