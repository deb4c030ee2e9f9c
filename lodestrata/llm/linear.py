"""Hashed sparse features and logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

import re

import numpy as np

BITS = 20
WIDTH = 1 << BITS
#: Letters of the stems that make words a family, and from how many distinct words on a text's family counts as larger.
STEMS, FAMILIES = (4, 5, 6, 7), (2, 3)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _shape(token: str) -> str:
    c = token[0]
    if c.isalpha():
        kind = "U" if len(token) > 1 and token.isupper() else "T" if c.isupper() else "l"
        return f"{kind}{min(len(token).bit_length(), 5)}"
    return "9" if c.isdigit() else token[:3]


class Hasher:
    """Token hashes with a bounded memo."""

    def __init__(self, limit: int = 100_000) -> None:
        self.memo: dict[str, tuple[int, int]] = {}
        self.prefixes: dict[str, tuple[int, ...]] = {}
        self.limit = limit

    def __call__(self, token: str) -> tuple[int, int]:
        got = self.memo.get(token)
        if got is None:
            import xxhash

            if len(self.memo) >= self.limit:
                self.memo.clear()
            got = xxhash.xxh3_64_intdigest(token), xxhash.xxh3_64_intdigest(_shape(token), seed=7)
            self.memo[token] = got
        return got

    def with_prefixes(self, token: str) -> tuple[int, ...]:
        """Hashes of a token and of its stems (prefixes of STEMS letters), marked by a tilde."""
        got = self.prefixes.get(token)
        if got is None:
            import xxhash

            if len(self.prefixes) >= self.limit:
                self.prefixes.clear()
            got = tuple(xxhash.xxh3_64_intdigest(x) for x in (token, *(f"{token[:k]}~" for k in STEMS if len(token) > k)))
            self.prefixes[token] = got
        return got


def ngram_features(text: str | None, hasher: Hasher) -> np.ndarray:
    """Feature slots, with repeats, of a text's word 1- and 2-grams, its shape 1- and 2-grams, and how far its 3-grams repeat."""
    tokens = _TOKEN.findall(text or "")
    n = len(tokens)
    if not n:
        return np.empty(0, np.int64)
    pairs = np.array([hasher(t) for t in tokens], np.uint64)
    w, s = pairs[:, 0], pairs[:, 1]
    k = np.uint64(0x9E3779B97F4A7C15)
    again = np.zeros(n, np.uint64)
    for lag in (1, 2):
        again[lag:] |= (w[lag:] == w[:-lag]).astype(np.uint64)
    s = s + again * np.uint64(0xD1B54A32D192ED03)
    parts = [w, s]
    if n > 1:
        parts += [w[:-1] * k ^ w[1:], s[:-1] * k ^ s[1:]]
    if n > 2:
        triples = (w[:-2] * k ^ w[1:-1]) * k ^ w[2:]
        share = 1 - len(np.unique(triples)) / len(triples)
        # one slot for the share of repeated 3-grams, as often as there are tokens: it weighs as much as they do together
        parts.append(np.full(n, 0x51ED270B + int(share * 8), np.uint64) * k)
    with np.errstate(over="ignore"):
        return ((np.concatenate(parts) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - BITS)).astype(np.int64)


def presence_features(text: str | None, hasher: Hasher) -> np.ndarray:
    """Distinct feature slots of a text's lower-cased words, of their stems, and of stems that FAMILIES distinct words or more share."""
    keys: list[int] = []
    for t in set(_TOKEN.findall((text or "").lower())):
        keys.extend(hasher.with_prefixes(t))
    if not keys:
        return np.empty(0, np.int64)
    u, c = np.unique(np.array(keys, np.uint64), return_counts=True)
    with np.errstate(over="ignore"):
        found = np.concatenate([u, *(u[c >= n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n) for n in FAMILIES)])
        return np.unique((found * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - BITS)).astype(np.int64)


def counted(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots with values count / sqrt(number of features)."""
    if not len(slots):
        return slots, np.empty(0)
    u, c = np.unique(slots, return_counts=True)
    return u, c / np.sqrt(len(slots))


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss; slot WIDTH is the intercept."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, slots: np.ndarray, values: np.ndarray, label: float, weight: float = 1.0) -> None:
        i, x = np.append(slots, WIDTH), np.append(values, 1.0)
        w = self.at(i)
        g = weight * (sigmoid(float(w @ x)) - label) * x
        self.z[i] += g - (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += g * g

    def weights(self) -> np.ndarray:
        return self.at(np.arange(WIDTH + 1)).astype(np.float32)
