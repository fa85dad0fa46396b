"""Spans that scans of texts find, and character codes for the small networks that score them."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np


class Span(NamedTuple):
    kind: str
    start: int  # code points
    end: int


def joined(spans: list[Span], kinds: list[str]) -> str:
    """kind:start:end by start, then kind in the order of ``kinds``, comma-joined."""
    rank = {kind: k for k, kind in enumerate(kinds)}
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, rank[s.kind], s.end)))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Character codes: a-z, A-Z, one for digits, one for each listed sign, then space, line break, other.
_SIGNS = "=:\"'-_/+.@()%,;!#*"
PAD, N_CODES = 0, 1 + 26 + 26 + 1 + len(_SIGNS) + 4
_CODE = np.full(128, N_CODES - 2, np.int16)
_CODE[97:123], _CODE[65:91], _CODE[48:58] = np.arange(1, 27), np.arange(27, 53), 53
for _k, _c in enumerate(_SIGNS):
    _CODE[ord(_c)] = 54 + _k
_CODE[32], _CODE[10] = N_CODES - 4, N_CODES - 3


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], N_CODES - 1).astype(np.int16)


class Adam:
    """Adaptive steps for a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.weights, self.rate, self.t = weights, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            a, b = self.first[k] / (1 - 0.9**self.t), self.second[k] / (1 - 0.999**self.t)
            self.weights[k] -= self.rate * a / (np.sqrt(b) + 1e-8)
