"""Follow-the-regularised-leader (McMahan et al., "Ad Click Prediction", 2013) over hashed sparse features."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Weights w over 2**bits features; step(idx, val, g) takes one example's gradient g with respect to its score."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        self.w = self.weights(idx)
        return float(self.w @ val)

    def step(self, idx: np.ndarray, val: np.ndarray, g: float) -> None:
        g = g * val
        n = self.n[idx]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[idx] += g - sigma * self.w
        self.n[idx] = n + g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
