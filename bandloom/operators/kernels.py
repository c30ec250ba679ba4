"""Feature maps of kernels that are no function of a distance: polynomial and sigmoid.

A map by landmarks (Williams and Seeger 2001): with kernel values K between m
landmarks and k(x) to them, the features k(x) U D^-1/2 of the eigenpairs of K
have the kernel as their inner product, exactly where the kernel's own
feature space has at most m dimensions. The sigmoid kernel has negative
eigenvalues; those are left out, which leaves the nearest kernel without them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.functions.matrix import field, map_matrix

KERNELS = ("poly", "sigmoid")
LANDMARKS = 128
# Rows beside the landmarks on which the error of the map is measured.
ERROR_ROWS = 256
# Eigenvalues below this share of the largest one count as zero.
RANK_SHARE = 1e-10


@dataclass(frozen=True)
class LandmarkMap:
    """A kernel with its landmarks (m x d)."""

    kernel: str
    gamma: float
    degree: int
    coef0: float
    landmarks: np.ndarray

    def values(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inner = self.gamma * (a @ b.T) + self.coef0
        return inner**self.degree if self.kernel == "poly" else np.tanh(inner)

    def mixing(self) -> np.ndarray:
        lam, vec = np.linalg.eigh(self.values(self.landmarks, self.landmarks))
        kept = lam > RANK_SHARE * np.abs(lam).max()
        if not kept.any():
            raise ValueError(f"the {self.kernel} kernel has no positive part on the landmarks")
        return vec[:, kept] / np.sqrt(lam[kept])

    def __call__(self, df: DataFrame) -> DataFrame:
        """`df` with its bands replaced by the features."""
        mixing = self.mixing()
        rest = [c for c in df.columns if c != "bands"]
        made = map_matrix(df, self.landmarks.shape[1], rest, [field("_z", "array<double>")],
                          lambda x, _: [self.values(x, self.landmarks) @ mixing])
        return made.withColumnRenamed("_z", "bands")

    def error(self, x: np.ndarray) -> float:
        """Mean absolute difference of kernel and feature products over all pairs of rows, relative to the mean value."""
        z = self.values(x, self.landmarks) @ self.mixing()
        true = self.values(x, x)
        return float(np.abs(true - z @ z.T).mean() / max(np.abs(true).mean(), 1e-300))


def landmark_map(df: DataFrame, kernel: str, gamma: float, degree: int = 3, coef0: float = 0.0, seed: int = 0,
                 size: int = LANDMARKS) -> tuple[LandmarkMap, float]:
    """The map of a seeded choice of `size` distinct band vectors, and its error on up to
    ERROR_ROWS further ones (on the landmarks, where there are no others).

    The choice takes the vectors of least digest, so it does not depend on the layout.
    """
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}, use rbf or one of {', '.join(KERNELS)}")
    vectors = df.select("bands").filter(~F.exists("bands", lambda v: v.isNull() | F.isnan(v))).distinct()
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "bands"), "bands").limit(size + ERROR_ROWS).collect()
    if not rows:
        raise ValueError("no samples to choose landmarks from")
    x = np.array([r["bands"] for r in rows], dtype=float)
    made = LandmarkMap(kernel, float(gamma), int(degree), float(coef0), x[:size])
    return made, made.error(x[size:] if len(x) > size else x)
