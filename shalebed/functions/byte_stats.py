"""Statistics of byte contents, one pass over each in bounded pieces."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SECTION = 65_536
FIELDS = "entropy double, byte_mean double, compress_ratio double, n_sections long, entropy_variance double"


def entropy_of(counts: np.ndarray) -> float:
    total = counts.sum()
    if not total:
        return 0.0
    p = counts[counts > 0] / total
    return float(-(p * np.log2(p)).sum())


class ByteStatistics:
    """Takes a content in pieces of any size; the result doesn't depend on them."""

    def __init__(self, section: int = SECTION, level: int = 9):
        self.section = section
        self.counts = np.zeros(256, np.int64)
        self.packer = zlib.compressobj(level)
        self.packed = 0
        self.rest = b""
        self.entropies: list[float] = []

    def update(self, piece: bytes) -> None:
        self.counts += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        self.packed += len(self.packer.compress(piece))
        data = self.rest + piece
        full = len(data) // self.section * self.section
        for at in range(0, full, self.section):
            self.entropies.append(entropy_of(np.bincount(np.frombuffer(data, np.uint8, self.section, at), minlength=256)))
        self.rest = data[full:]

    def result(self) -> tuple[float, float, float, int, float]:
        """Entropy, mean, compressed share, full sections and the variance of their
        entropies. Nothing gives 0, 0, 1, 0, 0; fewer than two sections vary by 0.
        """
        n = int(self.counts.sum())
        if not n:
            return 0.0, 0.0, 1.0, 0, 0.0
        mean = float((self.counts * np.arange(256)).sum() / n)
        packed = self.packed + len(self.packer.flush())
        spread = float(np.var(self.entropies)) if len(self.entropies) > 1 else 0.0
        return entropy_of(self.counts), mean, packed / n, len(self.entropies), spread


def byte_features(content: Column, section: int = SECTION, chunk: int = 1 << 20) -> Column:
    """struct<FIELDS> of a binary column; null counts as no bytes."""

    def measure(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for data in contents:
            stats = ByteStatistics(section)
            for at in range(0, len(data or b""), chunk):
                stats.update(data[at : at + chunk])
            rows.append(stats.result())
        return pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])

    measure.__annotations__ = {"contents": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(measure, FIELDS)(content)
