"""BM25 as Column arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75

    @staticmethod
    def idf(df: float, docs: float) -> float:
        """Smoothed inverse document frequency; 0 for a field without documents."""
        return math.log(1 + (docs - df + 0.5) / (df + 0.5)) if docs else 0.0

    def weight(self, idf: float, tf: Column, length: Column, average: float) -> Column:
        """Weight of a term with ``tf`` occurrences; 0 for none, or where the field has no terms at all."""
        if average <= 0:
            return F.lit(0.0)
        norm = F.lit(1 - self.b) + F.lit(self.b) * (length / F.lit(float(average)))
        return F.when(tf > 0, F.lit(idf) * (tf * F.lit(self.k1 + 1)) / (tf + F.lit(self.k1) * norm)).otherwise(0.0)
