"""Proofs that are observed while a table is written: rows, classes, key sums and counts that must be
zero. They cost no further scan, since they are metrics of the job that writes.

Sums over a digest of the keys don't depend on order or partitions: equal ones before and after a
stage show that it has lost, doubled and swapped no row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Proof:
    """What to observe: classes of a column, sums over keys, and counts by name, of which those under
    ``never`` must be zero."""

    labels: str | None = None
    classes: Sequence = (0, 1)
    keys: Sequence[str] = ()
    counts: dict[str, Column] = field(default_factory=dict)
    never: dict[str, Column] = field(default_factory=dict)

    def columns(self) -> list[Column]:
        out = [F.count(F.lit(1)).alias("rows")]
        if self.labels:
            label = F.col(f"`{self.labels}`")
            out += [F.count_if(label.eqNullSafe(F.lit(c))).alias(f"label_{c}") for c in self.classes]
            out.append(F.count_if(~F.coalesce(label.isin(*self.classes), F.lit(False))).alias("label_other"))
        if self.keys:
            digest = F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in self.keys])
            out += [F.sum(digest.cast("decimal(38,0)")).alias("key_sum"), F.bit_xor(digest).alias("key_xor")]
        return out + [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in {**self.counts, **self.never}.items()]


class Observed:
    """A frame with a proof's metrics on it, and their values once a job has run over it."""

    def __init__(self, df: DataFrame, proof: Proof) -> None:
        self.proof, self._observation = proof, Observation()
        self.frame = df.observe(self._observation, *proof.columns())

    def values(self) -> dict:
        found = {k: (v if isinstance(v, int) or v is None else str(v)) for k, v in self._observation.get.items()}
        wrong = {k: found[k] for k in self.proof.never if found[k]}
        if wrong:
            raise AssertionError(f"these must be zero: {wrong}")
        return found


#: What a stage that keeps all rows must leave as it was.
PRESERVED = ("rows", "label_0", "label_1", "label_other", "key_sum", "key_xor")


def require_preserved(before: dict, after: dict, names: Sequence[str] = PRESERVED) -> None:
    """Fails where two observations differ in what both have."""
    differs = {n: (before[n], after[n]) for n in names if n in before and n in after and before[n] != after[n]}
    if differs:
        raise AssertionError(f"rows weren't preserved (before, after): {differs}")
