"""Classification of vectors by cosine similarity to labelled prototype vectors.

The prototype set is a small model: its size is checked, then it travels with the
expression. Each vector meets all prototypes inside its own row, so there is no
join and no shuffle; a vector is read once whatever the number of prototypes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsift.fixed_values import PROTOTYPE_THRESHOLD, UNKNOWN
from claimsift.functions.plan_shape import settled


def first_vectors_per_label(
    vectors: DataFrame, key: str = "vec_id", label: str = "label", per_label: int = 4
) -> DataFrame:
    """The first ``per_label`` vectors of every label; limited before the shuffle too."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(key))
    return (
        vectors.withColumn("_place", place).filter(F.col("_place") <= per_label).drop("_place")
    )


@dataclass(frozen=True)
class PrototypeModel:
    """Unit prototype vectors, ordered by (label, id)."""

    ids: list[int]
    labels: list[str]
    unit: np.ndarray

    @property
    def classes(self) -> list[str]:
        return list(dict.fromkeys(self.labels))

    @classmethod
    def fit(
        cls, prototypes: DataFrame, key: str = "vec_id", label: str = "label",
        vector: str = "embedding", max_prototypes: int = 10_000,
    ) -> PrototypeModel:
        """Read the prototypes; a set of more than ``max_prototypes`` rows is refused, as every task holds it."""
        rows = (
            prototypes.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(vector).alias("v"))
            .limit(max_prototypes + 1)
            .collect()
        )
        if not rows:
            raise ValueError("no prototypes")
        if len(rows) > max_prototypes:
            raise ValueError(f"more than {max_prototypes} prototypes")
        rows.sort(key=lambda r: (r.l, r.k))
        matrix = np.array([r.v for r in rows], dtype="float64")
        return cls([r.k for r in rows], [str(r.l) for r in rows], _unit(matrix))


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero (similarity 0)."""
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _similarity(model: PrototypeModel, groups: list[np.ndarray]) -> Column:
    """Arrow UDF: array of vectors -> per group the highest cosine."""
    unit = model.unit.T

    @F.pandas_udf("array<double>")
    def similarity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out: list = [None] * len(vectors)
            present = np.flatnonzero(vectors.notna().to_numpy())
            if len(present):
                matrix = np.stack(vectors.to_numpy()[present]).astype("float64")
                cosine = _unit(matrix) @ unit
                best = np.stack([cosine[:, g].max(axis=1) for g in groups], axis=1)
                for i, row in zip(present, best):
                    out[i] = row
            yield pd.Series(out, dtype="object")

    return similarity


def _positions(model: PrototypeModel) -> list[np.ndarray]:
    labels = np.array(model.labels)
    return [np.flatnonzero(labels == c) for c in model.classes]


def prototype_cosine(vectors: DataFrame, model: PrototypeModel, key: str = "vec_id") -> DataFrame:
    """(key, proto_id, proto_label, cosine) for every vector and prototype."""
    each = [np.array([i]) for i in range(len(model.ids))]
    ids = F.array(*[F.lit(i).cast("bigint") for i in model.ids])
    names = F.array(*[F.lit(n) for n in model.labels])
    scored = vectors.select(key, _similarity(model, each)("embedding").alias("c"))
    return scored.select(
        key, F.explode(F.arrays_zip(ids.alias("proto_id"), names.alias("proto_label"), F.col("c").alias("cosine"))).alias("z")
    ).select(key, "z.proto_id", "z.proto_label", "z.cosine")


def label_similarity(vectors: DataFrame, model: PrototypeModel, key: str = "vec_id") -> DataFrame:
    """(key, proto_label, similarity): best prototype of each label."""
    names = F.array(*[F.lit(n) for n in model.classes])
    scored = vectors.select(key, _similarity(model, _positions(model))("embedding").alias("c"))
    return scored.select(
        key, F.explode(F.arrays_zip(names.alias("proto_label"), F.col("c").alias("similarity"))).alias("z")
    ).select(key, "z.proto_label", "z.similarity")


def classify_by_prototypes(
    vectors: DataFrame, model: PrototypeModel, threshold: float | None = PROTOTYPE_THRESHOLD
) -> DataFrame:
    """Replace ``embedding`` by ``predicted_class`` and ``confidence``. No shuffle."""
    keep = [c for c in vectors.columns if c != "embedding"]
    scored = vectors.select(
        *keep, _similarity(model, _positions(model))("embedding").alias("c")
    ).withColumn("confidence", F.array_max("c"))
    names = F.array(*[F.lit(n) for n in model.classes])
    # the first position of the maximum: ties go to the first label
    best = F.element_at(names, F.array_position("c", F.col("confidence")).cast("int"))
    best = F.when(F.col("confidence").isNotNull(), best)
    if threshold is not None:
        best = F.when(F.col("confidence") < threshold, UNKNOWN).otherwise(best)
    return settled(scored, keep, best.alias("predicted_class"), F.col("confidence"))
