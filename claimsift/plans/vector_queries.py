"""Prototype classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimsift.operators import prototypes as p
from claimsift.plans.registry import query, rounded

CTES = {
    "cosines": """
SELECT t.vec_id, p.vec_id AS proto_id, p.label::VARCHAR AS proto_label,
       list_cosine_similarity(t.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS cosine
FROM test_vectors t CROSS JOIN prototypes p""",
    "similarities": "SELECT vec_id, proto_label, max(cosine) AS similarity FROM cosines GROUP BY ALL",
    "vector_predictions": """
SELECT s.vec_id, t.label::VARCHAR AS ground_truth, CASE WHEN s.similarity < 0.3 THEN 'Unknown' ELSE s.proto_label END AS predicted_class, s.similarity AS confidence
FROM similarities s JOIN test_vectors t ON t.vec_id = s.vec_id
QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY s.similarity DESC, s.proto_label) = 1""",
}


def model_and_vectors(v, per_label: int = 4):
    """The prototype model and the vectors outside the (at most 4 per label) prototypes."""
    chosen = v.prototypes if per_label == 4 else p.first_vectors_per_label(v.embeddings, per_label=per_label)
    model = p.PrototypeModel.fit(chosen.select("vec_id", "label", "embedding"))
    held_out = model.ids if per_label == 4 else p.PrototypeModel.fit(v.prototypes).ids
    rest = v.embeddings.filter(~F.col("vec_id").isin(held_out))
    return model, rest.select("vec_id", F.col("label").cast("string").alias("ground_truth"), "embedding")


def vector_predictions(v):
    model, vectors = model_and_vectors(v)
    return p.classify_by_prototypes(vectors, model)


@query("""SELECT vec_id, label::BIGINT AS label, len(embedding) AS dims,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM prototypes""")
def prototype_set(v):
    squares = F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    return v.prototypes.select(
        "vec_id", F.col("label").cast("bigint").alias("label"),
        F.size("embedding").cast("bigint").alias("dims"), F.round(F.sqrt(squares), 6).alias("norm"),
    )


@query("SELECT vec_id, proto_id, proto_label, round(cosine, 6) AS cosine FROM cosines", **CTES)
def prototype_cosine(v):
    model, vectors = model_and_vectors(v)
    return rounded(p.prototype_cosine(vectors, model), "cosine")


@query("SELECT vec_id, proto_label, round(similarity, 6) AS similarity FROM similarities", **CTES)
def label_similarity(v):
    model, vectors = model_and_vectors(v)
    return rounded(p.label_similarity(vectors, model), "similarity")


@query("SELECT vec_id, ground_truth, predicted_class, round(confidence, 6) AS confidence FROM vector_predictions", **CTES)
def classify_embedding(v):
    return rounded(vector_predictions(v), "confidence")


@query("""
SELECT vec_id, ground_truth, proto_label AS predicted_class, round(cosine, 6) AS confidence FROM (
  SELECT c.vec_id, t.label::VARCHAR AS ground_truth, c.proto_label, c.cosine FROM cosines c JOIN test_vectors t ON t.vec_id = c.vec_id
  WHERE c.proto_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, proto_label) = 1""", **CTES)
def classify_single_prototype(v):
    model, vectors = model_and_vectors(v, per_label=1)
    return rounded(p.classify_by_prototypes(vectors, model, threshold=None), "confidence")
