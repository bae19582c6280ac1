"""Similarity of feature vectors and the score of handing one track over to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def rescaled_cosine(a: Column, b: Column, low: float = 0.80, span: float = 0.18) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(a, b) - low) / span))


def histogram_overlap(a: Column, b: Column) -> Column:
    """Shared mass of two histograms that sum to 2."""
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x) / 2


def appearance(embedding: Column, colour: Column, w_embedding: float = 0.35, w_colour: float = 0.65) -> Column:
    """Both blended, or the only one there is, or 0."""
    return F.coalesce(w_embedding * embedding + w_colour * colour, embedding, colour, F.lit(0.0))


def handover_score(look: Column, gap: Column, far: Column, edge_to_edge: Column, same_place: Column) -> Column:
    """Appearance, plus bonuses for leaving and entering at an edge or for staying in place, less excess distance and gap."""
    late = F.greatest(gap, F.lit(0.0))
    excess = F.greatest(F.lit(0.0), far - (0.06 + 0.35 * late))
    return look + F.when(edge_to_edge, 0.05).otherwise(0.0) + F.when(same_place, 0.04).otherwise(0.0) - F.least(F.lit(0.5), 1.5 * excess) - 0.004 * late
