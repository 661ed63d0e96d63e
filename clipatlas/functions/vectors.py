"""Vector arithmetic on arrays of doubles, evaluated in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A query vector as a literal, parsed in one go."""
    return F.expr("array(" + ", ".join(f"double('{float(x)!r}')" for x in values) + ")")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def _guarded(product: Column, norms: Column) -> Column:
    # No direction (a zero or non-finite vector) scores 0; a missing vector scores NULL.
    ratio = F.when((norms > 0) & ~F.isnan(norms), product / norms).when(norms.isNotNull(), F.lit(0.0))
    return F.nanvl(ratio, F.lit(0.0))


def cosine_similarity(a: Column, b: Column) -> Column:
    """``dot / (norm * norm)``, and 0 when either norm is 0."""
    return _guarded(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def euclidean_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def cosine_to(a: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to one fixed vector, whose norm is worked out once."""
    return _guarded(dot(a, vector(query)), norm(a) * F.lit(math.sqrt(sum(x * x for x in query))))


def distance_to(a: Column, query: Sequence[float]) -> Column:
    """Cosine distance to one fixed vector."""
    return F.lit(1.0) - cosine_to(a, query)


def usable(a: Column, dims: int | None = None) -> Column:
    """True for a vector that can be scored: present, not empty, of the right length."""
    return F.size(a) > 0 if dims is None else F.size(a) == dims


def encode_embedding(a: Column) -> Column:
    return F.to_json(a)


def decode_embedding(text: Column) -> Column:
    """Vector from its JSON text; NULL when the text is no array of numbers."""
    decoded = F.from_json(text, "array<double>")
    # Through an array of one, so that the text is decoded once and not once per mention.
    whole = F.transform(F.array(decoded), lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), v))
    return F.get(whole, F.lit(0))
