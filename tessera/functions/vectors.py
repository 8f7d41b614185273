"""Vector column functions (all JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    """Inner product in DOUBLE."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_normalize(a: Column, eps: float = EPS) -> Column:
    """x / max(||x||, eps): a zero vector stays zero (no NaN).  The norm is
    passed in as an array argument so it is computed once per row (an outer
    expression referenced inside a lambda is re-evaluated per element)."""
    norm = F.greatest(F.sqrt(sq_norm(a)), F.lit(eps))
    return F.zip_with(a, F.array_repeat(norm, F.size(a)), lambda x, n: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def binarize(a: Column, threshold: float = 0.0) -> Column:
    """Bits ``x > threshold`` packed into LONG words, 64 dimensions per word
    (dimension ``i`` is bit ``i % 64`` of word ``i // 64``)."""
    n_words = F.floor((F.size(a) + 63) / 64).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n_words - 1),
        lambda w: F.aggregate(
            F.sequence(w * 64, F.least(w * 64 + 63, F.size(a) - 1)),
            F.lit(0).cast("long"),
            lambda acc, i: acc.bitwiseOR(
                F.when(F.element_at(a, i + 1) > threshold,
                       F.call_function("shiftleft", F.lit(1).cast("long"), i - w * 64)).otherwise(F.lit(0).cast("long")))))


def signs(a: Column, threshold: float = 0.0) -> Column:
    """+1/-1 DOUBLE per dimension (``x > threshold``): equal to
    ``unpack_signs(binarize(a, threshold), dim)`` in one pass."""
    return F.transform(a, lambda x: F.when(x > threshold, F.lit(1.0)).otherwise(F.lit(-1.0)))


def unpack_signs(words: Column, dim: int) -> Column:
    """Packed bits -> +1/-1 DOUBLE vector of length ``dim`` (the lambdas
    only touch their own variables, so ``words`` is evaluated once)."""
    return F.slice(F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda j: (F.call_function("shiftright", w, j).bitwiseAND(F.lit(1)) * 2 - 1).cast("double")))),
        1, dim)


def hamming_words(a: Column, b: Column) -> Column:
    """Hamming distance of two packed bit arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                       F.lit(0), lambda acc, x: acc + x)


def mips_augment_doc(a: Column, max_sq_norm: Column) -> Column:
    """Inner-product -> L2 reduction: append sqrt(max_sq_norm - ||x||^2)."""
    extra = F.sqrt(F.greatest(max_sq_norm - sq_norm(a), F.lit(0.0)))
    return F.concat(F.transform(a, lambda x: x.cast("double")), F.array(extra))


def mips_augment_query(a: Column) -> Column:
    return F.concat(F.transform(a, lambda x: x.cast("double")), F.array(F.lit(0.0)))
