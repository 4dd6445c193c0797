"""Column expressions over ARRAY<FLOAT> vectors, computed in DOUBLE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV hash.
FNV_START, FNV_PRIME = 2166136261, 16777619


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for null, empty, NaN or zero vectors and for different lengths. Pass norms that are at hand."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    value = let(n, lambda n: F.when((n > 0) & ~F.isnan(n), dot(a, b) / n))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), value), F.lit(0.0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hash_embedding(grams: Column, dims: int = 384) -> Column:
    """A vector of length one: every gram adds +1 or -1 at the place its hash names, a single letter +1. Null and empty give zeros."""
    grams = F.coalesce(grams, F.array().cast("array<string>"))

    def hashed(g: Column) -> Column:
        letters = F.filter(F.split(g, ""), lambda c: c != "")
        return F.aggregate(letters, F.lit(FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c)) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))

    # place and sign of every gram, then one sum per place, then the length; each worked out once
    signed = F.transform(F.transform(grams, hashed), lambda h: F.struct((h % dims).alias("i"), F.when(h % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    single = (F.size(grams) == 1) & (F.length(grams[0]) == 1)
    at = F.when(single, F.transform(F.transform(grams, hashed), lambda h: F.struct((h % dims).alias("i"), F.lit(1.0).alias("s")))).otherwise(signed)
    places = F.sequence(F.lit(0), F.lit(dims - 1))
    raw = let(at, lambda a: F.transform(places, lambda i: F.aggregate(F.filter(a, lambda p: p["i"] == i), F.lit(0.0), lambda s, p: s + p["s"])))

    def scaled(r: Column) -> Column:
        size = F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x))
        return let(size, lambda n: F.transform(r, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float")))

    return let(raw, scaled)
