"""Column expressions on raw text that several native operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words (space, \t, \n, \v, \f, \r).
WORD_RE = r"[^\x20\x09-\x0D]+"
#: Words made of ASCII letters and digits and of every non-ASCII character.
ALNUM_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case so that ASCII words come out as if only A-Z had been touched.

    `lower` is a fast JVM call but maps the Kelvin sign to `k` and the dotted capital I
    to an ASCII `i` plus a mark; both are first swapped for another non-ASCII letter.
    """
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ĸ")))


#: What lies between the words of each kind.
BETWEEN = {WORD_RE: r"[\x20\x09-\x0D]+", ALNUM_RE: r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"}


def words(text: Column, pattern: str) -> Column:
    """All words of kind `pattern`, in order; null counts as an empty text.

    Splitting between the words costs a fraction of extracting them one match at a time.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN[pattern], -1), "")


def gram_hashes(tokens: Column, k: int) -> Column:
    """64-bit hashes of all rolling k-grams of an array column (empty if fewer than k)."""
    n = F.size(tokens)
    return F.when(
        n >= k,
        F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))


def crc_mod(col: Column, n: int) -> Column:
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def pinned(col: Column) -> Column:
    """`col`, kept where it stands in the plan.

    The optimizer copies a projected expression into filters pushed below it, and into
    lambdas, where an array would be rebuilt for each of its own elements. The condition
    always holds but isn't deterministic to the optimizer, so it moves nothing across.
    """
    return F.when(F.spark_partition_id() >= 0, col)
