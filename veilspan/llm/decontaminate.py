"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is far shorter than the documents it may hide in, so similarity of whole
documents says nothing; what counts is containment, the share of the item's distinct word
shingles that a document has. Items are partitioned by size (powers of two of their number
of distinct shingles). Every size class has a sketch length m: an item's sketch is its m
smallest shingle hashes (its MinHash values under one hash function). With
m = floor((1 - threshold) * u) + 1, where u is the largest size in the class, a document that holds
`threshold` of the item's shingles has at least one of any m of them. So looking up each
document's shingles in the sketches finds every qualifying pair, and no other document is
looked at again. Candidates are verified by exact containment over the shingles' words.

Documents and items are searched as texts, known by an MD5 of the whole text: copies are
searched once, and ids take part only when the pairs are named.

Defined results: null and wordless texts match nothing. An item with fewer words than a
shingle is one shingle of its own, all its words, searched with that length; an item without
words is skipped. Items with one text each get their own pairs. Of several texts under one
item id or one document id the best match counts, so there is one row a pair of ids; rows
without an id count as one id, null. Empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.textexpr import ALNUM_RE, pinned, words
from veilspan.session import materialize, release

SHINGLE, THRESHOLD = 5, 0.8
#: Rows of a side (16 to 32 bytes each) up to which it is broadcast; beyond, both are shuffled.
BROADCAST_ROWS = 400_000


def tokens(text: Column) -> Column:
    return words(F.lower(text), ALNUM_RE)


def shingle_texts(w: Column, k: int) -> Column:
    n = F.size(w)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(h: Column, k: int) -> Column:
    n = F.size(h)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def text_hash(shingle: Column, k: int) -> Column:
    """The hash that `shingle_hashes` gives to a shingle of k words."""
    parts = F.split(shingle, " ")
    return F.xxhash64(*[F.xxhash64(F.get(parts, F.lit(j))) for j in range(k)])


def side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def item_shingles(items: DataFrame, text: str, k: int) -> DataFrame:
    """(item, length, size, shingle): distinct shingles of each distinct text; length is k, or the words of a shorter item."""
    base = items.select(F.col(text).alias("_t")).where(F.col(text).isNotNull()).distinct()
    base = base.select(text_key(F.col("_t")).alias("item"), pinned(tokens(F.col("_t"))).alias("_w")).where(F.size("_w") > 0)
    parts = base.select("item", F.least(F.size("_w"), F.lit(k)).alias("length"), F.when(F.size("_w") < k, F.array(F.array_join("_w", " "))).otherwise(shingle_texts(F.col("_w"), k)).alias("_s"))
    own = parts.select("item", "length", pinned(F.array_distinct("_s")).alias("_s"))
    return own.select("item", "length", F.size("_s").alias("size"), F.explode("_s").alias("shingle"))


def matches(documents: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(key, item, n_shingles, n_found): keys of texts and of items they hold, containment from `threshold` on."""
    shingles = item_shingles(items, item_text, k)
    lengths = sorted(r[0] for r in shingles.select("length").distinct().collect())
    hashed = F.lit(None).cast("bigint")
    for n in lengths:
        hashed = F.when(F.col("length") == n, text_hash(F.col("shingle"), n)).otherwise(hashed)
    shingles = materialize(shingles.withColumn("hash", hashed), "items")
    # Size class 2^(c-1) < size <= 2^c; its sketches are long enough for its largest item.
    largest = F.pow(F.lit(2.0), F.ceil(F.log2("size")))
    ranked = shingles.groupBy("item", "size").agg(F.array_sort(F.collect_set(F.struct("hash", "length"))).alias("_h"))
    sketches = ranked.select("item", F.explode(F.slice("_h", F.lit(1), (F.floor(largest * (1 - threshold) + 1e-9) + 1).cast("int"))).alias("x"))
    sketches = materialize(sketches.select(F.col("x.hash").alias("hash"), "item"), "sketches")
    base = documents.select(pinned(text_key(F.col(text))).alias("key"), pinned(tokens(F.col(text))).alias("_w"))
    base = base.select("key", pinned(F.transform("_w", lambda w: F.xxhash64(w))).alias("_h"))
    # An item shorter than k words is looked for among the documents' shingles of its own length.
    every = F.concat(*[shingle_hashes(F.col("_h"), n) for n in lengths]) if lengths else F.array().cast("array<bigint>")
    looked = base.select("key", F.explode(every).alias("hash"))
    # One row a sketch hash: a hash that many items share does not multiply the documents' rows.
    by_hash = sketches.groupBy("hash").agg(F.collect_set("item").alias("_items"))
    found = looked.join(side(by_hash, sketches.count()), "hash").select("key", F.explode("_items").alias("item")).distinct()
    candidates = materialize(found, "candidates")
    # Verification: words of the candidate texts only, exact distinct shingles in common.
    wanted = candidates.groupBy("key").agg(F.collect_set("item").alias("_items"))
    texts = documents.select(text_key(F.col(text)).alias("key"), F.col(text).alias("_t")).join(side(wanted, candidates.count()), "key").dropDuplicates(["key"])
    texts = texts.select("key", "_items", pinned(tokens(F.col("_t"))).alias("_w"))
    texts = texts.select("key", "_items", pinned(F.array_distinct(F.concat(*[shingle_texts(F.col("_w"), n) for n in lengths])) if lengths else F.array().cast("array<string>")).alias("_s"))
    sets = shingles.groupBy("item", "size").agg(F.collect_set("shingle").alias("_own"))
    pairs = texts.select("key", "_s", F.explode("_items").alias("item")).join(side(sets, shingles.count()), "item")
    counted = pairs.select("key", "item", F.col("size").cast("long").alias("n_shingles"), F.size(F.array_intersect("_own", "_s")).cast("long").alias("n_found"))
    out = materialize(counted.where(F.col("n_found") / F.col("n_shingles") >= threshold), "matches")
    for done in (shingles, sketches, candidates):
        release(done)
    return out


def contained(documents: DataFrame, items: DataFrame, text: str = "text", id_column: str = "doc_id", item_text: str = "text", item_id: str = "item_id", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(id, item, n_shingles, n_found, containment): pairs with containment from `threshold` on."""
    found = matches(documents, items, text, item_text, k, threshold)
    n = found.count()
    named = documents.select(F.col(id_column).alias("_id"), text_key(F.col(text)).alias("key")).join(side(found, n), "key")
    named = named.join(side(items.select(F.col(item_id).alias("_item"), text_key(F.col(item_text)).alias("item")).distinct(), items.count()), "item")
    share = F.col("n_found") / F.col("n_shingles")
    best = named.groupBy("_id", "_item").agg(F.max(F.struct(share.alias("containment"), "n_found", "n_shingles")).alias("x"))
    return best.select(F.col("_id").alias(id_column), F.col("_item").alias(item_id), "x.n_shingles", "x.n_found", "x.containment")


def decontaminate(documents: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents whose text holds no item, with all their columns, whatever their ids."""
    hit = materialize(matches(documents, items, text, **options).select(F.col("key").alias("_key")).distinct(), "leaks")
    n = hit.count()
    if not n:
        return documents
    return documents.withColumn("_key", F.coalesce(text_key(F.col(text)), F.lit(""))).join(side(hit, n), "_key", "left_anti").select(*documents.columns)
