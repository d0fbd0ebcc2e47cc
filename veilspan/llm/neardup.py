"""Near-duplicates by exact similarity of word shingles: SimHash links, widened by MinHash bands.

Two texts are near copies if their sets of distinct five-word shingles have a Jaccard
similarity of `threshold` or more. The search has two parts. SimHash fingerprints over the same
shingles go through the Gray-order index of `simhash`, which links those within its radius.
That is not enough for right results at 0.8 (such pairs differ in ten of 64 bits on average,
and an index of that radius prunes nothing), so candidates also come from BANDS bands of ROWS
MinHash values: a pair at 0.8 shares none with probability 3e-6. Every candidate pair is
verified on the whole sets, so nothing is linked below the threshold. Components are joined
by star contraction.

Texts with equal sets collapse before the search. All pairs of a band's texts are candidates
up to WHOLE texts. In larger bands each text is first paired with the first one and with its
neighbours in the order of the next band, so a large group costs rows in proportion to its
size. Texts that these links leave outside their band's largest component are then a query set,
held against all texts of larger bands through an index of its shingles, QUERY_SHINGLES at
a time: each text looks its shingles up and counts what it shares with every query, so no pair
of two components goes unseen and no pairs are written but links, one a text and component.

Defined results: texts without words (null, empty, blank) have the empty set and are copies of
each other; a text of fewer words than a shingle is one shingle. Every row is judged by its
text: rows that repeat an id with other texts are rows of their own, rows without an id come
last in the order of ids. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.arrowtext import bounded, map_texts
from veilspan.llm.decontaminate import side, text_key
from veilspan.llm.graph import components
from veilspan.llm.simhash import majority, near_links
from veilspan.session import materialize, release

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
WHOLE, WINDOW = 32, 8
#: Shingles of the query set that are broadcast at a time (12 bytes each).
QUERY_SHINGLES = 1_000_000

_DRAW = np.random.default_rng(17)
_FACTORS = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _DRAW.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _DRAW.integers(0, 1 << 63, BANDS, np.uint64)


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """Hashes (XXH64) of the word shingles, repeats included."""
    import xxhash

    tokens = text.lower().encode("utf-8", "surrogatepass").split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(tokens[i : i + k]), 42) for i in range(max(1, len(tokens) - k + 1))], np.uint64)


def shingle_set(text: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    return np.unique(shingle_hashes(text, k))


def set_code(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), 7) if len(hashes) else 0


def bands(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + 2048]).min(1))
    mixed = (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64) + _SALT
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def signatures(documents: DataFrame, text: str, id_column: str, k: int = SHINGLE) -> DataFrame:
    """id, _key (of the text), code (of the shingle set), n (its size), fp (fingerprint) and bands of every row."""

    def work():
        def step(columns, texts):
            every = [shingle_hashes(t, k) for t in texts]
            sets = [np.unique(h) for h in every]
            return {
                id_column: columns[0],
                "_key": columns[1],
                "code": np.array([set_code(s) for s in sets], np.uint64).view(np.int64),
                "n": [len(s) for s in sets],
                "fp": np.array([majority(h) for h in every], np.uint64).view(np.int64),
                "bands": [bands(s).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets],
            }

        return step

    return map_texts(documents, [id_column, "_key", text], text, f"{id_column} {dict(documents.dtypes)[id_column]}, _key string, code long, n int, fp long, bands array<bigint>", work)


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b): codes that the Gray-order index links, a forest over the fingerprints, and codes of equal fingerprints."""
    codes = distinct.where("n > 0").select("fp", "code")
    first = codes.groupBy("fp").agg(F.min("code").alias("first"))
    linked = near_links(first.select("fp"))
    ends = linked.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    both = ends.unionByName(codes.join(first, "fp").select(F.col("first").alias("x"), F.col("code").alias("y"))).where("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def shared_bands(distinct: DataFrame) -> DataFrame:
    """(band, x): the texts (next band, code, n) of every band that several share."""
    nth = F.posexplode("bands").alias("at", "band")
    rows = distinct.select("code", "n", "bands", nth).select("band", F.struct(F.get("bands", (F.col("at") + 1) % BANDS).alias("next"), "code", "n").alias("x"))
    return rows.groupBy("band").agg(F.collect_list("x").alias("x")).where("size(x) > 1")


def _pairs(groups: DataFrame, choose, threshold: float) -> DataFrame:
    """(a, b): the pairs of positions that `choose` yields for a group's keys, of sizes that allow the threshold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(0)
            for at in range(len(column)):
                inside = column[at].values
                key, code, n = (inside.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                order = np.lexsort((code, key))
                key, code, n = key[order], code[order], n[order].astype(float)
                for i, j in choose(key):
                    fit = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9) & (code[i] != code[j])
                    i, j = code[i[fit]], code[j[fit]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])

    return groups.select("x").mapInArrow(run, "a long, b long").distinct()


def _first_pairs(key: np.ndarray):
    m = len(key)
    if m <= WHOLE:
        yield np.triu_indices(m, 1)
    else:
        yield np.zeros(m - 1, np.int64), np.arange(1, m)
        for w in range(1, WINDOW + 1):
            yield np.arange(m - w), np.arange(w, m)


def candidate_pairs(shared: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): all pairs of the smaller bands, a connecting choice of the larger ones'."""
    return _pairs(shared, _first_pairs, threshold)


def sets_of(codes: DataFrame, by_code: DataFrame, keyed: DataFrame, text: str, k: int) -> DataFrame:
    """(code, hashes): the shingle set of each code, made again from one text each; written."""
    first = materialize(by_code.join(codes, "code").select(F.col("_least._key").alias("_key")).distinct(), "first")

    def work():
        def step(columns, texts):
            sets = [shingle_set(t, k) for t in texts]
            return {"code": np.array([set_code(s) for s in sets], np.uint64).view(np.int64), "hashes": [s.view(np.int64) for s in sets]}

        return step

    sets = map_texts(keyed.join(side(first, first.count()), "_key", "left_semi"), [text], text, "code long, hashes array<bigint>", work)
    out = materialize(sets.dropDuplicates(["code"]), "sets")
    release(first)
    return out


def verified(pairs: DataFrame, by_code: DataFrame, keyed: DataFrame, text: str, k: int, threshold: float) -> DataFrame:
    """The pairs whose whole shingle sets are as similar as `threshold`."""
    wanted = pairs.select(F.col("a").alias("code")).unionByName(pairs.select(F.col("b").alias("code"))).distinct()
    sets = sets_of(wanted, by_code, keyed, text, k)
    both = pairs.join(sets.select(F.col("code").alias("a"), F.col("hashes").alias("_p")), "a").join(sets.select(F.col("code").alias("b"), F.col("hashes").alias("_q")), "b")
    common = F.size(F.array_intersect("_p", "_q"))
    out = materialize(both.where(common >= threshold * (F.size("_p") + F.size("_q") - common) - 1e-9).select("a", "b"), "verified")
    release(sets)
    return out


class Queries:
    """An index of the shingles of some texts: which of them are as similar to a given set as `threshold`."""

    def __init__(self, codes: list[int], roots: list[int], sets: list[list[int]], threshold: float):
        self.code, self.root, self.threshold = np.array(codes, np.int64), np.array(roots, np.int64), threshold
        self.size = np.array([len(s) for s in sets], np.int64)
        hashes = np.concatenate([np.array(s, np.int64) for s in sets])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], np.repeat(np.arange(len(sets), dtype=np.int32), self.size)[order]

    def links(self, code: int, root: int, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(a, b): a link to one query of each other component that has any."""
        lo, hi = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        n = hi - lo
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        common = np.bincount(self.owner[at], minlength=len(self.code))
        alike = np.flatnonzero((common >= self.threshold * (len(hashes) + self.size - common) - 1e-9) & (self.root != root))
        _, first = np.unique(self.root[alike], return_index=True)
        return [(min(code, c), max(code, c)) for c in self.code[alike[first]].tolist()]


def query_links(large: DataFrame, roots: DataFrame, by_code: DataFrame, keyed: DataFrame, text: str, k: int, threshold: float) -> DataFrame | None:
    """(a, b): links that join texts of the larger bands, so far apart, to other components; None if there is nothing to ask."""
    members = large.select("band", F.explode("x.code").alias("code")).join(roots.withColumnRenamed("node", "code"), "code", "left")
    members = materialize(members.select("band", "code", F.coalesce("root", "code").alias("root")), "members")
    sizes = members.groupBy("band", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    odd = materialize(members.join(most, "band").where("root <> most").select("code").distinct(), "odd")
    if odd.isEmpty():
        return None
    all_sets = materialize(sets_of(members.select("code").distinct(), by_code, keyed, text, k).join(members.select("code", "root").distinct(), "code"), "all-sets")
    asked = materialize(all_sets.join(odd, "code", "left_semi"), "asked")
    passes = -(-asked.agg(F.sum(F.size("hashes"))).first()[0] // QUERY_SHINGLES)
    found = None
    for p in range(passes):
        part = asked.where(F.pmod(F.xxhash64("code"), F.lit(passes)) == p).select("code", "root", "hashes").collect()
        if not part:
            continue
        columns = [r[0] for r in part], [r[1] for r in part], [r[2] for r in part]

        def run(batches, columns=columns):
            import pyarrow as pa

            queries = Queries(*columns, threshold)
            for batch in batches:
                code, root = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                out = [x for i in range(batch.num_rows) for x in queries.links(int(code[i]), int(root[i]), batch.column(2)[i].values.to_numpy())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

        links = materialize(bounded(all_sets).select("code", "root", "hashes").mapInArrow(run, "a long, b long").distinct(), "links")
        found = links if found is None else found.unionByName(links)
    return found


def near_duplicates(documents: DataFrame, text: str = "text", id_column: str = "doc_id", k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """id, _key, code, component_id (the smallest id that links reach) and keeper of every row.

    keeper: the row has the smallest id of its component and, of several texts under that id,
    the one with the smallest key (an MD5 of the text). Rows that repeat both are all keepers.
    """
    keyed = documents.select(id_column, F.coalesce(F.col(text), F.lit("")).alias(text)).withColumn("_key", text_key(F.col(text)))
    signed = materialize(signatures(keyed, text, id_column, k), "signed")
    prints = signed.select(id_column, "_key", "code")
    least_row = F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), "_key")).alias("_least")
    by_code = materialize(signed.groupBy("code").agg(least_row, F.any_value("n").alias("n"), F.min("fp").alias("fp"), F.any_value("bands").alias("bands")), "codes")
    shared = materialize(shared_bands(by_code.where("n > 0")), "bands")
    pairs = materialize(candidate_pairs(shared, threshold).unionByName(fingerprint_pairs(by_code)).distinct(), "pairs")
    roots = materialize(components(verified(pairs, by_code, keyed, text, k, threshold)), "roots")
    more = query_links(shared.where(F.size("x") > WHOLE), roots, by_code, keyed, text, k, threshold)
    if more is not None:
        roots = materialize(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
    tied = by_code.select("code", "_least").join(roots.withColumnRenamed("node", "code"), "code")
    best = tied.groupBy("root").agg(F.min("_least").alias("_best"))
    linked = materialize(tied.join(best, "root").select("code", "_best"), "linked")
    final = materialize(by_code.select("code", "_least").join(linked, "code", "left").select("code", F.coalesce("_best", "_least").alias("_best")), "final")
    for done in (shared, pairs, roots, linked, by_code):
        release(done)
    is_keeper = F.col(id_column).eqNullSafe(F.col("_best.id")) & (F.col("_key") == F.col("_best._key"))
    return prints.join(final, "code").select(id_column, "_key", "code", F.col("_best.id").alias("component_id"), is_keeper.alias("keeper"))


def first_of_each(documents: DataFrame, text: str = "text", id_column: str = "doc_id", **options) -> DataFrame:
    """`documents` with one row of each group of near copies, all columns: the keeper's.

    The rows that go are known by id and key; they are broadcast up to a counted size, so texts
    are not shuffled. Of rows that repeat the keeper's id and text, any one stays.
    """
    found = materialize(near_duplicates(documents, text, id_column, **options), "near")
    gone = materialize(found.where("NOT keeper").select(F.col(id_column).alias("_id"), "_key").distinct(), "gone")
    keyed = documents.withColumn("_key", text_key(F.coalesce(F.col(text), F.lit(""))))
    same = lambda other: (keyed["_key"] == other["_key"]) & keyed[id_column].eqNullSafe(other["_id"])
    kept = keyed.join(side(gone, gone.count()), same(gone), "left_anti")
    repeated = materialize(found.where("keeper").groupBy(F.col(id_column).alias("_id"), "_key").count().where("count > 1").select("_id", "_key"), "repeated")
    if repeated.isEmpty():
        return kept.select(*documents.columns)
    # Rows that repeat an id and a text are rare; only they are shuffled to leave one of each.
    match = (kept["_key"] == repeated["_key"]) & kept[id_column].eqNullSafe(repeated["_id"])
    once = kept.join(repeated, match, "left_semi").dropDuplicates(["_key", id_column])
    return kept.join(repeated, match, "left_anti").unionByName(once).select(*documents.columns)
