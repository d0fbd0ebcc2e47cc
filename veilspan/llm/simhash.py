"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 bits over rolling word shingles, repeats included; a bit is set if more
than half of the shingle hashes (XXH64, seed 42) have it.

Search: all pairs within `radius` differing bits are found, none is missed. Two such codes
agree in at least one of `radius + 1` blocks of bits, so each distinct code is sent to one
shuffle partition for each of its blocks. There, the codes that share the block form a
tree: they are sorted by Gray rank, which puts codes with long shared bit patterns next to
each other; each node keeps the bits that all codes below it agree in (mask and pattern),
groups of nodes get a parent likewise. Two nodes are compared by the differences in the
bits fixed in both: beyond `radius` the whole pair of groups is pruned, otherwise their
children are compared. Groups whose codes cannot differ by more than `radius` are linked as
a whole. Within a task links are joined at once, so it sends on a forest (at most one edge
a code) and not all pairs.

Equal texts collapse before the search: it runs on distinct fingerprints. Components are
joined over the whole table by star contraction in shared storage.

Defined results: texts without words (null, empty, blank) have fingerprint zero and link
like any other. Rows that repeat an id are treated as rows of one document, which links all
their fingerprints. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.arrowtext import map_texts
from veilspan.llm.graph import components
from veilspan.session import materialize

RADIUS = 3
SHINGLE = 3
FAN_OUT = 8
#: Node pairs that are compared at a time (memory bound of a task).
FRONT = 1 << 18


def fingerprint_bytes(raw: bytes, k: int = SHINGLE) -> int:
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = raw.lower().split()
    if not tokens:
        return 0
    if len(tokens) < k:
        return digest(b" ".join(tokens), 42)
    if k == 3:
        hashes = [digest(b"%b %b %b" % gram, 42) for gram in zip(tokens, tokens[1:], tokens[2:])]
    else:
        hashes = [digest(b" ".join(tokens[i : i + k]), 42) for i in range(len(tokens) - k + 1)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes, as one number."""
    seen = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[at : at + 4096], "<u8")
        seen += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * seen > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, text: str = "text", id_column: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """id and fp (the fingerprint as a signed 64-bit number) of every row."""

    def work():
        def step(columns, texts):
            codes = np.array([fingerprint_bytes(t.encode("utf-8", "surrogatepass"), k) for t in texts], np.uint64)
            return {id_column: columns[0], "fp": codes.view(np.int64)}

        return step

    return map_texts(documents, [id_column, text], text, f"{id_column} {dict(documents.dtypes)[id_column]}, fp long", work)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def build_levels(codes: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels from the leaves up: (pattern, mask, first child, end of children, first leaf) of each node.

    group: number of the tree of each code, not decreasing. The top level has one node a tree.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    n = len(codes)
    levels = [(codes, np.full(n, full), np.arange(n), np.arange(n) + 1, np.arange(n))]
    own = group
    while len(own) > 1 and (own[1:] == own[:-1]).any():
        first = np.r_[True, own[1:] != own[:-1]]
        at = np.arange(len(own))
        start = np.maximum.accumulate(np.where(first, at, 0))
        heads = np.flatnonzero((at - start) % FAN_OUT == 0)
        pattern, mask, _, _, leaf = levels[-1]
        low = np.bitwise_and.reduceat(pattern | ~mask, heads)  # 1 where all codes have 1, or it is open
        high = np.bitwise_or.reduceat(pattern & mask, heads)
        fixed = np.bitwise_and.reduceat(mask, heads)
        new_mask = fixed & ~(low ^ high)
        levels.append((high & new_mask, new_mask, heads, np.r_[heads[1:], len(own)], leaf[heads]))
        own = own[heads]
    return levels


def link(codes: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a forest over positions that joins all codes of one group within `radius` bits (through links)."""
    forest, n = Forest(len(codes)), len(codes)
    levels = build_levels(codes, group)
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    size = np.diff(np.r_[levels[top][4], n])
    roots = roots[size > 1]
    stack = [(top, roots[i : i + FRONT], roots[i : i + FRONT]) for i in range(0, len(roots), FRONT)]
    while stack:
        level, a, b = stack.pop()
        pattern, mask, first, end, leaf = levels[level]
        both = mask[a] & mask[b]
        apart = np.bitwise_count((pattern[a] ^ pattern[b]) & both)
        near = apart <= radius
        a, b, both, apart = a[near], b[near], both[near], apart[near]
        whole = apart + np.bitwise_count(~both) <= radius
        if whole.any():
            ends = np.r_[leaf[1:], n]
            for i, j in zip(a[whole].tolist(), b[whole].tolist()):
                head = int(leaf[i])
                for node in {i, j}:
                    for x in range(int(leaf[node]), int(ends[node])):
                        forest.join(head, x)
        a, b = a[~whole], b[~whole]
        if level == 0 or not len(a):
            continue
        ca, cb = end[a] - first[a], end[b] - first[b]
        per = FAN_OUT * FAN_OUT
        for at in range(0, len(a), max(1, FRONT // per)):
            s = slice(at, at + max(1, FRONT // per))
            grid_i, grid_j = np.divmod(np.arange(per), FAN_OUT)
            ok = (grid_i < ca[s, None]) & (grid_j < cb[s, None])
            x, y = (first[a[s]][:, None] + grid_i)[ok], (first[b[s]][:, None] + grid_j)[ok]
            keep = x <= y if level > 1 else x < y
            stack.append((level - 1, x[keep], y[keep]))
    return [(i, r) for i in range(n) if (r := forest.root(i)) != i]


def block_keys(radius: int = RADIUS) -> list[tuple[int, int]]:
    """(shift, width) of the blocks: radius + 1 of them, as even as 64 bits allow."""
    n = radius + 1
    marks = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(marks, marks[1:])]


def near_links(distinct: DataFrame, radius: int = RADIUS, partitions: int | None = None) -> DataFrame:
    """(a, b): edges that connect all fingerprints (`fp`, distinct) within `radius` bits."""
    blocks = block_keys(radius)
    keyed = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1)).alias("bits")) for i, (lo, width) in enumerate(blocks)])).alias("k"),
    ).select("fp", F.col("k.block").alias("block"), F.col("k.bits").alias("bits"))
    n = partitions or max(8, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.repartition(n, "block", "bits")

    def run(batches):
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        if not parts:
            return
        fp, block, bits = (np.concatenate(x) for x in zip(*parts))
        codes = fp.view(np.uint64)
        shifts = np.array([lo + width for lo, width in blocks])[block] % 64
        # The shared block goes to the top, so that Gray order keeps its tree together.
        turned = (codes >> shifts.astype(np.uint64)) | np.where(shifts > 0, codes << ((64 - shifts) % 64).astype(np.uint64), np.uint64(0))
        order = np.lexsort((gray_rank(turned), bits, block))
        codes, block, bits = codes[order], block[order], bits[order]
        group = np.cumsum(np.r_[0, (block[1:] != block[:-1]) | (bits[1:] != bits[:-1])])
        edges = link(codes, group, radius)
        if edges:
            signed = codes.view(np.int64)
            i, j = np.array(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(signed[i]), pa.array(signed[j])], names=["a", "b"])

    return dealt.select("fp", "block", "bits").mapInArrow(run, "a long, b long")


def near_duplicates(documents: DataFrame, text: str = "text", id_column: str = "doc_id", radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """id, fp, component_id (the smallest id that links reach) of every row."""
    prints = materialize(fingerprints(documents, text, id_column, k), "prints")
    # Pre-aggregated: a fingerprint is searched once however many rows have it.
    by_code = materialize(prints.groupBy("fp").agg(F.min(id_column).alias("_least")), "codes")
    links = near_links(by_code.select("fp"), radius)
    # Rows that repeat an id tie their different fingerprints together.
    twice = prints.groupBy(id_column).agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("_n")).where("_n > 1")
    ties = prints.join(twice.select(id_column, "a"), id_column).where("fp <> a").select("a", F.col("fp").alias("b"))
    roots = materialize(components(links.unionByName(ties)), "roots")
    tied = by_code.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = tied.groupBy("root").agg(F.min("_least").alias("component_id"))
    linked = materialize(tied.join(least, "root").select("fp", "component_id"), "linked")
    final = by_code.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "_least").alias("component_id"))
    return prints.join(final, "fp").select(id_column, "fp", "component_id")


def hexadecimal(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
