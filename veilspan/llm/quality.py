"""Quality rules: text statistics plus a learned decision list.

`statistics` computes per-text counts with DataFrame expressions only. `learn` grows an
ordered list of threshold conjunctions by sequential covering on labelled statistics: a
rule is grown condition by condition for information gain on two thirds of the rows,
pruned on the other third, and the rows it covers are removed before the next one.
`DecisionList.verdict` emits the list as one ordered Spark conditional expression.

Defined results: a null or blank text has all counts 0 and fails the base rule. Rows are
judged one by one, so repeated rows and repeated ids each get their own verdict. Without
labels of both kinds the list is empty and only the base rule decides. Columns of the
input other than id and text are ignored unless asked for with `keep`.

Training reads at most `max_train` labelled rows (those with the smallest id hashes);
scoring covers every row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.textexpr import WORD_RE, gram_hashes, pinned, words
from veilspan.session import short_batches

WINDOW = 8
MAX_TRAIN = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "digit_share", "upper_share")


def statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ratios: bool = True) -> DataFrame:
    """`keep` columns, the five counts and (optionally) the ratios the rules are made of."""
    base = short_batches(df).select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    base = base.select(*keep, "_t", pinned(words(F.col("_t"), WORD_RE)).alias("_w"))
    # Lines with a word; white space inside a line counts when lines are compared.
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD_RE))
    base = base.select("*", pinned(F.transform("_w", lambda w: F.xxhash64(w))).alias("_h"), pinned(lines).alias("_l"))
    base = base.select("*", pinned(gram_hashes(F.col("_h"), WINDOW)).alias("_g"))
    repeated = F.size("_g") > F.size(F.array_distinct("_g"))
    pairs = F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    base = base.select("*", pinned(F.when(repeated, F.sort_array(pairs))).alias("_s"))
    twin = F.filter("_s", lambda e, j: F.coalesce(e["g"] == F.get("_s", j - 1)["g"], F.lit(False)) | F.coalesce(e["g"] == F.get("_s", j + 1)["g"], F.lit(False)))
    base = base.select("*", pinned(F.sort_array(F.transform(twin, lambda e: e["i"]))).alias("_p"))
    # Windows start at _p: each adds the words up to the next start, eight at most.
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    out = base.select(
        *keep,
        pinned(F.size("_w").cast("long")).alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        pinned(F.coalesce(covered, F.lit(0)).cast("long")).alias("n_repeat_words"),
        *([F.size("_l").alias("_n_lines"), F.size(F.array_distinct("_h")).alias("_n_distinct"), F.length(F.regexp_replace("_t", r"[^0-9]+", "")).alias("_digits"), F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).alias("_upper")] if ratios else []),
    )
    if not ratios:
        return out
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")
    return out.select(
        *keep, *COUNTS,
        share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_dup_lines", "_n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_n_distinct", "n_words").alias("distinct_share"), share("_digits", "word_chars").alias("digit_share"),
        share("_upper", "word_chars").alias("upper_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.cut) if self.above else c <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Ordered conjunctions; the first that holds rejects the row, else it is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def fired(self) -> Column:
        """Number of the first rule that holds, from 1; null if none does."""
        out = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            held = rule[0].column()
            for condition in rule[1:]:
                held = held & condition.column()
            out = F.when(held, F.lit(i)).otherwise(out)
        return out

    def verdict(self) -> Column:
        return self.fired().isNull()

    def __str__(self) -> str:
        return "\n".join(" AND ".join(map(str, r)) + " -> reject" for r in self.rules) or "(keep all)"


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def cover(rows: list[tuple], features: list[str], cuts: dict[str, list[float]], max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.9, min_cover: int = 5) -> DecisionList:
    """Sequential covering over binned rows.

    rows: (bins per feature, is_reject, part of the growing set, weight); bin b of a feature
    means that exactly b of its cut points lie below the value.
    """
    learned, left = DecisionList(), rows

    def tally(rule, data):
        p = n = 0.0
        for bins, bad, _, weight in data:
            if all((bins[f] > b) == above for f, above, b in rule):
                p, n = (p + weight, n) if bad else (p, n + weight)
        return p, n

    while len(learned.rules) < max_rules:
        rule, inside = [], [r for r in left if r[2]]
        while len(rule) < max_conditions:
            p0, n0 = sum(r[3] for r in inside if r[1]), sum(r[3] for r in inside if not r[1])
            if not p0 or not n0:
                break
            best = (0.0, None)
            for f, name in enumerate(features):
                size = len(cuts[name]) + 1
                pos, neg = [0.0] * size, [0.0] * size
                for bins, bad, _, weight in inside:
                    (pos if bad else neg)[bins[f]] += weight
                p = n = 0.0
                for b in range(size - 1):
                    p, n = p + pos[b], n + neg[b]
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        if pp >= min_cover and (g := _gain(p0, n0, pp, nn)) > best[0] + 1e-9:
                            best = (g, (f, above, b))
            if not best[1]:
                break
            f, above, b = best[1]
            rule.append(best[1])
            inside = [r for r in inside if (r[0][f] > b) == above]
        if not rule:
            break
        held_back = [r for r in left if not r[2]]
        worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*tally(r, held_back))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        p, n = tally(rule, left)
        if p < min_cover or p < min_precision * (p + n):
            break
        learned.rules.append([Condition(features[f], above, cuts[features[f]][b]) for f, above, b in rule])
        left = [r for r in left if not all((r[0][f] > b) == above for f, above, b in rule)]
    return learned


def learn(documents: DataFrame, labels: DataFrame, text: str = "text", max_train: int = MAX_TRAIN, n_cuts: int = 40) -> DecisionList:
    """Fit the list on at most `max_train` rows of `labels` (doc_id, quality 0/1).

    The sample's ids are broadcast (8 bytes each, `max_train` at most); only the sampled
    documents' statistics are computed.
    """
    ids = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_train)
    sampled = documents.select("doc_id", F.col(text).alias("text")).join(F.broadcast(ids), "doc_id")
    features = ["n_words", *RATIOS]
    rows = [
        (tuple(float(r[f]) for f in features), r["quality"] == 0, r["g"] != 0)
        for r in statistics(sampled, keep=("doc_id", "quality")).select(*features, "quality", base_failed().alias("failed"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)).alias("g")).collect()
        if not r["failed"]
    ]
    rows.sort()
    if not rows or all(r[1] for r in rows) or not any(r[1] for r in rows):
        return DecisionList()
    cuts, binned = {}, [[0] * len(features) for _ in rows]
    for f, name in enumerate(features):
        values = sorted(r[0][f] for r in rows)
        # Cut points between neighbouring values, evenly over all rows and over the rare class.
        marks = set()
        for part in (values, sorted(r[0][f] for r in rows if r[1])):
            for q in range(1, n_cuts):
                marks.add(part[min(len(part) - 1, q * len(part) // n_cuts)])
        cuts[name] = sorted(marks)
        for i, r in enumerate(rows):
            lo, hi = 0, len(cuts[name])
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if cuts[name][mid] < r[0][f] else (lo, mid)
            binned[i][f] = lo
    found = cover([(tuple(b), r[1], r[2], 1.0) for b, r in zip(binned, rows)], features, cuts)
    # A cut moves to the middle of the gap that it lies in, away from both neighbours.
    for rule in found.rules:
        for i, c in enumerate(rule):
            values = [r[0][features.index(c.feature)] for r in rows]
            low, high = max((v for v in values if v <= c.cut), default=c.cut), min((v for v in values if v > c.cut), default=c.cut)
            rule[i] = Condition(c.feature, c.above, (low + high) / 2)
    return found


def judge(documents: DataFrame, rules: DecisionList, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, the five counts, base_failed, kept, and the number of the rule that fired."""
    stats = statistics(documents, text, keep)
    return stats.select(
        *keep, *COUNTS, base_failed().alias("base_failed"),
        (~base_failed() & rules.verdict()).alias("kept"), rules.fired().alias("rule"),
    )
