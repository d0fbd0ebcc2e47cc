"""Toxicity scores by weak supervision.

Voters are lexicons and patterns that vote `toxic` or abstain: seed lexicons and a seed
pattern, lexicons of words and of word beginnings mined from labelled rows, and patterns of
how many different words of these a text holds, and how densely. The votes of all distinct training texts,
labelled or not, are counted by vote pattern. A generative label model (two classes, each a
tree of voters: P(vote | class, vote of the parent)) is fitted to these counts by expectation
maximisation: it learns the voters' accuracies and, through the tree, which of them repeat
each other. No label is a vote: labels only mined the lexicons and give the prior, the toxic
share of the labelled rows; the class in which voters fire more often is the toxic one. A linear classifier (logistic) is trained on the model's
posterior labels, over the same features, on training texts that need no label.
Scoring sees the text alone.

Bounds: at most `max_train` labelled rows of each class (smallest id hashes) are mined, and at
most `MAX_FIT` distinct texts that hold a mined word (smallest text hashes) train the classifier;
how common the mined words are and how often votes go together is counted over all distinct
training texts. The driver gets counts only: mined features, vote patterns (2^19 at most), and
the feature numbers of the texts that train. Texts stay on the executors.

Defined results: null and empty texts get the score of a text without features. Without
labelled rows of both classes the seed lexicon decides (two different seed words give a
score over one half). Ids may be of any type; rows without an id are scored, but not learned
from, repeated ids are one training row each. Repeated rows get equal scores; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.arrowtext import map_texts
from veilspan.session import materialize

MAX_TRAIN, MAX_FIT = 4000, 8000
THRESHOLD = 0.3
#: A word is a run of letters; beginnings have these lengths.
WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
#: Lexicon voters of mined words and of beginnings.
WORD_VOTERS, BEGINNING_VOTERS = 8, 4
#: Patterns: different words on the list, and one such word among so many different words of the text.
AT_LEAST, ONE_IN = (2, 4), (300, 60)
#: A mined feature stands in this share of the toxic rows at least, this many times the share of the clean ones.
LEAST_SHARE, LEAST_RATIO = 0.006, 30.0

#: Common English insults, by part of speech.
SEED_NOUNS = "idiot moron imbecile loser scum trash clown jerk fool vermin".split()
SEED_ADJECTIVES = "stupid pathetic worthless disgusting dumb despicable vile filthy".split()
SEED_PATTERN = re.compile(r"\b(?:you|u|they|he|she)(?:\s+are|'re|\s+is|\s+r)\s+(?:all\s+|just\s+|such\s+)?(?:an?\s+)?(?:" + "|".join(SEED_NOUNS + SEED_ADJECTIVES) + r")\b")
#: The seed pattern's and the patterns' feature names.
INSULT = "<insult>"


def at_least(n: int) -> str:
    return f"<{n} words>"


def one_in(n: int) -> str:
    return f"<1 of {n}>"


PATTERNS = [INSULT, *map(at_least, AT_LEAST), *map(one_in, ONE_IN)]


def features(text: str) -> set[str]:
    """Distinct words, and beginnings of longer words as `abcd*`."""
    out: set[str] = set()
    for w in set(WORD.findall(text.lower())):
        out.add(w)
        out.update(w[:k] + "*" for k in BEGINNINGS if len(w) > k)
    return out


class Scanner:
    """Finds which words and beginnings of a list stand in a text, in one walk over it."""

    def __init__(self, wanted: list[str]):
        import ahocorasick

        self.index = {f: i for i, f in enumerate(wanted)}
        keys: dict[str, list[tuple[int, bool]]] = {}
        for f, i in self.index.items():
            if not f.startswith("<"):
                keys.setdefault(f.rstrip("*"), []).append((i, f.endswith("*")))
        self.automaton = ahocorasick.Automaton()
        for key, values in keys.items():
            self.automaton.add_word(key, (len(key), values))
        if keys:
            self.automaton.make_automaton()
        self.empty = not keys

    def __call__(self, text: str) -> set[int]:
        """Numbers of the features; those in angle brackets count if they are on the list."""
        low, index = text.lower(), self.index
        out: set[int] = set()
        words: set[str] = set()
        if not self.empty:
            size = len(low)
            for end, (length, values) in self.automaton.iter(low):
                at = end + 1 - length
                if at and _letter(low[at - 1]):
                    continue
                goes_on = end + 1 < size and _letter(low[end + 1])
                hit = [i for i, beginning in values if beginning == goes_on]
                if hit:
                    out.update(hit)
                    words.add(WORD.match(low, at).group() if goes_on else low[at : end + 1])
        if len(words) >= 2:  # a single word is chance
            size = len(set(low.split()))
            out.update(index[at_least(n)] for n in AT_LEAST if len(words) >= n and at_least(n) in index)
            out.update(index[one_in(n)] for n in ONE_IN if n * len(words) >= size and one_in(n) in index)
        if INSULT in index and SEED_PATTERN.search(low):
            out.add(index[INSULT])
        return out


def _letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


@dataclass
class LabelModel:
    """A prior and, for each class, a tree of voters: firing[c, i, v] = P(voter i fires | class c, its parent's vote v)."""

    prior: float
    parent: np.ndarray
    firing: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, counts: np.ndarray, prior: float | None = None, rounds: int = 100) -> LabelModel:
        """votes: distinct patterns, a row each, 0 or 1; counts: how many texts have them. prior: fixed if given."""
        total, n = counts.sum(), votes.shape[1]
        # Where several voters fire is likelier toxic than where one does; expectation maximisation does the rest.
        q = np.clip(votes.sum(1) / 4.0, 0.01, 0.97)
        model, parent = None, np.full(n, -1)
        for k in range(rounds):
            mass = np.stack([counts * (1 - q), counts * q])
            if k <= 8:  # the tree settles with the classes
                parent = _tree(votes, mass)
            firing = np.empty((2, n, 2))
            for i in range(n):
                for v in (0, 1):
                    on = np.ones(len(votes)) if parent[i] < 0 else votes[:, parent[i]] == v
                    part = mass * on
                    firing[:, i, v] = ((part @ votes[:, i]) + 0.05) / (part.sum(1) + 0.5)
            model = cls(float(np.clip(mass[1].sum() / total if prior is None else prior, 1e-4, 0.9)), parent, firing)
            new = model.posterior(votes)
            done = np.abs(new - q).max() < 1e-6 and k > 10
            q = new
            if done:
                break
        fires = (counts * q) @ votes.sum(1) / max(1e-9, (counts * q).sum()), (counts * (1 - q)) @ votes.sum(1) / max(1e-9, (counts * (1 - q)).sum())
        if fires[0] < fires[1] and prior is None:
            model = cls(1 - model.prior, model.parent, model.firing[::-1].copy())
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for i in range(votes.shape[1]):
            v = np.zeros(len(votes), int) if self.parent[i] < 0 else votes[:, self.parent[i]].astype(int)
            p = self.firing[:, i][:, v]
            z += np.where(votes[:, i] > 0, np.log(p[1] / p[0]), np.log((1 - p[1]) / (1 - p[0])))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _tree(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Parents in the spanning tree of voters that share most information within the classes (-1: the root)."""
    n = votes.shape[1]
    shared = np.zeros((n, n))
    total = mass.sum()
    for m in mass:
        size = m.sum()
        if size <= 0:
            continue
        one = (m @ votes) / size
        both = (votes * m[:, None]).T @ votes / size
        for a, pa in ((1, one), (0, 1 - one)):
            for b, pb in ((1, one), (0, 1 - one)):
                joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                joint = np.clip(joint, 1e-12, 1)
                shared += size / total * joint * np.log(joint / np.clip(pa[:, None] * pb[None, :], 1e-12, 1))
    parent = np.full(n, -1)
    best, source = shared[0].copy(), np.zeros(n, int)
    out = {0}
    while len(out) < n:
        best[list(out)] = -np.inf
        i = int(best.argmax())
        parent[i] = source[i]
        out.add(i)
        closer = shared[i] > best
        closer[list(out)] = False
        best[closer], source[closer] = shared[i][closer], i
    return parent


def _sigmoid(z: float) -> float:
    return 1 / (1 + float(np.exp(-max(-40.0, min(40.0, z)))))


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=lambda: {w: 2.5 for w in SEED_NOUNS + SEED_ADJECTIVES})
    bias: float = -4.0
    label_model: LabelModel | None = None

    def scorer(self):
        """A function from a text to its score."""
        names = sorted(self.weights)
        scan, values = Scanner(names), [self.weights[f] for f in names]
        return lambda text: _sigmoid(self.bias + sum(values[i] for i in sorted(scan(text))))

    def score(self, text: str) -> float:
        return self.scorer()(text)


def candidates(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, float, float]]:
    """(feature, share of the toxic rows, of the clean rows) of those far commoner in toxic rows, best first.

    counts: (feature, toxic rows, clean rows) of every feature that stands in enough toxic rows.
    """
    longest: dict[str, int] = {}  # the count of the commonest word with each beginning
    for f, toxic, _ in counts:
        for k in BEGINNINGS:
            if not f.endswith("*") and len(f) > k:
                longest[f[:k] + "*"] = max(toxic, longest.get(f[:k] + "*", 0))
    out = []
    for f, toxic, clean in counts:
        share, other = toxic / n_toxic, (clean + 1) / n_clean  # one clean row more: rare words need more proof
        # A beginning that stands for one word adds only chance hits.
        if longest.get(f, 0) < 0.8 * toxic and share > LEAST_RATIO * other:
            out.append((f, share, other))
    return sorted(out, key=lambda x: (3 * x[2] - x[1], x[0]))


def common_enough(found: list[tuple[str, float, float]], corpus: dict[str, float], most: int = 600) -> list[str]:
    """Candidates that the rest of the corpus hardly has, best first.

    corpus: the share of all distinct texts that hold each. A feature of toxic texts alone has as
    many times its toxic share as the corpus has toxic texts, the least ratio there is; the
    lower quartile over the candidates stands for it and is taken off.
    """
    if not found:
        return []
    shares, everywhere = np.array([s for _, s, _ in found]), np.array([corpus.get(f, 0.0) for f, *_ in found])
    toxic_part = float(min(0.9, np.quantile(everywhere / shares, 0.25)))
    rest = np.maximum(0, everywhere - toxic_part * shares) / (1 - toxic_part)
    return [f for (f, s, _), r in zip(found, rest) if s > 3 * r][:most]


def voters(mined: list[str]) -> list[set[str]]:
    """Each voter's features: seeds, the seed pattern, mined lexicons, numbers of different words."""
    words, beginnings = [f for f in mined if not f.endswith("*")], [f for f in mined if f.endswith("*")]
    # Beginnings of one stem go to one voter.
    stems = sorted({f[: BEGINNINGS[0]] for f in beginnings})
    by_stem = [{f for f in beginnings if stems.index(f[: BEGINNINGS[0]]) % BEGINNING_VOTERS == i} for i in range(BEGINNING_VOTERS)]
    return [set(SEED_NOUNS), set(SEED_ADJECTIVES), {INSULT}, *[set(words[i::WORD_VOTERS]) for i in range(WORD_VOTERS)], *by_stem, *[{f} for f in PATTERNS[1:]]]


def vocabulary(mined: list[str]) -> list[str]:
    return sorted({*mined, *SEED_NOUNS, *SEED_ADJECTIVES, *PATTERNS})


def train(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, names: list[str], steps: int = 600, penalty: float = 1e-3) -> tuple[dict[str, float], float]:
    """Logistic regression on soft labels, full-batch accelerated gradient. rows: feature numbers of each text."""
    n = len(names)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    weight = weight / weight.sum()
    w = v = np.zeros(n)
    b = c = float(np.log((weight @ target + 1e-4) / (1 - weight @ target + 1e-4)))
    rate = 4.0 / (1 + min(40.0, max([1.0, *map(len, rows)])))
    for k in range(steps):
        z = np.bincount(at, v[col], len(rows)) + c
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * weight
        new_w, new_b = v - rate * (np.bincount(col, g[at], n) + penalty * v * 0.01), c - rate * g.sum()
        m = k / (k + 3)
        v, c, w, b = new_w + m * (new_w - w), new_b + m * (new_b - b), new_w, new_b
    return {f: float(w[i]) for i, f in enumerate(names) if abs(w[i]) > 1e-3}, float(b)


def fit(mined: list[str], patterns: dict[int, int], sample: list[tuple[list[int], float]], prior: float) -> ToxicityModel:
    """prior: toxic share of the labelled rows; patterns: distinct texts by vote pattern (a bit a voter); sample: (numbers in `vocabulary(mined)`, weight) of texts."""
    names, parts = vocabulary(mined), voters(mined)
    known = np.array(sorted(patterns), np.int64)
    votes = (known[:, None] >> np.arange(len(parts)) & 1).astype(float)
    live = np.flatnonzero(votes.any(0))
    if not len(live):
        return ToxicityModel()
    label_model = LabelModel.fit(votes[:, live], np.array([patterns[p] for p in known.tolist()], float), prior)
    own = [[k for k, part in enumerate(parts) if names[i] in part] for i in range(len(names))]
    cast = np.zeros((len(sample), len(parts)))
    for r, (found, _) in enumerate(sample):
        for i in found:
            cast[r, own[i]] = 1
    target = label_model.posterior(cast[:, live])
    weights, bias = train([np.array(sorted(f), np.int64) for f, _ in sample], target, np.array([w for _, w in sample]), names)
    return ToxicityModel(weights, bias, label_model)


def pattern_of(names: list[str], mined: list[str]) -> list[int]:
    """For each feature of `names` the vote pattern that it gives rise to."""
    parts = voters(mined)
    return [sum(1 << k for k, part in enumerate(parts) if f in part) for f in names]


def mine(sampled: DataFrame, n_toxic: int, text: str) -> list[tuple[str, int, int]]:
    """(feature, toxic rows, clean rows) of the features in enough toxic rows. sampled: text and toxic."""

    def work():
        def step(columns, texts):
            counts: dict[str, list[int]] = {}
            for t, toxic in zip(texts, columns[0].to_pylist()):
                for f in features(t):
                    counts.setdefault(f, [0, 0])[0 if toxic else 1] += 1
            return {"feature": list(counts), "n_toxic": [c[0] for c in counts.values()], "n_clean": [c[1] for c in counts.values()]}

        return step

    partial = map_texts(sampled, ["toxic", text], text, "feature string, n_toxic long, n_clean long", work)
    counted = partial.groupBy("feature").agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c"))
    return [tuple(r) for r in counted.where(F.col("t") >= max(3.0, LEAST_SHARE * n_toxic)).collect()]


def scanned(documents: DataFrame, wanted: list[str], text: str) -> DataFrame:
    """(mark, found): the features of `wanted` in each distinct text, by number; mark is the text's hash."""

    def work():
        import xxhash

        scan = Scanner(wanted)

        def step(columns, texts):
            marks = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
            return {"mark": marks.view(np.int64), "found": [sorted(scan(t)) for t in texts]}

        return step

    return map_texts(documents, [text], text, "mark long, found array<int>", work).dropDuplicates(["mark"])


def learn(documents: DataFrame, labels: DataFrame, where: str = "true", max_train: int = MAX_TRAIN, text: str = "text", id_column: str = "doc_id") -> ToxicityModel:
    """Mine labelled rows (id, toxic 0/1) that satisfy `where`, then fit to all documents that satisfy it."""
    marked = labels.where(f"({where}) AND toxic IS NOT NULL AND {id_column} IS NOT NULL").select(id_column, (F.col("toxic") == 1).alias("toxic"))
    part = lambda toxic: marked.where("toxic" if toxic else "NOT toxic").orderBy(F.xxhash64(id_column), id_column).limit(max_train)
    # At most 2 * max_train ids are broadcast.
    chosen = materialize(part(True).unionByName(part(False)).groupBy(id_column).agg(F.max("toxic").alias("toxic")), "chosen")
    sampled = documents.select(id_column, F.col(text).alias("_text")).join(F.broadcast(chosen), id_column)
    sampled = materialize(sampled.groupBy("_text").agg(F.max("toxic").alias("toxic")), "labelled")  # copies count once
    sizes = {r[0]: r[1] for r in sampled.groupBy("toxic").count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return ToxicityModel()
    found = candidates(mine(sampled, sizes[True], "_text"), sizes[True], sizes[False])
    names = vocabulary([f for f, *_ in found])
    hits = materialize(scanned(documents.where(where), names, text), "hits")
    n_texts = hits.count()
    counts = {names[r[0]]: r[1] for r in hits.select(F.explode("found").alias("i")).groupBy("i").count().collect()}
    mined = common_enough(found, {f: c / max(1, n_texts) for f, c in counts.items()})
    # The numbers of different words are recounted over what was mined; a second walk sees that.
    final = vocabulary(mined)
    hits = materialize(scanned(documents.where(where), final, text), "hits")
    codes = F.array(*[F.lit(p) for p in pattern_of(final, mined)])
    pattern = F.aggregate("found", F.lit(0), lambda a, i: a.bitwiseOR(F.get(codes, i)))
    patterns = {r[0]: r[1] for r in hits.groupBy(pattern.alias("p")).count().collect()}
    with_hits = hits.where("size(found) > 0")
    n_hits = n_texts - patterns.get(0, 0)
    chosen = [list(r[0]) for r in with_hits.orderBy(F.xxhash64("mark"), "mark").select("found").limit(MAX_FIT).collect()]
    sample = [(f, n_hits / max(1, len(chosen))) for f in chosen] + [([], float(max(1, patterns.get(0, 0))))]
    return fit(mined, patterns, sample, marked.agg(F.avg(F.col("toxic").cast("double"))).first()[0])


def score(documents: DataFrame, model: ToxicityModel, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, score and predicted (1 from THRESHOLD on) of every row."""
    weights, bias = model.weights, model.bias

    def work():
        score_of = ToxicityModel(weights, bias).scorer()

        def step(columns, texts):
            scores = [score_of(t) for t in texts]
            return {id_column: columns[0], "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

        return step

    return map_texts(documents, [id_column, text], text, f"{id_column} {dict(documents.dtypes)[id_column]}, score double, predicted int", work)


def learn_local(texts: list[str], labels: list[int]) -> ToxicityModel:
    """The same from lists; labels: 0, 1, or -1 for texts without one."""
    if 0 not in labels or 1 not in labels:
        return ToxicityModel()
    counts: dict[str, list[int]] = {}
    once: dict[str, int] = {}
    for t, label in zip(texts, labels):
        if label >= 0:
            once[t] = max(label, once.get(t, 0))
    sizes = Counter(once.values())
    for t, label in once.items():
        for f in features(t):
            counts.setdefault(f, [0, 0])[0 if label else 1] += 1
    found = candidates([(f, a, b) for f, (a, b) in counts.items() if a >= max(3.0, LEAST_SHARE * sizes[1])], sizes[1], sizes[0])
    distinct = sorted(set(texts))

    def scan_all(names):
        scan = Scanner(names)
        return [sorted(scan(t)) for t in distinct]

    names = vocabulary([f for f, *_ in found])
    held = Counter(names[i] for hit in scan_all(names) for i in hit)
    mined = common_enough(found, {f: c / len(distinct) for f, c in held.items()})
    codes, hits = pattern_of(vocabulary(mined), mined), scan_all(vocabulary(mined))
    patterns: Counter[int] = Counter()
    for hit in hits:
        p = 0
        for i in hit:
            p |= codes[i]
        patterns[p] += 1
    return fit(mined, dict(patterns), [(h, 1.0) for h in hits if h] + [([], float(max(1, patterns[0])))], labels.count(1) / (labels.count(0) + labels.count(1)))
