"""Reduced releases of texts, row by row: tokens, cues, importance, anchors, context, masks, metrics.

A block of rows is laid out as one virtual text: every row gets a base position, so far from the
next row's that no span, window or gap reaches across. Tokens, cues and spans of the whole
block are then flat sorted arrays, and each rule is an array operation (overlaps and nearest
cues by binary search, merged spans by a running maximum). Only finding tokens and identifiers,
and putting texts together, goes text by text. Nothing is shuffled: a relation is one walk
over the rows, whatever their number, and holds one block at a time.

`Settings` are the parameters: cue lexicon, scorer, number of anchors, radius, gaps.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from veilspan.functions import lexicon as L
from veilspan.operators import identify

VARIANTS = ("raw", "pii_mask", "pii_quasi_mask", "importance_only", "importance_window", "context")
WHOLE_TEXT = VARIANTS[:3]
NOTHING = "[NO_TASK_EVIDENCE_RETAINED]"
CUES = ("TARGET_CUE", "HARM_CUE", "NEGATION_CUE", "QUOTE_CUE", "COUNTERSPEECH_CUE")
STANCE = ("NEGATION_CUE", "QUOTE_CUE", "COUNTERSPEECH_CUE")
BLOCK_ROWS, BLOCK_CHARS = 512, 2 << 20
PAD = 4096

_TOKEN = re.compile(L.TOKEN)
#: The alternatives that can match in a word without any of the marks the others need.
_MARK = re.compile(r"[@#\[]|://|www\.")
_PLAIN = re.compile("|".join(L.TOKEN_ALTERNATIVES[6:]))
_ALNUM = re.compile(r"[^\W_]")
#: What is white space to patterns and to str.split; none lies beyond the last of these.
_BLANK = np.array([chr(c).isspace() for c in range(0x3002)])
#: What tidies a rendered text once its white space is single spaces, in order: marks, brackets, quotes.
_TIDY = (*((" " + c, c) for c in ",.;:!?%"), ("( ", "("), (" )", ")"))
_QUOTES = (("`` ", '"'), (" ''", '"'), (" ' ", "'"))


@dataclass(frozen=True)
class Settings:
    """scorer: scores of a list of texts, 0 to 1; None is the lexicon's score."""

    lexicon: L.Lexicon = L.SYNTHETIC
    top_k: int = 5
    min_delta: float = 0.02
    share: float = 0.30
    radius: int = 2
    gap: int = 8
    merge_gap: int = 12
    threshold: float = 0.5
    scorer: Callable[[list[str]], list[float]] | None = field(default=None, compare=False)


def tidy(text: str) -> str:
    out = " ".join(text.split())
    for old, new in (*_TIDY, *_QUOTES):
        out = out.replace(old, new)
    return out.strip()


def merged(s: np.ndarray, e: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where one starts at most `gap` after the others' end."""
    if not len(s):
        return s, e
    order = np.lexsort((e, s))
    s, e = s[order], e[order]
    reach = np.maximum.accumulate(e)
    heads = np.flatnonzero(np.r_[True, s[1:] > reach[:-1] + gap])
    return s[heads], np.maximum.reduceat(e, heads)


def touched(s: np.ndarray, e: np.ndarray, xs: np.ndarray, xe: np.ndarray) -> np.ndarray:
    """Which spans (s, e) overlap any of the disjoint sorted spans (xs, xe)."""
    at = np.searchsorted(xe, s, "right")
    inside = at < len(xs)
    out = np.zeros(len(s), bool)
    out[inside] = xs[at[inside]] < e[inside]
    return out


def pairs_within(a: np.ndarray, b: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all a[i], b[j] at most `gap` apart; b is sorted."""
    lo, hi = np.searchsorted(b, a - gap, "left"), np.searchsorted(b, a + gap, "right")
    i = np.repeat(np.arange(len(a)), hi - lo)
    j = np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    return i, j


class Block:
    """The rows of a block and all that follows from them, each part made when asked for."""

    def __init__(self, rows: dict[str, list], settings: Settings):
        self.rows, self.set = rows, settings
        self.texts: list[str] = [t or "" for t in rows["text"]]
        self.n = len(self.texts)
        length = np.array([len(t) for t in self.texts], np.int64)
        self.length = length
        self.base = np.cumsum(length + PAD) - length

    # ------------------------------------------------------------ tokens and cues

    @cached_property
    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(row, start, end, kind) of each token, and the texts of the kinds (some are of no token).

        No token reaches across white space, so each distinct word of the block is cut into tokens once.
        """
        whole = "\n".join(self.texts)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = _BLANK[np.minimum(code, len(_BLANK) - 1)]
        at = np.flatnonzero(~blank & np.r_[True, blank[:-1]][: len(blank)])
        words = whole.split()
        distinct = list(dict.fromkeys(words))
        kinds = dict(zip(distinct, range(len(distinct))))
        word = np.fromiter(map(kinds.__getitem__, words), np.int64, len(words))
        # A word of Latin letters is one token.
        plain = np.fromiter(map(str.isalpha, distinct), bool, len(distinct)) & np.fromiter(map(str.isascii, distinct), bool, len(distinct))
        count, cut = np.ones(len(distinct), np.int64), []
        for i in np.flatnonzero(~plain).tolist():
            w, before = distinct[i], len(cut)
            cut += [(*m.span(), kinds.setdefault(m.group(), len(kinds))) for m in (_TOKEN if _MARK.search(w) else _PLAIN).finditer(w)]
            count[i] = len(cut) - before
        first = np.cumsum(count) - count
        parts = np.zeros((count.sum(), 3), np.int64)  # start, end, kind of the distinct words' tokens
        whole_word = np.zeros(len(parts), bool)
        whole_word[first[plain]] = True
        parts[whole_word, 1] = np.fromiter(map(len, distinct), np.int64, len(distinct))[plain]
        parts[whole_word, 2] = np.flatnonzero(plain)
        parts[~whole_word] = np.array(cut, np.int64).reshape(-1, 3)
        n = count[word]
        s, e, kind = parts[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[word], n)].T
        own = np.cumsum(self.length + 1) - (self.length + 1)  # where the rows' texts start
        row = np.searchsorted(own, at, "right") - 1
        at = np.repeat(at + (self.base - own)[row], n)
        return np.repeat(row, n), at + s, at + e, kind, list(kinds)

    row = property(lambda self: self.found[0])
    s = property(lambda self: self.found[1])
    e = property(lambda self: self.found[2])
    kind = property(lambda self: self.found[3])
    kinds = property(lambda self: self.found[4])

    @cached_property
    def tok(self) -> list[str]:
        return list(map(self.kinds.__getitem__, self.kind.tolist()))

    @cached_property
    def low_kinds(self) -> list[str]:
        return list(map(str.lower, self.kinds))

    @cached_property
    def low(self) -> list[str]:
        return list(map(self.low_kinds.__getitem__, self.kind.tolist()))

    @cached_property
    def count(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n)

    @cached_property
    def first(self) -> np.ndarray:
        return np.cumsum(self.count) - self.count

    @cached_property
    def idx(self) -> np.ndarray:
        return np.arange(len(self.row)) - self.first[self.row]

    @cached_property
    def place(self) -> np.ndarray:
        """Positions of tokens by number, rows far apart."""
        return np.arange(len(self.row)) + self.row * PAD

    @cached_property
    def cue(self) -> np.ndarray:
        """0, or the number of the token's cue in CUES from 1."""
        number = {term: CUES.index(label) + 1 for label, term in self.set.lexicon.labelled()}
        out = np.array([number.get(w, 0) for w in self.low_kinds], np.int64)[self.kind]
        groups = self.rows.get("target_groups") or []
        terms = {g: group_terms(g) for g in set(groups)}
        wanted = set().union(*terms.values())
        kinds: dict[str, list[int]] = {}
        for k, w in enumerate(self.low_kinds) if wanted else ():
            if w in wanted:
                kinds.setdefault(w, []).append(k)
        named = {g: [k for w in ws for k in kinds.get(w, ())] for g, ws in terms.items()}
        for r, g in enumerate(groups):
            if named[g]:
                part = slice(self.first[r], self.first[r] + self.count[r])
                out[part][np.isin(self.kind[part], named[g])] = 1
        return out

    def tokens_of(self, *labels: str) -> np.ndarray:
        return np.flatnonzero(np.isin(self.cue, [CUES.index(c) + 1 for c in labels]))

    # ------------------------------------------------------------ identifiers

    @cached_property
    def spans(self) -> list[list[dict]]:
        gold = self.rows.get("gold") or [None] * self.n
        return [identify.resolve([*({**g, "source": "synthetic", "score": 1.0, "replacement": None} for g in known or []), *identify.candidates(text)]) for text, known in zip(self.texts, gold)]

    # ------------------------------------------------------------ importance and anchors

    @cached_property
    def eligible(self) -> np.ndarray:
        """Numbers of the tokens that may be anchors."""
        stop = set(L.STOPWORDS)
        fit = np.array([(t.isalnum() or bool(_ALNUM.search(t))) and not (t[0] == "[" and t[-1] == "]") and w not in stop for t, w in zip(self.kinds, self.low_kinds)], bool)[self.kind]
        xs = np.array([b + x["start"] for b, spans in zip(self.base.tolist(), self.spans) for x in spans], np.int64)
        xe = np.array([b + x["end"] for b, spans in zip(self.base.tolist(), self.spans) for x in spans], np.int64)
        return np.flatnonzero(fit & ~touched(self.s, self.e, xs, xe))

    def lexicon_hits(self, texts: list[str]) -> np.ndarray:
        cues = self.set.lexicon.classifier
        return np.array([sum(c in low for c in cues) for low in map(str.lower, texts)], np.int64)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.set.scorer:
            return np.array(self.set.scorer(texts), float)
        return lexicon_score(self.lexicon_hits(texts))

    @cached_property
    def importance(self) -> tuple[np.ndarray, np.ndarray]:
        """(baseline, perturbed) score of each eligible token."""
        at = self.eligible
        if self.set.scorer:
            baseline = self.scores(self.texts)
            r, s, e = self.row[at], (self.s - self.base[self.row])[at], (self.e - self.base[self.row])[at]
            masked = [self.texts[i][:a] + "[MASKED]" + self.texts[i][b:] for i, a, b in zip(r.tolist(), s.tolist(), e.tolist())]
            return baseline[r], self.scores(masked) if masked else np.zeros(0)
        # A token that touches the first and the last place of a cue touches all between: the text loses the cue.
        hits, lost = self.lexicon_hits(self.texts), np.zeros(len(self.row), np.int64)
        for r in np.flatnonzero(hits):
            low, part = self.texts[r].lower(), slice(self.first[r], self.first[r] + self.count[r])
            s, e = self.s[part] - self.base[r], self.e[part] - self.base[r]
            for c in self.set.lexicon.classifier:
                a, b = low.find(c), low.rfind(c)
                if a >= 0:
                    lost[part] += (s < a + len(c)) & (a < e) & (s < b + len(c)) & (b < e)
        return lexicon_score(hits)[self.row[at]], lexicon_score(hits[self.row[at]] - lost[at])

    @cached_property
    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(token numbers, deltas) of the chosen anchors."""
        at, (baseline, perturbed) = self.eligible, self.importance
        delta, row = baseline - perturbed, self.row[self.eligible]
        order = np.lexsort((at, -delta, row))
        at, delta, row = at[order], delta[order], row[order]
        start = np.searchsorted(row, np.arange(self.n))
        rank = np.arange(len(row)) - start[row]
        most = np.minimum(self.set.top_k, np.maximum(1, np.floor(self.set.share * self.count).astype(np.int64)))
        passing = np.bincount(row, delta >= self.set.min_delta, self.n)
        take = (rank < most[row]) & ((passing[row] == 0) | (delta >= self.set.min_delta))
        return at[take], delta[take]

    @cached_property
    def fallback(self) -> np.ndarray:
        """Cue tokens that stand in for anchors in rows without any: harm first, then targets."""
        at = self.tokens_of("HARM_CUE", "TARGET_CUE")
        at = at[~np.isin(self.row[at], self.row[self.anchors[0]])]
        at = at[np.lexsort((at, self.cue[at] == 1, self.row[at]))]
        start = np.searchsorted(self.row[at], np.arange(self.n))
        return at[np.arange(len(at)) - start[self.row[at]] < self.set.top_k]

    @cached_property
    def chosen(self) -> np.ndarray:
        return np.sort(np.r_[self.anchors[0], self.fallback])

    # ------------------------------------------------------------ windows and context

    def framed(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the token `radius` before to the one `radius` after, inside the row."""
        lo, n = self.first[self.row[at]], self.count[self.row[at]]
        return self.s[np.maximum(lo, at - self.set.radius)], self.e[np.minimum(lo + n - 1, at + self.set.radius)]

    def ranged(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.minimum(self.s[i], self.s[j]), np.maximum(self.e[i], self.e[j])

    @cached_property
    def anchor_or_harm(self) -> np.ndarray:
        return np.union1d(self.chosen, self.tokens_of("HARM_CUE")).astype(np.int64)

    @cached_property
    def h1(self):
        own = self.chosen[np.isin(self.cue[self.chosen], (1, 2))]
        s, e = self.framed(self.chosen)
        return np.r_[s, self.s[own]], np.r_[e, self.e[own]]

    @cached_property
    def h2(self):
        t, x = self.tokens_of("TARGET_CUE"), self.anchor_or_harm
        i, j = pairs_within(self.place[t], self.place[x], self.set.gap)
        return self.ranged(t[i], x[j])

    @cached_property
    def h3(self):
        t, x = self.tokens_of(*STANCE), self.anchor_or_harm
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        after = np.searchsorted(self.place[x], self.place[t], "left")
        left, right = np.maximum(after - 1, 0), np.minimum(after, len(x) - 1)
        d_left, d_right = (np.abs(self.place[t] - self.place[x[k]]) for k in (left, right))
        near = np.where(d_left <= d_right, left, right)  # of two as near, the one before
        keep = np.minimum(d_left, d_right) <= self.set.gap
        return self.ranged(t[keep], x[near[keep]])

    @cached_property
    def h4(self):
        a, b = self.tokens_of(*STANCE), self.tokens_of("TARGET_CUE")
        i, j = pairs_within(self.place[a], self.place[b], self.set.gap)
        return self.ranged(a[i], b[j])

    @cached_property
    def kept(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Kept spans of each variant, merged and sorted."""
        some = self.length > 0
        whole = self.base[some], (self.base + self.length)[some]
        parts = [self.h1, self.h2, self.h3, self.h4]
        context = merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), self.set.merge_gap)
        return dict.fromkeys(WHOLE_TEXT, whole) | {"importance_only": merged(self.s[self.chosen], self.e[self.chosen], 0), "importance_window": merged(*self.framed(self.chosen), 1), "context": context}

    def row_of(self, s: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, s, "right") - 1

    # ------------------------------------------------------------ rendering

    def release(self, variant: str) -> list[str]:
        """The released texts of one variant."""
        if variant == "raw":
            return self.texts
        labels = set(L.DIRECT) if variant == "pii_mask" else {*L.DIRECT, *L.QUASI}
        s, e = self.kept[variant]
        rows, texts = self.row_of(s), []
        lo, hi = np.searchsorted(rows, np.arange(self.n), "left"), np.searchsorted(rows, np.arange(self.n), "right")
        for r, text in enumerate(self.texts):
            masks = [x for x in self.spans[r] if x["label"] in labels]
            base = int(self.base[r])
            pieces = [overlaid(text, a - base, b - base, masks) for a, b in zip(s[lo[r] : hi[r]].tolist(), e[lo[r] : hi[r]].tolist())]
            texts.append(tidy(" ... ".join(pieces)) if pieces else "" if variant in WHOLE_TEXT else NOTHING)
        return texts

    @cached_property
    def released(self) -> dict[str, list[str]]:
        return {v: self.release(v) for v in VARIANTS}

    @cached_property
    def released_tokens(self) -> dict[str, list[list[str]]]:
        own = [self.tok[a : a + n] for a, n in zip(self.first.tolist(), self.count.tolist())]
        return {v: own if v == "raw" else [_TOKEN.findall(t) for t in texts] for v, texts in self.released.items()}

    def by_variant(self, values: dict[str, list]) -> tuple[list, list, list]:
        """(rows, variants, values) of all variants."""
        return list(range(self.n)) * len(VARIANTS), [v for v in VARIANTS for _ in range(self.n)], [x for v in VARIANTS for x in values[v]]


def group_terms(groups: str | None) -> set[str]:
    """Terms that a row's target groups (joined by `|`) add to the target cues: their names, and the longer words of these."""
    out: set[str] = set()
    for name in (groups or "").split("|"):
        plain = re.sub(r"[_/-]+", " ", name.lower()).strip()
        if plain not in ("", "none", "other", "nan"):
            out |= {plain, *(w for w in plain.split() if len(w) > 2)}
    return out


def lexicon_score(hits: np.ndarray) -> np.ndarray:
    return np.minimum(1.0, L.BASE_SCORE + hits * L.CUE_SCORE)


def overlaid(text: str, start: int, end: int, masks: list[dict]) -> str:
    """The stretch of the text with the parts of masks that lie in it replaced."""
    out, at = [], start
    for x in masks:  # disjoint and sorted
        if x["start"] < end and start < x["end"]:
            out += [text[at : max(at, x["start"])], x["replacement"] or f"[{x['label']}]"]
            at = min(end, x["end"])
    return "".join([*out, text[at:end]]).strip()


def grams(tokens: list[str], n: int) -> set[tuple]:
    return set(zip(*(tokens[i:] for i in range(n))))


# ---------------------------------------------------------------- relations: a schema and the rows of a block

RELATIONS: dict[str, tuple[str, Callable[[Block], tuple]]] = {}


def relation(name: str, schema: str):
    """Register what a block yields: row numbers (become row_id), then the schema's columns."""

    def add(function):
        RELATIONS[name] = (schema, function)
        return function

    return add


def _spans(b: Block, s: np.ndarray, e: np.ndarray, *more) -> tuple:
    r = b.row_of(s)
    return (r, s - b.base[r], e - b.base[r], *more)


def _distinct(b: Block, s: np.ndarray, e: np.ndarray) -> tuple:
    both = np.unique(np.stack([s, e], 1), axis=0) if len(s) else np.zeros((0, 2), np.int64)
    return _spans(b, both[:, 0], both[:, 1])


def _tokens(b: Block, at: np.ndarray) -> tuple:
    r = b.row[at]
    return r, b.idx[at], [b.tok[i] for i in at], b.s[at] - b.base[r], b.e[at] - b.base[r]


relation("tokens", "idx int, tok string, s int, e int, low string")(lambda b: (*_tokens(b, np.arange(len(b.row))), b.low))
relation("eligible", "idx int, tok string, s int, e int")(lambda b: _tokens(b, b.eligible))
relation("anchors", "idx int, tok string, s int, e int, delta double")(lambda b: (*_tokens(b, b.anchors[0]), b.anchors[1]))
relation("cue_fallback", "idx int, tok string, s int, e int")(lambda b: _tokens(b, b.fallback))
relation("chosen", "idx int, tok string, s int, e int")(lambda b: _tokens(b, b.chosen))
relation("h1", "s int, e int")(lambda b: _distinct(b, *b.h1))
relation("h2", "s int, e int")(lambda b: _distinct(b, *b.h2))
relation("h3", "s int, e int")(lambda b: _distinct(b, *b.h3))
relation("h4", "s int, e int")(lambda b: _distinct(b, *b.h4))
relation("only_kept", "s int, e int")(lambda b: _spans(b, *b.kept["importance_only"]))
relation("window_kept", "s int, e int")(lambda b: _spans(b, *b.kept["importance_window"]))
relation("context_kept", "s int, e int")(lambda b: _spans(b, *b.kept["context"]))


@relation("cues", "idx int, tok string, s int, e int, low string, cue string")
def _(b):
    at = np.flatnonzero(b.cue)
    return (*_tokens(b, at), [b.low[i] for i in at], [CUES[b.cue[i] - 1] for i in at])


@relation("importance", "idx int, tok string, s int, e int, baseline double, perturbed double, delta double")
def _(b):
    baseline, perturbed = b.importance
    return (*_tokens(b, b.eligible), baseline, perturbed, baseline - perturbed)


@relation("anchor_windows", "idx int, s int, e int")
def _(b):
    s, e = b.framed(b.chosen)
    r = b.row[b.chosen]
    return r, b.idx[b.chosen], s - b.base[r], e - b.base[r]


@relation("kept_tokens", "idx int")
def _(b):
    at = np.flatnonzero(touched(b.s, b.e, *b.kept["importance_only"]))
    return b.row[at], b.idx[at]


@relation("identifiers", "s int, e int, label string, score double")
def _(b):
    flat = [(r, x["start"], x["end"], x["label"], x["score"]) for r, spans in enumerate(b.spans) for x in spans]
    return tuple(zip(*flat)) if flat else ([],) * 5


@relation("kept", "variant string, s int, e int")
def _(b):
    parts = [(v, *_spans(b, *b.kept[v])) for v in VARIANTS]
    return np.concatenate([p[1] for p in parts]), [v for v, r, *_ in parts for _ in r], np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])


@relation("releases", "variant string, binary_label int, split string, functionality string, source_text string, released_text string")
def _(b):
    r, v, texts = b.by_variant(b.released)
    own = [[b.rows[c][i] for i in r] if c in b.rows else [None] * len(r) for c in ("binary_label", "split", "functionality")]
    return r, v, *own, [b.texts[i] for i in r], texts


for _variant in VARIANTS:
    relation(f"release_{_variant}", "released_text string")(lambda b, v=_variant: (range(b.n), b.release(v)))


@relation("rendered", "variant string, n_chars int, n_spans int")
def _(b):
    spans = {v: np.bincount(b.row_of(b.kept[v][0]), minlength=b.n).tolist() for v in VARIANTS}
    r, v, texts = b.by_variant(b.released)
    return r, v, list(map(len, texts)), b.by_variant(spans)[2]


@relation("facts", "variant string, binary_label int, split string, functionality string, n_chars int, kept_chars long, n_tokens int, kept_tokens long, out_tokens int, raw_pred int, pred int, changed boolean, placeholder boolean")
def _(b):
    chars, tokens, pred = {}, {}, {}
    for v in VARIANTS:
        s, e = b.kept[v]
        chars[v] = np.bincount(b.row_of(s), e - s, b.n).astype(np.int64)
        tokens[v] = np.bincount(b.row, touched(b.s, b.e, s, e), b.n).astype(np.int64)
        pred[v] = (b.scores(b.released[v]) >= b.set.threshold).astype(int)
    r, v, texts = b.by_variant(b.released)
    flat = lambda x: b.by_variant(x)[2]
    own = [[b.rows[c][i] for i in r] if c in b.rows else [None] * len(r) for c in ("binary_label", "split", "functionality")]
    out = flat({v: [len(t) for t in ts] for v, ts in b.released_tokens.items()})
    return r, v, *own, b.length[r], flat(chars), b.count[r], flat(tokens), out, pred["raw"][r], flat(pred), [t != b.texts[i] for i, t in zip(r, texts)], [t == NOTHING for t in texts]


@relation("gram_counts", "variant string, n3_source int, n3_common int, n5_source int, n5_common int")
def _(b):
    def words(tokens):
        return [[t.lower() for t in row if _ALNUM.search(t)] for row in tokens]

    own = words(b.released_tokens["raw"])
    sets = {n: [grams(w, n) for w in own] for n in (3, 5)}
    counts = {v: [[len(x) for n in (3, 5) for x in (sets[n][r], sets[n][r] & grams(w, n))] for r, w in enumerate(words(b.released_tokens[v]))] for v in VARIANTS}
    r, v, found = b.by_variant(counts)
    return r, v, *zip(*found)


@relation("cue_preserved", "variant string, cue string, preserved boolean")
def _(b):
    at = np.flatnonzero(b.cue)
    terms: dict[tuple[int, str], set[str]] = {}
    for i in at:
        terms.setdefault((int(b.row[i]), CUES[b.cue[i] - 1]), set()).add(b.low[i])
    out = []
    for v in VARIANTS:
        low = [t.lower() for t in b.released[v]]
        out += [(r, v, cue, any(w in low[r] for w in words)) for (r, cue), words in terms.items()]
    return tuple(zip(*out)) if out else ([],) * 4


@relation("rationale", "idx int, variant string, hit boolean")
def _(b):
    at = np.flatnonzero(b.cue)
    hits = [touched(b.s[at], b.e[at], *b.kept[v]) for v in VARIANTS]
    return np.tile(b.row[at], len(VARIANTS)), np.tile(b.idx[at], len(VARIANTS)), [v for v in VARIANTS for _ in at], np.concatenate(hits)


@relation("residuals", "variant string, label string, s int, residual boolean")
def _(b):
    gold = b.rows.get("gold") or [None] * b.n
    out = [(r, v, g["label"], g["start"], b.texts[r][g["start"] : g["end"]] in b.released[v][r]) for v in VARIANTS for r, known in enumerate(gold) for g in known or []]
    return tuple(zip(*out)) if out else ([],) * 5


@relation("detected", "variant string, label string, n int")
def _(b):
    out = []
    for v in VARIANTS:
        for r, text in enumerate(b.released[v]):
            labels = [x["label"] for x in identify.resolve(identify.candidates(text))]
            out += [(r, v, label, labels.count(label)) for label in sorted(set(labels))]
    return tuple(zip(*out)) if out else ([],) * 4


def _judged(b: Block):
    """A deterministic stand-in for a language model judge: it reads the cues of the released text."""
    lex = b.set.lexicon
    harm, negation, quote, counter, target = map(set, (lex.harm, lex.negation, [*lex.quote, *L.QUOTE_SIGNS], lex.counterspeech, lex.target))
    out = {}
    for v in VARIANTS:
        out[v] = []
        for text in b.released[v]:
            words = set(_TOKEN.findall(text.lower()))
            stance = next((name for name, cues in (("NEGATE", negation), ("QUOTE", quote), ("OPPOSE", counter)) if words & cues), "ASSERT")
            known = text != NOTHING
            out[v].append((("YES" if words & harm else "NO") if known else "UNCLEAR", stance if known else "UNCLEAR", " ".join(sorted(words & target))))
    return out


@relation("judged", "variant string, binary_label int, hate string, stance string, target string")
def _(b):
    r, v, found = b.by_variant(_judged(b))
    return r, v, [b.rows["binary_label"][i] for i in r], *zip(*found)


@relation("paired", "variant string, binary_label int, hate string, stance string, target string, raw_hate string, raw_stance string, raw_target string")
def _(b):
    judged = _judged(b)
    r, v, found = b.by_variant(judged)
    return r, v, [b.rows["binary_label"][i] for i in r], *zip(*found), *zip(*(judged["raw"][i] for i in r))


@relation("bundles", "binary_label int, only_text string, window_text string, context_text string, n_only int, n_window int, n_context int, n_groups int, quasi_residual boolean")
def _(b):
    reduced = VARIANTS[3:]
    released = {v: b.release(v) for v in ("pii_mask", *reduced)}
    counts = [[sum(bool(_ALNUM.search(t)) for t in _TOKEN.findall(text)) for text in released[v]] for v in reduced]
    groups = [sum(map(bool, (g or "").split("|"))) for g in b.rows.get("target_groups") or [""] * b.n]
    gold = b.rows.get("gold") or [None] * b.n
    quasi = [any(g["label"] not in L.DIRECT and b.texts[r][g["start"] : g["end"]] in released["pii_mask"][r] for g in known or []) for r, known in enumerate(gold)]
    return range(b.n), b.rows["binary_label"], *(released[v] for v in reduced), *counts, groups, quasi


def _blocks(batches: Iterator, columns: list[str]) -> Iterator[dict[str, list]]:
    for batch in batches:
        data = {c: batch.column(i).to_pylist() for i, c in enumerate(columns)}
        at = size = 0
        for i, text in enumerate(data["text"]):
            size += len(text or "")
            if i + 1 - at >= BLOCK_ROWS or size >= BLOCK_CHARS:
                yield {c: v[at : i + 1] for c, v in data.items()}
                at, size = i + 1, 0
        if at < batch.num_rows:
            yield {c: v[at:] for c, v in data.items()}


def derive(rows: DataFrame, name: str, settings: Settings | None = None, id_column: str = "row_id") -> DataFrame:
    """The relation `name` (a key of RELATIONS) of any rows with an id and a text.

    Used if there: binary_label, split, functionality, target_groups (names joined by `|`), gold
    (array of known identifier spans: start, end, label). A null text counts as empty.
    """
    schema, make = RELATIONS[name]
    settings = settings or Settings()
    columns = [id_column, "text", *(c for c in ("binary_label", "split", "functionality", "target_groups", "gold") if c in rows.columns)]
    parsed = StructType.fromDDL(f"{id_column} {dict(rows.dtypes)[id_column]}, {schema}")

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(parsed)
        for data in _blocks(batches, columns):
            block = Block({"binary_label": [None] * len(data["text"]), **data}, settings)
            at, *values = make(block)
            ids = data[id_column]
            out = [[ids[i] for i in at], *values]
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(v if isinstance(v, (list, tuple)) else np.asarray(v), f.type) for v, f in zip(out, arrow)], schema=arrow)

    return rows.select(*columns).mapInArrow(run, parsed)
