"""Language identification by hierarchical discrimination.

A text becomes a histogram of hashed byte trigrams (square-rooted, unit length). A linear
classifier first picks the language family; within the family one-versus-one linear
support vector machines (squared hinge loss) vote for the language, closest pairs last.

Model: trained here, on at most `max_per_lang` distinct labelled texts a language (those with
the smallest text hashes), `max_rows` in all, whole texts. Executors count the trigrams; the
driver gets the nonzero counts alone, packed, and holds one matrix of them (`max_rows` times
32 KB at most). Every language is learned. Scoring covers every whole text.

Defined results: null texts and texts without a letter (Unicode class L) get `und` with score
0, as does every text if there is no labelled row. With a single learned language all other
texts get it with score 1. Ids play no part in learning, so null and repeated ids of any type
are fine; repeated rows count once and get equal answers. Ties between languages go to the
alphabetically first one. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.llm.arrowtext import blocks, bounded, map_texts
from veilspan.llm.decontaminate import side
from veilspan.session import materialize, release

DIM = 8192
MAX_PER_LANG, MAX_ROWS = 500, 8000

#: Language families by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk ky tr tt uz".split(),
    "semitic": "am ar he mt".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
}


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang[:2].lower() in codes), lang)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each hashed trigram stands in the text."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    hashed = ((raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA6B)) ^ (raw[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    return np.bincount(hashed >> np.uint32(19), minlength=DIM)


def scaled(counted: np.ndarray) -> np.ndarray:
    roots = np.sqrt(counted.astype(np.float32))
    return roots / max(float(np.sqrt((roots * roots).sum())), 1e-9)


def histogram(text: str) -> np.ndarray:
    return scaled(counts(text))


def linear_svm(x1: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 120) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient descent; y is +1 or -1. Classes weigh the same.

    x1: rows of unit length, each with a constant 1 behind it.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x1.shape[1], np.float32)
    rate = 1 / (2 * 2.0 + penalty)  # rows have unit length and a constant: curvature is 4 at most
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v)) * y * weight
        new = v - rate * (penalty * v - 2 * (slack @ x1))
        v, w = new + (k / (k + 3)) * (new - w), new
    return w[:-1], float(w[-1])


@dataclass
class LanguageModel:
    """families: their names and languages; the machines as columns of one matrix."""

    families: list[tuple[str, list[str]]] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> LanguageModel:
        return cls.fit_histograms(map(histogram, texts), langs)

    @classmethod
    def fit_histograms(cls, histograms: Iterable[np.ndarray], langs: list[str]) -> LanguageModel:
        """histograms: read once, in the order of `langs`, straight into the matrix."""
        model, kinds = cls(), sorted(set(langs))
        groups: dict[str, list[str]] = {}
        for lang in kinds:
            groups.setdefault(family(lang), []).append(lang)
        model.families = sorted(groups.items())
        if len(kinds) < 2:
            return model
        x = np.ones((len(langs), DIM + 1), np.float32)
        for row, found in zip(x, histograms):
            row[:-1] = found
        lang = np.array(langs)
        fam = np.array([family(a) for a in langs])
        columns = [linear_svm(x, np.where(fam == name, 1, -1).astype(np.float32)) for name, _ in model.families if len(model.families) > 1]
        for _, inside in model.families:
            for a, b in combinations(inside, 2):
                of = (lang == a) | (lang == b)
                model.pairs.append((a, b))
                columns.append(linear_svm(x[of], np.where(lang[of] == a, 1, -1).astype(np.float32)))
        model.weights = np.stack([w for w, _ in columns], 1).astype(np.float32)
        model.bias = np.array([b for _, b in columns], np.float32)
        return model

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        n_fam = len(self.families) if len(self.families) > 1 else 0
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            margins = np.stack([histogram(t) for t in part]) @ self.weights + self.bias if self.weights.shape[1] else np.zeros((len(part), 0))
            for text, m in zip(part, margins.astype(float)):
                if not self.families or not has_letter(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                f, sure = 0, 1.0
                if n_fam:
                    f = int(np.argmax(m[:n_fam]))
                    sure = 1 / (1 + np.exp(-4 * (m[f] - np.partition(m[:n_fam], -2)[-2])))
                inside = self.families[f][1]
                votes, least = dict.fromkeys(inside, 0.0), dict.fromkeys(inside, 1.0)
                for k, (a, b) in enumerate(self.pairs):
                    if a in votes and b in votes:
                        p = 1 / (1 + np.exp(-4 * m[n_fam + k]))
                        votes[a if m[n_fam + k] >= 0 else b] += 1
                        least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
                best = min(inside, key=lambda a: (-votes[a], -least[a], a))
                langs.append(best)
                scores.append(float(min(1.0, max(0.0, sure * least[best]))))
        return langs, scores


def learn(documents: DataFrame, text: str = "text", lang: str = "lang", where: str = "true", max_per_lang: int = MAX_PER_LANG, max_rows: int = MAX_ROWS) -> LanguageModel:
    """Fit on rows with text and lang that satisfy `where`.

    Hashes of the texts are ranked first (a bounded top-k a language); they are broadcast
    (16 bytes each, `max_rows` or one a language at most), so only the chosen texts are counted.
    """
    rows = documents.where(f"({where}) AND `{lang}` IS NOT NULL AND `{text}` IS NOT NULL").select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    rows = rows.where(F.col("_text").rlike(r"\p{L}"))
    distinct = materialize(rows.groupBy("_lang", "_hash").agg(F.lit(1)).select("_lang", "_hash"), "hashes")
    sizes = materialize(distinct.groupBy("_lang").agg(F.count("*").alias("_n")), "langs")
    n_langs = sizes.count()
    if not n_langs:
        return LanguageModel()
    quota = max(1, min(max_per_lang, max_rows // n_langs))
    # Hashes are even over 64 bits: the least 4 * quota of a language, about, are enough to rank, so no language fills a task.
    least = F.col("_hash") <= F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(4.0 * quota + 100) / F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_hash"))
    chosen = distinct.join(side(sizes, n_langs), "_lang").where(least).select("_lang", "_hash", rank.alias("_rank")).where(F.col("_rank") <= quota)
    chosen = materialize(chosen.select("_lang", "_hash"), "chosen")
    release(distinct)
    release(sizes)

    def work():
        def step(columns, texts):
            found = [counts(t) for t in texts]
            at = [np.flatnonzero(c) for c in found]
            return {"lang": columns[0], "hash": columns[1], "at": [i.astype("<u2").tobytes() for i in at], "n": [c[i].astype("<u4").tobytes() for c, i in zip(found, at)]}

        return step

    counted = map_texts(rows.join(F.broadcast(chosen), ["_lang", "_hash"]), ["_lang", "_hash", "_text"], "_text", "lang string, hash long, at binary, n binary", work)
    found = sorted(map(tuple, counted.dropDuplicates(["lang", "hash"]).collect()), reverse=True)
    langs = [r[0] for r in reversed(found)]

    def histograms():
        while found:
            _, _, at, n = found.pop()
            out = np.zeros(DIM, np.int64)
            out[np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
            yield scaled(out)

    return LanguageModel.fit_histograms(histograms(), langs)


def identify(documents: DataFrame, model: LanguageModel, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, lang_pred and score of every row."""
    kind = dict(documents.dtypes)[id_column]

    def work():
        def step(columns, texts):
            langs, scores = model.predict(texts)
            return {id_column: columns[0], "lang_pred": langs, "score": scores}

        return step

    return map_texts(documents, [id_column, text], text, f"{id_column} {kind}, lang_pred string, score double", work)


def identify_rows(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of `documents` with _lang_pred and _lang_score beside them (no join, no shuffle)."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    schema = StructType([*documents.schema, *StructType.fromDDL("_lang_pred string, _lang_score double")])

    def run(batches):
        for part, texts in blocks(batches, text):
            langs, scores = model.predict(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "_lang_pred", "_lang_score"])

    return bounded(documents).mapInArrow(run, schema)
