"""Scores from any classifier: what a model's classes mean, which model to load, scoring a column.

A scorer is anything with `predict_proba(texts) -> scores`. The lexicon's score is a column
expression and needs no Python; other scorers run in Arrow batches, once for each distinct
text, which a digest stands for, so texts are neither join nor shuffle keys.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.streaming.scoring import lexicon_score

#: Words in class names that mean harm, and that take it back.
HARM_NAMES = ("hate", "toxic", "offensive", "abusive", "harm")
CLEAN_NAMES = ("non", "not", "normal", "clean")
#: Classes of multi-label toxicity models, whose outputs are independent.
TOXICITY_CLASSES = frozenset("toxicity severe_toxicity obscene identity_attack insult threat sexual_explicit".split())

_HARM, _CLEAN, _NUMBER = re.compile("|".join(HARM_NAMES)), re.compile("|".join(CLEAN_NAMES)), re.compile(r"\s*-?\d+\s*")


class Scorer(Protocol):
    def predict_proba(self, texts: Sequence[str]) -> list[float]: ...


class Head(NamedTuple):
    """The output to read as the score, and whether outputs are independent (sigmoid) or compete (softmax)."""

    positive: int
    independent: bool

    def scores(self, logits):
        """Rows of logits to one score each."""
        import numpy as np

        z = np.asarray(logits, float)
        if self.independent:
            return 1 / (1 + np.exp(-z[:, self.positive]))
        z = np.exp(z - z.max(1, keepdims=True))
        return z[:, self.positive] / z.sum(1)


def head(id2label: Mapping | None, problem_type: str | None = None) -> Head:
    """The head that a model's configuration describes; entries whose key is no number don't count."""
    names = {int(k): str(v).lower() for k, v in (id2label or {}).items() if _NUMBER.fullmatch(str(k))}
    harmful = [i for i, name in names.items() if _HARM.search(name) and not _CLEAN.search(name)]
    binary = [max(names)] if len(names) == 2 else [1]
    return Head(min(harmful, default=binary[0]), problem_type == "multi_label_classification" or len(TOXICITY_CLASSES.intersection(names.values())) > 3)


@dataclass(frozen=True)
class Kind:
    """A way to get a scorer: the modules it needs, and what makes it from its arguments."""

    needs: tuple[str, ...]
    make: Callable[..., Scorer]


class TransformerScorer:
    """A sequence classifier from a folder of weights; its libraries are imported when it is made."""

    def __init__(self, folder: str, device: str = "cpu", max_length: int = 512):
        import torch
        from transformers import AutoModelForSequenceClassification, AutoTokenizer

        self.torch, self.device, self.max_length = torch, device, max_length
        self.tokenizer = AutoTokenizer.from_pretrained(folder, local_files_only=True)
        self.model = AutoModelForSequenceClassification.from_pretrained(folder, local_files_only=True).to(device).eval()
        self.head = head(self.model.config.id2label, self.model.config.problem_type)

    def predict_proba(self, texts: Sequence[str]) -> list[float]:
        with self.torch.no_grad():
            batch = self.tokenizer(list(texts), truncation=True, max_length=self.max_length, padding=True, return_tensors="pt").to(self.device)
            return self.head.scores(self.model(**batch).logits.cpu().numpy()).tolist()


KINDS = {"transformer": Kind(("torch", "transformers"), TransformerScorer)}


def missing(needs: Iterable[str]) -> list[str]:
    out = []
    for module in needs:
        try:
            importlib.import_module(module)
        except ImportError:
            out.append(module)
    return out


class Built(NamedTuple):
    """make: gives a scorer on a worker, None for the lexicon's column; name and why: what was built, and for want of what."""

    make: Callable[[], Scorer] | None
    name: str
    why: str


def choose(kind: str, *arguments, kinds: Mapping[str, Kind] = KINDS) -> Built:
    """The scorer of that kind; the lexicon where the modules it needs are not installed."""
    if kind == "lexicon":
        return Built(None, "lexicon", "")
    if kind not in kinds:
        raise ValueError(f"unknown classifier {kind!r}: one of lexicon, {', '.join(sorted(kinds))}")
    lacking = missing(kinds[kind].needs)
    return Built(None, "lexicon", f"{kind} needs {', '.join(lacking)}") if lacking else Built(lambda: kinds[kind].make(*arguments), kind, "")


def score_with(df: DataFrame, make: Callable[[], Scorer] | None = None, text: str = "text", batch: int = 64) -> DataFrame:
    """`df` with a score column; null texts count as empty. make: as `choose` gives it."""
    own = F.coalesce(F.col(text), F.lit(""))
    if make is None:
        return df.withColumn("score", lexicon_score(own))
    import pandas as pd

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make()
        for series in parts:
            texts = series.tolist()
            yield pd.Series([s for i in range(0, len(texts), batch) for s in scorer.predict_proba(texts[i : i + batch])], dtype="float64")

    # Annotations are names here; the iterator kind has to be given as types.
    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    marked = df.withColumn("_digest", F.sha2(own, 256))
    first = marked.groupBy("_digest").agg(F.min(own).alias("_text"))
    return marked.join(first.select("_digest", F.pandas_udf(run, "double")("_text").alias("score")), "_digest").drop("_digest")
