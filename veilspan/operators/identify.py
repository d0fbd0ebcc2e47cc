"""Identifier detection, overlap resolution, masking and synthetic injection, row by row.

Texts are handled whole inside `mapInArrow`: nothing is shuffled, and spans keep code-point
offsets as Python's `re` gives them.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from veilspan.functions import lexicon as L

SPAN = "struct<start:int,end:int,label:string,source:string,score:double,replacement:string>"

_PATTERNS = [(label, re.compile(p, re.I if loose else 0), score) for label, p, loose, score in L.DETECTORS]
_PHRASES = [(label, p.lower(), re.compile(r"(?<!\w)" + re.escape(p) + r"(?!\w)", re.I)) for label, ps in L.PHRASES for p in ps]


def span(start, end, label, source, score=1.0, replacement=None) -> dict:
    return {"start": start, "end": end, "label": label, "source": source, "score": score, "replacement": replacement}


_DIGIT = re.compile(r"\d")
#: What a text must hold for a detector to find anything: a quick test before the pattern runs.
_NEEDS = {"EMAIL": ("@",), "HANDLE": ("@",), "URL": ("://", "www."), "FAMILY_RELATION": ("cousin", "brother", "aunt", "uncle", "mother", "father", "sister"), "SOURCE_MARKER": ("posted", "wrote", "shared", "contact")}


def candidates(text: str) -> list[dict]:
    """All pattern and phrase hits, in detector order."""
    low, digits = text.casefold(), bool(_DIGIT.search(text))
    out = []
    for label, pattern, score in _PATTERNS:
        if any(part in low for part in _NEEDS[label]) if label in _NEEDS else digits:
            out += [span(m.start(), m.end(), label, "regex", score) for m in pattern.finditer(text)]
    for label, phrase, pattern in _PHRASES:
        if phrase in low:
            out += [span(m.start(), m.end(), label, "phrase") for m in pattern.finditer(text)]
    return out


def resolve(spans: list[dict]) -> list[dict]:
    """Greedy choice of disjoint spans: by start, then gold, score and length; detector order breaks ties.

    A later span takes the place of those it overlaps only if it outranks every one of them.
    """

    def rank(s):
        return (s["source"] in ("gold", "synthetic"), s["score"], s["end"] - s["start"])

    chosen: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"], *(-x for x in map(float, rank(s))))):
        rivals = [c for c in chosen if c["start"] < s["end"] and s["start"] < c["end"]]
        if all(rank(s) > rank(c) for c in rivals):
            chosen = [c for c in chosen if c not in rivals] + [s]
    return sorted(chosen, key=lambda s: (s["start"], s["end"]))


def mask(text: str, spans: list[dict], labels: set[str]) -> str:
    out = text
    for s in sorted((s for s in spans if s["label"] in labels), key=lambda s: -s["start"]):
        out = out[: s["start"]] + (s["replacement"] or f"[{s['label']}]") + out[s["end"] :]
    return out


def inject(text: str, seed: int, row_index: int) -> tuple[str, str, list[dict]]:
    """(template, text with made-up identifiers, their spans). The draws follow the seed and the row's place."""
    rng = random.Random(seed + row_index)
    template = rng.choice(L.TEMPLATES)
    parts: list[tuple[str, str | None]]
    if template == "handle_prefix":
        parts = [(rng.choice(L.HANDLES), "HANDLE"), (" said: ", None), (text, None)]
    elif template == "person_school_prefix":
        person, school = rng.choice(L.PEOPLE), rng.choice(L.SCHOOLS)
        parts = [(person, "PERSON"), (" from ", None), (school, "SCHOOL"), (" wrote: ", None), (text, None)]
    elif template == "date_city_prefix":
        date, person, city = rng.choice(L.DATES), rng.choice(L.PEOPLE), rng.choice(L.LOCATIONS)
        parts = [("On ", None), (date, "DATE"), (", ", None), (person, "PERSON"), (" in ", None), (city, "LOCATION"), (" posted: ", None), (text, None)]
    elif template == "family_prefix":
        relation, person, phone = rng.choice(L.FAMILY_RELATIONS), rng.choice(L.PEOPLE), rng.choice(L.PHONES)
        parts = [("My ", None), (relation, "FAMILY_RELATION"), (" ", None), (person, "PERSON"), (" (", None), (phone, "PHONE"), (") said ", None), (text, None)]
    elif template == "workplace_suffix":
        place, event = rng.choice(L.WORKPLACES), rng.choice(L.EVENTS)
        parts = [(text, None), (" - shared near ", None), (place, "WORKPLACE"), (" after the ", None), (event, "EVENT")]
    else:
        parts = [(text, None), (" Contact: ", None), (rng.choice(L.EMAILS), "EMAIL")]
    out, spans = "", []
    for value, label in parts:
        if label:
            spans.append(span(len(out), len(out) + len(value), label, "synthetic", 1.0, f"[{label}]"))
        out += value
    return template, out, spans


def _map(df: DataFrame, columns: list[str], schema: str, step) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = StructType.fromDDL(schema)
    arrow = to_arrow_schema(parsed)

    def run(batches):
        for batch in batches:
            rows = [step(*values) for values in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, parsed)


def detect(df: DataFrame, id_column: str = "row_id", text: str = "text") -> DataFrame:
    """(id, spans): resolved identifier spans of every row."""
    return _map(df, [id_column, text], f"{id_column} {dict(df.dtypes)[id_column]}, spans array<{SPAN}>", lambda i, t: (i, resolve(candidates(t or ""))))


def phrase_rows(df: DataFrame, id_column: str = "row_id", text: str = "text") -> DataFrame:
    """(id, found): label, phrase and start of every phrase hit of every row, overlaps included."""

    def step(i, t):
        return i, [{"label": label, "phrase": m.group().lower(), "s": m.start()} for label, _, pattern in _PHRASES for m in pattern.finditer(t or "")]

    return _map(df, [id_column, text], f"{id_column} {dict(df.dtypes)[id_column]}, found array<struct<label:string,phrase:string,s:int>>", step)


def mask_rows(df: DataFrame, quasi: bool = False, id_column: str = "row_id", text: str = "text") -> DataFrame:
    """(id, released_text): direct identifiers (and quasi ones if asked) replaced by their class."""
    labels = set(L.DIRECT + (L.QUASI if quasi else []))
    return _map(df, [id_column, text], f"{id_column} {dict(df.dtypes)[id_column]}, released_text string", lambda i, t: (i, mask(t or "", resolve(candidates(t or "")), labels)))


def inject_rows(df: DataFrame, seed: int = 17, id_column: str = "row_id", index: str = "row_index", text: str = "text") -> DataFrame:
    """(id, template, text, gold): every row with one template of made-up identifiers."""
    return _map(df, [id_column, index, text], f"{id_column} {dict(df.dtypes)[id_column]}, template string, text string, gold array<{SPAN}>", lambda i, n, t: (i, *inject(t or "", seed, n)))
