"""Patterns, word lists and identifiers that results depend on."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

#: One token is the first of these alternatives that matches.
TOKEN_ALTERNATIVES = (
    r"https?://[^\s]+",
    r"www\.[^\s]+",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"\[[A-Z][A-Z0-9_:-]*\]",
    r"@[A-Za-z0-9_]{2,32}",
    r"#\w+",
    r"[A-Za-z]+(?:['-][A-Za-z]+)*",
    r"\d+(?:[.,:/-]\d+)*",
    r"\S",
)
TOKEN = "|".join(TOKEN_ALTERNATIVES)

#: Words that cannot be anchors.
STOPWORDS = "a an and are as at be by for from in is it of on or that the this to with".split()

#: Cues of the lexicon classifier, its base score and the weight of a cue.
CLASSIFIER_CUES = ["ban", "banned", "deport", "leave", "vermin", "hate", "kill", "kicked out", "inferior", "terrorist", "should leave", "should be banned"]
BASE_SCORE, CUE_SCORE = 0.05, 0.28

#: Identifier classes.
DIRECT = ["PERSON", "HANDLE", "EMAIL", "PHONE", "URL", "IP"]
QUASI = ["DATE", "AGE", "LOCATION", "SCHOOL", "WORKPLACE", "ORG", "EVENT", "FAMILY_RELATION", "SOURCE_MARKER", "STYLE_MARKER"]

#: Identifier patterns in detector order (label, pattern, ignore case, score).
DETECTORS = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", False, 1.0),
    ("URL", r"\b(?:https?://|www\.)[^\s<>()]+", False, 1.0),
    ("HANDLE", r"(?<!\w)@[A-Za-z0-9_]{2,32}\b", False, 1.0),
    ("PHONE", r"\b(?:\+?\d[\d().\-\s]{6,}\d|555-\d{4})\b", False, 1.0),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", False, 1.0),
    ("DATE", r"\b(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+\d{1,2}|(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\s+at\s+\d{1,2}(?::\d{2})?\s*(?:am|pm)?)\b", True, 1.2),
    ("AGE", r"\b(?:age\s*)?\d{1,2}\s*(?:years old|year-old|yo|y/o)\b", True, 1.0),
    ("FAMILY_RELATION", r"\b(?:cousin|older brother|aunt|uncle|mother|father|sister|brother)\b", True, 1.0),
    ("SOURCE_MARKER", r"\b(?:posted|wrote|shared by|contact)\b", True, 1.0),
)

#: Made-up identifiers that are injected, and detected as phrases.
PEOPLE = ["Alex Mercer", "Jordan Vale", "Mira Stone", "Samir Vale"]
HANDLES = ["@river_user", "@north_test", "@sample_mira", "@civic_case"]
EMAILS = ["mira.example@test.invalid", "alex.mercer@example.invalid"]
PHONES = ["555-0104", "555-0188"]
LOCATIONS = ["Northbridge", "Riverton", "Westford"]
SCHOOLS = ["Riverton High", "Northbridge College"]
WORKPLACES = ["CivicWorks Lab", "Westford Library"]
DATES = ["2026-04-17", "May 3", "Friday at 8pm"]
FAMILY_RELATIONS = ["cousin", "older brother", "aunt"]
EVENTS = ["Riverton forum", "Northbridge meetup"]
PHRASES = (
    ("PERSON", PEOPLE), ("HANDLE", HANDLES), ("EMAIL", EMAILS), ("PHONE", PHONES), ("LOCATION", LOCATIONS), ("SCHOOL", SCHOOLS),
    ("WORKPLACE", WORKPLACES), ("DATE", DATES), ("FAMILY_RELATION", FAMILY_RELATIONS), ("EVENT", EVENTS),
)
TEMPLATES = ["handle_prefix", "person_school_prefix", "email_suffix", "date_city_prefix", "family_prefix", "workplace_suffix"]

#: Target groups and the terms that name them, in output order.
TARGET_TERMS = {
    "asian": ["asian", "asians"],
    "black": ["black", "black people"],
    "christian": ["christian", "christians"],
    "disabled": ["disabled", "disability", "mental illness", "psychiatric"],
    "gay": ["gay", "lesbian", "homosexual", "lgbt", "queer"],
    "immigrant": ["immigrant", "immigrants", "refugee", "refugees"],
    "jewish": ["jew", "jews", "jewish"],
    "muslim": ["muslim", "muslims", "islam"],
    "trans": ["trans", "transgender"],
    "white": ["white", "white people"],
    "women": ["woman", "women", "female", "females"],
}

#: Quotation signs that count as quote cues.
QUOTE_SIGNS = ['"', "'", "“", "”", "‘", "’"]


@dataclass(frozen=True)
class Lexicon:
    """Cue words by class, in order of precedence, and the classifier's cues."""

    target: list[str]
    harm: list[str]
    negation: list[str]
    quote: list[str]
    counterspeech: list[str]
    classifier: list[str]

    def labelled(self) -> list[tuple[str, str]]:
        """(label, term), each term once, under the class that comes first."""
        seen, out = set(), []
        for label, terms in (("TARGET_CUE", self.target), ("HARM_CUE", self.harm), ("NEGATION_CUE", self.negation), ("QUOTE_CUE", [*self.quote, *QUOTE_SIGNS]), ("COUNTERSPEECH_CUE", self.counterspeech)):
            for term in terms:
                if term not in seen:
                    seen.add(term)
                    out.append((label, term))
        return out


def conformance() -> Lexicon:
    """The published cue lists."""
    data = json.loads((Path(__file__).parent / "cue_lexicon.json").read_text())
    return Lexicon(*(data[k] for k in ("target", "harm", "negation", "quote", "counterspeech")), CLASSIFIER_CUES)


#: The invented prose of the test tables hardly has any of those words; common words of its
#: vocabulary stand in for them, so that every rule has something to work on.
SYNTHETIC = Lexicon(
    target=["that", "les", "das", "los"],
    harm=["idiot", "stupid", "trash", "loser", "moron", "scum", "clown", "this", "dans"],
    negation=["not", "never", "no", "do", "from"],
    quote=["said", "wrote", "by", "par", "von"],
    counterspeech=["wrong", "support", "was", "qui"],
    classifier=["idiot", "stupid", "trash", "loser", "moron", "scum", "clown", "pathetic", "worthless", "disgusting", "hate", "ban"],
)
