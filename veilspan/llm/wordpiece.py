"""Token counts by a linear longest-match automaton.

The automaton (trie of the vocabulary with failure links) reads a word once. Each node
knows how many tokens are complete when the walk has to leave it (popped tokens) and where
the rest of the text goes on, so greedy longest-match lengths come out in time linear in
the word, without building any piece.

The vocabulary is a BPE file's: its pieces are read as plain strings over its byte
alphabet, with the word-end mark as one last symbol. A mark that is left alone after the
longest matches belongs to the piece before it and adds no token. With every byte a piece
each word has a tokenization; a vocabulary where one is missing counts a word that cannot
be matched as one unknown token.

Defined results: null, empty and blank texts have 0 words and 0 tokens. Rows are counted
one by one; repeated rows get equal counts. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame

from veilspan.llm.arrowtext import map_texts

#: Distinct words a worker remembers before it starts afresh.
MEMORY = 400_000


def byte_alphabet() -> dict[int, str]:
    """The usual printable stand-in for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> tuple[list[str], str]:
    """(pieces, word-end mark) of a tokenizer file."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    return list(model["vocab"]), model.get("end_of_word_suffix") or ""


class Automaton:
    """Trie over symbols with failure links and popped-token counts.

    fail[v]: the node where matching goes on once v has no child for the next symbol;
    pops[v]: the tokens completed by going there; -1: no token can be completed.
    """

    END = -1

    def __init__(self, pieces: list[str], mark: str = ""):
        self.child: list[dict] = [{}]
        self.token = [False]
        self.mark = mark
        for piece in pieces:
            body, last = (piece[: -len(mark)], [self.END]) if mark and piece.endswith(mark) else (piece, [])
            symbols = [*map(ord, body), *last]
            at = 0
            for c in symbols:
                nxt = self.child[at].get(c)
                if nxt is None:
                    nxt = self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.token.append(False)
                at = nxt
            if symbols:
                self.token[at] = True
        alone = self.child[0].setdefault(self.END, len(self.child))
        if alone == len(self.child):
            self.child.append({})
            self.token.append(True)
        n = len(self.child)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c, v in self.child[u].items():
                if self.token[v]:
                    self.fail[v], self.pops[v] = 0, int(v != alone)
                else:
                    # The longest token inside u is popped first, then the rest with c is followed.
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.child[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.child[z][c], popped
                queue.append(v)

    def count(self, symbols) -> int:
        """Number of greedy longest-match tokens; 1 if there is no tokenization."""
        at = total = 0
        child, fail, pops = self.child, self.fail, self.pops
        for c in symbols:
            while c not in child[at]:
                nxt = fail[at]
                if nxt < 0 or at == 0:
                    return 1
                total += pops[at]
                at = nxt
            at = child[at][c]
        while at:
            if fail[at] < 0:
                return 1
            total += pops[at]
            at = fail[at]
        return total


class Counter:
    """Counts words of whole texts; remembers the words it has seen."""

    def __init__(self, path: str):
        pieces, mark = load_vocabulary(path)
        self.automaton = Automaton(pieces, mark)
        self.alphabet = {b: ord(c) for b, c in byte_alphabet().items()}
        self.seen: dict[bytes, int] = {}

    def word(self, raw: bytes) -> int:
        symbols = [self.alphabet[b] for b in raw]
        if self.automaton.mark:
            symbols.append(Automaton.END)
        return self.automaton.count(symbols)

    def text(self, text: str) -> tuple[int, int]:
        seen = self.seen
        tokens = text.lower().encode("utf-8", "surrogatepass").split()
        for raw in set(tokens).difference(seen):
            if len(seen) >= MEMORY:
                seen.clear()
                return len(tokens), sum(map(self.word, tokens))
            seen[raw] = self.word(raw)
        return len(tokens), sum(map(seen.__getitem__, tokens))


def token_counts(documents: DataFrame, vocabulary: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, n_words (runs without ASCII white space, lower-cased) and n_tokens of every whole text.

    vocabulary: path of a tokenizer file that every executor can read.
    """

    def work():
        counter = Counter(vocabulary)

        def step(columns, texts):
            found = [counter.text(t) for t in texts]
            return {id_column: columns[0], "n_words": [w for w, _ in found], "n_tokens": [n for _, n in found]}

        return step

    return map_texts(documents, [id_column, text], text, f"{id_column} {dict(documents.dtypes)[id_column]}, n_words long, n_tokens long", work)
