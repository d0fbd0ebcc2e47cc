"""Order-preserving packing into fixed windows by dynamic programming.

The documents of a task's input are laid end to end, in order. Windows of at most
`capacity` tokens are cut at document or sentence ends so that the sum of padding and of
truncation penalties is least. With g(i) = f(i) + i the recurrence is

    f(j) = penalty(j) + min( min over i in [j - capacity, j) of g(i) + capacity - j,
                             min over powers of two p of f(j - p) )

(a window whose length is a power of two is not padded); the inner minimum over the sliding
range comes from a monotone queue, so the work is linear in the number of cut candidates.
Where no candidate lies within a window's reach, cuts inside the sentence are added.

Memory: a task plans `horizon` tokens at a time, hands on all windows but the last and goes
on from there. The last windows of a task are cut to powers of two, so they are not padded.

Order: the documents of a split keep their order, and so do their pieces. Nothing is dealt out
anew, so neighbours part only where the input's own splits do.

Defined results: a null or empty text is packed as its end token alone. Every row is packed,
repeated rows too (as rows of their own, with equal doc_id), rows without an id as well.
Sequence ids are unique over the table; they depend on how the input is split into tasks,
which a rerun repeats. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
from pyspark.sql import DataFrame

from veilspan.llm.arrowtext import blocks, bounded
from veilspan.llm.wordpiece import byte_alphabet

CAPACITY = 4096
HORIZON = 64 * CAPACITY
#: Cost of a cut at a sentence end and inside a sentence, in tokens of padding.
SENTENCE_PENALTY, INNER_PENALTY = 4.0, 48.0
#: Distinct words a worker remembers, twice over; characters of a text that are taken at a time.
MEMORY, STRETCH = 80_000, 1 << 20
SPACE = re.compile(r"[\t-\r ]")
#: Bytes of text that are taken at a time; ids and their places take some ten times as much.
BLOCK = 2 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Token ids of whole texts, as the tokenizer file gives them, with words remembered.

    The file's own steps are NFC, white space, lower case, a split into words that never
    crosses white space or depends on what lies beyond it, and BPE inside each word. So the ids
    of a run between white space are always the same: a block of texts is split into runs, each
    distinct run is encoded once, and the ids are gathered by array operations. Only texts of
    the characters below are taken apart like that; any other text goes through the tokenizer
    whole. A text longer than STRETCH characters is taken in stretches that end at white space.
    """

    #: Characters for which lower-casing, NFC and white space are the same for Python and the file.
    PLAIN = (
        r"[\x00-\x1B\x20-\x7F\xA1-\xA3\xA5-\xB4\xB6-\u012F\u0132-\u017E\u0400-\u0481\u048A-\u052F\u05D0-\u05EA\u0621-\u063A\u0641-\u064A"
        r"\u2010-\u2027\u2030-\u205E\u20AC\u3001-\u3011\u3041-\u3096\u30A1-\u30FA\u30FC\u4E00-\u9FA5\uAC00-\uD7A3\U0001F300-\U0001F5FF\U0001F600-\U0001F64F]*+"
    )

    def __init__(self, path: str, end_id: int):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Only the steps are read as JSON: the whole file would leave its vocabulary in memory twice.
        before, steps = (json.loads(step.__getstate__()) if step else {} for step in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        steps = steps.get("pretokenizers", [])
        known = [n["type"] for n in before.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"]).findall if known else None
        self.model = self.tokenizer.model
        self.letters = dict(byte_alphabet())
        self.plain = regex.compile(self.PLAIN).fullmatch
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.end = np.array([end_id], "<u4").tobytes()
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.marks = {m: self.word(m) for m in ".,;:!?"}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def sentence_ends(self) -> np.ndarray:
        """By token id, whether a sentence can end there; the last entry stands for all ids beyond."""
        marks = [np.frombuffer(self.whole(mark), "<u4")[-1] for mark in (".", "!", "?", "…", "...", "。", "!!", "?!")]
        ends = np.zeros(max(marks) + 2, bool)
        ends[marks] = True
        return ends

    def word(self, word: str) -> bytes:
        """Ids of one word of the file's own split, remembered."""
        known = self.before.get(word)
        if known is None:
            # Printable ASCII stands for itself in the byte alphabet, control characters don't.
            ids = [t.id for t in self.model.tokenize(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters))]
            known = pack_ids(f"<{len(ids)}I", *ids)
        if len(self.seen) >= MEMORY:  # the last generation stays at hand, the one before goes
            self.before, self.seen = self.seen, {}
        self.seen[word] = known
        return known

    def run(self, run: str) -> bytes:
        """Ids of a run between white space; its words are remembered."""
        # Letters alone are one word; so are the letters before a last mark, and the mark.
        if run.isalpha():
            return self.word(run)
        if run and run[-1] in self.marks and (rest := run[:-1]).isalpha():
            return (self.seen.get(rest) or self.word(rest)) + self.marks[run[-1]]
        return b"".join([self.seen.get(w) or self.word(w) for w in self.split(run)])

    def gathered(self, lowered: list[str]) -> list[bytes]:
        """Ids of plain, lower-cased texts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        runs = pc.ascii_split_whitespace(pa.array(lowered, pa.string()))
        coded = runs.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(lowered)
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" ")
        found = [self.seen.get(w) or self.run(w) for w in distinct]
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False)
        count = size[which]
        ends = np.cumsum(count)
        at = np.repeat(start[which] - (ends - count), count)
        at += np.arange(len(at))
        marks = np.r_[0, ends][runs.offsets.to_numpy()]
        raw = ids[at].tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(marks, marks[1:])]

    def many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then the end id."""
        out: list[bytes | None] = [None] * len(texts)
        plain, where = [], []
        for i, text in enumerate(texts):
            if self.split is None or not self.plain(text) or any(s in text for s in self.special):
                out[i] = self.whole(text) + self.end
            elif len(text) > STRETCH:
                out[i] = b"".join(self.gathered([part.lower()])[0] for part in stretches(text)) + self.end
            else:
                plain.append(text.lower())
                where.append(i)
        for i, ids in zip(where, self.gathered(plain) if plain else []):
            out[i] = ids + self.end
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


def stretches(text: str, most: int = STRETCH) -> Iterator[str]:
    """The text in parts of about `most` characters, cut where ASCII white space stands."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, min(len(text), at + most))
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


#: Encoders of this Python worker, kept from task to task.
_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def plan(cuts: list[int], costs: list[float], capacity: int = CAPACITY, least_power: int = 1) -> list[int]:
    """Ends of the windows over [0, cuts[-1]). cuts: candidates in ascending order, the last one is the end.

    The distance between neighbouring candidates is `capacity` at most. least_power: the
    shortest window that is left unpadded on purpose.
    """
    powers = [p for k in range(capacity.bit_length() - 1, -1, -1) if (p := 1 << k) >= least_power]
    where = [0, *cuts]
    f, back = [0.0], [0]
    queue: deque[int] = deque([0])
    index = {0: 0}
    for n, (j, cost) in enumerate(zip(cuts, costs), 1):
        while where[queue[0]] < j - capacity:
            queue.popleft()
        i = queue[0]
        best, source = f[i] + where[i] + capacity - j, i
        for p in powers:
            k = index.get(j - p)
            if k is not None and f[k] < best:
                best, source = f[k], k
        f.append(best + cost)
        back.append(source)
        index[j] = n
        g = f[n] + j
        while queue and f[queue[-1]] + where[queue[-1]] >= g:
            queue.pop()
        queue.append(n)
    ends, n = [], len(cuts)
    while n:
        ends.append(where[n])
        n = back[n]
    return ends[::-1]


class Packer:
    """Collects documents and emits the pieces of finished windows.

    sentence_ends: by token id, whether a sentence can end there.
    """

    def __init__(self, task: int, sentence_ends: np.ndarray, capacity: int = CAPACITY, horizon: int = HORIZON):
        self.next_sequence = task << 40
        self.sentence_ends, self.capacity, self.horizon = sentence_ends, capacity, horizon
        self.docs: deque[list] = deque()  # [doc_id, ids as bytes, tokens, tokens already packed]
        self.size = 0

    def add(self, doc_id, ids: bytes) -> list[tuple]:
        self.docs.append([doc_id, ids, len(ids) // 4, 0])
        self.size += len(ids) // 4
        return self.flush(False) if self.size >= self.horizon else []

    def flush(self, last: bool) -> list[tuple]:
        out: list[tuple] = []
        while self.size >= (1 if last else self.horizon):
            out += self._round(last)
        return out

    def _round(self, last: bool) -> list[tuple]:
        marks, costs, at, limit = [], [], 0, self.horizon
        for _, ids, tokens, done in self.docs:
            part = np.frombuffer(ids, "<u4", min(tokens - done, limit - at), 4 * done)
            inner = np.flatnonzero(self.sentence_ends.take(part, mode="clip")) + at + 1
            end = at + len(part)
            inner = inner[inner < end]
            marks.append(inner)
            costs.append(np.full(len(inner), SENTENCE_PENALTY))
            marks.append(np.array([end]))
            costs.append(np.array([0.0 if done + len(part) == tokens else INNER_PENALTY]))
            at = end
            if at >= limit:
                break
        cuts, cost = np.concatenate(marks), np.concatenate(costs)
        # Long stretches without a sentence end get cuts of their own.
        gaps = np.flatnonzero(np.diff(np.r_[0, cuts]) > self.capacity // 4)
        if len(gaps):
            starts = np.r_[0, cuts]
            more = np.concatenate([np.arange(starts[g] + self.capacity // 16, cuts[g], self.capacity // 16) for g in gaps])
            order = np.argsort(all_cuts := np.r_[cuts, more], kind="stable")
            cuts, cost = all_cuts[order], np.r_[cost, np.full(len(more), INNER_PENALTY)][order]
        total, final = int(cuts[-1]), last and at == self.size
        if final:  # what is left over after whole windows can end on powers of two
            tail = sorted({total - t for t in _tails(total, self.capacity)} - set(cuts.tolist()) - {0})
            order = np.argsort(all_cuts := np.r_[cuts, np.array(tail, np.int64)], kind="stable")
            cuts, cost = all_cuts[order], np.r_[cost, np.full(len(tail), INNER_PENALTY)][order]
        ends = plan(cuts.tolist(), cost.tolist(), self.capacity, 1 if final else self.capacity // 16)
        if not final and len(ends) > 1:
            ends = ends[: max(1, bisect_left(ends, total - 2 * self.capacity))]
        return self._emit(ends)

    def _emit(self, ends: list[int]) -> list[tuple]:
        out, at = [], 0
        for end in ends:
            offset = 0
            while at < end:
                doc = self.docs[0]
                take = min(end - at, doc[2] - doc[3])
                part = doc[1][4 * doc[3] : 4 * (doc[3] + take)]
                out.append((doc[0], doc[3], take, zlib.crc32(part), doc[2], self.next_sequence, offset))
                doc[3] += take
                at, offset = at + take, offset + take
                if doc[3] == doc[2]:
                    self.docs.popleft()
            self.next_sequence += 1
        self.size -= at
        return out


def _tails(total: int, capacity: int) -> list[int]:
    """Token counts from the end at which the last windows' power-of-two lengths stand."""
    rest, out = total % capacity, [0]
    for k in range(capacity.bit_length()):
        if rest >> k & 1:
            out.append(out[-1] + (1 << k))
    return out[1:]


def pack(documents: DataFrame, tokenizer: str, end_id: int = 2, text: str = "text", id_column: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizer file that every executor can read. Each task packs the rows
    of its own input split; nothing is shuffled.
    """
    from pyspark.sql.types import StructType

    id_type = dict(documents.dtypes)[id_column]
    schema = StructType.fromDDL(SCHEMA.replace("doc_id long", f"{id_column} {id_type}", 1))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        encode = encoder(tokenizer, end_id)
        packer = Packer(TaskContext.get().partitionId(), encode.sentence_ends(), capacity)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for part, texts in blocks(batches, text, BLOCK):
            rows = [row for i, ids in zip(part.column(0).to_pylist(), encode.many(texts)) for row in packer.add(i, ids)]
            if rows:
                yield batch(rows)
        if rows := packer.flush(True):
            yield batch(rows)

    return bounded(documents).select(id_column, text).mapInArrow(run, schema)
