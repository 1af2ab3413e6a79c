"""Word-piece token counts by linear longest match, without building the pieces.

The vocabulary is a trie with two roots, for pieces that begin a word and for pieces that go on. A node's failure link
says where matching goes on once the pieces that end before it are popped, and ``popped`` how many those are, both worked
out beforehand; so a word's greedy longest-match count takes one walk over its characters. A word that cannot be cut
into pieces counts as one unknown token.

Words are runs of letters, digits and underscores, and each other character that is not white space. Null and empty
texts have no words. Whole texts are counted, of any length; repeated rows and null ids are rows like any other.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from tagweave.llm.common import small_batches

WORD = re.compile(r"\w+|[^\w\s]")
#: Words whose counts a task remembers, and their greatest length.
REMEMBERED, SHORT = 300_000, 24
_WIDE = 1 << 21  # above all code points


class Automaton:
    def __init__(self, vocabulary: Iterable[str], going_on: str = "##"):
        self.start, self.rest = 0, 1
        self.step: dict[int, int] = {}
        ends, parents = [False, False], [(-1, 0), (-1, 0)]
        for piece in vocabulary:
            node, chars = (self.rest, piece[len(going_on):]) if piece.startswith(going_on) and piece != going_on \
                else (self.start, piece)
            if not chars:
                continue
            for c in chars:
                key = node * _WIDE + ord(c)
                if key not in self.step:
                    self.step[key] = len(ends)
                    parents.append((node, ord(c)))
                    ends.append(False)
                node = self.step[key]
            ends[node] = True
        children: dict[int, list[int]] = {}
        for node, (parent, _c) in enumerate(parents):
            if parent >= 0:
                children.setdefault(parent, []).append(node)
        #: Where to go on once no edge fits (-1: nowhere), and how many tokens are popped on the way.
        self.link, self.popped = [-1] * len(ends), [0] * len(ends)
        queue = deque([self.start, self.rest])
        while queue:
            above = queue.popleft()
            for node in children.get(above, ()):
                queue.append(node)
                if ends[node]:
                    self.link[node], self.popped[node] = self.rest, 1
                    continue
                at, popped = self.link[above], self.popped[above]
                c = parents[node][1]
                while at >= 0 and (to := self.step.get(at * _WIDE + c, -1)) < 0:
                    popped += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.popped[node] = to, popped

    def count(self, word: str) -> int:
        """Tokens of a word; 0 if it cannot be cut into pieces."""
        at, tokens = self.start, 0
        for c in map(ord, word):
            while (to := self.step.get(at * _WIDE + c, -1)) < 0:
                tokens += self.popped[at]
                at = self.link[at]
                if at < 0:
                    return 0
            at = to
        while at != self.rest:
            tokens += self.popped[at]
            at = self.link[at]
            if at < 0:
                return 0
        return tokens


class Counts(dict):
    """Token counts by word, remembered; unknown words are negative."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        found = self.automaton.count(word) or -1
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def pieces_of(model: str) -> list[str]:
    """A word-piece vocabulary from a sentencepiece model: marked pieces begin a word, others go on; single
    characters do both."""
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [p.id_to_piece(i) for i in range(p.get_piece_size())
             if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i))]
    begins = [n[1:] for n in names if n.startswith("▁") and "▁" not in n[1:] and len(n) > 1]
    on = [n for n in names if "▁" not in n]
    return list(dict.fromkeys([*begins, *(n for n in on if len(n) == 1), *("##" + n for n in on)]))


@lru_cache(maxsize=2)
def automaton(model: str) -> Automaton:
    return Automaton(pieces_of(model))


def counted(docs: DataFrame, model: str, carried: list[str]) -> DataFrame:
    """The carried columns, and n_words, n_tokens and n_unknown of every row."""
    names = ["n_words", "n_tokens", "n_unknown"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counts(automaton(model))
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                found = list(map(known.__getitem__, WORD.findall(text or "")))
                unknown = found.count(-1)
                rows.append((len(found), sum(found) + 2 * unknown, unknown))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *(
                pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], [*carried, *names])

    small_batches(docs.sparkSession)
    return docs.select(*carried, "text").mapInArrow(run, StructType(
        [*docs.select(*carried).schema.fields, *(StructField(n, LongType()) for n in names)]))
