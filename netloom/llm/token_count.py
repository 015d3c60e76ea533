"""Token counts by a linear longest-match automaton over a vocabulary trie.

The vocabulary is a byte vocabulary of a public tokenizer. A word (a blank followed by the word's bytes) is split by
greedy longest match. The automaton is a trie of all pieces; where a byte has no edge, the failure link leads to the node
of what is left after the greedy pieces so far were popped, and the link carries the number of pieces popped, so a word
of n bytes takes at most 2n steps and no piece is ever built.

Defined results: a null or empty text has no words and no tokens; words are runs of anything but blanks and tabs to
carriage returns; a word of any length is one walk; repeated rows and null ids are rows of their own; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of at most this many bytes are looked up before they are walked; at most so many are remembered by a worker.
MEMO_BYTES, MEMO_WORDS = 64, 250_000


class LongestMatch:
    """goto: node * 256 + byte -> node. fail, popped: for each node the failure link and the pieces popped on the way; -1 where there is none."""

    def __init__(self, pieces: list[bytes]):
        self.goto: dict[int, int] = {}
        ends, parent, via, depth = [0], [0], [0], [0]
        for p in pieces:
            node = 0
            for byte in p:
                to = self.goto.get(node * 256 + byte)
                if to is None:
                    to = self.goto[node * 256 + byte] = len(ends)
                    ends.append(0), parent.append(node), via.append(byte), depth.append(depth[node] + 1)
                node = to
            if node:
                ends[node] = 1
        missing = [b for b in range(256) if not ends[self.goto.get(b, 0)]]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 single bytes")
        n = len(ends)
        self.fail, self.popped = [-1] * n, [0] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            children[parent[i]].append(i)
        queue = deque(children[0])
        while queue:
            v = queue.popleft()
            queue.extend(children[v])
            if ends[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            u, c = parent[v], via[v]
            z, k = self.fail[u], self.popped[u]
            while (to := self.goto.get(z * 256 + c)) is None:
                z, k = self.fail[z], k + self.popped[z]
            self.fail[v], self.popped[v] = to, k
        del depth

    def count(self, word: bytes) -> int:
        goto, fail, popped = self.goto.get, self.fail, self.popped
        node = total = 0
        for byte in word:
            while (to := goto(node * 256 + byte)) is None:
                total += popped[node]
                node = fail[node]
            node = to
        while node:
            total += popped[node]
            node = fail[node]
        return total


class _Memo(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.count = automaton.count

    def __missing__(self, word: bytes) -> int:
        n = self.count(b" " + word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


_built: dict[str, _Memo] = {}


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens for every row. No shuffle. Each Python worker builds the automaton once, from the
    vocabulary file that is installed on every machine; its size is that of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _built:
            _built[vocabulary_path] = _Memo(LongestMatch(vocabulary(vocabulary_path)))
        memo = _built[vocabulary_path]
        try:
            for whole in batches:
                for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                    words = [t.split() for t in b.column(1).cast(pa.binary()).to_pylist()]
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, words), pa.int64()), pa.array([sum(map(memo.__getitem__, w)) for w in words], pa.int64())], names=["doc_id", "n_words", "n_tokens"])
        finally:
            _built.clear()  # a worker that is used again starts small

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
