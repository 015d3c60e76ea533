"""Best-fit packing by a linear grouping scheme.

Documents are tokenized and cut into pieces of at most `capacity`. The plan is made from the histogram of piece lengths
alone (at most `capacity` rows, whatever the corpus):

1. Linear grouping: the large pieces, longest first, fall into groups of equal cardinality; each counts as long as its
   group's longest.
2. Few-size configurations: with so few sizes, the fullest configuration that holds the largest size left is found by a
   bounded subset sum, and used as often as the counts allow.
3. Substitution: actual pieces take the places of their groups, which leaves the rounding as room.
4. Best fit: small pieces, longest first, go where least room is left.

A piece's place follows from its length and its rank among pieces of that length. Ranks are distributed prefix sums, so no
length, however common, meets in one task.

Defined results: a null text is empty; an empty document is its end token alone; repeated rows and null ids are documents of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import tidy, written

CAPACITY = 4096
END_ID = 1
#: Pieces of more than capacity / SMALL tokens are grouped; the others fill up.
SMALL = 8
GROUPS = 192
#: Memory for the ids of words that a worker remembers, and texts that are looked up together.
MEMO_BYTES, TOGETHER = 70_000_000, 250
#: After letters, a run of these is one part of a word.
SYMBOLS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Words that are given to the tokenizer as one text.
JOINED = 200


class WordIds:
    """Ids (little-endian, 32 bits each) of the tokens of words, by the tokenizer.

    Its pre-tokenizer never joins across blanks and parts letters from punctuation, and the last token of a run of letters
    is marked as a word's end. So each distinct word is tokenized once, runs of letters many at a time, and a text's ids
    are those of its words. Where the count of ends isn't that of the words, they are tokenized one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.held = 0

    def _one(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[bytes]) -> None:
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        encoded = self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded, strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) == len(group) and stops[-1] == 4 * len(ids):
                raw, at = ids.tobytes(), 0
                for w, stop in zip(group, stops.tolist(), strict=True):
                    self.memo[w] = raw[at:stop]
                    at = stop
            else:
                self.memo.update((w, self._one(w)) for w in group)

    def learn(self, words: set[bytes]) -> None:
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held = 0
        memo = self.memo
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        for w in words.difference(memo):
            core = w.rstrip(SYMBOLS)
            if core.isalpha():
                parts[w] = core.lower(), w[len(core) :]
            elif core and not core.isascii() and core.decode().isalpha():
                parts[w] = core, w[len(core) :]
            else:
                memo[w] = self._one(w)
            self.held += 200 + 5 * len(w)
        self._letters(list({core for core, _ in parts.values()}.difference(memo)))
        for w, (core, tail) in parts.items():
            if tail:
                if tail not in memo:
                    memo[tail] = self._one(tail)
                memo[w] = memo[core] + memo[tail]
            elif w is not core:
                memo[w] = memo[core]

    def documents(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, with the end token."""
        end = END_ID.to_bytes(4, "little")
        for i in range(0, len(texts), TOGETHER):
            split = [t.split() for t in texts[i : i + TOGETHER]]
            self.learn(set().union(*split))
            find = self.memo.__getitem__
            for words in split:
                yield b"".join(map(find, words)) + end


_memos: dict[str, WordIds] = {}


def document_ids(texts: list[bytes], tokenizer_path: str) -> Iterator[bytes]:
    if tokenizer_path not in _memos:
        _memos[tokenizer_path] = WordIds(tokenizer_path)
    return _memos[tokenizer_path].documents(texts)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for). No shuffle; the tokenizer file is on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                rows = []
                for i, ids in zip(b.column(0).to_pylist(), document_ids(b.column(1).cast(pa.binary()).to_pylist(), tokenizer_path), strict=True):
                    for k in range(0, len(ids), 4 * capacity):
                        part = ids[k : k + 4 * capacity]
                        rows.append((i, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else [])))
                kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])
        finally:
            _memos.clear()  # a worker that is used again starts small

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


Place = tuple[int, int, int, int, int]


class Plan:
    """places: (length, first rank, count, first sequence, offset): the piece of that length and rank r stands at `offset`
    in sequence `first sequence + r - first rank`."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity, self.places, self.sequences = capacity, [], 0
        self.room: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        self.used = dict.fromkeys(histogram, 0)
        if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
            raise ValueError("lengths must be from 1 to the capacity")
        self._large({n: c for n, c in histogram.items() if n > capacity // SMALL and c > 0}, groups)
        self._small({n: c for n, c in histogram.items() if n <= capacity // SMALL and c > 0})

    def _add_room(self, room: int, first: int, count: int) -> None:
        if room <= 0:
            return
        if room not in self.room:
            self.room[room] = []
            insort(self.rooms, room)
        self.room[room].append((first, count))

    def _place(self, length: int, count: int, first: int, offset: int) -> None:
        self.places.append((length, self.used[length], count, first, offset))
        self.used[length] += count

    def _large(self, histogram: dict[int, int], groups: int) -> None:
        total = sum(histogram.values())
        if not total:
            return
        per = -(-total // groups)
        runs: list[list[list[int]]] = [[]]  # for each group its lengths, longest first, with counts
        size = 0
        for n in sorted(histogram, reverse=True):
            left = histogram[n]
            while left:
                if size == per:
                    runs.append([])
                    size = 0
                take = min(left, per - size)
                runs[-1].append([n, take])
                size, left = size + take, left - take
        sizes = [g[0][0] for g in runs]
        counts = [sum(c for _, c in g) for g in runs]
        first = 0
        while first < len(sizes):
            if not counts[first]:
                first += 1
                continue
            use = self._configuration(sizes, counts, first)
            times = min(counts[g] // k for g, k in use.items())
            for g, k in use.items():
                counts[g] -= k * times
            self._substitute([self._take(runs[g], times) for g, k in use.items() for _ in range(k)], times)

    def _configuration(self, sizes: list[int], counts: list[int], first: int) -> dict[int, int]:
        """The fullest set of sizes that holds sizes[first], as {group: how many}. Sums reached are the bits of an integer."""
        limit = self.capacity - sizes[first]
        mask = (1 << (limit + 1)) - 1
        reach = [1]
        layers = []
        for g in range(first, len(sizes)):
            for _ in range(min(counts[g] - (g == first), limit // sizes[g])):
                layers.append(g)
                reach.append((reach[-1] | (reach[-1] << sizes[g])) & mask)
        use = {first: 1}
        goal = reach[-1].bit_length() - 1
        for i in range(len(layers), 0, -1):
            if not reach[i - 1] >> goal & 1:
                goal -= sizes[layers[i - 1]]
                use[layers[i - 1]] = use.get(layers[i - 1], 0) + 1
        return use

    @staticmethod
    def _take(run: list[list[int]], count: int) -> list[tuple[int, int]]:
        out = []
        while count:
            n, c = run[0]
            k = min(c, count)
            out.append((n, k))
            count -= k
            if k == c:
                run.pop(0)
            else:
                run[0][1] -= k
        return out

    def _substitute(self, slots: list[list[tuple[int, int]]], times: int) -> None:
        """Sequences side by side: where no slot changes its length, a stretch of them is alike."""
        edges = {0, times}
        for s in slots:
            at = 0
            for _, c in s:
                at += c
                edges.add(at)
        cuts = sorted(edges)
        where = [iter(self._spread(s, cuts)) for s in slots]
        for a, b in zip(cuts, cuts[1:], strict=False):
            offset = 0
            for w in where:
                n = next(w)
                self._place(n, b - a, self.sequences + a, offset)
                offset += n
            self._add_room(self.capacity - offset, self.sequences + a, b - a)
        self.sequences += times

    @staticmethod
    def _spread(slot: list[tuple[int, int]], cuts: list[int]) -> list[int]:
        out, i, end = [], 0, slot[0][1]
        for a in cuts[:-1]:
            while a >= end:
                i += 1
                end += slot[i][1]
            out.append(slot[i][0])
        return out

    def _small(self, histogram: dict[int, int]) -> None:
        for n in sorted(histogram, reverse=True):
            left = histogram[n]
            while left:
                i = bisect_left(self.rooms, n)
                if i == len(self.rooms):
                    new = -(-left // (self.capacity // n))
                    self._add_room(self.capacity, self.sequences, new)
                    self.sequences += new
                    continue
                room = self.rooms[i]
                first, count = self.room[room].pop()
                if not self.room[room]:
                    del self.room[room]
                    self.rooms.pop(i)
                k = min(count, left)
                self._place(n, k, first, self.capacity - room)
                self._add_room(room - n, first, k)
                if k < count:
                    self._add_room(room, first + k, count - k)
                left -= k

    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (length, first rank) with first sequences and offsets."""
        a = np.array(sorted(self.places), np.int64).reshape(len(self.places), 5)
        return (a[:, 0] << 44) + a[:, 1], a[:, 3] - a[:, 1], a[:, 4]


def ranked(cut: DataFrame) -> DataFrame:
    """cut with rank: 0, 1, ... among pieces of a length. Rows are numbered inside (length, bucket), buckets start where
    a prefix sum over their counts says. cut must be a written table, as its order is read twice."""
    n = 4 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int"))
    counts = x.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    return x.withColumn("n", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("n")).drop("bucket", "n", "first")


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. The histogram (at most `capacity` rows) is all that reaches the driver; the
    plan made from it is bounded by the capacity too and is sent to the executors."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys, sequences, offsets = Plan(histogram, capacity).lookup()
    sent = cut.sparkSession.sparkContext.broadcast((keys, sequences, offsets))
    names = cut.columns
    schema = ", ".join(f"{c} {k}" for c, k in cut.dtypes) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            i = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            columns = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences[i] + rank), pa.array(offsets[i])], names=[*names, "sequence_id", "offset"])

    return ranked(cut).select(*names, "rank").mapInArrow(tidy(run), schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenizes, cuts and packs. The pieces (without ids unless asked for) are written once to the shared folder, as they
    are read for the histogram and for the ranks."""
    return packed(written(pieces(docs, tokenizer_path, capacity, keep_ids=keep_ids), "pieces"), capacity)
