"""Quality rules: gradient-boosted trees over document statistics, under two hard rules.

Statistics are computed over whole texts. The trees are fitted on the driver from the statistics of at most `most` labelled
documents (a documented bound; labels are taken in the order of a hash of their id), flattened into arrays and sent
to the executors, where batches are scored at once.

Defined results: a null text has no words and fails the base rule; labels without a document, documents without a
label and null labels take no part in the fit; with fewer than two classes the trees keep everything; repeated rows and null
ids are rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import boosting

#: Labelled documents used for the fit, at most.
MOST_LABELS = 8000
#: A document goes if its probability of being good is under this.
KEEP_AT = 0.5
BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
LINE_WORD = re.compile(rb"[^\x20\x09-\x0D]")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the trees and their constraints on the score of a good document.
FEATURES = (
    ("words", 0), ("mean_word", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", -1), ("bang_share", -1),
    ("digit_share", 0), ("stop_share", 0), ("comma_share", 0), ("distinct_share", 0), ("line_words", 0), ("pipe_share", -1), ("at_share", 0),
)


def _count(b: bytes, chars: bytes) -> int:
    return len(b) - len(b.translate(None, chars))


def repeated(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more, the first time included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    m = len(ids)
    if m < 2_000_000:
        key = (a[:-2] * m + a[1:-1]) * m + a[2:]
    else:  # three ids don't fit in 63 bits
        pair = np.unique(a[:-1] * m + a[1:], return_inverse=True)[1]
        key = pair[:-1] * m + a[2:]
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = times[which] > 1
    if not hit.any():
        return 0
    covered = np.zeros(n, bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def statistics(b: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base statistics and the trees' features of one whole text."""
    words = b.split()
    n = len(words)
    points = len(b) - _count(b, bytes(range(0x80, 0xC0)))
    chars = points - _count(b, BLANKS)
    symbols = _count(b, SYMBOLS)
    lines = [x for x in b.split(b"\n") if LINE_WORD.search(x)]
    dups = len(lines) - len(set(lines))
    again = repeated(words)
    w, c = max(n, 1), max(chars, 1)
    short = sum(1 for x in words if len(x) <= 3)
    features = (
        np.log1p(n), chars / w, symbols / c, dups / max(len(lines), 1), again / w, _count(b, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / c, _count(b, b"!") / w,
        _count(b, b"0123456789") / c, short / w, _count(b, b",.") / w, len(set(words)) / w, np.log1p(n / max(len(lines), 1)), _count(b, b"|") / w, _count(b, b"@") / w,
    )
    return (n, chars, symbols, dups, again), tuple(map(float, features))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = MOST_LABELS, id_col: str = "doc_id", text_col: str = "text") -> boosting.Forest:
    """Trees from at most `most` labels, chosen by a hash of the id; only their statistics reach the driver."""
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("label"), "doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t)[1] for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    # At most `most` ids: a bounded broadcast.
    found = _texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, x array<double>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.*")
    rows = sorted((r["doc_id"], r["y"], r["x"]) for r in found.toLocalIterator())
    y = np.array([r[1] for r in rows], float)
    x = np.array([r[2] for r in rows], float).reshape(len(rows), len(FEATURES))
    if len(set(y)) < 2:
        return boosting.fit(np.zeros((0, len(FEATURES))), np.zeros(0), [m for _, m in FEATURES], trees=0)
    return boosting.fit(x, y, [m for _, m in FEATURES])


def judged(docs: DataFrame, forest: boosting.Forest, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and good (the trees' probability) for every row. No shuffle."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, good double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = [statistics(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            good = forest.probability(np.array([r[1] for r in rows]).reshape(len(rows), len(FEATURES)))
            failed = [base_failed(r[0][0], r[0][4]) for r in rows]
            columns = [pa.array(c, pa.int64()) for c in zip(*(r[0] for r in rows), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(failed), pa.array([not f and p >= keep_at for f, p in zip(failed, good.tolist(), strict=True)]), pa.array(good)], names=["doc_id", *BASE, "base_failed", "kept", "good"])

    return _texts(docs, id_col, text_col).mapInArrow(run, schema)
