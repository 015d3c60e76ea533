"""N-gram Jaccard join in size-banded tiles with hashed bitmap signatures and exact intersections.

A document is the set of its distinct word shingles (64-bit hashes, sorted). Two sets link when their Jaccard similarity
reaches num / den. If they do, they differ in at most D = floor(m * (den - num) / num) elements, m the smaller size.

Tiles: sizes fall into bands; for a band, D of its largest size holds for all of it. Elements are dealt by hash into
D + 1 + slack segments, so linked sets agree in at least slack + 1 segments whole. A tile is (band, segment, its contents): any
two linked sets share slack + 1 of them. A set is dealt for its own band and for those lower bands in which a linked smaller set
can be. Tiles have one order for all sets: empty segments first, by their number, then by how many sets they hold, common ones first. Each
set leaves the first `slack` of its tiles; as linked sets share more than that, the last tile that they share is left by
neither, and no link is lost. Empty segments count among the left ones by the set itself, whether or not another set has a
key for them; of the others, tiles that a set has alone don't count, which leaves fewer. What only common passages have made alike is left, and so is every set that shares too few tiles.

Inside tiles no group is turned into all of its pairs. First each member of a tile meets only the tile's pivot, and what
links is merged into components. Where a tile still holds two components, its members are described by their differences
from the pivot. Two sets that link are unlike the pivot in the same elements: of |dx| and |dy| differences they share at
least t = (|dx| + |dy| - T) / 2, where T is the most that linked sets of their sizes differ in, and t is at least 1 for sets
of two components, as two sets closer to the pivot than that would both be linked with it. So a prefix of each list of
differences, rare ones first, is joined by pivot and element, and pairs whose first common element stands too late for t
to follow, or whose lists' own 256-bit signatures differ in more than T bits, are never made. Before that, a few rounds in which each set meets one other of its element merge most of what
links. Elements whose sets are one component leave after every round, so the join, which makes pairs of different components only,
ends exact and small.

A pair is first bounded: the bits in which two 1024-bit signatures differ are at most the elements in which the sets
differ, so the overlap is at most (|A| + |B| - bits) / 2. Only pairs that pass go on to the exact intersection of their sorted arrays.

Equal sets are one class, named by one of their rows. Tiles are counted for all rows, as keys are most of what is stored and
aren't moved to drop copies first; copies give way to their class when the tiles that one row has alone are gone.

All state is in Spark tables; only how many labels a step changed reaches the driver. A tile, pivot, element, class or
component may hold a large share of all rows: counts are summed before they move, and what is joined to them is written
first, so that both sides of the join are plain shuffles, which Spark splits where they are skewed.

Defined results: null and empty texts have no shingles, size 0, and link with nothing; texts of fewer words than a shingle
are one shingle; rows repeated or with equal sets are linked; a null id takes part and never names a component unless all its
ids are null (then the component_id is null); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import Scratch, text_of, tidy, written

#: Sizes of a band are within this ratio.
RATIO = 1.5
SIGNATURE_BITS = 1024
#: A segment more for so many elements in which linked sets may differ.
SLACK = 9
MEMO_WORDS = 120_000

#: Rounds in which each set meets one set for each of its differences, before the exact join of differences.
ROUNDS = 2

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[w] = h
        return h


_words = _Words()


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence where there are fewer words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    with np.errstate(over="ignore"):
        x = np.full(len(words) - width + 1, np.uint64(width) * _GOLD, np.uint64)
        for i in range(width):
            x = _mix(x + h[i : len(words) - width + 1 + i]) + _GOLD
        return np.unique(_mix(x))


def _bands() -> list[int]:
    """First sizes of the bands."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(-(-out[-1] * RATIO // 1))))
    return out


BANDS = _bands()


def band_plan(band: int, num: int, den: int) -> tuple[int, int]:
    """Segments and slack of a band; 0 segments where only equal sets can link."""
    differ = (BANDS[band + 1] - 1) * (den - num) // num
    if not differ:
        return 0, 0
    slack = 2 + differ // SLACK
    return differ + 1 + slack, slack


def tile_keys(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tiles that a set belongs to, and with each how many more tiles of its band the set leaves. A key has its
    band in its lowest 7 bits. The first empty segments, up to slack, are left and get no key."""
    n = len(s)
    own = bisect_right(BANDS, n) - 1
    least = -(-n * num // den)
    out, leave = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    with np.errstate(over="ignore"):
        contents = _mix(s + _GOLD)
        for band in range(own, -1, -1):
            if BANDS[band + 1] - 1 < least:
                break
            k, slack = band_plan(band, num, den)
            if not k:
                continue
            segment = ((s >> np.uint64(7)) % np.uint64(k)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(contents[order], dtype=np.uint64)])
            edges = np.searchsorted(segment[order], np.arange(k + 1))
            sums = total[edges[1:]] - total[edges[:-1]]
            full = edges[1:] > edges[:-1]
            keys = _mix(_mix(sums + np.uint64(band + 1) * _GOLD) + np.arange(k, dtype=np.uint64) * _A)
            keys = (keys & ~np.uint64(127)) | np.uint64(band)
            out.append(keys[full | (np.cumsum(~full) > slack)])
            leave.append(np.full(len(out[-1]), max(slack - k + int(full.sum()), 0), np.int32))
    return np.concatenate(out), np.concatenate(leave)


def signature(s: np.ndarray) -> bytes:
    bits = np.zeros(SIGNATURE_BITS, np.uint8)
    bits[(s >> np.uint64(64 - SIGNATURE_BITS.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def links(overlap: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, num: int, den: int) -> np.ndarray | bool:
    return den * overlap >= num * (a + b - overlap)


def _sets(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: id, two hashes that name its text, size, two hashes that name its set, signature, and its tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda rows: pa.array([np.uint64(x).astype(np.int64) for x in rows], pa.int64())
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            sizes, ones, twos, marks, keys, leave = [], [], [], [], [], []
            for text in b.column(3).cast(pa.binary()).to_pylist():
                s = shingles(text, n)
                sizes.append(len(s))
                with np.errstate(over="ignore"):
                    ones.append(_mix(s).sum(dtype=np.uint64))
                    twos.append(_mix(s ^ _B).sum(dtype=np.uint64))
                marks.append(signature(s))
                k, left = tile_keys(s, num, den) if len(s) else (s, np.zeros(0, np.int32))
                keys.append(k.view(np.int64))
                leave.append(left)
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(np.concatenate([*leave, np.zeros(0, np.int32)]))], names=["key", "first"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64()), signed(ones), signed(twos), pa.array(marks, pa.binary()), lists], names=["id", "k1", "k2", "n", "c1", "c2", "mark", "tiles"])
        _words.clear()  # a worker that is used again starts small

    x = _named(docs, id_col, text_col).select("id", "k1", "k2", "text")
    return x.mapInArrow(tidy(run), "id long, k1 long, k2 long, n long, c1 long, c2 long, mark binary, tiles array<struct<key: long, first: int>>")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("k1"), F.xxhash64(F.lit(7), text, F.col(id_col).cast("long")).alias("k2"), text.alias("text"))


class _Sets(dict):
    """Sets of the texts met last."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, text: bytes) -> np.ndarray:
        if len(self) >= 32:
            self.clear()
        s = self[text] = shingles(text, self.n)
        return s


def _with(pairs: DataFrame, sets: DataFrame, *names: str) -> DataFrame:
    """Pairs (a, b, and what else they have) with columns of both sets."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("cls").alias(side), *[F.col(n).alias(f"{n}_{side}") for n in names]), side)
    return pairs


def _bounded(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that can link by their sizes and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            bits = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, SIGNATURE_BITS // 64) for i in (4, 5)]
            differ = np.bitwise_count(bits[0] ^ bits[1]).sum(1).astype(np.int64)
            most = np.minimum((na + nb - differ) // 2, np.minimum(na, nb))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(links(most, na, nb, num, den)))

    x = _with(pairs, sets, "n", "mark").filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    return x.select("a", "b", "n_a", "n_b", "mark_a", "mark_b").mapInArrow(tidy(run), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The rows of pairs (a, b, two numbers) that link, by intersection of their sets. They stand by b, whose set is made once."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Sets(n)
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            ok: list[bool] = []
            for x, y in zip(b.column(4).cast(pa.binary()).to_pylist(), b.column(5).cast(pa.binary()).to_pylist(), strict=True):
                y, x = of[y], of[x]
                ok.append(bool(links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), num, den)))
            yield pa.RecordBatch.from_arrays(b.columns[:4], names=names).filter(pa.array(ok, pa.bool_()))

    return _with(pairs, sets, "text").select(*names, "text_a", "text_b").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))


def apart(n_sum: int, num: int, den: int) -> int:
    """The most elements in which linked sets differ whose sizes have this sum."""
    return (den - num) * n_sum // (den + num)


def differences(x: np.ndarray, pivot: np.ndarray, num: int, den: int, common: np.ndarray, rank: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many elements x and the pivot don't share, the first of them that any partner of x can need (by hash, and after
    them the pivot's common differences (sorted), by their rank), and a signature of all, of 4 x 64 bits."""
    found = np.setxor1d(x, pivot, assume_unique=True)
    size = len(found)
    most = apart(len(x) + len(x) * den // num, num, den)
    t = max(1, (size + max(0, size - most) - most + 1) // 2)
    bits = np.zeros(256, np.uint8)
    bits[(found >> np.uint64(40)).astype(np.int64) & 255] = 1
    mark = np.packbits(bits).view(np.int64)
    if len(common) and size:
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        order = np.where(common[at] == found, rank[at] + 1, 0)
        found = found[np.argsort(order, kind="stable")]
    return size, found[: max(0, size - t + 1)], mark


#: Sets of a pivot that are streamed together.
PART = 128
MARKS = ("m0", "m1", "m2", "m3")
#: A difference is common if so many sets of its pivot have it, and at least one in so many of them.
COMMON, COMMON_SHARE = 4, 512


def _common(pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """For pivots with many sets, the differences that many have, with their ranks by frequency: b, parts, common.
    Only sets not far from the pivot are counted; any order that all sets of a pivot share is a right one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Sets(n)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                found = []
                for x, y in zip(part.column(2).cast(pa.binary()).to_pylist(), part.column(3).cast(pa.binary()).to_pylist(), strict=True):
                    y, x = of[y], of[x]
                    d = np.setxor1d(x, y, assume_unique=True)
                    found.append(d if len(d) <= 4 * apart(len(x) + len(y), num, den) else d[:0])
                times = [len(d) for d in found]
                yield pa.RecordBatch.from_arrays([*[pa.array(np.repeat(part.column(k).to_numpy(), times)) for k in (0, 1)], pa.array(np.concatenate(found).view(np.int64))], names=["b", "sets", "element"])

    rows = pairs.filter(F.col("sets") >= 2 * COMMON).select("b", "sets", "text_a", "text_b").mapInArrow(tidy(run), "b long, sets long, element long")
    counts = rows.groupBy("b", "element").agg(F.count(F.lit(1)).alias("c"), F.max("sets").alias("sets"))
    counts = counts.filter((F.col("c") >= COMMON) & (F.col("c") * COMMON_SHARE >= F.col("sets")))
    return counts.groupBy("b").agg(_parts(F.max("sets")).alias("parts"), F.sort_array(F.collect_list(F.struct("c", "element"))).alias("common"))


def _parts(sets: Column) -> Column:
    return F.ceil(sets / PART).cast("int")


def _differing(pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """pivot, cls, comp, n, size, place, element, marks: the prefixes of the differences of each set (a) from its pivot (b).

    A pivot's sets are dealt into parts of bounded size, sorted behind one row with the pivot's common differences, and
    streamed, so these are held once for each part and not with every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Sets(n)
        now, common, rank = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows, prefixes, marks = [], [], []
                comps = part.column(5).to_pylist()
                for k, (a, pivot, x, y) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), part.column(3).cast(pa.binary()).to_pylist(), strict=True)):
                    if a is None:
                        values = part.column(4)[k].values
                        common = values.field("element").to_numpy().view(np.uint64)
                        rank = np.argsort(common)
                        now, common = pivot, common[rank]
                        continue
                    if pivot != now:
                        now, common, rank = pivot, common[:0], rank[:0]
                    y, x = of[y], of[x]
                    size, prefix, mark = differences(x, y, num, den, common, rank)
                    rows.append((pivot, a, comps[k], len(x), size))
                    prefixes.append(prefix)
                    marks.append(mark)
                if not rows:
                    continue
                times = np.array([len(p) for p in prefixes])
                whole = [np.repeat(np.array(column, np.int64), times) for column in zip(*rows, strict=True)]
                whole += [np.concatenate([np.arange(k) for k in times]).astype(np.int64), np.concatenate(prefixes).view(np.int64)]
                whole += [np.repeat(column, times) for column in np.stack(marks, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in whole], names=["pivot", "cls", "comp", "n", "size", "place", "element", *MARKS])

    common = _common(pairs, n, num, den).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = pairs.withColumn("part", F.pmod(F.xxhash64("a"), _parts(F.col("sets"))).cast("int")).select("a", "b", "text_a", "text_b", "part", "comp")
    both = own.unionByName(common.select("b", "part", "common"), allowMissingColumns=True)
    both = both.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return both.select("a", "b", "text_a", "text_b", "common", "comp").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in ("pivot", "cls", "comp", "n", "size", "place", "element", *MARKS)))


#: What a set brings to a meeting with another one.
OWN = ("cls", "origin", "comp", "n", "size", "place", *MARKS)


def _open(d: DataFrame, turn: int) -> DataFrame:
    """The elements of pivots whose sets are of different components, with one of these sets, another one each turn (met)."""
    seed = F.lit(int(turn * 0x9E3779B97F4A7C15 % (1 << 62)))
    chosen = F.min(F.struct(F.col("cls").bitwiseXOR(seed).alias("at"), *OWN)).alias("met")
    alike = (F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("cls")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), "cls")).alias("h2"), F.min(F.struct("cls", "place")).alias("first"))
    return d.groupBy("pivot", "element").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), chosen, *alike).filter("low < high")


def _telling(held: DataFrame) -> DataFrame:
    """The elements that the join needs. Of elements that the very same sets of a pivot have, the first stands for all: these
    share one order, so where another one is the first that two sets share, so is it. An edit changes a run of shingles,
    which comes down to one."""
    return held.groupBy("pivot", "c", "h1", "h2").agg(F.min(F.struct("first.place", "element", "met")).alias("x")).select("pivot", "x.element", "x.met")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp (the least node reachable) for the nodes of edges (a, b): least neighbours' labels, and labels of labels,
    until nothing changes. Each step is written, and counts what it changed."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        one = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        after = one.join(jump, "mid", "left").select("node", "old", F.coalesce(F.least("mid", "far"), "mid").alias("comp"))
        before = scratch.paths.pop("labels")
        labels, changed = scratch.counted(after, "labels", F.col("comp") != F.col("old"))
        scratch.paths["before"] = before
        scratch.drop("before")
        if not changed:
            scratch.paths["found"] = [*scratch.paths.get("found", []), *scratch.paths.pop("labels")]
            return labels.select("node", "comp")


def _labelled(rows: DataFrame, by: str, found: DataFrame, name: str = "comp") -> DataFrame:
    """rows with the component of the node in column `by`, which is its own where it isn't found."""
    return rows.join(found.select(F.col("node").alias(by), F.col("comp").alias("__comp")), by, "left").withColumn(name, F.coalesce("__comp", by)).drop("__comp")


def _merged(tiles: DataFrame, sets: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Two frames (node, comp): the components that links with pivots make of sets, and what further links make of these."""
    rest = tiles.filter("cls <> pivot")
    pairs = _bounded(rest.select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct(), sets, num, den)
    links = scratch.written(_verified(pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), sets, n, num, den), "links")
    found = components(links, scratch)
    x = scratch.written(_labelled(rest, "cls", found), "labelled")
    open_tiles = scratch.written(x.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key"), "open")
    unlike = scratch.written(x.join(open_tiles, "key", "left_semi").select(F.col("cls").alias("a"), F.col("pivot").alias("b"), "comp").distinct(), "unlike")
    pivots = scratch.written(unlike.groupBy("b").agg(F.count(F.lit(1)).alias("sets")), "pivots")
    scratch.drop("labelled", "open", "links")
    if pivots.isEmpty():
        return found, None
    pairs = scratch.written(_with(unlike.join(pivots, "b"), sets, "text").select("a", "b", "comp", "sets", "text_a", "text_b"), "pairs")
    d = scratch.written(_differing(pairs, n, num, den).withColumn("origin", F.col("comp")), "differences")
    scratch.drop("unlike", "pivots", "pairs")
    most = f"({den - num} * (n_a + n_b) div {den + num})"
    t = F.expr(f"(size_a + size_b - {most} + 1) div 2")
    can = (F.col("comp_a") != F.col("comp_b")) & (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    can &= (t <= F.col("size_a") - F.col("place_a")) & (t <= F.col("size_b") - F.col("place_b"))
    can &= F.expr(" + ".join(f"bit_count({m}_a ^ {m}_b)" for m in MARKS) + f" <= {most}")
    one, two = ([F.col(c).alias(f"{c}_{s}") for c in OWN] for s in "ab")
    edges = more = None
    for turn in range(ROUNDS + 1):
        if more is not None:
            d = scratch.replaced(_labelled(d.drop("comp"), "origin", more), "differences")
        held = _open(d, turn)
        held = scratch.written(held.select("pivot", "element", "met") if turn else _telling(held), "held")
        met = scratch.written(d.join(held, ["pivot", "element"]), "met")  # settled elements leave here
        scratch.drop("differences", "held")
        d = met.drop("met")
        if turn < ROUNDS:
            pairs = met.select(*one, *[F.col(f"met.{c}").alias(f"{c}_b") for c in OWN]).filter(can)
        else:
            pairs = d.select("pivot", "element", *one).join(d.select("pivot", "element", *two), ["pivot", "element"]).filter(can & (F.col("cls_a") < F.col("cls_b")))
        pairs = pairs.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"), F.least("origin_a", "origin_b").alias("x"), F.greatest("origin_a", "origin_b").alias("y")).distinct()
        new = scratch.written(_verified(pairs, sets, n, num, den).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "more")
        scratch.paths["differences"] = scratch.paths.pop("met")
        if not new.isEmpty():
            edges = new if edges is None else edges.union(new)
            more = components(edges, scratch)
    return found, more


def _tiles(sets: DataFrame, copies: DataFrame, scratch: Scratch) -> DataFrame:
    """key, cls, pivot (the least set of the tile) for the tiles that classes stay in and share with others."""
    rows = sets.select("row", F.explode("tiles").alias("tile")).select("row", "tile.*")
    common = scratch.written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "common")
    near = rows.join(common, "key").join(copies, "row", "left").select("key", F.coalesce("cls", "row").alias("cls"), "m", "first").distinct()
    order = Window.partitionBy("cls", F.col("key").bitwiseAND(F.lit(127))).orderBy(F.col("m").desc(), "key")
    stays = scratch.written(near.withColumn("nth", F.row_number().over(order)).filter("nth > first").select("key", "cls"), "stays")
    shared = scratch.written(stays.groupBy("key").agg(F.min("cls").alias("pivot"), F.max("cls").alias("last")).filter("pivot < last").drop("last"), "shared")
    return stays.join(shared, "key").select("key", "cls", "pivot")


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, stays (one row of each component: that of the least id), k1, k2 (the text's name)
    for every row."""
    with Scratch(docs.sparkSession) as scratch:
        return written(_components(docs, words, num, den, id_col, text_col, scratch), "components")


def _components(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    sets = scratch.written(_sets(docs, words, num, den, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sets")
    full, name = sets.filter("n > 0"), ["n", "c1", "c2"]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    classes = scratch.written(full.groupBy(*name).agg(F.min("row").alias("cls"), F.count(F.lit(1)).alias("rows"), first), "classes")
    copies = scratch.written(full.select("row", *name).join(classes.filter("rows > 1").select(*name, "cls"), name).filter("row <> cls").select("row", "cls"), "copies")
    tiles = scratch.written(_tiles(full, copies, scratch), "tiles")
    scratch.drop("common", "stays", "shared", "copies")
    needed = sets.select(F.col("row").alias("cls"), "n", "mark", "k1", "k2").join(tiles.select("cls").distinct(), "cls", "left_semi")
    texts = _named(docs, id_col, text_col).select("k1", "k2", "text")
    texts = needed.join(texts, ["k1", "k2"]).withColumn("copy", F.row_number().over(Window.partitionBy("k1", "k2", "cls").orderBy(F.lit(0)))).filter("copy = 1")
    texts = scratch.written(texts.select("cls", "n", "mark", "text"), "texts")
    found, more = _merged(tiles, texts, words, num, den, scratch)

    whole = _labelled(classes, "cls", found)
    if more is not None:
        whole = _labelled(whole.withColumnRenamed("comp", "origin"), "origin", more)
    whole = scratch.written(whole.select(*name, "comp", "first"), "whole")
    heads = scratch.written(whole.groupBy("comp").agg(F.min("first").alias("head")), "heads")
    named = whole.join(heads, "comp").select(*name, F.col("head.id").alias("component_id"), F.col("head.row").alias("head"))
    x = sets.select("id", "k1", "k2", *name, "row").join(named, name, "left")
    empty = F.col("n") == 0
    return x.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (empty | (F.col("row") == F.col("head"))).alias("stays"), "k1", "k2",
    )


def jaccard_dedup(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each component, and every row without words. All columns are kept."""
    stay = jaccard_components(docs, words, num, den, id_col, text_col).filter("stays").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"))
    text = text_of(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(id_col).cast("long"), text).alias("k1"), F.xxhash64(F.lit(7), text, F.col(id_col).cast("long")).alias("k2"))
    order = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(*order))
    return rows.join(stay, ["k1", "k2"]).withColumn("nth", nth).filter("nth <= rows").select("row.*")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS o, doc_id AS v FROM documents UNION SELECT r.o, e.b FROM r JOIN e ON r.v = e.a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(v) FROM r WHERE r.o = documents.doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id)
"""
