"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

DataFrame operations only. Texts are equal when identical after lower-casing A-Z.

Few rows stand in a group with others, and only their texts move. A filter of 2^24 bits (2 MB, whatever the input) tells
most of the other rows apart where they are read; of these it lets some through as its bits fill up, and the exact join
that follows drops them.

A text may be that of a large share of all rows: groups are counted before anything moves, and stand in a table before they are
joined, so that both sides are plain shuffles, which Spark splits where they are skewed (merge joins, as a shuffle that
is joined to a broadcast is not split).

Defined results: a null text is the empty text. A null id sorts below every other id, so it stays only where
all ids of a group are null. Rows repeated with the same id and text count in the group's size; one of them stays.
An empty table gives an empty result. Columns of the input that share a name with an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import LOWER, UPPER, Scratch, ascii_lower, text_of, without, written

#: Members of one group that meet one copy of the keeper's bytes; larger groups are salted into more parts.
PER_SALT = 512
#: Bits of the filter, as a power of two, and of one of its rows.
FILTER_BITS, ROW_BITS = 24, 15


def content_hash(t: Column) -> Column:
    """128 bits of a normalised text."""
    return F.unhex(F.md5(t))


def _digests(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """id, content hash, SHA-256 and a hash of the raw text for every row: the one pass that normalises all texts. It is
    written, as every step after it starts there."""
    t = ascii_lower(text_of(text_col))
    return scratch.written(docs.select(F.col(id_col).alias("id"), content_hash(t).alias("h"), F.unhex(F.sha2(t, 256)).alias("sha"), F.xxhash64(text_of(text_col)).alias("raw")), "digests")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row for each distinct (id, normalised text): id, h, sha, raw, n_rows, keep_id, group_size, kept.

    Only hashes and ids are shuffled to form the groups. Texts of members move once, by their own id and hash, for the comparison of
    bytes: each member of a group with more than one row meets the keeper's text, in salted parts of bounded size.
    A group in which bytes differ (a collision of the hash) is split into groups of equal bytes.
    """
    with Scratch(docs.sparkSession) as scratch:
        return written(_groups(docs, id_col, text_col, keep, scratch), "groups")


def _place(raw: Column, id_: Column) -> Column:
    return F.pmod(F.xxhash64(raw, id_), F.lit(1 << FILTER_BITS))


def _bits(members: DataFrame) -> DataFrame:
    """The filter: at most 2^9 rows of 4 KB, with a bit for the place of every member (raw, id)."""
    at = _place(F.col("raw"), F.col("id"))
    return members.groupBy(F.shiftright(at, ROW_BITS).alias("filter_row")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit((1 << ROW_BITS) - 1))).alias("filter_bits"))


def _candidates(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """rows (raw, id and more) with may_be: false for rows that are no members."""
    x = rows.withColumn("filter_at", _place(F.col("raw"), F.col("id")))
    x = x.join(F.broadcast(bits), F.shiftright("filter_at", ROW_BITS) == F.col("filter_row"), "left")  # 2 MB at most
    place = F.col("filter_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring("filter_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1))
    return x.withColumn("may_be", F.coalesce(bit == 1, F.lit(False))).drop("filter_at", "filter_row", "filter_bits")


def _members(digests: DataFrame, best: Callable, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of more than one row (h, keep_id, group_size, parts), their members (h, id, raw, keep_id, parts), and the filter."""
    groups = digests.groupBy("h").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = scratch.written(groups.withColumn("parts", F.ceil(F.col("group_size") / PER_SALT).cast("int")), "groups")
    members = scratch.written(digests.select("h", "id", "raw").distinct().join(groups.select("h", "keep_id", "parts").hint("merge"), "h"), "members")
    return groups, members, scratch.written(_bits(members), "filter")


def _groups(docs: DataFrame, id_col: str, text_col: str, keep: str, scratch: Scratch) -> DataFrame:
    best = {"smallest": F.min, "largest": F.max}[keep]
    digests = _digests(docs, id_col, text_col, scratch)
    groups, members, bits = _members(digests, best, scratch)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("raw", F.xxhash64("text"))
    texts = _candidates(texts, bits).filter("may_be").select("id", "raw", "text")
    found = texts.alias("a").join(members.alias("m"), (F.col("a.raw") == F.col("m.raw")) & F.col("a.id").eqNullSafe(F.col("m.id")))
    found = scratch.written(found.select("m.h", "a.id", "m.keep_id", "m.parts", ascii_lower(F.col("a.text")).alias("t")), "texts")
    found = found.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    keeper = found.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("h").agg(F.max("t").alias("keep_t"), F.max("parts").alias("parts"))
    keeper = keeper.select("h", "keep_t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    collided = scratch.written(found.join(keeper, ["h", "part"]).filter("t <> keep_t").select("h").distinct(), "collided")

    rows = digests.groupBy("h", "sha", "id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("raw").alias("raw"))
    alone = F.col("group_size").isNull()
    out = rows.join(groups.drop("parts").hint("merge"), "h", "left")
    out = out.withColumn("keep_id", F.when(alone, F.col("id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("group_size", "n_rows"))
    if not collided.isEmpty():
        split = found.join(collided, "h", "left_semi").groupBy("h", F.unhex(F.sha2("t", 256)).alias("sha")).agg(best("id").alias("own_id"), F.count(F.lit(1)).alias("own_size"))
        own = F.col("own_size").isNotNull()
        out = out.join(split, ["h", "sha"], "left").withColumn("keep_id", F.when(own, F.col("own_id")).otherwise(F.col("keep_id"))).withColumn("group_size", F.coalesce("own_size", "group_size"))
    return out.select("h", "sha", "id", "raw", "n_rows", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows repeated with id and text, the least in all columns stays.
    Rows that the filter knows to be alone stay where they are."""
    groups = exact_groups(docs, id_col, text_col, keep)
    members = groups.filter("group_size > 1").select("id", "raw", "kept")
    bits = written(_bits(members), "filter")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("raw"))
    rows = _candidates(rows, bits)
    order = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]
    first = F.row_number().over(Window.partitionBy("raw", F.coalesce("id", F.lit(0)), F.col("id").isNull()).orderBy(*order))
    some = rows.filter("may_be").join(members.select(F.col("id").alias("own_id"), F.col("raw").alias("own_raw"), "kept"), (F.col("raw") == F.col("own_raw")) & F.col("id").eqNullSafe(F.col("own_id")), "left")
    some = some.filter(F.coalesce("kept", F.lit(True))).withColumn("nth", F.when(F.col("kept"), first).otherwise(F.lit(1)))
    return rows.filter(~F.col("may_be")).select("row.*").unionByName(some.filter("nth = 1").select("row.*"))


def with_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = exact_groups(without(docs, "keep_id", "group_size", "kept", "text_sha256"), keep=keep)
    one = groups.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return one.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("kept") & (F.col("i") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
