"""Secret scans over an incremental blob ledger. DataFrame and SQL functions only.

Every version of a text is a blob, named by its SHA-256. Only pairs of blob and rule version that the ledger doesn't
hold are scanned, each blob once however many paths carry it; findings are then joined back to all paths. The empty text is
the blob of very many paths: what is joined to paths stands in a table first, so both sides are plain shuffles, which
Spark splits where they are skewed.

Offsets: a pattern's matches and the pieces between them are cut by the same engine, so a match starts where the
lengths (in code points) of all pieces and matches before it end. Offsets are counted per piece, so a long text with
many matches costs a row for each match, not an array of arrays.

Defined results: a null text is the empty text and has no findings; a null id is a path like any other; repeated rows
are paths of their own; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import Scratch, text_of, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and don't overlap; those whose group is shorter than `least` are dropped after that."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The patterns of the kinds, in the order in which spans that start together are listed.
RULES = (
    Rule("assign", 1, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    # The maximal run of 24 or more is the match of [0-9a-f]+ that isn't dropped.
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
BASE = ("assign", "access", "hex")


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each path and version: id, blob."""
    return docs.select(F.col(id_col).alias("id"), F.sha2(text_of(text_col), 256).alias("blob"))


def unseen(blobs: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """blob, todo (the kinds to scan it for): the pairs of blob and rule version that the ledger lacks."""
    if ledger is None:
        return blobs.withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    pairs = blobs.withColumn("rule", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])))
    pairs = pairs.select("blob", "rule.kind", "rule.version").join(ledger.select("blob", "kind", "version").distinct(), ["blob", "kind", "version"], "left_anti")
    return pairs.groupBy("blob").agg(F.collect_set("kind").alias("todo"))


def _cut(rule: Rule, at: int) -> Column:
    t, p = F.col("t"), F.lit(rule.pattern)
    lengths = F.zip_with(
        F.split(t, rule.pattern, -1),
        F.arrays_zip(F.regexp_extract_all(t, p, F.lit(0)).alias("m"), F.regexp_extract_all(t, p, F.lit(rule.group)).alias("g")),
        lambda piece, m: F.struct(F.char_length(piece).cast("long").alias("gap"), F.char_length(m["m"]).cast("long").alias("len"), F.char_length(m["g"]).cast("long").alias("own")),
    )
    hit = F.array_contains("todo", rule.kind) & F.rlike(t, p)
    return F.when(hit, F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(at).alias("rank"), F.lit(rule.least).alias("least"), lengths.alias("cuts")))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger's new findings: blob, kind, version, rank, start, end, for blobs and rules that it hasn't seen.

    Texts move once, by blob and id of one path for each blob (never by a hot blob), and only blobs to scan go on.
    """
    found = versions(docs, id_col, text_col)
    path = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    one = found.withColumn("path", path).groupBy("blob").agg(F.min("path").alias("path"))
    one = one.join(unseen(one.select("blob"), rules, ledger), "blob")
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).withColumn("blob", F.sha2("t", 256)).withColumn("path", path)
    texts = texts.join(one, ["blob", "path"])
    texts = texts.withColumn("copy", F.row_number().over(Window.partitionBy("blob", "path").orderBy(F.lit(0)))).filter("copy = 1")
    hits = texts.select("blob", F.explode(F.array_compact(F.array(*[_cut(r, i) for i, r in enumerate(rules)]))).alias("hit"))
    rows = hits.select("blob", "hit.kind", "hit.version", "hit.rank", "hit.least", F.posexplode("hit.cuts").alias("i", "cut"))
    so_far = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("cut.gap") + F.coalesce("cut.len", F.lit(0))).over(so_far)
    rows = rows.withColumn("end", end).filter("cut.own >= least")
    return rows.select("blob", "kind", "version", "rank", (F.col("end") - F.col("cut.len")).alias("start"), "end")


def record(docs: DataFrame, findings: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger after a scan: a row for each blob, rule version and span, and one with null spans for each pair without findings."""
    blobs = versions(docs, id_col, text_col).select("blob").distinct()
    ranks = {r.kind: i for i, r in enumerate(rules)}
    pairs = unseen(blobs, rules, ledger).select("blob", F.explode("todo").alias("kind"))
    numbers = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    order = F.create_map(*[F.lit(x) for k, i in ranks.items() for x in (k, i)])
    new = pairs.join(findings.drop("version", "rank"), ["blob", "kind"], "left").select("blob", "kind", numbers[F.col("kind")].alias("version"), order[F.col("kind")].alias("rank"), "start", "end")
    return new if ledger is None else ledger.unionByName(new)


def delivered(deliveries: list[DataFrame], rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger after documents that came one delivery after the other: each is scanned for what those before it left unseen."""
    with Scratch(deliveries[0].sparkSession) as scratch:
        ledger = None
        for docs in deliveries:
            found = scratch.written(scan(docs, ledger, rules, id_col, text_col), "found")
            ledger = scratch.written(record(docs, found, ledger, rules, id_col, text_col), "ledger")
        return written(ledger, "ledger")


def by_path(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings joined back to every path: doc_id, a count for each base kind, base_sha256 and spans."""
    span = F.concat_ws(":", "kind", "start", "end")
    x = findings.filter("start IS NOT NULL").withColumn("span", F.struct("start", "rank", "kind", span.alias("text")))
    listed = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: s["text"]), ",")
    x = x.groupBy("blob").agg(F.collect_list("span").alias("all"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE])
    base = F.filter("all", lambda s: s["kind"].isin(*BASE))
    x = written(x.select("blob", *[f"n_{k}" for k in BASE], listed(base).alias("base"), listed(F.col("all")).alias("spans")), "spans")
    out = versions(docs, id_col, text_col).join(x, "blob", "left")
    return out.select(F.col("id").alias("doc_id"), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT b, '{r.kind}' AS kind, {i} AS rank, {r.least} AS least, unnest(string_split_regex(t, '{p}')) AS piece,
  unnest(regexp_extract_all(t, '{p}', 0) || ['']) AS m, unnest(regexp_extract_all(t, '{p}', {r.group}) || ['']) AS g,
  unnest(range(len(string_split_regex(t, '{p}')))) AS i FROM blobs WHERE regexp_matches(t, '{p}')""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS b FROM documents),
blobs AS (SELECT b, any_value(t) AS t FROM d GROUP BY b),
cuts AS ({" UNION ALL ".join(parts)}),
ends AS (SELECT *, CAST(sum(length(piece) + length(m)) OVER (PARTITION BY b, kind ORDER BY i) AS BIGINT) AS e FROM cuts),
spans AS (SELECT b, kind, rank, e - length(m) AS s, kind || ':' || (e - length(m)) || ':' || e AS span FROM ends WHERE length(g) >= least),
per AS (SELECT b, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY b)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (b)
"""


SQL = _sql()
