"""Quality classifier: hierarchical empirical Bayes over a document classifier.

Two document classifiers (low quality, toxic) give each document its own evidence: logistic regressions over text
statistics and over lexicons learned from labels. Their probabilities are summed per host (source) and per path (source
and language) by grouped aggregation; the spread between hosts and between a host's paths, after the spread that
sampling alone explains, sets how strongly a site is shrunk towards its host and a host towards the whole corpus. A
document's posterior odds are its own evidence times its path's odds over the corpus's odds.

The classifiers are fitted from at most MOST_LABELS labelled documents (a documented bound, chosen by a hash of the id);
everything else covers all documents.

Defined results: a null text is empty; null sources and languages are sites of their own; null ids are kept rows like any
other; labels that are null or without a document take no part; with one class only a classifier gives its
rate to all; repeated rows count once each; an empty table gives an empty result; outputs replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import kept, tidy, without, written

MOST_LABELS = 12_000
#: Words of each lexicon, at most; a word enters when it follows so many different words in its class, with log odds of
#: at least so much. A context counts once however many copies of a text carry it.
LEXICON, LEXICON_CONTEXTS, LEXICON_ODDS = 500, 8, 2.0
#: Posterior probabilities at which a document goes.
REJECT_AT = 0.5
TASKS = ("low", "toxic")
BLANK_OUT = bytes(32 if x < 128 and not chr(x).isalpha() else x for x in range(256))
N_STATS = 9


def _share(b: bytes, chars: bytes, of: int) -> float:
    return (len(b) - len(b.translate(None, chars))) / of


def _stats(b: bytes, words: int, distinct: int) -> list[float]:
    n, w = max(len(b), 1), max(words, 1)
    return [
        float(np.log1p(words)), _share(b, b"#*$%&<>", n) ** 0.5, _share(b, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", n) ** 0.5, _share(b, b"!", n) ** 0.5, _share(b, b"|", n) ** 0.5,
        _share(b, b"0123456789", n) ** 0.5, _share(b, b".,", n) ** 0.5, _share(b, b" \n\t", n), distinct / w,
    ]


def _vocabulary(b: bytes) -> list[bytes]:
    return b.lower().translate(BLANK_OUT).split()


@dataclass
class Logistic:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[1:] + self.weights[0]
        return np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-6, 1 - 1e-6)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> Logistic:
    """Newton's method on standardised features."""
    d = x.shape[1]
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(d), np.ones(d))
    a = np.column_stack([np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)])
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    w = np.zeros(d + 1)
    w[0] = np.log(rate / (1 - rate))
    if len(set(y.tolist())) > 1:
        ridge = np.diag([1e-6] + [l2] * d)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve(a.T @ (a * np.maximum(p * (1 - p), 1e-6)[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
            w -= step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
            if np.abs(step).max() < 1e-6:
                break
    return Logistic(w, mean, scale)


@dataclass
class Model:
    lexicons: dict[str, dict[bytes, float]] = field(default_factory=dict)
    models: dict[str, Logistic] = field(default_factory=dict)

    def features(self, b: bytes) -> list[float]:
        words = _vocabulary(b)
        distinct = set(words)
        out = _stats(b, len(words), len(distinct))
        for task in TASKS:
            lexicon = self.lexicons.get(task, {})
            found = [lexicon[w] for w in distinct & lexicon.keys()]
            out += [sum(found), max(found, default=0.0)]
        return out

    def probabilities(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), N_STATS + 2 * len(TASKS))
        return {t: self.models[t].probability(_columns(t, x)) for t in TASKS}


def _columns(task: str, x: np.ndarray) -> np.ndarray:
    """Low quality is read from the statistics and its lexicon, toxicity from its lexicon and the length."""
    k = N_STATS + 2 * TASKS.index(task)
    own = list(range(N_STATS)) if task == "low" else [0]
    return x[:, [*own, k, k + 1]]


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    y = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))
    y = y.orderBy(F.xxhash64(F.lit("label"), "doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most `most` ids: a bounded broadcast.
    found = texts.join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "low", "toxic")).alias("r"))
    return found.select("doc_id", "r.*")


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Model:
    """Two bounded passes over the labelled sample: word contexts by class (counted in Spark; only lexicons reach the
    driver), then features, from which the regressions are fitted."""
    sample = kept(_sample(docs, labels, most))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, low, toxic = b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for x, lo, to in zip(t, low, toxic, strict=True):
                w = _vocabulary(x)
                pairs = [(a.decode(errors="replace"), c.decode(errors="replace")) for a, c in set(zip([b"", *w], w, strict=False))]
                n = len(pairs)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array([lo] * n, pa.int32()), pa.array([to] * n, pa.int32())], names=["after", "word", "low", "toxic"])

    contexts = sample.select("text", *TASKS).mapInArrow(tidy(words), "after string, word string, low int, toxic int").groupBy("word", "after").agg(*[F.avg(t).alias(t) for t in TASKS])
    counts = kept(contexts.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in TASKS]))
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(t), F.lit(0.0)).alias(t) for t in TASKS]).first()
    model = Model()
    for t in TASKS:
        odds = F.log((F.col(t) + 0.5) / (n[t] + 1.0)) - F.log((F.col("n") - F.col(t) + 0.5) / (n["n"] - n[t] + 1.0))
        best = counts.filter(F.col(t) >= LEXICON_CONTEXTS).withColumn("odds", odds).filter(F.col("odds") >= LEXICON_ODDS).orderBy((F.col(t) * F.col("odds")).desc(), "word").limit(LEXICON)
        model.lexicons[t] = {r["word"].encode(): r["odds"] for r in best.collect()}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.features(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "low", "toxic", "x"])

    rows = sorted(map(tuple, sample.mapInArrow(tidy(features), "doc_id long, low int, toxic int, x array<double>").collect()))
    x = np.array([r[3] for r in rows], float).reshape(len(rows), N_STATS + 2 * len(TASKS))
    for i, t in enumerate(TASKS):
        model.models[t] = logistic(_columns(t, x), np.array([r[1 + i] for r in rows], float))
    return model


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """docs with p_low and p_toxic, each document's own probabilities. No shuffle."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            parts = [model.probabilities(text.slice(i, 500).cast(pa.binary()).to_pylist()) for i in range(0, max(1, len(text)), 500)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([p[t] for p in parts])) for t in TASKS], names=[f"p_{t}" for t in TASKS])

    tidied = tidy(run)

    @F.arrow_udf("p_low double, p_toxic double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(batches)

    own = without(docs, "p_low", "p_toxic")
    return own.withColumn("__p", scores(F.coalesce(F.col("text").cast("string"), F.lit("")))).select("*", "__p.*").drop("__p")


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, and for each task the posterior rate of the path (path_low, path_toxic) and the corpus's (all_low, ...).

    Sums by (host, path) are pre-aggregated before their shuffle, so a hot host costs no more than any other. All later
    steps see one row for each path; three numbers for each task reach the driver.
    """
    sums = [f(c).alias(f"{n}_{t}") for t in TASKS for n, f, c in (("s", F.sum, f"p_{t}"), ("q", F.sum, F.col(f"p_{t}") * F.col(f"p_{t}")))]
    paths = kept(scored.groupBy(F.col("source").alias("host"), F.col("lang").alias("path")).agg(F.count(F.lit(1)).alias("n"), *sums))
    hosts = Window.partitionBy("host")
    x = paths.withColumn("host_n", F.sum("n").over(hosts))
    for t in TASKS:
        x = x.withColumn(f"host_s_{t}", F.sum(f"s_{t}").over(hosts)).withColumn(f"host_q_{t}", F.sum(f"q_{t}").over(hosts))
    one = hosts.orderBy(F.col("path").asc_nulls_first())
    x = x.withColumn("first", F.row_number().over(one) == 1)
    whole = x.agg(F.sum("n").alias("n"), *[F.sum(f"s_{t}").alias(f"s_{t}") for t in TASKS]).first()
    rates = {t: ((whole[f"s_{t}"] or 0.0) + 0.5) / ((whole["n"] or 0) + 1.0) for t in TASKS}

    def spread(n: Column, s: Column, q: Column, around: Column) -> Column:
        """Squared distance of a site's mean from its parent's, less what sampling alone explains."""
        mean = s / n
        return (mean - around) * (mean - around) - F.greatest(q / n - mean * mean, F.lit(0.0)) / n

    measured = x.agg(
        *[F.avg(F.when(F.col("first"), spread(F.col("host_n"), F.col(f"host_s_{t}"), F.col(f"host_q_{t}"), F.lit(rates[t])))).alias(f"host_{t}") for t in TASKS],
        *[F.avg(spread(F.col("n"), F.col(f"s_{t}"), F.col(f"q_{t}"), F.col(f"host_s_{t}") / F.col("host_n"))).alias(f"path_{t}") for t in TASKS],
    ).first()
    for t in TASKS:
        strength = {}
        for level in ("host", "path"):
            between = max(measured[f"{level}_{t}"] or 0.0, 1e-9)
            strength[level] = float(np.clip(rates[t] * (1 - rates[t]) / between - 1, 1.0, 1e6))
        host = (F.col(f"host_s_{t}") + strength["host"] * rates[t]) / (F.col("host_n") + strength["host"])
        x = x.withColumn(f"path_{t}", (F.col(f"s_{t}") + strength["path"] * host) / (F.col("n") + strength["path"])).withColumn(f"all_{t}", F.lit(rates[t]))
    return kept(x.select("host", "path", *[f"{k}_{t}" for t in TASKS for k in ("path", "all")]))


def classified(docs: DataFrame, labels: DataFrame, model: Model | None = None, with_text: bool = True) -> DataFrame:
    """docs with low, toxic (posterior probabilities) and kept. Without its text, every document is scored once, and the scores
    are written. With it, texts are scored again when the result is read, as a copy of the texts would take more than
    the scores do. Paths are a table, which Spark broadcasts where its size is under the session's limit."""
    own = without(docs, "low", "toxic", "kept", "p_low", "p_toxic")
    model = model or fitted(own, labels)
    columns = [c for c in own.columns if with_text or c != "text"]
    if with_text:
        sites, scored = site_posteriors(evidence(own.select("source", "lang", "text"), model)), evidence(own, model)
    else:
        scored = written(evidence(own, model).drop("text"), "scored")
        sites = site_posteriors(scored)
    sites = sites.select(*[F.col(c).alias(f"__{c}") for c in sites.columns])
    x = scored.join(sites, F.col("source").eqNullSafe(F.col("__host")) & F.col("lang").eqNullSafe(F.col("__path")))
    odds = lambda c: F.log(c / (1 - c))
    for t in TASKS:
        x = x.withColumn(t, 1 / (1 + F.exp(-(odds(F.col(f"p_{t}")) + odds(F.col(f"__path_{t}")) - odds(F.col(f"__all_{t}"))))))
    x = x.withColumn("kept", (F.col("low") < REJECT_AT) & (F.col("toxic") < REJECT_AT))
    return x.select(*[f"`{c}`" for c in columns], *TASKS, "kept")
