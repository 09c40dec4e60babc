"""Quality classifier with hierarchical empirical Bayes over sites (operator 6).

A logistic classifier on a text's shape (capitals, symbols, repetition, word lengths) gives each document a
probability.  Sites are hosts and paths; here a document's source and its language within it.  Each host's mean is
shrunk toward the corpus, each path's toward its host; how strongly follows from the spread between sites beyond what
their sizes explain, so sparse sites stay near their parents.  A document's log-odds take part of its path's shift.

Fitting reads at most ``MAX_LEARN`` labelled rows, picked by the hash of their id; scoring and the site statistics cover every
document.

Defined results: null, empty and blank texts are kept out (score 0, not kept); null hosts or paths are sites of their own;
repeated rows score alike; a text with labels of both kinds counts as bad; without labels of both kinds every text that isn't empty is kept; further columns are passed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm.common import table, written
from caselode.llm.toxicity import logistic

MAX_LEARN = 10_000
SITE_WEIGHT = 0.25
#: Sites sent to every executor at most, about 20 MB; beyond it the site table is joined by shuffle.
BROADCAST_SITES = 200_000
SHAPE = ["upper", "symbols", "digits", "repeats", "word_length", "short"]


def shape(text: str = "text") -> dict[str, Column]:
    """Shares and logs that describe a text."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.split(F.trim(t), r"\s+")
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    return {
        "upper": share(r"\p{Lu}"),
        "symbols": share(r"[!|#$%&*@^~=<>_\\{}\[\]]"),
        "digits": share(r"[0-9]"),
        "repeats": 1 - F.size(F.array_distinct(words)) / F.size(words),
        "word_length": F.log1p(n / F.size(words)),
        "short": 1 / F.sqrt(n),
    }


def _inputs(df: DataFrame) -> list[Column]:
    """The shape and its squares, and symbols per word."""
    return [F.col(c) for c in SHAPE] + [F.sqrt(c) for c in SHAPE[:4]]


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LEARN) -> list[float] | None:
    picked = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumns(shape()).select("quality", *[c.cast("double").alias(f"x{i}") for i, c in enumerate(_inputs(docs))]).toPandas()
    x, y = rows.drop(columns="quality").to_numpy(), rows["quality"].to_numpy()
    if len(set(y)) < 2:
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = logistic((x - mean) / scale, y, ridge=0.1)
    return [*(w[:-1] / scale), float(w[-1] - (w[:-1] * mean / scale).sum())]


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def _shrinkage(sites: DataFrame, parent: Column) -> float:
    """Pseudo-documents behind a parent's mean: method of moments over the sites, between 5 and 10,000."""
    mean = F.col("s") / F.col("n")
    got = sites.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (mean - parent) ** 2).alias("between"), F.sum(F.col("n") * parent * (1 - parent)).alias("within")).first()
    if not got.k or got.k < 2 or not got.within:
        return 10_000.0
    within = got.within / got.n
    extra = (got.between / got.k - within) / (got.n / got.k)
    return float(np.clip(within / extra if extra > 0 else 10_000, 5, 10_000))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` with ``quality_score`` and ``keep``; input columns of these two names are replaced."""
    # The input row travels as one column, so that none of its names can clash with those used here.
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("quality_score", "keep")]).alias("_in"), F.col("text").alias("_text"), F.col(host).alias("_host"), F.col(path).alias("_path"))
    has_text = F.rlike(F.coalesce("_text", F.lit("")), F.lit(r"\S"))
    w = fit(docs, labels)
    if w is None:
        return rows.select("_in.*", F.when(has_text, 1.0).otherwise(0.0).alias("quality_score"), has_text.alias("keep"))
    shaped = rows.select("*", *[c.alias(f"_{k}") for k, c in shape("_text").items()])
    line = sum((c * float(v) for c, v in zip([F.col(f"_{k}") for k in SHAPE] + [F.sqrt(f"_{k}") for k in SHAPE[:4]], w, strict=False)), F.lit(float(w[-1])))
    scored = written(shaped.withColumn("_p", F.when(has_text, 1 / (1 + F.exp(-F.least(F.greatest(line, F.lit(-30.0)), F.lit(30.0))))).otherwise(0.0)).select("_in", "_host", "_path", "_p"), "quality")

    sites, overall = site_means(scored)
    sites = F.broadcast(sites) if sites.count() <= BROADCAST_SITES else sites
    joined = scored.join(sites, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_q")), "left")
    odds = _odds(F.col("_p")) + SITE_WEIGHT * (_odds(F.col("_site")) - _odds(F.lit(overall)))
    score = F.when(F.col("_p") > 0, 1 / (1 + F.exp(-odds))).otherwise(0.0)
    return joined.select("_in.*", score.alias("quality_score"), (score >= 0.5).alias("keep"))


def site_means(scored: DataFrame) -> tuple[DataFrame, float]:
    """(_h, _q, _site) of each host and path, and the mean of all, from (_host, _path, _p) of every document."""
    paths = written(scored.groupBy("_host", "_path").agg(F.sum("_p").alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    overall = float(total.s / total.n) if total.n else 0.5
    k = _shrinkage(hosts, F.lit(overall))
    hosts = hosts.select(F.col("_host").alias("_of"), ((F.col("s") + k * overall) / (F.col("n") + k)).alias("_host_mean"))
    inner = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_of"))).drop("_of")
    k = _shrinkage(inner, F.col("_host_mean"))
    return written(inner.select(F.col("_host").alias("_h"), F.col("_path").alias("_q"), ((F.col("s") + k * F.col("_host_mean")) / (F.col("n") + k)).alias("_site")), "sites"), overall


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the labels of four of five documents (crc32 of the id), score all."""
    labels = table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = quality_scores(table(spark, sf_dir, "documents"), labels.filter(~held))
    return scored.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), "keep")
