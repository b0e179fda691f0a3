"""Mixing to target weights with soft domain membership.

A naive Bayes classifier, fitted on a bounded sample of a labelled table, gives every document
a posterior over domains from the presence of a short list of telling words and format marks.
Rates (expected copies, 0 or more) are then fitted so that expected domain token totals match
the targets: projected gradient on the whitened least squares (A r - t)' M^-1 (A r - t), where
A is tokens times posterior and M the domains' moment matrix, so a step of 1 is safe. A rate
depends on the posterior alone; posteriors are rounded to GRID, which bounds the table the
iterations run over by the grid, not the corpus. A token here is a blank-separated word.

Documents are measured in one scan; ``mixed`` stores them with their measures, so that applying the
rates takes no second one. No text is shuffled. Texts of any length are measured whole, and rows
that repeat get the same rate. The labelled sample has about TRAIN_ROWS rows, the only thing broadcast. Only built-in expressions run.

Null text has no words: its posterior is that of a document without marks, its weight is 0.
Documents without labels, and labels without documents, are fine; labels with a null id or domain
are ignored. Without any label, or any telling word, every rate is 1. Extra columns pass through.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.quality import SYMBOLS, UPPER
from treeloom.llm.scratch import Scratch

TRAIN_ROWS = 6000
#: Telling words of the classifier, the most telling first.
VOCABULARY = 256
#: A word must be in so many sampled documents.
LEAST_DOCS = 8
GRID = 3
STEPS = 200
#: Share of the targets' sum that totals may miss; a hundredth of it ends the steps where targets are out of reach.
TOLERANCE = 1e-4
#: Expected size of the heaviest target's domain, times what it has.
GROWTH = 1.25
TARGETS = {"good": 0.94, "low": 0.04, "toxic": 0.02}
SEPARATE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATE), "")


def marks(text: Column, words: Column) -> Column:
    """The distinct words of a text, with marks of its format (which hold a blank)."""
    some = lambda name, test: F.when(test, F.array(F.lit(f" {name}"))).otherwise(F.array().cast("array<string>"))
    count = lambda letters: F.length(text) - F.length(F.translate(text, letters, ""))
    return _let(F.array_distinct(words), lambda distinct: F.concat(
        distinct,
        some("symbols", 10 * count(SYMBOLS) > 3 * F.size(words)),
        some("shouting", 2 * count(UPPER) > F.length(text)),
        some("repeating", 3 * F.size(distinct) < F.size(words)),
        some("short", F.size(words) < 20),
    ))


class Mixer:
    """A classifier and the gradient steps that its rates took."""

    def __init__(self, domains: list[str], bias: list[float], weights: dict[str, list[float]]):
        self.domains, self.bias, self.weights, self.steps = domains, bias, weights, []

    def measured(self, text: Column) -> Column:
        """Struct of p, the domains' probabilities rounded to GRID, and n, the words."""
        k = len(self.domains)
        bias = F.array(*[F.lit(float(b)) for b in self.bias])
        names = F.array(*[F.lit(w) for w in self.weights]) if self.weights else None

        def score(words: Column) -> Column:
            if names is None:
                return bias
            table = F.map_from_arrays(names, F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in self.weights.values()]))
            found = F.array_intersect(names, marks(text, words))
            return F.aggregate(found, bias, lambda s, w: F.zip_with(s, F.element_at(table, w), lambda a, b: a + b))

        def softmax(s: Column) -> Column:
            if k == 1:
                return F.array(F.lit(1.0))
            top = F.transform(s, lambda v: F.exp(v - F.array_max(s)))
            return _let(top, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda v: F.round(v / total, GRID))))

        return _let(words_of(text), lambda w: F.struct(_let(score(w), softmax).alias("p"), F.size(w).cast("long").alias("n")))

    def rate(self, p: str = "p") -> Column:
        """The rate of a posterior: every step moves it against the gradient, and not below 0."""
        if not self.steps:
            return F.lit(1.0)
        steps = ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in g) + ")" for g in self.steps)
        along = f"aggregate(zip_with({p}, g, (a, b) -> a * b), 0D, (s, x) -> s + x)"
        return F.expr(f"aggregate(array({steps}), 1D, (r, g) -> greatest(0D, r - {along}))")


def train(docs: DataFrame, labels: DataFrame, domains: list[str], rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> Mixer:
    """Fit the classifier; labels has doc_id and domain."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains)).select(F.col("doc_id").cast("long").alias("_id"), "domain")
    n = known.count()
    draw = F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1 << 30))
    sample = known.where(draw < int(min(1.0, rows / max(1, n)) * (1 << 30))).limit(2 * rows)
    held = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(sample), "_id")  # at most 2 * rows labels
    each = held.select("domain", F.explode(F.array(_let(words_of(F.col("text")), lambda w: marks(F.col("text"), w)))).alias("marks"))
    per = {r["domain"]: r["n"] for r in each.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(per.values())
    if not total:
        return Mixer(domains, [0.0] * len(domains), {})
    count = lambda d: F.sum(F.when(F.col("domain") == d, 1).otherwise(0))
    words = each.select("domain", F.explode("marks").alias("word")).groupBy("word").agg(*[count(d).alias(f"d{k}") for k, d in enumerate(domains)])
    seen = sum((F.col(f"d{k}") for k in range(len(domains))), F.lit(0))
    # How far a word's documents are from its expected share of each domain (chi-squared).
    off = sum((F.pow(F.col(f"d{k}") - seen * (per.get(d, 0) / total), 2) / (seen * max(per.get(d, 0), 1) / total) for k, d in enumerate(domains)), F.lit(0.0))
    best = words.where(seen >= LEAST_DOCS).withColumn("off", off).orderBy(F.desc("off"), "word").limit(VOCABULARY).collect()
    bias = [math.log((per.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    weights = {}
    for r in best:
        p = [(r[f"d{k}"] + 0.5) / (per.get(d, 0) + 1) for k, d in enumerate(domains)]
        weights[r["word"]] = [math.log(x) - math.log(1 - x) for x in p]
        bias = [b + math.log(1 - x) for b, x in zip(bias, p, strict=True)]
    return Mixer(domains, bias, weights)


def measure(docs: DataFrame, mixer: Mixer, text: str = "text") -> DataFrame:
    """docs with p and n. A generator is evaluated once; filters cannot be pushed below it."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select("*", F.explode(F.array(mixer.measured(t))).alias("_m")).select("*", "_m.p", "_m.n").drop("_m")


def fit_rates(measured: DataFrame, mixer: Mixer, targets: dict[str, float], growth: float = GROWTH) -> dict:
    """Take gradient steps until expected domain totals match; returns totals and targets.

    Targets that no rates reach end with the nearest totals; steps that do not settle give a warning
    with the totals that they came to, and the rates of the last.
    """
    scratch = Scratch(measured.sparkSession, "mixing")
    cells = scratch.save(measured.groupBy("p").agg(F.sum("n").alias("n")), "cells")
    k = len(mixer.domains)
    at = lambda i: F.col("p")[i]
    moments = cells.agg(*[F.sum(F.col("n") * at(i)).alias(f"t{i}") for i in range(k)], *[F.sum(F.col("n") * at(i) * at(j)).alias(f"m{i}_{j}") for i in range(k) for j in range(k)]).first()
    have = np.array([moments[f"t{i}"] or 0.0 for i in range(k)])
    share = np.array([targets[d] for d in mixer.domains], float)
    share /= share.sum()
    heavy = int(share.argmax())
    if have[heavy] <= 0:
        return {"have": have.tolist(), "want": have.tolist(), "reached": have.tolist()}
    want = share * growth * have[heavy] / share[heavy]
    moment = np.array([[moments[f"m{i}_{j}"] for j in range(k)] for i in range(k)], float)
    inverse = np.linalg.pinv(moment, rcond=1e-9, hermitian=True)
    reached = have
    for _ in range(STEPS):
        if np.abs(reached - want).max() <= TOLERANCE * want.sum():
            break
        mixer.steps.append((inverse @ (reached - want)).tolist())
        rated = cells.withColumn("r", mixer.rate("p"))
        now = rated.agg(*[F.sum(F.col("n") * at(i) * F.col("r")).alias(f"t{i}") for i in range(k)]).first()
        before, reached = reached, np.array([now[f"t{i}"] for i in range(k)])
        if np.abs(reached - before).max() <= TOLERANCE / 100 * want.sum():
            break
    else:
        warnings.warn(f"the rates did not settle in {STEPS} steps; they reach {reached.tolist()} of {want.tolist()}", stacklevel=2)
    scratch.keep()
    return {"have": have.tolist(), "want": want.tolist(), "reached": reached.tolist()}


def rated(measured: DataFrame, mixer: Mixer, doc_id: str = "doc_id", seed: int = 17) -> DataFrame:
    """measured with rate and copies: the rate's whole part, and one more by its fraction."""
    draw = F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.lit(seed)), F.lit(1 << 30)) / F.lit(1 << 30)
    out = measured.withColumn("rate", mixer.rate("p"))
    return out.withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, mixer: Mixer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document as often as its copies say, with docs' own columns."""
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    out = rated(measure(inside, mixer, "_text"), mixer, "_id").where("copies > 0")
    return out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_doc.*")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fit and mix with one scan of the texts: documents are stored with what was measured of them."""
    targets = targets or TARGETS
    mixer = train(docs, label_domains(labels), list(targets), doc_id=doc_id, text=text)
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    measured = Scratch(docs.sparkSession, "mixing").save(measure(inside, mixer, "_text").drop("_text"), "documents")
    if mixer.weights:
        fit_rates(measured, mixer, targets)
    out = rated(measured, mixer, "_id").where("copies > 0")
    return out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_doc.*")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxic marks."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, doc_id: str = "doc_id") -> tuple[Mixer, DataFrame]:
    """A mixer for docs, and the table (doc_id, p, n) its rates were fitted on."""
    targets = targets or TARGETS
    mixer = train(docs, label_domains(labels), list(targets), doc_id=doc_id)
    measured = Scratch(docs.sparkSession, "mixing").save(measure(docs.select(doc_id, "text"), mixer).select(doc_id, "p", "n"), "measured")
    if mixer.weights:  # nothing tells the domains apart otherwise
        fit_rates(measured, mixer, targets)
    return mixer, measured


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    mixer, measured = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    p = F.col("p")
    return rated(measured, mixer).select("doc_id", *[p[k].alias(f"p_{d}") for k, d in enumerate(mixer.domains)], F.col("n").alias("n_tokens"), "rate", "copies")
