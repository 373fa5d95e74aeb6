"""Quality classifier: a sparse ensemble of rules.

Statistics of each text are Spark columns. Trees are grown on a bounded sample of labelled
rows; every path from a root to an inner node or leaf becomes a conjunctive rule; a logistic
model under a lasso penalty keeps few of the rules; the kept ones are compiled into one
Spark column expression. Scoring reads each whole text once and runs no Python.

At most ``trees`` * 1.5 trees of ``depth`` give some 200 rules; all of them meet the lasso.

Defined cases: a null text counts as empty and gets a score; rows with a null doc_id are
never learned from; null labels are ignored; with one class or no labelled rows the score is
the smoothed share of label 1 for every row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import free_name, stored

SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Name -> column over one whole text (null: empty). Shares are 0 where there is nothing to divide by."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    words = F.array_remove(F.split(t, r"\s+"), "")
    n_words = F.size(words)
    distinct = F.size(F.array_distinct(words))
    bare = lambda pattern: F.char_length(F.regexp_replace(t, pattern, ""))
    share = lambda x, of: F.when(of > 0, x / of).otherwise(0.0)
    lines = F.regexp_count(t, F.lit("\n")) + 1
    return {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": share(n, n_words),
        "distinct_words": share(distinct, F.sqrt(n_words.cast("double"))),
        "distinct_share": share(distinct, n_words),
        "upper": share(n - bare("[A-ZÀ-Þ]+"), n),
        "digits": share(n - bare("[0-9]+"), n),
        "marks": share(n - bare("[#$%&*|~^=+<>{}\\[\\]\\\\_@/]+"), n),
        "shouts": share(n - bare("[!?]+"), n),
        "stops": share(n - bare("[.,;:]+"), n),
        "line_length": share(n, lines),
        "lines": F.log1p(lines.cast("double")),
        "twice": share(F.regexp_count(t, F.lit(r"(?i)\b(\w+) \1\b")), n_words),
    }


@dataclass
class Rules:
    """Conjunctions of (statistic, above?, threshold) with weights, and an intercept."""

    intercept: float
    terms: list[tuple[float, tuple[tuple[str, bool, float], ...]]] = field(default_factory=list)

    def score(self, of) -> Column:
        """The probability of label 1; ``of`` gives the column of a statistic's name."""
        z = F.lit(self.intercept)
        for weight, tests in self.terms:
            hit = F.lit(True)
            for name, above, cut in tests:
                hit = hit & ((of(name) > cut) if above else (of(name) <= cut))
            z = z + F.when(hit, F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _paths(node, names: list[str], so_far: tuple = ()):
    """Every path of a fitted tree below its root, as tests."""
    if so_far:
        yield so_far
    if node.subtreeDepth() > 0:
        split = node.split()
        name, cut = names[split.featureIndex()], float(split.threshold())
        yield from _paths(node.leftChild(), names, (*so_far, (name, False, cut)))
        yield from _paths(node.rightChild(), names, (*so_far, (name, True, cut)))


def _simplified(tests: tuple) -> tuple:
    """The tightest bound for each statistic and side."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, cut in tests:
        k = (name, above)
        best[k] = cut if k not in best else (max if above else min)(best[k], cut)
    return tuple(sorted((name, above, cut) for (name, above), cut in best.items()))


def fit_rules(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, trees: int = 10,
    depth: int = 3, penalty: float = 0.001,
) -> Rules:
    """Learn from at most ``sample_rows`` rows of ``labels`` (doc_id, label), chosen by a hash of doc_id.

    The label ids are bounded by ``sample_rows``, so they are broadcast to the scan of ``docs``.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
        .orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample_rows)
    )
    names = list(statistics(F.col("text")))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", *[c.alias(k) for k, c in statistics(F.col("text")).items()])
    rows = stored(rows, "statistics").coalesce(4)
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    prior = (ones + 1) / (n + 2)
    flat = Rules(math.log(prior / (1 - prior)))
    if not 0 < ones < n:
        return flat
    x = VectorAssembler(inputCols=names, outputCol="x").transform(rows).select("y", "x", *names).cache()
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird", subsamplingRate=0.7
    ).fit(x)
    boosted = GBTClassifier(featuresCol="x", labelCol="y", maxIter=max(2, trees // 2), maxDepth=depth, seed=7, stepSize=0.3).fit(x)
    found = {_simplified(p): None for m in (forest, boosted) for t in m.trees for p in _paths(t._call_java("rootNode"), names)}
    rules = list(found)
    hits = [
        F.expr(" AND ".join(f"`{name}` {'>' if above else '<='} {cut!r}D" for name, above, cut in tests)).cast("double").alias(f"r{k}")
        for k, tests in enumerate(rules)
    ]
    z = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="z").transform(x.select("y", *hits)).select("y", "z")
    z = z.cache()
    lasso = LogisticRegression(
        featuresCol="z", labelCol="y", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=60
    ).fit(z)
    x.unpersist()
    z.unpersist()
    weights = lasso.coefficients.toArray()
    return Rules(float(lasso.intercept), [(float(w), rules[k]) for k, w in enumerate(weights) if abs(w) > 1e-6])


def with_score(docs: DataFrame, rules: Rules, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` and, last, ``out``, the probability of label 1; where the name is taken it gets a leading underscore."""
    used = {name for _, tests in rules.terms for name, _, _ in tests}
    stats = F.struct(*[c.alias(k) for k, c in statistics(F.col(f"`{text}`")).items() if k in used] or [F.lit(0).alias("none")])
    held, score = free_name(docs, "stats"), free_name(docs, out)
    scored = docs.withColumn(held, stats)
    # the row's number makes the score no function of the row alone: a filter on it stays above the
    # projection, where each statistic is computed once, and isn't pushed down to compute them for every rule
    value = F.when(F.monotonically_increasing_id() >= 0, rules.score(lambda name: F.col(f"`{held}`.{name}")))
    return scored.withColumn(score, value).drop(held)


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = fit_rules(docs, labels.where(~held_out()))
    return with_score(docs.select("doc_id", "text"), rules).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
