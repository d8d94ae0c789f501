"""Mixing sources to target weights with soft memberships, in DataFrame functions alone."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

BUCKETS, TRAIN_ROWS, SMOOTHING, EVIDENCE = 4096, 20_000, 0.5, 60.0
STEPS, CLOSE, KEPT_STEPS = 40, 2e-4, 6
NO_LIMIT = 1e9
SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class DomainModel:
    """Naive Bayes over hashed words: log prior and log word weights of each domain."""

    domains: tuple[str, ...]
    prior: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    evidence: float
    #: Shares of the mixture by domain, as mix() aimed at them and as its rates reach them.
    targets: tuple[float, ...] = ()
    reached: tuple[float, ...] = ()


def _buckets(text: Column, buckets: int) -> Column:
    words = F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, buckets: int = BUCKETS, evidence: float = EVIDENCE) -> DomainModel:
    """A model of the domains in labelled(id, domain), from at most `rows` labelled rows, taken in the order of a hash of the id.

    Only labels of rows in docs count: a domain none of whose texts is there, or
    has a word, is no domain. Rows without a domain are left out; without any,
    there is one domain "all". Of an id's different domains the first by name counts.
    """
    named = labelled.where(F.col("domain").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("domain").alias("domain"))
    sample = named.join(docs.select(id_col), id_col, "left_semi").orderBy(F.xxhash64(id_col), id_col).limit(rows)
    texts = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)  # `rows` rows at most
    counts: dict[str, dict[int, int]] = {}
    each = texts.select("domain", F.explode(_buckets(F.col(text_col), buckets)).alias("b")).groupBy("domain", "b").count()
    for d, b, n in each.collect():  # domains * buckets rows at most
        counts.setdefault(d, {})[b] = n
    sizes = {d: n for d, n in sample.groupBy("domain").count().collect() if d in counts}
    domains = tuple(sorted(sizes)) or ("all",)
    total = sum(sizes.values()) or 1
    weights = []
    for d in domains:
        c = counts.get(d, {})
        whole = math.log(sum(c.values()) + SMOOTHING * buckets)
        weights.append([math.log(c.get(b, 0) + SMOOTHING) - whole for b in range(buckets)])
    mean = [sum(w[b] for w in weights) / len(weights) for b in range(buckets)]
    return DomainModel(domains, tuple(math.log(sizes.get(d, 1) / total) for d in domains), tuple(tuple(round(x - m, 6) for x, m in zip(w, mean)) for w in weights), evidence)


def _looked_up(table: Column) -> Column:
    return F.aggregate("_buckets", F.lit(0.0), lambda acc, b: acc + F.get(table, b))


def with_posteriors(docs: DataFrame, model: DomainModel, text_col: str = "text") -> DataFrame:
    """docs with _tokens, the number of words, and _posterior, the domain probabilities in the model's order.

    Long texts repeat their evidence; beyond `evidence` words it is scaled down
    to that many, which keeps memberships soft. Without words the prior stands.
    """
    rows = docs.select("*", F.explode(F.array(_buckets(F.col(text_col), len(model.weights[0])))).alias("_buckets"))
    rows = rows.withColumn("_tokens", F.size("_buckets").cast("bigint"))
    scale = F.least(F.lit(1.0), F.lit(model.evidence) / F.greatest(F.col("_tokens"), F.lit(1)))
    scores = []
    for prior, weights in zip(model.prior, model.weights):
        table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
        scores.append(F.lit(prior) + scale * _looked_up(table))
    rows = rows.withColumn("_scores", F.explode(F.array(F.array(*scores)))).drop("_buckets")
    raised = F.transform("_scores", lambda s: F.exp(s - F.array_max("_scores")))
    rows = rows.withColumn("_raised", raised)
    whole = F.aggregate("_raised", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("_posterior", F.transform("_raised", lambda x: x / whole)).drop("_scores", "_raised")


def first_rate(low: float | Column, high: float) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    return F.least(F.lit(float(high)), F.greatest(low, F.lit(1.0)))


def rate(posterior: Column, history: list[list[float]], low: float | Column, high: float, start: Column | None = None) -> Column:
    """A document's rate after these steps from `start`: each moves it by its posterior and then back into low..high; low can differ by row."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    start = first_rate(low, high) if start is None else start
    if not history:
        return start
    steps = F.from_json(F.lit(repr(history)), "array<array<double>>")
    k = len(history[0])

    def step(r: Column, residual: Column) -> Column:
        move = sum((F.get(posterior, F.lit(i)) * F.get(residual, F.lit(i)) for i in range(k)), F.lit(0.0))
        return F.greatest(low, F.least(F.lit(float(high)), r - move))

    return F.aggregate(steps, start, step)


def fit(rows: DataFrame, targets: list[float], low: float | Column = 0.0, high: float = NO_LIMIT, steps: int = STEPS) -> tuple[list[list[float]], list[float], list[float]]:
    """(moves of all steps, reached and target shares) of projected-gradient least squares on rows(_tokens, _posterior).

    Minimises the misfit of the expected token shares with every rate in
    low..high. The misfit is weighted by the inverse of the posteriors' second
    moments, and gradients are measured per token: every curvature is then 1, a
    step has length 1, and bounds that don't bind are met in one. A step is one
    aggregate over the table; a document's rate is the fold of its posterior over
    the moves. Every KEPT_STEPS steps the rates so far are written beside the
    posteriors, so that no step folds more than those few moves.
    """
    k = len(targets)
    p = [F.get("_posterior", F.lit(i)) for i in range(k)]
    first = rows.agg(F.sum("_tokens"), *[F.sum(F.col("_tokens") * p[i] * p[j]) for i in range(k) for j in range(k)]).first()
    total = first[0] or 0
    if not total:
        return [], [0.0] * k, targets
    moments = np.array(first[1:], float).reshape(k, k) / total
    inverse = np.linalg.inv(moments + 1e-9 * np.eye(k))
    state = rows.select("_tokens", "_posterior", first_rate(low, high).alias("_r"))
    history: list[list[float]] = []
    kept = 0
    share, last = [], None
    for _ in range(steps):
        if len(history) - kept == KEPT_STEPS:
            state = stored(state.select("_tokens", "_posterior", rate(F.col("_posterior"), history[kept:], low, high, F.col("_r")).alias("_r")), "rates")
            kept = len(history)
        r = rate(F.col("_posterior"), history[kept:], low, high, F.col("_r"))
        got = state.select("_tokens", "_posterior", F.explode(F.array(r)).alias("_now")).agg(*[F.sum(F.col("_tokens") * F.col("_now") * x) for x in p]).first()
        share = [x / total for x in got]
        if max(abs(s - t) for s, t in zip(share, targets)) < CLOSE:
            break
        if last and max(abs(a - b) for a, b in zip(share, last)) < CLOSE / 5:
            break  # the bounds hold it
        last = share
        history.append([float(x) for x in inverse @ (np.array(share) - np.array(targets))])
    return history, share, targets


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", low: float = 0.0, high: float = NO_LIMIT, total: float = 1.0, keep: str | None = None, sure: float = 0.5, nested: bool = False) -> tuple[DataFrame, DomainModel]:
    """(docs with _tokens, _posterior, _rate and _copies, the model with the target and reached shares).

    targets: share of each domain in the mixture; domains without one get 0, and
    the shares of domains that docs hold no labelled text of go to the others in
    proportion. Without labels the mixture is docs, `total` times. Rates lie in
    low..high; a document of domain `keep` with a probability of `sure` at least
    has a rate of one or more.
    `total` is the mixture's size as a multiple of all tokens. A document's
    whole copies are its rate, rounded down or up by a hash of id and text so
    that the expected tokens are met. Null text has no words and the prior as its
    membership; repeated rows get equal rates, and a null or repeated id is no
    matter: each row stands for itself. Extra columns stay, but names that begin
    with an underscore are the operator's; with `nested`, a row stays whole in
    _row, whatever its columns are called. Texts are scored once: the rows are
    written with their posteriors.
    """
    model = train(docs, labelled, id_col, text_col)
    rows = stored(with_posteriors(docs.select(F.struct(*docs.columns).alias("_row")), model, f"_row.{text_col}"), "posteriors")
    aims = [targets.get(d, 0.0) for d in model.domains]
    if model.domains == ("all",) and not sum(aims):
        aims = [1.0]
    elif sum(aims):
        aims = [a * sum(targets.values()) / sum(aims) for a in aims]
    least: float | Column = low
    if keep in model.domains:
        held = F.get("_posterior", F.lit(model.domains.index(keep))) >= sure
        least = F.when(held, F.lit(max(1.0, low))).otherwise(F.lit(float(low)))
    history, shares, _ = fit(rows, [total * a for a in aims], least, high)
    model = replace(model, targets=tuple(aims), reached=tuple(x / (sum(shares) or 1) for x in shares))
    out = rows.withColumn("_rate", rate(F.col("_posterior"), history, least, high))
    chance = F.pmod(F.xxhash64(F.col(f"_row.{id_col}"), F.col(f"_row.{text_col}")), F.lit(1 << 20)) / float(1 << 20)
    out = out.withColumn("_copies", F.floor(F.col("_rate") + chance).cast("int"))
    return out if nested else out.select("_row.*", "_tokens", "_posterior", "_rate", "_copies"), model


def domains_of_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) from the label table: toxic, clean or poor."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "poor")
    return labels.select(id_col, domain.alias("domain"))


TARGETS = {"clean": 0.90, "poor": 0.06, "toxic": 0.04}


def query(spark, sf_dir: str) -> DataFrame:
    """(doc_id, tokens, p_clean, p_poor, p_toxic, rate, copies, reached_clean, reached_poor, reached_toxic): rates that mix the label table's domains to TARGETS at the same number of tokens, and the shares that they reach."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labelled = domains_of_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = train(docs, labelled)
    rows = stored(with_posteriors(docs, model).select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "_tokens", "_posterior"), "posteriors")
    history, shares, _ = fit(rows, [TARGETS.get(d, 0.0) for d in model.domains])
    out = rows.withColumn("rate", rate(F.col("_posterior"), history, 0.0, NO_LIMIT))
    p = {d: F.get("_posterior", F.lit(i)) for i, d in enumerate(model.domains)}
    reached = {d: F.lit(x / (sum(shares) or 1)) for d, x in zip(model.domains, shares)}
    copies = F.floor(F.col("rate") + F.pmod("h", F.lit(1 << 20)) / float(1 << 20)).cast("int")
    return out.select("doc_id", F.col("_tokens").alias("tokens"), *[p.get(d, F.lit(0.0)).alias(f"p_{d}") for d in TARGETS], "rate", copies.alias("copies"), *[reached.get(d, F.lit(0.0)).alias(f"reached_{d}") for d in TARGETS])
