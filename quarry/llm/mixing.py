"""Mixing to target weights with soft membership, in DataFrame operations only.

Domains are the values of a label column of a labelled table. A Gaussian naive Bayes classifier over a few text
measures, fitted with one aggregation on all labelled rows, gives every document a posterior for each domain. Then
document rates between a floor and a ceiling are fitted so that the expected tokens of each domain, the sum over documents of
r * tokens * posterior, match the targets in the least-squares sense.

The fit is projected gradient descent. Each step needs two aggregations over the narrow table of tokens and
posteriors; only a few sums reach the driver. Steps are scaled by the domains' shared tokens over the documents that
are free to move; of several lengths of that step and of a plain gradient step the one with the least squared gap is
taken, so every step gains. The fit ends when the targets are met, a plain step could not close a tenth of `close`,
or no step gains a millionth of the squared gap.
Every few steps the rates are written to a table, so no expression grows; a document's final rate is the fold of all
steps over its posteriors.

A rate becomes copies: its integer part, and one more if a hash of the row falls below the fraction, so expected
totals are kept and the result is reproducible.

Defined results: null and blank texts have no tokens and get rates like others with the same posteriors; without
labelled rows, or with those of one domain only, posteriors are the domains' smoothed shares; a domain with a single
labelled row borrows the others' variances, one without any counts as an average of all; labels of unlisted or null value
are not learned from; a fit that leaves a target unmet, whatever ends it, warns with the gap; repeated rows get equal rates; extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import logging
import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, packed, saved, saved_at, split_words

MEASURES = ("log_words", "symbol_share", "word_length", "distinct_share", "repeat_share")
SYMBOLS = "#*$%&|<>"
log = logging.getLogger(__name__)
#: A step that lessens the squared gap by less than this share ends the fit.
LEAST_GAIN = 1e-6
#: Steps of the fit between two writes of the rates.
SAVE_EVERY = 8


def measured(docs: DataFrame, text: Column) -> DataFrame:
    """`docs` with _tokens and the measures of the text, columns prefixed by an underscore."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    base = docs.withColumn("_text", text).withColumns({"_words": split_words(F.col("_text")), "_lines": lines})
    counted = base.withColumns(
        {
            "_tokens": F.size("_words").cast("long"),
            "_distinct": F.size(F.array_distinct("_words")),
            "_n_lines": F.size("_lines"),
            "_n_distinct_lines": F.size(F.array_distinct("_lines")),
            "_chars": F.length("_text"),
            "_word_chars": F.length(F.array_join("_words", "")),
            "_symbols": F.length("_text") - F.length(F.translate("_text", SYMBOLS, "")),
        }
    ).drop("_text", "_words", "_lines")
    some = F.greatest(F.col("_tokens"), F.lit(1))
    return counted.withColumns(
        {
            "_log_words": F.log1p(F.col("_tokens").cast("double")),
            "_symbol_share": F.sqrt(F.col("_symbols") / F.greatest(F.col("_chars"), F.lit(1))),
            "_word_length": F.col("_word_chars") / some,
            "_distinct_share": F.col("_distinct") / some,
            "_repeat_share": 1 - F.col("_n_distinct_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        }
    ).drop("_distinct", "_n_lines", "_n_distinct_lines", "_chars", "_word_chars", "_symbols")


def classifier(rows: DataFrame, labels: DataFrame, label: str, domains: list) -> list[dict]:
    """Share, means and variances of the measures for each domain, over all labelled rows.

    A domain with one labelled row has its means and the variances that domains have on average; one without any has the means
    and variances of all labelled rows. With rows of no domain or of one alone nothing can be told apart, and `known` is false.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).alias("_domain")).where(
        F.col("_domain").isin(domains)
    )
    numbers = [F.avg("_" + m).alias("mean_" + m) for m in MEASURES] + [F.var_pop("_" + m).alias("var_" + m) for m in MEASURES]
    found = {
        r["_domain"]: r.asDict()
        for r in rows.join(known, rows["_doc_id"] == known["_id"]).groupBy("_domain").agg(F.count("*").alias("n"), *numbers).collect()
    }
    total = sum(r["n"] for r in found.values())

    def pooled(value) -> list[float]:  # noqa: ANN001
        return [sum(r["n"] * value(r, m) for r in found.values()) / max(total, 1) for m in MEASURES]

    middle = pooled(lambda r, m: r["mean_" + m])
    inner = pooled(lambda r, m: r["var_" + m])
    outer = pooled(lambda r, m: r["mean_" + m] ** 2)
    overall = [v + o - x * x for v, o, x in zip(inner, outer, middle, strict=True)]
    out = []
    for d in domains:
        r = found.get(d)
        means = [r["mean_" + m] for m in MEASURES] if r else middle
        variances = overall if not r else inner if r["n"] == 1 else [r["var_" + m] for m in MEASURES]
        share = ((r["n"] if r else 0) + 1) / (total + len(domains))
        out.append({"domain": d, "share": share, "means": means, "variances": variances, "known": len(found) > 1})
    return out


def posteriors(model: list[dict], least_variance: float = 1e-4) -> list[Column]:
    """A column for each domain: its posterior, from the measures; the shares alone if these tell nothing apart."""
    fitted = all(d["known"] for d in model)
    logs = []
    for d in model:
        log = F.lit(math.log(d["share"]))
        for m, mean, variance in zip(MEASURES, d["means"], d["variances"], strict=True):
            if fitted:
                v = variance + least_variance
                log = log - (F.col("_" + m) - mean) * (F.col("_" + m) - mean) / (2 * v) - 0.5 * math.log(v)
        logs.append(log)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    powers = [F.exp(x - top) for x in logs]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def stepped(rate: Column, moves: list[np.ndarray], floor: float, ceiling: float = math.inf) -> Column:
    """The rate after all moves, each with the floor and the ceiling as its bounds, as a fold.

    The moves are a constant array and no part of generated code, so one compiled class serves every step.
    """
    if not moves:
        return rate
    k = len(moves[0])
    values = F.split(F.lit(",".join(repr(float(x)) for m in moves for x in m)), ",").cast("array<double>")
    push = lambda i: functools.reduce(lambda x, y: x + y, [F.col(f"_p{j}") * F.get(values, i + j) for j in range(k)])
    each = F.sequence(F.lit(0), F.lit(k * (len(moves) - 1)), F.lit(k))
    most = (lambda r: r) if math.isinf(ceiling) else (lambda r: F.least(F.lit(float(ceiling)), r))
    return F.aggregate(each, rate, lambda r, i: F.greatest(F.lit(float(floor)), most(r - push(i))))


def fitted_rates(rows: DataFrame, targets: list[float], floor: float, steps: int, close: float, ceiling: float = math.inf) -> Column:
    """The rate as an expression of _p0, _p1, ... when the fit has converged; one that ends with a gap warns."""
    k, goal = len(targets), np.array(targets, float)
    names = [f"_p{i}" for i in range(k)]

    def sums(rows: DataFrame, columns: list[Column]) -> np.ndarray:
        return np.array([float(x or 0.0) for x in rows.agg(*[F.sum(c) for c in columns]).first()])

    def spent(rate: Column) -> list[Column]:
        return [rate * F.col("_tokens") * F.col(n) for n in names]

    start = F.lit(min(max(1.0, float(floor)), ceiling))
    both = [F.col("_tokens") * F.col(f"_p{i}") * F.col(f"_p{j}") for i in range(k) for j in range(k)]
    rate, path = start, None
    moves: list[np.ndarray] = []
    pending: list[np.ndarray] = []
    found = sums(rows, [*spent(start), *both])
    gap = found[:k] - goal
    steepest = float(np.linalg.eigvalsh(found[k:].reshape(k, k))[-1])
    size = max(1.0, float(np.abs(goal).max()))
    while np.abs(gap).max() > close * size:
        if len(moves) == steps:
            warnings.warn(f"mixing: {steps} steps did not converge, gap {np.abs(gap).max() / size:.6f} of the largest target", stacklevel=2)
            break
        now = rows.withColumn("_now", stepped(rate, pending, floor, ceiling))
        now = now.withColumn("_apart", F.col("_now") - stepped(F.col("_now"), [gap / steepest], floor, ceiling))
        free = F.col("_apart") != 0
        *shared, reach = sums(now, [*[F.when(free, x) for x in both], F.col("_tokens") * F.col("_apart") * F.col("_apart")])
        if np.sqrt(steepest * reach) <= 0.1 * close * size:  # what a plain step can still close
            warnings.warn(f"mixing: floor and ceiling leave a gap of {np.abs(gap).max() / size:.6f} of the largest target", stacklevel=2)
            break
        shared = np.array(shared).reshape(k, k)
        newton = np.linalg.lstsq(shared + 1e-9 * np.trace(shared) * np.eye(k), gap, rcond=None)[0]
        plain = gap / steepest
        # Long steps take rates to their bounds at once; the last, a plain step, always lessens the loss.
        tried = [newton * x for x in (4, 1, 0.5, 0.25, 1 / 16)] + [plain * x for x in (4096, 64, 1)]
        trials = now.select("*", *[stepped(F.col("_now"), [m], floor, ceiling).alias(f"_r{i}") for i, m in enumerate(tried)])
        totals = sums(trials, [x for i in range(len(tried)) for x in spent(F.col(f"_r{i}"))])
        gaps = totals.reshape(len(tried), k) - goal
        losses = (gaps * gaps).sum(axis=1)
        best = int(losses.argmin())
        if losses[best] >= (1 - LEAST_GAIN) * (gap @ gap):  # the bounds hold the rates; hardly more than rounding is left
            warnings.warn(f"mixing: no step closes the gap of {np.abs(gap).max() / size:.6f} of the largest target", stacklevel=2)
            break
        moves.append(tried[best])
        pending.append(moves[-1])
        gap = gaps[best]
        log.info("mixing: step %d, trial %d, gap %s of the largest target", len(moves), best, (gap / size).round(7).tolist())
        if len(pending) == SAVE_EVERY:
            spark, old = rows.sparkSession, path
            rows, path = saved_at(rows.select("_tokens", *names, stepped(rate, pending, floor, ceiling).alias("_rate")), "mixing-rates")
            rate, pending = F.col("_rate"), []
            if old:
                discard(spark, old)
    if path:
        discard(rows.sparkSession, path)
    reached = gap + goal
    log.info("mixing: %d steps, token shares reached %s, aimed at %s", len(moves), *(np.round(x / max(1.0, x.sum()), 6).tolist() for x in (reached, goal)))
    return stepped(start, moves, floor, ceiling)


@dataclass
class Fit:
    """The measured documents (narrow), and the posteriors and the rate as expressions of their measures."""

    narrow: DataFrame
    posteriors: dict[str, Column]
    rate: Column


def fit_rates(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict,
    label: str = "quality",
    floor: float = 0.0,
    total_tokens: float | None = None,
    steps: int = 40,
    close: float = 1e-4,
    ceiling: float = math.inf,
) -> Fit:
    """Measure every document once, learn the posteriors and fit the rates.

    The targets are `weights` (by domain, summing to one) times `total_tokens`; by default as many tokens as there
    are, or, with a positive floor, as many as let every domain keep its tokens times the floor.
    """
    domains = sorted(weights)
    slim = docs.select(F.col("doc_id").cast("long").alias("_doc_id"), unit(F.col("doc_id"), F.col("text")).alias("_unit"), F.col("text").alias("_t"))
    narrow = saved(measured(slim, F.col("_t")).drop("_t"), "mixing-measures")
    model = classifier(narrow, labels, label, domains)
    names = {f"_p{i}": p for i, p in enumerate(posteriors(model))}
    rows, path = saved_at(narrow.select("_tokens", *[p.alias(n) for n, p in names.items()]), "mixing-posteriors")
    if total_tokens is None:
        sums = [float(x or 0.0) for x in rows.agg(*[F.sum(F.col("_tokens") * F.col(n)) for n in names]).first()]
        total_tokens = max([sum(sums), *(floor * s / weights[d] for s, d in zip(sums, domains, strict=True) if weights[d] > 0)])
    rate = fitted_rates(rows, [weights[d] * total_tokens for d in domains], floor, steps, close, ceiling)
    discard(docs.sparkSession, path)
    return Fit(narrow, names, rate)


def unit(doc_id: Column, text: Column) -> Column:
    """A number from 0 to 1 that depends on the row alone."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, text), 11) / F.lit(float(1 << 53))


def rated(rows: DataFrame, fit: Fit) -> DataFrame:
    """`rows`, which carry measures and _unit, with posteriors, _rate and _copies.

    The explode of one struct keeps Spark from evaluating the measures again in every step of the rate's fold.
    """
    once = rows.select("*", F.explode(F.array(F.struct(*[p.alias(n) for n, p in fit.posteriors.items()]))).alias("_posteriors"))
    out = once.select("*", *[F.col("_posteriors")[n].alias(n) for n in fit.posteriors]).withColumn("_rate", fit.rate)
    copies = F.floor("_rate") + (F.col("_unit") < F.col("_rate") - F.floor("_rate")).cast("long")
    return out.withColumn("_copies", copies.cast("long"))


def document_rates(docs: DataFrame, labels: DataFrame, weights: dict, **options: object) -> DataFrame:
    """doc_id, tokens, a posterior for each domain (p_<domain>), rate and copies for every row of `docs`; see fit_rates."""
    fit = fit_rates(docs, labels, weights, **options)
    return rated(fit.narrow, fit).select(
        F.col("_doc_id").alias("doc_id"),
        F.col("_tokens").alias("tokens"),
        *[F.round(n, 6).alias(f"p_{d}") for n, d in zip(fit.posteriors, sorted(weights), strict=True)],
        F.round("_rate", 6).alias("rate"),
        F.col("_copies").alias("copies"),
    )


def token_shares(rates: DataFrame, domains: list) -> DataFrame:
    """The domains' expected tokens and shares of them after copying: domain, tokens, share."""
    one = lambda d: F.struct(F.lit(str(d)).alias("domain"), F.col(f"t_{d}").alias("tokens"), F.try_divide(F.col(f"t_{d}"), F.col("all")).alias("share"))
    sums = rates.agg(*[F.coalesce(F.sum(F.col("copies") * F.col("tokens") * F.col(f"p_{d}")), F.lit(0.0)).alias(f"t_{d}") for d in domains])
    total = functools.reduce(lambda x, y: x + y, [F.col(f"t_{d}") for d in domains])
    return sums.withColumn("all", total).select(F.explode(F.array(*[one(d) for d in domains])).alias("x")).select("x.*")


def mix_documents(docs: DataFrame, labels: DataFrame, weights: dict, label: str = "quality", floor: float = 1.0, ceiling: float = 4.0) -> DataFrame:
    """The rows of `docs`, each as often as its copies say.

    With a floor of one every row stays at least once; no row is repeated more than `ceiling` times (epochs), which
    can leave a target unreached. The documents are measured a second time here, as a join of the rates with the
    texts would shuffle all texts.
    """
    fit = fit_rates(docs, labels, weights, label=label, floor=floor, ceiling=ceiling)
    rows = docs.select(packed(docs), unit(F.col("doc_id"), F.col("text")).alias("_unit"))
    many = rated(measured(rows, F.col("row.text")), fit).where("_copies > 0")
    return many.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")
