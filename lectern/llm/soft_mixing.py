"""Mixing sources to target weights by soft membership (DataFrame functions only).

A naive Bayes classifier, fitted on labelled documents, gives each document a posterior over domains. Distributed
projected Newton steps then fit one rate to each document, so that the expected tokens of every domain match targets:
minimise the sum over domains of ((sum of rate * tokens * posterior) - target)^2 with rates not below a bound.
"""

from __future__ import annotations

import json
import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, named, packed

BUCKETS = 4096
#: Weight of the rates' own change beside the targets.
RIDGE = 1e-8


def _words(text: Column) -> Column:
    """Lower-case words between ASCII white space."""
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\v\f\r", F.lower(F.coalesce(text, F.lit(""))))
    return F.array_remove(F.split(spaced, " "), "")


def _bucket(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def fit_domains(docs: DataFrame, labelled_ids: DataFrame, domain_col: str, id_col: str, text_col: str, max_labelled: int = 20_000) -> tuple[list[str], list[float], list[list[float]]]:
    """(domains, log priors, log likelihoods by word bucket) from at most ``max_labelled`` labelled documents.

    The documents with the least hashes of their ids are taken. What comes to the driver is a count for each domain and
    bucket. A document with a null domain isn't used.
    """
    ids = labelled_ids.select(named(labelled_ids.columns[0]).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = docs.select(named(id_col).alias("id"), named(domain_col).cast("string").alias("d"), named(text_col).alias("t")).where("d is not null")
    words = rows.join(F.broadcast(ids), "id", "left_semi").select("d", F.explode(_words(F.col("t"))).alias("w"))
    counts = words.groupBy("d", _bucket(F.col("w")).alias("k")).agg(F.count("*").alias("n")).collect()
    domains = sorted({r.d for r in counts})
    if len(domains) > 64:
        raise ValueError(f"{len(domains)} domains; at most 64 can be mixed")
    table = {d: [0] * BUCKETS for d in domains}
    for r in counts:
        table[r.d][r.k] = r.n
    everything = sum(map(sum, table.values())) or 1
    overall = [(sum(table[d][k] for d in domains) + 1) / (everything + BUCKETS) for k in range(BUCKETS)]
    weights = []
    for d in domains:  # smoothed towards the words of all domains
        own = sum(table[d]) + BUCKETS
        weights.append([math.log((table[d][k] + BUCKETS * overall[k]) / own) for k in range(BUCKETS)])
    return domains, [math.log(sum(table[d]) / everything) for d in domains], weights


def posteriors(docs: DataFrame, model: tuple, *keep: str, text: str = "text", temper: float = 0.5) -> DataFrame:
    """Columns ``keep`` of each row, ``h`` (hash of the text), ``tokens`` and ``p0 .. p(K-1)``, in place, without a shuffle.

    Each row's words become bucket numbers once; for each domain after the first, the log likelihoods less those of the
    first are summed over them. The sum is divided by words ** ``temper``, as words of one document aren't independent.
    """
    domains, priors, weights = model
    words = docs.select(*keep, F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.transform(_words(F.col(text)), _bucket).alias("k"))

    def summed(d: int) -> Column:
        # A constant of 4,096 numbers, parsed once, when the plan is optimised. Sums of doubles depend on their order; those
        # of whole millionths don't.
        gain = F.from_json(F.lit(json.dumps([round((x - y) * 1e6) for x, y in zip(weights[d], weights[0])])), "array<bigint>")
        return F.aggregate("k", F.lit(0).cast("long"), lambda total, k: total + F.get(gain, k))

    sums = words.select(*keep, "h", F.size("k").cast("long").alias("tokens"), *(summed(d).alias(f"l{d}") for d in range(1, len(domains))))
    per_word = F.pow(F.greatest(F.lit(1), "tokens"), F.lit(temper))
    logits = sums.select(*keep, "h", "tokens", F.lit(0.0).alias("z0"), *((F.col(f"l{d}") / 1e6 / per_word + (priors[d] - priors[0])).alias(f"z{d}") for d in range(1, len(domains))))
    top = F.greatest(*(F.col(f"z{d}") for d in range(len(domains)))) if len(domains) > 1 else F.col("z0")
    powers = logits.select(*keep, "h", "tokens", *(F.exp(F.col(f"z{d}") - top).alias(f"e{d}") for d in range(len(domains))))
    whole = reduce(lambda a, b: a + b, (F.col(f"e{d}") for d in range(len(domains))))
    return powers.select(*keep, "h", "tokens", *((F.col(f"e{d}") / whole).alias(f"p{d}") for d in range(len(domains))))


def fit_rates(members: DataFrame, shares: list[float], lower: float, tolerance: float = 1e-3, max_steps: int = 60) -> DataFrame:
    """``members`` with a column ``rate``: the projected optimum, by Newton steps on one multiplier for each domain.

    The rates that minimise the squared errors of the domains' tokens, plus ``RIDGE`` times their own squared change (rows
    weighed by tokens), are ``greatest(lower, start + posterior . multiplier)``. Each step is one aggregate over all rows: of
    the domains' tokens and of the K by K matrix of the rows above the bound, by whose inverse the errors are scaled, so
    that a domain small in the input is fitted as fast as a large one. A step that doesn't lessen the convex objective is
    shortened. The total is the least one that needs no domain to shrink: targets are shares of it. It ends when targets
    are met to ``tolerance`` of the total, or at the optimum for targets that differ from these by a tenth of that:
    bounded rates may not reach every target, which is warned of. It raises if neither holds after ``max_steps``.
    """
    k = len(shares)
    p = [F.col(f"p{i}") for i in range(k)]
    have = np.array([float(x or 0) for x in members.agg(*(F.sum(F.col("tokens") * x) for x in p)).first()])
    everything = have.sum()
    if not everything:
        return members.withColumn("rate", F.lit(max(1.0, lower)))
    total = max(h / s for h, s in zip(have, shares) if s > 0) / everything
    target, start, near = np.array(shares) * total, max(lower, total), tolerance * total

    def wanted(at: np.ndarray) -> Column:
        return reduce(lambda a, b: a + b, (x * float(m) for x, m in zip(p, at)), F.lit(float(start)))

    def measure(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Objective, domains' tokens and their derivatives, all over the tokens of the input."""
        rows = members.withColumn("__u", wanted(at)).withColumn("__r", F.greatest(F.lit(float(lower)), "__u"))
        free = F.when(F.col("__u") > lower, F.col("tokens")).otherwise(F.lit(0))
        sums = [F.sum(F.col("tokens") * F.col("__r") * (F.col("__u") - F.col("__r") / 2)), *(F.sum(F.col("tokens") * F.col("__r") * x) for x in p)]
        got = np.array([float(x or 0) for x in rows.agg(*sums, *(F.sum(free * p[i] * p[j]) for i in range(k) for j in range(i, k))).first()]) / everything
        slope = np.zeros((k, k))
        slope[np.triu_indices(k)] = got[k + 1 :]
        return got[0] - target @ at + RIDGE / 2 * at @ at, got[1 : k + 1], slope + np.triu(slope, 1).T

    at = np.zeros(k)
    value, now, slope = measure(at)
    length, moved = 1.0, True
    for _ in range(max_steps):
        error = now - target
        if np.abs(error).max() < near or np.abs(error + RIDGE * at).max() < near / 10:
            break
        if moved:
            step, length = -np.linalg.solve(slope + RIDGE * np.eye(k), error + RIDGE * at), 1.0
        fall = (error + RIDGE * at) @ step
        new = at + length * step
        tried = measure(new)
        moved = tried[0] <= value + 1e-4 * length * fall or np.abs(tried[1] - target + RIDGE * new).max() < 0.5 * np.abs(error + RIDGE * at).max()
        if moved:
            at, (value, now, slope) = new, tried
        else:  # the least of the parabola through both values, within bounds
            length *= min(0.5, max(0.01, -fall * length / (2 * (tried[0] - value - fall * length))))
    else:
        raise RuntimeError(f"rates did not settle in {max_steps} steps; off the targets by up to {np.abs(now - target).max() / total:.3g} of the total")
    if np.abs(now - target).max() >= near:
        warnings.warn(f"rates of {lower} or more can't meet the targets; shares of the total are {np.round(now / now.sum(), 4).tolist()}", stacklevel=2)
    return members.withColumn("rate", F.greatest(F.lit(float(lower)), wanted(at)))


def _rated(packed_docs: DataFrame, model: tuple, targets: dict[str, float], lower: float, *keep: str, **how) -> DataFrame:
    """Columns ``keep`` of rows ``id, text``, with ``h, tokens, domains, posterior, rate, copies_out``."""
    domains = model[0]
    shares = [max(0.0, targets.get(d, 0.0)) for d in domains]
    if sum(shares):
        members = cut(posteriors(packed_docs, model, *keep), "members")
        rated = fit_rates(members, [s / sum(shares) for s in shares], lower, **how)
        posterior = F.array(*(F.col(f"p{i}") for i in range(len(domains))))
    else:
        domains, posterior = [], F.array().cast("array<double>")
        rated = packed_docs.select(*keep, F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.size(_words(F.col("text"))).cast("long").alias("tokens"), F.lit(max(1.0, lower)).alias("rate"))
    chance = F.pmod(F.xxhash64("id", "h", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies_out = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    return rated.select(*keep, "h", "tokens", F.array(*map(F.lit, domains)).cast("array<string>").alias("domains"), posterior.alias("posterior"), "rate", copies_out.alias("copies_out"))


def mix(
    docs: DataFrame, labelled_ids: DataFrame, targets: dict[str, float], domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    lower: float = 1.0, max_labelled: int = 20_000, **how,
) -> DataFrame:
    """One row per document: ``id, h, tokens, domains, posterior, rate, copies_out``.

    ``targets``: a share for each domain, scaled to sum to one; a domain without one gets none, and one that no labelled
    document has is left out. ``lower`` bounds the rates from below: at 1 documents are only repeated, never lost; at 0
    they may go. ``copies_out`` is the rate rounded up or down by a hash of the id and the text, so its mean is the rate.
    ``h`` is the hash of the text. Null text has no words: its posterior is the prior. Rows that repeat id and text get
    equal rates and copies. Null ids are ids like others. No labelled document, or no word in all documents: every rate is
    max(1, lower). An empty table gives no rows. Other columns are not read, and their names are free.
    """
    model = fit_domains(docs, labelled_ids, domain_col, id_col, text_col, max_labelled)
    return _rated(docs.select(named(id_col).alias("id"), named(text_col).alias("text")), model, targets, lower, "id", **how)


def apply_mix(
    docs: DataFrame, labelled_ids: DataFrame, targets: dict[str, float], domain_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    lower: float = 1.0, max_labelled: int = 20_000, **how,
) -> DataFrame:
    """``docs`` with each row as often as :func:`mix` says: rows are written once with their posterior, and not shuffled."""
    model = fit_domains(docs, labelled_ids, domain_col, id_col, text_col, max_labelled)
    rated = _rated(packed(docs, id=named(id_col), text=named(text_col)), model, targets, lower, "row", "id", **how)
    return rated.select("row", F.explode(F.sequence(F.lit(1), F.when(F.col("copies_out") > 0, F.col("copies_out").cast("int")))).alias("again")).select("row.*")
