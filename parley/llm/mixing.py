"""Mixing to target weights with soft membership in domains (operator 4).

Labelled documents teach a naive Bayes classifier on a few measures of the text, each in bins, which
gives every document probabilities of belonging to each domain. Rates r >= 0 of the documents are then
fitted so that the expected tokens of each domain, the sum of r * tokens * probability, meet the
targets: projected-gradient steps on the squared misfit, from r = 1. Each step is one sum over all
documents; the rates themselves follow, row by row, from the steps so far. All of it is DataFrame
functions, and the text is read once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import SPACES, let, stash

#: Shares of tokens wanted of the domains "0" and "1" of the label `quality`.
TARGETS = {"0": 0.1, "1": 0.9}
#: Bins of each measure, and what is added to each count.
BINS = 24
SMOOTH = 0.5
STEPS = 24
#: Distinct words of all words, their length; signs, calls, stops, lines; length of the text.
MEASURES = 7
MAX_RATE = 1.0
#: Without a budget, this share of the largest one that the supply allows.
HEADROOM = 0.95

#: Signs that stand apart from ordinary punctuation (fixed values).
SIGNS = "%*#$&|@~^<>{}[]\\_=+/"


def _shares(text: Column) -> list[Column]:
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(sign: str) -> Column:
        return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))) / n

    return [
        (F.length(text) - F.length(F.translate(text, SIGNS, ""))) / n,
        share("!"),
        share("."),
        share("\n"),
        F.least(F.log10(n) / 6, F.lit(1.0)),
    ]


def bins(text: Column) -> Column:
    """The bin of each measure of a whole text; finer near 0, where most lie."""
    words = F.split(text, r"[\x20\x09-\x0D]+")
    length = F.length(text)
    of_words = let(
        words,
        lambda w: F.array(
            F.size(F.array_distinct(w)) / F.size(w),
            F.least(length / F.size(w) / 20, F.lit(1.0)),
        ),
    )
    return F.transform(
        F.concat(of_words, F.array(*_shares(text))),
        lambda m: F.least(F.greatest(F.floor(F.sqrt(m) * BINS), F.lit(0)), F.lit(BINS - 1)).cast(
            "int"
        ),
    )


def token_count(text: Column) -> Column:
    """Words parted by white space."""
    words = F.split(F.trim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+")
    return F.when(F.trim(text, F.lit(SPACES)) == "", 0).otherwise(F.size(words)).cast("long")


def posteriors(bins: Column, scores: Sequence[Sequence[Sequence[float]]]) -> Column:
    """Probabilities of the domains, from scores by domain, measure and bin."""

    def logs(b: Column) -> Column:
        each = []
        for of_domain in scores:
            parts = [
                F.element_at(F.array(*map(F.lit, of_measure)), b[i] + 1)
                for i, of_measure in enumerate(of_domain)
            ]
            each.append(sum(parts[1:], parts[0]))
        return F.array(*each)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    powers = let(
        let(bins, logs), lambda logs: F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    )
    return let(powers, lambda e: F.transform(e, lambda x: x / total(e)))


def rate(p: Column, steps: Sequence[Sequence[float]], max_rate: float) -> Column:
    """The rate after the steps, each a number for each domain, from 1."""
    if not steps:
        return F.least(F.lit(1.0), F.lit(max_rate))

    def move(r: Column, step: Column) -> Column:
        down = F.aggregate(
            F.zip_with(step, p, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
        )
        return F.least(F.greatest(r - down, F.lit(0.0)), F.lit(max_rate))

    path = F.array(*(F.array(*map(F.lit, s)) for s in steps))
    return F.aggregate(path, F.lit(1.0), move)


def learn(
    featured: DataFrame, labels: DataFrame, domains: Sequence[str], label_col: str
) -> list[list[list[float]]]:
    """Scores by domain, measure and bin, from all labelled documents."""
    known = labels.select(
        F.col("doc_id").alias("_id"), F.col(label_col).cast("string").alias("domain")
    ).filter(F.col("domain").isin(*domains))
    # At most a row for each domain, measure and bin.
    counts = (
        featured.join(known, F.col("doc_id") == F.col("_id"))
        .select("domain", F.posexplode("bins").alias("measure", "bin"))
        .groupBy("domain", "measure", "bin")
        .count()
        .collect()
    )
    found = {(r["domain"], r["measure"], r["bin"]): r["count"] for r in counts}
    number = {d: sum(n for (e, m, _), n in found.items() if (e, m) == (d, 0)) for d in domains}
    whole = sum(number.values())
    out = []
    for d in domains:
        # The share of the domain goes with the first measure.
        prior = math.log((number[d] + SMOOTH) / (whole + SMOOTH * len(domains)))
        out.append(
            [
                [
                    math.log(
                        (found.get((d, m, b), 0) + SMOOTH) / (number[d] + SMOOTH * BINS)
                    )
                    + (prior if m == 0 else 0.0)
                    for b in range(BINS)
                ]
                for m in range(MEASURES)
            ]
        )
    return out


def fit(
    members: DataFrame,
    targets: Mapping[str, float],
    budget: float | None,
    max_rate: float,
    steps: int,
) -> tuple[list[list[float]], dict[str, float]]:
    """The steps of projected gradient on table (`tokens`, `p`), and the targets in tokens.

    Misfits are weighted by the domain's supply, and rates by the tokens of the document: with these
    weights the step of length one is the longest that always descends.
    """
    domains = sorted(targets)
    weights = [targets[d] / sum(targets.values()) for d in domains]

    def totals(r: Column) -> list[float]:
        sums = [
            F.sum(r * F.col("tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(len(domains))
        ]
        return [x or 0.0 for x in members.agg(*sums).first()]

    supply = totals(F.lit(1.0))
    if budget is None:
        shares = [max_rate * s / w for s, w in zip(supply, weights, strict=True) if w > 0]
        budget = HEADROOM * min(shares, default=0.0)
    wanted = [w * budget for w in weights]
    path: list[list[float]] = []
    got = totals(rate(F.col("p"), path, max_rate))
    for _ in range(steps):
        miss = [g - t for g, t in zip(got, wanted, strict=True)]
        if all(abs(m) <= 1e-4 * max(t, 1.0) for m, t in zip(miss, wanted, strict=True)):
            break
        path.append([m / s if s else 0.0 for m, s in zip(miss, supply, strict=True)])
        got = totals(rate(F.col("p"), path, max_rate))
    return path, dict(zip(domains, wanted, strict=True))


def _features(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        token_count(text).alias("tokens"),
        bins(text).alias("bins"),
        F.xxhash64("text").alias("_text"),
    )


def _copies(r: Column, *identity: Column) -> Column:
    """The rate as a whole number, up or down by a number drawn from the document itself."""
    draw = F.shiftrightunsigned(F.xxhash64(*identity, F.lit("mix")), 11) / float(1 << 53)
    return (F.floor(r) + F.when(draw < r - F.floor(r), 1).otherwise(0)).cast("long")


def _fitted(docs, labels, targets, label_col, budget, max_rate, steps):
    domains = sorted(targets)
    featured = stash(_features(docs), "measures")
    scores = learn(featured, labels, domains, label_col)
    members = stash(
        featured.select("doc_id", "tokens", "_text", posteriors(F.col("bins"), scores).alias("p")),
        "members",
    )
    path, wanted = fit(members, targets, budget, max_rate, steps)
    return members, scores, path, wanted


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    label_col: str = "quality",
    budget: float | None = None,
    max_rate: float = MAX_RATE,
    steps: int = STEPS,
) -> DataFrame:
    """Rates with which documents meet the targets.

    One row per row of `docs`: `doc_id`, `tokens` (words parted by white space), `posterior` (a map of
    domain to probability), `rate` (0 to `max_rate`) and `copies`, the rate rounded up or down by a draw from
    id and text. `targets` are shares of tokens by value of `label_col`; without a `budget` in tokens, it is
    close to the largest that the supply allows. Labels of other values, null labels and labels of missing documents
    are ignored; without any labels all domains are as likely. A null text counts as empty and has no tokens.
    Repeated rows and null ids are documents of their own. An empty table gives no rows.
    """
    domains = sorted(targets)
    members, _, path, _ = _fitted(docs, labels, targets, label_col, budget, max_rate, steps)
    r = rate(F.col("p"), path, max_rate)
    return members.withColumn("rate", r).select(
        "doc_id",
        "tokens",
        F.map_from_arrays(F.array(*map(F.lit, domains)), F.col("p")).alias("posterior"),
        "rate",
        _copies(F.col("rate"), F.col("doc_id"), F.col("_text")).alias("copies"),
    )


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float] = TARGETS,
    label_col: str = "quality",
    budget: float | None = None,
    max_rate: float = MAX_RATE,
    steps: int = STEPS,
) -> DataFrame:
    """The rows of `docs`, each as often as `mixing_rates` has copies of it.

    The rates are worked out again from the text of each row, so that nothing is joined.
    """
    _, scores, path, _ = _fitted(docs, labels, targets, label_col, budget, max_rate, steps)
    identity = (F.col("doc_id").cast("long"), F.xxhash64("text"))
    copies = let(
        posteriors(bins(F.coalesce(F.col("text"), F.lit(""))), scores),
        lambda p: let(rate(p, path, max_rate), lambda r: _copies(r, *identity)),
    )
    times = let(
        copies,
        lambda n: F.when(n > 0, F.array_repeat(F.lit(0), n.cast("int"))),
    )
    return docs.withColumn("_copy", F.explode(times)).drop("_copy")
