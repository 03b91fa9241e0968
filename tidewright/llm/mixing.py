"""Mixing to target weights by soft membership, in DataFrame operations only.

The labelled table teaches a Gaussian classifier over a few statistics of each
text, one of which counts words that stand in toxic labelled texts far more than
in clean ones; every document gets posteriors of the domains quality x toxicity,
kept to hundredths.  Document rates floor <= r <= ceiling are then fitted so
that the expected domain totals sum(r * tokens * posterior) match the targets:
half the sum of (total - target)^2 / natural total is least.  Of the rates that reach the least,
those nearest to one in the metric that weighs documents by tokens are
1 - posteriors * multipliers, held between floor and ceiling, so Newton steps on
four multipliers find them, with a penalty on the distance that falls through
EASES; each row's rate then follows from its posteriors without a join.  Rates depend on
the posteriors alone, so the steps read the table of distinct posteriors with
their tokens; its size is bounded by the grid of hundredths, not by the corpus,
and every step is one distributed aggregation.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm._learn import labelled_texts, sample_ids
from tidewright.llm._spark import Scratch

#: The domains, as (quality, toxic), and the columns of their posteriors.
DOMAINS = ((0, 0), (0, 1), (1, 0), (1, 1))
POSTERIORS = [f"p_q{q}_t{t}" for q, t in DOMAINS]
FEATURES = ["f_upper", "f_marks", "f_distinct", "f_length", "f_insults"]
#: Labelled ids a domain that the classifier learns from at most, and toxic words at most.
QUOTA, WORDS = 4000, 200
#: A toxic word stands in this many toxic texts and in this share of them at least, and in so many times the share of clean texts.
LEAST_TEXTS, LEAST_SHARE, LIFT = 4, 0.01, 8.0
#: Aggregations of a fit at most; one that needs more is an error.
STEPS = 400
#: The weights of the rates' distance from one in turn, and the projected gradient left at most, as a share of the largest rate.
EASES, TOLERANCE = tuple(10.0**-k for k in range(2, 9)), 1e-7
#: Target shares of a corpus for training: mostly good clean text, some of the rest so that a model has met it.
SHARES = {"p_q1_t0": 0.9, "p_q0_t0": 0.07, "p_q1_t1": 0.02, "p_q0_t1": 0.01}
#: What to keep of each domain where a corpus is thinned and nothing is repeated.
KEPT = {"p_q1_t0": 1.0, "p_q0_t0": 0.5, "p_q1_t1": 0.25, "p_q0_t1": 0.1}


def words_of(text: Column) -> Column:
    """The lower-cased runs of characters other than ASCII white space and stops; a text that begins or ends with those has an empty one there."""
    return F.split(F.lower(text), r"[\x20\x09-\x0D.,;:!?\"()]+")


def toxic_words(texts: DataFrame) -> list[str]:
    """At most WORDS words that tell toxic texts (label 1) from clean ones (0); ``texts`` has doc_id, label and text.

    Of more, those in the most toxic texts, then the first in order.
    """
    words = words_of(F.col("text"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit("")), words).alias("before"), words.alias("word"))
    found = texts.select("doc_id", "label", F.explode(pairs).alias("x")).select("doc_id", "label", "x.before", "x.word").where("word <> ''")
    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count_distinct("doc_id").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    counted = {"in_toxic": (1, "doc_id"), "in_clean": (0, "doc_id"), "places": (1, "before")}
    counts = found.groupBy("word").agg(*[F.count_distinct(F.when(F.col("label") == label, F.col(c))).alias(k) for k, (label, c) in counted.items()])
    counts = counts.where((F.col("in_toxic") >= max(LEAST_TEXTS, LEAST_SHARE * toxic)) & (F.col("in_toxic") * (clean + 1) >= LIFT * (F.col("in_clean") + 1) * toxic))
    # Words of a passage that many texts copy stand behind one and the same word.
    counts = counts.where(F.col("places") * 2 >= F.col("in_toxic"))
    return sorted(r["word"] for r in counts.orderBy(F.desc("in_toxic"), "word").limit(WORDS).collect())


def statistics(docs: DataFrame, id_col: str, text_col: str, insults: list[str], carried: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, text_hash, features) of each row, and the carried columns under their names; a token is a word of words_of()."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.array_remove(words_of(text), "").alias("w"), *carried)
    rows = rows.select("doc_id", "t", F.size("w").alias("n"), F.array_distinct("w").alias("kinds"), *rows.columns[3:])
    n, size = F.col("n").cast("double"), F.length("t").cast("double")
    hits = F.size(F.array_intersect("kinds", F.array(*map(F.lit, insults)))) if insults else F.lit(0)
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_tokens"),
        F.xxhash64("t").alias("text_hash"),
        F.log((F.regexp_count("t", F.lit("[A-Z]")) + 2) / (size + 60)).alias("f_upper"),
        F.log((F.regexp_count("t", F.lit("[!#$%&*|]")) + 0.2) / (size + 60)).alias("f_marks"),
        F.log((F.size("kinds") + 20) / (n + 20)).alias("f_distinct"),
        F.log((size + 120) / (n + 20)).alias("f_length"),
        (F.least(hits, F.lit(2)) / 2.0).alias("f_insults"),
        *rows.columns[4:],
    )


def _domain() -> Column:
    return reduce(lambda e, k: e.when((F.col("quality") == DOMAINS[k][0]) & (F.col("toxic") == DOMAINS[k][1]), k), range(len(DOMAINS)), F.when(F.lit(False), 0))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], dict[int, dict]]:
    """The toxic words, and the counts of labelled ids, means and variances of the statistics by domain.

    Words and moments are those of up to QUOTA ids a domain.  Rows of labels
    with a null id, or null or other values than 0 and 1, teach nothing; an id
    with several labels teaches all of them.
    """
    scratch = Scratch(docs.sparkSession)
    taught = labels.select(F.col(id_col).cast("long").alias("doc_id"), _domain().alias("label")).where("label is not null and doc_id is not null").distinct()
    # Four rows at most.
    counts = dict(tuple(r) for r in taught.groupBy("label").count().collect())
    texts = scratch.write(labelled_texts(docs, sample_ids(taught, "label", QUOTA), id_col, text_col), "taught")
    words = toxic_words(texts.select("doc_id", F.col("label").isin(*[k for k, (_, toxic) in enumerate(DOMAINS) if toxic]).cast("int").alias("label"), "text").where("text is not null"))
    moments = [f(x).alias(f"{f.__name__}_{x}") for x in FEATURES for f in (F.avg, F.var_pop)]
    found = statistics(texts, "doc_id", "text", words, (F.col("label"),)).groupBy("label").agg(*moments).collect()
    return words, {r["label"]: {"n": counts[r["label"]], **r.asDict()} for r in found}


def posteriors(rows: DataFrame, found: dict[int, dict]) -> DataFrame:
    """``rows`` with the columns POSTERIORS, which sum to one.

    A domain that no labelled row has gets 0; without labelled rows all domains
    get the same.
    """
    if not found:
        return rows.select("*", *[F.lit(1 / len(DOMAINS)).alias(p) for p in POSTERIORS])
    logs = []
    for k in range(len(DOMAINS)):
        if r := found.get(k):
            terms = [F.lit(0.0) + float(r["n"])]
            density = F.log(terms[0])
            for x in FEATURES:
                var = float(r[f"var_pop_{x}"]) + 0.01
                density = density - (F.col(x) - float(r[f"avg_{x}"])) ** 2 / (2 * var) - 0.5 * F.log(F.lit(var))
            logs.append(density)
        else:
            logs.append(F.lit(-1e9))
    names = [f"_l{k}" for k in range(len(DOMAINS))]
    rows = rows.select("*", *[e.alias(n) for e, n in zip(logs, names, strict=True)])
    top = F.greatest(*names)
    rows = rows.select("*", *[F.exp(F.col(n) - top).alias(f"_e{k}") for k, n in enumerate(names)])
    total = reduce(Column.__add__, [F.col(f"_e{k}") for k in range(len(DOMAINS))])
    # Hundredths by the largest domain taking what rounding leaves.
    low = [F.floor(F.col(f"_e{k}") / total * 100).cast("int") for k in range(len(DOMAINS))]
    rows = rows.select("*", *[e.alias(f"_h{k}") for k, e in enumerate(low)])
    left = 100 - reduce(Column.__add__, [F.col(f"_h{k}") for k in range(len(DOMAINS))])
    best = reduce(lambda e, k: e.when(F.col(names[k]) == top, k), range(len(DOMAINS)), F.when(F.lit(False), 0))
    out = [((F.col(f"_h{k}") + F.when(best == k, left).otherwise(0)) / 100).alias(p) for k, p in enumerate(POSTERIORS)]
    return rows.select(*[c for c in rows.columns if not c.startswith(("_l", "_e", "_h"))], *out)


def _start(floor: float, ceiling: float | None) -> float:
    return max(1.0, floor) if ceiling is None else min(max(1.0, floor), ceiling)


def _held(z: Column, floor: float, ceiling: float | None) -> Column:
    low = F.greatest(F.lit(float(floor)), z)
    return low if ceiling is None else F.least(F.lit(float(ceiling)), low)


def rate(multipliers: np.ndarray, floor: float, ceiling: float | None) -> Column:
    """The rate of a row with POSTERIORS."""
    dot = reduce(Column.__add__, [F.col(p) * float(m) for p, m in zip(POSTERIORS, multipliers, strict=True)])
    return _held(F.lit(float(_start(floor, ceiling))) - dot, floor, ceiling)


def _dot(numbers: np.ndarray) -> Column:
    """The product of POSTERIORS and numbers, as data rather than code: the steps of a fit then share their generated classes."""
    pairs = F.zip_with(F.array(*POSTERIORS), F.array(*[F.lit(float(x)) for x in numbers]), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)


def solve(cells: DataFrame, targets: list[float], floor: float, ceiling: float | None = None, steps: int = STEPS) -> np.ndarray:
    """The multipliers of the least-squares rates of ``cells`` (POSTERIORS and tokens) that are nearest to one, or to the bound nearest to one.

    An ArithmeticError tells of a fit whose projected gradient is above
    TOLERANCE after ``steps`` aggregations.  Cells without tokens, and domains
    without any, decide nothing; cells with equal posteriors get equal rates.
    """
    low, high, k = float(floor), float("inf") if ceiling is None else float(ceiling), len(POSTERIORS)
    if low > high:
        raise ValueError("the floor is above the ceiling")
    start = _start(low, ceiling)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    want, left = np.array(targets, float), steps

    def totals(multipliers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """The domains' totals, their slopes by the multipliers, the integral of the rates, and the largest rate."""
        nonlocal left
        if (left := left - 1) < 0:
            raise ArithmeticError(f"rates of the mix haven't converged in {steps} steps")
        rows = cells.withColumn("z", F.lit(start) - _dot(multipliers)).withColumn("r", _held(F.col("z"), low, ceiling))
        rows = rows.withColumn("m", F.col("tokens") * F.col("r")).withColumn("a", F.when((F.col("z") >= low) & (F.col("z") <= high), F.col("tokens")).otherwise(0.0))
        integral = F.when(F.col("z") == F.col("r"), F.col("z") * F.col("z") / 2).otherwise((F.col("z") - F.col("r") / 2) * F.col("r")) * F.col("tokens")
        sums = [*(F.col("m") * F.col(p) for p in POSTERIORS), *(F.col("a") * F.col(POSTERIORS[i]) * F.col(POSTERIORS[j]) for i, j in upper), integral]
        out = np.array(list(rows.agg(*[F.coalesce(F.sum(x), F.lit(0.0)) for x in sums], F.coalesce(F.max("r"), F.lit(low))).first()), float)
        slopes = np.zeros((k, k))
        for (i, j), x in zip(upper, out[k:-2], strict=True):
            slopes[i, j] = slopes[j, i] = x
        return out[:k], slopes, out[-2], out[-1]

    natural = np.array(list(cells.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col(p)), F.lit(0.0)) for p in POSTERIORS]).first()), float)
    scale = np.where(natural > 0, natural, 1.0)
    at = np.zeros(k)
    now = totals(at)
    for ease in EASES if (abs(now[0] - want) / scale).max() > TOLERANCE else ():
        while True:
            slope = want - now[0] + ease * scale * at
            if (abs(slope) / scale).max() < TOLERANCE / 10 * max(1.0, now[3]):
                break
            curve = now[1] + ease * np.diag(scale)
            size = np.sqrt(np.diag(curve))
            step = -np.linalg.solve(curve / np.outer(size, size), slope / size) / size
            value = now[2] + want @ at + ease / 2 * (scale * at * at).sum()
            for _ in range(25):
                new = totals(at + step)
                if new[2] + want @ (at + step) + ease / 2 * (scale * (at + step) ** 2).sum() <= value + 1e-4 * slope @ step + 1e-12 * abs(value):
                    break
                step = step / 2
            else:
                break  # as near as doubles go; the projected gradient decides
            at, now = at + step, new
    slope = np.where(natural > 0, (now[0] - want) / scale, 0.0)
    rows = cells.withColumn("r", _held(F.lit(start) - _dot(at), low, ceiling))
    move = F.abs(F.col("r") - _held(F.col("r") - _dot(slope), low, ceiling))
    far, most = rows.agg(F.max(move), F.max("r")).first()
    if far is not None and far > TOLERANCE * max(1.0, most):
        raise ArithmeticError(f"rates of the mix have a projected gradient of {far:.3g}")
    return at


def fit_rates(cells: DataFrame, targets: list[float], floor: float = 0.0, ceiling: float | None = None, steps: int = STEPS) -> DataFrame:
    """``cells`` with their rate."""
    return cells.withColumn("rate", rate(solve(cells, targets, floor, ceiling, steps), floor, ceiling))


def _copies() -> Column:
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text_hash"), F.lit(1 << 30)) / float(1 << 30)
    return F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("long")


def targets_of(natural: list[float], shares: dict[str, float] | None, kept: dict[str, float] | None, tokens: float | None) -> list[float]:
    """The domains' target totals, from shares of a total or from multiples of the natural totals; all else stays as it is."""
    if kept is not None:
        return [n * max(0.0, float(kept.get(p, 1.0))) for p, n in zip(POSTERIORS, natural, strict=True)]
    want = [max(0.0, float(shares.get(p, 0))) if n > 0 else 0.0 for p, n in zip(POSTERIORS, natural, strict=True)] if shares else list(natural)
    total = sum(natural) if tokens is None else float(tokens)
    return [w / (sum(want) or 1) * total for w in want]


def _rated(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, shares: dict[str, float] | None, kept: dict[str, float] | None, tokens: float | None, floor: float, ceiling: float | None, carried: tuple[Column, ...] = ()) -> DataFrame:
    """Every row's posteriors, rate and copies, and the carried columns."""
    scratch = Scratch(docs.sparkSession)
    words, found = learn(docs, labels, id_col, text_col)
    rows = scratch.write(posteriors(statistics(docs, id_col, text_col, words, carried), found).drop(*FEATURES), "posteriors")
    # At most one row for each point of the grid of hundredths.
    cells = scratch.write(rows.groupBy(*POSTERIORS).agg(F.sum("n_tokens").cast("double").alias("tokens")).repartition(1), "cells")
    natural = [x or 0.0 for x in cells.agg(*[F.sum(F.col("tokens") * F.col(p)) for p in POSTERIORS]).first()]
    multipliers = solve(cells, targets_of(natural, shares, kept, tokens), floor, ceiling)
    return rows.withColumn("rate", rate(multipliers, floor, ceiling)).withColumn("copies", _copies())


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", shares: dict[str, float] | None = None, kept: dict[str, float] | None = None, tokens: float | None = None, floor: float = 0.0, ceiling: float | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, the four posteriors, rate, copies.

    ``shares`` are the domains' target shares by posterior column (normalised;
    missing ones and those of domains that no text belongs to are 0), of
    ``tokens`` in total, by default the corpus's; ``kept`` instead gives targets
    as multiples of the natural totals (1 where missing).  With neither, rates
    are 1.  Where targets can't be met - domains that the classifier can't tell
    apart, or the bounds - the fit is the nearest; report() tells how near.
    copies is the rate rounded up or down by a hash of the id and the text, so
    that its expectation is the rate.

    Null and empty texts have no tokens and take the rate of their posteriors.
    Rows that repeat an id and a text are rounded alike; null ids are an id.  An
    empty table gives an empty result.  Other columns are not read.
    """
    rows = _rated(docs, labels, id_col, text_col, shares, kept, tokens, floor, ceiling)
    return rows.select("doc_id", "n_tokens", *POSTERIORS, "rate", "copies")


def report(mixed: DataFrame) -> DataFrame:
    """One row a domain of a result of mix(): domain, natural and expected total of tokens, and its expected share."""
    rows = mixed.select(F.explode(F.array(*[F.struct(F.lit(p).alias("domain"), (F.col("n_tokens") * F.col(p)).alias("natural"), (F.col("n_tokens") * F.col(p) * F.col("rate")).alias("expected")) for p in POSTERIORS])).alias("x"))
    out = rows.groupBy("x.domain").agg(F.sum("x.natural").alias("natural"), F.sum("x.expected").alias("expected"))
    total = out.agg(F.sum("expected").alias("total"))
    return out.join(F.broadcast(total)).select("domain", "natural", "expected", F.try_divide("expected", "total").alias("share"))


def apply_mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", shares: dict[str, float] | None = None, kept: dict[str, float] | None = None, tokens: float | None = None, floor: float = 0.0, ceiling: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the copies that mix() gives it.

    Rows are written once beside their statistics, so that neither a join nor a
    second reading of texts is needed to apply their rates.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _rated(docs, labels, id_col, text_col, shares, kept, tokens, floor, ceiling, (row,)).where("copies > 0")
    if ceiling is not None and ceiling <= 1:
        return rows.select("row.*")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
