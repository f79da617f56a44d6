"""Quality classifier: a sparse rule ensemble (trees -> rules -> lasso logistic -> columns).

1. Text statistics are built-in column expressions.
2. A bounded sample of labelled rows (``most_labelled``, taken by a hash of the id, the
   only part of the table that is sampled) comes to the driver as numbers.
3. Small boosted trees grow on it in numpy; every path from a root is a conjunctive rule.
4. An L1 logistic regression over the rules (proximal gradient) keeps a few of them.
5. The kept rules compile into one Spark expression, so scoring is a scan with projections.

Defined cases: null and empty texts have all statistics 0 and the score these give; null
labels do not train; without labelled rows, or with one class only, the score is the
smoothed share of label 1.  Repeated labels of one id each count, repeated rows are scored one by one.
Other columns pass through unless they are named held_out, score or predicted, which the result replaces; inner
columns take names that the caller's do not have.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, words

MOST_LABELLED = 20_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"


def statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """Add the statistics as columns, and a row number; returns the names of all, the row number's last."""
    body = F.coalesce(F.col(text), F.lit(""))
    _t, _w = fresh(docs.columns, "text", "words")
    out = docs.withColumn(_t, body).withColumn(_w, words(text))
    count = lambda chars: F.length(_t) - F.length(F.translate(_t, chars, ""))
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    n, chars = F.size(_w), F.length(_t)
    twice = F.size(F.filter(_w, lambda w, i: w == F.get(_w, i - 1)))
    stats = {
        "s_words": n.cast("double"),
        "s_word_chars": per(chars, n),
        "s_distinct": per(F.size(F.array_distinct(_w)), n),
        "s_twice": per(twice, n),
        "s_upper": per(count(UPPER), chars),
        "s_digits": per(count(DIGITS), chars),
        "s_symbols": per(count("#*$%&<>@^~_=+\\"), n),
        "s_pipes": per(count("|"), n),
        "s_marks": per(count("!?"), n),
        "s_stops": per(count(".,;:"), n),
        "s_lines": per(count("\n"), n),
    }
    names = fresh(docs.columns, *stats, "row")
    values = [F.round(v.cast("double"), 6) for v in stats.values()]
    return out.withColumns(dict(zip(names, [*values, F.monotonically_increasing_id()]))).drop(_t, _w), names


def grow(x: np.ndarray, gradient: np.ndarray, depth: int, least: int, cuts: list[np.ndarray]) -> list:
    """A regression tree by squared error: nested (feature, cut, left, right) or None; cuts: candidates per feature."""

    def node(rows: np.ndarray, d: int):
        g = gradient[rows]
        if d == 0 or len(rows) < 2 * least:
            return None
        best, total = (1e-9, None, None), g.sum() ** 2 / len(rows)
        for f, at in enumerate(cuts):
            if not len(at):
                continue
            bins = np.searchsorted(at, x[rows, f], side="left")
            k, s = np.cumsum(np.bincount(bins, minlength=len(at) + 1))[:-1], np.cumsum(np.bincount(bins, weights=g, minlength=len(at) + 1))[:-1]
            ok = (k >= least) & (len(rows) - k >= least)
            gain = np.where(ok, s**2 / np.maximum(k, 1) + (g.sum() - s) ** 2 / np.maximum(len(rows) - k, 1) - total, 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, at[gain.argmax()])
        if best[1] is None:
            return None
        low = x[rows, best[1]] <= best[2]
        return best[1], float(best[2]), node(rows[low], d - 1), node(rows[~low], d - 1)

    return node(np.arange(len(x)), depth)


def paths(tree, so_far=()) -> list[tuple]:
    """Every node but the root as a conjunction of (feature, cut, is it the lower side)."""
    if tree is None:
        return []
    f, cut, low, high = tree
    a, b = (*so_far, (f, cut, True)), (*so_far, (f, cut, False))
    return [a, b, *paths(low, a), *paths(high, b)]


def fires(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, cut, low in rule:
        out &= (x[:, f] <= cut) if low else (x[:, f] > cut)
    return out


def value(tree, x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """Newton step of each leaf."""
    out = np.zeros(len(x))

    def fill(node, rows):
        if node is None:
            out[rows] = gradient[rows].sum() / (hessian[rows].sum() + 1.0)
            return
        low = x[rows, node[0]] <= node[1]
        fill(node[2], rows[low])
        fill(node[3], rows[~low])

    fill(tree, np.arange(len(x)))
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1 logistic weights by accelerated proximal gradient; the intercept goes free."""
    n, k = z.shape
    zf = z.astype(np.float64)
    step = 4.0 * n / (max(1.0, np.linalg.norm(zf, 2) ** 2) + n)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-(zf @ v + c))) - y
        w2 = v - step * (zf.T @ miss) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * miss.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4, penalty: float = 5e-4, seed: int = 7) -> dict:
    """Rules with weights: {"rules": [(rule, weight)], "bias": float}."""
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return {"rules": [], "bias": bias}
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 64))) for f in range(x.shape[1])]
    least = max(3, len(y) // 1000)
    score, rules = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = rng.random(len(y)) < 0.7
        tree = grow(x[rows], (y - p)[rows], depth, least, cuts)
        if tree is None:
            continue
        rules += paths(tree)
        score += rate * value(tree, x, y - p, p * (1 - p))
    rules = list(dict.fromkeys(rules))
    z = np.stack([fires(r, x) for r in rules], axis=1) if rules else np.zeros((len(y), 0), dtype=bool)
    keep: dict[bytes, int] = {}
    for i in range(z.shape[1]):  # one of the rules that fire on the same rows
        if 0 < z[:, i].sum() < len(y):
            keep.setdefault(z[:, i].tobytes(), i)
    idx = list(keep.values())
    w, b = lasso(z[:, idx], y.astype(float), penalty)
    return {"rules": [(rules[i], float(v)) for i, v in zip(idx, w) if v], "bias": float(b)}


def compiled(model: dict, names: list[str]) -> Column:
    """The model as one Spark expression over the statistics."""
    total = F.lit(model["bias"])
    for rule, weight in model["rules"]:
        fired = F.lit(True)
        for f, cut, low in rule:
            fired = fired & ((F.col(names[f]) <= cut) if low else (F.col(names[f]) > cut))
        total = total + F.when(fired, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", most_labelled: int = MOST_LABELLED) -> dict:
    """Learn from (key, text, label); at most ``most_labelled`` rows, picked by a hash of the key."""
    rows = labelled.where(F.col(label).isNotNull()).select(key, text, F.col(label).cast("int").alias("_y"))
    picked = rows.orderBy(F.xxhash64(key, F.lit(11)), key).limit(most_labelled)
    stats, names = statistics(picked, text)
    names = names[:-1]
    got = stats.select("_y", *names).toPandas()
    return fit_rules(got[names].to_numpy(dtype=float), (got["_y"].to_numpy() > 0).astype(float)) | {"names": names}


def score(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted."""
    stats, (*names, row) = statistics(docs.drop("score", "predicted"), text)
    # a row number keeps a later filter on the score above the statistics, which would else be
    # worked out again for every rule that names them
    out = stats.withColumn("score", F.when(F.col(row) >= 0, compiled(model, names)).otherwise(0.0)).drop(row, *names)
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def quality_classifier(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "quality", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Learn from labelled rows where ``held_out`` is false, score every row of ``docs``."""
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    few = docs.where(~F.col("held_out")).select(key, text)
    marks = labels.select(F.col(key), F.col(label).alias("_label")).where("_label is not null")
    # the sample is drawn on the narrow labels table, so texts meet only a bounded set of ids
    marks = marks.orderBy(F.xxhash64(key, F.lit(11)), key).limit(2 * most_labelled)
    model = fit(few.join(F.broadcast(marks), key), text, "_label", key, most_labelled)
    return score(docs, model, text)
