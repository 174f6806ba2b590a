"""Quality by Bradley-Terry ranking.

A document's score is linear in features of its whole text. The weights are
learned from all preference pairs (a document labelled 1 is preferred to one
labelled 0) of all labelled documents outside the held-out fold: the logistic
loss of a pair is taken on the difference of the two feature vectors, as in the
Bradley-Terry model, and minimised by Newton steps. The loss of a pair depends
on its two scores alone, so no pairs are made: each step sums the documents by
label and bin of scores (``BINS`` a unit, each taken at its mean) and pairs the
bins. The cut is a quantile of all training scores, on a grid of ``CUT_BINS`` a
unit, searched around the training share of label 0; scores are mapped so that
the cut is ``threshold``.

What reaches the driver are sums by bin: ``2 * MAX_SCORE * BINS`` rows a label
at most, ``2 * MAX_SCORE * CUT_BINS`` once for the cut. Only features of labelled
documents are shuffled; scoring reads every whole text where it lies: no shuffle.

Defined results: NULL or empty text: the features of an empty text; repeated
rows: one result each; no usable labels (or one class only): score 1 for
every document; no rows: no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipendlens.llm.common import held_out, written
from stipendlens.llm.host_rules import repeated_window_words
from stipendlens.plans.joins import fits_rows
from stipendlens.plans.lineage import cut_lineage

FEATURES = ("log_words", "log_word_len", "distinct_words", "top_word", "repeated_windows", "symbols", "punctuation",
            "capitals", "digits", "letters", "dup_lines", "line_words", "marked_words", "few_words")
MAX_SCORE, BINS, CUT_BINS = 40, 16, 256  # scores beyond MAX_SCORE share the last bin
_SYMBOLS = "#*$%&|<>~^=_\\{}[]"
_PUNCT = "!?.,;:"
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def text_features(text: str | None) -> tuple[float, ...]:
    text = text or ""
    words = text.encode("utf-8").split()
    n, chars = len(words), max(1, len(text))
    nw = max(1, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    nl = max(1, len(lines))
    spaces = text.count(" ") + text.count("\n") + text.count("\t")
    solid = max(1, chars - spaces)
    symbols = sum(map(text.count, _SYMBOLS))
    capitals = len(text) - len(_CAPITAL.sub("", text))
    digits = sum(map(text.count, "0123456789"))
    punct = sum(map(text.count, _PUNCT))
    marked = sum(m for w, m in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in (b".", b","))
    return (math.log1p(n), math.log1p((chars - spaces) / nw), len(counts) / nw, (max(counts.values()) if n else 0) / nw,
            repeated_window_words(words) / nw, math.sqrt(symbols / solid), math.sqrt(punct / solid),
            math.sqrt(capitals / solid), math.sqrt(digits / solid), 1 - (symbols + punct + digits) / solid,
            1 - len(set(lines)) / nl if lines else 0.0, math.log1p(n / nl), math.sqrt(marked / nw), float(n < 5))


def training_features(docs: DataFrame, labels: DataFrame, label: str, max_broadcast_rows: int) -> DataFrame:
    """y and the features of every labelled document outside the held-out fold."""
    known = cut_lineage(labels.filter(~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    texts = docs.filter(~held_out()).select("doc_id", "text")
    if fits_rows(known, max_broadcast_rows):
        texts = texts.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")

    @F.pandas_udf(", ".join(f"{c} double" for c in FEATURES))
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(np.array([text_features(t) for t in texts], float).reshape(-1, len(FEATURES)), columns=FEATURES)

    # the features are shuffled, never the texts
    return written(texts.select("doc_id", features(F.col("text")).alias("x")).select("doc_id", "x.*").join(known, "doc_id").drop("doc_id"))


def _sums(rows: DataFrame, of: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``of`` maps a batch to (group of each row, ``width`` values of each row):
    the groups in order and their sums. A task sends one row a group."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = np.zeros(0, np.int64), np.zeros((0, width))
        for b in batches:
            group, values = of(b)
            group, total = np.concatenate([at, group]), np.concatenate([total, values])
            order = np.argsort(group, kind="stable")
            at, start = np.unique(group[order], return_index=True)
            total = np.add.reduceat(total[order], start) if len(at) else total
        yield pd.DataFrame({"at": at} | {f"c{i}": total[:, i] for i in range(width)})

    names = [f"c{i}" for i in range(width)]
    each = rows.mapInPandas(run, "at bigint, " + ", ".join(f"{c} double" for c in names))
    got = each.groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).toPandas().sort_values("at")
    return got["at"].to_numpy(), got[names].to_numpy()


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, ridge: float = 1e-3,
          max_broadcast_rows: int = 1_000_000) -> dict | None:
    """Standardised Bradley-Terry weights and the cut; None without both classes."""
    rows = training_features(docs, labels, label, max_broadcast_rows)
    k = len(FEATURES)
    got = rows.agg(F.sum(1 - F.col("y")), F.sum("y"), *(F.avg(c) for c in FEATURES), *(F.stddev_pop(c) for c in FEATURES)).first()
    n0, n1 = got[:2]
    if not n0 or not n1:
        return None
    # rounded, like the weights: sums of doubles differ in their last digits from run to run
    mean, std = np.round(np.array(got[2:2 + k], float), 9), np.round(np.array(got[2 + k:], float), 9) + 1e-6

    def points(b: pd.DataFrame) -> np.ndarray:
        z = np.clip((b[list(FEATURES)].to_numpy(float) - mean) / std, -6, 6)
        return np.hstack([z, z * z])  # a feature may be bad at both ends

    def bins(z: np.ndarray, w: np.ndarray, per_unit: int) -> np.ndarray:
        return np.floor(np.clip(z @ w, -MAX_SCORE, MAX_SCORE) * per_unit).astype(np.int64)

    def binned(w: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Of label 0 and of label 1: the share of each bin of scores, its mean score and mean point."""
        def of(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            z = points(b)
            return 2 * bins(z, w, BINS) + b["y"].to_numpy(), np.column_stack([np.ones(len(z)), z @ w, z])
        at, c = _sums(rows, of, 2 * k + 2)
        return [(c[at % 2 == y, 0] / n, *np.split(c[at % 2 == y, 1:] / c[at % 2 == y, :1], [1], axis=1)) for y, n in ((0, n0), (1, n1))]

    def products(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        z, y = points(b), b["y"].to_numpy()
        per = np.stack([z[y == v].T @ z[y == v] for v in (0, 1)])  # label x point x point
        return np.arange(per.size // (2 * k)), per.reshape(-1, 2 * k)

    second = _sums(rows, products, 2 * k)[1].reshape(2, 2 * k, 2 * k) / np.array([n0, n1])[:, None, None]
    w, last = np.zeros(2 * k), np.zeros(2 * k)
    best = math.inf
    for _ in range(40):  # Newton steps on the mean of log(1 + exp(-w.diff)) over all pairs + ridge / 2 w.w
        (p0, s0, z0), (p1, s1, z1) = binned(w)
        diff, weight = s1.T - s0, p0[:, None] * p1[None, :]
        loss = float((weight * np.logaddexp(0, -diff)).sum() + ridge / 2 * (w @ w))
        if loss > best + 1e-6 and np.abs(w - last).max() > 1e-5:
            w = (w + last) / 2
            continue
        best, last = loss, w
        p = 1 / (1 + np.exp(diff))
        pull, spread = weight * p, weight * p * (1 - p)
        grad = pull.sum(1) @ z0 - pull.sum(0) @ z1 + ridge * w
        cross = z0.T @ spread @ z1
        hess = (z0.T * spread.sum(1)) @ z0 + (z1.T * spread.sum(0)) @ z1 - cross - cross.T + ridge * np.eye(len(w))
        inside = second.sum(0) - (z0.T * p0) @ z0 - (z1.T * p1) @ z1  # of points about the mean point of their bin
        step = np.linalg.solve(hess + spread.sum() * inside, grad)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    w = np.round(w, 8)
    at, share = _sums(rows, lambda b: (2 * bins(points(b), w, CUT_BINS) + b["y"].to_numpy(), np.ones((len(b), 1))), 1)
    y, at, share = at % 2, at // 2, share[:, 0] / (n0 + n1)
    places, at = np.unique(at, return_inverse=True)
    mass = [np.bincount(at[y == v], share[y == v], len(places)) for v in (0, 1)]
    share0, s = mass[0].sum(), (places + 0.5) / CUT_BINS
    below, errors = np.cumsum(mass[0] + mass[1]), np.cumsum(mass[1] - mass[0])
    near = np.flatnonzero((below >= 0.5 * share0) & (below <= min(0.999, 1.5 * share0)))
    best_at = near[np.argmin(errors[near])] if len(near) else int(np.searchsorted(below, share0))
    cut = float(s[min(best_at, max(0, len(s) - 2)):][:2].mean())
    middle = (mass[0] + mass[1]) @ s
    scale = 1.0 / max(1e-6, float(np.sqrt((mass[0] + mass[1]) @ (s - middle) ** 2)))
    return {"mean": mean, "std": std, "w": w, "cut": cut, "scale": 3 * scale, "at": math.log(threshold / (1 - threshold))}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score in 0 to 1 for ``docs(doc_id, text)``."""
    if model is None:
        return docs.select("doc_id", F.lit(1.0).alias("score"))

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        x = np.array([text_features(t) for t in texts], float).reshape(-1, len(FEATURES))
        z = np.clip((x - model["mean"]) / model["std"], -6, 6)
        s = np.hstack([z, z * z]) @ model["w"]
        return pd.Series(1 / (1 + np.exp(-np.clip(model["scale"] * (s - model["cut"]) + model["at"], -30, 30))))

    return docs.select("doc_id", quality(F.col("text")).alias("score"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    return score(docs, learn(docs, labels, threshold=threshold)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
