"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, case, look-alike letters, digits and
signs written for letters inside words), scanned once with an Aho-Corasick
automaton that holds the lexicon and the exception phrases, and scored from
the weights found, normalised by length. A lexicon entry is a word start or
a whole word; a hit inside an exception phrase does not count.

The lexicon is learned from labelled training documents: word starts of 3 to
8 letters and whole words that are significantly more frequent in toxic ones
(a document counts an entry ``CLIP`` times at most), weighted by the log ratio
of their rates per word; of entries that extend each other only the most
significant, and among equals the longest, stays. The logistic map from
(weight, weight by length, largest weight, hits) to a score is fitted on the
same sample with lexicons of the other half, so that chance entries do not
look certain.

Bounds: ``per_class`` sampled documents a label, ``max_candidates`` counted
entries, ``max_terms`` lexicon entries; only those and one small feature row
per sampled document reach the driver. Scoring reads every whole text where
it lies: no shuffle.

Defined results: NULL or empty text: no hits, the score of a clean empty
text; repeated rows: one result each; no usable labels (or one class only):
score 0 for every document; no rows: no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipendlens.llm.common import WORD, held_out, labelled_sample
from stipendlens.plans.lineage import cut_lineage

# Look-alike letters, substitutes inside words, exception phrases.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
              "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
              "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
              "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o",
              "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": ""}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "sore loser rule")

_FOLD = str.maketrans(HOMOGLYPHS)
_SUB = str.maketrans(SUBSTITUTES)
_SUBSTITUTED = re.compile(r"[013457@$!8]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
STARTS = range(3, 9)
CLIP = 3


def fold(text: str | None) -> str:
    text = unicodedata.normalize("NFKC", text or "").lower().translate(_FOLD)
    return _SUBSTITUTED.sub(lambda m: m[0].translate(_SUB), text)


def terms_of(text: str, only: frozenset[str] | None = None) -> Counter:
    """Counts of word starts and whole words (marked by a trailing blank)."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall(fold(text))).items():
        for t in [w[:k] for k in STARTS if len(w) >= k] + [w + " "] * (len(w) >= 3):
            if only is None or t in only:
                out[t] += n
    return out


class Scanner:
    """The automaton over a lexicon {entry: weight} and exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: Sequence[str] = EXCEPTIONS) -> None:
        self.auto = ahocorasick.Automaton()
        held: dict[str, list] = {}
        for entry, weight in lexicon.items():
            held.setdefault(entry.rstrip(), []).append((entry.endswith(" "), float(weight)))
        for phrase in exceptions:
            held.setdefault(fold(phrase), []).append((True, None))
        for entry, values in held.items():
            self.auto.add_word(entry, (len(entry), tuple(values)))
        if held:
            self.auto.make_automaton()

    def hits(self, text: str) -> list[float]:
        if not len(self.auto):
            return []
        t = fold(text)
        found, excepted = [], []
        for end, (size, values) in self.auto.iter(t):
            start = end - size + 1
            if start and t[start - 1].isalpha():
                continue
            closed = end + 1 >= len(t) or not t[end + 1].isalpha()
            for whole, weight in values:
                if whole and not closed:
                    continue
                (excepted if weight is None else found).append((start, end, weight))
        return [w for s, e, w in found if not any(a <= s and e <= b for a, b, _ in excepted)]

    def features(self, text: str | None) -> tuple[float, ...]:
        """log weight, log weight per 100 words (20 words at least), largest weight, log hits."""
        w = self.hits(text or "")
        if not w:
            return (0.0, 0.0, 0.0, 0.0)
        total = sum(w)
        return (math.log1p(total), math.log1p(100 * total / (20 + len((text or "").split()))), max(w),
                math.log1p(len(w)))


def _count_terms(sample: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """Occurrences per (term, half), clipped by document; batches are counted before the shuffle."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(seen: Counter) -> pd.DataFrame:
            return pd.DataFrame([(t, h, n) for (t, h), n in seen.items()], columns=["term", "half", "n"])

        seen: Counter = Counter()
        for b in batches:
            for text, half in zip(b["text"], b["half"]):
                for t, n in terms_of(text, only).items():
                    seen[t, half] += min(n, CLIP)
                if len(seen) > 200_000:
                    yield rows(seen)
                    seen = Counter()
        if seen:
            yield rows(seen)

    return sample.select("text", "half").mapInPandas(run, "term string, half int, n bigint").groupBy("term").agg(
        F.sum(F.when(F.col("half") == 0, F.col("n")).otherwise(0)).alias("n_0"),
        F.sum(F.when(F.col("half") == 1, F.col("n")).otherwise(0)).alias("n_1"))


def choose_terms(bad: dict[str, int], good: dict[str, int], n_bad: int, n_good: int, max_terms: int,
                 false_share: float = 1e-3, min_weight: float = 1.5) -> dict[str, float]:
    """Entries whose rate per word is significantly higher in toxic documents,
    none the start of another. Of the entries taken a share of ``false_share``
    is expected to be there by chance (Benjamini and Hochberg's step-up over the
    p-values of the likelihood ratio statistics of all entries seen), so the
    choice means the same for few labels and for many. ``n_bad``, ``n_good``:
    words of either class."""
    ranked = []
    for t, a in bad.items():
        b = good.get(t, 0)
        weight = math.log((a + .5) / (n_bad + 1)) - math.log((b + .5) / (n_good + 1))
        if weight < min_weight:
            continue
        expected = (a + b) * n_bad / (n_bad + n_good)
        gain = 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0.0))
        ranked.append((-gain, -len(t), t, weight))
    ranked.sort()
    last = 0  # entries that pass: up to the last whose p-value is below its place's share
    for i, (gain, *_) in enumerate(ranked, 1):
        if math.erfc(math.sqrt(max(0.0, -gain) / 2)) <= false_share * i / max(1, len(bad)):
            last = i
    ranked = ranked[:last]
    out: dict[str, float] = {}
    starts: set[str] = set()
    for _, _, t, weight in ranked:
        word = t.rstrip()
        if len(out) >= max_terms or word in starts or any(word[:k] in out for k in STARTS):
            continue
        out[t] = weight
        starts.update(word[:k] for k in range(1, len(word) + 1))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps of a ridge logistic regression with intercept (last)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * len(y) * 1e-2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * (ridge * len(y) * 1e-2 + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 6000,
          max_candidates: int = 50_000, max_terms: int = 2000) -> tuple[dict[str, float], list[float]] | None:
    """(lexicon, coefficients), or None when a class has no training document."""
    sample = cut_lineage(labelled_sample(docs, labels, label, per_class).withColumn(
        "half", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int")))
    words = F.sum(F.greatest(F.lit(1), F.regexp_count("text", F.lit(WORD)))).alias("words")
    sizes = {(r["y"], r["half"]): r["words"] for r in sample.groupBy("y", "half").agg(words).collect()}
    n = [[sizes.get((y, h), 0) for h in (0, 1)] for y in (0, 1)]
    if not sum(n[0]) or not sum(n[1]):
        return None
    seen = F.col("n_0") + F.col("n_1")
    toxic = _count_terms(sample.filter("y = 1"), None).filter(seen >= 3).orderBy(seen.desc(), "term").limit(max_candidates)
    bad = {r["term"]: (r["n_0"], r["n_1"]) for r in toxic.collect()}
    clean = _count_terms(sample.filter("y = 0"), frozenset(bad))  # at most max_candidates rows
    good = {r["term"]: (r["n_0"], r["n_1"]) for r in clean.collect()}

    def lexicon(halves: tuple[int, ...]) -> dict[str, float]:
        a = {t: m for t, c in bad.items() if (m := sum(c[h] for h in halves))}
        b = {t: sum(c[h] for h in halves) for t, c in good.items()}
        return choose_terms(a, b, sum(n[1][h] for h in halves), sum(n[0][h] for h in halves), max_terms)

    full, other = lexicon((0, 1)), [lexicon((1,)), lexicon((0,))]
    features = sample.select("text", "y", "half").mapInPandas(
        _featurize([Scanner(x) for x in other]), "y int, f0 double, f1 double, f2 double, f3 double").toPandas()
    x = features[["f0", "f1", "f2", "f3"]].to_numpy()
    return full, fit_logistic(x, features["y"].to_numpy(float)).tolist()


def _featurize(scanners: list[Scanner]):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = np.array([scanners[h].features(t) for t, h in zip(b["text"], b["half"])], float).reshape(-1, 4)
            yield pd.DataFrame({"y": b["y"], "f0": f[:, 0], "f1": f[:, 1], "f2": f[:, 2], "f3": f[:, 3]})
    return run


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]] | None, keep: Sequence[str] = ("doc_id",),
          exceptions: Sequence[str] = EXCEPTIONS) -> DataFrame:
    """The ``keep`` columns of ``docs(text, ...)`` and ``score``, 0 to 1."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    scanner, coef = Scanner(model[0], exceptions), np.array(model[1])

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        f = np.array([scanner.features(t) for t in texts], float).reshape(-1, 4)
        return pd.Series(1 / (1 + np.exp(-np.clip(f @ coef[:-1] + coef[-1], -30, 30))))

    return docs.select(*keep, toxic(F.col("text")).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
