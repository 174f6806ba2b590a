"""Quality rules judged at host level.

Each document gets word and line counts and a base verdict from fixed rules.
Failures are then counted per domain (the ``source`` of a document), each
domain's failure rate is shrunk with a beta prior fitted to the spread of
all domains' rates, and a domain whose posterior rate is surely above
``max_rate`` (mean - z * sd) is rejected as a whole; its verdict joins back to
its documents.

The counts come from one pass over whole texts (Arrow batches, a few rows
wide apart from the text); the narrow counts are checkpointed because both
the domain sums and the join back read them. Sums combine map-side, so a hot
domain is one row per task; domain verdicts are broadcast after a size
check, else joined by shuffle.

Defined results: NULL or blank text: no words, fails the base rules; NULL
source: a domain of its own; repeated rows count each; no rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stipendlens.llm.common import beta_strength
from stipendlens.plans.joins import bounded_broadcast
from stipendlens.plans.lineage import cut_lineage

_WS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more, firsts included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    _, pairs = np.unique(a[:-2] * len(ids) + a[1:-1], return_inverse=True)
    _, at, count = np.unique(pairs * len(ids) + a[2:], return_inverse=True, return_counts=True)
    twice = count[at] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= twice
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = text.encode("utf-8").split()  # bytes split on exactly \x20 \x09-\x0D
    lines = [x for x in text.split("\n") if x.strip(_WS)]
    return (len(words), len(text) - sum(map(text.count, _WS)), sum(map(text.count, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated_window_words(words))


def document_counts(docs: DataFrame, domain: str = "source") -> DataFrame:
    """doc_id, domain and the five counts of every whole text."""
    src = docs.select("doc_id", F.col(domain).cast("string").alias("domain"), "text")
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = np.array([text_counts(t) for t in b["text"]], np.int64).reshape(-1, len(_COUNTS))
            yield pd.DataFrame({"doc_id": b["doc_id"], "domain": b["domain"]}
                               | {c: got[:, i] for i, c in enumerate(_COUNTS)})

    return src.mapInPandas(run, f"doc_id {kind}, domain string, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def apply_host_rules(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, max_rate: float = 0.5,
                     z: float = 1.645, domain: str = "source") -> DataFrame:
    """doc_id, the five counts, base_failed, kept."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counts = cut_lineage(document_counts(docs, domain).withColumn("base_failed", failed))
    by = counts.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("x"))
    mean, strength = beta_strength(by, "x", "n")
    post = (F.col("x") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    sd = F.sqrt(post * (1 - post) / (F.col("n") + F.lit(strength) + 1))
    bad = by.filter(post - F.lit(z) * sd > max_rate).select(F.col("domain").alias("bad_domain"), F.lit(True).alias("rejected"))
    joined = counts.join(bounded_broadcast(bad), F.col("domain").eqNullSafe(F.col("bad_domain")), "left")
    return joined.select("doc_id", *_COUNTS, "base_failed",
                         (~F.col("base_failed") & F.col("rejected").isNull()).alias("kept"))
