"""Toxicity: recall and precision on labels, entries chosen alike for few labels and many, and the automaton against a plain scan."""

import random

import pytest

from stipendlens.llm import toxicity as T


@pytest.mark.parametrize("sf, recall, precision", [("sf0.001", 0.9, 0.8), ("sf0.01", 0.8, 0.95), ("sf0.1", 0.9, 0.95)])
def test_toxic_documents_are_found_and_clean_ones_left_alone(spark, sf, recall, precision):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.toxicity(docs, labels).join(labels, "doc_id").select("held_out", "toxic", "predicted").collect()
    for part in [rows] if sf == "sf0.001" else [rows, [r for r in rows if r["held_out"]]]:
        hit = sum(r["toxic"] and r["predicted"] for r in part)
        assert hit >= recall * sum(r["toxic"] for r in part) and hit > 0
        assert hit >= precision * sum(r["predicted"] for r in part)


def test_entries_are_chosen_by_the_share_of_false_ones_not_by_the_size_of_the_sample():
    rng = random.Random(1)
    noise = [f"w{i}" for i in range(3000)]
    for docs in (12, 120, 1200):
        bad, good = {}, {}
        for _ in range(docs):
            for w in {"awful ", *rng.sample(noise, 60)}:
                bad[w] = bad.get(w, 0) + 1
            for _ in range(5):
                for w in rng.sample(noise, 60):
                    good[w] = good.get(w, 0) + 1
        assert list(T.choose_terms(bad, good, 61 * docs, 300 * docs, 2000)) == ["awful "]


def plain_hits(text, lexicon, exceptions):
    """Every position against every entry."""
    t = T.fold(text)

    def at(i, phrase, whole):
        j = i + len(phrase)
        return t.startswith(phrase, i) and not (i and t[i - 1].isalpha()) and not (whole and j < len(t) and t[j].isalpha())

    kept = [(i, i + len(T.fold(p)) - 1) for p in exceptions for i in range(len(t)) if at(i, T.fold(p), True)]
    return sorted(w for e, w in lexicon.items() for i in range(len(t)) if at(i, e.rstrip(), e.endswith(" "))
                  and not any(a <= i and i + len(e.rstrip()) - 1 <= b for a, b in kept))


def test_scanner_equals_a_plain_scan():
    rng = random.Random(2)
    lexicon = {"ab": 1.0, "abc ": 2.0, "b ": 3.0, "cab": 4.0, "bca ": 5.0}
    exceptions = ("ab c", "cab b")
    scan = T.Scanner(lexicon, exceptions)
    for _ in range(2000):
        text = "".join(rng.choice("aabbcc  4@8А") for _ in range(rng.randrange(40)))
        assert sorted(scan.hits(text)) == plain_hits(text, lexicon, exceptions)
