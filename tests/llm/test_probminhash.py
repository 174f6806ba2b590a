"""Near-duplicates against all pairs with the exact similarity."""

import random
from itertools import combinations

import numpy as np
import pytest

from stipendlens.llm import probminhash as P
from tests.llm.test_linking import union_find


def weighted(text):
    words = (text or "").lower().encode().split()
    size = min(len(words), P.SHINGLE)
    out = {}
    for i in range(len(words) - size + 1 if words else 0):
        g = tuple(words[i:i + size])
        out[g] = out.get(g, 0) + 1
    return out


def jp(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a.get(k, 0) / a[d], b.get(k, 0) / b[d]) for k in keys) for d in set(a) & set(b))


def test_similarity_is_the_formula_and_jaccard_for_equal_weights():
    rng = random.Random(1)
    for _ in range(40):
        texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 60))) for _ in range(2)]
        a, b = map(weighted, texts)
        h = P._Hashes()
        got = P.probability_jaccard(P.shingles(texts[0], h), P.shingles(texts[1], h))
        assert got == pytest.approx(jp(a, b))
        if set(a.values()) | set(b.values()) == {1}:
            assert got == pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)))


def test_registers_estimate_the_similarity():
    rng = random.Random(2)
    a = [f"w{rng.randrange(40)}" for _ in range(300)]
    b = a[:220] + [f"v{rng.randrange(40)}" for _ in range(60)]
    h = P._Hashes()
    s = [P.shingles(" ".join(x), h) for x in (a, b)]
    doc = np.repeat([0, 1], [len(x[0]) for x in s])
    r = P.registers(doc, np.concatenate([x[0] for x in s]), np.concatenate([x[1] for x in s]).astype(float), 2, 4000)
    assert (r[0] == r[1]).mean() == pytest.approx(P.probability_jaccard(*s), abs=0.03)


def test_similar_pairs_are_the_pairs_at_the_threshold():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 3000))) for _ in range(6)]
    texts += [" ".join(t.split()[:rng.randrange(1, 9999)]) for t in texts for _ in range(4)] + ["a b " * 40, "a b " * 90, "c " * 9]
    h = P._Hashes()
    sets = [P.shingles(t, h) for t in texts]
    wanted = np.triu(np.ones((len(sets), len(sets)), bool), 1)
    got = P.similar_pairs(sets, wanted, 0.8)
    assert sorted(got) == [(i, j) for i, j in combinations(range(len(sets)), 2) if P.probability_jaccard(sets[i], sets[j]) >= 0.8]


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    got = sorted(map(tuple, P.near_duplicates(docs).collect()), key=repr)
    sets = [weighted(r["text"]) for r in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2)
             if sets[i] and sets[j] and (rows[i]["text"] == rows[j]["text"] or jp(sets[i], sets[j]) >= 0.8)]
    root = union_find(links)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            k = root.get(i, i)
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    want = [(r["doc_id"], least.get(root.get(i, i))) for i, r in enumerate(rows)]
    assert got == sorted(want, key=repr)
    return got


def test_given_documents(documents):
    got = check(documents.filter("length(text) < 4000"))
    assert any(a != b for a, b in got)


def test_hot_near_copies_chains_and_odd_rows(make_docs):
    rng = random.Random(4)
    base = [f"word{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(60):  # near copies of one text, all different
        t = base.copy()
        t[rng.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(t)))
    chain = [f"c{k}" for k in range(200)]
    rows += [(100 + k, " ".join(chain[8 * k:8 * k + 110])) for k in range(8)]  # linked to the next only
    rows += [(200 + i, " ".join(base)) for i in range(30)] + [(300, None), (301, ""), (302, " \n"), (303, ""), (304, "one two"), (305, "one two"),
             (306, "One two"), (307, "a " * 400), (308, "a " * 900), (309, "x y z " * 9000), (309, "x y z " * 9000), (None, "unique text here")]
    check(make_docs(rows))


def test_keep_one_of_each_group(make_docs):
    text = " ".join(f"w{i}" for i in range(40))
    docs = make_docs([(5, text), (3, text + " tail"), (3, text + " tail"), (9, "other words entirely here now"), (1, None), (2, ""), (4, "  ")])
    kept = P.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 9]


def test_empty_table(make_docs):
    empty = make_docs([(1, "a")]).filter("false")
    assert P.near_duplicates(empty).count() == 0 and P.keep_one(empty).count() == 0
