"""Fingerprints against a Python model built on Spark's word hashes."""

import hashlib

from pyspark.sql import functions as F

from stipendlens.llm import syncmers as X


def check(spark, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    ranked = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    after = {r: ranked[(i + 1) % len(ranked)] for i, r in enumerate(ranked)}
    got = X.fingerprints(docs).collect()
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        text = next(t for d, t in rows if d == r["doc_id"] and len(t) == r["n_chars"])
        nxt = after[(r["doc_id"], text)][1]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + nxt[:cut]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
    for r in got:
        text = next(t for d, t in rows if d == r["doc_id"] and len(t) == r["n_chars"])
        for other, value in ((r["edited_fingerprint"], r["near_edited"]), (prints[after[(r["doc_id"], text)][1]], r["near_next"])):
            a, b = ({p[i:i + 8] for i in range(0, len(p), 8)} for p in (r["fingerprint"], other))
            assert value == (len(a & b) / len(a | b) if a | b else 1.0)
    return {r["doc_id"]: r for r in got}


def test_given_documents(spark, documents):
    got = check(spark, documents)
    near = sorted(r["near_edited"] for r in got.values() if r["n_chars"] > 300)
    assert near[len(near) // 10] > 0.3 and sum(r["near_next"] for r in got.values()) / len(got) < 0.1


def test_odd_documents(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "a"), (4, "a b c"), (5, "  a  b c "), (6, "é" * 10), (7, "w x y z " * 4000), (9, "q r s t u v w x"), (-4, "neg")]
    got = check(spark, make_docs(rows))
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == "" and got[2]["near_next"] == 1.0
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and len(got[3]["fingerprint"]) == 8


def test_repeated_and_null_rows(spark, make_docs):
    got = X.fingerprints(make_docs([(1, "a b c d e f")] * 3 + [(None, "last one here now"), (2, "g h i j k")])).collect()
    assert len(got) == 5 and len({tuple(r) for r in got}) == 3


def test_one_document_is_its_own_next(make_docs):
    row = X.fingerprints(make_docs([(1, "abcdef")])).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0


def test_anchors_are_closed_syncmers(spark):
    words = [f"w{i * 7919 % 101}" for i in range(60)]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    got = {r["pos"] for r in df.select(X.anchors(F.col("text")).alias("a")).first()["a"]}
    g = df.select(X._inner(X.word_hashes(F.col("text"))).alias("g")).first()["g"]
    inner = X.K - X.S + 1
    assert 10 < len(got) < 40 and got == {i for i in range(len(words) - X.K + 1) if min(g[i], g[i + inner - 1]) <= min(g[i:i + inner])}
    assert all(got & set(range(i, i + inner)) for i in range(len(words) - X.K - inner + 2))
    moved = spark.createDataFrame([("start " + " ".join(words) + " end",)], "text string")
    shifted = {r["pos"] - 1 for r in moved.select(X.anchors(F.col("text")).alias("a")).first()["a"]}
    assert got == shifted & set(range(len(words) - X.K + 1))


def test_empty_table(make_docs):
    assert X.fingerprints(make_docs([(1, "a")]).filter("false")).count() == 0


def test_positions_decide_in_long_texts(spark, make_docs):
    """One replaced tail in a long text, and its passages in another order, against a model of placed pairs."""
    words = [f"w{i}" for i in range(6000)]
    blocks = [words[i:i + 12] for i in range(0, 6000, 12)]
    rows = [(2, " ".join(words)), (1, " ".join(w for b in reversed(blocks) for w in b))]
    docs = make_docs(rows)
    got = check(spark, docs)
    assert 8 * 2000 < len(got[2]["fingerprint"]) < 0.7 * len(rows[0][1])

    def anchors(text):
        return spark.createDataFrame([(text,)], "text string").select(X.anchors(F.col("text")).alias("a")).first()["a"]

    def pairs(text):
        a = anchors(text)
        return {(x["hash"], y["hash"], y["pos"] - x["pos"]) for x, y in zip(a, a[1:])}

    mine, other = pairs(rows[0][1]), pairs(rows[1][1])
    cut = len(rows[0][1]) // 3
    edited = pairs(rows[0][1][:len(rows[0][1]) - cut] + rows[1][1][:cut])
    assert got[2]["near_next"] == len(mine & other) / len(mine | other)
    assert got[2]["near_edited"] == len(mine & edited) / len(mine | edited) > 0.4
    plain, moved = ({x["hash"] for x in anchors(t)} for _, t in rows)
    assert got[2]["near_next"] < 0.75 * len(plain & moved) / len(plain | moved)  # the same anchors, at other offsets


def test_a_moved_passage_keeps_its_pairs(make_docs):
    words = [f"w{i}" for i in range(3000)]
    docs = make_docs([(2, " ".join(words)), (1, " ".join(words[1000:] + words[:1000]))])
    assert {r["doc_id"]: r["near_next"] > 0.98 for r in X.fingerprints(docs).collect()} == {1: True, 2: True}
