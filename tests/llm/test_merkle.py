"""Merkle manifest against a tree built in Python, level by level."""

import hashlib
import zlib

import pytest

from stipendlens.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf int, tree string, pos int, total int, extra string, root int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, n_chars):
    return h(*[field(v) for v in (r["doc_id"], r["source"], r["lang"], n_chars, r["text"])])


def tree(level, k):
    proofs, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, a in enumerate(at):
            s = a - a % k
            proofs[i].append(("".join(level[s:a]), "".join(level[a + 1:s + k])))
            at[i] = a // k
        level = [h(*level[i:i + k]) for i in range(0, len(level), k)]
    return level[0], proofs


def expected(rows, k=2):
    items = []
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        changed = r["n_chars"] + 1 if hit and r["n_chars"] is not None else r["n_chars"]
        items.append((r["lang"], r["doc_id"], leaf(r, r["n_chars"]), leaf(r, changed)))
    langs = sorted({i[0] for i in items}, key=lambda v: (v is not None, (v or "").encode()))
    per = {lang: sorted((i for i in items if i[0] == lang), key=lambda i: (i[1] is not None, i[1] or 0, i[2])) for lang in langs}
    subs = {lang: tree([i[2] for i in own], k) for lang, own in per.items()}
    root, upper = tree([subs[lang][0] for lang in langs], k) if langs else (None, [])
    out = []
    for lang, up in zip(langs, upper):
        for i, proof in zip(per[lang], subs[lang][1]):
            node = i[3]
            for left, right in proof + up:
                node = h(left, node, right)
            out.append((i[1], i[2], subs[lang][0], root, h("".join(a + b for a, b in proof + up)), node, node == root))
    return sorted(out, key=repr)


def got(docs, **kw):
    return sorted((tuple(r) for r in merkle.tampered_manifest(docs, **kw).collect()), key=repr)


@pytest.mark.parametrize("kw", [{}, {"height": 2}, {"fan_out": 3, "height": 2}, {"fan_out": 5, "height": 1}])
def test_documents(documents, kw):
    want = expected(documents.collect(), kw.get("fan_out", 2))
    assert got(documents, **kw) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def rows(spark, data):
    return spark.createDataFrame([(*r, 7, "t", 3, 9, "x", 1) for r in data], SCHEMA)


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    data = [(None, "no id", "en", "s", 5), (None, None, None, None, None), (1, "a", None, "s", 1), (1, "b", None, "s", 1), (2, "", "", "", 0),
            (7, "äß😀", "é", "ü", 3), (8, "x" * 300_000, "z", "s", 2 ** 63 - 1), (-5, "minus", "en", "s", None)]
    data += [(3, "same", "en", "s", 4)] * 9 + [(i, f"d{i}", "en", "s", i) for i in range(40, 60)]
    df = rows(spark, data)
    for kw in ({}, {"height": 1}, {"height": 2, "fan_out": 3}):
        assert got(df, **kw) == expected(df.collect(), kw.get("fan_out", 2))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    df = rows(spark, [(i, "t", "en", "s", 1) for i in range(n)])
    assert got(df) == expected(df.collect())
    if n == 1:
        r = merkle.tampered_manifest(df).first()
        assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h("")


def test_a_proof_leads_from_the_leaf_to_the_root_and_from_no_other(spark, documents):
    from pyspark.sql import functions as F

    m = merkle.manifest(documents.select("doc_id", "lang", merkle.leaf_hash().alias("leaf"), F.col("source").alias("kept")), height=3)
    r = m.agg(F.count("*"), F.sum((merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).cast("int")),
              F.sum((merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).cast("int")), F.count("kept")).first()
    assert (r[0], r[1], r[2], r[3]) == (documents.count(), documents.count(), 0, documents.count())


def test_a_repeated_row_is_dealt_by_block(spark):
    """A row that fills the table stays one row up to its blocks."""
    df = rows(spark, [(1, "same", "en", "s", 4)] * 3000 + [(2, "other", "en", "s", 5)])
    assert got(df, height=4) == expected(df.collect())


def test_changing_one_document_changes_the_root_only_through_its_language(spark, documents):
    from pyspark.sql import functions as F

    base = {r["lang"]: (r["subroot"], r["root"]) for r in _roots(documents)}
    first = documents.orderBy("doc_id").first()
    changed = {r["lang"]: (r["subroot"], r["root"]) for r in _roots(
        documents.withColumn("text", F.when(F.col("doc_id") == first["doc_id"], F.lit("changed")).otherwise(F.col("text"))))}
    assert {lang for lang in base if base[lang][0] != changed[lang][0]} == {first["lang"]}
    assert all(base[lang][1] != changed[lang][1] for lang in base)


def _roots(docs):
    return merkle.manifest(docs.select("doc_id", "lang", merkle.leaf_hash().alias("leaf"))).select("lang", "subroot", "root").distinct().collect()
