"""Ids against the library's, and exact round trips."""

import random

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from stipendlens.llm import sentencepiece_sa as S

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=S.MODEL_PATH)
VOCABULARY = S.Vocabulary.load()


def encode(texts, encoder=None):
    ids, counts = (encoder or S.Encoder(VOCABULARY)).encode(texts)
    ends = np.append(0, np.cumsum(counts))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def check(texts, encoder=None):
    got, decoder = encode(texts, encoder), S.Decoder(VOCABULARY)
    assert got == [LIBRARY.encode(t or "") for t in texts]
    assert [decoder.decode(x) for x in got] == [(t or "").replace(S.MARK, " ") for t in texts]


def test_given_documents(documents):
    check([r["text"] for r in documents.collect()])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abcdehilnorst  \n\t é中😀▁0.,​\0", max_size=60), max_size=8))
def test_any_text(texts):
    check(texts)


def test_chunks_and_memory_are_exact(monkeypatch):
    monkeypatch.setattr(S, "_CHUNK", 50)
    monkeypatch.setattr(S, "_REMEMBERED", 5)
    rng = random.Random(1)
    encoder = S.Encoder(VOCABULARY)
    for _ in range(4):
        check([" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) for _ in range(20)) for _ in range(3)], encoder)


def test_long_runs_and_empty_texts():
    check([None, "", " ", " " * 300, "a" * 3000, "\n" * 50, "the " * 20_000, "x"])


def test_table(make_docs):
    docs = make_docs([(1, "Hello  world"), (1, "Hello  world"), (2, None), (None, "é\n中"), (3, "the " * 50_000)])
    got = S.encode(docs, keep=("doc_id", "source", "score"))
    assert got.columns == ["doc_id", "source", "score", "tokens", "n_tokens", "round_trip"]
    rows = got.collect()
    assert len(rows) == 5 and all(r["round_trip"] and r["n_tokens"] == len(r["tokens"]) for r in rows)
    back = {r["doc_id"]: r["text"] for r in S.decode(got).collect()}
    assert back == {1: "Hello  world", 2: "", None: "é\n中", 3: "the " * 50_000}
    assert S.encode(docs.filter("false")).count() == 0


def test_long_segments_take_few_rounds_in_windows(monkeypatch):
    rng = random.Random(4)
    texts = ["ab" * 20_000, "".join(rng.choice("漢字仮名交文日本語") for _ in range(8_000)),
             "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(20_000)), "the" * 4_000 + "a" * 9_000]
    monkeypatch.setattr(S, "_CHUNK", 997)
    check(texts)
    calls, repeat = [], np.repeat  # each round repeats the segments' best ranks
    monkeypatch.setattr(S.np, "repeat", lambda *a, **k: calls.append(1) or repeat(*a, **k))
    check([texts[0], texts[3]])
    assert len(calls) < 2_000
