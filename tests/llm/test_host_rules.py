from collections import Counter

from stipendlens.llm import host_rules


def brute(text):
    text = text or ""
    words = [w for w in text.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered))


def test_counts_match_brute_force(documents):
    got = {r["doc_id"]: tuple(r)[1:6] for r in host_rules.apply_host_rules(documents).collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in documents.collect()}


def test_odd_texts():
    for t in [None, "", " \n\t", "a", "a a a a", "a b c a b c", "x\u00a0y\x85z \x1c q", "\n\na\na\n b\n b", "w " * 50_000]:
        assert host_rules.text_counts(t) == brute(t)


def test_bad_host_is_rejected_and_others_kept(make_docs):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 20 == 0 else "short", "spam") for i in range(200)]
    rows += [(1000 + i, good, "fine") for i in range(50)] + [(2000, None, None), (2001, good, None), (2001, good, None), (None, good, "fine")]
    got = host_rules.apply_host_rules(make_docs(rows)).collect()
    assert len(got) == len(rows)
    kept = Counter((r["doc_id"] is None or r["doc_id"] >= 1000, r["kept"]) for r in got if not r["base_failed"])
    assert kept[(False, True)] == 0 and kept[(False, False)] == 10 and kept[(True, True)] == 53 and kept[(True, False)] == 0


def test_empty_table(make_docs):
    assert host_rules.apply_host_rules(make_docs([(1, "a")]).filter("false")).count() == 0
