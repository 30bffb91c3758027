"""Toxicity, conversation repair and collocations: queries against plain versions, and edge cases."""

import random
import zlib

import brute_more as brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evspark.llm import bits, collocations, conversation_repair, queries, shared, toxicity

LABELS = "doc_id long, toxic int, label int, evidence double"


def test_toxic_words_as_plain():
    for text in ["Über-Idiot, x1 _y z", "", None, "中文 A'b\x00c"]:
        assert toxicity.words_of(text) == brute.toxic_words(text)


def labelled(n=400, seed=3):
    """Rows where a toxic text holds some of a few words or of a family of words."""
    rng = random.Random(seed)
    syllables = ["ta", "lo", "mi", "ren", "sto", "un", "ka", "pe"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randint(20, 120))], i % 5 == 0
        for _ in range(max(2, len(words) // 25) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["Grub", "vexed", "Zorch" + word()])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_op11_ratios_as_plain(spark):
    rows = labelled(120)
    df = spark.createDataFrame([(label, text) for _, text, label in rows], "label int, text string")
    table, plain = toxicity.table_of(df).opened(), brute.KneserNey([(label, text) for _, text, label in rows])
    words = sorted({w for _, t, _ in rows for w in brute.toxic_words(t)})[:300] + [b"grubby", b"new", b"zorchnew", b"x" * 50, "é".encode()]
    assert toxicity.ratios(table, words) == pytest.approx([plain.ratio(w) for w in words], abs=1e-9)
    assert len(toxicity.ratios(table, [])) == 0


def test_op11_weights_stay_right_when_dropped(monkeypatch):
    table = [(np.empty(0, np.uint64), np.empty(0))] * 16
    monkeypatch.setattr(toxicity, "ratios", lambda _, words: np.array([len(w) + 3.0 for w in words]))
    monkeypatch.setattr(toxicity, "KEPT_BYTES", 500)
    weights = toxicity._Weights(table)
    texts = ["aa b", "cc dddd e", "aa cc", "", None, "ffff g h i j"]
    for _ in range(3):
        assert weights.evidence(texts) == pytest.approx([sum(len(w) for w in (t or "").split()) / (len((t or "").split()) + 10) for t in texts])


def test_op11_held_out(spark):
    rows = labelled(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0, 0.0) for i, _, y in rows], LABELS)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    out = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in sorted(got) if got[i].held_out] == out
    assert np.mean([got[i].predicted == rows[i][2] for i in out]) >= 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_op11_never_sees_held_out_labels(spark):
    rows = labelled(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    some = [spark.createDataFrame([(i, 1 - y if flip and held(i) else y, 0, 0.0) for i, _, y in rows], LABELS) for flip in (False, True)]
    first, second = (sorted(map(tuple, toxicity.score_documents(docs, x).collect())) for x in some)
    assert first == second


def test_op11_cases(spark, docs, doc_rows):
    labels = spark.createDataFrame([(i, y, 0, 0.0) for i, y in [(4, 1), (4, 0), (5, None), (None, 1), (6, 1), (9, 0), (10, 0), (77, 1)]], LABELS)
    got = toxicity.score_documents(docs, labels).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (d["doc_id"] for d in doc_rows)))
    assert {(r.score, r.predicted) for r in got} == {(2.5 / 6, 1)}  # too few labels for a curve: share of the labels that may be used
    assert {r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []


def test_op11_over_the_table(query, rows):
    got = query("op11_toxicity")
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in rows("documents"))


def test_op12(query, rows, same):
    some = rows("conversations")
    same(query("op12_conversation_repair"), brute.op12(brute.damaged(some), list({r["conv_id"] for r in some})))


ROLES = ["user", "assistant", "system", "tool", "", " "]
TEXTS = ["Fine.", "Again.", "cut off", " ", "", "Why?\n", "a ", "Ok! \t"]
TALK = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.sampled_from(ROLES), st.sampled_from(TEXTS)), max_size=7)


def plain_blocks(rows, size):
    """The operator's steps on one conversation, by its functions, with blocks of ``size`` rows."""
    rows = sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["text"]))
    seen, codes = set(), []
    for r in rows:
        text = r["text"].strip(brute.SPACE)
        fault = conversation_repair.BLANK if not text else conversation_repair.REPEATED if (r["role"], r["text"]) in seen else conversation_repair.CUT if text[-1] not in ".!?" else 0
        seen.add((r["role"], r["text"]))
        codes.append((r["role"][:1], fault, 1))
    parts = [codes[i : i + size] for i in range(0, len(codes), size)]
    behind = [conversation_repair.with_inserts(list(conversation_repair.END))]
    for p in reversed(parts):
        behind.append(conversation_repair.applied(conversation_repair.matrix(p), behind[-1]))
    behind.reverse()
    state, audit = conversation_repair.START, ""
    for p, costs in zip(parts, behind[1:], strict=True):
        edits, state = conversation_repair.walk(p, costs, state)
        audit += edits
    audit += conversation_repair.closing(state)
    left = conversation_repair.replay(audit, [(r["role"], r["text"], 1) for r in rows], conversation_repair.START)
    return int(behind[0][conversation_repair.START]), audit, [f"{r['role']}:{r['text']}" for r in left]


@settings(max_examples=400, deadline=None)
@given(TALK, st.integers(1, 4))
def test_op12_edits_are_cheapest_and_least(talk, size):
    rows = [{"conv_id": 1, "turn": t, "role": r, "text": x} for t, r, x in talk]
    want = brute.op12(rows, [1])[0]
    cost, audit, left = plain_blocks(rows, size)
    assert (cost, audit, brute.sha("\n".join(left))) == (want["cost"], want["audit"], want["repaired_sha256"])


def many_talks():
    rng = random.Random(4)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 4, 5]), rng.choice(ROLES), rng.choice(TEXTS)) for c in [None, *range(40)] for _ in range(rng.randint(1, 8))]
    rows += [(99, t, rng.choice(ROLES[:3]), rng.choice([*TEXTS, f"Text {t}."])) for t in range(300)] + [(98, 7, "user", "Same.")] * 50
    return rows + [(97, 1, "user", "word " * 40_000 + "."), (97, 2, "assistant", "Done.")]


@pytest.mark.parametrize("size", [1024, 7])
def test_op12_cases(spark, same, monkeypatch, size):
    """Null turns and ids, repeated rows, long texts, and conversations that lie in many blocks."""
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", size)
    rows = many_talks()
    df = spark.createDataFrame([(*r, 1, 2, "n", 3) for r in rows], "conv_id long, turn long, role string, text string, part int, block int, first string, n int")
    repaired = conversation_repair.repair(df)
    plain = [dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows]
    want = brute.op12(plain)
    same(conversation_repair.digests(repaired).collect(), want)
    left = conversation_repair.repaired_rows(repaired).where("conv_id = 99").orderBy("part", "block", "place").collect()
    digest = next(w["repaired_sha256"] for w in want if w["conv_id"] == 99)
    assert brute.sha("\n".join(f"{r.role}:{r.text}" for r in left)) == digest
    assert conversation_repair.digests(conversation_repair.repair(df.limit(0))).collect() == []


def test_op12_nulls_are_one_space(spark, same):
    rows = [{"conv_id": c, "turn": t, "role": r, "text": x} for c in (None, 1, 2, 3) for t in (None, 0, 1, 2, 3, 4) for r, x in ((None, "A."), ("user", None), ("assistant", "B. c"))]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "conv_id long, turn long, role string, text string")
    got = conversation_repair.digests(conversation_repair.repair(queries.damaged(df))).collect()
    same(got, brute.op12(brute.damaged(rows), [None, 1, 2, 3]))


def test_op13(query, rows, same):
    same(query("op13_collocations"), brute.op13(rows("documents")))


def phrases():
    rng = random.Random(8)
    words = ["New", "york", "city", "a", "b", "É", "ünï", "x" * 300, "<|endoftext|>", "\x1c", "tab\x00"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))).replace("b", rng.choice(["b", "b,", "b\n", "b\t"])) for _ in range(300)]
    langs = [rng.choice(["en", "de", None, "und", ""]) for _ in texts]
    return [*zip(langs, texts, strict=True), ("en", None), (None, ""), ("en", "new york " * 5000), ("fr", "seul")]


@pytest.mark.parametrize("small", [False, True])
def test_op13_cases(spark, same, monkeypatch, small):
    """Null languages and texts, ends of pieces, overlaps, repeated rows; tries that burst and spill all the time."""
    if small:
        monkeypatch.setattr(collocations, "Trie", lambda length: plain_trie(length, 20, 3))
        monkeypatch.setattr(collocations, "MOST_WORDS", 20)
        monkeypatch.setattr(collocations, "KEPT_BYTES", 400)
        monkeypatch.setattr(collocations, "PORTION", 7)
        monkeypatch.setattr(bits, "MIN_BYTES", 32)
        monkeypatch.setattr(bits, "MAX_BYTES", 32)
    docs = phrases()
    df = spark.createDataFrame([(lang, t, "w", 1, 2, 3) for lang, t in docs], "lang string, text string, word string, id int, n int, w1 int")
    plain = [{"lang": lang, "text": t} for lang, t in docs]
    same(collocations.collocations(df, least=10, top=30).collect(), brute.op13(plain, 10, 30))
    assert collocations.collocations(df.limit(0)).collect() == []


plain_trie = collocations.Trie


WORDS = st.sampled_from([1, 2, 17, 33, (1 << 21) - 1, 5 << 10])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(WORDS, WORDS, st.integers(1, 5)), min_size=1, max_size=300), max_size=6), st.integers(2, 400))
def test_op13_tries_count(batches, most):
    trie, found, want = plain_trie(3, most, 3), brute.Counter(), brute.Counter()

    def take(run):
        keys, counts = run
        assert (np.diff(keys) > 0).all()
        found.update(dict(zip(zip(*(p.tolist() for p in collocations.unpacked(keys, 3)), strict=True), counts.tolist(), strict=True)))

    for some in batches:
        x = np.array(some, np.int64)
        trie.add(collocations.packed([x[:, k] for k in range(3)]))
        want.update(some)
        for run in trie.spilled():
            take(run)
        assert trie.entries <= most
    for run in trie.rest():
        take(run)
    assert found == want
    assert trie.entries == 0


def test_op13_long_texts_in_parts(monkeypatch):
    """Every phrase of a text that comes in parts is whole in exactly one part."""
    monkeypatch.setattr(collocations, "PORTION", 4)
    monkeypatch.setattr(collocations, "_docs", lambda texts: [("en", t) for t in texts])
    for size in range(1, 15):
        text = " ".join(f"w{i}" for i in range(size))
        for length in (1, 2, 3):
            words = text.encode().split()
            want = [tuple(words[i : i + length]) for i in range(size - length + 1)]
            got = [tuple(p[i : i + length]) for some in collocations._portions([text], length) for _, p in some for i in range(len(p) - length + 1)]
            assert got == want


def test_op13_scores_are_exact(spark):
    a, left, right = 123_456_789_012_345, 987_654_321_098_765, 4_567_890_123_456_789
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations.score("a", "l", "r")).first()[0] == 1_000_000 * a * a // (left * right)


def test_op13_another_seed_where_ids_collide(spark, same, monkeypatch):
    plain = collocations.word_id
    monkeypatch.setattr(collocations, "word_id", lambda lang, word, seed: 1 if seed == 0 else plain(lang, word, seed))
    counted = collocations.counted
    seeds = []
    monkeypatch.setattr(collocations, "word_counts", lambda docs, seed, f=collocations.word_counts: seeds.append(seed) or f(docs, seed))
    docs = [{"lang": "en", "text": "a b c " * 20}]
    df = spark.createDataFrame([("en", docs[0]["text"])], "lang string, text string")
    totals, words, pairs, triples = counted(df)
    assert words.count() == 3
    assert pairs.count() == 3


def test_bits(spark):
    numbers = np.random.default_rng(1).integers(0, 1 << 63, 5000)
    df = shared.stored(spark.createDataFrame([(int(x),) for x in numbers], "x long"), "numbers")
    opened = bits.write(df, 5000).opened()
    assert opened.have(numbers.astype(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert opened.have(others).mean() < 0.02
    assert not bits.write(df.limit(0), 0).opened().have(others).any()
