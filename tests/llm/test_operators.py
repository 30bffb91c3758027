"""Each registered query against its plain version, and the edge cases of each operator."""

import random
import zlib
from pathlib import Path

import brute
import numpy as np
import public_tokenizers
import pytest
from compare import connect, differences
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evspark.llm import chat, components, decontaminate, embedding_dedup, line_dedup, minhash, mixing, quality, queries, shared, token_count, token_output, units, url_filter
from evspark.llm.oracle import ORACLE

DATA = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_op1(query, rows, same):
    same(query("op1_token_output"), brute.op1(rows("documents")))


def test_op1_cases(spark, docs, doc_rows, same, tmp_path):
    folder = str(tmp_path / "tokens")
    manifest = token_output.write_tokens(docs, folder, BPE, 2).collect()
    got = token_output.read_tokens(spark, folder, with_ids=True).collect()
    same([{"id": r.doc_id, "ids": tuple(r.ids)} for r in got], [{"id": d["doc_id"], "ids": (*brute.encode(d["text"]), 2)} for d in doc_rows])
    in_order = sorted(got, key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in in_order]
    assert ids == sorted(ids)
    assert [r.start for r in in_order] == [0, *np.cumsum([r.n_tokens for r in in_order])[:-1].tolist()]
    assert {m.width for m in manifest} == {2}
    assert token_output.token_documents(docs.limit(0), BPE, 2).collect() == []


def test_op1_wide_ids():
    assert token_output.id_type(50257, 2).itemsize == 2
    assert token_output.id_type(70000, 2).itemsize == 4
    assert token_output.id_type(1000, 70000).itemsize == 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\u2003", "'s", "'ll", "The", "x1", "!!", "<|endoftext|>", "<|", "中", "é", "\u0301"]), st.text(max_size=3)), max_size=30))
def test_pieces_encode_as_whole_text(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    want = brute.encode(text)
    assert np.frombuffer(units.ids_of(BPE, [text], np.dtype("<u2"))[0], "<u2").tolist() == want
    assert units.lengths_of(BPE, [text], {" The": 1}) == [len(want)]


def test_other_tokenizers_encode_whole_texts():
    texts = ["Some  text, twice.", "", None and "", "ÉA b"]
    texts = [t or "" for t in texts]
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert units.lengths_of(public_tokenizers.path("word_bpe_49k.json"), texts, {}) == [len(word.encode(t, add_special_tokens=False).ids) for t in texts]
    piece = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert units.lengths_of(public_tokenizers.path("piece_bpe_32k.model"), texts, {}) == [len(x) for x in piece.encode(texts)]


def test_op2(query, rows, same):
    same(query("op2_embedding_dedup"), brute.op2(rows("embeddings")))


VECTORS = "vec_id long, embedding array<float>, label int, node string, links int, band int, id int, count int"


def vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 24))
    out = [base[i] + rng.standard_normal(24) * s for i in range(6) for s in (0.0, 0.0, 0.1, 0.25, 0.3, 0.35)]
    out = [[float(np.float32(x)) for x in v] for v in out]
    rows = [(k, v, k % 2 + 1) for k, v in enumerate(out)]
    rows += [(100 + k, v, lab) for k, (v, lab) in enumerate([(None, 1), ([], 1), ([0.0] * 24, 1), ([float("nan")] * 24, 1), ([float("inf")] + [1.0] * 23, 1), ([None] + [1.0] * 23, 1), (out[0], None), (out[0], None)])]
    rows += [(200, [1.0, 2.0], 1), (201, [2.0, 4.0], 1), (202, [3.0], 1), (203, [5.0], 1), (204, [-5.0], 1), (0, out[1], 1)]
    return rows


def test_op2_cases(spark, same):
    some = [dict(zip(("vec_id", "embedding", "label"), r, strict=True)) for r in vectors()]
    df = spark.createDataFrame([(*r, "n", 1, 2, 3, 4) for r in vectors()], VECTORS)
    same(embedding_dedup.near_duplicates(df, 0.93).collect(), brute.op2(some))
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_op2_blocks(spark, same, monkeypatch):
    """A large group of near copies, cut into many blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(32)
    some = [{"vec_id": k, "embedding": (centre + rng.standard_normal(32) * 0.2).tolist(), "label": 1} for k in range(150)]
    df = spark.createDataFrame([(r["vec_id"], r["embedding"], 1) for r in some], "vec_id long, embedding array<double>, label int")
    same(embedding_dedup.near_duplicates(df, 0.93).collect(), brute.op2(some))


def test_op2_counts_every_link_of_a_large_group(spark):
    """Some 400,000 pairs between 0.93 and 0.95: none is lost, so n_links is exact."""
    rng, n, dim = np.random.default_rng(7), 1000, 64
    noise = rng.standard_normal((n, dim))
    noise[:, 0] = 0
    x = np.sqrt(0.06) * noise / np.linalg.norm(noise, axis=1)[:, None]
    x[:, 0] = np.sqrt(0.94)
    x = x @ np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    cosine = x @ x.T
    assert ((cosine > 0.93) & (cosine < 0.95)).sum() > 800_000
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, 0.93).collect()}
    assert [got[k] for k in range(n)] == ((cosine >= 0.93).sum(1) - 1).tolist()


def test_op2_stores_each_vector_once(spark, monkeypatch):
    """What lies in the shared folder does not grow with the number of bands: below three times the vectors."""
    folders, new_folder = [], shared.new_folder
    monkeypatch.setattr(shared, "new_folder", lambda *a: folders.append(new_folder(*a)) or folders[-1])
    x = np.random.default_rng(8).standard_normal((4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(df, 0.93).count() == 4000
    kept = [f for d in folders for f in Path(d.removeprefix("file:")).rglob("*") if f.is_file()]
    assert sum(f.stat().st_size for f in kept) < 3 * x.nbytes


def test_op2_ranges(spark, same, monkeypatch):
    """Buckets dealt to many tasks, and pairs looked for and computed a few at a time."""
    for name, value in (("UNIT", 64), ("CHUNK", 50), ("ROTATED", 7), ("SORTED", 32), ("PAIRS", 16)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 24))
    some = [{"vec_id": k, "embedding": (centres[k % 40] + rng.standard_normal(24) * 0.2).tolist(), "label": k % 2} for k in range(300)]
    df = spark.createDataFrame([(r["vec_id"], r["embedding"], r["label"]) for r in some], "vec_id long, embedding array<double>, label int")
    same(embedding_dedup.near_duplicates(df, 0.93).collect(), brute.op2(some))


def test_op2_estimates_are_unbiased():
    rng = np.random.default_rng(7)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.standard_normal((2, 400, 64)))
    bits, factor = embedding_dedup.encode(x, 448)
    value, error = embedding_dedup.estimate(bits, factor, y, 448)
    off = (value - x @ y.T) / error[:, None]
    assert abs(off.mean()) < 0.05
    assert (np.abs(off) < embedding_dedup.SIGMAS).all()


def test_op3(query, rows):
    docs = {d["doc_id"]: d for d in rows("documents")}
    got = query("op3_mixing")
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    aims, taken = brute.op3_targets(list(docs.values())), {}
    for r in got:
        d = docs[r["doc_id"]]
        assert r["size"] == brute.size(d["text"])
        assert r["source_size"] == aims[d["source"]][0]
        assert r["target"] == pytest.approx(aims[d["source"]][1])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[d["source"]] = taken.get(d["source"], 0) + r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - t) <= 2 * largest for s, (_, t) in aims.items())
    assert sorted(map(repr, got)) == sorted(map(repr, query("op3_mixing")))


def test_op3_cases(docs, doc_rows):
    got = mixing.copies(docs).collect()
    assert len(got) == len(doc_rows)
    assert sorted(r["size"] for r in got) == sorted(brute.size(d["text"]) for d in doc_rows)
    assert all(0 <= r.copies <= 2 for r in got)
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns
    assert whole.count() == sum(r.copies for r in got)
    assert mixing.mixed(docs.limit(0)).collect() == []


def test_op3_targets_stop_and_share_again():
    assert mixing.targets([10, 100, 100], [3, 1, 2], 300) == pytest.approx([20, 280 / 3, 560 / 3])
    assert mixing.targets([10, 10], [1, 1], 30) == [15, 15]
    assert mixing.targets([0, 10], [1, 1], 15) == [0, 15]


@pytest.mark.parametrize("seed", range(4))
def test_op3_table_of_targets_as_plain(spark, seed):
    rng = random.Random(seed)
    sizes = {None: 40, **{f"s{i:04}": rng.choice([0, 3, rng.randrange(1000), 10 * i]) for i in range(rng.choice([1, 7, 500]))}}
    df = shared.stored(spark.createDataFrame(list(sizes.items()), "source string, size long"), "sizes")
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    for share in (0.4, 1.5, 2.5):
        want = mixing.targets([sizes[s] for s in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], share * sum(sizes.values()))
        got = {r.source: r.target for r in mixing.source_targets(df, share=share).collect()}
        assert [got[s] for s in names] == pytest.approx(want)
    assert mixing.source_targets(df.limit(0)).collect() == []


def test_op3_rows_that_differ_in_maps_only(spark):
    rows = [(1, "one two", "a", {"k": str(i), "z": "0"}) for i in range(6)] + [(1, "one two", "a", {"z": "0", "k": "1"})]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,string>")
    hashes = {(r.h, tuple(sorted(r.tags.items()))) for r in df.select(mixing._row_hash(df).alias("h"), "tags").collect()}
    assert len({h for h, _ in hashes}) == len(hashes) == 6
    drawn = mixing.mixed(df).collect()
    assert {tuple(sorted(r.tags.items())) for r in drawn} == {tuple(sorted(r[3].items())) for r in rows}
    assert len({r.tags["k"] for r in drawn}) == 6  # each is drawn once or twice


def test_op4(query, rows, same):
    same(query("op4_decontaminate"), brute.op4(rows("documents"), rows("benchmark")))


ITEMS = [(1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (2, "Four Words, here"), (2, "four words here"), (3, "four words here"), (4, None), (5, " ... "), (None, "other"), (6, "ÜNÏCODE unit"), (7, "É unit ünïcode")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_op4_cases(spark, docs, doc_rows, same, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", 0)
    items = spark.createDataFrame([(*r, "w", 1) for r in ITEMS], "item_id long, text string, window string, len int")
    got = decontaminate.contamination(docs, items, 10)
    got = got.withColumn("n_items", F.size("items")).withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)).withColumn("contaminated", F.col("n_hit") > 0)
    want = brute.op4(doc_rows, [{"item_id": i, "text": t} for i, t in ITEMS])
    same(got.collect(), want)
    clean = decontaminate.clean_documents(docs, items, 10)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not r["contaminated"] for r in want)


def test_op4_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Before, four  words here! after"), (2, "nothing"), (3, None), (4, "four words here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Four words here")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.cut_spans(docs, items).collect()}
    assert got == {1: "Before, after", 2: "nothing", 3: None, 4: ""}


def test_op4_empty_tables(spark, docs):
    items = spark.createDataFrame([(1, "four words here")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), items).collect() == []
    assert {r.n_hit for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}


def test_op5_held_out_accuracy(spark):
    """On the larger tables: labels of held-out rows, and no use of their labels."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op5_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(held) > 80
    assert np.mean([p == q for p, q in held]) > 0.97
    assert all(r.held_out == (brute.zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    turned = spark.createDataFrame([(r.doc_id, 1 - r.quality if got[r.doc_id].held_out else r.quality) for r in labels], "doc_id long, quality int")
    again = quality.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), turned).collect()
    # sums of doubles depend on their order
    assert {r.doc_id: r.score for r in again} == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-6)


def test_op5_matches_plain_densities():
    rng = np.random.default_rng(8)
    d = len(quality.FEATURES)
    model = quality.Model(rng.standard_normal((2, d)), np.stack([np.linalg.inv(np.linalg.cholesky(np.eye(d) * k)) for k in (1, 2)]), np.array([0.0, d / 2 * np.log(2)]), np.log([0.25, 0.75]))
    x = rng.standard_normal((5, d))
    density = [-0.5 * ((x - m) ** 2).sum(1) / k - d / 2 * np.log(k) + np.log(p) for m, k, p in zip(model.means, (1, 2), (0.25, 0.75), strict=True)]
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(density[0] - density[1])))


def test_op5_fit_as_plain(spark):
    """Means, shrunken covariances and scores of a fit, by numpy over the same rows, and the query's scores by them."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["the", "of", "Buy", "NOW!!", "x1", "###", "words."]) for _ in range(rng.randrange(3, 60))), i % 3 == 0) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, quality int")
    x = np.array([quality.statistics(t) for _, t, _ in rows])
    y = np.array([int(y) for _, _, y in rows])
    train = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in rows])
    parts = [x[train & (y == c)] for c in (0, 1)]
    spread = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * s for p, s in zip(parts, spread, strict=True)) / train.sum()
    d = len(quality.FEATURES)
    mild = pooled + np.eye(d) * (np.trace(pooled) / d * 1e-3 + 1e-9)
    target = (1 - quality.SHRINK_TO_IDENTITY) * mild + quality.SHRINK_TO_IDENTITY * np.eye(d) * np.trace(mild) / d
    logs = []
    for p, s in zip(parts, spread, strict=True):
        cov = (1 - quality.SHRINK_TO_POOLED) * s + quality.SHRINK_TO_POOLED * target
        off = x - p.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(p) / train.sum()))
    want = 1 / (1 + np.exp(logs[0] - logs[1]))
    got = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    assert [got[i] for i, _, _ in rows] == pytest.approx(want.tolist(), abs=1e-6)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for (i, _, _), s in zip(rows, want, strict=True) if s >= 0.5}


def test_op5_fits_on_a_bounded_number_of_ids(spark):
    docs = spark.range(50).selectExpr("id doc_id", "concat('text ', id) text")
    labels = spark.range(50).selectExpr("id doc_id", "cast(id % 2 as int) quality")
    some = [r.doc_id for r in quality.fit_rows(docs, labels, most=7).collect()]
    assert len(some) == 7 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in some)
    assert sorted(some) == sorted(r.doc_id for r in quality.fit_rows(docs, labels, most=7).collect())


def test_op5_cases(spark, docs, doc_rows):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(15)] + [(4, None, 0, "x"), (4, 1, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, stats string")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(doc_rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert all(0 <= r.score <= 1 for r in quality.score_documents(docs, some).collect())
    assert quality.score_documents(docs.limit(0), labels).collect() == []
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).count() == sum(r.predicted for r in got)


def test_op6(query, rows, same):
    own = [dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in queries.CONTROL_CHAT]
    same(query("op6_chat"), brute.op6(rows("conversations") + own))


TURNS = [
    (1, 0, "user", "[INST] hi [\\INST] </s>"), (1, 1, "assistant", None), (1, 2, "assistant", "<|endoftext|> \\</s> <\\s> é🙂"), (1, 2, "assistant", "tie"), (1, 2, "assistant", "tie"),
    (2, None, None, "no role"), (2, 1, "tool [/ROLE]", "[TEXT]"), (None, 0, "assistant", ""), (None, 1, "assistant", "  spaces  "), (3, 0, "system", None), (4, 0, "assistant", "x" * 50_000 + "\n" * 500),
]


def test_op6_cases(spark, same):
    df = spark.createDataFrame([(*r, "f", 1) for r in TURNS], "conv_id long, turn long, role string, text string, formatted string, ids int")
    made = chat.format_conversations(df, BPE)
    same(chat.digests(made).collect(), brute.op6([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in TURNS]))
    assert chat.format_conversations(df.limit(0), BPE).collect() == []
    for r in made.collect():
        assert brute.encode(r.formatted) == r.ids
        assert len(r.ids) == len(r.trains)
        assert 50256 not in r.ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x<s>"]), st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "a", " ", "INST]", "é🙂"]), max_size=8).map("".join)), max_size=6))
def test_op6_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    trains, ranges = chat.mask(brute.tokenizer().encode(formatted, add_special_tokens=False).offsets, spans)
    assert "".join(chat.unescape(formatted[a:b]) for a, b in ranges) == "".join(t for r, t in turns if r == "assistant")


def test_op7(query, rows, same):
    same(query("op7_minhash"), brute.op7(rows("documents")))


def test_op7_cases(docs, doc_rows, same):
    known = [d for d in doc_rows if d["doc_id"] is not None]
    got = minhash.near_duplicates(docs, 85).collect()
    same([r for r in got if r.doc_id is not None], brute.op7(known))
    assert len(got) == len(doc_rows)
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None and r.n_shingles) == [(56, 4, False)] * 2
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_op7_keep_first(docs):
    left = minhash.keep_first(docs, 85)
    assert left.columns == docs.columns
    # 4, 5, 6 and the rows without id are one group; 7 and two rows of 8 another
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in left.collect()) == [-1, 1, 2, 3, 4, 7, 8, 9, 10, 11, 12, 13]


def test_op7_chains_and_shared_passages(spark, same):
    """Links only along a chain, and a passage that unlike documents share."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[4 * k : 4 * k + 150]) for k in range(12)]
    passage = " ".join(f"p{i}" for i in range(60))
    others = [passage + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 80))) for _ in range(40)]
    some = [{"doc_id": k, "text": t} for k, t in enumerate(rnd.sample(chain + others, 52))]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in some], "doc_id long, text string")
    same(minhash.near_duplicates(df, 85).collect(), brute.op7(some))
    same(minhash.near_duplicates(df, 70).collect(), brute.op7(some, 70))


def test_op7_rows_without_id_meet_their_own_text(spark, monkeypatch):
    """Near copies that all lack an id, each row three times: every node's text is hashed once."""
    texts = [" ".join([f"t{g}x{i}" for i in range(100)] + [f"end{e}"]) for g in range(10) for e in range(2)]
    df = spark.createDataFrame([(None, t) for t in texts * 3], "doc_id long, text string")
    hashed, kind, original = [], type(df), type(df).mapInArrow

    def watched(self, func, *args, **kwargs):
        if func is minhash._full_sets:
            hashed.append(self.count())
        return original(self, func, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    got = minhash.near_duplicates(df, 85).collect()
    assert sum(hashed) == len(texts)
    assert [(r.n_shingles, r.component_id, r.kept) for r in got] == [(97, None, False)] * 60
    assert len({r.text.rsplit(" ", 1)[0] for r in minhash.keep_first(df, 85).collect()}) == minhash.keep_first(df, 85).count() == 10


def test_op7_estimates():
    rng = np.random.default_rng(10)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(40):
            pool = np.unique(rng.integers(0, 1 << 64, 4000, np.uint64))
            both = int(2000 * share)
            a, b = np.sort(pool[:2000]), np.sort(pool[2000 - both : 4000 - both])
            x, y = minhash.sketch(a), minhash.sketch(b)
            used = np.array([((x != minhash.EMPTY) | (y != minhash.EMPTY)).sum()])
            match = np.array([((x == y) & (x != minhash.EMPTY)).sum()])
            errors.append(minhash.similarity(match, used, np.array([2000.0]), np.array([2000.0]))[0] - both / (4000 - both))
        assert abs(np.mean(errors)) < 0.03


def test_components(spark):
    rnd = random.Random(11)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 520)] + [(5, 5), (None, 3)]
    sets = brute.Sets()
    for a, b in edges:
        if a is not None:
            sets.join(a, b)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.root(x) for x in list(sets.parent) if sets.root(x) != x}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_op8(query, rows, same):
    same(query("op8_url_filter"), brute.op8(rows("pages"), queries.URL_RULES))


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.org/es/x", "http://a.example.org/en/12", "http://example.org", "http://xexample.org/es/", "ftp://example.org:80/es/", "x://b.com/de/?q", "x://b.com?/de/", "x://b.com#/fr/", "a://b://c.com/fr/", "http://com/fr/1", "http://É.com/FR/", "http://" + "a." * 500 + "com/fr/" + "y" * 5000, "http://t.net/a"]
RULES = [*queries.URL_RULES, ("t.net", "/a", "allow"), ("T.net", "/a", "block"), (None, "/", "block"), ("", "/", "block"), ("c.com", None, "block")]


def test_op8_cases(spark, same):
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(URLS)] + [(None, URLS[5], "h", "p")] * 2, "page_id long, url string, host string, path string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plain = [((h or "").lower(), p or "", v) for h, p, v in RULES if h]
    want = brute.op8([{"page_id": r.page_id, "url": r.url} for r in pages.collect()], plain)
    same(url_filter.judge_urls(pages, rules).collect(), want)
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}


def test_op8_many_files_and_collisions(spark, same, monkeypatch):
    """Rules over several files, and digests that all collide."""
    rules = [(f"h{k}.org", f"/{k % 7}", "block" if k % 2 else "allow") for k in range(300)]
    pages = [{"page_id": k, "url": f"http://www.h{k}.org/{k % 7}/x"} for k in range(400)]
    df = spark.createDataFrame([(p["page_id"], p["url"]) for p in pages], "page_id long, url string")
    monkeypatch.setattr(url_filter, "RULES_PER_FILE", 40)
    same(url_filter.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect(), brute.op8(pages, rules))

    class Known(url_filter.Rules):
        def __init__(self):
            strings = [f"block\n{url_filter.key(h, p)}".encode() for h, p, _ in rules[:5]]
            self.parts = [(np.zeros(5, "<u8"), np.cumsum([0, *map(len, strings)]), shared.pa.py_buffer(b"".join(strings)))]
            self.firsts = np.zeros(1, "<u8")

    keys = [url_filter.key(h, p) for h, p, _ in rules[:8]]
    assert Known().find(np.zeros(8, np.uint64), keys) == ["block"] * 5 + [None] * 3


def test_op9(query, rows, same):
    same(query("op9_token_count"), brute.op9(rows("documents")))


def test_op9_cases(docs, doc_rows, same):
    same(token_count.count_tokens(docs, BPE, 5).collect(), brute.op9(doc_rows, 5))
    assert token_count.count_tokens(docs.limit(0), BPE, 5).collect() == []


def test_op10(query, rows, same):
    same(query("op10_line_dedup"), brute.op10(rows("documents")))


@pytest.mark.parametrize("full", [False, True])
def test_op10_cases(docs, doc_rows, same, monkeypatch, full):
    """Also with filters so small that every bit is set: more is shuffled, the result is the same."""
    if full:
        monkeypatch.setattr(line_dedup, "MIN_FILTER_BYTES", 64)
        monkeypatch.setattr(line_dedup, "MAX_FILTER_BYTES", 64)
    got = line_dedup.dedup_lines(docs).withColumn("kept_sha256", F.sha2(F.col("text").cast("binary"), 256)).collect()
    same(got, brute.op10(doc_rows))
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_op10_rows_carry_keys_of_their_own_text(spark, same, monkeypatch):
    """Rows without an id, and rows of one id, with two repeated lines each."""
    some = [{"doc_id": i, "text": f"repeated line {k} first\nown line {i} {k} {j}\nrepeated line {k} second"} for k in range(40) for j, i in enumerate((k, None, 1000))]
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in some], "doc_id long, text string")
    carried, kind, original = [], type(df), type(df).mapInArrow

    def watched(self, func, *args, **kwargs):
        if "keys" in self.columns:
            carried.append(self.agg(F.max(F.size("keys"))).first()[0])
        return original(self, func, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    got = line_dedup.dedup_lines(df).withColumn("kept_sha256", F.sha2(F.col("text").cast("binary"), 256)).collect()
    same(got, brute.op10(some))
    assert carried == [2]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = connect(DATA)
    assert differences(queries.QUERIES[name](spark, DATA), con, ORACLE[name]) == ""


@pytest.mark.parametrize("what", ["ids", "lengths"])
def test_pieces_are_kept_up_to_a_number_of_bytes(monkeypatch, what):
    """With room for a few pieces only the ids stay right, and no more than one batch of pieces goes beyond the bound."""
    monkeypatch.setattr(units, "KEPT_BYTES", 2000)
    units._kept.cache_clear()
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)] * 2
    for text in texts:
        if what == "ids":
            assert np.frombuffer(units.ids_of(BPE, [text], np.dtype("<u2"))[0], "<u2").tolist() == brute.encode(text)
        else:
            assert units.lengths_of(BPE, [text], {}) == [len(brute.encode(text))]
        kept = units._kept(BPE, "<u2" if what == "ids" else "length")
        assert len(kept) <= 2000 // units.ENTRY_BYTES + 31
    units._kept.cache_clear()


def test_columns_with_the_names_of_helpers(spark):
    """Operators that return rows keep columns of any name, also those that they would use themselves."""
    names = ["mix_key", "mix_n", "dedup_key", "hit_id", "hit_text", "hit_spans", "fit_id", "_mix_n", "__mix_key", "__spans", "at", "n", "row_hash"]
    rows = [(i, text, "s", *[f"{n}{i}" for n in names]) for i, text in enumerate(["one two three four five six", "ONE two three four five six", "other words stand in this text", None, ""])]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` string" for n in names)]))
    items = spark.createDataFrame([("x", "three four five")], "item_id string, text string")
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")
    given = {r.doc_id: r for r in df.collect()}
    results = {
        "mixed": mixing.mixed(df), "first": minhash.keep_first(df), "clean": decontaminate.clean_documents(df, items, 3), "good": quality.keep_good(df, labels),
    }
    for name, out in results.items():
        assert out.columns == df.columns, name
        assert all(given[r.doc_id] == r for r in out.collect()), name
    assert {r.doc_id for r in results["first"].collect()} == {0, 2, 3, 4}
    assert {r.doc_id for r in results["clean"].collect()} == {2, 3, 4}
    cut = decontaminate.cut_spans(df, items, 3)
    assert cut.columns == df.columns
    assert {(r.doc_id, r.text, r.hit_spans) for r in cut.collect()} == {(0, "one two six", "hit_spans0"), (1, "ONE two six", "hit_spans1"), (2, rows[2][1], "hit_spans2"), (3, None, "hit_spans3"), (4, "", "hit_spans4")}


def test_op10_keeps_the_largest_id(spark):
    most = (1 << 63) - 1
    df = spark.createDataFrame([(most, "a line of text\nb"), (1, "A line of text"), (None, "a line of text")], "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {most: (1, "b"), 1: (0, "A line of text"), None: (1, "")}


def test_stored_steps_take_small_batches(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(shared, "BATCH_BYTES", 100_000)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    df = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t")).mapInArrow(sizes, "n long")
    found = [r.n for r in shared.stored(df, "sizes").collect()]
    assert len(found) > 10 and max(found) < 250_000
    assert spark.conf.get(key) == before
