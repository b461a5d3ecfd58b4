"""Tokenization automaton, hard negatives and Merkle manifest against plain versions, on small tables with odd rows."""

import hashlib
import math
import pickle
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import bpe, hard_negatives, merkle, mixing
from riskloom.llm.registry import ORACLES, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, leaf string, root string, key string"


@pytest.fixture(scope="module")
def automaton():
    return bpe.load(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def row(i, text, lang="en", source="s", n=1):
    return (i, text, lang, source, n, "x", "y", "z", "k")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977} x{i}\n" for i in range(20000))
    rows = [row(1, None), row(2, ""), row(3, " \n\t  "), row(4, "one<|endoftext|> two", None), row(4, "other text"), row(6, "same"), row(6, "same"), row(7, long),
            row(8, "a" * 50000, "de"), row(9, " " * 50000, "de"), (None, "no id", "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None),
            row(10, "\U0001F600 ՘ Ᲊ \x00 \x1c don't é漢字", "", ""), row(28, "n", "zz", "s", (1 << 63) - 1), row(29, "m", "zz", None, None)]
    return spark.createDataFrame(rows + [row(100 + i, f"text {i}", "\U0001F600" if i % 2 else "￿") for i in range(37)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_merkle"])
def test_sql(spark, name):
    assert compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF) is None


# ------------------------------------------------------------------ 11

def test_bpe_of_documents(spark, odd, automaton, library):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = real.withColumn("doc_id", F.col("doc_id") + 1000).union(odd.select("doc_id", "text"))
    encoded = bpe.encode(docs, automaton)
    got = [(r.doc_id, list(r.ids), r.decoded) for r in bpe.decode(encoded, automaton).collect()]
    want = [(i, e.ids, library.decode(e.ids, skip_special_tokens=False)) for (i, t) in map(tuple, docs.collect()) for e in [library.encode(t or "", add_special_tokens=False)]]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bpe_keeps_columns(odd, nothing, automaton):
    encoded = bpe.encode(odd, automaton).withColumn("decoded", F.lit("clash"))
    back = bpe.decode(encoded, automaton)
    assert back.columns == ["doc_id", "ids", "decoded"] and not back.where("decoded = 'clash'").count()
    assert bpe.encode(nothing, automaton).count() == 0
    assert bpe.decode(encoded.withColumn("ids", F.lit(None).cast("array<int>")), automaton).where("decoded IS NOT NULL").count() == 0


@pytest.mark.parametrize("words", [bpe.PIECES, 7])
def test_bpe_of_strange_texts(automaton, library, words, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", words)
    rnd = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "a", "the", " The", "'s", "'ll", "1", "22", "é", "ß", "՘", "Ᲊ", "漢", "\U0001f600", "\x00", "\x1c", "\x85", "\xa0", " ", "...", "==",
            "<|endoftext|>", "<|endof", "́", "ا", "क्", "\U00013456"]
    for i in range(4000):
        text = "".join(rnd.choice(bits) if i % 2 else chr(rnd.choice([rnd.randint(97, 105), rnd.randint(0, 0x2ff), rnd.randint(0, 0xd7ff), rnd.randint(0xe000, 0x10ffff)]))
                       for _ in range(rnd.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text).tolist() == ids and automaton.decode(ids) == text


def test_bpe_of_every_character(automaton, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(every), 50000):
        text = "".join(f"a{c}1{c}!{c} " for c in every[i:i + 50000])
        assert automaton.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def merged_plainly(word, merges):
    parts = list(word)
    for u, v, both in merges:
        i, out = 0, []
        while i < len(parts):
            if parts[i:i + 2] == [u, v]:
                out.append(both)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@pytest.mark.parametrize("seed", range(30))
def test_automaton_of_small_vocabularies(seed):
    """Random merges over three letters: every word of up to seven letters has the path that merging in order gives, and no other path."""
    rnd = random.Random(seed)
    labels, merges = [b"a", b"b", b"c"], []
    while len(merges) < 12:
        u, v = rnd.choice(range(len(labels))), rnd.choice(range(len(labels)))
        if labels[u] + labels[v] not in labels and len(labels[u] + labels[v]) < 7:
            merges.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
    a = bpe.compiled(labels, merges, {}, {"L": [(97, 122)], "N": [(48, 57)], "S": [(32, 32)]})
    a = pickle.loads(pickle.dumps(a))

    def paths(word, state=0):
        if not word:
            return [[]]
        return [[t, *rest] for t, s in enumerate(labels) if word.startswith(s) and a.has_arc(state, t) and t in a.ends for rest in paths(word[len(s):], a.target[t])]

    for n in range(1, 8):
        for code in range(3 ** n) if n < 6 else rnd.sample(range(3 ** n), 100):
            digits = [code // 3 ** k % 3 for k in range(n)]
            word = bytes(97 + d for d in digits)
            assert a.encode_word(word) == merged_plainly(digits, merges)
            if n < 6:
                assert paths(word) == [a.encode_word(word)]


def test_words_stay_bounded(automaton, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 5)
    text = " ".join(f"word{i % 13}" for i in range(300))
    one = pickle.loads(pickle.dumps(automaton))
    assert one.encode(text).tolist() == automaton.encode(text).tolist()
    assert len(one.words) <= 5 and len(one.words.old) <= 5 and len(one.arcs) <= 5


def test_strange_vocabularies(tmp_path):
    with pytest.raises(ValueError):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        bpe.compiled([b"a", b"b", b"ab"], [(0, 1, 2), (0, 1, 2)], {}, {})


# ------------------------------------------------------------------ 12

def hard_plainly(rows, every=100):
    kept = []
    for k, (i, x, label) in enumerate(rows):
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((k, i, [math.floor(256 * float(c)) for c in x], math.fmod(label + 1, 10) if i % 7 == 0 else label))
    out = []
    for a in kept:
        if a[1] % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[2], r[2])), r[1], r[0], r[3]) for r in kept if r[0] != a[0] and len(r[2]) == len(a[2]))
        for p in [s for s in scored if s[3] == a[3]][:5]:
            allowed = [n for n in scored if n[3] != a[3] and 80 * -p[0] <= 100 * -n[0] <= 100 * -p[0]][:5]
            out += [(a[1], p[1], r + 1, n[1], -p[0], -n[0]) for r, n in enumerate(allowed)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, key string, score string, x string"


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(6, 18)) * 0.3
    rows = [(i, [float(np.float32(c)) for c in centres[rnd.integers(6)] + rnd.normal(size=18) * 0.1], int(rnd.integers(4)), "k", "s", "x") for i in range(900)]
    clash = [1.0] * 18
    rows += [(900 + i, clash, i % 3, "k", "s", "x") for i in range(30)] + [rows[0], rows[0], rows[3]]  # ties and repeated rows, an anchor among them
    rows += [(2000, None, 1, "k", "s", "x"), (2100, clash, None, "k", "s", "x"), (None, clash, 1, None, None, None), (2200, clash[:17] + [None], 1, "k", "s", "x"),
             (2300, clash[:17] + [math.nan], 1, "k", "s", "x"), (2400, clash[:17] + [-math.inf], 1, "k", "s", "x"), (2500, [], 1, "k", "s", "x"), (2501, [], 1, "k", "s", "x"),
             (2502, [], 2, "k", "s", "x"), (2600, [0.5, 0.5], 1, "k", "s", "x"), (2601, [0.5, 0.25], 1, "k", "s", "x"), (2602, [0.5, 0.125], 2, "k", "s", "x"),
             (2700, [3e6] * 3, 1, "k", "s", "x"), (2701, [3e6, 3e6, 3.00001e6], 1, "k", "s", "x"), (2702, [3e6, 2.9e6, 3e6], 2, "k", "s", "x")]
    return rows, spark.createDataFrame(rows, VECTORS).repartition(5)


@pytest.mark.parametrize("block", [hard_negatives.BLOCK_BYTES, 3000])
def test_hard_negatives(vectors, block, monkeypatch):
    """With all anchors at once and with a few a block."""
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    rows, table = vectors
    assert sorted(map(tuple, hard_negatives.mine(table).collect())) == hard_plainly([r[:3] for r in rows])


def test_hard_negatives_of_given_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert sorted(map(tuple, hard_negatives.mine(table, every=10).collect())) == hard_plainly(rows, every=10)


def test_hard_negatives_of_nothing(spark, vectors):
    table = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(table).collect() == []
    assert hard_negatives.mine(vectors[1].where("vec_id % 100 <> 0")).collect() == []
    assert hard_negatives.mine(vectors[1].where("vec_id = 100")).collect() == []


def test_huge_components_do_not_fail(spark):
    table = spark.createDataFrame([(100, [3e38, 3e38], 1), (101, [3e38, 3e38], 1), (102, [3e38, 3e38], 2)], "vec_id long, embedding array<float>, label int")
    (found,) = hard_negatives.mine(table).collect()
    assert found.positive_score == found.negative_score == (1 << 63) - 1


def test_segment_bounds_hold():
    """The products of two vectors lie within the bounds of every level."""
    rnd = np.random.default_rng(1)
    for n in (1, 3, 5, 17, 64, 100):
        a, b = (np.floor(rnd.normal(size=(40, n)) * 60 + 20) for _ in range(2))
        for parts in hard_negatives.LEVELS:
            (m, d), (m2, d2) = hard_negatives.summary(a, parts), hard_negatives.summary(b, parts)
            off = np.abs(a @ b.T - m @ m2.T) - d @ d2.T
            assert (off <= 1e-6).all()


def test_segments_rule_out_pairs():
    """Rows far from an anchor in their means are ruled out by the wide segments."""
    near, far = np.full((5, 64), 50.0), np.full((200, 64), -50.0)
    x = np.concatenate([near, far])
    rows = hard_negatives.Vectors(np.arange(205), np.arange(205), np.zeros(205, int), x, [hard_negatives.summary(x, p) for p in hard_negatives.LEVELS])
    anchors = rows.part(slice(0, 1))
    i, j, score = hard_negatives.within(rows, anchors, np.ones((205, 1), bool), np.array([1]), np.array([1 << 40]))
    assert i.tolist() == [0, 1, 2, 3, 4] and (score == 64 * 2500).all()


# ------------------------------------------------------------------ 13

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_plainly(r, more=0):
    fields = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree_plainly(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_plainly(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2))
        i //= 2
    return out


def proofs_plainly(rows, every=7):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    order = sorted(by, key=lambda lang: (lang is not None, (lang or "").encode()))
    for rs in by.values():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_plainly(r)))
    trees = {lang: tree_plainly([leaf_plainly(r) for r in by[lang]]) for lang in order}
    top = tree_plainly([trees[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for i, r in enumerate(by[lang]):
            path = path_plainly(trees[lang], i) + path_plainly(top, k)
            folded = leaf_plainly(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % every == 0))
            for beside, before in path:
                folded = H(folded) if beside is None else H(beside, folded) if before else H(folded, beside)
            out.append((r["doc_id"], leaf_plainly(r), trees[lang][-1][0], top[-1][0], H(*[s for s, _ in path if s]), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("stride, rows, every", [(merkle.STRIDE, 50_000, 7), (1, 50_000, 2), (2, 0, 7)])
def test_merkle(odd, stride, rows, every, monkeypatch):
    """Eight levels a step, each level a step, and with the node rows joined by a shuffle."""
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", rows)
    got = merkle.digest(merkle.proofs(odd, stride, every)).collect()
    assert sorted(map(tuple, got), key=repr) == proofs_plainly([r.asDict() for r in odd.collect()], every)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_merkle_of_few(odd, n):
    """One language of n rows, and n languages of one row."""
    base = odd.where("doc_id >= 100").orderBy("doc_id").limit(n)
    for docs in (base.withColumn("lang", F.lit("en")), base.withColumn("lang", F.concat(F.lit("l"), "doc_id"))):
        got = merkle.digest(merkle.proofs(docs, 1)).collect()
        assert sorted(map(tuple, got), key=repr) == proofs_plainly([r.asDict() for r in docs.collect()])


def test_merkle_of_nothing(nothing, spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert merkle.digest(merkle.proofs(nothing)).collect() == []
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_merkle_finds_a_changed_row(odd):
    """Siblings of the table as it was do not lead a changed row to the old root; unchanged rows do."""
    found = merkle.proofs(odd, every=1)
    assert {r.verified for r in found.where("doc_id IS NULL OR doc_id = 29").collect()} == {True}
    assert not found.where("doc_id IS NOT NULL AND doc_id <> 29 AND verified").count()


# ------------------------------------------------------------------ 7, once more

def test_draws_follow_one_law_on_both_sides_of_the_library(monkeypatch):
    """The sampler for large totals against exact shares of small ones, and against the moments of large ones."""
    good, bad, n = 12, 30, 9
    exact = np.array([math.comb(good, k) * math.comb(bad, n - k) for k in range(n + 1)]) / math.comb(good + bad, n)
    rng = np.random.default_rng(1)
    monkeypatch.setattr(mixing, "LIBRARY", 0)
    seen = np.bincount([mixing.hypergeometric(rng, good, bad, n) for _ in range(4000)], minlength=n + 1)
    assert (np.abs(seen / 4000 - exact) < 4.5 * np.sqrt(exact * (1 - exact) / 4000) + 1e-9).all()
    assert mixing.hypergeometric(rng, 5, 0, 3) == 3 and mixing.hypergeometric(rng, 0, 5, 3) == 0 and mixing.hypergeometric(rng, 4, 3, 7) == 4
    for library in (0, 10**9):
        monkeypatch.setattr(mixing, "LIBRARY", library)
        for total in (999_999_000, 1_000_001_000, 10**13):
            good, n = total // 3, total // 5
            draws = np.array([mixing.hypergeometric(rng, good, total - good, n) for _ in range(150)], float)
            sd = math.sqrt(n * (1 / 3) * (2 / 3) * (1 - n / total))
            assert abs(draws.mean() - n / 3) < 5 * sd / math.sqrt(150) and 0.7 < draws.std() / sd < 1.35


def test_split_tree_of_a_trillion_blocks():
    quotas = np.array([3 * 10**12, 7, 10**12 + 1])
    tree = mixing.split_tree(quotas, 64)
    assert (tree.sum(axis=0) == quotas).all() and (tree >= 0).all()
    assert tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 1
    assert (mixing.split_tree(quotas, 64) == tree).all()


def test_mixed_documents_with_clashing_ids(spark):
    """Two texts under one id keep their own sizes; nothing exceeds twice its size."""
    rows = [(5, " ".join(["a"] * 10), "x"), (5, " ".join(["b"] * 1000), "x"), (6, "c " * 300, "y"), (6, "c " * 300, "y"), (None, "d " * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r.asDict() for r in mixing.mixed_documents(docs).collect()]
    sizes = {len((r["text"] or "").split()) for r in got}
    assert sizes <= {10, 1000, 300, 40}
    for r in got:
        assert r["size"] == len(r["text"].split()) and 0 < r["taken"] <= 2 * r["size"]
    assert len(got) == len([r for r in mixing.mix(docs).collect() if r["taken"] > 0])
