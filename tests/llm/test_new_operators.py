"""Token shards, filter audit and Merkle manifest: small tables with every odd case, and brute force."""

import random
import re
import zlib
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapane.llm import filter_audit, language_id, merkle, ngram_lm, queries, shared, token_store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, grp long, pos long, part int, shard int, failed int"
ODD = [
    (7, "two words", "en", "b", 9), (3, None, None, "a", 0), (4, "", "en", None, 0), (5, " \t\n ", "fr", "", 4), (1, "One  Two\n\n three | x", "en", "a", None), (2, "two words", "en", "a", 9), (9, "éß 漢字 🎈 don't", "fr", "b", -7),
    (9, "éß 漢字 🎈 don't", "fr", "b", -7), (9, "another text of the same id", "fr", "b", 3), (None, "two words", "en", "b", 7), (None, "two words", None, None, None), (21, "w " * 250, "de", "a", 500), (22, "end <|endoftext|> here", "de", "a", 2**63 - 1),
    (-5, " ".join(f"w{i % 97}x" for i in range(300)), "", "a", 1), (28, "x" * 70_000 + " y", "de", "b", 7), (35, "A B C $5", "é", "b", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4, 5, 6) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- token shards ----------------------------------------------------------------------------------------------------


def test_monotone_sequences():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 255, 256, 257, 3000):
        for top in (1, 3, 1000, 1 << 40):
            values = np.sort(r.integers(0, top, n))
            coded = token_store.Monotone.encode(values)
            assert (coded.all().astype(np.int64) == values).all()
            assert (coded.get(np.arange(n)).astype(np.int64) == values).all()
    dense = token_store.Monotone.encode(np.cumsum(r.integers(1, 600, 20_000)))
    assert sum(map(len, dense.buffers())) * 8 / 20_000 < 2 + np.log2(300) + 1  # bits a boundary


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_library_s_ids(name):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(name)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    made, plain = token_store.Encoder(spec, 2), Tokenizer.from_file(path)
    assert made.by_runs == (name == "byte_bpe_50k.json")
    rng = random.Random(3)
    bits = ["a", "Word", " ", "  ", "\n", "\t", "é", "漢", "12", "don't", "'s", ".", "...", "$", "\x1c", "　", "<|endoftext|>", "🎈", "Ⅷ"]
    for text in ["", " ", "a", *("".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(2000))]:
        assert np.frombuffer(made.encode(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_memo_forgets_and_gives_the_same():
    calls = []
    memo = token_store.Memo(lambda k: calls.append(k) or k.encode(), most=3)
    for k in "abcdeabcaaf" * 3:
        assert memo[k] == k.encode()
    assert len(memo) <= 3 and len(calls) < 33


def expected_tokens(rows):
    from tokenizers import Tokenizer

    plain, start, out = Tokenizer.from_file(queries.tokenizer_path(queries.TOKENIZER)), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_token_shards_of_odd_rows(spark, odd):
    shards = token_store.write_tokens(odd, queries.tokenizer_path(queries.TOKENIZER))
    got = token_store.boundaries(shards).collect()
    want = expected_tokens([r[:2] for r in ODD])
    once = [x for x in want if x[0] is not None and x[0] != 9]
    by_id = {r["doc_id"]: tuple(r) for r in got}
    assert all(by_id[x[0]] == x[:4] for x in once) and len(got) == len(want)
    for doc_id in (None, 9):  # rows that share an id: any order, but next to each other
        mine, its = sorted(tuple(r)[1:] for r in got if r["doc_id"] == doc_id), [x for x in want if x[0] == doc_id]
        assert mine[0][0] == its[0][1] and sorted(x[1:] for x in mine) == sorted(x[2:4] for x in its)
        assert all(a[0] + a[1] == b[0] for a, b in zip(mine, mine[1:], strict=False))
    lists = {r["doc_id"]: r["ids"] for r in token_store.token_ids(shards).collect()}
    assert all(lists[x[0]] == x[4] for x in once)
    rows = sorted(shards.collect())
    assert [r["base"] for r in rows] == [sum(x["n_ids"] for x in rows[:i]) for i in range(len(rows))]


def test_random_access_in_a_shard(tmp_path):
    rows = [(None, b""), (-3, b"\x01\x00\x02\x00"), (5, b""), (2**62, b"\x07\x00" * 4000)]
    path, n, n_ids = token_store.write_shard(f"file://{tmp_path}/a/0.tok", iter(rows), 2, 9)
    shard = token_store.Shard(path)
    assert (n, n_ids) == (4, 4006) and shard.doc_ids() == [None, -3, 5, 2**62]
    assert shard.document(1).tolist() == [1, 2, 9] and shard.document(0).tolist() == [9] and len(shard.document(3)) == 4001
    begin, end = shard.bounds(np.arange(4))
    assert begin.tolist() == [0, 1, 4, 5] and end.tolist() == [1, 4, 5, 4006]
    assert [f for f, _, _ in shard.blocks(8)] == [0, 2, 3]
    with pytest.raises(ValueError, match="not a token shard"):
        (tmp_path / "b").write_bytes(b"x" * 200)
        token_store.Shard(f"file://{tmp_path}/b")


def test_a_frequent_id_spans_shards(spark):
    docs = spark.range(600).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    shards = token_store.write_tokens(docs.repartition(3), queries.tokenizer_path(queries.TOKENIZER))
    assert shards.where("n_docs > 300").isEmpty()
    got = sorted(token_store.boundaries(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [7] * 400 + list(range(400, 600)) and got[-1]["start"] == 599 * 3


def test_many_nulls_span_shards(spark):
    docs = spark.range(300).select(F.when(F.col("id") == 299, -(2**63)).when(F.col("id") > 200, F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    shards = token_store.write_tokens(docs.repartition(3), queries.tokenizer_path(queries.TOKENIZER))
    assert shards.where("n_docs > 150").isEmpty()
    got = sorted(token_store.boundaries(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 201 + [-(2**63)] + list(range(201, 299))


# ---- filter audit ------------------------------------------------------------------------------------------------------


def test_transducer_against_brute_force():
    rng = random.Random(5)
    texts = ["", " ", "a", "A\x0bB", "é É\tß", "x" * 100 + " " + "x" * 100 + "y", *("".join(rng.choices("aAbZ é漢🎈$|\n\t", k=rng.randrange(60))) for _ in range(500))]
    found = filter_audit.transduce(pa.array([None, *texts]), filter_audit.byte_table())
    for i, t in enumerate(["", *texts]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert tuple(int(v[i]) for v in found.values()) == (len(w), len(set(w)), len(re.findall("[A-Z]", t)), len(t), len(re.findall(r"[#$%&*|]", t))), t


def test_words_with_equal_digests_stay_apart():
    raw = np.frombuffer(b"abc abd abc xbc abd", np.uint8)
    start, size = np.array([0, 4, 8, 12, 16]), np.full(5, 3)
    clash = np.full(5, 7, np.uint64)
    assert filter_audit.distinct_spans(raw, np.zeros(5, np.int64), start, size, 1, clash).tolist() == [3]
    assert filter_audit.distinct_spans(raw, np.array([0, 0, 1, 1, 1]), start, size, 2, clash).tolist() == [2, 3]


def brute_audit(rows, labels):
    def failed(doc_id, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        out = {"A"} if len(w) < 200 else set()
        out |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        return out | ({"E"} if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows) else set())

    docs = [(p or "", failed(i, t or ""), any(x == i and q == 1 for x, q, _ in labels if x is not None), any(x == i and t == 1 for x, _, t in labels if x is not None)) for i, t, p in rows]
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for k, own in enumerate(order):
                mine = [d for d in docs if d[0] == part]
                gone = [d for d in mine if own in d[1] and not d[1] & set(order[:k])]
                kept = sum(not d[1] & set(order[: k + 1]) for d in mine)
                redundant = sum(own in d[1] and bool(d[1] & set(order[:k])) for d in mine)
                out[part, "".join(order), k + 1] = (kept, len(gone), redundant, sum(d[1] == {own} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), own)
                total[part, own] = total.get((part, own), 0) + len(gone)
    return {k: (*v[:6], total[k[0], v[6]]) for k, v in out.items()}


def test_audit_against_brute_force(spark, odd):
    labels = [(7, 1, 0), (7, 0, 1), (9, 1, None), (21, None, 1), (None, 1, 1), (99, 1, 1), (2, 1, 1)]
    found = filter_audit.audit(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found.collect()}
    assert found.dtypes[:3] == [("part", "string"), ("filter_order", "string"), ("step", "int")]
    assert got == brute_audit([(r[0], r[1], r[3]) for r in ODD], labels)


# ---- Merkle manifest ---------------------------------------------------------------------------------------------------


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity=2, tampered=lambda doc_id: doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: H(*map(field, (i, s, lang, n, t)))

    def grow(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
        return levels

    def climb(levels, i, value):
        proof = []
        for level in levels[:-1]:
            at = i - i % arity
            run = level[at : at + arity]
            proof += [d for j, d in enumerate(run) if at + j != i]
            run[i - at] = value
            value, i = H(*run), i // arity
        return value, proof

    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted(((r[0], leaf(*r), r) for r in rows if r[2] == lang), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((mine, grow([x[1] for x in mine])))
    top, out = grow([t[1][-1][0] for t in trees]), []
    for g, (mine, levels) in enumerate(trees):
        for i, (doc_id, digest, r) in enumerate(mine):
            n = None if r[4] is None else r[4] + 1
            value = leaf(*r[:4], n) if tampered(doc_id) else digest
            low, below = climb(levels, i, value)
            root, above = climb(top, g, low)
            out.append((doc_id, digest, levels[-1][0], top[-1][0], H(*below, *above), root, root == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_of_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str) == brute_manifest([r[:5] for r in ODD])


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_over_several_tiers(spark, monkeypatch, arity):
    """Blocks of 8 or 9 nodes, so that there are several tiers of documents and of groups, with groups of every size from 1 on."""
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(i, f"text {i}", None if i % 31 == 30 else f"g{min(i % 31, i % 7)}" if i < 400 else f"h{i}", "s", i) for i in range(430)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    changed = {"n_chars": F.col("n_chars") + 1}
    found = merkle.manifest(docs, arity=arity, changed=changed, where=F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_manifest(rows, arity)


@pytest.mark.parametrize("n", [1, 2])
def test_lone_leaves(spark, n):
    rows = [(i, "t", f"l{i}", "s", 1) for i in range(n)]
    found = merkle.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_manifest(rows, tampered=lambda i: False)


# ---- all three ---------------------------------------------------------------------------------------------------------


def test_empty_tables_of_the_new_operators(spark, empty):
    assert token_store.boundaries(token_store.write_tokens(empty, queries.tokenizer_path(queries.TOKENIZER))).collect() == []
    assert filter_audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    assert merkle.manifest(empty).collect() == []


def test_op11_against_the_library(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op11_token_store(spark, sf_dir).collect())
    assert got == [x[:4] for x in expected_tokens(docs)]


# ---- mended operators --------------------------------------------------------------------------------------------------


def test_a_lost_model_file_is_an_error(spark, odd, tmp_path, monkeypatch):
    import glob
    import os

    monkeypatch.setattr(shared, "shared_dir", lambda s: f"file://{tmp_path}")
    whole = ngram_lm.score(odd, odd)
    files = glob.glob(f"{tmp_path}/terrapane-lm-*/pairs-*")
    os.remove(max(files, key=os.path.getsize))
    with pytest.raises(Exception, match="No such file"):
        whole.collect()


def test_sample_draws_rows_without_ids_and_repeated_rows_once(spark):
    nulls = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    again = spark.range(4000).select(F.lit(7).alias("doc_id"), F.lit("le texte").alias("text"), F.lit("fr").alias("lang"))
    got = language_id.sample(nulls.unionByName(again), "lang")
    assert got["fr"] == ["le texte"] and len(got["en"]) > language_id.TRAIN_DOCS / 2
