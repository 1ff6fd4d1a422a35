"""The text operators on Spark: small tables with every odd case, and brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from terrapane.llm import decontamination, jaccard_join, language_id, media_columns, ngram_lm, queries, secret_scan, source_mixing, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, class long, bucket int, label int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def prose(seed, n):
    state, out = seed, []
    for _ in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append("w" + str(state >> 44))
    return " ".join(out)


LONG = prose(5, 30_000)
ODD = [
    (1, prose(1, 80), "en", "a", None), (2, prose(1, 80), "en", "a", 3), (3, prose(1, 80).upper(), "en", None, 3), (4, prose(1, 76) + " q r s t", "de", "a", 3), (5, None, None, "a", 0), (6, "", "en", "b", 0),
    (7, " \t\n ", "fr", "b", 4), (8, "two words", "en", "b", 9), (9, "Two\twords", "en", "b", 9), (10, "one", None, "b", 3), (11, LONG, "es", "a", 1), (12, LONG[: len(LONG) // 2] + " x " + LONG[len(LONG) // 2 :], "es", "a", 1),
    (13, prose(9, 30) + " " + prose(1, 60) + " " + prose(8, 40), "en", "b", 1), (14, "éß 漢字 🎈", "fr", "b", 7), (14, "éß 漢字 🎈", "fr", "b", 7), (15, "a a a a a a a a a a a a", "en", "b", 7), (None, prose(3, 20), "en", "b", 7),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 99, "k", 5, 1, 0) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components_on_odd_rows(odd, k, percent):
    rows = [(d, t) for d, t, *_ in ODD if d is not None]
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(odd.where("doc_id is not null"), k, percent).collect())
    assert got == brute_components(rows, k, percent)


@pytest.mark.parametrize("settings", [{}, {"TRIALS": 0, "BLOCK": 4}, {"TRIALS": 1, "BLOCK": 3}])
def test_components_of_near_copies_of_many_sizes(spark, monkeypatch, settings):
    """Copies with a growing number of changed words, so similarities lie on both sides of the threshold, in buckets beyond SMALL."""
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows, n = [], 0
    for base in range(3):
        body = prose(50 + base, 60 + 40 * base).split()
        for variant in range(25):
            text = body[:]
            for c in range(variant % 6):
                text[(variant * 7 + c * 11) % len(text)] = f"z{variant}-{c}"
            rows.append((n, " ".join(text)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(df, 4, 85).collect())
    assert got == brute_components(rows, 4, 85)


def test_components_by_plain_labels_equal_those_in_one_task(spark, monkeypatch):
    from terrapane.llm import graph

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 9] + [(100, 3), (100, 30)], "a long, b long")
    one = sorted(tuple(r) for r in graph.components(edges).collect())
    monkeypatch.setattr(graph, "TASK_EDGES", 5)
    assert sorted(tuple(r) for r in graph.components(edges.repartition(5)).collect()) == one


def test_contained_items(spark, odd):
    items = [(1, prose(1, 60)), (2, "two words"), (3, None), (4, ""), (5, prose(1, 20) + " no such words here at all in any text"), (6, " ".join(words(LONG)[15_000:15_040])), (6, "a a a"), (7, "one")]
    df = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t, *_ in ODD:
        for i, body in items:
            k = min(5, len(words(body)))
            if k:
                need = shingles(body, k)
                w = words(t)
                have = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
                if 100 * len(need & have) >= 80 * len(need):
                    want.append((d, i, len(need & have), len(need)))
    got = [tuple(r) for r in decontamination.contained_items(odd, df).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and want
    kept = decontamination.without_items(odd, df)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - len({i for i, (d, t, *_) in enumerate(ODD) if any(w[0] == d for w in want)})


def test_items_in_blocks_match_alike(spark, odd, monkeypatch):
    items = spark.createDataFrame([(i, prose(1, 40 + i)) for i in range(8)], "item_id long, text string")
    one = sorted(map(str, decontamination.contained_items(odd, items).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 100)
    assert sorted(map(str, decontamination.contained_items(odd, items).collect())) == one


def test_repeated_passages(spark):
    body = [prose(s, 300).split() for s in range(4)]
    passage = prose(77, 70).split()
    fuzzy = [w if i % 17 else f"f{i}" for i, w in enumerate(passage)]
    texts = [body[0][:100] + passage + body[0][100:], body[1] + passage, fuzzy + body[2], body[3], body[3], body[3][:40], passage[:30] + body[0][:5]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(90, None), (91, "")], "doc_id long, text string")
    got = [r.asDict() for r in substring_dedup.repeated_passages(df).collect()]
    pairs = {frozenset((r["doc_id"], r["other_id"])) for r in got if r["kind"] == "passage"}
    linked = set().union(*pairs)
    assert {0, 1, 2} <= linked and not linked & {5, 6, 90, 91}
    for r in got:
        if r["kind"] == "passage":
            a, b = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["other_id"]][r["other_start"] : r["other_end"]]
            assert min(len(a), len(b)) >= 50 and r["agreeing"] >= 0.8 * max(len(a), len(b))
    assert [(r["doc_id"], r["other_id"], r["end"]) for r in got if r["kind"] == "copy"] == [(4, 3, 300)]


def test_passages_made_of_frequent_phrases(spark):
    """Every run of 50 words or more that two texts share is in a row of both, though each short seed of it is in many texts of lower digest."""
    lines = [prose(1000 + n, 26).split() for n in range(12)]
    texts = {}
    for n in range(60):  # hubs: two of the lines each, apart from each other
        texts[n] = [*prose(2000 + n, 30).split(), *lines[n % 12], *prose(3000 + n, 30).split(), *lines[(n + 5) % 12], *prose(4000 + n, 30).split()]
    for n in range(6):  # pairs that share two lines in a row: 52 words
        for m in (0, 1):
            texts[100 + 2 * n + m] = [*prose(5000 + 2 * n + m, 45).split(), *lines[2 * n], *lines[2 * n + 1], *prose(6000 + 2 * n + m, 45).split()]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = substring_dedup.repeated_passages(df).collect()
    found = {i: [(r["start"], r["end"]) for r in got if r["doc_id"] == i] + [(r["other_start"], r["other_end"]) for r in got if r["other_id"] == i] for i in texts}
    assert all(any(s <= 45 and e >= 97 for s, e in found[i]) for i in range(100, 112)), found


def test_fuzzy_passages_of_frequent_seeds_only(spark):
    """Two texts of ten share 72 words of which every ninth differs, and 150 other texts quote 16 of the words each: all ten pairs are found."""
    texts = []
    for n in range(10):
        base = prose(100 + n, 72).split()
        texts += [[*prose(9000 + n, 40).split(), *base, *prose(9100 + n, 40).split()], [*prose(9200 + n, 50).split(), *(w if i % 9 else f"x{n}.{i}" for i, w in enumerate(base)), *prose(9300 + n, 60).split()]]
        texts += [[*prose(10_000 + 200 * n + m, 60).split(), *base[(s := m % 57) : s + 16], *prose(20_000 + 200 * n + m, 60).split()] for m in range(150)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {frozenset((r["doc_id"], r["other_id"])) for r in substring_dedup.repeated_passages(df).collect()}
    shares_a_seed = [n for n in range(10) if n * 152 in set().union(*got)]
    assert {frozenset((n * 152, n * 152 + 1)) for n in shares_a_seed} == got and len(shares_a_seed) >= 8


def test_every_pair_of_many_near_copies_has_a_passage(spark):
    """150 texts have the same 60 words, two of which differ in each (20 in the middle never do, so a seed is shared): all pairs of them are linked, and both places of a text that has them twice."""
    base, changed = prose(501, 60).split(), lambda n: {(7 * n) % 20, 40 + (11 * n) % 20}
    copy = lambda n: [w if i not in changed(n) else f"x{n}.{i}" for i, w in enumerate(base)]
    texts = [[*prose(30_000 + n, 40).split(), *copy(n), *prose(40_000 + n, 40).split()] for n in range(150)]
    texts[0] += [*copy(200), *prose(50_000, 40).split()]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substring_dedup.repeated_passages(df).collect()
    assert len({frozenset((r["doc_id"], r["other_id"])) for r in got}) == 150 * 149 // 2
    twice = [{r["start"] < 140 if r["doc_id"] == 0 else r["other_start"] < 140 for r in got if {r["doc_id"], r["other_id"]} == {0, n}} for n in range(1, 150)]
    assert all(len(t) == 2 for t in twice)


def test_a_stretch_that_is_twice_in_a_text_has_passages_at_both_places(spark):
    """A text has 250 words twice, so a seed's places among equal words; ten others have 60 of the words, every tenth changed, and 40 quote ten each."""
    base = prose(700, 250).split()
    texts = [[*base, *base]]
    texts += [[*prose(60_000 + n, 40).split(), *(w if (i + n) % 10 else f"x{n}.{i}" for i, w in enumerate(base[95:155])), *prose(61_000 + n, 40).split()] for n in range(10)]
    texts += [[*prose(62_000 + n, 60).split(), *base[90 + n : 110 + n], *prose(63_000 + n, 60).split()] for n in range(40)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substring_dedup.repeated_passages(df).collect()
    places = {n: {(r["start"] if r["doc_id"] == 0 else r["other_start"]) >= 250 for r in got if {r["doc_id"], r["other_id"]} == {0, n}} for n in range(1, 11)}
    found = [p for p in places.values() if p]
    assert len(found) >= 8 and all(p == {False, True} for p in found)


def test_lm_against_plain_python(spark, odd):
    train = odd.where("doc_id % 5 <> 1")
    got = {(r["doc_id"], r["n_tokens"]): r for r in ngram_lm.score(odd, train).collect()}
    end = ("</s>",)
    c, pairs = Counter(), Counter()
    for d, t, *_ in ODD:
        if d is not None and d % 5 != 1:
            seq = [*words(t), end]
            c.update(seq)
            pairs.update(zip([end, *seq[:-1]], seq, strict=True))
    total, v = sum(c.values()), len(c)
    for d, t, *_ in ODD:
        seq = [*words(t), end]
        r = got[(d, len(seq))]
        p1 = [(c[w] + 0.5) / (total + 0.5 * (v + 1)) for w in seq]
        p2 = [(pairs[(h, w)] + ngram_lm.MASS * q) / (c[h] + ngram_lm.MASS) for h, w, q in zip([end, *seq[:-1]], seq, p1, strict=True)]
        assert r["train_tokens"] == total and r["vocabulary"] == v and r["n_known"] == sum(w in c for w in seq)
        assert r["base_score"] == pytest.approx(sum(map(math.log10, p1)), rel=1e-9)
        assert r["score"] == pytest.approx(sum(map(math.log10, p2)), abs=0.03 * len(seq))


def test_lm_with_one_hot_context(spark):
    """A context with most of the tokens is cut over shards, and lookups still find its successors."""
    rows = [(i, " ".join(f"the x{(i * 31 + j) % 500}" for j in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = [r["score"] / r["base_score"] for r in ngram_lm.score(df, df).collect()]
    assert len(scores) == 40 and max(scores) < 0.9


def test_mixing(spark, odd):
    got = source_mixing.mix_sources(odd, {"a": 3.0, "b": 1.0}, block=2).collect()
    assert len(got) == len(ODD) and len({r["position"] for r in got}) == len(ODD)
    ranks = Counter((r["source"], r["source_rank"]) for r in got)
    assert max(ranks.values()) == 1 and {s: max(r for t, r in ranks if t == s) + 1 for s in ("a", "b", None)} == Counter(s for _, _, _, s, _ in ODD)
    with pytest.raises(ValueError):
        source_mixing.mix_sources(odd, {"a": 0.0})


def test_language(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog were in the house that night " * 20, "en"), ("der hund und die katze waren in dem haus diese nacht " * 20, "de"), ("nothing labelled", None)])]
    model = language_id.sample(spark.createDataFrame(train, "doc_id long, text string, lang string"), "lang")
    texts = [(1, "the dog in the house"), (2, "die katze und der hund"), (3, None), (4, "12 34 !!"), (5, ""), (6, "漢字かな"), (7, "the dog " * 5000)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[3]["score"] == 0
    df = spark.createDataFrame([(*t, i) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    assert sorted(r["doc_id"] for r in language_id.keep_identified(df, model).collect()) == [1, 2, 7]
    assert language_id.identify(df, {}).where("lang_pred <> 'und'").count() == 0


def test_language_of_four_scripts(spark):
    """Every letter of training counts: clean texts of each script are kept, though the alphabets have 2,000 letters together."""
    import random

    r = random.Random(3)
    scripts = {"en": range(0x61, 0x7B), "el": range(0x3B1, 0x3CA), "ru": range(0x430, 0x450), "zh": range(0x4E00, 0x55D0)}
    lexicon = {k: ["".join(chr(r.choice(v)) for _ in range(2 if k == "zh" else r.randint(3, 8))) for _ in range(1500 if k == "zh" else 300)] for k, v in scripts.items()}

    def text(lang, n):
        return ("" if lang == "zh" else " ").join(r.choice(lexicon[lang]) for _ in range(n))

    model = {k: [text(k, 300 if k == "zh" else 90) for _ in range(40)] for k in scripts}
    rows = [(i, k, text(k, 80)) for i, k in enumerate([*scripts] * 5)] + [(99, "junk", "".join(chr(r.choice(range(0xAC00, 0xD7A3))) for _ in range(200)))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert {x["doc_id"]: x["lang_pred"] for x in language_id.identify(df, model).collect() if x["doc_id"] < 99} == {i: k for i, k, _ in rows[:-1]}
    assert sorted(x["doc_id"] for x in language_id.keep_identified(df, model).collect()) == list(range(20))


def test_too_many_labels_are_an_error(spark):
    with pytest.raises(ValueError, match="languages"):
        language_id.sample(spark.range(1001).selectExpr("id as doc_id", "'some words' as text", "cast(id as string) as lang"), "lang")


def test_secrets(spark, odd):
    key = "AKIA" + "Q7ZX2WJ5M3N8B4VC"
    texts = [(1, f'é the token = "{hashlib.sha1(b"x").hexdigest()}" and more'), (2, f"{key} at the start"), (3, "call 4845168114407329 or 97.51.17.173 or mail7.example.com"), (4, None), (5, ""), (1, "nothing here")]
    df = spark.createDataFrame([(*t, len(t[1] or "")) for t in texts], "doc_id long, text string, n_chars long")
    found = secret_scan.scan(df).collect()
    by = {i: t for i, t in texts[:5]}
    assert sorted(r["doc_id"] for r in found) == [1, 2] and all(by[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in found)
    clean = secret_scan.redact(df, length_col="n_chars").collect()
    assert [r["text"] for r in clean] == ['é the token = "[secret]" and more', "[secret] at the start", texts[2][1], None, "", "nothing here"]
    assert clean[1]["n_chars"] == len("[secret] at the start") and clean[3]["n_chars"] == 0


def test_images_of_texts(odd):
    got = media_columns.payload_images(odd).collect()
    for (_, t, *_), r in zip(ODD, sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"])), strict=True):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
    bmp = {r["doc_id"]: r for r in media_columns.payload_images(odd, "bmp").collect()}
    assert all(bmp[r["doc_id"]]["feature"] == r["feature"] and bmp[r["doc_id"]]["media_sha256"] != r["media_sha256"] for r in got if r["doc_id"] != 14)


def test_tiles(spark, tmp_path):
    import io

    import numpy as np

    px = np.arange(300, dtype=np.uint8).reshape(10, 10, 3)
    df = spark.createDataFrame([(1, bytearray(media_columns.encode_ppm(px))), (2, None), (3, bytearray(b"junk"))], "id long, image binary")
    media_columns.write_tiles(df, "id", "image", str(tmp_path / "tiles"), 5)
    rows = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "tiles")).collect()}
    assert np.load(io.BytesIO(rows[1]["npy"])).shape == (5, 5, 3) and rows[2]["npy"] is None and rows[3]["error"]


@pytest.mark.parametrize("name", ["contained", "components", "passages", "lm", "mix", "language", "secrets", "images"])
def test_empty_tables(spark, empty, name):
    items = spark.createDataFrame([], "item_id long, text string")
    made = {
        "contained": lambda: decontamination.contained_items(empty, items), "components": lambda: jaccard_join.jaccard_components(empty), "passages": lambda: substring_dedup.repeated_passages(empty), "lm": lambda: ngram_lm.score(empty, empty),
        "mix": lambda: source_mixing.mix_sources(empty), "language": lambda: language_id.identify(empty, language_id.sample(empty, "lang")), "secrets": lambda: secret_scan.redact(empty), "images": lambda: media_columns.payload_images(empty),
    }[name]()
    assert made.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    cur = con.execute(queries.ORACLE_SQL[name])
    order = [[d[0] for d in cur.description].index(c) for c in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in cur.fetchall())


def test_query_columns(spark, sf_dir):
    want = {
        "op1_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}, "op3_html_extraction": {"page_id", "url", "text", "n_chars"}, "op5_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
        "op6_media_columns": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"}, "op10_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    }
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, sf_dir)
        assert columns <= set(df.columns)
        if name not in ("op3_html_extraction",):
            assert df.count() == docs


def test_held_out_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    got = queries.op10_language_id(spark, sf_dir).join(docs, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns, name
        if name == "ngram_jaccard_join":
            want = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)}
            assert {r["doc_id"] for r in kept.collect()} == want
        elif name == "secret_scan":
            assert kept.count() == before.count()
            assert all(r["text"] == texts[r["doc_id"]] or "[secret]" in r["text"] for r in kept.collect())
    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in final) == sorted(r["doc_id"] for r in kept.collect())
