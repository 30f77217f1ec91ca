"""Training-data operators: plain comparisons, round trips, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import digest, encode, names, packing, queries, splitting
from factloom.llm.tokenizer import encoding, vocabulary

ENC = encoding(vocabulary())
TEXTS = ["", None, " ", "a", "\n\n", "Hello, world's  end.\r\n\r\nxin chào các bạn!", "x" * 5000, "日本語。テスト！" * 300, "<|endoftext|> is text", "é​\U0001f600   x", "'s't '", "1 22 333 \t4"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, "same id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("chunk", F.lit(2))


def test_encoding_equals_the_tokenizer(texts):
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in encode.encode_corpus(texts).collect())
    assert got == sorted([(i, tuple(ENC.encode_ordinary(t) if t else ())) for i, t in enumerate(TEXTS)] + [(0, tuple(ENC.encode_ordinary("same id")))])


def test_words_of_many_chunks_are_salted(spark):
    words = spark.range(400).selectExpr("id chunk", "cast(0 as int) n", "if(id % 4 < 3, ' the', concat(' w', id % 12)) word")
    got = encode.word_ids(words, vocabulary(), hot=50)
    assert got.groupBy("word", "salt").count().agg({"count": "max"}).first()[0] < 150
    assert {(r["chunk"], tuple(np.frombuffer(r["ids"], np.int32))) for r in got.collect()} == {(r["chunk"], tuple(ENC.encode_ordinary(r["word"]))) for r in words.collect()}


def test_encoding_of_nothing(texts):
    assert encode.encode_corpus(texts.limit(0)).count() == 0
    assert {tuple(r["ids"]) for r in encode.encode_corpus(texts.filter("text is null or text = ''")).collect()} == {()}


def test_chunks_do_not_matter(texts):
    words = {(r["chunk"], r["words"] is None) for r in encode.split_words(texts, "doc_id", "text", chunk_chars=10).collect()}
    assert len({c for c, _ in words}) > 3


def test_decoding(spark, data):
    got = {r["doc_id"]: r["text"] for r in queries.p8_decoded(spark, data).collect()}
    want = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert got == want


def test_corpus_ids(spark, data):
    want = {r["doc_id"]: ENC.encode_ordinary(r["text"]) if r["text"] else [] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["ids"] for r in queries.p8_ids(spark, data).collect()} == want


@pytest.mark.parametrize("sizes,k", [([8, 7, 6, 5, 4], 2), ([5], 3), ([], 2), ([1] * 50, 7), ([9, 9, 1, 1, 1], 3)])
def test_differencing_keeps_every_item(sizes, k):
    w = packing.difference(sizes, k)
    assert sorted(i for x in w for i in x) == list(range(len(sizes))) and len(w) <= k


def test_differencing_is_even():
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 200) for _ in range(400)]
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 12)]
    assert max(sums) - min(sums) <= 2


def test_packing(spark):
    rows = [("a", 25), ("b", 10), ("c", 0), ("d", None), ("e", 7), ("e", 7), ("f", 3), (None, 4), ("g", -1)]
    got = packing.pack(spark.createDataFrame(rows, "k string, n long").withColumn("piece", F.lit("clash")), "k", "n", capacity=10).collect()
    load: dict = {}
    for r in got:
        load[r["container"]] = load.get(r["container"], 0) + r["length"]
    assert max(load.values()) <= 10 and sum(load.values()) == 25 + 10 + 7 + 7 + 3 + 4
    assert sorted((r["k"] or "", r["piece"], r["length"]) for r in got) == sorted([("a", 0, 10), ("a", 1, 10), ("a", 2, 5), ("b", 0, 10), ("c", 0, 0), ("d", 0, 0), ("e", 0, 7), ("e", 0, 7), ("f", 0, 3), ("", 0, 4), ("g", 0, 0)])
    assert packing.pack(spark.createDataFrame([], "k string, n long"), "k", "n").count() == 0


def test_containers(spark, data):
    got = queries.p9_containers(spark, data).groupBy("container").agg(F.sum("length").alias("n")).collect()
    total = sum(r["n"] for r in got)
    assert max(r["n"] for r in got) <= packing.CAPACITY and len(got) <= -(-total // packing.CAPACITY) * 1.1 + 1


def check_pieces(rows, whole, limit, overlap):
    by: dict = {}
    for r in rows:
        by.setdefault(r["row"], []).append(r)
    seen = []
    for own in by.values():
        own.sort(key=lambda r: (r["piece"], r["part"]))
        text = whole[own[0]["doc_id"]]
        seen.append(own[0]["doc_id"])
        at = 0
        for r in own:
            assert r["core_start"] == at and r["piece_text"] == (text if text is None else text[r["start"] : r["core_end"]])
            assert r["n_tokens"] == (len(ENC.encode_ordinary(r["piece_text"])) if r["piece_text"] else 0) <= limit
            if at and not r["part"]:
                assert len(ENC.encode_ordinary(text[r["start"] : at])) >= min(overlap, 1)
            at = r["core_end"]
        assert at == len(text or "")
    assert sorted(seen) == sorted(whole)


def test_pieces_of_hard_texts(spark):
    rnd = random.Random(2)
    hard = [None, "", "word " * 3000, "x" * 4000, "日本語" * 1500, "😀" * 800, " " * 3000, "\n" * 2000, "\"" * 3000, "a.\n\n" * 900, "# Head\nline one. line two!\n\nTitle here\n\npara\n" * 80, "".join(rnd.choice("ab'!. \n1é ") for _ in range(6000))]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("ends", F.lit("x"))
    check_pieces(splitting.split_texts(df, limit=128, overlap=16).collect(), dict(enumerate(hard)), 128, 16)
    assert splitting.split_texts(df.limit(0)).count() == 0


def test_one_very_long_text(spark):
    """Ten times the text takes about ten times as long, not a hundred."""
    import time

    body = "".join(f"Line {i} says a little. It goes on.\n" for i in range(20_000))
    took = []
    for times in (1, 10):
        df = spark.createDataFrame([(1, body * times)], "doc_id long, text string")
        began = time.time()
        r = splitting.split_texts(df).agg(F.count("*").alias("n"), F.max("n_tokens").alias("top"), F.sum(F.col("core_end") - F.col("core_start")).alias("chars")).first()
        took.append(time.time() - began)
        assert r["top"] <= splitting.LIMIT and r["chars"] == len(body) * times and r["n"] > 300 * times
    assert took[1] < 40 * took[0]


def test_second_cuts():
    """Pieces above the limit are cut at a sentence, and an overlap that is too long is shortened."""
    enc = ENC.encode_ordinary
    text = "one two three four five. six seven eight nine ten"
    got = list(splitting._within(text, [(0, 0, len(text))], 8, enc))
    assert [text[a:z] for _, _, _, a, z, _, _ in got] == ["one two three four five.", " six seven eight nine ten"] and all(n <= 8 for *_, n, _ in got)
    piece = list(splitting._within(text, [(0, len(text) - 1, len(text))], 4, enc))
    assert len(piece) == 1 and piece[0][2] > 0 and piece[0][5] <= 4


def test_pieces_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    check_pieces(splitting.split_texts(docs).collect(), {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}, splitting.LIMIT, splitting.OVERLAP)
    joined = {r["doc_id"]: r["text"] for r in queries.p10_joined(spark, data).collect()}
    assert joined == {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_boundaries():
    t = "Intro text. More\nline two.\n\n# Head\nend"
    at = {i: chr(b) for i, b in enumerate(splitting.boundaries(t)) if chr(b) != "C"}
    assert at[11] == "S" and at[17] == "L" and at[28] == "H" and at[5] == "W"


@pytest.mark.parametrize("shape", ["normal", "ties", "sorted", "one", "two", "heavy"])
def test_digest_error(shape):
    rng = np.random.default_rng(0)
    v = {"normal": rng.normal(size=30000), "ties": rng.integers(0, 3, 30000).astype(float), "sorted": np.arange(30000.0), "one": np.array([5.0]), "two": np.array([1.0, 3.0]), "heavy": rng.pareto(1, 30000)}[shape]
    parts = [digest._row(p, np.ones(len(p)), p.min(), p.max(), digest.COMPRESSION) for p in np.array_split(v, 7) if len(p)]
    m = digest._row(np.concatenate([p["means"] for p in parts]), np.concatenate([p["weights"] for p in parts]).astype(float), v.min(), v.max(), digest.COMPRESSION)
    assert m["n"] == len(v) and len(m["means"]) <= digest.COMPRESSION
    for q in digest.QUANTILES:
        e = digest.quantile(np.array(m["means"]), np.array(m["weights"], float), m["low"], m["high"], q)
        err = max((v < e).sum() - q * len(v), q * len(v) - (v <= e).sum(), 0)
        assert err <= digest.RANK_BOUND * len(v) + 1
    if shape == "two":
        assert digest.quantile(np.array(m["means"]), np.array(m["weights"], float), 1, 3, 0.5) == 2


def test_percentiles(spark, data):
    got = queries.p6_percentiles(spark, data).collect()
    assert all(r["rank_error"] * r["n"] <= digest.RANK_BOUND * r["n"] + 1 for r in got)
    rows = spark.read.parquet(f"{data}/saved_null_observations_v1.parquet").select("transition_id", "bucket_id", "noise_displacement").toPandas()
    rows = rows[np.isfinite(rows["noise_displacement"])].fillna({"transition_id": "?", "bucket_id": "?"})
    assert {(r["transition_id"] or "?", r["bucket_id"] or "?"): r["n"] for r in got} == rows.groupby(["transition_id", "bucket_id"]).size().to_dict()
    both = queries.p6_combined(spark, data).collect()
    assert all(r["rank_error"] * r["n"] <= digest.RANK_BOUND * r["n"] + 1 for r in both) and len(both) == len(got)


def test_groups_above_the_bound_are_digested_again(spark):
    """A coarse digest of an uneven group misses the bound; a finer one keeps it."""
    df = spark.range(4000).selectExpr("if(id < 3500, 'u', null) g", "exp(id % 3500 / 300.0) v")
    coarse = digest._certified(df, ["g"], "v", digest.QUANTILES, None, 20_000, 4).agg(F.max("rank_error")).first()[0]
    assert coarse > 0.004
    got = digest.percentiles(df, ["g"], "v", compression=4, bound=0.002).collect()
    assert len(got) == 14 and all(r["rank_error"] * r["n"] <= 0.002 * r["n"] + 1 for r in got)
    with pytest.raises(ArithmeticError):
        digest.percentiles(df, ["g"], "v", compression=digest.FINEST, bound=-1.0)


def test_percentiles_edges(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", 1.0), ("a", nan), ("a", None), ("a", inf), ("b", nan), (None, 2.0), (None, 2.0)], "g string, v double").withColumn("n", F.lit(1)).withColumn("est", F.lit(2))
    got = {(r["g"], r["q"]): (r["n"], r["estimate"], r["rank_error"]) for r in digest.percentiles(df, ["g"], "v", [0.5]).collect()}
    assert got == {("a", 0.5): (1, 1.0, 0.0), (None, 0.5): (2, 2.0, 0.0)}
    assert digest.percentiles(df.limit(0), ["g"], "v").count() == 0


def osa(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return int(d[-1, -1])


@pytest.mark.parametrize("bound", [1, 2])
def test_trie_join_finds_every_pair(spark, bound):
    rnd = random.Random(bound)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(90)})
    df = spark.createDataFrame([("p", w) for w in words] + [("q", w) for w in words[:9]], "part string, name string")
    want = {(p, a, b, osa(a, b)) for p, ws in (("p", words), ("q", words[:9])) for a in ws for b in ws if a < b and osa(a, b) <= bound}
    assert {tuple(r) for r in names.trie_join(df, bound).collect()} == want
    # Every shard is hot: sharded again, then split by its held names.
    assert {tuple(r) for r in names.trie_join(df, bound, hot=2).collect()} == want
    both = {(p, a, b, osa(a, b)) for p, ws, vs in (("p", words, words[::3]), ("q", words[:9], words[:2])) for a in ws for b in vs if osa(a, b) <= bound}
    other = spark.createDataFrame([("p", w) for w in words[::3]] + [("q", w) for w in words[:2]], "part string, name string")
    for hot in (2, 4000):
        assert {tuple(r) for r in names.trie_join(df, bound, other, hot=hot).collect()} == both


def test_a_hot_shard_is_sharded_again(spark):
    """Names with one segment in common do not stay in one trie."""
    rnd = random.Random(4)
    words = sorted({"segment" + "".join(rnd.choice("abcdefgh") for _ in range(14)) for _ in range(600)})
    df = spark.createDataFrame([("p", w) for w in words], "part string, name string")
    first = names._shards(df.selectExpr("part", "name", "xxhash64(part) path", "name rest"), 1, None, True)
    assert first.groupBy("path").count().agg({"count": "max"}).first()[0] == len(words)
    second = names._shards(first, 1, None)
    per = [r["count"] for r in second.groupBy("path").count().collect()]
    assert sorted(per)[-1] < len(words) / 20


GIVEN = [("Tobren", "Tobi"), ("Tobren", "Bren"), ("Aldovin", "Aldo")]
SAME = [
    ["Tobren Kibara Nolepo", "TOBREN KIBARA NOLEPO", "Kibara Nolepo, Tobren", "T. Kibara Nolepo", "Tobi Kibara Nolepo", 'Tobren "Bren" Kibara Nolepo', "TS. Tobren Kibara-Nolepo", "Kibara Nolepo Tobren", "Tobren Kibara No1epo", "Tobren Kibraa Nolepo", "Tobren K. Nolepo"],
    ["Aldovin Kibara Nolepo", "aldo kibara nolepo"],
    ["Vabôit Môbếre Software", "Vaboit Mobere SW", "Software of Vaboit Mobere", "Công ty Vabôit Môbếre Soft", "VaboitMobere Software Co., Ltd.", "Vaboit Mobere Software (VMS)"],
    ["Vabôit Môbếre Systems", "Vaboit Mobere Sys"],
    ["Rolaza Buvuda 9", "mô hình Rolaza Buvuda 9", "ROLAZA-BUVUDA-9", "RolazaBuvuda (v9)", "Rоlaza Buvuda v9"],
    ["Rolaza Buvuda 9.5", "Rolaza Buvuda (9.5)"],
    ["Rolaza Buvuda 9 Pro", "Rolaza-Buvuda-9-Pro"],
]


def test_names(spark):
    rows = [(m,) for g in SAME for m in g] + [(None,), ("",), ("  ",), ("the company",), ("người này",), ("Người này",), ("hãng",)] * 2
    got = {(r["mention_a"], r["mention_b"]) for r in names.name_pairs(names.link_names(spark.createDataFrame(rows, "mention string").withColumn("name", F.lit(1)), spark.createDataFrame(GIVEN, "given_name string, short_form string"))).collect()}
    assert got == {(a, b) for g in SAME for a in g for b in g if a < b}


def test_no_names(spark):
    given = spark.createDataFrame([], "given_name string, short_form string")
    assert names.name_pairs(names.link_names(spark.createDataFrame([], "mention string"), given)).count() == 0


def test_orders_of_other_names(spark):
    """Words in another order and an edit, in the first letter too."""
    rows = [("Delta Yonder Base",), ("base delta yonder",), ("Xelta Yonder Base",), ("Yonder Base Velta",), ("Delta Yonder Case File",)]
    given = spark.createDataFrame([], "given_name string, short_form string")
    got = {r["mention"]: r["entity"] for r in names.link_names(spark.createDataFrame(rows, "mention string"), given).collect()}
    assert len(set(got.values())) == 2 and len({got[r[0]] for r in rows[:4]}) == 1


def test_a_lexicon_of_ones_own(spark):
    own = names.Lexicon(forms={"bank": "bank bk"}, generic=frozenset({"somebody"}))
    rows = [("Alpha Kinto Bank",), ("Alpha Kinto Bk",), ("Bank of Alpha Kinto",), ("somebody",)]
    given = spark.createDataFrame([], "given_name string, short_form string")
    got = names.link_names(spark.createDataFrame(rows, "mention string"), given, own).collect()
    assert len(got) == 3 and len({r["entity"] for r in got}) == 1


def test_pairs_of_a_hot_entity(spark):
    linked = spark.range(50).selectExpr("lpad(id, 3, '0') mention", "if(id < 45, 'e', 'f') entity")
    for hot in (3, 2000):
        got = names.name_pairs(linked.unionByName(linked), hot).collect()
        assert len(got) == len(set(got)) == 45 * 44 // 2 + 5 * 4 // 2 and all(a < b for a, b in got)


def test_components_of_a_chain(spark):
    n = spark.createDataFrame([(f"{i:03d}",) for i in range(40)], "node string")
    e = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(29)], "a string, b string")
    got = {r["node"]: r["root"] for r in names.components(n, e).collect()}
    assert got == {f"{i:03d}": "000" if i < 30 else f"{i:03d}" for i in range(40)}


def test_found(spark, data):
    pairs = queries.p2_found(spark, data).collect()
    assert pairs and all(r["mention_a"] < r["mention_b"] for r in pairs) and len(set(pairs)) == len(pairs)
