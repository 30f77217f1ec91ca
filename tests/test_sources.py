"""Sources, sinks, pages and streams on small fixtures."""

import json
import zipfile
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.functions import expressions as x
from factloom.functions import html
from factloom.sources import artifacts, contracts
from factloom.streaming import streams

LD = '<script type="application/ld+json">{"@graph": [{"@type": ["NewsArticle", "Thing"], "datePublished": "2026-01-02T03:04:05+07:00"}]}</script>'


def test_publication_times():
    utc = lambda *a: datetime(*a, tzinfo=timezone.utc)
    assert html.published_at(f"<html>{LD}</html>") == (utc(2026, 1, 1, 20, 4, 5), "jsonld_datePublished")
    assert html.published_at(LD.replace("NewsArticle", "Event").replace('"Thing"', '"Event"')) == (None, None)
    assert html.published_at(LD.replace("+07:00", "")) == (None, None)
    assert html.published_at('<meta property="article:published_time" content="2026-01-02T03:04:05Z">') == (utc(2026, 1, 2, 3, 4, 5), "meta_published_time")
    assert html.published_at("<script type='application/ld+json'>{broken</script>") == (None, None) == html.published_at(None)


def test_body_text():
    page = "<!doctype html><html><head><title>t</title><script>no()</script></head><body><nav>menu</nav><article><h1>Head</h1><p>One  <b>two</b></p><p>three</p><style>x</style></article><article>second</article>foot</body></html>"
    assert html.body_text(page)[:2] == ("Head One two three", "article")
    assert html.body_text("<body><div class='x content-detail y'>in <i>it</i></div><main>m</main></body>")[:2] == ("in it", "article_body")
    assert html.body_text("<body><aside><article>no</article></aside><p>x</p></body>") == ("x", "body", ["BODY_EXTRACTED", "PARSER_FALLBACK_BODY", "SHORT_BODY_LT_200_CHARS"])
    assert html.body_text("") == html.body_text(None) == (None, None, ["EMPTY_BODY"])
    assert html.body_text("plain \u00a0 text")[:2] == ("plain text", "raw_text")
    assert html.body_text("<article></article><p>x</p>") == (None, "article", ["EMPTY_BODY"])
    assert html.body_text("<p>x</p>")[2] == ["PARSER_NO_BODY_NODE"]
    assert html.body_text("<article>" + "word " * 60 + "</article>")[2] == ["BODY_EXTRACTED"]


def test_decoding():
    assert html.decode_bytes("xin chào".encode()) == ("xin chào", "utf-8")
    assert html.decode_bytes(b"<meta charset=latin-1>\xe9")[0].endswith("é")
    assert html.decode_bytes(None) == (None, "none")


def test_page_udfs(spark):
    r = spark.createDataFrame([("<p>café</p>",), (None,)], "h string").select(html.extract_body("h").alias("b"), html.normal_form("h").alias("n"), html.publication("h").alias("p"), html.casefolded("h").alias("c")).collect()
    assert r[0]["n"] == "<p>café</p>" and r[1]["b"]["text"] is None and r[1]["p"]["published"] is None


def test_immutable_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None), ("a", 1)], "k string, n int")
    path = str(tmp_path / "t")
    assert artifacts.write_immutable(df, path) == "WRITTEN" and artifacts.write_immutable(df.repartition(3), path) == "REUSED"
    assert artifacts.read_verified(spark, path).count() == 3
    with pytest.raises(ValueError):
        artifacts.write_immutable(df.distinct(), path)
    df.limit(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError):
        artifacts.read_verified(spark, path)


def test_text_store(spark, tmp_path):
    path = str(tmp_path / "store")
    a = spark.createDataFrame([("x",), ("x",), (None,), ("",)], "t string")
    assert (artifacts.store_texts(a, "t", path), artifacts.store_texts(a, "t", path), artifacts.store_texts(spark.createDataFrame([("y",), ("x",)], "t string"), "t", path)) == (2, 0, 1)
    assert spark.read.parquet(path).filter(F.sha2("text", 256) == F.col("sha256")).count() == 3


def test_inventory_and_evidence(spark, tmp_path):
    import hashlib

    body = b"<!doctype html><html><body>x</body></html>"
    good = hashlib.sha256(body).hexdigest()
    (tmp_path / "f" / "g").mkdir(parents=True)
    (tmp_path / "f" / f"{good}.html").write_bytes(body)
    (tmp_path / "f" / "g" / f"{'0' * 64}.html").write_bytes(body)
    (tmp_path / "f" / "note.txt").write_bytes(b"\xff\xfe")
    got = {(Path(r["path"]).name, r["filename_hash_status"], r["content_type"]) for r in artifacts.file_inventory(spark, str(tmp_path / "f")).collect()}
    assert got == {(f"{good}.html", "MATCH", "text/html"), (f"{'0' * 64}.html", "MISMATCH", "text/html"), ("note.txt", "NO_HASH_IN_NAME", "text/plain")}
    lines = [json.dumps({"a": [{"sha256": good}, {"b": {"raw_blob_sha256": "q"}}]}), "{broken", json.dumps([1])]
    found = artifacts.scan_evidence(spark.createDataFrame([(t,) for t in lines], "t string"), "t").collect()
    assert {(r["locator"], r["sha256"], r["problem"]) for r in found} == {("$.a[0]", good, None), ("$.a[1].b", "q", None), (None, None, "BAD_JSON")}
    assert {r["line_sha256"] for r in found} == {hashlib.sha256(t.encode()).hexdigest() for t in lines[:2]}
    log = str(tmp_path / "logs" / "day.jsonl")
    artifacts.append_log(spark.createDataFrame([(1, None)], "b int, a string"), log)
    artifacts.append_log(spark.createDataFrame([(2, "x")], "b int, a string"), log)
    (tmp_path / "logs" / "other.txt").write_text("no")
    assert {r["text"] for r in artifacts.read_logs(spark, str(tmp_path / "logs"), (".txt",)).filter("not path like '%jsonl%'").collect()} == {"no"}
    assert {r["value"] for r in spark.read.text(log).collect()} == {'{"a":null,"b":1}', '{"a":"x","b":2}'}
    rows, path = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), str(tmp_path / "json")
    assert (artifacts.write_json_immutable(rows, path), artifacts.write_json_immutable(rows.repartition(2), path)) == ("WRITTEN", "REUSED")
    with pytest.raises(ValueError):
        artifacts.write_json_immutable(rows.limit(1), path)
    bad = spark.createDataFrame([("a/b.json",), ("/etc/x",), ("../x",), ("a/../../b",), (" ",), (None,), ("C:\\x",), ("a..b",)], "p string")
    assert sorted((r["path"] or "", r["problem"]) for r in artifacts.unsafe_paths(bad, "p").collect()) == [("", "BLANK"), (" ", "BLANK"), ("../x", "LEAVES_FOLDER"), ("/etc/x", "ABSOLUTE"), ("C:\\x", "ABSOLUTE"), ("a/../../b", "LEAVES_FOLDER")]


def test_zip_and_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b/c.txt", "hello")
        z.writestr("a.txt", "")
    got = [(r["member"], bytes(r["content"])) for r in artifacts.zip_members(spark, str(tmp_path / "a.zip")).collect()]
    assert got == [("a.txt", b""), ("b/c.txt", b"hello")]
    artifacts.write_csv(spark.createDataFrame([("x", "y")], "`:START_ID` string, `name:ID` string").coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    assert artifacts.read_graph_csv(spark, str(tmp_path / "csv")).columns == ["start_id", "name_id"]


def test_contracts(spark):
    assert len(contracts.tables()) == 20 and contracts.schema("fact_versions").names[:2] == ["schema_version", "fact_version_id"]
    d = contracts.conform(spark.createDataFrame([("e", "s")], "edge_id string, subject_id string"), "snapshot_edges")
    assert d.columns == contracts.schema("snapshot_edges").names and d.first()["object_id"] is None
    with pytest.raises(ValueError):
        contracts.conform(spark.range(1), "snapshot_edges")
    assert {(r["field"], r["problem"]) for r in contracts.schema_audit(d.withColumn("x", F.lit(1)).drop("object_id"), "snapshot_edges").collect()} == {("object_id", "MISSING"), ("x", "ADDED")}
    checks = spark.createDataFrame([("PASS",), ("BLOCKED",), ("NOT_RUN",)], "status string")
    assert contracts.status_fold(checks).first()["status"] == "BLOCKED" and contracts.status_fold(checks.limit(0)).first()["status"] == "NOT_RUN"


def test_expressions(spark):
    u = spark.createDataFrame([("https://x/a-20260220140751211.htm",), ("https://x/a-100260629205745473.htm",), (None,)], "u string").select(x.url_instant("u").alias("t")).collect()
    assert [r["t"] for r in u] == [datetime(2026, 2, 20, 7, 7, 51), None, None]
    t = spark.createDataFrame([("2026-01-02T03:04:05+07:00",), ("2026-01-02T03:04:05",), ("x",)], "v string").select(x.aware_instant("v").alias("t")).collect()
    assert [r["t"] for r in t] == [datetime(2026, 1, 1, 20, 4, 5), None, None]
    s = spark.createDataFrame([("xin chào bạn", 4, 8), ("abc", 1, 9), (None, 0, 1)], "t string, a long, z long").select(x.span("t", "a", "z").alias("s")).collect()
    assert [r["s"] for r in s] == ["chào", None, None]
    m = spark.createDataFrame([("1.5",), ("-2",), ("x",)], "v string").select(x.money("v").alias("m")).collect()
    assert [str(r["m"]) for r in m] == ["1.500000", "None", "None"]


def test_mention_keys(spark):
    import unicodedata

    cases = {
        "Tập đoàn Alpha (ALP)": "alpha", "tập đoàn alpha": "tập đoàn alpha", "Hãng 3M": "3m", "Bà Rịa": "bà rịa", "Bà Lan": "lan", "Kappa (A05)": "kappa (a05)", "(abc)": "(abc)",
        "Beta – Gamma, Ltd.": "beta gamma,", "Delta Corp": "delta", "Group": "group", "“Eta”": "eta", "  Ngân hàng  X. ": "ngân hàng x",
    }
    d = spark.createDataFrame([(unicodedata.normalize("NFD", k), v) for k, v in cases.items()], "m string, want string").select("want", x.mention_key(html.normal_form("m")).alias("key"))
    assert {r["want"]: r["key"] for r in d.collect()} == {v: v for v in cases.values()}
    generic = {"ông": True, "người này": True, "công cụ mới": True, "FPT": False, "alpha": False, "gpt 4": False, "": True}
    g = spark.createDataFrame(list(generic.items()), "m string, want boolean").select("m", x.is_generic("m").alias("g"))
    assert {r["m"]: r["g"] for r in g.collect()} == generic


def test_content_types(spark):
    texts = {"\n\t <!DOCTYPE html>": "text/html", "(note) <html lang='vi'>": "text/html", "x" * 5000 + "<html>": "text/plain", " " * 9000 + "<html>": "text/html", "<?xml version='1'?>": "application/xml", " {": "application/json", " \n": "empty"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", x.content_type("t").alias("k")).collect()
    assert {r["t"]: r["k"] for r in got} == texts


def test_streams(spark, tmp_path):
    rows = [(k, datetime(2025, 1, 1, h, m), 1.0) for k, h, m in ((1, 0, 0), (1, 0, 20), (1, 3, 0), (2, 0, 5), (1, 12, 0), (3, 23, 0))]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in" / "events.parquet"))
    schema = spark.read.parquet(str(tmp_path / "in" / "events.parquet")).schema
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "events.parquet"))
    closed = streams.run_to_table(streams.sessions(source(), "user_id", "ts", 1800), "s")
    s = sorted((r["key"], r["n"]) for r in closed.unionByName(streams.open_sessions(spark.read.parquet(str(tmp_path / "in" / "events.parquet")), closed, "user_id", "ts", 1800)).collect())
    assert s == [("1", 1), ("1", 1), ("1", 2), ("2", 1), ("3", 1)]
    w = streams.run_to_table(streams.window_counts(source().withColumn("kind", F.lit("k")), "ts", "kind", "value"), "w", "complete")
    assert {(r["start"].hour, r["n"]) for r in w.collect()} == {(0, 4), (12, 1), (18, 1)}
    first = streams.run_to_table(streams.first_deliveries(source(), "user_id", "ts"), "f")
    assert first.count() == 3
    store = str(tmp_path / "store")
    streams.append_versions(source(), store, "user_id")
    assert spark.read.parquet(store).count() == 3
