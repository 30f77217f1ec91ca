"""Files and tables that are written once: hashes, manifests, stores, inventories, logs, archives."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as x
from ..runtime import path_exists


def semantic_hash(df: DataFrame) -> str:
    """A hash of the rows as a multiset, whatever their order and files.

    Rows are hashed, hashes counted and combined in 4,096 buckets, and the buckets'
    hashes once more, so only those reach the driver.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    counts = df.select(row.alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    per = counts.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "h", "n")))), 256).alias("h"))
    line = per.orderBy("b").collect()
    head = json.dumps(sorted(df.dtypes))
    return df.sparkSession.range(1).select(F.sha2(F.lit(head + "|" + "|".join(r["b"] + r["h"] for r in line)), 256)).first()[0]


def write_immutable(df: DataFrame, path: str) -> str:
    """WRITTEN, or REUSED where the same rows are there; other rows are an error.  A manifest stands beside the files."""
    spark = df.sparkSession
    digest = semantic_hash(df)
    manifest = path.rstrip("/") + ".manifest"
    if path_exists(spark, manifest):
        held = spark.read.json(manifest).first()["semantic_sha256"]
        if held != digest:
            raise ValueError(f"{path} holds other rows")
        return "REUSED"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path).count()
    spark.createDataFrame([(digest, rows, json.dumps(df.dtypes))], "semantic_sha256 string, rows long, columns string").coalesce(1).write.json(manifest)
    return "WRITTEN"


def read_verified(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of write_immutable, after their schema, number and hash have been compared with the manifest."""
    m = spark.read.json(path.rstrip("/") + ".manifest").first()
    df = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if json.loads(m["columns"]) != [list(c) for c in df.dtypes]:
        raise ValueError(f"{path}: other columns than in its manifest")
    if df.count() != m["rows"] or semantic_hash(df) != m["semantic_sha256"]:
        raise ValueError(f"{path}: other rows than in its manifest")
    return df


def store_texts(df: DataFrame, text: str, path: str) -> int:
    """Adds texts that the content-addressed store lacks; the number added.  Partitions are the hashes' first two digits."""
    spark = df.sparkSession
    new = df.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("sha256"), F.col(text).alias("text")).dropDuplicates(["sha256"]).withColumn("part", F.substring("sha256", 1, 2))
    if path_exists(spark, path):
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new = new.cache()
    n = new.count()
    if n:
        new.repartition("part").write.mode("append").partitionBy("part").parquet(path)
    new.unpersist()
    return n


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256, filename_hash_status, content_type) of every file below root."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", r"([0-9a-f]{64})(?:\.[^/]*)?$", 1)
    status = F.when(name == "", "NO_HASH_IN_NAME").when(name == F.sha2("content", 256), "MATCH").otherwise("MISMATCH")
    head = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.lit("\u0001"))
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), status.alias("filename_hash_status"), x.content_type(head).alias("content_type"))


def walk_json(node, locator: str = "$") -> Iterator[tuple[dict, str]]:
    """Every object inside of a JSON value with its place, outermost first."""
    if isinstance(node, dict):
        yield node, locator
        for k, v in node.items():
            yield from walk_json(v, f"{locator}.{k}")
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from walk_json(v, f"{locator}[{i}]")


def scan_evidence(lines: DataFrame, column: str, hash_fields: tuple[str, ...] = ("raw_blob_sha256", "payload_sha256", "sha256"), path: str | None = None) -> DataFrame:
    """(path, line_sha256, locator, sha256, record, problem) of each object that names a hash; lines that are no JSON have a problem.

    A line is known by its file, where ``path`` names that column, and its own hash:
    unlike a number it does not depend on how files are split.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file, line, text in zip(b["path"], b["line_sha256"], b["text"]):
                try:
                    for record, locator in walk_json(json.loads(text)):
                        out += [(file, line, locator, record[f], json.dumps(record, ensure_ascii=False, sort_keys=True), None) for f in hash_fields if isinstance(record.get(f), str)]
                except (TypeError, ValueError):
                    out.append((file, line, None, None, None, "BAD_JSON"))
            yield pd.DataFrame(out, columns=["path", "line_sha256", "locator", "sha256", "record", "problem"])

    d = lines.select((F.col(path) if path else F.lit(None).cast("string")).alias("path"), F.sha2(column, 256).alias("line_sha256"), F.col(column).alias("text"))
    return d.mapInPandas(run, "path string, line_sha256 string, locator string, sha256 string, record string, problem string")


def read_logs(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".jsonl", ".log")) -> DataFrame:
    """(path, text): the lines of every log below root with one of the suffixes."""
    d = spark.read.option("recursiveFileLookup", "true").text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.col("path").endswith(s)
    return d.filter(ends & (F.trim("text") != ""))


def append_log(df: DataFrame, path: str) -> None:
    """Appends each row as a line of JSON with sorted names to an operational log; nothing that is there is touched."""
    df.select(x.canonical_json(*df.columns).alias("value")).write.mode("append").text(path)


def write_json_immutable(df: DataFrame, path: str) -> str:
    """As write_immutable, for lines of JSON with sorted names."""
    text = df.select(x.canonical_json(*df.columns).alias("value"))
    if path_exists(df.sparkSession, path):
        held = df.sparkSession.read.text(path)
        if semantic_hash(held) != semantic_hash(text):
            raise ValueError(f"{path} holds other rows")
        return "REUSED"
    text.write.mode("errorifexists").text(path)
    return "WRITTEN"


def unsafe_paths(df: DataFrame, column: str) -> DataFrame:
    """(path, problem): paths that must not be opened: absolute ones, those that leave their folder, and blank ones."""
    c = F.col(column)
    problem = F.when(F.coalesce(F.trim(c) == "", F.lit(True)), "BLANK").when(c.rlike(r"^(?:/|\\|[A-Za-z]:)"), "ABSOLUTE").when(c.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)"), "LEAVES_FOLDER").when(c.contains("\u0000"), "CONTROL")
    return df.select(c.alias("path"), problem.alias("problem")).filter("problem is not null")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, bytes, content) of the files inside of archives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, raw in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for i in sorted(z.infolist(), key=lambda i: i.filename):
                        if not i.is_dir():
                            yield pd.DataFrame({"path": [p], "member": [i.filename], "bytes": [i.file_size], "content": [z.read(i)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, bytes long, content binary")


def write_csv(df: DataFrame, path: str) -> None:
    """One header a file; the first column's name carries the byte-order mark that spreadsheets look for."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).write.mode("errorifexists").option("header", "true").csv(path)


def read_graph_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with headers such as :START_ID, renamed to start_id."""
    d = spark.read.option("header", "true").csv(path)
    return d.select(*[F.col(f"`{c}`").alias(c.strip("﻿").lstrip(":").lower().replace(":", "_")) for c in d.columns])


def materialize_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations) as a graph store takes them: a node with its snapshots in order, a relation once per snapshot."""
    nodes = edges.select("snapshot_id", F.explode(F.array("h", "t")).alias("entity_id")).groupBy("entity_id").agg(F.array_sort(F.collect_set("snapshot_id")).alias("snapshot_ids"), F.min("snapshot_id").alias("first_seen"))
    return nodes, edges.select("snapshot_id", "h", "r", "t").distinct()


def anti_cached(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(answered, open): requests whose key the cache holds, with its response, and the others."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")
