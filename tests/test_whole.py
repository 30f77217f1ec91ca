"""Results that hold all of their input: no cap, no named snapshot."""

from factloom.operators import geometry, graph, provenance
from factloom.plans import evidence_plan, graph_plan, measure_plan


def test_members_beyond_a_thousand(spark):
    docs = spark.range(1500).selectExpr("id as doc_id", "if(id < 1400, 'same', if(id < 1499, cast(id as string), null)) as text")
    got = provenance.cluster_members(docs, "doc_id", "text").collect()
    assert len(got) == 1499 and len({r["doc_id"] for r in got}) == 1499
    hot = provenance.exact_clusters(docs, "doc_id", "text").orderBy("members", ascending=False).first()
    assert hot["members"] == 1400 == sum(r["body_sha256"] == hot["body_sha256"] for r in got)


def test_support_beyond_a_thousand(spark):
    d = spark.range(1300).selectExpr("concat('c', id) as claim_id", "if(id < 1200, 'f', if(id < 1250, concat('g', id), null)) as logical_fact_id")
    got = provenance.supporting_claims(d.unionByName(d.limit(10))).collect()
    top = provenance.fact_support(d).filter("logical_fact_id = 'f'").first()
    assert (top["supporting_claims"], top["first_claim"]) == (1200, "c0")
    assert len(got) == 1250 and sum(r["logical_fact_id"] == "f" for r in got) == 1200


EDGES = "snapshot_id string, subject_id string, relation_id string, object_id string"


def test_every_snapshot_is_split_and_ranked(spark, tmp_path):
    rows = [(s, f"h{i}", "r", f"t{i % 4}") for s, n in (("A", 60), ("B", 40)) for i in range(n)]
    spark.createDataFrame([*rows, ("C", "h1", "q", "t1")], EDGES).write.parquet(str(tmp_path / "snapshot_edges.parquet"))
    split = {r["snapshot_id"]: r for r in graph_plan.split_diagnostics(spark, str(tmp_path)).collect()}
    base = {(r["snapshot_id"], r["r"]): r for r in graph_plan.frequency_baseline(spark, str(tmp_path)).collect()}
    assert set(split) == {"A", "B", "C"} and split["A"]["held"] > split["B"]["held"] > 0
    for s in ("A", "B"):
        assert base[s, "r"]["n"] == base[s, "ALL"]["n"] == split[s]["held"] and base[s, "ALL"]["hits10"] == 1.0


def test_every_pair_of_snapshots_is_compared(spark, tmp_path):
    rows = [("T08", "a", "r", None), ("T08", "a", "r", None), ("T08", "b", "r", "x"), ("T09", "a", "r", None), ("T09", "c", "r", "x"), ("T12", "a", "r", None), ("T12", "c", "r", "x"), (None, "z", "r", "x")]
    spark.createDataFrame(rows, EDGES).write.parquet(str(tmp_path / "snapshot_edges.parquet"))
    got = {tuple(r) for r in evidence_plan.edge_parity(spark, str(tmp_path)).collect()}
    assert got == {("T09", "LEFT", 2), ("T09", "RIGHT", 1), ("T12", "LEFT", 0), ("T12", "RIGHT", 0)}


def test_training_has_the_dimension_and_epochs_of_the_reference(spark):
    rows = [("A", f"e{i}", "r", f"e{(i + 1) % 20}") for i in range(20)]
    v = geometry.train(spark.createDataFrame(rows, "snapshot_id string, h string, r string, t string"), seeds=(13,)).collect()
    assert {len(r["vec"]) for r in v if r["kind"] != "loss"} == {64}
    assert [len(r["vec"]) for r in v if r["kind"] == "loss"] == [400]


def test_vectors_report_convergence(spark, data, monkeypatch):
    few = geometry.train(graph_plan.edges(spark, data), dimension=8, epochs=45)
    monkeypatch.setattr(measure_plan, "_trained", lambda *_: few)
    got = measure_plan.transe_vectors(spark, data).collect()
    assert len(got) == 60 and all(r["all_finite"] == 1 and r["converged"] is not None for r in got)


def test_acronym_alone(spark, tmp_path):
    spark.createDataFrame([("Asia Grid Bank (AGB)", "AGB"), ("Other (OTH)", None)], "subject_mention string, object_mention string").write.parquet(str(tmp_path / "extracted_claims.parquet"))
    spark.createDataFrame([("OTH",), ("AGB (AGB)",), ("Grid",)], "mention string").write.parquet(str(tmp_path / "entity_mapping_versions.parquet"))
    got = {tuple(r) for r in evidence_plan.acronym_aliases(spark, str(tmp_path)).collect()}
    assert got == {("AGB", "Asia Grid Bank (AGB)", "AGB"), ("AGB", "Asia Grid Bank (AGB)", "AGB (AGB)"), ("OTH", "Other (OTH)", "OTH")}


def test_components_of_a_long_chain(spark):
    """Longer than the number of rounds that once was the limit."""
    edges = spark.range(1500).selectExpr("'S' snapshot_id", "lpad(id, 5, '0') h", "'r' r", "lpad(id + 1, 5, '0') t")
    assert graph.components(edges).select("root").distinct().count() == 1
