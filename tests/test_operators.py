"""Operators on small hand-made inputs, where the wanted rows are written down."""

import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from quarrymap.operators import context, graph, ingest, lookup, resolve, retrieval, state, temporal
from quarrymap.sources import tables
from tests.conftest import SF


def nodes(spark, *rows):
    return spark.createDataFrame([(i, k, i, f, "") for i, k, f in rows], "id string, kind string, name string, file string, namespace string")


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "rel_id string, source_id string, target_id string, kind string, resolution string")


def test_weights_of_a_file_pair(spark):
    """Two calls (one uncertain), one extends, and files of one directory: the weights are those of the kinds, each by itself."""
    n = nodes(spark, ("a", "class", "src/A.php"), ("b", "class", "src/B.php"), ("c", "class", "lib/C.php"))
    e = edges(spark, ("1", "a", "b", "calls", "resolved"), ("2", "a", "b", "calls", "dynamic"), ("3", "b", "a", "extends", "resolved"), ("4", "c", "a", "instantiates", "resolved"))
    got = {(r.left, r.right): r.weight for r in graph.file_graph(n, e).collect()}
    assert got.keys() == {("src/A.php", "src/B.php"), ("lib/C.php", "src/A.php")}
    assert got["src/A.php", "src/B.php"] == pytest.approx(1.0 * math.log1p(1.5) + 0.9 * math.log1p(1) + 0.25)
    assert got["lib/C.php", "src/A.php"] == pytest.approx(0.95 * math.log1p(1) + 0.25 / 3)
    for kind, weight in {"overrides": 0.85, "references_type": 0.7, "implements": 0.9, "uses_trait": 0.9}.items():
        one = graph.file_signals(n, edges(spark, ("1", "a", "c", kind, "resolved"))).where(F.col("signal") == kind).first()
        assert one.weight == pytest.approx(weight * math.log(2))


def test_relations_of_a_file_itself(spark):
    n = nodes(spark, ("b", "class", "src/B.php"))
    e = edges(spark, ("1", "file:x/Start.php", "b", "calls", "resolved")).withColumn("file", F.lit("x/Start.php"))
    assert [(r.left, r.right) for r in graph.file_graph(n, e).collect()] == [("src/B.php", "x/Start.php")]


def test_crosscut_of_a_hub_and_of_utility_paths(spark):
    pairs = [("src/hub.php", f"src/f{i}.php", 1.0) for i in range(10)] + [("src/f0.php", "src/util/log.php", 0.2)]
    df = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in pairs], "left string, right string, weight double")
    got = {r.file: (r.score, r.signals) for r in graph.crosscut(df).collect()}
    assert got["src/hub.php"] == (0.75, "high_degree")
    assert got["src/util/log.php"] == (0.125, "utility_path")
    assert got["src/f1.php"] == (0.0, "")
    assert [r.file for r in graph.crosscut_report(graph.crosscut(df)).collect()] == ["src/hub.php"]
    lone = spark.createDataFrame([("src/base.php",)], "file string")
    assert [(r.file, r.score) for r in graph.crosscut(df.limit(0), lone).collect()] == [("src/base.php", 0.125)]
    assert graph.crosscut(df.limit(0)).count() == 0


def test_values_at_ranks(spark):
    values = [3.0, 1.0, 2.0, 2.0, 9.0, 7.0, 7.0, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert graph.at_ranks(df, "v", list(range(8))) == sorted(values)
    assert graph.at_ranks(df.limit(0), "v", [0]) == [None]


def test_region_labels(spark):
    rows = [("a", f"src/Shop/f{i}.php", r"Acme\Shop") for i in range(3)] + [("a", "src/Other/g.php", "")]
    rows += [("b", "src/billing_core/x.php", ""), ("b", "src/billing_core/y.php", r"Acme\Z")]
    rows += [("c", "fooBar.php", ""), ("c", "fooBaz.php", ""), ("e", "a.php", ""), ("f", "src/HTTPClient/x.php", ""), ("f", "src/HTTPClient/y.php", "")]
    rows += [("d", "lib/x/deep/f.php", ""), ("d", "lib/y/deep/f.php", "")]
    df = spark.createDataFrame(rows, "region string, file string, namespace string")
    assert dict(map(tuple, graph.region_labels(df).collect())) == {"a": "Shop", "b": "Billing Core", "c": "Foo", "d": "Deep", "e": "Region", "f": "HTTPClient"}


def test_regions_have_two_files(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", "z"), (2, "b", "z"), (2, "c", "z")]
    got = graph.region_drafts(spark.createDataFrame(rows, "level int, file string, community string")).collect()
    assert sorted((r.level, r.kind, r.files) for r in got) == [(1, "module", 2), (2, "system", 3)]
    assert {r.id for r in got if r.level == 1} == {"region:" + hashlib.sha256(b"1\0a\0b").hexdigest()}


def test_impact(spark):
    n = nodes(spark, *[(x, "method", "src/A.php") for x in "tabcd"])
    e = edges(
        spark, ("9", "a", "t", "calls", "phpstan_resolved"), ("1", "b", "t", "calls", "dynamic"), ("5", "c", "a", "calls", "phpstan_resolved"), ("3", "d", "b", "calls", "phpstan_resolved"),
        ("0", "file:src/A.php", "t", "calls", "phpstan_resolved"), ("6", "c", "a", "calls", "phpstan_resolved"),
    )
    rows = graph.impact(n, e, "t", 2).collect()
    assert [r.node for r in rows] == ["a", "b", "c", "d"]  # by depth, certain ones first, id; a file is no node
    got = {r.node: (r.depth, r.uncertain, r.evidence, r.truncated) for r in rows}
    assert got == {"a": (1, False, 1, False), "b": (1, True, 1, False), "c": (2, False, 2, False), "d": (2, True, 1, False)}
    evidence = graph.impact_evidence(e, graph.impact(n, e, "t", 2), "t", 2)
    assert sorted(map(tuple, evidence.collect())) == [("a", "9"), ("b", "1"), ("c", "5"), ("c", "6"), ("d", "3")]
    # relation 1 comes before 9, so b is come upon first, and d before c
    assert {r.node: r.truncated for r in graph.impact(n, e, "t", 2, 3).collect()} == {"a": True, "b": True, "d": True}
    assert {r.node for r in graph.impact(n, e, "t", 2, 1).collect()} == {"b"}
    assert graph.impact(n, e, "none", 2).count() == 0


def test_rank_counts_unresolved_relations_as_uncertain(spark):
    n = nodes(spark, ("a", "method", "x"), ("b", "method", "x"), ("c", "method", "x"))
    e = edges(
        spark, ("1", "a", "unresolved:calls", "calls", "dynamic"), ("2", "a", "b", "calls", "multiple_targets"), ("2", "a", "c", "calls", "multiple_targets"), ("3", "b", "c", "calls", "phpstan_resolved"),
        ("4", "c", "unresolved:calls", "calls", "dynamic"),
    )
    assert [tuple(r) for r in graph.rank(n, e, "callees").select("id", "score", "uncertain").collect()] == [("a", 2, 2), ("b", 1, 0), ("c", 0, 1)]
    assert [tuple(r) for r in graph.rank(n, e, "callers").select("id", "score", "uncertain").collect()] == [("c", 2, 1), ("b", 1, 1), ("a", 0, 0)]


def test_entrypoints_call_but_are_not_called(spark):
    n = spark.createDataFrame(
        [("a", "method", False), ("b", "method", False), ("c", "method", True), ("d", "function", None), ("e", "class", False), ("f", "method", False)], "id string, kind string, abstract boolean"
    )
    e = edges(
        spark, ("1", "a", "b", "calls", "phpstan_resolved"), ("2", "c", "b", "calls", "phpstan_resolved"), ("3", "d", "b", "calls", "structural_only"), ("4", "e", "b", "calls", "phpstan_resolved"),
        ("5", "f", "unresolved:calls", "calls", "dynamic"), ("6", "a", "unresolved:calls", "calls", "dynamic"), ("7", "b", "c", "extends", "phpstan_resolved"),
    )
    assert [tuple(r) for r in graph.entrypoints(n, e, 9).collect()] == [("d", 1, 0), ("a", 1, 1)]


def test_resolution_is_case_sensitive_and_names_what_it_found(spark):
    m = spark.createDataFrame([(r"A\X", "X", "go", "ok"), (r"B\X", "X", "go", "ok"), (r"B\Y", "Y", "go", "conflict")], "fqn string, name string, method string, state string")
    q = spark.createDataFrame([(x,) for x in ("X::go", r"A\X::go", "x::go", "Y::go", "X", "X::none")], "target string")
    got = {r.target: (r.status, r.candidates) for r in resolve.resolve_methods(m, q).collect()}
    assert got["X::go"] == ("ambiguous", r"A\X::go,B\X::go") and got[r"A\X::go"] == ("found", "") and got["Y::go"][0] == "conflict"
    assert got["x::go"] == ("not_found", r"A\X::go,B\X::go,B\Y::go") and got["X"][0] == "invalid" and got["X::none"] == ("not_found", "")


def test_search_without_words_finds_nothing(spark):
    c = tables.chunks(spark, SF)
    assert retrieval.query_terms("the and of") == [] and retrieval.lexical(c, []).count() == 0
    assert retrieval.query_terms(r"Where is Foo\Bar::baz in the file?") == [r"foo\bar::baz"]
    assert retrieval.structural(c.withColumn("file", F.lit("f")).withColumn("ord", F.lit(1)), [], 5).count() == 0


def test_identifier_shapes(spark):
    words = {"camelCase": 1, "DB": 1, "M365": 1, "Größe": 1, "snake_case": 1, "a\\b": 1, "word": 0, "x": 0, "The": 0, "größe": 0}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: int(r.s) for r in df.select("w", retrieval.is_structural(F.col("w")).alias("s")).collect()} == words


def test_context_fails_on_what_must_be_there(spark):
    rows = [(1, "a", "primary", True, 0, 50, "f"), (1, "b", "dependency", False, 10, 60, "f"), (1, "c", "dependency", False, 20, 10, "g"), (1, "d", "dependency", False, 30, 5, "f"), (2, "a", "primary", True, 0, 101, "f"), (2, "b", "dependency", False, 1, 1, "f")]
    df = spark.createDataFrame(rows, "plan int, symbol string, role string, mandatory boolean, priority int, size bigint, file string")
    caps = dict.fromkeys(context.ROLES, 1)
    got = {r.plan: r for r in context.select_context(df, 100, 2, caps).collect()}
    assert (got[1].chosen, got[1].omitted, got[1].used, got[1].files, got[1].failed) == (["a", "c"], ["b", "d"], 60, 2, False)
    assert (got[2].chosen, got[2].failed) == ([], True)


def test_symbol_events(spark):
    rows = [("s", "a.php", "x", False), ("s", "b.php", "y", True), ("gone", "a.php", "x", False), ("new", "a.php", "x", True), ("same", "a.php", "x", False), ("same", "a.php", "x", True)]
    got = temporal.symbol_events(spark.createDataFrame(rows, "id string, path string, signature string, late boolean")).collect()
    assert sorted((r.kind, r.id, r.old, r.new) for r in got) == [
        ("symbol_added", "new", None, "x"), ("symbol_moved", "s", "a.php", "b.php"), ("symbol_removed", "gone", "x", None), ("symbol_signature_changed", "s", "x", "y"),
    ]


def test_snapshots_are_recorded_once(spark, tmp_path):
    folder = f"file://{tmp_path}/history"
    rows = lambda *r: spark.createDataFrame(list(r), "entity string, n int, snapshot_id int")
    state.record_snapshot(rows(("a", 1, 1), ("b", 1, 1), ("a", 2, 2)), folder)
    state.record_snapshot(rows(("a", 3, 2)), folder)
    state.record_snapshot(rows(("a", 3, 2)), folder)
    assert sorted(map(tuple, state.snapshots_at(spark, folder).select("snapshot_id", "entity", "n").collect())) == [(1, "a", 1), (1, "b", 1), (2, "a", 3)]


def test_last_of_equal_ids(spark):
    df = spark.createDataFrame([("x", "old", 1), ("x", None, 2), ("y", "only", 1)], "id string, v string, ord int")
    assert [(r.id, r.v) for r in ingest.unique_by_id(df, "ord").collect()] == [("x", None), ("y", "only")]


def test_map_sections_and_source_files(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"files": [{"path": "a.php", "sha256": "s"}], "relations": [{"id": 1}], "cases": [{"query": "q", "expected": ["a", "b"]}]}, indent=1))
    f = tables.code_map(spark, f"file://{tmp_path}/map.json", "files", "path string, sha256 string")
    assert [(r.path, r.sha256) for r in f.collect()] == [("a.php", "s")]
    cases = tables.code_map(spark, f"file://{tmp_path}/map.json", "cases", "query string, expected array<string>").select("query", F.explode("expected").alias("e"))
    assert [(r.query, r.e) for r in cases.collect()] == [("q", "a"), ("q", "b")]
    for name in ("src/a.php", "src/b.txt", "vendor/c.php", "src/deep/d.php"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"<?php // {name}")
    got = tables.source_files(spark, f"file://{tmp_path}", ("/vendor/",)).collect()
    assert [r.path.split("/src/")[-1] for r in got] == ["a.php", "deep/d.php"]
    assert got[0].sha256 == hashlib.sha256(b"<?php // src/a.php").hexdigest() and got[0].content == "<?php // src/a.php"


def test_refresh_stream_has_the_newest_hash_of_each_path(spark):
    from quarrymap.plans.catalog import QUERIES

    want = {(r.path, r.sha256) for r in tables.files(spark, SF).select("path", "sha256").collect()}
    got = {(f"{'/'.join(r.path.split('/')[:2])}/doc{r.path.split('/')[2]}.txt", r.sha256) for r in QUERIES["refresh_stream"](spark, SF).collect()}
    assert got == want


def test_related_without_a_hit(spark):
    files = spark.createDataFrame([("src/A.php", "n")], "path string, namespace string")
    assert lookup.related(files, "zzz", 10).count() == 0


@pytest.mark.parametrize("name", ["rank_callers", "file_graph_edges", "structural_diff_counts", "context_selection", "hybrid_rrf", "chunk_replace"])
def test_same_rows_with_other_partitions(spark, name):
    from quarrymap.plans.catalog import QUERIES

    rows = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(str(r) for r in QUERIES[name](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows[0] == rows[1]
