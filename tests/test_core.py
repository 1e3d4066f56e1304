"""Contexts, renames, chunks, indexes, published maps and labels on small hand-made inputs."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrymap.operators import edit_context, graph, hints, ingest, publish, ranks, rename, retrieval, segments, source, temporal, vector_index
from quarrymap.storage import new_folder, stored

METHOD = "id string, symbol string, ord int, file string, line_start int, line_end int"
SYMBOL = "id string, ord int, file string, line_start int, line_end int"
RELATION = "rel_id string, source_id string, target_id string, kind string, resolution string"


def _service(spark):
    """An interface, its implementation, a controller, a repository, a caller in a directory that only sounds like tests, and a test."""
    services = "src/Services.php"
    methods = spark.createDataFrame(
        [
            ("If::save", "If", 0, services, 9, 9), ("Svc::new", "Svc", 0, services, 14, 14), ("Svc::save", "Svc", 1, services, 16, 19), ("Ctl::submit", "Ctl", 0, services, 24, 27),
            ("Repo::persist", "Repo", 0, services, 32, 32), ("Contest::submit", "Contest", 0, "src/Contest/ContestCaller.php", 12, 15), ("CtlTest::testSubmit", "CtlTest", 0, "tests/UserControllerTest.php", 13, 16),
        ], METHOD,
    )
    symbols = spark.createDataFrame([("If", 0, services, 7, 10), ("Svc", 1, services, 12, 20), ("User", 2, services, 35, 99)], SYMBOL)
    relations = spark.createDataFrame(
        [
            ("o1", "Svc::save", "If::save", "overrides", "phpstan_resolved"), ("c1", "Svc::save", "Repo::persist", "calls", "phpstan_resolved"), ("c2", "Ctl::submit", "Svc::save", "calls", "phpstan_resolved"),
            ("c3", "Contest::submit", "Svc::save", "calls", "phpstan_resolved"), ("c4", "CtlTest::testSubmit", "Ctl::submit", "calls", "phpstan_resolved"), ("c5", "Ctl::submit", "If::save", "calls", "phpstan_resolved"),
            ("t1", "Svc::save", "User", "references_type", "phpstan_resolved"), ("t2", "Svc::save", "Svc", "references_type", "phpstan_resolved"), ("x", "file:src/boot.php", "Svc::save", "calls", "phpstan_resolved"),
        ], RELATION,
    )
    return methods, symbols, relations, methods.select(F.col("file").alias("path")).distinct()


def test_context_of_a_service(spark):
    rows = edit_context.unique_candidates(edit_context.context_candidates(*_service(spark)))
    got = {(r.symbol, r.role): r for r in rows.where("plan = 'Svc::save'").collect()}
    assert {k: (r.priority, r.mandatory, r.evidence) for k, r in got.items()} == {
        ("Svc::save", "primary"): (0, True, 0), ("If::save", "contract"): (10, True, 1), ("Ctl::submit", "change_candidate"): (20, False, 2), ("Contest::submit", "change_candidate"): (20, False, 1),
        ("CtlTest::testSubmit", "verification"): (20, False, 1), ("Repo::persist", "dependency"): (30, False, 1), ("User", "type_definition"): (40, False, 1), ("Svc", "type_definition"): (40, False, 1),
    }
    assert (got["User", "type_definition"].line_start, got["User", "type_definition"].line_end) == (35, 65)  # 31 lines at most
    assert got["Svc", "type_definition"].line_end == 13  # up to its first method
    one = edit_context.context_candidates(*_service(spark), targets=spark.createDataFrame([("If::save",)], "plan string"))
    assert {(r.symbol, r.role, r.mandatory) for r in one.collect()} >= {("Svc::save", "contract", False), ("Ctl::submit", "change_candidate", False)}


def test_likely_tests(spark):
    paths = ["src/User.php", "src/UserController.php", "src/Zip.php", "tests/UserControllerTest.php", "tests/UserTest.php", "tests/Test.php", "test/AnyCest.php", "src/Contest/Any.php"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    base = lambda p: re.sub("(?i)(test|cest)$", "", re.sub(r"\.[^.]*$", "", p.split("/")[-1]))
    for limit in (1, 2, 9):
        want = set()
        for p in paths:
            found = sorted(t for t in paths if t != p and t.startswith("test") and (base(t) in base(p) or base(p) in base(t)))
            want |= {(p, t) for t in found[:limit]}
        assert {tuple(r) for r in edit_context.likely_tests(files, limit).collect()} == want


def test_plans_do_not_depend_on_how_many_are_looked_at_first(spark):
    rng = random.Random(3)
    roles = ["primary", "contract", "change_candidate", "dependency", "verification", "type_definition"]
    rows = []
    for plan in range(12):
        for i in range(rng.randint(1, 60)):
            role = rng.choice(roles)
            rows.append((f"p{plan}", f"s{i}", role, "r", roles.index(role) * 10, role == "primary" and i < 2, f"f{rng.randint(0, 9)}", rng.randint(1, 99), 1, rng.randint(10, 300)))
    df = spark.createDataFrame(rows, "plan string, symbol string, role string, reason string, priority int, mandatory boolean, file string, line_start int, line_end int, size long")
    for policy in (edit_context.Policy(bytes=1500, files=4, callers=2, callees=1, tests=2, types=0), edit_context.Policy(bytes=400, files=2), edit_context.Policy()):
        by_hand = {}
        for plan in {r[0] for r in rows}:
            used, files, counts, chosen, failed = 0, [], dict.fromkeys(policy.caps, 0), [], False
            for r in sorted((r for r in rows if r[0] == plan), key=lambda r: (r[4], r[6], r[7], r[1], r[2], r[3])):
                if failed or (not r[5] and r[2] in counts and counts[r[2]] >= policy.caps[r[2]]):
                    continue
                if used + r[9] > policy.bytes or (r[6] not in files and len(files) >= policy.files):
                    failed = failed or r[5]
                    continue
                used, chosen = used + r[9], [*chosen, (r[1], r[2], r[3])]
                files += [r[6]] if r[6] not in files else []
                if r[2] in counts:
                    counts[r[2]] += 1
            by_hand[plan] = (chosen, used, len(files), failed)
        for first in (1, 1000):
            got = edit_context.context_plans(df, policy, first).collect()
            for r in got:
                if not by_hand[r.plan][3]:
                    assert ([tuple(c) for c in r.chosen], r.used, r.files, r.failed) == by_hand[r.plan]
                assert r.failed == by_hand[r.plan][3]
            assert len(got) == len(by_hand)
    with pytest.raises(ValueError):
        edit_context.Policy(files=0)


def test_covering_tests_are_counted_without_being_listed(spark, monkeypatch):
    """Every third method is a test; some relations have several targets, so that one leads to several callers of a plan."""
    rng, n = random.Random(11), 60
    methods = [(f"m{i}", f"s{i % 5}", i, f"tests/T{i % 4}Test.php" if i % 3 == 0 else f"src/F{i % 7}.php", i * 10, i * 10 + i % 6) for i in range(n)]
    relations = [(f"r{rng.randint(0, 350)}", f"m{rng.randint(0, n - 1)}", f"m{rng.randint(0, n - 1)}", rng.choice(["calls"] * 9 + ["overrides"]), "x") for _ in range(500)]
    relations += [(f"h{i}", f"m{i}", "m1", "calls", "x") for i in range(n)] + [(f"h{i}", f"m{i}", "m2", "calls", "x") for i in range(n)]  # hot ones
    files = spark.createDataFrame([(m[3],) for m in methods], "path string").distinct()
    args = spark.createDataFrame(methods, METHOD), spark.createDataFrame([("s1", 0, "src/S.php", 1, 9)], SYMBOL), spark.createDataFrame(relations, RELATION), files
    every = edit_context.unique_candidates(edit_context.context_candidates(*args, tests=2)).cache()
    want = every.groupBy("plan", "role", "reason").agg(
        F.min("priority"), F.bool_or("mandatory"), F.count("*"), F.min("symbol"), F.max("symbol"), F.min("file"), F.sum("line_start"), F.sum("line_end"), F.sum("evidence"), F.min("first_evidence"),
    )
    monkeypatch.setattr(edit_context, "ONE_GROUP", 7)
    monkeypatch.setattr(edit_context, "ONE_TASK", 50)
    assert sorted(map(str, map(tuple, edit_context.candidate_totals(*args, tests=2).collect()))) == sorted(map(str, map(tuple, want.collect())))
    size = 30 * (F.col("line_end") - F.col("line_start") + 1).cast("long")
    policy = edit_context.Policy(bytes=1500, files=2, callers=3, callees=3, tests=4, types=1)
    want = edit_context.context_plans(every.withColumn("size", size), policy).collect()
    for first in (2, 64):
        assert sorted(edit_context.method_plans(*args, size, policy, tests=2, first=first).collect()) == sorted(want)
    near, _, _ = edit_context._parts(*args, None, 2)
    assert near.where(F.col("reason") == edit_context.COVERING).isEmpty() and not every.where(F.col("reason") == edit_context.COVERING).isEmpty()


def _written(spark):
    """Rows that stages have written for others so far."""
    stages = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None))
    return sum(s.shuffleWriteRecords() for s in stages)


def test_tests_of_callers_are_counted_without_a_row_for_each_plan_and_test(spark):
    """60 methods are called by 20 others, and these by 200 tests each: 240,000 times a plan, a caller and a test."""
    plans, callers, tests = range(60), range(20), range(200)
    methods = [(f"p{i}", "P", i, "src/P.php", i, i) for i in plans] + [(f"c{i}", "C", i, "src/C.php", i, i) for i in callers] + [(f"t{i}", "T", i, "tests/TTest.php", i, i + 2) for i in tests]
    relations = [(f"{c}:{p}", f"c{c}", f"p{p}", "calls", "x") for c in callers for p in plans] + [(f"{t}-{c}", f"t{t}", f"c{c}", "calls", "x") for t in tests for c in callers]
    methods, symbols = spark.createDataFrame(methods, METHOD), spark.createDataFrame([("P", 0, "src/P.php", 1, 9)], SYMBOL)
    before = _written(spark)
    rows = edit_context.candidate_totals(methods, symbols, spark.createDataFrame(relations, RELATION), methods.select(F.col("file").alias("path")).distinct())
    got = {r.plan: (r.candidates, r.starts, r.ends, r.evidence, r.first_evidence) for r in rows.where(F.col("reason") == edit_context.COVERING).collect()}
    assert got == {f"p{p}": (200, sum(tests), sum(tests) + 400, 4000, "0-0") for p in plans}
    assert _written(spark) - before < 100_000


def test_tests_of_callers_in_cells(spark, monkeypatch):
    rng = random.Random(5)
    change = {(rng.randint(0, 9), rng.randint(100, 115)) for _ in range(60)} | {(7, c) for c in range(100, 116)}
    met = {(rng.randint(100, 120), rng.randint(0, 40)) for _ in range(300)}
    values = {t: (rng.randint(1, 9), rng.randint(0, 3)) for t in range(41)}
    monkeypatch.setattr(edit_context, "ONE_GROUP", 40)
    monkeypatch.setattr(edit_context, "ONE_TASK", 60)
    tests = spark.createDataFrame([(c, t, *values[t]) for c, t in met], "caller long, test long, x long, y long")
    covering = edit_context.Covering(spark.createDataFrame([*change, *change], "plan long, caller long"), tests)
    of = {p: sorted({t for c, t in met if (p, c) in change}) for p in {p for p, _ in change}}
    got = {r.plan: (r.candidates, r.x, r.y) for r in covering.counts().collect()}
    assert got == {p: (len(ts), sum(values[t][0] for t in ts), sum(values[t][1] for t in ts)) for p, ts in of.items() if ts}
    asked = {p: (rng.randint(0, 20), rng.randint(3, 9), rng.choice([None, [1], [0, 3]])) for p in of if p % 4}
    rows = covering.met(3, spark.createDataFrame([(p, *a) for p, a in asked.items()], "plan long, least long, room long, files array<long>")).collect()
    first = {p: [] for p in asked}
    for r in rows:
        first[r.plan] += r.tests
        assert [(x, y) for x, y in zip(r.xs, r.ys)] == [values[t] for t in r.tests]
    for p, (least, room, files) in asked.items():
        assert sorted(first[p])[:3] == [t for t in of[p] if t >= least and values[t][0] <= room and (files is None or values[t][1] in files)][:3]


def test_a_plan_without_room_does_not_look_at_what_is_left(spark, monkeypatch):
    """After 800 of 900 bytes each of 3000 tests is too large, but for the last one."""
    rows = [("p", "p", "primary", "r", 0, True, "f", 1, 1, 800)] + [("p", f"t{i}", "verification", "r", 20, False, f"f{i % 9}", i, i, 200) for i in range(3000)]
    rows += [("p", "z", "verification", "r", 20, False, "g", 1, 1, 50), ("p", "d", "dependency", "r", 30, False, "f", 1, 1, 60)]
    df = spark.createDataFrame(rows, "plan string, symbol string, role string, reason string, priority int, mandatory boolean, file string, line_start int, line_end int, size long")
    rounds, fold = [], edit_context._fold
    monkeypatch.setattr(edit_context, "_fold", lambda *a: rounds.append(1) or fold(*a))
    got = edit_context.context_plans(df, edit_context.Policy(bytes=900), 8).collect()
    assert [([c.symbol for c in r.chosen], r.omitted, r.used, r.files, r.failed) for r in got] == [(["p", "z"], 3001, 850, 2, False)]
    assert len(rounds) == 2


CODE = """<?php

final class Example
{
    public function unrelated(): void
    {
    }

    /** @return non-empty-string */
    public function target(): string
    {
        return 'ok';
    }
}
"""


def _file(path, content, stale=False):
    sha = hashlib.sha256(content.encode()).hexdigest()
    return path, sha, "0" * 64 if stale else sha, content


FILE = "path string, sha256 string, current string, content string"


def test_slices_take_what_stands_above(spark):
    deep = "a();\n" + "// x\n" * 40 + "f();\n"
    block = "x();\n/**\n * y();\n\n */\n#[A]\n\nfunction f() {}"
    files = spark.createDataFrame([_file("a.php", CODE), _file("b.php", deep), _file("c.php", block), _file("s.php", CODE, True), _file("e.php", "")], FILE)
    asked = spark.createDataFrame([("a.php", 10, 13), ("b.php", 42, 99), ("c.php", 8, 8), ("c.php", 0, 1), ("s.php", 10, 13), ("e.php", 1, 3), ("c.php", None, 2)], "path string, line_start int, line_end int")
    got = {(r.path, r.line_start): r for r in source.slices(files, asked, above=True).collect()}
    assert got.keys() == {("a.php", 10), ("b.php", 42), ("c.php", 8), ("c.php", 0), ("e.php", 1)}
    assert got["a.php", 10].start == 8 and "unrelated" not in got["a.php", 10].content and got["a.php", 10].content.endswith("    }\n")
    assert (got["b.php", 42].start, got["b.php", 42].end) == (12, 42)  # thirty lines at most
    assert got["c.php", 8].start == 2 and got["c.php", 8].content.startswith("/**\n") and got["e.php", 1].content == ""
    plain = {(r.path, r.line_start): r for r in source.slices(files, asked).collect()}
    assert plain["a.php", 10].start == 10 and plain["c.php", 0].content == "x();\n"


def test_chunks_by_symbol(spark):
    body = "".join(f"line {i}\n" for i in range(1, 1001))
    files = spark.createDataFrame([_file("a.php", body), _file("b.php", body), _file("c.php", body, True), _file("d.php", ""), _file("e.php", "x\n" * 400)], FILE)
    symbols = spark.createDataFrame([("class:A", "class", "A", "class A", "a.php", 3, 900), ("function:f", "function", "f", "function f", "a.php", 950, 960), ("class:C", "class", "C", "class C", "c.php", 1, 9)], "symbol_id string, kind string, fqn string, signature string, path string, line_start int, line_end int")
    methods = spark.createDataFrame([("method:A::b", "class:A", "b", "public b()", 2, 10, 800, "x"), ("method:A::a", "class:A", "a", "public a()", 1, 5, 6, "x")], "method_id string, symbol_id string, name string, signature string, ord int, line_start int, line_end int, path string")
    got = {r.symbol_id: r for r in source.symbol_chunks(files, symbols, methods).collect()}
    assert got.keys() == {"class:A", "function:f", "method:A::a", "method:A::b", *[f"file:b.php:segment:{i}" for i in (1, 2, 3)], "file:e.php:segment:1"}
    assert got["class:A"].content == "".join(f"line {i}\n" for i in range(3, 24)) + "\nclass A\n    public a()\n    public b()" and got["class:A"].end == 900
    assert got["method:A::b"].content.count("\n") == 401 and got["method:A::b"].name == "A::b" and got["method:A::a"].content == "line 5\nline 6\n"
    assert got["file:b.php:segment:3"].start == 801 and got["file:b.php:segment:3"].end == 1000
    assert [r.path for r in source.skipped_files(files).collect()] == ["c.php"]


def _rename_demo(spark, change=lambda tables: tables):
    """An interface, an implementation and a caller, with letters of two bytes before the names."""
    service = "<?php // é save(\ninterface I { function save(); }\nclass S implements I { /* ü */ public function Save() { return 'save('; } function keep() {} }\nclass T extends S { function taken() {} }\n"
    caller = "<?php\n$ö->save ( 1 ); # ->save(\n$s?->save(2); S::save(3);\n"
    tables = {
        "methods": [("I::save", "I", "save", "s.php", 2, 2), ("S::save", "S", "Save", "s.php", 3, 3), ("S::keep", "S", "keep", "s.php", 3, 3), ("T::taken", "T", "taken", "s.php", 4, 4), ("C::go", "C", "go", "c.php", 1, 3)],
        "symbols": [("I", "interface", "I"), ("S", "class", "S"), ("T", "class", "T"), ("C", "class", "C")],
        "relations": [
            ("o", "S::save", "I::save", "overrides", "phpstan_resolved", "s.php", 3, 3, None), ("e", "T", "S", "extends", "phpstan_resolved", "s.php", 4, 4, None), ("i", "S", "I", "implements", "phpstan_resolved", "s.php", 3, 3, None),
            ("c", "C::go", "S::save", "calls", "phpstan_resolved", "c.php", 2, 2, None),
        ],
        "files": [_file("s.php", service), _file("c.php", caller)],
    }
    change(tables)
    make = lambda name, schema: spark.createDataFrame(tables[name], schema)
    return (
        make("methods", "id string, symbol string, name string, file string, line_start int, line_end int"), make("symbols", "id string, kind string, fqn string"),
        make("relations", "rel_id string, source_id string, target_id string, kind string, resolution string, file string, line_start int, line_end int, receiver_type string"), make("files", FILE),
    ), {p: c for p, _, _, c in tables["files"]}


def _plan(spark, target="S::save", new="store", change=lambda t: None, **more):
    tables, texts = _rename_demo(spark, change)
    return rename.rename_plans(spark.createDataFrame([("p", target, new)], "plan string, target string, replacement string"), *tables, **more), texts


def test_rename_edits_are_byte_exact(spark):
    plans, texts = _plan(spark)
    assert tuple(plans.plans.first()) == ("p", "safe", 2, 3, 0, 0)
    edits = plans.edits.collect()
    assert sorted((r.path, r.expected, r.role) for r in edits) == [("c.php", "save", "call"), ("s.php", "Save", "declaration"), ("s.php", "save", "declaration")]
    for r in edits:
        assert texts[r.path].encode()[r.start : r.end + 1].decode() == r.expected
    done = texts["c.php"].encode()
    at = next(r for r in edits if r.path == "c.php")
    assert (done[: at.start] + b"store" + done[at.end + 1 :]).decode().split("\n")[1] == "$ö->store ( 1 ); # ->save("


def test_blocked_renames_have_no_edits(spark):
    def call(*values):
        return lambda t: t["relations"].append(("x", "C::go", *values))

    cases = {
        "collide": dict(new="TAKEN"), "exactly one": dict(change=call("S::save", "calls", "phpstan_resolved", "c.php", 3, 3, None)), "outside method": dict(change=lambda t: t["relations"].append(("c", "C::go", "T::taken", "calls", "multiple_targets", "c.php", 2, 2, None))),
        "unsupported": dict(change=call("S::save", "calls", "structural_only", "c.php", 2, 2, None)), "outside the indexed": dict(change=call("S::save", "calls", "phpstan_resolved", "gone.php", 2, 2, None)),
        "unindexed": dict(change=lambda t: t["relations"].append(("o2", "S::save", "Ext::save", "overrides", "phpstan_resolved", "s.php", 3, 3, None))), "Trait": dict(change=lambda t: t["symbols"].__setitem__(1, ("S", "trait", "S"))),
        "semantic": dict(semantic=False),
    }
    for text, case in cases.items():
        plans, _ = _plan(spark, **case)
        row = plans.plans.first()
        assert (row.status, row.edits, plans.edits.count()) == ("blocked", 0, 0), text
        assert any(text in r.blocker for r in plans.blockers.collect()), text
    plans, _ = _plan(spark, change=lambda t: t["files"].__setitem__(1, _file("c.php", "<?php\n", True)))
    assert plans.plans.first().status == "blocked" and [r.path for r in plans.stale.collect()] == ["c.php"]
    for new, target in (("9x", "S::save"), ("SAVE", "S::save"), ("fine", "S::none")):
        assert _plan(spark, target, new)[0].plans.first().status == "invalid"
    plans, _ = _plan(spark, change=call("unresolved:calls", "calls", "dynamic", "c.php", 3, 3, r"null|\s|Other"))
    assert plans.plans.first().status == "review_required" and plans.edits.count() == 3


def test_pieces_cover_the_source(spark):
    rng = random.Random(5)
    parts = ["/* a 'x' */", "// b \"\n", "#[A]", "# c\n", "'it\\'s'", '"q\\"é"', "näme", "->", " ", "\n", "(", "9", "\\", "/", "'open"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["/* open", "x" * 100_000 + "'" + "\\'" * 50_000 + "'", ""]
    rows = rename.source_pieces(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")).collect()
    for i, text in enumerate(texts):
        own = sorted((r.no, r) for r in rows if r.path == str(i))
        assert "".join(r.piece for _, r in own) == re.sub(r"\\(['\"\\])", "\x01\x01", text)
        for _, r in own:
            before = text.encode()[: r.start].decode()
            assert r.line == 1 + before.count("\n")


def test_hints_of_literals_alone(spark):
    code = "<?php // select * from a\n/* \"from b\" */ $q = 'SELECT * FROM orders o JOIN `lines` l'; $r = \"update $t\";\n$x = 'delete from ' . $table; $y = $z . 'from ' . $w; $v = 'from ' . 'c';\nview('home'); view($name); function view('x') {} other('from');"
    files = spark.createDataFrame([("a.php", code)], "path string, content string")
    assert sorted((r.line, r.name, r.action) for r in hints.table_hints(files).collect()) == [(2, "lines", "SELECT"), (2, "orders", "SELECT"), (3, "<dynamic table>", "DELETE")]
    assert sorted((r.line, r.template) for r in hints.template_hints(files, ["view"]).collect()) == [(4, "<dynamic>"), (4, "home")]


def test_tokens_of_embeddings(spark):
    got = spark.createDataFrame([("assertComputerNames can_be:Requested x ab Computer",)], "t string").select(retrieval.embedding_terms(F.col("t")).alias("w")).first().w
    assert got == ["assertcomputernames", "assert", "computer", "names", "can_be", "can", "requested", "computer"]


def _clustered(spark, n=1500, width=16):
    rng = random.Random(6)
    centers = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in (centers[0] if i % 3 == 0 else rng.choice(centers))]) for i in range(n)]
    rows += [(n + i, rows[i][1]) for i in range(20)] + [(n + 50, None)]
    return spark.createDataFrame(rows, "id long, vector array<double>"), {i: v for i, v in rows if v}


def test_vector_index(spark):
    df, vectors = _clustered(spark)
    folder = new_folder(spark, "test-cells")
    vector_index.write_cells(df, folder)
    far = lambda a, b: round(sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5, 4)
    asked = [i for i in vectors if i % 50 == 0]
    want = {q: sorted((far(vectors[q], v), i) for i, v in vectors.items() if i != q)[:10] for q in asked}
    exact = vector_index.neighbours(spark, folder, df.where("id % 50 = 0"), 10).collect()
    for q in asked:
        assert sorted((r.distance, r.id) for r in exact if r["query"] == q) == want[q]
    probed = {(r["query"], r.id) for r in vector_index.neighbours(spark, folder, df.where("id % 50 = 0"), 10, exact=False).collect()}
    assert len(probed & {(q, i) for q in asked for _, i in want[q]}) >= 0.9 * 10 * len(asked)
    q = [x + 0.05 for x in vectors[7]]
    best = [(r.distance, r.id) for r in vector_index.search(spark, folder, q, 12, probes=1).collect()]
    assert best == sorted((far(q, v), i) for i, v in vectors.items())[:12]
    assert vector_index.search(spark, folder, q, 5000).count() == len(vectors)
    empty = new_folder(spark, "test-cells")
    vector_index.write_cells(df.limit(0), empty)
    assert vector_index.search(spark, empty, q, 3).count() == 0 and vector_index.neighbours(spark, empty, df.limit(3), 3).count() == 0


def test_probed_neighbours_of_the_query_table(spark):
    from quarrymap.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.01"
    exact, probed = ({(r["query"], r.id) for r in QUERIES[name](spark, sf).collect()} for name in ("vector_neighbours", "vector_neighbours_probed"))
    assert len(exact & probed) >= 0.9 * len(exact)


def test_neighbours_in_pieces_of_one_cell(spark, monkeypatch):
    """Copies, equal distances and null vectors, in one cell that no task holds whole."""
    monkeypatch.setattr(vector_index, "PIECE", 7)
    rng = random.Random(3)
    vectors = {i: [float(rng.randint(0, 2)) for _ in range(3)] if i % 9 else [1.0, 1.0, 1.0] for i in range(120)}
    df = spark.createDataFrame([*vectors.items(), (500, None)], "id long, vector array<float>")
    folder = new_folder(spark, "test-pieces")
    vector_index.write_cells(df, folder, cells=1)
    asked = df.where("id % 4 = 0")
    got = vector_index.neighbours(spark, folder, asked, 6).collect()
    far = lambda a, b: round(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5, 4)
    for q in range(0, 120, 4):
        want = sorted((far(vectors[q], v), i) for i, v in vectors.items() if i != q)[:6]
        assert [(r.distance, r.id) for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == want
    assert {r["query"] for r in got} == set(range(0, 120, 4))


def test_nearest_of_a_piece_looks_at_few_pairs_at_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(vector_index, "AT_ONCE", 8)
    rows = pa.table({"id": [3, 1, 2, 9], "vector": [[0.0], [0.00025], [0.00035], [5.0]]})
    asked = pa.table({"query": [3, 7, 8], "q": [[0.0], [0.0], [0.0]], "worst": [float("inf"), float("inf"), 0.0002]})
    got = [tuple(r.values()) for r in vector_index._best(asked, rows, 2).to_pylist()]
    assert got == [(3, 1, 0.0003), (3, 2, 0.0004), (7, 3, 0.0), (7, 1, 0.0003), (8, 3, 0.0), (8, 1, 0.0003)]


def test_segments_equal_a_new_index(spark):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rng.randint(0, 12)))
    schema = "chunk_id string, path string, symbol_name string, signature string, content string"
    frame = lambda docs: spark.createDataFrame([(f"{p}#{i}", p, "n", "s", c) for p, cs in docs.items() for i, c in enumerate(cs)], schema)
    docs = {f"f{i}": [text() for _ in range(rng.randint(1, 3))] for i in range(25)}
    root = new_folder(spark, "test-segments")
    segments.build(root, frame(docs))
    untouched = None
    for step in range(3):
        changed = rng.sample(sorted(docs), 4) + [f"new{step}"]
        for p in changed[:3] + [f"new{step}"]:
            docs[p] = [text() for _ in range(rng.randint(1, 3))]
        docs.pop(changed[3])
        told = segments.refresh(root, spark.createDataFrame([(p,) for p in changed], "path string"), frame(docs))
        assert untouched is None or told["segments"][: len(untouched)] == untouched  # what was there stays as it is
        untouched = told["segments"]
        for words in (["alpha"], ["beta", "eps"], ["gamma", "nothing"], []):
            want = sorted(map(tuple, retrieval.lexical(frame(docs), words).collect()))
            assert sorted(map(tuple, segments.search(spark, root, words).collect())) == want
    told = segments.merge(spark, root)
    assert len(told["segments"]) == 1 and told["chunks"] == sum(map(len, docs.values()))
    assert sorted(map(tuple, segments.search(spark, root, ["beta", "eps"]).collect())) == sorted(map(tuple, retrieval.lexical(frame(docs), ["beta", "eps"]).collect()))


def _moved(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_links_move_once_to_be_counted_by_source(spark):
    from quarrymap.operators import graph

    rows = [("a", "x", "calls", "dynamic"), ("a", "x", "calls", "sure"), ("b", "x", "calls", "sure"), ("b", "b", "calls", "sure")]
    edges = spark.createDataFrame([(f"r{i}", *r) for i, r in enumerate(rows)], "rel_id string, source_id string, target_id string, kind string, resolution string")
    nodes = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("x", "f3")], "id string, file string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        out = graph.coupling(nodes, edges, "file", 5)
        # the links by source and again by target, both sides of nodes, and the counts
        assert _moved(out) == 5
        assert [tuple(r) for r in out.collect()] == [("f2", "f3", 1, 0), ("f1", "f3", 1, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_postings_are_counted_where_they_are_read(spark):
    from collections import Counter

    texts = {"a": "beta alpha beta x9 Beta", "b": "", "c": None, "d": "alpha " * 5000}
    df = spark.createDataFrame([(k, "p", "n1", "s1", v) for k, v in texts.items()], "chunk_id string, path string, symbol_name string, signature string, content string")
    found = retrieval.postings(df, "path")
    assert _moved(found) == 0
    want = {k: Counter(["n1", "s1", *(v or "").lower().split()]) for k, v in texts.items()}
    assert sorted((r.chunk_id, r.term, r.tf, r.len) for r in found.collect()) == sorted((k, t, n, sum(c.values())) for k, c in want.items() for t, n in c.items())


def test_embedding_by_blocks_equals_the_one_by_terms(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    rng = random.Random(5)
    words = [f"word{i}" for i in range(40)] + ["camelCase", "under_score", "Other"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(25)] + [None, ""]
    df = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, content string").repartition(3, "chunk_id")
    known = retrieval.idf(df).where("crc32(term) % 3 <> 0")  # the others are new and count with 1
    want = {}
    for r in retrieval.hashed_embedding(retrieval.term_counts(df), known).collect():
        want.setdefault(r.chunk_id, {})[r.bucket] = round(r.v, 6)
    counts = retrieval.counted_chunks(df)
    rows = retrieval.block_embedding(counts, known)
    got = {r.chunk_id: {i: round(v, 6) for i, v in enumerate(r.sums) if v is not None} for r in rows.collect()}
    assert len(got) == len(texts) and {k: v for k, v in got.items() if v} == want
    assert sorted(map(tuple, retrieval.idf(df, counts).collect())) == sorted(map(tuple, retrieval.idf(df).collect()))
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-5 for r in retrieval.unit_vectors(rows).collect())


def test_published_maps(spark):
    rows = spark.createDataFrame([(i, f"n{i % 7}", {"z": [i], "a": None}, (None, i)) for i in range(100)], "b int, a string, m map<string,array<int>>, s struct<y:string,x:int>")
    root = new_folder(spark, "test-map")
    told = publish.write_map(root, {"nodes": (rows, ["a", "b"]), "empty": (rows.limit(0), ["b"])})
    lines = spark.read.text(f"{root}/{told['folder']}/nodes").collect()
    assert len(lines) == 100 and all(list(json.loads(r.value)) == ["a", "b", "m", "s"] and '"m":{"a":null,"z":[' in r.value and '"s":{"x":' in r.value for r in lines)
    back = publish.read_section(spark, root, "nodes", "b int, a string").collect()
    assert {tuple(r) for r in back} == {(i, f"n{i % 7}") for i in range(100)} and told["sections"]["empty"]["rows"] == 0
    again = publish.write_map(new_folder(spark, "test-map"), {"nodes": (rows.repartition(7), ["a", "b"]), "empty": (rows.limit(0), ["b"])})
    assert again["digest"] == told["digest"]  # however the rows are dealt
    fails = F.udf(lambda x: 1 // (x - 50), "int")
    with pytest.raises(Exception):
        publish.write_map(root, {"a": (rows, ["b"]), "nodes": (rows.withColumn("b", fails("b")), ["b"])})
    assert publish.manifest(spark, root) == told  # the old map is still the map
    other = publish.write_map(root, {"nodes": (rows.where("b <> 3"), ["a", "b"])})
    assert publish.manifest(spark, root)["digest"] == other["digest"] != told["digest"]
    with pytest.raises(ValueError):
        publish.read_section(spark, root, "empty", "b int")


def test_pairs_of_changes_are_dealt_by_their_number(spark, monkeypatch):
    rows = [(c, f) for c in range(40) for f in range(c % 5, c % 5 + 6)]
    commits = spark.createDataFrame(rows, "commit_ord int, file int")
    want = sorted(temporal.cochange(commits, 6, 2).collect())
    monkeypatch.setattr(temporal, "ONE_TASK", 50)  # 600 pairs
    dealt = []
    kind = type(commits)
    kept = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, n, *by: dealt.append(n) or kept(df, n, *by))
    assert sorted(temporal.cochange(commits, 6, 2).collect()) == want and dealt == [12]
    by_hand = {}
    for c in range(40):
        mine = [f for x, f in rows if x == c]
        for pair in ((x, y) for x in mine for y in mine if x < y):
            by_hand.setdefault(pair, []).append(str(c))
    text = {p: ",".join(sorted(v, key=int)) for p, v in by_hand.items() if len(v) > 1}
    assert {(r.left, r.right): (r.together, r.revisions) for r in want} == {p: (v.count(",") + 1, v) for p, v in text.items()}


def test_relations_move_once_to_their_source(spark, monkeypatch):
    """Joins by equal keys and sums after them: the relations aren't dealt by pairs of nodes as well."""
    monkeypatch.setattr(graph, "stored", lambda df, name: kept.append(df) or df)
    kept = []
    nodes = spark.createDataFrame([(f"n{i}", "method", f"d/f{i % 3}", "x") for i in range(9)], "id string, kind string, file string, namespace string")
    edges = spark.createDataFrame([(f"r{i}", f"n{i % 9}", f"n{i % 7}", "calls", "dynamic" if i % 2 else "sure") for i in range(50)], RELATION)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        graph.file_signals(nodes, edges)
        text = kept[0]._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\(source_id#\d+, target_id", text) and "Exchange hashpartitioning(source_id" in text
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files, want = {f"n{i}": f"d/f{i % 3}" for i in range(9)}, {}
    for i in range(50):
        a, b = sorted((files[f"n{i % 9}"], files[f"n{i % 7}"]))
        if a != b:
            want[a, b] = want.get((a, b), 0) + (0.5 if i % 2 else 1)
    assert {(r.left, r.right): r.f for r in kept[0].collect()} == want


def test_labels_told_apart(spark):
    rows = [
        ("r1", "Shared", "src/Feature/A.php", "aaaaaa1"), ("r2", "shared", "src/Feature/B.php", "bbbbbb1"), ("r3", "Shared", "src/Feature/C.php", "bbbbbb2"), ("r4", "Shared", "src/Feature/D.php", "bbbbbb3"),
        ("r5", "Shared", "src/x.php", "cccccc1"), ("r6", "Alone", "src/y.php", "d"), ("r7", "Shared / Feature", "z.php", "e"),
    ]
    got = dict(map(tuple, graph.unique_labels(spark.createDataFrame(rows, "id string, label string, first string, digest string")).collect()))
    # r7 alone has its label, so r1 can't take it; r2 to r4 share directory and digits
    assert got == {
        "r1": "Shared / Feature aaaaaa", "r2": "shared / Feature bbbbbb", "r3": "Shared / Feature bbbbbb-2", "r4": "Shared / Feature bbbbbb-3", "r5": "Shared / cccccc", "r6": "Alone", "r7": "Shared / Feature",
    }


def _told_apart_one_by_one(rows):
    """The choices in order of the ids, each looking at all that are taken."""
    keys = [x[1].lower() for x in rows]
    alone = {k for k in keys if keys.count(k) == 1}
    taken, out = set(alone), {x[0]: x[1] for x in rows if x[1].lower() in alone}
    for i, label, first, digest in sorted(x for x in rows if x[1].lower() not in alone):
        above = (first.rsplit("/", 1)[0] if "/" in first else ".").split("/")[-1]
        plain = above in ("", ".") or above.lower() in graph.NOISE or above.lower() == label.lower()
        base = f"{label} / " + (digest[:6] if plain else " ".join(w[:1].upper() + w[1:] for w in re.sub("[_-]+", " ", above).split(" ")))
        n = 0
        while True:
            pick = base if n == 0 else f"{base} {digest[:6]}" if n == 1 else f"{base} {digest[:6]}-{n}"
            if pick.lower() not in taken:
                break
            n += 1
        taken.add(pick.lower())
        out[i] = pick
    return out


def test_many_labels_told_apart_in_few_rounds(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"r{i:04}", rng.choice(["Shared", "shared", "Other"]), f"lib/{rng.choice(['src', 'one', 'two_b'])}/x.php", rng.choice(["aaaaaa1", "bbbbbb1"])) for i in range(400)]
    rows += [(f"s{i}", f"Shared / One aaaaaa-{n}", "x", "d") for i, n in enumerate([2, 3, 4, 7, 9, 30, 31, 32, 33, 60, 1, 5000])]  # numbers that are taken
    rows += [(f"q{i}", f"Other / Two b bbbbbb-{n}", "x", "d") for i, n in enumerate(["02", "x", "0"])]  # and what are none
    rows += [("r0500", "Q", "lib/one aaaaaa-2/x.php", "aaaaaa"), ("r0501", "Q", "lib/one/x.php", "aaaaaa"), ("r0502", "q", "lib/one/x.php", "aaaaaa"), ("r0503", "q", "lib/one/x.php", "aaaaaa")]
    rounds = []
    monkeypatch.setattr(graph, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    got = dict(map(tuple, graph.unique_labels(spark.createDataFrame(rows, "id string, label string, first string, digest string")).collect()))
    assert got == _told_apart_one_by_one(rows)
    assert rounds.count("asking") <= 6


def test_ranks_and_parts(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 5), i) for i in range(103)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(5)
    got = {(r.k, r.i): r["rank"] for r in ranks.with_rank(df, ["k", "i"]).collect()}
    assert got == {row: n for n, row in enumerate(sorted(rows))}
    for parts in (1, 7, 103, 500):
        out = sorted((r.k, r.i, r.part) for r in ranks.balanced_parts(df, ["k", "i"], parts).collect())
        sizes = [sum(1 for x in out if x[2] == p) for p in range(min(parts, 103))]
        assert [x[2] for x in out] == sorted(x[2] for x in out) and sum(sizes) == 103 and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    assert ranks.balanced_parts(df.limit(0), ["k"], 3).count() == 0


def test_bulk_commits_are_counted_by_files_of_the_map(spark):
    commits = spark.createDataFrame([(1, "a"), (1, "b"), (1, "x"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "c")], "commit_ord int, file string")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    got = temporal.cochange(commits, 2, 1, files).collect()
    assert [(r.left, r.right, r.together) for r in got] == [("a", "b", 2)]


def test_merge_states(spark):
    lists = "extends array<string>, implements array<string>, uses array<string>"
    s = spark.createDataFrame([(x, "class", "f", ["B", "A"], [], []) for x in "abcde"], f"id string, kind string, file string, {lists}")
    r = spark.createDataFrame(
        [("a", "class", "f", [r"\A", "B", "B"], None, None, None), ("b", "trait", "f", ["A"], None, None, None), ("c", None, None, ["A"], None, None, None), ("d", None, None, None, None, None, {"T": "int"})],
        f"id string, kind string, file string, {lists}, templates map<string,string>",
    )
    got = {x.id: (x.status, x.extends) for x in ingest.merge_symbols(s, r).collect()}
    assert got == {"a": ("confirmed", ["A", "B"]), "b": ("conflict", ["A"]), "c": ("semantic_enrichment", ["A"]), "d": ("semantic_enrichment", ["A", "B"]), "e": ("structural_only", ["A", "B"])}


def test_scores_count_bytes(spark):
    from quarrymap.functions.text import match_score

    rows = spark.createDataFrame([("en",), ("xen",), ("éen",), ("enéé",), ("none",), ("",)], "c string")
    got = {r.c: r.s for r in rows.select("c", match_score(F.col("c"), "en", 8000).alias("s")).collect()}
    assert got == {"en": 9000, "xen": 8000 - 10 - 1, "éen": 8000 - 20 - 2, "enéé": 8600 - 4, "none": 0, "": 0}
