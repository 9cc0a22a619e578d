import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from srcmetrics.operators import ignore, lines, offenders, rank, report, skew, summary, tree
from srcmetrics.options import OffenderLimits, ScanOptions
from srcmetrics.plans.scan import scan
from srcmetrics.sources.corpus import as_file_root, read_corpus, spread


def report_text(scanned):
    rows = scanned.report().orderBy("root", "line_no").collect()
    out = {}
    for r in rows:
        out.setdefault(r.root, []).append(r.text)
    return out


def documents(scanned):
    return {root: json.loads("".join(parts)) for root, parts in report_text(scanned).items()}


def body(n, indent="    "):
    return "".join(f"{indent}step({i});\n" for i in range(n))


# A project of two files, 144 and 102 visible lines, made by rule.
LIB = (
    "#![allow(unused)]\n\n"
    f"/// first\npub fn first() {{\n{body(62)}}}\n\n"
    f"/// second\npub fn second() {{\n{body(62)}}}\n\n"
    f"fn third() {{\n{body(8)}}}\n\nfn tail() {{}}\nconst LAST: u8 = 1;\n"
)
MAIN = f"use a::b;\n\nfn main() {{\n{body(12)}}}\n\n/// long\nfn build() {{\n{body(36)}\n{body(40)}}}\n\nfn end() {{\n{body(5)}}}\n"


@pytest.fixture(scope="module")
def project(files):
    return files(("r", "Cargo.toml", "[package]"), ("r", "src/lib.rs", LIB), ("r", "src/main.rs", MAIN))


def test_totals_and_longest_functions(project):
    doc = documents(scan(project, ScanOptions(output_format="json")))["r"]
    assert doc["language"] == "rust" and doc["git_ignore"] is False
    assert [f["path"] for f in doc["files"]] == ["src/lib.rs", "src/main.rs"]
    assert doc["totals"] == {"files": 2, "total_loc": sum(f["summary"]["total_loc"] for f in doc["files"])}
    lib, main = (f["summary"] for f in doc["files"])
    assert lib["total_loc"] == sum(1 for x in LIB.split("\n") if x.strip())
    assert main["total_loc"] == sum(1 for x in MAIN.split("\n") if x.strip())
    assert [e["name"] for e in lib["top_functions"]] == ["first", "second", "third"]
    assert lib["top_functions"][0]["loc"] == 65 and lib["impl_methods"] == []
    assert main["top_functions"][0] == {"name": "build", "loc": 79}
    assert lib["consts"] == [{"loc": 1, "name": "LAST"}]


@pytest.mark.parametrize("options", [ScanOptions(include_regex=(r"lib\.rs$",)), ScanOptions(exclude_regex=("main",)), ScanOptions(exclude=("src/main.rs",))])
def test_selection(project, options):
    assert [r.path for r in scan(project, options).file_loc.collect()] == ["src/lib.rs"]


def test_offenders_keep_files_and_filter_functions(project):
    limits = OffenderLimits(120, 70)
    doc = documents(scan(project, ScanOptions(output_format="json", offenders=limits)))["r"]
    by_path = {f["path"]: f["summary"] for f in doc["files"]}
    assert set(by_path) == {"src/lib.rs", "src/main.rs"}
    assert by_path["src/lib.rs"]["file_scope_functions"] == [] and by_path["src/lib.rs"]["top_functions"] == []
    assert by_path["src/lib.rs"]["consts"] != []  # only functions are filtered
    assert [e["name"] for e in by_path["src/main.rs"]["file_scope_functions"]] == ["build"]


def test_no_offenders(project):
    options = ScanOptions(output_format="json", offenders=OffenderLimits(1000, 1000))
    assert documents(scan(project, options))["r"]["totals"] == {"files": 0, "total_loc": 0}
    options = ScanOptions(offenders=OffenderLimits(1000, 1000))
    assert report_text(scan(project, options))["r"] == [". r/", "└── no files exceeded configured LOC limits"]
    options = ScanOptions(include_regex=("nothing",))
    assert report_text(scan(project, options))["r"] == [". r/", "└── no files matched language rust"]


def test_csharp_project_skips_generated_files(files):
    table = files(
        ("App.csproj", ""),
        ("Program.cs", "class P {\n  void M() {\n    string L(int x)\n    {\n      return x;\n    }\n  }\n}\n"),
        ("Gen/W.Designer.cs", "class W { }"),
        ("obj/Debug/x.g.cs", "class X { }"),
    )
    doc = documents(scan(table, ScanOptions(output_format="json")))["r"]
    assert doc["language"] == "csharp" and [f["path"] for f in doc["files"]] == ["Program.cs"]
    assert {"loc": 4, "name": "local L"} in doc["files"][0]["summary"]["file_scope_functions"]


def test_ambiguous_roots(files):
    table = files(("m", "Cargo.toml", ""), ("m", "a.csproj", ""), ("m", "a.rs", ""), ("m", "a.cs", ""), ("n", "a.rs", "fn a() {}"))
    scanned = scan(table)
    assert {r.root: r.status for r in scanned.roots.collect()} == {"m": "ambiguous", "n": "ok"}
    assert set(report_text(scanned)) == {"n"}
    assert {r.root: r.files for r in scanned.totals.collect()} == {"m": 0, "n": 1}
    with pytest.raises(PySparkException, match="unable to auto-detect language"):
        scan(table, ScanOptions(mode="failfast"))


def test_given_roots_without_files(spark, files):
    roots = spark.createDataFrame(
        [("r", "Label", "directory", "/x/Label"), ("gone", "Gone", "directory", "/x/Gone")], "root string, label string, kind string, uri string"
    )
    scanned = scan(files(("a.rs", "fn a() {}")), ScanOptions(output_format="json"), roots)
    assert {r.root: r.files for r in scanned.totals.collect()} == {"r": 1, "gone": 0}
    assert documents(scanned)["r"]["root"] == {"label": "Label", "kind": "directory", "path": "/x/Label"}


def test_ties_in_the_ranking(spark):
    rows = [("r", 1, "p", True, i, name, loc) for i, (name, loc) in enumerate([("b", 2), ("a", 2), ("c", 3), ("a", 2), ("z", 1)])]
    items = spark.createDataFrame(
        rows, "root string, file_id bigint, path string, is_function boolean, ordinal int, display_name string, loc bigint"
    )
    got = [(r.rank, r.display_name) for r in rank.top_functions(items).orderBy("rank").collect()]
    assert got == [(1, "c"), (2, "a"), (3, "a")]
    assert rank.top_functions(items, 5).count() == 5


def test_limits_are_strict(spark):
    items = spark.createDataFrame(
        [("r", 1, True, 10), ("r", 2, True, 11), ("r", 2, False, 99)], "root string, file_id bigint, is_function boolean, loc bigint"
    )
    sizes = spark.createDataFrame([("r", 1, "a", 20), ("r", 2, "b", 5), ("r", 3, "c", 21)], "root string, file_id bigint, path string, total_loc bigint")
    kept = offenders.offending_files(sizes, items, 20, 10)
    assert {r.path for r in kept.collect()} == {"b", "c"}
    assert sorted((r.file_id, r.loc) for r in offenders.offender_items(items, kept, 10).collect()) == [(2, 11), (2, 99)]


def draw(paths):
    """The expected tree, node by node."""
    root = {}
    for path in paths:
        node = root
        *dirs, name = path.split("/")
        for d in dirs:
            node = node.setdefault((0, d), {})
        node[(1, name)] = None
    out = []

    def walk(node, indent):
        for i, ((is_file, name), child) in enumerate(sorted(node.items(), key=lambda kv: kv[0])):
            last = i == len(node) - 1
            out.append(indent + ("└── " if last else "├── ") + (name + " (t)" if is_file else name + "/"))
            if not is_file:
                walk(child, indent + ("    " if last else "│   "))

    walk(root, "")
    return out


def test_trees_and_path_order(spark):
    rng = random.Random(7)
    names = ["a", "b", "a.b", "B", "c-d", "é"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) + f"/f{rng.randint(0, 40)}.rs" for _ in range(150)})
    table = spark.createDataFrame([("big", i, p, "t") for i, p in enumerate(paths)] + [("one", 1, "x.rs", "t")],
                                  "root string, file_id bigint, path string, text string")
    got = {}
    for r in tree.tree_report(table).orderBy("root", "line_no").collect():
        got.setdefault(r.root, []).append(r.text)
    assert got["one"] == [". one/", "└── x.rs (t)"]
    assert got["big"] == [". big/", *draw(paths)]
    placed = rank.ordered_files(table.filter("root = 'big'")).orderBy("position").collect()
    assert [r.path for r in placed] == sorted(paths, key=lambda p: p.split("/"))
    assert [r.position for r in placed] == list(range(1, len(paths) + 1))


def test_file_roots(files):
    table = as_file_root(files(("a/b/x.rs", "fn f() {}"), ("y.rs", "\n")))
    from srcmetrics.operators.rust_items import rust_items

    texts = report.summary_text(lines.file_loc(table), rank.top_functions(rust_items(table)))
    got = sorted(r.text for r in tree.tree_file_root(texts).collect())
    assert got == [". x.rs (1 loc; max fns loc: f (1))", ". y.rs (0 loc; max fns loc: none)"]
    roots = table.select("root", "label", F.lit("rust").alias("language")).limit(1)
    assert tree.tree_empty_file_root(roots).first().text == ". x.rs (no files matched language rust)"
    assert tree.tree_empty_file_root(roots, True).first().text == ". x.rs (no files exceeded configured LOC limits)"


IGNORE_FILES = [
    (".ignore", "# c\n\n*.gen.rs\n/out/\n!keep.gen.rs\ndocs/*.md\n**/tmp/**\nfoo?.rs\n[ab].rs\n\\#x.rs\nsp\\ ace.rs  \n"),
    ("sub/.ignore", "*.rs\n!in.rs\n"),
    ("out/.ignore", "!*\n"),
    (".gitignore", "*.cs\n!sub/in.rs\n"),
    ("sub/deep/.ignore", "!back.rs\n"),
]
IGNORED = ["x.gen.rs", "a/x.gen.rs", "out/x.rs", "docs/x.md", "q/tmp/z/x.rs", "foo1.rs", "a.rs", "q/b.rs", "#x.rs", "sub/x.rs", "sub/deep/y.rs", "sp\\ ace.rs".replace("\\", "")]
KEPT = ["keep.gen.rs", "a/keep.gen.rs", "a/out/x.rs", "docs/d/x.md", "foo12.rs", "c.rs", "sub/in.rs", "sub/deep/back.rs", "a/x.cs", "z.rs"]


def test_ignore_rules(files):
    table = files(*IGNORE_FILES, *[(p, "") for p in IGNORED + KEPT])
    own = ignore.ignore_rules(table, gitignore=False)
    kept = {r.path for r in ignore.apply_ignore_rules(table, own).collect()}
    assert kept & set(IGNORED) == set() and set(KEPT) <= kept
    both = ignore.ignore_rules(table)
    kept = {r.path for r in ignore.apply_ignore_rules(table, both).collect()}
    assert "a/x.cs" not in kept and "sub/in.rs" in kept
    needs_git = ignore.ignore_rules(table, require_git=True)
    assert {r.source for r in needs_git.collect()} == {".ignore"}


def test_salted_way_gives_the_same(spark, files, project, monkeypatch):
    table = files(*IGNORE_FILES, *[(p, "") for p in IGNORED + KEPT])
    rules = ignore.ignore_rules(table)
    first = sorted(r.path for r in ignore.apply_ignore_rules(table, rules).collect())
    items = sorted(scan(project).items.drop("ordinal").collect())
    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    assert sorted(r.path for r in ignore.apply_ignore_rules(table, rules).collect()) == first
    assert sorted(scan(project).items.drop("ordinal").collect()) == items


def test_position_over_many_slices(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 7919 % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, v bigint").repartition(5)
    got = skew.global_position(df, ["g"], [F.col("v")]).collect()
    for g in {r[0] for r in rows}:
        placed = sorted((r.position, r.v) for r in got if r.g == g)
        assert [v for _, v in placed] == sorted(v for gg, v in rows if gg == g)
        assert [n for n, _ in placed] == list(range(1, len(placed) + 1))


def test_checkpoints_go_to_the_named_folder(spark):
    skew.checkpointed(spark.range(1))
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()


def test_sum_of_files_is_the_total(project):
    sizes = lines.file_loc(project)
    assert summary.totals(sizes).first().total_loc == sum(r.total_loc for r in sizes.collect())
    scanned = scan(project)
    per_file = {r.file_id: r.total_loc for r in scanned.file_loc.collect()}
    assert all(r.loc <= per_file[r.file_id] for r in scanned.items.collect())


def test_reading_a_tree_with_hidden_files(spark, tmp_path):
    root = tmp_path / "repo"
    (root / ".hidden" / "_x").mkdir(parents=True)
    (root / "src").mkdir()
    (root / ".hidden" / "_x" / "a.rs").write_text("fn a() {}\n")
    (root / "src" / "b.rs").write_bytes(b"// \xff\nfn b() {}\n")
    (root / "Cargo.toml").write_text("")
    (root / "loop").symlink_to(root)
    table = read_corpus(spark, [f"file://{root}/"], tasks=2)
    got = {r.path: r.content for r in table.collect()}
    assert got == {".hidden/_x/a.rs": "fn a() {}\n", "src/b.rs": "// �\nfn b() {}\n", "Cargo.toml": ""}
    assert {r.root for r in table.select("root").collect()} == {f"file://{root}"}
    scanned = scan(table)
    assert scanned.roots.first().label == "repo" and scanned.items.count() == 2


def test_spread_leaves_large_tables_alone(spark):
    wide = spark.range(0, 100, 1, 16)
    assert spread(wide) is wide and spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 8


def test_text_does_not_reach_a_shuffle(project):
    from srcmetrics.operators.rust_items import rust_items

    plan = rust_items(project.filter("path like '%.rs'"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert windows and not any("content" in line or "chunk" in line for line in windows)
    physical = rust_items(project)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1


def test_written_reports_are_whole_in_order(project, tmp_path):
    import json

    s = scan(project, ScanOptions(language="rust", output_format="json"))
    want = {}
    for r in s.report().orderBy("root", "line_no").collect():
        want.setdefault(r.root, []).append(r.text)
    report.write_report(s.report(), f"{tmp_path}/report")
    for root, lines_ in want.items():
        parts = sorted((tmp_path / "report" / f"root={root}").glob("part-*"))
        text = "".join(p.read_text() for p in parts)
        assert text.splitlines() == lines_
        json.loads(text)


def test_files_are_read_by_bytes(spark, tmp_path, monkeypatch):
    from srcmetrics.sources import corpus

    rows = [(f"d{i % 5}/.h/f{i}", "x" * (i * 997 % 5000)) for i in range(200)] + [("big", "y" * 100_000), ("empty", "")]
    files_ = spark.createDataFrame(rows, "path string, content string")
    assert corpus.write_tree(files_, f"file://{tmp_path}/t") == 202
    table = read_corpus(spark, [f"file://{tmp_path}/t"])
    assert sorted((r.path, r.content) for r in table.collect()) == sorted(rows)
    listing = corpus.list_tree(spark, [f"file://{tmp_path}/t"])
    assert {r.uri.rsplit("/", 1)[1]: r["size"] for r in listing.collect()}["big"] == 100_000
    monkeypatch.setattr(corpus, "TASK_BYTES", 10_000)
    total = sum(len(t) for _, t in rows)
    named = listing.selectExpr("top AS root", "uri AS path", "uri", "size")
    assert corpus.read_listed(named).rdd.getNumPartitions() == -(-total // 10_000)
