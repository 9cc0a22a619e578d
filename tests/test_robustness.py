"""Nesting and literals in heads, odd ignore rules, and the choice of files in whole scans."""

import io
from contextlib import redirect_stdout

import pytest

from srcmetrics.operators import ignore, skew
from srcmetrics.operators.csharp_items import csharp_items
from srcmetrics.operators.rust_items import rust_items
from srcmetrics.operators.select import exclude_prefixes
from srcmetrics.options import ScanOptions
from srcmetrics.plans import scan as plan
from srcmetrics.plans.scan import scan


def found(items):
    return {(r.path, r.category, r.name, r.owner, r.start_line, r["loc"]) for r in items.collect()}


def test_rust_heads_with_literals_and_deep_nesting(files):
    texts = {
        "raw": '#[doc = r#"a ] " b"#]\nfn w() {\n}\n',
        "char": "#[arg(sep = ']')]\nfn c() {}\n",
        "nested": "#[a(b[c[d[e[f]]]])]\nstruct N;\n",
        "comment": "/*" * 9 + " x " + "*/" * 9 + "\nfn real() {}\n",
        "generics": "impl<T: A<B<C<D<E<F<G<H<u8>>>>>>>>> Tr for Q<T> {\n fn m(&self) {}\n}\n",
        "const": "fn f() -> Foo<\n    { N + 1 },\n> {\n  x\n}\n",
        "call": "impl Foo<{ g(1) }> {\n fn m() {}\n}\n",
    }
    assert found(rust_items(files(*texts.items()))) == {
        ("raw", "file_scope_function", "w", None, 1, 3),
        ("char", "file_scope_function", "c", None, 1, 2),
        ("nested", "struct", "N", None, 1, 2),
        ("comment", "file_scope_function", "real", None, 2, 1),
        ("generics", "impl_block", "Q < T >", None, 1, 3),
        ("generics", "impl_method", "m", "Q < T >", 2, 1),
        ("const", "file_scope_function", "f", None, 1, 5),
        ("call", "impl_block", "Foo < { g (1) } >", None, 1, 3),
        ("call", "impl_method", "m", "Foo < { g (1) } >", 2, 1),
    }


def test_csharp_heads_with_literals_and_deep_nesting(files):
    texts = {
        "typeof": "[A(new[] { typeof(B[][]) })]\nclass X {\n void M() { }\n}\n",
        "string": 'class X {\n [A(new[] { "a" })]\n void M() { }\n}\n',
        "parameter": 'class X {\n void Q(int[] x, [B(C = new[] { "s" })] int y) { }\n}\n',
        "deep": "class X {\n int P(((((((int a, int b), int c), int d), int e), int f), int g) z) { return 1; }\n}\n",
    }
    got = found(csharp_items(files(*texts.items())))
    assert {r for r in got if r[1] == "impl_method"} == {
        ("typeof", "impl_method", "M", "X", 3, 1),
        ("string", "impl_method", "M", "X", 2, 2),
        ("parameter", "impl_method", "Q", "X", 2, 1),
        ("deep", "impl_method", "P", "X", 2, 1),
    }
    assert {(r[0], r[4]) for r in got if r[1] == "struct"} == {(k, 1) for k in texts}
    assert not any(r[2] == "top-level statements" for r in got)


ODD = ["foo[", "[z-a].rs", "a\\", "[", "]", "[]", "[!]", "[[a]]", "{", "}", "(", "*)", "+?", "a&&b", "\\q", "\\d+", "[\\", "**[", "$^|", "[a-", "!", "!["]


def test_odd_rule_lines_do_not_end_the_job(files):
    table = files((".ignore", "\n".join([*ODD, "gone.rs", "[!b-d]x.rs", "{y}.rs"])), ("gone.rs", ""), ("ax.rs", ""), ("cx.rs", ""), ("{y}.rs", ""), ("keep.rs", ""))
    kept = {r.path for r in ignore.apply_ignore_rules(table, ignore.ignore_rules(table)).collect()}
    assert kept == {".ignore", "cx.rs", "keep.rs"}


def test_many_prefixes_filter_like_few(files):
    table = files(("src/a.rs", ""), ("src2/b.rs", ""), ("lib/c/d.rs", ""), (None, ""))
    few = exclude_prefixes(table, ["src", "./lib", " lib/c "])
    many = exclude_prefixes(table, ["src", "lib/c", *(f"no{i}" for i in range(500))])
    want = {"src2/b.rs", None}
    assert {r.path for r in few.collect()} == {r.path for r in many.collect()} == want


def test_own_rules_hold_before_the_language_is_told(files):
    table = files((".ignore", "vendor/"), ("vendor/a.cs", "class A { }"), ("vendor/b.cs", "class B { }"), ("m.rs", "fn m() {}"))
    scanned = scan(table)
    assert [r.language for r in scanned.roots.collect()] == ["rust"]
    assert [r.name for r in scanned.items.collect()] == ["m"]


def test_every_given_and_found_root_is_reported(spark, files):
    table = files(("listed", "a.rs", "fn a() {}\n"), ("unlisted", "b.rs", "fn b() {}\n"))
    roots = spark.createDataFrame(
        [("listed", "L", "directory", "/l"), ("empty", "E", "directory", "/e")], "root string, label string, kind string, uri string"
    )
    scanned = scan(table, ScanOptions(language="rust"), roots)
    assert {(r.root, r.label, r.language, r.status) for r in scanned.roots.collect()} == {
        ("listed", "L", "rust", "ok"),
        ("unlisted", "unlisted", "rust", "ok"),
        ("empty", "E", "rust", "ok"),
    }
    first = {r.root: r.text for r in scanned.report().filter("line_no = 1").collect()}
    assert set(first) == {"listed", "unlisted", "empty"}


def explained(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@pytest.mark.parametrize("broadcast_bytes", [skew.BROADCAST_BYTES, -1])
def test_text_meets_no_shuffled_join(files, monkeypatch, broadcast_bytes):
    seen = []
    monkeypatch.setattr(skew, "BROADCAST_BYTES", broadcast_bytes)
    kept = plan.checkpointed
    monkeypatch.setattr(plan, "checkpointed", lambda df: seen.append(explained(df)) or kept(df))
    table = files((".ignore", "no.rs"), ("no.rs", "fn n() {}\n"), ("yes.rs", "fn y() {}\n"), ("x.cs", "class X { }\n"), ("Cargo.toml", ""))
    scanned = scan(table)
    assert [r.name for r in scanned.items.collect()] == ["y"]
    for text in seen:
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line or "SortMergeJoin" in line:
                below = next((x for x in lines[i + 1 :] if "Project" in x), "")
                assert "content#" not in below or "AS content" in below


GLOBS = {
    "foo[[]bar.rs": (["foo[bar.rs", "d/foo[bar.rs"], ["foobar.rs", "foo[[]bar.rs"]),
    "[[:alpha:]]x.rs": (["ax.rs", "d/Zx.rs"], ["1x.rs", ":x.rs", "x.rs"]),
    "[![:digit:]_]y.rs": (["ay.rs"], ["1y.rs", "_y.rs"]),
    "[\\\\a]z.rs": (["\\z.rs", "az.rs"], ["bz.rs"]),
    "[a&&b]q.rs": (["aq.rs", "bq.rs", "&q.rs"], ["cq.rs"]),
    "[]-]w.rs": (["]w.rs", "-w.rs"], ["aw.rs"]),
    "[^a-c]v.rs": (["dv.rs"], ["bv.rs"]),
    "open[ab": ([], ["opena", "open[ab"]),
    "[z-a]u.rs": ([], ["mu.rs"]),
    "p(1)+{2}.rs": (["p(1)+{2}.rs"], ["p11{2}.rs"]),
    "a\\*b.rs": (["a*b.rs"], ["axb.rs"]),
    "**/k/**": (["k/a", "d/k/b/c"], ["k", "dk/a"]),
    "m/**/n.rs": (["m/n.rs", "m/a/b/n.rs"], ["mn.rs"]),
}


def test_globs(spark):
    rows = [(f"r{i}", -1, ".ignore", f"{glob}\n") for i, glob in enumerate(GLOBS)]
    rows += [(f"r{i}", k, path, "") for i, (hit, miss) in enumerate(GLOBS.values()) for k, path in enumerate(hit + miss)]
    table = spark.createDataFrame(rows, "root string, file_id bigint, path string, content string")
    rules = ignore.ignore_rules(table)
    kept = {(r.root, r.path) for r in ignore.apply_ignore_rules(table, rules).filter("file_id >= 0").collect()}
    assert kept == {(f"r{i}", path) for i, (_, miss) in enumerate(GLOBS.values()) for path in miss}


def test_rules_of_repositories(files):
    base = [(".gitignore", "!b.rs\n*.x\n"), (".ignore", "!c.rs\n"), (".git/info/exclude", "a.rs\nb.rs\nc.rs\n")]
    table = files(*base, *[(p, "") for p in ("a.rs", "b.rs", "c.rs", "d.x", "src/a.rs")])
    rules = ignore.ignore_rules(table, require_git=True)
    kept = {r.path for r in ignore.apply_ignore_rules(table, rules).collect()}
    assert {"b.rs", "c.rs"} <= kept and not kept & {"a.rs", "d.x", "src/a.rs"}
    plain = files((".gitignore", "a.rs\n"), ("a.rs", "fn a() {}"), ("b.rs", "fn b() {}"))
    options = ScanOptions(language="rust", ignore_rules=True)
    assert {r.path for r in scan(plain, options).file_loc.collect()} == {"a.rs", "b.rs"}  # no repository
    inside = files((".gitignore", "a.rs\n"), ("a.rs", "fn a() {}"), ("b.rs", "fn b() {}"), (".git/HEAD", "x"))
    assert {r.path for r in scan(inside, options).file_loc.collect()} == {"b.rs"}


def test_only_heavy_keys_are_spread(spark, monkeypatch):
    rows = spark.range(1_000_000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 50000)) AS k", "id AS v")
    small = spark.range(50_000).selectExpr("concat('k', id) AS k", "id AS w").unionByName(spark.sql("SELECT 'hot' AS k, -1L AS w"))
    heavy = skew.heavy_keys(rows, ["k"], 100)
    hot = spark.sql("SELECT xxhash64('hot') AS h").first().h
    assert set(heavy) == {hot} and 30 <= heavy[hot] <= 40
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        joined = skew.skewed_join(rows, small, ["k"], ["v"])
        plan = joined._jdf.queryExecution().toString()
        assert "_salt" in plan
        assert joined.count() == 1_000_000 and joined.filter("k = 'hot' AND w <> -1").isEmpty()
        even = rows.filter("k <> 'hot'")
        assert skew.heavy_keys(even, ["k"], 100) == {}
        assert "_salt" not in skew.skewed_join(even, small, ["k"], ["v"])._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
