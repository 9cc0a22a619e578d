"""Nesting to any depth, the state at the end of a text, and branches of conditions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from srcmetrics.functions import lexical, nesting
from srcmetrics.operators.csharp_items import csharp_items
from srcmetrics.operators.rust_items import rust_items
from srcmetrics.operators.structure import chunks, mask_source, scan_status
from srcmetrics.options import ScanOptions
from srcmetrics.plans.scan import scan


def flat(text):
    """Plain reading of Rust text: markers inside block comments become dashes."""
    out, i, depth = [], 0, 0
    while i < len(text):
        two = text[i : i + 2]
        if depth:
            if two in ("/*", "*/"):
                depth += 1 if two == "/*" else -1
                out.append("--" if depth > (two == "/*") else two)
                i += 2
            else:
                out.append(text[i])
                i += 1
        elif two == "/*":
            depth, i = 1, i + 2
            out.append(two)
        elif two == "//":
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
            out.append(text[i:end])
            i = end
        elif text[i] == '"' or (text[i] == "r" and text[i + 1 : i + 2] in ("#", '"') and not text[i - 1 : i].isalnum()):
            n = 0
            if text[i] == "r":
                n = len(text[i + 1 :]) - len(text[i + 1 :].lstrip("#"))
                if text[i + 1 + n : i + 2 + n] != '"':
                    out.append("r")
                    i += 1
                    continue
                end = text.find('"' + "#" * n, i + 2 + n)
                end = len(text) if end < 0 else end + 1 + n
            else:
                end = i + 1
                while end < len(text) and text[end] != '"':
                    end += 2 if text[end] == "\\" else 1
                end = min(end + 1, len(text))
            out.append(text[i:end])
            i = end
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def test_flat_comments(spark):
    rng = random.Random(2)
    parts = ["/*", "*/", "/* ", " */", "//", "\n", '"', '\\"', 'r#"', '"#', "a ", " b", "{", "'", " r", "/", "*", "'a"]
    texts = ["".join(rng.choices(parts, weights=[4, 4, 2, 2, 1, 3, 2, 1, 1, 1, 3, 3, 1, 0, 1, 1, 1, 1], k=rng.randrange(1, 30))) for _ in range(1500)]
    # three signs in a row, of which a code reader and a comment reader take different pairs
    texts = [t for t in texts if "*/*" not in t and "/*/" not in t and "//*" not in t]
    texts += ["/* a /* b */ c */ d", 'x "/* /* "; /* /* */ */', "// /* /*\nfn", "/* /* */", "/* a */ /* /* b */ c */ /* d */ /*/* x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nesting.flat_comments(F.col("t")).alias("f")).collect()
    assert [(r.t, r.f) for r in got] == [(t, flat(t)) for t in texts]


@pytest.mark.parametrize("depth", [17, 40, 200])
def test_rust_nests_to_any_depth(files, depth):
    generics = "A<" * depth + "u8" + ">" * depth
    texts = {
        "comment": "/*" * depth + " x\n {" + "*/" * depth + "\nfn real() {\n}\n",
        "doc": "fn before() {}\n/** " + "/* { */" * depth + "/*" * depth + "*/" * depth + " */\nfn real() {}\n",
        "generics": f"impl<T: {generics}> Tr for Q<T> {{\n fn m(&self) {{}}\n}}\n",
        "target": f"impl Q<{generics}> {{\n fn m(&self) {{}}\n}}\nfn f(x: {generics}) -> {generics} {{}}\n",
        "attribute": "// no\n#[test]\n#[a(" + "b[" * depth + "]" * depth + ")]\nfn t() {\n}\nfn u() {}\n",
        "groups": "fn f(x: " + "(" * depth + "u8" + ",)" * depth + ", y: " + "[" * depth + "u8" + "; 1]" * depth + ") {\n}\nfn g() {}\n",
    }
    got = {(r.path, r.category, r.name, r.start_line, r["loc"], r.owner_trait) for r in rust_items(files(*texts.items())).collect()}
    target = f"Q < {generics.replace('<', ' < ').replace('>', ' >')} >"
    assert got == {
        ("comment", "file_scope_function", "real", 3, 2, None),
        ("doc", "file_scope_function", "before", 1, 1, None),
        ("doc", "file_scope_function", "real", 2, 2, None),
        ("generics", "impl_block", "Q < T >", 1, 3, "Tr"),
        ("generics", "impl_method", "m", 2, 1, "Tr"),
        ("target", "impl_block", target, 1, 3, None),
        ("target", "impl_method", "m", 2, 1, None),
        ("target", "file_scope_function", "f", 4, 1, None),
        ("attribute", "test_function", "t", 2, 4, None),
        ("attribute", "file_scope_function", "u", 6, 1, None),
        ("groups", "file_scope_function", "f", 1, 2, None),
        ("groups", "file_scope_function", "g", 3, 1, None),
    }
    assert {r.status for r in scan_status(files(*texts.items()), "rust").collect()} == {"ok"}
    masked = {r.path: r.masked for r in mask_source(files(*texts.items()), "rust").collect()}
    assert masked["comment"].split() == ["fn", "real()", "{", "}"]


@pytest.mark.parametrize("depth", [17, 40, 200])
def test_csharp_nests_to_any_depth(files, depth):
    generics = "A<" * depth + "int" + ">" * depth
    tuples = "(" * depth + "int a" + ", int b)" * depth
    texts = {
        "generics": f"class X {{\n {generics} M<T>({generics} a) {{ }}\n}}\n",
        "tuples": f"class X {{\n int M({tuples} a) {{ return 1; }}\n int x;\n X({tuples} a) : base(b => {{ c(); }})\n {{\n }}\n}}\n"
        f"interface I {{\n [A({tuples.replace('int ', '').replace('a', 'B')})]\n void N({tuples} a);\n}}\n",
    }
    got = {(r.path, r.category, r.name, r["loc"]) for r in csharp_items(files(*texts.items())).collect()}
    assert got == {
        ("generics", "struct", "X", 3),
        ("generics", "impl_block", "X", 3),
        ("generics", "impl_method", "M", 1),
        ("tuples", "struct", "X", 7),
        ("tuples", "impl_block", "X", 7),
        ("tuples", "impl_method", "M", 1),
        ("tuples", "impl_method", "X", 3),
        ("tuples", "trait", "I", 4),
        ("tuples", "impl_block", "I", 4),
        ("tuples", "trait_method", "N", 2),
    }


def test_branches_of_conditions(files):
    texts = {
        "heads": "#if A\nclass X : B {\n#else\nclass X : C {\n#endif\n int F() {\n return 1;\n }\n}\nclass Y { }\n",
        "three": "namespace N {\n#if A\nclass X : B {\n#elif B\nclass X : C {\n#else\nclass X {\n#endif\n void M() { }\n}\n}\n",
        "bodies": "class X {\n#if A\n void M() {\n  if (a) {\n#else\n void M(int x) {\n  if (b) {\n#endif\n  go();\n }\n }\n void N() { }\n}\n",
        "whole": "class X {\n#if A\n void M() { }\n#else\n void M(int x) { }\n#endif\n}\n",
        "ends": "class X {\n void M() {\n#if A\n a();\n }\n#else\n b(); }\n#endif\n void N() { }\n}\n",
        "nested": "class X {\n#if A\n void M() {\n#else\n#if B\n void M(int x) {\n#else\n void M(long x) {\n#endif\n#endif\n go();\n }\n void N() { }\n}\n",
        "split": "class X {\n#if A\n void M() {\n#endif\n go();\n#if A\n }\n#endif\n}\n",
    }
    table = files(*texts.items())
    got = {(r.path, r.category, r.name, r.start_line, r["loc"]) for r in csharp_items(table).collect() if r.category != "impl_block"}
    assert got == {
        ("heads", "struct", "X", 2, 8),
        ("heads", "impl_method", "F", 6, 3),
        ("heads", "struct", "Y", 10, 1),
        ("three", "struct", "X", 3, 8),
        ("three", "impl_method", "M", 9, 1),
        ("bodies", "struct", "X", 1, 13),
        ("bodies", "impl_method", "M", 3, 9),
        ("bodies", "impl_method", "N", 12, 1),
        ("whole", "struct", "X", 1, 7),
        ("whole", "impl_method", "M", 3, 1),
        ("whole", "impl_method", "M", 5, 1),
        ("ends", "struct", "X", 1, 10),
        ("ends", "impl_method", "M", 2, 4),
        ("ends", "impl_method", "N", 9, 1),
        ("nested", "struct", "X", 1, 14),
        ("nested", "impl_method", "M", 3, 10),
        ("nested", "impl_method", "N", 13, 1),
        ("split", "struct", "X", 1, 9),
        ("split", "impl_method", "M", 3, 5),
    }
    assert {r.status for r in scan_status(table, "csharp").collect()} == {"ok"}


STATUS = {
    "rust": {
        "kinds": ("fn a() { ( } )\n", "unbalanced"),
        "swapped": ("fn a(x: [u8; 4)] {}\n", "unbalanced"),
        "comment": ("fn a() {}\n/* { fn b() {}\n", "unterminated"),
        "deep comment": ("/*" * 40 + "*/" * 39 + "\nfn b() {}\n", "unterminated"),
        "string": ('fn a() {}\nconst S: &str = "x; {\n', "unterminated"),
        "raw": ('const S: &str = r##"x"#; {\n', "unterminated"),
        "open": ("fn a() {\n", "unbalanced"),
        "close": ("fn a() {}\n}\n", "unbalanced"),
        "both": ("fn a() {} }\nfn b() {\n", "unbalanced"),
        "fine": ("fn a<'a>(x: &'a str) { let y = '\"'; let z = \"\\\"{\"; } // \"\n/* ' */\n", "ok"),
        "lone quote": ("fn a() {}\n// it's \"\n", "ok"),
        "empty": ("", "ok"),
    },
    "csharp": {
        "kinds": ("class X { void M() { ( } ) }\n", "unbalanced"),
        "swapped": ("class X { int[] y = [1, 2); }\n", "unbalanced"),
        "comment": ("class X { }\n/* class Y { }\n", "unterminated"),
        "verbatim": ('class X { string s = @"c:\\";\n} \n string t = @"x\n', "unterminated"),
        "raw": ('class X { string s = """ " "" ; }\n', "unterminated"),
        "open": ("class X {\n", "unbalanced"),
        "close": ("class X { }\n}\n", "unbalanced"),
        "fine": ('#region "\nclass X { string s = $"{a} }}{{"; char c = \'"\'; string t = ""; }\n#endregion don\'t\n// "\n', "ok"),
    },
}


@pytest.mark.parametrize("language", STATUS)
def test_status(files, language):
    items = {"rust": rust_items, "csharp": csharp_items}[language]
    table = files(*[(name, text) for name, (text, _) in STATUS[language].items()])
    want = {name: status for name, (_, status) in STATUS[language].items()}
    assert {r.path: r.status for r in scan_status(table, language).collect()} == want
    rows = items(table, with_files=True).filter("category = 'file'").collect()
    assert {r.path: r.status for r in rows} == want


def test_scans_tell_the_status_of_their_files(files):
    table = files(("a.rs", "fn a() {\n}\n"), ("b.rs", "fn b() { ( }\n"), ("c.rs", "/* fn c() {}\n"), ("d.cs", "class D {"))
    s = scan(table, ScanOptions(language="rust"))
    assert {r.path: r.status for r in s.status.collect()} == {"a.rs": "ok", "b.rs": "unbalanced", "c.rs": "unterminated"}
    assert "status" not in s.items.columns
    with pytest.raises(Exception, match="unable to parse source file"):
        scan(table, ScanOptions(language="rust", mode="failfast"))
    scan(files(("a.rs", "fn a() {\n}\n")), ScanOptions(language="rust", mode="failfast"))


def test_byte_order_marks(files):
    from srcmetrics.operators.lines import file_loc

    rust = files(("a.rs", "\ufefffn a() {}\n"), ("b.rs", "\ufeff\nfn b() {\n}\n"), ("c.rs", "\ufeff#![allow(x)]\n/// d\nfn c() {}\n"))
    rows = rust_items(rust, with_files=True).collect()
    sizes = {r.path: r["loc"] for r in rows if r.category == "file"}
    assert sizes == {r.path: r.total_loc for r in file_loc(rust).collect()} == {"a.rs": 1, "b.rs": 3, "c.rs": 3}
    assert {(r.name, r.start_line, r["loc"]) for r in rows if r.category != "file"} == {("a", 1, 1), ("b", 2, 2), ("c", 2, 2)}
    sharp = files(("a.cs", "\ufeffusing System;\nclass A { }\n"), ("b.cs", "\ufeff\nclass B { }\n"))
    rows = csharp_items(sharp, with_files=True).collect()
    sizes = {r.path: r["loc"] for r in rows if r.category == "file"}
    assert sizes == {r.path: r.total_loc for r in file_loc(sharp).collect()} == {"a.cs": 2, "b.cs": 2}
    assert {(r.name, r.start_line) for r in rows if r.category == "struct"} == {("A", 2), ("B", 2)}


BRANCHED = "class C%d : A\n{\n#if X\nvoid M()\n{\n#else\nvoid M(int a)\n{\n#endif\nint[] x = [1, 2];\n}\n}\n"


def test_branches_of_long_files(spark, files):
    """A file may have many marked chunks, and costs no more than its text in many files."""
    n = 300
    blocks = [BRANCHED % i for i in range(n)]
    found = csharp_items(files(("a.cs", "namespace N;\n" + "".join(blocks)))).collect()
    assert sorted(r.name for r in found if r.category == "struct") == sorted(f"C{i}" for i in range(n))
    methods = [r for r in found if r.category == "impl_method"]
    assert len(methods) == n and {r.loc for r in methods} == {8}

    def took(*texts):
        rows = files(*[(f"{i}.cs", t) for i, t in enumerate(texts)]).coalesce(1)
        start = time.perf_counter()
        chunks(rows, "csharp").write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    part = "".join(blocks[:50])
    took(part)
    assert took(part * 300) < 3 * took(*[part] * 300)


def test_groups_side_by_side(spark):
    """All groups of a text are taken out, those side by side at once."""
    texts = ["f" + "(a)" * 400, "f" + "(" * 23 + ")" * 23 + "(b(c))" * 50, "(" * 9 + ")" * 8]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        nesting.peeled(F.col("t"), lexical.CS_PARENS, "()", "(", lexical.PEEL_LEVELS).alias("p")
    )
    assert [r.p for r in rows.collect()][:2] == ["f" + "()" * 400, "f()" + "()" * 50]
    assert rows.collect()[2].p == "()".join(["(", ""])


def test_comments_of_long_files(spark):
    """A text with many nested comments costs no more than its parts in many files."""
    part = "".join(f"fn f{i}() {{\n/* a /* {{ */ */\n}}\n" for i in range(20))

    def flattened(*texts):
        return spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(nesting.flat_comments(F.col("t")).alias("f"))

    def took(*texts):
        start = time.perf_counter()
        flattened(*texts).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    took(part)
    assert took(part * 100) < 3 * took(*[part] * 100)
    open_ = "/* a /* b"
    assert [r.f for r in flattened(part * 30, part * 30 + open_).collect()] == [flat(part * 30), flat(part * 30 + open_)]
