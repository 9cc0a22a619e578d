import pytest
from pyspark.sql import functions as F

from srcmetrics.functions import lexical as lx
from srcmetrics.operators.csharp_items import csharp_items
from srcmetrics.operators.lines import file_loc
from srcmetrics.operators.rust_items import rust_items


@pytest.fixture(scope="module")
def rust(files):
    def run(text):
        rows = rust_items(files(("a.rs", text))).orderBy("ordinal", "category").collect()
        return [(r.category, r.display_name, r.loc) for r in rows]

    return run


@pytest.fixture(scope="module")
def csharp(files):
    def run(text):
        rows = csharp_items(files(("a.cs", text))).orderBy("ordinal", "category").collect()
        return [(r.category, r.display_name, r.loc) for r in rows]

    return run


RUST_CASES = {
    "attributes and docs belong to the item, plain comments do not": (
        "#![allow(x)]\n//! inner\n\n// plain\n/// doc {\n#[inline]\n\npub fn a() {\n\n    b();\n}\n",
        [("file_scope_function", "a", 5)],
    ),
    "nested functions and modules": (
        "mod m {\n  fn a() {\n    fn b() {}\n  }\n}",
        [("file_scope_function", "a", 3), ("file_scope_function", "b", 1)],
    ),
    "only the plain test attribute makes a test": (
        "#[test]\nfn a() {}\n#[x::test]\nfn b() {}\n// #[test]\nfn c() {}\n#[cfg(test)]\nfn d() {}\n#[ignore]\n#[test]\nfn e() {}",
        [
            ("test_function", "a", 2),
            ("file_scope_function", "b", 2),
            ("file_scope_function", "c", 1),
            ("file_scope_function", "d", 2),
            ("test_function", "e", 3),
        ],
    ),
    "types": (
        "struct A;\npub struct B(u8, [u8; 3]);\nstruct C<T> where T: X {\n  a: T,\n}\nenum D { X }\nunion U { a: u8 }\n",
        [("struct", "A", 1), ("struct", "B", 1), ("struct", "C", 3), ("enum", "D", 1)],
    ),
    "values end at their own semicolon": (
        'const A: &[u8] = &[\n  1,\n];\nstatic mut B: F = F {\n  a: ";",\n};\nconst _: () = f(|| { 1; });\nconst fn g() {}\nfn h(p: *const u8) {}\n',
        [
            ("const", "A", 3),
            ("static", "B", 3),
            ("const", "_", 1),
            ("file_scope_function", "g", 1),
            ("file_scope_function", "h", 1),
        ],
    ),
    "trait methods need a body, associated values are no items": (
        "pub trait T: Sized {\n  const C: u8 = 1;\n  fn a(&self);\n  fn b(&self) {\n    x();\n  }\n}\n",
        [("trait", "T", 7), ("trait_method", "trait T::b", 3)],
    ),
    "impl blocks and methods, printed token by token": (
        "impl<'a, T: Fn(u8) -> u8> fmt::Display for Foo<'a, T> {\n  fn f(&self) {}\n}\nimpl Foo<'_, [u8; 4]> {\n  const C: u8 = 1;\n"
        "  pub(crate) async unsafe fn g() {}\n}\nimpl !Send for &mut (A, B) {}\n",
        [
            ("impl_block", "Foo < 'a , T >", 3),
            ("impl_method", "fmt :: Display for Foo < 'a , T >::f", 1),
            ("impl_block", "Foo < '_ , [u8 ; 4] >", 4),
            ("impl_method", "Foo < '_ , [u8 ; 4] >::g", 1),
            ("impl_block", "& mut (A , B)", 1),
        ],
    ),
    "functions inside methods are free functions": (
        "impl A {\n  fn a() {\n    let x = 1;\n    fn b() {}\n  }\n}\n",
        [("impl_block", "A", 6), ("impl_method", "A::a", 4), ("file_scope_function", "b", 1)],
    ),
    "macro bodies and foreign blocks are not looked into": (
        'macro_rules! m {\n  () => { fn a() {} };\n}\nlazy! { static B: u8 = 1; }\nextern "C" {\n  fn c();\n  static D: u8;\n}\n'
        "quote!(fn e() {} struct F;);\nextern \"C\" fn g() { t! { fn h() {} } }\nfn i() {}\n",
        [("file_scope_function", "g", 1), ("file_scope_function", "i", 1)],
    ),
    "literals and comments hide structure": (
        "fn a() {\n  let c = '}'; let d = b'{'; let e = \"}\\\"{\";\n  let f = r##\"}\"# { \"##; // }\n  /* } /* } */ } */\n  let l: &'static str = \"\";\n}\nfn b() {}\n",
        [("file_scope_function", "a", 6), ("file_scope_function", "b", 1)],
    ),
    "impl in type position is no block": (
        "fn a() -> impl Iterator<Item = u8> {\n  let f: fn(u8) = |x| {};\n  b(move || { struct Q; });\n}\nfn c(x: impl Fn(u8) -> [u8; { 2 }]) {}",
        [("file_scope_function", "a", 4), ("struct", "Q", 1), ("file_scope_function", "c", 1)],
    ),
    "empty file": ("", []),
    "byte order mark": ("\ufefffn a() {}", [("file_scope_function", "a", 1)]),
}


@pytest.mark.parametrize("name", RUST_CASES)
def test_rust(rust, name):
    text, expected = RUST_CASES[name]
    assert rust(text) == expected


CSHARP_CASES = {
    "types give a type and a block": (
        "namespace N;\n// note\n[Some(\"{\")]\npublic sealed class A<T> : B where T : new()\n{\n}\nstruct S { }\npublic record R(int X);\nreadonly record struct Q(int X) { }\n",
        [("impl_block", "A", 4), ("struct", "A", 4), ("impl_block", "S", 1), ("struct", "S", 1), ("impl_block", "R", 1),
         ("struct", "R", 1), ("impl_block", "Q", 1), ("struct", "Q", 1)],
    ),
    "interface members count with and without a body": (
        "interface I\n{\n  int A();\n  int B() { return 1; }\n  int P { get; }\n}\n",
        [("impl_block", "I", 6), ("trait", "I", 6), ("trait_method", "A", 1), ("trait_method", "B", 1), ("trait_method", "P.get", 1)],
    ),
    "enums and delegates": (
        "enum E : byte { A = 1 }\npublic delegate (int, string) D<T>(T x) where T : class;\n",
        [("enum", "E", 1), ("delegate", "D", 1)],
    ),
    "events": (
        "class A {\n  public event H? X;\n  event H Y {\n    add {\n      q();\n    }\n    remove => q();\n  }\n}\n",
        [("impl_block", "A", 9), ("struct", "A", 9), ("event", "X", 1), ("event", "Y", 6), ("impl_method", "Y.add", 3), ("impl_method", "Y.remove", 1)],
    ),
    "fields": (
        "class A {\n  public const int C = 1;\n  static readonly Dictionary<string, int> M = new()\n  {\n    [\"{\"] = 1,\n  };\n  const static int Z = 1; int _p = F(x => { return 1; });\n}\n",
        [("impl_block", "A", 8), ("struct", "A", 8), ("const", "C", 1), ("static", "M", 4), ("const", "Z", 1)],
    ),
    "callables": (
        "class A {\n  A(int x) : base(x) { y(); }\n  ~A() { }\n  public static A operator +(A a, A b) => new();\n  public static bool operator ==(A a, A b)\n  {\n    return true;\n  }\n"
        "  public static explicit operator List<int>(A a) => null;\n  int this[int i] => 1;\n  string D => \"x\";\n"
        "  async Task<List<(int, int)>> G<T>(int a = 1, string s = \"}\") where T : class\n  {\n    z();\n  }\n  void IFoo.E() => Go(x =>\n  {\n    w();\n  });\n  abstract int H();\n}\n",
        [("impl_block", "A", 21), ("struct", "A", 21), ("impl_method", "A", 1), ("impl_method", "~A", 1), ("impl_method", "operator +", 1),
         ("impl_method", "operator ==", 4), ("impl_method", "explicit operator List<int>", 1), ("impl_method", "this[]", 1),
         ("impl_method", "D", 1), ("impl_method", "G", 4), ("impl_method", "E", 4), ("impl_method", "H", 1)],
    ),
    "accessors stand for their member": (
        "class A {\n  int P\n  {\n    get { return 1; }\n    private set => x = value;\n  }\n  string this[string k] { get { return k; } }\n"
        "  int Q { get; init; } = 1;\n  int R => x switch\n  {\n    { A: 1 } => 2,\n    _ => 3,\n  };\n}\n",
        [("impl_block", "A", 14), ("struct", "A", 14), ("impl_method", "P.get", 1), ("impl_method", "P.set", 1), ("impl_method", "this[].get", 1),
         ("impl_method", "Q.get", 1), ("impl_method", "Q.init", 1), ("impl_method", "R", 5)],
    ),
    "local functions": (
        "class A {\n  void M() {\n    var q = new F { X = 1 };\n    if (a) { return; } else { throw new E(\"x\"); }\n    int L(int x)\n    {\n      static int D() => 3;\n      return 1;\n    }\n"
        "    foreach (var i in q) { Call(() => { int N(int z) { return z; } return N(1); }); }\n    await foreach (var x in G(y)) { }\n    return Foo(x) switch { _ => 1 };\n  }\n}\n",
        [("impl_block", "A", 14), ("struct", "A", 14), ("impl_method", "M", 12), ("file_scope_function", "local L", 5),
         ("file_scope_function", "local D", 1), ("file_scope_function", "local N", 1)],
    ),
    "nested types own their members": (
        "class A {\n  class B { int C() => 1; }\n  int D() { return 1; }\n}\n",
        [("impl_block", "A", 4), ("struct", "A", 4), ("impl_block", "B", 1), ("struct", "B", 1), ("impl_method", "C", 1), ("impl_method", "D", 1)],
    ),
    "statements at the top are summed and not looked into": (
        "using System;\nusing static X.Y;\n\nvar a = 1; // one\n// note\nif (a)\n{\n  b();\n}\nelse if (c) { }\nelse\n{\n  int L() { return 1; }\n}\n"
        "do { x(); }\nwhile (true);\ntry { y(); }\ncatch { }\nvar m = new F\n{\n  A = 1,\n};\nint Add(int p)\n{\n  return p;\n}\nclass Z { void M() { } }\n",
        # 1 + 9 + 2 + 2 + 4 + 4
        [("impl_block", "Z", 1), ("struct", "Z", 1), ("impl_method", "M", 1), ("file_scope_function", "top-level statements", 22)],
    ),
    "literals, comments and directives hide structure": (
        "class A {\n  void M() {\n#region don't {\n    var s = $\"{a(\"}\")} }}{{\"; // }\n    var v = @\"c:\\\"\" {\"; var r = \"\"\"\n  { \" }\n\"\"\"; /* } */\n    var c = '{';\n#endregion\n  }\n  void N() { }\n}\n",
        [("impl_block", "A", 12), ("struct", "A", 12), ("impl_method", "M", 9), ("impl_method", "N", 1)],
    ),
}


@pytest.mark.parametrize("name", CSHARP_CASES)
def test_csharp(csharp, name):
    text, expected = CSHARP_CASES[name]
    assert csharp(text) == expected


def test_owners(files):
    rust = rust_items(files(("a.rs", "impl X for Y {\n fn a() {}\n}\ntrait T { fn b() {} }"))).collect()
    got = {(r.category, r.name): (r.owner, r.owner_trait) for r in rust}
    assert got == {
        ("impl_block", "Y"): (None, "X"),
        ("impl_method", "a"): ("Y", "X"),
        ("trait", "T"): (None, None),
        ("trait_method", "b"): ("T", None),
    }
    csharp = csharp_items(files(("a.cs", "interface I { int P { get; } }\nclass C { int M() => 1; }"))).collect()
    got = {(r.category, r.name): (r.owner, r.owner_trait) for r in csharp}
    assert got[("impl_block", "I")] == (None, "interface") and got[("impl_block", "C")] == (None, None)
    assert got[("trait_method", "P.get")] == ("I", None) and got[("impl_method", "M")] == ("C", None)


def test_file_rows_hold_the_total_of_each_file(files):
    table = files(("a.rs", "fn a() {}\n\n// x\n"), ("b.rs", ""), ("c.rs", "fn a() {"))
    rows = rust_items(table, with_files=True).filter("category = 'file'").collect()
    assert {r.path: r.loc for r in rows} == {r.path: r.total_loc for r in file_loc(table).collect()}
    table = files(("a.cs", "var a = 1;\n\nclass A { }\n// x"), ("b.cs", ""), ("c.cs", "class A {\n x"))
    rows = csharp_items(table, with_files=True).filter("category = 'file'").collect()
    assert {r.path: r.loc for r in rows} == {r.path: r.total_loc for r in file_loc(table).collect()}


def test_chunks_without_a_prefix_need_no_prefix_pattern(spark):
    texts = ["\n  pub fn a(", " \f\x0bimpl<T> X {", "\n// c\nfn a() {", "#[test]\nfn t() {", "const A: u8;", "", "\n", "[x] int a;", "extern \"C\" {"]
    chunk = F.col("chunk")
    rows = spark.createDataFrame([(t,) for t in texts], "chunk string")
    bare, marked = F.ltrim(chunk, F.lit(lx.BLANKS)), F.rlike(chunk, F.lit(lx.CS_MARKED))
    found = rows.select(
        chunk,
        (marked | (bare == F.regexp_replace(chunk, lx.CS_PREFIX, ""))).alias("csharp"),
        (
            F.rlike(chunk, F.lit(lx.RUST_MARKED))
            | (F.regexp_extract(chunk, lx.RUST_HEAD, 0) == F.regexp_extract(chunk, lx.RUST_BARE_HEAD, 0))
        ).alias("rust"),
        F.rlike(chunk, F.lit(lx.RUST_MARKED)).alias("marked"),
    ).collect()
    assert all(r.csharp and r.rust for r in found)
    assert [r.chunk for r in found if r.marked] == ["\n// c\nfn a() {", "#[test]\nfn t() {"]
