"""Corpora that Spark derives from the given tables. Each covers its whole table
and whole texts, so the work of a query grows with the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcmetrics.operators.skew import shared_folder
from srcmetrics.sources.corpus import from_documents, from_pages, read_corpus, spread, write_tree

FIRST_PARTS = ["src", "src/core", "src2/io", "tests", "obj/Debug", "lib/Bin"]
EXTENSIONS = [".rs", ".cs", ".RS", ".Designer.cs", ".g.cs", ".generated.cs", ".txt", ".cs", ".rs", ".razor", ".md"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(documents(spark, sf_dir).select("doc_id", "source", "text"))


def _pick(number: Column, values: list[str], other: str | None = None) -> Column:
    out = F.lit(other) if other is not None else F.lit(values[-1])
    for i, v in enumerate(values):
        out = F.when(number == i, F.lit(v)).otherwise(out)
    return out


def document_path() -> Column:
    doc = F.col("doc_id")
    return F.concat(
        _pick(doc % 7, FIRST_PARTS, "src.old"), F.lit("/Unit"), doc.cast("string"), _pick(doc % 11, EXTENSIONS)
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under made-up paths."""
    return from_documents(documents(spark, sf_dir), document_path())


def marked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with project files at the top of some roots."""
    number = F.substring("source", 4, 9).cast("int")
    sources = documents(spark, sf_dir).select("source").distinct()

    def marker(every: int, file_id: int, name: str) -> DataFrame:
        return sources.filter(number % every == 0).select(
            F.col("source").alias("root"),
            F.lit(file_id).cast("bigint").alias("file_id"),
            F.lit(name).alias("path"),
            F.lit("").alias("content"),
        )

    return (
        document_files(spark, sf_dir)
        .unionByName(marker(3, -1, "Cargo.toml"))
        .unionByName(marker(4, -2, "App.csproj"))
    )


# Rule files laid into every root: (file id, path, text).
RULE_TEXTS = [
    (-10, ".ignore", "# top\n*.txt\n/src/core/\n*.md\n!Unit*1.md\nobj/\nUnit[[:digit:]][!0-4\\].razor\n*[[]*\n"),
    (-11, "tests/.gitignore", "*.rs\n!*8.rs  \n"),
    (-12, "src.old/.gitignore", "*\n!*.cs\n"),
    (-13, "src.old/.ignore", "!Unit?.rs\nUnit*[02].cs\n"),
]


def ruled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document files with rule files in each root."""
    rules = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).cast("bigint").alias("file_id"), F.lit(p).alias("path"), F.lit(t).alias("content"))
                for i, p, t in RULE_TEXTS
            ]
        )
    )
    per_root = documents(spark, sf_dir).select(F.col("source").alias("root")).distinct().select("root", rules.alias("r"))
    return document_files(spark, sf_dir).unionByName(per_root.select("root", "r.*"))


def read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents written as a tree of files, hidden ones among them, and read back."""
    doc = F.col("doc_id")
    place = _pick(doc % 4, ["a", ".hidden/_b", "c/d/.e", "_f"])
    path = F.concat(place, F.lit("/"), _pick(doc % 3, ["u", ".u", "_u"]), doc.cast("string"), F.lit(".txt"))
    folder = shared_folder(spark)
    write_tree(from_documents(documents(spark, sf_dir), path), folder)
    return read_corpus(spark, [folder])


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def spaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with blank lines, carriage returns and a final line break."""
    files = document_files(spark, sf_dir)
    text = F.replace(F.col("content"), F.lit(". "), F.lit(".\r\n\u00a0\n"))
    return files.withColumn("content", F.concat(text, F.lit("\n")))


def _words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("([A-Za-z]+)"), F.lit(1))


def _listed(line: Column, before: str, after: str, gap: str = "\n") -> Column:
    """One text line per word of ``line``."""
    return F.array_join(F.transform(_words(line), lambda w: F.concat(F.lit(before), w, F.lit(after))), gap)


def _template(text: str, i: Column, **parts: Column) -> Column:
    """``text`` with ``@`` as the line number and ``<name>`` as the given parts."""
    pieces: list[Column] = []
    rest = text
    while rest:
        cut = min((rest.find(t) for t in ("@", *[f"<{n}>" for n in parts]) if t in rest), default=-1)
        if cut < 0:
            pieces.append(F.lit(rest))
            break
        if cut:
            pieces.append(F.lit(rest[:cut]))
        if rest[cut] == "@":
            pieces.append(i.cast("string"))
            rest = rest[cut + 1 :]
        else:
            name = rest[cut + 1 : rest.index(">", cut)]
            pieces.append(parts[name])
            rest = rest[cut + len(name) + 2 :]
    return F.concat(*pieces)


RUST_BLOCKS = [
    "fn f@(a: [u8; 4]) {\n<calls>\nfn inner@() { one() }\n}\n",
    "// plain note\n/// doc { line\n#[test]\nfn t@() {\n<gapped>\n}\n",
    "#[cfg(any(a, all(b, not(any(c, all(d, not([[e]])))))))]\npub struct S@<T> {\n<fields>\n}\n",
    "enum E@ {\n<variants>\n}\n",
    "pub trait T@ {\nfn need(&self);\nconst K: u8;\nfn dflt(&self) {\n<calls>\n}\n}\n",
    "impl<'a, D: <nest>> fmt::Display for W@<'a> {\nconst C: u8 = 1;\nfn show(&self) {\n<gapped>\n}\n}\n",
    "impl W@ {\nfn a(&self) {\n<calls>\n}\n\n#[inline]\nfn b() {}\n}\n",
    "const C@: [&str; 2] = [\n<strings>\n];\npub static G@: u8 = 1;\n",
    "macro_rules! m@ {\n() => { fn hidden() {} };\n}\nfoo! {\nstruct Hidden;\n}\nmod m@ {\n"
    "pub(crate) async unsafe fn g@() {\n<calls>\nlet s = \"}{\\\"{\"; // }\n<comment>\nlet c = '{';\n}\n}\n",
    "extern \"C\" {\nfn ffi(x: u8);\n}\nfn raw@() {\nlet r = r#\"\n<raw>\n\"#;\n}\n",
]


def _blocks(line: Column, i: Column, templates: list[str], parts: dict[str, Column]) -> Column:
    out = F.lit("")
    for k, template in enumerate(templates):
        used = {n: c for n, c in parts.items() if f"<{n}>" in template}
        out = F.when(i % len(templates) == k, _template(template, i, **used)).otherwise(out)
    return out


def _generated(spark: SparkSession, sf_dir: str, head: str, tail: str, templates, parts, suffix: str) -> DataFrame:
    blocks = F.transform(
        F.split("text", "\n", -1), lambda line, i: _blocks(line, i, templates, parts(line))
    )
    text = F.concat(F.lit(head), F.array_join(blocks, "\n"), F.lit(tail))
    path = F.concat(
        _pick(F.col("doc_id") % 3, ["src", "src/core", "src.old"]), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(suffix)
    )
    return from_documents(spread_documents(spark, sf_dir).withColumn("text", text), path)


def rust_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document becomes a Rust definition of known size."""

    def parts(line: Column) -> dict[str, Column]:
        return {
            "calls": _listed(line, "w_", "();"),
            "gapped": _listed(line, "w_", "();", "\n \n"),
            "fields": _listed(line, "w_", ": [u8; 4],"),
            "variants": _listed(line, "W", "(u8),"),
            "strings": _listed(line, '"', '};{",'),
            "raw": _listed(line, "", ' } " {'),
            "nest": F.lit("A<" * 18 + "u8" + ">" * 18),
            "comment": F.lit("/* { " * 18 + "/* } */" + " */" * 18),
        }

    head = "#![allow(dead_code)]\n//! about { this\n\n"
    return _generated(spark, sf_dir, head, "\nfn tail() {}\n", RUST_BLOCKS, parts, ".rs")


CSHARP_BLOCKS = [
    "// note {\n[Serializable]\n#if DEBUG\npublic sealed class C@<T> : Base where T : new()\n{\n"
    "#else\npublic sealed class C@<T> : Other where T : new()\n{\n#endif\n"
    "public int Run(int a = 1, string s = \"}{\")\n{\n<calls>\nint Local@(int x)\n{\nreturn x;\n}\n}\n}\n",
    "public interface I@\n{\nint Need(int x);\nint Dflt(int v)\n{\n<calls>\n}\nstring P { get; }\n}\n",
    "enum E@\n{\n<variants>\n}\n",
    "public delegate int D@<T>(\n<params>\n);\n",
    "class Ev@\n{\npublic event EventHandler? Changed@;\npublic event EventHandler Upd@\n{\nadd\n{\n<gapped>\n}\n"
    "remove { x(); }\n}\n}\n",
    "public record struct R@(int V)\n{\npublic const int Max@ = 3;\n"
    "private static readonly Dictionary<string, int> Map@ = new()\n{\n<entries>\n};\nprivate int _x;\n}\n",
    "public class K@\n{\npublic K@(int x) : base(x)\n{\n<calls>\n}\n~K@() { }\n"
    "public static K@ operator +(K@ a, K@ b) => new(a, b);\npublic static explicit operator int(K@ a)\n{\nreturn 1;\n}\n"
    "public int this[int i] => 1;\npublic string Desc => \"x\";\n}\n",
    "class A@\n{\npublic int P@\n{\nget\n{\n<calls>\n}\nprivate set => x = value;\n}\npublic string this[string k]\n{\n"
    "get { return k; }\n}\npublic int Auto { get; set; } = 1;\npublic int Sw => x switch\n{\n{ A: 1 } => 2,\n};\n}\n",
    "namespace N@\n{\n/* { */\n#region a \" {\nstruct S@\n{\nvoid M@()\n{\nvar s = $\"{a} }}{{\"; // }\n"
    "var v = <at>\"c:\\\"\" {\";\nvar r = \"\"\" { \" \"\"\";\n<gapped>\n}\n}\n#endregion\n}\n",
    "class L@\n{\nvoid IFoo.Ex@() => Go(x =>\n{\n<calls>\n});\nasync Task<List<int>> Gen@<U>(<nest> u) where U : class\n{\n"
    "if (u == null) { return 1; } else { foo(); }\nforeach (var q in u)\n{\nw();\n}\nreturn 1;\n}\n}\n",
]


def csharp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document becomes a C# definition of known size."""

    def parts(line: Column) -> dict[str, Column]:
        return {
            "calls": _listed(line, "w_", "();"),
            "gapped": _listed(line, "w_", "();", "\n\t\n"),
            "variants": _listed(line, "W", " = 1,"),
            "params": _listed(line, "int w_", "", ",\n"),
            "entries": _listed(line, '["', '{"] = 1,'),
            "at": F.lit("@"),
            "nest": F.lit("A<" * 18 + "int" + ">" * 18),
        }

    head = "using System;\n[assembly: Foo(\"{\")]\nnamespace Demo.App;\n\n"
    return _generated(spark, sf_dir, head, "\n", CSHARP_BLOCKS, parts, ".cs")


# Text put at the end of files, by doc_id, and the status that each gives them.
ENDINGS = {
    "rust": [
        ("", "ok"),
        ("}", "unbalanced"),
        ("fn z() { ( } )", "unbalanced"),
        ("/* { ", "unterminated"),
        ('fn z() { let s = "', "unterminated"),
        ("/*" * 18 + " { " + "*/" * 18 + "\nfn z() {}", "ok"),
        ("/*" * 18 + " { " + "*/" * 17 + "\nfn z() {}", "unterminated"),
    ],
    "csharp": [
        ("", "ok"),
        ("}", "unbalanced"),
        ("class Z { void M() { ( } ) }", "unbalanced"),
        ("/* { ", "unterminated"),
        ('class Z { string s = @"', "unterminated"),
        ("#if A\nclass Z {\n#else\nclass Z : B {\n#endif\n}\n", "ok"),
        ("class Z { int[] x = [1, 2); }", "unbalanced"),
    ],
}


def ended_files(files: DataFrame, language: str) -> DataFrame:
    endings = [text for text, _ in ENDINGS[language]]
    return files.withColumn("content", F.concat("content", _pick(F.col("file_id") % len(endings), endings)))


STATEMENT_BLOCKS = [
    "foreach (var x in a)\n{\n<calls>\n}\n",
    "if (a)\n{\n<calls>\n}\nelse\n{\nb();\n}\n",
    "var v@ = new Foo\n{\n<entries>\n};\n",
]


def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document becomes a C# statement at the top of a file."""

    def parts(line: Column) -> dict[str, Column]:
        return {"calls": _listed(line, "w_", "();"), "entries": _listed(line, "w_", " = 1,")}

    head = "using System;\n\nvar a = new[] { 1, 2 };\n"
    tail = "\nConsole.WriteLine(a);\nclass Z { void M() { } }\n"
    return _generated(spark, sf_dir, head, tail, STATEMENT_BLOCKS, parts, ".cs")


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``impl`` block per document, one method per line."""

    def block(line: Column, i: Column) -> Column:
        def when(k: int, text: str) -> Column:
            return F.when(i % 4 == k, F.lit(text)).otherwise(F.lit(""))

        words = _words(line)
        return F.concat(
            when(3, "// plain note\n/// doc { line\n#[test]\n"),
            F.lit("fn f"),
            i.cast("string"),
            F.lit("(a: [u8; 4]) {\n"),
            F.when(i % 4 == 1, F.array_join(words, "\n \n")).otherwise(F.array_join(words, "\n")),
            when(2, '\nlet s = "}{\\"{"; // }\n/* { */'),
            when(0, ";\nfn inner() { one() }"),
            F.lit("\n}\n"),
        )

    text = F.concat(
        F.lit("impl Doc {\n"),
        F.array_join(F.transform(F.split("text", "\n", -1), block), "\n"),
        F.lit("\n}\nfn tail();\n"),
    )
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".rs"))
    return from_documents(spread_documents(spark, sf_dir).withColumn("text", text), path)


def quoted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each line once in a literal and once in a comment."""

    def line_text(line: Column) -> Column:
        words = F.array_join(_words(line), " ")
        return F.concat(F.lit('let s = "{'), words, F.lit('"; // '), words)

    text = F.array_join(F.transform(F.split("text", "\n", -1), line_text), "\n")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".rs"))
    return from_documents(spread_documents(spark, sf_dir).withColumn("text", text), path)
