import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from srcmetrics.functions import paths as p
from srcmetrics.functions.text import decode_text
from srcmetrics.operators import detect, lines, select
from srcmetrics.operators.structure import mask_source, scan_status
from srcmetrics.options import OffenderLimits, ScanOptions

BLANK_POINTS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
VISIBLE_POINTS = [0x200B, 0xFEFF, 0xFFFD, 0x1C, 0x1F, 0x180E]


def paths_of(df):
    return {r.path for r in df.collect()}


def test_every_white_space_point_is_blank_and_lookalikes_are_not(files):
    assert len(BLANK_POINTS) == 25
    rows = [(f"b{c}", chr(c)) for c in BLANK_POINTS] + [(f"v{c}", chr(c)) for c in VISIBLE_POINTS]
    for r in lines.file_loc(files(*rows)).collect():
        assert r.total_loc == (1 if r.path.startswith("v") else 0), r.path


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a\r\n\r\nb", ["a", "", "b"]),
        ("a\n", ["a"]),
        ("", []),
        ("a\rb", ["a\rb"]),
        ("a\u2028b", ["a\u2028b"]),
        ("\n\n", ["", ""]),
        ("a\r\r\n", ["a\r"]),
    ],
)
def test_line_splitting(files, text, expected):
    got = [r.line for r in lines.lines(files(("x", text))).orderBy("line_no").collect()]
    assert got == expected


def test_file_loc_agrees_with_lines(files):
    table = files(("x", "a\r\n\r\nb"), ("y", ""), ("z", " \n\t\nq\n\u3000"), ("w", "one"))
    loc = {r.path: r.total_loc for r in lines.file_loc(table).collect()}
    counted = lines.lines(table).filter("nonblank").groupBy("path").count().collect()
    assert loc == {"x": 2, "y": 0, "z": 1, "w": 1}
    assert {r.path: r["count"] for r in counted} == {k: v for k, v in loc.items() if v}


def test_invalid_bytes_become_replacement_characters(spark):
    df = spark.createDataFrame([(bytearray(b"\x61\xff\x62"),), (bytearray("é".encode()),)], "b binary")
    assert [r[0] for r in df.select(decode_text(F.col("b"))).collect()] == ["a\ufffdb", "é"]


def test_span_loc_clamps_and_drops(spark, files):
    rows = lines.lines(files(("x", "a\n\n b\nc\n")))
    spans = spark.createDataFrame(
        [("r", 1, "all", 1, 4), ("r", 1, "past", 3, 99), ("r", 1, "blank", 2, 2), ("r", 1, "inverted", 4, 1),
         ("r", 1, "beyond", 9, 12), ("r", 1, "zero", 0, 2), ("r", 1, "one", 1, 2), ("r", 1, "one", 1, 2)],
        "root string, file_id bigint, name string, start_line int, end_line int",
    )
    got = sorted((r.name, r.loc) for r in lines.span_loc(spans, rows).collect())
    assert got == [("all", 3), ("one", 1), ("one", 1), ("past", 2)]


def test_language_needs_a_stem_and_ignores_case(files):
    table = select.with_language(files(("x.RS", ""), (".rs", ""), ("x.rs.txt", ""), ("a.b/.cs", ""), ("q/Y.Cs", "")))
    got = {r.path: r.language for r in table.collect()}
    assert got == {"x.RS": "rust", ".rs": None, "x.rs.txt": None, "a.b/.cs": None, "q/Y.Cs": "csharp"}


def test_generated_paths(files):
    generated = ["Obj/x.cs", "a/BIN/x.cs", "x.Designer.CS", "AssemblyInfo.cs", "a/SolutionInfo.cs", "q.g.i.cs", "q.razor.g.cs",
                 "My.AssemblyInfo.cs", "p.generated.cs", "TemporaryGeneratedFile_7.cs"]
    kept = ["object/x.cs", "Designer.cs", "obj/x.rs", "xTemporaryGeneratedFile_.cs", "g.cs"]
    table = select.with_language(files(*[(x, "") for x in generated + kept]))
    assert paths_of(select.generated_filter(table)) == set(kept)


def test_prefixes_cover_whole_components(files, monkeypatch):
    table = files(("src/a", ""), ("src2/a", ""), ("src.old/a", ""), ("lib/src/a", ""), ("q/w/e", ""))
    few = ["src", " q/w/ ", "", "./lib", "/src2"]
    expected = {"src2/a", "src.old/a", "lib/src/a"}
    assert paths_of(select.exclude_prefixes(table, few)) == expected
    many = few + [f"none{i}" for i in range(60)]
    assert paths_of(select.exclude_prefixes(table, many)) == expected


def test_exclusion_wins_and_patterns_search(files):
    table = files(("src/a.rs", ""), ("src/b.rs", ""), ("bench/b.rs", ""), ("bench/é.rs", ""))
    both = ScanOptions(include_regex=("src", "é"), exclude_regex=("b\\.rs$",))
    assert paths_of(select.select_files(table, both)) == {"src/a.rs", "bench/é.rs"}
    same = ScanOptions(include_regex=("src",), exclude_regex=("src",))
    assert paths_of(select.select_files(table, same)) == set()
    assert paths_of(select.select_files(table, ScanOptions(include_regex=(r"^bench/\w\.rs$",)))) == {"bench/b.rs", "bench/é.rs"}


def test_root_label(spark):
    df = spark.createDataFrame([("/a/b/repo/",), ("s3://bucket/x",), ("/",)], "u string")
    assert [r[0] for r in df.select(p.root_label(F.col("u"))).collect()] == ["repo", "x", "/"]


DETECTION = [
    ("sole", "Cargo.toml", "rust"),
    ("dotnet", "App.SLN", "csharp"),
    ("both", "Cargo.toml", "rust"), ("both", "a.csproj", None), ("both", "a.rs", None), ("both", "b.rs", None), ("both", "c.cs", None),
    ("even", "Cargo.toml", None), ("even", "a.csproj", None), ("even", "a.rs", None), ("even", "c.cs", None),
    ("none", "readme", None),
    ("below", "sub/Cargo.toml", "csharp"), ("below", "x.cs", None), ("below", "y.cs", None), ("below", "y.rs", None),
    ("built", "obj/x.cs", "rust"), ("built", "bin/y.cs", None), ("built", "z.rs", None),
]


def test_detection(files):
    table = files(*[(root, path, "") for root, path, _ in DETECTION])
    got = {r.root: (r.language, r.status) for r in detect.detect_language(table).collect()}
    expected = {root: lang for root, _, lang in reversed(DETECTION)}
    assert got == {k: (v, "ok" if v else "ambiguous") for k, v in expected.items()}
    with pytest.raises(PySparkException, match="unable to auto-detect language"):
        detect.detect_language(table, mode="failfast").collect()
    assert {r.language for r in detect.detect_language(table, requested="rust").collect()} == {"rust"}


def test_single_file_detection(files):
    got = {r.path: r.status for r in detect.detect_file(files(("a.rs", ""), ("b.txt", ""))).collect()}
    assert got == {"a.rs": "ok", "b.txt": "unknown"}


def test_options_are_checked(spark):
    for bad in ((0, 5), (5, -1), (True, 3), (2.5, 1)):
        with pytest.raises(ValueError):
            OffenderLimits(*bad)
    with pytest.raises(TypeError):
        OffenderLimits(5)
    with pytest.raises(ValueError, match="language"):
        ScanOptions(language="go")
    assert ScanOptions(language="auto").language is None
    assert ScanOptions(exclude=(" a ", "  ")).exclude == ("a",)
    with pytest.raises(ValueError, match=r"invalid exclude-path regex: \(x"):
        ScanOptions(exclude_regex=("(x",)).check_patterns(spark)
    assert ScanOptions(include_regex=("a{1,3}",)).check_patterns(spark)


def test_masking_keeps_length_and_lines(files):
    rust = 'a /* x /* y */ "z */ b // "\nr#"q " "# c \'{\' \'a "s\\"}" r"\\" d\nb"\n" e'
    masked = mask_source(files(("x.rs", rust)), "rust").first().masked
    assert len(masked) == len(rust) and masked.count("\n") == rust.count("\n")
    assert masked.split() == ["a", "b", "r", "c", "'a", "r", "d", "b", "e"]
    csharp = '#region " {\nx @"a""b\\" $"{q("z")} }}" """r " """ \'\\\'\' y // {'
    masked = mask_source(files(("x.cs", csharp)), "csharp").first().masked
    assert len(masked) == len(csharp) and masked.split() == ["x", "y"]


def test_scan_status(files):
    table = files(("ok.rs", 'fn a() { "}" }'), ("open.rs", "fn a() { {"), ("close.rs", "} {"), ("empty.rs", ""))
    got = {r.path: r.status for r in scan_status(table, "rust").collect()}
    assert got == {"ok.rs": "ok", "open.rs": "unbalanced", "close.rs": "unbalanced", "empty.rs": "ok"}
    with pytest.raises(PySparkException, match="unable to parse"):
        scan_status(table, "rust", mode="failfast").collect()


def test_long_and_unterminated_literals(files):
    long_text = 'fn a() { let x = "' + "y\\\"{" * 100_000 + '"; }\n'
    table = files(("long.rs", long_text), ("open.rs", 'fn a() {}\nconst S: &str = "' + "{" * 50_000), ("comment.rs", "/*" * 2000))
    got = {r.path: r.status for r in scan_status(table, "rust").collect()}
    assert got == {"long.rs": "ok", "open.rs": "unterminated", "comment.rs": "unterminated"}


def test_visible_lines_are_searched_only_where_lines_are_blank(spark):
    """Counts agree with a plain reading for all kinds of white space."""
    from srcmetrics.functions.text import visible_line_starts

    texts = ["", "a", "\na", "\n\n", "\n 　\na\n", "\nb\r\n\tc", "x\n\x0b", "\n b\n c\n\nd", "\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", visible_line_starts(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == [sum(1 for line in t.split("\n")[1:] if line.strip()) for t in texts]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan
