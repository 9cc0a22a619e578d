"""Mixing, sharding, language, fingerprints, pages, archives and token counts."""

import collections
import gzip
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcmetrics.llm import bpe, fingerprint, html_text, langid, warc
from srcmetrics.llm.fingerprint import compare_versions
from srcmetrics.llm.mixing import mix_sources, source_targets, word_count
from srcmetrics.llm.sharding import shard_documents
from srcmetrics.llm.queries import vocabulary


def test_shards(edges, nothing):
    rows = shard_documents(edges, 4).collect()
    assert len(rows) == edges.count()
    assert collections.Counter(r["size"] for r in rows)[16] == 3  # null or empty text
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r.text_crc32 for r in rows if r.doc_id == 9} == {zlib.crc32(b"one")}
    ids = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert shard_documents(nothing, 4).count() == 0
    assert {r.shard for r in shard_documents(edges, 1).collect()} == {0}


def test_shards_are_near_equal(llm):
    rows = [(i, "x" * (i * 37 % 100)) for i in range(4000)]
    sizes = collections.Counter()
    for r in shard_documents(llm.createDataFrame(rows, "doc_id bigint, text string"), 40).collect():
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and all(abs(s - mean) <= 116 for s in sizes.values())


def test_targets_stop_and_are_shared_anew(llm):
    rows = [(s, n) for s, n in [("a", 10), ("b", 100), ("c", 1000), ("d", 5), (None, 300)]]
    got = {r.source: r.target for r in source_targets(llm.createDataFrame(rows, "source string, size bigint"), (5, 2, 1), 1.5, 2).collect()}
    assert sum(got.values()) == pytest.approx(1.5 * 1415)
    assert got["a"] == 20 and got["d"] == 10 and got["b"] == 200
    assert all(got[s] <= 2 * n for s, n in rows)


def test_mix(llm, edges, nothing):
    rng = random.Random(1)
    rows = [(i, rng.choice("abcde"), rng.randrange(0, 200)) for i in range(3000)]
    table = llm.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    mixed, blocks = mix_sources(table, slots=1 << 12)
    first = sorted(map(tuple, mixed.collect()))
    assert first == sorted(map(tuple, mix_sources(table.repartition(5), slots=1 << 12)[0].collect()))
    taken, target = collections.Counter(), {}
    for r in mixed.collect():
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    block = sum(target.values()) / (1 << 12)
    assert all(abs(taken[s] - t) <= 4 * block for s, t in target.items())
    assert blocks.count() > 4000
    sized = edges.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    got, _ = mix_sources(sized)
    assert got.count() == edges.count()
    assert all(r.taken == 0 for r in got.filter("size = 0").collect())
    assert mix_sources(nothing.select("doc_id", "source", F.lit(0).cast("bigint").alias("size")))[0].count() == 0


def test_mix_is_not_one_plan(llm):
    rows = [(i, "abc"[i % 3], i % 7) for i in range(60)]
    mixed, _ = mix_sources(llm.createDataFrame(rows, "doc_id bigint, source string, size bigint"))
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6  # blocks meet their times, and their parts meet


def test_mix_reaches_tiny_sources_beside_a_hot_one(llm):
    rows = [(i, "hot", 5000) for i in range(2000)]
    tiny = {"a": [1], "b": [2, 1], "c": [40] * 3, "d": [30] * 40, "e": [100] * 60, None: [9]}
    rows += [(10_000 + 100 * k + i, s, n) for k, (s, sizes) in enumerate(tiny.items()) for i, n in enumerate(sizes)]
    table = llm.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    mixed, _ = mix_sources(table, slots=1 << 10)  # a block has 14,655 tokens, a tiny source 1 to 6,000
    taken, target = collections.Counter(), {}
    for r in mixed.collect():
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(taken) == 7 and all(target[s] == 2 * sum(n) for s, n in tiny.items())
    for s in tiny:
        assert taken[s] > 0 and abs(taken[s] - target[s]) <= max(1, 0.01 * target[s])
    assert abs(taken["hot"] - target["hot"]) <= 0.01 * target["hot"]


def test_language_held_out_accuracy(llm):
    words = {
        "en": "the and of to in that with was for on are this from have which".split(),
        "de": "der die und das nicht mit sich auf für ein eine dem ist wird über".split(),
        "fr": "le la les des une est pas que qui dans pour avec sur été être".split(),
    }
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 60))), lang) for i, lang in enumerate(rng.choice(list(words)) for _ in range(600))]
    docs = llm.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.identify_languages(docs).collect()
    lang = {i: x for i, _, x in rows}
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(edges, nothing, monkeypatch):
    got = {(r.doc_id, r.lang_pred, r.held_out) for r in langid.identify_languages(edges).collect()}
    assert {i for i, p, _ in got if p == "und"} == {3, 4, 5, 6, None}
    assert len([1 for i, *_ in got if i is None]) == 2
    model = langid.train(edges)
    kept = langid.keep_identified(edges, model, 0.0)
    assert kept.columns == edges.columns and kept.count() == 8
    whole = {(r.doc_id, round(r.score, 6)) for r in langid.predict(edges, model).collect()}
    monkeypatch.setattr(langid, "PIECE", 50)
    names, score = langid._scored(__import__("pyarrow").array(["The quick brown fox jumps over the lazy dog near the old mill."]), model)
    assert (1, round(float(score[0]), 6)) in whole  # a text in pieces scores as a whole
    assert langid.identify_languages(nothing).count() == 0


def test_fingerprints_against_sets(llm, monkeypatch):
    rng = random.Random(4)
    lines = [f"line {k}" for k in range(300)]
    texts = ["\n".join(rng.sample(lines, rng.choice([0, 1, 2, 5, 9, 40, 150]))) for _ in range(60)] + ["", None, "é\U0001f600x"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in compare_versions(llm.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    down = [t or "" for _, t in sorted(rows, reverse=True)]
    paragraphs = lambda t: {p for p in t.split("\n") if p}

    def near(a, b):
        return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0

    for k, text in enumerate(down):
        r, after = got[len(down) - 1 - k], down[(k + 1) % len(down)]
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.near_edited == pytest.approx(near(paragraphs(text), paragraphs(new)))
        assert r.near_next == pytest.approx(near(paragraphs(text), paragraphs(after)))
    assert len({r.fingerprint for r in got.values()}) == len({frozenset(paragraphs(t)) for t in down})


def test_fingerprint_edges(edges, nothing):
    got = compare_versions(edges).collect()
    assert len(got) == edges.count()
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert all(r.near_next == 1.0 for r in got if r.doc_id in (2,))  # its repeat, then its copy
    assert compare_versions(nothing).count() == 0
    assert compare_versions(edges.filter("doc_id = 9")).first().near_next == 1.0  # its own next


def test_subtracted_tables_peel(llm):
    rows = [(list(range(40)), [*range(3, 40), 77, 78])]
    table = llm.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    cells = fingerprint.subtracted(fingerprint.table(F.col("a"), 8), fingerprint.table(F.col("b"), 8))
    found = table.select(fingerprint.peeled(cells, 8).alias("d")).first().d
    assert sorted(found) == [0, 1, 2, 77, 78]
    whole = fingerprint.peeled(fingerprint.table(F.col("a"), 8), 8)
    assert table.select(whole.alias("d")).first().d is None  # 40 digests in 24 cells


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site work as well as we can for you.</div>
<article><header><h1>My &amp; title</h1></header><p>One&nbsp;  two<br>three <b>four</b>.<p>Short.
<div class="comments"><p>I liked this article very much, and so did all of my many friends.</p></div>
<form>Name <input><button>Go</button></form></article><aside>Read this too, it is long enough to look like text.</aside>
<footer>&copy; me</footer></body></html>"""


def test_main_text(llm):
    tree = html_text.train_tree()
    assert html_text.main_text(PAGE, tree) == "My & title\n\nOne two three four.\n\nShort."
    correct = html_text.classify(tree, np.array([r[:-1] for r in html_text.LABELLED], float)) == np.array([r[-1] for r in html_text.LABELLED])
    assert correct.mean() >= 0.97
    plain = "<body><div><a>A</a> <a>B</a></div><h2>A heading</h2><div>" + "word " * 40 + "</div><div>" + "more " * 30 + "</div>"
    assert html_text.main_text(plain, tree).startswith("A heading\n\nword word")
    cut = ["", "<", "<p", "<p><<b>a<b", "a < b", '<a href="x>y', "<!-- x", "<script>x", "&#0;&bogus;", "</p></p>", "<p/>" * 9]
    rows = [(i, "u", p) for i, p in enumerate([*cut, None, PAGE, "<article>" + "<p>x y</p>" * 20_000])]
    pages = llm.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in html_text.extract_main_text(pages).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert got[len(cut)].text == "" and got[0].text == ""
    assert got[len(rows) - 1].text.count("x y") == 20_000  # nothing is dropped
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


WORDY = " ".join(f"word{k}" for k in range(30))
PAGES = {
    "class of an article": (f"<nav><a>x</a></nav><article class='post has-sidebar'><p>{WORDY}</p></article>", WORDY),
    "denied": (f"<div class='content no-ads'><p>{WORDY}</p></div>", WORDY),
    "id of main": (f"<main id='search-results-guide'><p>{WORDY}</p></main>", WORDY),
    "form around": (f"<form id=page><div class=menu><a>a</a></div><article><p>{WORDY}</p></article><label>x</label></form>", WORDY),
    "wrapper around": (f"<div class='sidebar-page widget'><article><p>{WORDY}</p></article></div>", WORDY),
    "section of an article": (f"<article><p>{WORDY}</p><section class='related-work'><p>{WORDY} too</p></section></article>", f"{WORDY}\n\n{WORDY} too"),
    "links after it": (f"<article><p>{WORDY}</p><div class='related'><a href=x>One</a></div><div class=related><a>Two</a></div></article>", WORDY),
    "inline advert": (f"<article><p>{WORDY} <span class='ad'>Buy <b>now</b> <span>cheap</span></span>and so on.</p></article>", f"{WORDY} and so on."),
    "links around blocks": ("<div>" + "".join(f"<a href=/{k}><h3>Some title {k}</h3><p>A teaser of a text {k}</p></a>" for k in range(6)) + "</div>", ""),
    "only a little": ("<h1>A heading</h1><p>One short line.</p>", "A heading\n\nOne short line."),
    "comments": (f"<article><p>{WORDY}</p></article><section id=comments><article class='comment'><p>{WORDY} indeed</p></article></section>", WORDY),
    "comment list": (f"<article><p>{WORDY}</p><ol class='comment-list'><li>{WORDY} indeed</li></ol></article>", WORDY),
    "own header": (f"<article><header><h1>Title here</h1></header><p>{WORDY}</p><footer>End</footer></article>", f"Title here\n\n{WORDY}"),
    "open link": (f"<article><p><a href=x>see</p><p>{WORDY}</p></article>", WORDY),
    "open advert": (f"<article><p>Text <span class=ad>buy</p><p>{WORDY}</p></article>", f"Text\n\n{WORDY}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert html_text.main_text(f"<html><body>{page}</body></html>", html_text.train_tree()) == want


def test_deep_pages_take_linear_time():
    import time

    def took(depth):
        start = time.process_time()
        html_text.blocks("<div>" * depth + "x" + "</div>" * depth)
        return time.process_time() - start

    took(1000)
    assert took(40_000) < 20 * took(8000)


def test_extra_columns_of_pages(llm):
    rows = [(1, "u", f"<article>{WORDY}</article>", "x", 5), (1, "u", None, None, None), (None, None, "", "y", 1)]
    pages = llm.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_main_text(pages).collect()]
    assert sorted(got, key=repr) == sorted([(1, "u", WORDY, len(WORDY)), (1, "u", "", 0), (None, None, "", 0)], key=repr)


def test_archives_round_trip(llm):
    big = "é" * 600
    rows = [
        (1, "http://a", big), (2, "http://b c\n", big), (7, None, big), (7, "again", big), (None, "no id", big),
        (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (8, "u", "y" * 300_000), (9, "u", "<p>\r\n\r\n</p>"),
    ]
    pages = llm.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    folder, index = warc.write_archives(pages)
    got = warc.read_records(folder, index).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(h or "" for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(text.encode())
        assert r.payload_digest == hashlib.sha1(text.encode()).hexdigest()
        revisit = r.page_id in (1, 2, None)
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (7 if revisit else None)
        assert r.payload == (None if revisit else text)
    one = index.filter("page_id = 8")
    assert [r.page_id for r in warc.read_records(folder, one).collect()] == [8]
    assert warc.read_records(*warc.write_archives(pages.limit(0))).count() == 0


def test_reads_of_near_records_are_joined():
    rows = [(0, 10), (10, 5), (15 + warc.GAP_BYTES, 5), (30 + 3 * warc.GAP_BYTES, 7), (9 * warc.SPAN_BYTES, 2 * warc.SPAN_BYTES)]
    got = list(warc._ranges(rows[::-1]))
    assert [(b, e) for b, e, _ in got] == [(0, 20 + warc.GAP_BYTES), (30 + 3 * warc.GAP_BYTES, 37 + 3 * warc.GAP_BYTES), (9 * warc.SPAN_BYTES, 11 * warc.SPAN_BYTES)]
    assert sorted(x for *_, held in got for x in held) == sorted(rows)


def test_damaged_record_raises(llm):
    with pytest.raises(ValueError, match="length"):
        warc.parse_record(gzip.decompress(gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")))


def test_token_counts_are_the_librarys(llm, edges):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    counter = bpe.Counter(vocabulary())
    rng = random.Random(6)
    odd = "aaaaabbb  \n\t é  \x1c\x85'll's 12٣ẞ😀中文ñ<|endoftext|>%%%***"
    texts = ["", " ", "a" * 5000, "ab" * 3000, " " * 3000, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext", "don't I'LL"]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [chr(c) + "a" + chr(c) + "1 " + chr(c) * 2 for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    for text in texts:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    got = edges.select("text", bpe.token_count(F.col("text"), vocabulary()).alias("n")).collect()
    assert all(r.n == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in got)


def test_words_of_long_texts_are_counted_one_by_one(monkeypatch):
    counter = bpe.Counter(vocabulary())
    text = "The quick brown fox, don't jump.  " * 50
    whole = counter.count(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    counter._counts.clear()
    assert counter.count(text) == whole
