"""Each stage of the pipeline, and all of them in turn, against plain Python."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from srcmetrics.llm import langid
from srcmetrics.llm.mixing import mix_sources, word_count

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = {
    "en": "the of and to in that house water light stone river people because nothing under",
    "de": "der die und das nicht haus wasser licht stein fluss leute weil nichts unter zwischen",
    "fr": "le la et les dans maison eau lumière pierre rivière gens parce rien sous entre",
}
ITEM = "seven silver spoons were found beneath the old mill during that very wet autumn"


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n=5):
    words = plain_words(text)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def rows_of(docs):
    return sorted(map(tuple, docs.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    rows = []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        words = WORDS[lang].split()
        text = " ".join(f"{rng.choice(words)}{rng.choice(['', 's', 'e', 'n'])}" for _ in range(rng.randrange(20, 90)))
        rows.append((i, text, lang if i % 5 else None, rng.choice(["a", "b", None]), len(text)))
    for k in range(25):  # near copies, of which some have no id
        old = rows[k * 7][1].split()
        old[rng.randrange(len(old))] = "changed"
        rows.append((1000 + k if k % 4 else None, " ".join(old), None, "b", 1))
    rows += [rows[3], rows[3], (rows[4][0], "another text of the same id " + rows[8][1], "en", "a", 1)]
    rows += [(2000 + k, f"{rows[20 + k][1]} {ITEM} {rows[30 + k][1]}", None, "a", 1) for k in range(4)]
    rows += [(None, f"{rows[40][1]} {ITEM}", "fr", "c", 1), (3000, None, None, None, None), (3001, "12 34 !?", "en", "a", 8), (None, "", None, "a", 0)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def table(llm, corpus):
    return llm.createDataFrame([(*r, "x") for r in corpus], KIND + ", size string").repartition(4)


@pytest.fixture
def folder(llm, tmp_path, table):
    items = llm.createDataFrame([(1, ITEM), (2, None), (3, "quite another passage that nobody ever wrote down here")], "item_id bigint, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def empty(llm):
    return llm.createDataFrame([], KIND)


def test_language(llm, table, folder):
    got = cp.identify_language(llm, table, folder)
    assert got.columns == table.columns
    model = langid.train(table)
    scored = langid.predict(table.select(F.monotonically_increasing_id().alias("doc_id"), "text"), model)
    good = scored.filter(f"lang_pred <> 'und' AND score >= {cp.LEAST_SCORE}").count()
    assert got.count() == good
    texts = {r.text for r in got.collect()}
    assert None not in texts and "12 34 !?" not in texts and "" not in texts
    kept = sum(1 for r in table.collect() if r.text in texts)
    assert kept >= 0.98 * sum(1 for r in table.collect() if r.text and re.search("[a-z]", r.text))  # clean ones stay


def near_groups(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r)
    return list(groups.values())


def test_near_copies(llm, table, folder):
    got = cp.drop_near_copies(llm, table, folder)
    assert got.columns == table.columns
    left = rows_of(got)
    groups = near_groups([tuple(r) for r in table.collect()])
    assert len(left) == len(groups)
    assert sum(len(g) > 1 for g in groups) > 15
    for g in groups:
        ids = [r[0] for r in g if r[0] is not None]
        kept = [r for r in g if r in left]
        assert kept and (not ids or min(ids) in [r[0] for r in kept])


def test_decontaminate(llm, table, folder):
    got = cp.drop_benchmark_leaks(llm, table, folder)
    assert rows_of(got) == sorted((tuple(r) for r in table.collect() if ITEM not in (r.text or "")), key=repr)
    assert got.columns == table.columns


def test_mix(llm, table, folder):
    got = cp.mix(llm, table, folder)
    assert got.columns == table.columns
    sizes = table.select(F.xxhash64("doc_id", "text").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    times = collections.defaultdict(int)
    for r in mix_sources(sizes)[0].collect():
        n = (2 * r.taken + r["size"]) // (2 * r["size"]) if r["size"] else 0
        times[r.doc_id] = max(times[r.doc_id], n)
    keyed = table.withColumn("key", F.xxhash64("doc_id", "text")).collect()
    want = [tuple(r)[:-1] for r in keyed for _ in range(times[r.key])]
    assert rows_of(got) == sorted(want, key=repr)
    assert rows_of(got) == rows_of(cp.mix(llm, table.repartition(7), folder))


def test_shard(llm, table, folder):
    got = cp.shard(llm, table, folder)
    assert got.columns == [*table.columns, "shard"]
    assert rows_of(got.drop("shard")) == rows_of(table)
    sizes = collections.Counter()
    for r in got.collect():
        sizes[r.shard] += len((r.text or "").encode()) + 16
    mean = sum(sizes.values()) / cp.SHARDS
    largest = max(len((r.text or "").encode()) + 16 for r in table.collect())
    assert set(sizes) <= set(range(cp.SHARDS)) and all(abs(n - mean) <= 2 * largest for n in sizes.values())
    ids = [r.doc_id for r in sorted(got.collect(), key=lambda r: (r.shard, r.doc_id is not None, r.doc_id or 0))]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_no_rows(llm, folder):
    for _, stage in cp.STAGES:
        assert stage(llm, empty(llm), folder).count() == 0


def test_run(llm, table, folder, corpus):
    got = cp.run(llm, folder)
    assert got.columns == [*table.columns, "shard"]
    texts = collections.Counter(r.text for r in got.collect())
    assert not any(ITEM in t for t in texts)
    assert all(any(t == r[1] for r in corpus) for t in texts)
    words = collections.Counter()
    for r in got.collect():
        words[r.source] += len(plain_words(r.text))
    kept = [g[0] for g in near_groups([(i, t) for i, t in enumerate(texts)])]
    assert len(kept) == len(texts)  # no near copies are left
    assert got.select("shard").distinct().count() > 20
    assert rows_of(got) == rows_of(cp.run(llm, folder))
