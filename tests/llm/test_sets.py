"""Shingle sets, the n-gram join, decontamination and the line join against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from srcmetrics.llm import lines as ln
from srcmetrics.llm import shingles as sh
from srcmetrics.llm.components import components
from srcmetrics.llm.decontaminate import decontaminated, find_items
from srcmetrics.llm import ngram_join as nj
from srcmetrics.llm.ngram_join import ngram_components

ID_TEXT = "doc_id bigint, text string"


def shingle_set(text, size, pattern=r"[^\x20\x09-\x0D]+"):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(pattern, low)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset({tuple(w)} if w else ())


def groups(rows, linked):
    """Smallest id reachable, over all pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i], rows[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [least[find(i)] for i in range(len(rows))]


@pytest.mark.parametrize("size", [1, 3, 5])
@pytest.mark.parametrize("slice_bytes", [7, 1 << 18])
def test_shingle_hashes_are_sets(monkeypatch, size, slice_bytes):
    monkeypatch.setattr(sh, "SLICE_BYTES", slice_bytes)
    texts = ["", "a", "A b", "a  B c\td", None, "x y z x y z", "é Ü  k", " a b c ", "a b c", "\x0b\x0c"]
    got = []
    for at, end, h, first in sh.shingle_sets(pa.array(texts), size):
        got += [set(h[a:b].tolist()) for a, b in zip(first, first[1:])]
    want = [shingle_set(t, size) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_components(llm):
    edges = [(1, 2), (3, 2), (4, 3), (9, 8), (8, 9), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(components(llm.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} | {100 + i: 100 for i in range(41)}
    assert components(llm.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_few_links_take_few_tasks(llm):
    wanted = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: llm.conf.get(k, None) for k in wanted}
    context = llm.sparkContext
    try:
        for k, v in wanted.items():
            llm.conf.set(k, v)
        context.setJobGroup("few links", "")
        links = llm.createDataFrame([(i, i - i % 50) for i in range(1000)], "a bigint, b bigint").coalesce(1)
        got = dict(components(links).collect())
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            llm.conf.set(k, v) if v is not None else llm.conf.unset(k)
    assert got == {i: i - i % 50 for i in range(1000)}
    known = context.statusTracker()
    stages = {s for j in known.getJobIdsForGroup("few links") for s in known.getJobInfo(j).stageIds}
    # stars are known as such: links told apart, counted around each node, and no round
    assert sum(known.getStageInfo(s).numTasks for s in stages if known.getStageInfo(s)) < 5 * 40


def test_rounds_of_few_links_take_few_tasks(llm):
    context = llm.sparkContext
    many = 8 * context.defaultParallelism
    wanted = {"spark.sql.shuffle.partitions": str(many), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: llm.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            llm.conf.set(k, v)
        context.setJobGroup("few links, some rounds", "")
        links = llm.createDataFrame([(i, i + 1) for i in range(30)], "a bigint, b bigint").coalesce(1)
        got = dict(components(links).collect())
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            llm.conf.set(k, v) if v is not None else llm.conf.unset(k)
    assert got == dict.fromkeys(range(31), 0)
    known = context.statusTracker()
    stages = {s for j in known.getJobIdsForGroup("few links, some rounds") for s in known.getJobInfo(j).stageIds}
    # only the given links, whose number is not known as yet, are told apart in all partitions
    assert sum(known.getStageInfo(s).numTasks == many for s in stages if known.getStageInfo(s)) <= 2


def near_copies():
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(60):  # one large group, linked in part only through others
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(100 + i, passage + " " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(25))) for i in range(40)]
    rows += [(200 + i, rows[i][1].upper()) for i in range(5)]
    return rows


@pytest.mark.parametrize(("size", "pct"), [(3, 90), (5, 80)])
def test_ngram_join_finds_every_link(llm, size, pct):
    rows = near_copies()
    sets = {i: shingle_set(t, size) for i, t in rows}

    def linked(a, b):
        x, y = sets[a[0]], sets[b[0]]
        return bool(x) and 100 * len(x & y) >= pct * len(x | y)

    got = {r.doc_id: r.component_id for r in ngram_components(llm.createDataFrame(rows, ID_TEXT), size, pct).collect()}
    assert [got[i] for i, _ in rows] == groups(rows, linked)


def test_ngram_join_edges(edges, nothing):
    got = collections.Counter(map(tuple, ngram_components(edges, 3, 90).collect()))
    assert got[(1, 11, 1)] == 1 and got[(2, 11, 1)] == 2  # equal texts, a repeated row
    assert got[(3, 0, 3)] == got[(4, 0, 4)] == got[(5, 0, 5)] == 1  # no words: linked with nothing
    assert got[(7, 3, 7)] == got[(8, 3, 7)] == 1  # long texts
    assert got[(9, 1, 9)] == 1
    assert got[(None, 3, None)] == got[(None, 0, None)] == 1
    assert sum(got.values()) == edges.count()
    assert ngram_components(nothing, 3, 90).count() == 0


def test_items_found_by_containment(llm):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 6, 9, 20, 50, 130])))) for i in range(40)]
    rows = []
    for d in range(120):
        words = [word() for _ in range(rng.randrange(0, 1500))]
        if d % 2:
            leak = items[rng.randrange(40)][1].split()
            if d % 4 == 1 and len(leak) > 40:
                leak[20] = "CHANGED"
            words[len(words) // 2 : len(words) // 2] = ", ".join(leak).upper().split()
        rows.append((d, " ".join(words)))
    plain = "[0-9a-z\x80-\U0010ffff]+"
    want = set()
    for d, text in rows:
        have = shingle_set(text, 5, plain)
        for i, item in items:
            s = shingle_set(item, 5, plain)
            if s and len(s & have) >= 0.8 * len(s):
                want.add((d, i, len(s), len(s & have)))
    got = set(map(tuple, find_items(llm.createDataFrame(rows, ID_TEXT), llm.createDataFrame(items, "item_id bigint, text string")).collect()))
    assert len(want) > 20
    assert got <= want
    assert len(got) >= 0.9 * len(want)


def test_items_edges(llm, edges, nothing, monkeypatch):
    from srcmetrics.llm import decontaminate as dc

    items = [(1, "quick brown fox jumps over the lazy"), (2, None), (3, ""), (4, "One!"), (None, "no id here at all"), (4, "one")]
    table = llm.createDataFrame(items, "item_id bigint, text string")
    want = {(1, 1), (2, 1), (9, 4), (None, None)}
    assert {(r.doc_id, r.item_id) for r in find_items(edges, table).collect()} == want
    monkeypatch.setattr(dc, "BLOCK_BYTES", 100)  # several passes
    assert {(r.doc_id, r.item_id) for r in find_items(edges, table).collect()} == want
    kept = decontaminated(edges, table)
    assert kept.columns == edges.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {3, 4, 5, 6, 7, 8, 10, None}
    assert find_items(nothing, table).count() == 0
    assert find_items(edges, table.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, k):
    out = list(line)
    for _ in range(k):
        i = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        if kind == 0 or i == len(out):
            out.insert(i, rng.choice("abcé"))
        elif kind == 1:
            out[i] = rng.choice("abcé")
        else:
            del out[i]
    return "".join(out)


@pytest.mark.parametrize("most", [1, 2, 4])
def test_banded_distance(most):
    rng = random.Random(most)
    a = ["".join(rng.choice("abé") for _ in range(rng.randrange(12))) for _ in range(1500)]
    b = [edited(rng, x, rng.randrange(6)) for x in a]
    want = np.array([distance(x, y) <= most for x, y in zip(a, b)])
    assert (ln.within_threshold(a, b, most) == want).all()


def test_rows_without_an_id_link_others(llm):
    words = [f"w{k}" for k in range(60)]
    a, b, c = words, words[:-1] + ["x"], words[2:-1] + ["x", "y"]
    kind = "doc_id bigint, text string"
    rows = [(1, " ".join(a)), (None, " ".join(b)), (3, " ".join(c)), (None, " ".join(b)), (9, "quite another text")]
    got = {(r.doc_id, r.component_id) for r in nj.ngram_components(llm.createDataFrame(rows, kind), 3, 90).collect()}
    assert got == {(1, 1), (None, 1), (3, 1), (9, 9)}
    only = [(None, " ".join(a)), (None, " ".join(b))]
    assert {r.component_id for r in nj.ngram_components(llm.createDataFrame(only, kind), 3, 90).collect()} == {None}


def test_blocks_cut_only_fragments_they_have():
    h = np.array([5, 1 << 40, (1 << 40) + 7, 1 << 63], np.uint64)
    docs = np.zeros(2, nj._DOC)
    for bits in (0, 3, 30):
        batches = list(nj._cut(bits, 0, docs.copy(), [h[:3], h[1:]], [np.zeros(3, int), np.ones(3, int)]))
        rows = [r for x in batches for r in x.to_pylist()][1:]
        assert len(batches) == 2 and len(rows) <= 4
        found = []
        for r in rows:
            own = np.frombuffer(r["docs"], "<u2")
            steps = np.frombuffer(r["ngrams"], "<u4" if len(r["ngrams"]) == 4 * len(own) else "<u8")
            found += [((r["frag"] << (48 - bits)) + int(x), int(o)) for x, o in zip(np.cumsum(steps, dtype=np.uint64), own)]
        assert found == [(5 >> 16, 0), (1 << 24, nj._SEVERAL), ((1 << 24), nj._SEVERAL), (1 << 47, 1)]


def test_line_join_finds_every_link(llm):
    rng = random.Random(9)
    lines = ["".join(rng.choice("abcdefg h") for _ in range(rng.randrange(20, 70))).strip() for _ in range(60)]
    lines += [edited(rng, rng.choice(lines), rng.randrange(4)) for _ in range(90)]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))) for d in range(70)]
    flat = sorted((d, k, x) for d, t in rows for k, x in enumerate(t.split("\n"), 1) if x)
    texts = sorted({x for *_, x in flat})
    named = [((next((d, k) for d, k, y in flat if y == x)), x) for x in texts]
    near = lambda a, b: min(len(a[1]), len(b[1])) >= 24 and distance(a[1], b[1]) <= 2
    first = dict(zip(texts, groups(named, near)))
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.keep) for r in ln.dedup_lines(llm.createDataFrame(rows, ID_TEXT)).collect()}
    assert got == {(d, k): (*first[x], first[x] == (d, k)) for d, k, x in flat}


def test_only_shared_keys_of_lines_are_kept(llm, monkeypatch):
    """A line's keys that no other line has are never made into rows."""
    seen = []
    monkeypatch.setattr(ln, "linked_components", lambda keys, *a, **b: seen.append(keys) or ln.stored(keys.select("node", F.col("node").alias("root")).limit(0)))
    rng = random.Random(5)
    alone = ["".join(rng.choice("abcdefghij klm") for _ in range(400)) for _ in range(6)]
    passage = "one passage of more than forty characters that two of the lines have"
    texts = [*alone, alone[0][:200] + passage + alone[1][:200], alone[2][:200] + passage + alone[3][:200]]
    table = llm.createDataFrame([(x,) for x in texts], "line string").withColumn("node", F.xxhash64("line"))
    ln.near_lines(table.unionByName(table).repartition(3))
    (keys,) = seen
    held = collections.Counter(r.key for r in keys.select("key", "node").distinct().collect())
    assert held and min(held.values()) > 1
    assert keys.select("node").distinct().count() == 6


def test_line_join_edges(edges, nothing):
    got = collections.Counter(map(tuple, ln.dedup_lines(edges).collect()))
    assert got[(1, 1, 1, 1, True)] == 1 and got[(2, 1, 1, 1, False)] == 2
    assert got[(7, 1, 7, 1, True)] == 1 and got[(8, 1, 7, 1, False)] == 1
    assert got[(10, 2, 10, 2, True)] == 1  # short lines are copies only if equal
    assert not any(r[0] in (3, 4) for r in got)
    assert ln.dedup_lines(nothing).count() == 0


def test_line_threshold_grows_with_the_line(llm):
    assert [int(ln.threshold(n)) for n in (24, 77, 78, 216, 1068)] == [2, 2, 3, 16, 102]
    rng = random.Random(12)
    lines = []
    for n in (78, 90, 121, 122, 150, 216, 380, 700, 1500):  # both sides of the segments' end and of the band
        for _ in range(4):
            x = "".join(rng.choice("abcdefgh ") for _ in range(n - 2)) + "."
            most, at = int(ln.threshold(n - 1)), rng.randrange(n // 4)
            lines += [x, x[:at] + "Z" * most + x[at + most :], x[: n // 2] + "Q" * (most - 1) + x[n // 2 :], edited(rng, x, 2), x[:at] + "Y" * (2 * most + 4) + x[at + 2 * most + 4 :]]
    rng.shuffle(lines)
    rows = [((0, k), x) for k, x in enumerate(lines, 1)]
    near = lambda a, b: distance(a[1], b[1]) <= ln.threshold(min(len(a[1]), len(b[1]))) if abs(len(a[1]) - len(b[1])) < 160 else False
    by = collections.defaultdict(list)
    for r in rows:  # lines of other groups have nothing in common: only each group by brute force
        by[min(range(9), key=lambda k: abs(len(r[1]) - 1.07 * (78, 90, 121, 122, 150, 216, 380, 700, 1500)[k]))].append(r)
    got = {r.line_no: r.first_line_no for r in ln.dedup_lines(llm.createDataFrame([(0, "\n".join(lines))], ID_TEXT)).collect()}
    for part in ([x for k in range(5) for x in by[k]], by[5], by[6]):
        assert [got[k] for (_, k), _ in part] == [first for _, first in groups(part, near)]
    assert len(set(got.values())) < len(lines) / 2


def test_any_number_of_edits():
    rng = random.Random(13)
    a = ["".join(rng.choice("abé") for _ in range(rng.randrange(90))) for _ in range(300)]
    b = [edited(rng, x, rng.randrange(30)) for x in a]
    assert [ln.edit_distance(x, y) for x, y in zip(a, b)] == [distance(x, y) for x, y in zip(a, b)]
    want = [distance(x, y) <= ln.threshold(min(len(x), len(y))) for x, y in zip(a, b)]
    assert ln.near(a, b).tolist() == want


@pytest.mark.parametrize("top,most", [(90, 40), (200, 70), (330, 150)])
def test_bands_of_several_words(top, most, monkeypatch):
    """Each pair has its own number of edits, and bands are wider than one word."""
    rng = random.Random(top)
    a = ["".join(rng.choice("abé\U0001f600") for _ in range(rng.randrange(top))) for _ in range(80)]
    b = [edited(rng, x, rng.randrange(most)) if rng.random() < 0.9 else x[: top // 3] for x in a]
    have = np.array([distance(x, y) for x, y in zip(a, b)])
    limits = np.array([rng.randrange(most) for _ in a])
    assert (ln.within_threshold(a, b, limits) == (have <= limits)).all()
    assert all((ln.edit_distance(x, y, int(k)) <= k) == (d <= k) for x, y, d, k in zip(a, b, have, limits))
    told = ln.within_threshold(a, b, limits, 20)
    assert told[have <= limits].all() and not told.all()
    monkeypatch.setattr(ln, "MASK_BYTES", 5000)  # a few pairs at once
    assert (ln.within_threshold(a, b, limits) == (have <= limits)).all()


def test_heads_tell_lines_apart(monkeypatch):
    """Long lines in batches, of which some have nothing in common, as their whole lines tell."""
    rng = random.Random(8)
    a = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300, 420))) for _ in range(90)]
    b = [x if k % 3 else y for k, (x, y) in enumerate(zip(a, a[1:] + a[:1]))]
    b = [edited(rng, x, rng.randrange(45)) for x in b]
    heads = []
    monkeypatch.setattr(ln, "within_threshold", lambda x, y, most, head=None, real=ln.within_threshold: heads.append(head) or real(x, y, most, head))
    assert ln.near(a, b).tolist() == [distance(x, y) <= ln.threshold(min(len(x), len(y))) for x, y in zip(a, b)]
    assert any(heads)


def test_rows_of_a_key_meet_once(monkeypatch):
    """Pivots meet all rows of their key, then the others each other, wherever batches end."""
    from srcmetrics.llm import linking

    monkeypatch.setattr(linking, "GROUP_ROWS", 5)
    monkeypatch.setattr(linking, "GROUP_PAIRS", 7)
    rng = random.Random(21)
    rows = sorted({(rng.randrange(12) ** 2 // 12, rng.randrange(60)) for _ in range(160)})
    root = lambda node: node // 3
    index = lambda key, node: (key + node) % 3 > 0
    near = lambda x, y: np.abs(x("v") - y("v")) <= 40
    names = ["key", "node", "v", "index"]

    def meet(rows, pivots):
        table = pa.table({
            "key": [k for k, _ in rows], "node": [n for _, n in rows], "v": [n * 7 % 61 for _, n in rows],
            "index": [index(k, n) for k, n in rows], "root": [root(n) for _, n in rows],
        })
        found = [r for x in linking._meet(names, near, pivots)(iter(table.to_batches(max_chunksize=3))) for r in x.to_pylist()]
        return [(r["node"], r["other"]) for r in found if r["other"] is not None], [(r["key"], r["node"]) for r in found if r["other"] is None]

    want = collections.Counter()
    for k, n in rows:
        for j, m in rows:
            if k == j and n < m and root(n) != root(m) and (index(k, n) or index(k, m)) and abs(n * 7 % 61 - m * 7 % 61) <= 40:
                want[n, m] += 1
    first, rest = meet(rows, 2)
    second, left = meet(sorted(rest), 2)
    last, nothing = meet(sorted(left), None)
    assert not nothing and len(left) < len(rest) < len(rows)
    assert set(first) | set(second) | set(last) == set(want)
    assert len(first) + len(second) + len(last) <= sum(want.values())


def test_pairs_of_lines_are_verified_once(llm, monkeypatch):
    """Lines that share a passage and are not near are held against each other one time."""
    seen = []
    monkeypatch.setattr(ln, "stored", lambda df, real=ln.stored: seen.append(real(df)) or seen[-1])
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(120) + "."
    texts = [text(60) + "<" + passage + ">" + text(60) for _ in range(40)]
    assert ln.near_lines(llm.createDataFrame([(x,) for x in texts], "line string").withColumn("node", F.xxhash64("line"))).count() == 0
    tried = [x for x in seen if x.columns == ["a", "b"]][::2]
    pairs = collections.Counter(tuple(r) for x in tried for r in x.collect())
    assert len(pairs) > 300 and max(pairs.values()) == 1
