"""Packing, runs of words and conversation repair against brute force."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcmetrics.llm import packing, queries, runs
from srcmetrics.llm.conversations import ASSISTANT, BLANK, DUPLICATE, NOTHING, SOUND, SYSTEM, TRUNCATED, USER, Repair
from srcmetrics.llm.conversations import repair_conversations, summaries

WORDS = b" \t\n\v\f\r"


def check_pieces(rows, ids_of, window):
    """Each id of each document once, sequences without gaps, full but for powers of two."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        data = b"".join(bytes(r.ids) for r in pieces)
        assert data == np.array(ids_of[doc], "<u4").tobytes()
        assert all(len(r.ids) == 4 * r.length and r.length > 0 and r.doc_tokens == len(ids_of[doc]) for r in pieces)
        assert [r.start for r in pieces] == [0, *itertools.accumulate(r.length for r in pieces)][:-1]
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


ODD = [
    "a  b", "a   b", "  a", "a ", "a  ", "\n a", "a \n b", "a\n \nb", "a\n\n b", " ", "  ", "\t \t", "it's 'll x's 've",
    "x<|endoftext|>y", "a <|endoftext|> b", "a\n <|endoftext|>", "é  à b   c", "１２ ²½ x", "\x1c \x1d a \x85 b",
    "日本 語  です", "a​ b", "!! ?? ,", "", "\U0001f600 \U0001f601", "a\r\n b \r\n", "a 　 b", "don't  DON'T 's",
]


def test_ids_are_the_librarys(tokenizer):
    ids_of = packing.TokenIds(queries.vocabulary())
    rng = random.Random(3)
    letters = ["a", "b", " ", " ", "\n", "\t", "1", "!", "'", "s", "é", " ", "\x1c", " "]
    texts = ODD + ["".join(rng.choices(letters, k=rng.randrange(1, 30))) for _ in range(3000)]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids_of(text), ids_of.dtype).tolist() == want, repr(text)


def test_letters_are_the_librarys(tokenizer):
    """What Python takes for letters are one word to the library."""
    for point in range(0x80, 0x110000):
        if 0xD800 <= point < 0xE000 or not chr(point).isalpha():
            continue
        assert len(tokenizer.pre_tokenizer.pre_tokenize_str(f" a{chr(point)}")) == 1, hex(point)


def test_packing(edges, nothing, llm, tokenizer):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choices(["one", "two", "three!", "4", "é"], k=int(rng.expovariate(1 / 40)))) for i in range(800)}
    docs = llm.createDataFrame([(i, t or None, "x") for i, t in texts.items()], "doc_id bigint, text string, ids string").repartition(5)
    packed = packing.pack_documents(docs, queries.vocabulary(), window=128)
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    rows = packed.collect()
    assert check_pieces(rows, want, 128) == 0
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packed.collect()))
    whole = sum(1 for r in rows if r.length == r.doc_tokens)
    assert whole > 0.8 * sum(1 for ids in want.values() if len(ids) < 128)  # few are cut
    # repeated rows and null ids: each row is packed for itself
    got = packing.pack_documents(edges, queries.vocabulary()).collect()
    total = collections.Counter()
    for r in edges.collect():
        total[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    lengths = collections.Counter()
    for r in got:
        lengths[r.doc_id] += r.length
    assert lengths == total
    assert packing.pack_documents(nothing, queries.vocabulary()).count() == 0


def test_one_length_that_fills_nothing(llm):
    """Documents of one length only: no combination fills a window, yet nothing is padded."""
    docs = llm.createDataFrame([(i, "a" + " a" * 70) for i in range(301)], "doc_id bigint, text string")
    rows = packing.pack_documents(docs, queries.vocabulary(), window=128).collect()
    used = collections.Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert sum(used.values()) == 301 * 72
    assert all(n & (n - 1) == 0 for n in used.values())


def test_least_squares():
    rng = np.random.default_rng(2)
    for window in (8, 16, 32):
        counts = rng.integers(0, 50, window + 1)
        counts[0] = counts[window] = 0
        columns = packing.combinations(window, np.flatnonzero(counts))
        want = {
            c for c in itertools.combinations_with_replacement(range(window), 3)
            if sum(c) == window and c[1] and all(k == 0 or counts[k] for k in c)
        }
        assert {tuple(c) for c in columns.tolist()} == want
        x = packing.least_squares(counts, columns)
        uses = np.zeros((window + 1, len(columns)))
        for j, c in enumerate(columns):
            for k in c:
                uses[k, j] += k > 0
        slope = uses.T @ (counts - uses @ x)
        # at the optimum no unused combination helps, and no used one can be bettered
        assert (x >= 0).all() and slope.max() < 0.05 * counts.max()
        assert (np.abs(slope[x > 0.5]) < 0.05 * counts.max()).all()
        plan = packing.plan_windows(counts, window)
        used = np.zeros(window + 1, int)
        for c, n in plan.items():
            assert sum(c) == window and n > 0
            for k in c:
                used[k] += n * (k > 0)
        assert (used <= counts).all()


def brute_runs(t):
    out, n = set(), len(t)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and t[i] == t[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                w = t[s : i + q]
                if not any(w[d:] == w[:-d] for d in range(1, q)):
                    out.add((s, len(w), q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng, size):
    t = []
    while len(t) < size:
        unit = rng.choices("ab", k=rng.randrange(1, 9))
        t += rng.choices("abc", k=rng.randrange(1, 6)) if rng.random() < 0.5 else (unit * 9)[: rng.randrange(1, 9 * len(unit))]
    return t


def test_find_runs():
    rng = random.Random(4)
    for _ in range(150):
        texts = [[w.encode() for w in periodic(rng, rng.randrange(0, 100))] for _ in range(rng.randrange(1, 6))]
        assert runs._runs_of(texts) == [brute_runs(t) for t in texts]


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    values = rng.permutation(100)
    tree = runs.WaveletTree(values, 7)
    low = rng.integers(0, 100, 200)
    high = rng.integers(low, 101)
    bound = rng.integers(0, 101, 200)
    want = [(values[x:y] < z).sum() for x, y, z in zip(low, high, bound, strict=True)]
    assert tree.below(low, high, bound).tolist() == want
    some = high > low
    rank = rng.integers(0, (high - low)[some])
    want = [sorted(values[x:y])[z] for x, y, z in zip(low[some], high[some], rank, strict=True)]
    assert tree.ranked(low[some], high[some], rank).tolist() == want


def crc(text):
    return zlib.crc32(text.encode())


def want_runs(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), crc(str(doc_id)) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None,) * 3
    return (
        doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def write(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_runs_query(llm, edges, nothing, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(periodic(rng, rng.randrange(0, 60)))) for i in range(400)]
    rows += [(r.doc_id, r.text) for r in edges.collect() if r.doc_id not in (7, 8)]
    folder = write(llm.createDataFrame(rows, "doc_id bigint, text string").withColumn("runs", F.lit(1)), tmp_path, "documents")
    got = queries.op12_runs(llm, folder).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((want_runs(*r) for r in rows), key=key)
    assert runs.periodic_runs(nothing).count() == 0
    long = {r.doc_id: r for r in runs.periodic_runs(edges).collect()}[7]
    assert [tuple(r) for r in long.runs] == [(0, 90_000, 3)] and long.collapsed == "word1 word2 word3"


STATES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and rest == "ua" * (len(rest) // 2))


def brute_repair(rows):
    """Cheapest edits of [(initial, fault)] by the least of all (cost, edits), kept for each
    string of output initials reduced to what matters later."""
    best = {"": (0, "")}

    def insert(best):
        for _ in range(2):
            for out, (cost, edits) in list(best.items()):
                for c in "ua":
                    found = (cost + 5, edits + "I")
                    if out[-1:] + c in ("u", "su", "ua", "au") and found < best.get(out + c, (1e9,)):
                        best[out + c] = found
        return best

    for initial, fault in rows:
        new = {}
        for out, (cost, edits) in insert(best).items():
            steps = [(out, cost + 2, "D")]
            if fault not in (BLANK, DUPLICATE):
                more = 5 * (fault == TRUNCATED)
                steps.append((out + initial, cost + more, "K"))
                steps += [(out + c, cost + 1 + more, "R") for c in "ua"]
            for o, c, e in steps:
                if legal(o) or legal(o + "a") or o == "s":
                    new[o] = min(new.get(o, (1e9,)), (c, edits + e))
        best = new
    return min(v for o, v in insert(best).items() if legal(o))


def test_repair_against_all_edits():
    rng = random.Random(9)
    for _ in range(600):
        rows = [(rng.choice("suauax"), rng.choice([SOUND, SOUND, SOUND, TRUNCATED, BLANK, DUPLICATE])) for _ in range(rng.randrange(0, 9))]
        repair, edits = Repair(), b""
        for initial, fault in rows:
            edits += repair.row(STATES.get(initial), fault)
            assert len(repair._nodes) <= 7
        edits = (edits + repair.end()).decode()
        cost, want = brute_repair(rows)
        assert edits == want, rows


def test_repair_keeps_what_is_decided_out_of_memory():
    repair = Repair()
    out = sum(len(repair.row(USER if i % 2 == 0 else ASSISTANT, SOUND)) for i in range(10_000))
    assert out > 9_900 and sum(len(n.edits) for n in repair._nodes) < 100
    # ties that no row decides: a byte an edit and branch, and right to the end
    repair = Repair()
    out = b"".join(repair.row(USER, SOUND) for _ in range(2001)) + repair.end()
    assert out == b"D" + b"KR" * 1000


def want_repair(conv_id, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    counts, faults, seen, last, illegal = collections.Counter(), [], set(), None, 0
    for _, role, text in rows:
        body = text.encode().rstrip(WORDS).decode()
        fault = BLANK if not body else DUPLICATE if (role, text) in seen else SOUND if body[-1] in ".!?" else TRUNCATED
        seen.add((role, text))
        faults.append(fault)
        counts[fault] += 1
        illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
        last = role[:1]
    cost, audit = brute_repair([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    out, left = [], iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit == "D":
            continue
        other = "assistant" if out and out[-1][0] == "u" else "user"
        out.append(f"{row[1] if edit == 'K' else other}:{row[2] if row else ''}")
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return conv_id, gaps, counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], illegal, cost, audit, digest


def want_op13(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        out = convs.setdefault(conv_id, [])
        h = crc(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}") % 20
        text = "" if h == 1 else text.translate({ord(c): None for c in ".!?"}) if h == 2 else text
        out += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return [want_repair(c, r) for c, r in convs.items()]


def test_repair_query(llm, nothing, tmp_path):
    rng = random.Random(12)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choices(["user", "assistant", "system", "tool", None, "agent"], [8, 8, 3, 1, 1, 1])[0]
            text = rng.choice(["Yes.", "No!\n", "What? ", "and then", "", " \t", None, f"Turn {turn}.", "Ça va ? ", "y.\x1c"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += [(999, 0, "user", "Yes."), (999, 0, "user", "Yes."), (1000, None, None, None)]
    kind = "conv_id bigint, turn bigint, role string, text string"
    table = llm.createDataFrame(rows, kind).withColumns({"pos": F.lit(1), "fault": F.lit("x"), "edit": F.lit(0)})
    folder = write(table.repartition(3), tmp_path, "conversations")
    got = queries.op13_repair(llm, folder).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want_op13(rows), key=key)
    empty = llm.createDataFrame([], kind)
    assert repair_conversations(empty).count() == 0 and summaries(repair_conversations(empty)).count() == 0


def test_one_long_conversation(llm):
    """A conversation of many rows, all in one state's turn, passes in constant memory."""
    rows = llm.range(20_000).selectExpr("7L conv_id", "id turn", "'user' role", "concat('Row ', id, '.') text")
    edits = repair_conversations(rows).select("edit", "role").collect()
    assert "".join(e.edit for e in edits) == "KR" * 10_000
    assert [e.role for e in edits] == ["user", "assistant"] * 10_000


def test_words_that_come_again_are_not_merged_again(monkeypatch):
    import public_tokenizers

    from srcmetrics.llm.packing import TokenIds

    ids_of, merges = TokenIds(public_tokenizers.path("byte_bpe_50k.json")), []
    monkeypatch.setattr(ids_of, "_merged", lambda symbols: merges.append(1) or b"")
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters]
    words = (words + [f"{w}a" for w in words])[:700_000]
    texts = [" ".join(words[i : i + 100_000]) for i in range(0, 700_000, 100_000)]
    for text in texts:
        ids_of(text)
    first = len(merges)
    for text in texts * 2:
        ids_of(text)
    assert len(merges) == first


def test_parts_with_a_line_feed_are_cut_into_words_that_are_kept(tokenizer, monkeypatch):
    import public_tokenizers

    ids_of, cut = packing.TokenIds(public_tokenizers.path("byte_bpe_50k.json")), []
    plain = ids_of._plain
    monkeypatch.setattr(ids_of, "_plain", lambda text: cut.append(text) or plain(text))
    text = "one two.\nThree four,\nÉté five\nsix, seven.\neight."
    assert np.frombuffer(ids_of(text), ids_of.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert cut == ["one"]
    assert set(ids_of._parts) == {"two", "four", "five", "seven"}
    for odd in ("a b.\n c", "a b\n\nc", "a b.\n'sc", "a b \nc", "a b.\n", "a \nb", "a b\nc\nd", "a b1\nc", "a b.\nc1"):
        assert np.frombuffer(ids_of(odd), ids_of.dtype).tolist() == tokenizer.encode(odd, add_special_tokens=False).ids, repr(odd)
