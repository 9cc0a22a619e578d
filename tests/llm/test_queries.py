"""The registered queries over the smallest given tables: against their SQL, or the library."""

import collections
import zlib

import numpy as np
import pytest

from checks.compare import differences, duck
from srcmetrics.llm import queries
from srcmetrics.llm.oracle import oracle_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_and_sql_agree(llm, name):
    got = queries.queries()[name](llm, SF).toPandas()
    assert not differences(got, duck(SF).execute(oracle_sql()[name]).df())


def test_packed_pieces(llm):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    ids = {}
    for r in llm.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids[r.doc_id] = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
    seen, used = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op11_packing(llm, SF).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        used[r.sequence_id].append((r.offset, r.length))
    for doc, pieces in seen.items():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)])]
        assert [s for s, _ in sorted(pieces)] == ends[:-1] and ends[-1] == len(ids[doc])
    assert len(seen) == len(ids)
    sizes = []
    for pieces in used.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)])]
        assert [o for o, _ in sorted(pieces)] == ends[:-1]
        sizes.append(int(ends[-1]))
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes) and sum(n < 2048 for n in sizes) <= 11


def test_token_counts_and_pieces_agree(llm):
    counts = {r.doc_id: r.n_tokens for r in queries.op10_tokens(llm, SF).collect()}
    assert {r.doc_id: r.doc_tokens - 1 for r in queries.op11_packing(llm, SF).collect()} == counts
