"""The exchange between chunks and ranges: whole, in hops, and in proportion to the corpus."""

import numpy as np
import pytest

from palimpsest.llm import chunks as C
from palimpsest.llm import superkmers as S

from .helpers import prose, table


def test_records_survive_crates():
    r = np.random.Generator(np.random.PCG64(1))
    size = r.integers(0, 9, 300)
    body = r.integers(0, 256, int(size.sum())).astype(np.uint8)
    records = C.Records(r.integers(0, 40, 300), np.full(300, 7), [np.arange(300, dtype=np.uint32)], size, body)
    whole = {k: body[a : a + n].tobytes() for k, a, n in zip(range(300), np.cumsum(size) - size, size)}
    for width in (1, 8, 64):
        rows = C.crated(records, width, 3)
        assert rows.num_rows == len(set(records.to // width)) and set(rows.column("lane").to_pylist()) == {3}
        back = {}
        for at, blob in zip(rows.column("at").to_pylist(), rows.column("data").to_pylist()):
            got = C.opened([blob])
            assert set(got.to // width) == {at} and set(got.of) == {7}
            cut = np.cumsum(got.size) - got.size
            back |= {int(k): got.body[a : a + n].tobytes() for k, a, n in zip(got.columns[0], cut, got.size)}
        assert back == whole
    parts = list(records.parts(np.arange(300).astype(np.uint8), 300, 60))
    assert len(parts) == 5 and sorted(k for p in parts for k in p.columns[0]) == list(range(300))
    assert C.opened([]) is None and C.crated(C.Records(*(np.zeros(0, np.int64),) * 2, [], None, None), 1, 0).num_rows == 0


def test_rows_grow_with_the_corpus():
    sent = lambda n: n * min(C.FAN, C.ranges_for(n)) * len(C.widths(n, C.ranges_for(n)))
    assert sent(240) == 5 * sent(48)
    for n in (10**4, 10**6, 10**8):
        assert sent(100 * n) <= 200 * sent(n)
        w = C.widths(n, C.ranges_for(n))
        assert w[-1] == 1 and all(-(-a // b) <= C.FAN for a, b in zip([C.ranges_for(n), *w], w))


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_hops_find_the_same_shared_keys(spark, fan, monkeypatch):
    monkeypatch.setattr(C, "FAN", fan)
    docs = table(spark, [(k, f"{prose(k, 20)} {k % 7}") for k in range(60)])
    parts, n = C.chunked(docs, "doc_id", "text", 300)
    assert n > 11

    def keys(chunk):
        return np.unique(C.mix(np.array([int(t.split()[-1]) for t in chunk.texts] + [1000 + int(i) for i in chunk.ids], np.uint64)))

    def read(chunk, answers):
        import pyarrow as pa

        k = keys(chunk)
        return pa.table([pa.array(k.view(np.int64)), pa.array(C.common_among(k, answers, n))], ["key", "more"])

    got = C.apply(parts, C.common_keys(parts, keys, n), read, "key long, more boolean").collect()
    times = {}
    for r in got:
        times[r.key] = times.get(r.key, 0) + 1
    assert len(got) > 60 and all(r.more == (times[r.key] > 1) for r in got) and any(r.more for r in got)


def test_classes_compare_values_where_hashes_agree():
    values = np.frombuffer(b"abcabdabcabcd", np.uint8)
    start, size = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 4])
    for hashes in ([5, 6, 5, 7], [5, 5, 5, 5], [1, 1, 1, 2]):
        first, of = S.classes(np.array(hashes, np.uint64), values, start, size)
        assert of[0] == of[2] and len({of[0], of[1], of[3]}) == 3 == len(first) and [of[f] for f in first] == [0, 1, 2]
