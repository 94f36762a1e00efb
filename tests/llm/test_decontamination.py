import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortal.llm import fm_index
from cohortal.llm.words import pieces
from tests.llm.helpers import empty_table, odd_table

W = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items):
    words, hit, found = W.findall(low(text)), set(), set()
    for item, body in items:
        own = W.findall(low(body))
        for k in range(max(1, len(own) - 9) if own else 0):
            part = own[k : k + 10]
            for s in range(len(words) - len(part) + 1):
                if words[s : s + len(part)] == part:
                    hit.update(range(s, s + len(part)))
                    found.add(str(item))
    return len(words), sorted(hit), sorted(found)


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "cé", "d1", "e"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([0, 4, 9, 10, 14, 30, 12])]
    items += [(9, "zz"), (10, "")]
    docs = [" ".join(rng.choice([*vocabulary, "q", "..."]) for _ in range(rng.choice([0, 1, 40, 90]))) for _ in range(40)]
    docs += [f"x {rng.choice(items)[1]}, y-{rng.choice(items)[1]}" for _ in range(30)] + ["zz ZZ", None]
    return items, docs


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 60, 300):
        text = np.append(rng.integers(1, 4, n), 0)
        order = fm_index.suffix_array(text)
        suffixes = [tuple(text[i:]) for i in order]
        assert suffixes == sorted(suffixes)


def test_wavelet_matrix_ranks_and_reads():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 13, 200)
    matrix = fm_index.WaveletMatrix(values, 12)
    assert (matrix.access(np.arange(200)) == values).all()
    symbols, ends = rng.integers(0, 13, 500), rng.integers(0, 201, 500)
    assert matrix.rank(symbols, ends).tolist() == [int((values[:e] == s).sum()) for s, e in zip(symbols, ends)]


@pytest.mark.parametrize("limit", [40, 4000])
def test_search_equals_brute_force(limit):
    items, docs = made(3)
    patterns = fm_index.Patterns([(str(i), t.encode()) for i, t in items])
    for piece in pieces(pa.array([(d or "").encode() for d in docs], pa.binary()), limit):
        counts, hits, found = fm_index.search_piece(piece, patterns)
        for k in range(piece.n):
            assert (counts[k], hits[k].tolist(), sorted(found[k])) == brute(docs[piece.first + k], items)


@pytest.mark.parametrize("block", [200_000, 10])
def test_query_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(fm_index, "BLOCK_WORDS", block)
    items, docs = made(4)
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, "q q q q q q q q q q q"), (77, None)], "item_id long, text string")
    items.append(("null", "q q q q q q q q q q q"))
    out = {r.doc_id: r for r in fm_index.digest(fm_index.find_benchmark(table, bench)).collect()}
    assert len(out) == len(docs)
    for k, text in enumerate(docs):
        n, hit, found = brute(text, items)
        assert (out[k].n_words, out[k].n_hit, out[k].n_items, out[k].contaminated) == (n, len(hit), len(found), bool(hit))
        assert out[k].items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_removal_leaves_no_window(spark):
    items, docs = made(5)
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = fm_index.remove_spans(fm_index.find_benchmark(table, bench)).collect()
    assert len(left) == len(docs)
    for r in left:
        n, hit, _ = brute(docs[r.doc_id], items)
        assert len(W.findall(low(r.text))) == n - len(hit)
        if not hit:
            assert r.text == docs[r.doc_id]


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    odd = odd_table(spark)
    found = fm_index.find_benchmark(odd, bench)
    rows = fm_index.digest(found).collect()
    assert len(rows) == odd.count() and sum(r.contaminated for r in rows) == 3
    assert fm_index.remove_spans(found).columns == [c for c in odd.columns if c != "n_words"]
    assert fm_index.digest(fm_index.find_benchmark(empty_table(spark), bench)).count() == 0
    assert fm_index.digest(fm_index.find_benchmark(odd, bench.limit(0))).where("contaminated").count() == 0
