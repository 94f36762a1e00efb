import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohortal.core.settle import settle
from cohortal.llm import best_position
from tests.llm.helpers import empty_table, lower, odd_rows, odd_table

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(lower(text))


def brute(docs, items, k=10):
    """Every document scored against every item, straight from the definitions."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, bag in bags:
            m = 10 + (90 * sum(bag.values()) * n_docs) // n_terms if n_terms else 10
            score = 0
            for t in set(terms(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        scored.sort()
        out += [(item, rank + 1, d, -s) for rank, (s, _, _, d) in enumerate(scored[:k])]
    return sorted(out, key=str)


def answers(spark, docs, items, **more):
    table = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, best_position.rank_documents(table, asked, settle, **more).collect()), key=str)


def made(seed, n=250, vocabulary=60):
    rng = random.Random(seed)
    words = [f"{rng.choice(['Ab', 'cé', 'x', '9'])}{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights, k=n))
    docs = [(i, say(rng.choice([0, 1, 3, 20, 60]))) for i in rng.sample(range(10_000), n)]
    docs += [(20_000 + i, docs[i % 7][1]) for i in range(40)]  # copies tie
    items = [(i, say(rng.choice([1, 2, 5, 30]))) for i in range(25)] + [(90, "nowhere"), (91, ""), (92, None), (93, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("depth", [1, 32])
def test_search_equals_brute_force(spark, monkeypatch, seed, depth):
    monkeypatch.setattr(best_position, "FIRST_DEPTH", depth)
    monkeypatch.setattr(best_position, "SHARD_POSTINGS", 300)
    docs, items = made(seed)
    assert answers(spark, docs, items) == brute(docs, items)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(best_position, "BLOCK_BYTES", 200)
    docs, items = made(5, n=80)
    assert answers(spark, docs, items, k=3) == brute(docs, items, 3)


def test_ties_rank_by_id_and_null_comes_first(spark):
    docs = [(i, "same words here") for i in (9, 3, 7, 30, 1)] + [(None, "same words here"), (4, "other"), (None, None)]
    items = [(1, "words"), (2, "other same")]
    assert answers(spark, docs, items) == brute(docs, items)
    assert [r[2] for r in sorted(answers(spark, docs, items, k=3)) if r[0] == 1] == [None, 1, 3]


def test_repeated_rows_and_queries(spark):
    docs = [(1, "a b"), (1, "a b"), (2, "a"), (3, "c")]
    assert answers(spark, docs, [(5, "a"), (5, "a")]) == brute(docs, [(5, "a"), (5, "a")])


def lists(rng, n_docs, n_terms):
    held = rng.integers(1, n_terms + 1, n_docs)
    own = [rng.choice(n_terms, h, replace=False) for h in held]
    begins = np.concatenate(([0], np.cumsum(held)))
    return best_position.ImpactLists(begins, np.concatenate(own), rng.integers(0, 9, begins[-1]) ** 4, n_terms)


def test_bound_is_tighter_than_places_read_last(monkeypatch):
    """Stops no later than the threshold of the last places read would, and sometimes earlier."""
    monkeypatch.setattr(best_position, "FIRST_DEPTH", 1)
    rng, earlier = np.random.default_rng(1), 0
    for _ in range(60):
        index = lists(rng, 120, 4)
        query = np.arange(4)
        docs, scores, looked_up = index.search(query, 3)
        whole = np.bincount(np.repeat(np.arange(120), np.diff(index.begins)), index.impacts, 120).astype(int)
        order = np.lexsort((np.arange(120), -whole))[:3]
        order = order[whole[order] > 0]
        assert docs.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
        assert index._unseen.all() and not index._wanted.any()
        # The same rounds with the threshold of the last places read.
        depth, step, met = 0, 1, set()
        spans = [(index.starts[t], index.starts[t + 1]) for t in query]
        while True:
            for b, e in spans:
                met |= set(index.docs[min(b + depth, e) : min(b + depth + step, e)].tolist())
            depth, step = depth + step, step * 2
            bound = sum(int(index.listed[b + depth - 1]) for b, e in spans if b + depth < e)
            kth = sorted((whole[d] for d in met), reverse=True)[:3]
            if bound == 0 or (len(kth) == 3 and bound < kth[-1]):
                break
        assert looked_up <= len(met)
        earlier += looked_up < len(met)
    assert earlier > 0


def test_odd_rows(spark):
    odd = odd_table(spark)
    asked = spark.createDataFrame([(1, "short text lorem5"), (None, "seven EIGHT password")], "item_id long, text string")
    mine = sorted(map(tuple, best_position.rank_documents(odd, asked, settle).collect()), key=str)
    assert mine == brute([(r[0], r[1]) for r in odd_rows()], [(1, "short text lorem5"), (None, "seven EIGHT password")])
    texts = odd.selectExpr("cast(key as string) as label", "text as row")
    assert best_position.rank_documents(texts, asked, settle, doc="label", text="row").columns == ["item_id", "rank", "label", "score"]
    assert best_position.rank_documents(empty_table(spark), asked, settle).count() == 0
    assert best_position.rank_documents(odd, asked.limit(0), settle).count() == 0
