import collections
import hashlib

import pytest

from cohortal.core.settle import settle
from cohortal.llm import mixing
from tests.llm.helpers import empty_table, odd_rows, odd_table, prose, words


def targets(sizes):
    """Weights 5, 2, 1 by code point, null last; limits of three times a size, the excess shared again."""
    order = sorted([k for k in sizes if k is not None]) + [k for k in sizes if k is None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [k for k in order if k not in capped]
        rest = total - sum(3 * sizes[k] for k in capped)
        level = rest / sum(weight[k] for k in free) if free else 0
        over = {k for k in free if weight[k] * level > 3 * sizes[k]}
        if not over:
            return {k: 3.0 * sizes[k] if k in capped else weight[k] * level for k in order}
        capped |= over


def rows(n=400):
    source = lambda k: None if k % 11 == 0 else ("z" if k % 3 else f"s{k % 7}é")
    return [(k, prose(k, (k * 37) % 300), source(k)) for k in range(n)]


def test_targets_and_taken(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    plan = mixing.mix_sources(docs.repartition(4), settle)
    out = {r.doc_id: r for r in plan.taken().collect()}
    sizes = collections.Counter()
    for _, text, source in data:
        sizes[source] += len(words(text))
    want = targets(dict(sizes))
    taken = collections.Counter()
    for k, text, source in data:
        r = out[k]
        assert (r.size, r.source_size) == (len(words(text)), sizes[source])
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.08 * target + mixing.BLOCK_WORDS
    again = {r.doc_id: r.taken for r in mixing.mix_sources(docs.repartition(7), settle).taken().collect()}
    assert again == {k: r.taken for k, r in out.items()}


def test_slots_are_permutations_and_blocks_hold_all_words(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    plan = mixing.mix_sources(docs, settle)
    blocks = collections.Counter()
    for r in plan.doc_blocks().collect():
        blocks[r.key, r.block] += r.words
    count = {r.key: r.n_blocks for r in plan.targets.collect()}
    last = {r.key: r.source_size for r in plan.targets.collect()}
    for (key, block), n in blocks.items():
        assert n == mixing.BLOCK_WORDS or (block == count[key] - 1 and n == last[key] - block * mixing.BLOCK_WORDS)
    passes = collections.defaultdict(list)
    numbers = collections.defaultdict(list)
    for r in plan.slots.collect():
        passes[r.key, r["pass"]].append(r.block)
        numbers[r.key].append(r.number)
    for (key, p), found in passes.items():
        assert len(set(found)) == len(found) and max(found) < count[key] and p < 3
    for found in numbers.values():
        assert sorted(found) == list(range(len(found)))


def streams(data):
    """Per source the words of its documents in the order of their hash, with the document of each word."""
    out = collections.defaultdict(list)
    place = lambda k, n: int(hashlib.md5(f"{mixing.SEED}:{k}:{n}".encode()).hexdigest()[:8], 16) >> 1
    for k, text, source in sorted(data, key=lambda r: (place(r[0], len(words(r[1]))), r[0])):
        out[source] += [(w, k) for w in words(text)]
    return out


@pytest.mark.parametrize("bucket", [20_000, 50])
def test_mixed_blocks_equal_brute_force(spark, monkeypatch, bucket):
    """Every slot holds the words of its block, and the words per document are those that the plan counts."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 128)
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    mixed = settle(mixing.mix_blocks(docs, settle), "mixed")
    want = streams(data)
    shards, sources = collections.defaultdict(list), collections.Counter()
    for r in mixed.collect():
        own = want[r.source][r.block * mixing.BLOCK_WORDS : (r.block + 1) * mixing.BLOCK_WORDS]
        assert r.words == " ".join(w for w, _ in own) and r.n_words == len(own) > 0
        assert [p.doc_id for p in r.parts for _ in range(p.n)] == [k for _, k in own]
        shards[r.shard].append(r.slot)
        sources[r.source, r.shard] += 1
    for found in shards.values():
        assert sorted(found) == list(range(len(found))) and len(found) <= 128
    assert len(shards) > 3 and all(len(shards[s]) == 128 for s in range(len(shards) - 1))
    plan = mixing.mix_sources(docs, settle)
    key = lambda k: k[1:] if k != "n" else None
    assert sources == collections.Counter((key(r.key), r.shard) for r in plan.slots.collect())
    taken = {r.doc_id: r.taken for r in mixing.taken_from(mixed).collect()}
    assert taken == {r.doc_id: r.taken for r in plan.taken().collect() if r.taken}


def test_mixed_blocks_of_odd_rows_and_long_texts(spark):
    mixed = mixing.mix_blocks(odd_table(spark), settle).collect()
    total = sum(len(words(r[1])) for r in odd_rows())
    assert mixed and abs(sum(r.n_words for r in mixed) - total) <= 3 * mixing.BLOCK_WORDS * len({r.source for r in mixed})
    assert mixing.mix_blocks(empty_table(spark), settle).count() == 0
    long = spark.createDataFrame([(1, prose(1, 50_000), "a"), (2, None, "a"), (3, " ", None)], "doc_id long, text string, source string")
    out = mixing.mix_blocks(long, settle).collect()
    assert " ".join(r.words for r in sorted(out, key=lambda r: r.block)) == " ".join(words(prose(1, 50_000)))
    again = mixing.mix_blocks(long, settle).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_odd_rows(spark):
    out = mixing.mix_sources(odd_table(spark), settle).taken().collect()
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(r[0]), len(words(r[1]))) for r in odd_rows())
    assert all(r.taken <= 3 * r.size for r in out)
    assert mixing.mix_sources(empty_table(spark), settle).taken().count() == 0
    only = odd_table(spark).where("doc_id in (2, 3)")
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(only, settle).taken().collect()] == [(0, 0.0, 0)] * 2
