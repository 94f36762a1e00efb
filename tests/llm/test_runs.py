import hashlib
import random
import zlib

import numpy as np
import pytest

from cohortal.llm import squares
from tests.llm.helpers import LONG, empty_table, odd_table, words


def brute_runs(w):
    """Every maximal stretch, period by period; a period counts where no smaller one fits the stretch."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k + q < len(w):
            if w[k] != w[k + q]:
                k += 1
                continue
            end = k
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            n = end + q - k
            smaller = any(all(w[i] == w[i + p] for i in range(k, k + n - p)) for p in range(1, q))
            if n >= max(6, 4 * q) and not smaller:
                out.append((k, n, q))
            k = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    strongest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *strongest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def made(rng):
    """Random words with planted repetitions, nested and next to each other."""
    out = []
    for _ in range(rng.randrange(1, 7)):
        unit = [rng.choice("abcd") for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17]))]
        if rng.random() < 0.3:
            unit = unit * rng.randrange(2, 6) + [rng.choice("abx")]
        out += unit * rng.choice([1, 2, 3, 4, 5, 6, 9]) + unit[: rng.randrange(len(unit) + 1)]
        out += [rng.choice("abcdef") for _ in range(rng.choice([0, 0, 1, 5]))]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        w = made(rng)[:260]
        assert squares.runs_of([x.encode() for x in w]) == brute_runs(w)


def test_short_alphabet_and_empty():
    for n in range(10):
        for mask in range(2**n):
            w = [b"ab"[mask >> i & 1 :][:1] for i in range(n)]
            assert squares.runs_of(w) == brute_runs(w)
    assert squares.runs_of([]) == [] and squares.collapse([], []) == []


def test_runs_do_not_depend_on_the_pieces_appended():
    rng = random.Random(9)
    for _ in range(60):
        w = made(rng)[:300]
        whole = squares.runs_of([x.encode() for x in w])
        for most in (1, 3, 40):
            catcher, k = squares.SquareCatcher(), 0
            while k < len(w):
                step = rng.randrange(1, most + 1)
                catcher.append(np.array([ord(x) for x in w[k : k + step]], np.int64))
                k += step
                if k < len(w) and rng.random() < 0.1:
                    assert catcher.runs() == brute_runs(w[:k])
            assert catcher.runs() == whole


def test_long_periods_and_overlap_free_words():
    thue = [bin(i).count("1") % 2 for i in range(4096)]  # has no run of more than two periods
    assert squares.runs_of([b"ab"[x : x + 1] for x in thue]) == []
    block = [str(i).encode() for i in range(3_000)]
    assert squares.runs_of([b"x", *block * 5, b"0", b"y"]) == [(1, 15_001, 3_000)]
    assert squares.runs_of([b"a"] * 50_000) == [(0, 50_000, 1)]
    with pytest.raises(ValueError):
        squares.runs_of(block, power=3)


def test_query_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(made(rng)[:200])) for i in range(150)]
    rows += [(None, "a a a a a a a"), (None, None), (170, None), (171, ""), (172, " \n "), (3, rows[3][1]), (173, "é é é é é é é b")]
    found = squares.digest(squares.find_runs(squares.plant_period(spark.createDataFrame(rows, "doc_id long, text string"))))
    mine = sorted(map(tuple, found.collect()), key=str)
    assert mine == sorted((brute_row(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(150)) > 5


def test_odd_rows(spark):
    odd = odd_table(spark)
    found = squares.find_runs(odd)
    assert set(found.columns) == set(odd.columns) | {"n_words", "runs", "collapsed"}
    out = squares.digest(found).collect()
    assert len(out) == odd.count() and all(r.runs_sha256 and r.collapsed_sha256 for r in out)
    long = next(r for r in found.collect() if r.doc_id == 7)
    assert (long.n_words, long.collapsed, long.runs) == (60_000, LONG, [])
    assert squares.digest(squares.find_runs(squares.plant_period(empty_table(spark)))).count() == 0
