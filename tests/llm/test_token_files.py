import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from cohortal.core.settle import settle
from cohortal.llm import dac
from tests.llm.helpers import empty_table, odd_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def expected(rows):
    """(doc_id, start, n_tokens, ids_crc32) by encoding every text as a whole."""
    encode, at, out = plain(), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*encode(text), 0], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_any_token_is_read_by_its_place(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 7, 511, 512, 513, 3000):
        ids = (2 ** rng.uniform(0, [1, 17, 32][seed], n)).astype(np.uint64) - 1
        for widths in (None, [32], [1, 31], [5, 3, 24], [8, 8, 8, 8]):
            codes = dac.Codes.build(ids, widths)
            assert codes.tokens(0, n).tolist() == ids.tolist()
            for k in rng.integers(0, n, 40) if n else []:
                assert codes.token(int(k)) == ids[k]
                end = int(rng.integers(k, n + 1))
                assert codes.tokens(int(k), end).tolist() == ids[k:end].tolist()
            for level in range(len(codes.bitmaps)):
                on = np.unpackbits(codes.bitmaps[level], bitorder="little")
                for place in rng.integers(0, len(on) + 1, 10):
                    assert codes.rank(level, int(place)) == on[:place].sum()
    with pytest.raises(IndexError):
        dac.Codes.build(np.arange(3)).token(3)
    with pytest.raises(ValueError):
        dac.Codes.build(np.array([4]), [2])


def test_widths_are_the_cheapest():
    import itertools

    ids = np.array([0, 1, 1, 2, 5, 9, 40, 41, 42, 200] * 30)
    size = lambda widths: sum(
        (ids >> sum(widths[:k]) > 0).sum() * (w + 1 + 1 / 16) if k else len(ids) * (w + 1 + 1 / 16) for k, w in enumerate(widths)
    ) - ((ids >> sum(widths[:-1]) > 0).sum() if len(widths) > 1 else len(ids)) * (1 + 1 / 16)
    choices = [c for n in range(1, 9) for c in itertools.product(range(1, 9), repeat=n) if sum(c) == 8]
    assert size(dac.best_widths(ids)) == pytest.approx(min(size(c) for c in choices if len(c) <= 2))
    assert size(dac.best_widths(ids, 8)) == pytest.approx(min(map(size, choices)))


def test_segments_round_trip():
    rng = np.random.default_rng(5)
    parts, blob = [], b""
    for k in range(4):
        docs = [rng.integers(0, 50_000, rng.integers(1, 900)) for _ in range(rng.integers(1, 9))]
        names = [None if rng.random() < 0.2 else f"é{i}".encode() for i in range(len(docs))]
        starts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        blob += dac.Segment(3, k * 10, dac.Codes.build(np.concatenate(docs)), starts, names).to_bytes() + b"\n"
        parts.append((docs, names))
    back = list(dac.segments_of(blob))
    for k, (s, (docs, names)) in enumerate(zip(back, parts, strict=True)):
        assert (s.slice, s.first, s.docs) == (3, k * 10, names)
        assert all((s.document(i) == d).all() for i, d in enumerate(docs))
    with pytest.raises(ValueError):
        list(dac.segments_of(blob[:-20]))


def test_encoder_equals_library_on_odd_texts():
    rng = random.Random(1)
    atoms = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "\u180e", "\ufeff", "a", "it's", "'s", "12", "!?", "\u00e9", "\u00dcn", "\u6f22", "\U0001f642", "<|endoftext|>", "_", "\x00", "\u0301"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(1, 25))) for _ in range(3000)] + ["", " ", "\n", "\n\n a", "a\n", " a b"]
    encoder, direct = dac.Encoder(PATH), plain()
    assert encoder.by_unit
    for k in range(0, len(texts), 100):
        for text, ids in zip(texts[k : k + 100], encoder.encode(pa.array(texts[k : k + 100]))):
            assert ids.tolist() == direct(text), repr(text)


@pytest.mark.parametrize("segment", [1 << 20, 50])
def test_files_equal_whole_encoding(spark, tmp_path, monkeypatch, many_slices, segment):
    monkeypatch.setattr(dac, "SEGMENT_TOKENS", segment)
    rng = random.Random(2)
    rows = [(rng.randrange(-50, 10**12), " ".join(rng.choice(["alpha", "Beta", "gamma's", "42"]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [(None, "null id"), (10**13, None), (10**13 + 1, ""), (10**13 + 2, "x\ny\n\x00z")]
    folder = f"{tmp_path}/tokens"
    dac.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH, slices=5)
    out = dac.with_starts(dac.read_documents(spark, folder), settle)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == expected(rows)


def test_repeated_rows_and_string_ids(spark, tmp_path):
    rows = [("b", "one two"), ("a", "three"), ("b", "one two"), ("b", "one")]
    dac.write_tokens(spark.createDataFrame(rows, "key string, body string"), f"{tmp_path}/t", PATH, doc="key", text="body", slices=2)
    out = dac.with_starts(dac.read_documents(spark, f"{tmp_path}/t", "string"), settle).collect()
    assert sorted(r.doc_id for r in out) == ["a", "b", "b", "b"]
    ends = sorted((r.start, r.start + r.n_tokens) for r in out)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_odd_rows(spark, tmp_path):
    odd = odd_table(spark)
    encoded = dac.encode_tokens(odd.withColumn("token_ids", odd["row"]), PATH)
    direct = plain()
    assert set(encoded.columns) == set(odd.columns) | {"token_ids"}
    for r in encoded.collect():
        assert r.token_ids == [*direct(r.text), 0]
    dac.write_tokens(odd, f"{tmp_path}/odd", PATH)
    assert dac.with_starts(dac.read_documents(spark, f"{tmp_path}/odd"), settle).count() == odd.count()
    dac.write_tokens(empty_table(spark), f"{tmp_path}/none", PATH)
    assert dac.with_starts(dac.read_documents(spark, f"{tmp_path}/none"), settle).count() == 0
