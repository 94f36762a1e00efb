"""N-gram Jaccard self-join with adaptive multi-match prefixes, and the classes its links form.

A document's set are its distinct five-word shingles, in one global order that
puts shingles with a rare word first (no shingle is in more documents than its
rarest word). Two sets with Jaccard similarity t share at least l tokens of
their l-prefixes, |x| - ceil(t |x|) + l tokens long. Each document takes the l of
the least estimated cost; a pair is verified on whole sets if it shares at least
the smaller l of the two. Documents with the same words are one class from the
start, and documents whose longest prefix holds too few tokens that others have
take no part. Tokens of few documents give pairs. Tokens of many are split by set
size, so that only documents of like size meet; lists that are still long first
link each member to one leader, which joins large groups of near copies by few
pairs; what is still in different classes is compared in blocks of bounded size,
first inside random chunks of such a family and, once those links are followed,
between what is left and the rest. A block first compares prefixes, and only
documents with a partner there send their whole sets. Every block gives a forest
over classes, so links stay few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cohortal.llm.blocks import key_totals, pack, shard_totals, unpack
from cohortal.llm.components import Scratch, components
from cohortal.llm.words import LOWER, NOT_SPACE, Piece, pieces, sequence_hash, small_batches, span_hashes, spans, text_bytes, windows

WIDTH = 5
PERCENT = 80  # Jaccard threshold in percent
LONGEST = 8  # largest number of shared prefix tokens that is considered
VERIFY_COST = 100.0  # cost of one verification against reading one entry of a token's list
HOT = 9  # tokens held by so many are linked to a leader first; fewer are paired in one row
BAND = 1.26  # ratio of set sizes in a band; above 100 / PERCENT, so that similar sets are in one band or in two next to each other
LEADER_ROUNDS = 2
CHUNK = 400  # documents of a family that are compared at once with as many others
COLUMNS = 2048  # shingles counted at once there
SHARD_BYTES = 6 << 20
FEW_IDS = 4_000_000  # document ids that are sent to every task
SETS_AT_ONCE = 500  # sets of a shard that are held at once
FEW_ROWS = 1_000_000  # places in blocks that are sent to every task
FEW_BITMAPS = 16_384  # bitmaps of 32,768 row numbers that are sent to every task


SHARD_SCHEMA = "shard long, row long, docs array<{}>, texts array<binary>, n_words binary, ids binary, order binary, keys binary, counts binary, n_keys long"


def encode(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per shard: row ids, document ids, a key per text, words by their rank, sorted vocabulary with document counts."""
    rows = docs.select(F.col(doc).alias("doc"), text_bytes(text).alias("bytes"))
    kind = rows.schema["doc"].dataType.simpleString()
    small_batches(docs.sparkSession)

    def shard(number: int, row: int, ids: list[pa.Array], texts: list, parts: list) -> pa.RecordBatch:
        hashes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        keys, inverse, everywhere = np.unique(hashes, return_inverse=True, return_counts=True)
        width = max(1, len(keys))
        pairs = np.unique(np.repeat(np.arange(len(counts)), counts) * width + inverse)
        found = np.bincount(pairs % width, minlength=len(keys)).astype(np.int32)
        # Frequent words get small numbers, which compress well.
        order = np.argsort(-everywhere, kind="stable").astype(np.int32)
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.arange(len(keys), dtype=np.int32)
        arrays = [pa.array([number], pa.int64()), pa.array([row], pa.int64()), pa.ListArray.from_arrays([0, len(texts)], pa.concat_arrays(ids)), pa.array([texts], pa.list_(pa.binary()))]
        packed = [pack(counts.astype(np.int32)), pack(rank[inverse]), pack(order), pack(keys, True), pack(found)]
        arrays += [pa.array([p], pa.binary()) for p in packed] + [pa.array([len(keys)], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "row", "docs", "texts", "n_words", "ids", "order", "keys", "counts", "n_keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        row = TaskContext.get().partitionId() << 40
        ids, texts, parts, size = [], [], [], 0
        for batch in batches:
            for piece in pieces(batch.column(1)):
                if ids and size + len(piece.data) > SHARD_BYTES:
                    yield shard(number, row, ids, texts, parts)
                    number, row, ids, texts, parts, size = number + 1, row + len(texts), [], [], [], 0
                low = Piece(piece.first, LOWER[piece.data], piece.offsets)
                starts, ends, first = spans(low, NOT_SPACE)
                hashes = span_hashes(low.data, starts, ends)
                for a, b in zip(first[:-1], first[1:]):
                    texts.append(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None)
                parts.append((hashes, np.diff(first)))
                ids.append(batch.column(0).slice(piece.first, piece.n))
                size += len(piece.data)
        if ids:
            yield shard(number, row, ids, texts, parts)

    return rows.mapInArrow(run, SHARD_SCHEMA.format(kind))


def _document_sets(row: dict, chosen: np.ndarray, bounds: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """For chosen documents of a shard: sorted distinct shingle hashes, and the bound of each."""
    order, ids = unpack(row["order"], np.int32), unpack(row["ids"], np.int32)
    words = unpack(row["keys"], np.uint64, True)[order]
    bounds = None if bounds is None else bounds[order]
    first = np.concatenate(([0], np.cumsum(unpack(row["n_words"], np.int32), dtype=np.int64)))
    for d in chosen:
        own = ids[first[d] : first[d + 1]]
        if len(own) < WIDTH:
            yield int(d), np.array([sequence_hash(words[own])] if len(own) else [], np.uint64), np.ones(min(len(own), 1), np.int64) if bounds is not None else None
            continue
        shingles, _ = windows(words[own], np.array([0, len(own)]), WIDTH)
        tokens, place = np.unique(shingles, return_index=True)
        if bounds is None:
            yield int(d), tokens, None
        else:
            rare = bounds[own]
            low = np.min(np.stack([rare[j : len(own) - WIDTH + 1 + j] for j in range(WIDTH)]), axis=0)
            yield int(d), tokens, low[place]


def prefix_length(n: np.ndarray | int, more: int = 1):
    """|x| - ceil(t |x|) + more."""
    return n - -(-n * PERCENT // 100) + more


def _prefixes(row: dict, found: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For a shard's representatives: place, set size, and the longest prefix's tokens that others may have, with their places.

    ``found`` has the answers (bucket, totals) about the shard's words and, with
    ``place``, its representatives.
    """
    is_rep = found["place"].is_valid().to_numpy()
    bounds = shard_totals(found.filter(pa.array(~is_rep)))
    reps = np.sort(found["place"].drop_null().to_numpy()).astype(np.int64)
    for d, tokens, low in _document_sets(row, reps, bounds):
        order = np.lexsort((tokens, low))[: prefix_length(len(tokens), LONGEST)]
        shared = np.flatnonzero(low[order] > 1)  # a word that no other document has rules its shingles out
        yield d, len(tokens), tokens[order[shared]], shared


PREFIX_SCHEMA = "shard long, row long, keys binary, counts binary, n_keys long, reps binary, sizes binary, lengths binary, tokens binary, places binary"


def prefix_keys(shards: DataFrame, found: DataFrame) -> DataFrame:
    """Per shard the sorted prefix tokens of its representatives, each with how many of them have it, and who has which.

    ``reps`` are the representatives' places in the shard, ``sizes`` their set
    sizes and ``lengths`` their numbers of prefix tokens; ``tokens`` are places
    in ``keys`` and ``places`` those in the document's own order.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            parts = list(_prefixes(row, right))
            flat = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
            keys, tokens, counts = np.unique(flat(2, np.uint64), return_inverse=True, return_counts=True)
            whole = [[p[0] for p in parts], [p[1] for p in parts], [len(p[2]) for p in parts], tokens, flat(3, np.int64)]
            packed = [pack(np.asarray(x).astype(np.int32)) for x in whole]
            out.append((row["shard"], row["row"], pack(keys, True), pack(counts.astype(np.int32)), len(keys), *packed))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), *[pa.binary()] * 5]
        columns = zip(*out) if out else [[]] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in PREFIX_SCHEMA.split(", ")])

    return _asked(shards).groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(run, PREFIX_SCHEMA)


def _asked(shards: DataFrame) -> DataFrame:
    return shards.select("shard", "row", "n_words", "ids", "order", "keys")


def choose_shared(n: int, places: np.ndarray, df: np.ndarray) -> int:
    """How many shared prefix tokens a partner of a set of ``n`` must have.

    With m(l) entries in the lists of the l-prefix's tokens, reading costs m(l)
    and at most m(l) / l documents can share l tokens and need verification.
    A partner has at least ceil(t n) tokens in common, so no more may be asked:
    beyond that the l-prefix is the whole set and promises nothing.
    """
    best = (np.inf, 1)
    for more in range(1, min(LONGEST, -(-n * PERCENT // 100)) + 1):
        entries = float((df[places < prefix_length(n, more)] - 1).sum())
        best = min(best, (entries * (1 + VERIFY_COST / more), more))
    return best[1]


def least_shared(n):
    """How many tokens the longest prefix of a set of ``n`` shares with that of any similar set, at least."""
    return np.minimum(LONGEST, -(-n * PERCENT // 100))


TOKEN_SCHEMA = "token long, rid long, n int, l int, rest int, q int, df long, hot boolean, prefix binary"


def shared_tokens(prefixes: DataFrame, answers: DataFrame) -> DataFrame:
    """(token, rid, n, l, rest, q, df): each representative's own prefix tokens that two or more have, ``q`` of them.

    ``rest`` is the part of the set beyond the prefix. A representative whose
    longest prefix has fewer such tokens than any link needs gives none. With
    token null there is one row per representative, with its set's size and
    whether one of its tokens is held by many; if so, ``prefix`` has all of them.
    ``prefixes`` are the settled ``prefix_keys``, ``answers`` the totals of their keys.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("token", "rid", "n", "l", "rest", "q", "df")}
        reps, sizes, mores, rests, hots, whole = [], [], [], [], [], []
        totals = shard_totals(right)
        for row in left.to_pylist():
            keys = unpack(row["keys"], np.uint64, True)
            own_reps, own_sizes, lengths, all_tokens, all_places = (unpack(row[c], np.int32) for c in ("reps", "sizes", "lengths", "tokens", "places"))
            ends = np.cumsum(lengths, dtype=np.int64)
            for d, n, a, b in zip(own_reps.tolist(), own_sizes.tolist(), (ends - lengths).tolist(), ends.tolist()):
                at, places = all_tokens[a:b], all_places[a:b]
                df = totals[at]
                at, places, df = at[df > 1], places[df > 1], df[df > 1]
                more = choose_shared(n, places, df)
                length = min(n, prefix_length(n, more))
                own = (places < length) & (len(df) >= least_shared(n))
                tokens = keys[at[own]]
                rid, k = row["row"] + d, len(tokens)
                for name, values in (("token", tokens.view(np.int64)), ("df", df[own])):
                    out[name].append(values)
                for name, value in (("rid", rid), ("n", n), ("l", more), ("rest", n - length), ("q", k)):
                    out[name].append(np.full(k, value, np.int64))
                reps.append(rid)
                sizes.append(n)
                mores.append(more)
                rests.append(n - length)
                hots.append(bool((df[own] >= HOT).any()))
                whole.append(pack(np.sort(tokens), True) if hots[-1] else None)
        flat = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}
        kinds = {"token": pa.int64(), "rid": pa.int64(), "n": pa.int32(), "l": pa.int32(), "rest": pa.int32(), "q": pa.int32(), "df": pa.int64()}
        rows = len(flat["rid"])
        lists = pa.Table.from_arrays([*[pa.array(flat[k].astype(t.to_pandas_dtype()), t) for k, t in kinds.items()], pa.nulls(rows, pa.bool_()), pa.nulls(rows, pa.binary())], names=[*kinds, "hot", "prefix"])
        none = pa.nulls(len(reps), pa.int64())
        heads = [none, pa.array(reps, pa.int64()), *[pa.array(x, pa.int32()) for x in (sizes, mores, rests)], pa.nulls(len(reps), pa.int32()), none, pa.array(hots, pa.bool_()), pa.array(whole, pa.binary())]
        return pa.concat_tables([lists, pa.Table.from_arrays(heads, names=[*kinds, "hot", "prefix"])])

    return prefixes.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, TOKEN_SCHEMA)


def _close(a: str, b: str):
    """The length filter of the threshold."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT)


def _banded(tokens: DataFrame, settle) -> DataFrame:
    """Tokens of many, split by set size: (token, rid, n, l, rest, q, low, df) with a token per old token and band.

    A band's list holds its own members and, as ``low``, those of the band below,
    so a pair of like sizes meets in the list of its larger band and nowhere else
    but among two that are low. A list of low members only has no such pair.
    """
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")
    at = lambda up: F.struct((band + up).alias("band"), F.lit(up).alias("low"))
    split = tokens.select("token", "rid", "n", "l", "rest", "q", F.explode(F.array(at(0), at(1))).alias("at"))
    split = split.select(F.xxhash64("token", "at.band").alias("token"), "rid", "n", "l", "rest", "q", "at.low")
    sizes = settle(split.groupBy("token").agg(F.count("*").alias("df"), F.min("low").alias("_low")).where("df > 1 and _low = 0").select("token", "df"), "join-sizes")
    return settle(split.join(sizes, "token"), "join-banded")


def only_named(sets: DataFrame, *named: DataFrame) -> DataFrame:
    """The sets of the documents that settled tables of one id column name.

    A join would shuffle every set to find the few that are asked for; while the
    ids are few they are sent to the sets instead.
    """
    ids = reduce(DataFrame.union, [t.toDF("_rid") for t in named])
    few = sum(t.count() for t in named) <= FEW_IDS
    return sets.join(F.broadcast(ids) if few else ids, sets["rid"] == F.col("_rid"), "left_semi")


def named_sets(shards: DataFrame, classes: DataFrame, *named: DataFrame) -> DataFrame:
    """(rid, set): whole sets of the representatives that settled tables of one id column name, made from their shards."""
    at = only_named(classes.select(F.col("row").alias("rid"), "shard", "place"), *named)
    wanted = at.groupBy("shard").agg(F.sort_array(F.collect_list("place")).alias("chosen"))
    few = sum(t.count() for t in named) <= FEW_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                for start in range(0, len(row["chosen"]), SETS_AT_ONCE):
                    found = list(_document_sets(row, np.array(row["chosen"][start : start + SETS_AT_ONCE]), None))
                    rids, sets = [row["row"] + f[0] for f in found], [pack(f[1], True) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(sets, pa.binary())], names=["rid", "set"])

    small_batches(shards.sparkSession)
    return _asked(shards).join(F.broadcast(wanted) if few else wanted, "shard").mapInArrow(run, "rid long, set binary")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), a settled table, whose whole sets are similar enough."""
    sets = only_named(sets, pairs.select("a"), pairs.select("b"))
    left = sets.select(F.col("rid").alias("_a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("rid").alias("_b"), F.col("set").alias("set_b"))
    both = pairs.join(left, pairs["a"] == left["_a"]).join(right, pairs["b"] == right["_b"]).select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = unpack(x.as_py(), np.uint64, True), unpack(y.as_py(), np.uint64, True)
                spot = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
                shared = int((y[spot] == x).sum()) if len(x) and len(y) else 0
                keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep))

    small_batches(pairs.sparkSession)
    return both.mapInArrow(run, "a long, b long")


def _leaders(tokens: DataFrame, salt: int, settle) -> DataFrame:
    first = F.min(F.struct(F.xxhash64("rid", F.lit(salt)).alias("h"), "rid", "n", "label"))
    leaders = tokens.groupBy("token").agg(first.alias("lead")).select("token", "lead.rid", "lead.n", "lead.label")
    return settle(leaders.toDF("token", "a", "na", "label_a"), "join-leaders")


def _leader_pairs(tokens: DataFrame, salt: int, settle) -> DataFrame:
    """For each document the leader, of another class, that leads most of its tokens: at most one pair per document."""
    met = tokens.join(_leaders(tokens, salt, settle), "token").where((F.col("label") != F.col("label_a")) & _close("n", "na"))
    shared = met.groupBy("a", F.col("rid").alias("b")).agg(F.count("*").alias("shared"))
    return shared.groupBy("b").agg(F.max(F.struct("shared", "a"))["a"].alias("a")).select("a", "b")


def _families(tokens: DataFrame, settle) -> DataFrame:
    """(rid, label, family): documents that shared tokens hold together, linked or not.

    A document stands in two bands, which are not to be held together by it: it is
    two nodes here. Each document first follows one of its tokens' leaders, which joins most of
    a family by one edge a document; then tokens whose members are still apart
    join what is left, one edge per token and group.
    """
    tokens = tokens.withColumn("rid", F.shiftleft("rid", 1) + F.col("low"))
    leaders = _leaders(tokens, -1, settle)
    near = components(tokens.join(leaders, "token").groupBy(F.col("rid").alias("b")).agg(F.min("a").alias("a")), settle)
    named = tokens.join(near.select("node", F.col("label").alias("near")), tokens["rid"] == F.col("node")).select("token", "near").distinct()
    named = settle(named, "join-near")
    apart = named.groupBy("token").agg(F.min("near").alias("a"), F.max("near").alias("top")).where("a <> top")
    rest = settle(named.join(apart, "token").where("near <> a").select("a", F.col("near").alias("b")).distinct(), "join-rest")
    wider = components(rest, settle).select(F.col("node").alias("_near"), F.col("label").alias("_wider"))
    family = near.join(wider, near["label"] == wider["_near"], "left").select("node", F.coalesce("_wider", "label").alias("family"))
    members = tokens.groupBy("rid").agg(F.min("label").alias("label"))
    return members.join(family, members["rid"] == family["node"]).select(F.shiftright("rid", 1).alias("rid"), "label", "family")


def _shared_counts(packed: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The size of each set of a block, and of each intersection of two."""
    own = [unpack(x, np.uint64, True) for x in packed.to_pylist()]
    n = np.array([len(x) for x in own])
    _, number, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(own)), n)
    many = count[number] > 1
    column = (np.cumsum(count > 1) - 1)[number[many]]
    owner = owner[many]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(own), len(own)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        present = np.zeros((len(own), COLUMNS), np.float32)
        present[owner[a:b], column[a:b] - start] = 1
        shared += present @ present.T
    return n, shared.astype(np.int64)


def _meeting(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a block (rid, label, n, l, rest, prefix) that may be linked with one of another class there.

    This is the test of ``_candidates``, on prefixes, for all pairs of the block.
    """

    def run(group: pa.Table) -> pa.Table:
        out = group.select([*keys, "rid", "label"])
        labels, n, least, rest = (group[c].to_numpy().astype(np.int64) for c in ("label", "n", "l", "rest"))
        if (labels == labels[0]).all():
            return out.slice(0, 0)
        shared = _shared_counts(group["prefix"])[1]
        may = shared >= np.minimum(least[:, None], least[None, :])
        may &= (100 + PERCENT) * (shared + np.maximum(rest[:, None], rest[None, :])) >= PERCENT * (n[:, None] + n[None, :])
        may &= 100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :])
        may &= labels[:, None] != labels[None, :]
        return out.filter(pa.array(may.any(axis=1)))

    kinds = dict(blocks.select(*keys, "rid", "label").dtypes)
    return blocks.groupBy(*keys).applyInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def _at_places(places: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of a settled table of places in blocks with what the sets hold; few places are sent to the sets."""
    return sets.join(F.broadcast(places) if places.count() <= FEW_ROWS else places, "rid")


def _block_links(places: DataFrame, keys: list[str], prefixes: DataFrame, sets: DataFrame, settle) -> DataFrame:
    """Links of the blocks that ``places`` (keys, rid, label) name; whole sets travel only where prefixes leave a pair open."""
    places = settle(places, "join-places")
    met = settle(_meeting(_at_places(places, prefixes), keys), "join-places")
    return _compare(_at_places(met, sets), keys)


def _compare(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Links between different classes of a block (rid, label, set), as a forest over its classes."""

    def run(group: pa.Table) -> pa.Table:
        rids, labels = group["rid"].to_numpy(), group["label"].to_numpy()
        if (labels == labels[0]).all():
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        n, shared = _shared_counts(group["set"])
        near = (100 + PERCENT) * shared >= PERCENT * (n[:, None] + n[None, :])
        near &= labels[:, None] != labels[None, :]
        up = {x: x for x in labels.tolist()}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for x, y in np.argwhere(np.triu(near, 1)):
            p, q = top(int(labels[x])), top(int(labels[y]))
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((rids[x], rids[y]))
        return pa.Table.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.groupBy(*keys).applyInArrow(run, "a long, b long")


def _chunk_edges(members: DataFrame, prefixes: DataFrame, sets: DataFrame, settle, salt: int = 0) -> DataFrame:
    """Links inside random chunks of each family: one block per chunk, every prefix sent once, fewer links than documents.

    What belongs together in a family mostly becomes one class here, so few
    documents are left for the blocks of two chunks.
    """
    sizes = settle(members.groupBy("family").agg(F.ceil(F.count("*") / (2 * CHUNK)).alias("n_chunks")), "join-families")
    own = members.join(sizes, "family").withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(salt)), "n_chunks"))
    return _block_links(own.select("rid", "label", "family", "chunk"), ["family", "chunk"], prefixes, sets, settle)


def _block_edges(members: DataFrame, prefixes: DataFrame, sets: DataFrame, settle) -> DataFrame:
    """Links between different classes of a family, as a forest per block of two chunks.

    The largest class of a family is its main side: its members are never
    compared with each other. All others are cut into chunks that meet each
    other and the chunks of the main side. A block compares two chunks by
    counting the shingles that their documents share, first of prefixes.
    """
    sizes = members.groupBy("family", "label").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("family").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    chunks = lambda n: F.greatest(F.ceil(n / CHUNK), F.lit(1)).cast("int")
    mains = settle(mains.select("family", F.col("top.label").alias("main"), chunks(F.col("top.n")).alias("n_main"), chunks(F.col("all") - F.col("top.n")).alias("n_side")), "join-families")
    own = members.join(mains, "family").withColumn("side", F.col("label") != F.col("main"))
    at = F.pmod(F.xxhash64("rid"), F.when(F.col("side"), F.col("n_side")).otherwise(F.col("n_main")).cast("bigint")).cast("int")
    own = own.withColumn("chunk", at)
    other = lambda n: F.sequence(F.lit(0), n - 1)
    here = F.col("chunk")
    with_sides = F.transform(other(F.col("n_side")), lambda j: F.struct(F.lit("s").alias("kind"), F.least(here, j).alias("i"), F.greatest(here, j).alias("j")))
    with_main = F.transform(other(F.col("n_main")), lambda j: F.struct(F.lit("m").alias("kind"), here.alias("i"), j.alias("j")))
    as_main = F.transform(other(F.col("n_side")), lambda i: F.struct(F.lit("m").alias("kind"), i.alias("i"), here.alias("j")))
    blocks = F.when(F.col("side"), F.concat(with_sides, with_main)).otherwise(as_main)
    spread = own.select("rid", "label", "family", F.explode(blocks).alias("block"))
    return _block_links(spread.select("family", "block.kind", "block.i", "block.j", "rid", "label"), ["family", "kind", "i", "j"], prefixes, sets, settle)


def _needed(x: str, y: str):
    """How many prefix tokens two documents must share to be similar enough.

    Of the two prefixes, the one that ends first in the global order has all its
    common tokens inside the other. So the overlap is at most the shared tokens
    plus the larger rest, and at least the smaller l must be shared.
    """
    # 100 |x & y| >= p |x or y|  <=>  (100 + p) |x & y| >= p (|x| + |y|)
    total = F.ceil(PERCENT * (F.col(f"{x}.n") + F.col(f"{y}.n")).cast("long") / (100 + PERCENT))
    return F.greatest(F.least(f"{x}.l", f"{y}.l").cast("long"), total - F.greatest(f"{x}.rest", f"{y}.rest")).cast("int")


def _met(tokens: DataFrame) -> DataFrame:
    """(x, y) structs of members that meet in a token held by few: the lists are shorter than ``HOT``."""
    member = F.struct("rid", "n", "l", "rest", "q", "low")
    lists = tokens.groupBy("token").agg(F.array_sort(F.collect_list(member)).alias("m"))
    later = lambda x: F.filter("m", lambda y: (y["rid"] > x["rid"]) & (x["low"] + y["low"] < 2))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(later(x), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return lists.select(F.inline(pairs))


def _candidates(met: DataFrame) -> DataFrame:
    """Pairs that can be similar enough, from how many prefix tokens they share.

    A pair that needs more than one of the two has at all is not counted. A pair
    that also shares a long list is in one family and has been compared there.
    """
    close = met.where(_close("x.n", "y.n")).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"), _needed("x", "y").alias("need"), F.least("x.q", "y.q").alias("most"))
    shared = close.where("need <= most").groupBy("a", "b", "need").agg(F.count("*").alias("shared"))
    return shared.where("shared >= need").select("a", "b")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose documents are not in one class already."""
    out = pairs
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(f"_node_{end}"), F.col("label").alias(f"_label_{end}"))
        out = out.join(named, out[end] == named[f"_node_{end}"], "left")
    same = F.coalesce("_label_a", "a") == F.coalesce("_label_b", "b")
    return out.where(~same).select("a", "b")


def _open_tokens(tokens: DataFrame, labels: DataFrame | None, settle) -> DataFrame:
    """Tokens whose members are in more than one class, with each member's class."""
    plain = tokens.select("token", "rid", "n", "low")
    if labels is None:
        return plain.withColumn("label", F.col("rid"))
    named = labels.select(F.col("node").alias("_node"), "label")
    now = settle(plain.join(named, plain["rid"] == named["_node"], "left").select("token", "rid", "n", "low", F.coalesce("label", "rid").alias("label")), "join-labelled")
    mixed = settle(now.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token"), "join-open")
    return settle(now.join(mixed, "token"), "join-members")


def link_documents(docs: DataFrame, settle, *, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc, key) and, per key, (key, n_shingles, component_id).

    Every row gets a class. Null and empty texts and texts of white space have
    the key null, an empty set and no links. Ids may be of any type. Texts of fewer than five words have
    one shingle, so they link with equal ones only. Rows with the same words
    share a key whatever their ids; ids may repeat or be null (a class of null
    ids only has a null id). ``component_id`` is the smallest id of the class.
    """
    keep, settle = settle, Scratch(settle)
    shards = settle(encode(docs, doc, text), "join-shards")
    each = shards.select("shard", "row", F.posexplode(F.arrays_zip("docs", "texts")).alias("place", "d"))
    rows = settle(each.select((F.col("row") + F.col("place")).alias("row"), "shard", "place", F.col("d.docs").alias("doc"), F.col("d.texts").alias("key")), "join-rows")
    classes = settle(
        rows.where("key is not null").groupBy("key").agg(F.min("doc").alias("doc"), F.min(F.struct("row", "shard", "place")).alias("r")).select("key", "doc", "r.row", "r.shard", "r.place"),
        "join-classes",
    )
    none = lambda kind: F.lit(None).cast(kind)
    totals = key_totals(shards, settle, "join-words").select("shard", "bucket", "totals", none("int").alias("place"))
    reps = classes.select("shard", none("long").alias("bucket"), none("binary").alias("totals"), "place")
    prefixes = settle(prefix_keys(shards, totals.unionByName(reps)), "join-prefixes")
    answers = key_totals(prefixes, settle, "join-tokens").select("shard", "bucket", "totals")
    emitted = settle(shared_tokens(prefixes, answers), "join-shared")
    settle.release(shards, rows, classes, emitted)
    tokens = emitted.where("token is not null").drop("hot", "prefix")
    banded = _banded(tokens.where(F.col("df") >= HOT), settle)
    many = banded.where(F.col("df") >= HOT)
    # Few documents are in a long list; only their sets are made for the rounds about those.
    ids = settle(many.select("rid").distinct(), "join-ids")
    hot = settle(only_named(emitted.where("token is null and hot").select("rid", "n", "l", "rest", "prefix"), ids), "join-hot")
    few = settle(named_sets(shards, classes, hot.select("rid")), "join-sets")

    labels, edges = None, None
    for step in range(LEADER_ROUNDS):
        pairs = settle(_leader_pairs(_open_tokens(many, labels, settle), step, settle), "join-pairs")
        new = settle(verify(pairs, few), "join-edges")
        edges = new if edges is None else edges.union(new)
        labels = components(edges, settle)
    for edges_of in (_chunk_edges, _block_edges):
        members = settle(_families(_open_tokens(many, labels, settle), settle), "join-members")
        edges = edges.union(settle(edges_of(members, hot, few, settle), "join-edges"))
        labels = components(edges, settle)
    # Edges are few and lie in several tables; the sets and lists of the rounds are read no more.
    edges, labels = settle(edges, "join-edges"), settle(labels, "join-labels")
    settle.release(shards, rows, classes, emitted, banded, edges, labels)
    # Pairs that meet in a long list are settled by now, so only those without one are counted.
    short = tokens.withColumn("low", F.lit(0)).unionByName(banded).where(F.col("df") < HOT)
    pairs = settle(_candidates(_met(short)), "join-pairs")
    pairs = settle(_apart(pairs, labels), "join-pairs")
    settle.release(shards, rows, classes, emitted, edges, pairs)
    sets = settle(named_sets(shards, classes, pairs.select("a"), pairs.select("b")), "join-sets")
    settle.release(rows, classes, emitted, edges, pairs, sets)
    labels = components(edges.union(settle(verify(pairs, sets), "join-edges")), settle)

    sizes = emitted.where("token is null").select("rid", "n")
    named = classes.join(sizes, classes["row"] == sizes["rid"]).join(labels, classes["row"] == labels["node"], "left")
    named = settle(named.select("key", "doc", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "row").alias("label")), "join-named")
    least = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    result = keep(named.join(least, "label").select("key", "n_shingles", "component_id"), "join-result")
    settle.release(rows)
    return rows, result


def document_classes(docs: DataFrame, settle, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (its own id without links)."""
    rows, classes = link_documents(docs, settle, doc=doc, text=text)
    out = rows.join(classes, "key", "left")
    empty = F.col("key").isNull()
    return out.select(
        F.col("doc").alias("doc_id"),
        F.when(empty, F.lit(0).cast("long")).otherwise(F.col("n_shingles")).alias("n_shingles"),
        F.when(empty, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _bitmaps(ids: DataFrame) -> DataFrame:
    """(_bucket, _bits): the row numbers ``id`` as bitmaps; numbers meet by bucket first, so no partial bitmaps travel."""
    placed = ids.select(F.bitmap_bucket_number("id").alias("_bucket"), F.bitmap_bit_position("id").alias("_at")).repartition("_bucket")
    return placed.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def _marked(numbered: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows whose ``_row`` is set in settled ``bitmaps``.

    A join by number would shuffle every text; a bit a row is sent to the texts
    instead, which stay where they are.
    """
    few = bitmaps.count() <= FEW_BITMAPS
    at = F.bitmap_bit_position("_row")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = numbered.withColumn("_at", F.bitmap_bucket_number("_row"))
    both = placed.join(F.broadcast(bitmaps) if few else bitmaps, F.col("_at") == F.col("_bucket"))
    return both.where(F.getbit(byte, (at % 8).cast("int")) == 1)


def keep_first(docs: DataFrame, settle, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of linked documents, with the columns of ``docs``.

    The row with the smallest id stays (rows with an id before those without;
    of equal ids any one). Rows without words have no links and all stay.
    """
    keep, settle = settle, Scratch(settle)
    # The number of a row holds while the same settled rows are read in the same pieces, so it is written with them.
    names = [f"_c{i}" for i in range(len(docs.columns))]
    numbered = keep(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()), "join-numbered")
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    plain = numbered.select(F.col("_row").alias("id"), F.col(at[text]).alias("text"))
    rows, classes = link_documents(plain, settle, doc="id", text="text")
    # Within a class: by document id, then by row.
    ids = numbered.select(F.col("_row").alias("id"), F.col(at[doc]).alias("own"))
    named = rows.where("key is not null").join(classes.select("key", "component_id"), "key").join(ids, F.col("doc") == F.col("id"))
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "id"))["id"].alias("id"))
    kept = keep(_bitmaps(first.select("id").union(rows.where("key is null").select(F.col("doc").alias("id")))), "join-kept")
    settle.release()
    return _marked(numbered, kept).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
