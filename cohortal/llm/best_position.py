"""Ranked lexical search by the Best Position Algorithm.

Documents are indexed in shards: whole documents in the order of their ids,
with the counts of the terms that the query block asks for. Once the corpus
counts are known, every shard turns its counts into impact lists, one per term,
highest impact first. A search reads the lists of a query in parallel; for every
document it meets, it looks up the document's impacts directly and marks their
places in all lists as seen. The best position of a list is the end of its
unbroken stretch of seen places. No document unseen so far can score more than
the impacts at the best positions add up to, and this bound is never above the
one from the places read last. A search stops when the bound is strictly below
the k-th score, so equal scores are never lost, or when its lists are seen whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from cohortal.llm.words import small_batches, text_bytes

TOP = 10
FIRST_DEPTH = 32  # places read of every list in the first round; each round reads twice as many
SHARD_POSTINGS = 1 << 21  # counts of a shard, closed at the next document
BLOCK_BYTES = 1 << 20  # query text handled in one pass over the documents, which bounds what is broadcast
MERGE_SALTS = 64

# Terms: digits, letters (A-Z lower-cased) and everything beyond ASCII.
_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes, A-Z lower-cased."""
    return text.translate(_CLEAN).split()


@dataclass
class Corpus:
    """Counts over all documents: those with a term, all their terms, and documents holding each query term."""

    n_docs: int
    n_terms: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * int(d) + 1))) for d in self.df], np.int64)

    def norms(self, sizes: np.ndarray) -> np.ndarray:
        return 100 - 90 + (90 * sizes.astype(np.int64) * self.n_docs) // max(self.n_terms, 1)


class ImpactLists:
    """The impact lists of a shard with direct access by document."""

    def __init__(self, begins: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_lists: int):
        """Per document its postings ``begins[d]`` to ``begins[d + 1]``: term numbers and impacts."""
        self.begins, self.terms, self.impacts = begins, terms, impacts
        self.n_docs = len(begins) - 1
        docs = np.repeat(np.arange(self.n_docs), np.diff(begins))
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.listed = docs[order], impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_lists + 1))
        self.place = np.empty(len(order), np.int64)  # of each posting in its list
        self.place[order] = np.arange(len(order))
        self._unseen = np.ones(len(order), bool)
        self._wanted = np.zeros(n_lists, bool)

    def search(self, query: np.ndarray, k: int = TOP) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of the k best (higher score, then lower number), and how many documents were looked up.

        ``query`` holds distinct term numbers. Documents with score 0 are never returned.
        """
        begin, end = self.starts[query], self.starts[query + 1]
        query, begin, end = query[end > begin], begin[end > begin], end[end > begin]
        live = self.listed[begin] > 0
        query, begin, end = query[live], begin[live], end[live]
        best_docs, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(query):
            return best_docs, best, 0
        self._wanted[query] = True
        met = np.zeros(self.n_docs, bool)
        first_unseen = begin.copy()
        depth, step, looked_up = 0, FIRST_DEPTH, 0
        while True:
            # Sorted access to the next places of every list.
            read = [self.docs[b + depth : min(b + depth + step, e)] for b, e in zip(begin, end) if b + depth < e]
            met_now = np.unique(np.concatenate(read)) if read else np.zeros(0, np.int64)
            fresh = met_now[~met[met_now]]
            if len(fresh):
                met[fresh] = True
                looked_up += len(fresh)
                scores = self._look_up(fresh)
                docs, values = np.concatenate((best_docs, fresh)), np.concatenate((best, scores))
                if len(values) > k:
                    cut = np.partition(values, len(values) - k)[len(values) - k]
                    docs, values = docs[values >= cut], values[values >= cut]
                top = np.lexsort((docs, -values))[:k]
                best_docs, best = docs[top], values[top]
            depth += step
            step *= 2
            bound = 0
            for j in range(len(query)):
                if first_unseen[j] < end[j]:
                    rest = self._unseen[first_unseen[j] : end[j]]
                    ahead = int(rest.argmax())
                    first_unseen[j] = first_unseen[j] + ahead if rest[ahead] else end[j]
                if first_unseen[j] < end[j]:
                    # The first places are always read, so a best position exists.
                    bound += int(self.listed[first_unseen[j] - 1])
            if bound == 0 or (len(best) >= k and bound < best[-1]):
                break
        for b, e in zip(begin, end):
            self._unseen[b:e] = True
        self._wanted[query] = False
        return best_docs, best, looked_up

    def _look_up(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents, marking the places of their impacts in the query's lists."""
        counts = self.begins[docs + 1] - self.begins[docs]
        own = np.repeat(np.arange(len(docs)), counts)
        rows = np.arange(int(counts.sum())) + np.repeat(self.begins[docs] - (np.cumsum(counts) - counts), counts)
        hit = self._wanted[self.terms[rows]]
        rows, own = rows[hit], own[hit]
        self._unseen[self.place[rows]] = False
        # Sums stay far below 2^53, so doubles add them exactly.
        return np.bincount(own, self.impacts[rows], len(docs)).astype(np.int64)


def impacts_of(counts: np.ndarray, norms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * counts.astype(np.int64)) // (1000 * counts.astype(np.int64) + 8 * norms))


def _shards(docs: DataFrame, doc: str, text: str, vocabulary) -> DataFrame:
    """Postings of the vocabulary's terms in shards of whole documents, ids ascending, null first."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc).alias("doc"), text_bytes(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        ids: list[pa.Array] = []
        sizes: list[int] = []
        held: list[int] = []
        terms: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        postings = 0

        def shard() -> pa.RecordBatch:
            named = pa.concat_arrays(ids)
            order = pc.array_sort_indices(named, null_placement="at_start").to_numpy() if not pa.types.is_nested(named.type) else np.arange(len(named))
            sizes_, held_ = np.array(sizes, np.int64)[order], np.array(held, np.int64)
            ends = np.cumsum(held_)
            pick = np.concatenate([np.arange(ends[k] - held_[k], ends[k]) for k in order]) if postings else np.zeros(0, np.int64)
            all_terms = np.concatenate(terms)[pick] if postings else np.zeros(0, np.int32)
            columns = [
                pa.array([int((sizes_ > 0).sum())], pa.int64()),
                pa.array([int(sizes_.sum())], pa.int64()),
                pa.ListArray.from_arrays([0, len(named)], named.take(pa.array(order))),
                *(pa.array([x.tobytes()], pa.binary()) for x in (
                    sizes_.astype(np.int32), held_[order].astype(np.int32), all_terms,
                    np.concatenate(counts)[pick] if postings else np.zeros(0, np.int32),
                )),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["n_docs", "n_terms", "docs", "sizes", "held", "terms", "counts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = 0
            for k, raw in enumerate(batch.column(1)):
                words = terms_of(raw.as_py())
                own = [(number[w], n) for w, n in Counter(words).items() if w in number]
                sizes.append(len(words))
                held.append(len(own))
                if own:
                    pairs = np.array(own, np.int32)
                    terms.append(pairs[:, 0])
                    counts.append(pairs[:, 1])
                    postings += len(own)
                if postings >= SHARD_POSTINGS:
                    ids.append(batch.column(0).slice(at, k + 1 - at))
                    at = k + 1
                    yield shard()
                    ids, sizes, held, terms, counts, postings = [], [], [], [], [], 0
            if at < batch.num_rows:
                ids.append(batch.column(0).slice(at))
        if sizes:
            yield shard()

    schema = f"n_docs long, n_terms long, docs array<{kind}>, sizes binary, held binary, terms binary, counts binary"
    return rows.mapInArrow(run, schema)


def _document_counts(shards: DataFrame, n: int) -> np.ndarray:
    """In how many documents each of the ``n`` query terms occurs; each shard adds its own up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer(), np.int32), minlength=n)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["term", "n"])

    out = np.zeros(n, np.int64)
    for r in shards.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def _blocks(queries: DataFrame, item: str, text: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The queries with their distinct terms, in blocks of about ``BLOCK_BYTES`` of text."""
    rows = queries.select(F.col(item).alias("item"), text_bytes(text).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // BLOCK_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, list(dict.fromkeys(terms_of(bytes(r.text))))) for r in part.collect()]


def top_ranked(rows: DataFrame, k: int, group: Sequence[str], doc: str, score: str, spread: int = MERGE_SALTS) -> DataFrame:
    """The k highest scores of each group with their ``rank``; equal scores by ascending id.

    A first cut in ``spread`` parts of every group keeps the last task of a group small.
    """
    order = [F.col(score).desc(), F.col(doc).asc_nulls_first()]
    salt = F.pmod(F.xxhash64(doc), F.lit(spread))
    for keys in ([*group, salt], group):
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return rows


def rank_documents(
    docs: DataFrame, queries: DataFrame, settle, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = TOP
) -> DataFrame:
    """(item, rank, doc, score): each query's ``k`` best documents with a score above 0, all if there are fewer.

    Every document is searched. A null text, of a document or a query, has no
    terms; a query without terms or without a matching document has no rows.
    Equal scores rank by ascending id, null first; repeated documents are rows
    of their own and repeated queries are answered one by one, as rows of equal
    item and rank. Ids are carried as they are, in columns named ``doc`` and
    ``item``; other columns are not read. Queries come in blocks of bounded
    size, one pass over the documents each.
    """
    context = docs.sparkSession.sparkContext
    kinds = (queries.schema[item].dataType.simpleString(), docs.schema[doc].dataType.simpleString())
    out = None
    for block in _blocks(queries, item, item_text):
        number: dict[bytes, int] = {}
        asked = [np.array([number.setdefault(w, len(number)) for w in terms], np.int64) for _, terms in block]
        shards = settle(_shards(docs, doc, text, context.broadcast(number)), "impact-shards")
        totals = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        corpus = Corpus(totals[0] or 0, totals[1] or 0, _document_counts(shards, len(number)))
        found = _search(shards, context.broadcast((corpus, corpus.weights(), asked)), kinds[1], k)
        merged = top_ranked(found, k, ["query"], "doc", "score")
        names = docs.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"query int, item {kinds[0]}")
        part = merged.join(F.broadcast(names), "query").select(F.col("item").alias(item), "rank", F.col("doc").alias(doc), "score")
        out = part if out is None else out.unionAll(part)
    return out


def _search(shards: DataFrame, shared, kind: str, k: int) -> DataFrame:
    """The k best documents of every query in every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, weights, asked = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                sizes, held, terms, counts = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in range(1, 5))
                begins = np.concatenate(([0], np.cumsum(held, dtype=np.int64)))
                norms = np.repeat(corpus.norms(sizes), held)
                lists = ImpactLists(begins, terms, impacts_of(counts, norms, weights[terms]), len(weights))
                queries, docs, scores = [], [], []
                for number, query in enumerate(asked):
                    best, values, _ = lists.search(query, k)
                    queries.append(np.full(len(best), number, np.int32))
                    docs.append(best)
                    scores.append(values)
                names = batch.column(0)[row].values.take(pa.array(np.concatenate(docs))) if docs else batch.column(0)[row].values.slice(0, 0)
                empty = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([empty.astype(np.int32), *queries])), names, pa.array(np.concatenate([empty, *scores]))], names=["query", "doc", "score"]
                )

    return shards.select("docs", "sizes", "held", "terms", "counts").mapInArrow(run, f"query int, doc {kind}, score long")
