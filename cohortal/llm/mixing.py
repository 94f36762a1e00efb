"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, its documents in a fixed pseudorandom order, form one
stream that is packed into blocks of equal length. Output shards draw how many
blocks they take from each source; the draws of a source are numbered across
shards, number j takes block perm(j mod blocks) of pass j div blocks, and the
blocks are joined by (source, index).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating, null last
MOST_PASSES = 3  # no source, and so no document, is taken more often
BLOCK_WORDS = 64
SHARD_BLOCKS = 1024
BUCKET_ROWS = 20_000  # documents that are numbered in one task
SHARDS_PER_RANGE = 1000  # shards whose draws are numbered in one task
SEED = "mix"

#: Multipliers of the index permutations: fixed primes.
PRIMES = (982451653, 899809363, 797003437, 715225739, 633910099, 573259391, 472882027, 413158511)

_WORD = r"[^\x20\x09-\x0D]+"
_FIRST = W.unboundedPreceding


def hashed(*parts: Column | str) -> Column:
    """31 bits from the MD5 of the parts joined by ``:``."""
    text = F.concat_ws(":", F.lit(SEED), *parts)
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), 1)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sizes_of(docs: DataFrame, text: str = "text", source: str = "source", doc: str = "doc_id", *carried: str) -> DataFrame:
    """doc_id, source, size (words, null: 0), a source key that is never null and a hash for the order."""
    out = docs.select(
        *carried,
        F.col(doc).alias("doc_id"),
        F.col(source).alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(_WORD)).cast("long").alias("size"),
    )
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return out.withColumns({"key": key, "place": hashed(_text("doc_id"), F.col("size").cast("string"))})


def source_targets(sizes: DataFrame) -> DataFrame:
    """key, source_size, target, n_blocks and the share of blocks of each source: one row per source.

    A target is weight x level, or three times the source's size where that is
    less. Sources that reach the limit come first in the order of limit over
    weight, so one pass over that order finds the level.
    """
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    # "n" sorts before "s": the null source is put last.
    rank = F.row_number().over(W.orderBy((F.col("key") == "n").cast("int"), "key")) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = per.withColumn("weight", F.element_at(weights, (rank % len(WEIGHTS) + 1).cast("int")))
    everything = W.partitionBy()
    by_limit = W.orderBy(F.col("source_size") / F.col("weight"), "key")
    before = by_limit.rowsBetween(_FIRST, -1)
    limit = F.col("source_size") * float(MOST_PASSES)
    per = per.withColumns({
        "limit": limit,
        "level": (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    })
    free = F.col("limit") >= F.col("level") * F.col("weight")
    level = F.min(F.when(free, F.struct(F.col("source_size") / F.col("weight"), F.col("key"), F.col("level")))).over(everything)["level"]
    per = per.withColumn("target", F.least("limit", F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    per = per.withColumn("n_blocks", blocks.cast("long"))
    # Blocks wanted: the last block of a source may be short.
    per = per.withColumn("wanted", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0))
    total = F.sum("wanted").over(everything)
    by_key = W.orderBy("key").rowsBetween(_FIRST, 0)
    per = per.withColumns({"n_slots": F.round(total).cast("long"), "share": F.when(total > 0, F.col("wanted") / total).otherwise(0.0)})
    each = F.floor(F.col("share") * SHARD_BLOCKS)
    # What the whole parts leave of a shard is drawn; the draw's upper end of each source, scaled to 1.
    rest = F.col("share") * SHARD_BLOCKS - each
    end = F.sum(rest).over(by_key) / F.nullif(F.sum(rest).over(everything), F.lit(0.0))
    left = (F.lit(SHARD_BLOCKS) - F.sum(each).over(everything)).cast("long")
    return per.select("key", "source_size", "target", "n_blocks", "n_slots", each.cast("long").alias("each"), (end - rest / F.nullif(F.sum(rest).over(everything), F.lit(0.0))).alias("draw_from"), end.alias("draw_to"), left.alias("drawn"))


def _running(df: DataFrame, value: str, bucket: str, order: list, name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the key: bucket totals first, then rows within a bucket."""
    totals = df.groupBy("key", bucket).agg(F.sum(value).alias("_total"))
    starts = totals.select("key", bucket, F.coalesce(F.sum("_total").over(W.partitionBy("key").orderBy(bucket).rowsBetween(_FIRST, -1)), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum(value).over(W.partitionBy("key", bucket).orderBy(*order).rowsBetween(_FIRST, -1)), F.lit(0))
    return df.withColumn("_within", within).join(starts, ["key", bucket]).withColumn(name, F.col("_start") + F.col("_within")).drop("_start", "_within")


def draw_counts(targets: DataFrame) -> DataFrame:
    """(shard, key, slots, first): how many blocks each shard takes of each source, and their first number.

    Every shard takes the whole part of its expected counts and draws the few
    blocks that are left from a multinomial over the fractional parts. The last
    shard, which may be short, takes its slots in source order of the same draw.
    """
    spark = targets.sparkSession
    n_slots = targets.agg(F.max("n_slots")).first()[0] or 0
    n_shards = -(-n_slots // SHARD_BLOCKS)
    shards = spark.range(n_shards).select(F.col("id").alias("shard"))
    drawn = targets.agg(F.max("drawn")).first()[0] or 0
    parts = targets.select("key", "each", "draw_from", "draw_to", "n_blocks")
    # A few numbers per shard; the sources' table is joined by range of a coarse cell, never crossed.
    draws = shards.select("shard", F.explode(F.sequence(F.lit(1), F.lit(int(drawn)))).alias("draw")) if drawn > 0 else shards.limit(0).withColumn("draw", F.lit(1))
    draws = draws.withColumn("u", hashed(F.col("shard").cast("string"), F.col("draw").cast("string")) / float(1 << 31)).withColumn("cell", F.floor(F.col("u") * 1024))
    last = F.least(F.floor(F.col("draw_to") * 1024), F.lit(1023))
    cells = parts.where("draw_to > draw_from").withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("draw_from") * 1024), F.lit(1023)), last)))
    hit = (F.col("u") >= F.col("draw_from")) & (F.col("u") < F.col("draw_to"))
    extra = draws.join(cells, "cell").where(hit).groupBy("shard", "key").agg(F.count("*").alias("slots"))
    # Whole parts: one row per source and range of shards, expanded to the shards of that range.
    n_ranges = -(-n_shards // SHARDS_PER_RANGE)
    spread = parts.where("each > 0").withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(max(n_ranges - 1, 0)))))
    first = F.col("range") * SHARDS_PER_RANGE
    base = spread.withColumn("shard", F.explode(F.sequence(first, F.least(first + SHARDS_PER_RANGE, F.lit(n_shards)) - 1))) if n_shards else spread.withColumn("shard", F.lit(0)).limit(0)
    whole = base.select(F.col("shard").cast("long").alias("shard"), "key", F.col("each").alias("slots")).unionByName(extra)
    counts = whole.groupBy("shard", "key").agg(F.sum("slots").alias("slots"))
    # The last shard: cut after its slots, sources in key order.
    room = n_slots - (n_shards - 1) * SHARD_BLOCKS
    before = F.coalesce(F.sum("slots").over(W.orderBy(hashed("key"), "key").rowsBetween(_FIRST, -1)), F.lit(0))
    final = counts.where(F.col("shard") == n_shards - 1).withColumn("slots", F.greatest(F.least(F.round((before + F.col("slots")) * (room / SHARD_BLOCKS)) - F.round(before * (room / SHARD_BLOCKS)), F.col("slots")), F.lit(0)).cast("long"))
    counts = counts.where(F.col("shard") < n_shards - 1).unionByName(final.select("shard", "key", "slots"))
    counts = counts.withColumn("range", F.floor(F.col("shard") / SHARDS_PER_RANGE))
    return _running(counts, "slots", "range", ["shard"], "first")


def slots_of(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(shard, key, number, pass, block): every slot with the block it takes.

    The permutation of a pass maps i to (prime x i + offset) mod blocks, where
    the prime (none that divides the number of blocks) and the offset are picked
    by a hash of source and pass; each pass takes every block once. Numbers
    beyond the third pass stay empty.
    """
    slots = counts.where("slots > 0").withColumn("number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("slots") - 1)))
    slots = slots.join(targets.select("key", "n_blocks"), "key").where(F.col("number") < MOST_PASSES * F.col("n_blocks"))
    slots = slots.withColumn("pass", F.floor(F.col("number") / F.col("n_blocks")))
    fitting = F.filter(F.array(*[F.lit(p).cast("long") for p in PRIMES]), lambda p: F.col("n_blocks") % p != 0)
    named = (F.col("key"), F.col("pass").cast("string"))
    prime = F.get(fitting, (hashed(F.lit("a"), *named) % F.size(fitting)).cast("int")).cast("decimal(18,0)")
    place = (F.col("number") % F.col("n_blocks")).cast("decimal(19,0)")
    offset = hashed(F.lit("b"), *named) % F.col("n_blocks")
    block = ((prime * place + offset.cast("decimal(19,0)")) % F.col("n_blocks").cast("decimal(19,0)")).cast("long")
    return slots.select("shard", "key", "number", "pass", block.alias("block"))


@dataclass
class Mix:
    """Everything a mix decides: documents with their place in the stream, targets and slots."""

    documents: DataFrame
    targets: DataFrame
    slots: DataFrame

    def doc_blocks(self) -> DataFrame:
        """(row, key, block, words): the blocks each document has words in."""
        begin, end = F.col("begin"), F.col("begin") + F.col("size")
        rows = self.documents.where("size > 0").withColumn(
            "block", F.explode(F.sequence(F.floor(begin / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS)))
        )
        words = F.least(end, (F.col("block") + 1) * BLOCK_WORDS) - F.greatest(begin, F.col("block") * BLOCK_WORDS)
        return rows.select("row", "key", "block", words.alias("words"))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: one row per document."""
        times = self.slots.groupBy("key", "block").agg(F.count("*").alias("times"))
        got = self.doc_blocks().join(times, ["key", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        return (
            self.documents.join(got, "row", "left")
            .join(self.targets.select("key", "source_size", "target"), "key")
            .select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        )


def mix_sources(docs: DataFrame, settle, *, text: str = "text", source: str = "source", doc: str = "doc_id") -> Mix:
    """Plan a mix of all ``docs``.

    ``settle`` writes an intermediate table and reads it back. Null texts have
    no words, the null source is a source of its own and comes last, repeated
    rows count each, null ids are fine. An empty table gives empty results.
    Documents are ordered by a hash, so reruns agree.
    """
    return _planned(settle(sizes_of(docs, text, source, doc).withColumn("row", F.monotonically_increasing_id()), "mix-sizes"), settle)


def _planned(rows: DataFrame, settle) -> Mix:
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    targets = settle(source_targets(rows), "mix-targets")
    placed = rows.withColumn("bucket", F.floor(F.col("place") * buckets / float(1 << 31)))
    placed = _running(placed, "size", "bucket", ["place", "doc_id", "size", "row"], "begin")
    documents = settle(placed.select("row", "doc_id", "key", "size", "begin"), "mix-documents")
    return Mix(documents, targets, slots_of(draw_counts(targets), targets))


def cut_pieces(placed: DataFrame) -> DataFrame:
    """(key, block, at, row, doc_id, n, words): the words each document has in each block of its source.

    ``placed`` has row, doc_id, key, size, begin and text. The text is cut into
    words once; the outer lambda holds them while the blocks are cut from it.
    """
    begin, end = F.col("begin"), F.col("begin") + F.col("size")
    blocks = F.sequence(F.floor(begin / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS))

    def piece(words: Column, block: Column) -> Column:
        first = F.greatest(begin, block * BLOCK_WORDS)
        n = (F.least(end, (block + 1) * BLOCK_WORDS) - first).cast("int")
        own = F.array_join(F.slice(words, (first - begin + 1).cast("int"), n), " ")
        return F.struct(block.alias("block"), (first - block * BLOCK_WORDS).cast("int").alias("at"), n.alias("n"), own.alias("words"))

    words = F.array(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))
    cut = F.element_at(F.transform(words, lambda w: F.transform(blocks, lambda b: piece(w, b))), 1)
    return placed.where("size > 0").select("key", "row", "doc_id", F.inline(cut))


def mix_blocks(docs: DataFrame, settle, *, text: str = "text", source: str = "source", doc: str = "doc_id") -> DataFrame:
    """The mixed data: shard, slot, source, block, n_words, words, parts; one row per slot of a shard.

    ``words`` are the words of one block, joined by a space: ``BLOCK_WORDS`` of
    them, fewer in the last block of a source. ``parts`` says which rows they
    come from, in order: row, doc_id and number of words. Slots of a shard are
    in a fixed pseudorandom order, numbered from 0. The plan is that of
    ``mix_sources``, with the same results for nulls, repeated rows and empty
    tables. A text travels once, to its place in the stream, and its pieces
    once, to their block; a block has at most ``BLOCK_WORDS`` pieces.
    """
    named = docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = settle(named.withColumn("row", F.monotonically_increasing_id()), "mix-texts")
    plan = _planned(settle(sizes_of(texts, "text", "source", "doc_id", "row"), "mix-sizes"), settle)
    pieces = cut_pieces(plan.documents.join(texts.select("row", "text"), "row"))
    parts = F.sort_array(F.collect_list(F.struct("at", "row", "doc_id", "n", "words")))
    packed = pieces.groupBy("key", "block").agg(parts.alias("parts"))
    order = W.partitionBy("shard").orderBy(hashed(F.lit("o"), F.col("shard").cast("string"), "key", F.col("number").cast("string")), "key", "number")
    slots = plan.slots.withColumn("slot", F.row_number().over(order) - 1)
    return slots.join(packed, ["key", "block"]).select(
        "shard",
        "slot",
        F.when(F.col("key") != "n", F.substring("key", F.lit(2), F.length("key"))).alias("source"),
        "block",
        F.aggregate("parts", F.lit(0), lambda n, p: n + p["n"]).alias("n_words"),
        F.array_join(F.transform("parts", lambda p: p["words"]), " ").alias("words"),
        F.transform("parts", lambda p: F.struct(p["row"], p["doc_id"], p["n"])).alias("parts"),
    )


def taken_from(blocks: DataFrame) -> DataFrame:
    """(row, doc_id, taken): the words that mixed blocks hold of each document; documents without any are left out."""
    return blocks.select(F.inline("parts")).groupBy("row", "doc_id").agg(F.sum("n").alias("taken"))
