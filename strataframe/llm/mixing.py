"""Mixing sources to target weights, with DataFrame functions only.

Multivariate-hypergeometric splitting tree. The documents of a source, in a pseudo-random order, are one stream of words
cut into blocks. A source with target t and size T gives its stream floor(t / T) times whole, and of one more pass
the first words in a permuted order of blocks. The blocks drawn from all sources are dealt to shards: the root
holds the exact quota of each source; a node halves its shards, draws from the multivariate hypergeometric
distribution how many of each source's blocks go left, and gives the rest right. A leaf is a shard's quota; it takes that many
of each source's permuted blocks, disjoint from all other shards', and orders them by a hash.

Word positions come from two sums, over hash buckets of a source and within a bucket, so a source with a third of all rows
is spread over ``BUCKETS`` groups.

Defined results: a null or blank text has size 0 and is never taken; a null source is a source, last in order; rows that share a
doc_id are rows of their own; a source of size 0 has target 0; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strataframe.llm.shared import Scratch
from strataframe.llm.special import bound, hypergeometric

#: Words of a block, hash buckets of a source's order, words of a shard.
BLOCK = 1024
BUCKETS = 4096
SHARD_WORDS = 1 << 22
SPACES = "\\x20\\x09-\\x0D"
#: Any prime above the number of blocks of a source; multiplying by it permutes them.
PRIME = (1 << 31) - 1


def word_count(text: Column) -> Column:
    """Runs of anything but space and the characters tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], total_share: float, most_times: float) -> DataFrame:
    """``source``, ``source_size``, ``target`` per source, from ``source``, ``source_size``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``total_share`` times all words; a target stops
    at ``most_times`` its source's size and the excess is shared again by weight. Water filling: sources reach their limit in the
    order of limit / weight, so one ordered pass finds where it stops.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * float(most_times)
    every = Window.partitionBy()
    filled = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        sizes.withColumn("weight", weight).withColumn("limit", limit)
        .withColumn("total", F.sum("source_size").over(every) * float(total_share))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("full", F.coalesce(F.sum("limit").over(filled), F.lit(0.0)))
        .withColumn("full_weight", F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
        # Water level if this source and all later ones were below their limits.
        .withColumn("level", (F.col("total") - F.col("full")) / (F.col("all_weight") - F.col("full_weight")))
        .withColumn("open_level", F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.col("level")))
    )
    # Levels rise up to the first source that stays below its limit and fall from there.
    level = F.max(F.col("open_level")).over(every)
    target = F.when(level.isNull(), F.col("limit")).otherwise(F.least("limit", level * F.col("weight")))
    return parts.select("source", "source_size", target.alias("target"))


def _uniform(*parts) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _halves(node: DataFrame, width: int, seed: int) -> DataFrame:
    """One level of the tree: both halves of every node, their blocks by source drawn from the multivariate hypergeometric distribution."""
    def split(acc, q):
        taken = hypergeometric(acc["rest"], q["blocks"], acc["room"], _uniform(F.lit(seed), F.col("node"), F.lit(width), q["source"]))
        return bound(taken, lambda t: F.struct((acc["rest"] - q["blocks"]).alias("rest"), (acc["room"] - t).alias("room"),
                                               F.concat(acc["out"], F.array(t)).alias("out")))

    left = F.floor(F.col("held") / 2).cast("long")
    start = F.struct(F.col("held").alias("rest"), left.alias("room"), F.array().cast("array<long>").alias("out"))

    def children(go):
        quota = lambda n: F.transform("quota", lambda q, i: F.struct(q["last"], q["source"], n(q["blocks"], F.get(go, i)).alias("blocks")))
        return F.array(
            F.struct((F.col("node") * 2).alias("node"), quota(lambda b, g: g).alias("quota"), left.alias("held")),
            F.struct((F.col("node") * 2 + 1).alias("node"), quota(lambda b, g: b - g).alias("quota"), (F.col("held") - left).alias("held")))

    return node.select(F.explode(bound(F.aggregate("quota", start, split, lambda acc: acc["out"]), children)).alias("n")).select("n.*")


def shard_quotas(quotas: DataFrame, shards: int, seed: int, scratch: Scratch) -> DataFrame:
    """``shard``, ``source``, ``first``, ``count``: the source's draws ``first`` to ``first + count - 1`` go to the shard.

    ``quotas``: ``source``, ``blocks``. ``shards`` is a power of two. Every level of the tree is a written table, so no
    plan holds more than one.
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "blocks"))).alias("quota")).select(
        F.lit(0).cast("long").alias("node"), "quota", F.aggregate("quota", F.lit(0).cast("long"), lambda s, q: s + q["blocks"]).alias("held"))
    node = scratch.write(node, "tree")
    width = shards
    while width > 1:
        node = _halves(node, width, seed)
        # Rows double at each level; from here on tasks share them.
        node = scratch.write(node.repartition("node") if shards // width >= 128 else node, "tree")
        width //= 2
    leaves = node.select(F.col("node").alias("shard"), F.explode("quota").alias("q")).select("shard", "q.source", F.col("q.blocks").alias("count"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).where("count > 0")


class Mix:
    """A mix of ``docs`` (doc_id, text, source): ``documents`` with what is taken of each, and ``pieces`` by shard and order."""

    def __init__(self, docs: DataFrame, scratch: Scratch, *, weights: Sequence[float], total_share: float, most_times: float, seed: int = 20):
        spread = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
        rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), spread.alias("spread"))
        rows = scratch.write(rows.withColumn("bucket", F.pmod("spread", F.lit(BUCKETS)).cast("int")), "sizes")
        self._scratch = scratch
        buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
        targets = source_targets(sizes, weights, total_share, most_times)
        target = F.round("target").cast("long")
        passes = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0).cast("long")
        full = F.floor(F.col("source_size") / BLOCK).cast("long")
        plan = (
            targets.withColumn("passes", passes)
            .withColumn("rest", target - F.col("passes") * F.col("source_size"))
            .withColumn("full", full)
            .withColumn("per_pass", F.ceil(F.col("source_size") / BLOCK).cast("long"))
            .withColumn("blocks", F.col("passes") * F.col("per_pass") + F.ceil(F.col("rest") / BLOCK).cast("long"))
        )
        self.plan = plan = scratch.write(plan, "plan")
        start = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = buckets.withColumn("before", F.coalesce(F.sum("words").over(start), F.lit(0))).select("source", "bucket", "before")
        named = (starts.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
                 .select("b.source", "b.bucket", "b.before", "p.source_size", "p.target", "p.passes", "p.rest", "p.full", "p.per_pass", "p.blocks"))
        order = Window.partitionBy("source", "bucket").orderBy("spread", "doc_id")
        before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # The number tells repeated rows without words apart, which start at one place.
        placed = rows.withColumn("inside", before).withColumn("row", F.row_number().over(order))
        placed = (placed.alias("r").join(named.alias("n"), F.col("r.source").eqNullSafe(F.col("n.source")) & (F.col("r.bucket") == F.col("n.bucket")))
                  .select("doc_id", "r.source", "size", "r.bucket", "row", (F.col("before") + F.col("inside")).alias("start"), "source_size", "target",
                          "passes", "rest", "full", "per_pass", "blocks"))
        self._placed = placed

    def _blocks(self) -> DataFrame:
        """Each document by the blocks it lies in, with the block's number in the permuted order and the words drawn in the last pass."""
        end = F.col("start") + F.col("size")
        spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))).otherwise(F.array().cast("array<bigint>"))
        out = self._placed.withColumn("block", F.explode_outer(spans))
        # Whole blocks are permuted; a shorter last block stays last.
        draw = F.when(F.col("block") < F.col("full"), F.pmod(F.col("block") * PRIME + 12345, F.col("full"))).otherwise(F.col("block"))
        low = F.greatest("start", F.col("block") * BLOCK)
        high = F.least(end, (F.col("block") + 1) * BLOCK)
        return (
            out.withColumn("draw", draw)
            .withColumn("low", low).withColumn("words", F.coalesce(high - low, F.lit(0)))
            .withColumn("open", F.least(F.lit(BLOCK), F.greatest(F.lit(0), F.col("rest") - F.col("draw") * BLOCK)))
            .withColumn("last_words", F.coalesce(F.greatest(F.lit(0), F.least(high, F.col("block") * BLOCK + F.col("open")) - low), F.lit(0)))
        )

    def _shard_count(self, shard_words: int) -> int:
        blocks = self.plan.agg(F.sum("blocks")).first()[0] or 0
        count = 1
        while count * shard_words < blocks * BLOCK:
            count *= 2
        return count

    def shards(self, seed: int = 21, shard_words: int = SHARD_WORDS) -> DataFrame:
        """``shard``, ``source``, ``first``, ``count``: the quota of each shard as a range of the source's draws."""
        return shard_quotas(self.plan.select("source", "blocks"), self._shard_count(shard_words), seed, self._scratch)

    def _dealt(self, seed: int, shard_words: int) -> DataFrame:
        """Every document by block and pass, with the shard that took the block, if any.

        A source's draws are cut into as many equal cells as there are shards; a quota is sent to the few cells it reaches, and a block is
        looked up in the quotas of its cell.
        """
        count = self._shard_count(shard_words)
        quotas = shard_quotas(self.plan.select("source", "blocks"), count, seed, self._scratch)
        cell = lambda number: F.floor(number / F.ceil(F.col("blocks") / count)).cast("long")
        reach = F.explode(F.sequence(cell(F.col("first")), cell(F.col("first") + F.col("count") - 1)))
        quotas = quotas.alias("q").join(self.plan.alias("p"), F.col("q.source").eqNullSafe(F.col("p.source"))).select(
            "q.*", "p.blocks").withColumn("cell", reach).drop("blocks")
        quotas = self._scratch.write(quotas, "quotas")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))
        rows = self._blocks().withColumn("pass", each)
        rows = rows.withColumn("words", F.when(F.col("pass") == F.col("passes"), F.col("last_words")).otherwise(F.col("words")))
        rows = rows.withColumn("number", F.when(F.col("words") > 0, F.col("pass") * F.col("per_pass") + F.col("draw")))
        rows = rows.withColumn("cell", cell(F.col("number")))
        return rows.alias("r").join(
            quotas.alias("d"), F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col("r.cell") == F.col("d.cell"))
            & (F.col("r.number") >= F.col("d.first")) & (F.col("r.number") < F.col("d.first") + F.col("d.count")), "left",
        ).select("r.*", "shard")

    def pieces(self, seed: int = 21, shard_words: int = SHARD_WORDS) -> DataFrame:
        """The mix: ``shard``, ``place`` (order within the shard), ``doc_id``, ``source``, ``pass``, ``from_word``, ``words``.

        A piece is a run of a document's words; the shards take disjoint pieces.
        """
        return self._dealt(seed, shard_words).where("shard is not null").select(
            "shard", F.xxhash64(F.lit(seed), "source", "number").alias("place"), "doc_id", "source", "pass",
            (F.col("low") - F.col("start")).alias("from_word"), "words")

    def documents(self, seed: int = 21, shard_words: int = SHARD_WORDS) -> DataFrame:
        """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` (words of its pieces)."""
        return self._dealt(seed, shard_words).groupBy("doc_id", "source", "bucket", "row", "size", "source_size", "target").agg(
            F.coalesce(F.sum(F.when(F.col("shard").isNotNull(), F.col("words"))), F.lit(0)).alias("taken")).drop("bucket", "row")
