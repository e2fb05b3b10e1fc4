"""Order MinHash fingerprints, with DataFrame functions only.

The units are words and their k-mers; equal k-mers are told apart by their occurrence number. One
hash orders all numbered k-mers; its range is dealt into ``SKETCHES`` equal parts (one permutation hashing), and in each part
the ``TUPLE`` least k-mers are selected, put back into text order and hashed as a tuple. Two texts share a component when the
same k-mers were selected in the same order, so the likeness falls with edits and with moved passages.

Defined results: a null text is empty; a text without words has empty components only; a text with fewer words than ``k`` has its whole
sequence as its only k-mer; equal texts have equal fingerprints; two empty fingerprints have likeness 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from strataframe.llm.special import bound

K = 2
SKETCHES = 64
TUPLE = 2
#: A word's place takes 30 bits (no string has more words), the order of its k-mer the other 33.
PLACE = 1 << 30
PARTS = 4096
BLANKS = " \t\n\x0b\f\r"
#: What stands for a component without k-mers.
EMPTY = "." * 8


def fingerprint(text: Column, k: int = K) -> Column:
    """``SKETCHES`` components of 8 hex digits; a component without k-mers is 8 dots."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))

    def grams(h: Column) -> Column:
        few = F.when(F.size(h) > 0, F.array(F.aggregate(h, F.lit(7).cast("long"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.array().cast("array<long>"))
        return F.when(F.size(h) < k, few).otherwise(
            F.transform(F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda _, i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])))

    def numbered(g: Column) -> Column:
        """Hashes of k-mers with their occurrence numbers, in text order."""
        def runs(s: Column) -> Column:
            # Sorted by k-mer and place; the occurrence number is the distance to the run's start.
            start = F.filter(F.transform(s, lambda x, i: F.when(
                (i == 0) | (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] != x["h"]), i)), lambda i: i.isNotNull())
            return bound(start, lambda b: F.flatten(F.transform(b, lambda lo, r: F.transform(
                F.slice(s, lo + 1, F.coalesce(F.get(b, r + 1), F.size(s)) - lo),
                lambda x, n: F.struct(x["i"].alias("i"), F.xxhash64(x["h"], n).alias("h"))))))

        placed = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.transform(g, lambda x: F.xxhash64(x, F.lit(0)))).otherwise(
            F.transform(F.array_sort(bound(placed, runs)), lambda x: x["h"]))

    def components(n: Column) -> Column:
        order = F.sort_array(F.transform(n, lambda h, i: h.bitwiseAND((1 << 33) - 1) * PLACE + i))

        def chosen(p: Column) -> Column:
            part = lambda x: F.shiftright(x, 57)
            least = F.filter(p, lambda x, i: (i < TUPLE) | (part(F.get(p, F.greatest(i - TUPLE, F.lit(0)))) != part(x)))

            def tuples(c: Column) -> Column:
                # Sorted by part, so a part is a run of at most TUPLE entries; its first entry writes it and the empty parts before it.
                def component(x: Column, i: Column) -> Column:
                    before = F.when(i == 0, F.lit(-1)).otherwise(part(F.get(c, F.greatest(i - 1, F.lit(0)))))
                    places = F.array_sort(F.filter(F.transform(F.slice(c, i + 1, F.lit(TUPLE)), lambda y: F.when(part(y) == part(x), y.bitwiseAND(PLACE - 1))),
                                                   lambda y: y.isNotNull()))
                    key = F.aggregate(places, F.lit(11).cast("long"), lambda a, at: F.xxhash64(a, F.get(n, at.cast("int"))))
                    text = F.concat(F.repeat(F.lit(EMPTY), (part(x) - before - 1).cast("int")), F.right(F.lpad(F.hex(key), 16, "0"), F.lit(8)))
                    return F.when(before < part(x), text)

                last = F.coalesce(part(F.get(c, F.size(c) - 1)), F.lit(-1))
                return F.concat(F.array_join(F.transform(c, component), ""), F.repeat(F.lit(EMPTY), (F.lit(SKETCHES - 1) - last).cast("int")))

            return bound(least, tuples)

        return bound(order, chosen)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return bound(bound(bound(hashed, grams), numbered), components)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components among those that one of the fingerprints has."""
    def compare(c: Column) -> Column:
        used = F.filter(c, lambda x: (x["a"] != EMPTY) | (x["b"] != EMPTY))
        return bound(used, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.filter(u, lambda x: x["a"] == x["b"])) / F.size(u)))

    pieces = F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda s: F.struct(
        F.substr(a, s * 8 + 1, F.lit(8)).alias("a"), F.substr(b, s * 8 + 1, F.lit(8)).alias("b")))
    return bound(pieces, compare)


def with_next(docs: DataFrame, values: list[str]) -> DataFrame:
    """``docs`` with ``next_<value>`` of the next row in descending doc_id; the last row's next is the first.

    The ids are cut at quantiles into ``PARTS`` parts. A part's first row closes the part above it, so it is sent
    to both and no part needs another. A null doc_id comes last, spread by a hash over what lies below all ids.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)) + F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    keyed = docs.withColumn("key", key)
    shares = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    cuts = keyed.agg(F.array_sort(F.array_distinct(F.percentile_approx("key", shares, F.lit(1_000_000)))).alias("c"), F.max("key").alias("top"))
    cut, top = cuts.select(F.coalesce("c", F.array().cast("array<bigint>"))).scalar(), cuts.select("top").scalar()
    keyed = keyed.withColumn("cuts", cut).withColumn("top", top)

    def search(arr: Column) -> Column:
        # Number of cuts below the key.
        step = lambda acc, bit: F.when(
            (acc + bit <= F.size(arr)) & (F.get(arr, F.greatest(acc + bit - 1, F.lit(0))) < F.col("key")), acc + bit).otherwise(acc)
        return F.aggregate(F.array(*[F.lit(PARTS >> (i + 1)) for i in range(PARTS.bit_length() - 1)]), F.lit(0), step)

    keyed = keyed.withColumn("part", search(F.col("cuts")))
    is_cut = F.coalesce(F.get("cuts", F.col("part")) == F.col("key"), F.lit(False))
    also = F.when(F.col("key") == F.col("top"), F.lit(0)).when(is_cut, F.col("part") + 1)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("closes"))
    closing = F.struct(also.alias("part"), F.lit(True).alias("closes"))
    sent = keyed.withColumn("to", F.explode(F.filter(F.array(own, closing), lambda x: x["part"].isNotNull()))).drop("part", "cuts", "top").select("*", "to.*").drop("to")
    order = Window.partitionBy("part").orderBy("closes", F.desc("key"), F.xxhash64("text"))
    return sent.select("*", *[F.lead(v).over(order).alias(f"next_{v}") for v in values]).where("not closes").drop("key", "part", "closes")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by the beginning of the next document, in descending doc_id.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fingerprint", fingerprint(F.col("text")))
    rows = with_next(rows, ["text", "fingerprint"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
