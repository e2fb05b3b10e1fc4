"""Spelling variants: words of the corpus that differ from a far more frequent word by one edit.

Pivotal grams. All bigrams are ordered by their frequency in the vocabulary, rare ones first. The prefix of a word is its three first
bigrams in that order (ties included), and two of them without a common letter, chosen by dynamic programming for least total
frequency, are its pivots. One edit leaves at least one of the two pivots alone, and if the pivots' word has the earlier prefix end, what is
left of a pivot is in the other word's prefix. So pivots are looked up among the prefix grams of the other words. Position limits sharpen
this: an edit behind the left pivot leaves all up to it in place, an edit before the right pivot all from it on; so these untouched sides and the lengths
are part of the key, which places the gram too. What meets is verified by its edit distance.

Counting combines each task's words before the shuffle, so a word in every text is one row per task. The alphabet is fixed, so there are at most 8,100
bigrams to order. A word has a bounded number of strings at distance one. Chains of forms grow fivefold at each link and are followed by doubling.

Defined results: a null text has no words; a null doc_id counts as an empty one where misspellings are drawn; repeated rows count each;
of near words with equal counts the smallest in code point order is the form; further columns are ignored; without words there are no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strataframe.llm.shared import Scratch

#: Words are runs of these letters; A-Z are read as a-z.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words a task counts before it hands them on, and letters it takes at a time.
HELD_WORDS = 200_000
PASS_LETTERS = 1 << 20


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces that end between words."""
    at = 0
    while len(text) - at > PASS_LETTERS:
        end = at + PASS_LETTERS
        while end < len(text) and RUN.match(text[end]):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _counted(drop_every: int, least_letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if not text.is_valid:
                    continue
                mark = b"%s:" % (b"" if doc is None else str(doc).encode())
                # Lower-casing bytes changes A-Z only.
                for piece in _pieces(text.as_py().encode().lower().decode()):
                    for word, n in Counter(RUN.findall(piece)).items():
                        if drop_every and (h := zlib.crc32(mark + word.encode())) % drop_every == 0:
                            h %= len(word)
                            word = word[:h] + word[h + 1:]
                        if len(word) >= least_letters:
                            total[word] += n
                if len(total) > HELD_WORDS:
                    yield rows()
        if total:
            yield rows()
    return run


def word_counts(docs: DataFrame, *, least_letters: int, least_count: int, drop_every: int = 0) -> DataFrame:
    """``word``, ``n`` over all rows of ``docs`` (doc_id, text); with ``drop_every``, one in so many distinct words of a document loses a letter."""
    counts = docs.select("doc_id", "text").mapInArrow(_counted(drop_every, least_letters), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def pivots(grams: list[tuple[int, int, str]]) -> tuple[int, int]:
    """Places of the two disjoint bigrams of least total frequency among (place, frequency, gram) in order of place."""
    best: tuple | None = None  # cheapest pair so far
    one: tuple | None = None  # cheapest gram that ends before the current one
    waiting: list[tuple[int, int, str]] = []
    for place, frequency, gram in grams:
        while waiting and waiting[0][0] + 2 <= place:
            p, f, g = waiting.pop(0)
            one = min(one, (f, g, p)) if one else (f, g, p)
        if one:
            pair = (one[0] + frequency, one[2], place)
            best = min(best, pair) if best else pair
        waiting.append((place, frequency, gram))
    return best[1], best[2]


def prefix(word: str, order: dict[str, int]) -> tuple[list[tuple[int, int, str]], tuple[int, str]]:
    """Bigrams of a word up to its third in the order, in order of place, and where that prefix ends in the order."""
    grams = [(order[word[i:i + 2]], word[i:i + 2], i) for i in range(len(word) - 1)]
    end = sorted(grams)[min(2, len(grams) - 1)][:2]
    return [(i, f, g) for f, g, i in grams if (f, g) <= end], end


def _keys(order: dict[str, int]):
    """Rows (key, word, n, end, pivot): the places where a word's prefix grams stand in the index, and where its pivots look."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, word_, n_, end_, pivot_ = [], [], [], [], []

            def add(k: str, pivot: bool) -> None:
                key.append(k)
                word_.append(word)
                n_.append(n)
                end_.append(end)
                pivot_.append(pivot)

            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                grams, last = prefix(word, order)
                end = f"{last[0]:020d}{last[1]}"
                size = len(word)
                for i, _, _ in grams:
                    add(f"<{size}:{word[:i + 2]}", False)
                    add(f">{size}:{word[i:]}", False)
                a, b = pivots(grams)
                for near in (size - 1, size, size + 1):
                    # An edit behind the left pivot, or before the right one.
                    add(f"<{near}:{word[:a + 2]}", True)
                    add(f">{near}:{word[b:]}", True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(word_, pa.string()), pa.array(n_, pa.int64()), pa.array(end_, pa.string()),
                                              pa.array(pivot_)], names=["key", "word", "n", "end", "pivot"])
    return run


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``word``, ``near``, ``near_n`` for all words (word, n; four letters or more) that differ by one inserted, deleted or replaced letter, both ways."""
    bigrams = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))
    order = {r[0]: r[1] for r in words.select(F.explode(bigrams).alias("gram")).groupBy("gram").count().collect()}
    keys = scratch.write(words.mapInArrow(_keys(order), "key string, word string, n long, end string, pivot boolean"), "grams")
    side = lambda pivot: keys.where(F.col("pivot") == pivot).drop("pivot")
    met = side(True).alias("p").join(side(False).alias("g"), "key").where(
        (F.col("p.end") <= F.col("g.end")) & (F.levenshtein(F.col("p.word"), F.col("g.word"), 1) == 1))
    pair: list[Column] = [F.col("p.word").alias("word"), F.col("p.n").alias("n"), F.col("g.word").alias("near"), F.col("g.n").alias("near_n")]
    met = met.select(*pair)
    both = met.select("word", "near", "near_n").unionByName(met.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return both.distinct()


def spelling_forms(docs: DataFrame, scratch: Scratch, *, least_letters: int = 6, least_count: int = 5, factor: int = 5, drop_every: int = 0) -> DataFrame:
    """One row per word of ``docs``: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word of largest count, if that is at least ``factor`` times the word's own; ``root`` follows forms to the last.
    """
    words = scratch.write(word_counts(docs, least_letters=least_letters, least_count=least_count, drop_every=drop_every), "words")
    near = near_words(words, scratch)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))
    is_form = F.col("near_n") >= F.col("n") * factor
    found = scratch.write(found.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    # Counts grow by ``factor`` at each link, so the longest chain is known.
    top = words.agg(F.max("n")).first()[0] or 0
    longest = 0
    while least_count * factor ** (longest + 1) <= top:
        longest += 1
    reach = 1
    while reach < longest:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = scratch.write(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        reach *= 2
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
