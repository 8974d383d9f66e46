"""Spelling variant grouping over a corpus vocabulary with a bit-sliced position index.

Words within one edit of each other agree outside a window of a few letters around the edit. Every word is therefore placed under the
digests of what lies outside each of its windows, once for words of its own length and once for words one letter shorter, and only words
under one digest meet. There, each pair (position, letter) has a bitset of the words with that letter there. A query word walks its own
letters and keeps four bitsets: words equal so far, words with one letter replaced, one inserted (read one position further) and one
deleted (one position before). All words are followed at once, by AND and OR of whole bitsets.

A digest that many words share is cut into pieces of a bounded number of words and letters; each piece is indexed by one task
and read past by all words of the digest, one at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written

RUN = re.compile("[a-zÀ-ÿ]+")
DROPPED = 199
LEAST_LETTERS = 6
LEAST_COUNT = 5
FORM_RATIO = 5
#: Letters of a window; no word has more than WINDOWS of them, so long words have wider ones.
WINDOW = 4
WINDOWS = 4
#: Words and letters of an index.
INDEX_WORDS = 4096
INDEX_LETTERS = 1 << 16


def runs_of(row_id: int | None, text: str) -> Iterator[tuple[str, int]]:
    """Words of one text with their numbers, after the stated deletions; equal runs of a document share their fate."""
    own = "" if row_id is None else str(row_id)
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(f"{own}:{run}".encode())
        if h % DROPPED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: counted in each task and then summed; a task hands on its counts when they grow large."""

    def count(batches):
        held, letters = Counter(), 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in runs_of(row_id, text.as_py()):
                    if len(word) >= least_letters:
                        letters += 0 if word in held else len(word)
                        held[word] += n
                if letters > 1 << 22:
                    yield out()
                    held, letters = Counter(), 0
        if held:
            yield out()

    counted = id_and_text(docs, id_column, text_column).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def windows_of(length: int) -> int:
    return min(WINDOWS, -(-length // WINDOW))


def window(length: int, at: int) -> int:
    """The window of the shorter word that holds position ``at``; its end belongs to the last one."""
    k = windows_of(length)
    return next((j for j in range(k) if at < (j + 1) * length // k), k - 1)


def placed(words: DataFrame) -> DataFrame:
    """short, window, key, word, n: each word under the digest of what surrounds each window, as the shorter or equal word of a pair and as the longer one."""
    letters = F.char_length("word")

    def under(longer: int) -> Column:
        short = letters - longer
        k = F.least(F.lit(WINDOWS), F.ceil(short / WINDOW)).cast("int")

        def key(j):
            start, end = F.floor(j * short / k).cast("int"), F.floor((j + 1) * short / k).cast("int")
            around = F.xxhash64(F.col("word").substr(F.lit(1), start), F.col("word").substr(end + longer + 1, letters))
            return F.struct(short.alias("short"), j.alias("window"), around.alias("key"))

        return F.transform(F.sequence(F.lit(0), k - 1), key)

    longer = F.when(letters > 1, under(1)).otherwise(F.slice(under(0), 1, 0))
    return words.select("word", "n", F.explode(F.concat(under(0), longer)).alias("k")).select("k.*", "word", "n")


class Index:
    """Bitsets over a list of words: bit i stands for word i."""

    def __init__(self, words: list[str]):
        self.words = words
        self.at: dict[tuple[int, str], int] = {}
        self.of_length: dict[int, int] = {}
        for i, word in enumerate(words):
            bit = 1 << i
            self.of_length[len(word)] = self.of_length.get(len(word), 0) | bit
            for place in enumerate(word):
                self.at[place] = self.at.get(place, 0) | bit
        self.all = (1 << len(words)) - 1

    def near(self, query: str) -> Iterator[int]:
        """Indexes of the words that differ from ``query`` by exactly one replaced, inserted or deleted letter."""
        get, length = self.at.get, len(query)
        equal, replaced, deleted = self.all, 0, 0
        inserted = self.all  # the first letter may be the inserted one
        for i, c in enumerate(query):
            before = equal
            equal &= get((i, c), 0)
            replaced = (replaced & get((i, c), 0)) | before
            inserted = (inserted & get((i + 1, c), 0)) | equal
            deleted = (deleted & get((i - 1, c), 0)) | before
            if not (replaced | inserted | deleted):
                return
        size = self.of_length.get
        found = (replaced & size(length, 0) & ~equal) | (inserted & size(length + 1, 0)) | (deleted & size(length - 1, 0))
        while found:
            last = found & -found
            yield last.bit_length() - 1
            found ^= last


def first_difference(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _answer(index: Index, counts: list[int], query: str, short: int, at: int) -> Iterator[tuple[str, int, int, str]]:
    """query, how many near words it has here, and the best of them; a pair belongs to the window of its first difference only."""
    best, many = None, 0
    for i in index.near(query):
        word = index.words[i]
        low, high = (query, word) if len(query) <= len(word) else (word, query)
        if len(low) == short and window(short, first_difference(low, high)) == at:
            many += 1
            if best is None or (-counts[i], word) < best:
                best = (-counts[i], word)
    if best:
        yield query, many, -best[0], best[1]


def _answers(rows: Iterable[tuple]) -> Iterator[tuple[str, int, int, str]]:
    """From rows (short, window, key, piece, reads, word, n) in order: the words of an index come first and read it too, then come its other readers."""
    for (short, at, _, _), piece in groupby(rows, lambda r: r[:4]):
        words, counts, index = [], [], None
        for *_, reads, word, n in piece:
            if not reads:
                words.append(word)
                counts.append(n)
                continue
            if index is None:
                index = Index(words)
            yield from _answer(index, counts, word, short, at)
        if len(words) > 1:
            index = index or Index(words)
            for word in words:
                yield from _answer(index, counts, word, short, at)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best for each of ``words`` (word, n; distinct) that has a near word: their number and the most frequent one (ties: the smallest)."""
    own = placed(words)
    place = ["short", "window", "key"]
    size = own.groupBy(*place).agg(F.count(F.lit(1)).alias("m"), F.sum(F.char_length("word").cast("long")).alias("letters")).filter("m > 1")
    pieces = F.ceil(F.greatest(F.col("m") / INDEX_WORDS, F.col("letters") / INDEX_LETTERS, F.lit(1.0))).cast("int")
    dealt = own.join(size.select(*place, pieces.alias("pieces")), place)
    dealt = dealt.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.withColumn("reads", (F.col("piece") != F.pmod(F.xxhash64("word"), F.col("pieces"))))
    cols = [*place, "piece", "reads", "word", "n"]
    dealt = dealt.select(*cols).repartition(*place, "piece").sortWithinPartitions(*place, "piece", "reads")

    def answer(batches):
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        held = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "many", "best_n", "best"])

        for found in _answers(rows):
            held.append(found)
            if len(held) >= 1 << 14:
                yield out()
                held = []
        if held:
            yield out()

    found = dealt.mapInArrow(answer, "word string, many long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("many").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for ``forms`` (word, form): the last of a word's chain. Each round doubles the steps taken; a form is FORM_RATIO times as frequent as its word, so chains are short."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = now.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        step = written(now.join(nxt, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the corpus.

    NULL texts have no words; a NULL id counts as an empty one in the stated digest; repeated rows count as often as they stand; other
    columns are not read. An empty table gives an empty result.
    """
    words = written(vocabulary(docs, id_column, text_column, least_letters, least_count), "vocabulary")
    near = written(near_words(words), "near_words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    known = written(
        words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")),
        "word_forms",
    )
    chains = roots(known.filter("form IS NOT NULL"))
    return known.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
