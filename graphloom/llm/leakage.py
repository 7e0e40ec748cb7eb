"""Find evaluation passages inside a training corpus.

Method: an FM-index per training shard. Words are mapped to the vocabulary of
the evaluation texts (any other word is a break no passage can span), the runs
of a shard form one symbol sequence with a suffix array, its Burrows-Wheeler
transform is held in a wavelet matrix, every phrase of `words` consecutive
evaluation words is searched backwards through its ranks, and the hits are
located by sampled suffix positions. Overlapping hits merge into spans.

A word is a longest run of Unicode letters and digits, compared after case
folding. Null texts hold no words; items shorter than `words` words cannot
leak; duplicate items and documents are each reported. The evaluation side
travels to the executors in blocks of bounded size; whole documents are
searched, and runs without `words` consecutive vocabulary words are not indexed
because no phrase fits into them. Extra columns are ignored; empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"[\p{L}\p{Nd}]+")
#: Symbols of one shard's index; a document longer than that is cut with overlap.
SHARD = 1 << 20
#: Characters of evaluation text that are searched in one pass: about a million phrases, 150 MB in each task; more text takes more passes.
BLOCK_CHARS = 1 << 23
#: One suffix in so many keeps its position.
SAMPLE = 16

SPANS = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, start_char bigint, end_char bigint"
_SPANS_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "start_word", "end_word", "start_char", "end_char")])


def words_of(text: str) -> list[str]:
    found = WORD.findall(text)
    return " ".join(found).casefold().split(" ") if found else []


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; every 0 in `s` is a break of its own that sorts by position."""
    n = len(s)
    breaks = np.flatnonzero(s == 0)
    rank = s.astype(np.int64) + len(breaks)
    rank[breaks] = np.arange(len(breaks))
    width = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - width] = rank[width:] + 1
        key = rank * (n + len(breaks) + int(s.max(initial=0)) + 2) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Rank and access over a symbol sequence, one bit plane per level; all methods take arrays."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        current = s
        for level in reversed(range(self.bits)):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            before = ones[at]
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + before, at - before)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often `symbol` occurs before position `at`."""
        return self._descend(symbol, at) - self._descend(symbol, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            before = ones[at]
            bit = ones[at + 1] - before
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, zeros + before, at - before)
        return symbol


class FMIndex:
    """FM-index of a sequence over 0..symbols-1 that starts and ends with the break 0."""

    def __init__(self, s: np.ndarray, symbols: int):
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols)))).astype(np.int64)
        self.tree = WaveletMatrix(bwt, symbols)
        # The rows before a break keep their position too: walking back never crosses one.
        marked = (sa % SAMPLE == 0) | (bwt == 0)
        self.marks = np.concatenate(([0], np.cumsum(marked)))
        self.places = sa[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of the suffixes that start with each row of `phrases`."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.first[-1])
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            lo[alive] = self.first[symbol] + self.tree.rank(symbol, lo[alive])
            hi[alive] = self.first[symbol] + self.tree.rank(symbol, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the sequence of the suffix in each row."""
        at, place = rows.copy(), np.zeros(len(rows), np.int64)
        steps, open_ = 0, np.arange(len(rows))
        while len(open_):
            here = at[open_]
            known = self.marks[here + 1] > self.marks[here]
            done = open_[known]
            place[done] = self.places[self.marks[here[known]]] + steps
            open_, here = open_[~known], here[~known]
            symbol = self.tree.access(here)
            at[open_] = self.first[symbol] + self.tree.rank(symbol, here)
            steps += 1
        return place


class Phrases:
    """All distinct `words`-word phrases of a block of evaluation items, as symbols."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        self.words = words
        self.vocabulary: dict[str, int] = {}
        grams, owners = [], []
        for item, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if len(own) >= words:
                view = np.lib.stride_tricks.sliding_window_view(np.array(own, np.int64), words)
                grams.append(view)
                owners.append(np.full(len(view), item, np.int64))
        self.symbols = len(self.vocabulary) + 1
        if grams:
            self.grams, which = np.unique(np.concatenate(grams), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], 1), axis=0)
            self.owner = pairs[:, 1]
            self.owned = np.searchsorted(pairs[:, 0], np.arange(len(self.grams) + 1))
        else:
            self.grams = np.zeros((0, words), np.int64)


class _Shard:
    """Runs of vocabulary words, collected until they are worth an index."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.pieces: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.starts: list[int] = []  # in the sequence
        self.docs: list[int] = []  # index into self.texts
        self.offsets: list[int] = []  # in the document's words
        self.texts: list[tuple[int | None, str]] = []
        self.size = 1

    def add(self, doc_id: int | None, text: str) -> Iterator[list[tuple]]:
        get = self.phrases.vocabulary.get
        coded = np.array([get(w, 0) for w in words_of(text)], np.int64)
        least = self.phrases.words
        if len(coded) < least:
            return
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (coded > 0).view(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2]
        wide = end - begin >= least
        fresh = True
        for b, e in zip(begin[wide].tolist(), end[wide].tolist()):
            for cut in range(b, e - least + 1, SHARD):
                if fresh:
                    self.texts.append((doc_id, text))
                    fresh = False
                piece = coded[cut : min(e, cut + SHARD + least - 1)]
                self.starts.append(self.size)
                self.docs.append(len(self.texts) - 1)
                self.offsets.append(cut)
                self.pieces += [piece, np.zeros(1, np.int64)]
                self.size += len(piece) + 1
                if self.size >= SHARD:
                    yield self.hits()
                    self.clear()
                    fresh = True

    def hits(self) -> list[tuple]:
        p = self.phrases
        if not self.starts or not len(p.grams):
            return []
        index = FMIndex(np.concatenate(self.pieces), p.symbols)
        lo, hi = index.search(p.grams)
        count = hi - lo
        gram = np.repeat(np.arange(len(count)), count)
        if not len(gram):
            return []
        inside = np.arange(len(gram)) - np.repeat(np.cumsum(count) - count, count)
        place = index.locate(lo[gram] + inside)
        run = np.searchsorted(self.starts, place, "right") - 1
        doc = np.array(self.docs)[run]
        word = place - np.array(self.starts)[run] + np.array(self.offsets)[run]
        # Each hit belongs to every item that has the phrase.
        fan = (p.owned[1:] - p.owned[:-1])[gram]
        hit = np.repeat(np.arange(len(gram)), fan)
        item = p.owner[p.owned[gram][hit] + np.arange(len(hit)) - np.repeat(np.cumsum(fan) - fan, fan)]
        return self._spans(doc[hit], item, word[hit])

    def _spans(self, doc: np.ndarray, item: np.ndarray, word: np.ndarray) -> list[tuple]:
        order = np.lexsort((word, item, doc))
        doc, item, word = doc[order], item[order], word[order]
        apart = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] > word[:-1] + self.phrases.words)))
        first = np.flatnonzero(apart)
        last = np.concatenate((first[1:] - 1, [len(word) - 1]))
        out, known, bounds = [], -1, []
        for a, b in zip(first.tolist(), last.tolist()):
            d = int(doc[a])
            doc_id, text = self.texts[d]
            if d != known:
                known, bounds = d, [m.span() for m in WORD.finditer(text)]
            begin, end = int(word[a]), int(word[b]) + self.phrases.words
            out.append((doc_id, int(item[a]), begin, end, bounds[begin][0], bounds[end - 1][1]))
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_SPANS_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SPANS_ARROW)


def _searcher(items: list[tuple[int, str]], words: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(Phrases(items, words))
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                for rows in shard.add(doc_id, text):
                    yield _batch(rows)
        yield _batch(shard.hits())

    return search


def leaks(documents: DataFrame, items: DataFrame, words: int = 12) -> DataFrame:
    """``(doc_id, item_id, start_word, end_word, start_char, end_char)``: the spans of each item in each document.

    Ends are exclusive; spans of one item that touch or overlap are one.
    """
    spark = documents.sparkSession
    texts = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint"), "text")
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    source = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    found = None
    for b in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        block = [(r.item_id, r.text) for r in part.collect()]  # at most about BLOCK_CHARS characters
        spans = source.mapInArrow(_searcher(block, words), SPANS)
        found = spans if found is None else found.unionByName(spans)
    return found if found is not None else spark.createDataFrame([], SPANS)


def removal_spans(found: DataFrame) -> DataFrame:
    """``(doc_id, start_char, end_char)``: the parts of each document that belong to any item, merged."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc_id").orderBy("start_char", "end_char")
    reach = F.max("end_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("_new", F.coalesce((F.col("start_char") > reach).cast("int"), F.lit(1)))
    return (
        apart.withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "_span")
        .agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))
        .drop("_span")
    )
