"""Problem 5: held-out test passages inside a training corpus, by q-gram lemma filtering.

Test texts are cut into character q-grams with their places; a corpus text's q-grams are looked up in them. A passage of at
least ``m`` characters with at most ``e`` edits shares at least ``m + 1 - q * (e + 1)`` q-grams with its source, all of them
within a band of ``2 e + 1`` diagonals. So positions are kept that lie in a window with that many known q-grams, their hits
are counted in overlapping diagonal bands, and the regions that meet the bound of some passage they touch are verified by
banded alignment: along every diagonal of the band, the stretches of equal characters and the whole words in them; over the
whole region, the edits within the band. Texts with a passage too short to bear an edit have an index of their own, without
edits, so that they don't lower the bound of the others.

The test set is broadcast in blocks of a bounded number of texts, one pass over the corpus for each block. Each worker builds
the index of a block once.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a q-gram and edits allowed in a passage of the least length.
Q, EDITS = 12, 1
#: Words of a passage that count as leaked.
RUN_WORDS = 10
#: Test texts in one broadcast (at most some 20 MB of tables), and characters of the corpus looked up at once.
BLOCK_TEXTS, PIECE_CHARS = 20_000, 1 << 20
_MAP_BITS = 22

_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿᠎⁡⁢⁣"))
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_TO_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if c < 128 and chr(c).isalnum() else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15

FOUND = "doc_key long, item_key long, part string, message_no int, passage_chars int, edits int, run_words int"


def normal_form(text: str) -> str:
    """Lower-cased runs of letters and digits after NFKC and without invisible characters, joined by blanks."""
    raw = text.encode()
    if len(raw) == len(text):
        return b" ".join(raw.translate(_TO_SPACES).split()).decode()
    return " ".join(_WORD.findall(unicodedata.normalize("NFKC", text.translate(_INVISIBLE)).translate(_INVISIBLE).lower()))


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram that starts at each place, built from grams of half the length."""
    out, length, done = None, 1, 0
    power = points.astype(np.uint64) + np.uint64(1)
    while length <= q:
        if q & length:
            if out is None:
                out, done = power, length
            else:
                n = len(points) - done - length + 1
                out = out[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + power[done : done + n] if n > 0 else power[:0]
                done += length
        n = len(points) - 2 * length + 1
        power = power[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + power[length : length + n] if n > 0 else power[:0]
        length *= 2
    out = out ^ (out >> np.uint64(29))
    return out * np.uint64(0xBF58476D1CE4E5B9)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class TestTexts:
    """Index of one block of test texts: (item, part, text in normal form)."""

    def __init__(self, texts: list[tuple[int, str, str]], run_words: int = RUN_WORDS, q: int = Q, edits: int = EDITS):
        self.run_words = run_words
        self.labels = [(item, part) for item, part, _ in texts]
        self.texts = [text for _, _, text in texts]
        self.words = [text.split(" ") for text in self.texts]
        #: Characters of the shortest passage. It bounds the edits that the lemma can bear.
        self.shortest = [shortest_passage(w, run_words) for w in self.words]
        self.least = min(self.shortest, default=0)
        self.edits = max(0, min(edits, (self.least + 1) // q - 1))
        self.q = min(q, max(1, self.least))
        self.bound = self.least + 1 - self.q * (self.edits + 1)
        joined = "\x01".join(self.texts)
        self.points = code_points(joined)
        hashes = gram_hashes(self.points, self.q)
        starts = np.cumsum([0] + [len(t) + 1 for t in self.texts])
        at = np.arange(len(hashes))
        text_no = np.searchsorted(starts, at, side="right") - 1
        inside = at + self.q <= starts[text_no] + np.array([len(t) for t in self.texts] or [0])[np.minimum(text_no, len(self.texts) - 1)]
        order = np.argsort(hashes[inside], kind="stable")
        self.hashes, self.at, self.text_no = hashes[inside][order], at[inside][order], text_no[inside][order]
        self.starts = starts
        self.need = self._needed(len(joined))[self.at] if len(self.at) else np.zeros(0, np.int64)
        self.known = np.zeros(1 << _MAP_BITS, bool)
        self.known[(self.hashes >> np.uint64(64 - _MAP_BITS)).astype(np.int64)] = True

    def _needed(self, size: int) -> np.ndarray:
        """For the gram at each place of the joined texts: the least number of grams that the lemma wants of a passage (a window
        of ``run_words`` words) with this gram."""
        need = np.full(size + 1, 1 << 30, np.int64)
        for base, words in zip(self.starts.tolist(), self.words):
            at, begins = 0, []
            for word in words:
                begins.append(at)
                at += len(word) + 1
            for i in range(len(words) - self.run_words + 1):
                first, end = begins[i], begins[i + self.run_words - 1] + len(words[i + self.run_words - 1])
                own = need[base + first : base + end - self.q + 1]
                np.minimum(own, end - first + 1 - self.q * (self.edits + 1), out=own)
        return need

    def candidates(self, points: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, ...]]:
        """(text number, start and end in the corpus text, start and end in the test text, least and greatest diagonal,
        grams in common) of regions within the bound. No region runs over one of the ``starts``."""
        hashes = gram_hashes(points, self.q)
        if not len(hashes) or not len(self.hashes):
            return
        known = self.known[(hashes >> np.uint64(64 - _MAP_BITS)).astype(np.int64)]
        # places in a window of the passage's grams, with its edits, that holds as many known grams as the lemma wants
        width = self.least - self.q + 1 + self.edits
        total = np.concatenate([[0], np.cumsum(known)])
        n = len(known)
        full = total[np.minimum(np.arange(n) + width, n)] - total[:n] >= self.bound
        if not full.any():
            return
        reach = np.zeros(n + 1, np.int64)
        begins = np.flatnonzero(full)
        np.add.at(reach, begins, 1)
        np.add.at(reach, np.minimum(begins + width, n), -1)
        places = np.flatnonzero(known & (np.cumsum(reach[:n]) > 0))
        # grams over the end of a message are of no message
        message = np.searchsorted(starts, places, side="right")
        places = places[message == np.searchsorted(starts, places + self.q - 1, side="right")]
        low = np.searchsorted(self.hashes, hashes[places], side="left")
        high = np.searchsorted(self.hashes, hashes[places], side="right")
        times = high - low
        if not times.any():
            return
        place = np.repeat(places, times)
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        source, text_no, need = self.at[entry], self.text_no[entry], self.need[entry]
        diagonal = place - source
        # two sets of bands, half a band apart: any 2 e + 1 neighbouring diagonals lie within a band of one set
        band_width = 2 * (2 * self.edits + 1)
        for shift in (0, band_width // 2):
            band = (diagonal + shift) // band_width
            order = np.lexsort((place, band, text_no))
            p, s, t, b, least, d = place[order], source[order], text_no[order], band[order], need[order], diagonal[order]
            message = np.searchsorted(starts, p, side="right")
            new = np.r_[True, (t[1:] != t[:-1]) | (b[1:] != b[:-1]) | (p[1:] - p[:-1] > width) | (message[1:] != message[:-1])]
            begin = np.flatnonzero(new)
            end = np.r_[begin[1:], len(p)]
            enough = end - begin >= np.minimum.reduceat(least, begin)
            first, last = begin[enough], end[enough] - 1
            ends = (reduce.reduceat(own, begin)[enough] for reduce, own in ((np.minimum, s), (np.maximum, s), (np.minimum, d), (np.maximum, d)))
            s_low, s_high, d_low, d_high = ends
            yield from zip(*(x.tolist() for x in (t[first], p[first], p[last] + self.q, s_low, s_high + self.q, d_low, d_high, last + 1 - first)))

    def aligned(self, a: str, b: str, most: int) -> int | None:
        """Edits between two regions if at most ``most``, by dynamic programming within the band of ``most`` diagonals. What
        the regions have in common at their ends needs none."""
        if a == b:
            return 0
        if abs(len(a) - len(b)) > most:
            return None
        same = common_start(a, b)
        a, b = a[same:], b[same:]
        same = common_start(a[::-1], b[::-1])
        a, b = a[: len(a) - same], b[: len(b) - same]
        far, n = most + 1, len(b)
        row = [*range(most + 1), *[far] * (n + 1)][: n + 2]  # row[j]: edits from a[:i] to b[:j]; outside of the band far
        for i, x in enumerate(a, 1):
            low, high = max(0, i - most), min(n, i + most)
            new = [far] * (n + 2)
            best = far
            for j in range(low, high + 1):
                cost = row[j] + 1
                if j:
                    cost = min(cost, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
                new[j] = cost
                best = min(best, cost)
            if best > most:
                return None
            row = new
        return row[n] if row[n] <= most else None


def common_start(a: str, b: str) -> int:
    """Length of the longest common start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def shortest_passage(words: list[str], run_words: int) -> int:
    """Characters of the shortest run of so many words; 0 if there are fewer."""
    ends = np.cumsum([0] + [len(w) + 1 for w in words])
    return int((ends[run_words:] - ends[:-run_words]).min()) - 1 if len(words) >= run_words else 0


def longest_run(a: np.ndarray, b: np.ndarray, diagonals: range, shortest: int, least: int) -> int:
    """Whole words in the longest stretch that ``a`` and ``b`` (code points of texts in normal form) have in common on one of
    the ``diagonals`` (place in ``a`` less place in ``b``); 0 if under ``least`` words, which have ``shortest`` characters
    or more."""
    best = 0
    for d in diagonals:
        low, high = max(0, d), min(len(a), len(b) + d)
        if high - low < shortest:
            continue
        unequal = np.flatnonzero(a[low:high] != b[low - d : high - d])
        breaks = np.concatenate([[-1], unequal, [high - low]])  # a stretch lies between two of these
        for k in np.flatnonzero(np.diff(breaks) > shortest).tolist():
            i, j = int(breaks[k]) + 1, int(breaks[k + 1])
            # the words' edges within the stretch: blanks, and its ends where both texts have an edge there
            blanks = int(np.count_nonzero(a[low + i : low + j] == _BLANK))
            at_start = _edge(a, low + i - 1) and _edge(b, low + i - d - 1)
            at_end = _edge(a, low + j) and _edge(b, low + j - d)
            best = max(best, blanks - 1 + at_start + at_end)
    return best if best >= least else 0


_BLANK = 32


def _edge(points: np.ndarray, at: int) -> bool:
    return at < 0 or at >= len(points) or points[at] == _BLANK


def leaked_passages(docs: DataFrame, items: DataFrame, key: str = "chat_id", item_key: str = "item_id", run_words: int = RUN_WORDS) -> DataFrame:
    """FOUND rows: each passage of an item's question or answer in a message of a document, with the edits of its alignment
    (null if the region has more than its budget) and its longest run of equal words (0 if under ``run_words``).

    ``docs`` has ``messages``; null messages, null and empty contents hold nothing. Items with a null key or null texts hold
    nothing in these. Test texts shorter than ``run_words`` words can't be found. Repeated rows of either side repeat rows of
    the result.
    """
    spark = docs.sparkSession
    texts = items.where(F.col(item_key).isNotNull()).select(
        F.col(item_key).cast("long").alias("item"), F.posexplode(F.array("extra_info.question", "extra_info.answer")).alias("part", "text")
    ).where("text IS NOT NULL").distinct()
    blocks = max(1, -(-texts.count() // BLOCK_TEXTS))
    parts = None
    corpus = docs.where(F.col(key).isNotNull() & F.col("messages").isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.transform("messages", lambda m: m["content"]).alias("contents")
    )
    for block in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("item", "part", "text"), F.lit(blocks)) == block).collect()  # at most about BLOCK_TEXTS
        index = [(r.item, ("question", "answer")[r.part], normal_form(r.text)) for r in own]
        index = sorted(x for x in index if x[2].count(" ") + 1 >= run_words)
        found = corpus.mapInArrow(_searcher(spark.sparkContext.broadcast(index), run_words, uuid.uuid4().hex), FOUND)
        parts = found if parts is None else parts.unionByName(found)
    return parts


#: The indexes that this worker built last, by the name of their block.
_built: dict[str, list[TestTexts]] = {}


def indexes(texts: list[tuple[int, str, str]], run_words: int = RUN_WORDS) -> list[TestTexts]:
    """The index of the texts that can bear an edit in every passage, and that of the others."""
    short = [shortest_passage(t[2].split(" "), run_words) < 2 * Q for t in texts]
    parts = ([t for t, s in zip(texts, short) if s == which] for which in (False, True))
    return [TestTexts(part, run_words) for part in parts if part]


def _searcher(index, run_words: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:
            _built.clear()
            _built[name] = indexes(index.value, run_words)
        tests = _built[name]
        least = min((t.least for t in tests), default=0)
        for batch in batches:
            rows: list[tuple] = []
            keys, lists = batch.column(0).to_pylist(), batch.column(1)
            ends = lists.offsets.to_pylist()
            contents = lists.values.to_pylist()
            piece: list[tuple[int, int, str]] = []
            size = 0
            for key, start, end in zip(keys, ends, ends[1:]):
                for i in range(start, end):
                    if contents[i] and len(text := normal_form(contents[i])) >= least:
                        piece.append((key, i - start, text))
                        size += len(text) + 1
                        if size >= PIECE_CHARS:
                            rows += _search_all(tests, piece)
                            piece, size = [], 0
            rows += _search_all(tests, piece)
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in FOUND.split(", ")])

    return run


def _search_all(tests: list[TestTexts], piece: list[tuple[int, int, str]]) -> list[tuple]:
    if not piece:
        return []
    points = code_points("\n".join(text for _, _, text in piece))
    starts = np.cumsum([0] + [len(text) + 1 for _, _, text in piece])
    return [row for own in tests for row in _search(own, piece, points, starts)]


def _search(tests: TestTexts, piece: list[tuple[int, int, str]], points: np.ndarray, starts: np.ndarray) -> list[tuple]:
    best: dict[tuple, tuple] = {}
    for text_no, p, p_end, s, s_end, low, high, grams in dict.fromkeys(tests.candidates(points, starts)):
        m = int(np.searchsorted(starts, p, side="right")) - 1
        key, number, text = piece[m]
        base = int(starts[m])
        test, test_base = tests.texts[text_no], int(tests.starts[text_no])
        run = 0
        if grams > tests.shortest[text_no] - tests.q:  # every gram of a run of words is in its region
            left, right = max(0, p - base - 64), min(len(text), p_end - base + 64)
            shift = test_base - base - left
            run = longest_run(points[base + left : base + right], tests.points[test_base : test_base + len(test)], range(low + shift, high + shift + 1), tests.shortest[text_no], tests.run_words)
        most = max(1, tests.edits) * max(1, -(-(s_end - s) // tests.least))
        edits = tests.aligned(text[p - base : p_end - base], test[s - test_base : s_end - test_base], most)
        if edits is None and not run:
            continue
        label = (key, *tests.labels[text_no], number)
        row = (*label, p_end - p, edits, run)
        if label not in best or (row[6], row[4]) > (best[label][6], best[label][4]):
            best[label] = row
    return list(best.values())


def leaks(docs: DataFrame, items: DataFrame, key: str = "chat_id", item_key: str = "item_id") -> DataFrame:
    """``key, item_key``: each document and item of which a message holds ``RUN_WORDS`` consecutive words; once each."""
    return leaked_passages(docs, items, key, item_key).where(F.col("run_words") >= RUN_WORDS).select(F.col("doc_key").alias(key), F.col("item_key").alias(item_key)).distinct()


def leaks_by_source(docs: DataFrame, items: DataFrame, key: str = "chat_id", source: str = "data_source") -> DataFrame:
    """Per ``source``: documents, documents with a leak, and items leaked. Documents count once; a null source is its own."""
    found = leaks(docs, items, key)
    own = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(source).alias(source))
    leaked = found.groupBy(key).agg(F.collect_set("item_id").alias("items"))  # a document's items only
    marked = own.join(leaked, key, "left")
    counts = marked.groupBy(source).agg(F.count("*").alias("n_docs"), F.count("items").alias("n_leaked_docs"))
    pairs = marked.select(source, F.explode("items").alias("item_id")).distinct().groupBy(F.col(source).alias("own")).agg(F.count("*").alias("n_leaked_items"))
    return counts.join(pairs, F.col(source).eqNullSafe(F.col("own")), "left").select(source, "n_docs", "n_leaked_docs", F.coalesce("n_leaked_items", F.lit(0)).alias("n_leaked_items"))
