"""Benchmark decontamination: close word pairs propose test items, local alignment scores them.

A first scan of the corpus counts the word pairs of test items (words at a distance of one or two). The second
looks up each item's rarest pairs and aligns what they propose by Smith-Waterman, which scores copies with
changed, missing or added words. Both scans work on single texts, so a passage that is everywhere is spread
like the texts themselves, and nothing is dropped for being common.

No copy is lost before the alignment. Let an item have L words, a copy m matching words and e errors (changed,
missing or added words), and let it reach the threshold t: 2m - e >= 2tL. Of the m - 1 steps from one match to
the next at most e / 2 hold two or more errors, so at least tL - 1 steps hold at most one. The two words of
such a step are at most two apart in the item and in the text: a pair. Of the item's L - 1 places at which a
pair can begin, at least tL - 1 are thus met, and any choice of places that leaves out s fewer than that many
meets at least s. Which places are left out (the most frequent ones) changes only the cost.

Items under MIN_ITEM_WORDS words, where half of the score is a common phrase, are matched whole and exactly.
In scripts written without blanks every character is a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import PLAIN, byte_chunks, column_of, shingle_hashes, word_hashes

#: Items with fewer words count as copied only where all their words stand in a row.
MIN_ITEM_WORDS = 8
#: Share of an item's best possible score from which a passage counts as a copy.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, 1
#: Greatest distance of the two words of a pair, in the item and in the text.
REACH = 2
#: Places of an item that must be met together (fewer where the threshold promises fewer).
TOGETHER = 3
#: Words of test items that one pair of scans looks for; a larger benchmark takes more of them.
BLOCK_WORDS = 1_000_000
#: Look-ups that are expanded at once, and alignments that a task remembers.
EXPANDED, REMEMBERED = 2_000_000, 10_000


#: Scripts without blanks between words, for RE2 and for Java.
_SCRIPTS = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
_BLANKLESS = "([" + "".join(rf"\p{{{x}}}" for x in _SCRIPTS) + "])"
_NOT_BLANKLESS = "[^" + "".join(rf"\p{{Is{x}}}" for x in _SCRIPTS) + "]"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the plain words (lowered, marks left out) of all texts, and word offsets of the texts.

    A character of a script without blanks is a word, and CJK marks are left out like others.
    """
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    if not pc.all(pc.string_is_ascii(texts)).as_py():
        texts = pc.replace_substring_regex(texts, r"[\x{3000}-\x{3004}\x{3008}-\x{3020}\x{30FB}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}]", " ")
        texts = pc.replace_substring_regex(texts, _BLANKLESS, r" \1 ")
    hashes, offsets, base = [], [np.zeros(1, np.int64)], 0
    for _, data, bounds in byte_chunks(texts, 1 << 60):
        own, own_offsets = word_hashes(data, bounds, PLAIN)
        hashes.append(own)
        offsets.append(own_offsets[1:] + base)
        base += len(own)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(offsets)


def _least(words: np.ndarray | int, threshold: float) -> np.ndarray:
    """Matching words that a copy of an item of so many words has at least."""
    return np.ceil(threshold * np.asarray(words) - 1e-9).astype(np.int64)


@dataclass
class Items:
    """Test items of one block. ``words`` are numbers of the vocabulary, ``pairs`` the sorted keys of word pairs.

    ``places`` are the places in ``words`` where a pair begins, pair by pair; those of pair k are
    ``places[begins[k]:begins[k + 1]]``. ``short`` has the short items: by number of words, the sorted hashes
    of all their words and the items that these belong to.
    """

    ids: np.ndarray
    words: np.ndarray
    offsets: np.ndarray
    vocabulary: np.ndarray
    pairs: np.ndarray
    begins: np.ndarray
    places: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None]) -> "Items":
        words, offsets = words_of(pa.array(texts, pa.string()))
        vocabulary, numbers = np.unique(words, return_inverse=True)
        size = np.diff(offsets)
        end = np.repeat(np.where(size >= MIN_ITEM_WORDS, offsets[1:], 0), size)
        keys, places = [], []
        for apart in range(1, REACH + 1):
            at = np.flatnonzero(np.arange(len(words)) + apart < end)
            keys.append(numbers[at] * len(vocabulary) + numbers[at + apart])
            places.append(at)
        keys, places = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(keys, kind="stable")
        pairs, begins = np.unique(keys[order], return_index=True)
        short = {}
        for n in range(1, MIN_ITEM_WORDS):
            own = np.flatnonzero(size == n)
            if len(own):
                at = offsets[own][:, None] + np.arange(n)
                whole, _ = shingle_hashes(words[at].reshape(-1), np.arange(0, n * len(own) + 1, n), n)
                turn = np.argsort(whole)
                short[n] = whole[turn], own[turn]
        return cls(np.array(ids, np.int64), numbers.astype(np.int32), offsets, vocabulary, pairs, np.append(begins, len(keys)), places[order], short)

    def rarest(self, counts: np.ndarray, threshold: float) -> tuple["Items", np.ndarray]:
        """The items with the pairs of their rarest places only, and how many places of each are met together."""
        size = np.diff(self.offsets)
        promised = np.maximum(_least(size, threshold) - 1, 1)
        needed = np.minimum(promised, TOGETHER)
        item = np.repeat(np.arange(len(size)), size)
        cost = np.zeros(len(self.words))
        pair = np.repeat(np.arange(len(self.pairs)), np.diff(self.begins))
        np.add.at(cost, self.places, counts[pair])
        begin = np.arange(len(self.words)) + 1 < np.repeat(self.offsets[1:], size)
        order = np.lexsort((cost, ~begin, item))
        turn = np.empty(len(order), np.int64)
        turn[order] = np.arange(len(order)) - self.offsets[item]
        chosen = (turn < (size - 1 - promised + needed)[item])[self.places]
        held, begins = np.unique(pair[chosen], return_index=True)
        return replace(self, pairs=self.pairs[held], begins=np.append(begins, chosen.sum()), places=self.places[chosen]), needed

    def numbered(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the vocabulary for words, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def met(self, numbers: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair, position of its first word) for all pairs of the items within one row of the text."""
        pairs, firsts = [], []
        for apart in range(1, REACH + 1):
            a, b = numbers[:-apart], numbers[apart:]
            first = np.flatnonzero((a >= 0) & (b >= 0) & (row[:-apart] == row[apart:]))
            key = a[first] * len(self.vocabulary) + b[first]
            if not len(self.pairs):
                first, key = first[:0], key[:0]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[at] == key
            pairs.append(at[hit])
            firsts.append(first[hit])
        return np.concatenate(pairs), np.concatenate(firsts)


def _texts(batch: pa.RecordBatch, known: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch with words: (first row, words, offsets, words as numbers of the items' vocabulary)."""
    column = column_of(batch, "text")
    for low, _, bounds in byte_chunks(column):
        words, offsets = words_of(column.slice(low, len(bounds) - 1))
        if len(words):
            yield low, words, offsets, known.numbered(words)


def pair_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """How often the texts hold each pair of the items; every task adds up its own counts first."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known.pairs), np.int64)
        for batch in batches:
            for _, _, offsets, numbers in _texts(batch, known):
                pairs, _ = known.met(numbers, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)))
                total += np.bincount(pairs, minlength=len(total))
        some = np.flatnonzero(total)
        for low in range(0, len(some), 100_000):
            part = some[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["pair", "n"])

    rows = docs.select("text").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(items.pairs))
    counts[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return counts


def _proposed(known: Items, item: np.ndarray, needed: np.ndarray, span: np.ndarray, offsets: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, start, stop) of the stretches that meet enough places of an item to hold a copy; ``item`` of each place."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pairs, firsts = known.met(numbers, row)
    order = np.argsort(firsts, kind="stable")
    pairs, firsts = pairs[order], firsts[order]
    count = known.begins[pairs + 1] - known.begins[pairs]
    upto = np.concatenate(([0], np.cumsum(count)))
    ends = np.searchsorted(row[firsts], np.arange(len(offsets)))  # hits before each row
    low = 0
    while low < len(ends) - 1:
        high = max(low + 1, int(np.searchsorted(upto[ends], upto[ends[low]] + EXPANDED, "right")) - 1)
        part = slice(ends[low], ends[high])
        low, n = high, count[part]
        if not n.sum():
            continue
        ramp = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = known.places[np.repeat(known.begins[pairs[part]], n) + ramp]
        at, k = np.repeat(firsts[part], n), item[place]
        order = np.lexsort((at, k, row[at]))
        at, k, place = at[order], k[order], place[order]
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (np.diff(row[at]) > 0) | (np.diff(k) != 0) | (np.diff(at) > span[k[1:]])
        group = np.cumsum(new) - 1
        places = np.bincount(np.unique(group * len(known.words) + place) // len(known.words))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        for g in np.flatnonzero(places >= needed[k[first]]).tolist():
            own, r = int(k[first[g]]), int(row[at[first[g]]])
            yield r, own, max(int(offsets[r]), int(at[first[g]] - span[own])), min(int(offsets[r + 1]), int(at[last[g]] + REACH + 1 + span[own]))


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and where it ends in the passage.

    Row by row over the item; gaps along the passage are a running maximum, so each row is one vector step.
    """
    slope = GAP * np.arange(len(passage) + 1)
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros(len(passage) + 1, np.int64)
        row[1:] = np.maximum(0, np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] - GAP))
        row = np.maximum.accumulate(row + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def row_key() -> tuple[Column, Column]:
    """What tells rows apart, also those that share a doc_id or have none: doc_id and the hash of the text."""
    return F.col("doc_id").cast("long"), F.xxhash64("text")


def _exact(known: Items, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, start, stop) of the first occurrence of each short item in each row."""
    for n, (whole, own) in known.short.items():
        grams, upto = shingle_hashes(words, offsets, n)
        low, high = np.searchsorted(whole, grams, "left"), np.searchsorted(whole, grams, "right")
        seen = set()
        for at in np.flatnonzero(high > low).tolist():
            r = int(np.searchsorted(upto, at, "right")) - 1
            start = at - int(upto[r])
            if start + n > offsets[r + 1] - offsets[r]:
                continue
            for k in own[low[at] : high[at]].tolist():
                if (r, k) not in seen:
                    seen.add((r, k))
                    yield r, k, start, start + n


def copies(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    """Copies of the items in every row: doc_id, text_key (hash of its text), item_id, score, start_word, end_word."""
    shared = docs.sparkSession.sparkContext.broadcast(items.rarest(pair_counts(docs, items), threshold))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, needed = shared.value
        size = np.diff(known.offsets)
        item, least = np.repeat(np.arange(len(size)), size), _least(size, threshold)
        # Words of a copy: the item's and at most 2m - 2tL added ones.
        span = 3 * size - 2 * least + REACH
        memory: dict[tuple[int, bytes], tuple[float, int, int]] = {}
        for batch in batches:
            ids, rows = [(r["doc_id"], r["text_key"]) for r in batch.select(["doc_id", "text_key"]).to_pylist()], []
            for low, words, offsets, numbers in _texts(batch, known):
                rows += [(*ids[low + row], int(known.ids[k]), 1.0, start, stop) for row, k, start, stop in _exact(known, words, offsets)]
                numbers = numbers.astype(np.int32)
                for row, k, start, stop in _proposed(known, item, needed, span, offsets, numbers.astype(np.int64)):
                    passage, target = numbers[start:stop], known.words[known.offsets[k] : known.offsets[k + 1]]
                    if np.isin(target, passage).sum() < least[k]:
                        continue
                    key = (k, passage.tobytes())
                    if key not in memory:
                        if len(memory) >= REMEMBERED:
                            memory.clear()
                        score, end = align(passage, target)
                        share = score / (MATCH * len(target))
                        memory[key] = (share, end - align(passage[:end][::-1], target[::-1])[1] if share >= threshold else 0, end)
                    share, begin, end = memory[key]
                    if share >= threshold:
                        base = start - int(offsets[row])
                        rows.append((*ids[low + row], int(known.ids[k]), share, base + begin, base + end))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                names = ["doc_id", "text_key", "item_id", "score", "start_word", "end_word"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(*(c.alias(n) for c, n in zip(row_key(), ("doc_id", "text_key"))), "text").mapInArrow(
        work, "doc_id long, text_key long, item_id long, score double, start_word long, end_word long"
    )


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[Items]:
    """Items by hash blocks of about ``block_words`` words, so what a scan carries is bounded."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").distinct()
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")) + F.length(F.regexp_replace("text", _NOT_BLANKLESS, "")))).first()[0] or 0
    blocks = -(-total // block_words)
    for b in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        items = Items.of([r.item_id for r in own], [r.text for r in own])
        if len(items.words):
            yield items


def rows_with_copies(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Copies of test items in every row, as ``copies`` gives them. A threshold at which single words are enough is refused."""
    if threshold * MIN_ITEM_WORDS <= 1:
        raise ValueError(f"a threshold of {threshold} is reached by single words")
    out = None
    for items in _blocks(benchmark, block_words):
        found = copies(docs, items, threshold)
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_key long, item_id long, score double, start_word long, end_word long")
    return out


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Copies of test items in documents: doc_id, item_id, score, start_word, end_word (best one per pair).

    ``score`` is the alignment score over the item's best possible one; word offsets count plain words.
    Null and empty texts and items hold nothing. An item under MIN_ITEM_WORDS words is found in every text that
    holds its words in a row, even a single word (score 1, first occurrence). Equal texts under one item_id count once; several texts under it are several items whose best score counts. Repeated
    documents give one row; texts that share a doc_id, or have none, are all searched and their best score counts.
    """
    best = F.max(F.struct("score", "start_word", "end_word")).alias("b")
    out = rows_with_copies(docs, benchmark, threshold, block_words)
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.start_word", "b.end_word")
