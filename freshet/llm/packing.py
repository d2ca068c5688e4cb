"""Best-fit packing of tokenised documents: Martello-Toth dominance reduction, then best fit.

Packing only depends on how many pieces there are of each length, so the plan is made on the length
histogram (at most ``capacity`` entries, whatever the corpus) and its bins carry multiplicities. The
work that grows with the corpus (tokenising, ranking pieces of a length, placing them) is done by Spark.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import CHUNK_BYTES, byte_chunks, column_of, spread_rank
from freshet.runtime import pin

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words kept per worker in each of two generations; what falls out is encoded again when met again.
STORE_WORDS = 250_000
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_stores: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Ids of texts as little-endian bytes, through a store of the ids of single words.

    The vocabulary's splitting pattern never joins characters over white space, so a text's ids are the
    ids of its space-separated words one after the other. It also parts letters from the marks after them.
    Words of letters are encoded many at a time: each is one piece and ends with an id whose token bears
    the word-end mark. Anything else, and any batch whose ends do not add up, is encoded word by word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[ends] = True
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> None:
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) == len(some):
                raw, low = ids.tobytes(), 0
                for word, high in zip(some, cuts.tolist()):
                    self.store[word] = raw[low:high]
                    low = high
            else:
                self.store.update((w, self._one(w)) for w in some)

    def _learn(self, words: list[str]) -> None:
        store, older = self.store, self.older
        letters: set[str] = set()
        marked: list[tuple[str, str]] = []
        for word in words:
            if word in older:
                store[word] = older[word]
            elif word.isalpha():
                letters.add(word)
            else:
                head = word.rstrip(_MARKS)
                if head.isalpha():
                    marked.append((word, head))
                    if head in older:
                        store[head] = older[head]
                    elif head not in store:
                        letters.add(head)
                else:
                    store[word] = self._one(word)
        self._letters(list(letters))
        for word, head in marked:
            mark = word[len(head) :]
            if mark not in store:
                store[mark] = self._one(mark)
            store[word] = store[head] + store[mark]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of the texts."""
        if len(self.store) > STORE_WORDS:
            self.older, self.store = self.store, {}
        lists = pc.split_pattern(pc.replace_substring(_lowered(texts), "\n", " "), " ")
        coded = pc.dictionary_encode(lists.flatten())
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        store = self.store
        new = [w for w in words if w not in store]
        if new:
            self._learn(new)
        codes = list(map(store.__getitem__, words))
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        flat = np.frombuffer(b"".join(codes), "<u4")
        first = np.concatenate(([0], np.cumsum(sizes)))
        each = sizes[at]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(first[at] - ends + each, each) + np.arange(total)]
        words_before = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, np.concatenate(([0], ends))[words_before]


def _lowered(texts: pa.Array) -> pa.Array:
    """Lowered as far as the vocabulary itself would for sure: whole Latin-1 texts, else only A-Z.

    Texts that may hold a special token's name stay as they are, and so do texts with combining marks: the
    vocabulary composes before it lowers, and some marks compose with small letters only.
    """
    texts = pc.fill_null(texts, "")
    _, data, offsets = next(byte_chunks(texts, 1 << 60))
    beyond = np.concatenate(([0], np.cumsum(data >= 0xC4)))
    beyond = pa.array(np.diff(beyond[offsets]) > 0)
    # U+0300 to U+037F begin with these bytes and nothing else does; no other mark composes with A-Z.
    marks = np.concatenate(([0], np.cumsum((data == 0xCC) | (data == 0xCD))))
    named = pc.or_(pc.match_substring(texts, "<|"), pa.array(np.diff(marks[offsets]) > 0))
    out = pc.if_else(beyond, pc.ascii_lower(texts), pc.utf8_lower(texts)) if pc.any(beyond).as_py() else pc.utf8_lower(texts)
    return pc.if_else(named, texts, out) if pc.any(named).as_py() else out


def encoder(path: str) -> WordEncoder:
    if path not in _stores:
        _stores[path] = WordEncoder(path)
    return _stores[path]


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32. A null text is empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoder(tokenizer_path or public_tokenizers.path(TOKENIZER))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids = column_of(batch, "doc_id").to_pylist()
            column = column_of(batch, "text")
            for low, _, bounds in byte_chunks(column, 3 * CHUNK_BYTES):
                tokens, offsets = encode(column.slice(low, len(bounds) - 1))
                raw, rows = tokens.tobytes(), []
                for doc, start, stop in zip(ids[low:], offsets[:-1].tolist(), offsets[1:].tolist()):
                    codes = raw[4 * start : 4 * stop] + end
                    for k, at in enumerate(range(0, len(codes), 4 * capacity)):
                        own = codes[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


Content = tuple[tuple[int, int], ...]  # (length, pieces of it) pairs of a bin, in order of place


@dataclass
class Plan:
    """Bins in groups of equal content: ``groups[g] = (content, multiplicity, first sequence id)``.

    ``fixed`` counts the bins that the reduction settled for good.
    """

    groups: list[tuple[Content, int, int]]
    fixed: int

    @property
    def bins(self) -> int:
        return sum(m for _, m, _ in self.groups)


class _Counts:
    """Counts by length with the sorted lengths that are left."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {k: v for k, v in histogram.items() if v > 0}
        self.lengths = sorted(self.n)

    def take(self, length: int, many: int) -> None:
        self.n[length] -= many
        if not self.n[length]:
            del self.n[length]
            del self.lengths[bisect_left(self.lengths, length)]

    def largest_within(self, room: int) -> int | None:
        i = bisect_left(self.lengths, room + 1) - 1
        return self.lengths[i] if i >= 0 else None

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for x in self.lengths:
            out += [x] * min(self.n[x], k - len(out))
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int) -> int:
        """Largest sum of two different pieces that is at most ``room``; 0 if there is none."""
        best, lo, hi = 0, 0, bisect_left(self.lengths, room + 1) - 1
        while lo <= hi:
            a, b = self.lengths[lo], self.lengths[hi]
            if a + b > room:
                hi -= 1
                continue
            if lo != hi or self.n[a] > 1:
                best = max(best, a + b)
            lo += 1
        return best


def reduce_by_dominance(counts: _Counts, capacity: int) -> list[tuple[Content, int]]:
    """Fix the bins of the largest pieces for which one choice of partners dominates all others.

    For a largest piece j with room r: (1) nothing fits beside it: {j}. (2) A piece k fills r exactly, or
    (3) at most one more piece can fit: {j, k} with the largest k within r. (4) At most two can, and no
    two sum to more than k: {j, k}. In each case every other content of the bin could be exchanged for k
    without needing more bins. Equal pieces are fixed together. A piece without such a choice is passed
    over, and later pieces, which are smaller, are judged with what is left in sight.
    """
    fixed: list[tuple[Content, int]] = []
    for j in reversed(list(counts.lengths)):
        while counts.n.get(j):
            partners = _partners(counts, j, capacity - j)
            if partners is None:
                break
            if not partners:
                many, content = counts.n[j], ((j, 1),)
            elif partners == [j]:
                many, content = counts.n[j] // 2, ((j, 2),)
            else:
                many, content = min(counts.n[j], counts.n[partners[0]]), ((j, 1), (partners[0], 1))
            for length, slots in content:
                counts.take(length, many * slots)
            fixed.append((content, many))
    return fixed


def _partners(counts: _Counts, j: int, room: int) -> list[int] | None:
    """The partners that dominate all others beside one piece j: none, one, or not decided."""
    small = counts.smallest(4)
    if small[0] == j:  # the piece itself is no partner of its own
        small = small[1:]
    if not small or small[0] > room:
        return []
    k = counts.largest_within(room)
    if k == j and counts.n[j] == 1:
        at = bisect_left(counts.lengths, j)
        k = counts.lengths[at - 1] if at else None
    if k is None:
        return None
    alone = len(small) < 2 or small[0] + small[1] > room
    two = len(small) < 3 or sum(small[:3]) > room
    if k == room or alone or (two and counts.best_pair(room) <= k):
        return [k]
    return None


def best_fit(counts: _Counts, capacity: int) -> list[tuple[Content, int]]:
    """Best fit, longest first, on groups of equal bins."""
    rooms: list[int] = []
    open_bins: dict[int, list[list]] = {}  # room -> [[content, multiplicity]]

    def put(content: Content, many: int, room: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append([content, many])

    for length in sorted(counts.n, reverse=True):
        left = counts.n[length]
        while left:
            at = bisect_left(rooms, length)
            fresh = at == len(rooms)  # no open bin has room
            room = capacity if fresh else rooms[at]
            group = [(), left] if fresh else open_bins[room][-1]
            each = min(room // length, left)
            used = min(group[1], left // each)
            if not fresh:
                group[1] -= used
                if not group[1]:
                    open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room], rooms[at]
            put((*group[0], (length, each)), used, room - each * length)
            left -= used * each
    return [(content, many) for groups in open_bins.values() for content, many in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    counts = _Counts({k: v for k, v in histogram.items() if k < capacity})
    full = histogram.get(capacity, 0)
    fixed = ([(((capacity, 1),), full)] if full else []) + reduce_by_dominance(counts, capacity)
    groups, first = [], 0
    for content, many in [*fixed, *best_fit(counts, capacity)]:
        groups.append((content, many, first))
        first += many
    return Plan(groups, sum(m for _, m in fixed))


def _segments(made: Plan) -> dict[int, np.ndarray]:
    """For each length the runs of ranks that share a group: rows (first rank, slots per bin, sequence, offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    next_rank: dict[int, int] = {}
    for content, many, first in made.groups:
        offset = 0
        for length, slots in content:
            rank = next_rank.get(length, 0)
            out.setdefault(length, []).append((rank, slots, first, offset))
            next_rank[length] = rank + slots * many
            offset += slots * length
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is one piece
    holding only the end id; repeated rows are packed each; an empty table gives an empty result.
    The pieces are written once (five numbers each), counted by length, ranked within a length without
    gathering a length in one task, and placed by arithmetic on the plan's bounded table.
    """
    cut = pin(pieces(docs, tokenizer_path, capacity))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    table = _segments(plan(histogram, capacity))
    ranked = spread_rank(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (column_of(batch, c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                length = int(lengths[rows[0]])
                runs = table[length]
                run = runs[np.searchsorted(runs[:, 0], ranks[rows], "right") - 1]
                within = ranks[rows] - run[:, 0]
                sequence[rows] = run[:, 2] + within // run[:, 1]
                offset[rows] = run[:, 3] + within % run[:, 1] * length
            kept = [column_of(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
