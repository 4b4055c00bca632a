"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The benchmark is indexed, not the corpus: postings hold each term's BM25 impact divided by the item's score against
itself, so that one threshold serves items of any length. Every passage (a window of words, see WINDOW) of
every text is a query. Impacts of a term come in blocks of BLOCK postings with their largest impact. A passage ends at once
if no item can reach the threshold by what its rare terms bring and the most that common terms could; all others run the full search, whose pivots are skipped where block maxima can't reach it. What is retrieved is verified on k-word shingles of
question (all but the last sentence of the item) and answer (the last sentence; an item of one sentence is both).

The index goes to the executors in shards of about SHARD_CHARS of item text, one scan of the corpus each and one shard in
memory at a time, so that what is broadcast stays bounded however large the benchmark is. Document frequencies, the number
of items and their mean length are those of all shards, so that shards change no result. Within a shard, items are indexed
by classes of length, each with passages of its own length: a long item doesn't widen the passages of short ones.

Words are compared without punctuation at their ends. One changed word takes up to SHINGLE shingles, more than a short half
can miss, so a half of fewer than HALF_WORDS words is also held if that many words at its end of the item are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import PUNCT, Words, distinct, released, slices, text_slices
from .shared import written

#: Words of a passage, at least; passages are twice as long as the longest item of the class and half overlap, so that one of
#: them holds all of it.
WINDOW = 128
BLOCK = 16
K1, B = 1.2, 0.75
THRESHOLD = 0.75
MIN_OVERLAP = 0.8
SHINGLE = 5
#: The fewest words at which one changed word leaves MIN_OVERLAP of the shingles.
HALF_WORDS = 29
#: A term of more than this share of the items is common.
COMMON = 0.02
SHARD_CHARS = 32_000_000
#: From so many items on, a passage's scores are summed by the items it meets instead of for all.
DENSE_ITEMS = 20_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bare_words(text: pa.Array) -> Words:
    """Words without the punctuation at their ends; a word of nothing else stays as it is."""
    words = Words(text)
    data = words.data
    end = PUNCT[data]
    # General Punctuation (E2 80 xx), inverted marks, guillemets and the middle dot (C2 xx), ideographic marks (E3 80 81-91)
    wide = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) | (data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] >= 0x81) & (data[2:] <= 0x91))
    for j in range(3):
        end[wide + j] = True
    pair = np.flatnonzero((data[:-1] == 0xC2) & np.isin(data[1:], [0xA1, 0xAB, 0xB7, 0xBB, 0xBF]))
    end[pair] = end[pair + 1] = True
    inner = np.flatnonzero(~end)
    low, high = np.searchsorted(inner, words.start), np.searchsorted(inner, words.end)
    some = high > low
    words.start[some], words.end[some] = inner[low[some]], inner[high[some] - 1] + 1
    words.hash = words.hashed(words.start, words.end)
    return words


def question_and_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; a single sentence is both."""
    cut = [m.end() for m in re.finditer(r"[.?!]+[\x20\x09-\x0D]+", text.strip())]
    return (text.strip()[: cut[-1]], text.strip()[cut[-1] :]) if cut else (text, text)


def lengthened(text: str) -> tuple[str, str]:
    """Question and answer, each of HALF_WORDS words at least if the item has them: the first of it, and the last."""
    halves = question_and_answer(text)
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    whole = text[: spans[: HALF_WORDS][-1][1]], text[spans[-HALF_WORDS:][0][0] :]
    return tuple(max(h, w, key=lambda x: len(x.strip())) for h, w in zip(halves, whole))


@dataclass
class Statistics:
    """Of all items: their number, their mean length in words, and term hashes (ascending) with the items that have each."""

    items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        words = bare_words(pa.array(texts, pa.string()))
        doc, term = distinct(words.doc, words.hash)
        terms, df = np.unique(term, return_counts=True)
        return cls(len(texts), float(words.count.mean()) if texts else 1.0, terms, df)


class Index:
    """Postings of a shard of items, by term: items (ascending), impacts, and block maxima."""

    def __init__(self, items: list[tuple[int, str]], known: Statistics | None = None) -> None:
        items = sorted((i, t) for i, t in items if t and t.strip())
        known = known or Statistics.of([t for _, t in items])
        self.ids = [i for i, _ in items]
        words = bare_words(pa.array([t for _, t in items], pa.string()))
        length = words.count.astype(float)
        self.window = max(WINDOW, 2 * int(words.count.max(initial=0)))
        self.terms, at = np.unique(words.hash, return_inverse=True)
        key, tf = np.unique(at.astype(np.int64) * max(1, len(items)) + words.doc, return_counts=True)
        term, item = key // max(1, len(items)), key % max(1, len(items))
        df = known.df[np.searchsorted(known.terms, self.terms)] if len(self.terms) else np.zeros(0, int)
        idf = np.log1p((known.items - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / known.mean))
        impact /= np.maximum(np.bincount(item, impact, len(items)), 1e-12)[item]
        cut = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.items = [item[a:b] for a, b in zip(cut[:-1], cut[1:])]
        self.impacts = [impact[a:b] for a, b in zip(cut[:-1], cut[1:])]
        self.blocks = [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)) for x in self.impacts]
        self.top = np.array([x.max() for x in self.impacts])
        # terms of many items, and the most that all of them together bring to any one item
        self.rare = df <= max(2, COMMON * known.items)
        self.item_common = np.bincount(item, impact * ~self.rare[term], max(1, len(items)))
        self.common = float(self.item_common.max(initial=0.0))
        # the first item with the same text
        first: dict[str, int] = {}
        self.same = np.array([first.setdefault(t, i) for i, (_, t) in enumerate(items)], np.int64)
        self.cut, self.post_item, self.post_impact = cut, item, impact
        # question, answer, and both lengthened
        pairs = [question_and_answer(t) + lengthened(t) for _, t in items]
        self.parts, self.halves = [], []
        for half in zip(*pairs) if pairs else ((),) * 4:
            own = bare_words(pa.array(half, pa.string()))
            self.halves.append(np.split(own.hash, np.cumsum(own.count)[:-1]) if len(half) else [])
            doc, hashes = own.shingles(SHINGLE)
            order = np.argsort(doc, kind="stable")
            doc, hashes = doc[order], hashes[order]
            edge = np.searchsorted(doc, np.arange(len(items) + 1))
            self.parts.append([np.unique(hashes[a:b]) for a, b in zip(edge[:-1], edge[1:])])

    def find(self, word_hash: np.ndarray) -> np.ndarray:
        """Term numbers of words, -1 where no item has them."""
        if not len(self.terms):
            return np.full(len(word_hash), -1)
        at = np.minimum(np.searchsorted(self.terms, word_hash), len(self.terms) - 1)
        return np.where(self.terms[at] == word_hash, at, -1)

    def hopeful(self, term: np.ndarray, start: np.ndarray, end: np.ndarray, threshold: float) -> np.ndarray:
        """Whether any item may reach the threshold in the passages [start, end) of term numbers: what their rare terms
        bring it, and the most that common terms can. Of many items, only those with a rare term in the passage are met;
        those that common terms alone may bring there are summed over all their terms, once for each text."""
        out = np.zeros(len(start), bool)
        n = len(self.item_common)
        dense = n < DENSE_ITEMS
        alone = np.zeros(n, bool)
        if not dense:
            alone[np.unique(self.same[self.item_common >= threshold - 1e-9])] = True
        cut, item, weight = self.cut, self.post_item, self.post_impact
        if alone.any():
            held = alone[item]
            own_cut, own_item, own_weight = np.concatenate([[0], np.cumsum(held)])[cut], item[held], weight[held]
        step = max(1, 2_000_000 // n) if dense else 500
        for a in range(0, len(start), step):
            s, size = start[a : a + step], (end - start)[a : a + step]
            passage = np.repeat(np.arange(len(s)), size)
            t = term[np.arange(size.sum()) + np.repeat(s - np.cumsum(size) + size, size)]
            passage, t = passage[t >= 0], t[t >= 0]
            rare = self.rare[t]
            key, impact = self._met(passage[rare], t[rare], cut, item, weight)
            if dense:
                total = np.bincount(key, impact, len(s) * n).reshape(len(s), n) + self.item_common
                out[a : a + step] = (total >= threshold - 1e-9).any(1)
                continue
            key, total = _summed(key, impact)
            good = total + self.item_common[key % n] >= threshold - 1e-9
            out[a + key[good] // n] = True
            if alone.any():
                # distinct terms of the passages left, in runs of bounded numbers of postings
                pair = np.unique(passage[~out[a + passage]] * len(self.terms) + t[~out[a + passage]])
                p, t = pair // len(self.terms), pair % len(self.terms)
                run = np.cumsum(own_cut[t + 1] - own_cut[t]) // 4_000_000
                run = run[np.searchsorted(p, p)]  # a passage stays whole
                for r in np.unique(run):
                    key, total = _summed(*self._met(p[run == r], t[run == r], own_cut, own_item, own_weight))
                    out[a + key[total >= threshold - 1e-9] // n] = True
        return out

    def _met(self, passage: np.ndarray, t: np.ndarray, cut: np.ndarray, item: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """passage * items + item, and impact, of each posting of the terms t in their passages."""
        many = cut[t + 1] - cut[t]
        at = np.arange(many.sum()) + np.repeat(cut[t] - np.cumsum(many) + many, many)
        return np.repeat(passage, many) * len(self.item_common) + item[at], weight[at]

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of every item that reaches the threshold, by block-max WAND."""
        lists = [(self.items[t], self.impacts[t], self.blocks[t], float(self.top[t])) for t in terms.tolist()]
        place = [0] * len(lists)
        live = list(range(len(lists)))
        out = []
        bar = threshold - 1e-9
        while live:
            live.sort(key=lambda x: lists[x][0][place[x]])
            total, pivot = 0.0, -1
            for n, x in enumerate(live):
                total += lists[x][3]
                if total >= bar:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = int(lists[live[pivot]][0][place[live[pivot]]])
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][place[live[pivot + 1]]] == item:
                pivot += 1
            bound, skip = 0.0, None
            for x in live[: pivot + 1]:
                ids, _, blocks, _ = lists[x]
                at = place[x] + int(np.searchsorted(ids[place[x] :], item))
                if at < len(ids):
                    bound += float(blocks[at // BLOCK])
                    end = min((at // BLOCK + 1) * BLOCK, len(ids)) - 1
                    skip = int(ids[end]) + 1 if skip is None else min(skip, int(ids[end]) + 1)
            if bound < bar:
                # no item up to the nearest block end, or before the next list's item, can reach it
                to = max(item + 1, skip or item + 1)
                if pivot + 1 < len(live):
                    to = max(item + 1, min(to, int(lists[live[pivot + 1]][0][place[live[pivot + 1]]])))
                move = live[: pivot + 1]
            elif lists[live[0]][0][place[live[0]]] == item:
                score = sum(float(lists[x][1][place[x]]) for x in live[: pivot + 1] if lists[x][0][place[x]] == item)
                if score >= bar:
                    out.append((item, score))
                move, to = live[: pivot + 1], item + 1
            else:
                move, to = live[:pivot], item
            for x in move:
                place[x] += int(np.searchsorted(lists[x][0][place[x] :], to))
            live = [x for x in live if place[x] < len(lists[x][0])]
        return out


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    if not len(key):
        return key, value
    order = np.argsort(key)
    begin = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
    return key[order][begin], np.add.reduceat(value[order], begin)


def _matches(text: pa.Array, indexes: list[Index]) -> list[tuple[int, int, float, float, float]]:
    """(row, item, score, question overlap, answer overlap) of an array's verified rows."""
    words = bare_words(text)
    return [hit for index in indexes for hit in _hits(words, index)]


def _hits(words: Words, index: Index) -> list[tuple[int, int, float, float, float]]:
    term = index.find(words.hash)
    bound = np.concatenate([[0.0], np.cumsum(np.where((term >= 0) & index.rare[term], index.top[term], 0.0) if len(index.top) else np.zeros(len(term)))])
    needed = THRESHOLD - index.common - 1e-9  # from rare terms
    first = np.cumsum(words.count) - words.count
    # windows: one for a short text, else one every half window; the last reaches the end
    window, stride = index.window, index.window // 2
    many = np.maximum(1, -(-(words.count - window) // stride) + 1)
    many[words.count == 0] = 0
    row = np.repeat(np.arange(words.n_docs), many)
    start = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * stride
    end = np.minimum(start + window, first[row] + words.count[row])
    found: dict[tuple[int, int], float] = {}
    maybe = np.flatnonzero(bound[end] - bound[start] >= needed)
    for w in maybe[index.hopeful(term, start[maybe], end[maybe], THRESHOLD)].tolist() if len(index.top) else []:
        terms = np.unique(term[start[w] : end[w]])
        terms = terms[terms >= 0]
        for item, score in index.search(terms, THRESHOLD):
            key = (int(row[w]), item)
            found[key] = max(found.get(key, 0.0), score)
    out = []
    if found:
        doc, hashes = words.shingles(SHINGLE)
        order = np.argsort(doc, kind="stable")
        edge = np.searchsorted(doc[order], np.arange(words.n_docs + 1))
        hashes = hashes[order]
        for (r, item), score in found.items():
            mine = hashes[edge[r] : edge[r + 1]]
            overlap = [float(np.isin(part[item], mine).mean()) if len(part[item]) else 0.0 for part in index.parts]
            # an item or half shorter than a shingle is held as one sequence, to be found as such
            for h, part in enumerate(index.parts):
                if len(part[item]) == 1 and overlap[h] < 1:
                    overlap[h] = float(_holds(words, r, first, index, item, h))
            overlap = [max(overlap[h], overlap[h + 2]) for h in range(2)]
            if min(overlap) >= MIN_OVERLAP:
                out.append((r, index.ids[item], score, overlap[0], overlap[1]))
    return out


def _holds(words: Words, r: int, first: np.ndarray, index: Index, item: int, half: int) -> bool:
    """Whether the text has the item's half as a run of words."""
    want = index.halves[half][item]
    mine = words.hash[first[r] : first[r] + words.count[r]]
    at = np.flatnonzero(mine[: len(mine) - len(want) + 1] == want[0]) if 0 < len(want) <= len(mine) else []
    return any(np.array_equal(mine[a : a + len(want)], want) for a in at)


def _length_class(words: int) -> int:
    """0 for items of which two fit a passage of WINDOW words, then one class for each fourfold length."""
    return max(0, (2 * words - 1).bit_length() - WINDOW.bit_length() + 2) // 2 if 2 * words > WINDOW else 0


def indexed(items: list[tuple[int, str]], known: Statistics | None = None) -> list[Index]:
    """An index for each class of item lengths, all with the statistics of all items."""
    items = [(i, t) for i, t in items if t and t.strip()]
    known = known or Statistics.of([t for _, t in items])
    classes: dict[int, list[tuple[int, str]]] = {}
    for i, t in items:
        classes.setdefault(_length_class(len(_WORD.findall(t))), []).append((i, t))
    return [Index(part, known) for _, part in sorted(classes.items())]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, term, words) of each distinct term of each item, and of each item its words with a null term."""
    for batch in slices(batches):
        words = bare_words(batch.column(1))
        shard = batch.column(0).to_numpy(zero_copy_only=False)
        doc, term = distinct(words.doc, words.hash)
        yield pa.RecordBatch.from_arrays([pa.array(shard[doc]), pa.array(term.view(np.int64)), pa.array(np.zeros(len(doc), np.int64))], names=["shard", "term", "words"])
        some = words.count > 0
        yield pa.RecordBatch.from_arrays([pa.array(shard[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(words.count[some].astype(np.int64))], names=["shard", "term", "words"])


def _shards(benchmark: DataFrame) -> tuple[int, Iterator[list[Index]]]:
    """The number of shards, and the indexes of one after the other; only one is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    n = int((items.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS) + 1
    if n == 1:
        return 1, iter([indexed([(r.item_id, r.text) for r in items.toLocalIterator()])])
    dealt = items.select(F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int").alias("shard"), "item_id", "text")
    every = written(dealt.select("shard", "text").mapInArrow(_terms, "shard int, term long, words long"))
    total = every.where("term is null").agg(F.count("*").alias("items"), F.avg("words").alias("mean")).first()
    df = every.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    # the terms of a shard are bounded by its text
    held = written(every.where("term is not null").select("shard", "term").distinct().join(df, "term"))

    def shards() -> Iterator[list[Index]]:
        for shard in range(n):
            mine = held.where(F.col("shard") == shard).select("term", "df").toArrow()
            term, count = mine["term"].to_numpy().view(np.uint64), mine["df"].to_numpy()
            order = np.argsort(term)
            known = Statistics(total.items, total.mean or 1.0, term[order], count[order])
            yield indexed([(r.item_id, r.text) for r in dealt.where(F.col("shard") == shard).toLocalIterator()], known)

    return n, shards()


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc id, item_id long, score double, question_overlap double, answer_overlap double): one row for each row of docs
    and test item that it holds: retrieved with a score of THRESHOLD of the item's own or more, and question and answer
    both overlapping by MIN_OVERLAP of their shingles or more.

    Null and blank texts and items match nothing; very long texts are searched whole, as passages; repeated rows match each;
    items with equal texts are all named; rows with a null id are matched too; other columns, whatever their names, are
    ignored; an empty table on either side gives an empty result. Shards of the benchmark change no result.
    """
    out = None
    n, shards = _shards(benchmark)
    for indexes in shards:
        held = docs.sparkSession.sparkContext.broadcast(indexes)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = 0
                for part in text_slices(batch.column(1)):
                    if rows := _matches(part, held.value):
                        r, *rest = zip(*rows)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r) if not at else pa.array([x + at for x in r])), *(pa.array(x) for x in rest)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
                    at += len(part)

        kind = docs.schema[id_col].dataType.simpleString()
        found = docs.select(id_col, "text").mapInArrow(search, f"`{id_col}` {kind}, item_id long, score double, question_overlap double, answer_overlap double")
        if n > 1:
            found = written(found)
            held.destroy()
        out = found if out is None else out.union(found)
    return out


def _holder(held: Broadcast) -> Callable[[Column], Column]:
    """A function of a text column: whether it holds an item of these indexes."""

    @F.arrow_udf("boolean")
    def holds(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(hits(texts))

    def hits(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            hit, at = np.zeros(len(text), bool), 0
            for part in text_slices(text):
                hit[[at + r for r, *_ in _matches(part, held.value)]] = True
                at += len(part)
            yield pa.array(hit)

    return holds


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no test item, with all their columns; nothing is shuffled, and of a row only its text goes
    to Python. Nulls, blanks and empty tables as for contaminations(); columns of any name are kept."""
    n, shards = _shards(benchmark)
    for indexes in shards:
        held = docs.sparkSession.sparkContext.broadcast(indexes)
        docs = docs.where(~_holder(held)(F.col("text")))
        if n > 1:
            docs = written(docs)
            held.destroy()
    return docs
