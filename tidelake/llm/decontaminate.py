"""Benchmark decontamination with suffix arrays over the training documents.

Each chunk of documents is a shard: the word ids of its texts, in one sequence, with their suffixes sorted. The
benchmark comes to the shards in blocks of bounded size, one after another, and every suffix of a benchmark item is
looked up in every shard by binary search; suffixes that share the first ``window`` words are looked up as one. Words
that no item of the block has get id zero, which matches nothing, so suffixes that start with one needn't be sorted:
they can't match. Where a window occurs, the document's suffixes are looked up in the block's own suffix array, whose
neighbours give the longest verbatim match and its place in the item.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import chunks, free

#: Text bytes of the benchmark that go to the executors at once; a larger benchmark takes more passes.
BLOCK_BYTES = 4 << 20

# A-Z become a-z; 0-9, a-z and what is not ASCII stay; all else separates words
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def suffix_order(ids):
    """The suffixes of a sequence of non-negative integers in order, by doubling the length of what is compared."""
    import numpy as np

    n = len(ids)
    rank, size = np.asarray(ids, np.int64) + 1, 1
    while n:
        after = np.concatenate([rank[size:], np.zeros(min(size, n), np.int64)])
        _, rank = np.unique(rank * (int(max(rank.max(), n)) + 2) + after, return_inverse=True)
        rank = rank.ravel() + 1
        if rank.max() == n or size >= n:
            break
        size *= 2
    return np.argsort(rank, kind="stable")


class Block:
    """A part of the benchmark: its words' ids, its item sequences, its distinct windows and whose they are, its suffix array."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import numpy as np

        self.window, self.ids, self.items, found = window, {}, [], defaultdict(set)
        flat: list[int] = []
        self.starts = []
        for item, text in items:
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            if seq:
                self.items.append((item, seq))
                self.starts.append(len(flat))
                flat += [*seq, 0]
                for at in range(max(1, len(seq) - window + 1)):
                    found[tuple(seq[at : at + window])].add(item)
        self.windows = [(w, sorted(of)) for w, of in found.items()]
        self.most = max((len(seq) for _, seq in self.items), default=0)
        self.flat, self.order = flat, suffix_order(np.array(flat, np.int64)).tolist()

    def _place(self, seq: list[int]) -> int:
        lo, hi, flat, order, n = 0, len(self.order), self.flat, self.order, len(seq)
        while lo < hi:
            mid = (lo + hi) >> 1
            if flat[order[mid] : order[mid] + n] < seq:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def holds(self, seq: list[int]) -> bool:
        """Whether an item holds the whole of ``seq``."""
        lo = self._place(seq)
        return lo < len(self.order) and self.flat[self.order[lo] : self.order[lo] + len(seq)] == seq

    def longest(self, seq: list[int]) -> tuple[int, str, int]:
        """(words, item, place in it) of the longest prefix of ``seq`` that is in an item, the first such item and place.

        The neighbours in the suffix order share most; whatever shares as much stands beside them.
        """
        lo, flat, order, n = self._place(seq), self.flat, self.order, len(seq)
        best, places = 0, []
        for k, step in ((lo, 1), (lo - 1, -1)):
            while 0 <= k < len(order):
                at, m = order[k], 0
                while m < n and at + m < len(flat) and flat[at + m] == seq[m] and seq[m]:
                    m += 1
                if m < max(best, 1):
                    break
                if m > best:
                    best, places = m, []
                i = bisect_right(self.starts, at) - 1
                places.append((self.items[i][0], at - self.starts[i]))
                k += step
        return (best, *min(places)) if places else (0, "", 0)


class Shard:
    """A suffix array over word ids, ordered by the suffixes' first ``depth`` words."""

    def __init__(self, ids, depth: int, most: int):
        import numpy as np

        self.ids, self.depth = ids, depth
        self.bits = max(1, int(most).bit_length())
        self.each = 63 // self.bits
        padded = np.concatenate([ids, np.zeros(depth, ids.dtype)])
        at = np.flatnonzero(ids)
        keys = []
        for first in range(0, depth, self.each):
            key = np.zeros(len(at), np.int64)
            for j in range(first, min(first + self.each, depth)):
                key = key << self.bits | padded[at + j]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        self.order, self.keys = at[order], [k[order] for k in keys]

    def pack(self, rows, fill: int):
        """The keys of word sequences (a list of lists), filled up with ``fill`` to the depth."""
        import numpy as np

        full = np.full((len(rows), self.depth), fill, np.int64)
        for i, r in enumerate(rows):
            full[i, : min(len(r), self.depth)] = r[: self.depth]
        out = []
        for first in range(0, self.depth, self.each):
            key = np.zeros(len(rows), np.int64)
            for j in range(first, min(first + self.each, self.depth)):
                key = key << self.bits | full[:, j]
            out.append(key)
        return out

    def bound(self, sought, after: bool):
        """Binary search of all sought keys at once: the number of suffixes before each (after: or equal to it)."""
        import numpy as np

        lo = np.zeros(len(sought[0]), np.int64)
        hi = np.full(len(sought[0]), len(self.order), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            probe = np.minimum(mid, len(self.order) - 1)
            less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for own, key in zip(self.keys, sought):
                less |= same & (own[probe] < key)
                same &= own[probe] == key
            left = less | same if after else less
            lo = np.where(open_ & left, mid + 1, lo)
            hi = np.where(open_ & ~left, mid, hi)
        return lo

    def occurrences(self, low, high):
        """Where the sequences start: (index of the sequence, position) of each of its occurrences."""
        import numpy as np

        a, b = self.bound(low, False), self.bound(high, True)
        n = np.maximum(b - a, 0)
        which = np.repeat(np.arange(len(n)), n)
        return which, self.order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]

    def longest(self, seqs: list[list[int]], low) -> tuple:
        """For each sequence the length of its longest prefix that occurs in the shard, and a position where it does.

        The neighbours of a sequence's place in the suffix order share most with it, as far as the order goes; within
        it, all suffixes that share its whole depth are compared in full.
        """
        import numpy as np

        place, best, where = self.bound(low, False), np.zeros(len(seqs), np.int64), np.full(len(seqs), -1, np.int64)
        for i, seq in enumerate(seqs):
            near = [int(place[i]) - 1, int(place[i])]
            j = near[1] + 1
            full = seq[: self.depth]
            while len(seq) > self.depth and j < len(self.order) and list(self.ids[self.order[j] : self.order[j] + self.depth]) == full:
                near.append(j)
                j += 1
            for k in near:
                if 0 <= k < len(self.order):
                    at, n = int(self.order[k]), 0
                    while n < len(seq) and at + n < len(self.ids) and self.ids[at + n] == seq[n]:
                        n += 1
                    if n > best[i]:
                        best[i], where[i] = n, at
        return best, where


def blocks(benchmark: DataFrame, window: int, most: int = BLOCK_BYTES):
    """The benchmark's items, in blocks of at most ``most`` bytes (or one item); they pass the driver one at a time."""
    items, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").cast("binary").alias("t")).where("t is not null").toLocalIterator():
        if items and size + len(row.t) > most:
            yield Block(items, window)
            items, size = [], 0
        items.append((row.i, bytes(row.t)))
        size += len(row.t)
    if items:
        yield Block(items, window)


def _shard(texts: list[bytes], block: Block, depth: int):
    """The shard of these texts, each text's first position in it and its number of words."""
    import numpy as np

    get, parts, n_words = block.ids.get, [], []
    for text in texts:
        w = words(text)
        n_words.append(len(w))
        parts.append(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)))
        parts.append(np.zeros(1, np.int64))  # no match runs over the end of a text
    n_words = np.array(n_words, np.int64)
    return Shard(np.concatenate(parts), depth, len(block.ids)), np.cumsum(n_words + 1) - n_words - 1, n_words


def _find(texts: list[bytes], runs: list, items: list, matches: list, block: Block) -> tuple[list[int], list, list, list]:
    """For each text its number of words, the maximal runs of hit words, the items that occur, and the longest match.

    ``runs``, ``items`` and ``matches`` hold what other blocks have found.
    """
    import numpy as np

    shard, first, n_words = _shard(texts, block, block.window)
    hit = np.zeros(len(shard.ids) + 1, np.int64)
    own, best = [set(x or ()) for x in items], list(matches)
    if len(shard.order):
        seqs = [w for w, _ in block.windows]
        which, at = shard.occurrences(shard.pack(seqs, 0), shard.pack(seqs, (1 << shard.bits) - 1))
        size = np.array([len(s) for s in seqs], np.int64)[which]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + size, -1)
        text_of = np.searchsorted(first, at, "right") - 1
        for t, w in set(zip(text_of.tolist(), which.tolist())):
            own[t].update(block.windows[w][1])
        ahead = _windows_ahead(at[size == block.window], len(shard.ids))
        for t, ends in _hit_words(hit, first).items():
            for a, b in ends:
                # a match of more words than a window starts a window at each of its places but the last ones, and stays within an item and the run
                reach = np.minimum(np.minimum(block.window - 1 + ahead[a:b], block.most), np.arange(b - a, 0, -1))
                known = best[t]["words"] if best[t] else 0
                for p in (a + np.flatnonzero(reach > known)).tolist():
                    end = p + int(reach[p - a])
                    if end - p <= known or not block.holds(shard.ids[p : p + known + 1].tolist()):
                        continue
                    n, item, item_at = block.longest(shard.ids[p:end].tolist())
                    best[t], known = {"words": n, "doc_at": p - int(first[t]), "item": item, "item_at": item_at}, n
                    if known == block.most:
                        break
    for t, old in enumerate(runs):
        for r in old or ():
            hit[first[t] + r["start"]] += 1
            hit[first[t] + r["end"]] -= 1
    found = _hit_words(hit, first)
    out = [[{"start": a - int(first[t]), "end": b - int(first[t])} for a, b in found.get(t, ())] for t in range(len(texts))]
    return n_words.tolist(), out, [sorted(x) for x in own], best


def _windows_ahead(at, size: int):
    """For each of ``size`` places how many places from it on, without a gap, are in ``at``."""
    import numpy as np

    gap = np.arange(size + 1)
    gap[at] = size
    return np.minimum.accumulate(gap[::-1])[::-1][:size] - np.arange(size)


def _hit_words(hit, first) -> dict[int, list[tuple[int, int]]]:
    """The maximal runs of places that a positive running sum of ``hit`` covers, by text."""
    import numpy as np

    covered = np.concatenate([[False], np.cumsum(hit)[:-1] > 0, [False]])
    edge = np.diff(covered.astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b, t in zip(start.tolist(), end.tolist(), (np.searchsorted(first, start, "right") - 1).tolist()):
        out.setdefault(t, []).append((a, b))
    return out


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_MATCH = T.StructType([T.StructField("words", T.LongType()), T.StructField("doc_at", T.LongType()), T.StructField("item", T.StringType()), T.StructField("item_at", T.LongType())])
NAMES = ("__n_words", "__runs", "__items", "__longest")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, into: tuple[str, str, str, str] = NAMES) -> DataFrame:
    """``docs`` with four more columns, named by ``into``: the number of words, maximal runs of hit words (start, end), items, the longest match.

    A window is ``window`` consecutive words of a benchmark item, or the whole of a shorter item that has any; words
    of a document inside any occurrence of a window are hit. The items are the ids, as strings, of those with a window
    that occurs, sorted; an item without an id is called "null". The longest match (words, doc_at, item, item_at) is a
    longest verbatim one within the runs, the first in the document; null without a run. Null and empty texts have no
    words, so nothing occurs in them; an empty benchmark hits nothing. All other columns and repeated rows stay as they
    are; names of ``into`` that the documents have already are an error.
    """
    names = docs.columns
    if set(into) & set(names):
        raise ValueError(f"a column of {into} is there already")
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(into, (T.LongType(), _RUNS, T.ArrayType(T.StringType()), _MATCH))]])
    sc = docs.sparkSession.sparkContext
    at = names.index("text")
    sent = [sc.broadcast(block) for block in blocks(benchmark, window, block_bytes)] or [sc.broadcast(Block([], window))]

    def each(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        match = pa.struct([("words", pa.int64()), ("doc_at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())])
        # several blocks take turns in a worker, so they pass larger chunks
        for part in chunks(batches, at, (4 if len(sent) == 1 else 16) << 20):
            texts = [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]
            found = (None, [None] * len(texts), [None] * len(texts), [None] * len(texts))
            for one in sent:
                found = _find(texts, *found[1:], one.value)
                if len(sent) > 1:
                    del one._value
            types = [pa.int64(), span, pa.list_(pa.string()), match]
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, t) for x, t in zip(found, types)]], [*names, *into])

    return docs.mapInArrow(each, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, item_at, doc_id, doc_at, n_words): for every benchmark suffix its longest verbatim match in the corpus.

    Positions and lengths are in words; matches of fewer than ``least`` words are left out, and so are suffixes whose
    predecessor's match holds theirs. Of equally long matches the one with the smallest doc_id and position is given.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()

    def passed(sent):
        def each(batches):
            import numpy as np
            import pyarrow as pa

            block = sent.value
            seqs = [(item, at, seq[at:]) for item, seq in block.items for at in range(len(seq))]
            for part in chunks(batches, 1, 4 << 20):
                ids = part.column(0).to_pylist()
                shard, first, _ = _shard([x or b"" for x in part.column(1).to_pylist()], block, 12)
                if not len(shard.order) or not seqs:
                    continue
                size, where = shard.longest([s for *_, s in seqs], shard.pack([s for *_, s in seqs], 0))
                rows = [
                    (seqs[i][0], seqs[i][1], ids[t], int(where[i] - first[t]), int(size[i]))
                    for i in np.flatnonzero(size >= least).tolist()
                    for t in [int(np.searchsorted(first, where[i], "right")) - 1]
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["item_id", "item_at", "doc_id", "doc_at", "n_words"])

        return each

    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = f"item_id string, item_at long, doc_id {kind}, doc_at long, n_words long"
    found = None
    for block in blocks(benchmark, 12, block_bytes):
        one = source.mapInArrow(passed(sc.broadcast(block)), schema)
        found = one if found is None else found.union(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = found.groupBy("item_id", "item_at").agg(F.min(F.struct(-F.col("n_words"), "doc_id", "doc_at")).alias("b"))
    best = best.select("item_id", "item_at", F.col("b.doc_id").alias("doc_id"), F.col("b.doc_at").alias("doc_at"), (-F.col("b.col1")).alias("n_words"))
    before = best.select("item_id", (F.col("item_at") + 1).alias("item_at"), (F.col("n_words") - 1).alias("held"))
    return best.join(before, ["item_id", "item_at"], "left").where("held is null or n_words > held").drop("held")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with their own columns, whatever these are called.

    Null and empty texts, repeated rows and empty tables are as in scan().
    """
    into = tuple(free(docs.columns, n) for n in ("n_words", "runs", "items", "longest"))
    return scan(docs, benchmark, window, into=into).where(F.size(into[1]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
