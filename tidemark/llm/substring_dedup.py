"""Substring dedup by collinear chaining: passages that repeat across documents, also where single words differ.

Seeds are runs of ``K`` words whose hash is 0 modulo ``ONE_IN``, whatever stands around them: with every fifth word changed
two of five such runs are still the same. Documents meet in one of three ways. A seed of at most ``FEW`` documents joins all
of them; a more frequent one joins each to the first document that holds it and to the first in another order. A Fenwick
tree of prefix maxima chains the seeds that two documents share, in order of both, less a cost for gaps. A chain of
``SEEDS`` seeds or more over ``SPAN`` words tells a range of the document of the smaller id. The words of that range are
then sought in the whole other text by all their runs of ``K`` words, chained in the same way, aligned word by word,
extended at both ends and cut where a gap does not match. What is at least ``MIN_WORDS`` words long in either document and
matches in at least the threshold's share of them is a passage of the larger id, which repeats the smaller one, at every
place where it stands.

Two documents can share a passage of which every line is frequent, and yet each line leads both of them to another document.
So, of what is not covered then, the order of these leads is compared: a step is two neighbouring runs of seeds with different
first holders, and it is rarer than either; a single seed between two runs is no run. Steps join documents as seeds do, all holders of a rare step and the
first ones of a frequent step. Frequent steps over fewer than ``MIN_WORDS`` words make longer steps in turn, until all are
rare or so long that their first holder has the passage itself. The ranges that steps tell are sought as those of chains are.
Last, every window of ``MIN_WORDS`` words that is not covered and has no seed of its document alone is joined by its hash to
the first document that holds it, so that no exact repeat is lost, however frequent its seeds are.

Words are runs of other than ASCII space characters, compared with A-Z lower-cased. Documents of equal text repeat the
smallest id among them from end to end and are not compared further. Null ids and null, empty or shorter texts have no
passages; an id that stands for several texts is compared by each of them, and never with itself. A run of one repeated
word is no passage by itself. Ids can be of any type with an order; there can be 2**36 distinct texts, of 2**27 words each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, distinct_texts, lots, mix, shingle_hashes, text_key, window_hashes

K, ONE_IN = 3, 4
FEW = 8  #: a seed of so many documents joins all of them
SEEDS, SPAN = 3, 12  #: seeds of a chain that is looked at further, and words that it extends over
MIN_WORDS = 50
GAP, GAP_COST, REACH = 40, 0.1, 64  #: words between two segments of a chain; cost of a word of gap; words carried beyond a chain's ends
LOOSE = 64  #: words between two shared seeds of one chain
RUN, AHEAD = 2, 3  #: seeds of a run that leads to one document, and runs that a step looks ahead
AT = 27  #: bits of a place within a document
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the low bytes of a number
_LONG = 256  # bytes of a word beyond which it is hashed by itself
_LOT = 1 << 18  # bytes of texts that are hashed as one


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a lower-cased text, and where the words begin: all words eight bytes at a time, and no word is an object by itself."""
    n = len(text)
    data = np.frombuffer(text + bytes(16 - n % 8), np.uint8)
    gap = np.ones(n + 2, bool)
    _SPACE.take(data[:n], out=gap[1:-1])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start = edges[::2]
    size = edges[1::2] - start
    whole, h = data.view("<u8"), size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def eight(at: np.ndarray) -> np.ndarray:
        """The eight bytes from a place on, out of the two numbers that hold them."""
        first, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return (whole.take(first) >> bits) | (whole.take(first + 1) << (np.uint64(63) - bits) << np.uint64(1))

    def put(h: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        x = (h ^ (eight(at) & _LOW.take(left, mode="clip"))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    h, at = put(h, start, size), 8
    which = np.flatnonzero(size > at)
    while len(which) and at < _LONG:
        h[which] = put(h[which], start[which] + at, size[which] - at)
        at += 8
        which = which[size[which] > at]
    for i in which:
        h[i] = xxhash.xxh3_64_intdigest(text[start[i] : start[i] + size[i]])
    return h, start


def hashed_lots(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of its first text, words of each text, hashes of all their words) of neighbouring texts that are hashed as one."""
    held, size, done = [], 0, 0
    for n, text in enumerate(texts, 1):
        held.append((text.encode() if isinstance(text, str) else text or b"").lower())
        size += len(held[-1]) + 1
        if size >= _LOT or n == len(texts):
            h, start = _hashed(b"\n".join(held))
            ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in held]))
            yield done, np.diff(ends, prepend=0), h
            held, size, done = [], 0, n


def text_hashes(texts: list) -> list[np.ndarray]:
    """For each text one hash for each of its words, as ``words_of`` cuts them."""
    return [part for _, counts, h in hashed_lots(texts) for part in np.split(h, counts.cumsum()[:-1])]


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the seeds of a row of word hashes."""
    h = shingle_hashes(words, K)
    at = np.flatnonzero(h % np.uint64(ONE_IN) == 0)
    return at, h[at]


def windows(words: np.ndarray) -> np.ndarray:
    """One hash for every run of ``MIN_WORDS`` words."""
    return window_hashes(words, MIN_WORDS)


def open_windows(words: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Starts of the windows of which every seed is among the shared ones, but for windows of one repeated word.

    ``shared`` has a place of each shared seed.
    """
    n = len(words) - MIN_WORDS + 1
    at, h = seeds(words)
    known = np.sort(h[np.searchsorted(at, shared)])
    place = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
    alone = np.zeros(len(words) + 1, np.int64)
    alone[at[known[place] != h if len(known) else slice(None)] + 1] = 1
    alone = alone.cumsum()
    turns = np.r_[0, 0, words[1:] != words[:-1]].cumsum()  # changes of the word before a place
    start = np.arange(n)
    return np.flatnonzero((alone[start + MIN_WORDS - K + 1] == alone[start]) & (turns[start + MIN_WORDS] > turns[start + 1]))


class PrefixMaximum:
    """A Fenwick tree: the greatest (value, item) put at places before a given one."""

    def __init__(self, n: int):
        self.best = [(0.0, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def before(self, i: int) -> tuple[float, int]:
        out = (0.0, -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def segments(a: np.ndarray, b: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, words) of the runs of matching places on one diagonal, ordered by both starts."""
    if not len(a):
        return []
    order = np.lexsort((a, b - a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.r_[True, (np.diff(b - a) != 0) | (np.diff(a) > gap)])
    last = np.r_[new[1:], len(a)] - 1
    return sorted(zip(a[new].tolist(), b[new].tolist(), (a[last] - a[new] + K).tolist(), strict=True))


def ranges(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of b, a document's words, that chains of shared seeds (places in a and in b) point to; merged where they touch."""
    found = []
    for chain in (c for whole in chains(segments(a, b, LOOSE)) for c in cut(whole, LOOSE)):
        low, high = min(s[1] for s in chain), max(s[1] + s[2] for s in chain)
        first, last = chain[0][0], chain[-1][0] + chain[-1][2]
        inside = ((a >= first) & (a < last) & (b >= low) & (b < high)).sum()
        if inside >= SEEDS and high - low >= SPAN:
            found.append((max(0, low - REACH), high + REACH))
    out: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


class Grams:
    """The places of each run of ``K`` words of a text."""

    def __init__(self, words: np.ndarray):
        self.words = words
        h = shingle_hashes(words, K) if len(words) >= K else words[:0]
        self.order = np.argsort(h, kind="stable")
        self.sorted = h[self.order]

    def meet(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places here, places in ``part``) of equal runs: of each run its first place in ``part``, and all places here."""
        if len(part) < K or not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        run, first = np.unique(shingle_hashes(part, K), return_index=True)
        low, high = np.searchsorted(self.sorted, run), np.searchsorted(self.sorted, run, side="right")
        n = high - low
        inside = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        return self.order[np.repeat(low, n) + inside], np.repeat(first, n)


def chains(parts: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The segments as chains that ascend in both documents, of greatest length less gap costs; best first."""
    if len(parts) < 2:
        return [parts] if parts else []
    ends = sorted({b + n for _, b, n in parts})
    tree, score, back = PrefixMaximum(len(ends)), [], []
    waiting = sorted((a + n, i) for i, (a, _, n) in enumerate(parts))
    done = 0
    for i, (a, b, n) in enumerate(parts):
        # segments that end in a before this one starts; small overlaps are allowed
        while done < len(waiting) and waiting[done][0] <= a + K and waiting[done][1] < i:
            j = waiting[done][1]
            ja, jb, jn = parts[j]
            tree.put(bisect_left(ends, jb + jn), (score[j] + GAP_COST * (ja + jn + jb + jn), j))
            done += 1
        value, j = tree.before(bisect_left(ends, b + K + 1))
        gain = value - GAP_COST * (a + b)
        if j >= 0 and gain > 0 and parts[j][1] < b:
            score.append(n + min(gain, score[j]))
            back.append(j)
        else:
            score.append(float(n))
            back.append(-1)
    out, used = [], set()
    for i in sorted(range(len(parts)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(parts[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def cut(chain: list[tuple[int, int, int]], gap: int = GAP) -> list[list[tuple[int, int, int]]]:
    """A chain at its wide gaps."""
    out = [[chain[0]]]
    for s in chain[1:]:
        a, b, n = out[-1][-1]
        if s[0] - a - n > gap or s[1] - b - n > gap:
            out.append([])
        out[-1].append(s)
    return out


def common_words(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence of two short rows."""
    row = np.zeros(len(y) + 1, np.int64)
    for v in x:
        up = np.maximum(row[1:], row[:-1] + (y == v))
        row[1:] = np.maximum.accumulate(up)
    return int(row[-1])


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(words of a, words of b, matches) by which two rows go on alike; single words may differ, be lacking or added."""
    i = j = n = 0
    ends = (0, 0, 0)
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j, n = i + 1, j + 1, n + 1
            ends = (i, j, n)
            continue
        for p, q in ((1, 1), (1, 0), (0, 1)):
            if i + p + 2 < len(a) and j + q + 2 < len(b) and (a[i + p : i + p + 3] == b[j + q : j + q + 3]).all():
                i, j = i + p, j + q
                break
        else:
            break
    return ends


def align(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray, share: float) -> list[tuple[int, int, int, int, int]]:
    """Passages (start and end in a, start and end in b, matching words) of a chain over two rows of word hashes."""
    out, now = [], None
    for s_a, s_b, n in chain:
        if now is not None:
            # overlaps of neighbouring segments are cut off the later one
            over = max(0, now[-1][1] - s_a, now[-1][3] - s_b)
            s_a, s_b, n = s_a + over, s_b + over, n - over
            if n <= 0:
                continue
            a1, b1 = now[-1][1], now[-1][3]
            gap_a, gap_b = a[a1:s_a], b[b1:s_b]
            same = common_words(gap_a, gap_b)
            if same < 0.6 * max(len(gap_a), len(gap_b)) - 3:
                out.append(now)
                now = None
            else:
                now.append((a1, s_a, b1, s_b, same))
        now = now or []
        now.append((s_a, s_a + n, s_b, s_b + n, int((a[s_a : s_a + n] == b[s_b : s_b + n]).sum())))
    if now:
        out.append(now)
    whole = []
    for pieces in out:
        a0, b0, a1, b1 = pieces[0][0], pieces[0][2], pieces[-1][1], pieces[-1][3]
        x, y, m = _extend(a[a1:], b[b1:])
        p, q, k = _extend(a[:a0][::-1], b[:b0][::-1])
        pieces = [(a0 - p, a0, b0 - q, b0, k), *pieces, (a1, a1 + x, b1, b1 + y, m)]
        found = _longest(np.array(pieces, np.int64), share)
        if found:
            whole.append(found)
    return whole


def _longest(pieces: np.ndarray, share: float) -> tuple[int, int, int, int, int] | None:
    """The longest run of neighbouring pieces that is long and alike enough: a chance match at an end loses no passage."""
    matched = np.r_[0, pieces[:, 4].cumsum()]
    for size in range(len(pieces), 0, -1):
        i = np.arange(len(pieces) - size + 1)
        long_a, long_b = pieces[i + size - 1, 1] - pieces[i, 0], pieces[i + size - 1, 3] - pieces[i, 2]
        n = matched[i + size] - matched[i]
        good = np.flatnonzero((np.minimum(long_a, long_b) >= MIN_WORDS) & (n >= share * np.maximum(long_a, long_b)))
        if len(good):
            k = good[n[good].argmax()]
            return int(pieces[k, 0]), int(pieces[k + size - 1, 1]), int(pieces[k, 2]), int(pieces[k + size - 1, 3]), int(n[k])
    return None


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, place) of each text's seeds, each at its first place: the node, and the word within it."""
    for batch in lots(batches):
        found, places, nodes = [], [], batch.column(0).to_numpy()
        for done, counts, words in hashed_lots(batch.column(1).to_pylist()):
            if counts.max() < MIN_WORDS:
                continue
            text = np.repeat(np.arange(len(counts)), counts)
            at, h = seeds(words)
            inside = (text[at] == text[at + K - 1]) & (counts[text[at]] >= MIN_WORDS)
            at, h = at[inside], h[inside]
            order = np.lexsort((h, text[at].astype(np.uint16)))  # fewer texts than that are in a lot
            at, h = at[order], h[order]
            of = text[at]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])][: len(h)])
            at, of = at[first], of[first]
            found.append(h[first].view(np.int64)), places.append((nodes[done + of] << AT) + at - (counts.cumsum() - counts)[of])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, places)], names=["seed", "place"])


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the places of their shared seeds to ranges of b."""
    for batch in lots(batches, 1024):
        out = []
        for a, b, places in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "places")), strict=True):
            at = np.array(places, np.int64)
            at_a, at_b = at >> 32, at & 0xFFFFFFFF
            if at_a.max() - at_a.min() + K >= SPAN:
                out += [(a, b, low, high) for low, high in ranges(at_a, at_b)]
        if out:
            yield _regions(out)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of b of shared windows."""
    for batch in lots(batches, 1024):
        out = []
        for a, b, places in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "places")), strict=True):
            at = np.unique(np.array(places, np.int64))
            new = np.flatnonzero(np.r_[True, np.diff(at) > MIN_WORDS])
            out += [(a, b, max(0, int(at[i]) - REACH), int(at[j]) + MIN_WORDS + REACH) for i, j in zip(new, np.r_[new[1:], len(at)] - 1, strict=True)]
        if out:
            yield _regions(out)


def steps_of(node: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(key, node, start, end) of the steps between runs of at least so many neighbours, in the order of node, key and start."""
    order = np.lexsort((end, (node << AT) + start))
    node, start, end, of = node[order], start[order], end[order], of[order]
    for few in (least, 1):  # runs of one lead, and again without those that are too short
        new = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (of[1:] != of[:-1])]) if len(node) else np.zeros(0, np.int64)
        last = np.r_[new[1:], len(node)][: len(new)] - 1
        long_ = last - new + 1 >= few
        new, last = new[long_], last[long_]
        node, start, end, of = node[new], start[new], end[last], of[new]
    pairs = []
    for ahead in range(1, AHEAD + 1):
        i = np.arange(max(0, len(node) - ahead))
        j = i + ahead
        good = (node[i] == node[j]) & (of[i] != of[j]) & (start[j] - end[i] <= LOOSE)
        pairs.append((i[good], j[good]))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    key = mix(mix(of[i].astype(np.uint64)) + of[j].astype(np.uint64)).view(np.int64)
    own = node[i]
    order = np.lexsort((start[i], key, own.astype(np.uint16) if len(own) and own.max() < 1 << 16 else own))  # numbers of 16 bits are sorted by digits
    i, j, key = i[order], j[order], key[order]
    return key, node[i], start[i], end[j]


def _touching(new: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, range's first place) of places of which those within twice ``REACH`` words make one range; groups begin where ``new`` is true."""
    base = new.cumsum() << 32
    reach = np.maximum.accumulate(base + end)
    first = np.flatnonzero(np.r_[True, new[1:] | ((base + start)[1:] - reach[:-1] > 2 * REACH)])
    last = np.r_[first[1:], len(start)] - 1
    return start[first], (reach - base)[last], first


def _covered(spans: pa.ListArray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether one of the spans of its row holds a place: the furthest end of those that begin no later does."""
    own, flat = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy()) << 32, spans.flatten()
    if not len(own):
        return np.zeros(len(row), bool)
    low, high = (own + flat.field(k).to_numpy(zero_copy_only=False) for k in ("start_word", "end_word"))
    order = np.argsort(low)
    reach = np.maximum.accumulate(high[order])
    at = np.searchsorted(low[order], (row << 32) + start, side="right") - 1
    return (at >= 0) & (reach[at] >= (row << 32) + end)


def _steps(least: int):
    return lambda batches: (out for batch in lots(batches, 512) for out in _step_rows(batch, least))


def _step_rows(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    """(key, node, at, spans, covered) of the steps of each document: all places of a key, the ranges that these make, and whether passages hold every place."""
    if batch.num_rows:
        nodes, units, spans = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
        row = np.repeat(np.arange(len(nodes)), np.diff(units.offsets.to_numpy()))
        flat = units.flatten()
        start, end, of = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        key, row, start, end = steps_of(row, start, end, of, least)
        node, covered = nodes[row], _covered(spans, row, start, end)
        if len(key):
            new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            group = np.flatnonzero(new)
            low, high, first = _touching(new, start, end)
            lists = lambda x, y, names, at: pa.ListArray.from_arrays(pa.array(np.r_[at, len(x)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in (x, y)], names=names))
            at, ranges_ = lists(start, end, ["start", "end"], group), lists(low, high, ["low", "high"], np.searchsorted(first, group))
            yield pa.RecordBatch.from_arrays([pa.array(key[group]), pa.array(node[group]), at, ranges_, pa.array(np.logical_and.reduceat(covered, group))], names=["key", "node", "at", "spans", "covered"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of one pair, merged where they touch."""
    for batch in lots(batches, 1024):
        out = []
        for a, b, spans in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "spans")), strict=True):
            low, high = None, None
            for x in sorted((x["low"], x["high"]) for x in spans):
                if high is not None and x[0] <= high:
                    high = max(high, x[1])
                    continue
                if high is not None:
                    out.append((a, b, low, high))
                low, high = x
            out.append((a, b, low, high))
        if out:
            yield _regions(out)


def _inside(n: int, at: np.ndarray, spans) -> np.ndarray:
    """Which windows of a text of ``n`` words the spans cover."""
    depth = np.zeros(n + 1, np.int64)
    for x in spans:
        depth[x["start_word"]] += 1
        depth[x["end_word"]] -= 1
    bare = np.r_[0, (depth[:-1].cumsum() == 0)].cumsum()
    return bare[at + MIN_WORDS] == bare[at]


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct windows (window, its first place, covered) of each text that other documents may hold as well.

    A row without a window has the number of the text's words as its place.
    """
    for batch in lots(batches, 64):
        found, counts = [], []
        for node, words, shared, spans in zip(batch.column("node").to_pylist(), text_hashes(batch.column("text").to_pylist()), *(batch.column(k).to_pylist() for k in ("shared", "spans")), strict=True):
            if len(words) < MIN_WORDS:
                continue
            counts.append((node << AT) + len(words))
            at = open_windows(words, np.array(shared or [], np.int64))
            if len(at):
                # within an exact repeat its source holds the window as well, so the first holder is never left out
                at = at[~_inside(len(words), at, [x for x in spans or () if x["exact"]])]
                # one row for all places of a window; it is open if any of them is
                h, first, which = np.unique(windows(words)[at].view(np.int64), return_index=True, return_inverse=True)
                bare = np.bincount(which, ~_inside(len(words), at, spans or ()), len(h))
                found.append((h, (node << AT) + at[first], bare == 0))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["window", "place", "covered"])
        if counts:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(counts), pa.int64()), pa.array(counts, pa.int64()), pa.nulls(len(counts), pa.bool_())], names=["window", "place", "covered"])


def _regions(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 2 + [pa.int32()] * 2, strict=True)], names=["a", "b", "low", "high"])


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of b's text, its words in the range."""
    last, words = None, []
    for batch in lots(batches):
        out = []
        for b, text, low, high in zip(*(batch.column(k).to_pylist() for k in ("b", "text", "low", "high")), strict=True):
            if b != last:
                last, words = b, words_of(text)
            out.append(b" ".join(words[low:high]))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("a", "b", "low")), pa.array(out, pa.binary())], names=["a", "b", "low", "part"])


def covering(found: list[tuple]) -> list[tuple]:
    """Some of the passages (start and end in a, ...) that cover the same words of a: of overlapping ones those that reach furthest.

    A text of a repeated phrase matches at every shift by that phrase; these are no passages of their own.
    """
    out, end, best = [], -1, None
    for p in sorted(found, key=lambda p: (p[0], -p[1])):
        if best is not None and p[0] > end:  # the furthest of those that touch what is covered
            out.append(best)
            end, best = best[1], None
        if p[1] > end and (best is None or p[1] > best[1]):
            if p[0] > end:
                out.append(p)
                end, best = p[1], None
            else:
                best = p
    return out + ([best] if best is not None else [])


def places_of(grams: Grams, part: np.ndarray, share: float) -> list[tuple[int, int, int, int, int]]:
    """The passages of a text that repeat a part of another one.

    Chains that cover all the words of any come first; the others are aligned where these have left words uncovered.
    """
    every = [c for whole in chains(segments(*grams.meet(part), GAP)) for c in cut(whole) if len(c) > 1 or c[0][2] > K]
    spans = [(c[0][0], c[-1][0] + c[-1][2], i) for i, c in enumerate(every)]
    first = [x[2] for x in covering(spans)] if len(spans) > 1 else []
    covered, found = np.zeros(len(grams.words), bool), []
    for i in [*first, *sorted(set(range(len(every))).difference(first))]:
        if not covered[spans[i][0] : spans[i][1]].all():
            for p in align(every[i], grams.words, part, share):
                found.append(p)
                covered[p[0] : p[1]] = True
    return covering(found)


def _aligned(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams = None, Grams(np.zeros(0, np.uint64))
        for batch in lots(batches):
            out = []
            parts = text_hashes(batch.column("part").to_pylist())
            for a, b, low, own, text in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "low")), parts, batch.column("text"), strict=True):
                if a != last:
                    last, grams = a, Grams(text_hashes([text.as_py()])[0])
                out += [(a, p[0], p[1], b, low + p[2], low + p[3], p[4]) for p in places_of(grams, own, share)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "start_word", "end_word", "b", "of_start", "of_end", "n_matched"])

    return run


def _alignments(texts: DataFrame, regions: DataFrame, threshold: float) -> DataFrame:
    """The passages of a that the ranges of b lead to."""
    # the same plan at every size: texts are shuffled, also where few documents would allow a broadcast
    t = lambda x: texts.withColumnRenamed("node", x).hint("merge")
    cut_ = regions.join(t("b"), "b").select("a", "b", "low", "high", "text").mapInArrow(_sliced, "a long, b long, low int, part binary")
    both = cut_.join(t("a"), "a").select("a", "b", "low", "part", "text")
    return both.mapInArrow(_aligned(threshold), "a long, start_word long, end_word long, b long, of_start long, of_end long, n_matched long").distinct()


def _node(place):
    return F.shiftright(place, AT)


def _within(place):
    return place.bitwiseAND(F.lit((1 << AT) - 1))


def _stepped(scratch: Scratch, units: DataFrame, spans: DataFrame) -> list[DataFrame]:
    """Ranges (a, b, low, high) that steps tell; units (node, start, end, of): what leads a document's words to another one."""
    out = []
    while True:
        lists = units.groupBy("node").agg(F.collect_list(F.struct("start", "end", "of")).alias("units"))
        steps = lists.join(spans, "node", "left").select("node", "units", "spans").mapInArrow(_steps(1 if out else RUN), "key long, node long, at array<struct<start: int, end: int>>, spans array<struct<low: int, high: int>>, covered boolean")
        steps = scratch.table(steps, "steps")
        place = F.struct("node", "spans")
        held = steps.groupBy("key").agg(F.count("*").alias("n"), F.bool_and("covered").alias("done"), F.min(place).alias("first"), F.min(F.struct(F.xxhash64("node").alias("h"), place.alias("at"))).alias("second"))
        held = held.where("n > 1 and not done").select("key", "n", "first", F.col("second.at").alias("second"))
        # a step that very many documents share is a hot key: both sides are shuffled for this join alone, so that Spark can split it
        known = scratch.table(steps.join(scratch.table(held, "keys").hint("merge"), "key"), "held")
        few = known.where(F.col("n") <= FEW).groupBy("key").agg(F.collect_list(F.struct("node", "spans", "covered")).alias("p"))  # at most FEW
        few = few.select("p", F.explode("p").alias("x")).where("not x.covered").select("x", F.explode("p").alias("y"))
        star = known.where((F.col("n") > FEW) & ~F.col("covered")).select(place.alias("x"), F.explode(F.array("first", "second")).alias("y"))
        y = F.col("y")
        for hit in (few, star):
            hit = hit.where("y.node < x.node")
            hit = hit.select(F.col("x.node").alias("a"), y["node"].alias("b"), F.explode(y["spans"]).alias("span"))
            out.append(hit.select("a", "b", F.greatest(F.lit(0), F.col("span.low") - REACH).alias("low"), (F.col("span.high") + REACH).alias("high")))
        units = known.where(F.col("n") > FEW).select("node", F.explode("at").alias("at"), F.col("first.node").alias("of"))
        units = units.select("node", "at.start", "at.end", "of").where(F.col("end") - F.col("start") < MIN_WORDS)
        if units.isEmpty():
            return out


def _found(scratch: Scratch, nodes: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Passages (a, start_word, end_word, b, of_start, of_end, n_matched) between nodes of different ids, a after b; and (node, words)."""
    seeded = lambda: texts.mapInArrow(_seeded, "seed long, place long")  # noqa: E731  (made twice: dearer to keep than to make)
    repeated = scratch.table(seeded().groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    scratch.free()
    shared = scratch.table(seeded().join(repeated.hint("merge"), "seed"), "shared")
    scratch.drop(repeated)
    few = shared.where(F.col("n") <= FEW).groupBy("seed").agg(F.sort_array(F.collect_list("place")).alias("p"))  # at most FEW places
    few = few.select("p", F.explode("p").alias("y")).select("y", F.explode(F.filter("p", lambda x: x > F.col("y"))).alias("x"))
    many = shared.where(F.col("n") > FEW)
    leaders = scratch.table(many.groupBy("seed").agg(F.min("place").alias("first"), F.min(F.struct(F.xxhash64(_node(F.col("place"))).alias("h"), "place")).alias("second")).select("seed", "first", F.col("second.place").alias("second")), "leaders")
    led = scratch.table(many.join(leaders.hint("merge"), "seed").select("place", "first", "second"), "led")
    scratch.drop(leaders)
    star = led.select("place", F.explode(F.array_distinct(F.array("first", "second"))).alias("of")).where("place <> of")
    ends = few.unionByName(star.select(F.least("place", "of").alias("y"), F.greatest("place", "of").alias("x")))
    ends = ends.select(_node(F.col("x")).alias("a"), _node(F.col("y")).alias("b"), (F.shiftleft(_within(F.col("x")), 32) + _within(F.col("y"))).alias("place")).where("a <> b")
    pairs = ends.groupBy("a", "b").agg(F.collect_set("place").alias("places")).where(F.size("places") >= SEEDS)
    regions = scratch.table(pairs.mapInArrow(_ranged, "a long, b long, low int, high int"), "regions")
    ids = nodes.select("node", "id")
    # never a document with another text of its own id
    different = lambda df: df.join(ids.withColumnsRenamed({"node": "a", "id": "id_a"}), "a").join(ids.withColumnsRenamed({"node": "b", "id": "id_b"}), "b").where("id_a <> id_b").drop("id_a", "id_b")
    found = scratch.table(_alignments(texts, different(regions), threshold), "found")
    scratch.drop(regions)
    # what is not covered yet: steps between frequent seeds, and windows without a seed of their own, joined to the first document that holds them
    common = shared.groupBy(_node(F.col("place")).alias("node")).agg(F.collect_list(_within(F.col("place")).cast("int")).alias("shared"))
    exact = (F.col("n_matched") == F.col("end_word") - F.col("start_word")) & (F.col("n_matched") == F.col("of_end") - F.col("of_start"))
    spans = found.groupBy(F.col("a").alias("node"), "start_word", "end_word").agg(F.bool_or(exact).alias("exact")).groupBy("node").agg(F.collect_list(F.struct("start_word", "end_word", "exact")).alias("spans"))
    at = _within(F.col("place")).cast("int")
    units = led.select(_node(F.col("place")).alias("node"), at.alias("start"), (at + K).alias("end"), _node(F.col("first")).alias("of"))
    stepped = _stepped(scratch, units, spans)
    rest = texts.hint("merge").join(common, "node", "left").join(spans, "node", "left")
    opened = scratch.table(rest.select("node", "text", "shared", "spans").mapInArrow(_open, "window long, place long, covered boolean"), "windows")
    scratch.drop(shared)
    counts = scratch.table(opened.where("window is null").select(_node(F.col("place")).alias("node"), _within(F.col("place")).alias("words")), "counts")
    sought = opened.where("window is not null").groupBy("window").agg(F.min("place").alias("first"), F.min("covered").alias("covered"), F.max("place").alias("last")).where(~F.col("covered") & (_node(F.col("first")) < _node(F.col("last"))))
    sought = scratch.table(sought.select("window", "first"), "sought")
    late = opened.where("not covered").join(sought, "window").select(_node(F.col("place")).alias("a"), _node(F.col("first")).alias("b"), _within(F.col("first")).alias("place")).where("a <> b")
    late = late.groupBy("a", "b").agg(F.collect_set("place").alias("places")).mapInArrow(_runs, "a long, b long, low int, high int")
    every = reduce(DataFrame.unionByName, stepped, late).groupBy("a", "b").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    late = scratch.table(every.mapInArrow(_joined, "a long, b long, low int, high int"), "late")
    scratch.drop(opened, sought, led)
    return scratch.table(found.unionByName(_alignments(texts, different(late), threshold)).distinct(), "all"), counts


def _compared(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, their passages, their numbers of words); texts too short for a passage are no nodes."""
    known = docs.where(F.col(id_col).isNotNull()).select(id_col, text_col)
    nodes, texts = distinct_texts(scratch, known, id_col, text_col, least=2 * MIN_WORDS - 1)
    found, counts = _found(scratch, nodes, texts, threshold)
    scratch.drop(texts)
    return nodes, found, counts


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """Rows (id, start_word, end_word, of_<id>, of_start, of_end, n_matched): words of a document that repeat a smaller id's."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    nodes, found, counts = _compared(scratch, docs, id_col, text_col, threshold)
    ids = nodes.select("node", "id")
    found = found.join(ids.withColumnsRenamed({"node": "a"}), "a").join(ids.withColumnsRenamed({"node": "b", "id": "of_id"}), "b")
    rows = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("key")).where("id is not null and key is not null").distinct()
    whole = scratch.table(nodes.join(counts, "node").select("key", F.col("id").alias("of_id"), "words"), "whole")
    zero, words = F.lit(0).cast("long"), F.col("words")
    copies = rows.join(whole.hint("merge"), "key").where("id <> of_id")
    copies = copies.select("id", zero.alias("start_word"), words.alias("end_word"), "of_id", zero.alias("of_start"), words.alias("of_end"), words.alias("n_matched"))
    out = scratch.table(found.select(*copies.columns).unionByName(copies), "passages")
    return out.withColumnsRenamed({"id": id_col, "of_id": f"of_{id_col}"})


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the given ranges; what stands between the others stays as it is."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, kept = [], 0
    for low, high in sorted(spans):
        low, high = min(low, len(at) - 1), min(high, len(at) - 1)
        if at[low] > kept:
            out.append(text[kept : at[low]])
        kept = max(kept, at[high])
    return "".join([*out, text[kept:]])


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, drop_empty: bool = True) -> DataFrame:
    """``docs`` without the passages that repeat a smaller id's; documents of which nothing is left go, unless ``drop_empty`` is false.

    Each row is cut by its own text: rows that share an id have their own passages. Rows without an id stay as they are.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    nodes, found, counts = _compared(scratch, docs, id_col, text_col, threshold)
    spans = found.groupBy(F.col("a").alias("node")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    known = scratch.table(nodes.join(counts, "node").join(spans, "node", "left").select("key", F.col("id").alias("own"), "words", "spans"), "spans")

    @F.arrow_udf("string")
    def rest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        some = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([None if t is None or s is None else without(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in some], pa.string())

    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), text_key(text_col).alias("key"))
    id_, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    copy = id_ != F.col("own")  # all of it repeats the smallest id that has this text
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start_word"), F.col("words").alias("end_word")))
    hit = rows.join(known.hint("merge"), "key", "left").withColumn("cuts", F.when(copy, whole).when(id_.isNotNull(), F.col("spans")))
    # only texts with passages go to Python
    left = hit.withColumn("rest", F.coalesce(rest(F.when(F.col("cuts").isNotNull(), text), F.col("cuts")), text))
    if drop_empty:
        left = left.where(F.col("cuts").isNull() | F.col("rest").isNull() | (F.trim("rest") != ""))
    return left.select(*[(F.col("rest") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
