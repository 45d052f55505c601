"""Token counts of a unigram model over a public vocabulary, with forward scores shared in a trie.

Pre-tokens are the runs of characters between white space, each led by the word mark. A pre-token's tokens are its
segmentation into vocabulary pieces of the highest total log-probability, then of the fewest pieces; a character
that no piece covers is spelled in UTF-8 bytes. The public vocabulary file has pieces and ranks but no unigram
probabilities, and none are trained: a piece's probability is taken as Zipf's law gives it, 1 / (rank + 1) over the sum of
all. So the counts are those of this unigram model and of no published tokenizer.

Distinct pre-tokens go into a trie. A node's best score and count depend on its prefix alone, so they are computed once
and are shared by all pre-tokens with that prefix; terminal nodes give the count. The trie is made for a block of new
pre-tokens and a level at a time: all nodes of a depth are one array, and the pieces that end at them are followed through a
trie of the vocabulary. Counts of pre-tokens are kept, and are forgotten beyond ``WORDS`` of them; a block has at most
``BLOCK`` pre-tokens and a lot little more than ``LOT`` bytes of text. Pre-tokens over ``LONG`` characters are computed apart,
so a worker's memory is bounded.

Null and blank texts have no tokens. Repeated rows are counted each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import vocabulary

WORDS, BLOCK, LOT, LONG = 300_000, 1 << 16, 4 << 20, 48
MARK = "▁"


class PrefixTrie:
    """Unigram forward scores of prefixes."""

    def __init__(self, log_probs: dict[str, float], byte_log_prob: float):
        self.log_probs, self.byte_log_prob = log_probs, byte_log_prob
        self.longest = max(map(len, log_probs), default=1)
        # prefixes of pieces by length and order are states; so numbered, keys of (state before, character) are in order too
        prefixes = sorted({p[:k] for p in log_probs for k in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
        state = {"": 0, **{p: k + 1 for k, p in enumerate(prefixes)}}
        self.keys = np.array([state[p[:-1]] << 21 | ord(p[-1]) for p in prefixes] + [np.iinfo(np.int64).max], np.int64)
        self.piece = np.array([-np.inf] + [log_probs.get(p, -np.inf) for p in prefixes])
        self.open = np.zeros(len(state), bool)  # states that a further character can follow
        self.open[self.keys[:-1] >> 21] = True
        self.count: dict[str, int] = {}

    def step(self, scores: list[float], tokens: list[int], prefix: str) -> tuple[float, int]:
        """Best score and count of ``prefix``; ``scores`` and ``tokens`` hold those of its own prefixes, the empty one first."""
        n = len(prefix)
        size = len(prefix[-1].encode())
        best, fewest = scores[n - 1] + size * self.byte_log_prob, tokens[n - 1] + size
        get = self.log_probs.get
        for i in range(max(0, n - self.longest), n):
            p = get(prefix[i:])
            if p is not None:
                s = scores[i] + p
                if s > best or s == best and tokens[i] + 1 < fewest:
                    best, fewest = s, tokens[i] + 1
        return best, fewest

    def insert(self, word: str) -> int:
        """Terminal count of one pre-token."""
        return self.long(word) if len(word) > LONG else int(self.block([word])[0])

    def block(self, words: list[str]) -> np.ndarray:
        """Terminal counts of different pre-tokens that are in order and not empty."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        chars = np.ascontiguousarray(np.array(words).view(np.uint32).reshape(n, -1).T).astype(np.int64)
        out, shared, node = np.empty(n, np.int64), np.arange(n) > 0, np.zeros(n, np.int64)
        # of the levels within a piece's reach: each row's score and count there, and the state of each node of the last level since
        scores, tokens, states = {0: np.zeros(n)}, {0: np.zeros(n, np.int64)}, {}
        for k in range(len(chars)):
            c = chars[k]
            shared[1:] &= (c[1:] == c[:-1]) & (size[:-1] > k)
            new = ~shared & (size > k)
            row = np.flatnonzero(new)
            above, c = node[row], c[row]
            spelled = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            best, fewest = scores[k][row] + spelled * self.byte_log_prob, tokens[k][row] + spelled
            states[k] = np.zeros(int(node[-1]) + 1, np.int64)
            for i in list(states):
                before = states[i][above]
                at = np.flatnonzero(before >= 0)
                key = before[at] << 21 | c[at]
                to = np.searchsorted(self.keys, key)
                hit = self.keys[to] == key
                at, to = at[hit], to[hit] + 1
                states[i] = np.full(len(row), -1)
                going = self.open[to]
                states[i][at[going]] = to[going]
                p = self.piece[to]
                ends = p > -np.inf
                at, p = at[ends], p[ends]
                s, t = scores[i][row[at]] + p, tokens[i][row[at]] + 1
                better = (s > best[at]) | (s == best[at]) & (t < fewest[at])
                best[at[better]], fewest[at[better]] = s[better], t[better]
                if not going.any():
                    del states[i], scores[i], tokens[i]
            node = np.cumsum(new) - 1
            scores[k + 1], tokens[k + 1] = best[node], fewest[node]
            done = size == k + 1
            out[done] = tokens[k + 1][done]
        return out

    def long(self, word: str) -> int:
        """The same, without nodes, in time and memory linear in the length."""
        scores, counts, w = [0.0], [0], self.longest
        for k in range(len(word)):
            low = max(0, k + 1 - w)
            s, t = self.step(scores[-(k + 1 - low) :], counts[-(k + 1 - low) :], word[low : k + 1])
            scores.append(s)
            counts.append(t)
            if len(scores) > 4 * w:
                del scores[: -w - 1], counts[: -w - 1]
        return counts[-1]

    def sums(self, lists: list[list[str]]) -> list[int]:
        """Tokens of each list of words."""
        if len(self.count) > WORDS:
            self.count.clear()
        known = self.count
        new = set().union(*lists).difference(known)
        long = {w for w in new if len(w) >= LONG}
        known.update((w, self.long(MARK + w)) for w in long)
        short = sorted(new - long)
        for i in range(0, len(short), BLOCK):
            some = short[i : i + BLOCK]
            known.update(zip(some, self.block([MARK + w for w in some]).tolist()))
        done = [sum(map(known.__getitem__, words)) for words in lists]
        for w in long:
            del known[w]
        return done

    def totals(self, texts: list[str]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text; what a text has beyond ``WORDS`` pre-tokens is counted in stretches."""
        lists = [t.split() for t in texts]
        done = self.sums([words[:WORDS] for words in lists])
        for i, words in enumerate(lists):
            for j in range(WORDS, len(words), WORDS):
                done[i] += self.sums([words[j : j + WORDS]])[0]
        return list(zip(map(len, lists), done))

    def total(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        return self.totals([text])[0]


def by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices that end where their texts, the second column, pass a further ``LOT`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        lot = np.cumsum(sizes, dtype=np.int64) // LOT
        cuts = [0, *(np.flatnonzero(np.diff(lot)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield batch.slice(i, j - i)


@lru_cache(maxsize=2)
def load(path: str) -> PrefixTrie:
    """The model of a vocabulary file, once for each worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(math.fsum(1 / (k + 1) for k in range(len(plain))))
    log_probs = {model.id_to_piece(i): -math.log(k + 1) - total for k, i in enumerate(plain)}
    return PrefixTrie(log_probs, -2 * math.log(len(plain)))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_pretokens, n_tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = load(path)
        for batch in by_size(batches):
            done = trie.totals([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64())], names=["id", "n_pretokens", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)
