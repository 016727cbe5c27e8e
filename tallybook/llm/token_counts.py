"""Token counts by trie-shared dynamic programming over a unigram model.

A pre-token's best segmentation is found by forward scores: the best score of each prefix over the pieces that end
there. A task's distinct pre-tokens are put in a trie (sorted, so that a node is where a pre-token leaves the one
before), and scores are worked out level by level, once for each node and so once for each shared prefix; the terminal
node of a pre-token gives its count of tokens, which is kept for the documents that follow.

The vocabulary file gives the pieces. Their probabilities are fitted to the corpus in one pass over all of it: pieces
start at Zipf's law of their rank, every task segments its distinct pre-tokens by that and counts the pieces as often
as the pre-tokens come, and the sums, a row for each piece at most, give the scores that documents are counted with. A
character that no piece covers counts one token per byte, each far below the rarest piece.

Nulls and edges: a null or blank text has no pre-tokens and no tokens. Null and repeated doc_ids keep their rows; an
empty table gives no rows. Long texts are read whole, and long pre-tokens are segmented whole. Of segmentations that
score the same the one with the longest last piece counts.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shift of Zipf's law; how far a byte that no piece covers is below the rarest piece; count added to each piece's; the mark that begins a pre-token.
RANK_SHIFT, BELOW, SMOOTH, MARK = 2.7, 4.0, 0.5, "▁"
#: Pre-tokens that a task keeps at a time, with their counts; characters of a trie at most, and of texts taken together; such slices whose pre-tokens are kept.
KEPT, TRIE_CHARS, TOGETHER, SLICES = 400_000, 1 << 21, 1 << 22, 16
#: Pre-tokens longer than this walk the trie alone, since their paths are long and hardly shared.
LONG = 48


def _mixed(points: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each code point."""
    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xBF58476D1CE4E5B9)


_BASE = 0x100000001B3C5  # odd: of the rolling hash of a piece's characters


class Unigram:
    """Pieces with scores."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.names = list(scores)
        self.number = {p: i for i, p in enumerate(self.names)}
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - BELOW
        # by length: sorted hashes of the pieces, their scores and numbers
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for p in scores if p}):
            held = [p for p in self.names if len(p) == n]
            points = _mixed(np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)).reshape(len(held), n)
            keys = np.zeros(len(held), dtype=np.uint64)
            for k in range(n):
                keys = keys * np.uint64(_BASE) + points[:, k]
            order = np.argsort(keys)
            self.by_length[n] = keys[order], np.array([scores[p] for p in held])[order], np.array([self.number[p] for p in held])[order]

    @classmethod
    def ranked(cls, pieces: Iterable[str]) -> Unigram:
        return cls({p: -math.log(r + RANK_SHIFT) for r, p in enumerate(pieces)})

    def fitted(self, counts: dict[str, float]) -> Unigram:
        """The same pieces with probabilities in proportion to these counts."""
        total = sum(counts.values()) + SMOOTH * len(self.scores)
        return Unigram({p: math.log((counts.get(p, 0) + SMOOTH) / total) for p in self.scores})

    def walk(self, words: Iterable[str], used: Counter | None = None, weights: dict[str, int] | None = None) -> Iterator[tuple[str, int]]:
        """(word, tokens of MARK + word) of distinct words, in sorted order; memory is one path of the trie. used: adds the pieces, weights times each."""
        scores, longest = self.scores, self.longest
        path, best, tokens, back = "", [0.0], [0], [0]
        for word in sorted(words):
            text = MARK + word
            shared = 0
            for x, y in zip(path, text, strict=False):
                if x != y:
                    break
                shared += 1
            del best[shared + 1:], tokens[shared + 1:], back[shared + 1:]
            for end in range(shared + 1, len(text) + 1):
                # without a piece: the character's bytes, one token each
                size = len(text[end - 1].encode("utf-8", "surrogatepass"))
                top, count, start = best[end - 1] + size * self.unknown, tokens[end - 1] + size, -end
                for at in range(max(0, end - longest), end):
                    score = scores.get(text[at:end])
                    if score is not None and (found := best[at] + score) > top:
                        top, count, start = found, tokens[at] + 1, at
                best.append(top)
                tokens.append(count)
                back.append(start)
            path = text
            if used is not None:
                at = len(text)
                while at > 0:
                    start = back[at]
                    if start >= 0:
                        used[text[start:at]] += weights[word]
                    at = start if start >= 0 else at - 1
            yield word, tokens[-1]

    def trie(self, words: list[str], used: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
        """Tokens of MARK + word for each of the sorted distinct words, all levels of their trie at once. used: adds the pieces by number, weights times each."""
        n = len(words)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n) + 1
        ends = np.cumsum(sizes + 1)
        root = ends - sizes - 1  # a word's place in the arrays of nodes; its prefix of d characters is d further on
        points = np.zeros(int(ends[-1]), dtype=np.uint32)
        inside = np.ones(len(points), dtype=bool)
        inside[root] = False
        points[inside] = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        # characters shared with the word before: a node of its own begins after them
        shared, same = np.zeros(n, dtype=np.int64), np.arange(1, n)
        depth = 1
        while len(same):
            same = same[(sizes[same] >= depth) & (sizes[same - 1] >= depth)]
            same = same[points[root[same] + depth] == points[root[same - 1] + depth]]
            shared[same] = depth
            depth += 1
        width = np.ones(len(points), dtype=np.int64) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        mixed = _mixed(points)
        best, tokens = np.zeros(len(points)), np.zeros(len(points), dtype=np.int64)
        rolled, piece = np.zeros(len(points), dtype=np.uint64), np.full(len(points), -1, dtype=np.int64)
        powers = np.array([pow(_BASE, k, 1 << 64) for k in range(self.longest + 1)], dtype=np.uint64)
        deep = np.arange(n)
        for d in range(1, int(sizes.max()) + 1):
            deep = deep[sizes[deep] >= d]
            new = shared[deep] < d
            own, at = deep[new], root[deep[new]] + d
            rolled[at] = rolled[at - 1] * np.uint64(_BASE) + mixed[at]
            top, count, which = best[at - 1] + width[at] * self.unknown, tokens[at - 1] + width[at], np.full(len(at), -1, dtype=np.int64)
            for length in range(min(d, self.longest), 0, -1):
                if length not in self.by_length:
                    continue
                keys, scores, numbers = self.by_length[length]
                asked = rolled[at] - rolled[at - length] * powers[length]
                place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = np.flatnonzero(keys[place] == asked)
                found = best[at[hit] - length] + scores[place[hit]]
                better = found > top[hit]
                hit, found = hit[better], found[better]
                top[hit], count[hit], which[hit] = found, tokens[at[hit] - length] + 1, numbers[place[hit]]
            best[at], tokens[at], piece[at] = top, count, which
            # words that share the prefix get what its first word has
            if len(own) < len(deep):
                first = np.maximum.accumulate(np.where(new, np.arange(len(deep)), 0))
                old = np.flatnonzero(~new)
                to, source = root[deep[old]] + d, root[deep[first[old]]] + d
                for of in (best, tokens, rolled, piece):
                    of[to] = of[source]
        if used is not None:
            lengths = np.array([len(p) for p in self.names], dtype=np.int64)
            at, word = root + sizes, np.arange(n)
            while len(at):
                which = piece[at]
                hit = which >= 0
                np.add.at(used, which[hit], weights[word[hit]])
                at = at - np.where(hit, lengths[which], 1)
                left = at > root[word]
                at, word = at[left], word[left]
        return tokens[root + sizes]

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """word -> tokens of MARK + word, of distinct words."""
        return self._counted(words, None)[0]

    def usage(self, weights: dict[str, int]) -> dict[str, int]:
        """piece -> how often the best segmentations of these words, so often each, use it."""
        used, by_number = self._counted(weights, weights)[1:]
        for i in np.flatnonzero(by_number):
            used[self.names[i]] += int(by_number[i])
        return used

    def _counted(self, words: Iterable[str], weights: dict[str, int] | None) -> tuple[dict[str, int], Counter, np.ndarray]:
        used, by_number = Counter(), np.zeros(len(self.names), dtype=np.int64)
        marked = [w for w in words if len(w) > LONG or MARK in w]
        found = dict(self.walk(marked, used if weights else None, weights))
        short = sorted(w for w in words if len(w) <= LONG and MARK not in w)
        places = np.cumsum(np.fromiter((len(w) + 2 for w in short), dtype=np.int64, count=len(short)))
        start = 0
        while start < len(short):
            begun = int(places[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(places, begun + TRIE_CHARS, side="right")))
            part, start = short[start:end], end
            mine = np.fromiter(map(weights.__getitem__, part), dtype=np.int64, count=len(part)) if weights else None
            found.update(zip(part, self.trie(part, by_number if weights else None, mine).tolist(), strict=True))
        return found, used, by_number


def pieces(model: bytes) -> list[str]:
    """The vocabulary file's pieces in order of frequency, without control and byte pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    return [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


@functools.lru_cache(maxsize=1)
def _ranked(model: bytes) -> Unigram:
    return Unigram.ranked(pieces(model))


def _sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Rows with their pre-tokens, texts of some TOGETHER characters at a time."""
    for batch in batches:
        start, held, size = 0, [], 0
        for i, t in enumerate(batch.column(column)):
            text = t.as_py() or ""
            held.append(text.split())
            size += len(text)
            if size >= TOGETHER:
                yield batch.slice(start, i + 1 - start), held
                start, held, size = i + 1, [], 0
        if held:
            yield batch.slice(start), held


def fitted(docs: DataFrame, model: bytes) -> Unigram:
    """The vocabulary's pieces with probabilities from how often all of docs' best segmentations use them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram, seen, total, slices = _ranked(shared.value), Counter(), Counter(), 0
        for _, words in _sliced(batches, 0):
            for w in words:
                seen.update(w)
            slices += 1
            if len(seen) > KEPT or slices >= SLICES:
                total.update(unigram.usage(seen))
                seen, slices = Counter(), 0
        total.update(unigram.usage(seen))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["piece", "n"])

    used = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "piece string, n long")
    # a row for each piece of the vocabulary at most
    return _ranked(model).fitted({r["piece"]: r["n"] for r in used.groupBy("piece").agg(F.sum("n").alias("n")).collect()})


def counted(docs: DataFrame, model: bytes, unigram: Unigram | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text. model: the vocabulary file, of fixed size, broadcast; unigram: its scores, fitted to docs if None."""
    shared = docs.sparkSession.sparkContext.broadcast((unigram or fitted(docs, model)).scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram, kept, slices = Unigram(shared.value), {}, 0
        for part, words in _sliced(batches, 1):
            distinct = set().union(*words)
            fresh = distinct.difference(kept)
            slices += 1
            if len(kept) + len(fresh) > KEPT or slices >= SLICES:
                kept, fresh, slices = {}, distinct, 0
            kept.update(unigram.counts(fresh))
            totals = [sum(map(kept.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.array(list(map(len, words)), dtype=np.int64)), pa.array(np.array(totals, dtype=np.int64))], names=["doc_id", "n_pretokens", "n_tokens"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
