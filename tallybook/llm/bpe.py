"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

A merge list determines how far ahead of a token boundary the text can still move that boundary: a merge at the
right end can free its left neighbour, whose own later merge can free the next, with ranks rising along the
chain. `lookahead` is the longest such chain in symbols. The encoder reads symbols one at a time, keeps for each
recent position the last token of the encoding that ends there, and emits tokens as soon as every encoding that
may still be continued shares them. What it keeps is bounded by the longest token and the lookahead.

A pre-token of at most `lookahead` symbols ends before any of its tokens is sure, so `word` runs the same steps over it
whole; longer ones are streamed. Pre-tokens repeat, so encodings of short chunks are kept in tables of fixed size
(KEPT_CHUNKS, KEPT_WORDS; nothing longer than KEPT_CHARS is kept, and what was not asked for lately goes). A text is
read in stretches of some STRETCH characters cut at white space, whose ids are digested and decoded before the next is
read. Where there is no white space for so long, the tokens of the run leave the transducer STRETCH at a time. Beside the
text itself, what is kept so stays the same however long it is, but for such a run's own pre-tokens.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the vocabulary's patterns see it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
BREAK = regex.compile(f"[{SPACE}]")
#: Fixed value: how the vocabulary cuts text into pre-tokens.
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: Chunks and pre-tokens kept with their encoding (two generations of so many each), the longest worth keeping, and pairs of tokens kept.
KEPT_CHUNKS, KEPT_WORDS, KEPT_CHARS, KEPT_PAIRS = 100_000, 200_000, 48, 300_000
#: Longest beginning of a pre-token whose last token is kept.
KEPT_PREFIX = 10
#: Characters of a text encoded at a time, about.
STRETCH = 1 << 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeList:
    """The vocabulary file's merges as a streaming transducer over byte symbols."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.numbers = {**self.ids, **self.special}
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.numbers.items()}
        self.names = {i: t for t, i in self.numbers.items()}
        self.special_ids = frozenset(self.special.values())
        self.symbol = byte_symbols()
        self.byte = {c: b for b, c in enumerate(self.symbol)}
        self.shown = dict(enumerate(self.symbol))
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.parts = {a + b: (a, b) for a, b in merges}
        self.longest = max(self.width(t) for t in self.ids)
        # what a token stands for: its bytes, and a space where it ends a word
        self.raw = {i: bytes(self.byte[c] for c in t[: self.width(t)]) + (b" " if self.end and t.endswith(self.end) else b"") for t, i in self.ids.items() if t not in self.special}
        self.lookahead = self._lookahead(merges)
        order = {t: i for i, t in enumerate(self.parts)}
        if any(order.get(x, -1) >= i for i, m in enumerate(merges) for x in m):
            raise ValueError("a merge uses a token that a later merge makes")
        # tokens that their own symbols merge to; others never come out of the merges
        self.real = {t for t in self.ids if t not in self.parts and self.width(t) == 1}
        for t, (x, y) in self.parts.items():
            if t in self.ids and x in self.real and y in self.real and self._follows(x, y, order[t]):
                self.real.add(t)
        self.kept: dict[tuple[str, str], bool] = {}
        self.ends: dict[str, str] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def width(self, token: str) -> int:
        return len(token) - len(self.end) if self.end and token.endswith(self.end) and len(token) > len(self.end) else len(token)

    def _lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Symbols after a boundary that can still move it: the longest chain of merges (x, y) of falling rank toward the right, each starting with what the one on its left ends with."""
        reach: dict[str, int] = {}
        for left, right in merges:
            reach[left] = max(reach.get(left, 0), self.width(left) + max(self.width(right), reach.get(right, 0)))
        return max(reach.values(), default=1)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain merging of a few symbols: lowest rank first, leftmost among equals."""
        out = list(symbols)
        while len(out) > 1:
            best = min(range(len(out) - 1), key=lambda i: self.rank.get((out[i], out[i + 1]), len(self.rank)))
            if (out[best], out[best + 1]) not in self.rank:
                break
            out[best: best + 2] = [out[best] + out[best + 1]]
        return out

    def symbols(self, token: str) -> list[str]:
        n = self.width(token)
        return [*token[: n - 1], token[n - 1:]]

    def _follows(self, a: str, b: str, before: int | None = None) -> bool:
        """Whether b may stand after a (before: until the merge of that rank): no merge across their border comes first.

        On a's right edge and b's left edge each piece lasts from the merge that makes it to the one that takes it
        up. A pair of pieces that some merge joins while both last would have been joined; of equal ranks the
        left one acts first.
        """
        rank, parts = self.rank, self.parts
        top = len(rank) if before is None else before
        x, x_end = a, top
        while True:
            y, y_end = b, top
            while True:
                r = rank.get((x, y))
                if r is not None and r < x_end and (r <= y_end if y_end < top else r < top):
                    return False
                if y not in parts:
                    break
                y_end, y = min(top, rank[parts[y]]), parts[y][0]
            if x not in parts:
                return True
            x_end, x = min(top, rank[parts[x]]), parts[x][1]

    def stream(self, word: Iterable[str]) -> Iterator[str]:
        """Tokens of a pre-token given symbol by symbol, each emitted once no continuation can change it."""
        ids, real, kept, longest = self.ids, self.real, self.kept, self.longest
        most = self.lookahead + 2 * longest
        text, last, ahead = "", [None], None  # last[k]: the last token of the encoding of the first k symbols held
        symbols = iter(word)
        while True:
            symbol = next(symbols, None)
            if ahead is not None:
                text += ahead
                n, suffix = len(text), self.end if symbol is None else ""
                for at in range(max(0, n - longest), n):
                    token = text[at:] + suffix
                    if token in real:
                        prior = last[at]
                        if prior is None:
                            break
                        fits = kept.get((prior, token))
                        if fits is None:
                            fits = self._fit((prior, token))
                        if fits:
                            break
                else:
                    raise ValueError(f"no token ends {text[-8:]!r}")
                last.append(token)
                if n > most:
                    done, text, last = self._stable(text, last)
                    yield from done
            if symbol is None:
                break
            ahead = symbol
        if text:
            yield from self._back(last, len(text))

    def _back(self, last: list[str | None], at: int) -> list[str]:
        """The tokens of the encoding that ends at this place, from what is held."""
        out = []
        while at > 0:
            out.append(last[at])
            at -= self.width(last[at])
        return out[::-1]

    def _stable(self, text: str, last: list[str | None]) -> tuple[list[str], str, list[str | None]]:
        """Emits what the encodings of all prefixes that end within the longest token have in common."""
        n = len(text)
        ends = set(range(max(1, n - self.longest + 1), n + 1))
        while len(ends) > 1:  # walk the rearmost end back until all meet
            far = max(ends)
            ends.discard(far)
            ends.add(far - self.width(last[far]))
        meet = ends.pop()
        # the token before the cut stays known: it decides what may follow
        return (self._back(last, meet), text[meet:], last[meet:]) if meet else ([], text, last)

    def bytes_shown(self, pre: str) -> str:
        """The symbols of a pre-token's bytes."""
        return pre if pre.isascii() and pre.isprintable() else pre.encode("utf-8").decode("latin-1").translate(self.shown)

    def word(self, pre: str) -> list[str]:
        """Tokens of one pre-token. One that is no longer than the lookahead is held whole before any token is stable."""
        pre = self.bytes_shown(pre)
        n, longest = len(pre), self.longest
        if n > self.lookahead:
            return list(self.stream(pre))
        real, kept, ends, last = self.real, self.kept, self.ends, [""]
        for end in range(1, n + 1):
            if end < n:
                held = pre[:end]
                if (token := ends.get(held)) is not None:  # pre-tokens share their beginnings
                    last.append(token)
                    continue
            else:
                held = pre + self.end
            for at in range(end - longest if end > longest else 0, end):
                token = held[at:]
                if token in real:
                    if not at:
                        break
                    pair = last[at], token
                    fits = kept.get(pair)
                    if fits is None:
                        fits = self._fit(pair)
                    if fits:
                        break
            else:
                raise ValueError(f"no token ends {held[-8:]!r}")
            last.append(token)
            if end < n and end <= KEPT_PREFIX:
                if len(ends) >= KEPT_PAIRS:
                    ends.clear()
                ends[held] = token
        return self._back(last, n)

    def _fit(self, pair: tuple[str, str]) -> bool:
        if len(self.kept) >= KEPT_PAIRS:
            self.kept.clear()
        fits = self.kept[pair] = self._follows(*pair)
        return fits

    def words(self, chunk: str) -> list[str]:
        """Pre-tokens of a piece of text: composed, in lower case letter by letter, cut by the pattern."""
        text = chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk)
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        if text.isalpha():  # letters alone, or letters and one mark: what the pattern would find
            return [text]
        if text[-1:] in (",", ".") and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        return PRE_TOKEN.findall(text)

    def chunk(self, chunk: str) -> Iterator[str]:
        """Tokens of a piece of text without special tokens in it, those of long pre-tokens as they get sure."""
        for pre in self.words(chunk):
            yield from self.stream(self.bytes_shown(pre)) if len(pre) > self.lookahead else self.word(pre)

    def tokens(self, text: str) -> Iterator[str]:
        """Tokens of a whole text, special ones included."""
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                yield part
            else:
                yield from self.chunk(part)


class Decoder:
    """Turns ids into text one at a time, holding back at most three bytes of an unfinished character.

    joined: as the library decodes a vocabulary without a decoder, names joined by spaces. Otherwise names stand
    for bytes and word ends for spaces; bytes that can't start or continue a character become U+FFFD.
    """

    def __init__(self, merges: MergeList, joined: bool = False):
        import codecs

        self.merges, self.joined, self.first = merges, joined, True
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, tokens: Iterable[int]) -> str:
        """The text that these further ids complete; ids that the vocabulary lacks give nothing."""
        names = self.merges.names
        if self.joined:
            known = [names[t] for t in tokens if t in names]
            lead, self.first = " " if known and not self.first else "", self.first and not known
            return lead + " ".join(known)
        special, raw, out, run = self.merges.special_ids, self.merges.raw, [], []
        for t in tokens:
            if t in special:  # ends what bytes there are
                out += [self.state.decode(b"".join(run), final=True), names[t]]
                run = []
            elif t in raw:
                run.append(raw[t])
        return "".join(out) + self.state.decode(b"".join(run))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


class Kept(dict):
    """make(key) for the keys asked for lately: at most two generations of `size` short keys."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Text to ids. Chunks between spaces and pre-tokens keep their ids, as bytes, for a while."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.words = Kept(lambda pre: self._ids(merges.word(pre)), KEPT_WORDS)
        self.chunks = Kept(self._chunk, KEPT_CHUNKS)

    def _ids(self, tokens: Iterable[str]) -> bytes:
        return b"".join([self.merges.packed[t] for t in tokens])

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk and any(s in chunk for s in self.merges.special):
            return self._ids(self.merges.tokens(chunk))
        return b"".join([self.words[pre] for pre in self.merges.words(chunk)])

    def stretches(self, text: str) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of a whole text, a stretch of it at a time."""
        start = 0
        while start <= len(text):
            gap = BREAK.search(text, start + STRETCH)
            end = gap.start() if gap else len(text)
            stretch = text[start:end]
            if len(stretch) <= 2 * STRETCH:
                yield b"".join(map(self.chunks.__getitem__, stretch.split(" ")))
            else:
                tokens = self.merges.tokens(stretch)
                while part := self._ids(islice(tokens, STRETCH)):
                    yield part
            start = end + 1


@functools.lru_cache(maxsize=1)
def encoder(content: str) -> Encoder:
    """One encoder for all tasks that a Python worker runs."""
    return Encoder(MergeList(content))


def encoded(docs: DataFrame, content: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, restored_sha256 of every whole text, and ids (array<int>) if asked for.

    decoded_sha256 is of the text as the library decodes it, restored_sha256 of what the byte-to-text machine gives.
    content: the vocabulary file's text, a fixed few MB, broadcast to the executors. A null text counts as empty:
    no ids, and the digests of nothing. Rows keep null and repeated doc_ids; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(shared.value)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for t in batch.column(1):
                back, plain, size, held = Decoder(of.merges, joined=True), Decoder(of.merges), 0, []
                digests = [hashlib.sha256() for _ in range(3)]
                for ids in of.stretches(t.as_py() or ""):
                    tokens = np.frombuffer(ids, dtype="<u4").tolist()
                    size += len(tokens)
                    for digest, part in zip(digests, (ids, back.feed(tokens).encode(), plain.feed(tokens).encode()), strict=True):
                        digest.update(part)
                    if with_ids:
                        held.append(ids)
                digests[2].update(plain.finish().encode())
                rows[0].append(size)
                for row, digest in zip(rows[1:4], digests, strict=True):
                    row.append(digest.hexdigest())
                if with_ids:
                    rows[4].append(np.frombuffer(b"".join(held), dtype="<u4").astype(np.int32))
            names, kinds = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "restored_sha256"], [None, pa.int64(), *[pa.string()] * 3]
            arrays = [batch.column(0), *(pa.array(r, type=k) for r, k in zip(rows[:4], kinds[1:], strict=True))]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array(rows[4], type=pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, restored_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decoded(tokens: DataFrame, content: str, joined: bool = False) -> DataFrame:
    """(doc_id, text) of tokens(doc_id, ids): decoded id by id; a null array gives an empty text, unknown ids nothing."""
    shared = tokens.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = MergeList(shared.value)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                d = Decoder(merges, joined)
                texts.append((d.feed([i for i in (ids.as_py() or []) if i is not None]) + d.finish()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
