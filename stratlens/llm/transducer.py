"""Token counts by a finite-state transducer that is compiled from a merge table.

A word's symbols are its bytes; the last one is a symbol of its own kind, as tokens that end a word are. For every
beginning of a word the merges give one last token, and tokens follow each other just where joining them would be split
there again. So the count of a beginning is one more than the count of the beginning before its last token, and all that
later symbols can depend on is the state: the beginnings that some token may still reach back to, each with its place in the
tree of tokens, its last token and how many tokens it has more than the present one. Tokens are bounded, so states are
finite; a transition on a symbol leads to one state and carries the number of tokens that it emits (less than nothing where
a merge reaches back). States and transitions are compiled when first met and kept as one table of arrays.

All words of a slice of texts step through the table at once. Words of over CHUNK symbols are cut into chunks, whose maps from entry
state to (exit state, tokens) are partial: an entry is added when the chunk before may leave in it, starting from a
first guess for all chunks at once. Once no map lacks an entry, maps are composed in pairs of doubling
distance (a parallel prefix scan), so neither the number of chunks nor their order limits how many are worked on at once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratlens.llm import text

OVER = 2048
CHUNK = 64
MOST = 1 << 21  # transitions kept; beyond it the table is compiled anew from what comes next
_LAST = 256  # added to a byte that ends a word
_SYMBOLS = 512
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
# White space besides what Unicode calls a separator, and the suffixes that stay with their apostrophe.
_BLANKS = [*range(0x09, 0x0E), 0x85]
_SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def classes() -> np.ndarray:
    """The class of every code point; what Python's Unicode version does not assign is unknown."""
    kinds = {"Z": SPACE, "L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        table[c] = UNKNOWN if category == "Cn" else kinds.get(category[0], OTHER)
    table[_BLANKS] = SPACE
    return table


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """Tokens as strings of symbols, and which tokens may stand side by side."""

    def __init__(self, vocabulary: list[str], merges: list[tuple[str, str]], suffix: str):
        bytes_of = {letter: b for b, letter in enumerate(byte_letters())}
        number = {token: k for k, token in enumerate(vocabulary)}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = dict.fromkeys(range(len(vocabulary)), -1)
        for r, (left, right) in enumerate(merges):
            token = number[left + right]
            pair = number[left], number[right]
            if token in self.parts or max(self.born[pair[0]], self.born[pair[1]]) >= r:
                raise ValueError(f"merge {r} makes a token twice or uses a later one")
            self.rank[pair], self.parts[token], self.born[token] = r, pair, r
        self.spines: tuple[dict, dict] = ({}, {})
        self.known: dict[tuple[int, int], bool] = {}
        # The tree of tokens that stand for themselves: (node, symbol) to node, and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for name, token in number.items():
            if token in self.parts and not self._adjacent(*self.parts[token], self.rank[self.parts[token]]):
                continue
            whole = name[: -len(suffix)] if name.endswith(suffix) and len(name) > len(suffix) else name
            symbols = [bytes_of[c] for c in whole]
            symbols[-1] += _LAST * (whole != name)
            node = 0
            for s in symbols:
                self.inner[node] = True
                at = self.child.setdefault(node * _SYMBOLS + s, len(self.token))
                if at == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
                node = at
            self.token[node] = token

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The token and its parts at one edge, each with the rank of the merge that takes it up (none for the token)."""
        found = self.spines[side].get(token)
        if found is None:
            found, at, until = [], token, float("inf")
            while True:
                found.append((at, until))
                if at not in self.parts:
                    break
                until = self.born[at]
                at = self.parts[at][side]
            self.spines[side][token] = found
        return found

    def _adjacent(self, left: int, right: int, until: float) -> bool:
        """No merge across the border of two tokens comes before both edges are taken up (by rank until at the latest).

        Of equal ranks the one further left comes first.
        """
        for a, a_until in self._spine(left, 1):
            a_until = min(a_until, until)
            for b, b_until in self._spine(right, 0):
                r = self.rank.get((a, b))
                if r is not None and r < a_until and r <= min(b_until, until) and r != until:
                    return False
        return True

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the merges keep the two tokens apart."""
        found = self.known.get((left, right))
        if found is None:
            found = self.known[left, right] = self._adjacent(left, right, float("inf"))
        return found


class Transducer:
    """The compiled part of the automaton. State 0 is the beginning of a word; last symbols lead back to it."""

    def __init__(self, merges: Merges, most: int = MOST):
        self.merges, self.most = merges, most
        self.clear()

    def clear(self) -> None:
        first = ((0, -1, 0),)
        self.states, self.number = [first], {first: 0}
        self.bits, self.size = 12, 0
        self._allocate()
        self.merges.known.clear()

    def _allocate(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        self.emit = np.zeros(1 << self.bits, np.int32)

    def _compile(self, key: int) -> tuple[int, int]:
        state, symbol = divmod(key, _SYMBOLS)
        m, reached, token, emitted = self.merges, [], -1, 0
        for node, last, ahead in self.states[state]:
            to = m.child.get(node * _SYMBOLS + symbol)
            if to is None:
                continue
            if token < 0 and m.token[to] >= 0 and (last < 0 or m.adjacent(last, m.token[to])):
                token, emitted = m.token[to], ahead + 1
            if m.inner[to]:
                reached.append((to, last, ahead))
        if token < 0:
            raise ValueError(f"no token for symbol {symbol}")
        if symbol >= _LAST:
            return 0, emitted
        target = ((0, token, 0), *((node, last, ahead - emitted) for node, last, ahead in reached))
        to = self.number.setdefault(target, len(self.states))
        if to == len(self.states):
            self.states.append(target)
        return to, emitted

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free slot where its search ends."""
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        slot = (spread >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        wrong = np.flatnonzero((held != keys) & (held >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[wrong]]
            wrong = wrong[(held != keys[wrong]) & (held >= 0)]
        return slot

    def _insert(self, rows: list[tuple[int, int, int]]) -> None:
        mask = (1 << self.bits) - 1
        for key, to, emitted in rows:
            slot = (key * 0x9E3779B97F4A7C15 % 2**64) >> (64 - self.bits)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & mask
            self.keys[slot], self.next[slot], self.emit[slot] = key, to, emitted
        self.size += len(rows)

    def _grow(self, more: int) -> None:
        if 3 * (self.size + more) < 1 << self.bits:
            return
        used = self.keys >= 0
        old = self.keys[used], self.next[used], self.emit[used]
        while 3 * (self.size + more) >= 1 << self.bits:
            self.bits += 1
        self._allocate()
        free = np.arange(len(old[0]))
        while len(free):  # of keys that end at one free slot the last one takes it; the others search again
            slot = self._slots(old[0][free])
            self.keys[slot] = old[0][free]
            won = self.keys[slot] == old[0][free]
            self.next[slot[won]], self.emit[slot[won]] = old[1][free[won]], old[2][free[won]]
            free = free[~won]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and emitted tokens of each pair; transitions not met before are compiled."""
        keys = states.astype(np.int64) * _SYMBOLS + symbols
        slot = self._slots(keys)
        missing = self.keys[slot] < 0
        if missing.any():
            new = np.unique(keys[missing]).tolist()
            self._grow(len(new))
            self._insert([(key, *self._compile(key)) for key in new])
            slot = self._slots(keys)
        return self.next[slot], self.emit[slot]

    def run(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and tokens of stretches of symbols, each from its own entry state."""
        order = np.argsort(-lengths, kind="stable")
        at, state, total = starts[order], states[order].astype(np.int32), np.zeros(len(order), np.int64)
        active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max()) if len(lengths) else 0), "left")
        for k, n in enumerate(active.tolist()):
            state[:n], emitted = self.step(state[:n], symbols[at[:n] + k])
            total[:n] += emitted
        exits, tokens = np.empty_like(state), np.empty_like(total)
        exits[order], tokens[order] = state, total
        return exits, tokens

    def count(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each word; words reach from one start to the next."""
        if self.size > self.most:
            self.clear()
        lengths = np.diff(np.append(starts, len(symbols)))
        long = lengths > CHUNK
        tokens = np.zeros(len(starts), np.int64)
        tokens[~long] = self.run(symbols, starts[~long], lengths[~long], np.zeros(int((~long).sum()), np.int32))[1]
        if long.any():
            tokens[long] = self._count_long(symbols, starts[long], lengths[long])
        return tokens

    def _count_long(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of words cut into chunks, by maps of chunks and their composition."""
        chunks = -(-lengths // CHUNK)
        firsts = np.cumsum(chunks) - chunks
        word = np.repeat(np.arange(len(starts)), chunks)
        begin = starts[word] + CHUNK * (np.arange(len(word)) - firsts[word])
        size = np.minimum(CHUNK, starts[word] + lengths[word] - begin)
        final = np.zeros(len(word), bool)
        final[firsts + chunks - 1] = True
        # Entries of the maps: (chunk, state) in one number, sorted, with exit and tokens.
        width = np.int64(1) << 40
        key, leave, tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        wanted = np.arange(len(word)) * width
        while len(wanted):
            chunk = wanted // width
            exits, emitted = self.run(symbols, begin[chunk], size[chunk], wanted % width)
            key, leave, tokens = np.append(key, wanted), np.append(leave, exits), np.append(tokens, emitted)
            order = np.argsort(key)
            key, leave, tokens = key[order], leave[order], tokens[order]
            follows = (key // width + 1) * width + leave
            goes_on = ~final[key // width]
            wanted = np.setdiff1d(follows[goes_on], key)
        after = np.where(goes_on, np.searchsorted(key, follows), len(key))
        after, total = np.append(after, len(key)), np.append(tokens, 0)
        while (after[:-1] < len(key)).any():  # composed over 2, 4, 8 ... chunks
            total, after = total + total[after], after[after]
        return total[np.searchsorted(key, firsts * width)]


class Counter:
    """Token counts of texts for one vocabulary file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model = given["model"]
        names = sorted(model["vocab"], key=model["vocab"].get)
        self.transducer = Transducer(Merges(names, [tuple(pair) for pair in model["merges"]], model["end_of_word_suffix"]))
        special = [re.escape(token["content"]) for token in given["added_tokens"]]
        self.special = re.compile("|".join(special)).search if special else lambda _: None
        self.split = re.compile("|".join(special)).split if special else lambda t: [t]
        self.classes = classes()
        self.byte_of = {letter: b for b, letter in enumerate(byte_letters())}

    def _words(self, whole: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a text without its white space, and where words start."""
        if not whole.isascii():
            whole = unicodedata.normalize("NFC", whole).replace("Σ", "σ")
        lowered = whole.lower()
        points = np.frombuffer(lowered.encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        if (kind == UNKNOWN).any():
            return self._asked(whole)
        # A run of letters or of other signs is a word, as is each number.
        start = kind != SPACE
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        n = len(points)
        quote = np.flatnonzero((points == ord("'")) & start)
        quote = quote[quote + 1 < n]
        quote = quote[kind[quote + 1] == LETTER]  # a sign alone, before letters
        padded = np.append(points, [0, 0])
        for suffix in _SUFFIXES:
            hits = quote[np.all([padded[quote + 1 + k] == ord(c) for k, c in enumerate(suffix)], axis=0)]
            start[hits + 1] = False
            end = hits + 1 + len(suffix)
            end = end[end < n]
            start[end[kind[end] == LETTER]] = True
        data = np.frombuffer(lowered.encode(), np.uint8)
        head = np.flatnonzero((data & 0xC0) != 0x80)  # a character's first byte
        sizes = np.diff(np.append(head, len(data)))
        inside = kind != SPACE
        data = data[np.repeat(inside, sizes)]
        place = np.cumsum(np.where(inside, sizes, 0)) - sizes
        return self._marked(data, place[start])

    def _asked(self, whole: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for signs that Python does not know, split by the tokenizer itself."""
        t = self.tokenizer
        pieces = [p for p, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(whole))]
        data = np.array([self.byte_of[c] for p in pieces for c in p], np.uint8)
        lengths = np.array([len(p) for p in pieces], np.int64)
        return self._marked(data, np.cumsum(lengths) - lengths)

    @staticmethod
    def _marked(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = data.astype(np.int64)
        symbols[np.append(starts[1:], len(symbols))[: len(starts)] - 1] += _LAST
        return symbols, starts

    def count(self, texts: list[str]) -> list[int]:
        """The tokenizer's number of tokens of each text, without added ones; special strings in a text are one token each."""
        pieces, owner, extra = [], [], [0] * len(texts)
        for k, t in enumerate(texts):
            parts = self.split(t) if self.special(t) else [t]
            extra[k] = len(parts) - 1
            pieces += parts
            owner += [k] * len(parts)
        words = [self._words(p) for p in pieces]
        ends = np.cumsum([len(s) for s, _ in words])
        starts = np.concatenate([at + end - len(s) for (s, at), end in zip(words, ends, strict=True)])
        tokens = self.transducer.count(np.concatenate([s for s, _ in words]), starts)
        bounds = np.concatenate(([0], np.cumsum([len(at) for _, at in words])))
        sums = np.diff(np.concatenate(([0], np.cumsum(tokens)))[bounds])
        return (np.bincount(owner, weights=sums, minlength=len(texts)).astype(np.int64) + np.array(extra)).tolist()


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One for all tasks of a Python worker: what is compiled stays."""
    return Counter(path)


def counted(docs: DataFrame, path: str | None = None, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than over tokens) of each whole text of docs (doc_id, text).

    A null or empty text has no bytes and no tokens; a null doc_id stays null; a repeated row gives a repeated row; other
    columns are ignored; an empty table gives an empty result.
    """
    path = path or vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            offsets, _ = text.utf8(batch.column("text"))
            for i, j in text.slices(offsets):
                tokens = own.count([t or "" for t in batch.column("text").slice(i, j - i).to_pylist()])
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(tokens, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > over)
