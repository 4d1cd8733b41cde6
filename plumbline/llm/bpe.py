"""Byte-level BPE: speculate with greedy longest matches, verify adjacent pairs, merge only what fails.

A sequence of tokens is what the merges make of a word if and only if each token is made of its own bytes
and each adjacent pair, merged by itself, stays that pair; this holds when every token comes of one merge.
So a greedy proposal needs one look per adjacent pair, and an answer for a pair holds for the whole corpus.

A batch of texts is one array of characters: words are cut by character classes, told apart by Arrow, and only
those that aren't remembered are encoded; token ids and decoded bytes are gathered from tables.
"""

from __future__ import annotations

import heapq
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, ship, text_bytes

#: White space as the tokenizer's pattern engine sees it (Unicode White_Space); fixed values.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level split pattern, a fixed value of the public vocabulary. words_begin() cuts by it.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Contractions that the pattern keeps in one word, after their apostrophe; fixed values.
_ONE_LETTER, _TWO_LETTERS = "stmd", ("re", "ve", "ll")


def character_classes() -> np.ndarray:
    """Per code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    out = np.full(0x110000, 3, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, of in ((0, f"[{_SPACE}]+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
        for found in regex.finditer(of, every):
            out[ord(found[0][0]) : ord(found[0][-1]) + 1] = kind
    return out


def _byte_letters() -> dict[str, int]:
    """The printable letter that a vocabulary file writes for each byte: itself, or the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(free)}


def load_vocabulary(path: str) -> dict:
    """What encode and decode need, from a vocabulary file of the tokenizers library (read on the driver)."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    letters = _byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    ids = {raw(t): i for t, i in told["model"]["vocab"].items()}
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in told["model"]["merges"]]
    return {
        "ids": ids,
        "merges": {(ids[raw(a)], ids[raw(b)]): (rank, ids[raw(a) + raw(b)]) for rank, (a, b) in enumerate(merges)},
        "special": {t["content"]: t["id"] for t in told.get("added_tokens", [])},
        "classes": character_classes(),
    }


_NEVER = 1 << 40

class SpeculativeBPE:
    """Encodes and decodes. The tokens of a word are remembered; beyond most_words all words are forgotten at once."""

    def __init__(self, vocabulary: dict, most_words: int = 1 << 17):
        self.ids, self.merges, self.special = vocabulary["ids"], vocabulary["merges"], vocabulary["special"]
        self.classes, self.most_words = vocabulary["classes"], most_words
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        longest_first = sorted((t.encode() for t in self.special), key=len, reverse=True)
        self.find_special = re.compile(b"|".join(map(re.escape, longest_first))) if self.special else None
        self.finder = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.finder.add_word(token.decode("latin-1"), i)
        self.finder.make_automaton()
        self._spines()
        table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.table = pa.array(table, pa.binary())
        self.sound = np.zeros(len(table), dtype=np.int8)  # 1: made of its own bytes, -1: not, 0: not looked at
        self._forget()

    def _forget(self) -> None:
        """What is remembered: words by number, and of each number its tokens, as a range of one array."""
        self.number: dict[bytes, int] = {}
        self.start, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        if self.special:
            self._remember([t.encode() for t in self.special], np.array([*self.special.values()], dtype=np.int32), np.ones(len(self.special), dtype=np.int64))

    def _remember(self, words: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def _spines(self) -> None:
        """Per token, what stands at its right and at its left edge while the merges make it, each with the
        rank of the merge that uses it up; and the ranks of all merges by pair, for binary search."""
        parts = {made: (rank, pair) for pair, (rank, made) in self.merges.items()}
        top = max(self.bytes_of) + 1
        edges: list[list[tuple[int, int, int]]] = [[], []]
        for token in self.ids.values():
            for side in (0, 1):
                at, used = token, _NEVER
                while True:
                    edges[side].append((token, at, used))
                    if at not in parts:
                        break
                    used, at = parts[at][0], parts[at][1][1 - side]
        self.edge = []
        for side in (0, 1):
            table = np.array(edges[side], dtype=np.int64)
            table = table[np.argsort(table[:, 0], kind="stable")]
            start = np.searchsorted(table[:, 0], np.arange(top + 1))
            self.edge.append((start, table[:, 1], table[:, 2]))
        keys = np.array([a << 32 | b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.made_of_rank = np.array([made for _, made in sorted(self.merges.values())], dtype=np.int64)
        self.byte_id = np.array([self.ids[bytes([k])] for k in range(256)], dtype=np.int64)
        self.merge_keys, self.merge_ranks = keys[order], np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one word: the lowest-ranked adjacent pair first, the leftmost of equals, until none is left."""
        token = [self.ids[word[k : k + 1]] for k in range(len(word))]
        n = len(token)
        after, before, get = [*range(1, n + 1)], [*range(-1, n - 1)], self.merges.get
        heap = [(*m, k, token[k], token[k + 1]) for k in range(n - 1) if (m := get((token[k], token[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, made, k, a, b = heapq.heappop(heap)
            if token[k] != a or (nxt := after[k]) >= n or token[nxt] != b:
                continue  # used up meanwhile
            token[k], token[nxt], after[k] = made, -1, after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if m := get((made, token[after[k]])):
                    heapq.heappush(heap, (*m, k, made, token[after[k]]))
            if (prev := before[k]) >= 0 and (m := get((token[prev], made))):
                heapq.heappush(heap, (*m, prev, token[prev], made))
        return [t for t in token if t >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_ranks[at], _NEVER)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many words side by side: each round makes the next merge of every word that has one. Returns
        the tokens, word after word, and the number of each word's."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        long = np.flatnonzero(lengths > 48)
        done_word, done_token = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in long.tolist():
            done_token.append(np.array(self.merge(words[k]), dtype=np.int64))
            done_word.append(np.full(len(done_token[-1]), k))
        short = np.flatnonzero(lengths <= 48)
        token = self.byte_id[np.frombuffer(b"".join([words[k] for k in short.tolist()]), dtype=np.uint8)]
        word = np.repeat(short, lengths[short])
        rank = np.full(len(token), _NEVER)  # of the pair that begins here
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._ranks(token[inner], token[inner + 1])
        while len(token):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(token)])
            if (over := least == _NEVER).any():
                mask = np.repeat(over, size)
                done_word.append(word[mask])
                done_token.append(token[mask])
                token, word, rank = token[~mask], word[~mask], rank[~mask]
                least, size = least[~over], size[~over]
                if not len(token):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.r_[True, word[at][1:] != word[at][:-1]]]  # the leftmost of each word
            token[at] = self.made_of_rank[rank[at]]
            keep = np.ones(len(token), dtype=bool)
            keep[at + 1] = False
            token, word, rank, at = token[keep], word[keep], rank[keep], at - np.arange(len(at))
            for spot in (at, at - 1):
                good = (spot >= 0) & (spot + 1 < len(token))
                rank[spot[(spot >= 0) & ~good]] = _NEVER
                spot = spot[good]
                same = word[spot] == word[spot + 1]
                if spot is not at:
                    rank[spot[~same]] = _NEVER
                spot = spot[same]
                rank[spot] = self._ranks(token[spot], token[spot + 1])
        word, token = np.concatenate(done_word), np.concatenate(done_token)
        return token[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def pairs_hold(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each adjacent pair of tokens stays a pair when its bytes are merged alone.

        It doesn't if some merge joins an edge of the left token with an edge of the right one before either
        is used up inside its own token; of two merges with the same rank the one further left comes first.
        """
        holds = np.ones(len(left), dtype=bool)
        (l_start, l_at, l_used), (r_start, r_at, r_used) = self.edge
        rows = np.arange(len(left))
        n_l, n_r = l_start[left + 1] - l_start[left], r_start[right + 1] - r_start[right]
        for i in range(int(n_l.max(initial=0))):
            for j in range(int(n_r.max(initial=0))):
                some = rows[(n_l > i) & (n_r > j) & holds]
                if not len(some):
                    continue
                x, y = l_start[left[some]] + i, r_start[right[some]] + j
                key = l_at[x] << 32 | r_at[y]
                at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
                rank = self.merge_ranks[at]
                holds[some[(self.merge_keys[at] == key) & (rank < l_used[x]) & (rank <= r_used[y])]] = False
        return holds

    def _unsound(self, tokens: np.ndarray) -> np.ndarray:
        for t in np.unique(tokens[self.sound[tokens] == 0]).tolist():
            self.sound[t] = 1 if self.merge(self.bytes_of[t]) == [t] else -1
        return self.sound[tokens] < 0

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words, and to which word each belongs. Words don't hold the byte 255."""
        told = np.array([i for _, i in self.finder.iter_long(b"\xff".join(words).decode("latin-1"))], dtype=np.int64)
        between = told == self.byte_id[255]
        return told[~between], np.cumsum(between)[~between]

    def learn(self, words: list[bytes]) -> None:
        """Encodes words that aren't remembered yet, all at once."""
        flat, word_of = self.propose(words)
        sizes = np.bincount(word_of, minlength=len(words))
        fails = np.zeros(len(words), dtype=bool)
        same = word_of[1:] == word_of[:-1]
        key, back = np.unique(flat[:-1][same] << 32 | flat[1:][same], return_inverse=True)
        fails[word_of[1:][same][~self.pairs_hold(key >> 32, key & 0xFFFFFFFF)[back]]] = True
        fails[word_of[self._unsound(flat)]] = True
        redo = np.flatnonzero(fails)
        if len(redo):
            stays = ~np.repeat(fails, sizes)
            merged, merged_sizes = self.merge_all([words[k] for k in redo.tolist()])
            self._remember([words[k] for k in np.flatnonzero(~fails).tolist()], flat[stays].astype(np.int32), sizes[~fails])
            self._remember([words[k] for k in redo.tolist()], merged.astype(np.int32), merged_sizes)
        else:
            self._remember(words, flat.astype(np.int32), sizes)

    def words_begin(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        """For each byte of the texts in data, which begin at starts, whether a word of PATTERN begins there."""
        raw = np.frombuffer(data, dtype=np.uint8)
        lead = (raw & 0xC0) != 0x80
        code = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        cut = np.zeros(len(raw) + 1, dtype=bool)  # where texts and special tokens begin and end
        cut[starts] = True
        inside = []
        for found in self.find_special.finditer(data) if self.find_special else ():
            if not cut[found.start() + 1 : found.end()].any():
                inside.append(found.span())
        for a, b in inside:
            cut[[a, b]] = True
        first = cut[:-1][lead]
        kind = self.classes[code]
        begins = first.copy()
        begins[1:] |= kind[1:] != kind[:-1]
        # white space before a word: its last character stands alone, or goes to the word if it is a blank
        after = np.flatnonzero((kind[1:] != 0) & (kind[:-1] == 0) & ~first[1:]) + 1
        begins[after - 1] = True
        begins[after[code[after - 1] == 0x20]] = False
        quote = np.flatnonzero((code[:-1] == 0x27) & begins[:-1] & (kind[1:] == 1) & ~first[1:])
        if len(quote):
            one = np.isin(code[quote + 1], [ord(c) for c in _ONE_LETTER])
            third = np.minimum(quote + 2, len(code) - 1)
            pair = code[quote + 1].astype(np.int64) << 32 | code[third]
            two = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in _TWO_LETTERS]) & (quote + 2 < len(code)) & ~first[third]
            begins[quote[one | two] + 1] = False
            rest = np.concatenate([quote[one] + 2, quote[two] + 3])
            begins[rest[rest < len(code)]] = True
        out = np.zeros(len(raw), dtype=bool)
        out[lead] = begins
        for a, b in inside:
            out[a + 1 : b] = False
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts, one after the other, and the number of each text's."""
        data = b"".join(texts)
        if not data:
            return np.empty(0, np.int32), np.zeros(len(texts), dtype=np.int64)
        if len(self.number) > self.most_words:
            self._forget()
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        at = np.flatnonzero(self.words_begin(data, starts)).astype(np.int32)
        offsets = pa.py_buffer(np.append(at, np.int32(len(data))))
        words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        kinds = words.dictionary.to_pylist()
        known = list(map(self.number.get, kinds))
        if None in known:
            self.learn([w for w, k in zip(kinds, known) if k is None])
            known = list(map(self.number.__getitem__, kinds))
        number = np.array(known, dtype=np.int64)[words.indices.to_numpy()]
        sizes = self.size[number]
        ends = np.cumsum(sizes)
        place = np.repeat(self.start[number] - (ends - sizes), sizes)
        place += np.arange(len(place))
        before = np.append(0, ends)[np.searchsorted(at, np.append(starts, len(data)))]
        return self.flat[place], np.diff(before)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts of token ids, given one after the other with the number of each text's; special tokens are kept."""
        told = self.table.take(pa.array(ids, pa.int32()))
        if not len(ids):
            return pa.array([""] * len(sizes), pa.string())
        ends = np.frombuffer(told.buffers()[1], dtype=np.int32)[np.append(0, np.cumsum(sizes))]
        raw = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), told.buffers()[2]])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:  # ids that don't come of a text
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text, and the text that they decode to.

    Returns id_col, ids array<int>, decoded string. A null or empty text has no ids and decodes to the empty
    text. Rows are kept one for one, repeated and null ids too; other columns aren't read. The vocabulary
    (fixed size) is read on the driver and broadcast. One pass, no shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    state: dict = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "bpe" not in state:
            state["bpe"] = SpeculativeBPE(held.value)
        ids, sizes = state["bpe"].encode(text_bytes(batch.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, state["bpe"].decode(ids, sizes)], names=[id_col, "ids", "decoded"])

    picked = docs.select(F.col(id_col), F.col(text_col))
    kind = picked.schema[id_col].dataType.simpleString()
    return mapped(picked, work, f"`{id_col}` {kind}, ids array<int>, decoded string", 2 << 20)
