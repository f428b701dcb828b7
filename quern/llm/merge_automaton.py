"""Byte-level BPE merges compiled to a deterministic transducer over bytes.

A sequence of tokens is what the merges make of its bytes if and only if each
token is what they make of its own bytes and no two neighbours would have been
merged across their boundary before they were complete.  So the last token of a
prefix is the one token that ends there and stands well beside the last token of
what comes before it, and a prefix's count is one more than that one's.

After some bytes all that matters is, for each place where a token could still be
open, the vocabulary's trie node of the bytes since, the last token before it and
the count of tokens up to it, less the count up to now.  These facts are the
automaton's state; a transition reads a byte and carries the change of the count
(a merge makes it fall).  States and transitions are compiled when first reached
and depend on the vocabulary alone.  All pieces of a batch run at once, a byte a
step, longest first; the last few long ones go on one by one.

The memory has a bound: with ``most`` states, those in use are kept and the others
are compiled again when needed.
"""

from __future__ import annotations

import json

import numpy as np

#: Added to the changes of counts, which a token's length bounds, to keep them positive.
BIAS = 192
#: States that a worker holds, and those that it keeps from one task to the next.
STATES, KEPT = 400_000, 200_000
#: Pieces under which a batch's rest goes piece by piece.
FEW = 24
_TURN = np.uint32(0x9E3779B1)
_NONE = np.uint32(0xFFFFFFFF)
FOREVER = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies' letters: a byte that prints is itself, the others are letters from 256 on, in order."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(more)] = b
            more += 1
    return out


class Table:
    """Transitions by state and byte in an open-addressed hash table; 32 bits hold 256 * state + byte, and 512 * state + change."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, _NONE, np.uint32), np.zeros(1 << bits, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for keys that aren't there."""
        slots = (keys * _TURN) >> np.uint32(32 - self.bits)
        out = self.values.take(slots)
        wrong = np.flatnonzero(self.keys.take(slots) != keys)
        if len(wrong):
            slots, rest = slots[wrong], keys[wrong]
            found = self.keys[slots]
            while len(wrong):
                empty = found == _NONE
                out[wrong[empty]] = -1
                go = ~empty
                wrong, rest = wrong[go], rest[go]
                slots = (slots[go] + np.uint32(1)) & np.uint32((1 << self.bits) - 1)
                found = self.keys[slots]
                right = found == rest
                out[wrong[right]] = self.values[slots[right]]
                wrong, rest, slots, found = wrong[~right], rest[~right], slots[~right], found[~right]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once."""
        self.used += len(keys)
        if 4 * self.used > 1 << self.bits:
            held = self.keys != _NONE
            keys, values = np.r_[self.keys[held], keys], np.r_[self.values[held], values]
            self.__init__(max(self.bits + 1, int(4 * len(keys)).bit_length()))
            self.used = len(keys)
        slots = (keys * _TURN) >> np.uint32(32 - self.bits)
        while len(keys):
            _, first = np.unique(slots, return_index=True)
            here = first[self.keys[slots[first]] == _NONE]
            self.keys[slots[here]], self.values[slots[here]] = keys[here], values[here]
            left = np.ones(len(keys), bool)
            left[here] = False
            keys, values = keys[left], values[left]
            slots = (slots[left] + np.uint32(1)) & np.uint32((1 << self.bits) - 1)


def entry(node: int, before: int, far: int) -> int:
    """A place of a state as one number: trie node, the last token before it or -1, and its count less the present one."""
    return node << 40 | before + 1 << 16 | far + 32768


class MergeAutomaton:
    _open: dict[str, "MergeAutomaton"] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model = given["model"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd or given["pre_tokenizer"].get("type") != "ByteLevel" or given.get("normalizer"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        self.added = {x["content"]: x["id"] for x in given.get("added_tokens", ())}
        letters, ids = byte_alphabet(), model["vocab"]
        size = 1 + max(ids.values())
        self.first, self.second, self.born = [-1] * size, [-1] * size, [FOREVER] * size
        self.length = np.ones(size, np.int64)
        self.pairs: dict[tuple[int, int], int] = {}
        spelt: dict[int, bytes] = {}
        for text, i in ids.items():
            if len(text) == 1 and text in letters:
                spelt[i], self.born[i] = bytes([letters[text]]), -1
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = ids[a], ids[b], ids[a + b]
            if z in spelt or x not in spelt or y not in spelt or max(self.born[x], self.born[y]) >= rank:
                raise ValueError("merges aren't in order of their parts")
            spelt[z], self.first[z], self.second[z], self.born[z], self.pairs[x, y] = spelt[x] + spelt[y], x, y, rank, rank
        if len({v for v in spelt.values() if len(v) == 1}) < 256 or max(map(len, spelt.values())) >= BIAS:
            raise ValueError("bytes are missing, or tokens are too long")
        whole = {i: True for i in spelt if self.born[i] < 0}
        for i in sorted((i for i in spelt if self.born[i] >= 0), key=self.born.__getitem__):
            whole[i] = whole[self.first[i]] and whole[self.second[i]] and not self.crossed(self.first[i], self.second[i], inner=True)
        self.child: dict[int, int] = {}
        self.token_at, self.opens = [-1], [True]
        for i, text in spelt.items():
            self.length[i] = len(text)
            if not whole[i]:
                continue
            node = 0
            for b in text:
                key = node << 8 | b
                self.opens[node] = True
                node = self.child.get(key, -1)
                if node < 0:
                    node = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.opens.append(False)
            self.token_at[node] = i
        self._reset([(entry(0, -1, 0),)])

    @classmethod
    def of(cls, path: str) -> "MergeAutomaton":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def rest(self) -> None:
        """Make room for other work between tasks."""
        if len(self.states) > KEPT:
            self._reset(self.states[:1])

    def crossed(self, a: int, b: int, inner: bool = False) -> bool:
        """Whether a merge would take the end of ``a`` with the beginning of ``b`` before both are complete.

        ``inner``: before the merge of the two themselves.  Goes back through the tokens that stood at the
        boundary, latest first; each was there until ``until_a`` and ``until_b``.  Equal ranks go from left to right.
        """
        until_a = until_b = FOREVER
        look = not inner
        while True:
            rank = self.pairs.get((a, b)) if look else None
            if rank is not None and rank < until_a and rank <= until_b:
                return True
            look = True
            at_a, at_b = self.born[a], self.born[b]
            if at_a < 0 and at_b < 0:
                return False
            if at_a > at_b:
                until_a, a = at_a, self.second[a]
            else:
                until_b, b = at_b, self.first[b]

    def _reset(self, states: list[tuple]) -> None:
        """Begin anew with these states, the start first."""
        self.states = states
        self.number = {s: i for i, s in enumerate(states)}
        self.table = Table()
        self.beside: dict[int, bool] = {}
        self.last = np.array([(s[-1] >> 16 & 0xFFFFFF) - 1 for s in states], np.int32)

    def _compile(self, keys: list[int]) -> np.ndarray:
        """The transitions of states and bytes (256 * state + byte): 512 times the next state, plus the change of the count and ``BIAS``."""
        child, token_at, opens, beside, states, numbers = self.child.get, self.token_at, self.opens, self.beside, self.states, self.number
        values = []
        for key in keys:
            byte, on, token, count = key & 255, [], -1, 0
            for e in states[key >> 8]:
                node = child(e >> 40 << 8 | byte, -1)
                if node < 0:
                    continue
                if token < 0 and (t := token_at[node]) >= 0:
                    before = (e >> 16 & 0xFFFFFF) - 1
                    apart = before < 0 or beside.get(before << 32 | t)
                    if apart is None:
                        apart = beside[before << 32 | t] = not self.crossed(before, t)
                    if apart:
                        token, count = t, (e & 0xFFFF) - 32767
                if opens[node]:
                    on.append(node << 40 | e & 0xFFFFFFFFFF)
            on = [e - count for e in on]
            on.append(token + 1 << 16 | 32768)
            state = tuple(on)
            number = numbers.get(state)
            if number is None:
                number = numbers[state] = len(states)
                states.append(state)
            values.append(number << 9 | count + BIAS)
        if len(states) > len(self.last):
            more = [(s[-1] >> 16 & 0xFFFFFF) - 1 for s in states[len(self.last) :]]
            self.last = np.r_[self.last, np.array(more, np.int32)]
        out = np.array(values, np.int32)
        self.table.put(np.array(keys, np.uint32), out)
        return out

    def run(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, tokens: np.ndarray | None = None) -> np.ndarray:
        """Tokens of each piece ``data[start : start + length]``.  ``tokens``: takes the last token of the prefix that ends at each byte."""
        order = np.argsort(-length.astype(np.int32), kind="stable") if length.max(initial=0) > 32767 else np.argsort(-length.astype(np.int16), kind="stable")
        at, size = start[order].astype(np.int32), length[order].astype(np.int32)
        state, total = np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64)
        live, k = len(at), 0
        while live:
            if live < FEW:
                for i in range(live):
                    self._alone(i, k, data, at, size, state[:live], total, tokens)
                break
            place = at[:live] + np.int32(k)
            keys = state[:live] << np.uint32(8) | data.take(place)
            got = self.table.get(keys)
            if got.min() < 0:
                if len(self.states) > STATES:
                    keys = self._shrink(state[:live]) << np.uint32(8) | data.take(place)
                    got = self.table.get(keys)
                self._compile(np.unique(keys[got < 0]).tolist())
                got = self.table.get(keys)
            total[:live] += got & 511
            got >>= 9
            state[:live] = got
            if tokens is not None:
                tokens[place] = self.last.take(got)
            k += 1
            live = int(np.searchsorted(-size[:live], -k, side="left"))
        out = np.empty(len(at), np.int64)
        out[order] = total - BIAS * size.astype(np.int64)
        return out

    def _shrink(self, state: np.ndarray) -> np.ndarray:
        """Keep the states in use; renumbers them in place."""
        used = np.unique(np.r_[np.uint32(0), state])
        state[:] = np.searchsorted(used, state)
        self._reset([self.states[i] for i in used.tolist()])
        return state

    def _alone(self, i: int, k: int, data: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray, total: np.ndarray, tokens: np.ndarray | None) -> None:
        """The rest of one piece."""
        known: dict[int, int] = {}
        now, sum_, begin, out = int(state[i]), 0, int(at[i]) + k, []
        for byte in data[begin : begin + int(size[i]) - k].tobytes():
            key = now << 8 | byte
            value = known.get(key)
            if value is None:
                value = int(self.table.get(np.array([key], np.uint32))[0])
                if value < 0:
                    if len(self.states) > STATES:
                        rest = np.r_[np.uint32(now), state[i + 1 :]]
                        self._shrink(rest)
                        now, state[i + 1 :] = int(rest[0]), rest[1:]
                        known, key = {}, int(rest[0]) << 8 | byte
                    value = int(self._compile([key])[0])
                known[key] = value
            sum_ += value & 511
            now = value >> 9
            if tokens is not None:
                out.append((self.states[now][-1] >> 16 & 0xFFFFFF) - 1)
        total[i] += sum_
        if tokens is not None:
            tokens[begin : begin + len(out)] = out

    def ids(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each piece, and all their ids in order: from each piece's end back, a token at a time."""
        last = np.empty(len(data), np.int32)
        count = self.run(data, start, length, last)
        total = np.cumsum(count)
        out = np.empty(int(total[-1]) if len(total) else 0, "<u4")
        to, place, begin = total - 1, start + length - 1, start
        while len(place):
            t = last[place]
            out[to] = t
            place, to = place - self.length[t], to - 1
            more = place >= begin
            place, to, begin = place[more], to[more], begin[more]
        return count, out
