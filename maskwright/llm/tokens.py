"""Token ids of whole texts by a tokenizer file, with a bounded per-worker table of pieces already encoded.

The file's own rules split texts at white space before any merge, so a text's ids are those of its parts between
white space, one after the other. A part of plain Latin letters with punctuation behind it is split once more and
lower-cased, as the file's rules do. Such pieces of at most 16 bytes are looked up all at once, by their exact bytes, in
a table of numpy arrays; the tokenizer's model only sees pieces that are new to a worker. All other parts
go to the tokenizer as they are. Long texts are taken in steps that end at a blank.
"""

from __future__ import annotations

import os

import numpy as np

#: A worker forgets its pieces beyond so many (about 40 MB); it bounds memory and changes no result.
MEMORY = 1_000_000
#: Bytes of text taken at once, and the longest piece that the table holds.
STEP, LONGEST = 500_000, 16
#: Of other parts a worker keeps so many bytes at most.
ODD_BYTES = 8_000_000
_BLANK, _MARK, _LOWER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), np.arange(256, dtype=np.uint8)
_BLANK[[32, 9, 10, 13]] = True
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Pieces:
    """Open addressing over (length, first 8 bytes, last 8 bytes), which is a piece of at most 16 bytes exactly."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.bytes = self.tok.model, {}
        self.slots_mask = np.uint64((1 << (2 * MEMORY - 1).bit_length()) - 1)
        self.forget()

    def forget(self) -> None:
        self.n, self.used, self.odd, self.odd_bytes = 0, 0, {}, 0
        self.slots = np.full(int(self.slots_mask) + 1, -1, dtype=np.int32)
        self.head, self.tail = np.zeros(MEMORY, dtype=np.uint64), np.zeros(MEMORY, dtype=np.uint64)
        self.size, self.count, self.at = np.zeros(MEMORY, dtype=np.uint8), np.zeros(MEMORY, dtype=np.uint8), np.zeros(MEMORY, dtype=np.int32)
        self.pool = np.zeros(4 * MEMORY, dtype=np.uint32)

    def model_ids(self, piece: bytes) -> list[int]:
        """Ids of a lower-case word or a run of punctuation, by the file's model alone: the rules before it only change the alphabet."""
        text = piece.decode()
        if not text.isascii():
            for c in text:
                if c not in self.bytes:
                    [(shown, _)] = self.tok.pre_tokenizer.pre_tokenize_str(c)
                    self.bytes[c] = shown
            text = "".join(map(self.bytes.__getitem__, text))
        return [t.id for t in self.model.tokenize(text)]

    def slot(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (_mix(_mix(head) ^ (tail * np.uint64(0x9E3779B97F4A7C15)) ^ size.astype(np.uint64)) & self.slots_mask).astype(np.int64)

    def find(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each piece's entry, -1 where it is new."""
        slot = self.slot(head, tail, size)
        entry = self.slots[slot]
        open_ = np.flatnonzero(entry >= 0)
        e = entry[open_]
        wrong = open_[(self.head[e] != head[open_]) | (self.tail[e] != tail[open_]) | (self.size[e] != size[open_])]
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & int(self.slots_mask)
            e = entry[wrong] = self.slots[slot[wrong]]
            some, e = wrong[e >= 0], e[e >= 0]
            wrong = some[(self.head[e] != head[some]) | (self.tail[e] != tail[some]) | (self.size[e] != size[some])]
        return entry

    def learn(self, raw: bytes, start: np.ndarray, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entries of pieces that are new and now are added; start: where in `raw` each one stands."""
        order = np.lexsort((size, tail, head))
        first = np.r_[True, (head[order][1:] != head[order][:-1]) | (tail[order][1:] != tail[order][:-1]) | (size[order][1:] != size[order][:-1])]
        one, which = order[first], np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(first) - 1
        found = [self.model_ids(raw[a : a + n]) for a, n in zip(start[one].tolist(), size[one].tolist())]
        counts = np.array([len(f) for f in found])
        new, to = np.arange(self.n, self.n + len(one)), self.used + int(counts.sum())
        if to > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(to, len(self.pool)), dtype=np.uint32)])
        self.pool[self.used : to] = [i for f in found for i in f]
        self.head[new], self.tail[new], self.size[new], self.count[new] = head[one], tail[one], size[one], counts
        self.at[new] = self.used + np.cumsum(counts) - counts
        self.used, self.n = to, self.n + len(one)
        slot = self.slot(head[one], tail[one], size[one])
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]  # of several for one slot the last stays
            left = self.slots[slot] != new
            new, slot = new[left], (slot[left] + 1) & int(self.slots_mask)
        return self.n - len(one) + which

    def odd_ids(self, part: bytes) -> np.ndarray:
        if (ids := self.odd.get(part)) is None:
            ids = np.asarray(self.tok.encode(part.decode(), add_special_tokens=False).ids, dtype=np.uint32)
            self.odd_bytes += 200 + len(part) + ids.nbytes
            if self.odd_bytes > ODD_BYTES:
                self.odd, self.odd_bytes = {}, 0
            self.odd[part] = ids
        return ids

    def step(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that a NUL-free gap of one blank separates: the ids, and for each id where in `data` its part begins."""
        x = np.frombuffer(data, dtype=np.uint8)
        n = len(x)
        ink = np.zeros(n + 2, dtype=np.int8)
        ink[1:-1] = ~_BLANK[x]
        edge = np.diff(ink)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        latin = x == 0xC3
        behind = np.zeros(n, dtype=bool)
        behind[1:] = latin[:-1]
        low = _LOWER[x]
        low[behind & (x >= 0x80) & (x <= 0x9E) & (x != 0x97)] += 32
        other = ~(_LETTER[x] | latin | (behind & (x != 0x97) & (x != 0xB7)))
        core = np.maximum(start, np.maximum.accumulate(np.where(_MARK[x], 0, np.arange(1, n + 1)))[end - 1])
        others = np.zeros(n + 1, dtype=np.int32)
        np.cumsum(other, out=others[1:])
        odd = (others[core] > others[start]) | (core - start > LONGEST) | (end - core > LONGEST)
        core[odd] = end[odd]
        s, e = np.stack([start, core], axis=1).ravel(), np.stack([core, end], axis=1).ravel()
        strange, full = np.repeat(odd, 2), e > s
        s, e, strange = s[full], e[full], strange[full]
        padded = np.concatenate([np.zeros(8, dtype=np.uint8), low, np.zeros(8, dtype=np.uint8)])
        words = np.ndarray(shape=(n + 9,), dtype="<u8", buffer=padded.data, strides=(1,))
        size = e - s
        head = words[s + 8] & _KEEP[np.minimum(size, 8)]
        tail = np.where(size > 8, words[e], np.uint64(0))
        head[strange] = tail[strange] = 0
        size = np.where(strange, 0, size).astype(np.uint8)
        if self.n + len(s) > MEMORY:
            self.forget()
        entry = self.find(head, tail, size)
        raw = low.tobytes()
        new = np.flatnonzero((entry < 0) & ~strange)
        if len(new):
            entry[new] = self.learn(raw, s[new], head[new], tail[new], size[new])
        entry[strange] = 0
        count = np.where(strange, 0, self.count[entry]).astype(np.int64)
        strange = np.flatnonzero(strange)
        found = [self.odd_ids(data[a:b]) for a, b in zip(s[strange].tolist(), e[strange].tolist())]
        count[strange] = [len(f) for f in found]
        stop = np.cumsum(count)
        total, first = int(stop[-1]), stop - count
        ids = self.pool[np.minimum(np.repeat(self.at[entry] - first, count) + np.arange(total), len(self.pool) - 1)]
        for f, a in zip(found, first[strange].tolist()):
            ids[a : a + len(f)] = f
        return ids, np.repeat(s, count)


_loaded: dict[str, _Pieces] = {}


def _cuts(raw: bytes) -> list[bytes]:
    """The text in steps of about STEP bytes, each but the last ended by a blank."""
    out, at = [], 0
    while len(raw) - at > STEP:
        to = raw.rfind(b" ", at, at + STEP)
        if to < at and (to := raw.find(b" ", at + STEP)) < 0:
            break
        out.append(raw[at : to + 1])
        at = to + 1
    return [*out, raw[at:]]


def encode(path: str, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
    """Ids of each text (unsigned 32-bit), end_id behind them if given."""
    if (pieces := _loaded.get(path)) is None:
        pieces = _loaded[path] = _Pieces(path)
    end = np.asarray([] if end_id is None else [end_id], dtype=np.uint32)
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        ids, at = pieces.step(b" ".join([raw for _, raw in held]))
        stops = np.cumsum([len(raw) + 1 for _, raw in held])
        for (k, _), some in zip(held, np.split(ids, np.searchsorted(at, stops)[:-1])):
            parts[k].append(some)
        held.clear()

    for k, text in enumerate(texts):
        for raw in _cuts(text.encode("utf-8", "replace")):
            if held and size + len(raw) > STEP:
                flush()
                size = 0
            held.append((k, raw))
            size += len(raw) + 1
    if held:
        flush()
    return [np.concatenate([*p, end]) for p in parts]
