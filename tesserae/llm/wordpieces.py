"""Token ids of many texts at once, equal to the tokenizer's own.

The tokenizer lower-cases, splits texts into runs of letters, single digits and runs of other characters, and merges
the bytes of each run by rank (byte pair encoding with word ends). Characters between spaces are split here on bytes
where all of them are ASCII or Latin-1 letters; anything else (apostrophes, angle brackets, other alphabets) goes to
the tokenizer, one space-free run at a time, since no token reaches over a space. So do runs of over LONG_RUN bytes.
The ids of runs stay in a bounded hash table of the worker. A very long text goes in parts, cut at spaces.
"""

from __future__ import annotations

import json

import numpy as np

from tesserae.llm.common import BASES, byte_values, span_hashes

#: Runs that a worker keeps; beyond it the table starts anew.
KNOWN = 1 << 18
SLOT_BITS = 20
#: Longer runs go to the tokenizer, whose merges take n log n steps; those here take a pass over the run each.
LONG_RUN = 256
NO_RANK = np.int32(2**31 - 1)


def _classes() -> np.ndarray:
    """0 space, 1 letter, 2 digit, 3 other ASCII, 4 only the tokenizer splits it, 5 lead byte of a Latin-1 letter."""
    c = np.full(256, 4, np.uint8)
    c[0x21:0x7F] = 3
    c[ord("0") : ord("9") + 1] = 2
    c[ord("a") : ord("z") + 1] = 1
    c[ord("A") : ord("Z") + 1] = 1
    c[[0x20, *range(9, 14)]] = 0
    c[[ord("'"), ord("<")]] = 4
    c[0xC3] = 5
    return c


class Table:
    """64-bit keys to numbers, by open addressing."""

    def __init__(self, bits: int):
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.values[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            v = self.values[slot[wrong]]
            out[wrong] = v
            wrong = wrong[(v >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New, distinct keys."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.values[slot[left]] < 0
            _, first = np.unique(slot[left], return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            done = left[take]
            self.keys[slot[done]], self.values[slot[done]] = keys[done], values[done]
            left = left[~take]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)


def _mix(pairs: np.ndarray) -> np.ndarray:
    x = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


class Merges:
    """Byte pair encoding of many byte strings, from the tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        # the printable characters that stand for bytes in the file
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        name = {b: chr(b) for b in plain}
        name |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in name)}
        self.inner = np.array([vocab[name[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[name[b] + end] for b in range(256)], np.int32)
        rules = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        a, b, both = (np.array([vocab[x] for x in col], np.int64) for col in ([r[0] for r in rules], [r[1] for r in rules], [r[0] + r[1] for r in rules]))
        self.made = both.astype(np.int32)
        key = a << 17 | b
        _, first = np.unique(key, return_index=True)
        self.table = Table(19)
        self.table.put(_mix(key[first]), first.astype(np.int32))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.table.get(_mix((a.astype(np.int64) << 17 | b).ravel())).reshape(a.shape)
        r[r < 0] = NO_RANK
        return r

    def encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of buf[s:e] for each span, end to end, and their counts."""
        size = ends - starts
        counts = np.zeros(len(size), np.int64)
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        group = np.where(size <= 16, (size + 3) // 4 * 4, 1 << np.frexp(np.maximum(size - 1, 1).astype(np.float64))[1])
        for n in np.unique(group).tolist():
            own = np.flatnonzero(group == n)
            step = max(1, 2_000_000 // n)
            for k in range(0, len(own), step):
                which = own[k : k + step]
                width = size[which]
                cells = buf[np.minimum(starts[which][:, None] + np.arange(n), len(buf) - 1)]
                s = self.inner[cells]
                line = np.arange(len(s))
                s[line, width - 1] = self.last[cells[line, width - 1]]
                r = np.full((len(s), n), NO_RANK, np.int32)
                i, j = np.nonzero(np.arange(n) < width[:, None] - 1)
                r[i, j] = self.ranks(s[i, j], s[i, j + 1])
                while len(s):
                    best = r.argmin(1)
                    low = r[np.arange(len(s)), best]
                    done = low == NO_RANK
                    if done.any():
                        rows.append((which[done], s[done], width[done]))
                        counts[which[done]] = width[done]
                        go = ~done
                        s, r, which, best, low, width = s[go], r[go], which[go], best[go], low[go], width[go]
                        if not len(s):
                            break
                    line = np.arange(len(s))
                    s[line, best] = self.made[low]
                    width = width - 1
                    n_now = s.shape[1] - 1
                    right = np.arange(n_now) > best[:, None]
                    s = np.where(right, s[:, 1:], s[:, :-1])
                    r = np.where(right, r[:, 1:], r[:, :-1])
                    for at in (best - 1, best):
                        ok = np.flatnonzero((at >= 0) & (at < width - 1))
                        r[ok, at[ok]] = self.ranks(s[ok, at[ok]], s[ok, at[ok] + 1])
                    end = np.flatnonzero(best >= width - 1)
                    r[end, np.minimum(best[end], n_now - 1)] = NO_RANK
        begin = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.uint32)
        for which, s, width in rows:
            i, j = np.nonzero(np.arange(s.shape[1]) < width[:, None])
            flat[begin[which][i] + j] = s[i, j]
        return flat, counts


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.kind = _classes()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.clear()

    def clear(self) -> None:
        self.known, self.n = Table(SLOT_BITS), 0
        self.flat = np.zeros(1 << 20, np.uint32)
        self.begin = np.zeros(2, np.int64)

    def _learn(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        used = int(self.begin[self.n])
        while used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[used : used + len(ids)] = ids
        if self.n + len(keys) + 1 > len(self.begin):
            self.begin = np.r_[self.begin, np.zeros(max(len(self.begin), len(keys) + 1), np.int64)]
        self.begin[self.n + 1 : self.n + len(keys) + 1] = used + np.cumsum(counts)
        self.n += len(keys)

    def batch(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 documents laid end to end, and the documents' offsets among them."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = self.kind[buf]
        low = self.lower[buf]
        lead = np.flatnonzero(kind == 5)
        if len(lead):
            second = buf[np.minimum(lead + 1, n - 1)]
            letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
            kind[lead] = np.where(letter, 1, 4)
            kind[lead[letter] + 1] = 1
            upper = letter & (second <= 0x9E)
            low[lead[upper] + 1] += 32
        change = np.empty(n, bool)
        change[0] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        change |= kind == 2
        change[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(change)
        ends = np.r_[starts[1:], n]
        what = kind[starts]
        if (what == 4).any():  # whole runs between spaces that hold such bytes
            inked = what > 0
            fresh = np.r_[True, ~inked[:-1]] | np.isin(starts, offsets[:-1])
            group = np.cumsum(fresh & inked)
            hard = np.zeros(int(group[-1]) + 1, bool)
            hard[group[(what == 4)]] = True
            mine = inked & hard[group]
            head = np.flatnonzero(mine & fresh)
            s4, e4 = starts[head], ends[_tails(mine, fresh)]
            keep = inked & ~mine
            starts, ends, easy = np.r_[starts[keep], s4], np.r_[ends[keep], e4], np.r_[np.ones(int(keep.sum()), bool), np.zeros(len(s4), bool)]
            order = np.argsort(starts, kind="stable")
            starts, ends, easy = starts[order], ends[order], easy[order]
        else:
            keep = what > 0
            starts, ends = starts[keep], ends[keep]
            easy = np.ones(len(starts), bool)
        easy &= ends - starts <= LONG_RUN
        keys = span_hashes(byte_values()[np.where(kind == 4, buf, low)], starts, ends)
        keys = np.where(easy, keys, span_hashes(byte_values()[buf], starts, ends, BASES[1]) if not easy.all() else keys)
        found = self.known.get(keys)
        if (found < 0).any():
            new = np.flatnonzero(found < 0)
            new = new[np.unique(keys[new], return_index=True)[1]]
            if self.n and self.n + len(new) > KNOWN:
                self.clear()
                new = np.unique(keys, return_index=True)[1]
            if self.n + len(new) > KNOWN:  # one very long text
                self.known = Table(max(SLOT_BITS, int(2 * len(new)).bit_length()))
            mine = new[easy[new]]
            if len(mine):
                self._learn(keys[mine], *self.merges.encode(low, starts[mine], ends[mine]))
            other = new[~easy[new]]
            if len(other):
                raw = buf.tobytes()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)]
                ids = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
                self._learn(keys[other], np.array([x for i in ids for x in i], np.uint32), np.array([len(i) for i in ids], np.int64))
            found = self.known.get(keys)
        size = self.begin[found + 1] - self.begin[found]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.begin[found] - (end - size), size)]
        return ids, np.r_[0, end][np.searchsorted(starts, offsets)]


def parts(buf: np.ndarray, limit: int):
    """buf in pieces of about `limit` bytes, cut after a space; without one, a piece is longer."""
    a = 0
    while len(buf) - a > limit:
        b = a + limit
        while b < len(buf):
            near = np.flatnonzero(buf[b : b + 65536] == 32)
            if len(near):
                b += int(near[0]) + 1
                break
            b = min(b + 65536, len(buf))
        yield buf[a:b]
        a = b
    if a < len(buf) or not len(buf):
        yield buf[a:]


def _tails(mine: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The last run of each group of runs that `mine` marks."""
    after = np.r_[~mine[1:] | fresh[1:], True]
    return np.flatnonzero(mine & after)
