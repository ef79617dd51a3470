"""Many keywords at once: an automaton over bytes that goes through each text once.

Its states are the beginnings of keywords. Where no keyword goes on with the next byte, a failure link leads to the longest
beginning that the text read so far ends with; here failures are worked into the table of transitions, so that each byte is one
step. All texts of a batch are gone through side by side, cut into pieces that overlap by the longest keyword, one byte of every
piece at a time. Its table has a row for each of the keywords' bytes, of four bytes for each byte that they use: keywords beyond
MOST_BYTES, where it takes tens of megabytes, are looked up by windows.
"""

from __future__ import annotations

import numpy as np

#: Bytes of all keywords together, which bound the table of transitions; bytes of a piece of text.
MOST_BYTES, PIECE = 200_000, 1_024


class Automaton:
    def __init__(self, keywords: list[str]):
        """Empty keywords are found everywhere; keywords may be repeated."""
        words = [k.encode("utf-8", "surrogatepass") for k in keywords]
        if sum(map(len, words)) > MOST_BYTES:
            raise ValueError(f"keywords of over {MOST_BYTES} bytes")
        self.longest = max(map(len, words), default=0)
        used = sorted({b for w in words for b in w})
        #: Bytes that no keyword has are class 0.
        self.classes = np.zeros(256, dtype=np.uint8 if len(used) < 255 else np.uint16)
        for i, b in enumerate(used):
            self.classes[b] = i + 1
        self.wide = len(used) + 1
        children: list[dict[int, int]] = [{}]
        self.ids: dict[int, list[int]] = {}
        levels: list[list[tuple[int, int, int]]] = []
        for number, word in enumerate(words):
            state = 0
            for depth, b in enumerate(word):
                c = int(self.classes[b])
                to = children[state].get(c)
                if to is None:
                    to = children[state][c] = len(children)
                    children.append({})
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((state, c, to))
                state = to
            self.ids.setdefault(state, []).append(number)
        # level by level, as a failure link leads to a shorter beginning
        self.next = np.zeros((len(children), self.wide), dtype=np.int32)
        fail = np.zeros(len(children), dtype=np.int32)
        #: The nearest state, by failure links, that ends a keyword; itself if it does. 0: none.
        self.ends = np.zeros(len(children), dtype=np.int32)
        self.beyond = np.zeros(len(children), dtype=np.int32)
        for depth, level in enumerate(levels):
            parent, c, to = np.array(level, dtype=np.int32).T
            if depth:
                fail[to] = self.next[fail[parent], c]
            final = np.array([int(t) in self.ids for t in to])
            self.beyond[to] = self.ends[fail[to]]
            self.ends[to] = np.where(final, to, self.beyond[to])
            self.next[parent, c] = to
            self.next[to] = self.next[fail[to]]

    def found(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, keyword) of all keywords in texts, each pair once, in order."""
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        rows, states = [], []
        over = max(self.longest - 1, 0)
        pieces = [(i, a) for i, d in enumerate(data) for a in range(0, len(d), PIECE)]
        step = max(1, (16 << 20) // (PIECE + over))  # pieces side by side: 16 MB of bytes
        for k in range(0, len(pieces), step):
            part = pieces[k : k + step]
            side = np.zeros((len(part), PIECE + over), dtype=self.classes.dtype)
            for j, (i, a) in enumerate(part):
                got = np.frombuffer(data[i], dtype=np.uint8)[max(0, a - over) : a + PIECE]
                side[j, : len(got)] = self.classes[got]
            side = np.ascontiguousarray(side.T)
            of = np.array([i for i, _ in part])
            state = np.zeros(len(part), dtype=np.int32)
            flat = self.next.reshape(-1)
            for column in side:
                state = flat[state * np.int64(self.wide) + column]
                ends = self.ends[state]
                hit = np.flatnonzero(ends)
                if len(hit):
                    rows.append(of[hit])
                    states.append(ends[hit])
        pairs = set()
        if rows:
            each = np.unique(np.concatenate(rows) * np.int64(len(self.ends)) + np.concatenate(states))
            for row, state in zip((each // len(self.ends)).tolist(), (each % len(self.ends)).tolist()):
                while state:
                    pairs.update((row, k) for k in self.ids[state])
                    state = int(self.beyond[state])
        pairs.update((row, k) for k in self.ids.get(0, ()) for row in range(len(texts)))
        out = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]


#: An odd number whose powers weigh the bytes of a window, and bits of the filter that windows pass first.
BASE, FILTER_BITS = np.uint64(0x9E3779B97F4A7C15), 24


class Windows:
    """Keywords of any number: windows of each of their lengths are looked up by a hash and then compared, so that memory is the
    keywords' bytes and a few numbers each, where the automaton has a row of its table for each of their bytes."""

    def __init__(self, keywords: list[str]):
        words = [k.encode("utf-8", "surrogatepass") for k in keywords]
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
        #: By length: hashes in order, the keywords' bytes, and a filter that windows pass first.
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: Equal keywords are one. Its number is `first` of its length and its place there; its keywords are numbers[starts[i] : starts[i + 1]].
        self.first: dict[int, int] = {}
        self.empty, at = False, 0
        numbers, sizes = [], []
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own, n = order[x:y], int(length[order[x]])
            self.empty |= n == 0
            data = np.frombuffer(b"".join(words[i] for i in own.tolist()), dtype=np.uint8).reshape(len(own), n)
            h = (data * _powers(n)).sum(axis=1, dtype=np.uint64)
            by = np.lexsort((own, data.view(f"S{n}").ravel(), h)) if n else np.arange(len(own))
            h, data, own = h[by], data[by], own[by]
            new = np.append(True, (h[1:] != h[:-1]) | (data[1:] != data[:-1]).any(axis=1))
            begin = np.flatnonzero(new)
            numbers.append(own)
            sizes.append(np.diff(np.append(begin, len(own))))
            self.first[n], at = at, at + len(begin)
            passes = np.zeros(1 << FILTER_BITS, dtype=bool)
            passes[h >> np.uint64(64 - FILTER_BITS)] = True
            self.lengths[n] = (h[begin], data[begin], np.packbits(passes, bitorder="little"))
        self.numbers = np.concatenate(numbers).astype(np.int32) if numbers else np.zeros(0, dtype=np.int32)
        self.starts = np.concatenate([np.zeros(1, dtype=np.int64), *map(np.cumsum, [np.concatenate(sizes)] if sizes else [])])

    def found(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As Automaton.found."""
        each = [self.one(t) for t in texts]
        return np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate([np.zeros(0, dtype=np.int64), *each])

    def one(self, text: str | None) -> np.ndarray:
        """The keywords in a text, each once, in order."""
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        hits = [np.full(int(self.empty), self.first.get(0, 0))]
        for a in range(0, len(data), LONG):
            hits += self._hits(data, a)
        hit = np.unique(np.concatenate(hits))
        n = self.starts[hit + 1] - self.starts[hit]
        return np.sort(self.numbers[np.repeat(self.starts[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64))

    def _hits(self, data: np.ndarray, begin: int) -> list[np.ndarray]:
        """Numbers of keywords that begin among the LONG bytes of data from begin on."""
        part = data[begin : begin + LONG + max(self.lengths, default=1) - 1]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part * _powers(len(part)), dtype=np.uint64)])
        back = _powers(len(part), INVERSE)
        hits = []
        for n, (known, words, passes) in self.lengths.items():
            if n > len(part):
                break
            if not n:
                continue
            h = (sums[n:] - sums[:-n]) * back[: len(sums) - n]
            bit = h >> np.uint64(64 - FILTER_BITS)
            at = np.flatnonzero(passes[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            windows = np.lib.stride_tricks.sliding_window_view(part, n)
            i = np.searchsorted(known, h[at])
            while len(at):  # keywords of one hash stand side by side
                same = (i < len(known)) & (known[np.minimum(i, len(known) - 1)] == h[at])
                at, i = at[same], i[same]
                hits.append(np.unique(i[(words[i] == windows[at]).all(axis=1)]) + self.first[n])
                i = i + 1
        return hits


#: Bytes of a text that are hashed at once.
LONG = 1 << 20
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


_made: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """The first n powers of base, modulo 2 ** 64."""
    if int(base) not in _made or len(_made[int(base)]) < n:
        _made[int(base)] = _cumulated(2 * n, base)
    return _made[int(base)][:n]


def _cumulated(n: int, base: np.uint64) -> np.ndarray:
    return np.concatenate([np.ones(min(n, 1), dtype=np.uint64), np.cumprod(np.full(max(n - 1, 0), base, dtype=np.uint64), dtype=np.uint64)])
