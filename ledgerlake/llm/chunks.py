"""Texts to ids through chunks: a text is cut where matches of the public pattern
surely end, and the ids of a chunk are remembered with its bytes."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from .wordhash import mixed

STORE_BITS = 21
#: ASCII letters 1, ASCII punctuation 2, the rest 0.
KINDS = np.array([1 if chr(c).isalpha() and c < 128 else 2 if 32 < c < 127 and not chr(c).isalnum() else 0 for c in range(256)], dtype=np.uint8)


#: Chunks of so many bytes are remembered, as so many 64-bit numbers and a length.
SHORT = 32
PARTS = SHORT // 8
LOW_BYTES = np.array([(1 << 8 * k) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], dtype=np.uint64)


def short_chunks(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first SHORT bytes of each chunk, zeros behind its end, as PARTS numbers."""
    padded = np.zeros(len(b) + SHORT, dtype=np.uint8)
    padded[: len(b)] = b
    at_any = np.ndarray((len(b) + SHORT - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
    out = np.empty((len(starts), PARTS), dtype=np.uint64)
    for k in range(PARTS):
        out[:, k] = at_any[np.minimum(starts + 8 * k, len(b))] & LOW_BYTES[np.clip(sizes - 8 * k, 0, 8)]
    return out


def chunk_hashes(parts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Never 0, which marks a free slot."""
    h = sizes.astype(np.uint64)
    for k in range(PARTS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    h[h == 0] = 1
    return h


class ChunkStore:
    """Ids of chunks by their bytes: an open hash table of a fixed size, probed
    for many chunks at once, and the ids one after another.  Entries without a
    slot hold what is used once."""

    def __init__(self, bits: int = STORE_BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.entry = np.zeros(1 << bits, dtype=np.int32)
        self.kept: tuple | None = None
        self.clear()

    def keep(self) -> None:
        """What the store holds now stays when it is cleared."""
        self.kept = (self.keys.copy(), self.entry.copy(), self.n, self.used, *(x.copy() for x in (self.at, self.length, self.parts, self.size, self.ids)))

    def clear(self) -> None:
        if self.kept:
            keys, entry, self.n, self.used, *rest = self.kept
            self.keys[:], self.entry[:] = keys, entry
            self.at, self.length, self.parts, self.size, self.ids = (x.copy() for x in rest)
            return
        self.keys[:] = 0
        self.n = self.used = 0
        self.at, self.length = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.parts, self.size = np.zeros((1024, PARTS), dtype=np.uint64), np.zeros(1024, dtype=np.int64)
        self.ids = np.zeros(4096, dtype=np.uint32)

    def full(self, more: int) -> bool:
        return 2 * (self.n + more) > len(self.keys) or self.used > 8 * len(self.keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 if there is none."""
        out = np.full(len(h), -1, dtype=np.int64)
        rows, slot = np.arange(len(h)), h & self.mask
        while len(rows):
            held = self.keys[slot]
            same = held == h[rows]
            out[rows[same]] = self.entry[slot[same]]
            on = ~same & (held != 0)
            rows, slot = rows[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def holds(self, entry: np.ndarray, parts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the entries are of these chunks, byte for byte."""
        return (self.size[entry] == sizes) & (self.parts[entry] == parts).all(axis=1)

    def append(self, ids: list[list[int]], parts: np.ndarray | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
        """New entries with their ids."""
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(length.sum()))
        grow = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), dtype=x.dtype)])
        n, used = self.n + len(ids), self.used + len(flat)
        self.at, self.length, self.ids = grow(self.at, n), grow(self.length, n), grow(self.ids, used)
        self.parts, self.size = grow(self.parts, n), grow(self.size, n)
        self.at[self.n : n] = self.used + np.cumsum(length) - length
        self.length[self.n : n] = length
        self.ids[self.used : used] = flat
        if parts is not None:
            self.parts[self.n : n], self.size[self.n : n] = parts, sizes
        made = np.arange(self.n, n)
        self.n, self.used = n, used
        return made

    def add(self, h: np.ndarray, parts: np.ndarray, sizes: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Entries for new hashes, each once, that are found from now on."""
        made = self.append(ids, parts, sizes)
        rows, slot = np.arange(len(h)), h & self.mask
        while len(rows):
            free = np.flatnonzero(self.keys[slot] == 0)
            placed = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[placed]] = h[rows[placed]]
            self.entry[slot[placed]] = made[rows[placed]]
            on = np.ones(len(rows), dtype=bool)
            on[placed] = False
            moved = self.keys[slot] != h[rows]  # not the ones just placed
            rows, slot = rows[on], np.where(moved, (slot + np.uint64(1)) & self.mask, slot)[on]
        return made


class ChunkEncoder:
    """Whole texts to ids, with a bounded memory of chunks.

    Texts are cut before single spaces (and as cuts() says).  With the public
    pattern a space always starts a match and never ends one, unless white space
    meets white space there; texts with two spaces in a row or a space at their
    end are therefore cut by the pattern itself.  Chunks go through the store in
    slices of at most half its slots, so that it holds any slice however many
    distinct chunks a text has.  Longer chunks than SHORT bytes, and those whose hash
    another chunk has, are encoded by themselves, so no id rests on a hash alone.
    """

    def __init__(self, pattern: str, bits: int = STORE_BITS):
        self.split = regex.compile(pattern).findall
        self.store = ChunkStore(bits)

    def fresh(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks that are not known yet."""
        raise NotImplementedError

    def chunks_of(self, texts: pa.Array) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of the texts, the same as an array, where chunks start, their numbers by text)."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = memoryview(raw)[offsets[0] : offsets[-1]] if raw else memoryview(b"")
        begin = offsets[:-1] - offsets[0]
        size = np.diff(offsets)
        b = np.frombuffer(data, dtype=np.uint8)
        cut, slow = self.cuts(b, begin, size)
        for k in slow:
            text = bytes(data[begin[k] : begin[k] + size[k]]).decode("utf-8", "surrogatepass")
            own = np.cumsum([0, *(len(w.encode("utf-8", "surrogatepass")) for w in self.split(text))])[:-1]
            cut[begin[k] : begin[k] + size[k]] = False
            cut[begin[k] + own] = True
        for k in self.uncut(bytes(data), begin, size):
            cut[begin[k] : begin[k] + size[k]] = False
            cut[begin[k]] = True
        starts = np.flatnonzero(cut)
        n_chunks = np.diff(np.searchsorted(starts, np.append(begin, len(b))))
        return data, b, starts, n_chunks

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id if one is given, numbers of ids
        by text)."""
        data, b, starts, n_chunks = self.chunks_of(texts)
        lengths, listed = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
        most = len(self.store.keys) // 2
        for k in range(0, len(starts), most):
            entry = self.known(data, b, starts[k : k + most], int(starts[k + most]) if k + most < len(starts) else len(b))
            n = self.store.length[entry]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            lengths.append(n)
            listed.append(self.store.ids[np.repeat(self.store.at[entry], n) + step])
        length = np.concatenate(lengths)
        doc = np.repeat(np.arange(len(texts)), n_chunks)
        sizes = np.bincount(doc, weights=length, minlength=len(texts)).astype(np.int64) + (end_id is not None)
        if end_id is None:
            return np.concatenate(listed), sizes
        out = np.full(int(sizes.sum()), end_id, dtype=np.uint32)
        out[np.arange(int(length.sum())) + np.repeat(doc, length)] = np.concatenate(listed)
        return out, sizes

    def uncut(self, data: bytes, begin: np.ndarray, size: np.ndarray) -> list[int]:
        """Texts that have to be encoded as one chunk."""
        return []

    @staticmethod
    def cuts(b: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where chunks start, and the texts that the pattern has to cut.

        Besides single spaces a match ends where an ASCII letter meets ASCII
        punctuation, before a line end that follows no white space, and after
        such a line end if a letter follows; what is left is encoded alone as it
        is in its text."""
        kind = KINDS[b]
        cut = b == 32
        cut[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
        line = np.zeros(len(b), dtype=bool)
        line[1:] = (b[1:] == 10) & (b[:-1] > 32)
        cut |= line
        cut[1:] |= line[:-1] & (kind[1:] == 1)
        cut[begin[size > 0]] = True
        two = np.flatnonzero((b[1:] == 32) & (b[:-1] == 32))
        odd = np.unique(np.searchsorted(begin, two, side="right") - 1)
        filled = np.flatnonzero(size > 0)
        ends = filled[b[begin[filled] + size[filled] - 1] == 32]
        return cut, np.union1d(odd[size[odd] > 0], ends).astype(np.int64)

    def known(self, data: memoryview, b: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
        """The store's entry of every chunk, the last one up to end; new chunks are
        encoded."""
        store, low = self.store, int(starts[0])
        ends = np.append(starts[1:], end)
        sizes = ends - starts
        parts = short_chunks(b[low:end], starts - low, sizes)
        h = chunk_hashes(parts, sizes)
        entry = np.where(sizes <= SHORT, store.find(h), -1)
        if store.full(int((entry < 0).sum())):
            store.clear()
            entry = np.where(sizes <= SHORT, store.find(h), -1)
        alone = sizes > SHORT
        hit = np.flatnonzero(entry >= 0)
        alone[hit] |= ~store.holds(entry[hit], parts[hit], sizes[hit])
        text = lambda r: str(data[starts[r] : ends[r]], "utf-8", "surrogatepass")
        new = np.flatnonzero((entry < 0) & ~alone)
        if len(new):
            fresh, first, same = np.unique(h[new], return_index=True, return_inverse=True)
            first = new[first]
            made = store.add(fresh, parts[first], sizes[first], self.fresh([text(r) for r in first]))
            entry[new] = made[same]
            alone[new] = ~store.holds(entry[new], parts[new], sizes[new])
        rows = np.flatnonzero(alone)
        if len(rows):
            listed: dict[str, int] = {}
            place = [listed.setdefault(text(r), len(listed)) for r in rows]
            entry[rows] = store.append(self.fresh(list(listed)))[place]
        return entry
