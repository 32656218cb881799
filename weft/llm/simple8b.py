"""Simple-8b: whole 64-bit words, each with a selector and as many ids as its selector says.

A file has a head, blocks of BLOCK ids (the last may have fewer) and a foot:

    head    8 bytes MAGIC
    words   64-bit, little-endian: 4 bits of selector at the top, 60 bits of ids, the first lowest
    escapes 64-bit values of 2**60 or more, which selector 0 words hold by their place here
    blocks  64-bit word number at which each block begins, so that any run of blocks can be decoded at once
    docs    64-bit doc_id, 64-bit number of ids, one byte 1 if the doc_id is null, for each document in turn
    foot    counts of words, escapes, blocks, docs and ids, 64-bit each, then MAGIC

Every word is decoded by itself, so decoding needs no loop over words.
"""

from __future__ import annotations

from array import array

import numpy as np

MAGIC, BLOCK = b"WEFTS8B1", 1024
#: For selectors 1 to 15, how many ids a word has and the bits of each. Selector 0 is an escape.
PLACES = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60), (240, 0)]
COUNT = np.array([1] + [n for n, _ in PLACES])


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids (unsigned 32- or 64-bit) as words, escapes, and the word number of each block."""
    n = len(ids)
    if not n:
        return np.empty(0, "<u8"), np.empty(0, "<u8"), np.empty(0, np.int64)
    ends = np.minimum((np.arange(n) // BLOCK + 1) * BLOCK, n)
    best, top = np.zeros(n, np.int8), int(ids.max())
    # From the fullest selector up: positions from which all of its ids, or all to the block's end, are small enough.
    for selector in sorted(range(1, 16), key=lambda s: PLACES[s - 1][0]):
        count, bits = PLACES[selector - 1]
        if top >> bits == 0:
            best[:] = selector
            continue
        large = ids >= ids.dtype.type(1 << bits)
        at = np.flatnonzero(~large)
        if len(at):
            over = np.cumsum(large, dtype=np.int32)
            best[at[over[np.minimum(at + count, ends[at]) - 1] == over[at]]] = selector
    # All blocks step through their words together.
    at, stop, starts, blocks = np.arange(0, n, BLOCK), ends[::BLOCK], [], []
    number = np.arange(len(at))
    while len(at):
        starts.append(at)
        blocks.append(number)
        at = at + COUNT[best[at]]
        live = at < stop
        at, stop, number = at[live], stop[live], number[live]
    first = np.sort(np.concatenate(starts))
    words, chosen = np.zeros(len(first), "<u8"), best[first]
    room = np.concatenate([ids, np.zeros(240, ids.dtype)])
    for selector in np.unique(chosen).tolist():
        here = np.flatnonzero(chosen == selector)
        if selector == 0:
            continue
        count, bits = PLACES[selector - 1]
        w = np.full(len(here), selector << 60, np.uint64)
        for k in range(count if bits else 0):
            x = room[first[here] + k]
            x = np.where(first[here] + k < ends[first[here]], x, np.uint64(0))
            w |= x.astype(np.uint64) << np.uint64(k * bits)
        words[here] = w
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] = np.arange(len(escaped))
    return words, ids[first[escaped]].astype("<u8"), np.searchsorted(first, np.arange(0, n, BLOCK))


def decode(words: np.ndarray, escapes: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """The n ids of whole blocks; blocks: the number of each block's first word, from 0."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNT[selector]
    at = np.cumsum(count) - count
    of = np.searchsorted(blocks, np.arange(len(words)), side="right") - 1
    at += of * BLOCK - at[blocks][of]  # a block's last word may have room to spare
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector).tolist():
        here = np.flatnonzero(selector == s)
        if s == 0:
            out[at[here]] = escapes[words[here].astype(np.int64)]
            continue
        many, bits = PLACES[s - 1]
        low, stop = np.uint64((1 << bits) - 1), np.minimum((of[here] + 1) * BLOCK, n)
        for k in range(many if bits else 0):
            live = at[here] + k < stop
            out[at[here[live]] + k] = (words[here[live]] >> np.uint64(k * bits)) & low
    return out


class Writer:
    """Writes documents' ids to an open file, a run of whole blocks at a time."""

    RUN = 512 * BLOCK

    def __init__(self, file):
        self.file, self.held, self.n_held = file, [], 0
        self.words = self.ids = 0
        self.escapes, self.blocks = [], []
        self.doc_ids, self.many, self.null = array("q"), array("q"), bytearray()  # 17 bytes a document
        file.write(MAGIC)

    @property
    def docs(self) -> int:
        return len(self.null)

    def add(self, doc_ids: np.ndarray, null: np.ndarray, many: np.ndarray, ids: np.ndarray) -> None:
        """doc_ids and which are null, and how many of ids are each one's."""
        self.doc_ids.frombytes(np.where(null, 0, doc_ids).astype("<i8").tobytes())
        self.many.frombytes(many.astype("<i8").tobytes())
        self.null += null.astype("u1").tobytes()
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.RUN:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        words, escapes, blocks = encode(ids[:n])
        if len(escapes):
            here = np.flatnonzero(words >> np.uint64(60) == 0)
            words[here] += np.uint64(sum(map(len, self.escapes)))
        self.file.write(words.tobytes())
        self.escapes.append(escapes)
        self.blocks.append(blocks + self.words)
        self.words += len(words)
        self.ids += n
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.n_held)
        parts = [np.concatenate(self.escapes), np.concatenate(self.blocks)]
        parts += [np.frombuffer(x, k) for x, k in ((self.doc_ids, "<i8"), (self.many, "<i8"), (self.null, "u1"))]
        for p, kind in zip(parts, ("<u8", "<u8", "<i8", "<i8", "u1")):
            self.file.write(p.astype(kind).tobytes())
        self.file.write(np.array([self.words, len(parts[0]), len(parts[1]), self.docs, self.ids], "<u8").tobytes() + MAGIC)
        self.file.close()


class Reader:
    """Reads a file by runs of blocks."""

    def __init__(self, file):
        self.file, size = file, file.size()
        if file.read_at(8, 0) != MAGIC or file.read_at(8, size - 8) != MAGIC:
            raise ValueError("not a whole file of this format")
        self.n_words, n_escapes, n_blocks, n_docs, self.n_ids = np.frombuffer(file.read_at(40, size - 48), "<u8").astype(int).tolist()
        at = 8 + 8 * self.n_words
        self.escapes = np.frombuffer(file.read_at(8 * n_escapes, at), "<u8")
        at += 8 * n_escapes
        self.blocks = np.frombuffer(file.read_at(8 * n_blocks, at), "<u8").astype(np.int64)
        at += 8 * n_blocks
        docs = np.frombuffer(file.read_at(16 * n_docs, at), "<i8")
        self.doc_ids, self.many = docs[:n_docs], docs[n_docs:]
        self.null = np.frombuffer(file.read_at(n_docs, at + 16 * n_docs), "u1").astype(bool)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end of the file, from the blocks that hold them."""
        if begin >= end:
            return np.empty(0, np.uint64)
        a, b = begin // BLOCK, -(-end // BLOCK)
        w = int(self.blocks[a])
        stop = int(self.blocks[b]) if b < len(self.blocks) else self.n_words
        words = np.frombuffer(self.file.read_at(8 * (stop - w), 8 + 8 * w), "<u8")
        got = decode(words, self.escapes, self.blocks[a:b] - w, min(b * BLOCK, self.n_ids) - a * BLOCK)
        return got[begin - a * BLOCK : end - a * BLOCK]
