"""Token-id output: a context-mixing range coder over independently reset, checksummed blocks.

Documents in ascending order are dealt into shards by range, tokenized, and written as images:

    magic, version | documents, ids, block size, symbols | order, lengths, start of each document |
    order-0 table (symbols, counts) | for each block: ids, bytes, checksum | head's checksum | payloads

An id is predicted by what last followed the two ids before it (order 2), by what last followed
the one before it (order 1), and by the image's id counts (order 0, adapted once for each image
and stored in its head). How often a prediction of a given confidence was right is counted per
block and mixed with the counts for the last two outcomes; the mixture drives a carry-less range
coder with 64-bit state. Every block starts from empty predictions and ends with a flush, so that
blocks decode alone. All blocks of an image are coded in step, as lanes of numpy arrays; the
arithmetic is in integers throughout, so that both directions agree on any machine.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, shared_folder, temp_name, with_row_ids, write_table

MAGIC, VERSION = b"LWTK", 3
HEAD = struct.Struct("<4sHIQII")
SLOTS = 512
SCALE = 20
TOP, BOTTOM = np.uint64(48), np.uint64(1 << 48)
FIELD, MASK = np.uint64(20), np.uint64((1 << 20) - 1)
#: What an outcome adds to its count, in the field of its class: order 2 right, order 1 right, neither.
GAIN = np.uint64(24)
FRESH = np.uint64(1 | 1 << 20 | 2 << 40)
#: A factor that turns three fields into their running sums; a literal's share where there is none.
SUMS, ONE = np.uint64(1 | 1 << 20 | 1 << 40), np.uint64(1 << SCALE)
U = np.uint64


class DamagedBlock(ValueError):
    """A block whose ids don't have the checksum that was written with it."""


class Model:
    """The state of ``lanes`` blocks that are coded in step."""

    def __init__(self, lanes: int, counts: np.ndarray):
        """``counts``: scaled frequencies by id, that sum to 1 << SCALE."""
        freq = counts.astype(np.uint64)
        self.codes = np.cumsum(freq) - freq << U(32) | freq
        self.lanes = lanes
        self.one, self.two = np.zeros(lanes * SLOTS, np.int32), np.zeros(lanes * SLOTS, np.int32)
        self.by_sure, self.by_past = np.full(lanes * 32, FRESH), np.full(lanes * 9, FRESH)
        self.base = np.arange(lanes) * SLOTS
        self.row32, self.row9 = np.arange(lanes) * 32, np.arange(lanes) * 9
        # Slots depend on the low bits of ids alone.
        self.last, self.before = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16)
        self.past, self.kind = np.zeros(lanes, np.uint8), np.zeros(lanes, np.uint8)

    def shrink(self, lanes: int) -> None:
        for k in ("base", "row32", "row9", "last", "before", "past", "kind"):
            setattr(self, k, getattr(self, k)[:lanes])
        self.lanes = lanes

    def predict(self) -> None:
        spread = self.last * 40503
        self.at1 = self.base + (spread >> 4 & SLOTS - 1)
        self.at2 = self.base + (spread + self.before * 30011 >> 3 & SLOTS - 1)
        self.e1, self.e2 = self.one.take(self.at1), self.two.take(self.at2)
        self.p1, self.p2 = self.e1 >> 2, self.e2 >> 2
        self.q1, self.q2 = self.e1.astype(np.uint8) & 3, self.e2.astype(np.uint8) & 3
        self.sure = self.row32 + (self.q2 << 3 | self.q1 << 1 | (self.p1 == self.p2))
        self.hist = self.row9 + self.past
        self.of_sure, self.of_past = self.by_sure.take(self.sure), self.by_past.take(self.hist)
        self.mixed = self.of_sure + self.of_past
        self.sums = self.mixed * SUMS
        self.total = self.sums >> U(40 - SCALE) & MASK << U(SCALE)

    def fields(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first bit of an outcome's field, where it starts within ``total``, and its count."""
        at = kind * FIELD
        return at, (self.sums << FIELD >> at & MASK) << U(SCALE), self.mixed >> at & MASK

    def interval(self, x: np.ndarray, kind: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the outcome, a literal's ``x`` included, within ``total``."""
        share = self.codes.take(x)
        np.putmask(share, kind < 2, ONE)
        return start + n * (share >> U(32)), n * (share & U((1 << 32) - 1))

    def update(self, x: np.ndarray, kind: np.ndarray, at: np.ndarray, right1: np.ndarray, right2: np.ndarray) -> None:
        gain = GAIN << at
        self.by_sure[self.sure] = self.of_sure + gain
        self.by_past[self.hist] = self.of_past + gain
        self.past, self.kind = self.kind * 3 + kind, kind
        fresh = x << 2 | 1
        self.one[self.at1] = _learned(self.e1, self.q1, right1, fresh)
        self.two[self.at2] = _learned(self.e2, self.q2, right2, fresh)
        self.before, self.last = self.last, x.astype(np.uint16)


def _learned(entry: np.ndarray, sure: np.ndarray, right: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Entries that are surer by one where they were right, less sure where not, or else replaced."""
    ok = right.view(np.int8)
    out = entry + ((ok & (sure < 3).view(np.int8)) + ok - 1)
    np.putmask(out, ~right & (sure < 2), fresh)
    return out


def _narrowed(low: np.ndarray, width: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The top words of lanes ``at``, which are shifted out; an interval that a word's boundary cuts
    loses what lies beyond it."""
    bits, kept = low[at], width[at]
    kept = np.minimum(kept, BOTTOM - (bits & (BOTTOM - U(1)))) << U(16)
    low[at], width[at] = bits << U(16), kept
    return bits >> TOP


def encode_lanes(ids: np.ndarray, block: int, counts: np.ndarray) -> list[bytes]:
    """The payload of each block of ``block`` ids."""
    lanes = -(-len(ids) // block)
    model = Model(lanes, counts)
    table = np.zeros(lanes * block, np.int32)
    table[: len(ids)] = ids
    steps = np.ascontiguousarray(table.reshape(lanes, block).T)
    del table
    ends = np.full(lanes, block)
    ends[-1] = len(ids) - (lanes - 1) * block
    low, width, pos = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max), np.zeros(lanes, np.int64)
    out = np.zeros((lanes, block + 600), np.uint16)
    done: list[np.ndarray] = []
    for t in range(block):
        if t == ends[-1] and lanes > 1 and len(done) == 0:
            done.append(_flushed(out[-1], int(pos[-1]), low[-1]))
            model.shrink(lanes - 1)
            low, width, pos, out = low[:-1].copy(), width[:-1].copy(), pos[:-1].copy(), out[:-1]
        elif t == ends[-1]:
            break
        if t % 128 == 0 and pos.max() + 520 > out.shape[1]:
            out = np.concatenate([out, np.zeros((len(out), block // 2 + 600), np.uint16)], axis=1)
        x = steps[t, : model.lanes]
        model.predict()
        right1, right2 = model.p1 == x, model.p2 == x
        first = right2 & (model.q2 > 0)
        kind = 2 - (first | right1 & (model.q1 > 0)).view(np.uint8) - first.view(np.uint8)
        field, start, n = model.fields(kind)
        start, size = model.interval(x, kind, start, n)
        unit = width // model.total
        low += unit * start
        width = unit * size
        at = np.flatnonzero(width < BOTTOM)
        while len(at):
            spot = pos[at]
            out.reshape(-1)[at * out.shape[1] + spot] = _narrowed(low, width, at)
            pos[at] = spot + 1
            at = at[width[at] < BOTTOM]
        model.update(x, kind, field, right1, right2)
    for s in (48, 32, 16, 0):
        out[np.arange(len(low)), pos] = low >> U(s) & U(0xFFFF)
        pos += 1
    whole = [out[k, :n].astype("<u2", copy=False) for k, n in enumerate(pos.tolist())]
    return [w.tobytes() for w in whole + done]


def _flushed(words: np.ndarray, n: int, low: np.uint64) -> np.ndarray:
    tail = [int(low) >> s & 0xFFFF for s in (48, 32, 16, 0)]
    return np.concatenate([words[:n], np.array(tail, np.uint16)]).astype("<u2")


def decode_lanes(payloads: list[bytes], n_ids: int, block: int, counts: np.ndarray) -> np.ndarray:
    """The ids of blocks, ``block`` each but for the last."""
    lanes = len(payloads)
    model = Model(lanes, counts)
    lookup = np.repeat(np.arange(len(counts), dtype=np.uint16 if len(counts) <= 1 << 16 else np.int32), counts)
    sizes = np.array([len(p) // 2 for p in payloads])
    words = np.frombuffer(b"".join(payloads) + b"\0" * 16, "<u2")
    pos = np.cumsum(sizes) - sizes
    low, width, code = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max), np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << U(16) | words[pos]
        pos += 1
    out = np.zeros((block, lanes), np.int32)
    last = n_ids - (lanes - 1) * block
    for t in range(block):
        if t == last:
            if lanes == 1:
                break
            model.shrink(lanes - 1)
            low, width, code, pos = (v[: lanes - 1].copy() for v in (low, width, code, pos))
        model.predict()
        unit = width // model.total
        value = (code - low) // unit  # within the total, but in a damaged block
        part = value >> U(SCALE)
        kind = (part >= (model.mixed & MASK)).view(np.uint8) + (part >= (model.sums >> FIELD & MASK)).view(np.uint8)
        field, start, n = model.fields(kind)
        x = lookup.take(((value - start) // n).view(np.int64), mode="clip").astype(np.int32)
        np.putmask(x, kind == 0, model.p2)
        np.putmask(x, kind == 1, model.p1)
        start, size = model.interval(x, kind, start, n)
        low += unit * start
        width = unit * size
        at = np.flatnonzero(width < BOTTOM)
        while len(at):
            _narrowed(low, width, at)
            spot = pos[at]
            code[at] = code[at] << U(16) | words.take(spot, mode="clip")
            pos[at] = spot + 1
            at = at[width[at] < BOTTOM]
        out[t, : model.lanes] = x
        model.update(x, kind, field, model.p1 == x, model.p2 == x)
    return (out.T.reshape(-1)[:n_ids] if lanes > 1 else out[:n_ids, 0]).astype(np.int64)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts by id scaled to sum to 1 << SCALE, at least 1 where an id occurs."""
    seen = counts > 0
    room = (1 << SCALE) - int(seen.sum())
    out = np.where(seen, 1 + counts * room // max(1, int(counts.sum())), 0).astype(np.int64)
    out[int(np.argmax(out))] += (1 << SCALE) - int(out.sum())
    return out


def write_image(order: np.ndarray, lengths: np.ndarray, ids: np.ndarray, most: int = 512) -> bytes:
    """One image of whole documents; ``order`` and ``lengths`` are theirs, ``ids`` all their ids."""
    block = int(min(most, max(256, len(ids) >> 11)))
    table = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(table)
    n = table[symbols]
    payloads = encode_lanes(ids, block, scaled(table)) if len(ids) else []
    sums = [zlib.crc32(ids[k : k + block].astype("<u4").tobytes()) for k in range(0, len(ids), block)]
    sizes = [(min(block, len(ids) - k * block), len(p), c) for k, (p, c) in enumerate(zip(payloads, sums, strict=True))]
    parts = [
        HEAD.pack(MAGIC, VERSION, len(order), len(ids), block, len(symbols)),
        order.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(),
        symbols.astype("<u4").tobytes(), n.astype("<u4").tobytes(), np.array(sizes, "<u4").tobytes(),
    ]
    head = b"".join(parts)
    return b"".join([head, struct.pack("<I", zlib.crc32(head)), *payloads])


class Head:
    """What an image says before its payloads; raises DamagedBlock where its checksum differs."""

    def __init__(self, image: bytes):
        if len(image) < HEAD.size:
            raise DamagedBlock("head")
        magic, version, docs, self.n_ids, self.block, symbols = HEAD.unpack_from(image)
        if magic != MAGIC or version != VERSION:
            raise DamagedBlock(f"not an image of version {VERSION}")
        at = HEAD.size
        n_blocks = -(-self.n_ids // self.block)
        end = at + 12 * docs + 8 * symbols + 12 * n_blocks
        if len(image) < end + 4 or zlib.crc32(image[:end]) != struct.unpack_from("<I", image, end)[0]:
            raise DamagedBlock("head")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(image, kind, n, at)
            at += found.nbytes
            return found

        self.order, self.lengths = take("<i8", docs), take("<u4", docs)
        names, n = take("<u4", symbols), take("<u4", symbols)
        self.sizes, self.bytes, self.sums = take("<u4", 3 * n_blocks).reshape(-1, 3).T
        table = np.zeros(int(names[-1]) + 1 if len(names) else 1, np.int64)
        table[names] = n
        self.counts = scaled(table) if len(names) else table
        self.starts = end + 4 + np.cumsum(self.bytes, dtype=np.int64) - self.bytes

    def payload(self, image: bytes, k: int) -> bytes:
        return image[int(self.starts[k]) : int(self.starts[k]) + int(self.bytes[k])]

    def checked(self, k: int, ids: np.ndarray) -> np.ndarray:
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.sums[k]:
            raise DamagedBlock(f"block {k}")
        return ids


def read_block(image: bytes, k: int) -> np.ndarray:
    """The ids of one block, from the head and its own payload alone."""
    head = Head(image)
    return head.checked(k, decode_lanes([head.payload(image, k)], int(head.sizes[k]), head.block, head.counts))


def read_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """order, lengths and ids; raises DamagedBlock where a checksum differs."""
    head = Head(image)
    if not head.n_ids:
        return head.order, head.lengths, np.empty(0, np.int64)
    payloads = [head.payload(image, k) for k in range(len(head.sizes))]
    ids = decode_lanes(payloads, head.n_ids, head.block, head.counts)
    for k in range(len(head.sizes)):
        head.checked(k, ids[k * head.block : (k + 1) * head.block])
    return head.order, head.lengths, ids


ODD = re.compile("<\\||[\x1c-\x1f\x85\xa0  -     　]")
#: The characters that stand for bytes in the vocabulary; a line's end stays what it is.
PRINTED = np.full(256, 0, "<u4")
PRINTED[[*range(33, 127), *range(161, 173), *range(174, 256)]] = [*range(33, 127), *range(161, 173), *range(174, 256)]
PRINTED[PRINTED == 0] = np.arange(256, 256 + (PRINTED == 0).sum())
PRINTED[10] = 10
#: Bytes of ODD: those that say it all, and the first ones of blanks beyond ASCII.
SURELY, MAYBE = (b"<|", b"\x1c", b"\x1d", b"\x1e", b"\x1f"), (b"\xc2", b"\xe1", b"\xe2", b"\xe3")
#: Bytes of a piece that the table holds; longer pieces go by a dictionary.
SHORT = 23
#: Masks that leave the first 0 to 8 bytes of a word of 64 bits.
LEAVE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
TOKEN_ID = attrgetter("id")
STIR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def odd(text: str, body: bytes) -> bool:
    """Whether ODD is found in ``text``, of which ``body`` are the bytes."""
    return any(x in body for x in SURELY) or any(x in body for x in MAYBE) and ODD.search(text) is not None


def letters(raw: np.ndarray) -> np.ndarray:
    """Where a letter of ASCII is."""
    return (raw | 32) - 97 < 26


def words_of_letters(pieces: list[bytes]) -> np.ndarray:
    """Which pieces the pre-tokenizer leaves whole: a space or none, and letters of ASCII or Latin-1."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    start = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(pieces) + b"\0", np.uint8)
    # The second byte of a letter of Latin-1, after 0xC3; 0x97 and 0xB7 are signs.
    second = (raw[1:] >> 6 == 2) & (raw[1:] != 0x97) & (raw[1:] != 0xB7) & (raw[:-1] == 0xC3)
    fine = letters(raw)
    fine[:-1] |= second
    fine[1:] |= second
    lead = start[size > 1]
    fine[lead] |= raw[lead] == 32
    return np.logical_and.reduceat(fine, start)


class Encoder:
    """A tokenizer that remembers pieces.

    Its pre-tokenizer never joins what stands on the two sides of certain places: the start of a
    run of blanks, the last blank before a word, unless that is a space the word itself, and an
    ASCII mark after a letter of ASCII or Latin-1.
    Texts are cut there, at whole arrays of bytes at once, and each piece's ids are looked up by
    its bytes, which the table compares whole. Texts with blanks beyond ASCII, or with anything
    like a special token, are encoded whole. A new piece that is a word of letters goes to the
    tokenizer's model right away, since its pre-tokenizer would leave it as it is. The table has a fixed size and is emptied when three
    quarters full.
    """

    held: dict[str, Encoder] = {}

    def __init__(self, path: str, bits: int = 20):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tool, self.bits = Tokenizer.from_file(path), bits
        self.model = self.tool.model
        self.clear()

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def clear(self) -> None:
        #: A row for each slot: three words of a piece's bytes with its size on top, and where its ids are.
        self.table = np.zeros((1 << self.bits, 4), np.uint64)
        self.store, self.stored, self.used = np.zeros(1 << 16, np.uint32), 0, 0
        self.long: dict[bytes, int] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        out = [b""] * len(texts)
        easy = []
        bodies = []
        for k, t in enumerate(texts):
            body = t.encode() if t else b""
            if t and odd(t, body):
                out[k] = self.whole(t)
            elif t:
                easy.append(k)
                bodies.append(body)
        if easy:
            for k, ids in zip(easy, self._pieces(bodies), strict=True):
                out[k] = ids
        return out

    def _pieces(self, bodies: list[bytes]) -> list[bytes]:
        joined = b"\0" + b"\0".join(bodies) + b"\0" + bytes(SHORT + 1)
        raw = np.frombuffer(joined, np.uint8)[: -SHORT - 1]
        mark = np.cumsum([0, *[len(b) + 1 for b in bodies]])  # between texts; not part of any
        blank = (raw == 32) | (raw - 9 < 5)
        letter = letters(raw)
        start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = ~blank[:-1] & blank[1:]
        cut[start[raw[start - 1] != 32]] = True
        mark_here = ((raw - 33 < 94) & ~letter & ~(raw - 48 < 10))[1:]
        cut[1:-1] |= letter[:-1] & mark_here
        # Two bytes of which the first is 0xC3 are a letter too, but for the signs of times and division.
        cut[2:-1] |= (raw[:-2] == 0xC3) & (raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7) & mark_here[1:]
        ends_text = np.zeros(len(raw), bool)
        ends_text[mark] = True
        cut[start[~ends_text[start]] - 1] = True
        cut[mark] = cut[mark + 1] = True
        cuts = np.flatnonzero(cut)
        at, size = cuts[:-1], np.diff(cuts)
        of_mark = np.searchsorted(at, mark)
        size[of_mark] = 0
        where, many = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        words = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
        parts = []
        for a in range(0, len(at), 1 << min(17, self.bits - 2)):
            some = slice(a, a + (1 << min(17, self.bits - 2)))
            where, many[some] = self._found(joined, words, at[some], size[some])
            ends = np.cumsum(many[some])
            parts.append(self.store[np.arange(ends[-1]) + np.repeat(where - ends + many[some], many[some])])
        ids = np.concatenate(parts).astype("<u4", copy=False)
        edge = np.cumsum(many)[of_mark].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def _found(self, joined: bytes, words: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece are, and how many; what is new is learned first."""
        keys = np.zeros((len(at), 3), np.uint64)
        keys[:, 0] = words[at] & LEAVE.take(np.minimum(size, 8))
        for k in (1, 2):
            on = np.flatnonzero(size > 8 * k)
            keys[on, k] = words[at[on] + 8 * k] & LEAVE.take(np.minimum(size[on] - 8 * k, 9 - k))
        keys[:, 2] |= np.minimum(size, SHORT + 1).astype(np.uint64) << U(56)
        short = np.flatnonzero((size > 0) & (size <= SHORT))
        far = np.flatnonzero(size > SHORT).tolist()
        place = np.zeros(len(at), np.uint64)
        place[short], missing = self._look_up(keys[short])
        new = short[missing]
        pieces = {joined[at[k] : at[k] + size[k]] for k in far}
        while len(new) or not pieces <= self.long.keys():
            # One of each hash; what shares another piece's comes in the next turn.
            first = new[np.unique(self._hashes(keys[new]), return_index=True)[1]]
            if self.used + len(first) + len(self.long) + len(pieces) > 3 << (self.bits - 2) and self.used:
                self.clear()
                return self._found(joined, words, at, size)
            fresh = [p for p in pieces if p not in self.long]
            spans = zip(at[first].tolist(), (at + size)[first].tolist(), strict=True)
            ids = self._learned([joined[a:b] for a, b in spans] + fresh)
            self._put(keys[first], ids[: len(first)])
            self.long.update(zip(fresh, ids[len(first) :].tolist(), strict=True))
            place[new], missing = self._look_up(keys[new])
            new = new[missing]
        for k in far:
            place[k] = self.long[joined[at[k] : at[k] + size[k]]]
        return (place >> U(32)).astype(np.int64), (place & U((1 << 32) - 1)).astype(np.int64)

    @staticmethod
    def _hashes(keys: np.ndarray) -> np.ndarray:
        h = (keys[:, 0] + STIR[2]) * STIR[0] ^ (keys[:, 1] + STIR[1]) * STIR[2] ^ keys[:, 2] * STIR[1]
        return (h ^ h >> U(29)) * STIR[0]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (self._hashes(keys) >> U(64 - self.bits)).astype(np.int64)

    def _look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last column of each key's row, and which keys have none."""
        slot, last = self._slots(keys), len(self.table) - 1
        rows = self.table.take(slot, axis=0)
        place, missing = rows[:, 3], []
        rest = np.flatnonzero((rows[:, 0] != keys[:, 0]) | (rows[:, 1] != keys[:, 1]) | (rows[:, 2] != keys[:, 2]))
        while len(rest):
            held = self.table[slot[rest], 2] > 0
            missing.append(rest[~held])
            rest = rest[held]
            slot[rest] = slot[rest] + 1 & last
            rows = self.table.take(slot[rest], axis=0)
            same = (rows[:, :3] == keys[rest]).all(1)
            place[rest[same]] = rows[same, 3]
            rest = rest[~same]
        return place, np.concatenate(missing) if missing else rest

    def _put(self, keys: np.ndarray, places: np.ndarray) -> None:
        slot, last = self._slots(keys), len(self.table) - 1
        left = np.arange(len(keys))
        while len(left):
            free = left[self.table[slot[left], 2] == 0]
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.table[slot[won], :3], self.table[slot[won], 3] = keys[won], places[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            left = left[lost[left]]
            slot[left] = slot[left] + 1 & last
        self.used += len(keys)

    def _learned(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes pieces; where their ids now are, above 32 bits, and how many."""
        sizes, parts = np.zeros(len(pieces), np.int64), [np.empty(0, np.uint32)]
        plain = words_of_letters(pieces) if pieces else np.empty(0, bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        words, rest = int(plain.sum()), order[int(plain.sum()) :].tolist()
        for k in range(0, words, 1024):
            some = order[k : min(k + 1024, words)]
            raw = np.frombuffer(b"\n".join([pieces[i] for i in some.tolist()]), np.uint8)
            found = list(map(self.model.tokenize, PRINTED[raw].tobytes().decode("utf-32-le").split("\n")))
            sizes[some] = np.fromiter(map(len, found), np.int64, len(found))
            parts.append(np.fromiter(map(TOKEN_ID, chain.from_iterable(found)), np.uint32, int(sizes[some].sum())))
        for k in range(0, len(rest), 2048):
            some = rest[k : k + 2048]
            found = [e.ids for e in self.tool.encode_batch_fast([pieces[i].decode() for i in some], add_special_tokens=False)]
            sizes[some] = list(map(len, found))
            parts.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes[some].sum())))
        flat = np.concatenate(parts)
        while self.stored + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.stored : self.stored + len(flat)] = flat
        at = np.empty(len(pieces), np.int64)
        at[order] = self.stored + np.cumsum(sizes[order]) - sizes[order]
        self.stored += len(flat)
        return at.astype(np.uint64) << U(32) | sizes.astype(np.uint64)


def groups(texts: list, most: int = 1 << 20):
    """Neighbours of up to ``most`` characters, or one text."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if k > start and size + len(t or "") > most:
            yield texts[start:k]
            start, size = k, 0
        size += len(t or "")
    yield texts[start:]


def images(rows: DataFrame, path: str, end_id: int, text: str, shards: int, part_ids: int) -> DataFrame:
    """(shard, part, n_ids, image): ``rows`` (_rid and text) in ranges of _rid."""

    def run(batches):
        tool = Encoder.at(path)
        shard, part, order, lengths, held = TaskContext.get().partitionId(), 0, [], [], []
        size, end = 0, np.array([end_id], "<u4").tobytes()

        def made():
            body = write_image(np.array(order, np.int64), np.array(lengths, np.int64), np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([size], pa.int64()), pa.array([body], pa.binary())], names=["shard", "part", "n_ids", "image"])

        for b in batches:
            for k in range(0, b.num_rows, 64):
                some = b.slice(k, 64)
                encoded = chain.from_iterable(tool.encode(g) for g in groups(some.column(1).to_pylist()))
                for rid, ids in zip(some.column(0).to_pylist(), encoded, strict=True):
                    found = ids + end
                    order.append(rid)
                    lengths.append(len(found) // 4)
                    held.append(found)
                    size += lengths[-1]
                    if size >= part_ids:
                        yield made()
                        part, order, lengths, held, size = part + 1, [], [], [], 0
        if order:
            yield made()

    dealt = rows.select("_rid", text).repartitionByRange(shards, "_rid").sortWithinPartitions("_rid")
    return dealt.mapInArrow(run, "shard int, part int, n_ids long, image binary")


def read_documents(written: DataFrame) -> DataFrame:
    """(_rid, start, n_tokens, ids_crc32) of every document, from images."""

    def run(batches):
        for b in batches:
            for shard, part, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                image = held.as_py()
                order, lengths, ids = read_image(image)
                ends = np.cumsum(lengths, dtype=np.int64)
                body = ids.astype("<u4").tobytes()
                sums = [zlib.crc32(body[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(order)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(order), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())], names=["shard", "part", "_rid", "_at", "n_tokens", "ids_crc32"])

    read = written.select("shard", "part", "image").mapInArrow(run, "shard int, part int, _rid long, _at long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each image, so that a single task can sum them.
    starts = written.select(F.col("shard").alias("_s"), F.col("part").alias("_p"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_start"))
    joined = read.join(starts, (F.col("shard") == F.col("_s")) & (F.col("part") == F.col("_p")))
    return joined.select("_rid", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(rows: DataFrame, path: str, out_dir: str | None = None, end_id: int = 0, text: str = "text", shard_bytes: int = 32 << 20, part_ids: int = 1 << 20) -> DataFrame:
    """Write ``rows`` (_rid, unique and ascending, and text) as images; what they hold, read back.

    A null or empty text is the end id alone. Images go to ``out_dir`` (by default a folder beside
    the checkpoints, which all executors share) as the binary column of a table, so that writing
    is committed as a whole and survives lost executors. An empty table writes no image.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).alias("b")).first()["b"] or 0
    out_dir = out_dir or f"{shared_folder(spark)}/{temp_name('tokens')}"
    write_table(images(rows, path, end_id, text, max(1, -(-size // shard_bytes)), part_ids), out_dir)
    return read_documents(spark.read.schema("shard int, part int, n_ids long, image binary").parquet(out_dir))


def in_file_order(docs: DataFrame) -> DataFrame:
    """``docs`` with _rid, which ascends in the order of their files' parts and of the rows in them.

    A frame that isn't read from files is taken in the order of doc_id.
    """
    files = sorted({f.rsplit("/", 1)[-1] for f in docs.inputFiles()}, key=lambda f: (int(m[1]) if (m := re.match(r"part-(\d+)", f)) else -1, f))
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return with_row_ids(docs, docs.columns)
    numbers = docs.sparkSession.createDataFrame([(f, n) for n, f in enumerate(files)], "_name string, _number long")
    joined = placed.join(F.broadcast(numbers), F.url_decode("_file") == F.url_decode("_name"))
    return joined.withColumn("_rid", F.shiftleft("_number", 40) + F.col("_row")).drop("_file", "_row", "_name", "_number")


def output_of(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for ``rows`` (doc_id, text, _rid) in the order of _rid."""
    read = token_output(rows.select("_rid", "text"), path)
    ids = rows.select("doc_id", F.col("_rid").alias("_r"))
    return ids.join(read, F.col("_r") == F.col("_rid")).select("doc_id", "start", "n_tokens", "ids_crc32")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_context_mixing_tokens(spark, sf_dir: str) -> DataFrame:
    return output_of(with_row_ids(documents(spark, sf_dir), ["doc_id", "text"]), default_path())
