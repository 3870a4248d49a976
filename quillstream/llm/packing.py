"""Best-fit packing with swap-based local search."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, table, texts
from .wordhash import Hasher


#: Runs that the faster encoder's pattern, which recurses, can't take.
_LONG = re.compile(r"\s{512}|\S{65536}")


class Encoder:
    """Token ids of a byte-level BPE file, for many texts at once.

    The BPE never crosses the border in front of a space that follows a visible character, so texts
    are cut there. Each piece's bytes are hashed with array operations and looked up in an open
    hash table of pieces whose ids are known; only unknown ones meet the tokenizer, in one call. A
    text with a piece that touches further white space goes through the tokenizer as a whole. The
    table is emptied when ``most`` pieces are known, which bounds it whatever the corpus has. Two
    different pieces are taken for one another with a chance of 2^-64.
    """

    def __init__(self, file: str, most: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.tok, self.most, self.hash = Tokenizer.from_file(file), most, Hasher(8)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = self._ranks(file)
        self.slots = 1 << (2 * most - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
        self.at, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool, self.pieces, self.used = np.zeros(1 << 18, np.uint32), 0, 0

    def _ranks(self, file: str):  # noqa: ANN202
        """The same vocabulary in an encoder that is faster on short pieces; None if it isn't a plain one."""
        import json

        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["model"].get("type") != "BPE":
            return None
        # The letters that stand for bytes: visible ones for themselves, the others from 256 on in order.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        assert set(letters) == set(ByteLevel.alphabet())
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t) and t not in self.special}
        import public_tokenizers

        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or _LONG.search(text):
            ids = self.tok.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.asarray(ids, np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each known piece, -1 for the others."""
        out = np.full(len(keys), -1, np.int64)
        slot, todo = (keys & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.place[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _learn(self, keys: np.ndarray, texts: list[str], first: np.ndarray) -> None:
        """Remember pieces with different keys.

        A piece with its space begins with a token that begins with a space, and has no other such
        token, so these tokens mark where each piece's ids start. A text's first piece has no space.
        """
        if self.pieces + len(keys) > self.most:
            self._clear()
            if len(keys) > self.most:  # a single long text with more pieces than the table has room for
                self.slots, self.most = 1 << (2 * len(keys) - 1).bit_length(), len(keys)
                self._clear()
        bad = np.asarray([not t or t[-1].isspace() or (t[0].isspace() and not f) or bool(_LONG.search(t)) for t, f in zip(texts, first, strict=True)])
        spaced = np.flatnonzero(~bad & ~first)
        ids = [np.zeros(0, np.uint32)]
        at, count = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int32)
        if len(spaced):
            got = np.asarray(self.fast.encode_ordinary(" " + " ".join([texts[i] for i in spaced])), np.uint32)
            starts = np.flatnonzero(self.spaced[got])
            at[spaced], count[spaced] = starts, np.diff(np.append(starts, len(got)))
            ids.append(got)
        n = len(ids[-1])
        for i in np.flatnonzero(~bad & first):
            got = np.asarray(self.fast.encode_ordinary(texts[i]), np.uint32)
            at[i], count[i], n = n, len(got), n + len(got)
            ids.append(got)
        a, b = self.pieces, self.pieces + len(keys)
        while len(self.at) < b:
            self.at, self.count = np.concatenate([self.at, self.at]), np.concatenate([self.count, self.count])
        while len(self.pool) < self.used + n:
            self.pool = np.concatenate([self.pool, self.pool])
        self.at[a:b], self.count[a:b] = at + self.used, count
        self.pool[self.used : self.used + n] = np.concatenate(ids)
        self.pieces, self.used = b, self.used + n
        slot, todo = (keys & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]
            won = free & (self.keys[slot] == keys[todo])
            self.place[slot[won]] = todo[won] + a
            todo, slot = todo[~won], (slot[~won] + 1) & (self.slots - 1)

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text; ``data`` has the texts' UTF-8 bytes, ``offsets`` their n + 1 bounds."""
        raw, n = data.tobytes(), len(offsets) - 1
        if self.fast is None:
            return [self.whole(raw[i:j].decode()) for i, j in zip(offsets, offsets[1:])]
        # Pieces: between spaces, and at the texts' bounds.
        gap = np.flatnonzero(data == 32)
        start = np.concatenate([offsets[:-1], gap + 1])
        end = np.concatenate([gap, offsets[1:]])
        # In page order; at equal places a text's end comes with its own start, so sorting both works.
        start.sort()
        end.sort()
        own = np.searchsorted(offsets[1:], start, side="right")
        own = np.minimum(own, n - 1)
        first = np.zeros(len(start), bool)
        bounds = np.searchsorted(start, offsets[:-1], side="left")
        empty = offsets[:-1] == offsets[1:]
        first[bounds[~empty]] = True
        keys = self.hash.spans(self.hash.prefix(data), start, end) ^ np.where(first, np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        keys[keys == 0] = 1
        found = self._find(keys)
        if (found < 0).any():
            new, one = np.unique(keys[found < 0], return_index=True)
            one = np.flatnonzero(found < 0)[one]
            before = self.pieces
            self._learn(new, [raw[i:j].decode() for i, j in zip(start[one].tolist(), end[one].tolist())], first[one])
            found = self._find(keys)
            if self.pieces < before + len(new) and (found < 0).any():  # emptied meanwhile
                new, one = np.unique(keys, return_index=True)
                self._clear()
                self._learn(new, [raw[i:j].decode() for i, j in zip(start[one].tolist(), end[one].tolist())], first[one])
                found = self._find(keys)
        count = self.count[found].astype(np.int64)
        odd = np.zeros(n, bool)
        odd[own[count < 0]] = True
        count[count < 0] = 0
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.at[found] - (ends - count), count) + np.arange(total)]
        last = np.searchsorted(own, np.arange(n), side="right")
        upto = np.concatenate([[0], ends])[last]
        special = any(s.encode() in raw for s in self.special)
        out = []
        for k in range(n):
            if empty[k]:
                out.append(np.zeros(0, np.uint32))
            elif odd[k] or special and any(s.encode() in raw[offsets[k] : offsets[k + 1]] for s in self.special):
                out.append(self.whole(raw[offsets[k] : offsets[k + 1]].decode()))
            else:
                out.append(ids[upto[k - 1] if k else 0 : upto[k]])
        return out


def pieces(docs: DataFrame, tokenizer: str, limit: int, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents over ``limit`` are cut.

    A document's ids end with ``end_id``; a cut one's first piece has what is left over, all others
    ``limit`` tokens. A null text counts as empty: one piece that has the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = Encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices([batch], "text"):
                rows = []
                for doc, got in zip(part.column(0).to_pylist(), encode.batch(*texts(part)), strict=True):
                    ids = got.astype("<u4").tobytes() + tail
                    n, k, at = len(ids) // 4, 0, 0
                    while at < n:
                        size = (n - at - 1) % limit + 1 if not k else limit
                        rows.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                        at, k = at + size, k + 1
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that it fits."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    keys: list[int] = []
    for i in order:
        at = bisect_left(keys, lengths[i])
        if at < len(keys):
            r = keys[at]
            b = room[r].pop()
            if not room[r]:
                del room[r]
                del keys[at]
        else:
            r, b = limit, len(bins)
            bins.append([])
        bins[b].append(i)
        if r := r - lengths[i]:
            if r not in room:
                room[r] = []
                insort(keys, r)
            room[r].append(b)
    return bins


class _Units:
    """Single pieces or pairs of one bin, by length: of each length the one whose bin has the least besides it.

    ``rest`` and ``bin`` have that bin's other tokens and its number. A heap per length has all
    bins; entries of a bin that has changed since (another ``version``) are dropped when met.
    """

    def __init__(self, limit: int, version: list[int]) -> None:
        self.rest, self.bin = np.full(limit + 1, 1 << 40, np.int64), np.full(limit + 1, -1, np.int64)
        self.heap: list[list[tuple[int, int, int]]] = [[] for _ in range(limit + 1)]
        self.version = version

    def top(self, size: int, but: int = -1) -> tuple[int, int]:
        """The least rest and its bin, other than ``but``."""
        h, kept = self.heap[size], None
        while h and (self.version[h[0][1]] != h[0][2] or h[0][1] == but):
            e = heappop(h)
            if self.version[e[1]] == e[2]:
                kept = e
        out = h[0][:2] if h else (1 << 40, -1)
        if kept:
            heappush(h, kept)
        return out

    def add(self, size: int, rest: int, b: int) -> None:
        heappush(self.heap[size], (rest, b, self.version[b]))
        if rest < self.rest[size]:
            self.rest[size], self.bin[size] = rest, b

    def refresh(self, sizes: list[int]) -> None:
        for size in sizes:
            self.rest[size], self.bin[size] = self.top(size)


def local_search(bins: list[list[int]], lengths: list[int], limit: int) -> list[list[int]]:
    """Move documents, exchange one for one, two for one and one for two between underfull bins, until
    a pass over all of them finds nothing that raises the sum of squared fills; bins that become empty go.

    A unit is nothing, a piece or a pair of one bin; its rest is what the bin has besides it. To
    exchange v of bin a for a longer u of another bin raises the sum of squares by twice
    (length of u - length of v) * (rest of v - rest of u), so of each length only the unit with the
    least rest counts, and v meets all bins at once: a slice over the lengths that fit. Equal
    lengths in a bin are one unit, so a bin has at most some 2,000 pairs for 2,048 tokens. Every
    change raises an integer that is bounded, so the search ends.
    """
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    version = [0] * len(bins)
    ones, twos = _Units(limit, version), _Units(limit, version)

    def units(b: int) -> tuple[list[int], list[int], list[int]]:
        """Different lengths of a bin's pieces; those of its pairs, with the first piece's length."""
        count = Counter(lengths[i] for i in bins[b])
        sizes, pairs = sorted(count), {}
        for k, x in enumerate(sizes):
            for y in sizes[k + (count[x] < 2) :]:
                pairs.setdefault(x + y, x)
        return sizes, list(pairs), list(pairs.values())

    def enter(b: int) -> None:
        held[b] = units(b)
        if 0 < fill[b] < limit:
            for kind, sizes in ((ones, held[b][0]), (twos, held[b][1])):
                for x in sizes:
                    kind.add(x, fill[b] - x, b)

    def best(kind: _Units, give: np.ndarray, a: int) -> tuple[int, int, int]:
        """The largest gain, the place in ``give`` of what leaves bin a and the length of what comes."""
        if not len(give):
            return 0, 0, 0
        come = give[:, None] + np.arange(1, limit - fill[a] + 1)
        gain = (come - give[:, None]) * (fill[a] - give[:, None] - kind.rest[come])
        at = int(gain.argmax())
        return int(gain.flat[at]), at // gain.shape[1], int(come.flat[at])

    def take(b: int, sizes: tuple[int, ...]) -> list[int]:
        out = []
        for x in sizes:
            out.append(bins[b].pop(next(k for k, i in enumerate(bins[b]) if lengths[i] == x)))
        return out

    def improve(a: int) -> bool:
        """Make the best change that fills bin a further."""
        single, pair, first = held[a]
        # What bin a has itself doesn't count.
        own = [(kind, x) for kind, sizes in ((ones, single), (twos, pair)) for x in sizes if kind.bin[x] == a]
        for kind, x in own:
            kind.rest[x], kind.bin[x] = kind.top(x, a)
        less = np.asarray(single, np.int64)
        found = (
            best(ones, np.append(0, less), a),
            best(twos, less, a),
            best(ones, np.asarray(pair, np.int64), a),
        )
        k = max(range(3), key=lambda i: found[i][0])
        gain, at, come = found[k]
        b = int((twos if k == 1 else ones).bin[come]) if gain > 0 else -1
        for kind, x in own:
            kind.refresh([x])
        if b < 0:
            return False
        out = ((0, *single)[at : at + 1] if at else ()) if k == 0 else (single[at],) if k == 1 else (first[at], pair[at] - first[at])
        into = (come,) if k != 1 else (x := held[b][2][held[b][1].index(come)], come - x)
        old = [held[a], held[b]]
        gone, got = take(a, out), take(b, into)
        bins[a] += got
        bins[b] += gone
        d = come - sum(out)
        fill[a], fill[b] = fill[a] + d, fill[b] - d
        version[a] += 1
        version[b] += 1
        for s, p, _ in old:
            ones.refresh([x for x in s if ones.bin[x] in (a, b)])
            twos.refresh([x for x in p if twos.bin[x] in (a, b)])
        enter(a)
        enter(b)
        return True

    held: list[tuple[list[int], list[int], list[int]]] = [([], [], [])] * len(bins)
    for b in range(len(bins)):
        if 0 < fill[b] < limit:
            enter(b)
    changed = True
    while changed:
        changed = False
        for a in sorted((b for b in range(len(bins)) if 0 < fill[b] < limit), key=lambda b: -fill[b]):
            while 0 < fill[a] < limit and improve(a):
                changed = True
    return [b for b in bins if b]


def pack(items: DataFrame, limit: int, group_items: int = 20_000) -> DataFrame:
    """``items`` (doc_id, piece, length, ...) with sequence_id and offset.

    A full item is a sequence of its own and never shuffled with others. The rest is dealt by hash
    into groups of about ``group_items``, as many as the count asks for, each packed alone: memory
    is bounded. What a group wastes is what its local search leaves; see the README for figures.
    """
    left = items.where(F.col("length") < limit)
    groups = max(1, -(-left.count() // group_items))
    cols = items.columns

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = t.column("length").to_pylist()
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(local_search(best_fit(lengths, limit), lengths, limit)):
            at = 0
            for i in b:
                seq[i], off[i] = k, at
                at += lengths[i]
        seq = (seq << 32) | (key[0].as_py() << 1)
        return t.select(cols).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    schema = ", ".join(f"{c} {t}" for c, t in items.dtypes) + ", sequence_id long, offset long"
    g = F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups))
    packed = left.withColumn("_g", g).groupBy("_g").applyInArrow(run, schema)
    full = items.where(F.col("length") == limit)
    # Numbers for full pieces are odd, for packed ones even.
    full = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full.select(*cols, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``limit`` tokens.

    Defined cases: null text: empty (the end id alone); rows that repeat a document are packed as
    often as they occur; an empty table gives no rows; further columns of ``docs`` are left out.
    """
    return pack(scratch(pieces(docs, tokenizer, limit, end_id)), limit)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
