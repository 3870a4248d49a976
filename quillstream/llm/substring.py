"""Substring dedup: level-wise doubling from short windows to windows of the length that counts.

Level 1 asks which windows of a short length occur twice. Of all that lie in a window of the full length
only the one with the smallest hash is asked about: equal windows have equal parts at equal places, so
a window whose chosen part occurs once can't occur twice. What survives is extended to twice the
length, and asked about again, until the full length is reached or no candidates survive; there the
first place of each window is found.

What travels is packed: a row has the entries of many texts for one bucket of hashes, as lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, scope, scratch, slices, table, texts, unkeyed
from .wordhash import Hasher, inside, mix, words

_U = np.uint64
_LOW = _U((1 << 24) - 1)
LISTS = "bucket int, docs array<long>, g array<long>, k array<int>, s array<int>, c array<int>, w array<long>, rd array<long>, rs array<int>, rc array<int>"
FOUND = "bucket int, d array<long>, s array<int>, c array<int>"


def levels(length: int, least: int = 10) -> list[int]:
    """The lengths of the levels: ``length`` halved as long as that is even and a half has ``least`` words, one half at least."""
    if length < 2 or length % 2:
        raise ValueError("the length of a window must be even")
    out = [length, length // 2]
    while out[-1] % 2 == 0 and out[-1] // 2 >= least:
        out.append(out[-1] // 2)
    return out[::-1]


class Parts:
    """The windows of several texts: hashes of words, and for each window its chosen part of ``width`` words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, width: int, first: Hasher) -> None:
        self.length, self.width, self.data = length, width, data
        self.start, self.end, self.bounds = words(data, offsets)
        self.part = first.ngrams(first.spans(first.prefix(data), self.start, self.end), width)
        self.windows = np.flatnonzero(inside(self.bounds, length))
        self.place = self._chosen()

    def _chosen(self) -> np.ndarray:
        """For each window the place of its part with the smallest hash, the leftmost of equals.

        The low bits of the hash give way to the place, so a running minimum finds both.
        """
        if not len(self.windows):
            return np.zeros(0, np.int64)
        at = np.arange(len(self.part), dtype=_U)
        low = (self.part & ~_LOW) | (at & _LOW)
        span, wide = self.length - self.width + 1, 1
        while wide * 2 <= span:
            low = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        if wide < span:
            low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
        low = (low[self.windows] & _LOW).astype(np.int64)
        base = self.windows & ~int(_LOW)
        return base + low + np.where(low < (self.windows & int(_LOW)), int(_LOW) + 1, 0)

    def alive(self, ids: np.ndarray, fd: np.ndarray, fs: np.ndarray) -> np.ndarray:
        """For each window whether its chosen part is among the places (document, word), sorted, that survived."""
        held = np.zeros(len(self.part), bool)
        lo, hi = np.searchsorted(fd, ids), np.searchsorted(fd, ids, side="right")
        for k in np.flatnonzero(hi > lo):
            held[fs[lo[k] : hi[k]] + self.bounds[k]] = True
        return held[self.place]

    def own(self, place: np.ndarray) -> np.ndarray:
        """The text of each word place."""
        return np.searchsorted(self.bounds, place, side="right") - 1


def _list(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _by_bucket(bucket: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, the buckets that occur, and their bounds in that order."""
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    return order, there, np.append(first, count)


def _firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the keys, and for each place in it the place where its run of equals starts."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


#: Hashes that a task remembers as repeated; what it forgets only travels once more.
REMEMBERED = 1 << 20


class Asked:
    """Packs the places of windows that are asked about, by buckets of their hashes.

    Of equal ones in a slice of texts the first alone travels by its hash; the others are known to
    occur twice, and go along as such (rd, rs), in any bucket. So do all that the task has seen twice
    in an earlier slice: a passage in a third of all texts arrives about once per task.
    """

    def __init__(self, buckets: int) -> None:
        self.buckets, self.known = buckets, np.zeros(0, _U)

    def pack(self, ids: np.ndarray, p: Parts, place: np.ndarray) -> pa.RecordBatch | None:
        if not len(place):
            return None
        place = place[np.append(True, place[1:] != place[:-1])]
        own = p.own(place)
        s, g = place - p.bounds[own], p.part[place]
        order, start = _firsts(g)
        lead, seen = start == np.arange(len(g)), np.isin(g[order], self.known)
        many = np.bincount(start, minlength=len(g))[start] > 1
        twice = order[many | seen]
        if len(self.known) < REMEMBERED:
            self.known = np.union1d(self.known, g[order[lead & many]])
        order = order[lead & ~seen]
        by, there, cuts = _by_bucket((mix(g[order]) % _U(self.buckets)).astype(np.int32), len(order))
        order = order[by]
        return _pack(there, cuts, ids[own[order]], g[order], s[order], None, None, ids[own[twice]], s[twice], np.ones(len(twice), np.int64))


def level_one(docs: DataFrame, length: int, width: int, buckets: int) -> DataFrame:
    """Per bucket of hashes, packed (doc, place) of the chosen parts of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, asked = Hasher(3), Asked(buckets)
        for part in slices(batches, "text"):
            p = Parts(*texts(part), length, width, first)
            out = asked.pack(np.asarray(part.column(0)), p, p.place)
            if out is not None:
                yield out

    return docs.mapInArrow(run, LISTS)


def extend(docs: DataFrame, found: DataFrame, length: int, before: int, width: int, buckets: int, groups: int) -> DataFrame:
    """The same for parts of ``width`` words, of the windows whose part of ``before`` words survived."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        first, asked, out = Hasher(3), Asked(buckets), []
        if left.num_rows and right.num_rows:
            fd, fs = _places(right)
            for part in slices(left.sort_by("doc_id").combine_chunks().to_batches(), "text"):
                ids = np.asarray(part.column(0))
                short, long = (Parts(*texts(part), length, w, first) for w in (before, width))
                out.append(asked.pack(ids, long, long.place[short.alive(ids, fd, fs)] if len(short.place) else long.place))
        return pa.Table.from_batches([x for x in out if x is not None] or [_none()])

    return _grouped(docs, found, groups).groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, LISTS)


def _none() -> pa.RecordBatch:
    return _pack(np.zeros(0, np.int32), np.zeros(1, np.int64), *[np.zeros(0, np.int64)] * 3, None, None, *[np.zeros(0, np.int64)] * 3).slice(0, 0)


def _places(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The documents and word places of FOUND, sorted."""
    d, s = (np.asarray(found.column(c).combine_chunks().flatten()) for c in ("d", "s"))
    order = np.lexsort((s, d))
    return d[order], s[order].astype(np.int64)


def _pack(there: np.ndarray, cuts: np.ndarray, d: np.ndarray, g: np.ndarray, s: np.ndarray, c: np.ndarray | None, w: list | None, rd: np.ndarray, rs: np.ndarray, rc: np.ndarray) -> pa.RecordBatch:
    """Rows of LISTS, one per bucket; the known ones go with the first row. ``w``: values and bounds."""
    n = len(there)
    if not n:
        there, cuts, n = np.zeros(1, np.int32), np.zeros(2, np.int64), 1
    docs, places, k = [], [0], []
    for i, j in zip(cuts, cuts[1:]):
        u, inv = np.unique(d[i:j], return_inverse=True)
        docs.append(u)
        k.append(inv)
        places.append(places[-1] + len(u))
    known = np.asarray([0] + [len(rd)] * n)
    empty = np.zeros(n + 1, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(there, pa.int32()), _list(np.concatenate(docs), np.asarray(places), pa.int64()), _list(g.view(np.int64), cuts, pa.int64()), _list(np.concatenate(k), cuts, pa.int32()), _list(s, cuts, pa.int32()),
            _list(c if c is not None else np.zeros(0), cuts if c is not None else empty, pa.int32()), _list(w[0].view(np.int64), w[1], pa.int64()) if w else _list(np.zeros(0), empty, pa.int64()),
            _list(rd, known, pa.int64()), _list(rs, known, pa.int32()), _list(rc, known, pa.int32()),
        ],
        names=["bucket", "docs", "g", "k", "s", "c", "w", "rd", "rs", "rc"],
    )


def _unpack(t: pa.Table) -> dict[str, np.ndarray]:
    """The entries of all rows of a bucket: d, g, s, and with windows c and w; the known ones rd, rs, rc."""
    col = {c: t.column(c).combine_chunks() for c in t.column_names if c != "bucket"}
    flat = {c: np.asarray(a.flatten()) for c, a in col.items()}
    per = lambda c: np.asarray(pc.list_value_length(col[c])).astype(np.int64)
    shift = np.cumsum(per("docs")) - per("docs")
    return flat | {"d": flat["docs"][flat["k"] + np.repeat(shift, per("k"))] if len(flat["k"]) else np.zeros(0, np.int64), "g": flat["g"].view(_U), "w": flat["w"].view(_U)}


def _found(d: np.ndarray, s: np.ndarray, c: np.ndarray, groups: int) -> pa.Table:
    """Rows of FOUND, by the bucket of the document."""
    bucket = _bucket(d, groups)
    order, there, cuts = _by_bucket(bucket, len(d))
    return pa.table({"bucket": pa.array(there, pa.int32()), "d": _list(d[order], cuts, pa.int64()), "s": _list(s[order], cuts, pa.int32()), "c": _list(c[order], cuts, pa.int32())})


def _bucket(d: np.ndarray, groups: int) -> np.ndarray:
    return (mix(d.view(_U)) % _U(groups)).astype(np.int32)


def repeated(entries: DataFrame, groups: int) -> DataFrame:
    """FOUND: the places of parts that occur twice or more."""

    def run(t: pa.Table) -> pa.Table:
        e = _unpack(t)
        order, start = _firsts(e["g"])
        twice = order[np.bincount(start, minlength=len(start))[start] > 1] if len(start) else order
        d, s = np.concatenate([e["d"][twice], e["rd"]]), np.concatenate([e["s"][twice], e["rs"]])
        return _found(d, s, np.ones(len(d), np.int64), groups)

    return entries.groupBy("bucket").applyInArrow(run, FOUND)


def _grouped(docs: DataFrame, found: DataFrame, groups: int) -> DataFrame:
    """Documents of ``found`` (and some others) with the bucket they belong to.

    A bit map of fixed size (1 MB) over the ids spares documents without entries the shuffle; where
    it is full, all go, and nothing else changes.
    """
    bits, held = _id_bits(found)
    b = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = np.asarray(x.column(0))
            at = (mix(ids.view(_U)) % _U(bits)).astype(np.int64)
            y = x.append_column("bucket", pa.array(_bucket(ids, groups)))
            yield y.filter(pa.array((b.value[at >> 3] >> (at & 7)) & 1 == 1))

    return docs.mapInArrow(run, "doc_id long, text string, bucket int")


def _id_bits(found: DataFrame, bits: int = 1 << 23) -> tuple[int, np.ndarray]:
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = np.unique(mix(np.asarray(b.column(0).flatten()).view(_U)) % _U(bits)).astype(np.int64)
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        word = held.view(np.int64)
        at = np.flatnonzero(word)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(word[at])], names=["word", "bits"])

    rows = found.select("d").mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(bits // 64, np.int64)
    held[np.asarray(rows.column("word"))] = np.asarray(rows.column("bits"))
    return bits, held.view(np.uint8)


def level_two(docs: DataFrame, found: DataFrame, length: int, width: int, buckets: int, groups: int) -> DataFrame:
    """Per bucket of hashes, the windows whose chosen part of ``width`` words survived, packed as runs.

    Of equal windows of a group of documents the first alone travels; later ones are known to be
    repeats. A run has consecutive windows with the same part g; w has a hash of each that is
    independent of g's, so 128 bits decide.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_none()])
        first, second = Hasher(3), Hasher(33)
        fd, fs = _places(right)
        g, w, d, s = [], [], [], []
        for part in slices(left.sort_by("doc_id").combine_chunks().to_batches(), "text"):
            ids = np.asarray(part.column(0))
            x = Parts(*texts(part), length, width, first)
            if not len(x.place):
                continue
            on = x.alive(ids, fd, fs)
            at, place = x.windows[on], x.place[on]
            own = x.own(at)
            full = second.ngrams(second.spans(second.prefix(x.data), x.start, x.end), length)
            g.append(x.part[place])
            w.append(full[at])
            d.append(ids[own])
            s.append(at - x.bounds[own])
        return pa.Table.from_batches([_leads(*(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (d, s, g, w)), buckets)])

    return _grouped(docs, found, groups).groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(run, LISTS)


def _leads(d: np.ndarray, s: np.ndarray, g: np.ndarray, w: np.ndarray, buckets: int, known: tuple[np.ndarray, ...] | None = None) -> pa.RecordBatch:
    """LISTS of the first of each run of equal windows, which are in the order of their documents, and the others (and ``known``) as repeats."""
    g, w = g.view(_U), w.view(_U)
    order, start = _firsts(g, w)
    lead, ahead = start == np.arange(len(order)), order[start]
    later = order[~lead & ((d[ahead] != d[order]) | (s[ahead] != s[order]))]
    go = np.sort(order[lead])
    repeats = runs(d[later], s[later])
    if known:
        repeats = tuple(np.concatenate([a, b]) for a, b in zip(repeats, known, strict=True))
    new = np.ones(len(go), bool)
    new[1:] = (d[go][1:] != d[go][:-1]) | (s[go][1:] != s[go][:-1] + 1) | (g[go][1:] != g[go][:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(go)))
    by, there, cuts = _by_bucket((mix(g[go[head]]) % _U(buckets)).astype(np.int32), len(head))
    head, count = head[by], count[by]
    idx = np.repeat(head - (np.cumsum(count) - count), count) + np.arange(count.sum())
    wcuts = np.concatenate([[0], np.cumsum(count)])[cuts]
    first = go[head]
    return _pack(there, cuts, d[first], g[first], s[first], count, [w[go[idx]], wcuts], *repeats)


def runs(d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (document, first place, number) of places."""
    if not len(d):
        return d.astype(np.int64), s.astype(np.int64), np.zeros(0, np.int64)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(d)) - 1
    return d[at], s[at], s[last] - s[at] + 1


def _windows(e: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """d, s, g, w of each window of unpacked runs, in the order of documents and places."""
    c = e["c"].astype(np.int64)
    step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    d, s, g = np.repeat(e["d"], c), np.repeat(e["s"], c) + step, np.repeat(e["g"], c)
    order = np.lexsort((s, d))
    return d[order], s[order], g[order], e["w"][order]


#: From so many groups of documents on, the entries of a bucket are first joined in parts.
MANY = 1 << 10


def later(entries: DataFrame, buckets: int, groups: int) -> DataFrame:
    """FOUND: runs of windows that also start earlier.

    A passage in a third of all texts comes once from each group of documents. Where these are many,
    a bucket's entries are joined in as many parts as the root of their number first, of which each
    passes the first window of equals on, so no task meets all groups.
    """

    def part(t: pa.Table) -> pa.Table:
        e = _unpack(t)
        out = _leads(*_windows(e), buckets, (e["rd"], e["rs"], e["rc"]))
        return pa.Table.from_batches([out])

    def run(t: pa.Table) -> pa.Table:
        e = _unpack(t)
        d, s, g, w = _windows(e)
        order, start = _firsts(g, w)
        ahead = order[start]
        bad = order[(d[ahead] != d[order]) | (s[ahead] != s[order])]
        rd, rs, rc = runs(d[bad], s[bad])
        return _found(np.concatenate([rd, e["rd"]]), np.concatenate([rs, e["rs"]]), np.concatenate([rc, e["rc"]]), groups)

    if groups >= MANY:
        salt = F.pmod(F.xxhash64(F.get("docs", F.lit(0))), F.lit(int(groups**0.5)))
        entries = entries.groupBy("bucket", salt.alias("salt")).applyInArrow(part, LISTS)
    return entries.groupBy("bucket").applyInArrow(run, FOUND)


OUT = "doc_id long, n_words long, n_removed long, kept string"


def _kept(part: pa.RecordBatch, cover: dict[int, list[tuple[int, int]]], length: int) -> pa.RecordBatch:
    n, removed, kept = [], [], []
    for d, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
        w = (t.as_py() or "").encode().split()
        n.append(len(w))
        spans = cover.get(d)
        if spans:
            gone = np.zeros(len(w) + 1, np.int64)
            for s, c in spans:
                gone[s] += 1
                gone[s + c - 1 + length] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            removed.append(int(gone.sum()))
            w = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
        else:
            removed.append(0)
        kept.append(b" ".join(w).decode())
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, length: int = 20, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the words that no repeated window covers, joined by a space.

    A window of ``length`` (even) words is repeated if its word sequence also starts earlier: in a
    document with a smaller id, or earlier in the same one; of different texts with one id (or none)
    the one with the smaller SHA-256 comes first. ``digest``: kept is the SHA-256 of the
    text instead of the text. Defined cases: null: no words; texts shorter than a window keep all;
    rows that repeat a document are treated alike and aren't earlier than one another; a null id
    counts as the smallest; an empty table gives no rows; further columns of any name are left out.
    """
    d, names = numbered(docs)
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Buckets of about half a million entries; groups of about 4 MB of texts.
    buckets, groups = 1 + size // 20_000_000, 1 + size // 4_000_000
    widths = levels(length)
    with scope():
        found = scratch(repeated(level_one(d, length, widths[0], buckets), groups))
        # Double the length until it is the full one or nothing survives.
        for before, width in zip(widths, widths[1:-1]):  # noqa: B905
            if found.isEmpty():
                break
            found = scratch(repeated(extend(d, found, length, before, width, buckets, groups), groups))
        last = found if found.isEmpty() else later(level_two(d, found, length, widths[-2], buckets, groups), buckets, groups)
        full = scratch(last, keep=True)
    bits, held = _id_bits(full)
    b = docs.sparkSession.sparkContext.broadcast(held)

    def sha(x: pa.RecordBatch) -> pa.RecordBatch:
        if not digest:
            return x
        return x.set_column(3, "kept", pa.array([hashlib.sha256(t.encode()).hexdigest() for t in x.column(3).to_pylist()], pa.string()))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = (mix(np.asarray(x.column(0)).view(_U)) % _U(bits)).astype(np.int64)
            y = x.filter(pa.array((b.value[at >> 3] >> (at & 7)) & 1 == 0))
            for part in slices([y], "text"):
                yield sha(_kept(part, {}, length))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        cover: dict[int, list[tuple[int, int]]] = {}
        cols = [right.column(c).combine_chunks().flatten().to_pylist() if right.num_rows else [] for c in ("d", "s", "c")]
        for doc, s, c in zip(*cols, strict=True):
            cover.setdefault(doc, []).append((s, c))
        parts = [sha(_kept(x, cover, length)) for x in slices(left.combine_chunks().to_batches(), "text")]
        kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        return pa.Table.from_batches(parts, kinds)

    touched = _grouped(d, full, groups).groupBy("bucket").cogroup(full.groupBy("bucket")).applyInArrow(cut, OUT)
    out = d.mapInArrow(untouched, OUT).unionByName(touched)
    if names is None:
        return unkeyed(out)
    out = out.withColumnRenamed("doc_id", "key").join(names.select("key", "doc_id"), "key")
    return out.select("doc_id", "n_words", "n_removed", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")
