"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_bits, numbered, of_rows, scope, scratch, slices, table, texts, unkeyed
from .components import components
from .wordhash import Hasher, mix, words

_U = np.uint64
#: Counters of how many documents have a shingle, shared by the shingles with the same top bits.
SKETCH_BITS = 22
#: Cells of a document's histogram of shingles, for the suffix filter.
CELLS = 64
#: A token that so many documents have is dealt with in parts of about as many.
HOT = 1 << 9
#: The same where a part meets all others of its token.
PAIRED = 1 << 12
#: Partial counts that one task adds up.
FAN_IN = 32


def shingles(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; of a shorter text, the whole's."""
    start, end, bounds = words(data, offsets)
    w = hasher.spans(hasher.prefix(data), start, end)
    grams = hasher.ngrams(w, n)
    out = []
    for i, j in zip(bounds.tolist(), bounds[1:].tolist()):
        if j - i >= n:
            out.append(np.unique(grams[i : j - n + 1]))
        elif j > i:
            out.append(mix(hasher.ngrams(w[i:j], j - i) + _U(j - i)))
        else:
            out.append(np.zeros(0, _U))
    return out


def sketch(docs: DataFrame, n: int) -> np.ndarray:
    """For each counter the number of documents with such a shingle, over all documents.

    32 MB of counts whatever the corpus (16 MB when broadcast). They are summed on the executors
    block by block, by a tree in which a task meets FAN_IN partial blocks of half a megabyte at most.
    """
    size, blocks = 1 << SKETCH_BITS, 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(6, lower=True), np.zeros(size, np.int64)
        for b in slices(batches, "text"):
            for s in shingles(*texts(b), hasher, n):
                at = (s >> _U(64 - SKETCH_BITS)).astype(np.int64)
                if len(at):
                    np.add.at(total, at, 1)
        raw, part = total.reshape(blocks, -1), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array(np.full(blocks, part, np.int32)), pa.array([pa.compress(r.tobytes(), "zstd", asbytes=True) for r in raw], pa.binary())], names=["block", "part", "counts"])

    def unpack(x: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(x, size // blocks * 8, "zstd", asbytes=True), np.int64)

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(size // blocks, np.int64)
        for x in t.column("counts"):
            total += unpack(x.as_py())
        return pa.table({"block": t.column("block")[:1], "part": t.column("part")[:1], "counts": pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())})

    schema = "block int, part int, counts binary"
    rows = docs.select("text").mapInArrow(count, schema)
    partials = docs.rdd.getNumPartitions()
    while True:
        partials = -(-partials // FAN_IN)
        rows = rows.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("block", "part").applyInArrow(add, schema)
        if partials <= 1:
            break
    out = np.zeros((blocks, size // blocks), np.int64)
    for r in rows.collect():
        out[r.block] += unpack(bytes(r.counts))
    return out.ravel()


def signatures(docs: DataFrame, counts: np.ndarray, n: int, threshold: int) -> DataFrame:
    """Per document: n, a and b (128 bits of its set), hist (CELLS counts, 255 at most), and tokens,
    its prefix: the rarest n - ceil(threshold * n / 100) + 1 shingles, in the order shared by all.

    A token is a shingle's count and then 40 bits of its hash. Two sets with the wanted similarity
    have a token of their prefixes in common; a rare collision only adds a candidate.
    """
    held = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 22) - 1).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, often = Hasher(6, lower=True), held.value
        for part in slices(batches, "text"):
            ns, a, b, hist, tokens = [], [], [], [], []
            for s in shingles(*texts(part), hasher, n):
                m = len(s)
                keys = np.sort((often[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(_U) << _U(40)) | (mix(s) >> _U(24)))
                ns.append(m)
                a.append(int(mix(s).sum().view(np.int64)) if m else 0)
                b.append(int(mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)) if m else 0)
                hist.append(np.minimum(np.bincount((s & _U(CELLS - 1)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes())
                tokens.append(keys[: m - (threshold * m + 99) // 100 + 1 if m else 0].view(np.int64))
            lens = np.cumsum([0, *map(len, tokens)])
            lists = pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(np.concatenate(tokens)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ns, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(hist, pa.binary()), lists], names=["doc_id", "n", "a", "b", "hist", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, a long, b long, hist binary, tokens array<long>")


def _filters(nx: Column, ny: Column, px: Column, py: Column, t: int) -> Column:
    """Length filter, and positional filter for the first common token (places from 0)."""
    least, most = F.least(nx, ny), F.greatest(nx, ny)
    need = F.ceil((nx + ny) * F.lit(t) / F.lit(100.0 + t) - 1e-9)
    return (least * 100 >= most * t) & (1 + F.least(nx - px - 1, ny - py - 1) >= need)


def chain(entries: DataFrame, order: list[Column], t: int) -> DataFrame:
    """Neighbours (token, x, y, ok) in the sorted documents of each token; ok: the filters let them pass.

    If all neighbours of a token turn out to be connected, so are all its documents. Tokens of very
    many documents are dealt with in salted parts whose first documents are chained in turn, so a
    group that holds a third of all rows isn't one task.
    """
    e = entries.withColumn("salt", salt(F.col("id"), HOT))
    w = Window.partitionBy("token", "salt").orderBy(*order)
    prev = e.select("token", "salt", "id", "n", "pos", F.lag(F.struct("id", "n", "pos")).over(w).alias("p"))
    heads = prev.where("p is null").where(parts(HOT) > 1)
    linked = heads.select("token", "id", "n", "pos", F.lag(F.struct("id", "n", "pos")).over(Window.partitionBy("token").orderBy(*order)).alias("p"))
    rows = prev.drop("salt").unionByName(linked).where("p is not null").where("p.id <> id")
    ok = _filters(F.col("n"), F.col("p.n"), F.col("pos"), F.col("p.pos"), t)
    return rows.select("token", F.least("id", "p.id").alias("x"), F.greatest("id", "p.id").alias("y"), ok.alias("ok"))


def parts(size: int) -> Column:
    """Into how many parts of about ``size`` entries a token's are dealt; its top bits count its documents."""
    return (1 + F.floor(F.shiftright(F.col("token"), 40) / size)).cast("int")


def salt(doc: Column, size: int) -> Column:
    """The part of its token that a document's entry belongs to."""
    return F.pmod(F.xxhash64(doc), parts(size))


def every_salt(size: int) -> Column:
    return F.explode(F.sequence(F.lit(0), parts(size) - 1))


def suffix_filter(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """Pairs whose histograms differ by no more than the sets may: the sum of differences of counts
    in any division of the shingles is a lower bound of what only one of the two has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            hx, hy = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int32) for k in (2, 4))
            nx, ny = np.asarray(b.column(3)), np.asarray(b.column(5))
            need = -(-(nx + ny) * t // (100 + t))
            ok = (np.abs(hx - hy).sum(1) <= nx + ny - 2 * need) & (np.minimum(nx, ny) * 100 >= np.maximum(nx, ny) * t)
            yield b.select(["x", "y"]).filter(pa.array(ok))

    s = sets.select("doc_id", "hist", "n")
    j = pairs.select("x", "y").join(s.select(F.col("doc_id").alias("x"), F.col("hist").alias("hx"), F.col("n").alias("nx")), "x")
    j = j.join(s.select(F.col("doc_id").alias("y"), F.col("hist").alias("hy"), F.col("n").alias("ny")), "y")
    return j.select("x", "y", "hx", "nx", "hy", "ny").mapInArrow(run, "x long, y long")


def verify(pairs: DataFrame, docs: DataFrame, n: int, t: int) -> DataFrame:
    """The pairs (x, y), each once, whose sets are similar, by their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(6, lower=True)
        for part in slices(batches, "tx", 1 << 19):
            sx, sy = shingles(*texts(part, "tx"), hasher, n), shingles(*texts(part, "ty"), hasher, n)
            both = np.asarray([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(sx, sy, strict=True)])
            union = np.asarray([len(a) + len(b) for a, b in zip(sx, sy, strict=True)]) - both
            yield part.select(["x", "y"]).filter(pa.array((100 * both >= t * union) & (both > 0)))

    d = docs.where(id_bits(pairs, "x", "y")(F.col("doc_id")))
    j = pairs.join(d.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), "x")
    j = j.join(d.select(F.col("doc_id").alias("y"), F.col("text").alias("ty")), "y")
    return j.select("x", "y", "tx", "ty").mapInArrow(run, "x long, y long").distinct()


def join(docs: DataFrame, n: int = 4, threshold: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    Two documents link if 100 * intersection >= threshold * union of their sets. Documents with
    equal sets are one class (one of them stands for all). Candidates are documents that share a
    token of their prefixes and pass the filters; each candidate pair is verified once on whole
    texts. First the neighbours in each token's sorted documents are verified; for tokens whose
    documents aren't all connected by then, all their pairs across components follow, so no link
    between different components is lost, and a large group of near copies doesn't become all its
    pairs. Defined cases: null texts and texts without words have an empty set, link with nothing
    and are their own component; a null id counts as the smallest; rows with one id (or none) and
    different texts are documents of their own; repeated rows are answered alike; an empty table gives no rows.
    """
    with scope():
        d, names = numbered(docs)
        out = linked(d, n, threshold)
        if names is None:
            out = unkeyed(out, "component_id")
        else:
            name = names.groupBy(F.col("key").alias("component_id")).agg(F.first("doc_id").alias("of"))
            out = out.withColumnRenamed("doc_id", "key").join(name, "component_id").select("key", "n_shingles", F.col("of").alias("component_id"))
            out = names.select("key", "doc_id").join(out, "key").drop("key")
        return scratch(out.select("doc_id", "n_shingles", "component_id"), keep=True)


def linked(docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """join() for documents whose ids are numbers of their own (see common.numbered); call it in a scope()."""
    sig = scratch(signatures(docs, sketch(docs, n), n, threshold))
    classes = scratch(sig.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep")))
    sets = sig.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    entries = sets.select(F.col("doc_id").alias("id"), "n", F.posexplode("tokens").alias("pos", "token"))
    near = scratch(chain(entries, [F.col("n"), F.col("id")], threshold))
    pairs = scratch(near.groupBy("x", "y").agg(F.count("*").alias("shared"), F.bool_or("ok").alias("ok")))

    def grown(comp: DataFrame | None, found: DataFrame) -> DataFrame:
        """The components with the links among the pairs found; what is settled goes on as a star per component."""
        links = scratch(suffix_filter(found, sets, threshold))
        if comp is not None and links.isEmpty():
            return comp
        links = verify(links, docs, n, threshold)
        return components(links if comp is None else comp.select(F.col("id").alias("x"), F.col("comp").alias("y")).unionByName(links))

    # First the neighbour with most tokens in common, one pair per document; then what that left apart.
    likely = scratch(pairs.where("ok").groupBy("y").agg(F.max_by("x", F.struct("shared", (-F.col("x")).alias("m"))).alias("x")))
    comp = grown(None, likely)
    apart = _named(_named(pairs, comp, "x"), comp, "y").where("cx <> cy")
    comp = grown(comp, apart.where("ok").join(likely, ["x", "y"], "left_anti"))
    some = scratch(_loose(near, pairs, entries, comp))
    # A hub that resembles many documents which hardly resemble one another: of each such token the
    # document with most of these tokens in its prefix is tried against the others.
    fame = some.groupBy("x").agg(F.count("*").alias("fame"))
    hub = some.join(fame, "x").groupBy("token").agg(F.max(F.struct("fame", (-F.col("x")).alias("m"), "x", "n", "pos", "cx")).alias("h"))
    hub = hub.select("token", "h", every_salt(HOT).alias("salt"))
    star = some.withColumn("salt", salt(F.col("x"), HOT)).join(hub, ["token", "salt"]).where("cx <> h.cx")
    star = star.where(_filters(F.col("n"), F.col("h.n"), F.col("pos"), F.col("h.pos"), threshold)).select(F.least("x", "h.x").alias("x"), F.greatest("x", "h.x").alias("y")).distinct()
    star = scratch(star.join(pairs.where("ok"), ["x", "y"], "left_anti"))
    comp = grown(comp, star)
    tested = pairs.where("ok").select("x", "y").unionByName(star)
    some = scratch(_loose(near, pairs, some.withColumnRenamed("x", "id"), comp))
    # Each pair of a token's parts meets in a place of its own.
    mine = salt(F.col("x"), PAIRED)
    a = some.select("token", "x", "n", "pos", "cx", mine.alias("s"), every_salt(PAIRED).alias("r"))
    b = some.select("token", F.col("x").alias("y"), F.col("n").alias("m"), F.col("pos").alias("q"), F.col("cx").alias("cy"), mine.alias("r"), every_salt(PAIRED).alias("s"))
    # Of two components' documents the longer ones look for the shorter ones.
    cross = a.join(b, ["token", "s", "r"]).where("cx <> cy").where((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("x") < F.col("y"))))
    cross = cross.where(_filters(F.col("n"), F.col("m"), F.col("pos"), F.col("q"), threshold)).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    comp = grown(comp, cross.join(tested, ["x", "y"], "left_anti"))
    member = sig.select("doc_id", "n", "a", "b").join(classes, ["n", "a", "b"], "left")
    member = member.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    # A class stands under its smallest id, so the smallest representative is the smallest document.
    return member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep", "doc_id").alias("component_id"))


def _named(rows: DataFrame, comp: DataFrame, col: str) -> DataFrame:
    """Add c<col>: the component of column ``col``; its own id where it has no link."""
    c = comp.select(F.col("id").alias(col), F.col("comp").alias(f"c{col}"))
    return rows.join(c, col, "left").withColumn(f"c{col}", F.coalesce(f"c{col}", col))


def _loose(near: DataFrame, pairs: DataFrame, entries: DataFrame, comp: DataFrame) -> DataFrame:
    """Entries (token, x, n, pos, cx) of tokens with neighbours that aren't connected yet."""
    apart = _named(_named(pairs, comp, "x"), comp, "y").where("cx <> cy")
    tokens = near.join(apart, ["x", "y"], "left_semi").select("token").distinct().select("token", every_salt(HOT).alias("salt"))
    e = entries.select("token", F.col("id").alias("x"), "n", "pos", salt(F.col("id"), HOT).alias("salt"))
    return _named(e.join(tokens, ["token", "salt"], "left_semi").drop("salt"), comp, "x")


def deduplicate(docs: DataFrame, n: int = 4, threshold: int = 85) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id, once; all columns stay,
    whatever their names.

    Of rows with one id and different texts each is a document; of repeated ones one stays. Null
    texts and texts without words are like no other and stay; an empty table gives no rows.
    """
    with scope():
        rows, names = numbered(docs)
        dropped = scratch(linked(rows, n, threshold).where("doc_id <> component_id").select(F.col("doc_id").alias("key")), keep=True)
    return of_rows(docs, dropped, names)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
