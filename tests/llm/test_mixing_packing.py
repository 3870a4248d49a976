import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import public_tokenizers
from quillstream.llm import mixing, packing
from tokenizers import Tokenizer

FILE = public_tokenizers.path("byte_bpe_50k.json")


def water(sizes, most=3):
    """Targets by the stated loop."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, weight = total - sum(most * sizes[s] for s in capped), sum(w[s] for s in names if s not in capped)
        share = {s: most * sizes[s] if s in capped else left * w[s] / weight for s in names}
        new = {s for s in names if share[s] > most * sizes[s]}
        if not new:
            return share
        capped |= new


def test_mixing_defined_cases(spark, docs, rows, none, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op7_mixing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for r in got:
        sizes[source[r.doc_id]] += r["size"]
    want = water(sizes)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s]) and r.taken <= 3 * r["size"]
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op7_mixing(spark, str(tmp_path)).collect()))
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in rows}
    assert mixing.mix_sources(none).count() == 0


def test_mixing_comes_near_targets(spark):
    d = spark.createDataFrame([(i, "w " * (20 + i % 50), f"s{i % 7 if i % 3 else 0}") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.plan(d).groupBy("row.source").agg(mixing.F.first("target").alias("t"), mixing.F.sum(mixing.F.col("size") * mixing.F.col("copies")).alias("n")).collect()
    assert all(abs(r.n / r.t - 1) < 0.15 for r in got)


def pieces_of(text, tok):
    ids = np.asarray(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
    out, at = [], 0
    while at < len(ids):
        n = (len(ids) - at - 1) % 2048 + 1 if at == 0 else 2048
        out.append((len(out), at, n, zlib.crc32(ids[at : at + n].tobytes())))
        at += n
    return out


def check(got, text_rows):
    tok = Tokenizer.from_file(FILE)
    want = Counter((d, *p) for d, t in text_rows for p in pieces_of(t, tok))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 2048
    least = -(-sum(r.length for r in got) // 2048)
    assert len(bins) <= max(least + 1, least * 1.02)


def test_packing_defined_cases(spark, docs, rows, none):
    check(packing.pack_documents(docs, FILE).collect(), [(r[0], r[1]) for r in rows])
    assert packing.pack_documents(none, FILE).count() == 0


def test_packing_query(spark, sf):
    check(packing.op8_packing(spark, sf).collect(), [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_encoder_forgets_and_stays_right():
    e, tok = packing.Encoder(FILE, most=50), Tokenizer.from_file(FILE)
    texts = [" ".join(f"x{i}y{j}" for j in range(40)) for i in range(9)] + ["a  b", "\n q", "", " ", "é it's  "]
    raw = [t.encode() for t in texts]
    got = e.batch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_local_search_empties_bins():
    lengths = [6, 6, 5, 5, 4, 4]
    bins = packing.local_search([[0, 4], [1, 5], [2, 3]], lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(6))
    bins = packing.local_search([[0], [1, 4], [2], [3, 5]], lengths, 12)
    assert len(bins) == 3


def test_local_search_ends_where_no_exchange_helps():
    rng = random.Random(4)
    for limit, low, high, n in [(2048, 412, 612, 2000), (60, 1, 40, 90), (40, 3, 11, 120), (30, 7, 13, 60)]:
        lengths = [rng.randint(low, high) for _ in range(n)]
        bins = packing.local_search(packing.best_fit(lengths, limit), lengths, limit)
        assert sorted(i for b in bins for i in b) == list(range(n))
        sets = [sorted(lengths[i] for i in b) for b in bins]
        assert all(0 < sum(s) <= limit for s in sets)
        if n == 2000:
            assert len(bins) <= 1.01 * -(-sum(lengths) // limit)
            continue
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if i == j:
                    continue
                for k, m in ((0, 1), (1, 1), (2, 1), (1, 2)):
                    for out, into in product(combinations(a, k), combinations(b, m)):
                        d = sum(into) - sum(out)
                        assert not (0 < d <= limit - sum(a) and d > sum(b) - sum(a)), (a, b, out, into)


def test_mixing_leaves_columns_of_any_name_alone(spark):
    names = ["_size", "_copies", "_copy", "_target", "_source_size", "_s", "size", "copies", "target", "row", "of", "w", "i", "part"]
    rows = [(i, f"w {'x ' * (i % 9)}", f"s{i % 3}", *(f"{n}{i}" for n in names)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    mixed = mixing.mix_sources(docs)
    assert mixed.schema == docs.schema
    plain = mixing.mix_sources(docs.select("doc_id", "text", "source"))
    by = {r[0]: r for r in rows}
    assert sorted(map(tuple, mixed.collect())) == sorted(by[r.doc_id] for r in plain.collect())


def test_encoder_takes_long_runs():
    e, tok = packing.Encoder(FILE), Tokenizer.from_file(FILE)
    texts = ["\n" * 1_000_000, "a" + " " * 200_000 + "b", "x " + "q" * 100_000 + " y", "c\n" + "\t" * 5000 + "d e", " \u3000" * 3000]
    raw = [t.encode() for t in texts]
    got = e.batch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_local_search_beats_best_fit_on_even_lengths():
    rng = random.Random(0)
    lengths = [rng.randint(500, 1099) for _ in range(4000)]
    fit = packing.best_fit(lengths, 2048)
    bins = packing.local_search(fit, lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(4000)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= 1643 < len(fit)
