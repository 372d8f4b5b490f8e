"""Vector codes, whitening and quality rules against plain versions, and the cases that each docstring defines."""

import hashlib
import math
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from echofold.llm import codes, quality, queries, whitening
from echofold.llm.vectors import main_size

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label string, key string, v string, x string, code string, error string, node string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, x, "k", "v", "x", "c", "e", "n") for i, v, x in rows], VECTORS)


def plain_codes(rows, parts, entries, rounds):
    """(key, code, error, label error) and the codebooks, one number at a time."""
    own = [(k, [math.floor(256 * c) for c in v], label) for k, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(own[0][1]) // parts)
    cut = lambda v: [(v + [0] * parts * width)[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in own[:entries]] for p in range(parts)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(books[p], cut(v)[p])[1] for _, v, _ in own]
            for k in set(at):
                used = [cut(v)[p] for (_, v, _), a in zip(own, at, strict=True) if a == k]
                books[p][k] = [sum(c) // len(used) for c in zip(*used, strict=True)]
    found = [(k, [near(books[p], cut(v)[p]) for p in range(parts)], label) for k, v, label in own]
    error = {}
    for _, n, label in found:
        error[label] = error.get(label, 0) + sum(d for d, _ in n)
    return [(k, "".join(f"{a:02x}" for _, a in n), sum(d for d, _ in n), error[label]) for k, n, label in found], books


@pytest.mark.parametrize("seed", range(6))
def test_tree_is_the_whole_search(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-3, 4, (64, 3)) if seed % 2 else rng.integers(-500, 500, (64, 4))  # few values: many ties and equal entries
    entries[10:20] = entries[5]
    points = np.concatenate([rng.integers(-6, 7, (800, entries.shape[1])), entries, entries + 1])
    far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    at, best = codes.Tree(entries).nearest(points)
    assert (at == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_tree_looks_at_few_entries():
    rng = np.random.default_rng(1)
    tree = codes.Tree(rng.normal(0, 200, (64, 4)).astype(np.int64))
    assert max(len(own) for own, axis in zip(tree.own, tree.axis, strict=True) if axis < 0) <= codes.LEAF
    assert sorted(np.concatenate([own for own, axis in zip(tree.own, tree.axis, strict=True) if axis < 0])) == list(range(64))


def odd_vectors(rng, n):
    rows = [(int(k), rng.normal(0, 1, 6).round(2).tolist(), "ab"[k % 2] if k % 5 else None) for k in range(n)]
    rows += [(3, rows[3][1], "a"), (None, [0.5] * 6, "b"), (90, None, "a"), (91, [], "a"), (92, [1.0, None, 0.0, 0.0, 0.0, 0.0], "a"), (93, [float("nan")] * 6, "a"), (94, [float("inf")] * 6, "a"), (95, [1.0, 2.0], "a")]
    return rows


@pytest.mark.parametrize("parts,entries", [(4, 8), (3, 64), (1, 5)])
def test_codes_against_plain(spark, parts, entries):
    rows = odd_vectors(np.random.default_rng(entries), 40)
    frame = vectors_of(spark, rows).repartition(5)
    books = codes.train(frame, parts=parts, entries=entries)
    found = codes.with_group_error(codes.compress(frame, books, "vec_id", "embedding", "label"), "label")
    want, plain = plain_codes([r for r in rows if r[1] is None or len(r[1]) in (0, 6)], parts, entries, codes.ROUNDS)
    assert books.entries.tolist() == plain
    assert sorted((tuple(r) for r in found.select("vec_id", "code", "error", "label_error").collect()), key=repr) == sorted(want, key=repr)
    assert books.sha256() == hashlib.sha256(",".join(str(x) for b in plain for e in b for x in e).encode()).hexdigest()
    code = np.frombuffer(bytes.fromhex(found.where("vec_id = 7").first().code), np.uint8)[None]
    x = np.array(rows[7][1])
    assert ((np.floor(x * 256) - books.decoded(code)[0] * 256) ** 2).sum() == found.where("vec_id = 7").first().error


def test_codes_of_nothing_and_of_too_much(spark):
    none = vectors_of(spark, [(1, None, "a")])
    books = codes.train(none)
    assert codes.with_group_error(codes.compress(none, books, "vec_id", "embedding", "label"), "label").count() == 0
    with pytest.raises(ArithmeticError):
        codes.train(vectors_of(spark, [(1, [1e30] * 4, "a")]))


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "HEAVY_LABELS", 2)
    rows = [(k, None if k % 3 == 0 else f"l{k % 5}", k) for k in range(50)]
    found = codes.with_group_error(spark.createDataFrame(rows, "vec_id long, label string, error long"), "label").collect()
    assert len(found) == 50 and all(r.label_error == sum(e for _, x, e in rows if x == r.label) for r in found)


def test_codes_query_is_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({codes.ORACLE_SQL})").fetchall()
    assert sorted(tuple(r) for r in queries.op11_codes(spark, SF).select(*names).collect()) == sorted(want)


def plain_whitening(vectors, k):
    """n, deviations, whitened rows, eigenvalue shares by an eigenvalue routine for symmetric matrices."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    once = [list(r) for r in dict.fromkeys(map(tuple, x))]
    n, sums = len(once), [sum(c) for c in zip(*once, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in once])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    every = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    return n, deviation, every @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check_whitening(found, keys, vectors, k):
    n, deviation, whitened, share = plain_whitening(vectors, k)
    rows = {}
    for r in found.collect():
        rows.setdefault(r.vec_id, {})[r.component] = r
    assert set(rows) == set(keys) and all(sorted(r) == list(range(1, k + 1)) for r in rows.values())
    got = np.array([[rows[key][c].whitened for c in range(1, k + 1)] for key in keys])
    sign = np.sign((got * whitened).sum(axis=0))
    assert np.abs(got - whitened * sign).max() < 1e-8
    for key, far in zip(keys, deviation, strict=True):
        r = rows[key][1]
        assert (r.n, r.deviation) == (n, far) and abs(r.explained - share[0]) < 1e-9 * share[0] and r.identity_error < 1e-9


def test_whitening_against_plain(spark):
    rng = np.random.default_rng(2)
    spread = rng.normal(0, 1, (300, 20)) * np.linspace(3, 0.2, 20)
    rows = [(k, v.tolist(), "a") for k, v in enumerate(spread)] + [(1000 + k, spread[0].tolist(), "a") for k in range(200)]
    odd = [(2000, None, "a"), (2001, [], "a"), (2002, [1.0] * 19 + [None], "a"), (2003, [1.0] * 19 + [float("-inf")], "a"), (2004, [1.0, 2.0], "a")]
    frame = vectors_of(spark, rows + odd).repartition(11)
    model = whitening.fit(frame)
    check_whitening(whitening.whiten(frame, model), [r[0] for r in rows], [r[1] for r in rows], 16)
    assert whitening.fit_list(frame.where("vec_id < 2000").withColumnRenamed("v", "_v").withColumnRenamed("embedding", "v")).count() == 300


def test_whitening_query(spark):
    found = queries.op12_whitening(spark, SF)
    vectors = {r.vec_id: list(r.embedding) for r in queries.table(spark, SF, "embeddings").collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)}
    check_whitening(found, list(vectors), list(vectors.values()), 16)


def test_factors_merge_over_levels(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (900, 5)).astype(np.int64) + whitening.SHIFT
    frame = spark.createDataFrame([(bytes(b),) for b in whitening.packed(x).to_pylist()], "x binary").repartition(70)  # 70, 9, 2, 1
    r = whitening.factor(frame, lambda rows: rows - whitening.SHIFT - 0.5, 5)
    y = x - whitening.SHIFT - 0.5
    assert np.allclose(r.T @ r, y.T @ y)


def test_whitening_without_spread(spark):
    rows = [(1, [1.0, 2.0, 3.0], "a"), (2, [1.0, 2.0, 3.0], "a"), (None, [1.0, 2.0, 4.0], "b")]
    frame = vectors_of(spark, rows)
    found = sorted(whitening.whiten(frame, whitening.fit(frame)).collect(), key=repr)
    assert len(found) == 9 and {r.n for r in found} == {2}
    assert all((r.whitened is None) == (r.component > 1) for r in found) and all(abs(abs(r.whitened) - 1) < 1e-12 for r in found if r.component == 1)
    assert {r.explained for r in found if r.component > 1} == {0.0}
    one = frame.where("vec_id = 1")
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in whitening.whiten(one, whitening.fit(one)).collect()] == [(None, 0.0, 0, 0.0)] * 3
    none = frame.limit(0)
    assert whitening.whiten(none, whitening.fit(none)).count() == 0
    with pytest.raises(ArithmeticError):
        whitening.fit(vectors_of(spark, [(1, [1e300] * 3, "a")]))


def test_packed_widths_and_deviations_past_a_long():
    x = np.array([[5, -7], [40_000, 1], [2**40, -(2**40)], [0, 0]]) + whitening.SHIFT
    assert (whitening.unpacked(whitening.packed(x), 2) == x).all()
    model = whitening.Whitening(2, 3, [7, -2], np.zeros((2, 0)), np.zeros(0), 0.0)
    big = np.array([[2**29, 1], [2**30, 2**30], [2**31, 3]])
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(r, model.sums, strict=True)) for r in big]
    assert model.deviation(big).tolist() == [w if w < 2**63 else None for w in want]


def test_main_size(spark):
    frame = spark.createDataFrame([([1.0, -4.0],), ([2.0, 3.0],), ([1.0],), ([9.0],)], "v array<double>")
    assert main_size(frame, "v") == (1, 2, 9.0) and main_size(frame.limit(0), "v") == (0, 0, 0.0)


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {k + i for k, w in enumerate(windows) if counts[w] > 1 for i in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def plain_verdict(text):
    raw, z = (text or "").encode(), zstandard.ZstdCompressor(level=3)

    def fine(x):
        low, high = next((lo, hi) for most, lo, hi in quality.LIMITS if len(x) < most)
        return low <= len(z.compress(x)) / len(x) <= high

    chunks = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
    return fine(raw) and sum(len(x) for x in chunks if len(x) >= 256 and not fine(x)) <= 0.25 * len(raw)


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    found = queries.op13_quality(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        base = plain_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        assert r.kept == (not base[5] and plain_verdict(texts[r.doc_id]))
    assert any(r.kept for r in found)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("etaoinshrdlucmfw"), rng.integers(2, 9))) for _ in range(2000)]
    return " ".join(words[int(2000 * u * u)] for u in rng.random(n))


def test_quality_odd(spark):
    import base64

    rng = np.random.default_rng(4)
    noise = " ".join(base64.b64encode(rng.bytes(45)).decode() for _ in range(400))
    half = prose(1, 1500)
    looped = prose(1, 1500) + "".join(f" w{k} " + "ab" * 200 for k in range(30))  # its words differ, its bytes repeat
    texts = [None, "", " \n\n\t ", "a b c", "x" * 300_000, prose(2, 60), prose(3, 3000), half, noise, looped, "é漢😀 " * 30 + " #*$%&|<>", "a b c d\n\na b c d\n \n \n" * 2, prose(5, 400_000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(6, texts[6]), (None, texts[6])]
    frame = spark.createDataFrame([(k, t, "k", "t", 1) for k, t in rows], "doc_id long, text string, key string, t string, kept int")
    found = quality.scored(frame).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((k is None, k or 0) for k, _ in rows)
    for r in found:
        text = dict(rows)[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(text)
        assert r.kept == (not r.base_failed and plain_verdict(text))
    kept = {r.doc_id for r in found if r.kept}
    tabled = " ".join(f"{w} price per unit of item number {k}" for k, w in enumerate(prose(9, 3000).split()))  # lists of one phrase
    assert not quality.judged(tabled.encode(), zstandard.ZstdCompressor(level=3))[2]
    assert {5, 6, 7, 12, None} <= kept and not kept & {0, 1, 2, 3, 4, 8, 9, 10, 11}
    assert not next(r for r in found if r.doc_id == 9).base_failed and not next(r for r in found if r.doc_id == 8).base_failed
    good = quality.keep_good(frame)
    assert good.columns == frame.columns and sorted((r.doc_id or 0, r.text) for r in good.collect()) == sorted((k or 0, t) for k, t in rows if k in kept)
    assert quality.scored(frame.limit(0)).count() == 0 and quality.keep_good(frame.limit(0)).count() == 0


def test_every_new_query_reads_its_whole_table(spark):
    vectors = queries.table(spark, SF, "embeddings")
    assert queries.op11_codes(spark, SF).count() == vectors.count() and queries.op12_whitening(spark, SF).count() == 16 * vectors.count()
    assert queries.op13_quality(spark, SF).agg(F.countDistinct("doc_id")).first()[0] == queries.table(spark, SF, "documents").count()
