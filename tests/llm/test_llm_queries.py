"""The operators on tables: whole results against brute force, and the cases that each docstring defines."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from echofold.llm import ann, bpe, decontam, html_extract, langid, licenses, linededup, queries, simhash, toxicity, warc
from echofold.llm.components import components
from echofold.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, t string, score string, fp string, ids string"


def docs_of(spark, texts):
    """Documents with nulls in other columns, and further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, x, None, None if (i or 0) % 2 else "h", None, "k", "t", "s", "f", "i") for i, x in texts], DOCS)


ODD = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A b C d e f"), (None, "a b c d e f"), (5, "\n\n"), (6, "x" * 300_000), (7, "word " * 60_000), (8, "É漢😀 <|endoftext|>")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark, odd):
    return odd.limit(0)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_bpe_table(spark, odd, empty):
    got = bpe.encode(odd, tokenizer_path(), decoded=True)
    assert sorted((r.doc_id, r.decoded) for r in got.where("doc_id IS NOT NULL").collect()) == sorted((i, x or "") for i, x in ODD if i)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got.collect())
    assert rows_of(bpe.decode(got, tokenizer_path())) == rows_of(got.select("doc_id", "decoded"))
    assert bpe.encode(empty, tokenizer_path()).count() == 0


def test_bpe_query_is_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    for r in queries.op1_bpe(spark, SF).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_html_table(spark):
    page = "<article><h1>Head</h1><p>Some text of the article, long enough to be read.</p></article><footer>x</footer>"
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, page, "c"), (3, page, "c"), (None, "<p>" + "w " * 100_000, "d")], "page_id long, html string, key string")
    got = html_extract.extract(rows).collect()
    assert sorted((r.page_id or 0, r.text) for r in got if r.page_id) == [(1, ""), (2, ""), (3, "Head Some text of the article, long enough to be read."), (3, "Head Some text of the article, long enough to be read.")]
    assert all(r.n_chars == len(r.text) for r in got) and html_extract.extract(rows.limit(0)).count() == 0


def test_html_query(spark):
    import html
    import re

    got = {r.page_id: r.text for r in queries.op2_html(spark, SF).collect()}
    for r in queries.table(spark, SF, "pages").collect():
        body = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", "\n", re.search("<article>(.*)</article>", r.html, re.S).group(1)))
        assert got[r.page_id] == " ".join(x for x in (" ".join(html.unescape(y).split()) for y in body.split("\n")) if x)


def test_langid_held_out(spark, odd, empty):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = queries.op3_langid(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 5)] == ["und"] * 3 and got[3].lang_pred in model[0][0] and len(got) == 9
    assert {r.lang_pred for r in langid.predict(odd, langid.train(odd)).collect()} == {"und"} and langid.predict(empty, langid.train(empty)).count() == 0


def test_langid_blocks_of_languages_are_one_model(spark, odd, monkeypatch):
    docs = queries.table(spark, SF, "documents")
    pick = lambda frame: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in frame.where("doc_id IS NOT NULL").collect())
    one = pick(langid.predict(docs, langid.train(docs)))
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 1)
    model = langid.train(docs)
    assert len(model) > 2 and pick(langid.predict(docs, model)) == one
    assert {r.lang_pred for r in langid.predict(odd, model).where("doc_id IN (1, 2, 5)").collect()} == {"und"}


def test_ann_recall_and_order(spark):
    rows = queries.table(spark, SF, "embeddings")
    data = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    got = defaultdict(list)
    for r in queries.op4_ann(spark, SF).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1 and r.score == pytest.approx(float(data[r.query_id] @ data[r.vec_id]), abs=1e-12)
        got[r.query_id].append(r.vec_id)
    hits = total = 0
    for q in (k for k in data if k % 20 == 0):
        want = sorted((k for k in data if k != q), key=lambda k: (-float(data[q] @ data[k]), k))[:20]
        assert len(got[q]) == 20
        hits += len(set(want) & set(got[q]))
        total += 20
    assert hits / total >= 0.9


def test_ann_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [0.5, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in ann.search(frame, F.col("vec_id") == 0, 20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 9, 0.5)]
    assert ann.search(frame.limit(0), F.col("vec_id") == 0).count() == 0 and ann.search(frame, F.lit(False)).count() == 0


def plain_line_dedup(rows, ratio, least):
    pages, seen = defaultdict(int), defaultdict(int)
    for host, text in {(host, text or "") for host, text in rows}:
        pages[host] += 1
        for line in {x.strip(" ") for x in text.split("\n")} - {""}:
            seen[host, line] += 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return [None if text is None else "\n".join(x for x in text.split("\n") if (host, x.strip(" ")) not in bad) for host, text in rows]


def test_line_dedup(spark, odd, empty):
    rows = [("a" if k % 3 else None, "\n".join(["head " * (k % 2), f"line {k}", " foot", ""][: k % 5])) for k in range(60)] + [("a", None), (None, "")]
    frame = spark.createDataFrame([(k, h, t, "x") for k, (h, t) in enumerate(rows)], "doc_id long, source string, text string, host string")
    got = [r.text for r in linededup.drop_boilerplate(frame).orderBy("doc_id").collect()]
    assert got == plain_line_dedup([(h or "", t) for h, t in rows], linededup.RATIO, linededup.MIN_PAGES) and any(x != t for x, (_, t) in zip(got, rows, strict=True))
    assert linededup.drop_boilerplate(odd).columns == odd.columns and linededup.drop_boilerplate(odd).count() == len(ODD) and linededup.drop_boilerplate(empty).count() == 0


def test_line_dedup_keeps_copied_texts(spark):
    rows = [("a", "one long story\nwith its own end") for _ in range(50)] + [("a", f"menu\nitem {k}") for k in range(50)]
    frame = spark.createDataFrame([(k, h, t) for k, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = [r.text for r in linededup.drop_boilerplate(frame).orderBy("doc_id").collect()]
    assert got == [rows[0][1]] * 50 + [f"item {k}" for k in range(50)]


def test_simhash_query_is_brute_force(spark):
    from importlib import util

    spec = util.spec_from_file_location("kernels", __file__.replace("queries", "kernels"))
    kernels = util.module_from_spec(spec)
    spec.loader.exec_module(kernels)
    rows = sorted((r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect())
    fps = [kernels.plain_fingerprint(t) for _, t in rows]
    root = kernels.roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = sorted((rows[i][0], f"{fps[i]:016x}", rows[root[i]][0]) for i in range(len(rows)))
    assert rows_of(queries.op6_simhash(spark, SF)) == sorted(want, key=repr)


def test_simhash_hot_buckets(spark, monkeypatch):
    """Buckets over the limit are cut in chunks and lose no link."""
    r = np.random.default_rng(6)
    base = int(r.integers(0, 2**62))
    fps = {base}
    while len(fps) < 400:
        fps.add(list(fps)[int(r.integers(0, len(fps)))] ^ (1 << int(r.integers(0, 20))))
    fps |= {int(x) for x in r.integers(0, 2**62, 50)}
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    monkeypatch.setattr(simhash, "HOT_ROWS", 64)
    got = {x.node: x.component for x in components(simhash.near_links(frame)).collect()}
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    again = {x.node: x.component for x in components(simhash.near_links(frame)).collect()}
    order = sorted(fps)
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(order)):
        for j in range(i):
            if (order[i] ^ order[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {order[i]: order[find(i)] for i in range(len(order)) if sum(find(j) == find(i) for j in range(len(order))) > 1}
    assert got == again == want


def test_simhash_odd_rows(spark, odd, empty):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (5, 1), (3, 3), (4, 3), (None, 3)} <= got and simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 6, 7, 8] and simhash.keep_one(empty).count() == 0


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (5, 5)] + [(2000, 2000 + k) for k in range(1, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000, **{2000 + k: 2000 for k in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_license_table(spark, odd, empty):
    frame = docs_of(spark, [(1, "x\nReleased under the MIT License.\n"), (1, "x\nReleased under the MIT License.\n"), (2, None)])
    assert rows_of(licenses.names_of(licenses.scan(frame))) == [(1, "MIT"), (1, "MIT"), (2, "")]
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(empty).count() == 0


def test_decontamination_table(spark, odd, empty):
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "a b"), (5, "")], "item_id long, text string")
    frame = docs_of(spark, [(1, "z " + item.upper() + "!"), (2, item.replace("lazy", "lazzy")), (3, item[: len(item) // 2]), (None, item), (4, None), (1, "z " + item.upper() + "!")])
    got = rows_of(decontam.contaminated(frame, items).select("doc_id", "item_id", "edits"))
    assert got == sorted([(d, i, e) for d, e in ((1, 0), (1, 0), (2, 1), (None, 0)) for i in (1, 2)], key=repr)
    assert sorted(r.doc_id for r in decontam.without_leaks(frame, items).collect()) == [3, 4] and decontam.without_leaks(frame, items).columns == frame.columns
    assert decontam.contaminated(odd, items).count() == 0 and decontam.contaminated(empty, items).count() == 0 and decontam.contaminated(frame, items.limit(0)).count() == 0
    small = list(decontam.blocks(items, symbols_a_block=40))
    assert len(small) > 1 and sorted(i for b in small for i in b.ids) == [1, 2]
    other = "a quite different sentence about the weather of that year"
    more = items.union(spark.createDataFrame([(6, other)], items.schema))
    frame = frame.union(docs_of(spark, [(8, other), (8, other), (9, "nothing of it")]))
    for block in (10**6, 40):  # one block, and several
        got = rows_of(decontam.contaminated(frame, more, symbols_a_block=block).select("doc_id", "item_id", "edits"))
        assert got == sorted([(d, i, e) for d, e in ((1, 0), (1, 0), (2, 1), (None, 0)) for i in (1, 2)] + [(8, 6, 0)] * 2, key=repr)
        left = decontam.without_leaks(frame, more, symbols_a_block=block)
        assert sorted(r.doc_id for r in left.collect()) == [3, 4, 9] and left.columns == frame.columns


def test_toxicity_held_out(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    got = queries.op9_toxicity(spark, sf).collect()
    held = [r for r in got if r.held_out and r.doc_id in labels]
    clean = [r for r in held if not labels[r.doc_id]]
    caught = [r.predicted for r in held if labels[r.doc_id]]
    assert len(got) == 10_000 and sum(r.predicted for r in clean) / len(clean) < 0.03 and sum(caught) / len(caught) > 0.75
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = queries.table(spark, sf, "labels").limit(0)
    assert toxicity.train(odd, none) is None and {r.score for r in toxicity.scored(odd, None).collect()} == {0.0}
    known = spark.createDataFrame([(k, k % 2) for k in (3, 4, 6, 7, 8)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, known)
    assert toxicity.scored(odd, model).count() == len(ODD) and toxicity.scored(empty, model).count() == 0 and toxicity.without_toxic(odd, None).count() == len(ODD)


def test_warc_round_trip(spark, tmp_path):
    import base64

    text = "<p>WARC/1.1\r\n\r\nü</p>\n"
    rows = [(3, "http://h.example/a?b=1#c", text), (1, "http://h.example/", text), (2, None, None), (5, "https://x.example", ""), (4, "http://i\r\nj.example/", "z" * 300_000), (None, "http://n.example/", text), (7, "u", "unique"), (7, "u", "unique")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, key string, payload string")
    path = f"file://{tmp_path}/warc"
    warc.write(warc.captures(frame), path)
    records = warc.read(spark, path)
    assert records.count() == 3 * len(rows)
    got = [(int(r.metadata.key) if r.metadata.key else None, r.metadata.payload_bytes, r.response.payload_digest, r.response.kind, r.response.refers_to, r.response.payload, r.request.kind) for r in warc.transactions(records).collect()]
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = first[h or ""] != i
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", str(first[h or ""]) if revisit else None, None if revisit else bytearray(body), "request"))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    warc.write(warc.captures(frame.limit(0)), path + "0")
    assert warc.transactions(warc.read(spark, path + "0")).count() == 0
    assert {r.record_type for r in warc.captures(frame, least_bytes=10**6).collect()} == {"response"}


def test_pipeline_is_its_stages_by_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    model = toxicity.train(docs, queries.table(spark, SF, "labels"))
    good = {r.doc_id for r in toxicity.scored(docs, model).where("predicted = 0").collect()}
    one = sorted((r.doc_id, r.source, r.text) for r in docs.collect() if r.doc_id in good)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.source, r.text) for r in kept.collect()) == one
    clean = plain_line_dedup([(s, t) for _, s, t in one], linededup.RATIO, linededup.MIN_PAGES)
    two = spark.createDataFrame([(i, t, "en", s, len(t)) for (i, s, _), t in zip(one, clean, strict=True)], docs.schema)
    assert rows_of(corpus_pipeline.drop_lines(spark, kept, SF).select("doc_id", "text", "n_chars")) == rows_of(two.select("doc_id", "text", "n_chars"))
    reps = {r.doc_id for r in simhash.near_duplicates(two).where("doc_id = component_id").collect()}
    leaked = {r.doc_id for r in decontam.contaminated(two, queries.table(spark, SF, "benchmark")).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(reps - leaked) and len(got) > 100


def test_pipeline_stages_on_odd_rows(spark):
    rows = spark.createDataFrame([(i, x, None, None, None) for i, x in ODD], queries.table(spark, SF, "documents").schema)
    for docs in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert docs.columns == rows.columns or name == names_last(), name
        assert docs.count() >= 0


def names_last():
    return corpus_pipeline.STAGES[-1][0]


def plain_near_copies(rows, least=0.8):
    """component_id by all pairs of five-word shingle sets."""
    import re

    sets = {}
    for i, text in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if j < i and len(a) * least <= len(b) and len(b) * least <= len(a) and len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_copies_are_all_pairs(spark, monkeypatch):
    """The stage's form on a whole table, with hot buckets and groups cut in chunks, and with the joins of large tables."""
    docs = queries.table(spark, SF, "documents")
    want = plain_near_copies([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == want and len(set(want.values())) < len(want)
    base = [f"w{k}" for k in range(60)]
    r = np.random.default_rng(3)
    texts = [" ".join([*base[: int(k)], f"x{n}", *base[int(k) + 1 :]]) for n, k in enumerate(r.integers(0, 60, 60))] + [" ".join(f"y{n}{k}" for k in range(40)) for n in range(20)] + ["", None]
    rows = docs_of(spark, list(enumerate(texts)))
    want = plain_near_copies(list(enumerate(texts)))
    for name, value in (("HOT_ROWS", 16), ("CHUNK_ROWS", 16), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(simhash, name, value)
    monkeypatch.setattr("echofold.llm.components.ONE_TASK", 0)
    assert {x.doc_id: x.component_id for x in simhash.near_duplicates(rows).collect()} == want
    assert sorted(x.doc_id for x in simhash.keep_one(rows).collect()) == sorted(set(want.values())) and len(set(want.values())) < 40


def test_components_over_rounds(spark, monkeypatch):
    monkeypatch.setattr("echofold.llm.components.ONE_TASK", 0)
    test_components_of_chains(spark)


def rolled(chars):
    h = 0
    for c in chars:
        h = (h * 0x01000193 % 2**32) ^ (ord(c) * 0x9E3779B1 % 2**32)
    return h


def test_langid_query_is_plain_bayes(spark):
    """Every row of the query against counts and sums made one gram at a time."""
    import math
    import unicodedata
    import zlib

    def grams(text):
        low = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
        low = " " + " ".join(low.split()) + (" " if low.split() and low.endswith(" ") else "")
        for n in langid.ORDERS:
            for k in range(len(low) - n + 1):
                h = rolled(low[k : k + n])
                yield ((h ^ (h >> 15)) * (0x85EBCA6B + 2 * n) % 2**32) >> (32 - langid.BUCKET_BITS)

    docs = queries.table(spark, SF, "documents").collect()
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 3 == 1
    langs = sorted({r.lang for r in docs if r.lang is not None and not held(r)})
    counts = {x: defaultdict(int) for x in langs}
    priors = defaultdict(int)
    for r in docs:
        if r.lang is not None and not held(r):
            priors[r.lang] += 1
            for g in grams(r.text):
                counts[r.lang][g] += 1
    total = {x: sum(counts[x].values()) + langid.SMOOTHING * langid.BUCKETS for x in langs}
    got = {r.doc_id: r for r in queries.op3_langid(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        own = got[r.doc_id]
        assert own.held_out == held(r)
        if not any(unicodedata.category(c)[0] == "L" for c in r.text or ""):
            assert (own.lang_pred, own.score) == ("und", 0.0)
            continue
        found = list(grams(r.text))
        score = {x: math.log(priors[x] / sum(priors.values())) + sum(math.log((counts[x][g] + langid.SMOOTHING) / total[x]) for g in found) for x in langs}
        best = max(langs, key=lambda x: score[x])
        assert own.lang_pred == best and own.score == pytest.approx(1 / sum(math.exp(max(-700, score[x] - score[best])) for x in langs), abs=1e-3)


def test_toxicity_scores_are_a_plain_forward_pass(spark):
    import math
    import unicodedata

    docs = queries.table(spark, SF, "documents")
    model = toxicity.train(docs, queries.table(spark, SF, "labels"))
    worth = (model["E"] @ (model["W"][1] - model["W"][0])).astype(float)

    def score(text):
        words = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in (text or "").lower()).split()
        values = []
        for w in words:
            w = f"<{w}>"
            code = [(ord(c) + 1) * 0x9E3779B1 % 2**32 for c in w]
            whole = sum(c * ((j * 2654435769 % 2**32) | 1) for j, c in enumerate(code)) % 2**32
            values.append(worth[((whole ^ (whole >> 15)) * 0xC2B2AE35 % 2**32) >> (32 - toxicity.BUCKET_BITS)])
            for n in toxicity.ORDERS:
                for k in range(len(w) - n + 1):
                    h = rolled(chr(ord(c) + 1) for c in w[k : k + n])
                    values.append(worth[((h ^ (h >> 15)) * (0x85EBCA6B + 2 * n) % 2**32) >> (32 - toxicity.BUCKET_BITS)])
        mean = sum(values) / (len(values) + toxicity.PRIOR)
        return 1 / (1 + math.exp(-(toxicity.SCALE * mean + float(model["b"][1] - model["b"][0]))))

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(texts) and all(r.score == pytest.approx(score(texts[r.doc_id]), abs=1e-6) and r.predicted == (r.score >= 0.5) for r in got)


def test_decontamination_query_is_plain_alignment(spark):
    """Every document of the table against every fifth item, by whole dynamic programming (a numpy row a step)."""
    import re

    plain = lambda text: " ".join(re.findall(r"[^\W_]+", (text or "").lower()))
    docs = {r.doc_id: plain(r.text) for r in queries.table(spark, SF, "documents").collect()}
    items = {r.item_id: plain(r.text) for r in queries.table(spark, SF, "benchmark").where("item_id % 5 = 0").collect()}
    got = {(r.doc_id, r.item_id): r.edits for r in queries.op8_decontamination(spark, SF).collect() if r.item_id % 5 == 0}
    joined = "\x00".join(docs.values())  # no symbol of an item, so no leak crosses two documents
    text = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(x) + 1 for x in docs.values()])
    owner = np.searchsorted(ends, np.arange(len(text)), "right")
    want = {}
    for j, item in items.items():
        if len(item.split()) < decontam.MIN_WORDS:
            continue
        bound = int(len(item) * 0.1)
        row = np.zeros(len(text) + 1, np.int32)
        place = np.arange(len(text) + 1)
        for c in np.frombuffer(item.encode("utf-32-le"), np.uint32):
            new = np.concatenate([[row[0] + 1], np.minimum(row[1:] + 1, row[:-1] + (text != c))])
            row = np.minimum.accumulate(new - place) + place
        for k in np.flatnonzero(row[1:] <= bound):
            pair = list(docs)[owner[k]], j
            want[pair] = min(want.get(pair, 99), int(row[k + 1]))
    assert got == want


def test_warc_query_is_plain_digests(spark):
    import base64

    pages = sorted((r.page_id, (r.html or "").encode()) for r in queries.table(spark, SF, "pages").collect())
    first = {}
    for i, body in pages:
        first.setdefault(body, i)
    want = [(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in pages]
    assert sorted(map(tuple, queries.op10_warc(spark, SF).collect())) == want


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", (100, 1000))
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    rows = spark.createDataFrame([(k, f"u{k % 7}", "x" * (40 * k)) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/warc"
    warc.write(warc.captures(rows), f"file://{path}")
    import gzip
    from pathlib import Path

    sizes = [[len(r["body"]) for r in warc.parse(gzip.decompress(f.read_bytes())) if r["fields"]["warc-type"] == "response"] for f in Path(path).glob("part-*")]
    assert all(len(x) == 1 or sum(x) < 1000 + 150 * len(x) for x in sizes) and sum(map(len, sizes)) == 60 and max(map(len, sizes)) == 3
    got = warc.transactions(warc.read(spark, f"file://{path}")).collect()
    assert sorted((int(r.metadata.key), len(r.response.payload)) for r in got) == [(k, 40 * k) for k in range(60)]


def test_ann_recall_over_many_parts(spark, monkeypatch):
    """With 64 parts and cells that split, recall of the table's own nearest stays 0.9 or more."""
    monkeypatch.setattr(ann, "PART_ROWS", 80)
    monkeypatch.setattr(ann, "CELL_ROWS", 50)
    monkeypatch.setattr(ann, "LEAST_SAMPLE", 2048)
    monkeypatch.setattr(ann, "SAMPLE_A_PART", 32)
    rows = queries.table(spark, "/root/testdata/sf0.1", "embeddings")
    found = ann.search(rows, F.col("vec_id") % 20 == 0).toPandas()
    data = rows.toPandas()
    keys, X = data.vec_id.to_numpy(), np.stack(data.embedding).astype(float)
    asks = np.flatnonzero(keys % 20 == 0)
    scores = X[asks] @ X.T
    scores[np.arange(len(asks)), asks] = -np.inf
    best = keys[np.argsort(-scores, axis=1)[:, :20]]
    got = found.groupby("query_id").vec_id.apply(set)
    assert found.groupby("query_id").size().eq(20).all() and len(got) == len(asks)
    assert np.mean([len(got[q] & set(x)) / 20 for q, x in zip(keys[asks], best, strict=True)]) >= 0.9


def test_ann_gives_k_rows_from_uneven_and_tiny_parts(spark, monkeypatch):
    """Most rows in one direction, few in many others, some keys repeated often: each query still gets k rows or all there are."""
    monkeypatch.setattr(ann, "PART_ROWS", 10)
    monkeypatch.setattr(ann, "LEAST_SAMPLE", 256)
    monkeypatch.setattr(ann, "SAMPLE_A_PART", 8)
    monkeypatch.setattr(ann, "TARGET", 0.0)  # one part is enough but for the count
    rng = np.random.default_rng(6)
    lonely = rng.normal(0, 1, (60, 8)) * 5
    X = np.concatenate([np.array([3.0] + [0.0] * 7) + rng.normal(0, 0.05, (700, 8)), lonely])
    keys = [*range(740), *[740] * 20]
    frame = spark.createDataFrame([(k, x.tolist()) for k, x in zip(keys, X, strict=True)], "vec_id long, embedding array<double>")
    found = ann.search(frame, F.col("vec_id") % 20 == 0, 20).groupBy("query_id").agg(F.collect_list("rank").alias("r"), F.collect_list("vec_id").alias("x")).collect()
    assert {r.query_id for r in found} == {k for k in keys if k % 20 == 0}
    assert all(sorted(r.r) == list(range(1, 21)) and r.query_id not in r.x for r in found)
    few = frame.where("vec_id < 12")
    assert {r["count"] for r in ann.search(few, F.col("vec_id") < 3, 20).groupBy("query_id").count().collect()} == {11}


def test_ann_keeps_neighbours_of_long_vectors():
    """Scores are small against the vectors' lengths, so that products round; the exact order stands."""
    rng = np.random.default_rng(7)
    X = rng.normal(0, 1, (400, 64)) * 1e8
    Q = rng.normal(0, 1, (5, 64))
    X -= X @ np.linalg.pinv(Q) @ Q
    q, x, s = ann.best_of(np.arange(5) + 1000, Q, np.arange(400), X, 20)
    for k in range(5):
        exact = (Q[k] * X).sum(axis=1)
        assert x[q == 1000 + k].tolist() == np.lexsort((np.arange(400), -exact))[:20].tolist()
