"""The operators' kernels against plain versions of the same definitions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from echofold.llm import ann, bpe, components, decontam, html_extract, html_pages, langid, licenses, simhash, toxicity, warc
from echofold.llm.queries import tokenizer_path

POOL = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "don't", "1", "23", "é", "ß", "漢字", "😀", " ", "\t", "<|endoftext|>", "<|end", "!", "??", "_", "the ", "'ll", "'S", "　", "ⅷ", "²", "́", "ext|>", "ababab", "aaaaaaaa", "\x85", "\x1c", "...", "\r\n"]


@pytest.fixture(scope="module")
def index():
    return bpe.load(tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_is_the_library(index, library):
    r = random.Random(3)
    texts = ["".join(r.choices(POOL, k=r.randint(0, 25))) for _ in range(3000)] + ["", "a" * 5000, " " * 999, "ab" * 999, "'" * 50, None]
    for split in (1, 3):
        columns = [pa.array(texts[k::split], pa.string()) for k in range(split)]
        for k, (ids, bounds) in enumerate(index.encode_block(columns)):
            own = texts[k::split]
            back = index.decode(ids, bounds).to_pylist()
            for i, (text, want) in enumerate(zip(own, library.encode_batch([x or "" for x in own], add_special_tokens=False), strict=True)):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == want.ids, text
                assert back[i] == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_decodes_any_ids(index, library):
    r = np.random.default_rng(0)
    rows = [r.integers(0, 50257, n).astype(np.int32) for n in r.integers(0, 9, 300)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    assert index.decode(np.concatenate(rows), bounds).to_pylist() == [library.decode(x.tolist(), skip_special_tokens=False) for x in rows]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    texts = ["", None, "One", "one TWO", "A b c", "a b c d a b c d", "É é x\x0by\x1cz  w v", " ".join(f"w{k % 7}" for k in range(500))]
    assert simhash.fingerprints_of(pa.array(texts, pa.string())).tolist() == [plain_fingerprint(x) for x in texts]


def roots(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 60), st.integers(0, 5))
def test_trie_forest_spans_all_links(seed, n, flips):
    r = np.random.default_rng(seed)
    fp = r.integers(0, 2**63, 4, dtype=np.uint64)[r.integers(0, 4, n)]
    for _ in range(flips):
        fp = np.where(r.random(n) < 0.6, fp ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)), fp)
    unit = r.integers(0, 3, n)
    unit, fp = (x.ravel() for x in np.unique(np.stack([unit.astype(np.uint64), fp]), axis=1))
    a, b = simhash.trie_forest(unit.astype(np.int64), fp)
    distinct = {int(x): k for k, x in enumerate(np.unique(fp))}
    near = [(distinct[int(fp[i])], distinct[int(fp[j])]) for i in range(len(fp)) for j in range(i) if unit[i] == unit[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 3]
    assert roots(len(distinct), [(distinct[int(x)], distinct[int(y)]) for x, y in zip(a, b, strict=True)]) == roots(len(distinct), near)
    assert len(a) < max(1, len(fp))


def test_forest():
    a, b = components.forest(np.array([5, 7, 1, 9]), np.array([3, 5, 2, 9]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {5: 3, 7: 3, 2: 1}


def edits_within(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def plain_symbols(text):
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def test_leaks_are_those_of_plain_alignment():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcde", k=r.randint(2, 6)))
    items = [" ".join(word() for _ in range(r.randint(5, 30))) for _ in range(12)] + [" ".join(r.choices("abcdefg", k=5) + ["xyzuvw"[: r.randint(1, 6)]]) + "q" * k for k in range(0, 18, 3)] + ["too short", None or "one two three four five"]
    texts = []
    for _ in range(140):
        text = " ".join(word() for _ in range(r.randint(0, 60)))
        if r.random() < 0.7:
            leak = list(r.choice(items))
            for _ in range(r.randint(0, max(2, len(leak) // 8))):
                k = r.randrange(len(leak) + 1)
                leak[k : k + r.randint(0, 1)] = r.choice(["", "x", "Q", "!"])
            at = r.randint(0, len(text))
            text = text[:at] + " " + "".join(leak).upper() + " " + text[at:]
        texts.append(text)
    held = decontam.Items.of(list(range(len(items))), items)
    row, item, edits = decontam.leaks(held, pa.array([*texts, None, ""], pa.string()))
    got = {(int(a), int(held.ids[b])): int(c) for a, b, c in zip(row, item, edits, strict=True)}
    want = {}
    for i, text in enumerate(texts):
        for j, x in enumerate(items):
            x = plain_symbols(x)
            if len(x.split()) >= decontam.MIN_WORDS:
                k = edits_within(x, plain_symbols(text))
                if k <= int(len(x) * 0.1):  # a tenth of the item, whatever its length
                    want[i, j] = k
    assert got == want and len(got) > 15 and any(got.values())
    assert any(c == int(len(plain_symbols(items[j])) * 0.1) > 0 and len(plain_symbols(items[j])) < 32 for (_, j), c in got.items())


def alignments(items, texts):
    """(text, item): fewest edits, within a tenth, by plain alignment of all pairs."""
    out = {}
    for j, x in enumerate(map(plain_symbols, items)):
        for i, text in enumerate(map(plain_symbols, texts)):
            if len(x.split()) >= decontam.MIN_WORDS and (k := edits_within(x, text)) <= int(len(x) * decontam.EDITS):
                out[i, j] = k
    return out


@pytest.mark.parametrize("hot,heavy,chunk", [(64, 512, 1 << 20), (2, 5, 1 << 20), (2, 3, 40), (0, 4, 300), (10**6, 512, 100)])
def test_leaks_of_items_that_share_phrases(monkeypatch, hot, heavy, chunk):
    """Openings shared by all items, templates that differ in a word, equal items; against plain alignment of all pairs."""
    for name, value in (("HOT", hot), ("HEAVY_ITEMS", heavy), ("CHUNK", chunk)):
        monkeypatch.setattr(decontam, name, value)
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(3, 8)))
    opening, frame = "which of the following is best", "name the town in which the poet %s was born and went to school"
    items = [f"{opening} {word()} {word()} {word()} {word()} {word()}" for _ in range(14)] + [frame % word() for _ in range(8)]
    items += [items[0], items[0].upper(), items[15]]
    texts = [f"{opening}. " * 12, (frame % "x") + " " + (frame % word()), items[3] + "! " + f"{opening}: " * 3 + items[15], " ".join(word() for _ in range(60))]
    for _ in range(8):
        leak = list(r.choice(items))
        for _ in range(r.randint(0, 9)):
            leak[r.randrange(len(leak))] = r.choice("xyz")
        texts.append(f"{opening} " * r.randint(0, 3) + "".join(leak) + f" {word()}" * r.randint(0, 9))
    held = decontam.Items.of(list(range(len(items))), items)
    row, item, edits = decontam.leaks(held, pa.array(texts, pa.string()))
    got = {(int(a), int(held.ids[b])): int(c) for a, b, c in zip(row, item, edits, strict=True)}
    assert got == alignments(items, texts) and len(got) == len(row) > 15


def test_leaks_of_a_phrase_that_thousands_of_items_share():
    """8,000 items with one opening, and a megabyte that repeats it; one item stands in its middle with two edits."""
    import resource
    import time

    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=r.randint(4, 9)))
    opening = "which one of the following statements"
    items = [f"{opening} {word()} {word()} {word()} {word()} {word()} {word()}" for _ in range(8000)]
    held = decontam.Items.of(list(range(len(items))), items)
    text = f"{opening} is so. " * 11_000
    half = len(text) // 2
    text = text[:half] + " " + items[4321].replace(" ", "  ", 2)[:-1] + "z " + text[half:]
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    row, item, edits = decontam.leaks(held, pa.array([text], pa.string()))
    assert [(int(a), int(held.ids[b]), int(c)) for a, b, c in zip(row, item, edits, strict=True)] == [(0, 4321, 1)]
    assert time.perf_counter() - began < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_html_model():
    model = html_extract.trained()
    right = total = 0
    for seed in range(5000, 5060):
        page = html_extract.Page(html_pages.labelled_page(seed))
        y, p = html_extract.labels_of(page), html_extract.marginals([page], model)[0]
        texts = [k for k, tag in enumerate(page.tag) if tag == "#"]
        right += sum((p[k] >= 0.5) == y[k] for k in texts)
        total += len(texts)
    assert right / total > 0.98


def test_sum_product_is_enumeration():
    r = np.random.default_rng(1)
    up = [-1, 0, 0, 1, 1, 2]
    forest = html_extract.forest_of([([[] for _ in up], r.integers(0, 3, len(up)), up)], {})
    unary, edge = r.normal(size=len(up)), r.normal(size=(3, 2, 2))
    belief, pair, z = html_extract.sum_product(forest, unary, edge)
    weights = {}
    for k in range(2 ** len(up)):
        y = [k >> i & 1 for i in range(len(up))]
        weights[tuple(y)] = np.exp(sum(u * v for u, v in zip(unary, y, strict=True)) + sum(edge[forest["kind"][i], y[p], y[i]] for i, p in enumerate(up) if p >= 0))
    total = sum(weights.values())
    assert z == pytest.approx(np.log(total))
    for i in range(len(up)):
        assert np.exp(belief[i, 1] - np.logaddexp(*belief[i])) == pytest.approx(sum(w for y, w in weights.items() if y[i]) / total)
    assert np.exp(pair[3, 1, 0] - z) == pytest.approx(sum(w for y, w in weights.items() if y[1] == 1 and y[3] == 0) / total)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li><li><a href='/b'>More</a></li></ul></nav><!-- x --><div class="ad">Buy now cheap things.</div>
<article><h1>Fish &amp; chips &lt;3</h1><p><b>Bold
  start.<br>next<p>Caf&eacute; &#x41;&amp b.</p><div class="ad">Buy more.</div><section class="comments"><p>First!</p></section></article><footer>&copy; 2024</footer></body></html>"""


def test_extraction():
    model = html_extract.trained()
    assert html_extract.extract_texts([PAGE, None, "", "<p", "<!-- "], model) == ["Fish & chips <3 Bold start. next Café A& b.", "", "", "", ""]


def test_langid_grams():
    text, bounds = langid.letters_of(pa.array(["Ab, c!", "", None, "123", "É"], pa.string()))
    assert ["".join(map(chr, text[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [" ab c ", " ", " ", " ", " é"]
    for bucket, own in langid.grams(text, bounds):
        assert own[0] == 0 and own[-1] == len(bucket) and (np.diff(own) >= 0).all()


def test_subwords_of_a_misspelling():
    flat, bounds, token, rows = toxicity.words_of(pa.array(["Idiot idi0t, idiot", None, "..."], pa.string()))
    assert token.tolist() == [0, 1, 0] and rows.tolist() == [0, 3, 3, 3]
    bucket, own = toxicity.subwords(flat, bounds)
    a, b = (set(bucket[own[k] : own[k + 1]].tolist()) for k in (0, 1))
    # of the grams of <idiot>, those without the changed letter are shared: <id, idi, <idi
    assert len(a & b) == 3 and len(a) == len(b) == 5 + 4 + 3 + 1
    ids, share, at = toxicity.bags(pa.array(["one two one", "", None, "x"], pa.string()))
    assert [round(float(share[p:q].sum()), 5) for p, q in zip(at[:-1], at[1:], strict=True)] == [round(n / (n + toxicity.PRIOR), 5) for n in (21, 0, 0, 2)]


def test_toxicity_learns_what_it_can_see():
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 7)))
    make = lambda bad, forms: " ".join(word() for _ in range(40)) + (" " + " ".join(r.choices(forms, k=3)) if bad else "")
    y = np.arange(600) % 2
    model = toxicity.fit(toxicity.bags(pa.array([make(k, ["zmorvonz", "quixxist"]) for k in y])), y, np.ones(600, np.float32))
    seen = toxicity.scores(pa.array([make(k, ["zmorvonz"]) for k in y[:200]]), model)
    misspelt = toxicity.scores(pa.array([make(k, ["zmorvvonz", "zmorvonzz", "quixxlist"]) for k in y[:200]]), model)
    assert ((seen >= 0.5) == y[:200]).mean() > 0.97 and ((misspelt >= 0.5) == y[:200]).mean() > 0.9


def test_license_rules():
    assert all(re.search("|".join(licenses.ANCHORS), s) for s in licenses.KNOWN)
    mit = "The MIT License\n\n" + ".\n".join(licenses.SENTENCES[k][0].replace(" of ", "\nof ") for k in ("mit-grant", "mit-notice", "as-is")) + "."
    assert licenses.licenses_of(licenses.sentence_ids(mit)) == ["MIT"]
    assert licenses.licenses_of(licenses.sentence_ids("x.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0. The end")) == ["CC-BY-NC-4.0", "MIT"]
    assert licenses.sentence_ids("we are licensed under the Apache License, Version 2.0 here") == [] and licenses.licenses_of(["mit-notice"]) == []
    assert licenses.licenses_of(["apache-named", "mit-named", "apache-comply"]) == ["Apache-2.0", "MIT"]
    for name, rule in licenses.RULES:  # each rule's own text, its sentences wrapped over lines, states that license
        text = "Notice\n\n" + ".\n".join(licenses.SENTENCES[k][0].replace(" or ", "\nor ") for k in rule) + ".\nThe end"
        assert name in licenses.licenses_of(licenses.sentence_ids(text)), name


def test_warc_parser_goes_by_length():
    body = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\nx"
    digest = __import__("base64").b32encode(hashlib.sha1(body[19:]).digest()).decode()
    record = lambda kind, body, more="": f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}>\r\nWARC-Target-URI: \r\n{more}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    file = record("response", body, f"WARC-Payload-Digest: sha1:{digest}\r\n") + record("request", b"")
    rows = list(warc._rows(file))
    assert [r[0] for r in rows] == ["response", "request"] and rows[0][8] == body[19:] and rows[0][7] == len(body) - 19
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(file[: len(file) - 60][: file.index(b"WARC-Type: request") - 20]))


def test_ann_kernels():
    r = np.random.default_rng(4)
    X = r.normal(size=(400, 16)).astype(np.float32)
    part = ann.partition(X, ann.graph(X, 8), 8)
    assert np.bincount(part).min() == np.bincount(part).max() == 50
    keys = np.arange(400)
    q, x, s = ann.best_of(keys[:30], X[:30].astype(float), keys, X.astype(float), 20)
    scores = X[:30].astype(float) @ X.T.astype(float)
    for k in range(30):
        order = sorted((j for j in range(400) if j != k), key=lambda j: (-scores[k, j], j))[:20]
        assert x[q == k].tolist() == order
    copies = np.repeat(X[:1], 50, axis=0).astype(float)
    q, x, s = ann.best_of(np.array([7]), X[:1].astype(float), np.arange(50)[::-1].copy(), copies, 20)
    assert x.tolist() == [j for j in range(21) if j != 7] and len(set(s.tolist())) == 1


def plain_set(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_shingle_sets():
    from echofold.llm import shingle_sets

    texts = ["", None, "One", "one TWO", "a b c d e", "A b c d e f a b c d e", "É é x\x0by\x1cz  w v", " ".join(f"w{k % 7}" for k in range(500)), "one"]
    code, at = shingle_sets.sets_of(pa.array(texts, pa.string()))
    assert np.diff(at).tolist() == [len(plain_set(x)) for x in texts]
    cls = shingle_sets.digests(code, at).tolist()
    assert [cls[i] == cls[j] for i in range(len(texts)) for j in range(i)] == [plain_set(texts[i]) == plain_set(texts[j]) for i in range(len(texts)) for j in range(i)]
    fp, keys = shingle_sets.fingerprints(code, at), shingle_sets.bands(code, at)
    assert fp.shape == (len(texts), shingle_sets.FP_WORDS) and not fp[:2].any() and not keys[:2].any() and (keys[2] == keys[8]).all() and (fp[2] == fp[8]).all()


def test_similar_sets_are_those_of_all_pairs():
    from echofold.llm import shingle_sets

    r = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{r.randint(0, 500)}" for _ in range(r.randint(20, 80))]
        for _ in range(r.randint(1, 8)):
            own = list(base)
            for _ in range(r.randint(0, 2)):
                own[r.randrange(len(own))] = f"x{r.randint(0, 99)}"
            texts.append(" ".join(own))
    code, at = shingle_sets.sets_of(pa.array(texts))
    fp = shingle_sets.fingerprints(code, at)
    sets = [plain_set(x) for x in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    i, j = shingle_sets.similar(np.zeros(len(texts), int), fp, code, at, 0.8, 128)
    assert roots(len(texts), zip(i.tolist(), j.tolist(), strict=True)) == roots(len(texts), near) and len(near) > 10
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in zip(i, j, strict=True))
    side = np.arange(len(texts)) % 2
    i, j = shingle_sets.similar(side, fp, code, at, 0.8, 128)
    assert roots(len(texts), zip(i.tolist(), j.tolist(), strict=True)) == roots(len(texts), [(a, b) for a, b in near if side[a] != side[b]])
    # the budget of bits that the stage allows loses none of these
    assert max(np.bitwise_count(fp[a] ^ fp[b]).sum() for a, b in near) <= simhash.SET_BUDGET


def test_html_and_licenses_of_one_long_text():
    """Time grows with the length: a megabyte of open elements, of stray ends, of an open quote, and of one notice."""
    import time

    model = html_extract.trained()
    n = 1 << 20
    began = time.perf_counter()
    for page in ("<div>x" * (n // 6), "<div>x" + "</b>" * (n // 4), "<p>a" * (n // 4), '<a x="' + ">" * n, "<i>" * (n // 8) + "word " + "</i>" * (n // 8) + "<p>end of the text</p>"):
        html_extract.extract_texts([page], model)
    assert time.perf_counter() - began < 90
    deep = html_extract.Page("<div>" * 600 + "in" + "</div>" * 600 + "<p>out</p>")
    out = deep.text.index("out")
    assert deep.parent[deep.parent[out]] == 0
    began = time.perf_counter()
    assert licenses.licenses_of(licenses.sentence_ids("MIT License\n" * (n // 12))) == ["MIT"]
    assert time.perf_counter() - began < 20


def plain_licenses(ids, gap):
    left, names = list(ids), set()
    for name, rule in sorted(licenses.RULES, key=lambda r: -len(r[1])):
        k = 0
        while k < len(left):
            places = [k] if left[k] == rule[0] else []
            for want in rule[1:] if places else []:
                hit = [j for j in range(places[-1] + 1, min(len(left), places[-1] + gap + 2)) if left[j] == want]
                if not hit:
                    break
                places.append(hit[0])
            if places and len(places) == len(rule):
                names.add(name)
                left = [x for j, x in enumerate(left) if j not in places]
            else:
                k += 1
    return sorted(names)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["mit-named", "mit-grant", "mit-notice", "as-is", "apache-named", "apache-comply", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "gpl-hope"]), max_size=14))
def test_license_rules_are_a_plain_search(ids):
    assert licenses.licenses_of(ids) == plain_licenses(ids, licenses.GAP)
