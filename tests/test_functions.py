"""Scalar facts: every vector is one of FIXTURES.md or of the operator's definition."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echofold.functions import images, parse, present, text
from echofold.functions.similarity import jaro_winkler, narrative_match, pair_scores


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").select("r").collect()]


NORMS = {"Thürsdáy Arena": "thursdayarena", "The Thursday Arena Token": "thursdayarena", "Solaris": "solaris", "!!!": "", "Foo 1.0": "foo10", "Foo v1.0": "foov10", "𝐅𝐎𝐎 Coin": "FOO", "ソーラー": "ソラ", "coinй": "и", "the²": "the2", "Ⅱ": "", "½ coin": "12", "a_coin_b": "ab"}


def test_normalize(spark):
    assert column(spark, [*NORMS, None], text.normalize) == [*NORMS.values(), None]


def test_diacritics_are_those_of_the_property():
    known = text.code_points(text.DIACRITIC)
    assert len(known) == 1247 and {0x5E, 0x60, 0x301, 0x1ADB, 0x1E94A} <= known and 0x363 not in known
    assert text.normalized("coin\u1adbx") == "coinx" and text.normalized("a\u02b9b") == "ab" and text.normalized("a\u0363b") == "ab"
    assert text.code_points(" 41 61-63\n") == {0x41, 0x61, 0x62, 0x63}


def test_normalize_with_a_table_of_its_own():
    assert text.normalized("coin\u1adbx", text.char_table({0x1ADB})) == "coinx" and text.normalized("coin\u1adbx", text.char_table(())) == "x"


def test_compact_number(spark):
    cases = {"$44.8K": 44800.0, "$1.11M": 1110000.0, "17,588": 17588.0, "2b": 2e9, "500+": 500.0, "—": None, "0.0₂4": None, "44.8Q": None, ",": None, "": None, " $5 ": 5.0, "$ 3.05K": 3050.0, None: None}
    assert column(spark, list(cases), parse.compact_number) == pytest.approx(list(cases.values()))


def test_age(spark):
    cases = {"5s": 5, "9m": 540, "1h 30m": 5400, "2d 4h": 187200, "9": None, "9y": None, "1.5h": 5400, "": None, None: None}
    assert column(spark, list(cases), parse.age_seconds) == list(cases.values())


def test_mints(spark):
    mint = "M" + "1" * 35
    cases = {f"/meme/{mint}": mint, f"https://a.b/meme/{mint}?x=1#y": mint, "/meme/trending": None, "/meme/%ZZ": None, f"/coin/{mint}": None, f"/meme/%4D{'1' * 35}": mint, None: None}
    assert column(spark, list(cases), parse.mint_from_href) == list(cases.values())
    pairs = [("M111...1111", True), ("M111…2222", False), ("...", True), (None, True), ("a...b...c", True), ("M..", True)]
    assert column(spark, [x for x, _ in pairs], lambda c: parse.truncated_matches(c, F.lit(mint))) == [ok for _, ok in pairs]


def test_clean_text_and_urls(spark):
    assert column(spark, ["  a  \n b ", " ", "", None], text.clean_text) == ["a b", None, None, None]
    cases = {"/i/x.png": "https://h.example/i/x.png", "data:image/png;base64,xx": None, "BLOB:x": None, "//c.example/a b.png": "https://c.example/a%20b.png", "HTTPS://C.example": "https://c.example/", "": None, None: None}
    assert column(spark, list(cases), lambda c: parse.clean_image_url(c, "https://h.example/")) == list(cases.values())
    assert column(spark, ["MC: ", " mkt cap ::"], text.label_key) == ["MC", "MKT CAP"]


def test_trigrams_and_bands(spark):
    assert column(spark, ["bananana", "ab", "", None, "𝐅𝐎𝐎é漢"], text.trigrams) == [["ban", "ana", "nan"], [], [], [], ["𝐅𝐎𝐎", "𝐎𝐎é", "𝐎é漢"]]
    assert column(spark, ["0F0f0f0f0f0f0f0a", "xyz", None], text.phash_bands) == [["0:0f0f", "1:0f0f", "2:0f0f", "3:0f0a"], [], []]
    eleven = column(spark, ["0f0f0f0f0f0f0f0a"], lambda c: text.phash_bands(c, 11))[0]
    assert len(eleven) == 11 and sum(len(x.split(":")[1]) for x in eleven) == 64


def plain_jaro_winkler(a, b):
    """The definition, for one pair."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = set(), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in taken and b[j] == c:
                taken.add(j)
                left.append(c)
                break
    if not left:
        return 0.0
    right = [b[j] for j in sorted(taken)]
    m, t = len(left), sum(x != y for x, y in zip(left, right)) / 2
    score = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return score if score < 0.7 else score + prefix * 0.1 * (1 - score)


def test_jaro_winkler_vectors():
    got = jaro_winkler(["martha", "dixon", "abc", "abcd", "abcdef", "cupcake", "", "x"], ["marhta", "dicksonx", "cab", "abdc", "bcadef", "zogcash", "", ""])
    assert got == pytest.approx([0.961111, 0.813333, 0, 0.933333, 0.916667, 0.523810, 1, 0], abs=1e-6)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abcde", max_size=9), st.text("abcde", max_size=9)), min_size=1, max_size=8))
def test_jaro_winkler_is_the_definition(pairs):
    assert jaro_winkler([a for a, _ in pairs], [b for _, b in pairs]) == pytest.approx([plain_jaro_winkler(a, b) for a, b in pairs])


def test_narrative_match(spark):
    rows = spark.createDataFrame([("thursdayarena", "thursday", "cupcake", "thursdayarena", "", ""), ("ab", "", "ab", "", "u", "u"), ("ab", "", "ab", "", "", ""), (None, "xyz", "xyz", None, "", "")], "n string, s string, m string, t string, u string, w string")
    found = rows.select(narrative_match(pair_scores(F.col("n"), F.col("s"), F.col("m"), F.col("t")), 0.9, F.col("u"), F.col("w")).alias("r")).collect()
    assert found[0].r.similarity == 1.0 and found[0].r.matchedOn == ["name"] or found[0].r.matchedOn == ["symbol", "name"] or found[0].r.matchedOn == ["name", "symbol"]
    assert found[1].r.matchedOn == ["metadata"] and found[2].r is None and found[3].r.matchedOn == ["symbol"]


def plane(shade):
    y, x = np.mgrid[0:32, 0:32]
    return np.clip(np.round(shade(x, y)), 0, 255)


CIRCLE = plane(lambda x, y: np.where(np.hypot(x - 16, y - 16) < 32 / 3, 230.0, 25.0))
FACE = plane(lambda x, y: np.where(np.hypot(x - 16, y - 16) < 32 / 3, np.where((np.hypot(x - 12, y - 12) < 3) | (np.hypot(x - 20, y - 12) < 3), 20.0, 235.0), 30.0))


def distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_image_hashes():
    found = images.hash_planes(np.stack([CIRCLE, np.clip(CIRCLE + 20, 0, 255), np.roll(CIRCLE, 1, axis=1), FACE, 255 - CIRCLE, np.full((32, 32), 90.0)]))
    assert found.hash[0] == "97686887659e9699" and found.variance[0] == pytest.approx(9543.37, abs=0.01)
    assert [distance(found.hash[0], found.hash[k]) for k in (1, 2, 3, 4)] == [0, 0, 16, 62]
    assert found.hash[5] is None and found.failure[5] == "degenerate"


def test_pixel_column_and_hamming(spark):
    rgba = np.repeat(CIRCLE.astype(np.uint8).reshape(-1, 1), 4, axis=1).tobytes()
    got = column(spark, [bytearray(rgba), bytearray(b"short"), None], images.hash_pixels, "binary")
    assert [(r.hash, r.failure) for r in got] == [("97686887659e9699", None), (None, "unavailable"), (None, "unavailable")]
    cases = [("0" * 16, "0" * 13 + "3ff", 10, True), ("0" * 16, "0" * 13 + "7ff", 11, False), ("0" * 16, "0" * 15, None, False), ("f" * 16, "0" * 16, 64, False), (None, "0" * 16, None, False), ("g" * 16, "0" * 16, None, False)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], "i int, a string, b string")
    d = images.hamming(F.col("a"), F.col("b"))
    assert [(r.d, r.m) for r in rows.select("i", d.alias("d"), images.images_match(d).alias("m")).orderBy("i").collect()] == [(n, m) for _, _, n, m in cases]


def test_presentation(spark):
    assert column(spark, [999.4, 1250.0, 2.5e6, 3e9, None], present.format_usd, "double") == ["$999", "$1.3K", "$2.50M", "$3.00B", None]
    assert column(spark, [0, 60_000, 3_600_000, 47 * 3_600_000, 72 * 3_600_000], present.format_age, "long") == ["1 min", "1 min", "1 h", "47 h", "3 days"]
    assert column(spark, [0], lambda c: present.format_age(c, "not yet"), "long") == ["not yet"]
    assert column(spark, [0, 1_758_300_000_000], present.format_date, "long") == ["1970-01-01", "2025-09-19"]


def test_texts_go_through_python_in_pieces(monkeypatch):
    """A large batch is held a piece at a time, and nothing of it is lost."""
    import pyarrow as pa

    from echofold.functions import pieces

    texts = ["a" * 10, None, "", "b" * 30, "c" * 7, "a" * 10, "é" * 5, "c" * 7]
    column = pa.array(["x", *texts]).slice(1)
    assert list(pieces.pieces(column, 20)) == [(0, 3), (3, 1), (4, 2), (6, 2)] and list(pieces.pieces(column.slice(0, 0), 20)) == []
    monkeypatch.setattr(pieces, "PIECE_BYTES", 20)
    assert pieces.mapped(column, str.upper).to_pylist() == [x and x.upper() for x in texts]
