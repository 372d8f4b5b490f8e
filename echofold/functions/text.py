"""Text keys. Built-in functions throughout but for normalize(), which needs NFKD and is an Arrow UDF over distinct values."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.functions.pieces import mapped

#: Words that clones add or drop freely.
FILLER = ["coin", "token", "sol", "solana", "official", "the", "v2", "ii"]
#: White space as the browser's \s has it, as a Java character class.
WHITE = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: Code points of the Unicode property Diacritic, in hexadecimal, ranges with both ends.
DIACRITIC = """
5e 60 a8 af b4 b7-b8 2b0-34e 350-357 35d-362 374-375 37a 384-385 483-487 559 591-5bd 5bf 5c1-5c2 5c4-5c5 5c7
64b-652 657-658 6df-6e0 6e5-6e6 6ea-6ec 730-74a 7a6-7b0 7eb-7f5 818-819 898-89f 8c9-8d2 8e3-8fe 93c 94d
951-954 971 9bc 9cd a3c a4d abc acd afd-aff b3c b4d b55 bcd c3c c4d cbc ccd d3b-d3c d4d dca e3a e47-e4c e4e
eba ec8-ecc f18-f19 f35 f37 f39 f3e-f3f f82-f84 f86-f87 fc6 1037 1039-103a 1063-1064 1069-106d 1087-108d 108f
109a-109b 135d-135f 1714-1715 1734 17c9-17d3 17dd 1939-193b 1a60 1a75-1a7c 1a7f 1ab0-1abe 1ac1-1acb 1acf-1add
1ae0-1aeb 1b34 1b44 1b6b-1b73 1baa-1bab 1be6 1bf2-1bf3 1c36-1c37 1c78-1c7d 1cd0-1ce8 1ced 1cf4 1cf7-1cf9
1d2c-1d6a 1d9b-1dbe 1dc4-1dcf 1df5-1dff 1fbd 1fbf-1fc1 1fcd-1fcf 1fdd-1fdf 1fed-1fef 1ffd-1ffe 2cef-2cf1 2e2f
302a-302f 3099-309c 30fc a66f a67c-a67d a67f a69c-a69d a6f0-a6f1 a700-a721 a788-a78a a7f1 a7f8-a7f9 a806 a82c
a8c4 a8e0-a8f1 a92b-a92e a953 a9b3 a9c0 a9e5 aa7b-aa7d aabf-aac2 aaf6 ab5b-ab5f ab69-ab6b abec-abed fb1e
fe20-fe2f ff3e ff40 ff70 ff9e-ff9f ffe3 102e0 10780-10785 10787-107b0 107b2-107ba 10a38-10a3a 10a3f
10ae5-10ae6 10d22-10d27 10d4e 10d69-10d6d 10efa 10efd-10eff 10f46-10f50 10f82-10f85 11046 11070 110b9-110ba
11133-11134 11173 111c0 111ca-111cc 11235-11236 112e9-112ea 1133b-1133c 1134d 11366-1136c 11370-11374
113ce-113d0 113d2-113d3 113e1-113e2 11442 11446 114c2-114c3 115bf-115c0 1163f 116b6-116b7 1172b 11839-1183a
1193d-1193e 11943 119e0 11a34 11a47 11a99 11c3f 11d42 11d44-11d45 11d97 11dd9 11f41-11f42 11f5a 13447-13455
1612f 16af0-16af4 16b30-16b36 16d6b-16d6c 16f8f-16f9f 16ff0-16ff1 1aff0-1aff3 1aff5-1affb 1affd-1affe
1cf00-1cf2d 1cf30-1cf46 1d167-1d169 1d16d-1d172 1d17b-1d182 1d185-1d18b 1d1aa-1d1ad 1e030-1e06d 1e130-1e136
1e2ae 1e2ec-1e2ef 1e5ee-1e5ef 1e8d0-1e8d6 1e944-1e946 1e948-1e94a
"""
_FILLER = re.compile(r"\b(?:" + "|".join(FILLER) + r")\b", re.ASCII)


#: The same white space as characters.
WHITE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def code_points(ranges: str) -> frozenset[int]:
    """The code points of ranges written as DIACRITIC is."""
    ends = [[int(end, 16) for end in part.split("-")] for part in ranges.split()]
    return frozenset(cp for part in ends for cp in range(part[0], part[-1] + 1))


def char_table(diacritics: Iterable[int] | None = None) -> dict[int, str | None]:
    """A lazy translation table: letters and numbers stay, diacritics go, all else is a blank. diacritics: code points in place of DIACRITIC."""

    class Table(dict):
        def __missing__(self, cp: int) -> str | None:
            self[cp] = value = None if cp in gone else chr(cp) if unicodedata.category(chr(cp))[0] in "LN" else " "
            return value

    gone = code_points(DIACRITIC) if diacritics is None else frozenset(diacritics)
    return Table()


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    return char_table()


def normalized(value: str, table: dict | None = None) -> str:
    """Case, compatibility forms, accents, punctuation, filler words and spaces folded away; case first, so capitals that NFKD makes stay."""
    if value.isascii():
        plain = re.sub(r"[^a-z0-9^`]+", " ", value.lower()).replace("^", "").replace("`", "")
    else:
        plain = unicodedata.normalize("NFKD", value.lower()).translate(_table() if table is None else table)
    return "".join(_FILLER.sub(" ", plain).split())


@F.arrow_udf(T.StringType())
def _normalize(values: pa.Array) -> pa.Array:
    return mapped(values, normalized)


def normalize(value: Column) -> Column:
    return _normalize(value)


def trigrams(value: Column, min_length: int = 3) -> Column:
    """Distinct 3-grams in order of first place; none below min_length."""
    at = lambda chars, i: F.get(chars, i.cast("int"))
    whole = lambda chars: F.transform(F.sequence(F.lit(0), F.size(chars) - 3), lambda i: F.concat(at(chars, i), at(chars, i + 1), at(chars, i + 2)))
    grams = bound(F.split(value, ""), whole)  # places in a string are found from its start, which takes long in long texts
    return F.when(F.length(value) >= max(3, min_length), F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def text_trigrams(norm_name: Column, norm_symbol: Column, min_length: int = 3) -> Column:
    return F.array_union(trigrams(norm_name, min_length), trigrams(norm_symbol, min_length))


def phash_bands(phash: Column, bands: int = 4) -> Column:
    """16 hex digits as bands "i:digits", lower case; no bands for anything else. More bands than 4 raise recall: 11 leave none of 10 bits out."""
    low = F.lower(phash)
    if bands == 4:
        parts = F.array(*[F.concat(F.lit(f"{k}:"), low.substr(4 * k + 1, 4)) for k in range(4)])
    else:
        both = F.concat(*[F.lpad(F.conv(low.substr(8 * k + 1, 8), 16, 2), 32, "0") for k in range(2)])
        edges = [round(64 * k / bands) for k in range(bands + 1)]
        parts = F.array(*[F.concat(F.lit(f"{k}:"), both.substr(a + 1, b - a)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    return F.when(phash.rlike("^[0-9a-fA-F]{16}$"), parts).otherwise(F.array().cast("array<string>"))


def clean_text(value: Column) -> Column:
    """White space collapsed and trimmed; empty is null."""
    return bound(F.trim(F.regexp_replace(value, WHITE + "+", " ")), lambda x: F.when(x != "", x))


def label_key(value: Column) -> Column:
    """A label without trailing colons and white space, in capitals."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(value, f"(:|{WHITE})+$", ""), f"^{WHITE}+", "")))


def with_norms(rows, thresholds=None):
    """rows with normName, normSymbol (empty for null text) and trigrams."""
    least = thresholds.trigram_min_length if thresholds else 3
    named = rows.withColumns({"normName": F.coalesce(normalize(F.col("name")), F.lit("")), "normSymbol": F.coalesce(normalize(F.col("symbol")), F.lit(""))})
    return named.withColumn("trigrams", text_trigrams(F.col("normName"), F.col("normSymbol"), least))
