"""Registered queries of the operators, by operator, and the same results in SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echofold.functions import images, parse, present
from echofold.functions.similarity import narrative_match, pair_scores
from echofold.functions.text import clean_text, label_key, normalize, phash_bands, trigrams
from echofold.model import THRESHOLDS, TRACKED, Narrative, Thresholds
from echofold.operators import cluster, lookup, maintain, merge, neighbours, observe
from echofold.operators.candidates import candidates
from echofold.plans import bindings as B
from echofold.plans.service import Service
from echofold.sources import cards, launches, pictures
from echofold.sources.store import CoinStore, settled, shared_dir
from echofold.streaming import feed, retire, source, throttle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EXACT = Thresholds(narrative=Narrative(1.0), with_image=Narrative(1.0))  # scores of 1 are equal keys, which SQL can tell
Query = Callable[[SparkSession, str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- the bindings in SQL -------------------------------------------------------------------------------------------

def norm_sql(x: str) -> str:
    words = "coin|token|sol|solana|official|the|v2|ii"
    return rf"regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), '\b(?:{words})\b', ' ', 'g'), '\s+', '', 'g')"


def address_sql(x: str) -> str:
    return f"'M' || translate(lpad(CAST({x} AS VARCHAR), 35, '1'), '0', 'z')"


GRAMS = "list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))"
HASH = """hash AS (SELECT vec_id, bits, array_to_string(list_transform(range(0, 16), lambda k: substr('0123456789abcdef', 1 + 8 * bits[4 * k + 1] + 4 * bits[4 * k + 2] + 2 * bits[4 * k + 3] + bits[4 * k + 4], 1)), '') AS phash
  FROM (SELECT vec_id, list_transform(e, lambda x: CASE WHEN x > list_sort(e[2:64])[32] THEN 1 ELSE 0 END) AS bits FROM (SELECT vec_id, list_transform(embedding[1:64], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)))"""
RECORDS = f"""{HASH}, named AS (SELECT p_partkey AS number, CAST(p_partkey AS VARCHAR) AS mint, p_name || ' ' || p_brand AS name, p_type || ' ' || CAST(p_size AS VARCHAR) AS symbol,
  {B.T0} + p_partkey * 1000 AS firstSeen, {B.T0} + p_partkey * 1000 + p_size * 1000 AS lastSeen, floor(p_retailprice) * 100.0 AS peak, p_partkey % 7 = 0 AS migrated FROM part),
coin AS (SELECT named.*, coalesce({norm_sql('name')}, '') AS nn, coalesce({norm_sql('symbol')}, '') AS ns, phash, bits, migrated OR peak >= 100000 AS ran FROM named LEFT JOIN hash ON number = vec_id)"""
#: Candidates of the subjects (mint) in coin, by bucket priority, then key; the first 200.
CANDIDATES = f"""posting AS (SELECT DISTINCT mint, kind, key FROM (
  SELECT mint, 'n' AS kind, nn AS key FROM coin UNION ALL SELECT mint, 's', ns FROM coin
  UNION ALL SELECT mint, 'b', unnest([CAST(k AS VARCHAR) || ':' || substr(phash, 4 * k + 1, 4) for k in [0, 1, 2, 3]]) FROM coin WHERE phash IS NOT NULL
  UNION ALL SELECT mint, 't', unnest({GRAMS.format('nn')}) FROM coin UNION ALL SELECT mint, 't', unnest({GRAMS.format('ns')}) FROM coin) WHERE key <> ''),
probe AS (SELECT mint AS subject, 0 AS prio, 'n' AS kind, nn AS key FROM ask WHERE length(nn) >= 3 UNION ALL SELECT mint, 1, 's', nn FROM ask WHERE length(nn) >= 3
  UNION ALL SELECT mint, 2, 'n', ns FROM ask WHERE length(ns) >= 3 UNION ALL SELECT mint, 3, 's', ns FROM ask WHERE length(ns) >= 3
  UNION ALL SELECT mint, 4 + k, 'b', CAST(k AS VARCHAR) || ':' || substr(phash, 4 * k + 1, 4) FROM ask, range(0, 4) AS r(k) WHERE phash IS NOT NULL
  UNION ALL SELECT mint, 100 + i, 't', substr(nn, i, 3) FROM (SELECT mint, nn, unnest(range(1, length(nn) - 1)) AS i FROM ask)
  UNION ALL SELECT mint, 100000 + i, 't', substr(ns, i, 3) FROM (SELECT mint, ns, unnest(range(1, length(ns) - 1)) AS i FROM ask)),
found AS (SELECT subject, mint, min(prio) AS prio FROM probe JOIN posting USING (kind, key) WHERE subject <> mint GROUP BY subject, mint),
cand AS (SELECT subject, mint, prio, row_number() OVER (PARTITION BY subject ORDER BY prio, mint) AS place FROM found QUALIFY place <= 200)"""
ASK = "ask AS (SELECT * FROM coin WHERE number % 20 = 0)"
MATCHED = f"""WITH {RECORDS}, {ASK}, {CANDIDATES},
pair AS (SELECT c.subject, c.mint, k.name, k.symbol, k.firstSeen, k.peak, k.ran, k.migrated, list_sum(list_transform(range(1, 65), lambda i: abs(k.bits[i] - a.bits[i]))) AS distance,
   length(k.nn) >= 3 AND ((k.nn = a.nn) OR (k.nn = a.ns)) AS byName, length(k.ns) >= 3 AND ((k.ns = a.ns) OR (k.ns = a.nn)) AS bySymbol, length(k.nn) >= 3 AND k.nn = a.nn AS nameFirst, length(k.ns) >= 3 AND k.ns = a.ns AS symbolSecond
  FROM cand c JOIN coin k ON c.mint = k.mint JOIN ask a ON c.subject = a.mint),
prior AS (SELECT *, coalesce(distance <= 10, FALSE) AS image, CASE WHEN byName OR bySymbol THEN 1.0 WHEN distance <= 10 THEN 1 - distance / 64 END AS similarity,
   concat_ws(' + ', CASE WHEN byName AND (nameFirst OR NOT symbolSecond) THEN 'name' END, CASE WHEN bySymbol THEN 'symbol' END, CASE WHEN byName AND NOT (nameFirst OR NOT symbolSecond) THEN 'name' END, CASE WHEN distance <= 10 THEN 'image' END) AS matched
  FROM pair WHERE byName OR bySymbol OR coalesce(distance <= 10, FALSE))"""
EVENTS = f"""ev AS (SELECT CAST(user_id AS VARCHAR) AS mint, event_id, CASE WHEN event_id % 3 = 0 THEN 'The ' || event_type END AS name, CASE WHEN event_id % 4 = 0 THEN 'S-' || (event_id % 10) END AS symbol,
  CASE WHEN event_type <> 'error' THEN value * 300 END AS mc, CASE WHEN event_type = 'view' THEN value END AS vol, CASE WHEN event_id % 5 = 0 THEN 'https://img.example/' || (event_id % 7) END AS img, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS seenAt, event_type = 'purchase' AS migrated, event_id * 7919 % 1000003 AS seq FROM events),
fold AS (SELECT mint, arg_min(name, seq) FILTER (name IS NOT NULL) AS name, arg_min(symbol, seq) FILTER (symbol IS NOT NULL) AS symbol, arg_min(img, seq) FILTER (img IS NOT NULL) AS imageUrl, min(seenAt) AS firstSeen, max(seenAt) AS lastSeen, max(mc) AS peakMcUsd, max(vol) AS peakVolUsd, bool_or(migrated) AS sawMigrated, count(*) AS sightings FROM ev GROUP BY mint)"""
EVENT_NOW = 1_710_000_000_000


def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.fold(B.sightings(B.table(spark, sf_dir, "events")))


# --- text and hashes -----------------------------------------------------------------------------------------------

@query("STR1_normalize", f"SELECT doc_id, {norm_sql('text')} AS norm_text FROM documents")
def str1(spark, sf):
    """Whole texts as keys."""
    return B.spread(B.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", normalize(F.col("text")).alias("norm_text"))


@query("STR5_trigrams", f"WITH t AS (SELECT doc_id, {norm_sql('text')} AS nn FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct({GRAMS.format('nn')})), ',') AS trigrams FROM t")
def str5(spark, sf):
    """The distinct trigrams of whole texts' keys."""
    return str1(spark, sf).select("doc_id", F.array_join(F.array_sort(trigrams(F.col("norm_text"))), ",").alias("trigrams"))


@query("STR7_bands", f"WITH {HASH} SELECT vec_id, phash, array_to_string([CAST(k AS VARCHAR) || ':' || substr(phash, 4 * k + 1, 4) for k in [0, 1, 2, 3]], ' ') AS bands FROM hash")
def str7_mth3(spark, sf):
    return B.hashes(spark, sf).select("vec_id", "phash", F.array_join(phash_bands(F.col("phash")), " ").alias("bands"))


@query("JN2_band_join", f"""WITH {HASH}, coin AS (SELECT CAST(vec_id AS VARCHAR) AS mint, vec_id, '' AS nn, '' AS ns, phash, bits FROM hash), ask AS (SELECT * FROM coin), {CANDIDATES}
SELECT c.subject, c.mint, CAST(list_sum(list_transform(range(1, 65), lambda i: abs(x.bits[i] - y.bits[i]))) AS INT) AS distance FROM cand c JOIN coin x ON x.mint = c.subject JOIN coin y ON y.mint = c.mint""")
def jn2_mth4(spark, sf):
    """Hashes that share a band with each subject's, and their distance."""
    none = F.array().cast("array<string>")
    coins = B.hashes(spark, sf).select(F.col("vec_id").cast("string").alias("mint"), F.lit("").alias("normName"), F.lit("").alias("normSymbol"), none.alias("trigrams"), "phash", "vec_id")
    found = candidates(coins, coins).select("subject", F.explode("mints").alias("mint"))
    own = coins.select(F.col("mint").alias("subject"), F.col("phash").alias("_p"))
    return found.join(coins.select("mint", "phash"), "mint").join(own, "subject").select("subject", "mint", images.hamming(F.col("_p"), F.col("phash")).alias("distance"))


@query("JN2_within_ten", f"""WITH {HASH} SELECT x.vec_id, count(y.vec_id) AS others, CAST(min(d) AS INT) AS nearest FROM hash x LEFT JOIN
  (SELECT a.vec_id AS vec_x, b.vec_id, list_sum(list_transform(range(1, 65), lambda i: abs(a.bits[i] - b.bits[i]))) AS d FROM hash a JOIN hash b ON a.vec_id <> b.vec_id) y ON y.vec_x = x.vec_id AND d <= {THRESHOLDS.max_hamming} GROUP BY x.vec_id""")
def jn2_exact(spark, sf):
    """How many other records' hashes are within the image bar, and how near the nearest; no pair is out of its bands' reach."""
    rows = B.hashes(spark, sf)
    known, pairs = neighbours.near_hashes(rows)
    pairs = settled(pairs, "near-hashes")
    both = pairs.union(pairs.select("b", "a", "distance")).join(known.select(F.col("hash").alias("b"), "n"), "b").groupBy(F.col("a").alias("hash")).agg(F.sum("n").alias("far"), F.min("distance").alias("least"))
    per = known.join(both, "hash", "left").select("hash", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("others"), F.when(F.col("n") > 1, 0).otherwise(F.col("least")).alias("nearest"))
    return rows.join(per, rows.phash == per.hash).select("vec_id", "others", "nearest")


@query("AGG9_variance", "SELECT vec_id, round(list_var_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9) AS variance, list_sort(embedding[2:64])[32] AS middle FROM embeddings")
def agg9_agg10(spark, sf):
    rest = F.array_sort(F.slice("embedding", 2, 63))
    return B.table(spark, sf, "embeddings").select("vec_id", F.round(images.population_variance(F.col("embedding")), 9).alias("variance"), F.get(rest, F.lit(31)).alias("middle"))


SIDE, LOW = THRESHOLDS.sample_size, THRESHOLDS.dct_size
DULL = int(THRESHOLDS.min_variance * 10**6 * SIDE**4)
#: Each picture's pixels as rows, then a sum along x and one along y; of whole numbers, so that no order of terms tells a bit; of equal coefficients the later one counts as larger.
PIXELS = f"""WITH byte AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
part AS (SELECT doc_id, k AS picture, rpad(substr(h, k * {SIDE * SIDE * 8} + 1, {SIDE * SIDE * 8}), {SIDE * SIDE * 8}, '78') AS h FROM (SELECT doc_id, h, unnest(range(0, greatest(1, (length(h) + {SIDE * SIDE * 8 - 1}) // {SIDE * SIDE * 8}))) AS k FROM byte)),
line AS (SELECT doc_id, picture, CAST(y AS INT) AS y, substr(h, y * {SIDE * 8} + 1, {SIDE * 8}) AS h FROM (SELECT doc_id, picture, h, unnest(range(0, {SIDE})) AS y FROM part)),
dot AS (SELECT doc_id, picture, y, CAST(x AS INT) AS x, substr(h, x * 8 + 1, 6) AS h FROM (SELECT doc_id, picture, y, h, unnest(range(0, {SIDE})) AS x FROM line)),
pixel AS (SELECT doc_id, picture, y, x, {' + '.join(f"{w} * CAST('0x' || substr(h, {2 * c + 1}, 2) AS INT)" for c, w in enumerate(images.LUMA))} AS v FROM dot),
basis AS (SELECT k, i, CAST(round(cos(pi() * (2 * i + 1) * k / {2 * SIDE}) * sqrt((CASE WHEN k = 0 THEN 1 ELSE 2 END) / {SIDE}) * {images.BASIS}) AS BIGINT) AS c FROM range(0, {LOW}) a(k), range(0, {SIDE}) b(i)),
across AS (SELECT doc_id, picture, y, k AS l, CAST(sum(v * c) AS BIGINT) AS v FROM pixel JOIN basis ON i = x GROUP BY ALL),
down AS (SELECT doc_id, picture, {LOW} * k + l AS place, CAST(sum(v * c) AS BIGINT) AS v FROM across JOIN basis ON i = y GROUP BY ALL),
block AS (SELECT doc_id, picture, list(CAST(v AS HUGEINT) * 64 + place ORDER BY place) AS e FROM down GROUP BY ALL),
bit AS (SELECT doc_id, picture, list_transform(e, lambda x: CASE WHEN x > list_sort(e[2:64])[32] THEN 1 ELSE 0 END) AS bits FROM block),
spreads AS (SELECT doc_id, picture, CAST({SIDE**2} * sum(CAST(v AS BIGINT) * v) - sum(v) * sum(v) AS BIGINT) AS spread FROM pixel GROUP BY ALL)
SELECT doc_id, CAST(picture AS INT) AS picture, CASE WHEN spread >= {DULL} THEN array_to_string(list_transform(range(0, 16), lambda k: substr('0123456789abcdef', 1 + 8 * bits[4 * k + 1] + 4 * bits[4 * k + 2] + 2 * bits[4 * k + 3] + bits[4 * k + 4], 1)), '') END AS hash,
  CASE WHEN spread < {DULL} THEN 'degenerate' END AS failure, (spread + {SIDE**4 // 2}) // {SIDE**4} / 1e6 AS variance FROM bit JOIN spreads USING (doc_id, picture)
UNION ALL SELECT doc_id, 0, NULL, 'unavailable', 0 FROM documents WHERE text IS NULL"""


@query("MTH2_pixel_hash", PIXELS)
def mth2(spark, sf):
    """Documents' UTF-8 bytes, to their end, as 32 x 32 pictures through the pixel path: luma, gate, DCT, median bits. Null text is one unavailable picture."""
    size = SIDE * SIDE * 4
    rows = B.spread(B.table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("bytes")))
    last = F.floor((F.greatest(F.coalesce(F.length("bytes"), F.lit(0)), F.lit(1)) - 1) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.rpad(F.substring("bytes", k * size + 1, F.lit(size)), size, F.lit(b"x")))
    cut = rows.select("doc_id", F.posexplode(parts).alias("picture", "part"))
    return cut.select("doc_id", "picture", images.hash_pixels(F.col("part")).alias("r")).select("doc_id", "picture", "r.hash", "r.failure", "r.variance")


@query("SRC9_pictures", f"""SELECT doc_id || '-' || picture AS mint, CASE WHEN (doc_id + picture) % 10 <> 9 THEN hash END AS phash, CASE WHEN (doc_id + picture) % 10 = 9 THEN 'unavailable' ELSE coalesce(failure, 'ok') END AS state FROM ({PIXELS}) WHERE failure IS DISTINCT FROM 'unavailable'""")
def src9(spark, sf):
    """The same pictures as PNG files, of all five row filters, half of them at twice the size; every tenth is cut off."""
    size = SIDE * SIDE * 4
    rows = B.spread(B.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("bytes")))
    last = F.floor((F.greatest(F.length("bytes"), F.lit(1)) - 1) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.rpad(F.substring("bytes", k * size + 1, F.lit(size)), size, F.lit(b"x")))
    cut = rows.select("doc_id", F.posexplode(parts).alias("picture", "part"))
    number = F.col("doc_id") + F.col("picture")
    files = cut.select(F.concat("doc_id", F.lit("-"), "picture").alias("mint"), number.alias("number"), B.png_file(F.col("part"), number).alias("content"))
    whole = F.expr("CASE WHEN number % 10 = 9 THEN substring(content, 1, octet_length(content) - 13) ELSE content END")
    return pictures.verdicts_of(files.select("mint", whole.alias("content")))


# --- parsers and observations --------------------------------------------------------------------------------------

RAW = f"""raw AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS p, {address_sql('o_custkey')} AS m, * FROM orders)"""
PARSED = f"""{RAW}, parsed AS (SELECT k AS pos, CASE WHEN k % 11 <> 0 THEN m END AS mint, CASE WHEN k % 11 = 0 THEN 'no-mint' WHEN k % 13 = 0 THEN 'mint-mismatch' END AS rejected,
  CASE WHEN k % 5 <> 0 THEN 'Customer ' || o_custkey END AS name, CASE WHEN k % 7 <> 0 THEN o_orderpriority END AS symbol, CASE WHEN k % 2 <> 0 AND k % 4 = 1 THEN 'https://example.invalid/img/' || k || '.webp' END AS imageUrl, CAST(NULL AS VARCHAR) AS metadataUri,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 0 THEN (floor(p / 1000) + 0.5) * 1000 ELSE CAST(p AS DOUBLE) END AS marketCapUsd, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN CAST(p % 1000 AS DOUBLE) ELSE (p % 90) * 1000000.0 END AS volumeUsd,
  CASE WHEN k % 3 = 0 THEN (p % 50) * 3600 + 1800.0 WHEN k % 3 = 1 THEN CAST(p % 60 AS DOUBLE) END AS ageSeconds FROM raw)"""


@query("STR8_compact_number", f"WITH {PARSED} SELECT pos, marketCapUsd, volumeUsd FROM parsed")
def str8(spark, sf):
    return B.raw_rows(spark, sf).select("pos", parse.compact_number(F.col("marketCap")).alias("marketCapUsd"), parse.compact_number(F.col("volume")).alias("volumeUsd"))


@query("DT1_age", f"WITH {PARSED} SELECT pos, ageSeconds FROM parsed")
def dt1(spark, sf):
    return B.raw_rows(spark, sf).select("pos", parse.age_seconds(F.col("age")).alias("ageSeconds"))


@query("STR9_mints", f"WITH {RAW} SELECT k AS pos, CASE WHEN k % 11 <> 0 THEN m END AS mint, FALSE AS full_text, k % 11 <> 0 AND k % 13 = 0 AS vetoed FROM raw")
def str9_str10_str11(spark, sf):
    rows = B.raw_rows(spark, sf)
    mint = parse.mint_from_href(F.col("mintHref"))
    return rows.select("pos", mint.alias("mint"), parse.is_full_mint(F.col("mintText")).alias("full_text"), (mint.isNotNull() & ~parse.truncated_matches(F.col("mintText"), mint)).alias("vetoed"))


@query("STR10_full_mint", f"SELECT o_orderkey, o_orderkey % 3 = 0 AS full_text FROM orders")
def str10(spark, sf):
    k, m = F.col("o_orderkey"), B.address(F.col("o_custkey"))
    text = F.when(k % 3 == 0, F.concat(F.lit(" "), m, F.lit("\t"))).when(k % 3 == 1, F.concat(m.substr(1, 4), F.lit("..."), m.substr(33, 4)))
    return B.table(spark, sf, "orders").select("o_orderkey", parse.is_full_mint(text).alias("full_text"))


@query("STR12_clean_text", f"WITH {PARSED} SELECT pos, name, symbol FROM parsed")
def str12(spark, sf):
    return B.raw_rows(spark, sf).select("pos", clean_text(F.col("name")).alias("name"), clean_text(F.col("symbol")).alias("symbol"))


@query("STR13_image_url", f"WITH {PARSED} SELECT pos, imageUrl FROM parsed")
def str13(spark, sf):
    return B.raw_rows(spark, sf).select("pos", parse.clean_image_url(F.col("imageUrl"), "https://example.invalid/").alias("imageUrl"))


@query("STR14_label_key", "SELECT o_orderkey, upper(o_orderpriority) AS label FROM orders")
def str14(spark, sf):
    return B.table(spark, sf, "orders").select("o_orderkey", label_key(F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(":  :"))).alias("label"))


@query("STR15_image_mint", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN {address_sql('o_custkey')} END AS mint FROM orders")
def str15(spark, sf):
    k, m = F.col("o_orderkey"), B.address(F.col("o_custkey"))
    src = F.when(k % 3 == 0, F.concat(F.lit("https://cdn.example/"), m, F.lit(".WEBP?x"))).when(k % 3 == 1, F.concat(F.lit("data:/"), m, F.lit(".png"))).otherwise("https://cdn.example/a.png")
    return B.table(spark, sf, "orders").select("o_orderkey", parse.mint_from_image(src).alias("mint"))


@query("STR16_column", "SELECT event_id, CASE event_type WHEN 'click' THEN 'final-stretch' WHEN 'purchase' THEN 'migrated' WHEN 'signup' THEN 'new-pairs' ELSE 'other' END AS source FROM events")
def str16(spark, sf):
    heading = F.when(F.col("event_type") == "click", "the Final Stretch 3").when(F.col("event_type") == "purchase", "MIGRATED today").when(F.col("event_type") == "signup", "New Pairs Migrated").otherwise("pairs")
    return B.table(spark, sf, "events").select("event_id", parse.column_source(heading).alias("source"))


@query("STR17_link", "SELECT c_custkey, 'https://example.invalid/meme/' || replace(replace(c_name, '#', '%23'), ' ', '+') AS link FROM customer")
def str17(spark, sf):
    return B.table(spark, sf, "customer").select("c_custkey", parse.link_to(F.col("c_name"), "https://example.invalid").alias("link"))


@query("PRJ1_observation", f"WITH {PARSED} SELECT pos, mint, name, symbol, imageUrl, metadataUri, marketCapUsd, volumeUsd, ageSeconds, rejected FROM parsed")
def prj1_flt7(spark, sf):
    return observe.judged(B.raw_rows(spark, sf)).select("pos", "mint", *TRACKED, "rejected")


COMPLETE = " + ".join(f"({c} IS NOT NULL)::INT" for c in TRACKED)


@query("AGG3_dedupe", f"WITH {PARSED} SELECT mint, pos, {COMPLETE} AS completeness, first FROM (SELECT *, min(pos) OVER (PARTITION BY mint) AS first, row_number() OVER (PARTITION BY mint ORDER BY {COMPLETE} DESC, pos) AS n FROM parsed WHERE rejected IS NULL) WHERE n = 1")
def agg3_mth8(spark, sf):
    rows = observe.observations(observe.judged(B.raw_rows(spark, sf)))
    return observe.dedupe_by_mint(rows).select("mint", "pos", observe.completeness().alias("completeness"), "first")


RATES = ", ".join(f"CASE WHEN count(*) FILTER (rejected IS NULL) = 0 THEN 0.0 ELSE count(*) FILTER (rejected IS NULL AND {c} IS NOT NULL) / count(*) FILTER (rejected IS NULL) END AS rate_{c}" for c in TRACKED)
TALLY = f"SELECT pos % 500 AS pass, count(*) AS rows, count(*) FILTER (rejected IS NULL) AS kept, count(*) FILTER (rejected = 'no-mint') AS no_mint, count(*) FILTER (rejected = 'mint-mismatch') AS mint_mismatch, {RATES} FROM parsed GROUP BY pass"
FAILING = "list_filter([" + ", ".join(f"CASE WHEN rate_{c} < 0.5 THEN '{c}' END" for c in TRACKED if c != "metadataUri") + "], lambda x: x IS NOT NULL)"


@query("AGG4_tally", f"WITH {PARSED} {TALLY}")
def agg4(spark, sf):
    rows = observe.judged(B.raw_rows(spark, sf)).withColumn("pass", F.col("pos") % 500)
    return observe.tally(rows, ["pass"])


@query("AGG5_diagnose", f"WITH {PARSED}, t AS ({TALLY}), h AS (SELECT pass, rows, kept, {FAILING} AS low FROM t) SELECT pass, CASE WHEN rows < 20 THEN 'cold' WHEN kept = 0 THEN 'mints-failing' WHEN len(low) > 0 THEN 'fields-failing' ELSE 'ok' END AS health, CASE WHEN rows >= 20 AND kept > 0 THEN array_to_string(low, ',') ELSE '' END AS failing FROM h")
def agg5(spark, sf):
    return observe.diagnose(agg4(spark, sf)).select("pass", "health", F.array_join("failing", ",").alias("failing"))


# --- sources -------------------------------------------------------------------------------------------------------

LINES = f"""line AS (SELECT event_id AS k, {address_sql('user_id')} AS m, event_type, CASE event_id % 10 WHEN 0 THEN 'not-an-object' WHEN 1 THEN 'bad-mint' WHEN 2 THEN 'bad-mint' WHEN 3 THEN 'not-an-object' END AS bad FROM events),
launch AS (SELECT k AS pos, CASE WHEN bad IS NULL THEN m WHEN k % 10 = 2 THEN 'short' ELSE '' END AS mint, CASE WHEN bad IS NULL AND k % 3 <> 0 THEN 'N ' || event_type ELSE '' END AS name, CASE WHEN bad IS NULL THEN event_type ELSE '' END AS symbol,
  CASE WHEN bad IS NULL AND k % 4 > 1 AND k > 0 THEN CAST(k AS DOUBLE) END AS observedAt, coalesce(bad, CASE WHEN k <> min(k) FILTER (bad IS NULL) OVER (PARTITION BY bad IS NULL, m) THEN 'duplicate-in-file' END) AS reason FROM line)"""


@query("FLT8_launches", f"WITH {LINES} SELECT pos, mint, name, symbol, observedAt, reason FROM launch")
def flt8_src2(spark, sf):
    return launches.checked(launches.json_rows(B.launch_lines(spark, sf))).select("pos", "mint", "name", "symbol", "observedAt", "reason")


REPORT = "count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected, count(*) FILTER (reason = 'not-an-object') AS not_an_object, count(*) FILTER (reason = 'bad-mint') AS bad_mint, count(*) FILTER (reason = 'duplicate-in-file') AS duplicate_in_file"


@query("AGG7_report", f"""WITH {LINES}, r AS (SELECT {REPORT} FROM launch) SELECT *, ' (' || rejected || ' skipped: ' || not_an_object || ' not an object, ' || bad_mint || ' bad mint, ' || duplicate_in_file || ' duplicate in file)' AS said FROM r""")
def agg7_str19(spark, sf):
    found = launches.report(launches.checked(launches.json_rows(B.launch_lines(spark, sf))))
    return found.withColumn("said", present.describe_rejections({r: F.col(r.replace("-", "_")) for r in launches.REASONS}, F.col("rejected")))


@query("SRC2_json_array", "SELECT event_id AS pos, event_type AS kind FROM events")
def src2_array(spark, sf):
    """Each event as an array file of one member, so no file grows with the table."""
    lines = B.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.to_json(F.array(F.struct("event_id", "event_type"))).alias("value"))
    rows = launches.array_rows(lines.select("value"))
    return rows.select(F.try_variant_get("v", "$.event_id", "long").alias("pos"), F.try_variant_get("v", "$.event_type", "string").alias("kind"))


IMPORTED = f"""WITH {LINES}, batch AS (SELECT mint, nullif(name, '') AS name, nullif(symbol, '') AS symbol, observedAt FROM launch WHERE reason IS NULL)"""


@query("SNK3_import", f"""{IMPORTED} SELECT mint, name, symbol, CAST(least({B.NOW}, coalesce(observedAt, {B.NOW})) AS BIGINT) AS firstSeen, CAST({B.NOW} AS BIGINT) AS lastSeen, CAST(1 AS BIGINT) AS sightings, FALSE AS ran FROM batch""")
def snk3_prj2(spark, sf):
    rows = launches.checked(launches.json_rows(B.launch_lines(spark, sf)))
    empty = merge.fold(B.sightings(B.table(spark, sf, "events")).limit(0))
    return launches.imported(empty, rows, B.NOW).select("mint", "name", "symbol", "firstSeen", "lastSeen", "sightings", "ran")


@query("SNK6_ndjson", "SELECT event_id, event_type FROM events")
def snk6(spark, sf):
    path = fresh(spark, "ndjson")
    for part in range(2):
        B.table(spark, sf, "events").where(F.col("event_id") % 2 == part).select("event_id", "event_type").write.mode("append").json(path)
    return spark.read.schema("event_id long, event_type string").json(path)


CAP = "CASE WHEN k % 5 = 0 THEN bal * 1000.0 WHEN k % 5 = 1 THEN bal * 1000.0 WHEN k % 5 = 2 THEN NULL ELSE CAST(bal AS DOUBLE) END"


#: A sixth of the cards have no name and an age in two pieces: its number then stands where the name would, and no age follows.
CARDS = f"""WITH c AS (SELECT c_custkey AS k, CAST(abs(floor(c_acctbal)) AS BIGINT) AS bal, {address_sql('c_custkey')} AS m, c_name FROM customer)
SELECT k AS page_id, m AS mint, CASE WHEN k % 6 <> 0 THEN m END AS attr_mint, CASE WHEN k % 3 <> 0 THEN c_name WHEN k % 2 <> 0 THEN CAST(k % 60 AS VARCHAR) END AS name,
'T' || (k % 100) AS symbol, 'https://cdn.example/' || m || '.webp' AS imageUrl, {CAP} AS marketCapUsd, CAST(12 AS DOUBLE) AS volumeUsd,
CASE WHEN k % 2 = 0 THEN (k % 60) * 60.0 WHEN k % 3 <> 0 THEN CAST(k % 60 AS DOUBLE) END AS ageSeconds, CASE k % 4 WHEN 0 THEN 'new-pairs' WHEN 1 THEN 'final-stretch' WHEN 2 THEN 'migrated' ELSE 'other' END AS source FROM c"""


@query("PRJ6_cards", CARDS)
def prj6_tok_src1(spark, sf):
    """All card pages, as raw rows and observations."""
    return card_rows(B.card_pages(spark, sf))


@query("PRJ6_cards_all", f"SELECT * REPLACE (page_id // 20 AS page_id) FROM ({CARDS})")
def prj6_pages(spark, sf):
    """The same cards on pages of twenty, one after the other."""
    page = F.floor(F.col("page_id") / 20)
    cards_of = F.array_sort(F.collect_list(F.struct("page_id", "html")))  # twenty at most
    pages = B.card_pages(spark, sf).groupBy(page.alias("page")).agg(F.array_join(F.transform(cards_of, lambda x: x["html"]), "").alias("html"))
    return card_rows(pages.withColumnRenamed("page", "page_id"))


def card_rows(pages: DataFrame) -> DataFrame:
    found = cards.cards(pages).withColumn("seenAt", F.col("pos"))
    return observe.judged(found).select("page_id", "mint", F.col("attrMint").alias("attr_mint"), "name", "symbol", "imageUrl", "marketCapUsd", "volumeUsd", "ageSeconds", "source")


@query("FLT1_visible", "SELECT c_custkey AS page_id, 1 AS cards FROM customer WHERE c_acctbal >= 0")
def flt1(spark, sf):
    """Pages out of sight are left out before any card on them is read."""
    shown = B.table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("page_id"))
    return cards.cards(B.card_pages(spark, sf).join(shown, "page_id", "left_semi")).groupBy("page_id").agg(F.count("*").cast("int").alias("cards"))


@query("SNK10_scrub", r"SELECT page_id, length(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g')) AS n_chars, regexp_matches(html, '[\w.+-]+@[\w-]+\.[\w.]{2,}') AS mail FROM pages")
def snk10(spark, sf):
    return cards.scrubbed(B.table(spark, sf, "pages")).select("page_id", F.length("html").cast("long").alias("n_chars"), F.array_contains("refused", "email address").alias("mail"))


@query("SNK10_sections", r"""WITH p AS (SELECT c_custkey AS page_id, c_custkey % 4 AS kind, CASE WHEN c_custkey % 5 = 0 THEN c_name || '@mail.example' ELSE c_name END AS said FROM customer)
SELECT page_id, CASE kind WHEN 0 THEN '' WHEN 1 THEN '<section><i data-pulse-token-address="' || page_id || '">' || said || '</i></section>' WHEN 2 THEN '<section id="a"><a href="/meme/' || page_id || '">' || said || '</a></section>'
  ELSE '<section><a href=''/meme/a''>1</a></section>' || chr(10) || '<section><b data-pulse-token-address="">2</b></section>' END AS html,
  CASE WHEN kind = 0 THEN 'no sections' WHEN kind < 3 AND regexp_matches(said, '[\w.+-]+@[\w-]+\.[\w.]{2,}') THEN 'email address' ELSE '' END AS refused FROM p""")
def snk10_sections(spark, sf):
    """Customers as captures: sections with cards, with links to pairs, with neither, and a script within one."""
    k, kind = F.col("c_custkey"), F.col("c_custkey") % 4
    said = F.when(k % 5 == 0, F.concat("c_name", F.lit("@mail.example"))).otherwise(F.col("c_name"))
    card = F.concat(F.lit('<section><script>x</script><i data-pulse-token-address="'), k, F.lit('">'), said, F.lit("</i></section>"))
    link = F.concat(F.lit('<section id="a"><a href="/meme/'), k, F.lit('">'), said, F.lit("</a></SECTION >"))
    two = F.lit("<section><a href='/meme/a'>1</a></section><p>between</p><section><b data-pulse-token-address=\"\">2</b></section>")
    html = F.concat(F.lit("<nav><a href='/meme/out'>o</a></nav><section>news a@b.example</section>"), F.when(kind == 1, card).when(kind == 2, link).when(kind == 3, two).otherwise(""), F.lit("<footer>end</footer>"))
    found = cards.scrubbed(B.table(spark, sf, "customer").select(k.alias("page_id"), html.alias("html")), markup=cards.Markup())
    return found.select("page_id", "html", F.array_join("refused", ",").alias("refused"))


# --- merge and upkeep ----------------------------------------------------------------------------------------------

FOLDED = "mint, name, symbol, imageUrl, firstSeen, lastSeen, peakMcUsd, peakVolUsd, sawMigrated, sightings"


@query("AGG1_fold", f"WITH {EVENTS} SELECT {FOLDED}, sawMigrated OR coalesce(peakMcUsd >= 100000, FALSE) AS ran, coalesce({norm_sql('name')}, '') AS normName FROM fold")
def agg1(spark, sf):
    return event_fold(spark, sf).select(*FOLDED.split(", "), "ran", "normName")


@query("CLS3_evidence", f"WITH {EVENTS} SELECT mint, CASE WHEN sawMigrated THEN 'migrated' WHEN peakMcUsd >= 100000 THEN 'market-cap' ELSE 'none' END AS evidence FROM fold")
def cls(spark, sf):
    return event_fold(spark, sf).select("mint", merge.ran_evidence(F.col("peakMcUsd"), F.col("sawMigrated")).alias("evidence"))


@query("JN8_upsert", f"""WITH {EVENTS} SELECT mint, arg_min(name, (event_id % 2) * 10000000 + seq) FILTER (name IS NOT NULL) AS name, arg_min(symbol, (event_id % 2) * 10000000 + seq) FILTER (symbol IS NOT NULL) AS symbol, min(seenAt) AS firstSeen, max(seenAt) AS lastSeen, max(mc) AS peakMcUsd, bool_or(migrated) AS sawMigrated, count(*) AS sightings FROM ev GROUP BY mint""")
def jn8_snk1_snk2(spark, sf):
    """Two batches through a store: each is merged into the version before it."""
    store = CoinStore(spark, fresh(spark, "store"))
    rows = B.sightings(B.table(spark, sf, "events"))
    for part in range(2):
        store.merge(merge.folded(rows.where(F.col("event_id") % 2 == part)))
    return store.read().select("mint", "name", "symbol", "firstSeen", "lastSeen", "peakMcUsd", "sawMigrated", "sightings")


@query("SNK1_log_store", f"""WITH {EVENTS} SELECT mint, arg_min(name, (event_id % 8) * 10000000 + seq) FILTER (name IS NOT NULL) AS name, arg_min(symbol, (event_id % 8) * 10000000 + seq) FILTER (symbol IS NOT NULL) AS symbol,
  min(seenAt) AS firstSeen, max(seenAt) AS lastSeen, max(mc) AS peakMcUsd, bool_or(migrated) AS sawMigrated, count(*) AS sightings,
  CASE WHEN CAST(mint AS BIGINT) % 3 = 0 THEN '00ff00ff00ff00ff' END AS phash FROM ev WHERE event_id % 8 > 3 OR CAST(mint AS BIGINT) % 5 > 0 GROUP BY mint""")
def snk1_snk2_snk4_snk5(spark, sf):
    """Eight batches through the log, with removals and hash verdicts after the fourth, and folding wherever it falls due."""
    store = CoinStore(spark, fresh(spark, "log"))
    rows = B.sightings(B.table(spark, sf, "events"))
    for part in range(8):
        store.merge(merge.folded(rows.where(F.col("event_id") % 8 == part)))
        if part == 3:
            store.remove(store.read().where(F.col("mint").cast("long") % 5 == 0).select("mint"))
    known = store.read().where(F.col("mint").cast("long") % 3 == 0)
    store.tell_hashes(known.select("mint", F.lit("00ff00ff00ff00ff").alias("phash"), F.lit("ok").alias("phashState")))
    return store.read().select("mint", "name", "symbol", "firstSeen", "lastSeen", "peakMcUsd", "sawMigrated", "sightings", "phash")


@query("T5_arrival_trigrams", f"""WITH {EVENTS}, arrival AS (SELECT mint, coalesce(greatest(min(seq) FILTER (name IS NOT NULL), min(seq) FILTER (symbol IS NOT NULL)), min(seq)) AS seq FROM ev GROUP BY mint),
kept AS (SELECT mint, coalesce({norm_sql('name')}, '') AS nn, coalesce({norm_sql('symbol')}, '') AS ns FROM ev JOIN arrival USING (mint, seq))
SELECT mint, array_to_string(list_sort(list_distinct(list_concat({GRAMS.format('nn')}, {GRAMS.format('ns')}))), ',') AS trigrams FROM kept""")
def t5(spark, sf):
    found = merge.arrival_trigrams(B.sightings(B.table(spark, sf, "events")))
    return found.select("mint", F.array_join(F.array_sort("trigrams"), ",").alias("trigrams"))


@query("SNK5_retention", f"WITH {RECORDS} SELECT count(*) FILTER (lastSeen < {B.T0} + 300000 AND NOT ran) AS removed, count(*) FILTER (NOT (lastSeen < {B.T0} + 300000 AND NOT ran)) AS kept FROM coin")
def snk5(spark, sf):
    return maintain.removed_count(B.records(spark, sf), B.T0 + 300_000 + THRESHOLDS.retention_ms)


@query("SRC7_stale_scan", f"WITH {RECORDS} SELECT mint FROM coin WHERE NOT (lastSeen < {B.T0} + 300000 AND NOT ran)")
def src7(spark, sf):
    return maintain.retained(B.records(spark, sf), B.T0 + 300_000 + THRESHOLDS.retention_ms).select("mint")


@query("FLT6_pending", f"WITH {EVENTS} SELECT mint FROM fold WHERE CAST(mint AS BIGINT) % 5 IN (0, 1) OR (CAST(mint AS BIGINT) % 5 = 3 AND {EVENT_NOW} - lastSeen >= 21600000)")
def flt6(spark, sf):
    k = F.col("mint").cast("long") % 5
    coins = event_fold(spark, sf).withColumns({"imageUrl": F.when(k != 4, "https://example.invalid/x.png"), "phash": F.when(k == 4, "0" * 16), "phashState": F.when(k == 2, "degenerate").when(k == 3, "unavailable").when(k == 4, "ok")})
    return maintain.pending_images(coins, coins.select("mint"), EVENT_NOW).select("mint")


@query("SNK4_hashes", f"WITH {EVENTS} SELECT mint, CASE WHEN CAST(mint AS BIGINT) % 2 = 0 THEN 'ok' END AS phashState, CASE WHEN CAST(mint AS BIGINT) % 2 = 0 THEN '00ff00ff00ff00ff' END AS phash FROM fold")
def snk4(spark, sf):
    coins = event_fold(spark, sf)
    known = coins.where(F.col("mint").cast("long") % 2 == 0).select("mint").union(coins.select(F.concat(F.lit("gone"), "mint")))
    return maintain.with_hashes(coins, known.select("mint", F.lit("00ff00ff00ff00ff").alias("phash"), F.lit("ok").alias("state"))).select("mint", "phashState", "phash")


@query("SRC8_meta", f"WITH {EVENTS} SELECT min(firstSeen) AS startedAt, 1 AS schemaVersion, count(*) AS coinCount FROM fold")
def src8_agg8(spark, sf):
    return maintain.meta(event_fold(spark, sf))


@query("SRC5_get_many", f"WITH {RECORDS}, ask(pos, mint) AS (VALUES (0, '7'), (1, '3'), (2, '-1'), (3, '7'), (4, '12')) SELECT pos, mint, name FROM ask JOIN coin USING (mint)")
def src5(spark, sf):
    asked = spark.createDataFrame([(0, "7"), (1, "3"), (2, "-1"), (3, "7"), (4, "12")], "pos int, mint string")
    return maintain.in_order(B.records(spark, sf), asked).select("pos", "mint", "name")


# --- lookup, ranking, clusters -------------------------------------------------------------------------------------

def asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    coins = B.records(spark, sf)
    return coins.where("number % 20 = 0"), coins


@query("JN1_exact_keys", f"WITH {RECORDS}, {ASK} SELECT a.mint, count(DISTINCT c.mint) AS others FROM ask a JOIN coin c ON c.mint <> a.mint AND ((length(a.nn) >= 3 AND a.nn IN (c.nn, c.ns)) OR (length(a.ns) >= 3 AND a.ns IN (c.nn, c.ns))) GROUP BY a.mint")
def jn1_flt2_flt3(spark, sf):
    """Counted, not listed: records with one of a subject's keys, less those with both, so no pair of a hot key is made."""
    ask, coins = asked(spark, sf)
    least = THRESHOLDS.narrative.min_length
    long = lambda c: F.when(F.length(c) >= least, F.col(c))
    one = coins.select(F.explode(F.array_distinct(F.array_compact(F.array(long("normName"), long("normSymbol"))))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    two = coins.where((F.length("normName") >= least) & (F.length("normSymbol") >= least) & (F.col("normName") != F.col("normSymbol")))
    two = two.groupBy(F.least("normName", "normSymbol").alias("lo"), F.greatest("normName", "normSymbol").alias("hi")).agg(F.count("*").alias("both"))
    rows = ask.select("mint", long("normName").alias("a"), F.when(F.col("normSymbol") != F.col("normName"), long("normSymbol")).alias("b"))
    rows = rows.join(one.select(F.col("key").alias("a"), F.col("n").alias("na")), "a", "left").join(one.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b", "left")
    rows = rows.join(two, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")) & F.col("a").isNotNull() & F.col("b").isNotNull(), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("mint", (n("na") + n("nb") - n("both") - 1).alias("others")).where("others > 0")


CANDIDATE_ROWS = "SELECT subject AS mint, count(*) AS n, count(*) >= 200 AS capped, md5(string_agg(mint, ',' ORDER BY place)) AS listed FROM cand GROUP BY subject"


def listed(found: DataFrame) -> DataFrame:
    return found.select(F.col("subject").alias("mint"), F.size("mints").cast("long").alias("n"), "capped", F.md5(F.array_join("mints", ",")).alias("listed"))


@query("JN4_candidates", f"WITH {RECORDS}, {ASK}, {CANDIDATES} {CANDIDATE_ROWS}")
def jn4_jn3_src6_lim1(spark, sf):
    return listed(candidates(*asked(spark, sf)))


@query("LIM1_cap", f"WITH coin AS (SELECT CAST(p_partkey AS VARCHAR) AS mint, p_partkey, {norm_sql('p_name')} AS nn, '' AS ns, CAST(NULL AS VARCHAR) AS phash FROM part), ask AS (SELECT * FROM coin WHERE p_partkey % 20 = 0), {CANDIDATES} {CANDIDATE_ROWS}")
def lim1(spark, sf):
    coins = B.parts(spark, sf)
    return listed(candidates(coins.where("p_partkey % 20 = 0"), coins))


INDEXED_NOW = B.T0 + 40 * 86_400_000


@query("SRC4_index", f"""WITH coin AS (SELECT CAST(p_partkey AS VARCHAR) AS mint, p_partkey, {norm_sql('p_name')} AS nn, {norm_sql('p_type')} AS ns, CASE WHEN p_partkey % 4 = 0 THEN '00ff' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || 'ff00ff00' END AS phash FROM part WHERE p_size >= 10 OR p_retailprice * 100 >= 100000),
ask AS (SELECT * FROM coin WHERE p_partkey % 20 = 0), {CANDIDATES} {CANDIDATE_ROWS}""")
def src4_src6(spark, sf):
    """Candidates from the stored index after three merges (names of half the parts, all types, the other names), hash
    verdicts and a retention, each followed by its differences."""
    service = Service(CoinStore(spark, fresh(spark, "indexed")))
    key, null = F.col("p_partkey"), F.lit(None)
    parts = B.table(spark, sf, "part").select(
        key.cast("string").alias("mint"), F.col("p_name").alias("name"), F.col("p_type").alias("symbol"), null.cast("string").alias("imageUrl"), (F.col("p_retailprice") * 100).alias("marketCapUsd"), null.cast("double").alias("volumeUsd"),
        (B.T0 + F.col("p_size").cast("long") * 86_400_000).alias("seenAt"), F.lit("trending").alias("source"), key.alias("seq"), key,
    )
    service.observe(parts.where(key % 2 == 0).withColumn("symbol", null.cast("string")), B.T0)
    service.observe(parts.withColumn("name", null.cast("string")), B.T0)
    service.observe(parts.where(key % 2 == 1).withColumn("symbol", null.cast("string")), B.T0)
    service.record_hashes(parts.where(key % 4 == 0).select("mint", F.concat(F.lit("00ff"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("ff00ff00")).alias("phash"), F.lit("ok").alias("state")))
    service.retain(INDEXED_NOW)
    return listed(service.index.candidates(service.store.read().where(F.col("mint").cast("long") % 20 == 0)))


def exact_priors(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.priors(*asked(spark, sf), EXACT)


@query("JN7_priors", f"{MATCHED} SELECT subject, mint, similarity, matched, CAST(distance AS INT) AS distance, CASE WHEN migrated THEN 'migrated' WHEN peak >= 100000 THEN 'market-cap' ELSE 'none' END AS evidence, row_number() OVER (PARTITION BY subject ORDER BY similarity DESC, mint) AS rank FROM prior")
def jn5_jn7_jn10_srt2(spark, sf):
    return exact_priors(spark, sf).select("subject", "mint", "similarity", F.array_join("matchedOn", " + ").alias("matched"), F.col("imageDistance").alias("distance"), "evidence", F.col("rank").cast("long").alias("rank"))


COUNTS = f"{MATCHED}, n AS (SELECT subject, count(*) FILTER (ran) AS ranCount, count(*) AS totalCount FROM prior GROUP BY subject), cap AS (SELECT subject, count(*) >= 200 AS capped FROM cand GROUP BY subject), looked AS (SELECT ask.mint, coalesce(ranCount, 0) AS ranCount, coalesce(totalCount, 0) AS totalCount, coalesce(capped, FALSE) AS capped FROM ask LEFT JOIN n ON n.subject = ask.mint LEFT JOIN cap ON cap.subject = ask.mint)"


@query("AGG6_lookup", f"{COUNTS} SELECT *, TRUE AS confident, CAST({B.NOW - B.T0} AS BIGINT) AS corpusAgeMs, ranCount || ' / ' || totalCount || CASE WHEN capped THEN '+' ELSE '' END AS badge FROM looked")
def agg6_dt2_dt3_snk7(spark, sf):
    found = lookup.lookup(*asked(spark, sf), B.T0, B.NOW, EXACT)
    return found.withColumn("badge", present.badge(F.col("ranCount"), F.col("totalCount"), F.col("capped"), F.col("confident"), F.col("corpusAgeMs")))


USD = "CASE WHEN {0} >= 1e6 THEN printf('$%.2fM', {0} / 1e6) WHEN {0} >= 1e3 THEN printf('$%.1fK', {0} / 1e3) ELSE '$' || CAST(floor({0} + 0.5) AS BIGINT) END"


#: Peaks here are whole hundreds; to two places of a million a half goes up, as format_string has it.
PEAK = "CASE WHEN peak >= 1e6 THEN printf('$%.2fM', floor((peak + 5000) / 10000) / 100) WHEN peak >= 1e3 THEN printf('$%.1fK', peak / 1e3) ELSE '$' || CAST(floor(peak + 0.5) AS BIGINT) END"


@query("SNK8_popover", f"""{MATCHED}, shown AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ran DESC, peak DESC, similarity DESC, mint) AS place FROM prior QUALIFY place <= 50)
SELECT subject, place, concat_ws(' · ', name, 'first seen ' || strftime(make_timestamp(firstSeen * 1000), '%Y-%m-%d'), coalesce('peak MC ' || {PEAK}, 'peak MC unknown'), CASE WHEN migrated THEN 'ran — migrated' WHEN peak >= 100000 THEN 'ran — peak MC' ELSE 'no run observed' END, 'recognised by ' || matched, CASE WHEN distance = 0 THEN 'identical image' WHEN distance IS NOT NULL THEN 'image ' || distance || '/64 bits apart' END) AS line FROM shown""")
def snk8_srt3_prj4_str18(spark, sf):
    rows = lookup.popover(exact_priors(spark, sf))
    line = present.prior_line(F.col("name"), F.col("firstSeen"), F.col("peakMcUsd"), F.col("evidence"), F.col("matchedOn"), F.col("imageDistance"))
    return rows.select("subject", F.col("place").cast("long").alias("place"), line.alias("line"))


@query("JN9_live_cards", f"{COUNTS}, card AS (SELECT CAST(user_id AS VARCHAR) AS mint, arg_max(event_type, event_id) AS shown FROM events GROUP BY user_id) SELECT mint, totalCount, shown FROM looked JOIN card USING (mint)")
def jn9(spark, sf):
    """Results on the cards that now show their subjects; a subject's last card is the one."""
    shown = B.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("mint"), F.col("event_id").alias("pos"), F.col("event_type").alias("shown"))
    found = lookup.on_cards(lookup.lookup(*asked(spark, sf), B.T0, B.NOW, EXACT), shown)
    return found.select("mint", "totalCount", F.col("card.shown").alias("shown"))


@query("JN10_subjects", f"WITH {RECORDS} SELECT mint, nn AS norm_name, CASE number % 3 WHEN 1 THEN '00ff00ff00ff00ff' WHEN 2 THEN phash END AS phash FROM coin WHERE number % 20 = 0")
def jn10_prj5(spark, sf):
    """Subjects with the hash that they bring, a null one too, else the stored one."""
    ask, coins = asked(spark, sf)
    k = F.col("number") % 3
    rows = ask.select("mint", "name", "symbol", F.when(k == 1, "00ff00ff00ff00ff").alias("phash"), (k != 2).alias("phashGiven"))
    return lookup.subjects_of(rows, coins).select("mint", F.col("normName").alias("norm_name"), "phash")


@query("JN5_fuzzy_lookup")
def fuzzy(spark, sf):
    """The whole lookup at its production bars; SQL's Jaro-Winkler floors half transpositions, so there is none to compare."""
    found = lookup.priors(*asked(spark, sf))
    return found.select("subject", "rank", "mint", F.round("similarity", 9).alias("similarity"), F.array_join("matchedOn", " + ").alias("matched"), "evidence")


def word_sql(number: str) -> str:
    return f"translate(substr(md5(CAST({number} // 3 AS VARCHAR)), 1, 12), '0123456789', 'ghijklmnop') || substr('xyz', {number} % 3 + 1, 1)"


EXACT_CLUSTERS = f"""WITH RECURSIVE coin AS (SELECT CAST(c_custkey AS VARCHAR) AS mint, c_custkey AS number, {word_sql('c_custkey')} AS nn, CASE WHEN c_custkey % 50 < 45 THEN {word_sql('(c_custkey + 3)')} ELSE '' END AS ns FROM customer),
tie AS (SELECT mint, nn AS key FROM coin WHERE length(nn) >= 3 UNION SELECT mint, ns FROM coin WHERE length(ns) >= 3),
edge AS (SELECT DISTINCT a.mint AS a, b.mint AS b FROM tie a JOIN tie b USING (key)),
reach(mint, root) AS (SELECT a, min(b) FROM edge GROUP BY a UNION SELECT e.a, r.root FROM reach r JOIN edge e ON e.b = r.mint WHERE r.root < e.a),
grouped AS (SELECT coin.mint, coin.number, coalesce(min(least(root, coin.mint)), coin.mint) AS cluster FROM coin LEFT JOIN reach USING (mint) GROUP BY coin.mint, coin.number)"""


@query("GR1_clusters_exact", f"{EXACT_CLUSTERS} SELECT mint, cluster FROM grouped")
def gr1_exact(spark, sf):
    return cluster.clusters(B.chains(spark, sf).drop("number"), bar=1.0)


@query("SRT4_largest_first", f"{EXACT_CLUSTERS} SELECT cluster, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(number)) AS place FROM grouped GROUP BY cluster QUALIFY place <= 50")
def srt4(spark, sf):
    """A report of the 50 largest clusters, in order: of like sizes the one whose member came first."""
    rows = B.chains(spark, sf)
    found = cluster.clusters(rows.drop("number"), bar=1.0)
    top = cluster.largest_first(found, rows.select("mint", F.col("number").alias("pos"))).limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).select("cluster", "n", F.col("place").cast("long").alias("place"))  # of 50 rows


@query("GR1_clusters")
def gr1_agg11_srt4(spark, sf):
    rows = cluster.clusters(B.chains(spark, sf).drop("number"))
    return rows.groupBy("cluster").agg(F.count("*").alias("n")).select("cluster", "n", (F.col("n") > 1).alias("matched"))


SAME = {f"{a}{b}": f"(length(x.{a}) >= 3 AND length(y.{b}) >= 3 AND x.{a} = y.{b})" for a in ("nn", "ns") for b in ("nn", "ns")}


@query("FLT4_match", f"""WITH p AS (SELECT *, {norm_sql('p_name')} AS pn, {norm_sql('p_type')} AS pt, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'size ' || p_size END AS uri FROM part),
x AS (SELECT *, pn AS nn, pt AS ns FROM p), y AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN pn ELSE pt END AS nn, CASE WHEN p_partkey % 2 = 0 THEN pt ELSE pn END AS ns FROM p QUALIFY p_partkey = min(p_partkey) OVER (PARTITION BY p_brand)),
hit AS (SELECT x.p_partkey, x.uri <> '' AND x.uri = y.uri AS same, {SAME['nnnn']} OR {SAME['nnns']} AS name, {SAME['nsns']} OR {SAME['nsnn']} AS symbol, {SAME['nnnn']} OR NOT {SAME['nsns']} AS named FROM x JOIN y USING (p_brand))
SELECT p_partkey, CASE WHEN same OR name OR symbol THEN CAST(1 AS DOUBLE) END AS similarity, CASE WHEN same THEN 'metadata' WHEN name OR symbol THEN concat_ws(' + ', CASE WHEN name AND named THEN 'name' END, CASE WHEN symbol THEN 'symbol' END, CASE WHEN name AND NOT named THEN 'name' END) END AS matched FROM hit""")
def flt4_str4(spark, sf):
    """Each part against the first of its brand, by names, types as symbols, and sizes as addresses."""
    key = F.col("p_partkey")
    rows = B.table(spark, sf, "part").select("p_partkey", "p_brand", normalize(F.col("p_name")).alias("n"), normalize(F.col("p_type")).alias("s"), F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("size "), "p_size")).alias("uri"))
    own = F.struct(F.when(key % 2 == 0, F.col("n")).otherwise(F.col("s")).alias("n"), F.when(key % 2 == 0, F.col("s")).otherwise(F.col("n")).alias("s"), "uri")
    first = rows.groupBy("p_brand").agg(F.min_by(own, "p_partkey").alias("y"))
    found = narrative_match(pair_scores(F.col("n"), F.col("s"), F.col("y.n"), F.col("y.s")), 1.0, F.col("uri"), F.col("y.uri"))
    return rows.join(first, "p_brand").select("p_partkey", found.alias("m")).select("p_partkey", "m.similarity", F.array_join("m.matchedOn", " + ").alias("matched"))


SERVED_AGE = 2 * 86_400_000


@query("SRC10_service", f"""WITH {EVENTS}, coin AS (SELECT mint, CAST(mint AS BIGINT) AS number, coalesce({norm_sql('name')}, '') AS nn, coalesce({norm_sql('symbol')}, '') AS ns, CAST(NULL AS VARCHAR) AS phash, sawMigrated OR coalesce(peakMcUsd >= 100000, FALSE) AS ran FROM fold), {ASK}, {CANDIDATES},
prior AS (SELECT c.subject, k.ran FROM cand c JOIN coin k ON k.mint = c.mint JOIN ask a ON a.mint = c.subject WHERE (length(k.nn) >= 3 AND k.nn IN (a.nn, a.ns)) OR (length(k.ns) >= 3 AND k.ns IN (a.nn, a.ns))),
cap AS (SELECT subject, count(*) >= 200 AS capped FROM cand GROUP BY subject), n AS (SELECT subject, count(*) FILTER (ran) AS ranCount, count(*) AS totalCount FROM prior GROUP BY subject)
SELECT mint, coalesce(ranCount, 0) AS ranCount, coalesce(totalCount, 0) AS totalCount, coalesce(capped, FALSE) AS capped, FALSE AS confident, CAST({SERVED_AGE} AS BIGINT) AS corpusAgeMs, (SELECT count(*) FROM coin) AS coinCount FROM ask LEFT JOIN n ON n.subject = mint LEFT JOIN cap ON cap.subject = mint""")
def src10(spark, sf):
    """A client's requests: all sightings observed, then every twentieth record looked up two days on, when no badge is shown yet."""
    service = Service(CoinStore(spark, fresh(spark, "service"), EXACT), EXACT)
    service.observe(B.sightings(B.table(spark, sf, "events")), B.T0)
    now = B.T0 + SERVED_AGE
    subjects = service.store.read().where(F.col("mint").cast("long") % 20 == 0).select("mint", "name", "symbol")
    found = service.lookup(subjects, now).select("mint", "ranCount", "totalCount", "capped", "confident", "corpusAgeMs")
    return found.crossJoin(F.broadcast(service.meta(now).select("coinCount")))  # of one row


# --- presentation --------------------------------------------------------------------------------------------------

PRICE = "o_totalprice * 7 + 0.003"
#: The UTC date of milliseconds; a year of more than four digits has a sign, as ISO 8601 asks. By days, as a timestamp's microseconds end in the year 294247.
DATE = "CASE WHEN {0} >= 253402300800000 THEN '+' ELSE '' END || strftime(DATE '1970-01-01' + CAST(floor({0} / 86400000) AS INTEGER), '%Y-%m-%d')"


@query("DT4_presentation", f"""WITH o AS (SELECT o_orderkey, {PRICE} AS v, o_orderkey * 97003 AS ms FROM orders) SELECT o_orderkey, {USD.format('v')} AS usd, CASE WHEN ms / 3600000 < 1 THEN greatest(1, CAST(floor(ms / 60000 + 0.5) AS BIGINT)) || ' min' WHEN ms / 3600000 < 48 THEN CAST(floor(ms / 3600000 + 0.5) AS BIGINT) || ' h' ELSE CAST(floor(ms / 3600000 / 24 + 0.5) AS BIGINT) || ' days' END AS age, {DATE.format('ms * 1000')} AS date FROM o""")
def dt4_dt5_dt6(spark, sf):
    ms = F.col("o_orderkey") * 97003
    return B.table(spark, sf, "orders").select("o_orderkey", present.format_usd(F.expr(PRICE)).alias("usd"), present.format_age(ms).alias("age"), present.format_date(ms * 1000).alias("date"))


# --- streams -------------------------------------------------------------------------------------------------------

def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = B.table(spark, sf, "events").schema
    return B.sightings(spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet"))


@query("STM3_fold_stream", f"WITH {EVENTS} SELECT {FOLDED} FROM fold")
def stm3_snk1(spark, sf):
    store = CoinStore(spark, fresh(spark, "stream-store"))
    feed.fold_into(event_stream(spark, sf), store, fresh(spark, "stream-state"), {"availableNow": True}).awaitTermination()
    return store.read().select(*FOLDED.split(", "))


@query("STM3_stateful", f"WITH {EVENTS} SELECT {FOLDED} FROM fold")
def stm3_state(spark, sf):
    path = fresh(spark, "stateful")
    run = feed.stateful_fold(event_stream(spark, sf)).writeStream.outputMode("update").foreachBatch(lambda rows, _: rows.write.mode("append").parquet(path))
    run.option("checkpointLocation", fresh(spark, "stateful-state")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path)
    last = rows.groupBy("mint").agg(F.max_by(F.struct(*rows.columns), "sightings").alias("r"))
    return last.select("r.*")


@query("STM8_rate", """WITH f AS (SELECT user_id, count(*) AS launched, CAST(floor(epoch_us(max(ts)) / 1000) - floor(epoch_us(min(ts)) / 1000) AS BIGINT) AS running_ms FROM events GROUP BY user_id)
SELECT *, running_ms > 300000 AND launched * 60000 < 10 * running_ms AS alarm FROM f""")
def stm8(spark, sf):
    """Users as feeds, each from its first event to its last: which are suspiciously slow."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    feeds = B.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("launched"), (F.max(at) - F.min(at)).alias("running_ms"))
    return feeds.withColumn("alarm", feed.rate_alarm(F.col("launched"), F.col("running_ms")))


DEDUPE_CAP = 400  # far below the number of keys, which are users and kinds of events


@query("STM4_dedupe", f"""WITH RECURSIVE ev AS (SELECT event_id AS pos, user_id || event_type AS mint FROM events),
gen(found, half) AS (SELECT list({{'p': p, 'm': mint}} ORDER BY p)[1:{DEDUPE_CAP // 2 + 1}], {DEDUPE_CAP // 2} FROM (SELECT mint, min(pos) AS p FROM ev GROUP BY mint)
  UNION ALL SELECT (SELECT list({{'p': p, 'm': mint}} ORDER BY p)[1:{DEDUPE_CAP // 2 + 1}] FROM (SELECT mint, min(pos) AS p FROM ev WHERE pos >= gen.found[gen.half + 1].p AND NOT list_contains(list_transform(gen.found[1:gen.half], lambda x: x.m), mint) GROUP BY mint)), half
  FROM gen WHERE len(found) > half)
SELECT x.m AS mint, x.p AS event_id FROM (SELECT unnest(found[1:half]) AS x FROM gen)""")
def stm4(spark, sf):
    """Events by user and kind through a memory that holds few of them, in two runs of a stream over parts of the file."""
    path, rows = fresh(spark, "dedupe"), B.table(spark, sf, "events")
    half = rows.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    landing = path + "/in"
    for part in (F.col("event_id") <= half, F.col("event_id") > half):
        rows.where(part).select(F.concat(F.col("user_id").cast("string"), F.col("event_type")).alias("mint"), "event_id").write.mode("append").parquet(landing)
        feed.dedupe_into(spark.readStream.schema("mint string, event_id long").parquet(landing), path, path + "/state", "event_id", DEDUPE_CAP, trigger={"availableNow": True}).awaitTermination()
    return spark.read.schema("mint string, event_id long").parquet(f"{path}/rows/*")


def chain_sql(holds: str) -> str:
    """The events that fire, one after the other, for each user."""
    return f"""WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t, {holds} AS holds FROM events),
n AS MATERIALIZED (SELECT a.event_id, a.user_id, b.event_id AS next FROM e a ASOF LEFT JOIN e b ON a.user_id = b.user_id AND CAST(a.t + a.holds AS HUGEINT) * 10000000000 <= CAST(b.t AS HUGEINT) * 10000000000 + b.event_id),
f(event_id) AS (SELECT arg_min(event_id, CAST(t AS HUGEINT) * 10000000000 + event_id) FROM e GROUP BY user_id UNION ALL SELECT n.next FROM f JOIN n USING (event_id) WHERE n.next IS NOT NULL)
SELECT event_id, user_id FROM f JOIN e USING (event_id)"""


def timed_events(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at"), "value")


@query("STM1_coalesce", chain_sql("CAST(86400000 AS BIGINT)"))
def stm1(spark, sf):
    """A user's events as changes: the first begins a pass that takes in all others of a day."""
    rows = timed_events(spark, sf)
    return throttle.fires(rows, 86_400_000, "user_id", "at", "event_id", 30 * 86_400_000).join(rows, "event_id").select("event_id", "user_id")


@query("STM7_single_flight", chain_sql("greatest(1, CAST(floor(value * 3600000) AS BIGINT))"))
def stm7(spark, sf):
    """A user's events as sweeps of as many hours as their value; those that would overlap a running one are dropped."""
    rows = timed_events(spark, sf)
    fired = throttle.fires(rows, F.floor(F.col("value") * 3_600_000), "user_id", "at", "event_id", 30 * 86_400_000)
    return fired.join(rows, "event_id").select("event_id", "user_id")


@query("STM5_silences", f"""WITH e AS (SELECT user_id, event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS t FROM events), g AS (SELECT *, lag(t) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(CASE WHEN t - before >= {feed.SILENCE_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS attempt FROM g),
i AS (SELECT user_id, attempt, count(*) AS heard FROM s GROUP BY user_id, attempt)
SELECT s.user_id, CAST(s.attempt AS BIGINT) AS attempt, before AS last_heard, t AS heard_again, t - before AS silent_ms, heard, CAST(500 AS BIGINT) AS wait_least, CAST(least(30000, 500 * 2 ** least(s.attempt, 16)) AS BIGINT) AS wait_most
FROM s JOIN i ON i.user_id = s.user_id AND i.attempt = s.attempt - 1 WHERE t - before >= {feed.SILENCE_MS}""")
def stm5_mth9(spark, sf):
    """Users as feeds: their silences, each with its attempt to reconnect and the bounds of the wait before it."""
    return feed.silences(timed_events(spark, sf), "user_id", "at", "event_id")


FRAMES = """k AS (SELECT event_id AS k, 'M' || translate(lpad(CAST(user_id AS VARCHAR), 35, '1'), '0', 'z') AS mint, event_type FROM events)
SELECT k, CASE k % 10 WHEN 3 THEN 'short' ELSE mint END AS mint, event_type FROM k WHERE k % 10 NOT IN (0, 1, 2, 3)"""


@query("SRC3_feed", f"WITH {FRAMES.replace('SELECT k, CASE', 'SELECT CAST(k AS DOUBLE) AS observedAt, CASE').replace('event_type FROM k WHERE', 'event_type AS name FROM k WHERE')}")
def src3(spark, sf):
    """Frames of a feed (trades, messages, broken lines and short addresses among them) appended to a log's shards, read
    through the source in two runs of one query, the second from the checkpoint of the first."""
    root, rows = fresh(spark, "feed"), B.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    k = F.col("event_id")
    frame = lambda kind, mint: F.to_json(F.struct(F.lit(kind).alias("txType"), mint.alias("mint"), F.col("event_type").alias("name"), k.alias("observedAt")))
    mint = B.address(F.col("user_id"))
    line = F.when(k % 10 == 0, frame("buy", mint)).when(k % 10 == 1, F.lit('{"message": "subscribed", "txType": "create"}')).when(k % 10 == 2, F.lit('{"txType": "cre')).when(k % 10 == 3, frame("create", F.lit("short"))).otherwise(frame("create", mint))
    for part in range(2):
        rows.where(F.pmod(F.floor(k / 100), F.lit(2)) == part).select(line.alias("value")).repartition(3).write.mode("append").text(f"{root}/log")
        stream = source.launch_feed(spark, f"{root}/log").select("observedAt", "mint", "name")
        run = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("observedAt double, mint string, name string").parquet(f"{root}/rows")


RETIRE_MS = 2 * 86_400_000


@query("STM6_retired", f"""WITH {EVENTS}, s AS (SELECT mint || event_type AS mint, seenAt, seq, name, symbol, mc, migrated OR coalesce(mc >= 100000, FALSE) AS ran FROM ev JOIN events USING (event_id)),
g AS (SELECT *, lag(seenAt) OVER w AS before, coalesce(bool_or(ran) OVER (PARTITION BY mint ORDER BY seenAt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS kept FROM s WINDOW w AS (PARTITION BY mint ORDER BY seenAt, seq)),
i AS (SELECT *, sum(CASE WHEN seenAt - before > {RETIRE_MS} AND NOT kept THEN 1 ELSE 0 END) OVER (PARTITION BY mint ORDER BY seenAt, seq) AS life FROM g),
l AS (SELECT mint, life, min(seenAt) AS firstSeen, max(seenAt) AS lastSeen, max(mc) AS peakMcUsd, count(*) AS sightings, bool_or(ran) AS ran, arg_min(name, CAST(seenAt AS HUGEINT) * 10000000 + seq) FILTER (name IS NOT NULL) AS name, arg_min(symbol, CAST(seenAt AS HUGEINT) * 10000000 + seq) FILTER (symbol IS NOT NULL) AS symbol FROM i GROUP BY mint, life)
SELECT mint, name, symbol, firstSeen, lastSeen, peakMcUsd, sightings FROM l WHERE NOT ran AND lastSeen + {RETIRE_MS} <= (SELECT max(seenAt) FROM s)""")
def stm6(spark, sf):
    """Sightings by user and kind as a stream in time order, over several batches: which keys are retired, and with what."""
    root, rows = fresh(spark, "retire"), B.table(spark, sf, "events")
    seen = B.sightings(rows).join(rows.select("event_id", "event_type"), "event_id").withColumn("mint", F.concat("mint", "event_type"))
    low, high = seen.agg(F.min("seenAt"), F.max("seenAt")).first()
    for k in range(4):  # what is added each time is one batch, later than the one before
        part = seen.where((F.floor((F.col("seenAt") - low) * 4 / (high - low + 1)) == k)).select("mint", "name", "symbol", "marketCapUsd", "source", "seenAt", "seq")
        part.write.mode("append").parquet(f"{root}/in")
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", retire.ROCKS)
        try:
            stream = spark.readStream.schema(part.schema).parquet(f"{root}/in")
            found = retire.retired(stream, thresholds=replace(THRESHOLDS, retention_ms=RETIRE_MS))
            run = found.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state")
            run.trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(retire.RETIRED).parquet(f"{root}/rows")
