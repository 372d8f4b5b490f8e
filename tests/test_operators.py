"""Records, lookups, clusters, sources and streams on small tables."""

import json
import os
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofold.functions.text import with_norms
from echofold.model import COIN, OBSERVATION, RAW_ROW, THRESHOLDS
from echofold.functions import png
from echofold.operators import cluster, lookup, maintain, merge, neighbours, observe
from echofold.operators.candidates import candidates
from echofold.plans.service import Service
from echofold.sources import cards, launches, pictures
from echofold.sources.store import ConcurrentWrite, CoinStore, settled
from echofold.streaming import feed, throttle

T0 = 1_758_300_000_000
MINT = "M" + "1" * 35


def sightings(spark, rows):
    base = {"name": None, "symbol": None, "imageUrl": None, "metadataUri": None, "marketCapUsd": None, "volumeUsd": None, "ageSeconds": None, "seenAt": T0, "source": "new-pairs"}
    fields = [x.split()[0] for x in OBSERVATION.split(", ")]
    return spark.createDataFrame([tuple((base | r)[f] for f in fields) + (r.get("seq", i),) for i, r in enumerate(rows)], OBSERVATION + ", seq long")


def coins(spark, rows):
    base = {"imageUrl": None, "phash": None, "phashState": None, "firstSeen": T0, "lastSeen": T0, "peakMcUsd": None, "peakVolUsd": None, "ran": False, "sawMigrated": False, "sightings": 1, "name": None, "symbol": None}
    fields = [x.split()[0] for x in COIN.split(", ") if x.split()[0] not in ("normName", "normSymbol", "trigrams")]
    schema = ", ".join(x for x in COIN.split(", ") if x.split()[0] in fields)
    return with_norms(spark.createDataFrame([tuple((base | r)[f] for f in fields) for r in rows], schema))


def one(frame):
    return frame.collect()[0]


def test_fold_rules(spark):
    rows = sightings(spark, [{"mint": "a", "name": None, "symbol": "X", "marketCapUsd": 5.0, "seenAt": T0 + 9, "seq": 1}, {"mint": "a", "name": "Late", "seenAt": T0 - 5, "seq": 3}, {"mint": "a", "name": "Early", "symbol": "Y", "marketCapUsd": None, "seq": 2}, {"mint": "b", "source": "migrated"}, {"mint": "c", "marketCapUsd": 100_000.0}, {"mint": "d", "marketCapUsd": 99_999.0}])
    got = {r.mint: r for r in merge.fold(rows).collect()}
    assert (got["a"].name, got["a"].symbol, got["a"].peakMcUsd, got["a"].firstSeen, got["a"].lastSeen, got["a"].sightings) == ("Early", "X", 5.0, T0 - 5, T0 + 9, 3)
    assert [got[k].ran for k in "abcd"] == [False, True, True, False]


def test_upsert_equals_one_fold(spark):
    rows = sightings(spark, [{"mint": m, "name": n, "marketCapUsd": c, "seq": i} for i, (m, n, c) in enumerate([("a", None, 3.0), ("b", "B", None), ("a", "A", 1.0), ("c", None, 2.0), ("a", "Z", 9.0), ("b", "Q", 4.0)])])
    whole = sorted(merge.fold(rows).select("mint", "name", "peakMcUsd", "sightings").collect())
    first = merge.fold(rows.where("seq < 3"))
    assert sorted(merge.upsert(first, merge.folded(rows.where("seq >= 3"))).select("mint", "name", "peakMcUsd", "sightings").collect()) == whole


def test_arrival_trigrams(spark):
    rows = sightings(spark, [{"mint": "a", "name": "alpha", "seq": 0}, {"mint": "a", "name": "bravo", "symbol": "xray", "seq": 1}, {"mint": "b", "symbol": "xray", "seq": 0}, {"mint": "b", "name": "alpha", "seq": 1}])
    got = {r.mint: set(r.trigrams) for r in merge.arrival_trigrams(rows).collect()}
    assert got == {"a": {"bra", "rav", "avo", "xra", "ray"}, "b": {"alp", "lph", "pha"}}


def test_observations(spark):
    raw = [(f"/meme/{MINT}", None, "The  Boring Company", "TBC", "https://cdn.example/tbc.png", None, "$44.8K", "$80K", "9m", "new-pairs", T0, 0), ("/x", None, *[None] * 7, "new-pairs", T0, 1), (f"/meme/{MINT}", "ZZ...ZZ", *[None] * 7, "new-pairs", T0, 2), (f"/meme/{MINT}", None, "n", *[None] * 6, "new-pairs", T0, 3)]
    rows = observe.judged(spark.createDataFrame(raw, RAW_ROW + ", source string, seenAt long, pos long"))
    assert [r.rejected for r in rows.orderBy("pos").collect()] == [None, "no-mint", "mint-mismatch", None]
    best = one(observe.dedupe_by_mint(observe.observations(rows)))
    assert (best.name, best.marketCapUsd, best.ageSeconds, best.first) == ("The Boring Company", 44800.0, 540.0, 0)
    report = one(observe.tally(rows))
    assert (report.rows, report.kept, report.no_mint, report.mint_mismatch, report.rate_name, report.rate_symbol) == (4, 2, 1, 1, 1.0, 0.5)
    assert one(observe.diagnose(observe.tally(rows))).health == "cold"
    many = rows.crossJoin(spark.range(10)).drop("id")
    assert one(observe.diagnose(observe.tally(many.where("rejected IS NOT NULL")))).health == "mints-failing"
    failing = one(observe.diagnose(observe.tally(many.where("rejected IS NULL AND symbol IS NULL").union(many.where("rejected IS NULL AND symbol IS NULL")))))
    assert failing.health == "fields-failing" and "symbol" in failing.failing and "metadataUri" not in failing.failing
    assert one(observe.tally(rows.limit(0))).rate_name == 0.0


def test_candidate_cap_and_order(spark):
    rows = coins(spark, [{"mint": f"{k:04d}", "name": "solar flare"} for k in range(250)] + [{"mint": "x", "name": "solar flares"}])
    got = one(candidates(rows.where("mint = '0100'"), rows))
    assert got.capped and len(got.mints) == THRESHOLDS.max_candidates and got.mints == [f"{k:04d}" for k in range(201) if k != 100]
    got = one(candidates(rows.where("mint = 'x'"), rows.where("mint < '0200' OR mint = 'x'")))
    assert got.capped and len(got.mints) == 200
    assert candidates(coins(spark, [{"mint": "q", "name": "ab"}]), rows).isEmpty()


def test_lookup_text_image_and_gate(spark):
    near, far = "0f0f0f0f0f0f0f00", "f0f0f0f0f0f0f0f0"
    rows = coins(spark, [{"mint": "s", "name": "Thursday Arena", "symbol": "THU", "phash": "0f0f0f0f0f0f0f0f"}, {"mint": "a", "name": "thursday arena coin", "ran": True, "sawMigrated": True}, {"mint": "b", "name": "other", "phash": near}, {"mint": "c", "name": "thing", "phash": far}, {"mint": "d", "name": "zzz", "symbol": "Thursdayarenas"}])
    ask = lookup.subjects_of(rows.where("mint = 's'"), rows)
    got = {r.mint: r for r in lookup.priors(ask, rows).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"].similarity == 1.0 and got["a"].matchedOn == ["name"] and got["a"].evidence == "migrated"
    assert got["b"].matchedOn == ["image"] and got["b"].imageDistance == 4 and got["b"].similarity == 1 - 4 / 64 and got["d"].matchedOn == ["symbol"]
    assert [r.mint for r in lookup.priors(ask, rows).orderBy("rank").collect()][0] == "a"
    for started, confident in ((T0, True), (T0 + 38 * 86_400_000, False), (0, False)):
        r = one(lookup.lookup(ask, rows, started, T0 + 40 * 86_400_000))
        assert (r.ranCount, r.totalCount, r.capped, r.confident) == (1, 3, False, confident)


def recording():
    """123 launches in groups of one story each, told in the ways that launches vary: case, accents, filler words, punctuation,
    name and symbol swapped, one address. The second group of each line differs from all others by more than the bar."""
    draw = random.Random(17)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(9, 13)))
    rows, sizes = [], [27, 5, *[3] * 5, *[2] * 5, *[1] * 66]
    for size in sizes:
        name, symbol = word(), word()
        told = [(name, symbol), (name.upper(), ""), (f"The {name} coin", None), (symbol, name), (f"{name[0]}\u0301{name[1:]}", "x"), (f"{name}!", symbol.title()), (name[:-1] + "q", "")]
        rows += [(*told[k % len(told)], "") for k in range(size)]
    draw.shuffle(rows)
    return [(f"m{k:03d}", *r) for k, r in enumerate(rows)], sizes


def test_recorded_launches_cluster(spark):
    """Groups of a recording and the matches of each launch, by clusters and by lookup, against all pairs; and, where
    LAUNCH_RECORDING names its file, the published figures of a recording of 123 launches."""
    from echofold.functions.similarity import jaro_winkler

    told, want = recording()
    schema = "mint string, name string, symbol string, uri string"
    rows = with_norms(spark.createDataFrame(told, schema))
    own = [(r.normName, r.normSymbol) for r in rows.orderBy("mint").collect()]
    long = lambda x: len(x) >= 3
    matches = [sum(any(long(p) and long(q) and jaro_winkler([p], [q])[0] >= 0.9 for p in a for q in b) for j, b in enumerate(own) if j != i) for i, a in enumerate(own)]

    def figures(rows):
        sizes = sorted((r["count"] for r in cluster.clusters(rows).groupBy("cluster").count().collect()), reverse=True)
        store = rows.drop("uri").withColumns({"imageUrl": F.lit(None).cast("string"), "phash": F.lit(None).cast("string"), "firstSeen": F.lit(0).cast("long"), "lastSeen": F.lit(0).cast("long"), "peakMcUsd": F.lit(None).cast("double"), "ran": F.lit(False), "sawMigrated": F.lit(False)})
        return sizes, {r.mint: r.totalCount for r in lookup.lookup(store, store, T0, T0).collect()}

    sizes, counts = figures(rows)
    assert len(told) == 123 and sizes == want and [counts[m] for m in sorted(counts)] == matches
    if path := os.environ.get("LAUNCH_RECORDING"):
        sizes, counts = figures(with_norms(spark.createDataFrame([(r["mint"], r["name"], r["symbol"], r["uri"]) for r in json.load(open(path))], schema)))
        assert len(sizes) == 78 and sizes[:8] == [27, 5, 3, 3, 3, 3, 3, 2] and sizes.count(1) == 66
        counts = list(counts.values())
        assert {n: counts.count(n) for n in set(counts)} == {0: 66, 1: 10, 2: 15, 4: 5, 11: 2, 24: 15, 26: 10} and sum(counts) == 702


def test_clusters_edges(spark):
    rows = coins(spark, [{"mint": "a", "name": "cupcake", "symbol": "CUP"}, {"mint": "b", "name": "thursdayarena", "symbol": "cupcake"}, {"mint": "c", "name": "thursdayarena", "symbol": "zzz"}, {"mint": "d", "name": "x"}, {"mint": "e", "name": "x"}])
    got = {r.mint: r.cluster for r in cluster.clusters(rows.select("mint", "normName", "normSymbol")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


@pytest.mark.parametrize("bar", [0.9, 0.72, 0.97])
def test_near_keys_are_among_those_filed(spark, bar):
    """The index meets in every pair of keys that scores the bar, of all pairs; lengths up to wide bands, repeated letters."""
    from echofold.functions.similarity import jaro_winkler

    draw = random.Random(8)
    keys = {"".join(draw.choices("abcdefghijkl", k=draw.randint(3, 14))) for _ in range(120)} | {"".join(draw.choices("aab0é漢", k=draw.randint(3, 60))) for _ in range(60)}
    for key in sorted(keys):
        for _ in range(3):
            x = list(key)
            for _ in range(draw.randint(1, 1 + len(x) // 6)):
                k = draw.randrange(len(x))
                x[k : k + 1] = draw.choice([[], [x[k], "z"], ["q"], x[k : k + 2][::-1]])
            keys.add("".join(x))
    keys = sorted(k for k in keys if len(k) >= 3)
    near = cluster.near_keys(spark.createDataFrame(list(enumerate(keys)), "id long, key string").repartition(3), bar)
    got = {tuple(sorted(r)) for r in near.collect()}
    want = {(i, i + 1 + j) for i, a in enumerate(keys[:-1]) for j in np.flatnonzero(jaro_winkler([a] * (len(keys) - i - 1), keys[i + 1 :]) >= bar)}
    assert want <= got and len(want) > 100
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keys_of_few_letters_leave_few_pairs(spark):
    """Random words of one length and 16 letters: the index may not leave many times the pairs that score the bar."""
    draw = random.Random(3)
    stems = ["".join(draw.choices("abcdefghijklmnop", k=12)) for _ in range(1000)]
    words = sorted({stem + end for stem in stems for end in "xyz"})
    near = cluster.near_keys(spark.createDataFrame(list(enumerate(words)), "id long, key string"), 0.9).distinct()
    assert near.count() <= 1.02 * len(words)  # three pairs of each stem, and few others


def test_clusters_compare_all_keys(spark, monkeypatch):
    """Against all pairs: keys past the first 201 of a trigram, and near keys without a trigram in common."""
    from echofold.functions.similarity import jaro_winkler

    draw = random.Random(5)
    names = sorted({"thu" + "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 9))) for _ in range(500)})
    names += ["zyxthuqjk", "zyxwthuqk", "abcdefgh", "abdcefhg", "ünïcode", "ünicode", "aaaaaaaaaaaa", "aaaaaaaaaaab", "aaaaaaaa"]
    group = {n: n for n in names}
    for i, a in enumerate(names):
        for b in (b for b, score in zip(names[i + 1 :], jaro_winkler([a] * len(names[i + 1 :]), names[i + 1 :]), strict=True) if score >= 0.9):
            lost, kept = sorted((group[a], group[b]), reverse=True)
            group = {n: kept if g == lost else g for n, g in group.items()}
    rows = spark.createDataFrame([(n, n, "") for n in names], "mint string, normName string, normSymbol string")
    assert {r.mint: r.cluster for r in cluster.clusters(rows).collect()} == group and 20 < len(set(group.values())) < len(names)
    assert group["abcdefgh"] == group["abdcefhg"]
    monkeypatch.setattr(cluster, "COMMON_TOKENS", 3)
    monkeypatch.setattr(cluster, "BROADCAST_KEYS", 0)
    assert {r.mint: r.cluster for r in cluster.clusters(rows).collect()} == group
    assert cluster.clusters(rows.limit(0)).count() == 0


def test_pictures_cover_whole_texts(spark, tmp_path):
    """Texts that differ after their first 4,096 characters differ in a later picture."""
    from echofold.functions import images
    from echofold.plans.queries import QUERIES

    draw = random.Random(3)
    text = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz \n", k=4096)) for _ in range(4)]
    texts = {1: text[0] + text[1] + "end", 2: text[0] + text[2], 3: text[3], 4: "", 5: None, 6: "€ é 漢字 " * 500}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.picture): (r.hash, r.failure) for r in QUERIES["MTH2_pixel_hash"](spark, f"file://{tmp_path}").collect()}
    raw = {k: None if x is None else x.encode() for k, x in texts.items()}
    want = {(k, n): None if x is None else bytearray(x[n * 4096 : (n + 1) * 4096].ljust(4096, b"x")) for k, x in raw.items() for n in range(max(1, -(-len(x or b"") // 4096)))}
    pixels = spark.createDataFrame([(*k, v) for k, v in want.items()], "doc_id long, picture int, b binary")
    assert got == {(r.doc_id, r.picture): (r.r.hash, r.r.failure) for r in pixels.select("doc_id", "picture", images.hash_pixels(F.col("b")).alias("r")).collect()}
    assert len(got) == 10 and got[1, 0] == got[2, 0] and got[1, 1][0] != got[2, 1][0]


def test_upkeep(spark):
    now = T0 + THRESHOLDS.retention_ms
    rows = coins(spark, [{"mint": "old", "lastSeen": T0 - 1}, {"mint": "edge", "lastSeen": T0}, {"mint": "ran", "lastSeen": T0 - 9, "ran": True}])
    assert sorted(r.mint for r in maintain.retained(rows, now).collect()) == ["edge", "ran"]
    rows = coins(spark, [{"mint": "new", "imageUrl": "u"}, {"mint": "none"}, {"mint": "flat", "imageUrl": "u", "phashState": "degenerate"}, {"mint": "soon", "imageUrl": "u", "phashState": "unavailable", "lastSeen": now - 1}, {"mint": "later", "imageUrl": "u", "phashState": "unavailable", "lastSeen": now - THRESHOLDS.retry_ms}, {"mint": "ok", "imageUrl": "u", "phash": "0" * 16, "phashState": "ok"}])
    assert sorted(r.mint for r in maintain.pending_images(rows, rows.select("mint"), now).collect()) == ["later", "new"]
    verdicts = spark.createDataFrame([("new", None, "degenerate"), ("gone", "f" * 16, "ok")], "mint string, phash string, state string")
    after = {r.mint: r.phashState for r in maintain.with_hashes(rows, verdicts).collect()}
    assert after["new"] == "degenerate" and "gone" not in after and one(maintain.hashes_written(rows, verdicts)).written == 1
    assert tuple(one(maintain.meta(rows.limit(0)))) == (0, 1, 0)


def launch_file(spark, tmp_path, text):
    path = tmp_path / "launches.txt"
    path.write_text(text)
    return launches.read_launches(spark, f"file://{path}")


def test_launch_files(spark, tmp_path):
    other = "N" + "1" * 35
    lines = [json.dumps({"mint": MINT, "name": 7, "symbol": "S", "observedAt": -5}), "", "{\"mint\": tru", json.dumps({"mint": MINT}), "[1]", "null", json.dumps({"mint": f" {other} ", "name": "n", "observedAt": 12.5})]
    rows = launch_file(spark, tmp_path, "\r\n".join(lines))
    assert tuple(one(launches.report(rows))) == (2, 4, 2, 1, 1)
    good = {r.mint: r for r in rows.where("reason IS NULL").collect()}
    assert good[MINT].name == "" and good[MINT].observedAt is None and good[other].observedAt == 12.5
    assert tuple(one(launches.report(launch_file(spark, tmp_path, " " + json.dumps([json.loads(x) for x in (lines[0], lines[3], lines[6])]))))) == (2, 1, 0, 0, 1)
    assert tuple(one(launches.report(launch_file(spark, tmp_path, "[broken")))) == (0, 0, 0, 0, 0)
    assert tuple(one(launches.report(launch_file(spark, tmp_path, "")))) == (0, 0, 0, 0, 0)
    rows = launch_file(spark, tmp_path, "\r\n".join(lines))
    stored = coins(spark, [{"mint": MINT, "firstSeen": T0, "lastSeen": T0}])
    got = {r.mint: r for r in launches.imported(stored, rows, T0 + 5).collect()}
    assert got[other].firstSeen == 12 and got[other].lastSeen == T0 + 5 and got[MINT].sightings == 2 and got[MINT].symbol == "S"


CARD = f"""<section><h2>Final <b>Stretch</b></h2><div data-pulse-token-address="{MINT}"><img src="https://c.example/{MINT}.webp" alt="Alt Name"><img src="https://c.example/q.png"><span>V</span><span>$80K</span><span>MC</span><span>$</span><span>3.05</span><span>K</span>
<span>M111...1111</span><span>TBC</span><span>Shown</span><span>14</span><span>s</span></div>
<div data-pulse-token-address="bad"><a href="https://l.example/coin/{MINT}">x</a><span>MC</span><span>0.0<sub>5</sub>4</span><span>Volume $12</span><span>M111…1111</span><span>T</span><span>4m</span></div></section><div data-pulse-token-address="{MINT}">VICTORY</div>"""


def test_cards(spark):
    rows = cards.cards(spark.createDataFrame([(1, CARD), (2, None), (3, "")], "page_id long, html string")).orderBy("pos").collect()
    assert len(rows) == 3
    a, b, c = rows
    assert (a.name, a.symbol, a.marketCap, a.volume, a.age, a.source, a.imageUrl) == ("Alt Name", "TBC", "$3.05K", "$80K", "14s", "final-stretch", f"https://c.example/{MINT}.webp")
    assert (b.mintHref, b.attrMint, b.marketCap, b.volume, b.name, b.symbol, b.age) == (f"/meme/{MINT}", None, None, "$12", None, "T", "4m")
    assert (c.volume, c.source, c.mintText) == (None, "other", None)


def test_all_card_pages_are_read(spark):
    """Cards without a name and with an age in pieces, too: the reference reads the age's number as the name and finds no age."""
    from echofold.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    every = {r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    alone = {r.page_id: r for r in QUERIES["PRJ6_cards"](spark, sf).collect()}
    key = lambda r, page: (page, *[str(x) for x in tuple(r)[1:]])
    assert sorted(key(r, r.page_id) for r in QUERIES["PRJ6_cards_all"](spark, sf).collect()) == sorted(key(r, k // 20) for k, r in alone.items())
    assert set(alone) == every
    rest = {k for k in every if k % 3 == 0 and k % 2}
    assert rest and all((alone[k].name, alone[k].ageSeconds, alone[k].symbol) == (str(k % 60), None, f"T{k % 100}") for k in rest)
    assert all(alone[k].name is None and alone[k].ageSeconds == (k % 60) * 60 for k in every if k % 6 == 0)


def test_card_reader_takes_time_with_the_page(spark):
    """Open tags, nested cards and unmatched ends by the hundred thousand; ranges as a walk over open elements would have them."""
    import time

    began = time.perf_counter()
    assert cards.listed("<div>x" * 180_000, cards.Markup()) == []
    nested = cards.listed(f"<div data-pulse-token-address='{MINT}'>x" * 8000, cards.Markup())
    assert len(nested) == 8000 and len(nested[-1]["tokens"]) == 1 and len(nested[0]["tokens"]) > 512
    assert cards.listed("<b>x</i>" * 100_000 + CARD, cards.Markup()) is not None
    assert time.perf_counter() - began < 30
    page = f"""<p>a<section>Final<div data-pulse-token-address=k>one<b>two<sub>3</sub>four</b><i>five</i><img src=s data-pulse-token-address=v><a href=h>six</a>
      <span data-pulse-token-address=n>seven<sub>8</sub></span></div>nine</section>ten<![odd thing]>eleven</section></div>"""
    found = {x["attribute"]: x for x in cards.listed(page, cards.Markup())}
    tokens = lambda key: [(t["text"], t["sub"]) for t in found[key]["tokens"]]
    assert tokens("k") == [("one", True), ("two", True), ("3", True), ("four", True), ("five", False), ("six", False), ("seven", True), ("8", True)]
    assert (tokens("v"), tokens("n")) == ([], [("seven", True), ("8", True)])
    assert all(x["heading"] == "Final one two 3 four five" for x in found.values())
    assert found["k"]["images"] == [{"src": "s", "alt": None}] and found["v"]["images"] == [] and (found["k"]["links"], found["n"]["links"]) == (["h"], [])


def test_scrubber(spark):
    rows = spark.createDataFrame([(1, "<p>a</p><script>x()</script><img src='data:image/png;base64,AAAA'><svg><path/></svg>"), (2, "mail me@x.example api_key = 1")], "page_id long, html string")
    got = {r.page_id: r for r in cards.scrubbed(rows).collect()}
    assert "script" not in got[1].html and "svg" not in got[1].html and "R0lGOD" in got[1].html and got[1].refused == []
    assert set(got[2].refused) == {"email address", "api key"}


def test_scrubber_keeps_wanted_sections(spark):
    card, link = '<section class="x"><b data-pulse-token-address="k">1</b></section>', '<section><a class="c" href="/meme/k">2</a></section>'
    pages = {1: f"<nav>a</nav>{card}<section>news me@x.example</section>{link.replace('<section', '<SECTION')}<p>end</p>", 2: "<p>me@x.example</p>", 3: "", 4: None, 5: f"<section><h2>all</h2>{card}</section>", 6: card.removesuffix("</section>")}
    rows = cards.scrubbed(spark.createDataFrame(list(pages.items()), "page_id long, html string"), markup=cards.Markup())
    got = {r.page_id: (r.html, r.refused) for r in rows.collect()}
    assert got == {1: (f"{card}\n{link}", []), 2: ("", ["no sections"]), 3: ("", ["no sections"]), 4: (None, ["no sections"]), 5: (card, []), 6: (card, [])}


def test_store_versions(spark, tmp_path):
    store = CoinStore(spark, f"file://{tmp_path}/store")
    assert store.read().isEmpty()
    store.replace(merge.fold(sightings(spark, [{"mint": "a"}])))
    store.replace(merge.upsert(store.read(), merge.folded(sightings(spark, [{"mint": "a"}, {"mint": "b"}]))))
    assert {r.mint: r.sightings for r in store.read().collect()} == {"a": 2, "b": 1}


def folders(store):
    commit = store.state()[1]
    return {x["folder"] for part in (commit["base"], *(r["leaves"] for r in commit["runs"])) for x in part.values() if x["folder"]}


def test_store_writers_and_old_versions(spark, tmp_path):
    path = f"{tmp_path}/store"
    fold = lambda mints: merge.folded(sightings(spark, [{"mint": m} for m in mints]))
    store, other = (CoinStore(spark, f"file://{path}") for _ in range(2))
    store.merge(fold("abcdefgh"))
    store.merge(fold("a"))
    assert {r.mint: r.sightings for r in store.read().collect()} == {"a": 2, **dict.fromkeys("bcdefgh", 1)}
    rows = store.read()
    other.merge(fold("z"))
    before = set(os.listdir(path))
    with pytest.raises(ConcurrentWrite):
        store.replace(rows.where("mint < 'c'"))
    with pytest.raises(ConcurrentWrite):
        store.remove(rows.select("mint"))
    assert store.read().count() == 9 and set(os.listdir(path)) == before
    store.replace(store.read().where("mint < 'c'"))
    for _ in range(12):
        store.merge(fold("ab"))
    assert {r.mint: r.sightings for r in store.read().collect()} == {"a": 14, "b": 13}
    kept = {x for x in os.listdir(path) if x.startswith("v-")}
    assert {f.split("/")[0] for f in folders(store)} <= kept and len(kept) <= 20 and len([x for x in os.listdir(f"{path}/_commits") if x.isdigit()]) <= 9
    os.makedirs(f"{path}/v-orphan")
    os.utime(f"{path}/v-orphan", (1, 1))
    store.merge(fold("a"))
    assert "v-orphan" not in os.listdir(path)


def test_a_refused_commit_leaves_no_folder(spark, tmp_path, monkeypatch):
    store = CoinStore(spark, f"file://{tmp_path}/store")
    batch = merge.folded(sightings(spark, [{"mint": "a"}]))
    store.merge(batch)
    number, commit = store.state()
    monkeypatch.setattr(store, "state", lambda: (number - 1, commit))  # as of before another writer's commit
    before = set(os.listdir(f"{tmp_path}/store"))
    with pytest.raises(ConcurrentWrite):
        store.merge(batch)
    assert set(os.listdir(f"{tmp_path}/store")) == before


def test_store_is_the_fold_after_many_batches(spark, tmp_path):
    """Twenty batches with gaps, repeats, verdicts and removals, against a plain fold; buckets split, runs are folded together,
    and what a small batch writes is as small as it is."""
    r = random.Random(3)
    store = CoinStore(spark, f"file://{tmp_path}/store", split_rows=60, ratio=4)
    held, seen, split = {}, set(), 0
    for k in range(20):
        own = [f"m{r.randrange(400)}" for _ in range(500 if k < 2 else 12)]
        rows = [{"mint": m, "name": r.choice([None, f"n{k}"]), "symbol": r.choice([None, f"s{k}"]), "marketCapUsd": r.choice([None, float(r.randrange(200_000))]), "seenAt": T0 + r.randrange(1000), "source": r.choice(["migrated", "other"])} for m in own]
        before = folders(store)
        store.merge(merge.folded(sightings(spark, rows)))
        for x in rows:
            h = held.setdefault(x["mint"], {"name": None, "symbol": None, "peak": None, "first": x["seenAt"], "last": x["seenAt"], "migrated": False, "n": 0, "phash": None})
            h["name"], h["symbol"] = h["name"] or x["name"], h["symbol"] or x["symbol"]
            h["peak"] = max((y for y in (h["peak"], x["marketCapUsd"]) if y is not None), default=None)
            h["first"], h["last"], h["migrated"], h["n"] = min(h["first"], x["seenAt"]), max(h["last"], x["seenAt"]), h["migrated"] or x["source"] == "migrated", h["n"] + 1
        commit = store.state()[1]
        seen.add((len(commit["runs"]), "base" if not commit["runs"] else "runs"))
        split = max(split, len(commit["base"]))
        if commit["runs"] and len(commit["runs"]) > 1:
            new = folders(store) - before
            assert all(f.startswith(tuple(x["folder"].split("/")[0] for x in commit["runs"][-1]["leaves"].values() if x["folder"])) for f in new)
            assert commit["runs"][-1]["rows"] <= 12 * 20
        if k % 5 == 3:
            gone, told = r.sample(sorted(held), 7), r.sample(sorted(held), 9)
            store.read()
            store.tell_hashes(spark.createDataFrame([(m, f"{k:016x}", "ok") for m in told], "mint string, phash string, phashState string"))
            store.remove(spark.createDataFrame([(m,) for m in gone], "mint string"))
            for m in told:
                held[m]["phash"] = f"{k:016x}"
            for m in gone:
                held.pop(m)
    want = {m: tuple(h.values()) for m, h in held.items()}
    fields = ["name", "symbol", "peakMcUsd", "firstSeen", "lastSeen", "sawMigrated", "sightings", "phash"]
    got = {x.mint: tuple(x[f] for f in fields) for x in store.read().collect()}
    assert got == want and split > 4 and {"base", "runs"} == {x for _, x in seen}
    some = r.sample(sorted(held), 3) + ["none"]
    found = store.read_keys(spark.createDataFrame([(m,) for m in some], "mint string"))
    assert {x.mint: tuple(x[f] for f in fields) for x in found.collect()} == {m: want[m] for m in some[:3]}
    assert 0 < store.opened <= 4 * (1 + len(store.state()[1]["runs"])) and store.opened < len(folders(store))
    assert all(x.ran == (x.sawMigrated or (x.peakMcUsd or 0) >= THRESHOLDS.min_peak_usd) for x in store.read().collect())


def test_index_follows_the_records(spark, tmp_path):
    """After each of merges, verdicts and removals the stored postings are those made anew; lists that shrank are filled up."""
    from dataclasses import replace

    from echofold.operators.candidates import counted_postings
    from echofold.sources.postings import PostingIndex

    r = random.Random(4)
    few = replace(THRESHOLDS, max_candidates=3)
    store = CoinStore(spark, f"file://{tmp_path}/store", split_rows=50)
    index = PostingIndex(store, few.max_candidates, split_rows=8)
    names = ["moon cat", "moon dog", "sun cat", "tiny", "moon", None]

    def check():
        assert index.follows() == store.seq()
        rows = lambda frame: sorted((x.kind, x.key, list(x.mints), x.n) for x in frame.collect())
        assert rows(index.table.read()) == rows(counted_postings(store.read(), 4))

    for k in range(3):
        rows = [{"mint": f"m{r.randrange(40):02d}", "name": r.choice(names), "symbol": r.choice([None, "mc", "tin"])} for _ in range(25)]
        batch = merge.folded(sightings(spark, rows))
        index.around(batch, lambda batch=batch: store.merge(batch))
        check()
        mints = sorted(x.mint for x in store.read().select("mint").collect())
        if k % 2:
            gone = spark.createDataFrame([(m,) for m in mints[: len(mints) // 4] + r.sample(mints, 3)], "mint string")
            index.around(gone, lambda gone=gone: store.remove(gone.distinct()))
        else:
            told = spark.createDataFrame([(m, r.choice(["0" * 16, f"{r.randrange(9):016x}"]), "ok") for m in r.sample(mints, 8)], "mint string, phash string, phashState string")
            index.around(told, lambda told=told: store.tell_hashes(told))
        check()
    rows = store.read()
    subjects = rows.where("mint like '%3' or mint like '%1'")
    listed = lambda frame: sorted((x.subject, list(x.mints), x.capped) for x in frame.collect())
    assert listed(index.candidates(subjects, few)) == listed(candidates(subjects, rows, few)) and listed(candidates(subjects, rows, few))
    one_key = spark.createDataFrame([("trigram", "moo")], "kind string, key string")
    assert index.table.read_keys(one_key).count() == 1 and index.table.opened < len(folders(index.table))
    store.merge(merge.folded(sightings(spark, [{"mint": "new", "name": "moon"}])))  # not through the index
    assert listed(index.candidates(subjects, few)) == listed(candidates(subjects, store.read(), few))
    with pytest.raises(ValueError):
        index.candidates(subjects)


def test_stream_epochs_by_query(spark, tmp_path):
    """A batch that is run again is merged once; a second query on the same store adds its own."""
    rows = sightings(spark, [{"mint": f"m{k % 3}", "seq": k} for k in range(9)])
    path = f"{tmp_path}/in"
    rows.coalesce(1).write.json(path)
    store = CoinStore(spark, f"file://{tmp_path}/store")
    for checkpoint in ("c1", "c2", "c1"):
        feed.fold_into(feed.sightings(spark, path), store, f"{tmp_path}/{checkpoint}", {"availableNow": True}).awaitTermination()
    assert {r.mint: r.sightings for r in store.read().collect()} == {"m0": 6, "m1": 6, "m2": 6}
    query = next(iter(store.state()[1]["epochs"]))
    store.merge(merge.folded(rows), (query, store.epoch(query)))
    assert {r.sightings for r in store.read().collect()} == {6}


def test_hash_of_a_subject(spark):
    stored = coins(spark, [{"mint": m, "name": m, "phash": "0" * 16} for m in "abc"])
    asked = spark.createDataFrame([("a", "x", None, None, True), ("b", "x", None, "f" * 16, True), ("c", "x", None, "f" * 16, False), ("d", "x", None, None, False)], "mint string, name string, symbol string, phash string, phashGiven boolean")
    assert {r.mint: r.phash for r in lookup.subjects_of(asked, stored).collect()} == {"a": None, "b": "f" * 16, "c": "0" * 16, "d": None}
    assert {r.phash for r in lookup.subjects_of(asked.drop("phashGiven"), stored).where("mint IN ('a', 'b')").collect()} == {None, "f" * 16}


def test_largest_clusters_first_and_last_cards(spark):
    found = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "b"), ("d", "d"), ("e", "d"), ("f", "f")], "mint string, cluster string")
    order = spark.createDataFrame([(m, i) for i, m in enumerate("fedcba")], "mint string, pos int")
    assert [r.cluster for r in cluster.largest_first(found, order).collect()] == ["d", "b", "f", "a"]
    cards_now = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("q", 1, "w")], "mint string, pos int, place string")
    assert [(r.mint, r.card.place) for r in lookup.on_cards(found, cards_now).collect()] == [("a", "z")]


def test_service(spark, tmp_path):
    service = Service(CoinStore(spark, f"file://{tmp_path}/service"))
    assert tuple(one(service.meta(T0))) == (0, 1, 0, 0, False)
    seen = service.observe(sightings(spark, [{"mint": "a", "name": "Moon Cat", "source": "migrated"}, {"mint": "b", "name": "moon cat"}]), T0)
    assert sorted(r.mint for r in seen.collect()) == ["a", "b"]
    later = T0 + THRESHOLDS.min_age_ms
    assert tuple(one(service.meta(later))) == (T0, 1, 2, THRESHOLDS.min_age_ms, True)
    asked = spark.createDataFrame([("b", "moon cat", None), ("z", "MOON  CAT!", "q")], "mint string, name string, symbol string")
    assert {r.mint: (r.ranCount, r.totalCount, r.confident) for r in service.lookup(asked, later).collect()} == {"b": (1, 1, True), "z": (1, 2, True)}
    rows = launch_file(spark, tmp_path, "\n".join(json.dumps({"mint": m, "name": "n"}) for m in (MINT, MINT, "x")))
    assert tuple(one(service.import_launches(rows, later))) == (1, 1) and tuple(one(service.import_launches(rows, later))) == (1, 0)
    assert service.record_hashes(spark.createDataFrame([("a", "0" * 16, "ok"), ("gone", None, "unavailable")], "mint string, phash string, state string")) == 1
    assert service.retain(T0 + THRESHOLDS.retention_ms + 1) == 1 and sorted(r.mint for r in service.store.read().collect()) == sorted(["a", MINT])


def test_pictures(spark, tmp_path):
    y, x = np.mgrid[0:32, 0:32]
    plane = np.where(np.hypot(x - 16, y - 16) < 32 / 3, 230, 25).astype(np.uint8)
    folder = tmp_path / "pictures"
    folder.mkdir()
    for name, data in {"circle": np.repeat(plane.reshape(-1, 1), 4, axis=1).tobytes(), "flat": bytes(4096), "cut": b"xx", "huge": bytes(THRESHOLDS.max_image_bytes + 1)}.items():
        (folder / f"{name}.rgba").write_bytes(data)
    got = {r.mint: (r.phash, r.state) for r in pictures.verdicts(spark, f"file://{folder}").collect()}
    assert got == {"circle": ("97686887659e9699", "ok"), "flat": (None, "degenerate"), "cut": (None, "unavailable"), "huge": (None, "unavailable")}


def interlaced(samples, color, depth_bits=8):
    """A PNG of bytes in seven passes, without filters."""
    import struct
    import zlib

    h, w, _ = samples.shape
    raw = b"".join(b"\0" + row.tobytes() for x, y, dx, dy in png.PASSES if x < w and y < h for row in samples[y::dy, x::dx])
    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, depth_bits, color, 0, 0, 1)), (b"IDAT", zlib.compress(raw)), (b"IEND", b"")]
    return png.SIGNATURE + b"".join(struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x)) for kind, x in parts)


def test_png_pixels():
    """All row filters, color types and odd sizes; palettes, transparency, bits, passes; what is broken says so."""
    rng = np.random.default_rng(1)
    for color, n in png.SAMPLES.items():
        for h, w in ((1, 1), (7, 5), (20, 33)):
            samples = rng.integers(0, 256, (h, w, n)).astype(np.uint8)
            palette = rng.integers(0, 256, 768).astype(np.uint8).tobytes()
            data = png.encode(samples, color, rng.integers(0, 5, h), palette if color == png.PALETTE else None)
            got = png.decode(data)
            if color == png.PALETTE:
                want = np.dstack([np.frombuffer(palette, np.uint8).reshape(-1, 3)[samples[..., 0]], np.full((h, w), 255)])
            else:
                want = np.dstack([samples[..., [0, 0, 0]] if n < 3 else samples[..., :3], samples[..., -1] if n in (2, 4) else np.full((h, w), 255)])
            assert (got == want).all()
    samples = rng.integers(0, 256, (13, 11, 3)).astype(np.uint8)
    assert (png.decode(interlaced(samples, png.RGB))[..., :3] == samples).all()
    good = png.encode(samples, png.RGB, np.full(13, png.PAETH))
    bad = [b"", good[:40], good[:-13], good[:60] + b"!" + good[61:], png.SIGNATURE + b"x" * 99, png.encode(samples[..., :1], png.PALETTE, np.zeros(13, int), b"abc"), png.encode(samples, png.RGB, np.full(13, 9))]
    for data in bad:
        with pytest.raises(png.BadPicture):
            png.decode(data)
    flat = np.zeros((64, 96, 4), np.uint8)
    flat[:, 48:] = (200, 100, 50, 255)
    small = png.shrunk(flat, 32)
    assert (small[:, :16] == 0).all() and (small[:, 16:] == (200, 100, 50, 255)).all()
    assert (png.shrunk(np.full((5, 3, 4), 77, np.uint8), 32) == 77).all()
    ramp = np.dstack([np.tile(np.arange(96, dtype=np.uint8), (96, 1))] * 3 + [np.full((96, 96), 255, np.uint8)])
    assert (png.shrunk(ramp, 32)[0, :, 0] == np.arange(32) * 3 + 1).all()  # means of threes


def test_png_verdicts(spark):
    """The published picture's hash from a PNG at several sizes and types; broken, oversized and palette files told apart."""
    y, x = np.mgrid[0:128, 0:128] // 4
    plane = np.where(np.hypot(x - 16, y - 16) < 32 / 3, 230, 25).astype(np.uint8)
    kinds = np.arange(128) % 5
    two = bytes([25] * 3 + [230] * 3)
    files = {"gray": png.encode(plane[..., None], png.GRAY, kinds), "rgba": png.encode(np.dstack([plane] * 3 + [np.full_like(plane, 255)]), png.RGBA, kinds), "palette": png.encode((plane[..., None] > 100).astype(np.uint8), png.PALETTE, kinds, two)}
    files |= {"broken": files["gray"][:-20], "huge": files["gray"] + bytes(THRESHOLDS.max_image_bytes), "flat": png.encode(np.zeros((9, 9, 1), np.uint8), png.GRAY, np.zeros(9, int)), "none": None}
    frame = spark.createDataFrame([(m, None if c is None else bytearray(c)) for m, c in files.items()], "mint string, content binary")
    got = {r.mint: (r.phash, r.state) for r in pictures.verdicts_of(frame).collect()}
    assert got == {"gray": ("97686887659e9699", "ok"), "rgba": ("97686887659e9699", "ok"), "palette": ("97686887659e9699", "ok"), "broken": (None, "unavailable"), "huge": (None, "unavailable"), "flat": (None, "degenerate"), "none": (None, "unavailable")}


def test_pictures_alike_are_undone_together(monkeypatch):
    """Many take as many predictions as their pieces have diagonals, not as they have; each picture is as if alone."""
    calls, predict = [], png.predicted
    rng = np.random.default_rng(2)
    square = [rng.integers(0, 256, (32, 32, 4)).astype(np.uint8) for _ in range(300)]
    files = [png.encode(x, png.RGBA, (np.arange(32) + k) % 5) for k, x in enumerate(square)]
    monkeypatch.setattr(png, "predicted", lambda *x: calls.append(0) or predict(*x))
    got = pictures.sampled(files)
    assert got == [x.tobytes() for x in square] and len(calls) <= 2 * 63
    gray = rng.integers(0, 256, (20, 33, 1)).astype(np.uint8)
    other = [png.encode(gray, png.GRAY, np.arange(20) % 5), png.encode(gray[:7], png.GRAY, np.arange(7) % 5), png.encode(gray, png.PALETTE, np.arange(20) % 5, bytes(range(256)) * 3), png.encode(gray, png.PALETTE, np.zeros(20, int), b"abc"), interlaced(square[0][:13, :11, :3], png.RGB)]
    wrong = [png.encode(square[0], png.RGBA, np.full(32, 9)), files[0][:-13], png.SIGNATURE, b"raw", b"", None]
    mixed = [x for k in range(11) for x in (files[k], (other + wrong)[k])]
    plain = [png.shrunk(png.decode(x), 32).tobytes() for x in other[:3] + other[4:]]
    want = [*plain[:3], None, plain[3], None, None, None, b"raw", b"", None]
    assert pictures.sampled(mixed) == [x for k in range(11) for x in (square[k].tobytes(), want[k])]


def test_shrunk_pictures_have_exact_means():
    """Halves are rounded up whatever the size and the opacity: 12.5 is 13, of all pixels and by share."""
    two = np.full((2, 1, 4), 255, np.uint8)
    two[0, 0, :3], two[1, 0, :3] = 12, 13
    for opacity in range(1, 256):
        two[..., 3] = opacity
        for picture in (two.repeat(32, axis=0), two.repeat(7, axis=0).repeat(3, axis=1)):
            assert (png.shrunk(picture, 1)[0, 0] == (13, 13, 13, opacity)).all()


def test_hashes_within_ten_bits(spark):
    """Against all pairs: neighbours at every distance about the bar, copies, nulls and other strings."""
    draw = random.Random(13)
    hashes = [draw.getrandbits(64) for _ in range(40)]
    for h in hashes[:40]:
        for n in (1, 4, 9, 10, 11, 12):
            hashes.append(h ^ sum(1 << k for k in draw.sample(range(64), n)))
    texts = [f"{h:016x}" for h in hashes] + [f"{h:016X}" for h in hashes[:5]] + [None, "", "xyz"]
    known, pairs = neighbours.near_hashes(spark.createDataFrame([(t,) for t in texts], "phash string"))
    distinct = sorted(set(hashes))
    want = {(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 10}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and {d for *_, d in want} >= {1, 4, 9, 10}
    assert {r.hash: r.n for r in known.collect()} == {f"{h:016x}": hashes.count(h) + (h in hashes[:5]) for h in hashes}


def test_silences(spark):
    draw = random.Random(14)
    rows = [(i, draw.choice("abc") if i % 40 else f"only{i}", draw.randrange(3_000_000)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, feed string, t long")
    want = []
    for feed_name in {r[1] for r in rows}:
        own, attempt, heard = sorted((t, i) for i, f, t in rows if f == feed_name), 0, 1
        for (a, _), (b, _) in zip(own, own[1:], strict=False):
            if b - a >= 60_000:
                attempt += 1
                want.append((feed_name, attempt, a, b, b - a, heard, 500, min(30_000, 500 * 2 ** min(attempt, 16))))
                heard = 0
            heard += 1
    for bucket in (50_000, 86_400_000):
        assert sorted(tuple(r) for r in feed.silences(frame, "feed", "t", "id", bucket_ms=bucket).collect()) == sorted(want) and len(want) > 20


def test_stream_folds_agree(spark, tmp_path):
    rows = sightings(spark, [{"mint": f"m{k % 3}", "name": "n" if k % 2 else None, "marketCapUsd": float(k), "seq": k, "source": "migrated" if k == 4 else "other"} for k in range(9)])
    path = f"{tmp_path}/in"
    for part in range(3):
        rows.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").json(path)
    store = CoinStore(spark, f"file://{tmp_path}/store")
    feed.fold_into(feed.sightings(spark, path), store, f"{tmp_path}/c1", {"availableNow": True}).awaitTermination()
    want = sorted(map(tuple, merge.folded(rows).select("mint", "name", "peakMcUsd", "sawMigrated", "sightings").collect()))
    assert sorted(map(tuple, store.read().select("mint", "name", "peakMcUsd", "sawMigrated", "sightings").collect())) == want
    out = f"{tmp_path}/out"
    feed.stateful_fold(feed.sightings(spark, path)).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c2").foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("mint").agg(F.max_by(F.struct("mint", "name", "peakMcUsd", "sawMigrated", "sightings"), "sightings").alias("r")).select("r.*")
    assert sorted(map(tuple, last.collect())) == want


def plain_seen(keys, cap):
    """The places that a plain loop admits."""
    held, out = {}, []
    for i, key in enumerate(keys):
        if key not in held:
            out.append(i)
            held[key] = None
            if len(held) > cap:
                held = dict.fromkeys(list(held)[cap // 2 :])
    return out


def test_bounded_dedupe_is_a_plain_loop(spark, tmp_path):
    """A memory far smaller than the keys, in batches that end anywhere in a generation, one of them empty and one run again."""
    draw = random.Random(9)
    for cap, n in ((2, 9), (6, 40), (40, 240)):
        keys = [f"k{min(draw.randrange(3 * cap), draw.randrange(3 * cap))}" for _ in range(n)]
        cuts = sorted({0, n, *(draw.randrange(n) for _ in range(2))})
        seen, got = feed.BoundedSeen(spark, cap), []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            batch = spark.createDataFrame([(keys[i], i, "x") for i in range(lo, hi)], "mint string, pos long, row string").repartition(3)
            got += [r.pos for r in seen.add(batch, "pos").collect()]
        assert sorted(got) == plain_seen(keys, cap) and len(got) > len(set(keys))
        assert seen.last.count() <= cap // 2 and seen.now.count() <= cap // 2
    with pytest.raises(ValueError):
        feed.BoundedSeen(spark, 5)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in range(3):
        spark.createDataFrame([(keys[i], i) for i in range(part * n // 3, (part + 1) * n // 3)], "mint string, pos long").coalesce(1).write.mode("append").parquet(source)
        for _ in range(2 if part == 1 else 1):
            stream = spark.readStream.schema("mint string, pos long").parquet(source)
            feed.dedupe_into(stream, out, f"{tmp_path}/state", "pos", cap, trigger={"availableNow": True}).awaitTermination()
            if part == 1 and _ == 0:  # as after a failure between the batch and its commit
                os.remove(f"{tmp_path}/state/commits/1")
                os.remove(f"{tmp_path}/state/commits/.1.crc")
    assert sorted(r.pos for r in spark.read.parquet(f"{out}/rows/*").collect()) == plain_seen(keys, cap)


def test_bounded_dedupe_passes_many_generations_a_step(spark, monkeypatch):
    """Steps go by rows, not by generations: hundreds of these in few steps, which end anywhere in one."""
    draw, steps = random.Random(4), []
    monkeypatch.setattr(feed, "STEP_ROWS", 400)
    monkeypatch.setattr(feed, "settled", lambda frame, name, *by: steps.append(name) or settled(frame, name, *by))
    keys = [f"k{min(draw.randrange(12), draw.randrange(12))}" for _ in range(1500)]
    seen = feed.BoundedSeen(spark, 4)
    rows = spark.createDataFrame([(x, k, "x") for k, x in enumerate(keys)], "mint string, pos long, row string").repartition(3)
    got = sorted((r.pos, r.mint, r.row) for r in seen.add(rows, "pos").collect())
    assert got == [(k, keys[k], "x") for k in plain_seen(keys, 4)] and len(got) > 600 and len(steps) == 6


def plain_fires(rows):
    """rows: (id, key, at, holds)."""
    ends, out = {}, set()
    for i, key, at, holds in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        if at >= ends.get(key, at):
            out.add(i)
            ends[key] = at + max(1, holds or 1)
    return out


@pytest.mark.parametrize("bucket", [1, 7, 100, 10_000])
def test_events_that_fire(spark, bucket):
    """Against a plain loop: bursts, ties, keys of one event, null keys, times and holds, buckets of any width."""
    draw = random.Random(bucket)
    rows = [(i, draw.choice(["a", "b", "c", None]) if i % 50 else f"only{i}", draw.choice([None, *[draw.randrange(1500) if i % 3 else draw.randrange(60)] * 9]), draw.choice([0, 1, 5, 40, 250, None])) for i in range(600)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, "event_id long, user string, t long, holds long")
    got = [r.event_id for r in throttle.fires(frame, F.col("holds"), "user", "t", "event_id", bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_fires(rows)
    if bucket == 100:
        fixed = [(i, k, t, throttle.COALESCE_MS) for i, k, t, _ in rows]
        assert {r.event_id for r in throttle.fires(frame, throttle.COALESCE_MS, "user", "t", "event_id", bucket).collect()} == plain_fires(fixed)
        assert throttle.fires(frame.limit(0), 5, "user", "t", "event_id").count() == 0


def test_alarms():
    assert feed.backoff_ms(0, draw=lambda: 0.0) == 500 and feed.backoff_ms(99, draw=lambda: 0.999) < 30_000
    assert feed.rate_alarm(40, 301_000) and not feed.rate_alarm(60, 301_000) and not feed.rate_alarm(0, 299_000)
    calls = []
    dog = feed.Watchdog(lambda: calls.append(1), 60_000)
    for at, n in ((0, 5), (59_000, 0), (61_000, 0), (62_000, 0), (130_000, 1), (189_000, 0)):
        dog.note(at, n)
    assert calls == [1]
    said = []
    report = feed.Report(lambda *x: said.append(x), 30_000)
    for at, n in ((0, 5), (29_000, 1), (30_000, 2), (31_000, 4), (60_000, 0), (90_000, 0)):
        report.note(at, n)
    assert said == [(8, 8), (4, 12), (0, 12)]


def differs_from_sql(spark, path, name, **tables):
    """Rows of a query and of its SQL over tables (schema, rows) that are not in both."""
    import duckdb

    from echofold.plans.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS FROM '{path}/{table}.parquet/*.parquet'")
    found = QUERIES[name](spark, f"file://{path}")
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return {tuple(r) for r in found.collect()} ^ set(want)


def test_dates_of_far_years_are_those_of_the_sql(spark, tmp_path):
    keys = [0, 1, 2612310, 2612311, 3_000_003, 90_000_000, 216_000_000]  # the year 10000 begins between the third and the fourth
    assert differs_from_sql(spark, tmp_path, "DT4_presentation", orders=("o_orderkey long, o_totalprice double", [(k, 1234.5) for k in keys])) == set()


STRIPES = [(k, "".join(chr(33 + (j * k + j // 128 * (k % 3) + (j % (k % 7 + 2) == 0) * 40) % 90) for j in range(128)) * 40) for k in range(1, 40)]


def test_pictures_of_repeated_lines_have_the_bits_of_the_sql(spark, tmp_path):
    """Coefficients that are zero or equal but for rounding: bits must not hang on the order of a sum's terms."""
    rows = [*STRIPES, (90, "ab" * 2100), (91, "abcd" * 64 + "dcba" * 64), (92, None), (93, "")]
    for name in ("MTH2_pixel_hash", "SRC9_pictures"):
        assert differs_from_sql(spark, tmp_path / name, name, documents=("doc_id long, text string", rows)) == set()


def test_clear_pixels_have_the_bits_of_the_sql_at_any_size(spark, tmp_path):
    """A NUL as every fourth byte is a clear pixel; odd pictures are at twice the size."""
    rows = [(k, "".join(chr(33 + (j * k + j // 128) % 90) if j % 4 < 3 or j // 4 % 32 > k + 4 else "\0" for j in range(4096))) for k in range(6)]
    assert differs_from_sql(spark, tmp_path, "SRC9_pictures", documents=("doc_id long, text string", rows)) == set()


def test_bad_launches_are_not_shuffled(spark):
    """Rows that are refused for themselves have few mints: a join by mint would put all of one into one task."""
    rows = spark.createDataFrame([(k, "null" if k % 2 else '{"mint":"%s"}' % ("M" * 35 + "123456789"[k // 2 % 9])) for k in range(400)], "pos long, value string")
    found = launches.checked(launches.json_rows(rows))
    assert launches.report(found).first()[:5] == (9, 391, 200, 0, 191)
    plan = found._jdf.queryExecution().optimizedPlan()
    bad = [x for x in (plan.children().apply(k) for k in range(plan.children().size())) if "Join" not in x.toString()]
    assert plan.nodeName() == "Union" and len(bad) == 1 and "isnotnull(reason" in bad[0].toString()


def test_few_of_records_with_the_same_keys_are_listed(spark, monkeypatch):
    """Of records with one name only the first are listed by key; the lists and capped candidates are those of all."""
    from echofold.operators import candidates as own

    rows = coins(spark, [{"mint": f"{k:04d}", "name": ("hot bolt", "hot bolts", "blue ring")[k % 3]} for k in range(300)]).drop("trigrams").withColumn("phash", F.lit(None).cast("string"))
    rows = merge.coin_trigrams(rows)
    listed, index_keys = [], own.index_keys
    whole = {(r.kind, r.key): r.mints[:7] for r in own.postings(rows, None).collect()}
    monkeypatch.setattr(own, "index_keys", lambda x: listed.append(x.count()) or index_keys(x))
    assert {(r.kind, r.key): r.mints for r in own.postings(rows, 7).collect()} == whole and listed == [21]
    few = replace(THRESHOLDS, max_candidates=6)
    got = {r.subject: (r.mints, r.capped) for r in own.candidates(rows.where("mint < '0030'"), rows, few).collect()}
    for k in range(30):
        mint = f"{k:04d}"
        same = [f"{x:04d}" for x in range(300) if x % 3 == k % 3 and x != k][:6]
        assert got[mint] == (same, True)


def test_records_with_the_same_change_are_compared_once(spark, tmp_path, monkeypatch):
    """An index follows many records whose keys change alike by one of them; its lists are those made anew."""
    from echofold.operators.candidates import counted_postings
    from echofold.sources import postings as own

    store = CoinStore(spark, f"file://{tmp_path}/store")
    index, compared, settled = own.PostingIndex(store, 3), [], own.settled

    def counted(frame, name, *more):
        out = settled(frame, name, *more)
        compared.extend([out.count()] if name == "index-change" else [])
        return out

    monkeypatch.setattr(own, "settled", counted)
    for field in ("name", "symbol"):
        batch = merge.folded(sightings(spark, [{"mint": f"m{k:02d}", field: ("moon cat", "sun: dog", None)[k % 3]} for k in range(60)]))
        index.around(batch, lambda batch=batch: store.merge(batch))
    gone = spark.createDataFrame([(f"m{k:02d}",) for k in range(30)], "mint string")
    index.around(gone, lambda: store.remove(gone))
    rows = lambda frame: sorted((x.kind, x.key, list(x.mints), x.n) for x in frame.collect())
    assert rows(index.table.read()) == rows(counted_postings(store.read(), 4)) != []
    assert compared == [2, 2 * 2 + 5 + 4]  # a symbol for each of two kinds of records; then their names, symbols and trigrams
