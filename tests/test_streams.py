"""The launch feed's source and the timed state, against plain versions."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from echofold.model import THRESHOLDS
from echofold.streaming import retire, source

MINT = "M" + "1" * 35


def frames(n, seed):
    draw = random.Random(seed)
    lines = []
    for k in range(n):
        good = {"txType": "create", "mint": MINT, "name": f"n{k}" * draw.randint(1, 9), "symbol": "é漢", "uri": None, "observedAt": k}
        kinds = [json.dumps(good), json.dumps(good, ensure_ascii=False), json.dumps(good | {"txType": "buy"}), json.dumps(good | {"message": "x"}), json.dumps(good | {"mint": "short"}), json.dumps(good | {"mint": 7}), '{"txType', "[1]", "null", ""]
        lines.append(draw.choice(kinds))
    return lines


def want(lines):
    out = []
    for line in lines:
        try:
            x = json.loads(line)
        except ValueError:
            continue
        if isinstance(x, dict) and x.get("txType") == "create" and "message" not in x and x.get("mint") == MINT:
            out.append((x["name"], float(x["observedAt"])))
    return out


@pytest.mark.parametrize("piece,tail", [(1, 3), (37, 5), (1 << 20, 1 << 16)])
def test_pieces_hold_each_line_once(tmp_path, monkeypatch, piece, tail):
    """Ranges of any width; lines longer than a piece; a last line that is still being written is left for later."""
    monkeypatch.setattr(source, "PIECE_BYTES", piece)
    monkeypatch.setattr(source, "TAIL_BYTES", tail)
    reader = source.FeedReader({"path": str(tmp_path), "progress": str(tmp_path / "progress")})
    assert reader.latestOffset() == {} and reader.partitions({}, {}) == []
    first, rest = frames(40, 1), frames(30, 2)
    shard = tmp_path / "a.log"
    shard.write_bytes(("\n".join(first) + "\n" + '{"txType": "cre').encode())
    (tmp_path / "_other").write_text("x\n")

    def rows(start, end):
        return [(r["name"], r["observedAt"]) for p in reader.partitions(start, end) for batch in reader.read(p) for r in batch.to_pylist()]

    end = reader.latestOffset()
    assert rows({}, end) == want(first)
    shard.write_bytes(("\n".join([*first, *rest]) + "\n").encode())
    (tmp_path / "b.log").write_bytes(("\n".join(rest) + "\n").encode())
    later = reader.latestOffset()
    assert sorted(rows(end, later)) == sorted(want(rest) * 2) and rows(later, later) == []
    reader.commit(later)
    assert json.loads((tmp_path / "progress/committed.json").read_text()) == later


def test_reading_is_tried_again():
    waits, left = [], [3]

    def act():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("away")
        return "read"

    assert source.patiently(act, 5, waits.append) == "read" and len(waits) == 3 and all(0.5 <= w <= 30 for w in waits)
    with pytest.raises(OSError):
        source.patiently(lambda: (_ for _ in ()).throw(OSError()), 2, waits.append)
    with pytest.raises(ValueError):
        source.patiently(lambda: (_ for _ in ()).throw(ValueError()), 2, waits.append)


def test_feed_restarts_where_it_stopped(spark, tmp_path):
    log, out = tmp_path / "log", f"{tmp_path}/out"
    log.mkdir()
    lines = []
    for part in range(3):
        own = frames(60, part + 5)
        with open(log / f"{part % 2}.log", "a") as f:
            f.write("\n".join(own) + "\n")
        lines += own
        run = source.launch_feed(spark, f"file://{log}").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state")
        run.trigger(availableNow=True).start().awaitTermination()
        assert sorted((r.name, r.observedAt) for r in spark.read.parquet(out).collect()) == sorted(want(lines))


def plain_retired(rows, keep, floor):
    """rows: (mint, at, seq, source, mc) in the order of a time-ordered stream."""
    lives, out = {}, []
    for mint, at, seq, src, mc in sorted(rows, key=lambda r: (r[1], r[2])):
        life = lives.get(mint)
        if life and not life["ran"] and at > life["last"] + keep:
            out.append((mint, life["first"], life["last"], life["n"]))
            life = None
        life = life or {"first": at, "last": at, "n": 0, "ran": False}
        life = {"first": life["first"], "last": at, "n": life["n"] + 1, "ran": life["ran"] or src == "migrated" or (mc or 0) >= floor}
        lives[mint] = life
    end = max(r[1] for r in rows)
    return sorted(out + [(m, x["first"], x["last"], x["n"]) for m, x in lives.items() if not x["ran"] and x["last"] + keep <= end])


def test_records_are_retired(spark, tmp_path):
    draw = random.Random(15)
    keep = 5_000
    rows = [(f"m{draw.randrange(30)}", draw.randrange(100_000), k, draw.choice(["other"] * 12 + ["migrated"]), draw.choice([None, 5.0, 5.0, 5.0, 200_000.0 if k % 9 == 0 else 1.0])) for k in range(400)]
    schema = "mint string, name string, symbol string, marketCapUsd double, source string, seenAt long, seq long"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", retire.ROCKS)
    try:
        for part in range(3):
            own = [(m, f"n{seq}", None, mc, src, at, seq) for m, at, seq, src, mc in rows if at * 3 // 100_000 == part]
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            found = retire.retired(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), thresholds=replace(THRESHOLDS, retention_ms=keep))
            run = found.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
            run.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.schema(retire.RETIRED).parquet(f"{tmp_path}/out")
    assert sorted((r.mint, r.firstSeen, r.lastSeen, r.sightings) for r in got.collect()) == plain_retired(rows, keep, THRESHOLDS.min_peak_usd)
    assert got.where(F.col("name").isNull()).count() == 0 and got.count() > 20


def test_stateful_fold_makes_one_frame_a_key(spark, tmp_path, monkeypatch):
    """Rows of a key are folded as plain values, over batches with gaps in texts and figures; equal to the batch fold."""
    import inspect

    from echofold.operators import merge
    from echofold.streaming import feed

    schema = "mint string, name string, symbol string, imageUrl string, marketCapUsd double, volumeUsd double, seenAt long, source string, seq long"
    draw, rows = random.Random(2), []
    for k in range(60):
        text = lambda p: draw.choice([None, f"{p}{k}"])  # noqa: E731, B023
        rows.append((f"m{k % 4}", text("n"), text("s"), None, draw.choice([None, float(k)]), None if k % 4 else 1.5, 1000 + draw.randrange(500), draw.choice(["migrated", "other"]) if k % 4 == 1 else "other", draw.randrange(10**6)))
    for part in range(2):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run = feed.stateful_fold(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").foreachBatch(lambda found, _: found.write.mode("append").parquet(f"{tmp_path}/out"))
        run.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("sightings").collect():
        got[r.mint] = tuple(r)
    first = lambda own, c: min(((r[8], r[c]) for r in own if r[c] is not None), default=(0, None))[1]
    for mint in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == mint]
        top = lambda c: max((r[c] for r in own if r[c] is not None), default=None)  # noqa: E731, B023
        assert got[mint] == (mint, first(own, 1), first(own, 2), None, min(r[6] for r in own), top(6), top(4), top(5), any(r[7] == merge.MIGRATED for r in own), len(own))
    assert inspect.getsource(feed.stateful_fold).count("pd.DataFrame(") == 1


def test_a_batch_of_a_key_takes_few_state_calls():
    """Each call of the state or a timer is a trip to the JVM: four a key and batch, however many rows it has."""
    from pyspark.sql import Row

    calls = []

    class Stub:
        held = None

        def __getattr__(self, name):
            if name in ("getValueState", "getMapState"):
                return lambda *_: self
            return lambda *x: calls.append(name) or (self._set(x[0]) if name == "update" else self.held if name == "get" else False)

        def _set(self, value):
            self.held = value

    own = retire.Retirement(THRESHOLDS)
    own.init(Stub())
    row = lambda k: Row(seenAt=k, seq=k, source="other", marketCapUsd=None, name=f"n{k}", symbol=None)
    assert not list(own.handleInputRows(("m",), iter([row(k) for k in range(50)]), None)) and calls == ["get", "registerTimer", "update"]
    calls.clear()
    assert not list(own.handleInputRows(("m",), iter([row(k) for k in range(50, 90)]), None)) and calls == ["get", "deleteTimer", "registerTimer", "update"]
    assert [tuple(r) for r in own.handleExpiredTimer(("m",), None, None)] == [("m", "n0", None, 0, 89, None, 90)]
