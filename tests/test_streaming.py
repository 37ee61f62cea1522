"""The stateful stream of beacons against the batch recipe."""

import datetime
import json
import random

import pytest

from loglattice.events import derive
from loglattice.operators import recipes
from loglattice.schema import RAW
from loglattice.streaming import live

T0 = datetime.datetime(2026, 1, 1)


def flows(rng):
    """Events of regular, irregular and short flows, in segments, some without a source port."""
    out = []
    for f in range(8):
        at, port = T0, 1000
        for k in range(rng.choice([2, 4, 7, 12])):
            at += datetime.timedelta(seconds=60 + (rng.random() * 4 if f % 2 else rng.random() * 200))
            port += 1
            for _ in range(rng.randrange(1, 4)):  # segments of one connection
                seg = at + datetime.timedelta(milliseconds=rng.randrange(0, 900))
                out.append({"ts": seg.isoformat() + "Z", "source": "pcap", "host": f"h{f % 3}", "src_ip": f"10.0.0.{f}", "dst_ip": "10.9.9.9", "dst_port": 443 if f % 4 else None, "src_port": port if f != 5 else None})
    return [r | {"id": k} for k, r in enumerate(out)]


@pytest.mark.parametrize("seed", [0, 1])
def test_beacons_in_any_order_equal_the_batch(spark, tmp_path, seed):
    pytest.importorskip("google.protobuf")
    rng = random.Random(seed)
    rows = flows(rng)
    batch = derive(spark.createDataFrame([tuple(r.get(f.name) for f in RAW.fields) for r in rows], RAW))
    want = {tuple(r[c] for c in live.FLOW): (r.connections, r.mean_interval_s, r.jitter) for r in recipes.beaconing(batch).collect()}
    assert want
    shuffled = rng.sample(rows, len(rows))
    src = tmp_path / "in"
    src.mkdir()
    for k in range(5):
        (src / f"{k}.json").write_text("\n".join(json.dumps(r) for r in shuffled[k::5]))
    late = {"ts": "2026-01-02T00:00:00Z", "source": "pcap", "host": "zz", "dst_ip": "10.9.9.8", "id": 10**6}
    live.state_store(spark)
    try:
        def run():
            stream = live.beacons(live.read_json(spark, str(src), 1), late="2 hours")
            live.write(stream, str(tmp_path / "out"), str(tmp_path / "cp")).processAllAvailable()
            for q in spark.streams.active:
                q.stop()

        run()
        (src / "z.json").write_text(json.dumps(late))  # moves the watermark past all others; the query goes on from its checkpoint
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        key = tuple(r[c] for c in live.FLOW)
        if key not in last or r.connections > last[key].connections:
            last[key] = r
    got = {k: (r.connections, r.mean_interval_s, r.jitter) for k, r in last.items() if r.regular}
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=0.011)
