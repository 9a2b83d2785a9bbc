"""Streams over small planted tables, batch by batch."""

import datetime as dt
from decimal import Decimal

from pricelode.streaming import streams as T

KINDS = "variant_id long, store_id long, ts timestamp, price decimal(12,2)"


def test_interval_stream_replays_natively_and_replaces_a_batch_that_is_tried_again(spark, tmp_path):
    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    row = lambda v, t, p: (v, 1, t, None if p is None else Decimal(p))
    lots = [
        # Out of order; of one time the lowest price counts; 99 is no plausible change, a price or a time may be missing.
        [row(1, at(3), "12"), row(1, at(1), "10"), row(1, at(2), "99"), row(1, at(2, 5), "11"), row(1, at(2, 5), "10.5"), row(2, at(1), "5"), row(2, at(2), None), row(2, None, "6")],
        # Later than a later one, but within the delay: it goes between.
        [row(1, at(8), "12"), row(1, at(2, 9), "11"), row(2, at(7), "20"), row(2, at(10), "20")],
        # Held against 12 and 20; a row that the watermark has passed is dropped.
        [row(1, at(12), "50"), row(1, at(13), "48"), row(1, at(1, 1), "9"), row(2, at(12), "5"), row(3, at(12), "7")],
        [row(-1, at(30), "1")],
    ]
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        stream = spark.readStream.schema(KINDS).parquet(folder)
        query = T.stream_price_intervals(stream, out, state, "7 days", compact=2).trigger(availableNow=True).start()
        query.awaitTermination()
        return {s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]}

    def opened():
        rows = T.read_price_intervals(spark, out).where("variant_id > 0").collect()
        assert all(r.prev_ended_at == (None if r.old_price is None else r.started_at) for r in rows)
        return sorted((r.variant_id, r.started_at, float(r.price), None if r.old_price is None else float(r.old_price)) for r in rows)

    names = set()
    for lot in lots:
        spark.createDataFrame(lot, KINDS).coalesce(1).write.mode("append").parquet(folder)
        names |= run()
    # No pair is a key of a Python processor.
    assert names == {"stateStoreSave"}
    want = [
        (1, at(1), 10.0, None), (1, at(2, 5), 10.5, 10.0), (1, at(2, 9), 11.0, 10.5), (1, at(3), 12.0, 11.0), (1, at(13), 48.0, 12.0),
        (2, at(1), 5.0, None), (2, at(7), 20.0, 5.0), (2, at(12), 5.0, 20.0), (3, at(12), 7.0, None),
    ]
    assert opened() == want
    done = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    for name in (f"{done}", f".{done}.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    run()
    assert (tmp_path / "state" / "commits" / f"{done}").exists()
    assert opened() == want
    assert len(list((tmp_path / "out").glob("base-*"))) <= 2
