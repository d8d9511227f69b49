"""Closures by a stream of snapshots, in any order of arrival."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from emberline.operators import keyed
from emberline.streaming import snapshots

PUBLISHED = F.try_to_timestamp  # of the time in a document
DAYS = {1: ["r1", "r2", "r3"], 2: ["r1"], 3: ["r1", "r3"], 4: []}


def document(day, ids):
    return f"<f><at>2024-02-0{day}T00:00:00</at>" + "".join(f'<situationRecord id="{i}"><v>{day}</v></situationRecord>' for i in ids) + "</f>"


def test_any_order_of_arrival(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 2, n)
    want = {"r1": ("3", day(3), day(4)), "r2": ("1", day(1), day(2)), "r3": ("3", day(3), day(4))}
    orders = [(1, 2, 3, 4), (4, 3, 2, 1), (3, 1, 4, 2)]
    for n, order in enumerate(orders):
        landing, table = tmp_path / f"l{n}", f"file://{tmp_path}/t{n}"
        landing.mkdir()
        (landing / "broken.xml").write_text("<f><at>2024-02-09T00:00:00</at><situationRecord>")

        def run():
            published = PUBLISHED(F.regexp_extract(F.col("content").cast("string"), "<at>(.*?)</at>", 1))
            stream = snapshots.document_stream(spark, str(landing), files_a_batch=2)  # noqa: B023
            snapshots.snapshot_stream(stream, table, f"{tmp_path}/c{n}", published).awaitTermination()  # noqa: B023

        assert snapshots.presence(spark, table) is None
        for some in itertools.batched(order, 2):
            for d in some:
                (landing / f"d{d}.xml").write_text(document(d, DAYS[d]))
                (landing / f"again{d}.xml").write_text(document(d, DAYS[d][:1]))  # a part of the same snapshot, once more
            run()
        run()
        got = {r.record_id: (r["values"]["v"], r.snapshot, r.gone_at) for r in snapshots.presence(spark, table).collect()}
        assert got == want
        if n == 0:
            (landing / "d5.xml").write_text(document(5, ["r2"]))
            run()
            got = {r.record_id: (r.snapshot, r.gone_at) for r in snapshots.presence(spark, table).collect()}
            assert got == {"r1": (day(3), day(4)), "r2": (day(5), None), "r3": (day(3), day(4))}


def test_batches_broadcast_nothing(spark, tmp_path, monkeypatch):
    """Even an empty broadcast takes a page of the driver's memory, for each batch again."""
    plans = []
    for module in (snapshots, keyed):
        own = module.written
        monkeypatch.setattr(module, "written", lambda df, *more, own=own: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, *more))
    (tmp_path / "l").mkdir()
    for d in DAYS:
        (tmp_path / f"l/d{d}.xml").write_text(document(d, DAYS[d]))
    (tmp_path / "l/broken.xml").write_text("<f><at>2024-02-03T00:00:00</at><situationRecord>")
    published = PUBLISHED(F.regexp_extract(F.col("content").cast("string"), "<at>(.*?)</at>", 1))
    stream = snapshots.document_stream(spark, str(tmp_path / "l"), files_a_batch=5)
    snapshots.snapshot_stream(stream, f"file://{tmp_path}/t", f"{tmp_path}/c", published).awaitTermination()
    assert plans and not any("Broadcast" in p for p in plans)
    got = {r.record_id: (r.snapshot.day, r.gone_at.day) for r in snapshots.presence(spark, f"file://{tmp_path}/t").collect()}
    assert got == {"r1": (2, 4), "r2": (1, 2), "r3": (1, 2)}  # all parts of a snapshot that has a broken one are left out
