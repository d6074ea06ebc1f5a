"""State that ends, late publications, retries and live scoring."""

import datetime as dt
import os
import struct
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from detlake.streaming import events as E
from detlake.streaming import scoring as L

DAY = dt.datetime(2026, 1, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def stream_of(spark, folder, batches, schema):
    """One file a batch, in order."""
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema).coalesce(1)
        frame.write.mode("append").parquet(str(folder / f"batch={number:03d}"))
        for path in (folder / f"batch={number:03d}").glob("*.parquet"):
            os.utime(path, (1_000_000 + number, 1_000_000 + number))
    return E.read_stream(spark, f"{folder}/*", spark.createDataFrame([], schema).schema, max_files=1)


JOBS = "ts timestamp, inspection_id string, event_id bigint, event_type string"


def test_state_of_finished_jobs_ends(spark, tmp_path):
    jobs = [f"j{i}" for i in range(20)]
    first = [(at(0), j, i, "inspection_processing") for i, j in enumerate(jobs)]
    ended = [(at(1), j, 100 + i, "inspection_completed") for i, j in enumerate(jobs[:15])]
    later = [(at(60 + h), "open", 1000 + h, "inspection_queued") for h in range(3)]
    again = [(at(70), "j0", 5000, "inspection_redrive_requested"), (at(71), "j16", 5001, "inspection_failed")]
    stream = stream_of(spark, tmp_path / "in", [first, ended, later, later, again], JOBS)
    rows, sizes = [], []
    with E.state_store(spark, E.ROCKS):
        states = E.job_state_stream(stream, "1 hour")
        query = states.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).foreachBatch(lambda b, i: rows.extend(b.collect())).start()
        query.awaitTermination()
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) > 20 and sizes[-1] < 20  # fifteen jobs have gone
    last = {}
    for r in rows:
        last[r["inspection_id"]] = r
    assert (last["j1"]["state"], last["j1"]["events"], last["j1"]["attempts"]) == ("COMPLETED", 2, 1)
    assert (last["j0"]["state"], last["j0"]["events"]) == ("QUEUED", 1)  # counted anew after its state had ended
    assert (last["j16"]["state"], last["j16"]["events"]) == ("FAILED", 2)  # open jobs are kept


OUTBOX, SENT = "ts timestamp, event_id bigint, inspection_id string", "ts timestamp, event_id bigint"


def test_unpublished_rows_come_out_late(spark, tmp_path):
    outbox = stream_of(spark, tmp_path / "o", [[(at(h), h, f"j{h}") for h in range(6)], [(at(100), 99, "tick")]], OUTBOX)
    sent = stream_of(spark, tmp_path / "s", [[(at(1.5), 1, ), (at(2), 1), (at(2.25), 2), (at(40), 3)], [(at(100), 99)]], SENT)
    ages = E.run_to_table(E.queue_ages(outbox, sent, "24 hours", "3 hours"), "ages")
    got = {r["event_id"]: r["published_at"] for r in ages.collect()}
    # The row of hour 3 was published after the horizon; the tick is published at once.
    assert got == {0: None, 1: at(1.5), 2: at(2.25), 3: None, 4: None, 5: None, 99: at(100)}


def test_queue_metrics_and_retries(spark):
    rows = [(1, "a", at(0), at(0.5)), (2, "b", at(0.25), None), (3, "c", at(0.75), None), (4, "d", at(1), at(4))]
    ages = spark.createDataFrame(rows, "event_id bigint, inspection_id string, created_at timestamp, published_at timestamp")
    got = {r["window_start"]: r for r in E.queue_metrics(ages).collect()}
    assert (got[at(0)]["n"], got[at(0)]["unpublished"], got[at(0)]["oldest_unpublished"]) == (3, 2, at(0.25))
    assert (got[at(0)]["max_age"], got[at(1)]["mean_age"]) == (1800.0, 10800.0)
    events = [(at(0.1 * i), f"j{i % 2}", i, "inspection_retry_scheduled") for i in range(5)] + [(at(0), "j9", 9, "inspection_queued")]
    found = E.retries_per_window(spark.createDataFrame(events, JOBS)).collect()
    assert [tuple(r) for r in found] == [(at(0), 5, 2, 3)]


def png(width, height):
    def part(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + bytes(width) for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


class Boxes:
    """One box in each picture, too wide for small ones."""

    version, is_demo, is_experimental = "boxes-1", False, True

    def __call__(self, batch):
        return pd.DataFrame([(i, "open", 0.4, 1.0, 1.0, 12.0, 4.0) for i in batch["image_id"]],
                            columns=["image_id", "defect_type", "confidence", "x1", "y1", "x2", "y2"])


def test_live_scoring_follows_the_detector(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "wide.png").write_bytes(png(20, 10))
    (folder / "small.png").write_bytes(png(6, 6))
    (folder / "broken.png").write_bytes(b"no picture")
    root = str(tmp_path / "out")
    L.score_images(L.image_stream(spark, str(folder)), root, str(tmp_path / "cp"), Boxes).awaitTermination()
    report = spark.read.parquet(f"{root}/reports").collect()
    assert [r["inspection_id"].split("/")[-1] for r in report] == ["wide.png"]
    r = report[0]
    # 0.4 is shown under the experimental policy only.
    assert (r["overall_result"], r["is_experimental"], r["image_width"], r["image_height"]) == ("REVIEW_REQUIRED", True, 20, 10)
    assert r["inference_time_ms"] >= 0 and r["detections"][0]["severity"] == "medium" and len(r["limitations"]) == 2
    failed = spark.read.parquet(f"{root}/failed").collect()
    assert {f["inspection_id"].split("/")[-1]: f["issue"] for f in failed} == {"small.png": "out_of_bounds", "broken.png": "undecodable"}
    assert {f["error_code"] for f in failed} == {"INFERENCE_FAILED"}


@pytest.mark.parametrize("box, issue", [((0, 0, 5, 5), None), ((0, 0, 11, 5), "out_of_bounds"), ((5, 0, 5, 5), "invalid_detection"),
                                        ((0, float("nan"), 5, 5), "invalid_detection")])
def test_detections_are_checked_against_their_image(spark, box, issue):
    from detlake import schemas
    from detlake.operators import scoring as SC

    rows = spark.createDataFrame([("i", "open", 0.9, *map(float, box))], schemas.DETECTIONS)
    sizes = spark.createDataFrame([("i", 10, 10, 3), ("j", 10, 10, 4)], "image_id string, width int, height int, inference_time_ms int")
    got = {r["image_id"]: r for r in SC.inspection_reports(sizes, rows, "m").collect()}
    assert (got["i"]["issue"], got["i"]["status"]) == (issue, "FAILED" if issue else "COMPLETED")
    assert got["j"]["overall_result"] == "NO_VISIBLE_DEFECTS_DETECTED" and got["j"]["inference_time_ms"] == 4
    assert (got["i"]["overall_result"] is None) == bool(issue)
    assert SC.checked(rows.withColumn("image_id", F.lit("unknown")), sizes).first()["issue"] is not None
