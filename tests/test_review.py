"""Ledgers, adjudication, derived candidates, run contracts, jobs and streams."""

import pytest
from pyspark.sql import functions as F

from detlake.operators import derive as Y
from detlake.operators import jobs as J
from detlake.operators import review as W
from detlake.operators import runs as U
from detlake.sinks.tables import write_packet
from detlake.streaming import events as E

DECISION = ("batch_hash string, packet_sha256 string, reviewer string, reviewed_at string, case_id string,"
            " answers map<string,string>, rationale string")


def decision(batch, reviewer, time, case, answer, packet="p", field="relationship", rationale="seen"):
    return (batch, packet, reviewer, time, case, {field: answer}, rationale)


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame([(f"c{i}", "near") for i in range(4)], "case_id string, kind string")


def test_ledger_states(spark, catalog):
    t = "2026-01-0{}T00:00:00Z"
    first = spark.createDataFrame([
        decision("b1", "ann", t.format(1), "c0", "related"), decision("b1", "ann", t.format(1), "c1", "related"),
        decision("b1", "ann", t.format(1), "c2", "needs_reference")], DECISION)
    ledger, changed = W.append_batch(None, first, catalog, "p")
    assert changed
    again, changed = W.append_batch(ledger, first, catalog, "p", "h" * 64)
    assert not changed and again is ledger
    second = spark.createDataFrame([decision("b2", "bob", t.format(1), "c1", "unrelated")], DECISION)
    ledger, _ = W.append_batch(ledger, second, catalog, "p", "h" * 64)
    states = {r["case_id"]: r["status"] for r in W.review_states(catalog, ledger).collect()}
    assert states == {"c0": "recorded", "c1": "conflicting", "c2": "needs_reference", "c3": "unreviewed"}
    change = spark.createDataFrame([decision("b3", "bob", t.format(2), "c1", "related")], DECISION)
    ledger, _ = W.append_batch(ledger, change, catalog, "p", "h" * 64)
    final = W.review_states(catalog, ledger)
    assert final.filter("case_id = 'c1'").first()["status"] == "recorded"
    assert W.replay_differences(catalog, ledger, final).isEmpty()
    late = spark.createDataFrame([decision("b4", "bob", t.format(2), "c1", "unrelated")], DECISION)
    with pytest.raises(ValueError, match="later"):
        W.append_batch(ledger, late, catalog, "p", "h" * 64)
    with pytest.raises(ValueError, match="hash"):
        W.append_batch(None, first, catalog, "p", "h" * 64)


@pytest.mark.parametrize("change, reason", [
    ({"packet": "q"}, "packet_mismatch"), ({"reviewer": " "}, "invalid_reviewer"),
    ({"time": "2026-01-01T00:00:00"}, "invalid_review_time"), ({"case": "zz"}, "unknown_case"),
    ({"rationale": ""}, "invalid_rationale"), ({"field": "other"}, "wrong_fields"), ({"answer": "maybe"}, "invalid_answer")])
def test_bad_decisions_are_refused(spark, catalog, change, reason):
    values = {"batch": "b", "reviewer": "ann", "time": "2026-01-01T00:00:00Z", "case": "c0", "answer": "related", **change}
    row = spark.createDataFrame([decision(**values)], DECISION)
    assert [r["reason"] for r in W.decision_issues(row, catalog, "p").collect()] == [reason]


def test_repeated_case_in_a_batch(spark, catalog):
    row = decision("b", "ann", "2026-01-01T00:00:00Z", "c0", "related")
    issues = W.decision_issues(spark.createDataFrame([row, row], DECISION), catalog, "p")
    assert {r["reason"] for r in issues.collect()} == {"repeated_case"}


def test_adjudication_reopens_when_notes_arrive(spark):
    obs = spark.createDataFrame([("c", 0, "ann", "h0")], "case_id string, ordinal int, reviewer string, note_hash string")
    pick = spark.createDataFrame([("c", "keep_label")], "case_id string, action string")
    decided = W.adjudicate(obs, pick, "exp", "2026-01-01T00:00:00Z", 1)
    assert W.adjudication_status(obs, decided).first()["status"] == "resolved"
    more = obs.union(spark.createDataFrame([("c", 1, "bob", "h1")], obs.schema))
    assert W.adjudication_status(more, decided).first()["status"] == "pending"
    assert W.new_observations(more, obs).count() == 1


def test_corrected_release(spark):
    box = "class_id bigint, x1 double, y1 double, x2 double, y2 double"
    ann = spark.createDataFrame([(1, 0, 0, 10.0, 20.0, 30.0, 40.0), (1, 1, 1, 0.0, 0.0, 5.0, 5.0)],
                                f"image_id bigint, annotation_index bigint, {box}")
    edits = spark.createDataFrame([(1, 0, "replace", 1, 11.0, 21.0, 31.0, 41.0), (1, 1, "delete", 1, 0.0, 0.0, 5.0, 5.0)],
                                  f"image_id bigint, annotation_index bigint, action string, {box}")
    add = spark.createDataFrame([(1, 1, 70.0, 60.0, 80.0, 70.0)], f"image_id bigint, {box}")
    done = spark.createDataFrame([("c", "resolved")], "case_id string, status string")
    result = W.corrected_release(ann, done, edits, add)
    assert sorted((r["origin"], r["x1"]) for r in result.collect()) == [("added", 70.0), ("replaced", 11.0)]
    log = {r["action"]: r for r in W.change_log(ann, edits, add).collect()}
    assert log["replace"]["before"]["x1"] == 10.0 and log["delete"]["after"] is None and log["add"]["before"] is None
    with pytest.raises(ValueError, match="resolved"):
        W.corrected_release(ann, done.withColumn("status", F.lit("pending")), edits, add)
    idle = ann.filter("annotation_index = 0").withColumn("action", F.lit("replace"))
    with pytest.raises(ValueError, match="idle"):
        W.corrected_release(ann, done, idle, add)
    with pytest.raises(ValueError, match="duplicates"):
        W.corrected_release(ann, done, edits, add.union(add))


def test_resolution_rules(spark):
    cases = spark.createDataFrame([("a", "annotation", 100, 80), ("p", "prediction", 100, 80)],
                                  "case_id string, subject_kind string, width int, height int")
    rows = [("a", "correct_label", 1, 11.0, 21.0, 31.0, 41.0), ("p", "keep_label", None, None, None, None, None)]
    schema = "case_id string, action string, class_id int, x1 double, y1 double, x2 double, y2 double"
    got = W.resolution_issues(spark.createDataFrame(rows, schema), cases, 2)
    assert [(r["case_id"], r["reason"]) for r in got.collect()] == [("p", "action_not_applicable")]
    rows = [("a", "correct_label", 1, 11.0, 21.0, 131.0, 41.0), ("p", "add_label", None, None, None, None, None)]
    got = W.resolution_issues(spark.createDataFrame(rows, schema), cases, 2)
    assert {r["reason"] for r in got.collect()} == {"annotation_out_of_bounds", "annotation_presence"}


def test_packet_and_derived_candidate(spark):
    images = spark.createDataFrame(
        [("a", 0, "train", 0, "pa", 20, 20), ("b", 1, "validation", 1, "pb", 20, 20), ("c", 2, "test", 255, "pc", 20, 20)],
        "image_id string, ordinal int, split string, signature bigint, pixel_sha256 string, width int, height int")
    ann = spark.createDataFrame([("a", 0, 1, 1.0, 1.0, 19.01, 2.0), ("b", 0, 1, 1.0, 1.0, 30.0, 2.0)],
                                "image_id string, annotation_index bigint, category_id bigint, x double, y double, w double, h double")
    packet = Y.build_packet(images, ann)
    summary = {r["what"]: r["n"] for r in packet.summary().collect()}
    assert summary == {"images": 3, "groups": 3, "cross_split_groups": 0, "pair_cases": 0, "near_cases": 1, "box_cases": 1}
    near = packet.near_cases.first()["case_id"]
    box = packet.box_cases.first()["case_id"]

    def run(relation, correction):
        rows = [decision("b", "ann", "2026-01-01T00:00:00Z", near, relation),
                decision("b", "ann", "2026-01-01T00:00:00Z", box, correction, field="correction")]
        ledger, _ = W.append_batch(None, spark.createDataFrame(rows, DECISION), packet.catalog(), "p")
        return Y.derive_candidate(packet, ann, ledger)

    good = run("related", "accept")
    assert good.blockers.isEmpty() and good.groups.select("group_id").distinct().count() == 2
    assert good.annotations.filter("corrected").first()["w"] == pytest.approx(19.0)
    assert [r["image_id"] for r in good.invalid_boxes.collect()] == ["b"]
    bad = run("needs_reference", "reject")
    assert sorted(r["reason"] for r in bad.blockers.collect()) == ["border_correction_rejected", "needs_reference"]
    assert bad.invalid_boxes.count() == 2
    assert Y.inventory_differences(images, images.withColumn("width", F.lit(1)), ["width"]).count() == 3


def test_history_contract(spark):
    rows = [("r", 1, True, 1, 165, 165, False, 300, 165), ("r", 2, False, 166, 300, 135, True, 300, 165)]
    schema = ("run_id string, pass int, pass_complete boolean, step_start bigint, step_end bigint, train_steps bigint,"
              " has_validation boolean, max_steps bigint, training_views bigint")
    checks = U.history_checks(spark.createDataFrame(rows, schema)).first().asDict()
    assert all(v for k, v in checks.items() if k != "run_id")
    broken = [rows[0], ("r", 2, False, 167, 300, 135, True, 300, 165)]
    checks = U.history_checks(spark.createDataFrame(broken, schema)).first().asDict()
    assert not checks["steps_contiguous"] and not checks["steps_counted"] and checks["budget_met"]


def test_history_page_bounds(spark):
    jobs = spark.createDataFrame([(str(i), "o", float(i)) for i in range(30)], "id string, owner_id string, created_at double")
    assert [r["id"] for r in J.history(jobs, "o", 2, 1).collect()] == ["28", "27"]
    for limit in (0, 101):
        with pytest.raises(ValueError):
            J.history(jobs, "o", limit)


COMMANDS = "ts timestamp, inspection_id string, event_id string, kind string, token string, at double, lease_until double"


def commands(spark, rows):
    # Far from the epoch, where the first watermark already lies.
    day = 86400.0
    full = [(r[0], f"e{i}", r[1], r[2], r[3] + day, None if r[4] is None else r[4] + day)
            for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "inspection_id string, event_id string, kind string, token string, at double, lease_until double")
    return df.withColumn("ts", F.timestamp_seconds("at")).select("ts", "inspection_id", "event_id", "kind", "token", "at", "lease_until")


def stream_of(spark, df, tmp_path, parts=1):
    for i in range(parts):
        df.filter(F.substring("event_id", 2, 9).cast("int") % parts == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return E.read_stream(spark, str(tmp_path / "in"), df.schema)


def test_stale_tokens_and_expired_leases_are_fenced(spark, tmp_path):
    df = commands(spark, [
        ("j", "claim", "t1", 0.0, 120.0), ("j", "claim", "t2", 60.0, 180.0), ("j", "result", "t0", 70.0, None),
        ("j", "renew", "t1", 100.0, 220.0), ("j", "result", "t1", 200.0, None), ("j", "result", "t1", 210.0, None),
        ("k", "claim", "u1", 0.0, 120.0), ("k", "result", "u1", 121.0, None), ("k", "claim", "u2", 130.0, 250.0),
        ("k", "claim", "u3", 260.0, 380.0), ("k", "claim", "u4", 400.0, 500.0),
    ])
    out = E.run_to_table(E.fenced_results(stream_of(spark, df, tmp_path)), "fence")
    got = {r["event_id"]: r["outcome"] for r in out.collect()}
    assert [got[f"e{i}"] for i in range(11)] == [
        "claimed", "claim_refused", "stale", "renewed", "accepted", "stale",
        "claimed", "stale", "claimed", "claimed", "retry_limit_exceeded"]


def test_expired_lease_is_noticed_by_a_timer(spark, tmp_path):
    first = commands(spark, [("j", "claim", "t1", 0.0, 120.0)])
    path = tmp_path / "in"
    first.coalesce(1).write.mode("append").parquet(str(path))
    stream = E.fenced_results(E.read_stream(spark, str(path), first.schema), "1 second")

    def run():
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format(
            "parquet").start(str(tmp_path / "out")).awaitTermination()

    run()
    later = commands(spark, [("other", "claim", "x", 4000.0, 4100.0)]).withColumn("event_id", F.lit("z"))
    later.coalesce(1).write.mode("append").parquet(str(path))
    run()
    rows = spark.read.schema(E.LEASE_OUTPUT).parquet(str(tmp_path / "out")).collect()
    assert ("j", "lease_expired") in {(r["inspection_id"], r["outcome"]) for r in rows}


def test_stream_states_equal_batch_states(spark, tmp_path):
    kinds = list(J.STATE_AFTER)
    rows = [(f"e{i}", f"j{i % 7}", kinds[(i * 5) % 6], float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id string, inspection_id string, event_type string, created_at double")
    df = df.withColumn("ts", F.timestamp_seconds("created_at"))
    updates = E.run_to_table(E.job_state_stream(stream_of(spark, df, tmp_path, 3)), "s", "update")
    got = {r["inspection_id"]: (r["state"], r["events"], r["attempts"]) for r in E.latest_states(updates).collect()}
    batch = J.job_states(df.withColumnRenamed("event_id", "id"))
    assert got == {r["inspection_id"]: (r["state"], r["events"], r["attempts"]) for r in batch.collect()}


def test_redelivered_events_count_once(spark, tmp_path):
    df = spark.createDataFrame([(f"e{i % 10}", float(i)) for i in range(30)], "event_id string, at double")
    df = df.withColumn("ts", F.timestamp_seconds("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    kept = E.run_to_table(E.without_repeats(E.read_stream(spark, str(tmp_path / "in"), df.schema)), "d")
    assert kept.count() == 10


def test_fenced_stream_equals_batch_on_every_row(spark):
    """The registered stream query and the batch form over the same commands."""
    from detlake.plans import operations as O
    from detlake.plans import tables as T

    d = "/root/testdata/sf0.001"
    stream = O.fenced_results_stream(spark, d)
    batch = E.fenced_results_batch(O._commands(spark, d, T.events(spark, d)))
    verdicts = sorted(map(tuple, stream.collect()))
    assert verdicts == sorted(map(tuple, batch.select("inspection_id", "event_id", "outcome").collect()))
    assert len({outcome for *_, outcome in verdicts}) >= 6


def test_finished_jobs_take_no_further_commands():
    steps = [("claim", "a", 1.0, 9.0), ("fail", "a", 2.0, 0), ("claim", "b", 3.0, 9.0), ("fail", "b", 4.0, 0),
             ("claim", "c", 5.0, 9.0), ("fail", "c", 6.0, 0), ("claim", "d", 7.0, 9.0), ("redrive", None, 8.0, 0),
             ("claim", "e", 9.0, 20.0), ("result", "e", 10.0, 0), ("redrive", None, 11.0, 0), ("claim", "f", 12.0, 20.0)]
    lease, seen = E.NEW_LEASE, []
    for step in steps:
        lease, verdict = E.follow_lease(lease, *step)
        seen.append(verdict)
    assert seen == ["claimed", "retry_scheduled", "claimed", "retry_scheduled", "claimed", "failed", "claim_refused",
                    "redriven", "claimed", "accepted", "stale", "claim_refused"]
    assert lease[3] == "completed"


def test_cases_are_written_in_order_and_packed(spark, tmp_path):
    rows = spark.range(120).selectExpr(
        "id AS image_id", "id AS ordinal", "CASE WHEN id % 2 = 0 THEN 'train' ELSE 'test' END AS split",
        "id % 3 AS signature", "cast(id % 40 AS string) AS pixel_sha256", "20 AS width", "20 AS height",
    )
    boxes = rows.selectExpr("image_id", "0 AS annotation_index", "1 AS category_id", "1.0D AS x", "1.0D AS y", "19.01D AS w", "2.0D AS h")
    packet = Y.build_packet(rows, boxes, k=2, categories=spark.sql("SELECT 's' AS source, 1 AS category_id, 'c' AS name"))
    write_packet(str(tmp_path), packet)
    written = spark.read.parquet(f"{tmp_path}/cases")
    want = packet.catalog()
    assert written.columns == want.columns
    assert written.exceptAll(want).isEmpty() and want.exceptAll(written).isEmpty()
    ids = [r["case_id"] for r in packet.cases().select("case_id").collect()]
    assert ids == sorted(ids) and len(ids) > 3000
    linked = packet.near_cases.join(packet.groups.selectExpr("image_id AS first", "group_id AS a"), "first").join(
        packet.groups.selectExpr("image_id AS second", "group_id AS b"), "second")
    assert linked.filter("already_linked <> (a = b)").isEmpty() and linked.filter("already_linked").count() == 0
    # Ids take about their 32 bytes, not their 69 digits, in the files too.
    assert sum(f.stat().st_size for f in (tmp_path / "cases").glob("*.parquet")) < 55 * len(ids) + 30_000
