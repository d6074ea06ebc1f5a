"""Files in, files out: documents, labels, images, fingerprints, write-once tables."""

import json
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from detlake import schemas
from detlake.functions import pixels as P
from detlake.functions.sql import register_sql
from detlake.operators import scoring as SC
from detlake.operators import validate as V
from detlake.plans import files as plans
from detlake.sinks import tables as K
from detlake.sources import documents as D
from detlake.sources import files as S
from detlake.streaming import scoring as live
from detlake.streaming.events import checked_messages


def png(array, extra=b""):
    height, width = array.shape[:2]

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\0" + row.tobytes() for row in array.astype(np.uint8))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def picture(seed, size=(64, 64)):
    return np.random.default_rng(seed).integers(0, 256, (*size, 3))


def write_json(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))
    return str(path)


@pytest.fixture
def image_folder(tmp_path):
    folder = tmp_path / "data" / "images"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"{i}.png").write_bytes(png(picture(i)))
    return tmp_path / "data"


def digest(path):
    import hashlib

    return hashlib.sha256(path.read_bytes()).hexdigest()


def manifest(folder, **changes):
    """Three pictures of two classes, one a split; every picture shows both classes."""
    def sample(n, split):
        file = folder / "images" / f"{n}.png"
        marks = [(k, 4 + 9 * n + 20 * k, 7 + 3 * n, 12 + 5 * k, 9) for k in (0, 1)]
        return {
            "image": f"images/{n}.png", "sha256": digest(file), "width": 64, "height": 64,
            "group_id": f"lot{n * 11}", "split": split,
            "annotations": [
                {"class_id": k, "bbox": {"x1": x, "y1": y, "x2": x + w, "y2": y + h}} for k, x, y, w, h in marks
            ],
        }

    grant = {"name": "CC-TEST", "evidence": "license.txt", "allowed_uses": ["research", "teaching"],
             "reviewed_by": "clerk", "reviewed_on": "2025-06-30"}
    body = {"schema_version": "1.0", "name": "plates", "version": "7", "source_url": "https://example.org/plates",
            "source_revision": "b41", "license": grant, "classes": ["scratch", "dent"],
            "samples": [sample(n, s) for n, s in enumerate(("test", "train", "validation"))]}
    return body | changes


def findings(spark, folder, body, purpose="research"):
    (folder / "license.txt").write_text("ok")
    m = D.read_manifest(spark, write_json(folder.parent / "m.json", body))
    root = str(folder)
    strip = F.regexp_replace("path", "^(file:)?/*" + root.lstrip("/") + "/", "")
    files = S.image_files(spark, root).select(strip.alias("path"), F.sha2("content", 256).alias("actual_sha256"))
    decoded = P.fingerprints(S.decoded_images(spark, root + "/images")).withColumn("path", strip)
    listing = S.object_listing(spark, root).withColumnRenamed("image_key", "path")
    rows = V.validate_dataset(m, files, decoded, listing, purpose=purpose)
    return rows, m


def codes(rows):
    return sorted(r["code"] for r in rows.collect())


def test_clean_manifest_is_ready(spark, image_folder):
    rows, m = findings(spark, image_folder, manifest(image_folder))
    assert codes(rows) == []
    report = V.validation_summary(rows, m.images.count()).first()
    assert (report["valid"], report["ready_for_training"], report["sample_count"]) == (True, True, 3)


DEFECTS = {
    "checksum_mismatch": lambda b: b["samples"][0].update(sha256="f" * 64),
    "dimension_mismatch": lambda b: b["samples"][2].update(height=65),
    "group_leakage": lambda b: b["samples"][1].update(group_id=b["samples"][2]["group_id"]),
    "unknown_class": lambda b: b["samples"][1]["annotations"].append(
        {"class_id": 2, "bbox": {"x1": 30, "y1": 30, "x2": 40, "y2": 44}}),
    "out_of_bounds": lambda b: b["samples"][2]["annotations"].append(
        {"class_id": 1, "bbox": {"x1": 50, "y1": 50, "x2": 60, "y2": 70.5}}),
    "missing_class_coverage": lambda b: b["samples"][0].update(annotations=b["samples"][0]["annotations"][:1]),
    "invalid_review_date": lambda b: b["license"].update(reviewed_on="3001-12-24"),
    "usage_not_permitted": lambda b: b["license"].update(allowed_uses=["teaching"]),
}


def test_defects_are_reported_one_and_all(spark, image_folder):
    everything = manifest(image_folder)
    for code in ("checksum_mismatch", "usage_not_permitted", "missing_class_coverage"):
        body = manifest(image_folder)
        DEFECTS[code](body)
        assert codes(findings(spark, image_folder, body)[0]) == [code]
    for spoil in DEFECTS.values():
        spoil(everything)
    rows, m = findings(spark, image_folder, everything, "commercial")
    assert sorted(set(codes(rows))) == sorted(DEFECTS)
    assert not V.validation_summary(rows, m.images.count()).first()["valid"]


def test_copies_across_splits_are_found(spark, image_folder):
    (image_folder / "images" / "2.png").write_bytes(png(picture(0), extra=struct.pack(">I", 0) + b"tEXt" + struct.pack(">I", zlib.crc32(b"tEXt"))))
    rows, _ = findings(spark, image_folder, manifest(image_folder))
    assert codes(rows) == ["duplicate_pixels", "possible_visual_leakage"]


def test_fingerprints_follow_orientation(spark, tmp_path):
    base = picture(3, (60, 90))
    # A smooth picture, so that turning it does not depend on single pixels.
    base = np.cumsum(np.cumsum(base, 0), 1) // 3000 % 256
    (tmp_path / "a.png").write_bytes(png(base))
    (tmp_path / "b.png").write_bytes(png(np.rot90(base)))
    rows = {r["path"][-5:]: r for r in P.fingerprints(S.decoded_images(spark, str(tmp_path))).collect()}
    a, b = rows["a.png"], rows["b.png"]
    assert a["ahash"][1] == b["ahash"][0] and len(a["phash"]) == 8
    assert min((a["phash"][0] ^ h).bit_count() for h in b["phash"]) <= 2
    assert all(0 <= h < 1 << 63 for h in a["phash"])
    assert a["mean_luminance"] == pytest.approx(b["mean_luminance"], abs=0.6)
    assert a["pixel_sha256"] != b["pixel_sha256"]


def test_grey_and_colour_copies_share_a_digest(spark, tmp_path):
    grey = np.random.default_rng(9).integers(0, 256, (12, 20))
    rows = [("g", 20, 12, 1, bytearray(grey.astype(np.uint8).tobytes())),
            ("c", 20, 12, 3, bytearray(np.repeat(grey.astype(np.uint8), 3).tobytes()))]
    df = spark.createDataFrame(rows, "path string, width int, height int, channels int, pixels binary")
    assert df.select(P.pixel_digest().alias("d")).distinct().count() == 1


def test_hash_definitions():
    ramp = np.tile(np.arange(90, 0, -1.0), (80, 1))
    assert P.difference_bits(P.AreaSums(ramp).grid(8, 9)) == -1  # every cell brighter than its right neighbour
    assert P.difference_bits(P.AreaSums(ramp[:, ::-1]).grid(8, 9)) == 0
    flat = np.full((16, 16), 9.0)
    assert P.average_bits(P.AreaSums(flat).grid(8, 8)) == -1


@pytest.mark.parametrize("shape", [(8, 9), (80, 61), (33, 100), (5, 7), (1, 1), (64, 64)])
def test_area_sums_give_area_averages(shape):
    grey = np.random.default_rng(shape[0]).integers(0, 256, shape).astype(float)

    def shares(source, cells):
        """How much of each pixel row every cell takes."""
        edges = np.linspace(0, source, cells + 1)
        low, high = np.maximum(edges[:-1, None], np.arange(source)), np.minimum(edges[1:, None], np.arange(source) + 1)
        return np.clip(high - low, 0, None) * cells / source

    for rows, columns in ((8, 8), (8, 9), (32, 32)):
        plain = shares(shape[0], rows) @ grey @ shares(shape[1], columns).T
        got = P.AreaSums(grey).grid(rows, columns)
        settled = np.abs(plain - np.floor(plain) - 0.5) > 1e-9  # halves go to the even level
        assert (got == np.rint(plain))[settled].all() and np.abs(got - plain).max() <= 0.5 + 1e-9
    # The grid of a turned picture is the turned grid.
    for view, grid in zip(P.orientations(grey), P.orientations(P.AreaSums(grey).grid(32, 32)), strict=True):
        assert (P.AreaSums(np.ascontiguousarray(view)).grid(32, 32) == grid).all()


def test_pictures_of_one_size_are_computed_together(spark, monkeypatch):
    """Stacks give what single pictures give, sizes mixed, unreadable ones in between."""
    random_ = np.random.default_rng(5)
    sizes = [(8, 72, 1), (33, 50, 3), (1, 1, 1)] * 20
    pictures = [(n, *size, random_.integers(0, 256, size, np.uint8).tobytes()) for n, size in enumerate(sizes)]
    rows = [*pictures, (90, None, None, None, None), (91, -1, -1, 1, b"")]
    df = spark.createDataFrame(rows, "path int, height int, width int, channels int, pixels binary").coalesce(1)
    got = {r["path"]: r for r in P.fingerprints(df).collect()}
    for n, h, w, c, raw in pictures:
        (single,) = P._marks(raw, h, w, c)
        assert (got[n]["dhash"], got[n]["ahash"], got[n]["phash"], got[n]["mean_luminance"]) == single
        grey = P.grey_levels(raw, h, w, c)[0]
        mean = P.AreaSums(grey).grid(8, 8)
        assert single[1][0] % 2**64 == sum(1 << i for i in np.flatnonzero(mean.ravel() >= mean.mean()).tolist())
    assert got[90]["dhash"] is None and got[91]["ahash"] is None


def test_admission(spark, tmp_path):
    (tmp_path / "ok.png").write_bytes(png(picture(1)))
    control = struct.pack(">II", 2, 0)
    frames = struct.pack(">I", 8) + b"acTL" + control + struct.pack(">I", zlib.crc32(b"acTL" + control))
    (tmp_path / "moving.png").write_bytes(png(picture(2), extra=frames))
    (tmp_path / "big.png").write_bytes(png(picture(2, (80, 80))))
    (tmp_path / "text.png").write_bytes(b"no image")
    rows = P.admission_issues(S.image_files(spark, str(tmp_path)), S.decoded_images(spark, str(tmp_path)), 5000)
    assert {r["path"].split("/")[-1]: r["reason"] for r in rows.collect()} == {
        "moving.png": "animated", "big.png": "too_many_pixels", "text.png": "unsupported_format"}


def test_coco_source_and_audit(spark, tmp_path):
    path = write_json(tmp_path / "instances_train.json", {
        "images": [{"id": 1, "file_name": "a.png", "width": 20, "height": 20}],
        "categories": [{"id": 1, "name": "spur"}],
        "annotations": [
            {"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 1, 5, 5]},
            {"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 1, 5, 5]},
            {"id": 2, "image_id": 1, "category_id": 1, "bbox": [1, 1, 50, 5]},
            {"id": 3, "image_id": 9, "category_id": 7, "bbox": [1, 1, 5, 5]}]})
    coco = D.read_coco(spark, path)
    assert coco.images.first()["split"] == "train"
    errors = V.reference_errors(coco.annotations, coco.images, coco.categories)
    assert sorted(r["reason"] for r in errors.collect()) == ["unknown_category", "unknown_image"]
    resolved = V.resolved_annotations(coco.annotations, coco.images, coco.categories)
    assert codes(V.coco_issues(resolved)) == ["duplicate_annotation_id", "duplicate_box", "invalid_box"]


def test_yolo_source(spark, tmp_path):
    labels = tmp_path / "labels"
    labels.mkdir()
    (labels / "a.txt").write_text("0 0.5 0.5 0.2 0.4\n1 0.5 0.5\n0.5 0 0 0 0\n-1 0 0 0 0\nx 0 0 0 0\n")
    lines = S.parse_yolo_lines(S.read_yolo(spark, str(labels)))
    issues = [r["issue"] for r in lines.orderBy("line_number").collect()]
    assert [r["line_number"] for r in lines.orderBy("line_number").collect()] == [1, 2, 3, 4, 5]
    assert issues == [None, "invalid_yolo_line", *["invalid_yolo_values"] * 3]
    from detlake.functions.geometry import yolo_to_xyxy

    box = lines.filter("issue IS NULL").select(*yolo_to_xyxy("cx", "cy", "bw", "bh", F.lit(100), F.lit(50))).first()
    assert tuple(box) == pytest.approx((40, 15, 60, 35))
    images = spark.createDataFrame([("x/images/a.png",), ("x/images/b.png",)], "path string")
    images = images.withColumn("label_path", S.label_path_of(F.col("path")))
    held = spark.createDataFrame([("x/labels/a.txt",)], "label_path string")
    assert [r["images"] for r in V.missing_label_issues(images, held).collect()] == [["x/images/b.png"]]


def test_saved_predictions(spark, tmp_path):
    write_json(tmp_path / "run-1" / "best.json", {"source_images": ["a", "b"], "predictions": [
        {"image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4], "score": 0.5}]})
    images, predictions = D.read_saved_predictions(spark, f"{tmp_path}/*/best.json")
    assert [(r["run_id"], r["image_id"], r["path"]) for r in images.collect()] == [("run-1", 0, "a"), ("run-1", 1, "b")]
    row = predictions.first()
    assert (row["prediction_index"], row["image_id"], row["h"], row["score"]) == (0, 1, 4.0, 0.5)
    assert D.read_run_artifacts(spark, str(tmp_path)).select("artifact", "run_id").first() == ("best", "run-1")


@pytest.mark.parametrize("text, message", [
    ('{"reviewer": "a", "reviewer": "b"}', "DUPLICATE_KEY"), ('{"reviewer": NaN}', "MALFORMED"), ("{", "MALFORMED"),
    ('{"reviewer": "' + "x" * 99 + '"}', "size limit")])
def test_strict_json_refuses(spark, tmp_path, text, message):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(Exception, match=message):
        D.strict_json(spark, str(tmp_path), schemas.REVIEW_BATCH, limit=80).collect()


def test_review_batch_source(spark, tmp_path):
    batch = {"schema_version": "1.0", "packet_sha256": "p", "reviewer": "r", "reviewed_at": "2026-01-01T00:00:00Z",
             "decisions": [{"case_id": "c", "answers": {"relationship": "related"}, "rationale": "why"}]}
    write_json(tmp_path / "one.json", batch)
    write_json(tmp_path / "two.json", batch)
    rows = D.read_review_batches(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0]["batch_hash"] == rows[1]["batch_hash"]
    assert rows[0]["answers"] == {"relationship": "related"}


def test_an_aborted_write_is_replaced(spark, tmp_path):
    path = tmp_path / "t"
    (path / "_temporary").mkdir(parents=True)
    (path / "part-0.parquet").write_bytes(b"half a file")
    assert K.frozen_write(spark.range(3), str(path)) is True
    assert spark.read.parquet(str(path)).count() == 3


def test_a_foreign_folder_is_not_replaced(spark, tmp_path):
    path = tmp_path / "notes"
    path.mkdir()
    (path / "todo.txt").write_text("keep me")
    with pytest.raises(ValueError, match="no table"):
        K.frozen_write(spark.range(3), str(path))
    assert (path / "todo.txt").read_text() == "keep me"
    (tmp_path / "empty").mkdir()
    assert K.frozen_write(spark.range(3), str(tmp_path / "empty")) is True


def test_reports_are_completed_once(spark, tmp_path):
    schema = "inspection_id string, attempt int, completed_at double, model_version string, is_demo boolean"
    first = spark.createDataFrame([("a", 1, 1.0, "m", False), ("a", 1, 2.0, "m", False)], schema)
    second = spark.createDataFrame([("a", 1, 9.0, "m", False), ("b", 1, 9.5, "m", False)], schema)
    save = K.complete_reports(str(tmp_path))
    for number, batch in ((0, first), (1, second), (1, second)):
        save(batch, number)
    reports = spark.read.parquet(str(tmp_path / "reports")).collect()
    events = spark.read.parquet(str(tmp_path / "events")).collect()
    assert sorted((r["inspection_id"], r["attempt"]) for r in reports) == [("a", 1), ("b", 1)]
    assert sorted(r["completed_at"] for r in reports) == sorted(r["created_at"] for r in events)


def test_frozen_write(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.lit("train"))
    path = str(tmp_path / "t")
    assert K.frozen_write(df, path, ["split"]) is True
    assert K.frozen_write(df.orderBy(F.desc("id")), path, ["split"]) is False
    with pytest.raises(ValueError, match="refusing"):
        K.frozen_write(df.filter("id > 1"), path, ["split"])


def test_release_audit_and_exports(spark, tmp_path):
    images = spark.createDataFrame([(1, "g", "train"), (2, "h", "test")], "image_id bigint, group_id string, split string")
    boxes = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "image_id bigint, category_id bigint")
    release = K.write_release(str(tmp_path / "r"), images, boxes, images.select("image_id"), "1.0")
    assert {r["table"]: r["rows"] for r in release.collect()} == {"images": 2, "annotations": 3, "lineage": 2, "group_counts": 3}
    K.write_release(str(tmp_path / "r"), images, boxes, images.select("image_id"), "1.0")
    with pytest.raises(ValueError):
        K.write_release(str(tmp_path / "r"), images.limit(1), boxes, images.select("image_id"), "1.0")
    assert len(K.write_audit(str(tmp_path / "a"), images, boxes).first()["inventory_sha256"]) == 64
    assert {r["table"]: r["rows"] for r in K.write_research_set(str(tmp_path / "s"), images, boxes, images.limit(0)).collect()} == {
        "images": 2, "corrections": 3, "quarantine": 0}
    K.export_json(boxes, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 3


def test_sql_functions(spark):
    register_sql(spark)
    row = spark.sql("SELECT iou(0D,0D,10D,10D,5D,0D,10D,10D), hamming(5, 2), box_valid(0D,0D,1D,1D,1D,1D), box_valid(0D,0D,2D,1D,1D,1D)").first()
    assert tuple(row) == (pytest.approx(1 / 3), 3, True, False)
    assert spark.sql("SELECT * FROM tiles(2050, 1300, 1024, 256)").count() == 6


def test_display_policy_edges(spark):
    rows = [("open", c, 0.0, 0.0, 1.0, 1.0) for c in (0.699, 0.70, 0.899, 0.90)]
    df = spark.createDataFrame([("i", *r) for r in rows], schemas.DETECTIONS)
    got = SC.decide(df).select("confidence_band", "severity").collect()
    assert [r[0] for r in got] == [None, "review", "review", "high"] and got[3][1] == "high"
    shown = SC.decide(df, experimental=True).select("severity", "confidence_band").distinct().collect()
    assert [tuple(r) for r in shown] == [("medium", "review")]
    report = SC.reports(spark.createDataFrame([("i",), ("j",)], "image_id string"), SC.decide(df), "v").collect()
    assert {r["image_id"]: (r["overall_result"], r["ignored_detection_count"], len(r["detections"])) for r in report} == {
        "i": ("REVIEW_REQUIRED", 1, 3), "j": ("NO_VISIBLE_DEFECTS_DETECTED", 0, 0)}


def test_pinned_artifact(tmp_path):
    path = tmp_path / "m.bin"
    path.write_bytes(b"weights")
    assert SC.checked_artifact(str(path), digest(path)) == b"weights"
    with pytest.raises(ValueError):
        SC.checked_artifact(str(path), "0" * 64)


def test_continuous_scoring(spark, image_folder, tmp_path):
    stream = live.image_stream(spark, str(image_folder))
    for _ in range(2):  # a second run finds nothing new
        live.score_images(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    reports = spark.read.parquet(str(tmp_path / "out" / "reports"))
    assert reports.count() == 3 and reports.select("overall_result").distinct().first()[0] == "NOT_EVALUATED"
    assert spark.read.parquet(str(tmp_path / "out" / "events")).select("event_type").distinct().first()[0] == "inspection_completed"


def test_message_checks(spark):
    good = "0000abcd-0000-4000-8000-000000000001"
    bodies = [
        json.dumps({"version": 1, "event_id": good, "inspection_id": good}),
        json.dumps({"version": True, "event_id": good, "inspection_id": good}),
        json.dumps({"version": "1", "event_id": good, "inspection_id": good}),
        json.dumps({"version": 1, "event_id": good.upper(), "inspection_id": good}),
        "[]", "nonsense",
    ]
    rows = checked_messages(spark.createDataFrame([(b,) for b in bodies], "body string")).select("issue").collect()
    assert [r[0] for r in rows] == [None, "unsupported_version", "unsupported_version", "invalid_identity",
                                    "not_an_object", "not_an_object"]


def oracle(name, tables):
    """The rows of a query's SQL over Parquet files of one folder."""
    con = duckdb.connect()
    for file in tables.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=str)


def answered(spark, name, tables):
    return sorted(map(tuple, entry.queries()[name](spark, str(tables)).collect()), key=str)


def table(folder, name, columns):
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")


def test_long_tables_become_more_documents(spark, tmp_path, monkeypatch):
    """No export holds more than its share, and nothing is lost between them."""
    monkeypatch.setattr(plans, "ENTRIES", 40)
    documents = []

    def kept(df, keys, label):
        documents.append(df.agg(F.max(F.length("body")), F.count("*")).first())
        return written(df, keys, label)

    written = plans._documents
    monkeypatch.setattr(plans, "_documents", kept)
    rows = range(600)
    table(tmp_path, "orders", {"o_orderkey": list(rows), "o_custkey": list(rows)})
    table(tmp_path, "lineitem", {
        "l_orderkey": [i // 3 for i in rows], "l_partkey": [i * 7 for i in rows], "l_suppkey": [i % 40 for i in rows],
        "l_linenumber": pa.array([i % 3 + 1 for i in rows], pa.int32()), "l_quantity": [float(i % 50) for i in rows]})
    for name in ("coco_source", "saved_predictions_source"):
        assert answered(spark, name, tmp_path) == oracle(name, tmp_path)
    assert all(longest < 20_000 and count > 12 for longest, count in documents)


def test_places_repeat_between_manifests(spark, tmp_path):
    """Equal paths at equal places of several languages stay apart."""
    ids = [990 * i for i in range(12)]
    table(tmp_path, "documents", {"doc_id": ids, "text": [f"t{i}" for i in ids], "source": ["s"] * 12,
                                  "lang": ["de", "en", "fr"] * 4, "n_chars": ids})
    table(tmp_path, "labels", {"doc_id": ids[:9] + ids[:1], "quality": pa.array([0, 1] * 5, pa.int32())})
    assert answered(spark, "manifest_source", tmp_path) == oracle("manifest_source", tmp_path)


def test_review_batches_stay_below_the_limit(spark, tmp_path):
    turns = range(700)
    table(tmp_path, "conversations", {
        "conv_id": [i // 4 * 8 for i in turns], "turn": [i % 4 for i in turns],
        "role": [None if i % 90 == 0 else "user" for i in turns], "text": [None if i == 5 else f"{i}\n" + "x" * 9_000 for i in turns]})
    assert answered(spark, "review_batch_source", tmp_path) == oracle("review_batch_source", tmp_path)
