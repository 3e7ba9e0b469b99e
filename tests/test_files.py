"""Real files: pictures, layered-file headers, logs, streams."""
import hashlib
import json
import os
import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F

from adlattice.sources import images as IM, tables as TB
from adlattice.sources.files import read_heads, write_files
from adlattice.streaming import jobs as S


def png(w, h, rgb):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\x00" + b"".join(bytes(rgb(x, y)) for x in range(w)) for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def psd(sign=b"8BPS", version=1, w=640, h=480):
    return sign + struct.pack(">H6xHIIHH", version, 3, h, w, 8, 3)


def test_scan_sources(spark, tmp_path):
    (tmp_path / "solid.png").write_bytes(png(8, 6, lambda x, y: (9, 9, 9)))
    (tmp_path / "mixed.PNG").write_bytes(png(8, 6, lambda x, y: (x * 30, y * 40, 7)))
    (tmp_path / "broken.jpg").write_bytes(b"not a picture")
    (tmp_path / "a.psd").write_bytes(psd())
    (tmp_path / "b.psd").write_bytes(psd(sign=b"XXXX"))
    (tmp_path / "c.bmp").write_bytes(b"BM")
    want = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("solid.png", "mixed.PNG", "broken.jpg", "a.psd", "b.psd", "c.bmp", "gone.png")], "path string")
    got = {r.path.rsplit("/", 1)[1]: r for r in IM.scan_sources(spark, str(tmp_path), want).collect()}
    assert {n: r.code for n, r in got.items()} == {"solid.png": None, "mixed.PNG": None, "broken.jpg": "LOAD_FAILED", "a.psd": None, "b.psd": "LOAD_FAILED", "c.bmp": "UNSUPPORTED_SOURCE_TYPE", "gone.png": "SOURCE_NOT_FOUND"}
    assert (got["mixed.PNG"].width, got["mixed.PNG"].height, got["a.psd"].width, got["a.psd"].height) == (8, 6, 640, 480)
    assert len(got["solid.png"].sha16) == 16
    p = {r.path.rsplit("/", 1)[1]: (r.code, r.width) for r in IM.scan_psd(spark, str(tmp_path)).collect()}
    assert p["a.psd"] == (None, 640) and p["b.psd"] == ("PSD_OPEN_FAILED", None) and p["solid.png"][0] == "NOT_PSD"
    stats = {r.path.rsplit("/", 1)[1]: r for r in IM.image_stats(spark.read.format("image").load(f"{tmp_path}/*.[pP][nN][gG]")).collect()}
    assert stats["solid.png"].std_r == 0 and stats["mixed.PNG"].std_r > 60 and stats["mixed.PNG"].std_b == 0


def test_heads_of_any_size(spark, tmp_path):
    """A sparse layered file above 2 GB is hashed as it streams; small files share tasks, hidden ones are left out."""
    big = tmp_path / "deep" / "big.psd"
    big.parent.mkdir()
    with open(big, "wb") as f:
        f.write(psd())
        f.truncate((1 << 31) + 5)
    for i in range(10):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * i)
    (tmp_path / ".hidden").write_bytes(b"x")
    (tmp_path / "_hidden").write_bytes(b"x")
    rows = {r.path: r for r in read_heads(spark, f"file:{tmp_path}", headBytes=4, splitBytes=1 << 20).collect()}
    assert set(rows) == {str(big), *[f"{tmp_path}/{i}.bin" for i in range(10)]}
    for i in range(10):
        r = rows[f"{tmp_path}/{i}.bin"]
        assert (r.bytes, bytes(r.head), r.sha256) == (i, bytes([i]) * min(i, 4), hashlib.sha256(bytes([i]) * i).hexdigest())
    assert (rows[str(big)].bytes, bytes(rows[str(big)].head)) == ((1 << 31) + 5, b"8BPS")
    assert read_heads(spark, str(tmp_path), splitBytes=1 << 20).rdd.getNumPartitions() == 2
    fast = {r.path: r for r in read_heads(spark, str(tmp_path), hash=False).collect()}
    assert fast[str(big)].bytes == (1 << 31) + 5 and fast[str(big)].sha256 is None
    assert {r.path.rsplit("/", 1)[1]: r.width for r in IM.scan_psd(spark, str(tmp_path)).collect()}["big.psd"] == 640


def test_rows_as_files(spark, tmp_path):
    rows = [("a/x.txt", "text é"), ("a/b/y.bin", ""), ("z", None)]
    for _ in range(2):  # writing again replaces
        write_files(spark.createDataFrame(rows, "name string, content string"), str(tmp_path / "out"))
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"a/x.txt": "text é".encode(), "a/b/y.bin": b"", "z": b""}


def test_psd_header_reasons(spark):
    rows = [(n, bytearray(b)) for n, b in (("ok", psd()), ("v2", psd(version=2)), ("short", b"8BPS"), ("sign", psd(sign=b"8BPX")), ("ver", psd(version=7)), ("zero", psd(w=0)))]
    got = {r.n: r.h.reason for r in spark.createDataFrame(rows, "n string, c binary").select("n", IM.psd_header(F.col("c")).alias("h")).collect()}
    assert got == {"ok": None, "v2": None, "short": "file_too_short", "sign": "invalid_signature", "ver": "invalid_header_version:7", "zero": "invalid_dimensions"}


def test_read_layers_and_events(spark, tmp_path):
    doc = {"jobId": "j", "psdSize": {"width": 9, "height": 8}, "layers": [{"name": "g", "kind": "group", "role": "bg", "depth": 0, "bbox": None, "visible": True, "children_count": 1},
           {"name": "t", "kind": "type", "role": "title", "depth": 1, "bbox": {"left": 1, "top": 2, "right": 3, "bottom": 4}, "visible": True, "children_count": 0}]}
    (tmp_path / "layers.json").write_text(json.dumps(doc))
    rows = TB.read_layers(spark, str(tmp_path / "layers.json")).orderBy("ord").collect()
    assert [(r.ord, r.is_group, r.x1, r.y2) for r in rows] == [(0, True, None, None), (1, False, 1, 4)]
    (tmp_path / "log.jsonl").write_text('{"timestamp":"2026-01-01T00:00:00Z","jobId":"j","event":"stage_start","stage":"LAYOUT","metrics":{"n":"1"}}\nbroken\n')
    e = TB.read_events(spark, str(tmp_path / "log.jsonl")).collect()
    assert sorted(r.bad_line is None for r in e) == [False, True]


def test_model_runs_once_per_content_and_never_for_cached(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "id int, key string")
    cache = spark.createDataFrame([("c", 0)], "key string, calls int")

    def fn(batches):
        for b in batches:
            assert "c" not in set(b["key"]) and b["key"].is_unique
            yield pd.DataFrame({"key": b["key"], "calls": 1})
    got = {r.id: r.calls for r in IM.with_model(df, fn, "key string, calls int", "key", cache).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0}


def test_in_flight_over_several_batches(spark, tmp_path):
    """State carries from file to file: a start in a later batch is refused while the job runs, accepted after its end."""
    src = tmp_path / "in"
    src.mkdir()
    batches = [[(1, 1, "start"), (2, 2, "start")], [(1, 3, "start"), (2, 4, "finish")], [(2, 5, "start"), (1, 6, "finish"), (1, 7, "start")]]
    for i, b in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"job_id": j, "event_id": e, "ts": f"2026-01-01T00:00:{e:02d}", "kind": k}) for j, e, k in b))
        import os
        os.utime(src / f"{i}.json", (1000 + i, 1000 + i))
    S.prepare(spark)
    schema = "job_id long, event_id long, ts timestamp, kind string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    (S.dedupe_active(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    got = {r.event_id: r.verdict for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "ACCEPTED", 2: "ACCEPTED", 3: "DUPLICATE", 5: "ACCEPTED", 7: "ACCEPTED"}
    batch = {r.event_id: r.verdict for r in S.dedupe_active_batch(spark.read.schema(schema).json(str(src))).collect()}
    assert batch == got


def test_header_files_come_a_share_at_a_time(spark, tmp_path, monkeypatch):
    from adlattice.plans import sources as PS
    spark.range(1, 121).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    held, write = [], PS.write_files

    def watched(rows, place):
        write(rows, place)
        held.append((place, sum(len(f) for _, _, f in os.walk(place))))
    monkeypatch.setattr(PS, "write_files", watched)

    def scan():
        held.clear()
        return sorted(map(tuple, PS.s_psd(PS.Tables(spark, str(tmp_path))).collect()), key=lambda r: r[0])
    whole = scan()
    assert len(whole) == 120 and len(held) == 1 and not any(os.path.exists(p) for p, _ in held)
    monkeypatch.setattr(PS, "FILES_AT_ONCE", 20)
    assert scan() == whole
    assert len(held) == 6 and sum(n for _, n in held) == 120 and max(n for _, n in held) < 60 and not any(os.path.exists(p) for p, _ in held)


def test_files_are_deleted_a_folder_a_task(spark, tmp_path, monkeypatch):
    """The files of a share go in tasks, not one by one in the driver, before their folder goes; what is not there is no error."""
    from adlattice.plans import sources as PS
    from adlattice.sources import files as FI
    for name in ("a/b/1.png", "a/2.png", "c/3.PSD", "4.png"):
        (tmp_path / "all" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "all" / name).write_bytes(b"x")
    FI.delete_files(spark, str(tmp_path / "all"))
    FI.delete_files(spark, str(tmp_path / "all"))
    assert not (tmp_path / "all").exists()
    spark.range(1, 41).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    gone, delete = [], PS.delete_files

    def watched(session, place):
        gone.append(sum(len(f) for _, _, f in os.walk(place)))
        delete(session, place)
        assert not os.path.exists(place)
    monkeypatch.setattr(PS, "delete_files", watched)
    assert PS.s_psd(PS.Tables(spark, str(tmp_path))).count() == 40 and gone == [40]
