"""Streams of parser jobs, and of files joined with their artifacts."""

import io
import json
import time
import uuid
import zipfile
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from tesserae.sources.parser import ParserError, ParserService, data_id_of
from tesserae.streaming.jobs import parse_arriving, with_artifacts


def service_of(folder, timeout=60.0, interval=0.2):
    """A function that makes a service which notes calls as files, so that all workers see them. By its number a job fails, never ends, has an
    archive that comes at the second try, or can't be submitted at first."""

    def make():
        root = Path(folder)

        def count(what):
            (root / what).mkdir(exist_ok=True)
            (root / what / uuid.uuid4().hex).touch()
            return len(list((root / what).iterdir()))

        def send(method, address, headers, body):
            if address.endswith("/file-urls/batch"):
                asked = json.loads(body)["files"][0]
                n = int(asked["name"][1:-4])
                if count(f"ask-{n}") < 2 and n % 50 == 3:
                    return 503, b""
                return 200, json.dumps({"code": 0, "data": {"batch_id": f"{n}~{asked['data_id']}", "file_urls": [f"put://{n}"]}}).encode()
            if address.startswith("put://"):
                count(f"put-{address[6:]}")
                return 200, b""
            if "/batch/" in address:
                n, data_id = address.rpartition("/")[2].split("~")
                polls = count(f"poll-{n}")
                state = "failed" if int(n) % 50 == 1 else "running" if polls < 2 or int(n) % 50 == 2 else "done"
                return 200, json.dumps({"data": {"extract_result": [{"data_id": data_id, "state": state, "full_zip_url": f"zip://{n}" if state == "done" else ""}]}}).encode()
            if address.startswith("zip://"):
                n = address[6:]
                if int(n) % 50 == 4 and count(f"zip-{n}") < 2:
                    return 404, b""
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("x_content_list.json", json.dumps([{"text": f"body {n}"}]))
                    z.writestr("full.md", f"# {n}")
                return 200, out.getvalue()
            raise OSError(address)

        return ParserService(send, "http://p", "t", timeout=timeout, interval=interval)

    return make


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def until(query, done, seconds=240):
    end = time.time() + seconds
    while time.time() < end and not done():
        assert query.exception() is None, query.exception()
        time.sleep(0.3)
    assert done()


def test_jobs_survive_a_restart(rocks, tmp_path):
    spark, calls = rocks, tmp_path / "calls"
    for d in ("calls", "in"):
        (tmp_path / d).mkdir()
    total = 1000
    for n in range(total // 2):
        (tmp_path / "in" / f"f{n}.pdf").write_bytes(b"%PDF" + str(n).encode())
    start = lambda: parse_arriving(spark, str(tmp_path / "in"), service_of(str(calls), timeout=40.0), str(tmp_path / "out"), str(tmp_path / "state"), "1 second")
    query = start()
    until(query, lambda: sum(p["numInputRows"] for p in query.recentProgress) >= total // 2)
    query.stop()
    for n in range(total // 2, total):
        (tmp_path / "in" / f"f{n}.pdf").write_bytes(b"%PDF" + str(n).encode())
    (tmp_path / "in" / "again").mkdir()
    (tmp_path / "in" / "again" / "f7.pdf").write_bytes(b"%PDF7")
    query = start()
    rows = lambda: spark.read.parquet(str(tmp_path / "out"))
    until(query, lambda: any((tmp_path / "out").glob("*.parquet")) and rows().count() >= total)
    query.stop()
    got = {r["file_name"]: r for r in rows().collect()}
    assert len(got) == total == rows().count()
    for n in range(total):
        r = got[f"f{n}.pdf"]
        assert r["data_id"] == data_id_of(f"f{n}.pdf", b"%PDF" + str(n).encode())
        assert r["status"] == {1: "failed", 2: "timeout"}.get(n % 50, "done"), (n, r)
        if r["status"] == "done":
            assert json.loads(r["json"]) == [{"text": f"body {n}"}] and r["markdown"] == f"# {n}"
        assert len(list((calls / f"put-{n}").iterdir())) == 1, f"job {n} was sent twice"


def test_fetching_goes_another_way_last():
    calls = []
    service = ParserService(lambda *a: calls.append(a) or (500, b""), "http://p", attempts=2, interval=1, sleep=lambda s: None, other=lambda a: a.encode())
    assert service.fetch("x://y") == b"x://y" and len(calls) == 2
    service.other = None
    with pytest.raises(ParserError):
        service.fetch("x://y")


def test_artifacts_before_after_and_never(spark, tmp_path):
    at = lambda minutes: datetime(2024, 1, 1, 12) + timedelta(minutes=minutes)
    pdf, made = "file_id string, sha256 string, arrived timestamp", "origin_sha256 string, modified timestamp, json string, markdown string"
    write = lambda rows, kind, name: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        stream = lambda kind, name: spark.readStream.schema(kind).parquet(str(tmp_path / name))
        joined = with_artifacts(stream(pdf, "pdfs"), stream(made, "archives"), "10 minutes")
        joined.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return {(r["file_id"], r["json"]) for r in spark.read.schema("file_id string, json string").parquet(str(tmp_path / "out")).collect()}

    write([("after", "h2", at(1)), ("never", "h3", at(2))], pdf, "pdfs")
    write([("h1", at(0), "[1]", None), (None, at(0), "[0]", None)], made, "archives")
    assert run() == set()
    write([("before", "h1", at(4))], pdf, "pdfs")
    write([("h2", at(5), "[2]", "m")], made, "archives")
    assert run() == {("before", "[1]"), ("after", "[2]")}
    # Both streams move on: what came to nothing is told, and its state goes.
    write([("later", "h4", at(60))], pdf, "pdfs")
    write([("h3", at(61), "[3]", None)], made, "archives")
    run()
    write([("latest", "h5", at(120))], pdf, "pdfs")
    write([("h5", at(121), "[5]", None)], made, "archives")
    got = run()
    assert {("before", "[1]"), ("after", "[2]"), ("never", None)} <= got and ("never", "[3]") not in got and ("latest", "[5]") in got




def test_arriving_pdfs_wait_for_their_archives(spark, tmp_path):
    from tesserae.operators.index import Index
    from tesserae.streaming.ingest import watch_pdfs

    for d in ("in", "zips"):
        (tmp_path / d).mkdir()
    index = Index(spark, str(tmp_path / "index"), buckets=2)

    def archive(name, origin, text):
        with zipfile.ZipFile(tmp_path / "zips" / name, "w") as z:
            z.writestr("o_origin.pdf", origin)
            z.writestr("o_content_list.json", json.dumps([{"type": "text", "text": text, "page_idx": 0}]))

    def run():
        watch_pdfs(spark, str(tmp_path / "in"), str(tmp_path / "zips"), index, str(tmp_path / "state"), str(tmp_path / "missing")).awaitTermination()
        return sorted(r["text"] for r in index.read().collect()) if index.exists() else []

    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDFa")
    archive("b.zip", b"%PDFb", "body of b")
    assert run() == []
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDFb")
    archive("a.zip", b"%PDFa", "body of a")
    assert run() == ["body of a", "body of b"]
    assert {r["file_name"] for r in index.read().collect()} == {"a.pdf", "b.pdf"}
