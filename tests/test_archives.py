"""Members of archives and hashes of files, read by parts."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae.sources import archive, files
from tesserae.sources.archive import DigestReader, FilesPartition, Found, MemberReader, grouped, listed


def zipped(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, content in members.items():
            z.writestr(name, content)


class Counting(io.RawIOBase):
    """A file that notes how many bytes are read."""

    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def read(self, n=-1):
        out = self.inner.read(n) if n >= 0 else self.inner.read()
        self.seen.append(len(out))
        return out

    def seek(self, at, whence=0):
        return self.inner.seek(at, whence)

    def tell(self):
        return self.inner.tell()

    def seekable(self):
        return True

    def readable(self):
        return True


def test_a_wanted_member_of_a_large_archive(tmp_path, monkeypatch):
    zipped(tmp_path / "a.zip", {"big.bin": bytes(40_000_000), "x_content_list.json": "[1]", "y.bin": bytes(5_000_000)}, zipfile.ZIP_STORED)
    seen, opened = [], archive.store_of

    class Store:
        def __init__(self, inner):
            self.inner = inner

        def open_input_file(self, path):
            return Counting(self.inner.open_input_file(path), seen)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(archive, "store_of", lambda uri: (lambda s, p: (Store(s), p))(*opened(uri)))
    reader = MemberReader({"path": str(tmp_path), "members": ".json", "content": ".json", "partition_bytes": "1000000"})
    [partition] = reader.partitions()
    [(_, _, name, position, size, digest, content)] = list(reader.read(partition))
    assert (name, position, size, digest, content) == ("x_content_list.json", 1, 3, None, b"[1]") and sum(seen) < 1_000_000
    # All members of a large archive, over several partitions, each of them once.
    reader = MemberReader({"path": str(tmp_path), "digest": ".bin", "partition_bytes": "10000000"})
    parts = reader.partitions()
    rows = [r for p in parts for r in reader.read(p)]
    assert len(parts) == 2 and [r[2] for r in rows] == ["big.bin", "x_content_list.json", "y.bin"] and rows[0][5] == hashlib.sha256(bytes(40_000_000)).hexdigest() and rows[1][5:] == (None, None)


def test_members(spark, tmp_path):
    (tmp_path / "in dir").mkdir()
    zipped(tmp_path / "in dir" / "a b.zip", {"x/one.json": "{}", "full.md": b"\xff# t", "two.json": "[2]", "o_origin.pdf": b"%PDF"})
    zipped(tmp_path / "empty.zip", {})
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_bytes(b"x")
    rows = archive.members(spark, str(tmp_path), content=".json", digest=".pdf").cache()
    assert sorted((r["path"].rpartition("/")[2], r["position"], r["member"], r["content"]) for r in rows.filter("member is not null").collect()) == [
        ("a b.zip", 0, "x/one.json", b"{}"), ("a b.zip", 1, "full.md", None), ("a b.zip", 2, "two.json", b"[2]"), ("a b.zip", 3, "o_origin.pdf", None),
    ]
    assert rows.filter("member = 'o_origin.pdf'").first()["sha256"] == hashlib.sha256(b"%PDF").hexdigest() and rows.filter("member is null").count() == 2
    all_of = lambda: archive.members(spark, str(tmp_path), content=".json")
    for condition, n in ((F.col("member") == "full.md", 1), (F.col("member").isin("two.json", "none"), 1), (F.col("member").startswith("x/"), 1), (F.col("member").endswith(".json") & F.col("member").startswith("t"), 1), (F.col("member").isNull(), 2)):
        assert all_of().filter(condition).count() == n
    got = {r["path"].rpartition("/")[2]: r for r in files.archive_members(spark, str(tmp_path)).collect()}
    assert set(got) == {"a b.zip", "empty.zip", "bad.zip"} and got["bad.zip"]["json"] is None
    assert (got["a b.zip"]["json"], got["a b.zip"]["markdown"], got["a b.zip"]["content_list"], got["a b.zip"]["origin_sha256"]) == ("{}", "�# t", None, hashlib.sha256(b"%PDF").hexdigest())
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path", "modificationTime", "content")
    loaded = {r["origin_sha256"]: r for r in files.loaded_archives(whole).drop("path", "modified").collect()}
    assert all(tuple(r)[2:] == tuple(loaded[r["origin_sha256"]]) for r in got.values())
    assert files.archive_members(spark, str(tmp_path / "in dir")).count() == 1


def test_digests(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, content in (("a.pdf", b"%PDF" + bytes(3_000_000)), ("deep/b c.PDF", b"x"), ("x.md", b"# t")):
        (tmp_path / name).write_bytes(content)
    got = {r["file_name"]: r for r in files.file_digests(spark, str(tmp_path), "pdf").collect()}
    old = {r["file_name"]: r for r in files.files(spark, str(tmp_path), "pdf").collect()}
    assert set(got) == {"a.pdf", "b c.PDF"} == set(old)
    for name, r in got.items():
        assert (r["sha256"], r["length"], r["stem"], r["kind"], r["modified"]) == tuple(old[name][c] for c in ("sha256", "length", "stem", "kind", "modified"))
    one = files.file_digests(spark, str(tmp_path / "a.pdf"), "pdf").collect()
    assert len(one) == 1 and one[0]["sha256"] == got["a.pdf"]["sha256"]
    reader = DigestReader({"path": str(tmp_path), "partition_bytes": "1000"})
    assert len(reader.partitions()) == 2 and len(listed(str(tmp_path), "*.md")) == 1


def test_partitions_are_of_about_the_bytes_asked():
    sizes = [5, 5, 20, 1, 1, 1]
    groups = grouped([Found(str(i), None, n) for i, n in enumerate(sizes)], 10)
    assert [[f.size for f in g] for g in groups] == [[5, 5], [20], [1, 1, 1]] and isinstance(FilesPartition(groups[0]).files, list)
    with pytest.raises(FileNotFoundError):
        listed("/nowhere/at/all", "*")
