"""Normalisation, index, retrieval, review, sources and streaming."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tesserae.functions import text as X
from tesserae.operators import retrieve, review
from tesserae.operators.chunk import Budget, pdf_chunks
from tesserae.operators.embed import EmbeddingUnavailable, HashEmbedder, embed, vectors_of
from tesserae.operators.index import Index, index_rows
from tesserae.operators.normalize import normalize
from tesserae.plans import api, catalogue, ingest
from tesserae.sources import files
from tesserae.streaming.ingest import watch_markdown


def test_catalogue_is_registered():
    names = set(__spark_entry__.queries())
    assert set(catalogue.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names and catalogue.FLAGSHIP in names


CHUNK = "chunk_id string, chunk_index int, text string, token_count int, content_hash string"


def test_normalize_parsers(spark):
    pdf = spark.createDataFrame([("c", 0, "t", 1, "h", ("f", "n", 3, None, "paragraph,table"))], CHUNK + ", metadata struct<file_id:string,file_name:string,page_number:int,page_numbers:array<int>,block_type:string>")
    m = normalize(pdf, "pdf").first()["metadata"]
    assert m["source"]["page_numbers"] == [3] and m["content"]["types"] == ["paragraph,table"] and m["document"]["file_type"] == "pdf" and m["structure"]["heading_path"] == []
    word = spark.createDataFrame([("c", None, "t", None, None, ("A > B",))], CHUNK + ", metadata struct<heading_path:string>")
    r = normalize(word).first()
    assert r["chunk_index"] is None and r["token_count"] == 0 and r["content_hash"] == "" and r["metadata"]["structure"]["heading_path"] == ["A > B"] and r["metadata"]["source"]["page_numbers"] == [] == r["metadata"]["source"]["line_range"]
    md = spark.createDataFrame([("c", 0, "t", 1, "h", (2, 9, ["a", "", None], [1, 2], ""))], CHUNK + ", metadata struct<line_start:int,line_end:int,block_types:array<string>,heading_levels:array<int>,heading_path:string>")
    m = normalize(md).first()["metadata"]
    assert m["source"]["line_range"] == [2, 9] and m["content"]["types"] == ["a"] and m["structure"]["heading_path"] == []
    assert normalize(normalize(md)).first() == normalize(md).first()
    assert set(m.asDict()) == {"document", "structure", "source", "content", "processing"}


def test_embed_and_index(spark, tmp_path):
    chunks = normalize(spark.createDataFrame([("a", 0, " x ", 1, "h"), ("b", 1, "y", 1, "g")], CHUNK), "md")
    rows = index_rows(embed(chunks, HashEmbedder))
    assert rows.filter("id = 'a'").first()["text"] == " x " and all(len(r["vector"]) == 8 for r in rows.collect())
    index = Index(spark, str(tmp_path / "index"))
    with pytest.raises(LookupError):
        index.upsert(rows, create=False)
    assert index.upsert(rows.limit(0)) == 0 and not index.exists()
    assert index.upsert(rows) == 2 and index.read().count() == 2
    changed = rows.filter("id = 'b'").withColumn("text", F.lit("z")).unionByName(rows.filter("id = 'b'").withColumns({"id": F.lit("c")}))
    assert index.upsert(changed) == 2
    assert {r["id"]: r["text"] for r in index.read().collect()} == {"a": " x ", "b": "z", "c": "y"}
    with pytest.raises(Exception, match="blank"):
        embed(chunks.withColumn("text", F.lit(" ")), HashEmbedder).collect()


def test_provider_answers():
    assert vectors_of({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}, 2) == [[1.0], [2.0]]
    assert vectors_of('{"embeddings": [[1, 2]]}', 1) == [[1.0, 2.0]]
    for bad in ([[1.0]], [[], []], [["x"], [1]]):
        with pytest.raises(EmbeddingUnavailable):
            vectors_of(bad, 2)


@pytest.mark.parametrize("given, k", [(None, 5), ("7", 7), (0, 5), (-1, 5), (99, 20), ("x", 5), (3.9, 3), (True, 1)])
def test_top_k(given, k):
    assert retrieve.top_k_of(given) == k


def test_search_and_answer(spark):
    e = HashEmbedder()
    rows = [(str(i), [float(x) for x in e.embed([t])[0]], t, "f.md", "md", c, "", "1,2", i, None) for i, (t, c) in enumerate([("alpha", "A"), ("beta", "A"), ("", "B"), ("alpha", "A")])]
    index = spark.createDataFrame(rows, "id string, vector array<float>, text string, file_name string, file_type string, chapter string, section string, page_numbers string, chunk_index int, metadata_json string")
    hits = ingest.search(index, " alpha ", e, 2).collect()
    assert [h["id"] for h in hits] == ["0", "3"] and hits[0]["metadata"]["page_numbers"] == ["1", "2"]
    seen = []
    got = ingest.answer(index, "alpha", e, lambda p: seen.append(p) or [{"text": "ok"}, "!"], 2)
    assert got["answer"] == "ok!" and len(got["sources"]) == 2 and "[参考资料 1] 来源：f.md | A | 第1页\nalpha" in seen[0]
    assert ingest.answer(index.limit(0), "alpha", e, lambda p: "no")["answer"] == retrieve.NO_ANSWER
    for bad in (lambda: ingest.search(index, " ", e), lambda: ingest.answer(index, "q", e, str, knowledge_base="x")):
        with pytest.raises(ValueError):
            bad()


def test_result_metadata_falls_back_to_json(spark):
    rows = spark.createDataFrame([("", '{"document": {"file_name": "j"}, "source": {"page_numbers": [4], "line_range": [1, 2]}}'), ("r", "not json")], "file_name string, metadata_json string")
    got = [r["metadata"] for r in retrieve.result_metadata(rows).collect()]
    assert (got[0]["file_name"], got[0]["page_numbers"], got[0]["line_range"]) == ("j", ["4"], ["1", "2"]) and (got[1]["file_name"], got[1]["page_numbers"]) == ("r", None)


REVIEWED = "file_id string, chunk_id string, chunk_index int, text string, token_count int, chapter string, section string, page_number int, page_numbers array<int>, heading string, content_hash string"


def test_quality(spark):
    rows = [("f", "a", 0, "x", 60, "c", "s", 0, [1, 9], "", "h"), ("f", "b", 1, "A\nB", 60, "c", "s", 1, [], "A > B", "h"), ("f", "c", 2, "x", 60, None, "", None, [], "", None)]
    got = review.quality_issues(spark.createDataFrame(rows, REVIEWED)).orderBy("chunk_index", "code").collect()
    assert [(r["chunk_id"], r["code"]) for r in got] == [("a", "PAGE_JUMP"), ("b", "DUPLICATE_CONTENT"), ("b", "ORPHAN_HEADING"), ("c", "METADATA_MISSING"), ("c", "METADATA_MISSING"), ("c", "METADATA_MISSING")]
    report = review.quality_report(spark.createDataFrame(rows[:2] + rows[2:] * 3, REVIEWED)).first()
    assert (report["errors"], report["warnings"], report["score"]) == (9, 3, 0)
    with pytest.raises(ValueError):
        review.valid_status("DONE")


def test_pages_and_tree(spark):
    rows = spark.createDataFrame([("f", "a", 0, "x", 1, "", "", 3, [], "A > B", None), ("f", "b", 1, "y", 1, "", "", 4, [1, 2], "A", None), ("f", "c", 2, "z", 1, "", "", None, [], "", None)], REVIEWED)
    assert {r["page"]: len(r["chunks"]) for r in review.pages_of_chunks(rows).collect()} == {3: 1, 1: 1, 2: 1, 0: 1}
    assert {tuple(r["path"]): r["page_number"] for r in review.heading_tree(rows).collect()} == {("A",): 3, ("A", "B"): 3, ("A", "B", "Chunk 0"): 3, ("A", "Chunk 1"): 4, ("Chunk 2",): None}


def docx(paragraphs):
    body = "".join(f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}{table}</w:body></w:document>')
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("Heading2", "Sub"), ("", "1. item"), ("", "- dash"), ("", "plain")]))
    (tmp_path / "b.md").write_bytes("\ufeff# T\r\ntext".encode())
    pdf = b"%PDF-1"
    (tmp_path / "c.pdf").write_bytes(pdf)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c_origin.pdf", pdf)
        z.writestr("c_content_list.json", json.dumps([{"type": "text", "text": "Body here.", "page_idx": 0}]))
    (tmp_path / "bad.zip").write_bytes(b"no")
    where = str(tmp_path)
    assert [(r["element_type"], r["level"]) for r in files.word_elements(spark, where).orderBy("element_idx").collect()] == [("heading", 2), ("heading", 1), ("list", None), ("paragraph", None), ("table", None)]
    assert files.markdown_texts(spark, where).first()["title"] == "T"
    md = ingest.markdown_source(spark, where).collect()
    assert [(r["text"], r["metadata"]["document"]["file_name"]) for r in md] == [("# T\n\ntext", "b.md")]
    assert [r["text"] for r in ingest.word_source(spark, where).collect()] == ["1. item\n\n- dash\nplain\n表格第1行记录: k，v。"]
    assert [r["text"] for r in ingest.pdf_source(spark, where, where).collect()] == ["Body here."]
    import hashlib

    assert ingest.artifact_for(spark, where, hashlib.sha256(pdf).hexdigest()).first()["path"].endswith("c.zip")
    with pytest.raises(ValueError):
        ingest.handler_for("x.exe")
    assert ingest.handler_for("X.MD") is ingest.markdown_source


def test_the_newest_archive_counts(spark, tmp_path):
    import os

    pdf = b"%PDF-2"
    (tmp_path / "d.pdf").write_bytes(pdf)
    for n, (name, text, origin) in enumerate((("old.zip", "old body", pdf), ("new.zip", "new body", pdf), ("other.zip", "other body", b"x"))):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("o_origin.pdf", origin)
            z.writestr("o_content_list.json", json.dumps([{"type": "text", "text": text, "page_idx": 0}]))
        os.utime(tmp_path / name, (1_000_000 + n, 1_000_000 + n))
    where = str(tmp_path)
    assert [r["text"] for r in ingest.pdf_source(spark, where, where).collect()] == ["new body"]
    (tmp_path / "old.zip").unlink()
    (tmp_path / "new.zip").unlink()  # none of its own is left: the newest that has a content list
    assert [r["text"] for r in ingest.pdf_source(spark, where, where).collect()] == ["other body"]
    (tmp_path / "other.zip").write_bytes(b"broken")
    with pytest.raises(Exception, match="no parser archive for d.pdf"):
        ingest.pdf_source(spark, where, where).collect()


class FakeParser:
    """Answers of a parser service: a batch that is done at the third question, an archive that is there at the second try."""

    def __init__(self):
        self.calls, self.now, self.slept = [], 0.0, []
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a/x.json", "[1]")
            z.writestr("a/x_content_list.json", "[2]")
            z.writestr("a/full.md", "# text")
        self.zip = out.getvalue()

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds

    def send(self, method, address, headers, body):
        self.calls.append((method, address))
        n = self.calls.count((method, address))
        if address.endswith("/file-urls/batch"):
            assert json.loads(body)["files"][0]["name"] == "a.pdf" and json.loads(body)["language"] == "ch" and headers["Authorization"] == "Bearer t"
            return 200, json.dumps({"code": 0, "data": {"batch_id": "b", "file_urls": ["put://x"]}}).encode()
        if address == "put://x":
            return (201, b"") if body == b"%PDF" else (500, b"")
        if address.endswith("/batch/b"):
            state = "running" if n < 3 else "done"
            return 200, json.dumps({"data": {"extract_result": [{"data_id": "other", "state": "failed"}, {"data_id": "me", "state": state}]}}).encode()
        if address.endswith("/extract/task"):
            return 200, json.dumps({"code": 0, "data": {"task_id": json.loads(body)["url"]}}).encode()
        if address.endswith("/failing"):
            return 200, json.dumps({"data": {"state": "Failed"}}).encode()
        if address.endswith("/slow"):
            return 200, json.dumps({"data": {"state": "pending"}}).encode()
        if address.endswith("/ready"):
            return 200, json.dumps({"data": {"full_zip_url": "zip://a", "md_content": "inline"}}).encode()
        if address.endswith("/refused"):
            return 200, json.dumps({"code": "A1", "msg": "no"}).encode()
        if address == "zip://a":
            return (503, b"") if n == 1 else (200, self.zip)
        raise OSError("no such host")


def test_parser_service():
    from tesserae.sources import parser

    fake = FakeParser()
    service = parser.ParserService(fake.send, "http://p", "t", {"language": "ch"}, timeout=20, interval=2, clock=lambda: fake.now, sleep=fake.sleep)
    result = service.wait(service.submit_file("a.pdf", b"%PDF", "me"))
    assert result == {"data_id": "me", "state": "done"} and fake.slept == [2, 2]
    ready = service.wait(service.submit_address("ready"))
    assert service.artifacts(ready) == {"json": [1], "markdown": "inline"} and fake.slept[-1] == 2
    with pytest.raises(parser.ParserError):
        service.wait(service.submit_address("failing"))
    with pytest.raises(TimeoutError):
        service.wait(service.submit_address("slow"))
    with pytest.raises(parser.ParserError, match="A1"):
        service.wait(service.submit_address("refused"))
    before = len(fake.slept)
    with pytest.raises(parser.ParserError):
        service.fetch("gone://x")
    assert fake.slept[before:] == [2, 4] and fake.calls.count(("GET", "gone://x")) == 3
    for name, content, error in (("a.txt", b"%PDF", ValueError), ("a.pdf", b"other", parser.ParserError)):
        with pytest.raises(error):
            service.submit_file(name, content)
    assert service.artifacts({"content_list": [], "md": "x", "full_zip_url": "never://"}) == {"json": [], "markdown": "x"}
    with pytest.raises(zipfile.BadZipFile):
        parser.archive(b"no")
    assert [parser.state_of(x) for x in ({"status": "SUCCESS"}, {"md_url": "u"}, {"state": "error"}, {})] == ["done", "done", "failed", "running"]


def test_index_checks_vectors_and_lengths(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, vector array<float>, text string")
    assert index.dimension() is None and index.upsert(rows(("a", [1.0, 2.0], "x"), ("a", [1.0, 3.0], "y"))) == 1 and index.dimension() == 2
    kept = index.read().first()["text"]
    assert index.upsert(rows(("a", [1.0, 3.0], "y"), ("a", [1.0, 2.0], "x"))) == 1 and index.read().first()["text"] == kept
    for bad in (("b", [1.0], "x"), ("b", None, "x"), ("b", [1.0, 2.0], "x" * 8193)):
        with pytest.raises(Exception, match="components|too long"):
            index.upsert(rows(("c", [0.0, 1.0], "fine"), bad))
    assert [r["id"] for r in index.read().collect()] == ["a"]


def test_providers_by_name():
    from tesserae.operators import embed as E

    sent = []
    service = E.provider(" OpenAI ", model="m", base="http://e/", post=lambda *a: sent.append(a) or {"data": [{"index": 0, "embedding": [1]}]})
    assert service.embed(["t"]) == [[1.0]] and sent == [("http://e/embeddings", {"model": "m", "input": ["t"]}, 60.0)]
    assert E.provider("local", model=lambda texts: [[3.0, 4.0] for _ in texts]).embed(["t"]) == [[0.6, 0.8]]
    assert E.endpoint(url="u", base="b") == "u"
    for kind, options, error in (("x", {}, ValueError), ("api", {"post": print}, E.EmbeddingUnavailable), ("api", {}, ValueError)):
        with pytest.raises(error):
            E.provider(kind, model="m", **options)


def test_reviews_are_assembled(spark, tmp_path):
    chunks = spark.createDataFrame([("f", "c1", 0, "t1", "h", "a", "b", [1], 1, 3, "x"), ("g", "c2", 0, "t2", "h", "a", "b", [2], 2, 3, "y")], "file_id string, chunk_id string, chunk_index int, text string, heading string, chapter string, section string, page_numbers array<int>, page_number int, token_count int, content_hash string")
    blocks = spark.createDataFrame([("f", 0, "paragraph", "block", 7)], "file_id string, block_idx int, block_type string, content string, page_number int")
    parts = ingest.review_document(chunks, ingest.read_state(Index(spark, str(tmp_path / "none"))), blocks=blocks)
    assert sorted((r["file_id"], r["page"], r["blocks"] is not None) for r in parts["pages"].collect()) == [("f", 7, True), ("g", 2, False)]
    rows = {r["file_id"]: r for r in ingest.assembled_review(parts).collect()}
    assert set(rows) == {"f", "g"} and rows["g"]["chunks"][0]["text"] == "t2" and rows["f"]["pages"][0]["page"] == 7
    assert ingest.Settings.from_environment({"RETRIEVAL_DEFAULT_TOP_K": "7", "RETRIEVAL_MAX_TOP_K": "x", "RETRIEVAL_MIN_SCORE": " 0.5 "}) == ingest.Settings(7, 20, 0.5)
    sizes = spark.createDataFrame([(5,), (2048,), (3 << 20,)], "n long").select(api.size_text(F.col("n")).alias("t")).collect()
    assert [r["t"] for r in sizes] == ["5 B", "2.0 KB", "3.0 MB"]


def test_previews(spark, tmp_path):
    (tmp_path / "x_chunks_preview.json").write_text(json.dumps({"chunks": [{"chunk_id": "1", "chunk_index": 0, "text": "t", "metadata": {"file_id": "F", "file_name": "n"}}]}))
    (tmp_path / "y_chunks_preview.json").write_text("{")
    chunks = files.previews(spark, str(tmp_path))
    docs = files.documents_of(chunks)
    assert [(r["document_id"], r["file_name"], r["file_type"], r["chunk_count"]) for r in docs.collect()] == [("F", "n", "unknown", 1)]
    assert files.find_document(docs, "n").count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\nbody")
    index = Index(spark, str(tmp_path / "index"))
    watch_markdown(spark, str(tmp_path / "in"), index, str(tmp_path / "state")).awaitTermination()
    assert [r["text"] for r in index.read().collect()] == ["# A\n\nbody"]
    (tmp_path / "in" / "b.md").write_text("# B\n\nmore")
    watch_markdown(spark, str(tmp_path / "in"), index, str(tmp_path / "state")).awaitTermination()
    assert index.read().count() == 2


def test_service(spark, tmp_path):
    service = api.Service(spark, Index(spark, str(tmp_path / "index")), model=lambda p: "answer", records=Index(spark, str(tmp_path / "records")))
    got = service.upload(io.BytesIO(b"# A\n\nalpha body"), "C:/x/a?.md", str(tmp_path / "up"))
    assert got["upsert_count"] == 1 and got["file_size"] == 15 and got["path"].endswith("a_.md")
    assert [r["text"] for r in service.search("alpha", 3).collect()] in (["# A\n\nalpha body"], [])
    tool = api.search_tool(service)
    assert tool["call"]({"query": "# A\n\nalpha body"})[0]["metadata"]["file_name"] == "a_.md" == tool["call"]("# A\n\nalpha body")[0]["metadata"]["file_name"]
    assert service.respond_chat("# A\n\nalpha body") == (200, service.chat("# A\n\nalpha body"))
    assert service.respond_chat(" ")[0] == 400 and service.respond_chat("x", knowledge_base="other")[0] == 400

    def broken(_):
        raise OSError("secret")

    assert api.Service(spark, service.index, model=broken).respond_chat("# A\n\nalpha body") == (502, {"success": False, "message": "the model failed"})
    assert api.Service(spark, Index(spark, str(tmp_path / "none"))).respond_chat("q")[0] == 503
    assert api.respond(lambda: 1 / 0) == (500, {"success": False, "message": "the request failed"})
    assert service.chat("# A\n\nalpha body")["answer"] == "answer" and service.health()["index"]
    assert [(r["file_name"], r["chunk_count"]) for r in api.recent(service.records.read()).collect()] == [("a_.md", 1)]
    for stream, name, error in ((io.BytesIO(b""), "e.md", ValueError), (io.StringIO("x"), "e.md", TypeError), (io.BytesIO(b"x"), "..", ValueError), (io.BytesIO(b"x"), "e.exe", ValueError)):
        with pytest.raises(error):
            api.save_upload(stream, name, str(tmp_path / "up"))
    assert api.source_text(spark, str(tmp_path / "up")).filter("text like '# A%'").count() == 1
    marked = spark.createDataFrame([(3, 5), (3, None), (3, 1), (0, 2), (None, 2)], "a int, b int").select(api.lines_to_mark(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r["m"] for r in marked] == [[3, 5], [3, 3], [3, 3], None, None]


def test_vectors_keep_the_precision_that_is_asked_for(spark):
    from pyspark.sql.types import DoubleType

    texts = [f"text {i}" for i in range(50)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r["text"]: r["vector"] for r in embed(rows, HashEmbedder, component=DoubleType()).collect()}
    assert found == dict(zip(texts, HashEmbedder().embed(texts)))


def test_a_sentence_beyond_the_budget_may_stand_with_its_neighbours(spark):
    text = "one two. " + "word " * 900 + "end. three four."
    rows = spark.createDataFrame([(1, 0, "paragraph", text, None, None)], "file_id long, block_idx int, block_type string, content string, page_number int, heading_level int")
    told = lambda alone: [r["text"] for r in pdf_chunks(rows, Budget(), alone=alone).orderBy("chunk_index").collect()]
    long = "word " * 900 + "end."
    assert told(True) == ["one two.", long, "three four."]
    assert told(False) == ["one two.", f"one two.\n{long}", f"{long}\nthree four."]


def test_tokens_are_counted_as_their_pattern_matches(spark):
    import re

    texts = ["", " 　", "a b_1  c", "中文 abc中 d.e,, f  g", "é\U0001f600 x9é_y \x85\x1c.", "...", "x", " x ", None]
    pattern = X.TOKEN.replace(r"\x{", r"\u").replace("}", "")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", X.token_count(F.col("text")).alias("n"), X.strip(F.col("text")).alias("s"))
    for r in rows.collect():
        assert r["n"] == len(re.findall(pattern, r["text"] or "", re.ASCII)) and r["s"] == (r["text"] if r["text"] is None else r["text"].strip())


def test_blank_lines_are_no_items(spark, tmp_path):
    rows = [(1, "\n".join(["a"] * 7 + [" \t", "b"])), (2, "\n".join(["a"] * 7 + ["x  y"]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r["file_id"], r["block_idx"], r["block_type"]) for r in catalogue.QUERIES["parser_item_blocks"](spark, str(tmp_path)).orderBy("file_id", "block_idx").collect()]
    assert [f for f in found if f[2] == "table"] == [(2, 7, "table")] and [f[1] for f in found] == [*range(8), *range(8)]


def _plan(spark, query, sf_dir):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return catalogue.QUERIES[query](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def _small(spark, tmp_path):
    spark.createDataFrame([(1, "T\n\na b.\nc; d")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def _texts_are_handled_once(plan):
    """No text of a chunk is counted again, and no unit goes into the exchange where chunks are numbered."""
    assert "regexp_replace(text#" not in plan
    numbered = plan.partition("Window [row_number()")[2].split("\n+- ")[0]
    assert numbered and " _m#" not in next(line for line in numbered.splitlines() if "+- Project" in line).partition("[")[2].partition("CASE WHEN")[0]


def test_word_chunks_clean_and_count_once(spark, tmp_path):
    plan = _plan(spark, "word_chunk_rows", _small(spark, tmp_path))
    _texts_are_handled_once(plan)
    assert plan.count(r"\n{3,}") == 1


def test_markdown_chunks_clean_and_count_once(spark, tmp_path):
    plan = _plan(spark, "markdown_chunk_rows", _small(spark, tmp_path))
    _texts_are_handled_once(plan)
    assert plan.count(r"\n{3,}") == 1


def test_pdf_chunks_count_once(spark, tmp_path):
    _texts_are_handled_once(_plan(spark, "pdf_chunk_rows", _small(spark, tmp_path)))


def test_chunk_tokens_are_those_of_the_text(spark):
    content = [(1, 0, "heading", "1 T-1"), (1, 1, "paragraph", "a_1 b.　中 文;\x85" * 400), (1, 2, "table", "| x | \n"), (1, 3, "paragraph", "end"), (2, 0, "paragraph", "x. " * 900)]
    blocks = spark.createDataFrame([(*r, 1, 1) for r in content], "file_id long, block_idx int, block_type string, content string, page_number int, heading_level int")
    made = pdf_chunks(blocks).select("token_count", X.token_count(F.col("text")).alias("again")).collect()
    assert len(made) > 3 and all(r["token_count"] == r["again"] for r in made)


def test_line_breaks(spark):
    row = spark.createDataFrame([("a\r\nb\rc\n\nd e\x85f\r\r\ng",)], "t string").select(F.split("t", X.LINE_BREAK).alias("x")).first()
    assert row["x"] == ["a", "b", "c", "", "d", "e", "f", "", "g"]
