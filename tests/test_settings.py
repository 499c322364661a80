"""Settings, and hits as a vector store tells them."""

import json

import pytest

from tesserae.operators import retrieve
from tesserae.plans.settings import ChatSettings, EmbeddingSettings, ParserSettings, environment, flag


def test_environment():
    lines = "# c\nA=1\n B = 'x y' \nC\n=d\nE=\"q\"\nA=2\nF=a=b"
    assert environment(lines, {"B": "given"}) == {"A": "1", "B": "given", "E": "q", "F": "a=b"}
    assert flag({"X": " YES "}, "X", False) and not flag({"X": "0"}, "X", True) and flag({}, "X", True)


def test_embedding_settings():
    assert EmbeddingSettings.from_environment({}) == EmbeddingSettings()
    made = EmbeddingSettings.from_environment({"EMBEDDING_MODEL": "m", "EMBEDDING_API_BASE": "http://e/", "EMBEDDING_API_KEY": "k", "EMBEDDING_BATCH_SIZE": "4", "EMBEDDING_TIMEOUT_SECONDS": "5", "EMBEDDING_NORMALIZE": "off"})
    sent = []
    assert made.provider(lambda *a: sent.append(a) or [[1, 2]]).embed(["t"]) == [[1.0, 2.0]]
    assert sent == [("http://e/embeddings", {"model": "m", "input": ["t"]}, 5.0, {"Content-Type": "application/json", "Authorization": "Bearer k"})] and made.batch == 4 and "k'" not in repr(made)
    local = EmbeddingSettings(kind="local", normalise=False)
    assert local.provider(local=lambda texts: [[3.0, 4.0]]).embed(["t"]) == [[3.0, 4.0]]


def test_parser_and_chat_settings():
    made = ParserSettings.from_environment({"MINERU_TOKEN": "t", "MINERU_PRECISION_BASE_URL": "http://p/", "MINERU_IS_OCR": "1", "MINERU_PAGE_RANGES": "1-3", "MINERU_EXTRA_FORMATS": " docx, ,html"})
    assert made.options["is_ocr"] is True and made.options["page_ranges"] == "1-3" and made.options["extra_formats"] == ["docx", "html"]
    calls = []
    service = made.service(lambda method, address, headers, body: calls.append((address, headers, json.loads(body))) or (200, b'{"data": {"task_id": 7}}'))
    assert service.submit_address("u").address == "http://p/extract/task/7" and calls[0][1]["Authorization"] == "Bearer t" and calls[0][2]["language"] == "ch"
    for given in ({}, {"MINERU_PROVIDER": "other", "MINERU_TOKEN": "t"}):
        with pytest.raises(ValueError):
            ParserSettings.from_environment(given).service(print)
    assert ChatSettings.from_environment({"CHAT_MODEL_NAME": "m", "CHAT_MODEL_TEMPERATURE": "0.7"}) == ChatSettings(model="m", temperature=0.7)


def test_hits(spark):
    hits = [
        {"id": 1, "distance": 0.25, "entity": {"text": " a ", "file_name": "f", "page_numbers": "4, 5", "line_start": 1, "line_end": 2}}, {"id": 2, "score": "x", "distance": 1.0, "text": "b", "entity": {}},
        {"id": 3, "score": 0.5, "text": "  "}, {"id": 4, "score": "", "distance": "0.75", "entity": {"text": "c", "metadata_json": '{"document": {"file_name": "j"}, "source": {"page_numbers": [9]}}'}},
    ]
    raw = spark.createDataFrame([(json.dumps(h),) for h in hits] + [("{",)], "hit string")
    rows = {r["id"]: r for r in retrieve.hit_rows(raw).collect()}
    assert {k: r["score"] for k, r in rows.items()} == {"1": 0.25, "2": 0.0, "3": 0.5, "4": 0.75, None: 0.0} and rows["2"]["text"] == "b"
    got = {r["id"]: r for r in retrieve.retrieved_documents(retrieve.result_metadata(retrieve.hit_rows(raw))).collect()}
    assert set(got) == {"1", "2", "4"} and got["1"]["page_content"] == "a"
    assert (got["1"]["metadata"]["page"], got["1"]["metadata"]["page_numbers"], got["1"]["metadata"]["line_range"]) == ("4", ["4", "5"], ["1", "2"])
    assert (got["4"]["metadata"]["file_name"], got["4"]["metadata"]["page"], got["2"]["metadata"]["page"]) == ("j", "9", None)
