"""A client for a layout parser's service: jobs for files or addresses, waiting, and the artifacts of a finished job.

Nothing here opens a connection: ``send`` does, a function of (method, address, headers, body) that returns (status, body),
as bytes. Time is given too, so waiting can be tested. For one file ``ParserService`` submits and waits; for files that arrive
``tesserae.streaming.jobs`` keeps each job's state in a stream.
"""

from __future__ import annotations

import hashlib
import io
import json
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from tesserae.sources.files import DONE, FAILED

# Names that a service's answers use, in the order in which they count.
RESULT_LISTS = ("extract_result", "extract_results", "results", "files")
ADDRESSES = ("full_zip_url", "md_url", "markdown_url", "content_list_url", "middle_json_url", "json_url")
JSON_INLINE, JSON_ADDRESS = ("content_list", "middle_json", "layout_dets", "json"), ("content_list_url", "middle_json_url", "json_url")
TEXT_INLINE, TEXT_ADDRESS = ("md_content", "markdown", "md"), ("md_url", "markdown_url")
ARCHIVE_ADDRESS = ("full_zip_url", "zip_url")


class ParserError(RuntimeError):
    """The service refused, failed, or answered what can't be used."""


@dataclass(frozen=True)
class Job:
    """Where a job's state is asked for, and which of several results is its own."""

    address: str
    data_id: str | None = None


def data_id_of(name: str, content: bytes) -> str:
    """The same for the same file whenever it is sent."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}:{hashlib.sha256(content).hexdigest()}"))


def _first(record: Mapping[str, Any], names: Iterable[str]) -> Any:
    return next((record[n] for n in names if record.get(n)), None)


def own_result(answer: Mapping[str, Any], data_id: str | None) -> dict | None:
    """A job's result in an answer: of a list the first for ``data_id`` or for no one."""
    data = answer.get("data") or {}
    if data_id is None:
        return data
    found = _first(data, RESULT_LISTS) or []
    return next((r for r in ([found] if isinstance(found, dict) else found) if r.get("data_id") is None or str(r["data_id"]) == data_id), None)


def state_of(result: Mapping[str, Any]) -> str:
    """``done`` (by its state, or with any artifact), ``failed`` or ``running``."""
    said = str(result.get("state") or result.get("status") or "").lower()
    if said in DONE or _first(result, ADDRESSES):
        return "done"
    return "failed" if said in FAILED else "running"


@dataclass
class ParserService:
    send: Callable[[str, str, dict[str, str], bytes | None], tuple[int, bytes]]
    root: str
    token: str = ""
    options: dict[str, Any] = field(default_factory=dict)
    timeout: float = 300.0
    interval: float = 2.0
    attempts: int = 3
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    other: Callable[[str], bytes] | None = None  # fetches what ``send`` couldn't, by another way

    def call(self, method: str, address: str, body: Mapping[str, Any] | None = None) -> dict:
        """The JSON answer; an HTTP error or a code other than 0 fails."""
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.token}"}
        status, raw = self.send(method, address, headers, None if body is None else json.dumps(body).encode())
        if status >= 400:
            raise ParserError(f"{method} {address}: status {status}")
        answer = json.loads(raw)
        if str(answer.get("code", 0)) != "0":
            raise ParserError(f"{method} {address}: {answer}")
        return answer

    def submit_file(self, name: str, content: bytes, data_id: str | None = None) -> Job:
        """Asks for an address to upload to, and uploads the file there."""
        if not name.lower().endswith(".pdf"):
            raise ValueError("only PDF files are parsed")
        data_id = data_id or data_id_of(name, content)
        given = self.call("POST", f"{self.root}/file-urls/batch", {**self.options, "files": [{"name": name, "data_id": data_id}]}).get("data") or {}
        if not given.get("batch_id") or not given.get("file_urls"):
            raise ParserError(f"no address to upload to: {given}")
        status, _ = self.send("PUT", given["file_urls"][0], {}, content)
        if status not in (200, 201, 204):
            raise ParserError(f"the upload was answered with status {status}")
        return Job(f"{self.root}/extract-results/batch/{given['batch_id']}", data_id)

    def submit_address(self, url: str, name: str | None = None) -> Job:
        given = self.call("POST", f"{self.root}/extract/task", {**self.options, "url": url, **({"file_name": name} if name else {})}).get("data") or {}
        number = _first(given, ("task_id", "id"))
        if not number:
            raise ParserError(f"no task was made: {given}")
        return Job(f"{self.root}/extract/task/{number}")

    def wait(self, job: Job) -> dict:
        """The result of a job once it is done; asks every ``interval`` seconds, for ``timeout`` seconds."""
        end, answer = self.clock() + self.timeout, None
        while self.clock() < end:
            state, answer = self.ask(job)
            if state == "done":
                return answer
            self.sleep(self.interval)
        raise TimeoutError(f"the job wasn't done in {self.timeout} s: {answer}")

    def ask(self, job: Job) -> tuple[str, dict]:
        """``done`` with the job's result, or ``running`` with the answer. A failed job raises."""
        answer = self.call("GET", job.address)
        result = own_result(answer, job.data_id)
        state = state_of(result) if result else "running"
        if state == "failed":
            raise ParserError(f"the job failed: {answer}")
        return state, result if state == "done" else answer

    def fetch(self, address: str) -> bytes:
        """The bytes at an address, with longer and longer breaks between ``attempts``."""
        for attempt in range(1, self.attempts + 1):
            try:
                status, body = self.send("GET", address, {}, None)
                if status < 400:
                    return body
                problem: Exception = ParserError(f"status {status}")
            except OSError as error:
                problem = error
            if attempt < self.attempts:
                self.sleep(self.interval * attempt)
        if self.other is not None:
            return self.other(address)
        raise ParserError(f"{address} can't be fetched") from problem

    def artifacts(self, result: Mapping[str, Any]) -> dict[str, Any]:
        """``json`` and ``markdown`` of a result, as far as they are there: inline, by their own addresses, or else from the archive."""
        found: dict[str, Any] = {}
        tree = next((result[n] for n in JSON_INLINE if isinstance(result.get(n), (list, dict))), None)
        if tree is None and (address := _first(result, JSON_ADDRESS)):
            tree = json.loads(self.fetch(address))
        if tree is not None:
            found["json"] = tree
        text = next((result[n] for n in TEXT_INLINE if isinstance(result.get(n), str) and result[n].strip()), None)
        if text is None and (address := _first(result, TEXT_ADDRESS)):
            text = self.fetch(address).decode("utf-8", "replace")
        if text:
            found["markdown"] = text
        address = _first(result, ARCHIVE_ADDRESS)
        return archive(self.fetch(address)) | found if address and len(found) < 2 else found


def archive(content: bytes) -> dict[str, Any]:
    """The first JSON and the first Markdown member, in the archive's order. What isn't a ZIP fails."""
    found: dict[str, Any] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            kind = {"json": "json", "md": "markdown"}.get(name.lower().rpartition(".")[2])
            if kind and kind not in found:
                text = z.read(name).decode("utf-8")
                found[kind] = json.loads(text) if kind == "json" else text
    return found
