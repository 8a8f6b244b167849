"""The engine over HTTP with JSON, on the standard library."""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from loomline.functions.stages import DEFAULT_STAGES
from loomline.plans.engine import KINDS, Engine
from loomline.sources.documents import form_feed_pages, pdf_pages


class Refused(Exception):
    """A request that gets an error status."""

    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Api:
    """One method for each route; a request is (method, path, query, body)."""

    def __init__(self, engine: Engine):
        self.engine = engine
        doc = r"/api/documents/(?P<doc>[^/]+)"
        routes = [
            ("POST", r"/api/documents", self.upload), ("GET", r"/api/documents", lambda r: _rows(engine.documents())), ("DELETE", doc, self.delete), ("POST", doc + r"/build/(?P<kind>[^/]+)", self.build),
            ("GET", r"/api/jobs/(?P<job>[^/]+)", self.job), ("GET", doc + r"/jobs", lambda r: _rows(engine.jobs.latest(r["doc"]))), ("POST", doc + r"/ask/naive", lambda r: self.ask(engine.ask_naive, r)), ("POST", doc + r"/ask/timeline", lambda r: self.ask(engine.ask_timeline, r)),
            ("POST", doc + r"/compare", lambda r: self.ask(engine.compare, r)), ("GET", doc + r"/events", lambda r: _rows(engine.events(r["doc"]))), ("GET", doc + r"/graph", self.graph), ("GET", doc + r"/observations", self.observations),
            ("GET", doc + r"/metrics", lambda r: engine.metrics(r["doc"])), ("GET", doc + r"/taxonomy", lambda r: _rows(engine.taxonomy(r["doc"]))[0]["taxonomy"]), ("GET", r"/api/taxonomy", lambda r: list(DEFAULT_STAGES)), ("GET", r"/api/health", lambda r: {"spark": engine.health()}),
        ]
        self.routes = [(m, re.compile(p), f) for m, p, f in routes]

    def handle(self, method: str, target: str, body: bytes = b"", headers: dict | None = None) -> tuple[int, object]:
        at = urlsplit(target)
        for m, pattern, f in self.routes:
            found = pattern.fullmatch(at.path)
            if found and m == method:
                try:
                    return 200, f(found.groupdict() | {"query": parse_qs(at.query), "body": body, "headers": headers or {}})
                except Refused as e:
                    return e.status, {"detail": str(e)}
                except LookupError as e:
                    return 404, {"detail": str(e)}
        return 404, {"detail": "no such route"}

    def upload(self, r: dict) -> list[dict]:
        """The body is the file; its name is in ``?filename=``."""
        name = Path(r["query"].get("filename", [""])[0]).name
        parser = {".pdf": pdf_pages, ".txt": form_feed_pages}.get(Path(name).suffix.lower())
        if parser is None:
            raise Refused(400, "a .pdf or .txt file is expected")
        folder = f"{self.engine.conf.table('uploads')}/{uuid.uuid4().hex}"
        fs, at = self.engine.store._fs(f"{folder}/{name}")
        try:
            to = fs.create(at)
            to.write(bytearray(r["body"]))
            to.close()
            out = _rows(self.engine.ingest(folder, parser))
        finally:
            fs.delete(at.getParent(), True)
        if not out:
            raise Refused(400, "the file has no text")
        return out

    def delete(self, r: dict) -> dict:
        self.engine.delete(r["doc"])
        return {"deleted": r["doc"]}

    def build(self, r: dict) -> dict:
        if r["kind"] not in KINDS:
            raise Refused(400, f"kind must be one of {KINDS}")
        doc, engine = r["doc"], self.engine
        engine.pages(doc)
        job = engine.jobs.create(doc, r["kind"])
        threading.Thread(target=self._run, args=(job, engine.work(doc, r["kind"])), daemon=True).start()
        return {"job_id": job}

    def _run(self, job: str, work: Callable) -> None:
        try:
            self.engine.jobs.run(job, work)
        except Exception:  # noqa: BLE001, S110  the job's log has the error
            pass

    def job(self, r: dict) -> dict:
        found = _rows(self.engine.jobs.get(r["job"]))
        if not found:
            raise Refused(404, "no such job")
        return found[0]

    def ask(self, f: Callable, r: dict) -> dict:
        question = json.loads(r["body"] or b"{}").get("question", "")
        if not question:
            raise Refused(422, "a question is expected")
        try:
            out = f(r["doc"], question)
        except Exception as e:
            raise Refused(502, f"{type(e).__name__}: {e}") from e
        if out.get("filtered"):
            raise Refused(422, "the model refused the input")
        return out

    def graph(self, r: dict) -> dict:
        nodes, edges = self.engine.graph(r["doc"])
        return {"nodes": _rows(nodes), "edges": _rows(edges)}

    def observations(self, r: dict) -> list[dict]:
        return _rows(self.engine.observations(r["doc"], int(r["query"].get("limit", ["20"])[0])))


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is not started yet; call ``serve_forever``."""
    api = Api(engine)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, value = api.handle(self.command, self.path, body, dict(self.headers))
            data = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
