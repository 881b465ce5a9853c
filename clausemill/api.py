"""The library's façade: search, analyse, ingest, and an optional HTTP front."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame

from .kernels.query import build_query, query_type
from .operators.extract import analyze
from .operators.search import search
from .plans.pipelines import PIPELINES, query_terms

DEFAULT_PIPELINE = "Final Pipeline"


class Engine:
    """Indexes by pipeline (term, doc_id, positions), the documents' ids, and the lemma maps of queries."""

    def __init__(self, indexes: dict[str, DataFrame], doc_ids: DataFrame, lemma_maps: dict[str, dict[str, str]] | None = None):
        self.indexes, self.doc_ids, self.lemma_maps = indexes, doc_ids, lemma_maps or {}

    def terms_of(self, pipeline: str) -> Callable[[str], list[str]]:
        return lambda text: query_terms(pipeline, text, self.lemma_maps.get(pipeline))

    def search(self, query: str, pipeline: str = DEFAULT_PIPELINE, top: int | None = None) -> tuple[list, float]:
        """(ids in order of rank, milliseconds)."""
        if pipeline not in self.indexes:
            raise KeyError(f"no index for {pipeline!r}; there are {sorted(self.indexes)} of {sorted(PIPELINES)}")
        began = time.perf_counter()
        rows = search(self.indexes[pipeline], self.doc_ids, query, self.terms_of(pipeline), top).orderBy("rank").select("doc_id").collect()
        return [r["doc_id"] for r in rows], 1000 * (time.perf_counter() - began)

    analyze = staticmethod(analyze)
    build_query = staticmethod(build_query)
    query_type = staticmethod(query_type)


def serve(engine: Engine, ingest: Callable[[bytes], dict] | None = None, port: int = 8000, top: int = 100) -> ThreadingHTTPServer:
    """A server for GET /api/search?q&pipeline, POST /api/analyze and POST /api/upload; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, value: object, status: int = 200) -> None:
            data = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def handle_with(self, action: Callable[[], object]) -> None:
            try:
                self.answer(action())
            except Exception as e:  # a request's error is the client's answer, not the server's end
                self.answer({"error": str(e)}, 500)

        def body(self) -> bytes:
            return self.rfile.read(int(self.headers.get("Content-Length") or 0))

        def do_GET(self) -> None:
            url = urlparse(self.path)
            if url.path != "/api/search":
                return self.answer({"error": "not found"}, 404)
            asked = {k: v[0] for k, v in parse_qs(url.query).items()}

            def run() -> dict:
                query, pipeline = asked.get("q", ""), asked.get("pipeline", DEFAULT_PIPELINE)
                ids, ms = engine.search(query, pipeline, top)
                return {"query": query, "type": query_type(query), "pipeline": pipeline, "results": ids, "count": len(ids), "time_ms": round(ms, 3)}

            self.handle_with(run)

        def do_POST(self) -> None:
            data = self.body()
            if self.path == "/api/analyze":
                self.handle_with(lambda: analyze(json.loads(data or b"{}").get("text", "")))
            elif self.path == "/api/upload" and ingest is not None:
                self.handle_with(lambda: ingest(data))
            else:
                self.answer({"error": "not found"}, 404)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
