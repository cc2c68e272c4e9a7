"""A small search service: POST /search (an image, with options in the form or the query string) and GET /metrics.

For one machine in front of a Spark session; requests run one search each.
"""

from __future__ import annotations

import json
import threading
import time
from collections import defaultdict
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from bitsift.config import SearchOptions
from bitsift.engine import Engine
from bitsift.functions.codes import LANES
from bitsift.metrics import DURATION_BUCKETS, SCORE_BUCKETS
from bitsift.operators.features import describe
from bitsift.sources.files import decode_grey, fit_size

LIMIT = 50 << 20


class Metrics:
    """Counts of searches, and histograms of their duration and best score, by size class and nprobe."""

    def __init__(self) -> None:
        self.lock, self.counts = threading.Lock(), defaultdict(int)
        self.sums: dict[tuple, list] = {}

    def observe(self, labels: tuple[tuple[str, str], ...], seconds: float, score: float | None) -> None:
        with self.lock:
            self.counts[labels] += 1
            for name, value, buckets in (("search_duration_seconds", seconds, DURATION_BUCKETS), ("search_max_score", score, SCORE_BUCKETS)):
                if value is not None:
                    held = self.sums.setdefault((name, labels), [0, 0.0, [0] * len(buckets)])
                    held[0] += 1
                    held[1] += value
                    for i, b in enumerate(buckets):
                        held[2][i] += value <= b

    def text(self) -> str:
        mark = lambda labels: ",".join(f'{k}="{v}"' for k, v in labels)
        with self.lock:
            out = [f"search_count{{{mark(x)}}} {n}" for x, n in self.counts.items()]
            for (name, labels), (n, total, counts) in self.sums.items():
                buckets = DURATION_BUCKETS if name.endswith("seconds") else SCORE_BUCKETS
                out += [f'{name}_bucket{{{mark((*labels, ("le", f"{b:g}")))}}} {c}' for b, c in zip(buckets, counts, strict=True)]
                out += [f'{name}_bucket{{{mark((*labels, ("le", "+Inf")))}}} {n}', f"{name}_sum{{{mark(labels)}}} {total}", f"{name}_count{{{mark(labels)}}} {n}"]
        return "\n".join(out) + "\n"


def size_name(width: int, height: int) -> str:
    return next((str(s) for s in (128, 256, 512, 768, 1024, 1536, 2048) if width * height <= s * s), "2048+")


def parse_form(kind: str, body: bytes) -> dict[str, bytes]:
    """The fields of a multipart form; any other body is the file itself."""
    if not kind.startswith("multipart/"):
        return {"file": body}
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + body)
    return {part.get_param("name", header="content-disposition") or "": part.get_payload(decode=True) or b"" for part in message.iter_parts()}


def search(engine: Engine, metrics: Metrics, data: bytes, options: SearchOptions) -> dict:
    """{time in ms, result: [[score, path], ...]}; no hit and no features give an empty list."""
    began = time.perf_counter()
    image = decode_grey(data)
    if image is None:
        raise ValueError("the image can't be decoded")
    codes, _ = describe(fit_size(image, *engine.extractor.options.max_size), engine.extractor.options)
    hits = []
    if len(codes):
        rows = [(i, *map(int, c)) for i, c in enumerate(codes)]
        queries = engine.spark.createDataFrame(rows, "qid long, " + ", ".join(f"{c} long" for c in LANES))
        hits = [[r["score"], r["path"]] for r in engine.search_codes(queries, options).collect()]
    seconds = time.perf_counter() - began
    labels = (("size", size_name(image.shape[1], image.shape[0])), ("nprobe", str(options.nprobe)), ("scale_factor", f"{engine.extractor.options.scale:g}"))
    metrics.observe(labels, seconds, hits[0][0] if hits else None)
    return {"time": round(seconds * 1000), "result": hits}


def make_server(engine: Engine, address: tuple[str, int] = ("127.0.0.1", 8080), options: SearchOptions = SearchOptions(), token: str | None = None) -> ThreadingHTTPServer:
    metrics = Metrics()

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: str, kind: str = "application/json") -> None:
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def allowed(self) -> bool:
            if token and self.headers.get("Authorization") != f"Bearer {token}":
                self.reply(401, '{"error":"a token is needed"}')
                return False
            return True

        def do_GET(self) -> None:
            if self.allowed():
                known = urlsplit(self.path).path == "/metrics"
                self.reply(200 if known else 404, metrics.text() if known else "", "text/plain; version=0.0.4")

        def do_POST(self) -> None:
            if not self.allowed():
                return
            at, size = urlsplit(self.path), int(self.headers.get("Content-Length") or 0)
            if at.path != "/search" or size > LIMIT:
                self.reply(404 if at.path != "/search" else 413, "{}")
                return
            try:
                form = parse_form(self.headers.get("Content-Type", ""), self.rfile.read(size))
                given = {k: v[0] for k, v in parse_qs(at.query).items()} | {k: v.decode() for k, v in form.items() if k != "file"}
                wanted = options.overlay(**{k: int(given[k]) for k in ("nprobe", "k", "count", "distance") if given.get(k)})
                self.reply(200, json.dumps(search(engine, metrics, form.get("file", b""), wanted)))
            except Exception as e:  # any failure is the request's, not the service's
                self.reply(500, json.dumps({"error": str(e)}))

        def log_message(self, *args) -> None: ...

    return ThreadingHTTPServer(address, Handler)
