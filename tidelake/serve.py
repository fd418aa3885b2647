"""The named queries, factors and backtests over HTTP: JSON in, JSON out, pages of bounded size."""

from __future__ import annotations

import json
import math
from dataclasses import asdict
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from tidelake.functions.dates import date_parameter
from tidelake.operators import factors
from tidelake.operators.api import DataApi
from tidelake.plans.backtest import Config, Jobs

#: Bytes that a request's body may have.
BODY_MOST = 8 << 20


def plain(x):
    """What JSON can hold: dates as text, NaN and infinities as null."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    return x.isoformat() if isinstance(x, date) else x


#: Answers about factors that are kept, the latest ones.
TRACKED = 64


class Service:
    """What the paths do, apart from HTTP: answer(method, path, body, token) gives (status, value)."""

    def __init__(self, api: DataApi, registry: factors.FactorRegistry | None = None, jobs: Jobs | None = None, market=None):
        self.api, self.registry, self.jobs, self.market = api, registry, jobs, market
        self.tracked: dict[tuple, dict] = {}

    def answer(self, method: str, path: str, body: dict, token: str = "") -> tuple[int, object]:
        parts = [p for p in path.split("?")[0].split("/") if p]
        if parts == ["healthz"]:
            return 200, self.api.health()
        if parts == ["docs", "openapi.json"] or parts == ["docs"]:
            return 200, self.api.openapi()
        if self.api.tokens and (body.get("token") or token) not in self.api.tokens:
            return 401, {"code": 40101, "msg": "the token isn't valid", "data": None}
        try:
            if parts[:2] == ["api", "factors"] and self.registry is not None:
                return self._factors(method, parts[2:], body)
            if parts[:2] == ["api", "backtests"] and self.jobs is not None:
                return self._backtests(method, parts[2:], body)
        except (KeyError, TypeError, ValueError) as e:
            return 400, {"code": 40001, "msg": str(e), "data": None}
        name = body.get("api_name") or (parts[0] if len(parts) == 1 else "")
        if method != "POST" or not name:
            return 404, {"code": 40401, "msg": "no such path", "data": None}
        return 200, self.api.answer(name, body.get("params") or {}, body.get("fields") or "", body.get("token") or token)

    def _factors(self, method: str, rest: list[str], body: dict):
        if rest == ["kinds"]:
            return 200, factors.catalog()
        if not rest and method == "GET":
            return 200, [asdict(f) for f in self.registry.list()]
        if not rest and method == "POST":
            self.registry.put(made := factors.Factor(**body))
            return 200, asdict(made)
        found = self.registry.get(rest[0])
        if found is None:
            return 404, {"code": 40401, "msg": f"no factor {rest[0]}", "data": None}
        if method == "DELETE":
            self.registry.delete(rest[0])
            return 200, {"deleted": rest[0]}
        if rest[1:] in (["track"], ["coverage"]):
            start, end = date_parameter(body["start"]), date_parameter(body["end"])
            horizon, layers = int(body.get("horizon", 5)), int(body.get("layers", 5))
            # a factor's definition is part of the key, so that a new one isn't answered by the old one's figures
            # and so are the versions of the data
            versions = tuple(self.api.lake.version(d) for d in ("bars_daily", "daily_cross"))
            key = (rest[1], json.dumps(asdict(found), sort_keys=True), start, end, horizon, layers, versions)
            if key not in self.tracked:
                panel = self.api.lake.cross()
                rows = lambda df: [plain(r.asDict()) for r in df.orderBy("trade_date", *[c for c in ("layer",) if c in df.columns]).collect()]
                if rest[1] == "coverage":
                    self.tracked[key] = {"coverage": rows(factors.coverage(panel, found, start, end))}
                else:
                    made = factors.track(panel, found, start, end, horizon, layers)
                    self.tracked[key] = {"ic": rows(made.ic), "layers": rows(made.layers), "coverage": rows(made.coverage), "stats": plain(made.stats.first().asDict())}
                while len(self.tracked) > TRACKED:
                    self.tracked.pop(next(iter(self.tracked)))
            return 200, self.tracked[key]
        return 200, asdict(found)

    def _backtests(self, method: str, rest: list[str], body: dict):
        if not rest and method == "GET":
            return 200, self.jobs.ledger.list()
        if not rest and method == "POST":
            config = Config(body["start"], body["end"], float(body.get("capital", 1_000_000)), tuple(body.get("universe") or ()), body.get("benchmark") or "", body.get("frequency") or "1d", tuple((body.get("params") or {}).items()))
            return 200, {"run_id": self.jobs.submit(body["strategy"], config, self.market(config), body.get("name") or "")}
        job = self.jobs.ledger.get(rest[0])
        if job is None:
            return 404, {"code": 40401, "msg": f"no run {rest[0]}", "data": None}
        return 200, self.jobs.result(rest[0]) if rest[1:] == ["result"] else job


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't started yet; an error in a path is told as JSON, a body that is too large is refused."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if size > BODY_MOST:
                    return self._send(413, {"code": 41301, "msg": "the body is too large", "data": None})
                body = json.loads(self.rfile.read(size) or b"{}")
                status, value = service.answer(method, self.path, body, self.headers.get("X-Token") or "")
            except ValueError as e:
                status, value = 400, {"code": 40001, "msg": f"the body isn't JSON: {e}", "data": None}
            except Exception as e:  # noqa: BLE001  one request's error doesn't end the server
                status, value = 500, {"code": 50001, "msg": f"{type(e).__name__}: {e}"[:500], "data": None}
            self._send(status, value)

        def _send(self, status: int, value) -> None:
            raw = json.dumps(plain(value), ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self):  # noqa: N802
            self._reply("GET")

        def do_POST(self):  # noqa: N802
            self._reply("POST")

        def do_DELETE(self):  # noqa: N802
            self._reply("DELETE")

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
