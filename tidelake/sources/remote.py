"""Remote sources of market data: pages of untyped rows, from HTTP services or commands, with fallbacks.

A source's call() returns a Page. ``CallSource`` exposes calls to Spark as a Python data source: a partition for each
call, so that windows are fetched by executors in parallel.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Page:
    fields: list[str]
    items: list[list]
    count: int = 0
    has_more: bool = False
    limit: int = 0
    meta: dict = field(default_factory=dict)


class SourceError(RuntimeError):
    """``kind``: fatal (don't try again), halve (ask for less), or transient."""

    def __init__(self, message: str, kind: str = "transient"):
        super().__init__(message)
        self.kind = kind


#: Words by which a service says that it was asked for too much; a source's own are added to them.
TOO_MUCH = ("exceeds the limit", "too large", "upstream_pool_exhausted", "response estimate")


def kind_of(status: int, text: str, hints: tuple[str, ...] = TOO_MUCH) -> str:
    """halve: 400 or 503 with a hint; transient: 429 and 5xx; all others are fatal, errors in a response with 200 too."""
    if status in (400, 503) and any(h.lower() in text.lower() for h in hints):
        return "halve"
    return "transient" if status == 429 or status >= 500 else "fatal"


def envelope(body: bytes | str) -> Page:
    """A response of one of four shapes: {code, msg, detail, data: {fields, items}}, {ok, error, message, data}, {data: [objects]}, or {fields, items}."""
    try:
        raw = json.loads(body)
    except ValueError as e:
        raise SourceError("the response isn't JSON", "fatal") from e
    top = raw if isinstance(raw, dict) else {}
    if top.get("ok") is False:
        told = [str(top[k]) for k in ("error", "message") if top.get(k)]
        raise SourceError(": ".join(told) or "the service refused", "fatal")
    if top.get("code") not in (None, 0, 200):
        told = [str(top[k]) for k in ("msg", "detail") if top.get(k)] or [str(top.get("message") or top["code"])]
        raise SourceError(" ".join(told), "fatal")
    data = raw.get("data", raw) if isinstance(raw, dict) else raw
    if isinstance(data, list):
        names = list(dict.fromkeys(k for r in data for k in r))
        page = Page(names, [[r.get(n) for n in names] for r in data])
    elif isinstance(data, dict) and "fields" in data:
        page = Page(list(data["fields"]), [list(i) for i in data.get("items") or []])
    else:
        raise SourceError("the response has none of the known shapes", "fatal")
    more = data if isinstance(data, dict) else {}
    page.count = int(more.get("count") or top.get("count") or 0)
    told = more.get("has_more", top.get("has_more"))
    page.has_more = bool(told) if told is not None else 0 < len(page.items) < page.count
    page.meta = more.get("meta") or top.get("meta") or {}
    if page.meta.get("probe") or page.meta.get("sample"):
        raise SourceError("the service sent a sample, not the data", "fatal")
    return page


def complete(page: Page, limit: int = 0) -> Page:
    """The page, unless rows are missing: it counts more than it has, or has as many as the limit allows."""
    limit = limit or page.limit
    if page.count > len(page.items):
        raise SourceError(f"{page.count} rows counted, {len(page.items)} sent", "halve")
    if page.has_more or (limit and len(page.items) >= limit):
        raise SourceError(f"{len(page.items)} rows reach the limit", "halve")
    return page


def expanded(text: str) -> str:
    """${NAME} from the environment; unset names become empty."""
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), text)


@dataclass
class Http:
    """POST (JSON) or GET (query) calls; names of queries can be mapped; a token goes into the body or a header."""

    url: str
    method: str = "POST"
    token: str = ""
    names: dict[str, str] = field(default_factory=dict)
    header: str = ""
    limit: int = 0
    least: int = 100
    tries: int = 3
    pause: float = 0.5
    hints: tuple[str, ...] = ()
    transport: Callable | None = None

    def call(self, api: str, params: dict | None = None, fields: str = "") -> Page:
        """Tries again: with the same limit first; if the service wants less a second time, with half of it, and so on. Pauses grow."""
        limit, same = self.limit, 0
        for turn in range(self.tries):
            try:
                asked = dict(params or {}) | ({"limit": limit} if limit else {})
                page = self._page(*self._send(self.names.get(api, api), asked, fields))
                page.limit = limit
                return page
            except SourceError as e:
                if e.kind == "fatal" or turn + 1 == self.tries:
                    raise
                if e.kind == "halve":
                    same += 1
                    if same > 1 and limit > self.least:
                        limit, same = max(self.least, limit // 2), 0
                time.sleep(min(20.0, self.pause * (turn + 1)))
        raise SourceError("no tries left")

    def _page(self, status: int, body: bytes | str) -> Page:
        try:
            return envelope(body)
        except SourceError as e:
            text = body if isinstance(body, str) else body.decode(errors="replace")
            raise SourceError(str(e), kind_of(status, f"{e} {text[:400]}", (*TOO_MUCH, *self.hints))) from e

    def _send(self, api: str, params: dict, fields: str) -> tuple[int, bytes]:
        """(status, body) of a response, whatever its status; a transport that gives a body alone means 200."""
        token, headers = expanded(self.token), {"Content-Type": "application/json"}
        body = {"api_name": api, "params": params, "fields": fields} | ({"token": token} if token and not self.header else {})
        if self.header and token:
            headers[self.header] = token
        url = self.url if self.method == "POST" else f"{self.url}/{api}?{urllib.parse.urlencode(params | {'fields': fields})}"
        if self.transport:
            answer = self.transport(self.method, url, headers, body)
            return answer if isinstance(answer, tuple) else (200, answer)
        request = urllib.request.Request(url, json.dumps(body).encode() if self.method == "POST" else None, headers, method=self.method)
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()
        except OSError as e:
            raise SourceError(str(e), "transient") from e


@dataclass
class Command:
    """A program that reads a call as JSON and writes a page as JSON."""

    argv: list[str]
    timeout: float = 120.0

    def call(self, api: str, params: dict | None = None, fields: str = "") -> Page:
        sent = json.dumps({"api_name": api, "params": params or {}, "fields": fields})
        try:
            done = subprocess.run([expanded(a) for a in self.argv], input=sent, capture_output=True, text=True, timeout=self.timeout)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise SourceError(str(e)) from e
        if done.returncode:
            raise SourceError(done.stderr.strip()[:500] or f"exit {done.returncode}")
        return envelope(done.stdout)

    def check(self) -> bool:
        from shutil import which

        return which(expanded(self.argv[0])) is not None


@dataclass
class Fallback:
    """For each call the first member that succeeds."""

    members: list

    def call(self, api: str, params: dict | None = None, fields: str = "") -> Page:
        errors = []
        for m in self.members:
            try:
                return m.call(api, params, fields)
            except SourceError as e:
                errors.append(str(e))
        raise SourceError("; ".join(errors) or "no source", "fatal")


KINDS: dict[str, Callable[[dict], object]] = {
    "http": lambda c: Http(**{k: v for k, v in c.items() if k in Http.__dataclass_fields__}),
    "exec": lambda c: Command(c["argv"], float(c.get("timeout", 120))),
}


def register_kind(name: str, make: Callable[[dict], object]) -> None:
    KINDS[name] = make


class Sources:
    """Configured sources, and which of them serve a dataset. Disabled or broken ones are left out."""

    def __init__(self, config: dict):
        self.made, self.broken, self.bindings = {}, {}, config.get("bindings") or {}
        for name, c in (config.get("sources") or {}).items():
            if c.get("enabled", True):
                try:
                    self.made[name] = KINDS[c["kind"]](c)
                except Exception as e:  # noqa: BLE001  one bad entry doesn't take the others with it
                    self.broken[name] = str(e)

    def get(self, name: str):
        return self.made[name]

    def resolve(self, dataset: str):
        names = self.bindings.get(dataset) or self.bindings.get("default") or list(self.made)
        members = [self.made[n] for n in names if n in self.made]
        if not members:
            raise SourceError(f"no source for {dataset}", "fatal")
        return members[0] if len(members) == 1 else Fallback(members)


@dataclass
class _Call(InputPartition):
    params: dict


class CallSource(DataSource):
    """Spark's view of a source: options ``source`` (JSON with kind), ``api``, ``fields`` and ``calls`` (a JSON list of parameters)."""

    @classmethod
    def name(cls) -> str:
        return "market_calls"

    def schema(self) -> str:
        return ", ".join(f"`{f}` string" for f in [*self.options["fields"].split(","), "_call"])

    def reader(self, schema) -> DataSourceReader:
        return _CallReader(dict(self.options))


class _CallReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Call(p) for p in json.loads(self.options["calls"])]

    def read(self, partition):
        config, names = json.loads(self.options["source"]), self.options["fields"].split(",")
        page = complete(KINDS[config["kind"]](config).call(self.options["api"], partition.params, self.options["fields"]))
        at = [page.fields.index(n) if n in page.fields else None for n in names]
        label = json.dumps(partition.params, sort_keys=True)
        for item in page.items:
            yield (*[None if i is None or item[i] is None else str(item[i]) for i in at], label)
