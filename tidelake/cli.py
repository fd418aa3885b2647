"""The command line: python -m tidelake.cli --lake FOLDER COMMAND ...; results are JSON, a line each."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date
from pathlib import Path

from tidelake.functions import dates
from tidelake.operators.api import DataApi
from tidelake.operators.predicates import Predicate
from tidelake.registry import Registry, market
from tidelake.serve import plain
from tidelake.sources import ingest, remote
from tidelake.sources.lake import Lake


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelake", description=__doc__)
    p.add_argument("--lake", default="lake")
    p.add_argument("--registry", default="", help="a YAML or JSON file; the market's datasets without it")
    p.add_argument("--sources", default="", help="a JSON file of sources and bindings")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [sub.add_parser(name)] and [sub.choices[name].add_argument(*o[0], **o[1]) for o in options]
    opt = lambda *names, **kw: (names, kw)
    add("query", opt("name"), opt("--params", default="{}"), opt("--fields", default=""))
    add("scan", opt("dataset"), opt("--filter", action="append", default=[], help="field=value or field=a|b"), opt("--start", default=""), opt("--end", default=""), opt("--limit", type=int, default=100))
    add("compare", opt("dataset"), opt("--left", type=int, required=True), opt("--right", type=int, required=True), opt("--limit", type=int, default=1000))
    add("diagnose", opt("dataset"), opt("--filter", action="append", default=[]), opt("--start", default=""), opt("--end", default=""))
    add("import", opt("dataset"), opt("--start", default=""), opt("--end", default=""), opt("--replace", action="store_true"))
    add("source", opt("action", choices=("list", "check", "call")), opt("name", nargs="?", default=""), opt("--api", default=""), opt("--params", default="{}"), opt("--fields", default=""))
    add("dedupe", opt("dataset"), opt("--apply", action="store_true"))
    add("build-cross", opt("--years", default=""))
    for name in ("verify", "health", "summary"):
        add(name)
    add("reconcile", opt("dataset"))
    add("backtest", opt("--strategy", required=True), opt("--start", required=True), opt("--end", required=True), opt("--capital", type=float, default=1_000_000.0), opt("--universe", default=""), opt("--benchmark", default=""), opt("--warmup", type=int, default=365), opt("--out", default=""))
    add("serve", opt("--port", type=int, default=8000), opt("--tokens", default=""), opt("--factors", default="factors.json"), opt("--records", default="backtests"), opt("--most", type=int, default=2))
    return p


def predicates(lake: Lake, dataset: str, filters: list[str], start: str = "", end: str = "") -> list[Predicate]:
    """``field=value`` texts (values apart by ``|``) and a range of the time field as predicates."""
    d, out = lake.registry[dataset], []
    for text in filters:
        name, _, value = text.partition("=")
        if name not in d.names:
            raise KeyError(f"{dataset} has no field {name}")
        kind = d.type_of(name)
        read = {"date": dates.date_parameter, "timestamp": dates.datetime_parameter, "float64": float, "int64": int, "bool": lambda v: v.lower() == "true"}.get(kind, str)
        out.append(Predicate(name, "in", tuple(read(v.strip()) for v in value.split("|"))))
    if d.time_field:
        read = dates.datetime_parameter if d.type_of(d.time_field) == "timestamp" else dates.date_parameter
        out += [Predicate(d.time_field, op, read(v)) for op, v in ((">=", start), ("<=", end)) if v]
    return out


def market_from(lake: Lake, start: str, end: str, universe: list[str], warmup: int):
    """A daily backtest's market from the lake: bars, factors, actions, names and listings."""
    from datetime import timedelta

    from pyspark.sql import functions as F

    from tidelake.plans.backtest import market_of
    from tidelake.plans.broker import CorporateAction

    lo, hi = date.fromisoformat(start) - timedelta(days=warmup), date.fromisoformat(end)
    own = [Predicate("ts_code", "in", tuple(universe))] if universe else []
    span = lambda name: [Predicate(name, ">=", lo), Predicate(name, "<=", hi), *own]
    bars = lake.scan("bars_daily", span("trade_date"))
    facts = [c for c in bars.columns if c not in ("ts_code", "trade_date", "open", "high", "low", "close", "vol", "amount", "pre_close", "change")]
    shown = bars.select("ts_code", F.date_format("trade_date", "yyyy-MM-dd").alias("time"), "open", "high", "low", "close", (F.col("vol") * 100).alias("volume"), "amount", *facts)
    made = market_of(shown.toPandas())
    for r in lake.scan("adj_factor", own, ["ts_code", "trade_date", "adj_factor"], {"factor_type": ["hfq"]}).orderBy("trade_date").collect():
        made.factors.setdefault(r.ts_code, []).append((r.trade_date.isoformat(), r.adj_factor))
    for r in lake.scan("corporate_actions", span("ex_date")).collect():
        made.actions.setdefault(r.ex_date.isoformat(), []).append(CorporateAction(r.ts_code, r.allotted_ps or 0.0, r.rationed_ps or 0.0, r.rationed_px or 0.0, r.bonus_ps or 0.0))
    for r in lake.scan("stock_basic", own, ["ts_code", "name", "list_date", "delist_date"]).collect():
        made.names[r.ts_code] = r.name
        made.listed[r.ts_code] = (r.list_date and r.list_date.isoformat(), r.delist_date and r.delist_date.isoformat())
    return made


def run(args: argparse.Namespace, spark, say=print) -> int:
    """Runs a command; ``say`` gets each line."""
    tell = lambda x: say(json.dumps(plain(x), ensure_ascii=False, default=str))
    lake = Lake(spark, args.lake, Registry.load(args.registry) if args.registry else market())
    sources = remote.Sources(json.loads(Path(args.sources).read_text())) if args.sources else remote.Sources({})
    day = lambda t: dates.date_parameter(t) if t else None
    command = args.command
    if command == "query":
        tell(DataApi(lake).answer(args.name, json.loads(args.params), args.fields))
    elif command == "scan":
        for r in lake.scan(args.dataset, predicates(lake, args.dataset, args.filter, args.start, args.end), limit=args.limit).toLocalIterator():
            tell(r.asDict())
    elif command == "compare":
        for r in lake.compared(args.dataset, args.left, args.right).where("status <> 'same'").toLocalIterator():
            tell(r.asDict())
        for r in lake.changes(args.dataset, args.left, args.right).limit(args.limit).toLocalIterator():
            tell(r.asDict())
    elif command == "diagnose":
        for r in lake.scan_report(args.dataset, predicates(lake, args.dataset, args.filter, args.start, args.end)).orderBy("file").toLocalIterator():
            tell(r.asDict())
    elif command == "import":
        spec = ingest.imports(date.today().year)[args.dataset]
        for entry in ingest.Importer(lake, sources.resolve(args.dataset)).run(spec, day(args.start), day(args.end), args.replace):
            tell({k: entry[k] for k in ("dataset", "rows", "notes")})
    elif command == "source" and args.action == "list":
        for name, made in sources.made.items():
            tell({"name": name, "kind": type(made).__name__, "datasets": [d for d, names in sources.bindings.items() if name in names]})
        for name, why in sources.broken.items():
            tell({"name": name, "broken": why})
    elif command == "source":
        some = [args.name] if args.name else list(sources.made)
        for name in some:
            made = sources.get(name)
            try:
                if args.action == "check" and hasattr(made, "check") and not made.check():
                    raise remote.SourceError("it can't be run")
                page = made.call(args.api or "trade_cal", json.loads(args.params), args.fields) if args.action == "call" or args.api else None
                tell({"name": name, "ok": True} | ({"fields": page.fields, "items": page.items} if page and args.action == "call" else {}))
            except remote.SourceError as e:
                tell({"name": name, "ok": False, "error": str(e), "kind": e.kind})
    elif command == "dedupe":
        for r in lake.dedupe(args.dataset, args.apply).collect():
            tell(r.asDict())
    elif command == "build-cross":
        tell({k: v for k, v in lake.build_cross([y for y in args.years.split(",") if y] or None).items() if k in ("rows", "partitions")})
    elif command in ("verify", "summary"):
        for r in getattr(lake, command)().collect():
            tell(r.asDict())
    elif command == "health":
        for h in lake.health():
            tell(h)
        tell({"disk": lake.disk()})
    elif command == "reconcile":
        tell(lake.reconcile(args.dataset) or {"dataset": args.dataset, "rows": 0})
    elif command == "backtest":
        from tidelake.operators.analytics import lot_pairs
        from tidelake.plans.backtest import Config, simulate, strategy_of

        universe = [c for c in args.universe.split(",") if c]
        held = market_from(lake, args.start, args.end, sorted({*universe, *([args.benchmark] if args.benchmark and universe else [])}), args.warmup)
        codes = tuple(universe or sorted(set(held.series) - {args.benchmark}))
        done = simulate(strategy_of(Path(args.strategy).read_text()), Config(args.start, args.end, args.capital, codes, args.benchmark), held)
        gains = [sell - buy for _, buy, sell in lot_pairs((t["side"], t["amount"], t["price"]) for t in done.trades)]
        tell(done.summary | {"lots_won": sum(g > 0 for g in gains), "lots_lost": sum(g < 0 for g in gains)})
        if args.out:
            Path(args.out).write_text(json.dumps(plain({"nav": done.nav, "trades": done.trades, "orders": done.orders, "logs": done.logs, "summary": done.summary})))
    elif command == "serve":
        from tidelake.operators.factors import FactorRegistry
        from tidelake.plans.backtest import JobLedger, Jobs
        from tidelake.serve import Service, server

        made = lambda c: market_from(lake, c.start, c.end, list(c.universe), 365)
        service = Service(DataApi(lake, set(filter(None, args.tokens.split(",")))), FactorRegistry(args.factors), Jobs(JobLedger(args.records), args.most), made)
        server(service, port=args.port).serve_forever()
    return 0


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(args, spark)


if __name__ == "__main__":
    sys.exit(main())
