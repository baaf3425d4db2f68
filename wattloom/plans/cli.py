"""Command line: run, compare, sweep and fetch."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from ..session import build_session
from ..sources.grid_api import fetch_signal, read_token
from ..sources.jobs import load_jobs
from ..sources.signal_cache import load_signal, save_signal
from ..sources.sinks import console_table, default_name, summary_lines, sweep_rows, write_metrics, write_records, write_sweep
from . import experiments


def instant(text: str) -> datetime:
    """An ISO instant; without a zone it means UTC."""
    when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return when.replace(tzinfo=timezone.utc) if when.tzinfo is None else when.astimezone(timezone.utc)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wattloom")
    kinds = top.add_subparsers(dest="command", required=True)
    for name in ("run", "compare", "sweep"):
        p = kinds.add_parser(name)
        p.add_argument("workload")
        p.add_argument("signal")
        p.add_argument("--limit", type=int)
        p.add_argument("--released-from", type=instant)
        p.add_argument("--released-before", type=instant)
        p.add_argument("--nodes", type=int, default=experiments.DEFAULT_NODES)
        p.add_argument("--estimate", choices=("time_limit", "scheduling"))
        p.add_argument("--output")
        if name == "run":
            p.add_argument("--policy", choices=("fcfs", "easy", "power-cap", "carbon-aware"), default="fcfs")
            p.add_argument("--window", type=int)
            p.add_argument("--cap-mw", type=float)
            p.add_argument("--delay-hours", type=float)
            p.add_argument("--grid-minutes", type=int, default=15)
        if name == "compare":
            p.add_argument("--cap-mw", type=float)
            p.add_argument("--cap-fraction", type=float, default=experiments.CAP_FRACTION)
            p.add_argument("--no-replay", action="store_true")
        if name == "sweep":
            p.add_argument("--delay-hours", type=float, nargs="+", default=list(experiments.DELAY_HOURS))
            p.add_argument("--grid-minutes", type=int, nargs="+", default=[15])
    p = kinds.add_parser("fetch")
    for name, kind in (("--url", str), ("--zone", str), ("--start", instant), ("--end", instant)):
        p.add_argument(name, type=kind, required=True)
    p.add_argument("--factor", choices=("lifecycle", "direct"), default="lifecycle")
    p.add_argument("--no-estimates", action="store_true")
    p.add_argument("--env-file", default=".env")
    p.add_argument("--token-name", default="GRID_API_TOKEN")
    p.add_argument("--output")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session("wattloom")
    if args.command == "fetch":
        us = lambda t: int(t.timestamp()) * 1_000_000 + t.microsecond
        got = fetch_signal(spark, url=args.url, zone=args.zone, start_us=us(args.start), end_us=us(args.end), factor=args.factor, include_estimated=not args.no_estimates, token=read_token(args.env_file, args.token_name))
        print(save_signal(got, args.output or default_name("signal", args.zone) + ".json", 900_000_000, {"zone": args.zone, "unit": "gCO2eq/kWh", "gap_policy": "error"}))
        return 0
    jobs = load_jobs(spark, args.workload, args.limit, args.released_from, args.released_before)
    signal, _, _ = load_signal(spark, args.signal)
    if args.command == "run":
        row = experiments.scenario(args.policy, args.policy, args.nodes, args.estimate, args.window, None if args.cap_mw is None else args.cap_mw * 1e6,
                                   None if args.delay_hours is None else int(args.delay_hours * experiments.HOUR_US), args.grid_minutes * 60_000_000)
        done, metrics = experiments.single_run(jobs, signal, row)
        print("\n".join(summary_lines(metrics)))
        print(write_records(done, args.output or default_name(args.policy, done.count(), args.nodes) + ".parquet"))
    elif args.command == "compare":
        metrics = experiments.compare_baselines(jobs, signal, args.nodes, args.estimate or "time_limit", args.cap_fraction, None if args.cap_mw is None else args.cap_mw * 1e6, not args.no_replay)
        console_table(metrics).show(50, False)
        print(write_metrics(metrics, args.output or default_name("comparison", args.nodes) + ".csv"))
    else:
        points = experiments.carbon_sweep(jobs, signal, args.nodes, args.delay_hours, [m * 60_000_000 for m in args.grid_minutes], args.estimate or "scheduling")
        sweep_rows(points).show(100, False)
        print(write_sweep(points, args.output or default_name("sweep", args.nodes) + ".csv"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
