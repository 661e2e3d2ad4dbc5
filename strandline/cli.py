"""Command line: `python -m strandline.cli NAME --data DIR [--out DIR] [--freeze YEAR] ...` runs a registered query with its parameters."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from .session import local_session


def _years(text: str) -> tuple[int, ...]:
    return tuple(sorted(int(y) for y in text.split(",")))


#: Parameters that a run may change: names in plans.settings, which plans read when they are run.
PARAMETERS = {"freeze": int, "cutoff": int, "horizon": int, "self_cutoff": int, "cutoffs": _years}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandline", description="Runs a registered query over a folder of tables.")
    p.add_argument("name")
    p.add_argument("--data", required=True, help="folder of the tables")
    p.add_argument("--out", help="where the result goes as Parquet; shown if not given")
    p.add_argument("--cores", default="*")
    for name, kind in PARAMETERS.items():
        p.add_argument(f"--{name.replace('_', '-')}", type=kind)
    return p


def main(argv: Sequence[str] | None = None) -> int:
    from .plans import catalogue, settings

    args = parser().parse_args(argv)
    for name in PARAMETERS:
        if getattr(args, name) is not None:
            setattr(settings, name.upper(), getattr(args, name))
    known = catalogue.queries()
    if args.name not in known:
        raise SystemExit(f"unknown query {args.name}; known: {', '.join(sorted(known))}")
    spark = local_session("cli", args.cores)
    out = known[args.name](spark, args.data)
    if args.out:
        out.write.mode("errorifexists").parquet(args.out)
    else:
        out.show(50, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
