"""Command line: run a configuration, or show its plan."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from loomsift import __version__
from loomsift.plans.runner import Runner, RunConfig, described


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loomsift", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    commands = p.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a YAML configuration")
    run.add_argument("config", type=Path)
    run.add_argument("-o", "--output-dir", type=Path)
    run.add_argument("--dry-run", action="store_true", help="show the plan only")
    run.add_argument("--reset-index", action="store_true", help="forget the embedding index of earlier runs")
    run.add_argument("--single-file", action="store_true", help="join each output to one file, instead of a folder of parts")
    run.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    changes = {"output_dir": str(args.output_dir)} if args.output_dir else {}
    if args.reset_index:
        changes["embedding_reset_index"] = True
    if args.single_file:
        changes["single_file"] = True
    try:
        config = RunConfig.from_yaml(args.config, **changes)
        if args.dry_run:
            print("\n".join(f"{i}. {line}" for i, line in enumerate(described(config), 1)))
            return 0
        result = Runner(config).run()
    except (OSError, ValueError) as e:
        print(f"loomsift: {e}", file=sys.stderr)
        return 2
    print(json.dumps({"stage_counts": result.stage_counts, "rejected": result.manifest["rejected_breakdown"]}, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
