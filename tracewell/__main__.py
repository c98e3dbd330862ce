"""The tools from a shell: ``python -m tracewell TOOL ...`` prints the result as JSON."""

from __future__ import annotations

import argparse
import json
import sys

from . import logs

#: Tools with their positional arguments.
TOOLS = {
    "check-index-status": ("directory",),
    "get-index-stats": ("directory",),
    "index-codebase": ("directory",),
    "search-code": ("query", "search_type", "directory"),
    "search-docs": ("query", "directory"),
    "search-history": ("query", "search_type", "directory"),
    "find-dead-code": ("directory",),
}
_OPTIONS = {
    "search-code": (("--top-k", {"type": int}), ("--offset", {"type": int, "default": 0})),
    "search-docs": (("--top-k", {"type": int}), ("--include-context", {"action": "store_true"})),
    "search-history": (("--target-file", {}), ("--line-start", {"type": int}), ("--line-end", {"type": int}), ("--max-results", {"type": int, "default": 20}), ("--offset", {"type": int, "default": 0})),
    "find-dead-code": (("--min-confidence", {"type": float, "default": 0.5}), ("--kinds", {"nargs": "+"}), ("--include-tests", {"action": "store_true"}), ("--top-k", {"type": int})),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracewell", description="Index and question a source tree with Spark.")
    top.add_argument("--cores", default="*", help="cores of the local session")
    top.add_argument("--index-root", help="folder of the index; inside the project by default")
    top.add_argument("--log-level", help="DEBUG, INFO, WARNING or ERROR")
    tools = top.add_subparsers(dest="tool", required=True)
    for name, args in TOOLS.items():
        one = tools.add_parser(name)
        for a in args:
            one.add_argument(a)
        for flag, how in _OPTIONS.get(name, ()):
            one.add_argument(flag, **how)
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    logs.set_up(args.pop("log_level"))
    from .api import Engine
    from .session import local_session

    engine = Engine(local_session(args.pop("cores")), args.pop("index_root"))
    out = getattr(engine, args.pop("tool").replace("-", "_"))(**args)
    json.dump(out, sys.stdout, indent=2, default=str, ensure_ascii=False)
    print()
    return 1 if out.get("error") else 0


if __name__ == "__main__":
    sys.exit(main())
