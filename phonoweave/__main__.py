"""python -m phonoweave TEXT [--mode --output --unknown --no-tone-sandhi --format]: one utterance, without a cluster."""

from __future__ import annotations

import argparse
import json
import sys

from phonoweave.operators.utterance import ConfigurationError, Converter, Options


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="phonoweave")
    parser.add_argument("text")
    parser.add_argument("--mode", default="mandarin")
    parser.add_argument("--backend")
    parser.add_argument("--fallback-backend")
    parser.add_argument("--output", default="native")
    parser.add_argument("--unknown", default="strict")
    parser.add_argument("--no-tone-sandhi", action="store_true")
    parser.add_argument("--format", choices=("text", "json"), default="text")
    a = parser.parse_args(arguments)
    try:
        converter = Converter(Options(mode=a.mode, output=a.output, unknown=a.unknown, tone_sandhi=not a.no_tone_sandhi, backend=a.backend, fallback=a.fallback_backend))
    except ConfigurationError as e:
        print(f"ConfigurationError: {e}", file=sys.stderr)
        return 2
    result = converter.result(a.text)
    if result.error:
        print(result.error, file=sys.stderr)
        return 1
    if a.format == "json":
        print(json.dumps(converter.convert(a.text), ensure_ascii=False))
    else:
        print("".join(line + "\n" for line in result.lines()), end="")
    for warning in result.warnings:
        print(f"warning: {warning}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
