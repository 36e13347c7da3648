"""``python -m logweave.cli merge|sort --output <path> <input>...``

Exit codes: 0 done, 1 contract or I/O failure, 2 usage.
"""

from __future__ import annotations

import sys


class UsageError(Exception):
    """``str(error)`` is the reason line, empty when the usage line says it all."""


def parse_arguments(args: list[str]) -> tuple[str, list[str]]:
    """(output, inputs): the flag may stand anywhere, the last one wins, and unknown flags are inputs."""
    output, inputs, rest = None, [], iter(args)
    for arg in rest:
        if arg == "--output":
            output = next(rest, None)
            if output is None:
                raise UsageError
        else:
            inputs.append(arg)
    if output is None or not inputs:
        raise UsageError
    if output in inputs:
        raise UsageError(f"output {output} is also an input")
    return output, inputs


def main(args: list[str], spark=None) -> int:
    from py4j.protocol import Py4JError
    from pyspark.errors import PySparkException

    from logweave.operators.ordering import LogOrderError, merge_files, sort_files

    commands = {"merge": merge_files, "sort": sort_files}
    name = args[0] if args else ""
    program = f"logweave {name}".strip()
    try:
        if name not in commands:
            raise UsageError
        output, inputs = parse_arguments(args[1:])
    except UsageError as e:
        if str(e):
            print(f"{program}: {e}", file=sys.stderr)
        print(f"usage: logweave {name if name in commands else 'merge|sort'} --output <path> <input>...", file=sys.stderr)
        return 2
    if spark is None:
        from logweave.plans.session import new_session

        spark = new_session("logweave")
    try:
        commands[name](spark, inputs, output)
    except (LogOrderError, OSError, PySparkException, Py4JError, ValueError) as e:
        print(f"{program}: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
