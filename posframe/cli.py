"""python -m posframe.cli validate|inspect|dump|help FILE [START:END]

Exit codes: 0 in order, 1 the file breaks a rule, 2 usage, 3 the file can't be read.
"""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    from posframe import schema as S
    from posframe.operators import access

    if args[:1] in (["help"], ["--help"], ["-h"]):
        print(__doc__)
        return 0
    if len(args) < 2 or args[0] not in ("validate", "inspect", "dump") or len(args) > (3 if args[0] == "dump" else 2):
        print(__doc__, file=sys.stderr)
        return 2
    try:
        start, end = access.parse_range(args[2]) if len(args) == 3 else (0, 5)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from posframe.sources import container

    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    try:
        own = container.Container(args[1])
        if args[0] == "dump" and start >= min(end, own.header["num_positions"]):
            print(f"empty range {start}:{end}", file=sys.stderr)
            return 2
        container.check(spark, args[1])
        container.check_metadata(own.metadata())
        if args[0] == "inspect":
            for r in container.inspect(spark, args[1]).toLocalIterator():
                print(f"{r.name}: {r.value}")
        elif args[0] == "dump":
            for r in access.dump(container.read(spark, args[1], "header"), start, end).toLocalIterator():
                print(r.line)
        else:
            print("OK", own.header["num_positions"], "positions,", own.header["num_blocks"], "blocks,", own.header["num_features_total"], "features,", len(own.metadata()), "metadata bytes")
    except (S.ParseError, S.ValidationError) as e:
        print(e, file=sys.stderr)
        return 1
    except OSError as e:
        print(e, file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
