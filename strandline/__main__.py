"""python -m strandline version | info | list | run QUERY FOLDER | test"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

import strandline
from strandline.plans import data_queries, modes, series_queries


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str]) -> int:
    command = args[0] if args else "help"
    known = series_queries.QUERIES | data_queries.QUERIES
    if command == "version":
        print(strandline.__version__)
    elif command == "list":
        print("\n".join(known))
    elif command == "info":
        for k, v in modes.build_features(_session()).items():
            print(f"{k}: {v}")
    elif command == "run" and len(args) == 3 and args[1] in known:
        known[args[1]](_session(), args[2]).show(20, truncate=False)
    elif command == "test":
        from strandline.operators.reduce import reduce_series
        from strandline.sources.tables import series_from

        row = reduce_series(series_from(_session(), [1, 2, 3, 4, 5]), "x", ["sum", "mean", "min", "max", "var"]).collect()[0]
        ok = tuple(row) == (15.0, 3.0, 1.0, 5.0, 2.0)
        print("ok" if ok else f"wrong: {row}")
        return int(not ok)
    else:
        print(__doc__)
        return int(command != "help")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
