"""python -m pelorus feature CSV | totals CSV... | clear FOLDER [PREFIX]"""

from __future__ import annotations

import json
import sys

from pelorus.session import session


def main(args: list[str]) -> int:
    """Print a waypoint file's feature or the length of tracks, or clear a result cache. Exit code 2: wrong call, 1: failed."""
    if len(args) < 2 or args[0] not in ("feature", "totals", "clear"):
        print(__doc__)
        return 2
    from pyspark.sql import functions as F

    from pelorus.operators import paths
    from pelorus.sources import files

    spark = session("pelorus", "local[*]")
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if args[0] == "feature":
            print(json.dumps(json.loads(files.linestring_feature(files.read_waypoints(spark, args[1])).toJSON().first()), indent=2))
        elif args[0] == "totals":
            for name in args[1:]:
                row = paths.totals(files.read_waypoints(spark, name).withColumn("route_id", F.lit(0))).first()
                print(f"{name}: {row['nm']:.6f} nm in {row['legs']} legs")
        else:
            print(f"{files.ResultCache(spark, args[1]).clear(args[2] if len(args) > 2 else '')} results deleted")
    except Exception as e:
        print(f"failed: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
