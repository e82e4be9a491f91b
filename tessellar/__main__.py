"""python -m tessellar SAMPLES QUERY START END STEP: a range query over a Parquet table of samples, as JSON with its time and fingerprint."""

import json
import sys
import time

from pyspark.sql import SparkSession

from .api import fingerprint, result_json, step_ms, timestamp_ms
from .plans import engine
from .sources.store import Store


def main(path: str, query: str, start: str, end: str, step: str, repeats: str = "1") -> None:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark.read.parquet(path), typed=True)
    took = []
    for _ in range(int(repeats)):
        began = time.time()
        frame = engine.range_query(spark, store, query, timestamp_ms(start), timestamp_ms(end), step_ms(step)).persist()
        data = result_json(frame, "matrix")
        took.append(round(time.time() - began, 3))
        mark = fingerprint(frame)
        frame.unpersist()
    print(json.dumps({"seconds": took, "fingerprint": mark, "data": data}))


if __name__ == "__main__":
    main(*sys.argv[1:])
