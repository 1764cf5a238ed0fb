"""Seeded bars with gaps, a flat run, zero and missing volume."""

import math
import random
from datetime import datetime, timedelta

SCHEMA = "symbol string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(spark, n=480, seed=5, symbols=("A",), holes=True):
    rows = []
    for s in symbols:
        rnd, price = random.Random(f"{seed}{s}"), 100.0
        for i in range(n):
            price *= math.exp(rnd.gauss(0.0002, 0.01))
            close, volume = price, rnd.lognormvariate(3, 0.5)
            if holes:
                close = None if 100 <= i < 104 else 123.0 if 200 <= i < 208 else close
                volume = 0.0 if 300 <= i < 306 else None if i == 350 else volume
            rows.append((s, datetime(2020, 1, 1) + timedelta(hours=i), price, price * 1.002, price * 0.998, close, volume))
    return spark.createDataFrame(rows, SCHEMA)


def series(spark, closes, field="close"):
    rows = [
        ("A", datetime(2020, 1, 1) + timedelta(hours=i), None, None, None, c if field == "close" else None, c if field == "volume" else None) for i,
        c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, SCHEMA)
