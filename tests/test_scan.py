"""Running values by ranges against running values row by row."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lectern.operators.qa import log_warnings
from lectern.operators.scan import numbered, running


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(spark, inclusive):
    """One group of nearly all rows, a null group, groups that end within a range."""
    rng = random.Random(4)
    rows = [(rng.choice(["big"] * 20 + ["a", "b", None]), k, rng.choice([None, 1, 2, 5])) for k in range(800)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "g string, k int, v long").repartition(3)
    got = running(df, ["g"], ["k"], inclusive, total=("sum", F.col("v")), last=("max", F.when(F.col("v") == 5, F.struct("k", "v"))))
    want = []
    for g, own in groupby(sorted(rows, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
        total, last = 0, None
        for _, k, v in own:
            before = (total, last)
            total, last = total + (v or 0), (k, v) if v == 5 else last
            want.append((g, k, v, *((total, last) if inclusive else before)))
    assert sorted(((r["g"], r["k"], r["v"], r["total"], r["last"] and tuple(r["last"])) for r in got.collect()), key=str) == sorted(want, key=str)


def test_whole_table_is_one_group(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert sorted(tuple(r) for r in numbered(df, [], ["k"], 5).collect()) == [(k, k + 6) for k in range(1000)]
    assert numbered(df.where("false"), [], ["k"]).count() == 0


def plain_entries(lines):
    """Warnings of a log, line by line."""
    entries, open_ = [], None
    for n, line in sorted(lines):
        start = line.strip()
        if start.startswith(("[WARN]", "[ERROR]")):
            open_ = [n, [line]]
            entries.append(open_)
        elif start.startswith(("[INFO]", "INFO:", "ERROR:")):
            open_ = None
        elif open_:
            open_[1].append(line)
    return [(n, "\n".join(part).strip()) for n, part in entries]


def test_log_entries_over_ranges(spark):
    """Entries that go on over many lines and ranges; no window without a partition."""
    rng = random.Random(9)
    lines = [(k, rng.choice(["[WARN] w", " [ERROR] e", "[INFO] i", "  INFO: j", "ERROR: k"] + ["at x", "", " more"] * 9) + str(k % 10)) for k in range(3000)]
    df = spark.createDataFrame(rng.sample(lines, len(lines)), "line_no long, line string")
    out = log_warnings(df)
    assert sorted((r["first_line"], r["entry"]) for r in out.collect()) == plain_entries(lines)
    plan = out._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    two = df.select(F.lit("a").alias("log"), "*").unionByName(df.select(F.lit("b").alias("log"), "*"))
    assert log_warnings(two, by=("log",)).count() == 2 * out.count()
