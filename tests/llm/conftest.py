import re

import pytest

NOTES = "tile_id long, notes string, source_file string, score string, _row string"


@pytest.fixture(scope="session")
def feedback(spark):
    """Builds feedback rows; two columns besides have names that operators might use themselves."""
    def make(*rows):
        return spark.createDataFrame([(t, n, s, "x", "y") for t, n, s in rows], NOTES)
    return make


def words(n, seed=0):
    """n different words."""
    return [f"w{seed}x{i:04d}" for i in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, one very long text, repeated rows."""
    long_text = " ".join(words(60_000))
    return [(1, None, None), (2, "", "a"), (3, " \t\n ", "a"), (None, "null id " * 9, None), (None, None, "b"), (4, long_text, "a"), (4, long_text, "a"),
            (5, "same text here", "b"), (5, "same text here", "b"), (6, "same text here", None)]


def broadcast_steps(df):
    """The steps below each broadcast of the plan that Spark makes of ``df`` before it runs."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depths = [len(re.match(r"[\s:+-]*", line)[0]) for line in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depths[j] <= depths[i]), len(lines))
            out.append("\n".join(lines[i + 1:end]))
    return out
