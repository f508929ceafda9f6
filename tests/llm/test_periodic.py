import hashlib
import random
import time
import zlib

import pytest

from orthomill.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    """Every maximal run, from all lags; of one stretch the smallest period stays."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(12, 2 * q):
                best.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def texts():
    rng = random.Random(7)
    for alphabet in (1, 2, 3, 5, 30):
        for n in (11, 12, 13, 24, 60, 150, 300):
            yield [rng.randrange(alphabet) for _ in range(n)]
    for _ in range(150):
        words = []
        while len(words) < rng.choice([40, 120, 250]):
            base = [rng.randrange(rng.choice([2, 4, 50])) for _ in range(rng.randrange(1, 40))]
            words += (base * rng.randrange(1, 9))[:rng.randrange(1, 200)]
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = 99
        yield words
    yield fibonacci(400)
    yield list("ab" * 100 + "c" + "ab" * 90 + "c" + "ab" * 100 + "c" + "ab" * 90)
    base = ["x"] * 30 + ["y"] + ["x"] * 30 + ["z"]
    yield base * 6


def test_equals_brute_force():
    for words in texts():
        assert periodic.runs_of(words) == brute_runs(words), words


def test_collapsed_keeps_first_periods():
    words = list("pq") + list("abc") * 5 + list("rs")
    assert "".join(periodic.collapsed(words, periodic.runs_of(words))) == "pqabcrs"
    assert periodic.collapsed(["a"], []) == ["a"]


@pytest.mark.parametrize("period", [1, 2, 7, 400, 90_000])
def test_long_texts_take_little_time(period):
    base = [f"w{i}" for i in range(period)]
    words = (base * (200_000 // period + 1))[:200_000]
    start = time.perf_counter()
    assert periodic.runs_of(words) == [(0, 200_000, period)]
    assert time.perf_counter() - start < 10
    assert len(periodic.runs_of(fibonacci(30_000))) > 1000


def planted(doc_id, text):
    """The text with the contract's repetition, in plain words."""
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_query_equals_brute_force_on_documents(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = planted(r.doc_id, r.text)
        runs = brute_runs(words) if len(words) < 3000 else periodic.runs_of(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
        want[r.doc_id] = (
            len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    got = queries.QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in got} == want
    assert sum(w[0] > 0 for w in want.values()) > 10


def test_odd_rows(feedback, odd_rows):
    df = feedback(*odd_rows, (8, "la " * 30, "s"), (8, "la " * 30, "s"), (9, "A a " * 6 + "\x1c b", None))
    got = periodic.periodic_runs(df).collect()
    by = {r.tile_id: ([tuple(x) for x in r.runs], r.notes) for r in got}
    assert by[8] == ([(0, 30, 1)], "la") and by[9] == ([(0, 12, 2)], "A a \x1c b") and by[2] == ([], "") and by[3] == ([], "")
    assert len(got) == len(odd_rows) + 3 and {r.n_words for r in got if r.tile_id == 1} == {0}
    assert periodic.periodic_runs(df.filter("false")).count() == 0
