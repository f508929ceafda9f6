import random
from collections import defaultdict

from orthomill.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars=40, min_tiles=5):
    """(tile, lines, dropped, text) of every row, worked out from dictionaries."""
    tiles = defaultdict(set)
    for tile, text in rows:
        for line in (text or "").split("\n"):
            if len(key := low(line.strip(SPACE))) >= min_chars:
                tiles[key].add(tile)
    keeper = {k: max(t for t in ts if t is not None) for k, ts in tiles.items() if len(ts) >= min_tiles}
    out = []
    for tile, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if low(x.strip(SPACE)) not in keeper or keeper[low(x.strip(SPACE))] == tile]
        out.append((str(tile), len(lines), len(lines) - len(stay), text if len(stay) == len(lines) else "\n".join(stay)))
    return sorted(out, key=str)


def got(df):
    return sorted(((str(r.tile_id), r.n_lines, r.n_dropped, r.notes) for r in df.collect()), key=str)


def sample(seed):
    rng = random.Random(seed)
    common = [f"{'Shared' if i % 2 else 'SHARED'} boilerplate line number {i:03d} ünd mehr Text" for i in range(30)]
    rows = []
    for tile in range(60):
        lines = []
        for _ in range(rng.choice([1, 5, 70, 200])):
            pick = rng.random()
            line = rng.choice(common) if pick < 0.5 else "short" if pick < 0.6 else f"own line {tile} {rng.random()} with enough characters"
            lines.append(rng.choice(["", " ", "\t\x0b"]) + (line.upper() if rng.random() < 0.2 else line) + rng.choice(["", "  \r", " \x0c"]))
        rows.append((tile, "\n".join(lines)))
    return rows + rows[:3] + [(None, rows[0][1]), (None, rows[1][1])]


def test_equals_brute_force(feedback):
    rows = sample(1)
    df = feedback(*[(t, x, "a") for t, x in rows])
    assert got(line_dedup.without_shared_lines(df)) == brute(rows)
    assert line_dedup.without_shared_lines(df).columns == [*df.columns, "n_lines", "n_dropped"]


def test_lines_dealt_over_streams_give_the_same(feedback, monkeypatch):
    rows = sample(2)
    monkeypatch.setattr(line_dedup, "STREAM_ROWS", 7)
    assert got(line_dedup.without_shared_lines(feedback(*[(t, x, "a") for t, x in rows]))) == brute(rows)


def test_lengths_counts_and_largest_tile(feedback):
    at, under = "x" * 40, "y" * 39
    rows = [(i, f"{at}\n{under}\n\n{at.upper()}") for i in range(1, 6)] + [(i, "z" * 50) for i in range(6, 10)]
    assert [(r[0], r[2], r[3]) for r in got(line_dedup.without_shared_lines(feedback(*[(t, x, "a") for t, x in rows])))] == \
        [(str(i), 2, f"{under}\n") for i in range(1, 5)] + [("5", 0, rows[4][1])] + [(str(i), 0, "z" * 50) for i in range(6, 10)]


def test_bitmaps_name_only_words_with_drops(feedback):
    line = "a line that stands in five notes, with enough of it"
    rows = [(i, "\n".join([line if j in (3, 130) else f"{i} {j}" for j in range(200)])) for i in range(5)]
    maps = line_dedup.keep_bitmaps(feedback(*[(t, x, "a") for t, x in rows])).collect()
    assert sorted(r.tile_id for r in maps) == [0, 1, 2, 3]
    assert all([(k.word, k.bits) for k in r.keep] == [(0, ~(1 << 3)), (2, ~(1 << 2))] for r in maps)


def test_odd_rows(feedback, odd_rows):
    df = feedback(*odd_rows)
    assert got(line_dedup.without_shared_lines(df)) == brute([(t, x) for t, x, _ in odd_rows])
    assert line_dedup.without_shared_lines(df.filter("false")).count() == 0
    clash = df.withColumn("n_lines", df["score"]).withColumn("hash", df["score"]).withColumn("_keep", df["score"])
    assert line_dedup.without_shared_lines(clash).count() == len(odd_rows)
    many = [(i, "q" * 45 + "\n" + "r" * 45 + ("" if i else "\n" * 3000)) for i in range(6)]
    assert got(line_dedup.without_shared_lines(feedback(*[(t, x, None) for t, x in many]))) == brute(many)
