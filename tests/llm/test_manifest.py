import hashlib

import pytest
from pyspark.sql import functions as F

from orthomill.llm import manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """All levels of one tree, three neighbours to a digest."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i:i + 3]) for i in range(0, len(last), 3)])
    return levels


def climb(levels, at, value):
    """(folded value, siblings' hex) from one leaf to the top of its tree."""
    proof = ""
    for level in levels[:-1]:
        first = at // 3 * 3
        left, right = "".join(level[first:at]), "".join(level[at + 1:first + 3])
        proof, value, at = proof + left + right, digest(left, value, right), at // 3
    return value, proof


def brute(rows, found):
    """Sorted (tile, leaf, subroot, root, proof, folded, verified) of rows ``(tile, source, notes)``."""
    by_source = {}
    for tile, source, notes in rows:
        leaf = digest(field(tile), field(source), field(notes))
        seen = digest(field(tile), field(source), field(found(tile, notes)))
        by_source.setdefault(source, []).append((tile is not None, tile or 0, leaf, seen, tile))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda x: x[:4])
        trees[s] = tree([x[2] for x in by_source[s]])
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for at, (_, _, leaf, seen, tile) in enumerate(by_source[s]):
            value, low = climb(trees[s], at, seen)
            value, high = climb(top, i, value)
            out.append((str(tile), leaf, trees[s][-1][0], top[-1][0], digest(low + high), value, value == top[-1][0]))
    return sorted(out)


def got(df, found=None):
    built = manifest.build(df, ("tile_id", "source_file", "notes"), {"notes": found} if found is not None else None)
    return sorted((str(r.tile_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in manifest.audit(built).collect())


def cut(tile, notes):
    return notes.replace("\n", "") if notes is not None and tile is not None and tile % 2 == 0 else notes


@pytest.mark.parametrize("climbers", [50_000, 100])
def test_equals_brute_force_over_several_tiers(feedback, monkeypatch, climbers):
    monkeypatch.setattr(manifest, "CLIMBERS", climbers)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "é": 81, "f": 82, "g": 760, None: 7}
    rows, tile = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((tile * 7 % 1019, source, f"note {tile}\nline" if tile % 3 else None))
            tile += 1
    df = feedback(*[(t, n, s) for t, s, n in rows]).repartition(7)
    tampered = F.when(F.col("tile_id") % 2 == 0, F.replace("notes", F.lit("\n"), F.lit(""))).otherwise(F.col("notes"))
    want = brute(rows, cut)
    assert got(df, tampered) == want
    assert {r[-1] for r in want} == {True, False}


def test_many_sources_make_a_deep_top_tree(feedback):
    rows = [(i, f"s{i % 100:03d}", f"text {i}") for i in range(250)]
    assert got(feedback(*[(t, n, s) for t, s, n in rows])) == brute(rows, lambda t, n: n)


def test_a_lone_row_is_its_own_root(feedback):
    rows = [(5, "s", "alone")]
    (row,) = got(feedback((5, "alone", "s")))
    assert [row] == brute(rows, lambda t, n: n) and row[1] == row[2] == row[3] == row[5] and row[4] == digest("")


def test_any_change_shows(feedback):
    df = feedback(*[(i, f"text {i}", "s") for i in range(20)])
    for other in (F.concat("notes", F.lit(" ")), F.lit(None).cast("string"), F.lit("")):
        seen = F.when(F.col("tile_id") == 11, other).otherwise(F.col("notes"))
        assert [r[0] for r in got(df, seen) if not r[-1]] == ["11"]


def test_odd_rows(feedback, odd_rows):
    df = feedback(*odd_rows)
    assert got(df) == brute([(t, s, n) for t, n, s in odd_rows], lambda t, n: n)
    assert got(df.filter("false")) == []
    clash = df.withColumns({c: F.col("score") for c in ("place", "grp", "at", "digest", "share", "n")})
    assert len(got(clash)) == len(odd_rows)
