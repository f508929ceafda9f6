import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from orthomill.llm import components, gam, simhash
from orthomill.llm.components import connected
from orthomill.llm.tables import stored
from tests.llm.conftest import broadcast_steps, words


def brute_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    counts = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b, n in enumerate(counts) if 2 * n > len(grams))


def brute_classes(prints, threshold=2):
    """Smallest member of each class of linked values."""
    root = {p: p for p in prints}
    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in values}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def test_fingerprints_equal_a_plain_count():
    rng = random.Random(1)
    texts = ["", " ", "A", "b B", "É é A\x0bb\x0cc\x1fd", " ".join(rng.choices("ab cd ef gh ij".split(), k=300))]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [brute_print(t) for t in texts] and simhash.fingerprint(None) == 0


def test_every_word_within_two_bits_reaches_the_home_anchor():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, 40, dtype=np.uint64)
    rows, home, is_home = simhash.anchors(prints, 0)
    assert rows.tolist() == list(range(40)) and is_home.all()
    for i in range(40):
        near = [prints[i] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in (0, 1, 2, 2, 2)]
        at, anchor, _ = simhash.anchors(np.array(near, np.uint64), 2)
        assert all(home[i] in anchor[at == k] for k in range(len(near)))


@pytest.mark.parametrize("crowd", [256, 3, 0])
def test_links_join_the_same_classes_as_all_pairs(spark, crowd):
    rng = random.Random(3)
    values = {0, 1, (1 << 64) - 1, (1 << 64) - 4}
    for centre in [rng.getrandbits(64) for _ in range(6)]:
        for _ in range(25):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                v ^= 1 << b
            values.add(v)
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    got = {r.node: r.root for r in connected(simhash.links(df, 2, crowd)).collect()}
    want = brute_classes(values)
    classes = {}
    for v in values:
        classes.setdefault(got.get(signed(v), signed(v)), set()).add(v)
    expected = {}
    for v, r in want.items():
        expected.setdefault(r, set()).add(v)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_what_reaches_the_anchors_is_not_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(300)]
    # As a written table it has a size: the planner takes the some 150 rows of each print for one.
    prints = stored(spark.createDataFrame([(signed(v),) for v in values + [values[0] ^ 5]], "fingerprint long"), "test-prints")
    sent = []
    monkeypatch.setattr(simhash, "stored", lambda df, name, *a: sent.extend(broadcast_steps(df)) or stored(df, name, *a))
    got = simhash.links(prints)
    assert {tuple(sorted((r.a, r.b))) for r in got.collect()} == {tuple(sorted(map(signed, (values[0], values[0] ^ 5))))}
    assert not [steps for steps in sent if "MapInArrow" in steps or "Generate" in steps]


def test_near_duplicate_notes_on_odd_rows(spark, feedback, odd_rows):
    got = simhash.near_duplicate_notes(feedback(*odd_rows))
    assert got.columns == ["tile_id", "fingerprint", "component_id"] and got.count() == len(odd_rows)
    class_of = {(r.tile_id, r.fingerprint): r.component_id for r in got.collect()}
    # Null, empty and blank notes share fingerprint 0; the null tile with a null note belongs to them as well.
    assert {class_of[k] for k in ((1, 0), (2, 0), (3, 0), (None, 0))} == {1}
    assert {c for (t, _), c in class_of.items() if t in (5, 6)} == {5}
    assert simhash.near_duplicate_notes(feedback(*odd_rows).filter("false")).count() == 0
    kept = simhash.keep_first(feedback(*odd_rows))
    assert kept.columns == feedback(*odd_rows).columns
    assert sorted(r.tile_id for r in kept.collect() if r.tile_id is not None) == [1, 4, 5]
    assert kept.filter("tile_id is null").count() == 2


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, i) for i in range(1000, 1200)]
    edges = spark.createDataFrame(chain + hub + [(3, 3), (7, 1000), (None, 5)], "a long, b long")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(1000, 1200)}


def test_stars_need_no_round_and_former_rounds_go(spark, monkeypatch):
    made, write = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name, *a: made.append((name, write(df, name, *a))) or made[-1][1])
    stars = [(i // 10 * 10, i) for i in range(100) if i % 10]
    got = {r.node: r.root for r in connected(spark.createDataFrame(stars + [(4, 4), (0, 1)], "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(100)} and [n for n, _ in made] == ["cc-edges"]
    made.clear()
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in connected(chain).collect()} == {0}
    folders = [table.inputFiles()[0].removeprefix("file://").rpartition("/")[0] for _, table in made]
    assert len(folders) > 3 and [os.path.exists(f) for f in folders] == [False] * (len(folders) - 1) + [True]
    assert connected(chain.limit(0)).count() == 0


def test_gam_learns_main_effects_and_a_pair():
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    plain, paired = gam.fit(x[:3000], y[:3000], "abcd", n_pairs=0), gam.fit(x[:3000], y[:3000], "abcd", n_pairs=3)
    accuracy = [((m.probability(x[3000:]) > 0.5) == y[3000:]).mean() for m in (plain, paired)]
    assert paired.pairs and (1, 2) in [p[:2] for p in paired.pairs] and accuracy[1] > accuracy[0] + 0.05
    again = gam.fit(x[:3000], y[:3000], "abcd", n_pairs=3)
    assert np.array_equal(again.probability(x), paired.probability(x))
    # The margin is the sum of its tables' entries.
    bins = paired.bins(x[:5])
    total = paired.intercept + sum(t[bins[:, j]] for j, t in enumerate(paired.tables)) + sum(
        t[ci[bins[:, i]], cj[bins[:, j]]] for i, j, ci, cj, t in paired.pairs)
    assert np.allclose(total, paired.margin(x[:5]))


def test_fusion_records_are_scored_by_their_own_features(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), float(b), float(a > 0.5)) for i, (a, b) in enumerate(rng.uniform(0, 1, (600, 2)))] + [(999, None, float("nan"), None)]
    records = spark.createDataFrame(rows, "tile_id long, mask_area double, z_mean double, gt_has_object double")
    model = gam.fit_rows(records, ["mask_area", "z_mean"], "gt_has_object")
    got = gam.score(records, model).collect()
    assert len(got) == 601 and np.mean([(r.score > 0.5) == (r.gt_has_object == 1) for r in got if r.gt_has_object is not None]) > 0.98
    # A fit on few of the rows is a fit on a sample of them.
    few = gam.score(records, gam.fit_rows(records, ["mask_area", "z_mean"], "gt_has_object", fit_limit=80, key="tile_id")).collect()
    assert np.mean([(r.score > 0.5) == (r.gt_has_object == 1) for r in few if r.gt_has_object is not None]) > 0.9
    empty = gam.fit_rows(records.filter("false"), ["mask_area", "z_mean"], "gt_has_object")
    assert {round(r.score, 6) for r in gam.score(records, empty).collect()} == {0.5}


def test_grades_on_odd_rows(spark, feedback, odd_rows):
    good = [(100 + i, " ".join(random.Random(i).sample(words(400), 60)), "a") for i in range(60)]
    junk = [(200 + i, "spam " * 60, "a") for i in range(60)]
    df = feedback(*odd_rows, *good, *junk)
    labels = spark.createDataFrame([(t, 1) for t, *_ in good] + [(t, 0) for t, *_ in junk] + [(None, 1), (100, None), (101, 0)], "tile_id long, gt_label int")
    got = gam.grade_notes(df, labels)
    assert got.columns == ["tile_id", "held_out", "score", "predicted"] and got.count() == df.count()
    rows = got.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in rows)
    assert {r.predicted for r in rows if r.tile_id and r.tile_id >= 200} == {0} and {r.predicted for r in rows if r.tile_id and 102 <= r.tile_id < 200} == {1}
    kept = gam.keep_good(df, labels)
    assert kept.columns == df.columns and kept.filter("tile_id between 102 and 160").count() == 58 and kept.filter("tile_id >= 200").count() == 0
    assert gam.grade_notes(df.filter("false"), labels).count() == 0
    assert {r.score for r in gam.grade_notes(feedback((1, "a b", "a")), labels.filter("false")).collect()} == {0.5}


def test_held_out_accuracy_on_documents(spark):
    from orthomill.llm import queries
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.QUERIES["op9_gam_quality"](spark, sf).join(labels, "doc_id").filter("held_out")
    assert got.filter("predicted = quality").count() >= 0.95 * got.count()
    assert got.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) != 0).count() == 0
