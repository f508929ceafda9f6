import random
import time

from pyspark.sql import functions as F

from orthomill.llm import near_copies
from orthomill.llm.tables import stored
from tests.llm.conftest import broadcast_steps, words


def grams(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_kept(rows, similarity=0.8):
    """Positions of the first row, by (tile, null last), of each class of linked rows, from all pairs."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    best = {}
    for i, (tile, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0)), (tile is None, tile or 0))
    return sorted(best.values())


def edited(rng, text, changes):
    w = text.split()
    for i in rng.sample(range(len(w)), changes):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


def test_edited_copies_go_as_in_all_pairs(spark, feedback):
    rng = random.Random(4)
    rows = []
    for base in range(12):
        text = " ".join(rng.sample(words(400, base), 150))
        rows += [(len(rows) + i, edited(rng, text, i % 5)) for i in range(8)]
    rng.shuffle(rows)
    got = near_copies.keep_first_copies(feedback(*[(t, x, "a") for t, x in rows]))
    assert sorted((r.tile_id is None, r.tile_id) for r in got.collect()) == brute_kept(rows)


def test_stage_equals_brute_force_on_documents(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((False, r.doc_id) for r in got) == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_and_null_ids_are_told_apart(feedback, odd_rows):
    one, two = " ".join(words(60, 1)), " ".join(words(60, 2))
    got = near_copies.keep_first_copies(feedback((1, one, "a"), (7, one, "copy"), (7, two, "clean"), (None, two, "x"), (None, None, "y"), (None, " ", "z")))
    assert sorted((r.tile_id or 0, r.source_file) for r in got.collect() if r.notes and r.notes.strip()) == [(1, "a"), (7, "clean")] and got.count() == 3
    kept = near_copies.keep_first_copies(feedback(*odd_rows))
    assert kept.columns == feedback(*odd_rows).columns
    assert sorted(map(str, (r.tile_id for r in kept.collect()))) == ["1", "4", "5", "None"]
    assert near_copies.keep_first_copies(feedback(*odd_rows).filter("false")).count() == 0


def test_a_large_group_is_not_compared_pair_by_pair(feedback, monkeypatch):
    rng = random.Random(11)
    text = " ".join(words(150, 3))
    rows = [(i, edited(rng, text, rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 8]))) for i in range(400)]
    compared = []
    alike = near_copies._alike
    monkeypatch.setattr(near_copies, "_alike", lambda pairs, *a: compared.append(pairs.count()) or alike(pairs, *a))
    got = near_copies.keep_first_copies(feedback(*[(t, x, "a") for t, x in rows]))
    assert sorted((r.tile_id is None, r.tile_id) for r in got.collect()) == brute_kept(rows)
    assert sum(compared) < 10 * len(rows), compared


def test_texts_and_band_keys_are_not_broadcast(spark, feedback, monkeypatch):
    rng = random.Random(12)
    rows = [(100 * g + i, edited(rng, " ".join(words(80, g)), i)) for g in range(20) for i in range(4)]
    sent, seen = [], set()
    write = near_copies.stored
    monkeypatch.setattr(near_copies, "stored", lambda df, name, *a: seen.add(name) or sent.extend(broadcast_steps(df)) or write(df, name, *a))
    got = near_copies.keep_first_copies(feedback(*[(t, x, "a") for t, x in rows]))
    assert sorted((r.tile_id is None, r.tile_id) for r in got.collect()) == brute_kept(rows)
    assert {"near-met", "near-texts", "near-alike"} <= seen and sent
    # What a join makes is sized as the product of its sides, far more than it is.
    assert not [steps for steps in sent if "Join" not in steps and ("notes" in steps or "explode(keys" in steps)]


def test_simhash_classes_are_compared_first(spark, feedback, monkeypatch):
    text = " ".join(words(9000, 9))
    rows = [(i, f"{text} end{i}") for i in range(6)] + [(9, " ".join(words(60, 8)))]
    seen = []
    operator = near_copies.simhash.near_duplicate_notes
    monkeypatch.setattr(near_copies.simhash, "near_duplicate_notes", lambda notes, *a: seen.append((notes.count(), a)) or operator(notes, *a))
    # Without bands, only the operator's classes can tie texts.
    monkeypatch.setattr(near_copies, "bands", lambda hashes: [])
    got = near_copies.keep_first_copies(feedback(*[(t, x, "a") for t, x in rows]))
    assert seen == [(7, (5,))] and sorted(r.tile_id for r in got.collect()) == [0, 9]


def test_stored_tables_leave_no_shuffle_files(spark):
    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}

    before = shuffles()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = stored(rows.join(spark.range(0, 1400, 2).hint("merge").withColumnRenamed("id", "k"), "k"), "test-shuffles")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(name) == "false"
    assert kept.count() == 350 and kept.agg(F.sum("n")).first()[0] == sum(len(range(k, 5000, 700)) for k in range(0, 700, 2))
