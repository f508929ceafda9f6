import random

from orthomill.llm import repeats
from tests.llm.conftest import words


def test_passages_that_start_and_end_inside_a_sentence_are_cut(feedback):
    passage = " ".join(words(51, 1))
    rows = [(1, f"Zuvor {' '.join(words(30, 2))} {passage} {' '.join(words(30, 3))}."), (2, f"Andere {' '.join(words(25, 4))} {passage} {' '.join(words(9, 5))}."),
            (3, " ".join(words(51, 1)[:25]) + ". Neu " + " ".join(words(40, 6)))]
    got = repeats.repeated_spans(feedback(*[(t, x, "a") for t, x in rows])).collect()
    assert [(r.tile_id, rows[1][1][r.start:r.start + r.length], r.words, r.kept_tile_id) for r in got] == [(2, passage, 51, 1)]


def test_words_that_repeat_one_by_one_are_no_passage(feedback):
    names = [w.upper() for w in words(60, 1)]
    shuffled = names[::7] + names[1::7] + names[2::7] + names[3::7] + names[4::7] + names[5::7] + names[6::7]
    assert repeats.repeated_spans(feedback((1, " ".join(names), "a"), (2, " ".join(shuffled), "a"))).count() == 0
    assert [r.words for r in repeats.repeated_spans(feedback((1, " ".join(names), "a"), (2, " ".join(names), "a"))).collect()] == [60]


def test_units_leave_python_as_rows_of_their_own(feedback, monkeypatch):
    texts = {1: " ".join(words(400, 1)), 2: None, 3: " ", 4: "Kurz", 5: " ".join(words(90, 2)).upper()}
    plans, write = [], repeats.stored
    monkeypatch.setattr(repeats, "stored", lambda df, name, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name, *a))
    monkeypatch.setattr(repeats, "TEXTS", 2)
    got = repeats._units(feedback(*[(t, x, "a") for t, x in texts.items()]), "tile_id").collect()
    want = []
    for t, x in texts.items():
        units = repeats.units_of((x or "").lower().split())
        lengths = [0, *[w for *_, w in units], 0]
        want += [(t, t, h, a, w, lengths[i] + lengths[i + 2]) for i, (h, a, w) in enumerate(units)]
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 30
    assert len(plans) == 1 and "Generate" not in plans[0]


def test_agreeing_stretches_equal_a_walk_word_by_word():
    rng = random.Random(2)
    for _ in range(300):
        own = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        kept = [w if rng.random() < 0.95 else "x" for w in own + ["c"] * rng.randint(0, 3)][:rng.randint(0, 63)]
        same = [x == y for x, y in zip(own, kept)] + [False]
        starts = [i for i, s in enumerate(same) if s and not (i and same[i - 1])]
        assert repeats._agreeing(own, kept) == [(i, j) for i in starts for j in [same.index(False, i)] if j - i >= repeats.MATCH]
