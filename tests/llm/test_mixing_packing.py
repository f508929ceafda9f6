import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomill.llm import mixing, packing
from orthomill.llm.tables import word_count
from tests.llm.conftest import broadcast_steps, words

SIZED = "tile_id long, source_file string, size long"


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Excess over a source's ceiling is shared anew, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(most * sizes[s] for s in capped)
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} | {s: most * sizes[s] for s in capped}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.fixture(scope="module")
def sized(spark):
    rng = np.random.default_rng(3)
    rows = [(i, ["b", "a", "é", "z", None, "a1"][int(rng.choice(6, p=[.4, .2, .1, .1, .1, .1]))], int(rng.integers(1, 400))) for i in range(3000)]
    rows += [(9000, "b", 20_000), (9001, "empty", 0), (9002, "b", None), (None, "a", 30), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame(rows, SIZED)


def test_mix_meets_its_targets_and_repeats_itself(spark, sized):
    options = {"block_size": 4_000, "shard_blocks": 4, "seed": 1}
    got = mixing.mix_records(sized, **options).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source_file] += r.size
        taken[r.source_file] += r.taken
        target[r.source_file] = r.target
        assert r.taken <= 2 * r.size and r.taken == r.size * len(r.draws) and len({d.copy for d in r.draws}) == len(r.draws)
    want = brute_targets({s: n for s, n in sizes.items()})
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 20_000 / 2 if s == "b" else abs(taken[s] - want[s]) <= 200
    assert len(got) == sized.count() and sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixing.mix_records(sized.repartition(7, "size"), **options).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))
    other = mixing.mix_records(sized, **(options | {"seed": 2})).collect()
    assert Counter(map(str, other)) != Counter(map(str, got))


def test_slots_of_shards_are_not_broadcast(sized, monkeypatch):
    sent, write = {}, mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name, *a: sent.update({name: broadcast_steps(df)}) or write(df, name, *a))
    _, picks = mixing.plan(sized, block_size=4_000, shard_blocks=4)
    assert picks.count() and not [steps for steps in sent["mix-picks"] if "Generate explode(sequence(start" in steps]


def test_no_rows_no_draws(spark, sized):
    assert mixing.mix_records(sized.filter("false")).count() == 0
    assert [r.taken for r in mixing.mix_records(sized.filter("size = 0")).collect()] == [0]


def test_hypergeometric_draws_follow_their_law(spark):
    total, marked, drawn, n = 40, 12, 15, 20_000
    expr = mixing.hypergeometric(str(total), str(marked), str(drawn), f"(id + 0.5D) / {n}")
    counts = Counter(r.x for r in spark.range(n).select(F.expr(expr).alias("x")).collect())
    from math import comb
    for k in range(13):
        p = comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn)
        assert abs(counts[k] / n - p) < 2 / n  # the uniforms are evenly spaced, so this is inversion itself
    for t, k, d in ((10, 10, 4), (10, 0, 4), (10, 3, 10), (0, 0, 0), (200_000, 70_000, 100_000)):
        got = spark.range(20).select(F.expr(mixing.hypergeometric(str(t), str(k), str(d), "(id + 0.5D) / 20")).alias("x")).collect()
        assert all(max(0, d - (t - k)) <= r.x <= min(d, k) for r in got)
        if t:
            assert abs(np.mean([r.x for r in got]) - d * k / t) < max(1, 0.3 * (d * k / t * (1 - k / t)) ** 0.5)


def test_the_tree_shares_quotas_exactly(spark):
    quotas = {"a": 1000, "b": 37, "c": 1, "d": 260}
    got = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "_source string, quota long"), 5).collect()
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r["_source"]] += r.quota
        by_shard[r.shard] += r.quota
    assert by_source == quotas and set(by_shard) == set(range(32)) and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_mixed_notes_hold_the_drawn_rows_in_shards(spark, feedback):
    df = feedback(*[(i, " ".join(words(5 + i % 40)), "ab"[i % 2]) for i in range(400)], (900, None, "a"), (901, "", None))
    options = {"block_size": 300, "shard_blocks": 2}
    out = mixing.mixed_notes(df, word_count(F.col("notes")), **options)
    plan = mixing.mix_records(df.select("tile_id", "source_file", word_count(F.col("notes")).alias("size")), **options)
    assert out.columns == df.columns
    assert Counter(r.tile_id for r in out.collect()) == Counter({r.tile_id: len(r.draws) for r in plan.collect() if r.draws})
    order = [r.tile_id for r in out.collect()]
    assert order != sorted(order)


PATH = "/opt/tokenizers/word_bpe_49k.json"


def check_packing(rows, texts, window=4096):
    """Every id once, offsets gapless, windows full or a power of two; returns the windows' lengths."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(PATH)
    ids = {t: np.array([*tokenizer.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for t, x in texts.items()}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.tile_id].append((r.start, bytes(r.ids)))
        windows[r.window_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 and r.note_ids == len(ids[r.tile_id])
    assert {t: b"".join(x for _, x in sorted(p)) for t, p in pieces.items()} == {t: x.tobytes() for t, x in ids.items()}
    for t, p in pieces.items():
        at = 0
        for start, x in sorted(p):
            assert start == at
            at += len(x) // 4
    lengths = []
    for p in windows.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at and length > 0
            at += length
        lengths.append(at)
        assert at <= window and (at == window or at & (at - 1) == 0)
    return lengths


def test_packing_round_trip(feedback):
    rng = np.random.default_rng(4)
    odd = {1: None, 2: "", 3: " \n", 4: " ".join(words(9000)), 5: "Don't <|endoftext|> x<|startoftext|>y É İß ŉ ﬁ", 6: "naı̈ve Á   \x00 a\x00b",
           7: "ORND.!! ab###,| ﬀ% 12,5 Ω Ωmega", 8: "日本 語 ... 'll we'll O'Neil’s"}
    texts = odd | {100 + i: " ".join(rng.choice(words(500), int(rng.integers(1, 900)))) for i in range(300)}
    df = feedback(*[(t, x, "a") for t, x in texts.items()]).coalesce(3)
    rows = packing.pack_notes(df, PATH).collect()
    lengths = check_packing(rows, texts)
    assert sum(n < 4096 for n in lengths) <= 3 * 12
    assert packing.pack_notes(df.filter("false"), PATH).count() == 0
    doubled = feedback((1, "a b", "a"), (1, "a b", "a"), (None, "c", None))
    lengths = Counter()
    for r in packing.pack_notes(doubled.coalesce(1), PATH).collect():
        lengths[r.tile_id] += r.length
    assert lengths == {None: 2, 1: 6}


def test_words_are_encoded_as_in_their_text():
    encoder = packing.Encoder(PATH)
    text = "Alpha BETA gamma. GAMMA!! Ärger, çà | don't x's 42 a1b2 " * 3
    want = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode(text.encode()) == want == encoder.encode(text.encode())


def test_documents_go_where_the_squares_stay_smallest():
    rng = np.random.default_rng(5)
    packer = packing.Packer(64)
    for i in range(400):
        size = int(rng.integers(1, 64))
        def squares(level):
            counts = packer.counts.copy()
            counts[level] -= level > 0
            if level + size < 64:
                counts[level + size] += 1
            return int((counts[1:64] ** 2).sum())
        options = [0, *[h for h in range(1, 64 - size + 1) if packer.counts[h]]]
        best = min(map(squares, options))
        assert squares(packer.level_for(size)) == best
        packer.place(i, 0, bytes(4 * size), size)
        assert sum(len(w) for w in packer.open.values()) == packer.counts.sum()
    packer.finish()
    fills = [sum(len(p[3]) // 4 for p in w) for w in packer.closed]
    assert all(f == 64 or f & (f - 1) == 0 for f in fills) and sum(f < 64 for f in fills) <= 6
    assert zlib.crc32(b"") == 0
