import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomill.llm import line_frequency, pseudonyms, repeats
from tests.llm.conftest import words


def standing(rows, size):
    """Per row the numbers of the words that lie in a window of ``size`` words which stands earlier, in order of tiles."""
    seen, out = set(), []
    for _, text in rows:
        w, hit = (text or "").lower().split(), set()
        for i in range(len(w) - size + 1):
            window = tuple(w[i:i + size])
            if window in seen:
                hit |= set(range(i, i + size))
            seen.add(window)
        out.append(hit)
    return out


PASSAGE = "Dies ist " + " ".join(words(20, 1)) + ". Und das " + " ".join(words(25, 2)) + "."


def unit_hashes(text):
    return {h for h, *_ in repeats.units_of(text.lower().split())}


def test_units_of_a_passage_do_not_depend_on_what_is_around():
    assert len(unit_hashes("Eins zwei drei vier fünf.\n\n  Drei vier fünf\nmitten drin.\n" + PASSAGE.replace(" ", "\n") + " weiter hier") & unit_hashes(PASSAGE)) > 2
    assert unit_hashes("") == unit_hashes(" \n ") == set() and repeats._words(None) == []
    rng = random.Random(3)
    for _ in range(200):
        passage = " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) + rng.choice(["", "", "", "", "", "."]) for _ in range(50))
        around = [" ".join(f"{x}{rng.randrange(99)}" for _ in range(rng.randrange(60))) for x in "uv"]
        assert unit_hashes(f"{around[0]} {passage} {around[1]}") & unit_hashes(f"{around[1]} {passage} {around[0]}"), passage


def test_spans_lie_between_the_50_and_the_10_word_windows_that_stand_earlier(spark, feedback):
    rng = np.random.default_rng(1)
    pool = [" ".join(rng.choice(words(300), 12)).capitalize() + "." for _ in range(3)]
    rows = [(i, " ".join(rng.choice(pool, int(rng.integers(0, 14))))) for i in range(60)]
    found = {t: set() for t, _ in rows}
    for r in repeats.repeated_spans(feedback(*[(t, x, "a") for t, x in rows])).collect():
        first = len(rows[r.tile_id][1][:r.start].split())
        assert r.words >= 40 and len(rows[r.tile_id][1][r.start:r.start + r.length].split()) == r.words
        found[r.tile_id] |= set(range(first, first + r.words))
    must, may = standing(rows, 50), standing(rows, 10)
    assert all(found[t] <= may[t] for t, _ in rows) and any(must)
    # At the edge of a passage that stands in several lengths, under a unit of words can stay.
    lost = {t: must[t] - found[t] for t, _ in rows}
    assert all(not set(range(i, i + 24)) <= lost[t] for t in lost for i in lost[t])


@pytest.mark.parametrize("whole_first", [True, False])
def test_random_passages_at_random_places(spark, feedback, whole_first):
    rng = random.Random(5)
    vocabulary = words(2000, 8)
    passages = [[rng.choice(vocabulary) + rng.choice([""] * rng.choice([2, 9, 99]) + ["."]) for _ in range(rng.randrange(50, 140))] for _ in range(25)]
    rows = [(i, " ".join(p)) for i, p in enumerate(passages)] if whole_first else []
    for tile in range(len(rows), 150):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
            p = rng.choice(passages)
            at = rng.randrange(0, len(p) - 49)
            w += p[at:at + rng.randrange(50, 200)] if rng.random() < 0.7 else []
        rows.append((tile, rng.choice([" ", "\n", " \t "]).join(w) if not whole_first or rng.random() < 0.8 else " ".join(w).upper()))
    found = {t: set() for t, _ in rows}
    for r in repeats.repeated_spans(feedback(*[(t, x, "a") for t, x in rows])).collect():
        first = len(rows[r.tile_id][1][:r.start].split())
        found[r.tile_id] |= set(range(first, first + r.words))
    must, may = standing(rows, 50), standing(rows, 10)
    assert all(found[t] <= may[t] for t, _ in rows)
    lost = {t: must[t] - found[t] for t, _ in rows}
    if whole_first:
        assert not any(lost.values()), lost
    # Of versions of many lengths, less than a unit can stay at an edge.
    assert all(not set(range(i, i + 24)) <= lost[t] for t in lost for i in lost[t])


def test_passages_inside_other_text_are_cut_and_clean_notes_stay(spark, feedback):
    rows = [(1, "vorher steht " + PASSAGE, "a"), (2, "anderes steht " + PASSAGE + " danach kommt noch etwas", "a"), (3, "Nur dies ist hier.", "b"),
            (4, "Nur dies ist hier.", "b"), (5, None, "b"), (6, PASSAGE, None), (6, PASSAGE, None)]
    df = feedback(*rows)
    spans = repeats.repeated_spans(df).collect()
    assert {(r.tile_id, r.kept_tile_id) for r in spans} == {(2, 1), (6, 1)} and sum(r.tile_id == 6 for r in spans) == 2
    cut = repeats.without_repeats(df)
    assert cut.columns == [*df.columns, "kept_spans"] and cut.count() == len(rows)
    left = defaultdict(list)
    for r in cut.collect():
        left[r.tile_id].append(r.notes)
        source = next(x for t, x, _ in rows if t == r.tile_id)
        if source is not None:
            assert r.notes == "".join(source[s.start:s.start + s.length] for s in r.kept_spans)
    assert left[1] == [rows[0][1]] and left[3] == left[4] == ["Nur dies ist hier."] and left[5] == [None] and left[6] == ["", ""]
    assert "danach kommt" in left[2][0] and "w1x0003" not in left[2][0]


def test_repeats_on_odd_rows(feedback, odd_rows):
    got = repeats.repeated_spans(feedback(*odd_rows)).collect()
    assert [(r.tile_id, r.kept_tile_id, r.words) for r in got] == [(4, 4, 60_000)]
    assert repeats.repeated_spans(feedback(*odd_rows).filter("false")).count() == 0


def brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_plain_ones(feedback, odd_rows):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["a", "b", "é#", "|c"], int(rng.integers(0, 60)))) for _ in range(40)]
    texts += ["a b c d e f g h " * 9, "x\n\nx\n x\ny|\ny|", "one two three four five six seven eight nine", "𝒳 ﬁ\x0b<b>"]
    rows = [(100 + i, t, "a") for i, t in enumerate(texts)] + odd_rows
    got = line_frequency.judge_notes(feedback(*rows)).collect()
    want = Counter((t, *brute_base(x)) for t, x, _ in rows)
    assert Counter((r.tile_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)


def test_frequent_lines_of_a_host_empty_their_documents(feedback):
    line, body = "Alle  Rechte vorbehalten", [" ".join(words(30, i)) for i in range(40)]
    rows = [(i, f"{body[i]}\n{line}", "hot") for i in range(30)] + [(30 + i, f"{body[30]} {i}\n{line.upper()}", "other") for i in range(5)]
    # A document of such lines and little else is depleted; copies of it count once.
    menu = "\n".join([line] * 8)
    rows += [(50, menu, "hot"), (51, menu, "hot"), (52, menu, "other"), (53, menu, None)]
    got = {r.tile_id: r for r in line_frequency.judge_notes(feedback(*rows), min_documents=20, min_words=5, max_repeated=100).collect()}
    assert all(got[i].removed_lines == [1] and got[i].removed_words == 3 and got[i].kept for i in range(30))
    assert got[30].removed_lines == [] and got[52].kept and got[53].kept
    assert got[50].removed_words == 24 and not got[50].kept and not got[51].kept and not got[50].base_failed
    assert line_frequency.judge_notes(feedback(*rows).filter("false")).count() == 0


def test_lines_are_taken_out_by_number(feedback):
    df = feedback((1, "a\nb\nc", "x")).select(line_frequency.without_lines(F.col("notes"), F.array(F.lit(1))).alias("n"))
    assert df.first().n == "a\nc"


SAMPLE = ("Mail an.tonia.34@mail7.example.com, Karte 4539 1488 0343 6467 und 4539148803436467, keine 4539148803436468; Tel +1 (017) 555-7713 oder "
          "(212) 555-0199, Netz 97.51.17.173, nicht 300.1.2.3; am 2021-02-28 und 28.02.2021, nicht 2021-02-30; SSN 219-09-9999, nicht 000-12-3456; "
          "IBAN DE89 3704 0044 0532 0130 00; Version 3.0.1, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"")


def test_pseudonyms_keep_formats_and_can_be_undone(spark, feedback):
    df = feedback((1, SAMPLE, "a"), (2, SAMPLE + "!", "a"))
    done = pseudonyms.pseudonymise_notes(df, "k1")
    text = done.filter("tile_id = 1").first()
    assert text.n_replaced == 11 and done.filter("tile_id = 2").first().notes == text.notes + "!"
    for kept in ("4539148803436468", "300.1.2.3", "2021-02-30", "000-12-3456", "Version 3.0.1"):
        assert kept in text.notes
    for gone in ("an.tonia.34", "4539 1488 0343 6467", "4539148803436467", "555-7713", "555-0199", "97.51.17.173", "2021-02-28", "28.02.2021",
                 "219-09-9999", "0532 0130", "04dbebab"):
        assert gone not in text.notes
    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    cards = re.findall(r"Karte (\d{4} \d{4} \d{4} \d{4}) und (\d{16})", text.notes)[0]
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1])
    assert re.search(r"Tel \+1 \(\d{3}\) \d{3}-\d{4} oder \(\d{3}\) \d{3}-\d{4}, Netz (\d{1,3}\.){3}\d{1,3},", text.notes)
    iban = re.search(r"IBAN (DE\d\d( \d{4}){4} \d\d)", text.notes)[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    day, again = re.search(r"am (\d{4}-\d\d-\d\d) und (\d\d\.\d\d\.\d{4})", text.notes).groups()
    assert day == "-".join(reversed(again.split(".")))
    assert pseudonyms.pseudonymise_notes(done, "k1", sign=-1).filter("tile_id = 1").first().notes == SAMPLE
    assert pseudonyms.pseudonymise_notes(df, "k2").filter("tile_id = 1").first().notes != text.notes


def test_networks_are_permutations(spark):
    numbers = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    moved = {r.p for r in numbers.select(pseudonyms.permute_digits(F.col("d"), "k", "t").alias("p")).collect()}
    assert moved == {f"{i:04d}" for i in range(10_000)}
    days = spark.range(-25_567, -25_567 + 73_049).select(pseudonyms.permute_days(F.col("id"), "k").alias("p"))
    assert days.distinct().count() == 73_049 and days.agg(F.min("p"), F.max("p")).first() == (-25_567, 47_481)
    names = [f"{a}{b}.{d}" for a in "abcxyz" for b in "ABZ" for d in range(10)]
    texts = spark.createDataFrame([(n,) for n in names], "t string").select("t", pseudonyms.permute_text(F.col("t"), "k", "t").alias("p"))
    got = {r.t: r.p for r in texts.collect()}
    assert len(set(got.values())) == len(names) and all(re.fullmatch(r"[a-z][A-Z]\.[0-9]", p) for p in got.values())


def test_pseudonyms_on_odd_rows(feedback, odd_rows):
    df = feedback(*odd_rows)
    got = pseudonyms.pseudonymise_notes(df.withColumn("_done", F.lit("mine")))
    assert got.columns == [*df.columns, "_done", "n_replaced"] and got.filter("_done = 'mine'").count() == len(odd_rows)
    assert sorted(map(str, [(r.tile_id, r.notes, r.source_file) for r in got.collect()])) == sorted(map(str, odd_rows))
    assert {r.n_replaced for r in got.collect()} == {0} and pseudonyms.pseudonymise_notes(df.filter("false")).count() == 0


@pytest.mark.parametrize("run", ["a" * 200_000, "1" * 200_000, "a.b-" * 50_000, "1.1." * 50_000])
def test_long_runs_are_scanned_in_one_pass(feedback, run):
    assert pseudonyms.pseudonymise_notes(feedback((1, run + " 1@", "a"))).first().n_replaced == 0


def test_values_of_a_kind_stay_different_valid_and_reversible(spark):
    from datetime import date, timedelta
    days = [date(1900, 1, 1) + timedelta(i) for i in range(0, 73_049, 6)] + [date(2099, 12, 31), date(2000, 2, 29), date(2096, 2, 29)]
    texts = {d.strftime(f) for d in days for f in ("%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d", "%d.%m.%Y")}
    texts |= {f"{a:03d}-{g:02d}-{n:04d}" for a in (1, 77, 665, 667, 899) for g in (1, 50, 99) for n in range(1, 9999, 370)}
    unread = {"00/13/2001", "13/13/2001", "02/30/2000", "30/02/2000", "02/29/2001", "29/02/1900", "00/00/2000", "01/00/2000", "666-01-0001", "900-01-0001", "123-00-0001"}
    df = spark.createDataFrame([(t,) for t in sorted(texts | unread)], "t string").repartition(8)
    got = df.select("t", pseudonyms.pseudonym(F.col("t"), "k").alias("p")).select("t", "p", pseudonyms.pseudonym(F.col("p"), "k", -1).alias("back")).collect()
    assert all(r.back == r.t for r in got) and len({r.p for r in got}) == len(got) and {r.t for r in got if r.p == r.t} >= unread

    def like(t):
        if "/" in t:
            a, b, year = map(int, t.split("/"))
            date(year, min(a, b), max(a, b))
            return a > 12, b > 12, 1900 <= year <= 2099
        return re.sub("[0-9]", "0", t)
    assert all(like(r.t) == like(r.p) for r in got if r.t in texts)
    assert not any(re.match("000|666|9|...-00|.*-0000$", r.p) for r in got if r.t in texts and re.match("[0-9]{3}-", r.t))


class Plain:
    """The networks once more, number by number in plain Python."""

    def __init__(self, key):
        self.key = key

    def mix(self, tweak, turn, half, below):
        return int(hashlib.sha256(f"{self.key}|{tweak}|{turn}|{half}".encode()).hexdigest()[:15], 16) % below

    def network(self, a, b, a_size, b_size, tweak):
        for t in range(8):
            if t % 2 == 0:
                a = (a + self.mix(tweak, t, b, a_size)) % a_size
            else:
                b = (b + self.mix(tweak, t, a, b_size)) % b_size
        return a, b

    def digits(self, d, tweak):
        m = len(d) // 2
        a, b = self.network(int(d[:m]), int(d[m:]), 10 ** m, 10 ** (len(d) - m), f"{tweak}{len(d)}")
        return f"{a:0{m}d}{b:0{len(d) - m}d}"

    def refill(self, shape, digits):
        it = iter(digits)
        return re.sub("[0-9]", lambda _: next(it), shape)

    def date(self, v):
        from datetime import date, datetime, timedelta
        if "/" in v:
            a, b, year = map(int, v.split("/"))
            if a <= 12 and b <= 12:
                x, y = self.network((a - 1) * 12 + b - 1, year - 1900, 144, 200, "early")
                return f"{x // 12 + 1:02d}/{x % 12 + 1:02d}/{y + 1900}"
            late = [(d.month, d.day) for d in (date(2000, 1, 1) + timedelta(i) for i in range(366)) if d.day > 12]
            x, y = late.index((min(a, b), max(a, b))), year - 1900
            while True:
                x, y = self.network(x, y, 222, 200, "late")
                try:
                    date(y + 1900, *late[x])
                    break
                except ValueError:
                    pass
            m, d = late[x]
            return f"{m:02d}/{d:02d}/{y + 1900}" if a <= 12 else f"{d:02d}/{m:02d}/{y + 1900}"
        form = "%Y-%m-%d" if v[4] == "-" else "%d.%m.%Y"
        at = divmod((datetime.strptime(v, form).date() - date(1900, 1, 1)).days, 271)
        while True:
            at = self.network(*at, 270, 271, "day")
            if at[0] * 271 + at[1] < 73_049:
                return (date(1900, 1, 1) + timedelta(at[0] * 271 + at[1])).strftime(form)

    def social(self, v):
        areas = [a for a in range(1, 900) if a != 666]
        a, g, n = map(int, v.split("-"))
        x, y = self.network(areas.index(a), (g - 1) * 9999 + n - 1, 898, 99 * 9999, "social")
        return f"{areas[x]:03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"

    def address(self, v):
        a, b, c, d = map(int, v.split("."))
        x, y = self.network(a * 256 + b, c * 256 + d, 65_536, 65_536, "address")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"

    def card(self, v):
        body = self.digits(re.sub("[^0-9]", "", v)[:-1], "card")
        last = next(c for c in "0123456789" if sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(body + c))) % 10 == 0)
        return self.refill(v, body + last)

    def phone(self, v):
        country = re.match(r"(?:\+[0-9]{1,3}(?=[^0-9])|\+[0-9])?", v)[0]
        return country + self.refill(v[len(country):], self.digits(re.sub("[^0-9]", "", v[len(country):]), "phone"))


def test_pseudonyms_agree_with_plain_python(spark):
    """Every date, number and address found in the documents."""
    found = (spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
             .select(F.explode(F.regexp_extract_all("text", F.lit(pseudonyms.FOUND), F.lit(0))).alias("v")).distinct())
    extra = [("01/02/2003",), ("12/25/2031",), ("25/12/2031",), ("29/02/2000",), ("2099-12-31",), ("31.12.1999",), ("219-09-9999",), ("4539 1488 0343 6467",), ("+49 30 1234 5678",)]
    rows = found.union(spark.createDataFrame(extra, "v string")).distinct().select("v", pseudonyms.pseudonym(F.col("v"), "k").alias("p")).collect()
    plain, checked = Plain("k"), Counter()
    for r in rows:
        kind = next(n for n in ("MAIL", "SECRET", "IBAN", "DATE", "ADDRESS", "PHONE", "SOCIAL", "CARD") if re.fullmatch(getattr(pseudonyms, n), r.v))
        if kind in ("DATE", "ADDRESS", "PHONE", "SOCIAL", "CARD") and r.p != r.v:
            assert r.p == getattr(plain, kind.lower())(r.v), r
            checked[kind] += 1
    assert set(checked) >= {"DATE", "PHONE", "SOCIAL", "CARD"}, checked
