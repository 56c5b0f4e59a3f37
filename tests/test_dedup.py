import difflib
import random

import pytest

from ledgerloom.operators import dedup

COLUMNS = "source_file string, source_sheet string, source_row long, name string, community string, building_cluster string, unit_number string, plot_number string, mobile_1 string, identity_hash string, is_valid boolean, duplicate_flag string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return 1 - row[-1] / max(len(a), len(b), 1)


def walked(rows, key, measure):
    """The rule in its own words: rows of a file in order; a row equal to an accepted one is a duplicate; else one alike the last accepted named row
    of its property, or else of its phone; else it is accepted and becomes that row."""
    seen, properties, phones, out = set(), {}, {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        file, _, number, name, community, building, unit, plot, phone, identity, valid, _ = r
        if not valid:
            continue
        prop = (file, community, building or "", unit or plot) if community and (unit or plot) else None
        alike = lambda other: 0.0 if not key[name] or not key[other] else 1.0 if key[name] == key[other] else measure(key[name], key[other])
        if (file, identity) in seen:
            out[file, number] = ("exact", None, None)
            continue
        hit = None
        if prop in properties and name:
            score = alike(properties[prop][0])
            hit = ("property", score, properties[prop][1]) if score >= 0.85 else None
        if hit is None and phone and (file, phone) in phones and name:
            score = alike(phones[file, phone][0])
            hit = ("phone", score, phones[file, phone][1]) if score >= 0.85 else None
        out[file, number] = hit or ("accepted", None, None)
        if hit is None:
            seen.add((file, identity))
            if prop and name:
                properties[prop] = (name, number)
            if phone and name:
                phones[file, phone] = (name, number)
    return out


def judged(spark, rows, metric):
    frame = spark.createDataFrame(rows, COLUMNS)
    key = {r.name: r.key for r in frame.select("name", dedup.C.name_key(frame.name).alias("key")).distinct().collect()}
    found = dedup.near_duplicates(dedup.exact_duplicates(frame.drop("duplicate_flag")), metric=metric).collect()
    assert len(found) == len(rows)
    kind = lambda f: "accepted" if f is None else "exact" if f == "duplicate_identity_hash" else f.split("_")[2]
    got = {(r.source_file, r.source_row): (kind(r.duplicate_flag), r.fuzzy_match_score, r.fuzzy_matched_row) for r in found if r.is_valid}
    measure = levenshtein if metric == "levenshtein" else lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {k: (kind, None if score is None else int(score * 1000 + 0.5) / 1000, match) for k, (kind, score, match) in walked(rows, key, measure).items()}
    return got, want


def row(i, name, prop=None, phone=None, file="f", identity=None, valid=True):
    return (file, "s", i, name, "SIDRA" if prop else None, None, prop, None, phone, identity or f"{name}|{prop}|{phone}", valid, None)


@pytest.mark.parametrize("metric", ["ratio", "levenshtein"])
def test_walk_equals_the_rule(spark, metric):
    """Files of names with variants, properties and phones that many rows share, copies, invalid and unnamed rows."""
    rng = random.Random(11)
    stems = [f"{a} {b}" for a in ("KAROLINE", "MUSTAFA", "ÉTIENNE") for b in ("OKONKWO", "OKONKWA", "OKONKWOS", "LINDQVIST", "LINDQUIST")] + ["***", None]
    rows = [row(i, rng.choice(stems), rng.choice([None, "1", "2", "3", f"u{rng.randrange(60)}"]), rng.choice([None, "+9715", "+9716", f"+{rng.randrange(60)}"]), rng.choice("fgh"), valid=rng.random() > 0.05) for i in range(500)]
    got, want = judged(spark, rows, metric)
    assert got == want
    assert {k for k, _, _ in want.values()} == {"accepted", "exact", "property", "phone"}


def test_only_the_last_accepted_row_counts(spark):
    rows = [row(0, "Karoline Okonkwo", "12", "1"), row(1, "Mustafa Lindqvist", "12", "2"), row(2, "Karoline Okonkwo", "12", "3"), row(3, "Karoline Okonkwa", "12", "4")]
    got, want = judged(spark, rows, "ratio")
    assert got == want and [got["f", i][0] for i in range(4)] == ["accepted", "accepted", "accepted", "property"]


def test_a_copy_of_a_refused_row_is_judged_anew(spark):
    rows = [row(0, "Karoline Okonkwo", "12", "1"), row(1, "Karoline Okonkwa", "12", "2"), row(2, "Mustafa Lindqvist", "12", "3"), row(3, "Karoline Okonkwa", "12", "2"), row(4, "Karoline Okonkwa", "12", "2")]
    got, want = judged(spark, rows, "ratio")
    assert got == want and [got["f", i][0] for i in range(5)] == ["accepted", "property", "accepted", "accepted", "exact"]


def test_a_block_that_many_rows_share(spark):
    """A phone that all rows have, with names all different: each row is compared with one other, not with all."""
    names = [f"{a}{i} {b}" for i in range(700) for a, b in (("KAROLINE", "OKONKWO"), ("MUSTAFA", "LINDQVIST"), ("INES", "CASTELLANOS"))]
    got, want = judged(spark, [row(i, n, None, "+971500000000") for i, n in enumerate(names)], "ratio")
    assert got == want


def test_no_rows(spark):
    assert dedup.near_duplicates(dedup.exact_duplicates(spark.createDataFrame([], COLUMNS).drop("duplicate_flag"))).collect() == []
