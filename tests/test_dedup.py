"""Clustering against the one-by-one rule on small random sets, and the joins' filters against brute force."""

import hashlib
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacancia.functions.similarity import grams_shared_at_least, least_matched, short_length
from vacancia.operators import dedup, order, similar


def one_by_one(rows):
    """ord -> leader by the rule as stated: join the first earlier survivor that matches."""
    survivors, out = [], {}
    for ord_, ck, tk in sorted(rows):
        out[ord_] = ord_
        if ck and tk:
            for s, sc, st in survivors:
                if sc and st and SequenceMatcher(None, ck, sc).ratio() >= 0.8 and SequenceMatcher(None, tk, st).ratio() >= 0.75:
                    out[ord_] = s
                    break
        if out[ord_] == ord_:
            survivors.append((ord_, ck, tk))
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    words = ["data", "scientist", "ii", "emea", "lead", "engineer", "a", "ops", "x", "de"]
    names = ["acme", "acmes", "acme labs", "tide", "diet", "tides", "b", "bb", "abcde", "abxde", ""]
    rows = []
    for i in range(n):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.2:
            title = "".join(rng.choice("abcx ") for _ in range(rng.randint(1, 6))).strip()
        rows.append((i, rng.choice(names), title))
    return rows


def assign(spark, rows):
    df = spark.createDataFrame(rows, "ord long, ck string, tk string")
    return {r.ord: r.leader for r in dedup.assign_clusters(df).collect()}


def test_random_sets_match_the_rule(spark):
    rows = random_rows(1, 250)
    assert assign(spark, rows) == one_by_one(rows)


def test_portions_match_the_rule(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PORTION_NODES", 6)
    rows = random_rows(2, 120)
    assert assign(spark, rows) == one_by_one(rows)


def test_grid_cells_match_the_rule(spark, monkeypatch):
    monkeypatch.setattr(similar, "CELL_ROWS", 3)
    rows = random_rows(3, 120)
    assert assign(spark, rows) == one_by_one(rows)


def test_not_transitive(spark):
    rows = [(0, "acme", "data scientist"), (1, "acme", "data scientist ii emea"), (2, "acme", "scientist ii emea lead")]
    assert assign(spark, rows) == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize("threshold", [0.75, 0.8])
def test_no_matching_name_is_lost(spark, threshold):
    rng = random.Random(5)
    names = {"".join(rng.choice("abcd e") for _ in range(rng.randint(1, 9))) for _ in range(150)}
    names |= {n[:i] + n[i + 1:] for n in list(names)[:60] for i in range(min(2, len(n)))} - {""}
    df = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    got = {(r.a, r.b, r.a_later, r.b_later) for r in similar.similar_names(df, "name", threshold).collect()}
    want = set()
    ordered = sorted(names)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1:]:
            fwd, bwd = SequenceMatcher(None, a, b).ratio() >= threshold, SequenceMatcher(None, b, a).ratio() >= threshold
            if fwd or bwd:
                want.add((a, b, fwd, bwd))
    assert got == want


@pytest.mark.parametrize("threshold", [0.75, 0.8])
def test_short_strings_cover_the_weak_totals(threshold):
    """Above the short length every possible pair shares a gram."""
    limit = short_length(threshold)
    for total in range(2, 400):
        for n in range(1, total):
            m = total - n
            if max(n, m) > limit and min(n, m) >= least_matched(total, threshold):
                assert grams_shared_at_least(total, threshold) >= 1


def test_merge_fields_tags_alternates(spark):
    rows = [
        (0, 0, "greenhouse", "u0", "0", 0.0, None, None, "", ["a", "a"]),
        (1, 0, "rss", "u1", "1", 100.0, 5.0, "EUR", "x", ["b", "b", "a"]),
        (2, 0, "rss", "u2", "2", 200.0, 7.0, "USD", "y", ["b", "c"]),
        (3, 3, "rss", "u3", "3", 1.0, None, "", "z", []),
    ]
    df = spark.createDataFrame(rows, "ord long, leader long, source string, url string, source_id string, salary_min double, salary_max double, "
                                     "salary_currency string, employment_type string, tags array<string>")
    result = dedup.from_clusters(df)
    out = {r.ord: r for r in dedup.nested(result).collect()}
    assert (out[0].salary_min, out[0].salary_max, out[0].salary_currency, out[0].employment_type) == (100.0, 5.0, "EUR", "x")
    assert out[0].tags == ["a", "a", "b", "b", "c"]
    assert [(a.source, a.url) for a in out[0].alternate_sources] == [("rss", "u1"), ("rss", "u2")]
    assert (out[3].salary_min, out[3].tags, out[3].alternate_sources) == (1.0, [], [])
    stats = dedup.dedup_stats(df).first()
    assert stats.total_output + stats.duplicates_removed == stats.total_input == 4


def test_position_is_dense_and_total(spark):
    df = spark.range(1000).select(F.col("id"), F.pmod(F.hash("id"), F.lit(7)).alias("k"))
    got = [r[0] for r in order.with_position(df, "k", "id").orderBy("k", "id").select("ord").collect()]
    assert got == list(range(1000))


def test_small_blocks_are_paired_without_signatures(spark):
    """Both ways of finding candidates give the same edges; small blocks need no signature rows."""
    from pyspark.sql import functions as F

    from vacancia.operators import similar

    rows = [(i, f"firm{i % 3}", f"senior engineer {'ab'[i % 2] * (i % 7)} {i % 5}") for i in range(60)]
    nodes = spark.createDataFrame(rows, "ord long, ck string, tk string").groupBy("ck", "tk").agg(F.min("ord").alias("ord"))
    by_block = sorted(map(tuple, dedup.duplicate_edges(nodes).collect()))
    limit, similar.SMALL_BLOCK = similar.SMALL_BLOCK, 0
    try:
        by_signature = sorted(map(tuple, dedup.duplicate_edges(nodes).collect()))
    finally:
        similar.SMALL_BLOCK = limit
    assert by_block == by_signature and by_block
    side = spark.createDataFrame([(1, 7, [1]), (1, 8, [2])], "b int, id int, s array<int>")
    found = similar.candidate_pairs(side, side.select("b", F.col("id").alias("other"), F.col("s").alias("t")), ["b"], "id", "other", "s", "t", F.lit(True))
    assert found.count() == 4  # no shared signature is asked for in a small block


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_letters_of_many_pairs(monkeypatch):
    from vacancia.functions import similarity

    rng = random.Random(5)
    for words in (1, 50, 1 << 21):
        monkeypatch.setattr(similarity, "_WORDS", words)
        for letters in ("ab", "abcdefgh é😀\x00", "0123456789abcdef"):
            a, b = (np.array(["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130]))) for _ in range(20)], object) for _ in "ab")
            assert similarity.common_letters(a, b).tolist() == [_common(x, y) for x, y in zip(a, b)]


@pytest.mark.parametrize("threshold", [0.75, 0.8])
def test_near_pairs_lose_no_match(monkeypatch, threshold):
    """And digests, which share letters but not their order, are ruled out."""
    from vacancia.functions import similarity

    rng = random.Random(8)
    names = ["".join(rng.choice("abcd e") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    names += [n[:i] + n[i + 1:] for n in names for i in range(min(2, len(n))) if len(n) > 1]
    digests = ["firm " + hashlib.md5(str(i).encode()).hexdigest() for i in range(100)]
    for common_length in (4, 512):
        monkeypatch.setattr(similarity, "COMMON_LENGTH", common_length)
        found = set(zip(*(x.tolist() for x in similarity.near_pairs(names, names, threshold))))
        assert found >= {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if SequenceMatcher(None, a, b).ratio() >= threshold}
    assert set(zip(*(x.tolist() for x in similarity.near_pairs(digests, digests, threshold)))) == {(i, i) for i in range(100)}


def test_names_of_common_grams_meet_in_a_grid(spark, monkeypatch):
    """Names whose grams most of them share are compared in a grid, each pair once, with the same result."""
    rng = random.Random(6)
    names = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 9))) for _ in range(120)}
    df = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    want = {(a, b) for a in names for b in names if a < b and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.8}
    grids, grid = [], similar._all_near
    monkeypatch.setattr(similar, "GRID_ROWS", (30, 30))
    monkeypatch.setattr(similar, "_all_near", lambda *a: grids.append(1) or grid(*a))
    assert sorted((r.a, r.b) for r in similar.similar_names(df, "name", 0.8).collect()) == sorted(want) and grids
    far = spark.createDataFrame([("".join(chr(0x4E00 + 6 * i + k) for k in range(6)),) for i in range(60)], "name string")
    similar.similar_names(far, "name", 0.8).collect()
    assert len(grids) == 1


def test_titles_of_small_companies_get_no_signature(spark, monkeypatch):
    rows = [(i, "acme" if i < 40 else f"firm {chr(97 + i % 7) * 9}", f"engineer {i}") for i in range(80)]
    nodes = spark.createDataFrame(rows, "ord long, ck string, tk string")
    monkeypatch.setattr(similar, "SMALL_BLOCK", 20)
    signed = dedup._signed(nodes, dedup._company_links(nodes)).collect()
    assert sorted(r.ord for r in signed) == list(range(80))
    assert {r.ck for r in signed if r.sig is not None} == {"acme"} and all(r.len == len(r.tk) for r in signed)
