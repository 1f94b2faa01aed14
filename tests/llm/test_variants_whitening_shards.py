"""Spelling groups, whitening and sharding against plain Python and numpy."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import awkward_rows, rows_of
from vacancia.llm import sharding, spelling, whitening
from vacancia.session import scratch_path


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def spelled_rows():
    """Texts of words that are near each other in every way: crowds, anagrams, chains of forms, accents, long runs."""
    rng = random.Random(11)
    base = ["letter", "listen", "silent", "straßeé", "aaaaaa", "aaaaaaa", "anagrams", "Ünïcödéx", "xy" * 1500, "long" * 16]
    words = list(base)
    for w in base:
        for _ in range(25):
            i, c = rng.randrange(len(w)), rng.choice("abestéÿ")
            words += [w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], "".join(rng.sample(w, len(w)))]
    words += ["abcde", "abcdef", "abcdefg", "abcdefgh"]
    rows = [(i, " ".join(rng.choice(words).title() if rng.random() < 0.2 else rng.choice(words) for _ in range(200))) for i in range(40)]
    chain = " ".join(["abcde"] * 3 + ["abcdef"] * 8 + ["abcdefg"] * 40 + ["abcdefgh"] * 200)
    return [*rows, (None, chain), (None, None), (7, ""), (7, "letter letter, LETTER;listen1silent"), (7, "letter letter, LETTER;listen1silent")]


@pytest.mark.parametrize("bucket", [64, 2])
def test_spelling_groups(spark, bucket):
    rows = spelled_rows()
    docs = spark.createDataFrame([(*r, "mine", "mine", 1) for r in rows], "doc_id long, text string, word string, key string, n int")
    got = rows_of(spelling.spelling_groups(docs, bucket))
    assert got == brute_groups(rows) and any(r[1] and r[1] != r[2] for r in got)


def test_spelling_edges(awkward, clashing, nothing):
    expected = brute_groups([r[:2] for r in awkward_rows()])
    assert rows_of(spelling.spelling_groups(awkward)) == expected
    assert rows_of(spelling.spelling_groups(clashing)) == expected
    assert rows_of(spelling.spelling_groups(nothing)) == []


def test_signatures_lose_no_pair():
    """Every pair of random words one edit apart shares a signature; deletions meet as well."""
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
        i = rng.randrange(len(a) + 1)
        b = rng.choice([a[:i] + rng.choice("abcxÿ") + a[i:], a[:i] + rng.choice("bcxÿ") + a[i + 1 :] if i < len(a) else a + "y"])
        assert spelling.one_edit(a, b) == spelling.one_edit(b, a) == one_edit(a, b)
        if one_edit(a, b):
            one, two = spelling.signatures([a, b])
            assert set(one.tolist()) & set(two.tolist()), (a, b)
            rows, keys = spelling.Letters([a, b]).deletions()
            assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist()), (a, b)


def vectors(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * 0.2
    return [[float(v) for v in row] for row in base.astype(np.float32)]


def check_whitened(df, kept, components=32):
    """Rows of `whiten` against numpy on the kept (id, vector) rows; the sign of a component is free."""
    x = np.floor(64 * np.array([v for _, v in kept], dtype=np.float64)).astype(np.int64) + 1_000_000
    n, dim = x.shape
    total = [sum(int(v) for v in x[:, j]) for j in range(dim)]
    centred = x - x.mean(axis=0)
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, total, strict=True)) for row in x]
    got = collections.defaultdict(list)
    for r in df.orderBy("vec_id", "deviation", "component").collect():
        got[r["component"]].append(r)
    assert sorted(got) == list(range(1, min(components, dim) + 1))
    order = sorted(range(n), key=lambda i: (kept[i][0] is not None, kept[i][0] or 0, deviation[i]))
    for k, rows in got.items():
        assert [r["vec_id"] for r in rows] == [kept[i][0] for i in order]
        assert [r["deviation"] for r in rows] == [deviation[i] for i in order]
        assert all(r["n"] == n and r["explained"] == pytest.approx(values[k - 1] / np.trace(cov), rel=1e-9, abs=1e-14) for r in rows)
        if values[k - 1] > 1e-6:
            mine, theirs = np.array([r["whitened"] for r in rows]), (centred @ basis[:, k - 1] / np.sqrt(values[k - 1]))[order]
            assert min(abs(mine - theirs).max(), abs(mine + theirs).max()) < 1e-7
            assert rows[0]["identity_error"] < 1e-9
        else:
            assert all(r["whitened"] is None for r in rows)


def test_whitening(spark):
    plain = vectors(300, 40)
    kept = [(i, v) for i, v in enumerate(plain)] + [(1000 + i, plain[7]) for i in range(200)] + [(None, plain[8]), (3, plain[9]), (3, plain[3])]
    gone = [(5000, None), (5001, [None] + plain[0][1:]), (5002, [float("nan")] + plain[0][1:]), (5003, [float("inf")] + plain[0][1:]), (5004, []), (5005, plain[0][:12]), (5006, [1e30] + plain[0][1:])]
    rows = spark.createDataFrame([(i, v, "mine", "mine", "mine") for i, v in kept + gone], "vec_id long, embedding array<float>, x string, n string, dim string")
    check_whitened(whitening.whiten(rows), kept)
    check_whitened(whitening.whiten(rows.withColumn("embedding", F.col("embedding").cast("array<double>")), components=5), kept, 5)


def test_whitening_once_per_vector(spark):
    """With weights of one the fit list is the distinct vectors."""
    plain = vectors(60, 6)
    rows = spark.createDataFrame([(i, plain[i % 60] if i < 60 else plain[0]) for i in range(500)], "vec_id long, embedding array<float>")
    got = whitening.whiten(rows, weighted=False)
    assert got.first()["n"] == len({tuple(np.floor(64 * np.array(v))) for v in plain}) and got.count() == 500 * 6
    assert got.first()["identity_error"] < 1e-9


def test_whitening_without_variance(spark):
    few = vectors(3, 8)
    check_whitened(whitening.whiten(spark.createDataFrame(list(enumerate(few)), "vec_id long, embedding array<float>")), list(enumerate(few)))
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in same)
    for nothing in ([], [(1, None), (2, [None])]):
        got = whitening.whiten(spark.createDataFrame(nothing, "vec_id long, embedding array<float>"))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_is_exact():
    x = np.array([[10**6, -(10**6)], [0, 5]])
    assert whitening.deviations(x, 1000, [7, 7]) == [(10**9 - 7) ** 2 + (10**9 + 7) ** 2, 49 + (5000 - 7) ** 2]
    big = whitening.deviations(np.array([[2**50, 1]]), 2**13, [3, 3])
    assert big == [None]


def check_shards(df, texts, shards=16):
    got = df.collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = collections.defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def test_shards(spark, awkward, clashing, nothing):
    texts = [r[:2] for r in awkward_rows()]
    check_shards(sharding.shard_documents(awkward), texts)
    check_shards(sharding.shard_documents(clashing), texts)
    assert rows_of(sharding.shard_documents(nothing)) == []


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 500])
def test_shards_hold_whole_rows_in_random_order(spark, bucket_bytes):
    rows = [(i // 3 if i < 900 else None, "same" if i % 3 else f"text {i} " * (i % 7), "en") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    make = lambda seed: sharding.write_shards(docs, scratch_path(spark, "t"), shards=7, seed=seed, bucket_bytes=bucket_bytes)
    one, again, other = (make(seed) for seed in (1, 1, 2))
    key = lambda df: sorted((r["shard"], r["slot"], repr(r["doc"])) for r in df.collect())
    assert key(one) == key(again) != key(other)
    assert sorted(x[2] for x in key(one)) == sorted(x[2] for x in key(other))
    assert collections.Counter(r["doc"]["slot"] for r in one.collect()) == {"en": 2000}
    # the order is mixed: neighbours of the input are no neighbours of the output, and every shard has its share of each third
    place = {r["doc"]["doc_id"]: r["shard"] for r in one.filter("doc.text LIKE 'text%'").collect() if r["doc"]["doc_id"] is not None}
    first = collections.Counter(v for k, v in place.items() if k < 150)
    assert len(first) == 7 and min(first.values()) > 5 and max(first.values()) < 40


def test_shuffle_is_uniform(spark):
    """All orders of four rows of one bucket occur about equally often over many seeds."""
    seen = collections.Counter()
    docs = spark.createDataFrame([(i, "x") for i in range(4)], "doc_id long, text string").coalesce(1)
    arrays = docs.agg(F.sort_array(F.collect_list("doc_id")).alias("a"))
    orders = arrays.select(*[F.shuffle("a", s).alias(f"s{s}") for s in range(600)]).first()
    seen.update(tuple(o) for o in orders)
    assert len(seen) == 24 and min(seen.values()) > 5


def test_places_of_buckets():
    for rows, shards in ((0, 3), (2, 3), (7, 3), (9, 3)):
        each, longer = divmod(rows, shards)
        assert sum(each + (k < longer) for k in range(shards)) == rows
    assert [sharding.bucket_bits(t, 10) for t in (0, 1, 10, 11, 20, 21, 10**12)] == [0, 0, 0, 1, 1, 2, sharding.SLICE_BITS]
