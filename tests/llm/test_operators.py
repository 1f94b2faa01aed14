"""Each operator against plain Python on rows with nulls, empties, long texts, copies and clashing columns."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tests.llm.conftest import awkward_rows, rows_of
from vacancia.llm import decontaminate, exact_dedup, lm_scoring, mixing, repeats, simhash, token_counts, token_files
from vacancia.session import scratch_path

SPACE, WORD, TERM = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def text_rows():
    return [(r[0], r[1] or "") for r in awkward_rows()]


def by_repr(rows):
    return sorted(rows, key=repr)


def brute_exact():
    groups = collections.defaultdict(list)
    for doc_id, text in text_rows():
        groups[SPACE.sub(" ", text)].append(doc_id)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return by_repr(out)


def test_exact_duplicates(awkward, clashing, nothing):
    assert rows_of(exact_dedup.exact_duplicates(awkward)) == brute_exact()
    assert rows_of(exact_dedup.exact_duplicates(clashing, salts=2)) == brute_exact()
    assert rows_of(exact_dedup.exact_duplicates(nothing)) == []


def brute_counts(path):
    library = Tokenizer.from_file(path)
    out = []
    for doc_id, text in text_rows():
        n = len(library.encode(text, add_special_tokens=False).ids)
        out.append((doc_id, len(text.encode()), n, n > 1024))
    return by_repr(out)


def test_token_counts_and_cache(spark, awkward, clashing, nothing):
    cache = scratch_path(spark, "test-cache")
    assert rows_of(token_counts.token_counts(nothing, BYTES, cache)) == []
    assert rows_of(token_counts.token_counts(awkward, BYTES, cache)) == brute_counts(BYTES)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t for _, t in text_rows()})
    assert rows_of(token_counts.token_counts(clashing, BYTES, cache)) == brute_counts(BYTES)
    assert spark.read.parquet(cache).count() == stored.count()  # nothing was encoded again
    assert rows_of(token_counts.token_counts(awkward, WORDS, cache)) == brute_counts(WORDS)  # another version, other entries


def test_cache_answers_are_used(spark, awkward):
    cache = scratch_path(spark, "test-cache")
    token_counts.token_counts(awkward, BYTES, cache)
    spark.read.parquet(cache).selectExpr("tokenizer", "digest", "n_tokens + 5 AS n_tokens").write.mode("append").parquet(cache)
    got = {r[0]: r[2] for r in rows_of(token_counts.token_counts(awkward, BYTES, cache))}
    assert got[4] == 5


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_encoder_is_the_library(name):
    import random

    from vacancia.llm.tokenizing import Encoder

    path, rng = public_tokenizers.path(name), random.Random(5)
    alphabet = "abcXYZ é'sÉt\n\t 19½!?.,  \x0b\x1c ßµ中İ́<|>\r\x85ſ\xa0 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["x<|endoftext|>y", "<|startoftext|> a", "  ", "a  \n b", "'s't 'LL", "x" * 5000]
    encoder = Encoder(path)
    if name.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        whole = Tokenizer.from_file(path)
        library = lambda t: whole.encode(t, add_special_tokens=False).ids
    for text in texts:
        assert list(struct.unpack(f"<{len(encoder.ids(text)) // 4}I", encoder.ids(text))) == library(text)


def brute_targets(sizes):
    """Level by bisection instead of by ranks."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * weight[s]) for s in names) < sum(sizes.values()) else (low, mid)
    return {s: min(3 * sizes[s], high * weight[s]) for s in names}


def check_mix(df, source_of):
    got = rows_of(mixing.mix(df))
    sizes = collections.Counter()
    rows = [(source_of(r), r) for r in got]
    for source, r in rows:
        sizes[source] += r[1]
    goals = brute_targets(sizes)
    for source, (_, size, source_size, target, taken) in rows:
        assert source_size == sizes[source] and target == pytest.approx(goals[source], rel=1e-6, abs=1e-6)
        assert taken % size == 0 and taken <= 3 * size if size else taken == 0
    assert sum(r[4] for r in got) <= sum(sizes.values())
    assert got == rows_of(mixing.mix(df))
    return sizes, goals, rows


def test_mixing_edges(awkward, nothing, clashing):
    assert rows_of(mixing.mix(nothing)) == []
    got = rows_of(mixing.mix(awkward))
    assert [r[:2] for r in got] == by_repr([(i, len(WORD.findall(t))) for i, t in text_rows()])
    assert rows_of(mixing.mix(clashing.drop("source").withColumn("source", clashing.lang))) is not None
    assert all(r[4] <= 3 * r[1] for r in got)
    assert rows_of(mixing.mix(awkward.filter("text IS NULL"))) == [(3, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)]


def test_mixing_reaches_targets(spark):
    source = lambda i: f"s{(0 if i % 3 else i) % 7}"
    rows = [(i, "w " * (1 + i * 7919 % 50), "en", source(i), 1) for i in range(6000)]
    sizes, goals, got = check_mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), lambda r: source(r[0]))
    for s in sizes:
        assert abs(sum(r[4] for x, r in got if x == s) - goals[s]) <= 50 + 0.01 * goals[s]


def brute_repeats(rows, width):
    seen, words = collections.Counter(), [(i, t.encode().split()) for i, t in rows]
    for _, w in words:
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for doc_id, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return by_repr(out)


@pytest.mark.parametrize("shard", [2000, 3])
def test_repeats(awkward, clashing, nothing, shard):
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    frame = awkward if shard == 2000 else clashing
    assert rows_of(repeats.remove_repeats(frame, shard=shard), *columns) == brute_repeats(text_rows(), 35)
    assert rows_of(repeats.remove_repeats(nothing)) == []


def test_repeats_common_phrase(spark):
    """One phrase in every document, in contexts that recur and in contexts that do not."""
    phrase = " ".join(f"k{i}" for i in range(30))
    rows = [(i, f"{' '.join(f'a{i % 20}_{j}' for j in range(9))} {phrase} {' '.join(f'b{i % 33}_{j}' for j in range(12))}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(repeats.remove_repeats(df, shard=25), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(rows, 35)


def brute_contamination(docs, items, width=10):
    phrases = set()
    for item, text in items:
        t = TERM.findall(lower(text or ""))
        if t:
            phrases |= {(str(item) if item is not None else "", tuple(t[k : k + width])) for k in range(max(1, len(t) - width + 1))}
    out = []
    for doc_id, text in docs:
        t, hit, met = TERM.findall(lower(text)), set(), set()
        for item, phrase in phrases:
            for k in range(len(t) - len(phrase) + 1):
                if tuple(t[k : k + len(phrase)]) == phrase:
                    hit.update(range(k, k + len(phrase)))
                    met.add(item)
        out.append((doc_id, len(t), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return by_repr(out)


def test_contamination(spark, awkward, clashing, nothing):
    items = [(1, "THE quick, brown fox"), (2, "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11 p12"), (10, "p5 P6 p7"), (3, None), (4, "!!"), (None, "id at"), (1, "straße"), (5, "z z z z z z z z z z z"), (6, "twice"), (7, "absent quick words")]
    frame = spark.createDataFrame([(*r, "mine", "mine") for r in items], "item_id long, text string, term string, key string")
    expected = brute_contamination(text_rows(), items)
    assert rows_of(decontaminate.contamination(awkward, frame)) == expected
    assert rows_of(decontaminate.contamination(clashing, frame)) == expected
    assert rows_of(decontaminate.contamination(nothing, frame)) == []
    assert rows_of(decontaminate.contamination(awkward, frame.limit(0))) == brute_contamination(text_rows(), [])


def test_proximity(spark):
    texts = ["a x b y c", "c b a", "a x x x x b c", "a b", "b a a c x a c b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    phrases = spark.createDataFrame([(["a", "b", "c"],), (["a", "b"],)], "phrase array<string>")
    index = decontaminate.build_index(docs, phrases)
    for slop in (0, 2):
        got = {(r["doc"]["doc_id"], r["key"]) for r in decontaminate.proximity_matches(index, phrases, slop).collect()}
        expected = set()
        for i, text in enumerate(texts):
            w = (text or "").split()
            for p in (["a", "b", "c"], ["a", "b"]):
                if any(set(p) <= set(w[k : k + len(p) + slop]) for k in range(len(w))):
                    expected.add((i, " ".join(p)))
        assert got == expected


def brute_fingerprint(text):
    w = lower(text).encode().split()
    if not w:
        return 0
    n = max(1, len(w) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(n)]
    return sum((2 * sum(h >> b & 1 for h in hashes) > n) << b for b in range(64))


def test_simhash(awkward, clashing, nothing):
    rows = [(i, brute_fingerprint(t)) for i, t in text_rows()]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    name = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    expected = by_repr([(i, f"{f:016x}", name[find(k)]) for k, (i, f) in enumerate(rows)])
    assert rows_of(simhash.near_duplicates(awkward)) == expected
    assert rows_of(simhash.near_duplicates(clashing)) == expected
    assert rows_of(simhash.near_duplicates(nothing)) == []


@pytest.mark.parametrize("bucket", [256, 4])
def test_similar_fingerprints_of_a_crowd(spark, bucket):
    import random

    rng, found = random.Random(3), set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(120):
            value = centre
            for _ in range(rng.randint(0, 5)):
                value ^= 1 << rng.randrange(64)
            found.add(value - (1 << 64) if value >> 63 else value)
    fps = sorted(found)
    expected = {(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = [(r["a"], r["b"]) for r in simhash.similar(spark.createDataFrame([(x,) for x in fps], "fp long"), bucket).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def brute_scores(rows):
    docs = [(i, WORD.findall(lower(t))) for i, t in rows]
    single, double = collections.Counter(), collections.Counter()
    for _, w in docs:
        single.update(w)
        single[""] += bool(w)
        double.update(zip(["", *w], w))
    total, out = sum(n for w, n in single.items() if w), collections.defaultdict(lambda: [0, 0.0])
    for i, w in docs:
        out[i][0] += len(w)
        for v, x in zip(["", *w], w):
            out[i][1] += math.log(double[v, x] / single[v] if double[v, x] >= 2 else 0.4 * single[x] / total)
    return {i: (n, s) for i, (n, s) in out.items()}


def test_lm_scores(awkward, clashing, nothing):
    expected = brute_scores(text_rows())
    for frame, slices in ((awkward, 2), (clashing, 1)):
        got = {r["doc_id"]: r for r in lm_scoring.score_documents(frame, slices=slices).collect()}
        assert set(got) == set(expected)
        for i, (n, s) in expected.items():
            assert got[i]["n_words"] == n and got[i]["log_score"] == pytest.approx(s, abs=1e-3)
            assert got[i]["mean_log_score"] == (pytest.approx(s / n, abs=1e-4) if n else None)
    assert rows_of(lm_scoring.score_documents(nothing)) == []


def brute_ids(rows):
    library, start, out = Tokenizer.from_file(WORDS), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_token_files(spark, awkward, clashing, nothing):
    single = awkward.dropDuplicates(["doc_id"])
    rows = [(r["doc_id"], r["text"] or "") for r in single.collect()]
    single = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(token_files.token_files(single, WORDS, scratch_path(spark, "t"))) == by_repr(brute_ids(rows))
    got = sorted(token_files.token_files(clashing, WORDS, scratch_path(spark, "t")).collect(), key=lambda r: r["start"])
    assert by_repr((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == by_repr((r[0], r[2], r[3]) for r in brute_ids(text_rows()))
    assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
    assert rows_of(token_files.token_files(nothing, WORDS, scratch_path(spark, "t"))) == []


def test_huffman_round_trip():
    import numpy as np

    from vacancia.llm import huffman

    rng = np.random.default_rng(2)
    for n, kinds in ((0, 3), (1, 1), (2, 2), (1000, 700), (50_000, 30_000)):
        ids = (rng.zipf(1.2, n) % kinds).astype(np.uint32)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=1 << 16))
        data, checks = huffman.pack(ids, huffman.canonical(lengths), lengths)
        assert (huffman.unpack(data, n, checks, huffman.decoding_table(lengths)) == ids).all()
    steep = huffman.code_lengths(np.array([2**i for i in range(40)] + [0]), 8)
    assert steep.max() == 8 and steep[40] == 0 and sum(2.0 ** -int(x) for x in steep[:40]) == 1


def test_scratch_tables_are_discarded(spark, awkward):
    from vacancia.llm.common import discard, stored

    kept, gone = stored(awkward, "test-kept"), stored(awkward, "test-gone")
    discard(gone)
    assert kept.count() == awkward.count()
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0].rsplit("/", 1)[0]).count()
    with pytest.raises(ValueError):
        discard(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))


def test_lm_scores_in_pieces(spark, awkward):
    """Pieces that end within documents and keys dealt over many ranges change nothing; no plan has a row for each word."""
    expected = brute_scores(text_rows())
    size = sum(n for n, _ in expected.values())
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(awkward, 2, 2, size // 40, size // 10).collect()}
    assert set(got) == set(expected)
    assert all((got[i]["n_words"], got[i]["log_score"]) == (n, pytest.approx(s, abs=1e-3)) for i, (n, s) in expected.items())
    hot = spark.createDataFrame([(i, "a b " * 400) for i in range(200)] + [(None, " "), (None, None)], "doc_id long, text string")
    pieces = lm_scoring.pieces(hot, 1 << 18)
    asked = lm_scoring.asked(pieces, 0, 1, 1)
    assert asked.count() <= pieces.count() and pieces.agg({"n_words": "sum"}).first()[0] == 160_000
    totals = lm_scoring.totals(pieces, 0, 1, 1).collect()
    assert all(np.array_equal(np.sort(lm_scoring._from_planes(r["totals"], np.int64)), [200, 79_800, 80_000]) for r in totals)
