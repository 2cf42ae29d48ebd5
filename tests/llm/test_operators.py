"""Every operator against brute force, and on awkward rows: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import collections
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import _text, decontamination, itq, langid, licenses, lm_scoring, minmax, packing, queries, suffix_dedup, tool_calls, toxicity
from quillspark.llm._components import connected_components

SF = "/root/testdata/sf0.001"
CLASH = "n_shingles long, component_id string, spans int, kept string, found int, th string, score string, grp int, part long, lang string, source string, n_chars long"


def docs(spark, rows):
    """doc_id, text and columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, *([None] * 12)) for i, t in rows], f"doc_id long, text string, {CLASH}")


LONG = " ".join(f"word{k % 977}" for k in range(60_000))
AWKWARD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (4, "one"), (5, LONG), (6, LONG), (7, "a" * 5000), (8, "\x00퟿ é 한글 🙂"), (None, "no id at all"), (9, "one"), (10, "ONE"), (11, LONG[:3000]), (12, LONG[:3000])]


def texts(n=200):
    return [(r["doc_id"], r["text"]) for r in __import__("pyarrow.parquet", fromlist=["x"]).read_table(f"{SF}/documents.parquet").slice(0, n).to_pylist()]


# ---------------------------------------------------------------- shared parts


def test_word_hashes_are_of_words():
    column = pa.array(["The the\tTHE", None, "", " x y\x0bz ", "the"])
    raw, at = _text.texts(column)
    hashes, rows, starts, ends = _text.words(raw, at)
    words = [raw[a:b].tobytes().lower() for a, b in zip(starts, ends)]
    assert words == [b"the", b"the", b"the", "x y".encode(), b"z", b"the"] and rows.tolist() == [0, 0, 0, 3, 3, 4]
    assert len(set(hashes.tolist())) == 3


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 10


def shingle_sets(rows, k):
    out = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def components_by_brute_force(sets, percent=80):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def edited(rng, words, part):
    return " ".join(w if rng.random() > part else f"new{rng.randrange(10**6)}" for w in words)


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minmax, "BLOCK", block)
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = texts(60) + [(1000 + k, edited(rng, base, 0.02)) for k in range(40)] + [(2000 + k, "a b c d e".upper()) for k in range(5)]
    got = {r["doc_id"]: r for r in minmax.near_duplicates(docs(spark, rows), words=4).collect()}
    sets = shingle_sets(rows, 4)
    want = components_by_brute_force(sets)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[d]) and r["kept"] == (d == want[d]) for d, r in got.items())


def test_near_duplicates_awkward(spark):
    rows = [*AWKWARD, (None, "one"), (None, "two three"), (None, "TWO  three"), (4, "another text of this document"), (20, "another text of this document")]
    got = minmax.near_duplicates(docs(spark, rows), words=4).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["component_id"], r["kept"]))
    assert by[1] == [(1, True)] and by[2] == [(2, True)] and by[6] == [(5, False)] and by[9] == by[10] == [(4, False)] and by[12] == [(11, False)]
    assert by[4] == [(4, True)] * 3 and by[20] == [(4, False)]
    assert sorted(by[None], key=str) == [(4, False), (None, True), (None, True), (None, True)]
    assert minmax.near_duplicates(docs(spark, [])).count() == 0
    kept = collections.Counter((r["doc_id"], r["text"]) for r in minmax.keep_one(docs(spark, rows)).select("doc_id", "text").collect())
    lost = {(6, LONG), (None, "one"), (9, "one"), (10, "ONE"), (12, LONG[:3000]), (20, "another text of this document")}
    assert max(kept.values()) == 1 and {r for r in rows if r not in kept} - {(None, "two three"), (None, "TWO  three")} == lost
    assert ((None, "two three") in kept) != ((None, "TWO  three") in kept)
    assert minmax.keep_one(docs(spark, [])).count() == 0 and len(minmax.keep_one(docs(spark, rows)).columns) == 14


def test_groups_of_sorted_rows():
    rng = random.Random(19)
    keys = sorted((rng.randrange(5), rng.randrange(3)) for _ in range(200))
    table = pa.RecordBatch.from_arrays([pa.array([k[c] for k in keys]) for c in (0, 1)] + [pa.array(range(200))], names=["a", "b", "n"])
    parts, at = [], 0
    while at < 200:
        size = rng.choice([0, 1, 3, 40])
        parts.append(table.slice(at, size))
        at += size
    got = [g.to_pydict() for g in _text.groups(iter(parts), 2)]
    assert [n for g in got for n in g["n"]] == list(range(200)) and [(g["a"][0], g["b"][0]) for g in got] == sorted(set(keys))
    assert list(_text.groups(iter([]), 2)) == []


# ---------------------------------------------------------------- 8


def repeats_by_brute_force(bodies, span):
    seen = collections.Counter(t[i : i + span] for t in bodies for i in range(len(t) - span + 1))
    out = []
    for t in bodies:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        out.append((len(t), sum(gone), bytes(b for b, x in zip(t, gone) if not x)))
    return out


@pytest.mark.parametrize("group", [128, 3])
def test_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdéf ") for _ in range(2000))
    rows = []
    for k in range(60):
        a = rng.randrange(1400)
        rows.append((k, "".join(rng.choice("xyz é") for _ in range(rng.randrange(200))) + base[a : a + rng.randrange(80, 500)] + "".join(rng.choice("uvw") for _ in range(rng.randrange(200)))))
    rows += [(100, "q" * 700), (101, "ab" * 300), (102, base[:100]), (103, None), (104, "")]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs(spark, rows), span=100).collect()}
    for (d, _), (n, gone, kept) in zip(rows, repeats_by_brute_force([(t or "").encode() for _, t in rows], 100), strict=True):
        assert (got[d]["n_bytes"], got[d]["n_removed"], bytes(got[d]["kept"])) == (n, gone, kept)
        assert all(a["high"] < b["low"] for a, b in zip(got[d]["spans"], got[d]["spans"][1:]))


def test_repeats_around_a_crowded_gram(spark, monkeypatch):
    """Copies that end anywhere around a phrase that many texts hold, and how much is looked at where the phrase is all they share."""
    from quillspark.llm import _stage

    looked: list[int] = []

    def save(self, df, name, save=_stage.Stage.save):
        out = save(self, df, name)
        if name not in ("runs", "different", "found"):  # of crowded grams only
            lists = [f"size({c})" for c, kind in out.dtypes if kind.startswith("array")]
            looked.append(int(out.selectExpr(f"sum({lists[0] if lists else 1}) as n").first()["n"] or 0))
        return out

    monkeypatch.setattr(_stage.Stage, "save", save)
    rng = random.Random(31)
    noise = lambda n, letters="abcdefgh": "".join(rng.choice(letters) for _ in range(n))
    phrase = noise(360, "ABCDEFGH")
    rows = [(k, noise(500) + phrase + noise(500)) for k in range(300)]
    assert sum(r["n_removed"] for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()) == 0
    assert looked and max(looked) < 30 * len(rows)
    before, after = [noise(400) for _ in range(3)], [noise(400) for _ in range(3)]
    for k in range(300, 600):
        a, b = rng.randrange(400), rng.randrange(60) if k % 3 else rng.randrange(400)
        rows.append((k, noise(30 + k % 7) + rng.choice(before)[a:] + phrase + rng.choice(after)[:b] + noise(30 + k % 5)))
    rows += [(1000 + k, rows[500][1]) for k in range(3)] + [(1010, rows[501][1][7:]), (1011, rows[502][1][:-31])]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()}
    want = repeats_by_brute_force([t.encode() for _, t in rows], 400)
    for (d, _), (n, gone, kept) in zip(rows, want, strict=True):
        assert (got[d]["n_bytes"], got[d]["n_removed"], bytes(got[d]["kept"])) == (n, gone, kept), d
    assert 100 < sum(0 < gone < n for n, gone, _ in want)


def test_repeats_awkward(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 100_000)
    got = suffix_dedup.remove_repeats(docs(spark, AWKWARD), carry=("lang", "n_chars")).collect()
    assert len(got) == len(AWKWARD)
    gone = {r["doc_id"]: r["n_removed"] for r in got}
    assert gone[5] == len(LONG) and gone[6] == len(LONG) and gone[7] == 5000 and gone[4] == 0 and gone[1] == 0
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_front_coding_and_merge():
    rng = random.Random(4)
    entries = [(bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))), bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))), k, 0, 1, 1) for k in range(300)]
    runs = [sorted(entries[k::7]) for k in range(7)]
    packed = [suffix_dedup.write_run(r) for r in runs] + [b""]
    assert [e for _, e in suffix_dedup.read_run(packed[0])] == runs[0]
    merged = list(suffix_dedup.merge_runs(packed))
    assert [e[0] for _, e in merged] == sorted(e[0] for e in entries)
    before = b""
    for same, e in merged:
        assert same == suffix_dedup.common(before, e[0])
        before = e[0]


def test_repeated_words_in_pipeline(spark):
    import corpus_pipeline

    rng = random.Random(18)
    count = iter(range(10**6))
    own = lambda n: " ".join(f"u{next(count)}" for _ in range(n))
    short = " ".join(rng.choice("abcdefghij") for _ in range(51))  # 101 bytes
    usual = " ".join(rng.choice(["house", "garden", "of", "river"]) + str(k) for k in range(51))
    under = " ".join(f"v{k}" for k in range(50))
    shared = {0: short, 1: short.upper().replace(" ", "\n"), 2: usual, 3: usual, 4: under, 5: under, 6: "z" * 450, 7: "z" * 450, 8: usual + " " + under, 9: None}
    rows = []
    for d, x in shared.items():
        a, b = own(20 + d), own(30)
        rows.append((d, None if x is None else f"{a} {x} {b}", "en", "s", 1, f"{a}  {b}" if d not in (4, 5, 6, 7, 8) else f"{a} {x} {b}" if d in (4, 5) else f"{a}  {under} {b}" if d == 8 else None))
    made = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.repeated_passages(spark, made, SF).collect()}
    assert len(got) == len(rows) and got[9]["text"] == ""
    for d, *_, want in rows[:9]:
        assert "z" not in got[d]["text"] if want is None else got[d]["text"] == want, d
        assert got[d]["n_chars"] == len(got[d]["text"])


def repeated_words_by_brute_force(rows, n):
    split = {d: (t or "").encode().lower().split() for d, t in rows}
    seen = collections.Counter(tuple(w[i : i + n]) for w in split.values() for i in range(len(w) - n + 1))
    return {d: {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)} for d, w in split.items()}


def test_repeated_words(spark):
    from quillspark.llm._stage import Stage

    rows = texts(200) + [(10_000 + k, t) for k, (_, t) in enumerate(AWKWARD)]
    plain = docs(spark, rows).select("doc_id", F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    got = collections.defaultdict(set)
    for r in suffix_dedup.repeated_words(plain, 12, Stage(spark, "test-words")).collect():
        got[r["doc_id"]].update(range(r["low"], r["high"]))
    assert got == {d: w for d, w in repeated_words_by_brute_force(rows, 12).items() if w}


# ---------------------------------------------------------------- 9


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 64))
    v = np.vstack([rng.standard_normal((300, 64)), *[b + rng.standard_normal((12, 64)) * 0.25 for b in base]]).astype(np.float32)
    v = np.vstack([v, v[:20], v[:5] * 2])
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(9000, None), (9001, [0.0] * 64), (9002, [float("nan")] * 64), (9003, []), (9004, [None] * 64), (9005, [1.0] * 3)]
    got = {r["vec_id"]: r for r in itq.near_vectors(spark.createDataFrame([(*r, None, None) for r in rows], "vec_id long, embedding array<float>, v int, copies string")).collect()}
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    assert len(got) == len(rows)
    found = sum(got[k]["n_links"] for k in range(len(v)))
    assert near.sum() * 0.97 <= found <= near.sum()
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(9000, 9006))
    assert got[len(v) - 5]["component_id"] == got[0]["component_id"]
    assert itq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_near_vectors_of_other_lengths_and_sizes(spark):
    rng = np.random.default_rng(23)
    a, b = rng.standard_normal(64), rng.standard_normal(5)
    rows = [(1, a), (2, a * 1e200), (3, a * 1e-200), (4, rng.standard_normal(64)), (5, b), (6, b), (7, b * 3), (8, b + 0.01), (9, [2.0]), (10, [3.0]), (11, [-1.0]), (12, a * 1e-320), (None, b), (13, -a)]
    made = spark.createDataFrame([(d, [float(x) for x in v]) for d, v in rows], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in itq.near_vectors(made).collect()}
    assert got[1][1:] == (1, True) and got[2][1:] == (1, False) and got[3][1:] == (1, False) and got[4] == (0, 4, True) and got[13] == (0, 13, True)
    assert [got[d] for d in (5, 6, 7, 8, None)] == [(4, 5, d == 5) for d in (5, 6, 7, 8, None)]
    assert got[9] == (1, 9, True) and got[10] == (1, 9, False) and got[11] == (0, 11, True)


@pytest.mark.parametrize("width", [21, 32])
def test_wide_substrings_lose_no_links(spark, width):
    rng = np.random.default_rng(15)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1500, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    v = np.vstack([a, 0.901 * a + np.sqrt(1 - 0.901**2) * b])
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert sum(r["n_links"] for r in itq.near_vectors(table, width=width).collect()) >= 2 * 1500 * 0.99


def test_vectors_in_many_buckets_lose_no_links(spark, monkeypatch):
    monkeypatch.setattr(itq, "BUCKET", 100)
    monkeypatch.setattr(itq, "PAIRS", 50)
    rng = np.random.default_rng(16)
    a = rng.standard_normal((1500, 64))
    v = np.vstack([a, a + 0.45 * rng.standard_normal(a.shape)])
    u = itq.units(v)
    near = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert itq.prefix_bits(3000) == 5 and near.sum() > 1000
    assert near.sum() * 0.99 <= sum(r["n_links"] for r in itq.near_vectors(table).collect()) <= near.sum()


@pytest.mark.parametrize("width", [8, 30])
def test_meetings_are_all_pairs_within_two_bits(width):
    rng = np.random.default_rng(17)
    sub = np.sort(np.concatenate([rng.integers(0, 256, 60), rng.integers(0, 1 << width, 40)]))
    got = [(int(i), int(j)) for x, y in itq.meetings(sub, width) for i, j in zip(x, y, strict=True)]
    want = {(i, j) for i in range(100) for j in range(i) if (int(sub[i]) ^ int(sub[j])).bit_count() <= 2}
    assert len(got) == len(want) and {(max(p), min(p)) for p in got} == want


def test_near_vectors_are_joined_without_the_driver(spark):
    table = spark.createDataFrame([(k, [float(k % 7 + 1), 1.0, float(k)]) for k in range(40)], "vec_id long, embedding array<double>")
    plan = itq.near_vectors(table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_recall_does_not_fall_with_size():
    for n in (2, 1000, 10**5, 10**6, 10**7, 10**9):
        tables = itq.substrings(n, 0.9)
        flip, w = itq.flipped(0.9), tables[0][1]
        assert all(low % 64 + w <= 64 for low, _ in tables)
        p = sum(math.comb(w, k) * flip**k * (1 - flip) ** (w - k) for k in range(3))
        assert 1 - (1 - p) ** len(tables) >= 0.999


# ---------------------------------------------------------------- 1


def test_lm_scores(spark):
    rows = texts(120) + [(900 + k, t) for k, (_, t) in enumerate(AWKWARD)]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = {r["doc_id"]: r for r in lm_scoring.score(docs(spark, rows), held).collect()}
    assert len(got) == len(rows)
    counts, tokens = collections.Counter(), {}
    for d, t in rows:
        tokens[d] = [*(t or "").encode().lower().split(), None]
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(tokens[d])
    n, v = sum(counts.values()), len(counts)
    for d, words in tokens.items():
        r = got[d]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["n_known"] == sum(counts[w] > 0 for w in words) and r["n_tokens"] == len(words) and r["train_tokens"] == n
        assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(d).encode()) % 7 == 2)
    held_out = [r for r in got.values() if r["held_out"] and r["n_tokens"] > 50]
    assert sum(r["bits_per_byte"] for r in held_out) / len(held_out) < 3.2
    assert lm_scoring.score(docs(spark, []), held).count() == 0


def random_mixer():
    rng = np.random.default_rng(6)
    return lm_scoring.Mixer(rng.integers(0, 5, (int(lm_scoring._OFFSETS[-1]), 2)))


def test_lm_probabilities_add_up():
    mixer = random_mixer()
    # all bytes after one prefix: the 256 words x + byte share their first decisions, so the probabilities of their second bytes sum to one
    words = [b"x" + bytes([b]) for b in range(256)]
    spelling = lm_scoring.Spelling(words, np.zeros(256, np.int64), np.zeros(256, bool))
    every = slice(0, len(spelling.place))
    p = 1 / (1 + np.exp(-mixer.mix(*mixer.inputs(spelling, every)).astype(np.float64)))
    p = np.where(spelling.bits == 1, p, 1 - p).prod(0)
    assert p[spelling.place == 1].sum() == pytest.approx(1.0, abs=1e-5) and (spelling.place == 1).sum() == 256 and spelling.weight[spelling.place == 0].tolist() == [256]


def test_lm_shared_beginnings_change_nothing():
    rng = random.Random(20)
    words = list({"".join(rng.choice("abé") for _ in range(rng.randrange(0, 9))).encode() for _ in range(400)}) + [b"z" * 200, b"z" * 200 + b"a", b"z" * 70]
    marks, counted = np.array([rng.randrange(3) for _ in words]), np.array([rng.random() < 0.5 for _ in words])
    mixer = random_mixer()
    whole = mixer.log10(words, marks, counted)
    assert whole == pytest.approx([mixer.log10([w], marks[k : k + 1], counted[k : k + 1])[0] for k, w in enumerate(words)], abs=1e-4)
    assert lm_scoring.Spelling(words, marks, counted).weight.sum() == sum(len(w) + 1 for w in words)


def test_lm_packed_arrays():
    rng = np.random.default_rng(21)
    some = [rng.integers(0, 9, 5).astype(np.uint8), rng.integers(-9, 1 << 60, 7), np.zeros(0, np.float32)]
    for x, y in zip(some, lm_scoring.unpack(lm_scoring.pack(*some), "u1", "i8", "f4"), strict=True):
        assert (x == y).all() and x.dtype == y.dtype


def test_lm_runs_before():
    rng = random.Random(22)
    seen, start = [rng.random() < 0.6 for _ in range(300)], sorted({0, *rng.sample(range(300), 20)})
    want = []
    for k in range(300):
        n, j = 0, k
        while j not in start and seen[j - 1]:
            n, j = n + 1, j - 1
        want.append(n)
    assert lm_scoring.runs(np.array(seen), np.array(start)).tolist() == want


def test_lm_scores_by_brute_force(spark, monkeypatch):
    """Counts by dictionaries, occurrence by occurrence; only the spelling and the learned map are the operator's own."""
    monkeypatch.setattr(lm_scoring, "GROUP", 60_000)  # several groups
    rows = [*texts(60), (500, texts(1)[0][1]), (501, None), (502, "one"), (503, "one two one two one"), (504, texts(2)[1][1])]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    df, model = lm_scoring.fit_and_score(docs(spark, rows), held)
    got = {r["doc_id"]: r["score"] for r in df.collect()}
    split, mark, learned = {}, {}, {}
    for d, t in rows:
        raw = (t or "").encode()
        split[d] = [*raw.lower().split(), None]
        mark[d] = int(lm_scoring.markers(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])
        learned[d] = zlib.crc32(str(d).encode()) % 7 != 2
    one, of, after = collections.Counter(), collections.Counter(), collections.defaultdict(collections.Counter)
    pairs = lambda w: list(zip([("", ""), *(("", x) for x in w[:1]), *zip(w, w[1:])], w))
    for d, w in split.items():
        if learned[d]:
            one.update((mark[d], x) for x in w)
            of[mark[d]] += len(w)
            for context, x in pairs(w):
                after[context][x] += 1
    for m in set(mark.values()):
        assert model.totals.by[m] == of[m] and model.totals.unknown[m] == pytest.approx((sum(n == 1 for (k, _), n in one.items() if k == m) + 0.5) / (of[m] + 1))
    for d, w in split.items():
        own, m, total, run = int(learned[d]), mark[d], -lm_scoring.MARKER_COST, 0
        for context, x in pairs(w):
            n, hits = sum(after[context].values()) - own, after[context][x] - own
            kinds = len(after[context]) - (own and hits == 0)
            if n > 0:
                bucket = lambda v, top: min(top - 1, math.ceil(math.log2(v + 1)))
                cell = ((bucket(n, 8) * 6 + bucket(kinds, 6)) * 8 + bucket(run, 8)) * 2 + (hits > 0)
                total += model.answers[cell]
            if n > 0 and hits > 0:
                total, run = total + math.log10(hits / n), run + 1
                continue
            run = 0
            c = one[m, x] - own
            unknown = model.totals.unknown[m]
            if c > 0:
                total += math.log10((1 - unknown) * c / (of[m] - own))
            else:
                counted = one[m, x] > 0
                total += math.log10(unknown) + model.mixer.log10([x or b""], np.array([m]), np.array([counted]))[0]
        assert got[d] == pytest.approx(total, rel=1e-4, abs=1e-3), d


def test_lm_predecessors_with_many_successors_are_asked():
    few, many = (np.uint64(c) << np.uint64(lm_scoring.NEXT_BITS) for c in (3, 5))
    keys = np.concatenate([few + np.arange(2, dtype=np.uint64), many + np.arange(3000, dtype=np.uint64)])
    times = np.where(np.arange(3002) % 2 == 0, 2, 1).astype(np.uint32)
    part = (0, 7, lm_scoring.pack(np.diff(keys, prepend=np.uint64(0)), times))
    (answer,) = lm_scoring._successors(iter([lm_scoring._parts([part])]))
    m, n, d = lm_scoring.unpack(answer.column(3)[0].as_py(), "u4", "u4", "u4")
    assert m.tolist() == times.tolist()
    assert n.tolist() == [3] * 2 + [4500] * 3000 and d.tolist() == [2] * 2 + [3000] * 3000


def test_lm_texts_that_occur_twice_score_apart(spark):
    rng = random.Random(25)
    rows = [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(60))) for k in range(200)]
    rows = [*rows, *((1000 + d, t) for d, t in rows[:20])]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_scoring.score(docs(spark, rows), F.lit(False)).collect()}
    twice = {d for d, _ in rows[:20]} | {1000 + d for d, _ in rows[:20]}
    assert min(got[d] for d in twice) > max(v for d, v in got.items() if d not in twice)


# ---------------------------------------------------------------- 2


def test_matcher_is_one_edit():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words, stems = ["idiot", "scum", "moron"], ["lowei", "vequ"]
    m = toxicity.Matcher(words, stems)
    rng = random.Random(7)
    for _ in range(3000):
        w = "".join(rng.choice("idotmrnlweivqu") for _ in range(rng.randrange(1, 9)))
        if rng.random() < 0.5:
            w = rng.choice(words + stems)
            k = rng.randrange(len(w) + 1)
            w = w[:k] + rng.choice(["", "x", "d"]) + w[k + rng.randrange(2) :]
        want = {}
        for k, e in enumerate(m.entries):
            allowed = 1 if len(e) >= 5 else 0
            best = edits(w, e) if k < len(words) else min(edits(w[:n], e) for n in range(len(w) + 1))
            if best <= allowed:
                want[k] = best
        assert dict(m.match(w)) == want


def test_toxicity(spark):
    rng = random.Random(8)
    clean = [" ".join(rng.choice(["the", "house", "green", "walks", "slowly", "river"]) for _ in range(40)) for _ in range(300)]
    rows = [(k, t if k % 5 else t + " you stupid idiot moron") for k, t in enumerate(clean)]
    model = toxicity.train(spark.createDataFrame([(t, 0 if d % 5 else 1) for d, t in rows], "text string, toxic int"))
    tests = [(1, "what a stupid idiot moron you are"), (2, "a stupd idiott moronn walks"), (3, "green river walks slowly"), (4, None), (5, ""), (6, LONG)]
    got = {r["doc_id"]: r for r in toxicity.score(docs(spark, tests), model).collect()}
    assert got[1]["predicted"] == 1 and got[2]["score"] > got[3]["score"] and got[3]["predicted"] == 0 and got[4]["predicted"] == 0 and got[4]["score"] == got[5]["score"]
    assert model.score('he said "idiot" about the river')[0] < model.score("the idiot about the river")[0]
    assert toxicity.score(docs(spark, []), toxicity.train(spark.createDataFrame([], "text string, toxic int"))).count() == 0
    assert toxicity.score(docs(spark, AWKWARD), model).count() == len(AWKWARD)


# ---------------------------------------------------------------- 3

SCHEMA = {"f": {"q": {"type": "string", "required": True, "max": 6}, "x": {"type": "integer", "min": 0, "max": 10}}}


def test_tool_calls(spark):
    calls = [("a", None, "f", '{"x":1,"q":"hello"}'), ("b", "a", "f", '{"q":5}'), ("c", "b", "g", "{}"), ("d", "e", "f", '{"q":"a","x":99,"u":1}'), ("e", "d", "f", "bad"), (None, None, "f", "[1]"), ("b", "zz", "f", '{"q":"toolong"}'), ("h", "c", None, None)]
    made = spark.createDataFrame([(*c, "x", 1) for c in calls], "call_id string, after string, name string, arguments string, message string, depth int")
    results = spark.createDataFrame([("a", "ok"), ("a", "also"), ("b", None), ("zz", "x"), (None, "y")], "call_id string, content string")
    got = [r.asDict() for r in tool_calls.link(made, results, SCHEMA).collect()]
    assert len(got) == len(calls)
    by = {(r["call_id"], r["arguments"]): r for r in got}
    assert by["a", calls[0][3]]["message"] == '{"arguments":{"q":"hello","x":1},"call_id":"a","depth":0,"name":"f","result":"also"}'
    assert [by[c[0], c[3]]["depth"] for c in calls] == [0, 1, 2, None, None, None, 1, 3]
    assert [by[c[0], c[3]]["errors"] for c in calls] == ["", "q:type", "tool", "u:unknown,x:range", "json", "json", "q:range", "json"]
    assert by["a", calls[0][3]]["n_results"] == 2 and by["b", calls[1][3]]["n_calls"] == 2
    assert all(json.loads(r["message"]) for r in got if r["call_id"])
    assert tool_calls.link(made.where("false"), results.where("false"), SCHEMA).count() == 0


def test_long_chain(spark):
    n = 3000
    calls = spark.range(n).select(F.col("id").cast("string").alias("call_id"), (F.col("id") - 1).cast("string").alias("after"), F.lit("f").alias("name"), F.lit('{"q":"a"}').alias("arguments"))
    out = tool_calls.link(calls, spark.createDataFrame([], "call_id string, content string"), SCHEMA)
    assert out.where(F.col("depth") != F.col("call_id").cast("long")).count() == 0 and out.agg(F.max("depth")).first()[0] == n - 1


# ---------------------------------------------------------------- 4


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    rows = texts(100) + [(900 + k, t) for k, (_, t) in enumerate(AWKWARD)] + [(950, "don't <|endoftext|> ΑΣ İ x\ty\x0b½ á")]
    got = [r.asDict() for r in packing.pack(docs(spark, rows), capacity=512).collect()]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for d, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by[d], key=lambda r: r["piece"])
        assert [(p["start"], p["length"], p["ids_crc32"]) for p in pieces] == [(k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes())) for k in range(0, len(ids), 512)]
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 512) + 1
    assert packing.pack(docs(spark, [])).count() == 0


def test_exchange_between_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 100)
    rng = random.Random(9)
    rows = [(k, " ".join(["a"] * rng.randrange(1, 99))) for k in range(400)]
    got = [r.asDict() for r in packing.pack(docs(spark, rows), capacity=100).collect()]
    assert len(got) == 400 and len({(r["sequence_id"], r["offset"]) for r in got}) == 400
    used = collections.Counter()
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 100
    whole, _, left = packing.best_fit_decreasing(np.array([r["length"] for r in got]), 100)
    assert len(used) <= len(left) * 1.03 + 1


def test_lower_bound_holds():
    rng = np.random.default_rng(10)
    for _ in range(200):
        sizes = rng.integers(1, 21, rng.integers(1, 9))
        bound = packing.lower_bound(sizes, 20)

        def fewest(items, rooms):
            if not items:
                return len(rooms)
            best, tried = 99, set()
            for k, room in enumerate(rooms):
                if room >= items[0] and room not in tried:
                    tried.add(room)
                    best = min(best, fewest(items[1:], rooms[:k] + [room - items[0]] + rooms[k + 1 :]))
            return min(best, fewest(items[1:], [*rooms, 20 - items[0]])) if len(rooms) < 8 else best

        assert bound <= fewest(sorted(sizes.tolist(), reverse=True), []) <= len(packing.best_fit_decreasing(sizes, 20)[2])


# ---------------------------------------------------------------- 5


def align_by_brute_force(item, text):
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == text[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    rng = np.random.default_rng(11)
    for _ in range(200):
        item, text = rng.integers(0, 5, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 20)).astype(np.uint64)
        score, low, high = decontamination.align(item, text)
        assert score == align_by_brute_force(item.tolist(), text.tolist()) and 0 <= low <= high <= len(text)


def test_leaks(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(k, " ".join(word() for _ in range(30))) for k in range(20)] + [(90, None), (91, "too short"), (92, ""), (93, "single"), (None, "x y z")]
    rows = []
    for k in range(120):
        filler = lambda n: [word() for _ in range(n)]
        body = filler(60)
        if k % 3 == 0:
            body += [w if rng.random() > 0.15 else word() for w in items[k % 20][1].split()]
        rows.append((k, ", ".join([*body, *filler(20)]).upper()))
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(docs(spark, rows + AWKWARD), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t in rows:
        words = re.findall(r"[0-9a-z]+", t.lower())
        for k, i in items[:20]:
            if align_by_brute_force(i.split(), words) >= len(i.split()):
                want.add((d, k))
    assert set(got) == want and len(want) >= 40
    short = [(700, "it is Too, short!"), (701, "too long and short"), (702, "a single one"), (703, "single too short")]
    found = {(r["doc_id"], r["item_id"], r["score"], r["first_word"]) for r in decontamination.leaks(docs(spark, short), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(700, 91, 1.0, 2), (702, 93, 1.0, 1), (703, 93, 1.0, 0), (703, 91, 1.0, 1)}
    assert all(60 <= r["first_word"] + 2 and r["last_word"] <= 92 for r in got.values())
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(docs(spark, rows), empty).count() == 0
    assert decontamination.leaks(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize(("n", "edits"), [(20, 3), (30, 5), (38, 6)])
def test_leaks_of_a_group_with_the_same_edits(spark, n, edits):
    words = [f"i{k}" for k in range(n)]
    changed = list(words)
    for k in range(edits):
        changed[(k + 1) * n // (edits + 1)] = f"new{k}"
    rows = [(0, " ".join(words)), *((k, f"before{k} {' '.join(changed)} after{k}") for k in range(1, 101))]
    rows += [(200 + k, " ".join(words[: n // 2 + 4])) for k in range(30)] + [(300, " ".join(words[n // 2 - 4 :]))]
    got = decontamination.leaks(docs(spark, rows), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in rows}


# ---------------------------------------------------------------- 6


def test_languages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(table.where("doc_id % 4 <> 2"))
    held = table.where("doc_id % 4 = 2")
    got = langid.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got) and len(got) >= 40
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs(spark, AWKWARD), model).collect()}
    assert odd[1] == odd[2] == odd[3] == "und" and odd[4] in model.languages and len(langid.identify(docs(spark, AWKWARD), model).collect()) == len(AWKWARD)
    none = langid.train(docs(spark, []))
    assert {r["lang_pred"] for r in langid.identify(docs(spark, AWKWARD), none).collect()} == {"und"}
    assert langid.keep_known(docs(spark, AWKWARD), none).count() == 0 and langid.identify(docs(spark, []), model).count() == 0
    # what is in no language goes, the rest stays
    rng = random.Random(24)
    noise = ["".join(chr(rng.randrange(33, 127)) for _ in range(300)), "".join(rng.choice("qxzjkvw0123456789#$%") for _ in range(400))]
    rows = [*texts(200), *((9000 + k, t) for k, t in enumerate(noise))]
    kept = {r["doc_id"] for r in langid.keep_known(docs(spark, rows), model).collect()}
    assert kept == {d for d, t in rows if d < 9000 and t and any(c.isalpha() for c in t)}


def test_code_lengths_are_of_bytes(spark):
    """The probabilities of all bytes that folding leaves apart add up to one in every language and after every context."""
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    alone = [b for b in range(256) if not (65 <= b <= 90 or 9 <= b <= 13)]
    for before in (b"", b"th", b"\xc3\xbc\xe9", b"qqq"):
        texts = [before + bytes([b]) for b in alone]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        nats = model.nats(np.frombuffer(b"".join(texts), np.uint8), at)
        if before:
            nats = nats - model.nats(np.frombuffer(before, np.uint8), np.array([0, len(before)]))
        assert np.exp(-nats).sum(0) == pytest.approx(np.ones(len(model.languages)), abs=1e-3)
    assert np.exp(-model.plain_nats(np.array(alone, np.uint8), np.arange(len(alone) + 1))).sum() == pytest.approx(1, abs=1e-4)


def test_a_language_of_one_long_text_is_learned(spark):
    rows = [("en", f"the house and the river number {k}") for k in range(50)] + [("xx", "zug krk dro " * 3000)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"), 300)
    assert langid.identify(docs(spark, [(1, "krk zug dro")]), model).first()["lang_pred"] == "xx"


def test_escapes_add_up():
    rng = np.random.default_rng(13)
    n = rng.integers(0, 4, (50, 64)) * (rng.random((50, 64)) < 0.2)
    lower = rng.dirichlet(np.ones(64), 50)
    assert np.allclose(langid._escape(n, lower).sum(1), 1)


def test_all_languages_are_learned(spark):
    rng = random.Random(17)
    rows = []
    for k in range(40):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        rows += [(100 * k + j, " ".join(rng.choices(own, k=30 + k)), f"l{k:02}") for j in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table.where("doc_id % 100 < 5"))
    assert len(model.languages) == 40
    got = langid.identify(table.where("doc_id % 100 = 5"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {100 * k + 5: f"l{k:02}" for k in range(40)}


# ---------------------------------------------------------------- 7


def test_licences(spark):
    rows = [
        (1, "x\nThis work is licensed under the GNU General Public License, version 3.\ny"), (2, "MIT\nLicense and the mit, license"), (3, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files (the"),
        (4, "released under the licence"), (5, "apache licenses; cc bye"), (6, None), (7, "Licensed under CC BY-NC 4.0."),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"], got[1]["n_words"]) == (1, 7, "gpl", 14)
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 0, 4)
    assert got[3]["labels"] == "mit" and got[3]["base_labels"] == "" and 0.9 <= got[3]["score"] <= 1
    assert got[4]["labels"] == "" and got[5]["n_base"] == 0 and got[6]["n_words"] == 0 and got[6]["first_word"] is None and got[7]["labels"] == "cc-by,cc-by-nc"
    assert licenses.scan(docs(spark, AWKWARD)).count() == len(AWKWARD) and licenses.scan(docs(spark, [])).count() == 0


def test_licences_over_many_lines(spark):
    import textwrap

    rows, want = [], {}
    for label, some in licenses.TEMPLATES.items():
        for text in some:
            for form in (textwrap.fill(text, 30), textwrap.fill(text, 40), "\n\n".join(textwrap.wrap(text, 30)), text.replace(" ", "\n"), "# " + text.replace(" ", "\n# ")):
                rows.append((len(rows), "some words before\n" + form + "\nand after"))
                want[len(rows) - 1] = label
    scattered = " far ".join(w + " off" * 30 for w in licenses.TEMPLATES["mit"][1].split())
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, [*rows, (9999, scattered.replace(" ", "\n"))]), phrases={}).collect()}
    assert all(label in got[d]["labels"].split(",") and got[d]["score"] == 1 for d, label in want.items())
    assert got[9999]["labels"] == ""
    far = " ".join(w + " far off" * 9 for w in "licensed under cc by 4.0".split())
    assert {r["labels"] for r in licenses.scan(docs(spark, [(1, far), (2, far.replace(" ", "\n"))])).collect()} == {""}


def test_passages_are_exact():
    rng = random.Random(16)
    words = [f"t{k}" for k in range(40)]
    given = {f"l{k}": [" ".join(rng.sample(words, rng.randrange(3, 12)))] for k in range(25)}
    known = licenses.Templates(given, 0.8, {w.encode(): rng.randrange(100) for w in words})
    for _ in range(300):
        text = [w.encode() for w in rng.choices([*words, *["other"] * 20], k=rng.randrange(0, 60))]
        want = {}
        for n, t in enumerate(known.words):
            best = max((len(t & set(text[a : a + known.wide[n]])) for a in range(len(text))), default=0)
            if best >= known.need[n]:
                want[n] = best / len(t)
        assert known.passages(text) == want
