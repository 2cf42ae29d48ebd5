"""The registered queries against a plain Python of what each has to return, on the smallest tables, and the pipeline stage by stage."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from quillspark.llm import itq, minmax, packing, queries

SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def documents():
    return [(r["doc_id"], r["text"]) for r in rows("documents")]


def by_id(df):
    got = df.collect()
    out = {r["doc_id"]: r for r in got}
    assert len(out) == len(got)
    return out


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op1(spark, documents):
    got = by_id(queries.op1_lm_scoring(spark, SF))
    counts, tokens = collections.Counter(), {}
    for d, t in documents:
        tokens[d] = [*re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None]
        if crc(d, 7) != 2:
            counts.update(tokens[d])
    n, v = sum(counts.values()), len(counts)
    assert set(got) == set(tokens)
    for d, words in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(d, 7) == 2, len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_op2_on_held_out_rows(spark):
    more = SF.replace("0.001", "0.1")  # the smallest tables hold too few labels to learn from
    got = by_id(queries.op2_toxicity(spark, more))
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{more}/labels.parquet").to_pylist()}
    assert set(got) == set(pq.read_table(f"{more}/documents.parquet", columns=["doc_id"]).column(0).to_pylist())
    assert all(r["held_out"] == (crc(d, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    held = [(r["score"], labels[d]) for d, r in got.items() if r["held_out"] and labels.get(d) is not None]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) >= 0.9 and len(bad) > 10
    assert sum(s >= 0.3 for s in bad) >= 0.8 * len(bad) and sum(s < 0.3 for s in good) >= 0.9 * len(good)


def test_op3_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op3_tool_calls"]).fetchall()
    names = [c[0] for c in con.description]
    got = [tuple(r[n] for n in names) for r in queries.op3_tool_calls(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 20


def test_op3_keeps_missing_identifiers_apart(spark, tmp_path):
    made = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, 0, "user", None), (2, None, "user", "z"), (None, None, "user", None), (1, 2, "user", "c"), (1, 0, "user", "again")]
    spark.createDataFrame(made, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL["op3_tool_calls"]).fetchall()
    names = [c[0] for c in con.description]
    out = queries.op3_tool_calls(spark, str(tmp_path))
    got = [tuple(r[n] for n in names) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 7
    lost = [r for r in out.collect() if r["conv_id"] is None or r["turn"] is None]
    assert len(lost) == 4 and all(r["call_id"] is None and r["depth"] is None and r["n_results"] == 0 for r in lost)


def test_op4(spark, documents):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d, text in documents:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(d, k): (2048 * k, len(ids[2048 * k : 2048 * k + 2048]), zlib.crc32(ids[2048 * k : 2048 * k + 2048].tobytes())) for k in range(-(-len(ids) // 2048))}
    df = queries.op4_best_fit_packing(spark, SF)
    got = df.collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in bins.values():
        ends = [0]
        for offset, length in sorted(some):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    used, bound = packing.certificate(df)
    assert used == len(bins) and bound <= used <= bound + 1


def test_certificate_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 300)
    made = [(k, "a " * (40 + (k * 7919) % 700)) for k in range(2500)]
    df = packing.pack(spark.createDataFrame(made, "doc_id long, text string"), capacity=512)
    used, bound = packing.certificate(df, 512)
    assert bound <= used <= 1.02 * bound + 1 and df.selectExpr("sum(length)").first()[0] == sum(len(t.split()) + 1 for _, t in made)


def test_op5(spark, documents):
    fold = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    items = {r["item_id"]: fold(r["text"]) for r in rows("benchmark")}
    got = collections.defaultdict(set)
    for r in queries.op5_decontamination(spark, SF).collect():
        got[r["doc_id"]].add(r["item_id"])
        assert 0.5 <= r["score"] <= 1
    place = collections.defaultdict(set)
    for k, words in items.items():
        for j in range(len(words) - 2):
            place[tuple(words[j : j + 3])].add(k)
    for d, t in documents:  # every document and item that share a seed, aligned in full
        words = fold(t)
        near = {k for j in range(len(words) - 2) for k in place.get(tuple(words[j : j + 3]), ())}
        assert got[d] == {k for k in near if best_alignment(items[k], words) >= len(items[k])}, d
    assert sum(map(len, got.values())) >= 3


def best_alignment(item, text):
    ids = {w: k for k, w in enumerate(dict.fromkeys([*item, *text]))}
    a, b = np.array([ids[w] for w in item]), np.array([ids[w] for w in text])
    above, best = np.zeros(len(b) + 1, int), 0
    for x in a:
        row = np.zeros(len(b) + 1, int)
        diagonal = above[:-1] + np.where(b == x, 2, -1)
        for j in range(1, len(b) + 1):
            row[j] = max(0, diagonal[j - 1], above[j] - 1, row[j - 1] - 1)
        above, best = row, max(best, int(row.max()))
    return best


def test_op6_on_held_out_rows(spark):
    table = {r["doc_id"]: r for r in rows("documents")}
    got = by_id(queries.op6_ppm_langid(spark, SF))
    assert set(got) == set(table) and all(r["held_out"] == (crc(d, 4) == 2) for d, r in got.items())
    held = [d for d, r in got.items() if r["held_out"] and table[d]["lang"] is not None]
    assert sum(got[d]["lang_pred"] == table[d]["lang"] for d in held) >= 0.97 * len(held) and len(held) > 30


def test_op7(spark, documents):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = by_id(queries.op7_license_scan(spark, SF))
    for d, t in documents:
        words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        places, labels = [], set()
        for phrase, label in phrases.items():
            p = phrase.encode().split()
            found = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))), d
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))
    assert sum(r["n_base"] for r in got.values()) > 0


def test_op8(spark, documents):
    seen = collections.Counter()
    bodies = {d: (t or "").encode() for d, t in documents}
    for b in bodies.values():
        seen.update(hash(b[k : k + 400]) for k in range(len(b) - 399))
    got = by_id(queries.op8_suffix_dedup(spark, SF))
    for d, b in bodies.items():
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - 399):
            if seen[hash(b[k : k + 400])] > 1:
                gone[k : k + 400] = b"\1" * 400
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), d


def test_op9(spark):
    table = rows("embeddings")
    v = itq.units(np.array([r["embedding"] for r in table], np.float64))
    ids = [r["vec_id"] for r in table]
    near = (v @ v.T >= 0.9) & ~np.eye(len(v), dtype=bool)
    got = {r["vec_id"]: r for r in queries.op9_itq_neardup(spark, SF).collect()}
    assert set(got) == set(ids)
    found = sum(r["n_links"] for r in got.values())
    assert 0.98 * near.sum() <= found <= near.sum()
    if found == near.sum():
        parent = {d: d for d in ids}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = find(ids[i]), find(ids[j])
            parent[max(a, b)] = min(a, b)
        assert all(r["component_id"] == find(d) and r["kept"] == (find(d) == d) for d, r in got.items())


def test_op10(spark, documents):
    sets = {}
    for d, t in documents:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = by_id(queries.op10_minmax_neardup(spark, SF))
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


# ---------------------------------------------------------------- pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"stone{k % 977} river" for k in range(30_000))


def awkward():
    base = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows("documents")[:60]]
    odd = [(None, None, None, None, None), (9001, None, "en", None, 0), (9002, "", None, "s", None), (9003, " \n\t", "en", "s", 3), (9004, LONG, "en", "s", len(LONG)), (9005, LONG, "en", "s", len(LONG)), (None, base[0][1], "en", "s", 1)]
    return [*base, *odd, base[3], base[3], (base[4][0], base[5][1], "en", "s", 1)]


def test_stages_on_awkward_rows(spark):
    import corpus_pipeline as pipeline

    made = spark.createDataFrame([(*r, r[0], "x") for r in awkward()], COLUMNS + ", component long, signature string")
    empty = made.where("false")
    for name, step in pipeline.STAGES:
        out = step(spark, made, SF)
        if name == "best_fit_packing":
            assert out.count() >= len(awkward())
        else:
            assert out.columns == list(pipeline.COLUMNS), name
            ids = collections.Counter(r["doc_id"] for r in out.select("doc_id").collect())
            assert set(ids) <= {r[0] for r in awkward()}
        assert step(spark, empty, SF).count() == 0, name


def test_stages_by_plain_python(spark):
    import corpus_pipeline as pipeline

    table = rows("documents")
    made = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r["doc_id"] for r in pipeline.known_languages(spark, made, SF).collect()}
    assert known == {r["doc_id"] for r in table}  # all of them are prose
    near = pipeline.near_duplicates(spark, made, SF).collect()
    component = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(made).collect()}
    assert {r["doc_id"] for r in near} == set(component.values()) and len(near) == len(set(component.values())) < len(table)
    text = {r["doc_id"]: r["text"] for r in table}
    assert all(r["text"] == text[r["doc_id"]] for r in near)
    leaked = {r["doc_id"] for r in queries.op5_decontamination(spark, SF).collect()}
    assert {r["doc_id"] for r in pipeline.benchmark_leaks(spark, made, SF).collect()} == set(text) - leaked


def test_whole_pipeline(spark):
    import corpus_pipeline as pipeline

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, step in pipeline.STAGES:
        out = step(spark, docs, SF)
        if name != "best_fit_packing":
            docs = spark.createDataFrame(out.collect(), out.schema)
    want = {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in out.collect()}
    got = pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
