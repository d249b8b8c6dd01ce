"""Whitening, the audit of filter orders and byte-level BPE against brute force."""

import hashlib
import itertools
import random
import re
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import bpe, filter_audit, queries, whitening

SF = "/root/testdata/sf0.001"
FILE = queries.BYTE_BPE_MERGES
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(FILE)


# ------------------------------------------------------------------ BPE


def ids_of(text, encoder=None):
    data = b"".join((encoder or bpe.encoder_of(FILE)).encode(text))
    return list(struct.unpack(f"<{len(data) // 4}I", data))


ALPHABETS = ["ab", "abcde", "the quick", "' sretvmldS'", "  \n\tab\x0b\x1c\x85", "ÃÂaéí", "äöü€😀é", "<|endoftext|>x", "=-_*1２³", "a\xa0　"]


def test_encoding_is_the_library_s(library):
    rng = random.Random(1)
    texts = ["", " ", "<|endoftext|>", "x<|endoftext|>  y <|endof|> ", "it's 're''re 'r", "\x00\x1f\x7f", "a" * 3000]
    texts += ["".join(rng.choice(a) for _ in range(n)) for a in ALPHABETS for n in (1, 7, 300, 5000)]
    texts.append("".join(chr(c) for c in range(0x3200) if not 0xD800 <= c < 0xE000))
    for text in texts:
        assert ids_of(text) == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_long_words_are_streamed(library, monkeypatch):
    rng = random.Random(2)
    known = [t for t in library.get_vocab() if t.isalpha() and len(t) > 5]
    texts = ["".join(rng.choice(known) for _ in range(12_000)), "-" * 70_001, " " * 80_001 + "b", "'r" * 40_000 + "e", "ab" * 40_000]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids_of(t) for t in texts] == want
    monkeypatch.setattr(bpe, "WINDOW", 7)  # words and windows end anywhere
    monkeypatch.setattr(bpe, "STEP", 1)
    assert [ids_of(t[:3000]) for t in texts] == [library.encode(t[:3000], add_special_tokens=False).ids for t in texts]
    text = "it's we're  'r\n\n  <|endoftext|> they'll 12345678901 \t x " * 20
    assert ids_of(text) == library.encode(text, add_special_tokens=False).ids


class Small(bpe.Merges):
    """A random list of merges over a few letters."""

    def __init__(self, rng, n):
        letters = [bytes([c]) for c in b"abc"]
        made, pairs = list(letters), []
        while len(pairs) < n:
            y, s = rng.choice(made), rng.choice(made)
            if (y, s) not in pairs and len(y + s) <= 12 and y + s not in made:
                pairs.append((y, s))
                made.append(y + s)
        self.pairs, self.lookahead, self.longest = pairs, bpe.lookahead(pairs), max(map(len, made))
        number = {t: i for i, t in enumerate(made)}
        self.byte_ids = [number.get(bytes([b])) for b in range(256)]
        self.merge = {(number[y], number[s]): (r, number[y + s]) for r, (y, s) in enumerate(pairs)}


def merged_one_by_one(data, pairs):
    parts = [data[i : i + 1] for i in range(len(data))]
    for pair in pairs:  # in the order of the list, each from left to right
        i = 0
        while i + 1 < len(parts):
            if (parts[i], parts[i + 1]) == pair:
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            i += 1
    return list(map(len, parts))


def test_lookahead_is_enough():
    rng = random.Random(3)
    for _ in range(150):
        merges = Small(rng, rng.randint(1, 25))
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 120)))
        want = merged_one_by_one(data, merges.pairs)
        assert merges.merged(data)[1] == want
        # no text after a place that far can change what ends there
        ends = {*itertools.accumulate(want)}
        cut = rng.randint(0, len(data))
        for _ in range(5):
            other = data[: cut + merges.lookahead] + bytes(rng.choice(b"abc") for _ in range(30))
            assert {e for e in itertools.accumulate(merged_one_by_one(other, merges.pairs)) if e <= cut} == {e for e in ends if e <= cut} or cut + merges.lookahead > len(data)
        machine, got = bpe.Transducer(merges, step=1), []
        at = 0
        while at < len(data):
            n = rng.randint(1, 9)
            got += machine.feed(data[at : at + n])
            assert len(machine.held) <= machine.window
            at += n
        got += machine.finish()
        assert got == merges.merged(data)[0]


def test_lists_out_of_order_are_refused():
    with pytest.raises(ValueError, match="not made before"):
        bpe.lookahead([(b"ab", b"c"), (b"a", b"b")])


def test_decoding_is_the_library_s(library):
    rng = random.Random(4)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 60))]
        machine = bpe.Decoder(bpe.load(FILE))
        got = "".join(machine.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + machine.finish()
        assert got == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_awkward_rows(spark, none, library):
    rows = [(1, "one two", None, "a", 1), (None, "x", None, None, 1), (2, None, None, "a", 0), (3, "", None, "a", 0), (3, "", None, "a", 0), (4, "z" * 200_000, None, "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"ids": F.lit(1), "n_tokens": F.lit(2), "_id": F.lit(3)})
    plain, packed = bpe.encode(docs, FILE), bpe.encode(docs, FILE, packed=True)
    want = sorted([(r[0] or 0, library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows], key=str)
    assert sorted([(r.doc_id or 0, r.ids) for r in plain.collect()], key=str) == want
    assert sorted([(r.doc_id or 0, list(struct.unpack(f"<{r.n_tokens}I", r.ids))) for r in packed.collect()], key=str) == want
    for encoded in (plain, packed):
        back = bpe.decode(encoded.withColumn("text", F.lit("old")), FILE)
        assert back.columns == ["doc_id", "n_tokens", "text"]
        assert sorted([(r.doc_id or 0, r.text) for r in back.collect()], key=str) == sorted([(r[0] or 0, r[1] or "") for r in rows], key=str)
    odd = spark.createDataFrame([([464, None, 3290],), (None,), ([],)], "ids array<int>")
    assert sorted(r.text for r in bpe.decode(odd, FILE).collect()) == ["", "", library.decode([464, 3290])]
    assert bpe.encode(none, FILE).count() == 0 and bpe.decode(bpe.encode(none, FILE), FILE).count() == 0


def test_bpe_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


# ------------------------------------------------------------------ filters


def brute_failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    checks = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), re.search(r"[#$%&*|]", text))
    return sum(1 << i for i, c in enumerate(checks) if c)


LONG = " ".join(f"w{i}" for i in range(300))
AUDITED = [
    (1, LONG, None, "a", 1), (2, LONG, None, "a", 1), (2, LONG, None, "a", 1), (3, LONG, None, None, 1), (None, LONG, None, "b", 1), (4, None, None, "", 0),
    (5, "", None, "b", 0), (6, "x " * 400, None, "b", 0), (7, "A" + "b" * 49 + "B", None, "b", 0), (8, "A" + "b" * 49, None, "b", 0), (9, "50 % off", None, "a", 0),
    (10, "Éñ\x1cx\x85y " * 150, None, "a", 0), (11, "x " * 400, None, "a", 0), (2, "same id, other text", None, "a", 0), (12, "one\x0btwo\x0cthree", None, "a", 0),
]


def test_failures():
    for _, text, *_ in [*AUDITED, (0, "word " * 300_000, 0), (0, "".join(f"w{i} " for i in range(400_000)), 0), (0, "z" * 3_000_000, 0)]:
        assert filter_audit.failures(text or "") == brute_failures(text or ""), (text or "")[:30]


def brute_audit(rows, labels):
    firsts = {}
    for i, text, *_ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    failed = [(r[3] or "", brute_failures(r[1] or "") | 16 * (r[0] is not None and firsts[r[1] or ""] < r[0]), r[0]) for r in rows]
    out, removed_in_all = {}, {}
    for part in {p for p, _, _ in failed}:
        for order in itertools.permutations("ABCDE"):
            left = [(b, i) for p, b, i in failed if p == part]
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                gone = [(b, i) for b, i in left if b & bit]
                left = [(b, i) for b, i in left if not b & bit]
                all_of = [b for p, b, _ in failed if p == part]
                lost = [sum(1 for _, i in gone if any(x[k] == 1 for x in labels if x[0] == i and i is not None)) for k in (1, 2)]
                out[part, "".join(order), step] = (len(left), len(gone), sum(1 for b in all_of if b & bit) - len(gone), all_of.count(bit), *lost)
                removed_in_all[part, name] = removed_in_all.get((part, name), 0) + len(gone)
    return {k: (*v, removed_in_all[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(rows):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_audit_of_awkward_rows(spark, none):
    labels = [(2, 1, 0), (6, 0, 1), (9, 1, None), (9, None, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(AUDITED, SCHEMA).withColumns({c: F.lit(1) for c in ("bits", "n", "part", "id", "hash", "digest")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = filter_audit.audit(filter_audit.failed(docs), known).collect()
    assert as_dict(got) == brute_audit(AUDITED, labels) and len(got) == 600 * 3
    assert as_dict(filter_audit.audit(filter_audit.failed(docs)).collect()) == brute_audit(AUDITED, [])
    assert filter_audit.audit(filter_audit.failed(none), known).count() == 0


def test_audit_of_a_hot_text(spark):
    hot = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source")
    )
    got = filter_audit.failed(hot).groupBy("bits").agg(F.sum("n").alias("n")).collect()
    assert {r.bits: r.n for r in got} == {1: 2001, 17: 999}


def test_audit_query_is_its_sql(spark):
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = duck.execute(queries.ORACLES["op12_filter_audit"])
    names = [d[0] for d in cursor.description]
    got = queries.op12_filter_audit(spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cursor.fetchall())


# ------------------------------------------------------------------ whitening


def brute_whitening(x):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ q[:, :4] / np.sqrt(e[:4]), e / e.sum()


def test_whitening_query(spark):
    rows = queries.op11_whitening(spark, SF).orderBy("vec_id", "component").collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(np.array([r.embedding for r in table], float) * 256).astype(np.int64)
    n, deviation, whitened, explained = brute_whitening(x)
    got = np.array([r.whitened for r in rows]).reshape(-1, 4)
    assert {r.n for r in rows} == {n} and [r.deviation for r in rows[::4]] == deviation.tolist() and len(rows) == 4 * len(table)
    for j in range(4):
        assert min(np.abs(got[:, j] - whitened[:, j]).max(), np.abs(got[:, j] + whitened[:, j]).max()) < 1e-10
    assert np.allclose([r.explained for r in rows[:4]], explained[:4], rtol=1e-12)
    assert {r.identity_error < 1e-10 for r in rows} == {True}


RNG = np.random.default_rng(1)
SHAPES = {
    "scales": RNG.normal(size=(400, 6)) * [1e6, 1e4, 1e2, 50, 10, 3],
    "rank": np.round(RNG.normal(size=(300, 3)) * 1000) @ np.array([[1, 2, 3, 4, 5, 6], [0, 1, 0, 1, 0, 1], [2, 0, 0, 0, 0, 1]]),
    "constant": np.hstack([RNG.normal(size=(50, 2)) * 100, np.full((50, 2), 7.0)]),
    "far": 1e12 + RNG.normal(size=(300, 5)) * 100,
    "near": np.repeat(RNG.normal(size=(500, 1)) * 1e7, 5, 1) + RNG.normal(size=(500, 5)) * 3,
}


@pytest.mark.parametrize("name", SHAPES)
def test_whitening_of_columns_close_to_each_other(spark, name):
    x = np.round(SHAPES[name]).astype(np.int64)
    df = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(x)], "vec_id long, x array<long>").repartition(3)
    fitted = whitening.fit_whitening(df)[x.shape[1]]
    fit = np.unique(x, axis=0)
    centred = fit - fit[0]
    s = np.linalg.svd(centred - centred.mean(axis=0), compute_uv=False)
    want = s * s / len(fit)
    want[s <= 1e-9 * s[0]] = 0
    assert np.allclose(fitted.values, want, rtol=1e-6, atol=0)
    assert np.count_nonzero(fitted.values) == np.count_nonzero(want) and fitted.identity_error < 1e-7
    for row, exact in zip(x[:20], fitted.deviation(x[:20])):
        assert exact == min(2**63 - 1, sum((fitted.n * int(v) - t) ** 2 for v, t in zip(row, fitted.sums)))


def test_whitening_of_awkward_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [-0.0, 0.5, 9.0]), (None, [4.0, 1.0, 1.0]), (3, [2.0, 2.0, 8.0]), (4, None), (5, [None, 1.0, 2.0]),
            (6, [float("nan"), 1.0, 2.0]), (7, [float("inf"), 1.0, 2.0]), (8, []), (9, [1.0, 5.0]), (10, [1.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("n", "component", "x0", "deviation")})
    df = df.select("*", whitening.scaled(F.col("embedding")).alias("x"))
    got = whitening.whiten(df, whitening.fit_whitening(df)).collect()
    x = np.array([r[1] for r in rows[:5]]) * 256
    n, deviation, whitened, _ = brute_whitening(x.astype(np.int64))
    three = [r for r in got if r.vec_id not in (9, 10)]
    assert len(three) == 15 and {r.n for r in three} == {n} == {4}
    assert sorted(r.deviation for r in three if r.component == 1) == sorted(deviation.tolist())
    assert np.allclose(sorted(abs(r.whitened) for r in three), sorted(np.abs(whitened[:, :3]).ravel()), atol=1e-10)
    lone = [r for r in got if r.vec_id in (9, 10)]  # one distinct vector: nothing varies
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in lone] == [(1, 0, None, None, None)] * 4
    empty = df.where("vec_id > 100")
    assert whitening.whiten(empty, whitening.fit_whitening(empty)).count() == 0
    big = spark.createDataFrame([(1, [2**62, 5]), (2, [-(2**62), 7]), (3, [2**61, 5])], "vec_id long, x array<long>")
    assert {r.deviation for r in whitening.whiten(big, whitening.fit_whitening(big)).collect()} == {2**63 - 1}
