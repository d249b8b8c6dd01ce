"""The corpus operators against brute force, and on awkward tables."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioframe.llm import bpe, html_text, langid, packing, pieces, queries, simhash, substring, urlfilter, vafile, warc
from folioframe.llm.components import components
from folioframe.llm.content_sort import drop_copies, mark_copies
from folioframe.llm.html_text import extract, main_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def awkward():
    """Nulls, empties, ties, repeated rows, copies, near copies, a very long text."""
    base = " ".join(f"w{i % 37}x{i * i % 101}" for i in range(300))
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, base.replace(" ", "  "), "en", None, None), (4, base + " tail", "de", "b", 2),
        (5, "", "en", "a", 0), (6, None, None, None, None), (7, " \n\t", "en", "a", 3), (8, "A b C", "en", "a", 5), (9, "a b c", "en", "a", 5),
        (10, "one", "en", "a", 3), (11, "x " * 30_000, "en", "a", 60_000), (12, "pre fix " + base + " suf fix", "en", "a", 9), (13, base.upper(), "en", "a", 9),
        (None, base, "en", "a", 1), (20, "ein text über öl", "de", "a", 1), (20, "ein text über öl", "de", "a", 1), (21, "other text same id", "en", "z", 0), (21, base, "en", "z", 0),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names the operators use inside."""
    df = spark.createDataFrame(awkward(), SCHEMA)
    extra = {c: F.lit(7) for c in ("fp", "component_id", "_row", "_id", "_text", "kept", "_all", "cell", "bin_id", "rule", "host", "score", "count", "a")}
    return df.withColumns(extra)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ exact copies


def brute_copies(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(i)
    out = []
    for norm, members in groups.items():
        order = sorted(members, key=lambda i: (-len(rows[i][1] or ""), rows[i][0] is not None, rows[i][0] or 0))
        for i in members:
            out.append((rows[i][0], rows[order[0]][0], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return out


def test_exact_copies(spark, docs, none):
    got = mark_copies(docs).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute_copies(awkward()), key=key)
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) == {1}
    left = drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(kept)
    assert mark_copies(none).count() == 0 and drop_copies(none).count() == 0


def test_exact_copies_of_a_hot_text(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text  for all")).otherwise(F.concat(F.lit("same text for all but "), F.col("id").cast("string"))).alias("text"))
    got = mark_copies(hot).where("group_size > 1")
    assert got.agg(F.count("*"), F.min("group_size"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()[:] == (1000, 1000, 0, 1)
    assert drop_copies(hot).count() == 2001


# ------------------------------------------------------------------ near copies


def brute_fingerprint(text, k=3):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for row in awkward():
        assert simhash.fingerprint(row[1]) & (1 << 64) - 1 == brute_fingerprint(row[1])


def brute_components(fps, radius):
    up = {i: i for i in range(len(fps))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64).astype(object)
    fps = sorted({int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in rng.integers(0, 64, (12, 2))} | {0, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for blocks in (4, 6, 10):
        edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, blocks, cell_rows=4 if blocks == 4 else 4096)
        rooted = {r.node: r.root for r in components(edges).collect()}
        got = [rooted.get(f, f) for f in signed]
        want = brute_components(fps, 2)
        assert len({*zip(got, want)}) == len({*got}) == len({*want})


def test_near_groups(spark, docs, none):
    got = simhash.near_groups(docs).collect()
    rows = awkward()
    want = brute_components([brute_fingerprint(r[1]) for r in rows], 2)
    least = {}
    for r, c in zip(rows, want):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((r[0], least[c]) for r, c in zip(rows, want)), key=str)
    assert simhash.near_groups(none).count() == 0


def test_similar_texts(spark, docs, none):
    rng = np.random.default_rng(4)
    rows, near = [], []
    for d in range(60):
        w = [f"v{x}" for x in rng.integers(0, 5000, 400)]
        rows.append((3 * d, " ".join(w)))
        for at in rng.integers(0, 400, 3):
            w[at] = "changed"
        rows.append((3 * d + 1, " ".join(w)))
        near.append((3 * d, 3 * d + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert sum(got[a] == got[b] for a, b in near) >= 57
    assert len({got[a] for a, _ in near}) == 60
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and left.where("doc_id IS NULL").count() == 1
    assert simhash.drop_near_copies(none).count() == 0


def test_near_copies_go_by_row_not_by_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in "abc")
    rows = [(1, a), (5, a.replace("a77", "other")), (5, b), (5, b), (7, c), (5, c + " end"), (9, b.replace("b9", "x")), (None, a)]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, a), (5, b), (5, b), (5, c + " end"), (None, a)]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)


def shingle_set(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_similar_texts_are_those_of_brute_force(spark):
    """Pairs between 0.7 and 0.9: linked if, and only if, the shingles say so."""
    rng = np.random.default_rng(8)
    rows = []
    for d in range(300):
        w = [f"v{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((2 * d, " ".join(w)))
        for at in rng.choice(60, int(rng.integers(3, 12)), replace=False):
            w[5 * at + 2] = "changed"
        rows.append((2 * d + 1, " ".join(w)))
    sets = [shingle_set(t) for _, t in rows]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert sum(0.8 <= x < 0.85 for x in alike) > 20 and sum(0.7 < x < 0.8 for x in alike) > 20
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * d + 1] == 2 * d for d in range(300)] == [x >= 0.8 for x in alike]


def test_similar_texts_of_a_chain(spark):
    """Each text is like the next alone, so that one representative can't link them."""
    rng = np.random.default_rng(9)
    w = [f"v{x}" for x in rng.integers(0, 5000, 200)]
    rows = []
    for d in range(12):
        rows.append((d, " ".join(w)))
        w = w[15:] + [f"v{x}" for x in rng.integers(0, 5000, 15)]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 12 and {r.component_id for r in got} == {0}


def test_a_family_of_near_copies_is_no_square_of_pairs(spark, monkeypatch):
    assert max(len(i) for i, _ in simhash._linked(np.zeros(4000, np.uint64), np.zeros(4000, np.uint64), 2)) <= 1 << 20
    compared = []

    def counted(df, name, stash=simhash.stash):
        out = stash(df, name)
        compared.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(simhash, "stash", counted)
    base = [f"v{i}" for i in range(150)]
    rows = [(m, " ".join(base[: m % 140] + [f"x{m}"] + base[m % 140 :])) for m in range(1000)]
    got = simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1000 and {r.component_id for r in got} == {0}
    assert sum(compared) < 10 * len(rows)


def test_texts_around_a_common_passage_are_no_square_of_pairs(spark, monkeypatch):
    """Seven parts of ten in common: alike in many bands, but not similar. Two of them are."""
    pairs = []

    def counted(df, name, stash=simhash.stash):
        out = stash(df, name)
        pairs.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(simhash, "stash", counted)
    passage = [f"p{i}" for i in range(160)]
    rows = [(d, " ".join([*(f"a{d}x{i}" for i in range(20)), *passage, *(f"b{d}x{i}" for i in range(20))])) for d in range(400)]
    rows.append((400, rows[7][1].replace("a7x3", "changed")))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 7 if d == 400 else d for d, _ in rows} and sum(pairs) < 10 * len(rows)


def test_prefix_pairs_leave_out_no_similar_pair(spark):
    rng = np.random.default_rng(3)
    sets = []
    for d in range(120):
        base = sets[int(rng.integers(len(sets)))] if sets and rng.random() < 0.7 else set(rng.integers(0, 60, int(rng.integers(1, 50))).tolist())
        base = set(base) | set(rng.integers(0, 400, int(rng.integers(0, 6))).tolist())
        sets.append(set(list(base)[int(rng.integers(0, 3)) :]) or {1})
    rows = [(d, d, True, np.array(sorted(x), np.int64).tobytes()) for d, x in enumerate(sets)]
    got = {tuple(sorted(r)) for r in simhash.prefix_pairs(spark.createDataFrame(rows, "node long, root long, few boolean, found binary"), 0.8).collect()}
    for x, y in zip(sets, sets[1:]):
        bits = [simhash.sketch(np.array(sorted(v), np.uint64)).view(np.uint64) for v in (x, y)]
        assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(x ^ y)
    want = {(i, j) for j in range(120) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) > 30 and want <= got and len(got) < 4 * len(want)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 5), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and roots[100] == roots[101] != roots[0]


# ------------------------------------------------------------------ repeated passages


def brute_cut(rows, n=20):
    seen, out = {}, []
    for doc, text in sorted({(r[0] if r[0] is not None else -(1 << 63), r[1] or "") for r in rows}):
        w = words_of(text)
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), (doc, i))
    for r in rows:
        doc, w = r[0] if r[0] is not None else -(1 << 63), words_of(r[1])
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] < (doc, i):
                gone.update(range(i, i + n))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_repeated_passages(spark, docs, none):
    got = substring.kept_words(docs)
    assert sorted((r._doc, r.n_words, r.n_removed, r.kept) for r in got.collect()) == sorted(brute_cut(awkward()))
    cut = substring.drop_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert {r.text for r in cut.where("doc_id = 10").collect()} == {"one"}
    assert substring.kept_words(none).count() == 0 and substring.drop_repeats(none).count() == 0


def passages(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(30):
        parts = ["p" if rng.random() < 0.2 else f"u{x}" for x in rng.integers(0, 3 if seed else 40, 120)]
        if rows and rng.random() < 0.6:
            old = rows[int(rng.integers(len(rows)))][1].split()
            at = int(rng.integers(0, 60))
            parts[at:at] = old[at : at + int(rng.integers(15, 60))]
        rows.append((d, " ".join(parts)))
    return rows


def cut(spark, rows, **how):
    got = substring.kept_words(spark.createDataFrame(rows, "doc_id long, text string"), words=20, **how).collect()
    return sorted((r._doc, r.n_words, r.n_removed, r.kept) for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_passages_of_few_words(spark, seed):
    assert cut(spark, passages(seed)) == sorted(brute_cut(passages(seed)))


def test_repeated_passages_of_texts_that_go_round(spark):
    """Periods of all lengths with something else around them: the first of equal windows in a text is the one that stays."""
    rng = np.random.default_rng(11)
    rows = []
    for d in range(25):
        period = [f"w{x}" for x in rng.integers(0, 60, int(rng.integers(1, 45)))]
        rows.append((d, " ".join([*(f"a{d % 3}x{i}" for i in range(d)), *(period * 6), *(f"b{d % 4}x{i}" for i in range(9)), *period])))
    assert cut(spark, rows) == sorted(brute_cut(rows))


def test_repeated_passages_when_hashes_collide(spark, monkeypatch):
    """Sixteen bits and eight: spans of other words meet, are found out at their coordinates, and all is done again."""
    tried = []
    seen = substring._spans
    monkeypatch.setattr(substring, "_spans", lambda docs, texts, words, seed, bits: tried.append((seed, bits)) or seen(docs, texts, words, seed, bits))
    for bits in (16, 8):
        assert cut(spark, passages(0), bits=bits) == sorted(brute_cut(passages(0)))
    assert (1, 64) in tried


def test_repeated_passages_of_long_texts(spark, monkeypatch):
    """Texts that are hashed in many pieces, and repeat each other and themselves across their seams."""
    monkeypatch.setattr(substring, "_CHUNK", 500)
    rng = np.random.default_rng(5)
    a = [f"w{x}" for x in rng.integers(0, 400, 3000)]
    rows = [(1, " ".join(a)), (2, " \t ".join(a[700:2600] + [f"n{i}" for i in range(200)] + a[100:300])), (3, " ".join(a[5:400] * 3)), (3, " ".join(a[2000:]) + "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # Spark's Python workers import the module anew: the pieces are made here, as they are there
    for text in [r[1].encode() for r in rows]:
        pieces_ = [*substring._segments(text, 20)]
        assert len(pieces_) > 3 or len(text) < 1500
        whole = text.split()
        windows = [tuple(p.split()[i : i + 20]) for p, _ in pieces_ for i in range(len(p.split()) - 19)]
        assert windows == [tuple(whole[i : i + 20]) for i in range(len(whole) - 19)]
        assert all(whole[w] == p.split()[0] for p, w in pieces_)
    batch = substring.pa.RecordBatch.from_arrays([substring.pa.array([r[0] for r in rows]), substring.pa.array([r[1].encode() for r in rows])], ["_doc", "_text"])

    class Frame:
        select = lambda self, *cols: self

    monkeypatch.setattr(substring, "in_batches", lambda df, run, schema: [*run(iter([batch]))])
    cut_up = {tuple(x) for b in substring._paths(Frame(), 20, 0, 64) for x in zip(*[c.to_pylist() for c in b.columns[2:4]])}
    assert sum(r["meta"] >> 2 for b in substring._paths(Frame(), 20, 0, 64) for r in b.to_pylist()) == sum(max(0, len(r[1].split()) - 19) for r in rows)
    monkeypatch.undo()
    assert len(cut_up) > 100 and cut(spark, rows) == sorted(brute_cut(rows)) and df.count() == 4


def test_whole_passages_become_one_path(spark):
    """A passage of three hundred words in many documents is one span, not one for each of its windows."""
    rng = np.random.default_rng(6)
    passage = [f"p{x}" for x in rng.integers(0, 9999, 300)]
    rows = [(d, " ".join([*(f"a{d}x{i}" for i in range(30)), *passage, *(f"b{d}x{i}" for i in range(30))])) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"), F.lit(True).alias("_rest"))
    spans = substring._spans(docs, substring._zipped(docs), 20, 0, 64).collect()
    assert all(sum(r.n > 200 for r in spans if r.doc == d) == 1 for d in range(1, 40)) and len(spans) <= 8 * 39
    assert cut(spark, rows) == sorted(brute_cut(rows))


# ------------------------------------------------------------------ packing


def cheapest(sizes, lengths, cost):
    """Least cost of all ways to put the items into bins."""
    shrunk = lambda used: next((c for c in sorted(lengths) if c >= used), None)

    def grow(i, bins):
        if i == len(sizes):
            return sum(cost(shrunk(b)) for b in bins)
        best = grow(i + 1, [*bins, sizes[i]])
        for j in {b: j for j, b in enumerate(bins)}.values():
            if shrunk(bins[j] + sizes[i]):
                best = min(best, grow(i + 1, [b + sizes[i] * (k == j) for k, b in enumerate(bins)]))
        return best

    return grow(0, [])


def checked(sizes, lengths, cost=packing.sequence_cost):
    """A packing, after a check that its bins hold what is in them and have shrunk."""
    p = packing.best_fit(sizes, lengths, cost)
    used = {}
    for b, o, s in zip(p.bin_of, p.offset, sizes):
        assert o == used.get(b, 0)
        used[b] = o + s
    assert all(p.lengths[b] == min(c for c in lengths if c >= u) for b, u in used.items()) and len(used) == len(p.lengths)
    return p


def test_best_fit_is_near_the_cheapest_of_all_packings():
    rng = np.random.default_rng(0)
    costs = {"linear": lambda c: c + 1, "short": lambda c: c * c, "long": lambda c: c**0.5 + 2}
    ratios = []
    for _ in range(60):
        lengths = sorted(rng.choice([4, 6, 8, 12, 16], 3, replace=False).tolist())
        sizes = sorted(rng.integers(1, lengths[-1] + 1, 7).tolist(), reverse=True)
        for cost in costs.values():
            ratios.append(checked(sizes, lengths, cost).cost(cost) / cheapest(sizes, lengths, cost))
    assert min(ratios) > 1 - 1e-9 and max(ratios) < 1.5 and np.mean(ratios) < 1.03


def test_best_fit_is_no_dearer_than_any_single_length():
    rng = np.random.default_rng(1)
    lengths, better = (16, 32, 64), 0
    for k in range(30):
        sizes = sorted(np.minimum(rng.geometric(0.02 * (1 + k % 7), 300), 64).tolist(), reverse=True)
        p = checked(sizes, lengths, lambda c: c + c * c / 100)
        for one in lengths:
            other = packing._best_fit(sizes, list(lengths), lambda size, left, one=one: max(one, next(c for c in lengths if c >= size)))
            assert p.cost(lambda c: c + c * c / 100) <= other.cost(lambda c: c + c * c / 100)
        better += all(p.lengths.count(c) for c in lengths)
    assert better > 10  # a mixture of all lengths
    assert packing.best_fit([], (16,)) == packing.Packing([], [], [])


BPE = packing.Tokenizer(queries.BYTE_BPE)


def test_cutting_long_texts_changes_no_token(monkeypatch):
    text = " ".join(r[1] for r in awkward() if r[1]) + " end  of it\n\n all "
    whole = BPE.encode(text)
    monkeypatch.setattr(packing, "_ENCODE", 50)
    assert BPE.encode(text).tolist() == whole.tolist() and BPE.decode(whole) == text
    assert BPE.decode(BPE.encode("é" * 500 + " x")) == "é" * 500 + " x"
    monkeypatch.setattr(packing, "_BLANKS", re.compile(f"[{packing.SPACE}]{{5,}}"))
    for text in ("a" + " " * 30, " " * 9 + "b\n\n\n\n\n\nc\t\t\t\t\t\t\t1", "\x1c\x1c\x1c\x1c\x1c\x1cx \u3000\xa0\u2009 \t.", " " * 20):
        want = packing._encoding(BPE.file, BPE.pattern).encode_ordinary(text)
        assert BPE.encode(text).tolist() == want


def test_long_runs_get_the_tokens_of_the_whole_run():
    """Runs of more than a million characters, as the list of merges would have them; blanks by the million, too."""
    import random

    rng = random.Random(5)
    for text in ("".join(rng.choices("abcdefghij", k=1_050_000)), "x" + " " * 200_001 + "word", "\n" * 100_000):
        got = BPE.encode(text)
        assert got.tolist() == np.frombuffer(b"".join(bpe.encoder_of(queries.BYTE_BPE_MERGES).encode(text)), "<u4").tolist()


def test_packing_covers_every_token_once(spark, docs, none):
    rows = packing.pack(docs, (8, 64, 512), tokenizer=BPE, shard_tokens=4000).collect()
    bins, texts = {}, {}
    for r in rows:
        assert r.n_tokens == len(r.ids)
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        members.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in members:
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= members[0].bin_length and len({r.bin_length for r in members}) == 1
        assert members[0].bin_length == min(c for c in (8, 64, 512) if c >= at)
    for r in sorted(rows, key=lambda r: r.start):
        if r.doc_id not in (20, 21):
            assert sum(map(len, texts.get(r.doc_id, []))) == r.start
            texts.setdefault(r.doc_id, []).append(r.ids)
    want = {r[0]: r[1] for r in awkward() if r[1] and r[0] not in (20, 21)}
    assert {d: BPE.decode([i for part in ids for i in part]) for d, ids in texts.items()} == want
    assert sum(r.doc_id == 20 for r in rows) == 2 and {r.doc_id for r in rows if r.doc_id in (20, 21)} == {20, 21}
    whole = packing.sequences(packing.pack(docs, (8, 64, 512), tokenizer=BPE, shard_tokens=4000)).collect()
    assert {r.bin_id: r.ids for r in whole} == {b: [i for r in m for i in r.ids] for b, m in bins.items()}
    assert all(sum(p.n_tokens for p in r.parts) == r.n_tokens <= r.bin_length for r in whole)
    assert packing.pack(none, tokenizer=BPE).count() == 0


def test_packing_given_ids(spark):
    df = spark.createDataFrame([(1, [5, 6, 7]), (2, None), (3, []), (4, list(range(20))), (4, [None, 9])], "doc_id long, text array<long>")
    got = packing.pack(df.coalesce(1), (4, 8)).collect()
    assert sorted((r.doc_id, r.start, tuple(r.ids)) for r in got) == [(1, 0, (5, 6, 7)), (4, 0, tuple(range(8))), (4, 0, (9,)), (4, 8, tuple(range(8, 16))), (4, 16, (16, 17, 18, 19))]
    assert len({r.bin_id for r in got}) == 3 and {r.bin_length for r in got} == {8}


# ------------------------------------------------------------------ top-k


def test_top_k(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=6) / 2]) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(50)]  # ties
    rows += [(400, None), (420, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (440, [float("nan")] + [0.0] * 5), (460, [float("inf")] + [0.0] * 5), (None, [0.1] * 6)]
    rows += [(40, rows[40][1]), (480, [0.5, 0.5]), (481, [0.25, -1.0])]  # a repeated row, and another length
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", vafile.scaled(F.col("embedding")).alias("v"))
    got = sorted(tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 20 == 0, 7).select("query_id", "rank", "vec_id", "score").collect())
    vectors = {i: tuple(int(np.floor(64 * np.float64(np.float32(x)))) for x in v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q, v in vectors.items():
        if q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v)]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(heapq.nsmallest(7, scores), 1)]
    assert got == sorted(want)
    assert vafile.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("spread", [3, 200, 40_000, 1 << 40])
def test_bounds_hold_and_leave_little_to_read(spread):
    rng = np.random.default_rng(spread % 97)
    v = rng.integers(-spread, spread, (3000, 16))
    grid = vafile.Grid.over(int(v.min()), int(v.max()))
    cells = grid.cells(v)
    upper, lower = grid.bounds(v[:20], cells)
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(q, x)) for x in v[:300]] for q in v[:20]], float)
    assert (upper[:, :300] >= exact).all() and (lower[:, :300] <= exact).all()
    i, j, up, low = vafile.scan_block(grid, np.arange(20), v[:20], np.arange(3000), cells, 5)
    assert len(i) < 20 * 60 and (i != j).all() and (up >= low).all()


def test_top_k_of_large_components_and_repeated_ids(spark):
    big = 1 << 40
    rows = [(20, [big, 3]), (2, [big, 1]), (3, [-big, 2]), (4, [5, 5]), (4, [7, 7]), (20, [big, 3])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>").withColumns({c: F.lit(1) for c in ("d", "q", "cells", "rank", "score", "qb", "vn", "_nth")})
    got = vafile.top_k(df, F.col("vec_id") == 20, 3).orderBy("rank").collect()
    top = (1 << 63) - 1
    assert [tuple(r) for r in got] == [(20, 1, 2, top), (20, 2, 4, 7 * big + 21), (20, 3, 4, 5 * big + 15)]


def test_top_k_in_many_blocks(spark):
    """Ties at the k-th place over all blocks, and bounds that leave many to be read in the second round."""
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.integers(-900, 900, 4)]) for i in range(400)] + [(1000 + i, [100, 100, 100, 100]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    tops = lambda **more: sorted(map(tuple, vafile.top_k(df, F.col("vec_id") % 40 == 0, 6, block=50, query_block=4, **more).collect()))
    got = tops()
    assert got == tops(first_blocks=2)
    want = []
    for q, v in rows:
        if q % 40 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q]
            want += [(q, n, i, -x) for n, (x, i) in enumerate(heapq.nsmallest(6, scores), 1)]
    assert got == sorted(want)


def test_a_bound_from_the_first_blocks_leaves_less_than_one_a_block():
    rng = np.random.default_rng(8)
    v = rng.integers(-64, 64, (40_000, 32))
    grid = vafile.Grid.over(-64, 63)
    cells, ids = grid.cells(v), np.arange(len(v))
    rows = [vafile.scan_block(grid, ids[:10], v[:10], ids[a : a + 500], cells[a : a + 500], 5) for a in range(0, 20_000, 500)]
    floor = np.array([np.sort(np.concatenate([low[i == q] for i, _, _, low in rows]))[-5] for q in range(10)])
    left = [len(vafile.scan_block(grid, ids[:10], v[:10], ids[a : a + 500], cells[a : a + 500], 5, floor)[0]) for a in range(20_000, 40_000, 500)]
    assert np.mean(left) < 10 and all(len(i) >= 45 for i, *_ in rows)  # ten queries


# ------------------------------------------------------------------ pieces


def all_segmentations(text, v):
    out = []

    def grow(i, score, ids):
        if i == len(text):
            out.append((score, tuple(ids)))
            return
        single = False
        for j in range(i + 1, len(text) + 1):
            p = v.ids.get(text[i:j])
            if p is not None:
                single = single or j == i + 1
                grow(j, score + v.scores[p], [*ids, p])
        if not single:
            grow(i + 1, score + v.unknown_score, [*ids, *(v.bytes_[b] for b in text[i].encode())])

    grow(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["to be", "a  b", "héo the", "日x", "to.\nbe a", "a \n b", "  x ", "\n", " "])
def test_n_best_pieces(text):
    v = pieces.Vocabulary.load(MODEL)
    want = all_segmentations(pieces.BLANK + text.replace(" ", pieces.BLANK), v)
    got = pieces.Segmenter(v, 5)(text)
    assert [s for s, _, _ in got] == [s for s, _ in want[:5]]
    for score, n, raw in got:
        ids = np.frombuffer(raw, "<i4")
        assert (score, tuple(ids.tolist())) in want and len(ids) == n and pieces.decode_ids(ids, v) == text


def test_models_with_rules_of_their_own_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    plain = proto.ModelProto.FromString(open(MODEL, "rb").read())
    assert not pieces._unknown_rules(plain.SerializeToString())
    for change, said in (
        (lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"map"), "normalised"),
        (lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False), "in front"),
        (lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), "repeated blanks"),
        (lambda m: setattr(m.trainer_spec, "treat_whitespace_as_suffix", True), "end pieces"),
        (lambda m: setattr(m.pieces[500], "type", proto.ModelProto.SentencePiece.USER_DEFINED), "by the user"),
        (lambda m: setattr(m.trainer_spec, "model_type", 3), "whole words"),
    ):
        model = proto.ModelProto.FromString(plain.SerializeToString())
        change(model)
        assert said in " ".join(pieces._unknown_rules(model.SerializeToString()))
    model.trainer_spec.model_type = 2
    model.normalizer_spec.remove_extra_whitespaces = True
    odd = tmp_path / "odd.model"
    odd.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="repeated blanks"):
        pieces.Vocabulary.load(str(odd))


@pytest.mark.parametrize("seed", range(4))
def test_n_best_pieces_of_a_stretch_without_blanks(seed):
    """Few letters and whole-number scores: many ties, all segmentations counted."""
    v = pieces.Vocabulary.load(MODEL)
    rng = np.random.default_rng(seed)
    text = pieces.BLANK + "".join(rng.choice(list("aeinst日"), 11))
    want = all_segmentations(text, v)
    for n in (1, 3, 40):
        got = pieces.n_best(text, v, n)
        assert [s for s, _ in got] == [s for s, _ in want[:n]] and len({p for _, p in got}) == len(got)
        assert all(p in {ids for _, ids in want} for _, p in got)


def test_long_text_without_blanks_ends():
    v = pieces.Vocabulary.load(MODEL)
    text = "".join(np.random.default_rng(1).choice(list("abcdefghij"), 300_000))
    got = pieces.Segmenter(v, 4)(text)
    assert len(got) == 4 and len({raw for _, _, raw in got}) == 4
    assert all(pieces.decode_ids(np.frombuffer(raw, "<i4"), v) == text for _, _, raw in got)


def test_solved_stretches_are_bounded(monkeypatch):
    v = pieces.Vocabulary.load(MODEL)
    monkeypatch.setattr(pieces, "CACHE_BYTES", 10_000)
    monkeypatch.setattr(pieces, "SEARCHED_BYTES", 1_000)
    segment = pieces.Segmenter(v, 3)
    for i in range(200):
        segment(f"word{i} other{i}")
        assert segment.solved.bytes < 11_000 and segment.held < 2_000


def test_encode_and_decode(spark, docs, none):
    out = pieces.decode(pieces.encode(docs, MODEL, 3), MODEL)
    texts = {}
    for r in awkward():
        texts.setdefault(r[0], set()).add(r[1] or "")
    rows = out.collect()
    assert all(r.decoded in texts[r.doc_id] for r in rows)
    assert {r.rank for r in rows if r.doc_id == 1} == {1, 2, 3} and {r.rank for r in rows if r.doc_id == 5} == {1}
    assert {r.doc_id for r in rows} == {r[0] for r in awkward()}
    assert pieces.encode(none, MODEL).count() == 0
    checked = pieces.encode(docs, MODEL, 3, ids=False, decoded=True).collect()
    assert all(r.round_trip and r.ids is None for r in checked)
    assert sorted((str(r.doc_id), r.rank, r.ids_sha256) for r in checked) == sorted((str(r.doc_id), r.rank, r.ids_sha256) for r in rows)
    sums = {hashlib.sha256((r[1] or "").encode()).hexdigest() for r in awkward()}
    assert {r.text_sha256 for r in checked} == sums


def test_decoding_many_lists_is_decoding_each():
    v = pieces.Vocabulary.load(MODEL)
    rng = np.random.default_rng(2)
    lists = [rng.integers(3, 32_000, k).tolist() for k in (0, 1, 5, 40)] + [None, [], rng.integers(3, 259, 30).tolist()]
    got = pieces.decode_lists(pieces.pa.array(lists, pieces.pa.list_(pieces.pa.int32())), v).to_pylist()
    assert got == [None if x is None else pieces.decode_ids(np.array(x, int), v) for x in lists]


# ------------------------------------------------------------------ web pages


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><nav><a href=x>Home</a></nav>
      <div class="cookie-notice">We use cookies and other things that are long enough to look like text.</div>
      <main><h1>The &amp; title</h1><p>First   paragraph<br>of the article, with <a href=y>a link</a> inside.<p>Second &eacute; one, not closed
      <ul><li>Point</li><li>Other</li></ul><form><input>Your mail</form><script>var a = "<p>no</p>";</script><p>End.</p></main>
      <aside>About the author and other matters.</aside><section id="comments"><p>Nice post, thank you for it!</p></section><footer>(c)</footer></body></html>"""
    assert main_text(page) == "The & title\nFirst paragraph of the article, with a link inside.\nSecond é one, not closed\nPoint\nOther\nEnd."
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("plain words only") == "plain words only"


def test_main_text_without_article_tag():
    body = "".join(f"<p>Sentence number {i} of an article that has enough words in it.</p>" for i in range(8))
    page = f"<body><div class='top menu'><a>One</a><a>Two</a></div><div><h2>Head</h2>{body}<p>Short.</p></div><div class='ads'>Buy now</div></body>"
    got = main_text(page).split("\n")
    assert got[0] == "Head" and got[-1] == "Short." and len(got) == 10


def test_unmarked_menus_around_the_text_go():
    body = "".join(f"<p>Sentence number {i} of an article, <a href=x>with a link</a> in it.</p>" for i in range(6))
    page = f"<body><div><a>One</a> <a>Two</a></div>{body}<p>See <a href=z>this</a> as well, it says.</p><div><a>Back to the list</a></div></body>"
    got = main_text(page).split("\n")
    assert got[0].startswith("Sentence number 0") and got[-1] == "See this as well, it says."


LONG = "A paragraph of the text, with words enough to count as content and no link in it at all. " * 4


def test_main_text_keeps_short_sections_of_div_pages():
    body = f"<div>{''.join(f'<p>{LONG}{i}</p>' for i in range(12))}</div>"
    last = f"<p>The last section, short. {LONG[:160]}</p>"
    page = f"<body><div class=nav><a href=x>Home</a></div><div><div><h1>The title</h1></div>{body}<div>{last}</div></div><div class=footer>(c)</div></body>"
    got = main_text(page).split("\n")
    assert got[0] == "The title" and got[-1].startswith("The last section") and len(got) == 14


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div class='page header-fixed'", "form action=x"])
def test_main_text_inside_a_wrapper(wrapper):
    inner = f"<div class=sidebar><p>{LONG}</p></div><div><h1>The title</h1><p>{LONG}</p><p>{LONG}</p></div><div id=comments><p>Nice post!</p></div>"
    got = main_text(f"<body><nav><a href=x>Home</a></nav><{wrapper}>{inner}</{wrapper.split()[0]}><footer>(c)</footer></body>")
    assert got.split("\n") == ["The title", LONG.strip(), LONG.strip()]


SAID = ["First paragraph of the article, which goes on for long enough to look like the prose it is.", "Second paragraph, with as many words as the first one, or some more of them perhaps.", "Third and last paragraph; the article ends with it, and nothing is said after that."]
PROSE = "".join(f"<p>{x}</p>" for x in SAID)
LINKS = "<div><a href=a>One thing</a> <a href=b>Another thing</a> <a href=c>More of them</a></div>"
#: Pages marked by hand: the blocks that are the article.
MARKED = {
    "with-sidebar": (f"<div class='content with-sidebar'><h1>Title</h1>{PROSE}</div><div class=sidebar><p>{LONG}</p></div>", ["Title", *SAID]),
    "comments-open": (f"<div class='post comments-open'><h1>Title</h1>{PROSE}</div><div class='post-comments'><p>{LONG}</p></div>", ["Title", *SAID]),
    "no-sidebar": (f"<div id=page class='no-sidebar'><div class='search-results'><h1>Title</h1>{PROSE}</div></div>", ["Title", *SAID]),
    "has-share": (f"<section class='has-share'><h1>Title</h1>{PROSE}<div class='share-buttons-list social'>Tell others</div></section>", ["Title", *SAID]),
    "half of the page has a class word": (f"<div><h1>Title</h1>{PROSE}</div><div class='search-results'>{PROSE}</div>", ["Title", *SAID, *SAID]),
    "list-heavy": (f"<h1>Recipe</h1>{PROSE}<ul><li>Two eggs</li><li>Some flour</li><li>A cup of milk</li></ul>{LINKS}", ["Recipe", *SAID, "Two eggs", "Some flour", "A cup of milk"]),
    "table layout": (f"<table><tr><td><a href=a>Home</a><br><a href=b>News</a><br><a href=c>Sport</a></td><td><h1>Title</h1>{PROSE}</td><td><a href=d>Shop</a></td></tr></table>", ["Title", *SAID]),
    "header in article": (f"<article><header><h1>Title</h1><span>By the author</span><nav><h2>Parts</h2></nav></header>{PROSE}<footer>Filed under</footer></article>", ["Title", *SAID]),
    "short end in article": (f"<article><h1>Title</h1>{PROSE}<p>End.</p></article>", ["Title", *SAID, "End."]),
    "linked end": (f"<article><h1>Title</h1>{PROSE}<p><a href=x>The whole study</a></p><div><a href=y>Next article</a></div></article>", ["Title", *SAID, "The whole study"]),
    "unmarked menu and imprint": (f"{LINKS}<div><h1>Title</h1>{PROSE}</div><div>All rights reserved</div>", ["Title", *SAID]),
    "unmarked notices": (f"<div><span>Welcome, guest</span></div><h1>Title</h1>{PROSE}<div><span>Example Ltd</span> <span>Some road 1</span></div>{LINKS}", ["Title", *SAID]),
    "unmarked box beside the text": (f"<div><div><h1>Title</h1>{PROSE}</div><div><b>Weather</b> <i>mild</i><br>12 degrees</div></div>", ["Title", *SAID]),
    "paragraphs of divs": ("".join(f"<div>{x}</div>" for x in SAID) + "<div>End.</div>", [*SAID, "End."]),
    "nested articles of a list": (f"<main><article><h2>One</h2>{PROSE}</article><article><h2>Two</h2>{PROSE}</article></main>", ["One", *SAID, "Two", *SAID]),
    "hidden": (f"<div hidden><p>{LONG}</p></div><h1>Title</h1>{PROSE}<p aria-hidden=true>{LONG}</p>", ["Title", *SAID]),
}


@pytest.mark.parametrize("name", sorted(MARKED))
def test_marked_pages(name):
    body, blocks = MARKED[name]
    assert main_text(f"<html><head><title>T</title></head><body>{body}</body></html>").split("\n") == blocks


def test_the_ratios_decide(monkeypatch):
    """With every line taken for content, the unmarked pages come out otherwise."""
    monkeypatch.setattr(html_text, "_threshold", lambda values: -np.inf)
    changed = {name for name, (body, blocks) in MARKED.items() if main_text(f"<body>{body}</body>").split("\n") != blocks}
    assert changed >= {"unmarked menu and imprint", "unmarked notices", "unmarked box beside the text", "table layout"}


#: Nests that a page of some hundred kilobytes can hold.
NESTS = {
    "blocks": "<div>x" * 100_000, "marked": "<div class=ad>x" * 40_000, "articles": "<article>z" * 40_000, "inline": "<b>" * 20_000 + "<p>y</p>" * 20_000,
    "ends that open nothing": "<section><article>" + "<div>" * 40_000 + "</section>" * 40_000 + "</table>" * 40_000, "closed": "<div>x" * 40_000 + "</div>" * 40_000,
}


@pytest.mark.parametrize("name", sorted(NESTS))
def test_deep_pages_end(name):
    import time

    began = time.process_time()
    text = main_text(NESTS[name])
    assert time.process_time() - began < 30
    if name in ("blocks", "closed"):
        assert text.count("x") >= NESTS[name].count("x") - 3


def test_article_text_stays():
    sources = "<h2>Sources</h2><ul><li><a href=a>First study</a></li><li><a href=b>Second study</a></li></ul>"
    assert main_text(f"<article><h1>Title</h1>{PROSE}{sources}</article>").split("\n") == ["Title", *SAID, "Sources", "First study", "Second study"]
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul>"
    assert main_text(f"<article>{menu}<h1>Title</h1>{PROSE}</article>").split("\n") == ["Title", *SAID]
    last = "Second part, a short sentence in its own block."
    assert main_text(f"<body><div><h1>Title</h1>{PROSE}</div><div>{last}</div></body>").split("\n") == ["Title", *SAID, last]
    assert main_text(f"<body><div><h1>Title</h1>{PROSE}<div>A note inside the text's own part.</div></div></body>").split("\n") == ["Title", *SAID, "A note inside the text's own part."]


def test_extract(spark):
    rows = [(1, "u", "<article><p>Words</p></article>", 5), (1, "u", "<article><p>Words</p></article>", 5), (2, None, None, 6), (None, "v", "<p>" + "long " * 50_000 + "</p>", 7)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert sorted(((r.page_id, r.n_chars) for r in got), key=str) == sorted([(1, 5), (1, 5), (2, 0), (None, 249_999)], key=str)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    same = "<p>" + "equal payload " * 20 + "</p>"
    rows = [(i, f"http://x/{i}", same if i % 3 == 0 else f"<p>page {i} " + "text " * 40, "x") for i in range(60)]
    rows += [(100, "http://a b\r\n", "tiny", None), (101, None, "tiny", None), (102, "u", None, None), (103, "u", "é" * 200_000, None), (None, "n", same, None), (0, "again", same, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    archives = warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(archives).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in got), key=str) == sorted(
        ((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h, _ in rows), key=str
    )
    for r in got:
        if r.record_type == "revisit":
            assert r.refers_to == 0 and r.payload is None and r.page_id % 3 == 0
        else:
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and r.refers_to is None
    assert sum(r.record_type == "revisit" for r in got) == 19
    nothing = warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(nothing).count() == 0
    assert all(x.name.endswith((".zst", ".crc")) for x in (tmp_path / "w").iterdir()) and not list((tmp_path / "e").iterdir())


def test_warc_folders_as_spark_names_them(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>page {i}") for i in range(5)], "page_id long, url string, html string")
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shared.link./store", f"file://{tmp_path}")
    for folder in (f"file:{tmp_path}/a", f"file://{tmp_path}/b/", "viewfs://shared/store/c"):
        archives = warc.write_archives(pages, folder)
        assert sorted(r.page_id for r in warc.read_archives(archives).collect()) == list(range(5))
    assert {x.name for x in tmp_path.iterdir()} == {"a", "b", "c"}
    assert type(warc._system("s3a://bucket/x?region=us-east-1")[0]).__name__ == "S3FileSystem"
    assert warc._system("s3a://bucket/x?region=us-east-1")[1] == "bucket/x"
    with pytest.raises(Exception, match="(?i)scheme|filesystem|unrecognized"):
        warc.write_archives(pages, "nowhere://host/x")


def test_warc_dictionary_from_long_pages_only(spark):
    words = [f"<li class='item'>word {i * 7919 % 1000}</li>" for i in range(6000)]
    pages = spark.createDataFrame([(i, "u", f"<h1>{i}</h1>" + "".join(words[i * 100 :] + words[: i * 100])) for i in range(40)], "page_id long, url string, html string")
    assert pages.selectExpr("min(length(html))").first()[0] > warc.SAMPLE_BYTES // 32
    assert warc.train_dictionary(pages)
    assert warc.train_dictionary(pages.limit(0)) == b""


# ------------------------------------------------------------------ URL filters


def test_cascade_is_exact_over_its_keys(spark, monkeypatch):
    universe = [f"k{i}" for i in range(4000)]
    listed = universe[::7] + ["absent"]
    frame = lambda x: spark.createDataFrame([(k,) for k in x] + [(None,)], "key string")
    cascade = urlfilter.build_cascade(frame(listed), frame(universe))
    of = lambda c: np.array([r[:] for r in frame(universe + ["absent"]).where("key IS NOT NULL").select(*c.hashes(F.col("key"))).collect()], np.int64).view(np.uint64)
    h = of(cascade)
    assert cascade.has(h[:, 0].copy(), h[:, 1].copy()).tolist() == [k in set(listed) for k in universe + ["absent"]]
    assert len(cascade.levels) > 1
    empty = urlfilter.build_cascade(frame([]), frame(universe))
    assert not empty.has(h[:, 0].copy(), h[:, 1].copy()).any()
    # Hashes of 15 bits altogether: some key of the universe shares both with a listed one until the seeds suit.
    few = urlfilter.build_cascade(frame(listed[:5]), frame(universe[:400]), hash_bits=8)
    h = of(few)
    assert few.has(h[:400, 0].copy(), h[:400, 1].copy()).tolist() == [k in set(listed[:5]) for k in universe[:400]]
    monkeypatch.setattr(urlfilter, "MOST_SEEDS", 2)
    with pytest.raises(ValueError, match="share hashes"):
        urlfilter.build_cascade(frame(listed), frame(universe), hash_bits=4)


def test_hashes_are_independent(spark):
    """The second is no function of the first, whatever the seed: XXH64 of the number in front is the seed of the key's."""
    for seed in (0, 3):
        a, b = spark.createDataFrame([("k",)], "key string").select(*urlfilter._hashes(F.col("key"), seed)).first()
        for h, i in ((a, 2 * seed), (b, 2 * seed + 1)):
            first = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42)
            assert h % 2**64 == xxhash.xxh64_intdigest(b"k", first) | (i % 2)


def test_long_hosts_have_few_keys(spark):
    url = "http://" + "a." * 10_000 + "example.com/en/x"
    df = spark.createDataFrame([(url,), ("http://com/en/",), (None,)], "url string")
    host, path = urlfilter.host_and_path("url")
    keys = [r[0] for r in df.select(urlfilter.candidate_keys(host, path, [1, 4], 3)).collect()]
    assert keys[0] == ["a.example.com/en/", "example.com/en/", "a.example.com/", "example.com/", "com/en/", "com/"]
    assert keys[1] == ["com/en/", "com/"] and keys[2] == []


def test_judged_urls(spark):
    rules = spark.createDataFrame([("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")], "key string, action string")
    cases = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "https://EXAMPLE.com/en/a?b#c": ("example.com", "/en/a", "example.com/en/", "block"),
        "https://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "http://x.net/es": ("x.net", "/es", None, "allow"),
        "http://com": ("com", "", None, "allow"),
        "http://q.com?x=/en/": ("q.com", "", None, "allow"),
        "no scheme.com/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(cases)] * 2, "page_id long, url string, rule string")
    for bits in (None, 1):  # by filters, and for a list that is too long for them
        got = urlfilter.judge(pages, rules, [1, 4], max_bits=bits).collect()
        assert len(got) == 2 * len(cases)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id]
    assert urlfilter.judge(pages.limit(0), rules, [1, 4]).count() == 0


# ------------------------------------------------------------------ languages


def test_languages_are_told_apart_on_held_out_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    profiles = langid.fit(df.where(~held))
    out = langid.predict(df.where(held), profiles)
    assert out.where("lang = lang_pred").count() / out.count() > 0.98
    assert out.where("score < 0 OR score > 1").count() == 0
    assert zlib.crc32(b"1") % 4 == spark.range(1).select(F.crc32(F.lit("1")) % 4).first()[0]


def test_rare_labels_are_learnt_and_copies_count_once(spark):
    assert langid._quota([3, 50, 1000], 100) == 48 and langid._quota([3, 4], 100) == 100 and langid._quota([9, 9, 9], 2) == 1
    rows = [(f"the common words of text number {i} and others", "en") for i in range(3000)]
    rows += [("dasselbe wieder", "de")] * 2000 + [(f"ein deutscher satz mit vielen worten {i}", "de") for i in range(40)]
    rows += [("muy poco texto", "es"), ("12 34", "es"), ("99", "xx")]
    profiles = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(7), max_rows=120)
    assert profiles.languages == ("de", "en", "es")
    german = langid.bundle([t for t, _ in {r: 0 for r in rows if r[1] == "de"}]).sum(axis=0)
    assert profiles.prototypes[0] @ (german / np.linalg.norm(german)) > 0.999  # each text once, all 41 taken
    assert profiles.prototypes[2] @ langid.bundle(["muy poco texto"])[0] > 0.999


def test_short_texts_stay_and_long_ones_in_no_language_go(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"plain english words of text number {i} and some more of them", "en") for i in range(20)] + [(i, "12 34", None) for i in range(20, 25)]
    rows += [(i, "".join(map(chr, rng.integers(0x4E00, 0x9F00, n))), None) for i, n in enumerate([40] * 50 + [600] * 50, 100)]
    rows += [(200, "plain words of english text, number and all, " * 9, None), (201, None, "en")]
    kept = {r.doc_id: r.lang for r in langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sorted(kept) == [*range(20), *range(100, 150), 200] and kept[200] == "en"
    assert langid.keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=["de"]).count() == 0


def brute_vector(text):
    """Binding and bundling, letter by letter."""
    slots = [0]
    for c in f" {text} ".lower()[1:]:
        slot = ord(c) % 4095 + 1 if c.isalpha() else 0
        if slot or slots[-1]:
            slots.append(slot)
    vectors = langid._vectors().astype(int)
    total = np.zeros(langid.DIMENSIONS)
    for i in range(len(slots) - 2):
        if any(slots[i : i + 3]):
            total += np.roll(vectors[slots[i]], 2) * np.roll(vectors[slots[i + 1]], 1) * vectors[slots[i + 2]]
    norm = np.linalg.norm(total)
    return total / norm if norm else total


def test_bundles_are_those_of_brute_force(monkeypatch):
    texts = ["The cat, the hat. 12 über", "", "x", "one two  three\nfour " * 30, "été — 日本 a1b2"]
    want = np.array([brute_vector(t) for t in texts])
    assert np.allclose(langid.bundle(texts), want, atol=1e-6)
    monkeypatch.setattr(langid, "_CHUNK", 7)  # every text is long
    assert np.allclose(langid.bundle(texts), want, atol=1e-6)


def test_free_text_for_labels_is_refused(spark, monkeypatch):
    rows = spark.createDataFrame([(f"some words {i}", f"label {i}") for i in range(9)], "text string, lang string")
    monkeypatch.setattr(langid, "MOST_LABELS", 9)
    assert len(langid.fit(rows).languages) == 9
    monkeypatch.setattr(langid, "MOST_LABELS", 8)
    with pytest.raises(ValueError, match="labels"):
        langid.fit(rows)


def test_language_edge_cases(spark, docs, none):
    profiles = langid.fit(docs)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.predict(docs, profiles).collect()}
    for key in ((5, ""), (6, None), (7, " \n\t")):
        assert got[key] == ("und", 0.0)
    assert all(v[0] in ("en", "de") for k, v in got.items() if k[0] not in (5, 6, 7))
    assert (11, "x " * 30_000) in got
    assert langid.keep_known(docs).columns == docs.columns
    assert langid.keep_known(docs).where("text IS NULL OR trim(text) = ''").count() == 0
    assert langid.keep_known(none).count() == 0
    assert langid.bundle(["A.", "x"]).any(axis=1).all() and not langid.bundle(["", "12 34"]).any()
    alone, both = langid.bundle(["der text"]), langid.bundle(["anderes", "der text", ""])
    assert np.allclose(alone[0], both[1])
