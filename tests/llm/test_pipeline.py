"""The pipeline's stages one after the other, and the registered queries against their SQL."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from folioframe.llm import queries
from folioframe.llm.packing import Tokenizer
from folioframe.llm.simhash import near_groups, similar_groups
from folioframe.llm.substring import kept_words

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name == "near_copies":
            assert similar_groups(docs).where("doc_id <> component_id").count() == 0
        if name == "exact_copies":
            norm = {r.text.replace(" ", "").replace("\n", "") for r in before.collect()}
            assert docs.count() == len(norm)
        if name == "repeated_passages":
            assert kept_words(before).where("n_removed > 0").count() == docs.join(before, ["doc_id", "text"], "left_anti").count()
    assert counts == sorted(counts, reverse=True)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    encode, texts = Tokenizer(queries.BYTE_BPE), {}
    for r in packed.orderBy("doc_id", "start").collect():
        texts.setdefault(r.doc_id, []).extend(r.ids)
    assert {d: encode.decode(ids) for d, ids in texts.items()} == {r.doc_id: r.text for r in docs.collect() if r.text}


JUNK = [
    (-1, "0123 4567 89", None), (-2, None, "en"), (-3, "", None), (-4, "".join(chr(0x4E00 + (i * 7919) % 20000) for i in range(400)), None),
    (-5, " ".join(f"{(i * 2654435761) % 2**32:032b}".translate(str.maketrans("01", "xq")) for i in range(40)), None),
]
COPIES = [(5_000_000, "  ".join, "exact"), (5_000_001, lambda w: " ".join([*w[:-1], "changed"]), "near")]


def test_every_stage_acts(spark):
    """Rows planted for each stage: junk, an exact and a near copy of a long text, and a passage of another in a text of its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.where("length(text) > 2000").orderBy("doc_id").first().asDict()
    words = np.random.default_rng(4).permutation(base["text"].split()).tolist()
    base |= {"doc_id": 4_000_000, "text": " ".join(words)}
    planted = [base]
    planted += [base | {"doc_id": i, "text": t, "lang": lang} for i, t, lang in JUNK]
    planted += [base | {"doc_id": i, "text": f(words)} for i, f, _ in COPIES]
    own = [f"own{i}" for i in range(80)]
    planted.append(base | {"doc_id": 5_000_002, "text": " ".join([*own[:40], *words[:60], *own[40:]]), "lang": None})
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        seen.append({r.doc_id: r for r in docs.collect()})
    language, exact, near, cut = seen
    assert not language.keys() & {i for i, _, _ in JUNK} and {5_000_000, 5_000_001, 5_000_002} <= language.keys()
    assert language[5_000_002].lang  # it had no label
    assert (5_000_000 in exact) + (base["doc_id"] in exact) == 1 and 5_000_001 in exact
    assert 5_000_001 not in near and 5_000_002 in near
    assert cut[5_000_002].text == " ".join(own)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("doc_id = 5000002").collect()
    assert Tokenizer(queries.BYTE_BPE).decode([i for r in rows for i in r.ids]) == " ".join(own)


def test_near_copies_are_those_of_brute_force(spark):
    """All pairs of a thousand real texts: linked are those at 0.8 or more, by chains."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                linked += 1
                x, y = sorted((find(i), find(j)))
                up[y] = x
    assert linked > 40
    got = {r.doc_id: r.component_id for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_copies", "near_copies", "repeated_passages", "packing"]


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    assert order(tuple(r[c] for c in names) for r in got.collect()) == order(cursor.fetchall())


def test_near_copies_are_linked_by_fingerprints(spark):
    """No two documents stay whose fingerprints are linked: one line a hundred times, and few words of their own around it."""
    line = "the same line of a dozen words that comes again and again here"
    rows = [(i, " ".join([f"a{i}", f"b{i}", *[line] * 100]), "en", "web", 0) for i in range(5)]
    rows.append((9, " ".join(f"own{i}" for i in range(300)), "en", "web", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    fps = near_groups(docs)
    assert {r.doc_id for r in fps.where("doc_id = component_id").collect()} == {0, 9}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()} == {0, 9}


def test_near_copies_chain_over_both_kinds_of_links(spark):
    """A middle text is linked to one by its fingerprint and to another by its shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    left = corpus_pipeline.near_copies(spark, docs, SF)
    assert left.join(near_groups(docs).where("doc_id <> component_id"), "doc_id").count() == 0
    assert left.join(similar_groups(docs).where("doc_id <> component_id"), "doc_id").count() == 0
