"""The corpus pipeline on a small corpus with planted cases."""

import collections
import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

PARTS = {"en": ["the", "ing", "wh", "er", "ed"], "es": ["ció", "ñas", "que", "os", "ar"]}


def corpus(seed=1, n=240):
    r = random.Random(seed)
    text = lambda k, m: " ".join("".join(r.choice(PARTS[k]) for _ in range(r.randrange(2, 5))) for _ in range(m))
    docs = [(i, text("en" if i % 3 else "es", r.randrange(60, 160)), "en" if i % 3 else "es", f"src{i % 4}") for i in range(n)]
    labels = []
    for i in range(0, n, 2):
        bad = i % 10 == 0
        if bad:
            docs[i] = (i, " ".join(["horrid" if k == 7 else w for k, w in enumerate(docs[i][1].split(" "))]), *docs[i][2:])
        labels.append((i, 1, int(bad)))
    items = [(0, text("en", 40)), (1, text("es", 13))]
    words = docs[3][1].split(" ")
    words[5] = "changed"
    docs += [(1001, docs[3][1], "en", "src0"), (1002, " ".join(words), "en", "src1"), (1003, "123 456", "en", "src0"), (1004, None, "en", None), (1005, docs[7][1] + " " + items[0][1], "en", "src0"), (1006, docs[9][1], "es", "src3"), (1006, docs[9][1], "es", "src3"), (None, text("en", 90), "en", "src1")]
    return [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in docs], labels, items


def test_pipeline(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not {1001, 1002, 1003, 1004, 1005, 1006} & set(out)
    toxic = [i for i in range(0, 240, 10)]
    clean = [i for i in range(240) if i % 10]
    assert sum(i in out for i in toxic) <= 2 and sum(i in out for i in clean) >= 0.97 * len(clean)
    assert None in out and out[3]["n_tokens"] > 0


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    docs, labels, items = corpus()
    df = spark.createDataFrame(docs[:0], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert (name == "bpe_tokens" or out.columns == df.columns) and out.count() == 0, name


CLASHES = ["_found", "_id", "_n", "_key", "_row", "id", "n", "h", "s", "c", "score", "found", "component", "component_id", "row_key", "quality", "ids", "lo", "hi", "a.b"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls, repeats, ties, a text of 3 MB and clashing columns, and their folder."""
    from pyspark.sql import functions as F

    docs, labels, items = corpus(2)
    words = lambda i: docs[i][1].split(" ")
    long = " ".join(w for _ in range(60) for i in range(240) for w in words(i)[::-1])
    more = [
        (2000, None, None, None, None), (2001, "", "en", "src0", 0), (2002, " \n\t", "en", "src0", 3), (2003, "12 34 !", "en", None, 7), (2004, long, "en", "src1", len(long)),
        docs[3], docs[3], (3, "the same id with another text of the same kind", "en", "src1", None), (None, docs[4][1], None, None, None), (None, docs[4][1], None, None, None), (None, None, None, None, None),
        (2005, items[0][1], "en", "src0", 5), (2005, items[0][1], "en", "src0", 5), (None, items[0][1], "en", "src0", 5), (2006, "the ing", "en", "src0", 7), (2007, "the ing", "en", "src0", 7),
    ]
    root = tmp_path_factory.mktemp("odd_stages")
    spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([*items, (7, None), (8, "")], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    df = spark.createDataFrame([*docs, *more], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({c: F.lit("clash") for c in CLASHES})
    df.write.parquet(str(root / "documents.parquet"))
    return spark.read.parquet(str(root / "documents.parquet")), str(root), items


def stage_rows(spark, odd, name):
    """(rows that came in, rows that went out), each as the five columns of documents, counted."""
    docs, root, _ = odd
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, root)
    assert out.columns == docs.columns
    both = [df.collect() for df in (docs, out)]
    assert all(r[c] == "clash" for r in both[1] for c in CLASHES)
    came, went = (collections.Counter(tuple(r)[:5] for r in rows) for rows in both)
    assert not went - came
    return came, went


def test_language_stage_on_odd_rows(spark, odd):
    came, went = stage_rows(spark, odd, "language_id")
    assert {r[:2] for r in came - went} >= {(2000, None), (2001, ""), (2002, " \n\t"), (2003, "12 34 !"), (None, None)}
    assert all(any(c.isalpha() for c in r[1]) for r in went) and all(n == came[r] for r, n in went.items())
    assert sum(went.values()) >= sum(came.values()) - 7 and any(r[0] == 2004 for r in went)


def test_quality_stage_on_odd_rows(spark, odd):
    came, went = stage_rows(spark, odd, "quality_classifier")
    assert all(n == came[r] for r, n in went.items())
    clean = [r for r in came if r[0] is not None and r[0] < 240 and r[0] % 10 and r[4]]
    assert sum(r in went for r in clean) >= 0.97 * len(clean)
    assert len({r in went for r in came if r[0] in (2006, 2007)}) == 1


def test_near_duplicate_stage_on_odd_rows(spark, odd):
    came, went = stage_rows(spark, odd, "near_duplicates")
    none = {r: n for r, n in came.items() if r[0] is None}
    assert {r: n for r, n in went.items() if r[0] is None} == none
    ids = collections.Counter(r[0] for r in went.elements() if r[0] is not None)
    assert set(ids.values()) == {1} and set(ids) == {r[0] for r in came if r[0] is not None} - {1001, 1002, 1006, 2007}
    same = [r for r in came if r[0] == 3]
    assert [r for r in went if r[0] == 3] == [min(same, key=lambda r: r[1])]


def test_benchmark_stage_on_odd_rows(spark, odd):
    came, went = stage_rows(spark, odd, "benchmark_passages")
    item = odd[2][0][1]
    gone = {r for r in came if r[1] and item in r[1]}
    assert {r[0] for r in gone} == {1005, 2005, None} and came - went == collections.Counter({r: came[r] for r in gone})


def test_token_stage_on_odd_rows(spark, odd):
    docs, root, _ = odd
    got = collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.bpe_tokens(spark, docs, root).collect())
    assert got == collections.Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
