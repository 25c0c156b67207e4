"""The registered queries themselves, on odd rows and on empty tables."""

import hashlib
import json
import math
import zlib
from array import array

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from shellac.llm import queries, tokenizers_io  # noqa: E402

BYTES, WORDS = public_tokenizers.path(queries.BYTE_FILE), public_tokenizers.path(queries.WORD_FILE)
LONG = "a very long text, of many words. " * 90_000  # 3 MB
SHARED = "the same thirteen words stand here and in the benchmark item too as one passage"
TEXTS = [
    "One plain text about nothing much.", "One plain text about nothing much.", None, "", " \n\t ", "½ ² Ⅷ", "mail ann@example.org or see https://example.org/x now",
    LONG, f"{SHARED} and some more", "tie tie tie", "tie tie tie", "日本語の文章です。", "  a b", *(f"word{i} and others of kind {i % 7} in a row" for i in range(60)),
]
CLASHES = ["id", "n", "h", "s", "c", "v", "score", "found", "block", "bucket", "class", "component", "component_id", "label", "row_key", "edits", "good"]


def documents():
    rows = [(i, t, ["en", "es", None][i % 3], f"source {i % 2}", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    return [*rows, rows[0], (0, "the id again with another text", "en", None, None), (None, "a text without an id", None, None, None)]


KINDS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
}
ROWS = {
    "documents": documents(),
    "embeddings": [(i, [math.cos(i), math.sin(i), 0.5]) for i in range(50)] + [(0, [1.0, 2.0, 3.0]), (3, [math.cos(3), math.sin(3), 0.5]), (60, None), (61, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])],
    "pages": [
        (1, "https://Ann.Example.org/es/x?q", ""), (2, "http://example.org/en/12", None), (3, "http://bad-example.org/es/", None), (4, "http://x.com/fr/1#a", None), (5, "http://com/de/", None),
        (6, None, None), (7, "no address", None), (8, "ftp://HOST", None), (9, "http://", None), (9, "http://", None), *((i, f"http://site{i % 4}.net/{i % 60}", None) for i in range(10, 80)),
    ],
    "benchmark": [(1, SHARED), (2, "tie tie"), (3, None), (4, "")],
    "labels": [(i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(50)] + [(None, 1, 0), (5, None, None)],
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders of odd tables, with clashing further columns, and of empty ones."""
    made = {}
    for kind in ("odd", "empty"):
        root = tmp_path_factory.mktemp(kind)
        for name, schema in KINDS.items():
            df = spark.createDataFrame(ROWS[name] if kind == "odd" else [], schema)
            own = {c.split()[0] for c in schema.split(", ")}
            df.withColumns({c: F.lit("clash") for c in CLASHES if c not in own}).write.parquet(str(root / f"{name}.parquet"))
        made[kind] = str(root)
    return made


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_on_odd_rows(spark, tables, name):
    rows = queries.queries()[name](spark, tables["odd"]).collect()
    docs = documents()
    if name == "op4_neighbours":
        # the id 0 keeps the least of its two vectors
        vectors = {i: v for i, v in ROWS["embeddings"] if i is not None and v is not None and any(v) and v != [1.0, 2.0, 3.0]}
        near = {q: [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20, 40)}
        assert {r["query_id"] for r in rows} == set(near) and all(len(n) == len(set(n)) <= 20 and q not in n for q, n in near.items())
        assert all(abs(r["score"] - sum(a * b for a, b in zip(vectors[r["query_id"]], vectors[r["vec_id"]], strict=True))) < 1e-6 for r in rows)
        return
    if name == "op12_source_audit":
        pairs = [r for r in rows if r["part"] == "pair"]
        groups = {(r[2] or "", r[3] or "") for r in docs}
        assert len(pairs) == sum(a[0] == b[0] and a != b for a in groups for b in groups) and {r["rank"] for r in rows if r["part"] == "term"} <= set(range(1, 11))
        return
    if name == "op13_reversed_search":
        best = [(r["doc_id"], r["rank"]) for r in rows if r["item_id"] == 2]
        assert sorted(best, key=lambda x: x[1]) == [(9, 1), (10, 2)] and min(rows, key=lambda r: (r["item_id"], r["rank"]))["doc_id"] == 8 and {r["item_id"] for r in rows} == {1, 2}
        return
    assert len(rows) == len(ROWS["pages"] if name == "op2_url_filter" else docs)
    if name == "op11_secret_scan":
        assert all(r["n_assign"] + r["n_access"] + r["n_hex"] == 0 and r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    elif name == "op1_packed_ids":
        want = sorted((str(d), zlib.crc32(tokenizers_io.encode_many(WORDS, [t or ""])[0] + array("I", [1]).tobytes())) for d, t, *_ in docs)
        assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in rows) == want
        assert sorted(r["start"] for r in rows)[1:] == sorted(r["start"] + r["n_tokens"] for r in rows)[:-1]
    elif name == "op2_url_filter":
        by = {r["page_id"]: r for r in rows}
        assert [(by[i]["host"], by[i]["path"]) for i in (1, 6, 7, 8, 9)] == [("ann.example.org", "/es/x"), ("", ""), ("", ""), ("host", ""), ("", "")]
        assert [(by[i]["rule"], by[i]["verdict"]) for i in (1, 2, 3, 4, 5)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block")]
        assert all(r["rule"] is None and r["verdict"] in ("allow", "block") for r in rows if r["page_id"] > 5)
    elif name == "op3_chunk_bpe":
        ids = {t: tokenizers_io.encode_many(BYTES, [t or ""])[0] for _, t, *_ in docs}
        want = sorted((str(d), len(ids[t]) // 4, hashlib.sha256(ids[t]).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in docs)
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    elif name == "op5_jaccard_join":
        by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
        assert by[(1, 4)] == 0 and by[(10, 1)] == 9 and by[(2, 0)] == 2 and {c for (d, _), c in by.items() if d is None} == {None}
    elif name == "op6_edit_counts":
        by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (0, None)}
        assert by[6]["n_edits"] == 2 and by[6]["n_tokens_after"] == len(tokenizers_io.encode_many(BYTES, ["mail <email> or see <link> now"])[0]) // 4
        assert by[7]["n_edits"] == 0 and by[2]["n_tokens_before"] == 0
    elif name == "op7_lm_scores":
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)
        cut = [((t or "").encode().lower().split() + [None], d) for d, t, *_ in docs]
        learnt = [w for words, d in cut if d is None or zlib.crc32(str(d).encode()) % 5 != 1 for w in words]
        counts = {w: learnt.count(w) for w in {w for words, _ in cut for w in words if len(words) < 100}}
        kinds = len(set(learnt))
        for r in rows:
            words = next(words for words, d in cut if d == r["doc_id"])
            if len(words) < 100 and r["doc_id"] not in (0, None):
                base = sum(math.log10((counts[w] + 0.5) / (len(learnt) + 0.5 * (kinds + 1))) for w in words)
                assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["train_tokens"] == len(learnt)
    elif name == "op8_langid":
        assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {2, 3, 4, 5} and {r["lang_pred"] for r in rows} <= {"und", "en", "es"}
    elif name == "op9_quality":
        assert all(0 <= r["quality"] <= 1 for r in rows)
    elif name == "op10_decontaminate":
        by = {r["doc_id"]: r for r in rows}
        assert by[8]["n_hit"] == len(SHARED.split()) and by[8]["contaminated"] and by[9]["n_hit"] == 3 and by[2]["n_words"] == 0 and not by[7]["contaminated"]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_on_empty_tables(spark, tables, name):
    got = queries.queries()[name](spark, tables["empty"])
    assert got.collect() == [] and json.loads(got.schema.json())["fields"]
