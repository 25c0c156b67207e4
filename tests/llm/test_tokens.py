"""Tokens: packed files, chunk reuse, edits."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from shellac.llm import chunk_bpe, edit_counts, packed_ids, tokenizers_io  # noqa: E402

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["", " ", "a", "Hello world, it's 9 o'clock.", "\n\n \t x", "<|endoftext|> foo <|endoftext|>bar", "<|STARTOFTEXT|> Don't", "x" * 20000, "  " * 5000, "é" * 9000, "日本語 テキスト " * 300,
         " a.. b!!", "İa İ1 Ελλάς. ΟΔΟΣ, Σ", "word " * 4000, "same passage with many words in it. " * 60, "\u00a0 a\u2003b\x1cc", "e\u0301 \u0301x"]
SCHEMA = "doc_id long, text string, ids string, shard int"


def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, "again", None, 1), (None, "no id", "x", 2), (99, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def ids_of(path, text):
    return tokenizers_io.encode_many(path, [text or ""])[0]


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 64 * 9, dtype=np.uint64)
    assert (packed_ids.unpack(packed_ids.pack(ids, bits), bits) == ids).all()


def test_bits():
    assert [packed_ids.bits_for(n) for n in (1, 2, 3, 49_408, 65_536, 65_537)] == [1, 1, 2, 16, 16, 17]


def test_packed_files(spark):
    rows = docs(spark)
    manifest = packed_ids.write_packed(rows, lambda: tokenizers_io.word_encoder(WORDS, 1), 49_408, block=64)
    got = packed_ids.read_packed(manifest).orderBy("start").collect()
    # rows of one id follow each other by the hash of their text
    want = [tuple(r) for r in rows.select("doc_id", "text").orderBy("doc_id", F.xxhash64("text"), "text").collect()]
    assert [d for d, _ in want] == sorted((d for d, _ in want), key=lambda d: (d is not None, d or 0))
    start = 0
    for g, (doc, text) in zip(got, want, strict=True):
        ids = ids_of(WORDS, text) + array("I", [1]).tobytes()
        assert (g["doc_id"], g["start"], g["n_tokens"], zlib.crc32(g["ids"])) == (doc, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    path = manifest.orderBy(F.desc("n_ids")).first()["path"].removeprefix("file://")
    with open(path, "rb") as f:  # any span can be read by itself
        reader = packed_ids.Reader(f)
        whole = reader.ids(0, reader.n_ids)
        for a, b in ((0, 1), (63, 65), (reader.n_ids - 1, reader.n_ids), (5, 5)):
            assert (reader.ids(a, b) == whole[a:b]).all()


def test_packed_id_of_many_rows_spreads(spark):
    """Rows without an id, many of them, fill several files; a long text passes through, blocks go to the file as they fill."""
    rows = spark.createDataFrame([(None, f"text {i}") for i in range(3000)] + [(7, "long words " * 300_000)], "doc_id long, text string")
    manifest = packed_ids.write_packed(rows, lambda: tokenizers_io.word_encoder(WORDS, 1), 49_408)
    assert manifest.filter("n_docs > 0").count() == 4 and manifest.agg(F.max("n_docs")).first()[0] < 1500
    got = packed_ids.read_packed(manifest).filter("doc_id = 7").first()
    ids = ids_of(WORDS, "long words " * 300_000) + array("I", [1]).tobytes()
    assert zlib.crc32(got["ids"]) == zlib.crc32(ids) and got["start"] == manifest.agg(F.sum("n_ids")).first()[0] - len(ids) // 4


def test_packed_empty(spark):
    manifest = packed_ids.write_packed(docs(spark).limit(0), lambda: tokenizers_io.word_encoder(WORDS, 1), 49_408)
    assert packed_ids.read_packed(manifest).count() == 0


def test_word_encoder_equals_library():
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("aeinrst .,'!AÉßüİ1\n<|>") for _ in range(40)) for _ in range(300)]
    assert tokenizers_io.word_encoder(WORDS)(texts) == tokenizers_io.encode_many(WORDS, texts)


def test_word_encoder_looks_up_parts(monkeypatch):
    """Letters and the run of signs behind them are encoded apart, so that few strings need the library's whole course."""
    r, many, asked = random.Random(4), tokenizers_io.encode_many, []
    stems = ["".join(r.choice("abcdeéñÀÖÿÞœŁ") for _ in range(6)) for _ in range(300)]
    odd = ["don't", "a'", "'", "x'.s", "ª!", "µ,", "Ÿ.", "ẞ..", "×", "a×,", "a<|", "<|endoftext|>.", "a1.", "1.", "日.", "e\u0301.", "a\t.", "a,\u2003", *(chr(c) + s for c in range(0xA0, 0x260) for s in ("a", ","))]
    words = [v + t for w in stems for v in (w, w.upper()) for t in ("", ".", "***", ",###", "\\^_`{|}~", '")', "<|")]
    r.shuffle(words)
    texts = [" ".join(words[i::40]) + "\n" + " ".join(odd[i::40]) for i in range(40)] + ["", " ", "\n\n"]
    want = many(WORDS, [t + " ." for t in texts])
    monkeypatch.setattr(tokenizers_io, "encode_many", lambda path, texts: asked.extend(texts) or many(path, texts))
    encode = tokenizers_io.word_encoder(WORDS, 5)
    assert [x[:-4] for x in encode(texts)] == [x[:-4] for x in want]
    assert all(x[-4:] == array("I", [5]).tobytes() for x in encode(texts))
    assert len(asked) < 300  # signs and odd words; it was asked for each of the words with several signs


def test_encoders_equal_library():
    r = random.Random(2)
    texts = TEXTS + ["".join(r.choice("aeinrst .,'!AÉßü1\n\t<|>é") for _ in range(900)) for _ in range(60)]
    want = tokenizers_io.encode_many(BYTES, texts)
    assert tokenizers_io.encode_bytes(BYTES, texts) == want
    for mean in (16, 64, 512):
        assert chunk_bpe.ChunkEncoder(BYTES, mean)(texts) == want


def test_chunks_are_shared():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    passage = " ".join(words)
    made = chunk_bpe.ChunkEncoder(BYTES, 128)
    made([passage + " tail one"])
    before = len(made.chunks)
    made(["another head " + passage + " and another tail"])
    assert before >= 5 and len(made.chunks) - before <= 4  # only the ends are new


def test_joins_are_compared_until_they_agree(monkeypatch):
    """A window whose ids differ from its neighbours' grows; where none agrees the text is encoded as a whole."""
    text = " ".join(f"word{i} and others" for i in range(400))
    want, made = tokenizers_io.encode_many(BYTES, [text]), chunk_bpe.ChunkEncoder(BYTES, 128)
    assert made([text]) == want and made.grown == made.whole == 0
    agreed, tries = chunk_bpe.ChunkEncoder.agreed, []

    def second(left, right, bounds, ids):
        tries.append(bounds)
        return None if len(tries) % 2 else agreed(left, right, bounds, ids)

    monkeypatch.setattr(chunk_bpe.ChunkEncoder, "agreed", staticmethod(second))
    assert made([text]) == want and made.grown == len(tries) // 2 > 5
    monkeypatch.setattr(chunk_bpe.ChunkEncoder, "agreed", staticmethod(lambda *_: None))
    assert made([text]) == want and made.whole == 1


def test_memo_is_bounded_by_bytes():
    from shellac.llm.common import Memo

    memo = Memo(lambda words: [w.encode() for w in words], 1000, 10_000)
    for i in range(3000):
        memo.fill([f"word{i}", "x" * 5000])
        assert memo[f"word{i}"] and memo["x" * 5000]
    assert sum(map(len, memo)) + sum(map(len, memo.old)) < 30_000


def test_encode_and_decode(spark):
    rows = docs(spark)
    made = chunk_bpe.decode(chunk_bpe.encode(rows, BYTES), BYTES).collect()
    want = [(r["doc_id"], r["text"] or "") for r in rows.collect()]
    assert sorted((str(r["doc_id"]), hashlib.sha256(r["ids"]).hexdigest(), r["decoded"]) for r in made) == sorted((str(d), hashlib.sha256(ids_of(BYTES, t)).hexdigest(), t) for d, t in want)
    assert chunk_bpe.encode(rows.limit(0), BYTES).count() == 0


def test_decode_as_library(spark):
    r = random.Random(4)
    ids = [r.choices(range(50_257), k=20) for _ in range(200)] + [[]]
    rows = spark.createDataFrame([(i, bytearray(array("I", x).tobytes())) for i, x in enumerate(ids)] + [(999, None)], "doc_id long, ids binary")
    got = {x["doc_id"]: x["decoded"] for x in chunk_bpe.decode(rows, BYTES).collect()}
    made = tokenizers_io.tokenizer(BYTES)
    assert got == {i: made.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)} | {999: ""}


def test_edit_tree():
    count, r = edit_counts.counter(BYTES), random.Random(5)
    for _ in range(300):
        text = "".join(r.choice("ab .\n\té1'") for _ in range(r.choice([0, 5, 200])))
        tree = edit_counts.CountTree(edit_counts.segments(text), count)
        for _ in range(5):
            a, x = r.randrange(-2, len(text) + 3), r.choice(["", " ", "a", "\n", "  b", "foo bar", "\t"])
            b = a + r.choice([0, 1, 3, 30])
            a1 = min(max(0, a), len(text))
            text = text[:a1] + x + text[min(max(a1, b), len(text)) :]
            tree.edit(a, b, x)
            assert tree.text() == text and tree.total == len(ids_of(BYTES, text)) // 4


def test_edits_at_one_place_stay_small():
    count = edit_counts.counter(BYTES)
    text = "some words here. " * 300
    tree = edit_counts.CountTree(edit_counts.segments(text), count)
    for i in range(400):
        tree.edit(2000, 2000, f" new{i} words")
        text = text[:2000] + f" new{i} words" + text[2000:]
    assert tree.text() == text and tree.total == len(ids_of(BYTES, text)) // 4
    assert tree.reencoded < 400 * 60


def test_edit_counts_of_repeated_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a@b.org x"), (1, "a@b.org x"), (None, "y")], "doc_id long, text string").withColumn("n_edits", F.lit("clash"))
    edits = edit_counts.redactions(rows, [(r"[a-z]+@[a-z.]+", "<email>")])
    got = edit_counts.count_with_edits(edits, BYTES).collect()
    assert sorted((str(r["doc_id"]), r["n_edits"]) for r in got) == [("1", 1), ("1", 1), ("None", 0)]
    assert edit_counts.count_with_edits(edits.limit(0), BYTES).count() == 0


def test_edit_counts_only_reencode_near_edits(spark):
    long = "some words here. " * 2000
    rows = spark.createDataFrame([(1, long + "mail a@b.org now"), (2, None), (3, long), (4, "a@b.org c@d.org")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in edit_counts.count_with_edits(edit_counts.redactions(rows, [(r"[a-z]+@[a-z.]+", "<email>")]), BYTES).collect()}
    assert got[1]["n_edits"] == 1 and got[1]["chars_reencoded"] < 60
    assert got[1]["n_tokens_after"] == len(ids_of(BYTES, long + "mail <email> now")) // 4
    assert got[2]["n_tokens_before"] == 0 and got[3]["chars_reencoded"] == 0
    assert got[4]["n_tokens_after"] == len(ids_of(BYTES, "<email> <email>")) // 4
    nulls = rows.select("doc_id", "text", F.lit(None).alias("edits"))
    assert edit_counts.count_with_edits(nulls, BYTES).filter("n_edits > 0").count() == 0
