"""Encoders over the public tokenizer files, made once in each Python worker."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Memo, by_size, on_release

_MADE: dict = {}
on_release(_MADE.clear)


def tokenizer(path: str):
    """The library's tokenizer of a file; padding and truncation unused."""
    if path not in _MADE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_padding()
        made.no_truncation()
        _MADE[path] = made
    return _MADE[path]


#: The byte-level pre-tokenizer's pattern (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these letters, and where an added token might stand, the library itself encodes: Unicode tables may differ.
ODD = re.compile(r"[^\x00-\u024f]|<\|")


def _ranked(path: str):
    """A second engine for byte-level files whose ids are merge ranks, several times as fast; else None."""
    key = (path, "ranked")
    if key not in _MADE:
        _MADE[key] = None
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, pre, added = made["model"], made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        vocab = {t: i for t, i in model["vocab"].items() if t not in {a["content"] for a in added}}
        if (
            model["type"] == "BPE" and not made.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not model.get("ignore_merges") and len(vocab) == 256 + len(merges) and all(c in letters for t in vocab for c in t)
            and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and all(a["content"].startswith("<|") for a in added)
        ):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
            _MADE[key] = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
    return _MADE[key]


def encode_bytes(path: str, texts: list[str]) -> list[bytes]:
    """As :func:`encode_many`, with the faster engine for the texts on which both are known to agree.

    Those are texts of Latin letters and signs (below U+0250) without ``<|``, with
    which added tokens begin; all others go through the library.
    """
    quick = _ranked(path)
    if quick is None:
        return encode_many(path, texts)
    out: list[bytes | None] = [array("I", quick.encode_ordinary(t)).tobytes() if not ODD.search(t) else None for t in texts]
    rest = [i for i, x in enumerate(out) if x is None]
    for i, ids in zip(rest, encode_many(path, [texts[i] for i in rest]), strict=True):
        out[i] = ids
    return out


def encode_many(path: str, texts: list[str], run: int = 256 << 10) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, straight from the library."""
    made, out = tokenizer(path), []
    for part in by_size(texts, (len(t) for t in texts), run):
        out += [array("I", x.ids).tobytes() for x in made.encode_batch_fast(part, add_special_tokens=False)]
    return out


def _letters() -> list[str]:
    """The letters that stand for bytes 0 to 255 in byte-level files."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _word_model(path: str):
    """The library's BPE model, if its tokenizer does to a lower-case Latin word nothing before the model but write its bytes as letters."""
    state = json.loads(tokenizer(path).to_str())
    parts = [x["type"] for x in (state.get("normalizer") or {}).get("normalizers", [])]
    pre = (state.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known = (
        parts == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"]
        and "[\\p{L}]+" in pre[0]["pattern"].get("Regex", "").split("|") and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
    )
    return tokenizer(path).model if known else None


#: A word that is looked up as its two parts: letters whose lower case is one letter each, then signs but the apostrophe, with which a token may begin.
PARTED = r"^(?P<stem>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


def _gathered(pool: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` (those of ``sizes``, one behind the other) in the order of ``index``, and the size of each."""
    took = sizes[index]
    kind = np.int32 if max(len(pool), took.sum(dtype=np.int64)) < 2**31 else np.int64
    starts = np.cumsum(sizes, dtype=kind) - sizes
    at = np.repeat(starts[index] - (np.cumsum(took, dtype=kind) - took), took)
    at += np.arange(len(at), dtype=kind)
    return pool[at], took


def word_encoder(path: str, end_id: int | None = None) -> Callable[[list[str]], list[bytes]]:
    """An encoder for tokenizers that drop white space and never join words.

    Such a tokenizer (white space only separates, letters, digits and other
    signs never share a token) gives the same ids word by word: texts are cut at
    blanks and line ends, Arrow numbers the distinct words of some texts, and of
    letters and the signs behind them the distinct parts, Latin ones in lower
    case.  Only those parts are looked up one by one; each is encoded once per
    worker and kept in a bounded memo.  The ids of words and texts are gathered
    from theirs by number.  ``end_id`` is appended to each text.
    """
    key = (path, "words", end_id)
    if key in _MADE:
        return _MADE[key]
    end = b"" if end_id is None else array("I", [end_id]).tobytes()
    model, letters = _word_model(path), _letters()

    def encode_parts(parts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(parts)
        if model is not None:
            for i, w in enumerate(parts):
                if w.isalpha() and w.islower() and (w.isascii() or not ODD.search(w)):
                    out[i] = array("I", [t.id for t in model.tokenize(w if w.isascii() else "".join(letters[b] for b in w.encode()))]).tobytes()
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, encode_many(path, [parts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    memo = Memo(encode_parts, 600_000)

    def looked_up(parts: list[str]) -> list[bytes]:
        found = list(map(memo.get, parts))
        missing = [i for i, x in enumerate(found) if x is None]
        memo.fill({parts[i] for i in missing})
        for i in missing:
            found[i] = memo[parts[i]]
        return found

    def encode(texts: list[str]) -> list[bytes]:
        out = []
        for part in by_size(texts, (len(t) for t in texts), 8 << 20):
            cut = pc.split_pattern(pa.array([t.replace("\n", " ") for t in part], pa.string()), " ")
            words = cut.values.dictionary_encode()
            parted = pc.extract_regex(words.dictionary, PARTED)
            stems = pc.coalesce(pc.utf8_lower(pc.struct_field(parted, "stem")), words.dictionary)
            parts = pa.concat_arrays([stems, pc.coalesce(pc.struct_field(parted, "tail"), "")]).dictionary_encode()
            known = looked_up(parts.dictionary.to_pylist())
            sizes = np.fromiter(map(len, known), np.int32, len(known)) // 4
            ids, took = _gathered(np.frombuffer(b"".join(known), "<u4"), sizes, parts.indices.to_numpy().reshape(2, -1).T.reshape(-1))
            ids, took = _gathered(ids, took[0::2] + took[1::2], words.indices.to_numpy())
            ends = np.concatenate(([0], 4 * np.cumsum(took, dtype=np.int64)))[cut.offsets.to_numpy()].tolist()
            whole = ids.tobytes()
            out += [whole[a:b] + end for a, b in zip(ends, ends[1:])]
        return out

    _MADE[key] = encode
    return encode
