"""BPE encoding and decoding of whole texts with a word-end vocabulary.

The merges of a word are never replayed. Each task collects the distinct words of a batch of texts, sorts them
(sorted order is the depth-first order of their trie) and keeps, for the path from the root to the current word, the
last token of the encoding of every prefix. A prefix that several words share is thus encoded once. The last token of
a longer prefix is the longest vocabulary entry that ends it and that may stand beside the last token before it.

Word encodings are kept from batch to batch up to ``CACHE_WORDS`` words, after which the store starts anew, so the
memory of a task has a bound. Texts are spread by Spark and nothing is shuffled.

Nulls are encoded as the empty text: no tokens, the decoded text is empty. Repeated rows are encoded like any others,
other columns (of any name) are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What this encoder expects of a vocabulary file besides its words and merges.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
EXPECTED = {"normalizer": NORMALIZER, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}, "decoder": None}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: Most distinct words a task keeps the encodings of.
CACHE_WORDS = 400_000


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: Latin-1 printables for themselves, others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _lower(text: str) -> str:
    """Lower case character by character: the capital sigma knows no final form here."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class WordBpe:
    """Encoder and decoder of one vocabulary file (its JSON text) with an end-of-word suffix."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        wrong = [k for k, v in EXPECTED.items() if d.get(k) != v] + [k for k, v in MODEL.items() if model.get(k, v) != v]
        wrong += [t["content"] for t in d.get("added_tokens", []) if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
        if wrong:
            raise ValueError(f"this encoder does not know how the vocabulary file has {', '.join(wrong)}")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.strings = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.strings |= {i: t for t, i in self.special.items()}
        self.bytes = _byte_chars()
        v = self.vocab
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[v[a], v[b]] = r
            parts.setdefault(v[a + b], (v[a], v[b], r))
        self.parts = parts
        #: Symbols of a token, and the longest of all.
        self.length = {i: len(t.removesuffix(self.end)) if self.end else len(t) for t, i in v.items()}
        self.longest = max(self.length.values())
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
        self.ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of ``token`` while it is being merged, with the rank that makes the next one."""
        store = self._right if side else self._left
        if (got := store.get(token)) is None:
            chain, t = [], token
            after = float("inf")
            while True:
                chain.append((t, after))
                if t not in self.parts:
                    break
                after = self.parts[t][2]
                t = self.parts[t][side]
            got = store[token] = chain[::-1]
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's symbols, side by side, give a and b again: no merge crosses their border first."""
        key = (a, b)
        if (got := self._fits.get(key)) is not None:
            return got
        left, right, rank = self._edge(a, 1), self._edge(b, 0), self.rank
        i = j = 0
        ok = True
        while True:
            (x, next_x), (y, next_y) = left[i], right[j]
            r = rank.get((x, y))
            if r is not None and r < next_x and r <= next_y:
                ok = False
                break
            if next_x == next_y == float("inf"):
                break
            if next_x <= next_y:
                i += 1
            else:
                j += 1
        if len(self._fits) > 1_000_000:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Token ids of distinct words (in byte characters), by one depth-first pass over their trie."""
        vocab, length, longest, end, fits = self.vocab, self.length, self.longest, self.end, self.fits
        last: list[int] = []  # last[i]: last token of the encoding of path[: i + 1]
        path = ""

        def step(text: str, i: int, suffix: str) -> int:
            """Last token of text[: i + 1], the last symbol having the suffix."""
            for n in range(min(longest, i + 1), 0, -1):
                t = vocab.get(text[i + 1 - n : i + 1] + suffix)
                if t is not None and (n == i + 1 or fits(last[i - n], t)):
                    return t
            raise ValueError(f"no token ends {text[: i + 1]!r}")

        for word in sorted(words):
            n = len(word) - 1
            k, top = 0, min(n, len(last))
            while k < top and path[k] == word[k]:
                k += 1
            del last[k:]
            for i in range(k, n):
                last.append(step(word, i, ""))
            path = word
            t, i, ids = step(word, n, end), n, []
            while True:
                ids.append(t)
                i -= length[t]
                if i < 0:
                    break
                t = last[i]
            yield word, ids[::-1]

    def pieces(self, text: str) -> list[str | int]:
        """Words of a text in order; ints are special tokens."""
        out: list[str | int] = []
        for k, part in enumerate(self.split(text)) if self.split and "<" in text else ((0, text),):
            if k % 2:
                out.append(self.special[part])
            elif part.isascii():
                out += self.ascii_words(part.lower())
            else:
                out += self.words(_lower(unicodedata.normalize("NFC", part)))
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = {w for p in split for w in p if w not in known}
        if new:
            chars = self.bytes
            coded = {}
            for w in new:
                if isinstance(w, int):
                    known[w] = w.to_bytes(4, "little")
                else:
                    coded["".join([chars[b] for b in w.encode()])] = w
            for c, ids in self.encode_words(list(coded)):
                a = array("I", ids)
                if sys.byteorder == "big":
                    a.byteswap()
                known[coded[c]] = a.tobytes()
        return [b"".join([known[w] for w in p]) for p in split]

    def decode(self, ids: bytes) -> str:
        """The token strings with single spaces between: the files in use name no decoder."""
        a = array("I", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return " ".join(map(self.strings.__getitem__, a))


_OPEN: dict[int, WordBpe] = {}


def _open(spec: str) -> WordBpe:
    """The worker's encoder for a vocabulary; it lives on from task to task."""
    key = hash(spec)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = WordBpe(spec)
    return _OPEN[key]


def encode(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Encode every text: ``id_col``, ``ids`` (binary, little-endian unsigned 32-bit), and ``decoded`` if asked for.

    ``tokenizer_json`` is the text of a vocabulary file, whose size is fixed whatever the input, hence broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _open(spec.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = bpe.encode_batch(batch.column(1).to_pylist())
                cols = [batch.column(0), pa.array(ids, pa.binary())]
                if decoded:
                    cols.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "ids", "decoded"][: len(cols)])

    schema = f"`{id_col}` {id_type}, ids binary" + ", decoded string" * decoded
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def digests(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Per document the number of tokens, and SHA-256 of ids and of the decoded text."""
    out = encode(docs, tokenizer_json)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
