"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked symbol list, and
decoding by concatenating vocabulary strings.

The tokenizer is a file of the `tokenizers` library (model BPE, byte-level); its path is a parameter,
which every executor must be able to open. Texts are encoded whole. Each worker keeps the ids of the
pieces it met, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparrel.llm.common import extended, slices

#: Fixed value: the pattern by which byte-level tokenizers split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary strings: printable Latin-1 for itself, the
    other bytes in order as code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """One tokenizer file."""

    def __init__(self, path: str, cache: int = 1 << 19) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("unk_token") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are read here")
        letters = byte_letters()
        vocab = model["vocab"]
        self.strings = {i: bytes(letters[c] for c in s) for s, i in vocab.items()}
        ids = {s: i for i, s in self.strings.items()}
        self.first = [ids[bytes([b])] for b in range(256)]
        #: (left id, right id) -> (rank, id of both together)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}
        self.cache = cache

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. The queue holds (rank, place of the left symbol, ids of both); an entry is
        stale if either symbol has been merged away or changed since it was put there."""
        merges = self.merges
        sym = [self.first[b] for b in piece]
        n = len(sym)
        if n < 2:
            return sym
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(*got, i, sym[i], sym[i + 1]) for i in range(n - 1) if (got := merges.get((sym[i], sym[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, both, i, a, b = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = both, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if got := merges.get((both, sym[k])):
                    heapq.heappush(queue, (*got, i, both, sym[k]))
            if (h := before[i]) >= 0 and (got := merges.get((sym[h], both))):
                heapq.heappush(queue, (*got, h, sym[h], both))
        return [s for s in sym if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for null and for empty text. Strings of special tokens in the
        text become their ids."""
        out: list[int] = []
        known, merge = self.known, self.merge
        for part in self.special_pattern.split(text or "") if self.special_pattern else [text or ""]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self.pattern.findall(part):
                ids = known.get(piece)
                if ids is None:
                    ids = tuple(merge(piece.encode()))  # tuples of numbers cost the garbage collector nothing
                    if len(piece) <= 64:
                        if len(known) >= self.cache:
                            for old in [*known][: self.cache // 2]:
                                del known[old]
                        known[piece] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(df: DataFrame, text: str = "text", out: str = "ids", *, path: str | None = None) -> DataFrame:
    """Replace column `text` by `out`, an array of token ids of each whole text (empty for null). Other
    columns stay; one named like `out` is replaced."""
    path, df = path or default_path(), df.drop(*({out} - {text}))
    keep = [c for c in df.columns if c != text]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, text):
            ids = [bpe.encode(t) for t in batch.column(text).to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(ids, pa.list_(pa.int32()))], names=[*keep, out])

    return df.mapInArrow(made, extended(df.drop(text), {out: "array<int>"}))


def decode(df: DataFrame, ids: str = "ids", out: str = "text", *, path: str | None = None) -> DataFrame:
    """Replace column `ids` by `out`, the text of its vocabulary strings; null for null, and bytes that
    are no UTF-8 become U+FFFD. Other columns stay; one named like `out` is replaced."""
    path, df = path or default_path(), df.drop(*({out} - {ids}))
    keep = [c for c in df.columns if c != ids]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [None if x is None else bpe.decode(x) for x in batch.column(ids).to_pylist()]
                yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, out])

    return df.mapInArrow(made, extended(df.drop(ids), {out: "string"}))


def round_trip(df: DataFrame, text: str = "text", *, path: str | None = None) -> DataFrame:
    """Encode and decode each whole text in one pass, and keep digests only: replaces `text` by
    n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded
    text in UTF-8). Columns of these names are replaced; null text counts as empty."""
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    path, df = path or default_path(), df.drop(*(new.keys() - {text}))
    keep = [c for c in df.columns if c != text]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        number = {i: str(i) for i in bpe.strings}.__getitem__
        for batch in slices(batches, text):
            got = []
            for t in batch.column(text).to_pylist():
                ids = bpe.encode(t)
                got.append((len(ids), hashlib.sha256(",".join(map(number, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*got, strict=True)
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[*keep, *new])

    return df.mapInArrow(made, extended(df.drop(text), new))
