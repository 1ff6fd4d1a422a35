"""Token counts of whole texts by the whole-token shortcut.

For a byte-level BPE tokenizer, ``prove`` finds offline which vocabulary strings are one token when they are encoded
alone.  Texts are cut into pre-tokens by the tokenizer's pattern (no pre-token crosses from one run of non-space characters, with a space before it, to another,
so the count of such a run is kept and used again); a pre-token that is a proven string counts one
without any merging, and only the others are merged (each distinct one once per task, in a bounded memo).

Defined cases: null or empty text: 0 bytes, 0 tokens.  Repeated ids: a row each.  Extra columns are ignored.
Added tokens found in a text count one each, as the library does by default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import slices

MEMO = 400_000
# Unicode's White_Space, and the pre-token pattern of byte-level BPE with that class written out.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

RUN = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, spare = [""] * 256, iter(range(256, 512))
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(next(spare))
    return out


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The tokens of one pre-token: the pair of least rank is merged, the leftmost first, until none is left.  Only the pairs beside a merge are looked up again."""
    find, none = ranks.get, len(ranks)
    rank = [find(p, none) for p in zip(symbols, symbols[1:], strict=False)]
    while rank and (least := min(rank)) < none:
        at = rank.index(least)
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        del rank[at]
        if at:
            rank[at - 1] = find((symbols[at - 1], symbols[at]), none)
        if at < len(rank):
            rank[at] = find((symbols[at], symbols[at + 1]), none)
    return symbols


class Runs(dict):
    """Run of non-space characters (or of spaces) -> number of tokens, each counted when first met."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter, self.pieces = counter.__getitem__, counter.pieces

    def __missing__(self, run: str) -> int:
        if len(self) > MEMO:
            self.clear()
        n = sum(map(self.counter, self.pieces(run)))
        if len(run) < 64:
            self[run] = n
        return n


class Counter(dict):
    """Pre-token -> number of tokens.  Proven strings are there from the start; others are merged when first met."""

    def __init__(self, spec: dict, proven: list[str] | None = None):
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        self.ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.pieces = regex.compile(PATTERN).findall
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        super().__init__(dict.fromkeys(proven if proven is not None else prove(model["vocab"], self.ranks, self.letters), 1))
        self.proven = len(self)
        self.runs = Runs(self)

    def __missing__(self, piece: str) -> int:
        if len(self) > self.proven + MEMO:
            for k in list(self)[self.proven :]:
                del self[k]
        letters = self.letters
        n = self[piece] = len(merged([letters[b] for b in piece.encode("utf-8", "replace")], self.ranks)) if len(piece) < 64 else self.long(piece)
        return n

    def long(self, piece: str) -> int:
        """The same for long pre-tokens: a heap of pairs over a linked list, so that the time is n log n."""
        import heapq

        sym: list[str | None] = [self.letters[b] for b in piece.encode("utf-8", "replace")]
        n, ranks = len(sym), self.ranks
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        live = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, None
            right[i], live = right[j], live - 1
            if right[i] >= 0:
                left[right[i]] = i
            for x in (left[i], i):
                if x >= 0 and right[x] >= 0 and (r := ranks.get((sym[x], sym[right[x]]))) is not None:
                    heapq.heappush(heap, (r, x, sym[x], sym[right[x]]))
        return live

    def count(self, text: str) -> int:
        total, get = 0, self.runs.__getitem__
        if self.added and self.added.search(text):
            parts = self.added.split(text)
            total = len(parts) - 1
        else:
            parts = (text,)
        for p in parts:
            total += sum(map(get, RUN.findall(p)))
        return total


def prove(vocab: dict[str, int], ranks: dict[tuple[str, str], int], letters: list[str]) -> list[str]:
    """The vocabulary strings (as text) that are valid UTF-8 and that merging takes to exactly one token."""
    back, out = {c: b for b, c in enumerate(letters)}, []
    for s in vocab:
        try:
            text = bytes(back[c] for c in s).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if len(merged(list(s), ranks)) == 1:
            out.append(text)
    return out


@lru_cache(maxsize=2)
def counter(spec: str, proven: tuple[str, ...] | None = None) -> Counter:
    return Counter(json.loads(spec), list(proven) if proven is not None else None)


@lru_cache(maxsize=4)
def proven_strings(spec: str) -> tuple[str, ...]:
    """The strings that one token stands for, proven once before any text is read."""
    made = Counter(json.loads(spec))
    return tuple(list(made)[: made.proven])


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; tokenizer_json is the path of a byte-level BPE file on the driver (about 1.5 MB, sent once, with the strings proven)."""
    with open(tokenizer_json, encoding="utf-8") as f:
        body = f.read()
    spec = docs.sparkSession.sparkContext.broadcast((body, proven_strings(body)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*spec.value).count
        for batch in batches:
            for part in slices(batch, "text"):
                body = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode("utf-8", "replace")) for t in body], pa.int64()), pa.array(map(count, body), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return shared.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
