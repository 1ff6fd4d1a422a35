"""Language identification by cross-parsing entropy.

For each language, labelled text (a bounded sample) becomes a suffix automaton.  A text is cut greedily into the longest
phrases that occur in a language's text; the language that needs the fewest phrases, normalised by the length of its
training text and of the document, wins.  Texts are reduced to lower-case letters with one space between words, and parsed in windows of ``WINDOW`` symbols (a phrase
does not cross a window), all windows of a batch in step, by table look-ups.

Defined cases: text that is null or has no letter: ``und``, score 0.  No labelled text at all: every text is ``und``.
Ties: the language that sorts first.  Every letter of the training texts has a symbol; letters that a language's text never has are
phrases of their own in it.  More than ``LABELS`` labels are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .words import release, slices, string_buffers

WINDOW = 256
TRAIN_DOCS, TRAIN_CHARS, DOC_CHARS = 96, 24_000, 600
LABELS = 1000
LETTERS = 60  # a language of more letters has a larger alphabet's share of phrases, see Model.weight
DENSE = 256  # symbols of a language whose automaton is kept as a full table


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows, offsets)."""
    raw, off = string_buffers(column)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points, begins[off]


def symbols(column: pa.Array, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets): letters by the alphabet, one space for each run of other characters between letters."""
    points, off = code_points(column)
    low = letter_table()[points]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = low > 0
    keep[1:] |= (low[:-1] > 0) & (row[1:] == row[:-1])
    out = alphabet[low[keep]]
    return out, np.concatenate(([0], np.cumsum(keep)))[off]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """The transitions (symbol to state) of each state of the suffix automaton of a symbol sequence."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur, p = len(go), last
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return go


class Parser:
    """Greedy parsing by an automaton: a state and a symbol give 4 * next state plus the phrases that end there.

    Symbols: 0 a space, 1 .. n the letters of the text, n + 1 any other letter, n + 2 padding.  A symbol that cannot follow ends the open phrase and
    opens the next one; one that never occurs is a phrase of its own.  States are multiples of the number of symbols.
    Up to DENSE symbols there is an entry for each of them in each state, else only for the transitions that exist.
    """

    def __init__(self, text: np.ndarray, letters: int):
        self.width, go = letters + 3, automaton(text)
        width = self.width
        root = np.full(width, -1, np.int64)
        root[list(go[0])] = list(go[0].values())
        self.miss = np.where(root < 0, 2, 4 * width * root + 1)
        self.miss[-1] = 1
        self.start = np.where(root < 0, 1, 4 * width * root)
        self.start[-1] = 0
        keys = np.array([k * width + c for k, to in enumerate(go) for c in to], np.int64)
        goes = np.array([4 * width * x for to in go for x in to.values()], np.int64)
        self.dense = width <= DENSE
        if self.dense:
            out = np.tile(self.miss, (len(go), 1)).astype(np.int32)
            out[0] = self.start
            self.table = out.ravel()
            self.table[keys] = goes
        else:
            order = np.argsort(keys)
            self.keys, self.goes = np.append(keys[order], np.iinfo(np.int64).max), np.append(goes[order], 0)

    def phrases(self, grid: np.ndarray) -> np.ndarray:
        """The phrases of each column of symbols."""
        state, phrases = np.zeros(grid.shape[1], np.int32 if self.dense else np.int64), np.zeros(grid.shape[1], np.int32)
        for step in grid:
            if self.dense:
                got = self.table[state + step]
            else:
                at = np.searchsorted(self.keys, state + step)
                got = np.where(self.keys[at] == state + step, self.goes[at], np.where(state > 0, self.miss[step], self.start[step]))
            phrases += (got & 3).astype(np.int32)
            state = got >> 2
        return phrases + (state > 0)


class Model:
    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        column = pa.array([" ".join(texts[n]) for n in self.names], pa.string())
        points, _ = code_points(column)
        low = letter_table()[points]
        seen = np.unique(low[low > 0])
        self.pad = len(seen) + 2  # symbols of all languages: 0 a space, 1 .. the letters, one for any other letter, one for padding
        self.alphabet = np.where(letter_table() > 0, self.pad - 1, 0).astype(np.int32)
        self.alphabet[seen] = np.arange(1, len(seen) + 1)
        flat, off = symbols(column, self.alphabet)
        parts = [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        self.parsers, self.local, sizes = [], [], []
        for part in parts:
            mine = np.unique(part[part > 0])
            own = np.full(self.pad + 1, len(mine) + 1, np.int32)
            own[0], own[mine], own[self.pad] = 0, np.arange(1, len(mine) + 1), len(mine) + 2
            self.local.append(own)
            self.parsers.append(Parser(own[part], len(mine)))
            sizes.append(len(mine))
        self.cost = np.array([np.log2(max(2, len(p))) for p in parts])
        self.weight = np.array([max(1.0, np.log2(n + 1) / np.log2(LETTERS + 1)) for n in sizes])  # what a symbol of a language with many letters says more

    def rates(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages: normalised phrases a symbol, symbols of each row)."""
        flat, off = symbols(column, self.alphabet)
        length = np.diff(off)
        lanes = -(-length // WINDOW)
        row = np.repeat(np.arange(len(length)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = off[row] + nth * WINDOW
        stop = np.minimum(begin + WINDOW, off[row + 1])
        at = begin[None, :] + np.arange(WINDOW)[:, None]
        grid = np.where(at < stop[None, :], np.append(flat, self.pad)[np.minimum(at, len(flat))], self.pad).astype(np.int32)
        out = np.zeros((len(length), len(self.names)))
        for k, parser in enumerate(self.parsers):
            phrases = parser.phrases(self.local[k][grid])
            out[:, k] = np.bincount(row, phrases, len(length)) * self.cost[k]
        return out / np.maximum(length, 1)[:, None], length

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score in 0..1, normalised phrases a symbol, by the weight of the language's symbols) of each row."""
        n = len(column)
        if not self.names:
            return ["und"] * n, np.zeros(n), np.zeros(n)
        rate, length = self.rates(column)
        best = rate.argmin(axis=1)
        low = rate[np.arange(n), best]
        rate[np.arange(n), best] = np.inf
        second = rate.min(axis=1)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, second / (second + low))
        found = length > 0
        return [self.names[b] if f else "und" for b, f in zip(best, found, strict=True)], np.where(found, score, 0.0), np.where(found, low / self.weight[best], 0.0)


_models: dict[str, Model] = {}


def model_of(key: str, texts: dict[str, list[str]]) -> Model:
    if key not in _models:
        _models.clear()
        _models[key] = Model(texts)
    return _models[key]


def sample(docs: DataFrame, lang_col: str, id_col: str = "doc_id", text_col: str = "text", docs_each: int = TRAIN_DOCS) -> dict[str, list[str]]:
    """About docs_each labelled texts a language, chosen by a hash of id and text; DOC_CHARS from the middle of each, TRAIN_CHARS a language at most.

    These bounds concern only the fitting of the classifier.  The different rows of a language are counted first (about), so that
    the share that is drawn fits the language; repeated rows are drawn once, and at most 4 * docs_each of a language reach the driver.  More than LABELS
    languages are an error.
    """
    rows = shared.texts(docs, id_col, text_col, lang_col).withColumnRenamed(lang_col, "label").where(F.col("label").isNotNull())
    drawn = F.xxhash64("id", "text", F.lit(7))
    count = {r["label"]: max(1, r["n"]) for r in rows.groupBy("label").agg(F.approx_count_distinct(drawn).alias("n")).limit(LABELS + 1).collect()}
    if len(count) > LABELS:
        raise ValueError(f"more than {LABELS} languages are labelled")
    if not count:
        return {}
    draw = F.pmod(drawn, F.lit(1 << 40))
    limit = F.create_map(*[F.lit(x) for k, n in count.items() for x in (k, min(1 << 40, int((1 << 40) * 2 * docs_each / n)))])
    picked = rows.where(draw < limit[F.col("label")]).where(F.col("text").rlike(r"\p{L}"))
    start = F.greatest(F.lit(1), F.floor((F.length("text") - DOC_CHARS) / 2) + 1).cast("int")
    once = picked.select("label", draw.alias("draw"), F.substr("text", start, F.lit(DOC_CHARS)).alias("text")).distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "text"))
    got = once.withColumn("place", place).where(F.col("place") <= 4 * docs_each).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["draw"], r["text"])):
        mine = out.setdefault(r["label"], [])
        if len(mine) < docs_each and sum(map(len, mine)) < TRAIN_CHARS:
            mine.append(r["text"])
    return out


def identify(docs: DataFrame, texts_by_language: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, phrase_rate of every row of docs, from the whole text alone."""
    import hashlib

    key = hashlib.sha1(repr(sorted(texts_by_language.items())).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(texts_by_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(key, sent.value)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                names, score, rate = model.predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rate)], names=["doc_id", "lang_pred", "score", "phrase_rate"])

    return shared.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, phrase_rate double")


def keep_identified(docs: DataFrame, texts_by_language: dict[str, list[str]], text_col: str = "text", most_rate: float = 6.0) -> DataFrame:
    """The rows of docs, all columns, whose text has a language: not ``und``, and at most most_rate normalised phrases a symbol (random letters need more)."""
    import hashlib

    key = hashlib.sha1(repr(sorted(texts_by_language.items())).encode()).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast(texts_by_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(key, sent.value)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                names, _, rate = model.predict(part.column(part.schema.get_field_index(text_col)))
                yield part.filter(pa.array([n != "und" and r <= most_rate for n, r in zip(names, rate, strict=True)], pa.bool_()))
            release()  # workers are kept between stages, so what one has freed is the next one's room

    return docs.mapInArrow(run, docs.schema)
