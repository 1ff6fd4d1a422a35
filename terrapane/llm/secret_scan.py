"""Secret scans: candidates from whole texts, false positives removed by a random forest.

A candidate is a run of [A-Za-z0-9_/+.~-] of ten characters or more, or a value of SHORT characters or more other than spaces and quotes
after a cue and ``=`` or ``:`` (in quotes, with spaces as well).  Candidates that overlap and are both taken for
secrets are one finding.  Its features: length, transitions between
character classes, letter-pair likelihood, dictionary coverage, path-likeness, and the words beside it.  The forest
is grown from labelled findings (before, value, after, label); ``labelled_findings`` makes a reproducible set of them, and
callers may pass their own.  It is small, so it is grown on the driver and sent to the tasks; texts are scanned in tasks.

Defined cases: null or empty texts have no findings; repeated rows give findings each; extra columns pass through ``redact``
unchanged.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import release, slices, string_buffers

LEAST = 10
SHORT = 4
NEAR = 48
_RUN = np.zeros(256, dtype=bool)
_RUN[[ord(c) for c in string.ascii_letters + string.digits + "_/+.~-"]] = True
CUES = ("token", "password", "passwd", "secret", "key", "apikey", "api", "auth", "bearer", "credential", "private", "pwd", "access")
BENIGN = ("commit", "sha", "md5", "checksum", "version", "id", "uuid", "phone", "card", "isbn", "order", "ref", "http", "https", "www", "mail")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live", "xoxb", "xoxp", "glpat", "AIza", "eyJ")
DICTIONARY = tuple("the and ing tion ent ers able ness ment example mail com org net www page file data test user name build index image main src lib bin etc var usr home html json xml txt log tmp conf version release".split())
_WORD = re.compile(r"[A-Za-z]+")
_CUED = re.compile(rb"(?i)(?:" + "|".join(CUES).encode() + rb")[a-z0-9_-]{0,40}[\"']?[ \t]{0,8}[=:][ \t]{0,8}(?:\"([^\"\n]{%d,})\"|'([^'\n]{%d,})'|([^\s\"']{%d,}))" % ((SHORT,) * 3))


def candidates(column: pa.Array) -> list[tuple[int, int, int]]:
    """(row, start, end) in bytes of each candidate, in order."""
    raw, off = string_buffers(column)
    solid = np.zeros(len(raw) + 2, dtype=np.int8)
    solid[1:-1] = _RUN[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[off] = True
    step = np.diff(solid)
    start = np.flatnonzero((step > 0) | (cut & (solid[1:] > 0) & (solid[:-1] > 0)))
    end = np.flatnonzero((step < 0) | (cut & (solid[1:] > 0) & (solid[:-1] > 0)))
    keep = end - start >= LEAST
    start, end = start[keep], end[keep]
    start, end = with_cued(raw, off, start, end)
    row = np.searchsorted(off, start, side="right") - 1
    return [(int(r), int(s - off[r]), int(e - off[r])) for r, s, e in zip(row, start, end, strict=True)]


def with_cued(raw: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs and the values after a cue, in order; they may overlap."""
    body = raw.tobytes()
    found = np.array([m.span(m.lastindex) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) for m in _CUED.finditer(body, a, b)], np.int64).reshape(-1, 2)
    both = np.unique(np.concatenate((np.stack((start, end), axis=1), found)), axis=0)
    return both[:, 0], both[:, 1]


_KIND = "".join("l" if chr(c).islower() else "u" if chr(c).isupper() else "d" if chr(c).isdigit() else "o" for c in range(256))
_DICT = re.compile("(?=(" + "|".join(sorted(map(re.escape, DICTIONARY), key=len, reverse=True)) + "))")
_HEX, _LETTERS = re.compile(r"[0-9a-fA-F]*\Z"), re.compile(r"[A-Za-z]+")
_CUE, CUE_SET, BENIGN_SET = re.compile("|".join(CUES)), frozenset(CUES), frozenset(BENIGN)
_MOVES = tuple(a + b for a in "ludo" for b in "ludo" if a != b)


@lru_cache(maxsize=1 << 12)
def value_features(value: str) -> tuple[float, ...]:
    """The features of a value alone, over all of its characters; linear in its length."""
    n, kinds = len(value), value.translate(_KIND) if value.isascii() else "".join(_KIND[ord(c)] if ord(c) < 256 else "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in value)
    pairs = {m: kinds.count(m) for m in _MOVES}
    move = lambda a, b: pairs[a + b] + pairs[b + a]
    entropy = math.log2(n) - sum(c * math.log2(c) for c in Counter(value).values()) / n
    low = value.lower()
    covered, end = 0, 0
    for m in _DICT.finditer(low):
        a, b = m.span(1)
        covered += max(0, b - max(a, end))
        end = max(end, b)
    letters = sum(map(len, runs := _LETTERS.findall(value)))
    vowels = sum(low.count(c) for c in "aeiou") / max(1, letters if value.isascii() else sum(c.isalpha() for c in low))
    return (
        n, *(kinds.count(k) / n for k in "ludo"), entropy, entropy / math.log2(max(n, 2)), sum(pairs.values()) / max(1, n - 1),
        move("l", "d"), move("u", "d"), move("l", "u"), covered / n, vowels, float(_HEX.match(value) is not None),
        value.count("/"), value.count("."), float("." in value[-6:]), float(value.startswith(PREFIXES)), max(map(len, runs), default=0),
    )


def features(before: str, value: str, after: str) -> list[float]:
    """The features of one candidate with the text beside it."""
    near, past = [w.lower() for w in _WORD.findall(before)[-3:]], [w.lower() for w in _WORD.findall(after)[:2]]
    glue = before.rstrip("\"' ")[-1:]
    return [
        *(value_features if len(value) < 256 else value_features.__wrapped__)(value), float("//" in before[-8:]), float(glue == "@"), float(glue in ("=", ":")), float(before[-1:] in ("\"", "'")),
        float(bool(near) and _CUE.search(near[-1]) is not None), float(not CUE_SET.isdisjoint(near)), float(not BENIGN_SET.isdisjoint(near + past)),
    ]


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(before, value, after, is a secret): findings as reviewers label them, made from patterns by a seeded generator."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexs, alnum, up = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    word = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice(("a", "e", "i", "o", "u", "ea", "ou", "ie")) + r.choice(("", "", "n", "r", "s", "st", "l", "nd")) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 6)))
    number = lambda: str(r.randint(0, 255))

    def prosaic() -> str:  # a long word of prose
        out = word()
        while len(out) < LEAST:
            out += r.choice(("", "", "", "-", "/")) + word()
        return r.choice((out, out.capitalize(), out.capitalize(), out.upper(), out.title())) + r.choice(("", "", ".", "..."))

    def secret() -> tuple[str, str, str]:
        cue = r.choice(("token", "password", "secret", "api_key", "auth", "access_key", "pwd", "client_secret", "private_key", "credential"))
        cue, glue, quote = r.choice((cue, cue.upper(), "my_" + cue)), r.choice(("=", " = ", ": ", ":", " ")), r.choice(("", '"', "'"))
        value = r.choice((lambda: pick(hexs, r.choice((18, 20, 32, 40, 64))), lambda: pick(alnum, r.randint(12, 44)), lambda: pick(alnum + "/+-_", r.randint(20, 44)), lambda: pick(string.ascii_lowercase + string.digits, r.randint(12, 24))))()
        if r.random() < 0.4:
            value, cue, quote = r.choice((lambda: "AKIA" + pick(up, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 40), lambda: "glpat-" + pick(alnum, 20), lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24)))(), "", r.choice(("", '"'))
            glue = "" if r.random() < 0.7 else glue
        if r.random() < 0.25:  # passwords and pass phrases, as short as they come
            value = r.choice((lambda: pick(alnum + "@!#$%:&*^", r.randint(8, 16)), lambda: pick(string.ascii_letters, r.randint(8, 24)), lambda: "-".join(word() for _ in range(4)), lambda: pick(alnum, r.randint(8, 9))))()
            cue, glue = cue or r.choice(("password", "pwd", "secret")), r.choice(("=", " = ", ": ", ":"))
        return f"{prose()} {cue}{glue}{quote}", value, f"{quote} {prose()}"

    def other() -> tuple[str, str, str]:
        made = r.choice((
            lambda: ("", pick(string.digits, r.choice((10, 11, 12, 13, 16, 16, 16))), ""), lambda: ("", ".".join(number() for _ in range(4)), ""), lambda: (f"{word()}.{number()}@", f"{r.choice(('mail', 'post', 'mx', 'smtp'))}{r.randint(0, 9)}.{word()}.{r.choice(('com', 'org', 'net', 'example'))}", ""), lambda: ("", f"{word()}{word()}.{r.randint(0, 99)}", f"@{word()}{r.randint(0, 9)}.{word()}.com"),
            lambda: (r.choice(("commit ", "sha ", "md5: ", "checksum = ", "md5sum ", "sha256: ")), pick(hexs, r.choice((32, 40, 64))), ""), lambda: (r.choice(("uuid ", "id: ", "ref ")), "-".join(pick(hexs, k) for k in (8, 4, 4, 4, 12)), ""), lambda: (r.choice(("", "/", "http://", "https://")), "/".join([word() for _ in range(r.randint(2, 5))] + [f"{word()}{r.randint(0, 99)}.{r.choice(('html', 'txt', 'png', 'py'))}"]), ""),
            lambda: ("", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", ""), lambda: ("version ", f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}-release", ""), lambda: ("", word() + word() + word() + str(r.randint(0, 9)), ""), lambda: (r.choice(("password=", "token: ", "api_key = ")), r.choice(("changeme123", "example1234", "your-token-here-1", "xxxxxxxxxxxx1", "0000000000000000", "placeholder_1", "1111111111", "password123")), ""), lambda: ("+1 555 ", pick(string.digits, 10), ""), *[lambda: ("", prosaic(), "")] * 5, lambda: (r.choice(("key: ", "key = ", "token: ", "access: ", "password: ", "secret: ")), r.choice((word(), "true", "none", "null", "string", "required", "public", word() + word())), ""), lambda: ("", f"{word()}_{word()}_{r.randint(0, 999)}_{word()}", ""),
        ))()
        value = made[1] if len(made[1]) >= (SHORT if made[0][-2:] in (": ", "= ") else LEAST) else made[1] + pick(string.digits, LEAST - len(made[1]))
        return f"{prose()} {made[0]}", value, f"{made[2]} {prose()}"

    return [(*(secret() if i % 2 else other()), i % 2) for i in range(n)]


class Forest:
    """A random forest on numbers: bootstrap samples, Gini splits over random features, mean of leaf shares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 48, depth: int = 10, leaf: int = 3, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            at = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[at], y[at], depth, leaf, rng, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int, rng: np.random.Generator, nodes: list[list[float]]) -> int:
        me, best = len(nodes), None
        nodes.append([-1, 0, 0, 0, y.mean()])
        if depth and 0 < y.sum() < len(y):
            for f in rng.permutation(x.shape[1])[: max(1, int(math.sqrt(x.shape[1])) + 1)]:
                order = np.argsort(x[:, f], kind="stable")
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(y))
                ok = (v[1:] > v[:-1]) & (n >= leaf) & (len(y) - n >= leaf)
                if not ok.any():
                    continue
                a, b = ones[:-1], ones[-1] - ones[:-1]
                impurity = np.where(ok, a - a * a / n + b - b * b / (len(y) - n), np.inf)
                k = int(impurity.argmin())
                if best is None or impurity[k] < best[0]:
                    best = (impurity[k], f, (v[k] + v[k + 1]) / 2)
        if best is not None:
            left = x[:, best[1]] <= best[2]
            low = self._grow(x[left], y[left], depth - 1, leaf, rng, nodes)
            high = self._grow(x[~left], y[~left], depth - 1, leaf, rng, nodes)
            nodes[me][:4] = [best[1], best[2], low, high]
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := t[at, 0] >= 0).any():
                f = np.maximum(t[at, 0], 0).astype(np.int64)
                go = np.where(x[np.arange(len(x)), f] <= t[at, 1], t[at, 2], t[at, 3]).astype(np.int64)
                at = np.where(inner, go, at)
            out += t[at, 4]
        return out / len(self.trees)


def train(findings: Sequence[tuple[str, str, str, int]] | None = None) -> Forest:
    """The forest of labelled findings (default: labelled_findings())."""
    rows = list(findings) if findings is not None else labelled_findings()
    return Forest(np.array([features(*r[:3]) for r in rows], float), np.array([r[3] for r in rows], float))


def findings_of(column: pa.Array, forest: Forest, threshold: float) -> list[tuple[int, int, int, str, float]]:
    """(row, start, end, value, probability) of the candidates that the forest takes for secrets; offsets in characters."""
    found = candidates(column)
    if not found:
        return []
    bodies: dict[int, bytes] = {r: column[r].as_py().encode("utf-8", "replace") for r in {f[0] for f in found}}
    x = [features(bodies[r][max(0, s - NEAR) : s].decode(errors="ignore"), bodies[r][s:e].decode(errors="replace"), bodies[r][e : e + NEAR].decode(errors="ignore")) for r, s, e in found]
    p = forest.predict(np.array(x, float))
    taken: list[tuple[int, int, int, float]] = []
    for (r, s, e), q in zip(found, p, strict=True):
        if q >= threshold:
            if taken and taken[-1][0] == r and s < taken[-1][2]:
                _, s, before, most = taken.pop()
                e, q = max(e, before), max(q, most)
            taken.append((r, s, e, q))
    out = []
    row, at, chars = -1, 0, 0
    for r, s, e, q in taken:
        if r != row:
            row, at, chars = r, 0, 0
        start = chars + len(bodies[r][at:s].decode(errors="replace"))
        value = bodies[r][s:e].decode(errors="replace")
        at, chars = e, start + len(value)
        out.append((r, start, chars, value, float(q)))
    return out


def scan(docs: DataFrame, findings: Sequence[tuple[str, str, str, int]] | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (characters), value, value_sha256, probability of each secret."""
    sent = docs.sparkSession.sparkContext.broadcast(train(findings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                f = findings_of(part.column(1), sent.value, threshold)
                ids = part.column(0).take(pa.array([x[0] for x in f], pa.int64()))
                sha = [hashlib.sha256(x[3].encode()).hexdigest() for x in f]
                yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in f], pa.int64()), pa.array([x[2] for x in f], pa.int64()), pa.array([x[3] for x in f], pa.string()), pa.array(sha, pa.string()), pa.array([x[4] for x in f], pa.float64())], names=["doc_id", "start", "end", "value", "value_sha256", "probability"])

    return shared.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, end long, value string, value_sha256 string, probability double")


def redact(docs: DataFrame, findings: Sequence[tuple[str, str, str, int]] | None = None, threshold: float = 0.5, text_col: str = "text", length_col: str | None = None, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns, with each secret in the text replaced by mark; length_col, if given, follows the text."""
    if length_col and length_col not in docs.columns:
        raise ValueError(f"no column {length_col} among {docs.columns}")
    sent = docs.sparkSession.sparkContext.broadcast(train(findings))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                at = part.schema.get_field_index(text_col)
                column = part.column(at)
                new = column.to_pylist()
                for r, s, e, _, _ in reversed(findings_of(column, sent.value, threshold)):
                    new[r] = new[r][:s] + mark + new[r][e:]
                cols = list(part.columns)
                cols[at] = pa.array(new, column.type)
                if length_col:
                    n = part.schema.get_field_index(length_col)
                    cols[n] = pa.array([len(t) if t is not None and t != o else k for t, o, k in zip(new, column.to_pylist(), cols[n].to_pylist(), strict=True)], cols[n].type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)
            release()

    return docs.mapInArrow(run, schema)


def documents_with_secrets(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_secrets, probability (the highest) of the documents that have any."""
    return scan(docs, **kw).groupBy("doc_id").agg(F.count("*").alias("n_secrets"), F.max("probability").alias("probability"))
