"""Secret scans with a trigram index.

Every rule's regular expression is turned into a Boolean query over trigrams
that any match must hold.  Each block of documents gets an inverted index (the
documents of each wanted trigram); a query's postings are intersected and
united, and the rule's expression runs over the candidates only.  A rule
without mandatory trigrams runs over all documents.  The index is by document,
so nothing is shuffled.

Spans are in code points, end exclusive, leftmost and non-overlapping for each
rule.  Defined results: null and empty texts have no spans; every row is judged
by itself, so repeated rows agree; an empty table gives an empty result; other
columns are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``group`` (0: all) must have ``least`` characters.

    ``pattern`` finds it; a match goes on through ``tail``, which can be empty.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False
    tail: str = ""

    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern + self.tail, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE_RULES = (
    # letters of the names in either case; the value's class has both cases anyway
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
# what stands between the lines of a key: blanks, also escaped, and marks of quotations, comments and strings
_BETWEEN = r"""(?:[\s>#*|"',;]|\\[nrt]|\+(?=\s))"""
# a key after its first line: all up to the END line, or without one the lines of its
# header and of base64, with a shorter line after long ones
_KEY_BODY = (
    r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
    rf"|(?:{_BETWEEN}++[A-Za-z][A-Za-z-]*+:[^\n\\]*+)*+(?:{_BETWEEN}++[A-Za-z0-9+/]{{24,}}+={{0,2}})++(?:{_BETWEEN}++[A-Za-z0-9+/]++={{0,2}}(?=[\s\"'\\]*?(?:[\n\\]|\Z)))?)?"
)
# fixed values: published formats of credentials
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", tail=_KEY_BODY),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{6,128}@[a-z0-9.-]{3,}"),
)

# --- Boolean trigram queries -------------------------------------------------
# A query is True (no demand), a trigram, or ("and" | "or", frozenset of queries).


def _both(kind: str, parts) -> object:
    parts = list(parts)
    if kind == "and":
        parts = [p for p in parts if p is not True]
    elif True in parts or not parts:
        return True
    flat = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    return True if not flat else flat.pop() if len(flat) == 1 else (kind, frozenset(flat))


def _grams(text: str) -> object:
    return _both("and", {text[i : i + 3] for i in range(len(text) - 2)})


LIMIT = 24  # alternatives of a stretch that are kept apart


def _walk(nodes) -> Iterator[object]:
    """The parts of a sequence: a set of strings it must equal, or a query that ends such a stretch."""
    for op, arg in nodes:
        if op is C.LITERAL:
            yield {chr(arg).lower()}
        elif op is C.IN and all(o in (C.LITERAL, C.RANGE) for o, _ in arg):
            some = {chr(c).lower() for o, a in arg for c in (range(a[0], a[1] + 1) if o is C.RANGE else [a])}
            yield some if len(some) <= 8 else True
        elif op is C.SUBPATTERN:
            yield from _walk(arg[3])
        elif op is C.BRANCH:
            ways = [list(_walk(way)) for way in arg[1]]
            if all(isinstance(p, set) for way in ways for p in way):
                yield {s for way in ways for s in _product(way)}
            else:
                yield _both("or", [_query(way) for way in ways])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            parts = list(_walk(inner))
            if (low, high) == (0, 1) and all(isinstance(p, set) for p in parts):
                yield {"", *_product(parts)}
            elif low == 0:
                yield True
            else:
                for _ in range(min(low, 3)):
                    yield from parts
                if low > 3 or high != low:
                    yield True
        elif op is C.AT:
            continue
        else:
            yield True


def _product(parts: list[set[str]]) -> set[str]:
    out = {""}
    for p in parts:
        out = {a + b for a in out for b in p}
    return out


def _query(parts: list[object]) -> object:
    demands, run = [], {""}
    for p in [*parts, True]:
        if isinstance(p, set) and len(run) * len(p) <= LIMIT:
            run = {a + b for a in run for b in p}
            continue
        demands.append(_both("or", [_grams(s) for s in run]))
        run = p if isinstance(p, set) and len(p) <= LIMIT else {""}
        if not isinstance(p, set):
            demands.append(p)
    demands.append(_both("or", [_grams(s) for s in run]))
    return _both("and", demands)


def trigram_query(pattern: str) -> object:
    """What lower-cased trigrams any match of ``pattern`` holds; True if none is mandatory."""
    return _query(list(_walk(_parser.parse(pattern))))


def trigrams_in(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


class Index:
    """The documents of each wanted trigram within a block of texts."""

    def __init__(self, wanted: list[str]):
        # only trigrams of single-byte characters are looked up; others demand nothing
        self.number = {g: i + 1 for i, g in enumerate(g for g in wanted if g.isascii())}
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in self.number.items():
            a, b, c = g.encode()
            self.table[a << 16 | b << 8 | c] = i
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32

    def build(self, data: np.ndarray, offs: np.ndarray) -> None:
        self.n, self.postings = len(offs) - 1, {}
        if len(data) < 3:
            return
        low = self.lower[data]
        found = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(found)
        row = np.searchsorted(offs, at, "right") - 1
        inside = at + 3 <= offs[row + 1]
        pair = np.unique(found[at[inside]].astype(np.int64) * self.n + row[inside])
        gram = pair // self.n
        for g, (rows,) in A.split(gram, pair % self.n):
            self.postings[g] = rows

    def find(self, query: object) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings.get(self.number[query], np.zeros(0, np.int64)) if query in self.number else np.arange(self.n)
        out = None
        for part in query[1]:
            got = self.find(part)
            out = got if out is None else np.intersect1d(out, got) if query[0] == "and" else np.union1d(out, got)
        return out


def rule_spans(rule: Rule, compiled: re.Pattern[str], text: str) -> list[tuple[int, int]]:
    return [m.span() for m in compiled.finditer(text) if len(m.group(rule.group)) >= rule.least]


def scan_block(texts: pa.Array, rules: tuple[Rule, ...], made: list, index: Index) -> list[list[tuple[str, int, int]]]:
    """The spans of each text, by start, then in order of the rules."""
    data, offs = A.text_bytes(texts)
    index.build(data, offs)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
    for k, (rule, (compiled, query)) in enumerate(zip(rules, made)):
        for i in index.find(query).tolist():
            text = texts[i].as_py()
            if text:
                found[i] += [(a, k, b) for a, b in rule_spans(rule, compiled, text)]
    return [[(rules[k].kind, a, b) for a, k, b in sorted(x)] for x in found]


def prepare(rules: tuple[Rule, ...]) -> tuple[list, Index]:
    made = [(r.compiled(), trigram_query(r.pattern)) for r in rules]
    return made, Index(sorted(set().union(*(trigrams_in(q) for _, q in made))))


def scan_secrets(docs: DataFrame, *, base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns the id and the spans of each text: array of (kind, start, end)."""
    rules = base + more

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, index = prepare(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for batch in A.slices(whole, text_col):
                got = scan_block(batch.column(1), rules, made, index)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in got], kind)], [id_col, "spans"])

    want = docs.select(id_col, text_col)
    return want.mapInArrow(fn, f"`{id_col}` {dict(want.dtypes)[id_col]}, spans array<struct<kind string, start int, end int>>")


def redact(docs: DataFrame, *, mark: str = "[{kind}]", base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = MORE_RULES, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The same rows with every span replaced by its kind; spans that overlap become one.

    ``length_col`` is set to the new number of code points where text changed.
    """
    rules, names = base + more, docs.columns
    at, long = names.index(text_col), names.index(length_col) if length_col else None

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, index = prepare(rules)
        for whole in batches:
            for batch in A.slices(whole, text_col):
                cols = list(batch.columns)
                texts, changed = cols[at].to_pylist(), False
                sizes = cols[long].to_pylist() if long is not None else None
                for i, spans in enumerate(scan_block(cols[at], rules, made, index)):
                    if spans:
                        changed, out, done = True, [], 0
                        for kind, a, b in spans:
                            if a >= done:
                                out += [texts[i][done:a], mark.format(kind=kind)]
                            done = max(done, b)
                        texts[i] = "".join(out) + texts[i][done:]
                        if sizes is not None:
                            sizes[i] = len(texts[i])
                if changed:
                    cols[at] = pa.array(texts, cols[at].type)
                    if sizes is not None:
                        cols[long] = pa.array(sizes, cols[long].type)
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(fn, docs.schema)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
