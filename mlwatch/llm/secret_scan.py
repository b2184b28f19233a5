"""Secrets in texts: fixed patterns, and values in credential contexts that would be costly to guess.

The cost of a value is the least number of guess bits over all its segmentations into dictionary words, dates,
repeats, keyboard walks and spans tried by brute force, found by dynamic programming over its characters. The
dictionary is a short list of common passwords, followed by the words of the corpus, most frequent first.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mlwatch.llm.rows import by_batch, table
from mlwatch.sources.shared import discard, written

# The base patterns and the shortest matches that count.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
KINDS = ("assign", "access", "hex", "guess")

# Where a value may be a credential: a name for one, then a sign or a word that assigns, then the value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?|bearer|auth(?:orization)?)"""
    r"""["']?[\x20\t]{0,4}(?:[:=]|\bis\b)[\x20\t]{0,4}(?:bearer[\x20\t]{1,4})?["']?([^\s"'<>,;|]{6,})""",
    re.IGNORECASE | re.ASCII,
)
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
# A value that costs at least so many bits to guess is a secret.
GUESS_BITS = 40.0

# Words of a corpus that are dictionary words: the most frequent ones, each in at least so many documents.
CORPUS_WORDS = 1 << 15
WORD_DOCS = 3
# The words guessed first, most common first; callers may pass a longer list.
WORDS = (
    "password pass word admin login welcome letmein secret master dragon monkey shadow sunshine princess football "
    "baseball superman batman hello love test user guest root qwerty abc iloveyou summer winter spring autumn "
    "monday friday january december money freedom whatever trustno access server system default change changeme "
    "public private token key example sample demo null none true false string value your here insert redacted"
).split()
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:3[01]|[12]\d|0?[1-9])"
    r"|(?:3[01]|[12]\d|0?[1-9])[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d"
)
DATE_BITS = math.log2(365 * 120)
LONGEST_WORD = 24


def _adjacent() -> dict[str, str]:
    """Keys next to each key: beside it, or above and below it."""
    place = {c: (r, i) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
    return {
        a: "".join(b for b, (s, j) in place.items() if a != b and abs(r - s) <= 1 and abs(i - j) <= 1)
        for a, (r, i) in place.items()
    }


ADJACENT = _adjacent()
RANKS = {w: i + 1 for i, w in enumerate(WORDS)}


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


class _Starts:
    """Where a run that is still going may begin a span, cheapest ends first known; those that can't win are left out.

    A span from ``start`` costs its value plus the logarithm of its length. The gap of two logarithms only shrinks
    as the run goes on, so a later start that isn't cheaper at once never is.
    """

    def __init__(self, least: int):
        self.least, self.known = least, []

    def cost(self, end: int, run: int, value: list[float]) -> float:
        """The least cost of a span of the run that began at ``run``, infinite where it is too short."""
        if end - run < self.least:
            self.known = []
            return math.inf
        start = end - self.least
        new = value[start] + math.log2(self.least)
        if all(new < value[s] + math.log2(end - s) for s in self.known):
            self.known = [s for s in self.known if value[s] < value[start]] + [start]
        return min(value[s] + math.log2(end - s) for s in self.known)


def guess_bits(value: str, ranks: dict[str, int] = RANKS) -> float:
    """Bits of the cheapest way to guess ``value``; 0 for the empty one. Time and memory follow its length."""
    n, lower = len(value), value.lower()
    plain = lower.translate(_LEET)
    best = [0.0] * (n + 1)
    # by brute force a character costs the size of the largest alphabet that the value uses
    brute = math.log2(max([10, *{_alphabet(c) for c in value}]) + (26 if lower != value and value.upper() != value else 0))
    dates: dict[int, list[int]] = {}
    for m in re.finditer(rf"(?=({_DATE.pattern}))", value):
        dates.setdefault(m.end(1), []).append(m.start(1))
    repeat = walk = 0  # where the run of one character, and the walk, that end here began
    repeats, walks, sloped = _Starts(3), _Starts(4), [0.0] * (n + 1)
    for end in range(1, n + 1):
        i = end - 1
        cost = best[i] + brute
        if i and lower[i] != lower[i - 1]:
            repeat = i
        if i and lower[i] not in ADJACENT.get(lower[i - 1], ""):
            walk = i
        cost = min(cost, repeats.cost(end, repeat, best) + brute)
        cost = min(cost, walks.cost(end, walk, sloped) + math.log2(47) + end)  # a bit for every turn
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + DATE_BITS)
        for start in range(max(0, end - LONGEST_WORD), end - 1):
            rank = ranks.get(plain[start:end]) or ranks.get(lower[start:end])
            if rank:
                part = value[start:end]
                changed = (part != part.lower()) + (plain[start:end] != lower[start:end]) * 2
                cost = min(cost, best[start] + math.log2(rank + 1) + changed)
            half = (end - start) // 2  # a block said twice costs little more than once
            if half >= 3 and (end - start) % 2 == 0 and lower[start : start + half] == lower[start + half : end]:
                cost = min(cost, best[start + half] + 1)
        best[end], sloped[end] = cost, cost - end
    return best[n]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and without overlap for each kind, in code points."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_CHARS:
            out.append(("assign", m.start(), m.end()))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= ACCESS_CHARS:
            out.append(("access", m.start(), m.end()))
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def guessed_spans(text: str, bits: float = GUESS_BITS, ranks: dict[str, int] = RANKS) -> list[tuple[str, int, int]]:
    """Values in credential contexts that cost ``bits`` or more to guess; closing signs are no part of them."""
    out = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".!?)]}:")
        if len(value) >= ASSIGN_CHARS and guess_bits(value, ranks) >= bits:
            out.append(("guess", m.start(1), m.start(1) + len(value)))
    return out


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def spans_of(text: str | None, bits: float = GUESS_BITS, ranks: dict[str, int] = RANKS) -> list[tuple[str, int, int]]:
    """All spans of a whole text by start, then kind. A null text has none."""
    text = text or ""
    found = base_spans(text)
    lower = text.lower()
    if any(hint in lower for hint in _HINTS):
        found += guessed_spans(text, bits, ranks)
    return _ordered(found)


def corpus_words(docs: DataFrame, text_col: str = "text", bound: int = CORPUS_WORDS, least: int = WORD_DOCS) -> list[str]:
    """The dictionary of a corpus: WORDS, then the up to ``bound`` words that most documents hold, ties by name.

    Documents are counted over all rows. Only words of letters outside credential contexts count, in at least
    ``least`` documents, so that a secret doesn't become a word by being there.
    """
    prose = F.lower(F.regexp_replace(text_col, f"(?i){CONTEXT.pattern}", " "))
    letters = F.lit(rf"(?<![\p{{L}}\p{{N}}])(\p{{L}}{{2,{LONGEST_WORD}}})(?![\p{{L}}\p{{N}}])")
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(prose, letters))).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    # written first: collected at once, the most frequent words of every task would be merged on the driver
    most = written(counted.orderBy(F.desc("n"), "word").limit(bound), "corpus-words")
    common = [r.word for r in sorted(most.collect(), key=lambda r: (-r.n, r.word))]
    discard(most)
    return list(dict.fromkeys([*WORDS, *common]))


def _ranks(words: list[str] | None) -> dict[str, int]:
    return RANKS if words is None else {w.lower(): i + 1 for i, w in enumerate(words)}


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: float = GUESS_BITS,
    words: list[str] | None = None,
) -> DataFrame:
    """(id, spans): every span of every whole text as kind, start and end in code points, by start, then kind.

    Null and empty texts have no spans. Every row gives a row, repeated ones too; extra columns are ignored.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(words))

    def run(batch: pa.RecordBatch) -> dict:
        found = [spans_of(t, bits, ranks.value) for t in batch.column(1).to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]
        return {id_col: batch.column(0), "spans": pa.array(rows, kind)}

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return by_batch(docs.select(id_col, text_col), run, schema)


def redacted_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each stretch that spans cover replaced by one mark that names the first span's kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind} removed]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_secrets(
    docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", words: list[str] | None = None
) -> DataFrame:
    """``docs`` with secrets replaced by marks, and ``length_col``, if there, set anew where the text changed.

    All rows and columns stay; null texts stay null.
    """
    text_at = docs.columns.index(text_col)
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(words))
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            found = [spans_of(t, ranks=ranks.value) for t in texts]
            clean = [redacted_text(t, s) if s else t for t, s in zip(texts, found)]
            columns = batch.columns
            columns[text_at] = pa.array(clean, columns[text_at].type)
            if length_at is not None:
                sizes = columns[length_at].to_pylist()
                columns[length_at] = pa.array(
                    [len(c) if s else n for c, s, n in zip(clean, found, sizes)], columns[length_at].type
                )
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, words=corpus_words(docs))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
