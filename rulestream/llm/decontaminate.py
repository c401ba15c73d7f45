"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so that a question asked with other values has
the same template. Windows of template tokens are hashed and hash-joined with those of the
benchmark's items. Template matches must also be consistent: within one aligned copy of an item,
equal values in the item stand for equal values in the document. One name that stands for two, or
two that stand for one, end the evidence of the copy's templates; one number or unit that stands for
two may be two quantities of the same size, so the value that more windows hold counts, and windows
with another one don't; two numbers may also have become equal. A document is contaminated by an
item if what counts in its copies covers ``min_matched`` of the item's windows or ``min_share`` of
them.

Beside its templates a text has literal windows, its words in lower case without marks, which always
count; a copy needs only one of the two to match: what is a name depends on the marks and capitals
around a word, which a copy may have changed. Without placeholders both forms are the same.

A token is a number if it is made of digits and their marks or is a number word; a unit if it is in
the list of units and follows a number; a name if it is capitalised where no sentence or line
begins, or anywhere in a text that has it as such a name elsewhere. Names and number words that
follow each other with no mark between are one placeholder. The templates of windows of fewer than
``min_literals`` literal tokens say too little and aren't used; such windows match by their literal
form only, that is with the item's own values. The share is reached by all windows of the item or by
those with a usable template. An item shorter than a window is one window of its own length; one of
fewer than ``min_tokens`` tokens is in too many texts and contaminates nothing.

The benchmark's windows are broadcast after a check of their number; beyond ``broadcast_windows``
all windows of the documents are joined by shuffle instead.

Defined results: a null or empty text has no windows and is clean. Items without text or
words contaminate nothing. Repeated rows and repeated items give one row; of texts that share an id
the one with most matches is reported. Rows with a null id are reported with a null id. Bytes that
aren't UTF-8 count as U+FFFD. Empty tables give no rows. Other input columns pass through ``clean``
and aren't needed elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulestream.llm.common import col, free, text_hash, type_of, valid

WINDOW = 8
MIN_LITERALS = 4
MIN_MATCHED = 6
MIN_SHARE = 0.5
MIN_TOKENS = 4
BROADCAST_WINDOWS = 1_000_000

# Units, with their plurals and symbols.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "% percent dollar dollars euro euros cent cents usd eur mph kmh km/h °c °f degree degrees w kw kwh v volt volts watt watts j joule joules n newton newtons "
    "hz khz mhz ghz b kb mb gb tb byte bytes meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters".split()
)
# Number words with what they stand for.
NUMBERS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
    "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18",
    "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
    "hundred": "100", "thousand": "1000", "million": "1000000", "billion": "1000000000", "dozen": "12",
}
MARKS = "\"'`.,;:!?()[]{}<>|*#%&$€£«»„“”‘’…-–—_=+~^/\\"

_TOKEN = re.compile(r"\n|[^\x20\x09-\x0D]+")
_NUMBER = re.compile(r"[-+$€£]?\d[\d.,:/]*")
_OWNED = re.compile("['’]s$")
_GLUED = re.compile(r"(?<=\d)(?=[A-Za-z%°]+(?![A-Za-z0-9]))")

_CAPITAL, _END, _NUM, _UNIT, _STOP, _SAID = 1, 2, 4, 8, 16, 32
_FLAGS = 63
_M = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.uint64(0xFFFFFFFFFFFFFFFF ^ _FLAGS)
_SLOTS = np.array([0, *(xxhash.xxh3_64_intdigest(f"<{k}>".encode()) for k in ("num", "name", "unit"))], np.uint64) & _KEEP


def _describe(token: str) -> int:
    """A token's hash, with what can be said of it without its neighbours in the low bits; 0 in the rest: no token."""
    if token == "\n":
        return _END
    bare = token.strip(MARKS)
    last = token.rstrip("\"')]}»”’")[-1:]
    flags = (_END if last in (".", "!", "?", ":") else 0) | (_STOP if token[-1] in MARKS else 0)
    if not bare and token not in UNITS:
        return flags
    word = bare or token
    lower = word.lower()
    if _NUMBER.fullmatch(word):
        flags |= _NUM
    elif all(part in NUMBERS for part in lower.split("-")):
        flags |= _NUM | _SAID
    elif lower in UNITS:
        flags |= _UNIT
    if word[0].isupper() and (len(word) == 1 or word[1:].islower()):
        flags |= _CAPITAL
    return (xxhash.xxh3_64_intdigest(word.casefold().encode()) & ~_FLAGS & 0xFFFFFFFFFFFFFFFF or _FLAGS + 1) | flags


class Text(NamedTuple):
    """The tokens of a text; value: their literal hashes; kind: 0 literal, 1 number, 2 name, 3 unit; start: where template tokens begin."""

    tokens: list[str]
    value: np.ndarray
    kind: np.ndarray
    start: np.ndarray


class Templates:
    """Turns texts into template windows; remembers what it found out about tokens."""

    def __init__(self, most: int = 400_000):
        self.seen: dict[str, int] = {}
        self.most = most

    def read(self, text: str) -> Text:
        found = _TOKEN.findall(_GLUED.sub(" ", text))
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for token in set(found).difference(seen):
            seen[token] = _describe(token)
        code = np.fromiter(map(seen.__getitem__, found), np.uint64, len(found))
        flags, value = (code & np.uint64(_FLAGS)).astype(np.uint8), code & _KEEP
        begins = np.concatenate(([True], (flags[:-1] & _END) > 0))
        kept = np.flatnonzero(value)
        if len(kept) < len(found):
            # a mark that stands alone ends a run as one at the end of a word does
            apart = np.concatenate((np.diff(kept) > 1, [False])) if len(kept) else np.zeros(0, bool)
            flags, value, begins = flags[kept], value[kept], begins[kept]
            flags[apart] |= _STOP
            found = [found[i] for i in kept.tolist()]
        kind = np.zeros(len(value), np.uint8)
        capital = (flags & _CAPITAL) > 0
        kind[capital & ~begins] = 2
        kind[(flags & _NUM) > 0] = 1
        if not kind.any():
            return Text(found, value, kind, np.arange(len(value)))
        first = capital & begins & (kind == 0)
        if first.any() and (kind == 2).any():
            kind[first & np.isin(value, value[kind == 2])] = 2
        after = np.concatenate(([False], kind[:-1] == 1))
        kind[((flags & _UNIT) > 0) & after] = 3
        run = (kind == 2) | ((kind == 1) & ((flags & _SAID) > 0))
        goes_on = np.concatenate(([False], run[1:] & (kind[1:] == kind[:-1]) & run[:-1] & ((flags[:-1] & _STOP) == 0) & ~begins[1:]))
        return Text(found, value, kind, np.flatnonzero(~goes_on))

    @staticmethod
    def literal_windows(text: Text, size: int) -> np.ndarray:
        """The hashes of all windows of a size."""
        n = len(text.value) - size + 1
        return _hash((text.value[i : i + n] for i in range(size)), n, size) if n > 0 and size > 0 else np.zeros(0, np.uint64)

    @staticmethod
    def template_windows(text: Text, size: int, min_literals: int) -> tuple[np.ndarray, np.ndarray]:
        """Places, among the template tokens, and hashes of the usable windows with placeholders."""
        kind = text.kind[text.start]
        if len(kind) < size or size < 1 or not kind.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        filled = np.concatenate(([0], np.cumsum(kind > 0)))
        filled = filled[size:] - filled[:-size]
        at = np.flatnonzero((filled > 0) & (size - filled >= min(min_literals, size)))
        value = np.where(kind > 0, _SLOTS[kind], text.value[text.start])
        return at, _hash((value[at + i] for i in range(size)), len(at), size)


def _hash(columns: Iterable[np.ndarray], n: int, size: int) -> np.ndarray:
    """Hashes of ``n`` windows, given their first tokens, their second ones and so on."""
    code = np.full(n, size, np.uint64)
    for column in columns:
        code = code * _M + column
    code ^= code >> np.uint64(29)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    code ^= code >> np.uint64(32)
    return code


def _number(word: str) -> str:
    parts = word.split("-")
    return " ".join(NUMBERS[p] for p in parts) if all(p in NUMBERS for p in parts) else word


def slots(text: Text, at: int, size: int) -> list[str]:
    """The values of the placeholders of a window of template tokens, in order, with their types."""
    out = []
    begins = [*text.start[at : at + size + 1].tolist(), len(text.kind)]
    for i, end in zip(begins[:size], begins[1:]):
        if kind := text.kind[i]:
            words = [w.strip(MARKS).casefold() for w in text.tokens[i:end]]
            out.append(f"{'xnNu'[kind]}:{' '.join(map(_number, words)) if kind == 1 else _OWNED.sub('', ' '.join(words))}")
    return out


def item_windows(benchmark: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(item_id, key, literal, usable, ipos, place, islots, size, n_windows, n_usable): the distinct windows of the items.

    ``ipos`` is the place of a window's first token in the item, ``place`` its place among the tokens of its form; usable: with
    enough literals for a template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            out = []
            for i, said in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                text = templates.read(said or "")
                if len(text.value) < max(1, min_tokens):
                    continue
                size, short = min(window, len(text.value)), min(window, len(text.start))
                literal = Templates.literal_windows(text, size)
                at, keys = Templates.template_windows(text, short, min_literals)
                usable = {*text.start[at].tolist(), *(p for p in range(len(literal)) if not text.kind[p : p + size].any())}
                single = text._replace(start=np.arange(len(text.value)))
                forms = [(p, p, int(k), True, slots(single, p, size), size) for p, k in enumerate(literal.view(np.int64))]
                forms += [(int(text.start[p]), p, int(k), False, slots(text, p, short), short) for p, k in zip(at.tolist(), keys.view(np.int64))]
                out += [(i, k, same, p in usable, p, place, values, n, len(literal), len(usable)) for p, place, k, same, values, n in forms]
            names = ["item_id", "key", "literal", "usable", "ipos", "place", "islots", "size", "n_windows", "n_usable"]
            kinds = (batch.schema.field("item_id").type, pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)

    schema = f"item_id {type_of(benchmark, 'item_id')}, key bigint, literal boolean, usable boolean, ipos int, place int, islots array<string>, size int, n_windows int, n_usable int"
    return benchmark.select("item_id", valid().alias("text")).distinct().mapInArrow(run, schema)


def document_windows(docs: DataFrame, sizes: list[int], short: list[int], only: np.ndarray | None, min_literals: int = MIN_LITERALS) -> DataFrame:
    """(doc_id, th, key, literal, pos, dslots) of the documents' windows, or of those whose hash is in the sorted ``only``; dslots of template windows.

    ``sizes`` are those of literal windows, ``short`` those of templates.
    """
    shared = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, wanted = Templates(), shared.value
        if wanted is not None:
            # most windows are ruled out by the low bits of their hash
            low = np.uint64((1 << min(24, max(16, (16 * len(wanted)).bit_length()))) - 1)
            maybe = np.zeros(int(low) + 1, bool)
            maybe[wanted & low] = True

        def hits(keys: np.ndarray) -> np.ndarray:
            if wanted is None:
                return np.arange(len(keys))
            found = np.flatnonzero(maybe[keys & low])
            return found[wanted[np.minimum(np.searchsorted(wanted, keys[found]), len(wanted) - 1)] == keys[found]]

        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("th")
            for start in range(0, batch.num_rows, 64):
                rows, out = batch.column("text").slice(start, 64).to_pylist(), []
                for i, said in enumerate(rows, start):
                    if not said:
                        continue
                    text = templates.read(said)
                    for size in sizes:
                        keys = Templates.literal_windows(text, size)
                        hit = hits(keys)
                        out += [(i, k, True, p, []) for p, k in zip(hit.tolist(), keys[hit].view(np.int64).tolist())]
                    for size in short if len(text.start) < len(text.kind) or text.kind.any() else ():
                        at, keys = Templates.template_windows(text, size, min_literals)
                        hit = hits(keys)
                        out += [(i, k, False, p, slots(text, p, size)) for p, k in zip(at[hit].tolist(), keys[hit].view(np.int64).tolist())]
                taken = pa.array([r[0] for r in out], pa.int64())
                made = {"key": pa.int64(), "literal": pa.bool_(), "pos": pa.int32(), "dslots": pa.list_(pa.string())}
                yield pa.RecordBatch.from_pydict({"doc_id": ids.take(taken), "th": hashes.take(taken), **{n: pa.array([r[c] for r in out], t) for c, (n, t) in enumerate(made.items(), 1)}})

    schema = f"doc_id {type_of(docs, 'doc_id')}, th bigint, key bigint, literal boolean, pos int, dslots array<string>"
    return docs.select("doc_id", text_hash().alias("th"), valid().alias("text")).mapInArrow(run, schema)


def _consistent(aligned: DataFrame) -> DataFrame:
    """Aligned copies with the rows that count: literal matches, and template matches by a consistent mapping of values."""
    clash = lambda pairs, side="i": F.size(F.array_distinct(F.transform(pairs, lambda p: p[side]))) < F.size(pairs)
    step = aligned.withColumns({"same": F.filter("rows", lambda r: r["literal"]), "other": F.filter("rows", lambda r: ~r["literal"])})
    step = step.withColumn("told", F.flatten(F.transform("other", lambda r: F.array_distinct(r["pairs"]))))
    step = step.withColumn("pairs", F.array_distinct("told"))
    names = F.filter("pairs", lambda p: p["i"].startswith("N:"))
    step = step.withColumns({"named": clash(names) | clash(names, "d"), "mixed": clash(F.col("pairs"))})
    votes = F.transform("pairs", lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"), F.size(F.filter("told", lambda q: q == p)).alias("c")))
    step = step.withColumn("votes", F.when(F.col("mixed") & ~F.col("named"), votes))
    better = lambda q, p: (q["i"] == p["i"]) & ((q["c"] > p["c"]) | ((q["c"] == p["c"]) & (q["d"] < p["d"])))
    chosen = F.filter("votes", lambda p: ~F.exists("votes", lambda q: better(q, p)))
    step = step.withColumn("chosen", F.transform(chosen, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d"))))
    agree = F.filter("other", lambda r: F.size(F.array_except(r["pairs"], F.col("chosen"))) == 0)
    kept = F.when(F.col("named"), F.filter("other", lambda r: F.lit(False))).when(F.col("mixed"), agree).otherwise(F.col("other"))
    step = step.withColumn("rows", F.concat("same", kept)).where(F.size("rows") > 0)
    return step.select(aligned.columns)


def _matches(docs: DataFrame, benchmark: DataFrame, window: int, min_literals: int, min_matched: int, min_share: float, min_tokens: int, broadcast_windows: int) -> DataFrame:
    items = item_windows(benchmark, window, min_literals, min_tokens)
    facts = items.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("literal"), F.col("size"))).alias("sizes"), F.collect_set(F.when(~F.col("literal"), F.col("size"))).alias("short")).first()
    only = None
    if facts["n"] <= broadcast_windows:
        only = np.unique(np.array([r["key"] for r in items.select("key").distinct().collect()], np.int64).view(np.uint64))
        items = F.broadcast(items)
    found = document_windows(docs, sorted(facts["sizes"]), sorted(facts["short"]), only, min_literals).join(items, ["key", "literal"])
    found = found.withColumn("dslots", F.when(F.col("literal"), F.col("islots")).otherwise(F.col("dslots")))
    pairs = F.transform(F.arrays_zip("islots", "dslots"), lambda x: F.struct(x["islots"].alias("i"), x["dslots"].alias("d")))
    aligned = found.withColumn("pairs", pairs).groupBy("doc_id", "th", "item_id", "literal", (F.col("pos") - F.col("place")).alias("shift"))
    aligned = _consistent(aligned.agg(F.collect_set(F.struct("ipos", "literal", "usable", "pairs")).alias("rows"), F.max("n_windows").alias("n_windows"), F.max("n_usable").alias("n_usable")))
    aligned = aligned.withColumns({
        "at": F.array_distinct(F.transform("rows", lambda r: r["ipos"])),
        "usable": F.array_distinct(F.transform(F.filter("rows", lambda r: r["usable"]), lambda r: r["ipos"])),
        "pairs": F.array_distinct(F.flatten(F.transform("rows", lambda r: r["pairs"]))),
    })
    whole = aligned.groupBy("doc_id", "th", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("bigint").alias("n_matched"),
        F.size(F.array_distinct(F.flatten(F.collect_list("usable")))).alias("_matched"),
        F.max("n_windows").cast("bigint").alias("n_windows"),
        F.max("n_usable").alias("_usable"),
        F.max(F.size("pairs")).cast("bigint").alias("n_slots"),
        F.min(F.forall("pairs", lambda x: x["i"] == x["d"])).alias("same_values"),
    )
    enough = (F.col("n_matched") >= min_matched) | (F.col("n_matched") >= min_share * F.col("n_windows"))
    return whole.where(enough | ((F.col("_matched") > 0) & (F.col("_matched") >= min_share * F.col("_usable")))).drop("_matched", "_usable")


def find_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS, min_matched: int = MIN_MATCHED, min_share: float = MIN_SHARE, min_tokens: int = MIN_TOKENS, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, n_slots, same_values) of contaminated documents only."""
    best = _matches(docs, benchmark, window, min_literals, min_matched, min_share, min_tokens, broadcast_windows)
    best = best.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", "n_windows", "n_slots", "same_values")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that no item contaminates."""
    settings = dict(window=WINDOW, min_literals=MIN_LITERALS, min_matched=MIN_MATCHED, min_share=MIN_SHARE, min_tokens=MIN_TOKENS, broadcast_windows=BROADCAST_WINDOWS) | limits
    th, d, t = free(docs, "_th", "_d", "_t")
    bad = _matches(docs, benchmark, **settings).select(F.col("doc_id").alias(d), F.col("th").alias(t)).distinct()
    keyed = docs.withColumn(th, text_hash())
    return keyed.join(bad, keyed["doc_id"].eqNullSafe(bad[d]) & keyed[th].eqNullSafe(bad[t]), "left_anti").select(*map(col, docs.columns))
