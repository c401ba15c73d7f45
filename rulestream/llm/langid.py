"""Language identification in two steps: the family first, then one against one within it.

A text is lower-cased, its ASCII non-letters become spaces, and byte n-grams of two to four are
hashed into tables of 65,536 places each; their relative frequencies are the features. Linear
support vector machines, trained here, first tell each language family from the others; within the
winning family one machine for each pair of languages votes. Whole texts are scored, in segments
of bounded size.

The machines are fitted on at most about ``per_lang`` documents of each language, with the share
that the hash of the id decides; their features, not their texts, come to the driver. Languages
outside the table of families are families of their own.

Defined results: a null text and one without a letter (a numeral sign is none) are ``und`` with
score 0, and so is every text if nothing could be learned. Bytes that aren't UTF-8 count as U+FFFD.
Nothing is learned from rows with a null id, and of rows that share an id and a language the first
by the hash of its text counts. Ties go to the language or family that is first by name. Repeated
rows get equal results. An empty table gives an empty table. Input columns pass through;
``lang_pred`` and ``score`` replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulestream.llm.common import add_columns, held_out, valid

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en is nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "turkic": "az kk tr uz",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

ORDERS = (2, 3, 4)
PLACES = 1 << 16
SEGMENT = 1 << 20
SCALE = 40.0
_LETTER = regex.compile(r"\p{L}")
_PLAIN = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def grams(text: str) -> list[np.ndarray]:
    """The places of a text's n-grams, for each order."""
    b = _PLAIN[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)].astype(np.uint32)
    out, code = [], b
    for order in range(2, ORDERS[-1] + 1):
        code = (code[:-1] << np.uint32(8)) | b[order - 1 :]
        out.append((code * np.uint32(2654435761)) >> np.uint32(16))
    return out


def _segments(text: str):
    for at in range(0, len(text), SEGMENT):
        yield text[at : at + SEGMENT]


@dataclass
class Machine:
    """A linear machine: positive for the first of two sides."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((len(ORDERS), PLACES), np.float32))
    bias: float = 0.0

    def margin(self, parts: list[list[np.ndarray]]) -> float:
        total = 0.0
        for k in range(len(ORDERS)):
            n = sum(len(p[k]) for p in parts)
            total += sum(float(self.weights[k].take(p[k]).sum(dtype=np.float64)) for p in parts) / max(1, n)
        return SCALE * total + self.bias


def _sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    index, value = [], []
    for k, g in enumerate(grams(text)):
        places, n = np.unique(g, return_counts=True)
        index.append(places.astype(np.int64) + k * PLACES)
        value.append(SCALE * n / max(1, len(g)))
    return np.concatenate(index), np.concatenate(value).astype(np.float32)


def fit_machine(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], epochs: int = 12, penalty: float = 1e-4, seed: int = 7) -> Machine:
    """Hinge loss by stochastic subgradient, with averaged weights; both sides weigh the same."""
    flat, mean, bias, mean_bias, t = np.zeros(len(ORDERS) * PLACES, np.float32), np.zeros(len(ORDERS) * PLACES, np.float32), 0.0, 0.0, 0
    sides = {s: sum(1 for _, y in rows if y == s) for s in (1, -1)}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            (index, value), y = rows[i]
            t += 1
            rate = 0.5 / (1 + 0.5 * penalty * t)
            if y * (float(flat[index] @ value) + bias) < 1:
                step = rate * y * min(4.0, len(rows) / (2 * sides[y]))
                flat[index] += step * value
                bias += 0.1 * step
        flat *= 1 - penalty * len(rows) * 0.1 if penalty * len(rows) < 1 else 0.9
        mean += flat
        mean_bias += bias
    return Machine((mean / epochs).reshape(len(ORDERS), PLACES), mean_bias / epochs)


@dataclass
class Model:
    families: dict[str, list[str]]
    by_family: dict[str, Machine]
    by_pair: dict[tuple[str, str], Machine]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not _LETTER.search(text):
            return "und", 0.0
        parts = [grams(s) for s in _segments(text)]
        family, sure = next(iter(self.families)), 1.0
        if len(self.families) > 1:
            margins = {f: m.margin(parts) for f, m in self.by_family.items()}
            family = max(sorted(margins), key=margins.get)
            sure = _sigmoid(2 * margins[family])
        langs = self.families[family]
        votes = {lang: [0, 0.0] for lang in langs}
        pairs = {p: self.by_pair[p].margin(parts) for p in combinations(langs, 2)}
        for (a, b), m in pairs.items():
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = max(langs, key=lambda x: votes[x])
        for (a, b), m in pairs.items():
            if best in (a, b):
                sure *= _sigmoid(2 * (m if best == a else -m))
        return best, sure


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (language, text) rows."""
    return fit_features([(lang, _sparse(text)) for lang, text in rows if lang and text and _LETTER.search(text)])


def fit_features(vectors: list[tuple[str, tuple[np.ndarray, np.ndarray]]]) -> Model:
    """A model from languages and the features of their texts."""
    langs = sorted({lang for lang, _ in vectors})
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    families = dict(sorted(families.items()))
    side = lambda inside, among: fit_machine([(x, 1 if lang in inside else -1) for lang, x in vectors if lang in among])
    by_family = {f: side(ls, langs) for f, ls in families.items()} if len(families) > 1 else {}
    by_pair = {(a, b): side([a], [a, b]) for ls in families.values() for a, b in combinations(ls, 2)}
    return Model(families, by_family, by_pair)


def train(docs: DataFrame, parts: int = 3, part: int = 1, per_lang: int = 600) -> Model:
    """A model from documents with a language that aren't held out."""
    rows = docs.select("doc_id", "lang", valid().alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    share = F.lit(0.0)
    for r in rows.groupBy("lang").count().collect():
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_lang / r["count"]))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def features(texts: list[bytes]) -> list[list]:
        found = [_sparse(t.decode()) for t in texts]
        return [[index.astype("<u4").tobytes() for index, _ in found], [value.astype("<f4").tobytes() for _, value in found]]

    told = add_columns(chosen, "places binary, shares binary", "text", lambda: features).select("doc_id", "lang", "places", "shares").collect()
    told = sorted(told, key=lambda r: (str(r["doc_id"]), r["lang"]))
    return fit_features([(r["lang"], (np.frombuffer(r["places"], "<u4").astype(np.int64), np.frombuffer(r["shares"], "<f4"))) for r in told])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fill():
        m = shared.value
        return lambda texts: [list(x) for x in zip(*(m.predict(t.decode("utf-8", "replace") if t else None) for t in texts))] or [[], []]

    return add_columns(docs, "lang_pred string, score double", "text", fill)
