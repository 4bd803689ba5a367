"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents and maps look-alike letters, digits and
symbols to Latin letters. The lexicon (words and word beginnings with log-odds
weights) and the exception phrases are learned from a bounded sample of labelled
documents; a lexicon hit that lies inside an exception phrase does not count.
A word is judged by the documents it stands in. A word beginning also begins
ordinary words now and then, so it is judged by the documents in which it is
frequent, and weighs only what its mere presence says.
The weights found are summed, normalised by the document's length, and a
two-feature logistic curve turns both into a score.

Nulls: a null or empty text has no hits and gets the score of a document without
hits (next to 0 if nothing could be learned, as from an empty table). Repeated rows get
the same score; other columns are ignored."""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from intentlane.llm.common import NON_LETTERS, is_rest, labelled_sample, materialise, table

THRESHOLD = 0.3
MAX_TRAINING_ROWS = 20_000   # labelled documents sampled for the lexicon
STEMS = range(4, 9)          # lengths of word beginnings tried as entries
FREQUENT = 0.8               # occurrences per hundred words (of 20 more than there are) of a frequent beginning

# fixed values: letters that look like a Latin letter (Cyrillic, Greek, Latin variants)
HOMOGLYPHS = {
    "а": "a", "ӑ": "a", "α": "a", "ɑ": "a", "в": "b", "β": "b", "ь": "b", "с": "c", "ϲ": "c", "ԁ": "d",
    "е": "e", "ё": "e", "є": "e", "ε": "e", "ƒ": "f", "ɡ": "g", "һ": "h", "н": "h", "η": "h", "і": "i",
    "ї": "i", "ι": "i", "ı": "i", "ј": "j", "к": "k", "κ": "k", "ⅼ": "l", "ӏ": "l", "м": "m", "μ": "m",
    "п": "n", "ո": "n", "о": "o", "ο": "o", "σ": "o", "ø": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r",
    "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ω": "w", "ѡ": "w", "ԝ": "w",
    "х": "x", "χ": "x", "у": "y", "γ": "y", "ү": "y", "ᴢ": "z", "ζ": "z",
}
# fixed values: digits and symbols written for a letter
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


def _fold_table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:  # accented, full width
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c)).lower()
        if plain != chr(cp):
            out[cp] = plain
    out |= {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()}
    out |= dict.fromkeys([*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])  # marks, invisible
    return out


_FOLD = _fold_table()
#: written for i or l only between letters, as both also end sentences and part columns
_INNER = re.compile(r"(?<=[^\W\d_])[!|](?=[^\W\d_])")


def fold(text: str | None) -> str:
    return _INNER.sub("i", (text or "").lower().translate(_FOLD))


def words_of(folded: str) -> list[str]:
    return folded.encode().translate(NON_LETTERS).decode().split()


@dataclass
class Lexicon:
    """Words, word beginnings (ending in ``*``) and phrases without weight."""
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            if entry.endswith("*"):
                word, kind = entry.rstrip("*"), "stem"
            else:
                word, kind = entry, "word"
            made.add_word(word, (*made.get(word, ()), (len(word), kind, weight)))
        for phrase in self.exceptions:
            made.add_word(phrase, (*made.get(phrase, ()), (len(phrase), "exception", 0.0)))
        if len(made):
            made.make_automaton()
        return made


def hits(automaton: ahocorasick.Automaton, folded: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) of lexicon entries that are a word, or begin a
    longer one (stems), outside exception phrases."""
    if not len(automaton):
        return []
    found, skip = [], []
    for last, entries in automaton.iter(folded):
        b = last + 1
        goes_on = b < len(folded) and folded[b].isalpha()
        for length, kind, weight in entries:
            a = b - length
            if (a and folded[a - 1].isalpha()) or goes_on != (kind == "stem"):
                continue
            if kind == "exception":
                skip.append((a, b))
            else:
                found.append((a, b, weight))
    if not skip:
        return found
    skip.sort()
    starts, reach = [a for a, _ in skip], list(accumulate((b for _, b in skip), max))
    return [h for h in found if not ((k := bisect_right(starts, h[0])) and reach[k - 1] >= h[1])]


def measure(automaton: ahocorasick.Automaton, text: str | None) -> tuple[float, float]:
    """Total weight found, and weight per hundred words."""
    folded = fold(text)
    total = sum(w for _, _, w in hits(automaton, folded))
    return total, 100.0 * total / (20.0 + len(folded.split())) if total else 0.0


def scores(lexicon: Lexicon, features: np.ndarray) -> np.ndarray:
    a, b, c = lexicon.curve
    z = a + b * np.log1p(features[:, 0]) + c * np.log1p(features[:, 1])
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


# ------------------------------------------------------------------- learning

def _entries(text: str) -> dict[str, bool]:
    """The words and word beginnings of a text; whether they count as evidence
    (a word always, a beginning where it is frequent)."""
    words = words_of(fold(text))
    stems = Counter()
    for word, n in Counter(words).items():
        for k in STEMS:
            if len(word) > k:
                stems[word[:k] + "*"] += n
    enough = FREQUENT * (20 + len(words)) / 100.0
    return dict.fromkeys(words, True) | {stem: n >= enough for stem, n in stems.items()}


def _count(rows: DataFrame, things, flush: int = 80_000) -> DataFrame:
    """(thing, pos, neg, any_pos, any_neg): labelled documents for which each
    thing is evidence, and in which it stands at all, combined per task before
    the shuffle."""
    names = ["neg", "pos", "any_neg", "any_pos"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {name: Counter() for name in names}

        def out() -> pa.RecordBatch:
            keys = list(sums["any_neg"].keys() | sums["any_pos"].keys())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([sums[n][k] for k in keys], pa.int64()) for n in names)],
                names=["thing", *names])
            for counter in sums.values():
                counter.clear()
            return batch

        for batch in batches:
            for text, label in zip(batch["_text"], batch["label"]):
                side = "pos" if label.as_py() == 1 else "neg"
                found = things(text.as_py())
                sums["any_" + side].update(found.keys())
                sums[side].update(k for k, evidence in found.items() if evidence)
                if len(sums["any_neg"]) + len(sums["any_pos"]) > flush:
                    yield out()
        yield out()

    return (rows.select("_text", "label").mapInArrow(count, "thing string, " + ", ".join(f"{n} bigint" for n in names))
            .groupBy("thing").agg(*(F.sum(n).alias(n) for n in names)))


def _ratio(rate: float) -> Column:
    """Log-likelihood ratio of a thing that goes with the positive label, which a share ``rate`` of the rows has."""
    seen = F.col("pos") + F.col("neg")
    terms = [F.when(n > 0, 2 * n * F.log(n / (seen * share))).otherwise(F.lit(0.0))
             for n, share in ((F.col("pos"), rate), (F.col("neg"), 1 - rate))]
    return terms[0] + terms[1]


def _uncovered(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows without a hit so far."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield batch.filter(pa.array([not hits(automaton, fold(t.as_py())) for t in batch["_text"]], pa.bool_()))

    return sample.select("_text", "label").mapInArrow(keep, "_text string, label int") if lexicon.weights else sample


def _find_entries(rows: DataFrame, precision: float) -> dict[str, float]:
    """Entries that go with the label far beyond chance, with log-odds weights."""
    by_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    npos, nneg = by_label.get(1, 0), sum(n for k, n in by_label.items() if k != 1)
    if not npos or not nneg:
        return {}
    counted = materialise(_count(rows, _entries).where("pos >= 3"), "toxic-entries")
    tried = counted.count()
    rate = npos / (npos + nneg)
    seen = F.col("pos") + F.col("neg")
    found = (counted.where((F.col("pos") >= F.lit(precision) * seen) & (F.col("pos") > F.lit(rate) * seen))
             .withColumn("ratio", _ratio(rate)))
    # a chance find among so many candidates is unlikely above the first bound; the
    # second leaves weaker entries to the next round, which sees only texts without a hit
    least = max([2 * math.log(max(tried, 1)) + 6, 0.2 * (found.agg(F.max("ratio")).first()[0] or 0.0)])
    kept = {r["thing"]: r for r in found.where(F.col("ratio") >= F.lit(least)).orderBy(F.desc("ratio"), "thing").collect()}
    dropped = set()
    for entry, row in kept.items():  # of a chain of beginnings: the longest that still has the chain's documents
        word = entry.rstrip("*")
        for n in STEMS:
            stem = word[:n] + "*"
            if stem != entry and n <= len(word) and stem in kept:
                dropped.add(stem if row["pos"] >= 0.97 * kept[stem]["pos"] else entry)
    weights = {entry: math.log((row["any_pos"] + 0.5) / (npos + 1)) - math.log((row["any_neg"] + 0.5) / (nneg + 1))
               for entry, row in kept.items() if entry not in dropped}
    return {entry: weight for entry, weight in weights.items() if weight > 0}


def learn_lexicon(sample: DataFrame, precision: float = 0.85, rounds: int = 3) -> Lexicon:
    """Lexicon, exceptions and score curve from (_text, label) rows. Each round
    looks for entries in the texts that the rounds before found nothing in, so
    that words which merely stand beside an entry (in copies) are not learned."""
    lexicon = Lexicon()
    for _ in range(rounds):
        new = _find_entries(_uncovered(sample, lexicon), precision)
        if not new:
            break
        lexicon.weights |= new
    if lexicon.weights:
        lexicon.exceptions = _learn_exceptions(sample, lexicon)
        lexicon.curve = _learn_curve(sample, lexicon)
    return lexicon


def _learn_exceptions(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases around an entry that hardly ever stand in toxic documents."""
    automaton = lexicon.automaton()

    def phrases(text: str) -> dict[str, bool]:
        folded = fold(text)
        out = {}
        for a, b, _ in hits(automaton, folded):
            left, right = folded[max(0, a - 40):a].split(" "), folded[a:b + 40].split(" ")
            if len(left) > 1 and left[-2].isalpha():
                out[f"{left[-2]} {right[0]}"] = True
            if len(right) > 1 and right[1].isalpha() and right[0].isalpha():
                out[f"{right[0]} {right[1]}"] = True
        return out

    rows = (_count(sample, phrases).where("neg >= 3 and pos * 9 <= neg")
            .orderBy(F.desc("neg"), "thing").collect())
    return [r["thing"] for r in rows if all(w.isalpha() for w in r["thing"].split(" "))]


def _learn_curve(sample: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [measure(automaton, t.as_py()) for t in batch["_text"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.float64()), pa.array([y for _, y in found], pa.float64()), batch["label"].cast(pa.int32())],
                names=["w", "d", "label"])

    # equal feature values are summed before they come: at most one row per sampled document
    rows = sample.select("_text", "label").mapInArrow(features, "w double, d double, label int") \
        .groupBy("w", "d", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    rows.sort()
    x = np.array([[1.0, math.log1p(r["w"]), math.log1p(r["d"])] for r in rows])
    y = np.array([float(r["label"] == 1) for r in rows])
    n = np.array([float(r["n"]) for r in rows])
    beta = np.zeros(3)
    ridge = np.diag([0.01, 0.5, 0.5])
    for _ in range(50):  # Newton steps of a logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (y - p)) - ridge @ beta
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, grad)
        beta = beta + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label: str = "toxic", modulus: int = 4, held_out: int = 2,
                   max_rows: int = MAX_TRAINING_ROWS) -> Lexicon:
    return learn_lexicon(materialise(
        labelled_sample(docs, labels, label, modulus, held_out, max_rows, id_col, text_col).select("_text", "label"),
        "toxic-sample"))


def toxicity_score(text: Column, lexicon: Lexicon) -> Column:
    """Score between 0 and 1 of a text column. The lexicon (what a bounded
    sample taught) goes along with the function."""
    @F.arrow_udf("double")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = lexicon.automaton()
        for texts in batches:
            found = np.array([measure(automaton, t.as_py()) for t in texts], np.float64).reshape(-1, 2)
            yield pa.array(scores(lexicon, found), pa.float64())
    return udf(text)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = learn_toxicity(docs, labels)
    return (docs.select("doc_id", is_rest(F.col("doc_id"), 4, 2).alias("held_out"),
                        toxicity_score(F.col("text"), lexicon).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
