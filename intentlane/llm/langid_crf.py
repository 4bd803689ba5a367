"""Language identification by a linear-chain conditional random field.

Words are labelled within their line. A word's evidence comes from hashed byte
n-grams (with word borders: the n-grams at a border are its affixes) and from
learned lexicons; transitions between the labels of neighbouring words are
learned too, from training lines that switch between documents of two languages.
Forward-backward gives each word its label probabilities, so code-switched texts
are read word by word, and a document's language is the one with the largest sum
of probabilities over its words; the score is that sum's share.

The model is fitted on a bounded sample of labelled documents. Nulls: a null or
letterless text is ``und`` with score 0; more than MAX_LANGUAGES values of lang are
an error; a null lang is no training row; a null
doc_id is outside the held-out fold. Without training rows every text with
letters is ``und`` too. Repeated rows get the same result; other columns are
ignored. Ties go to the language first in order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from intentlane.llm.common import NON_LETTERS, hash_share, is_rest, table, text_slices

UNKNOWN = "und"
DOCS_PER_LANGUAGE = 500      # training documents a language
LINES_PER_DOC = 1.5          # training lines drawn for each training document, from its whole text
MAX_LANGUAGES = 256          # label values that a model can hold; more are an error
DIM = 1 << 16                # hashed n-gram features
NGRAMS = (1, 2, 3, 4)        # bytes, word borders included
LINE = 30                    # words of a training line
_CACHE = 200_000             # distinct words whose evidence a task keeps
_BLOCK_BYTES = 1 << 20       # text labelled at once


def line_words(line: str) -> list[bytes]:
    return line.lower().encode().translate(NON_LETTERS).split()


def has_letter(word: bytes) -> bool:
    """ASCII bytes that are left are letters; others are looked up."""
    return word.isalpha() or any(c.isalpha() for c in word.decode(errors="ignore"))


# ------------------------------------------------------------------- features

def ngram_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word index) of all n-grams of the bordered words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    raw = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in words]), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    feature, word = [], []
    code = np.zeros(len(raw), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        code = code[:len(raw) - n + 1] * np.uint64(257) + raw[n - 1:]
        whole = owner[:len(raw) - n + 1] == owner[n - 1:]
        if n in NGRAMS:
            mixed = (code[whole] * np.uint64(4) + np.uint64(n - 1)) * np.uint64(0x9E3779B97F4A7C15)
            feature.append((mixed >> np.uint64(48)).astype(np.int64) % DIM)
            word.append(owner[:len(raw) - n + 1][whole])
        code = code[:len(raw) - n + 1]
    return np.concatenate(feature), np.concatenate(word)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray              # (DIM + labels, labels): n-grams, then lexicon membership
    transitions: np.ndarray          # (labels, labels) log weights
    start: np.ndarray
    lexicon: dict[bytes, int]

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Log evidence per word and label; n-grams are averaged, so long words weigh no more."""
        feature, word = ngram_features(words)
        out = np.empty((len(words), len(self.labels)))
        count = np.maximum(np.bincount(word, minlength=len(words)), 1)
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(word, self.weights[feature, k], minlength=len(words)) / count
        known = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        if known:
            at, lex = np.array(known).T
            out[at] += self.weights[DIM + lex]
        return out


def forward_backward(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                     a: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Label probabilities of every word. e: positive evidence (words, labels);
    lines lie one after another from ``starts``. All lines advance together,
    the longest first, so the lines still running are a leading slice."""
    order = np.argsort(-lengths, kind="stable")
    s, n = starts[order], lengths[order]
    longest = int(n[0]) if len(n) else 0
    running = np.searchsorted(-n, -np.arange(longest + 1), side="left")  # lines longer than t
    alpha = np.empty_like(e)
    f = None
    for t in range(longest):
        at = s[:running[t]] + t
        f = (pi if t == 0 else f[:running[t]] @ a) * e[at]
        f /= f.sum(1, keepdims=True)
        alpha[at] = f
    b = np.ones((0, e.shape[1]))
    for t in range(longest - 2, -1, -1):
        at = s[:running[t]] + t
        new = np.ones((len(at), e.shape[1]))
        on = running[t + 1]
        full = np.ones((on, e.shape[1]))
        full[:len(b)] = b
        new[:on] = (full * e[s[:on] + t + 1]) @ a.T
        new /= new.sum(1, keepdims=True)
        alpha[at] *= new
        b = new
    return alpha / alpha.sum(1, keepdims=True)


def label_texts(model: Crf, texts: list[str | None], cache: dict) -> tuple[list[str], np.ndarray]:
    """Language and score per text."""
    k = len(model.labels)
    ids, doc, lengths, fresh = [], [], [], []
    index, table_ = cache.setdefault("index", {}), cache.setdefault("rows", [])
    start = len(table_)
    for d, text in enumerate(texts):
        for line in (text or "").split("\n"):
            words = line_words(line)
            if not words:
                continue
            row = [index.get(w, -1) for w in words]
            if -1 in row:
                for i, w in enumerate(words):
                    if row[i] < 0:
                        at = index.get(w)
                        if at is None:
                            at = index[w] = start + len(fresh) if has_letter(w) else -2
                            if at >= 0:
                                fresh.append(w)
                        row[i] = at
            row = [i for i in row if i >= 0] if min(row) < 0 else row
            if row:
                ids.extend(row)
                doc.append(d)
                lengths.append(len(row))
    if not ids or not k:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    if fresh:
        table_.extend(model.evidence(fresh))
    lengths_ = np.array(lengths)
    lines = np.repeat(np.array(doc), lengths_)
    # the evidence of the words in use only
    used, place = np.unique(np.array(ids), return_inverse=True)
    own = np.array([table_[i] for i in used])
    e = np.exp(own - own.max(1, keepdims=True))[place]
    starts = np.concatenate([[0], np.cumsum(lengths_)[:-1]])
    p = forward_backward(np.maximum(e, 1e-12), starts, lengths_, np.exp(model.transitions), np.exp(model.start))
    total = np.stack([np.bincount(lines, p[:, j], minlength=len(texts)) for j in range(k)], axis=1)
    words = total.sum(1)
    best = total.argmax(1)
    share = np.where(words > 0, total[np.arange(len(texts)), best] / np.maximum(words, 1e-9), 0.0)
    return [model.labels[b] if w > 0 else UNKNOWN for b, w in zip(best, words)], np.clip(share, 0.0, 1.0)


# ------------------------------------------------------------------- training

def training_words(docs: DataFrame, allowed: Column, id_col: str, text_col: str, lang_col: str,
                   per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], list[tuple[str, list[bytes]]]]:
    """Labels, and (label, consecutive words) of a bounded sample of documents:
    ``per_language`` a language, those with the smallest hashes of their id. An
    id that several documents share gives one, with the text of the smallest hash."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & allowed) \
        .select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    counts = rows.groupBy("_lang").agg(F.approx_count_distinct("_id").alias("_n")).limit(MAX_LANGUAGES + 1)
    seen = {r["_lang"]: r["_n"] for r in counts.collect()}
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of {lang_col}: the model holds a weight of each feature for each of them")
    labels = sorted(seen)
    if not labels:
        return [], []
    shares = rows.sparkSession.createDataFrame(
        [(x, min(1.0, 1.5 * per_language / max(n, 1))) for x, n in seen.items()], "_lang string, _share double")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = b" ".join(w for w in line_words(batch["_text"][i].as_py()) if has_letter(w))
                yield pa.RecordBatch.from_arrays([batch["_lang"].slice(i, 1), batch["_hash"].slice(i, 1), pa.array([text], pa.binary())],
                                                 names=["lang", "hash", "words"])

    drawn = (rows.join(F.broadcast(shares), "_lang").where(hash_share("langid", F.col("_id")) < F.col("_share"))
             .withColumn("_hash", F.xxhash64("_text"))
             .groupBy("_id").agg(F.min_by(F.struct("_lang", "_text", "_hash"), F.struct("_hash", "_lang")).alias("d")).select("_id", "d.*"))
    # about 1.5 times as many rows as are kept stand in a language's window
    cut = Window.partitionBy("_lang").orderBy(hash_share("langid", F.col("_id")), "_hash")
    sample = (drawn.withColumn("_nth", F.row_number().over(cut)).where(F.col("_nth") <= per_language)
              .select("_lang", "_text", "_hash")
              .mapInArrow(windows, "lang string, hash bigint, words binary").where("length(words) > 0"))
    got = sorted((r["lang"], r["hash"], bytes(r["words"])) for r in sample.collect())
    return labels, [(lang, words.split(b" ")) for lang, _, words in got]


def fit(labels: list[str], sample: list[tuple[str, list[bytes]]], seed: int = 7, epochs: int = 4) -> Crf:
    """Maximum conditional likelihood by AdaGrad over batches of lines."""
    k = len(labels)
    code = {x: i for i, x in enumerate(labels)}
    crf = Crf(labels, np.zeros((DIM + k, k)), np.zeros((k, k)), np.zeros(k), {})
    if k == 0 or not sample:
        return Crf([], np.zeros((DIM, 0)), np.zeros((0, 0)), np.zeros(0), {})
    rng = np.random.default_rng(seed)
    by_label = [[w for lang, w in sample if code[lang] == i] for i in range(k)]
    present = [i for i in range(k) if by_label[i]]
    crf.lexicon = _lexicon(by_label)
    vocabulary: dict[bytes, int] = {}
    lines, targets = [], []
    for _ in range(max(1, int(sum(map(len, by_label)) * LINES_PER_DOC))):
        line, target = [], []
        lang = int(rng.choice(present))
        while len(line) < LINE:
            doc = by_label[lang][rng.integers(len(by_label[lang]))]
            size = int(rng.integers(3, LINE + 1))
            at = int(rng.integers(0, max(1, len(doc) - size + 1)))
            piece = doc[at:at + size][:LINE - len(line)]
            line.extend(vocabulary.setdefault(w, len(vocabulary)) for w in piece)
            target.extend([lang] * len(piece))
            lang = int(rng.choice(present))  # switch inside the line
        lines.append(line)
        targets.append(target)
    words = list(vocabulary)
    feature, owner = ngram_features(words)
    order = np.argsort(owner, kind="stable")
    feature, first = feature[order], np.searchsorted(owner[order], np.arange(len(words) + 1))
    lex = np.array([crf.lexicon.get(w, -1) for w in words])
    lines_, targets_ = np.array(lines), np.array(targets)
    sums = [np.full_like(x, 1e-3) for x in (crf.weights, crf.transitions, crf.start)]
    rate = (2.0, 0.2, 0.2)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(lines_)), max(1, len(lines_) // 64)):
            flat, y = lines_[at].reshape(-1), targets_[at]
            used, place = np.unique(flat, return_inverse=True)
            spans = np.concatenate([np.arange(first[u], first[u + 1]) for u in used])
            size = first[used + 1] - first[used]
            f, own = feature[spans], np.repeat(np.arange(len(used)), size)
            scale = 1.0 / np.maximum(size, 1)
            log_e = np.stack([np.bincount(own, crf.weights[f, j], minlength=len(used)) * scale for j in range(k)], 1)
            has = lex[used] >= 0
            log_e[has] += crf.weights[DIM + lex[used][has]]
            grads = _gradient(log_e[place].reshape(*y.shape, k), y, crf)
            d_word = np.stack([np.bincount(place, grads[0].reshape(-1, k)[:, j], minlength=len(used)) for j in range(k)], 1)
            d_w = np.zeros_like(crf.weights)
            for j in range(k):
                d_w[:DIM, j] = np.bincount(f, (d_word[:, j] * scale)[own], minlength=DIM)
            np.add.at(d_w, DIM + lex[used][has], d_word[has])
            for x, g, s, r in zip((crf.weights, crf.transitions, crf.start), (d_w, *grads[1:]), sums, rate):
                g = g / len(at)
                s += g * g
                x += r * g / np.sqrt(s)
    return crf


def _lexicon(by_label: list[list[list[bytes]]], least: int = 8, share: float = 0.8) -> dict[bytes, int]:
    """Words of the sample that nearly always carry one label."""
    counts = [Counter(w for words in ws for w in words) for ws in by_label]
    totals = [max(1, sum(c.values())) for c in counts]
    out = {}
    for i, c in enumerate(counts):
        for w, n in c.items():
            rate = [x[w] / t for x, t in zip(counts, totals)]
            if n >= least and rate[i] >= share * sum(rate):
                out[w] = i
    return out


def _gradient(log_e: np.ndarray, y: np.ndarray, crf: Crf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observed minus expected counts: per word evidence, transitions, start."""
    b, t, k = log_e.shape
    e = np.exp(log_e - log_e.max(2, keepdims=True)) + 1e-12
    a, pi = np.exp(crf.transitions), np.exp(crf.start)
    f, r = np.empty_like(e), np.ones_like(e)
    f[:, 0] = pi * e[:, 0]
    f[:, 0] /= f[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        f[:, i] = (f[:, i - 1] @ a) * e[:, i]
        f[:, i] /= f[:, i].sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        r[:, i] = (r[:, i + 1] * e[:, i + 1]) @ a.T
        r[:, i] /= r[:, i].sum(1, keepdims=True)
    p = f * r
    p /= p.sum(2, keepdims=True)
    pair = f[:, :-1, :, None] * a * (e[:, 1:] * r[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    one = np.eye(k)[y]
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:, :-1].reshape(-1), y[:, 1:].reshape(-1)), 1.0)
    return one - p, seen - pair.sum((0, 1)), (one[:, 0] - p[:, 0]).sum(0)


def train_langid(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> Crf:
    return fit(*training_words(docs, allowed, id_col, text_col, lang_col, per_language))


def predict_language(text: Column, model: Crf) -> Column:
    """struct(lang_pred, score) of a text column. The model has a fixed size
    (DIM weights a language, and a lexicon of the sample's words)."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        crf, cache = shared.value, {}
        for texts in batches:
            langs, score = [], [np.zeros(0)]
            for part in text_slices(texts, _BLOCK_BYTES):
                if len(cache.get("index", ())) > _CACHE:
                    cache = {}
                x, s = label_texts(crf, part.to_pylist(), cache)
                langs += x
                score.append(s)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(score), pa.float64())],
                                             names=["lang_pred", "score"])
    return udf(text)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = is_rest(F.col("doc_id"), 4, 2)
    model = train_langid(docs, ~held_out)
    return (docs.select("doc_id", held_out.alias("held_out"), predict_language(F.col("text"), model).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))
