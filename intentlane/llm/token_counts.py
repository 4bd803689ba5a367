"""Token counts per section or field by offset-mapped attribution.

A document is encoded once, as a whole, by a public byte-level tokenizer. The
tokens' byte lengths give their character spans, which are joined as intervals
with the spans of the document's sections (its lines, or the fields it was put
together from). A token that crosses a border is allocated by an explicit rule:

- ``majority``: the section that holds most of its characters, the earlier of equals
- ``start``: the section that holds its first character
- ``fraction``: every section by its share of the characters

Characters outside all sections count for none of them; a token without a
character in any section is not attributed. Nulls: a null or empty text has one
empty section with no tokens; a null field is an empty field. Repeated rows are
counted one by one; other columns are ignored."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from intentlane.llm.common import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_TOKENIZER_BYTES = 64 << 20
# fixed value: the pre-tokenisation pattern that belongs to the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("majority", "start", "fraction")


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The vocabulary file, by Spark's reader; its size is checked, as it goes to every worker."""
    row = spark.read.format("binaryFile").load(path).select("length", "content").first()
    if row["length"] > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} has {row['length']} bytes, more than {MAX_TOKENIZER_BYTES}")
    return bytes(row["content"])


class Tokenizer:
    def __init__(self, ranks: bytes):
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={})
        self.lengths = np.zeros(max(pairs.values()) + 1, np.int64)
        for token, rank in pairs.items():
            self.lengths[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last character of every token. A token of part of
        a character spans that character."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if len(text) != (ends[-1] if len(ends) else 0):
            raw = np.frombuffer(text.encode(), np.uint8)
            char = np.cumsum((raw & 0xC0) != 0x80) - 1
            return char[starts], char[ends - 1] + 1
        return starts, ends


def attribute(start: np.ndarray, end: np.ndarray, first: np.ndarray, past: np.ndarray, rule: str) -> np.ndarray:
    """Tokens (possibly fractions) per section; sections are in order and apart."""
    out = np.zeros(len(first))
    if not len(first) or not len(start):
        return out
    a = np.searchsorted(past, start, side="right")            # first section that ends after the token starts
    b = np.searchsorted(first, end, side="left") - 1          # last section that starts before the token ends
    inside = a == b
    out += np.bincount(a[inside], minlength=len(first))[:len(first)]
    if rule == "fraction":
        one = np.flatnonzero(inside)
        held = np.minimum(end[one], past[a[one]]) - np.maximum(start[one], first[a[one]])
        out -= np.bincount(a[one], 1 - held / (end[one] - start[one]), minlength=len(first))
    for t in np.flatnonzero(a < b):
        over = np.minimum(end[t], past[a[t]:b[t] + 1]) - np.maximum(start[t], first[a[t]:b[t] + 1])
        over = np.maximum(over, 0)
        if rule == "fraction":
            out[a[t]:b[t] + 1] += over / (end[t] - start[t])
        else:
            out[a[t] + (int(over.argmax()) if rule == "majority" else int(np.flatnonzero(over)[0]))] += 1
    return out


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text, each with its line feed."""
    sizes = [len(x) + 1 for x in text.split("\n")]
    sizes[-1] -= 1
    past = np.cumsum(sizes)
    first = past - sizes
    if len(sizes) > 1 and sizes[-1] == 0:  # the text ends with a line feed
        return first[:-1], past[:-1]
    return first, past


def fields_text(fields: list[tuple[str, Column]], separator: str = "\n") -> tuple[Column, Column]:
    """One text of several fields, and its sections (name, start, end)."""
    values = [F.coalesce(c.cast("string"), F.lit("")) for _, c in fields]
    spans, at = [], F.lit(0)
    for (name, _), v in zip(fields, values):
        spans.append(F.struct(F.lit(name).alias("name"), at.cast("int").alias("start"),
                              (at + F.char_length(v)).cast("int").alias("end")))
        at = at + F.char_length(v) + F.lit(len(separator))
    return F.concat_ws(separator, *values), F.array(*spans)


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, sections: Column | None = None,
                   tokenizer: str = TOKENIZER, rule: str = "majority") -> DataFrame:
    """(id, section, name, char_start, char_end, n_tokens), one row per section.

    ``sections`` is an array of (name, start, end) in characters, in order and
    apart; without it the sections are the lines of the text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(spark, tokenizer))
    text = F.col("text") if text is None else text
    given = sections is not None
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *([sections.alias("sections")] if given else []))
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizer(ranks.value)
        for batch in batches:
            at, names, cuts, counts, numbers = [], [], [], [], []
            spans = batch["sections"].to_pylist() if given else None
            for n, value in enumerate(batch["text"]):
                value = value.as_py() or ""
                if given:
                    here = spans[n] or [{"name": None, "start": 0, "end": 0}]
                    first, past = np.array([s["start"] for s in here]), np.array([s["end"] for s in here])
                    names += [s["name"] for s in here]
                else:
                    first, past = line_spans(value)
                    names += ["line"] * len(first)
                counts.append(attribute(*tok.spans(value), first, past, rule))
                at += [n] * len(first)
                numbers.append(np.arange(len(first)))
                cuts.append((first, past))
            if at:
                yield pa.RecordBatch.from_arrays([
                    batch["id"].take(pa.array(at)), pa.array(np.concatenate(numbers), pa.int32()), pa.array(names, pa.string()),
                    pa.array(np.concatenate([c[0] for c in cuts]), pa.int64()),
                    pa.array(np.concatenate([c[1] for c in cuts]), pa.int64()),
                    pa.array(np.concatenate(counts), pa.float64())],
                    names=["id", "section", "name", "char_start", "char_end", "n"])

    out = rows.mapInArrow(count, f"id {kind}, section int, name string, char_start bigint, char_end bigint, n double")
    n = F.col("n") if rule == "fraction" else F.col("n").cast("bigint")
    return out.select(F.col("id").alias(id_col), "section", "name", "char_start", "char_end", n.alias("n_tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents")).drop("name")
