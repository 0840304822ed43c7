"""Benchmark decontamination with an Aho-Corasick automaton over benchmark windows.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. Every run of
`width` consecutive words of an item is a pattern; an item with fewer words is one pattern.
One automaton holds the patterns and passes each normalised text once; hits are mapped back
to code points of the original text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usetrail.llm.common import fresh, named, text_of

WIDTH = 10
#: Text of benchmark items that one automaton holds at most; more items make more automata.
BLOCK_BYTES = 8 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
RESULT = (
    "struct<n_words: long, runs: array<struct<first: long, last: long>>, items: array<string>,"
    " spans: array<struct<start: long, end: long>>>"
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def automaton(items: list[tuple[str | None, str]], width: int) -> ahocorasick.Automaton:
    """Patterns are space-framed word runs in Latin-1 form: one character per byte."""
    patterns: dict[bytes, tuple[int, set]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - width + 1) if words else 0):
            window = words[i : i + width]
            patterns.setdefault(b" ".join(window), (len(window), set()))[1].add(item)
    made = ahocorasick.Automaton()
    for pattern, (n, ids) in patterns.items():
        made.add_word(f" {pattern.decode('latin-1')} ", (n, tuple(x for x in ids if x is not None)))
    if len(made):
        made.make_automaton()
    return made


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open runs in order, with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def scan(text: str, made: ahocorasick.Automaton) -> tuple[int, list, set]:
    """Number of words, runs of hit words, and items whose windows occur."""
    words = words_of(text)
    if not words or not len(made):
        return len(words), [], set()
    plain = b" " + b" ".join(words) + b" "
    runs, items, spaces = [], set(), None
    for end, (n, ids) in made.iter(plain.decode("latin-1")):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)
        last = int(np.searchsorted(spaces, end))
        runs.append((last - n, last))
        items.update(ids)
    return len(words), merged(runs), items


def answer(text: str, n_words: int, runs: list, items: set) -> dict:
    spans = []
    if runs:
        places = [m.span() for m in WORD.finditer(text.translate(UPPER))]
        spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in runs]
    return {
        "n_words": n_words, "runs": [{"first": a, "last": b} for a, b in runs],
        "items": sorted(items), "spans": spans,
    }


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text: str = "text",
                  item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> Column:
    """What the benchmark shares with each text, as one struct column.

    n_words; runs, the hit words as half-open word intervals; items, the ids (as strings,
    sorted) with an occurring window; spans, the runs in code points of the original text.
    Null and empty texts have no words. Items with a null id count as hits but are not
    listed; repeated items and equal windows of several items are listed once per id. The
    benchmark is sent to the executors in blocks of `block_bytes`, each an automaton of its
    own, so its size is not bounded by what one process holds in one automaton.
    """
    spark = docs.sparkSession
    asked = benchmark.select(
        named(benchmark, item).cast("string").alias("item"), text_of(benchmark, text).alias("text")
    )
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    sent = [
        spark.sparkContext.broadcast([(r.item, r.text) for r in asked.where(F.col("block") == b).collect()])
        for b in range(blocks)
    ]
    struct = pa.struct(
        [
            ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
            ("items", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    @F.arrow_udf(RESULT)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = automaton(sent[0].value, width) if len(sent) == 1 else None
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            found = [(0, [], set()) for _ in texts]
            for block in sent:
                one = made if made is not None else automaton(block.value, width)
                for i, t in enumerate(texts):
                    n, runs, items = scan(t, one)
                    found[i] = (n, found[i][1] + runs, found[i][2] | items)
            yield pa.array(
                [answer(t, n, merged(runs), items) for t, (n, runs, items) in zip(texts, found, strict=True)],
                struct,
            )

    return scanned(text_of(docs, text))


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that share no window with the benchmark, with their columns as they are."""
    (found,) = fresh(docs, "contamination")
    marked = docs.withColumn(found, contamination(docs, benchmark, width))
    return marked.where(F.size(f"{found}.runs") == 0).drop(found)
