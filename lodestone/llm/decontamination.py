"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised items become one automaton over words (in blocks of bounded size when there
are many). Training words are streamed through it: at every word the automaton knows the
longest stretch ending there that also occurs in an item. Stretches over the length limit
are spans to remove, and a document that is covered too far goes as a whole.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Workspace, byte_texts, table

#: Words of one automaton at most (a single longer item still makes one block). An automaton
#: has fewer than two states per word, so what is broadcast stays below about 100 MB.
BLOCK_WORDS = 200_000
WINDOW = 10
#: A document goes as a whole when at least this share of its words is in benchmark spans.
MAX_COVERAGE = 0.5

# A-Z become a-z; every ASCII byte other than a letter or digit parts words; others stay.
_FOLD = bytes(
    i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32
    for i in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z."""
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with what each state stands for.

    ``window[s]``: the state of the last ``width`` words when the stretch at s is that long,
    or -1. ``whole[s]``: the nearest state on the suffix chain that is a whole short item, or
    -1. ``items[s]``: ids of the items that have the window, or are the short item, at s.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = []
        for item, words in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            numbered.append((item, codes))
            last = 0
            for code in codes:
                last = self._extend(last, code)
        self._describe(numbered)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, code: int) -> int:
        """The part of state q that is entered from p, as a state of its own where needed."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(code) == q:
            self.next[p][code] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, code: int) -> int:
        known = self.next[last].get(code)
        if known is not None:
            return self._split(last, known, code)
        state = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and code not in self.next[p]:
            self.next[p][code] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, self.next[p][code], code)
        return state

    def _describe(self, numbered: list[tuple[int, list[int]]]) -> None:
        size, width = len(self.next), self.width
        by_length = sorted(range(size), key=self.length.__getitem__)
        self.window, self.whole = [-1] * size, [-1] * size
        self.items: dict[int, set] = {}
        short = set()
        for item, codes in numbered:
            if 0 < len(codes) < width:
                state = 0
                for code in codes:
                    state = self.next[state][code]
                short.add(state)
                self.items.setdefault(state, set()).add(item)
        for state in by_length[1:]:
            parent = self.link[state]
            if self.length[state] >= width:
                self.window[state] = self.window[parent] if self.length[parent] >= width else state
            self.whole[state] = state if state in short and self.length[state] < width else self.whole[parent]
        for item, codes in numbered:
            if len(codes) >= width:
                for state, length in self.walk(codes):
                    if length >= width:
                        self.items.setdefault(self.window[state], set()).add(item)
        lengths = [len(codes) for _, codes in numbered if codes]
        self.shortest = min([min(n, width) for n in lengths], default=1)
        pairs = {a * len(self.vocabulary) + b for _, c in numbered for a, b in zip(c, c[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def walk(self, codes) -> Iterator[tuple[int, int]]:
        """The state after each word and how many last words it stands for."""
        state = length = 0
        for code in codes:
            while state and code not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if code in self.next[state]:
                state = self.next[state][code]
                length += 1
            yield state, length

    def _runs(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Stretches all of whose word pairs occur in items: only there can a window lie."""
        known = codes >= 0
        if self.shortest < 2:
            joined = known[1:] & known[:-1] if len(codes) else known
        elif len(self.pairs) == 0 or len(codes) < self.shortest:
            return []
        else:
            pair = codes[:-1] * len(self.vocabulary) + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined = (self.pairs[at] == pair) & known[1:] & known[:-1]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.view(np.int8), [0]))))
        runs = [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        if self.shortest < 2:
            covered = np.zeros(len(codes) + 1, bool)
            for a, b in runs:
                covered[a:b] = True
            runs += [(int(i), int(i) + 1) for i in np.flatnonzero(known & ~covered[:-1])]
        return [(a, b) for a, b in runs if b - a >= self.shortest]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans (from, to) of hit words, merged and in order, and the items they come from."""
        get = self.vocabulary.get
        codes = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        spans, items = [], set()
        for start, stop in self._runs(codes):
            for place, (state, length) in enumerate(self.walk(codes[start:stop].tolist()), start + 1):
                window = self.window[state] if length >= self.width else -1
                if window >= 0:
                    items |= self.items.get(window, set())
                    spans.append((place - length, place))
                # The stretch may be shorter than the state's longest, so walk down to it.
                whole = self.whole[state]
                while whole >= 0:
                    if self.length[whole] <= length and whole in self.items:
                        items |= self.items[whole]
                        spans.append((place - self.length[whole], place))
                    whole = self.whole[self.link[whole]]
        return merge(spans), items


def merge(spans) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return [(a, b) for a, b in merged]


def automata(
    items: DataFrame, *, item_id: str, text: str, width: int, block_words: int = BLOCK_WORDS
) -> list[bytes]:
    """Serialised automata of hash blocks of the items, each built in a task of its own.

    The number of blocks follows the bytes of the items, and a word takes two bytes at least,
    so a block has about ``block_words`` words at most, however many items there are.
    """

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(row.item, words_of(row.text.encode())) for row in frame.itertuples()]
        return pd.DataFrame({"automaton": [pickle.dumps(Automaton(rows, width))]})

    plain = items.select(
        F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")
    ).filter("item is not null and text is not null")
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-size // (2 * block_words)))
    built = (
        plain.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(build, "automaton binary")
    )
    space = Workspace(items.sparkSession, "benchmark")
    return [row["automaton"] for row in space.write("automata", built).toLocalIterator()]


def _match(handle):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(handle.value)
        for batch in batches:
            counts, all_spans, all_items = [], [], []
            before = zip(batch["_spans"].to_pylist(), batch["_items"].to_pylist(), strict=True)
            for text, (flat, known) in zip(byte_texts(batch["_text"]), before, strict=True):
                words = words_of(text)
                spans, items = automaton.find(words)
                earlier = list(zip(flat[::2], flat[1::2], strict=True))
                counts.append(len(words))
                all_spans.append([place for span in merge(earlier + spans) for place in span])
                all_items.append(sorted(items.union(known)))
            done = {
                "_words": pa.array(counts, pa.int64()),
                "_spans": pa.array(all_spans, pa.list_(pa.int64())),
                "_items": pa.array(all_items, pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_pydict(
                {name: done.get(name, batch[name]) for name in batch.schema.names}
            )

    return match


def find_items(docs: DataFrame, text: str, blocks: list[bytes]) -> DataFrame:
    """Add ``_words``, ``_spans`` (flat from, to word places) and ``_items`` to each row.

    Each block of the benchmark is one more step over the rows in the same task; spans and
    items of all blocks are merged.
    """
    context = docs.sparkSession.sparkContext
    found = docs.withColumns(
        {
            "_text": F.col(text),
            "_words": F.lit(0).cast("long"),
            "_spans": F.array().cast("array<bigint>"),
            "_items": F.array().cast("array<string>"),
        }
    )
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in found.schema.fields])
    for block in blocks or [pickle.dumps(Automaton([], WINDOW))]:
        found = found.mapInArrow(_match(context.broadcast(block)), schema)
    return found.drop("_text")


def remove_spans(text: str, automata_in_use: list[Automaton], spans: list[tuple[int, int]]) -> str:
    """The text without the spans; what closes up is looked at again until nothing is hit."""
    left = text.encode()
    while spans:
        places = [m.span() for m in re.finditer(rb"[^ ]+", left.translate(_FOLD))]
        pieces, at = [], 0
        for start, stop in spans:
            pieces.append(left[at : places[start][0]])
            at = places[stop - 1][1]
        left = b"".join([*pieces, left[at:]])
        words = words_of(left)
        spans = merge([span for a in automata_in_use for span in a.find(words)[0]])
    return left.decode()


def _cut(handles, max_coverage: float):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata_in_use = None
        for batch in batches:
            texts, spans = batch["_out"].to_pylist(), batch["_spans"].to_pylist()
            words, keep = batch["_words"].to_pylist(), []
            for i, flat in enumerate(spans):
                pairs = list(zip(flat[::2], flat[1::2], strict=True))
                hit = sum(b - a for a, b in pairs)
                keep.append(hit == 0 or hit < max_coverage * words[i])
                if hit and keep[-1]:
                    automata_in_use = automata_in_use or [pickle.loads(h.value) for h in handles]
                    texts[i] = remove_spans(texts[i], automata_in_use, pairs)
            done = batch.set_column(
                batch.schema.get_field_index("_out"), "_out", pa.array(texts, pa.string())
            )
            yield done.filter(pa.array(keep, pa.bool_()))

    return cut


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW,
    max_coverage: float = MAX_COVERAGE,
) -> DataFrame:
    """``docs`` without benchmark passages, same columns.

    A span is a stretch of ``width`` or more words of an item, or a whole shorter item; spans
    are cut out. A document of whose words ``max_coverage`` or more lie in spans is left out.
    Documents without a span come back unchanged, also empty and null texts; items without
    words or without an id match nothing; an empty benchmark changes nothing.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    column = names[docs.columns.index(text)]
    blocks = automata(items, item_id=item_id, text=item_text, width=width)
    found = find_items(docs.toDF(*names), column, blocks).withColumn("_out", F.col(column))
    context = docs.sparkSession.sparkContext
    handles = [context.broadcast(block) for block in blocks]
    cut = found.mapInArrow(_cut(handles, max_coverage), found.schema)
    return cut.withColumn(column, F.col("_out")).select(*names).toDF(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of ``documents`` shares with the items of ``benchmark``."""
    blocks = automata(table(spark, sf_dir, "benchmark"), item_id="item_id", text="text", width=WINDOW)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = F.aggregate(
        F.transform("_spans", lambda place, i: F.when(i % 2 == 1, place).otherwise(-place)),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    return find_items(docs, "text", blocks).select(
        "doc_id",
        F.col("_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS width,
    unnest(list_transform(range(1, greatest(len(words) - 9, 1) + 1),
      lambda i: array_to_string(words[i:i + least(len(words), 10) - 1], ' '))) AS passage
  FROM item WHERE len(words) > 0
), widths AS (SELECT DISTINCT width FROM windows), stretches AS (
  SELECT doc_id, width, unnest(range(1, len(words) - width + 2)) AS place, words
  FROM doc, widths WHERE len(words) >= width
), hits AS (
  SELECT doc_id, place, s.width, item_id FROM stretches s JOIN windows w
    ON s.width = w.width AND array_to_string(words[place:place + s.width - 1], ' ') = passage
), counted AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM
    (SELECT doc_id, unnest(range(place, place + width)) AS word FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
    (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
"""
