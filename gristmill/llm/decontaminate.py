"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts.

Normal form: A-Z lower-cased; words are runs of characters other than ASCII non-alphanumerics. A window
is `width` consecutive words of an item; an item of fewer, but not none, is one window. The automaton holds
each item's words in blocks of half a width, one after another, and short items whole: every window holds a
whole block, so a block that occurs in a text is extended to both sides against its item, and a stretch of a
width or more hits. So the automaton grows with the benchmark's words, not with its windows.

Texts are scanned once, as symbols: words of the benchmark have numbers, every other word is a blank, and
runs of fewer known words than the shortest window are stepped over. Word positions are those of the original,
and hit stretches also come as code point offsets in the original text.

Texts never move: the scan is a map over the documents, and the items are broadcast. A benchmark of more than
`block_bytes` of text, whose automaton would be too large for a worker, is scanned block by block, with the
narrow hits so far carried along, so that memory stays bounded whatever its size.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, stored, trimmed

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_built: dict[str, Items] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _digits(k: int, n: int) -> str:
    """k as n symbols, each place with 24 symbols of its own: nodes of the trie stay narrow."""
    return "".join(chr(1 + 24 * place + k // 24**place % 24) for place in range(n))


class Items:
    """The automaton over the items (id, text), and what extends its hits."""

    def __init__(self, width: int, rows: list[tuple[str, bytes]]):
        import ahocorasick

        self.width, self.number = width, {}
        self.names, self.words, seeds = [], [], {}
        step = (width + 1) // 2
        least = math.inf
        for item, text in rows:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            if not words:
                continue
            least = min(least, len(words), width)
            for at in range(0, len(words) - step + 1, step) if len(words) >= width else [0]:
                seeds.setdefault(tuple(words[at : at + step] if len(words) >= width else words), []).append((len(self.names), at))
            self.names.append(item)
            self.words.append(words)
        self.least = least
        self.n = max(1, math.ceil(math.log(len(self.number) + 2, 24)))
        self.code = [_digits(k, self.n) for k in range(len(self.number) + 1)]
        self.found = ahocorasick.Automaton() if seeds else None
        for seed, places in seeds.items():
            self.found.add_word("".join(map(self.code.__getitem__, seed)), (len(seed), tuple(places)))
        if seeds:
            self.found.make_automaton()

    def matches(self, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """(number of words, hit word stretches with end exclusive, items with occurring windows)."""
        words = words_of(text)
        ranges, items = set(), set()
        if self.found is not None and words:
            known = np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], known != 0, [0]])))
            for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if last - first >= self.least:
                    self._run(known[first:last].tolist(), first, ranges, items)
        return len(words), sorted(ranges), items

    def _run(self, words: list[int], first: int, ranges: set, items: set) -> None:
        upto: dict[tuple[int, int], int] = {}  # how far an item on a diagonal has been compared
        for end, (length, places) in self.found.iter("".join(map(self.code.__getitem__, words))):
            stop = (end + 1) // self.n
            at = stop - length
            for item, place in places:
                own = self.words[item]
                if len(own) < self.width:
                    ranges.add((first + at, first + stop))
                    items.add(self.names[item])
                elif upto.get((item, at - place), -1) < stop:
                    a, b = at, stop
                    while a and a - at + place and words[a - 1] == own[a - at + place - 1]:
                        a -= 1
                    while b < len(words) and b - at + place < len(own) and words[b] == own[b - at + place]:
                        b += 1
                    upto[item, at - place] = b
                    if b - a >= self.width:
                        ranges.add((first + a, first + b))
                        items.add(self.names[item])


def automaton(key: str, items: tuple) -> Items:
    """Kept for the worker's later tasks of the same scan."""
    if key not in _built:
        _built.clear()
        _built[key] = Items(*items)
    return _built[key]


def offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word stretches, merged where they meet, as code point offsets of the original text, end exclusive."""
    merged: list[list[int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_FOLD))]
    points = np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)])
    return [(int(points[places[a][0]]), int(points[places[b - 1][1]])) for a, b in merged]


def _scan(broadcast, key: str, state: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = None
        for batch in batches:
            built = built or automaton(key, broadcast.value)
            rows = []
            for value, before in zip(as_bytes(batch.column(text)), batch.column(state)):
                body = value.as_py() or b""
                n, ranges, items = built.matches(body)
                old = before.as_py()
                if old:
                    ranges = sorted({*ranges, *zip(old["starts"], old["stops"])})
                    items = items | set(old["items"])
                spans = offsets(body, ranges) if ranges else []
                rows.append({"n": n, "starts": [a for a, _ in ranges], "stops": [b for _, b in ranges], "items": sorted(items), "spans": ",".join(f"{a}:{b}" for a, b in spans)})
            at = batch.schema.get_field_index(state)
            kind = pa.struct([("n", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("spans", pa.string())])
            arrays = list(batch.columns)
            arrays[at] = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return run


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about block_bytes of text. A null id is no item that could be named: such rows
    count as hits under the id ''."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("binary").alias("body")).where("body is not null")
    total = items.agg(F.sum(F.length("body").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k)
        yield sorted((r["item"], bytes(r["body"])) for r in part.collect())


def hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = 16 << 20) -> tuple[DataFrame, str]:
    """Every row and column of `docs`, and a struct column (its name is the second value) with n (words), starts,
    stops (hit word ranges, end exclusive; they may overlap), items (ids as strings, '' for a null id, sorted) and
    spans ('start:end,...': hit stretches as code points of the original text, end exclusive, merged).

    Null and empty texts have no words and no hits. Repeated rows stay repeated. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    state = f"hits_{uuid.uuid4().hex}"
    kind = "struct<n:bigint,starts:array<int>,stops:array<int>,items:array<string>,spans:string>"
    out = docs.withColumn(state, F.lit(None).cast(kind))
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        sent = spark.sparkContext.broadcast((width, block))
        out = out.mapInArrow(trimmed(_scan(sent, uuid.uuid4().hex, state, text)), out.schema)
        block = following
        if following is not None:
            out = stored(out, "decontaminate")
    return out, state


def hit_words(state: Column) -> Column:
    """Number of distinct words in the ranges (sorted by start)."""
    ranges = F.arrays_zip(state["starts"].alias("a"), state["stops"].alias("b"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], x["b"]).alias("upto"))
    return F.aggregate(ranges, start, step, lambda acc: acc["n"].cast("long"))


def report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and hit_spans, the hit
    stretches as 'start:end,...' in code points of the original text."""
    found, state = hits(docs.select(doc_id, text), benchmark, text=text, **options)
    s = F.col(state)
    named = F.filter(s["items"], lambda x: x != "")
    return found.select(
        F.col(doc_id).alias("doc_id"),
        s["n"].alias("n_words"),
        hit_words(s).alias("n_hit"),
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(named), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(s["starts"]) > 0).alias("contaminated"),
        s["spans"].alias("hit_spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without a hit, with the columns of `docs`."""
    found, state = hits(docs, benchmark, **options)
    return found.where(F.size(F.col(state)["starts"]) == 0).drop(state)


def brute_force(docs: list[tuple], items: list[tuple], width: int = 10) -> list[tuple]:
    """What report() returns, by comparing every window with every position; for tests."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = words_of((text or "").encode())
        for at in range(max(len(w) - width, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[at : at + width]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = words_of((text or "").encode())
        hit, ids = np.zeros(len(w), bool), set()
        for window, who in windows.items():
            for at in range(len(w) - len(window) + 1):
                if tuple(w[at : at + len(window)]) == window:
                    hit[at : at + len(window)] = True
                    ids |= who
        out.append((doc, len(w), int(hit.sum()), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit.any())))
    return out

