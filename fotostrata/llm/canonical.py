"""Mapping free-entered values to the entries of a canonical list.

Each distinct value is looked at once. An Aho-Corasick automaton over the folded
canonical names and their aliases finds embedded mentions; of overlapping ones
the longest wins. What has no mention goes to token-set similarity: the value's
tokens, in any order and in any consecutive selection, against each name's,
by edit distance. Candidates are pre-filtered by a bound on that distance that
never loses one.

Scale: distinct values are counted with map-side combining and joined back
without gathering the rows of a frequent value in one task. The list itself is
held in every worker and may have at most ``MAX_ENTRIES`` entries.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotostrata.operators.lookup import skewed_lookup
from fotostrata.session import materialise

MAX_ENTRIES = 200_000
#: Greatest edit distance as a share of the longer string: for the whole value, and for a selection of its tokens.
WHOLE_SHARE = 0.39
PART_SHARE = 0.25
#: By how much of its share the second-best name must be farther away.
MARGIN = 0.05


def fold(text: str) -> str:
    """Lower case without accents, entities, width variants and punctuation; blanks are single."""
    plain = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", html.unescape(text)).casefold())
    return re.sub(r"[\W_]+", " ", "".join(c for c in plain if not unicodedata.combining(c))).strip()


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours; anything above ``most`` may come out as ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, prior = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prior[j] + 1, row[-1] + 1, prior[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most and min(prior) > most:
            return most + 1
        before, prior = prior, row
    return prior[-1]


def _bag(text: str) -> np.ndarray:
    counts = np.zeros(32, np.int32)
    for c in text:
        counts[ord(c) % 32] += 1
    return counts


class CanonicalList:
    """The names of one kind, ready to be matched. ``entries``: (place_id, name, code or None)."""

    def __init__(self, entries: list[tuple[int, str, str | None]]):
        self.ids, self.names = [], []
        aliases: dict[str, set[int]] = {}
        whole: dict[str, set[int]] = {}
        for place, name, code in sorted(entries, key=lambda e: len(fold(e[1]))):  # by length, so that names of like length stand together
            key = fold(name)
            if not key:
                continue
            self.ids.append(place)
            self.names.append(key)
            aliases.setdefault(key, set()).add(place)
            tokens = key.split()
            for k in range(1, len(tokens)):  # "Sul, Parmetem do" and the like, and an initial for the first word
                aliases.setdefault(" ".join(tokens[k:] + tokens[:k]), set()).add(place)
                whole.setdefault(" ".join([tokens[0][0], *tokens[1:]]), set()).add(place)
            if code and code.strip():
                whole.setdefault(fold(code).replace(" ", ""), set()).add(place)
        names = set(self.names)
        aliases = {k: v for k, v in aliases.items() if len(v) == 1 and (k in names or len(k) > 3)}
        # a code or an initial stands for a name only as the whole value
        self.whole = {k: next(iter(v)) for k, v in whole.items() if len(v) == 1 and k not in aliases}
        self.machine = ahocorasick.Automaton()
        for key, places in aliases.items():
            self.machine.add_word(f" {key} ", (len(key), next(iter(places))))
        if aliases:
            self.machine.make_automaton()
        self.any = bool(aliases)
        self.bags = np.array([_bag(n) for n in self.names]) if self.names else np.zeros((0, 32), np.int32)
        self.lengths = np.array([len(n) for n in self.names], np.int64)
        self.sorted_names = [" ".join(sorted(n.split())) for n in self.names]

    def mentions(self, folded: str) -> list[tuple[int, int, int]]:
        """(start, length, place) of the longest non-overlapping mentions, from left to right."""
        if not self.any:
            return []
        found = [(end - size, size, place) for end, (size, place) in self.machine.iter(f" {folded} ")]
        found.sort(key=lambda m: (-m[1], m[0]))
        taken: list[tuple[int, int, int]] = []
        for start, size, place in found:
            if all(start + size <= s or s + n <= start for s, n, _ in taken):
                taken.append((start, size, place))
        return sorted(taken)

    def similar(self, folded: str, share: float, scores: dict[int, float]) -> None:
        """Adds to ``scores`` each name within ``share`` of the value, whatever the order of its tokens."""
        bag, size = _bag(folded), len(folded)
        # strings that differ by more than the share in length alone are too far apart
        low, high = np.searchsorted(self.lengths, [size * (1 - share) - 1e-9, size / (1 - share) + 1e-9], side="left")
        apart = self.bags[low:high] - bag
        least = np.maximum(np.where(apart > 0, apart, 0).sum(axis=1), np.where(apart < 0, -apart, 0).sum(axis=1))
        longest = np.maximum(self.lengths[low:high], size)
        ordered = " ".join(sorted(folded.split()))
        for k in np.flatnonzero(least <= share * longest):
            i, most = low + k, int(share * longest[k])
            d = min(edit_distance(folded, self.names[i], most), edit_distance(ordered, self.sorted_names[i], most))
            if d <= most:
                scores[self.ids[i]] = min(scores.get(self.ids[i], 9.0), d / longest[k])

    def match(self, value: str) -> int:
        """The place a value means, or -1."""
        folded = fold(value)
        if not folded or not self.names:
            return -1
        glued = folded.replace(" ", "")
        for key in (folded, glued):
            if key in self.whole:
                return self.whole[key]
        found = self.mentions(folded)
        if found:
            most = max(m[1] for m in found)
            return next(m[2] for m in found if m[1] == most)
        if re.search(r"[.…]\s*$", value) and len(glued) >= 3:  # cut off on purpose
            begins = {self.ids[i] for i, n in enumerate(self.names) if n.startswith(folded)}
            if len(begins) == 1:
                return begins.pop()
        scores: dict[int, float] = {}
        self.similar(folded, WHOLE_SHARE, scores)
        tokens = folded.split()
        for n in range(1, len(tokens)):
            for at in range(len(tokens) - n + 1):
                part = " ".join(tokens[at : at + n])
                if len(part) >= 5:
                    self.similar(part, PART_SHARE, scores)
        ranked = sorted((s, p) for p, s in scores.items())
        if not ranked or len(ranked) > 1 and ranked[1][0] - ranked[0][0] < MARGIN:
            return -1
        return ranked[0][1]


def map_to_canonical(values: DataFrame, places: DataFrame) -> DataFrame:
    """(field, record_id, place_id) of every value that is not blank and not letter for letter a name of its kind.

    ``values`` has field (the kind of name meant), record_id and value; ``places``
    has place_id, kind, name and code. place_id is -1 where no entry is meant.
    Null and blank values are left out, repeated rows come out repeatedly, a value
    that two entries fit equally well maps to none, and with an empty list every
    value maps to -1. Very long values are matched whole.
    """
    rows = [tuple(r) for r in places.select("kind", "place_id", "name", "code").where("kind is not null and place_id is not null and name is not null").limit(MAX_ENTRIES + 1).collect()]
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the canonical list has more than {MAX_ENTRIES} entries")
    spark = values.sparkSession
    shared = spark.sparkContext.broadcast(sorted(rows, key=str))
    blank = F.regexp_replace("value", r"(?U)[\s​﻿]+", "") == ""
    given = values.select("field", "record_id", "value").where(F.col("field").isNotNull() & F.col("value").isNotNull() & ~blank)
    exact = spark.createDataFrame([(k, n) for k, _, n, _ in rows], "field string, value string").distinct()
    odd = given.join(F.broadcast(exact), ["field", "value"], "left_anti")
    distinct = odd.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[str, CanonicalList] = {}
        for batch in batches:
            fields, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for kind, text in zip(fields, texts, strict=True):
                if kind not in lists:
                    lists[kind] = CanonicalList([(p, n, c) for k, p, n, c in shared.value if k == kind])
                out.append(lists[kind].match(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["field", "value", "n_rows", "place_id"])

    # few bytes but much work a row: spread over all cores, which adaptive execution would undo for a partitioning by key
    spread = distinct.repartition(max(8, spark.sparkContext.defaultParallelism * 2))
    mapped = materialise(spread.mapInArrow(run, "field string, value string, n_rows long, place_id long"), "mapped")
    return skewed_lookup(odd, mapped, ["field", "value"], "n_rows").select("field", "record_id", "place_id")
