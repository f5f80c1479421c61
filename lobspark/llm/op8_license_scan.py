"""Licence scan: exact base phrases, and fuzzy search for short notices.

Words are runs of ASCII letters and digits and of all other characters from U+0080 on, A-Z lower-cased. Base
phrases are counted at every place where their words stand consecutively. A notice may be misspelt by up to
`edits` insertions, deletions and substitutions: it is split into edits + 1 parts, one of which must then stand
unchanged (pigeonhole), an automaton finds all parts in the whole text, and around every hit the regex library's
bounded-error matching verifies the notice and reports span and edits. Parts lie within words, as white space
and marks between words may differ freely; splits that would cross a word are moved to its bounds. Notices are
sought in the text with every such gap as one space, whatever its length (so a gap within a word is one edit).

A map over Arrow batches without shuffle. Null text counts as empty: no words, no labels, score 0. Rows keep
null and repeated identifiers; other columns are ignored; an empty table gives an empty result. Score: 1 with a
base place, else the best notice's share of unedited letters, else 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import tidy
from .textnum import LOWER, NOT_ALNUM, pieces, utf8, word_bounds

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice, label, edits allowed.
NOTICES = (
    ("licensed under the apache license", "apache", 3),
    ("permission is hereby granted free of charge", "mit", 4),
    ("released under the mit license", "mit", 3),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc", 2),
    ("gnu general public license", "gpl", 2),
    ("general public license", "gpl", 2),
    ("all rights reserved", "reserved", 2),
    ("spdx license identifier", "spdx", 2),
)
_IN = rb"0-9a-z\x80-\xff"


def one_space(lowered: str) -> tuple[str, np.ndarray]:
    """The text with every gap between words as one space, and where its characters stood."""
    chars = np.frombuffer(lowered.encode("utf-32-le"), np.uint32)
    gap = (chars < 128) & NOT_ALNUM[np.minimum(chars, 127)]
    keep = ~gap
    keep[:1] = True
    keep[1:] |= ~gap[:-1]
    return np.where(gap, np.uint32(32), chars)[keep].tobytes().decode("utf-32-le"), np.flatnonzero(keep)


def seeds(notice: str, edits: int) -> list[tuple[str, int]]:
    """edits + 1 disjoint parts of the notice and where they begin, each within a word and as long as can be."""
    words = [(m[0], m.start()) for m in re.finditer(r"\S+", notice)]
    size = max(n for n in range(1, len(notice)) if sum(len(w) // n for w, _ in words) > edits)
    parts = []
    for w, at in sorted(words, key=lambda x: -len(x[0])):
        c = len(w) // size
        bounds = [len(w) * j // c for j in range(c + 1)] if c else [0]
        parts += [(w[x:y], at + x) for x, y in zip(bounds, bounds[1:])]
    return parts[: edits + 1]


class Scanner:
    """Compiled phrases; one a worker."""

    def __init__(self, base: dict[str, str], notices: tuple[tuple[str, str, int], ...]) -> None:
        import ahocorasick

        gap = rb"[^" + _IN + rb"]+"
        self.base = [(label, re.compile(rb"(?<![" + _IN + rb"])" + gap.join(map(re.escape, phrase.encode().split())) + rb"(?![" + _IN + rb"])"), max(phrase.split(), key=len).encode()) for phrase, label in base.items()]
        self.patterns, self.seeds = [], ahocorasick.Automaton()
        by_seed: dict[str, list[tuple[int, int, int]]] = {}
        for k, (notice, label, edits) in enumerate(notices):
            body = " ".join(map(regex.escape, notice.split()))
            self.patterns.append((label, notice, edits, *(regex.compile(rf"{how}(?:{body}){{e<={edits}}}") for how in ("", "(?b)"))))
            for s, at in seeds(notice, edits):
                by_seed.setdefault(s, []).append((k, at, len(notice) - at))
        for s, where in by_seed.items():
            self.seeds.add_word(s, (len(s), where))
        self.seeds.make_automaton()

    def notices(self, lowered: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of each notice found; spans of one notice don't overlap."""
        hits = list(self.seeds.iter(lowered))
        if not hits:
            return []
        text, place = one_space(lowered)
        ends = np.searchsorted(place, [end for end, _ in hits]).tolist()  # seeds lie within words
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (_, (size, where)) in zip(ends, hits):
            start = end - size + 1
            for k, before, after in where:
                room = 2 * self.patterns[k][2]  # a match's bounds move by its edits at most
                windows.setdefault(k, []).append((max(0, start - before - room), start + after + room))
        found = []
        for k, spans in windows.items():
            label = self.patterns[k][0]
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                for start, end, n in sorted(self.matches(k, text, a, min(b, len(text)))):
                    found.append((label, int(place[start]), int(place[end - 1]) + 1, n))
        return found

    def matches(self, k: int, text: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of notice k in text[a:b], in frames of bounded length, so time grows with b - a alone."""
        size = len(self.patterns[k][1]) + 2 * self.patterns[k][2]  # more than a match and the room it is sought in
        while a < b:
            end = min(b, a + 8 * size)
            for m in sorted(self.framed(k, text, a, end)):
                if end == b or m[0] <= end - size:  # later ones are sought again in the next frame
                    yield m
                    a = max(a, m[1])
            if end == b:
                return
            a = max(a, end - size + 1)

    def framed(self, k: int, text: str, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """The matches of one frame, until none within the bound is left."""
        _, notice, edits, some, best = self.patterns[k]
        letters = {c: notice.count(c) for c in set(notice) - {" "}}
        left = [(a, b)]
        while left:
            a, b = left.pop()
            if b - a < len(notice) - edits or sum(max(0, n - text.count(c, a, b)) for c, n in letters.items()) > edits:
                continue  # more letters are missing than edits could replace
            first = some.search(text, a, b)
            if not first:
                continue
            # the best match near the first one; poorer ones before and after it count too
            m = best.search(text, first.start(), min(b, first.start() + len(notice) + 2 * edits)) or first
            yield m.start(), m.end(), sum(m.fuzzy_counts)
            left += [(m.end(), b), (a, m.start())]


_made: dict = {}


def scanner(base: dict[str, str], notices) -> Scanner:
    key = (tuple(base.items()), tuple(notices))
    if key not in _made:
        _made[key] = Scanner(base, notices)
    return _made[key]


def license_scan(docs: DataFrame, base: dict[str, str] = BASE, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans array<struct<label, start, end, edits>> (characters)."""
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(base, notices)
        sizes = {}
        for notice, label, _ in notices:
            sizes[label] = max(len(notice), sizes.get(label, 0))
        for batch in batches:
            for part in pieces(batch, 1):
                data, off = utf8(part.column(1))
                data = LOWER[data]
                starts, _, row = word_bounds(data, off, NOT_ALNUM)
                n_words = np.bincount(row, minlength=part.num_rows)
                first = np.cumsum(n_words) - n_words
                raw, ends = data.tobytes(), off.tolist()
                out = {k: [] for k in ("n", "a", "z", "b", "l", "s", "spans")}
                for r in range(part.num_rows):
                    text = raw[ends[r] : ends[r + 1]]
                    places, labels = [], set()
                    for label, pattern, word in scan.base:
                        if word in text:
                            at = [m.start() for m in pattern.finditer(text)]
                            if at:
                                labels.add(label)
                                places += at
                    found = scan.notices(text.decode())
                    where = np.searchsorted(starts, np.array(places, np.int64) + ends[r]) - first[r] if places else None
                    out["n"].append(len(places))
                    out["a"].append(int(where.min()) if places else None)
                    out["z"].append(int(where.max()) if places else None)
                    out["b"].append(",".join(sorted(labels)))
                    out["l"].append(",".join(sorted(labels | {f[0] for f in found})))
                    out["s"].append(1.0 if places else max((1 - e / sizes[label] for label, _, _, e in found), default=0.0))
                    out["spans"].append([{"label": label, "start": a, "end": z, "edits": e} for label, a, z, e in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["a"], pa.int64()), pa.array(out["z"], pa.int64()), pa.array(out["b"], pa.string()), pa.array(out["l"], pa.string()), pa.array(out["s"], pa.float64()), pa.array(out["spans"], span)], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = f"`{id_col}` long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,edits:int>>"
    tidy(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


ORACLE = None
