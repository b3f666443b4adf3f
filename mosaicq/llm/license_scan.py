"""License scans: pigeonhole-split exact seeds find candidates, bounded-error matching verifies them.

A notice of n letters with at most k edits contains, unedited, at least one of k + 1 pieces it is cut
into. All pieces of all notices sit in one Aho-Corasick automaton; a hit opens a window around the
place where the notice would lie, overlapping windows of a notice are merged, and the ``regex``
library's fuzzy matching verifies the edits there. One scan, nothing is shuffled: a frequent notice
or a long text costs only its own row.

Defined results: null and empty texts have no words, spans or labels and score 0; repeated rows are
scanned one by one; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose exact places are counted, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Short notices as normalised words, with their labels.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: One edit is allowed for each so many letters of a notice.
LETTERS_PER_EDIT = 12

#: Digits and letters stay, A-Z are lower-cased, every byte of a non-ASCII letter stays, the rest separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(raw: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return [w for w in raw.translate(_TABLE).split(b" ") if w]


class Scanner:
    """The automaton and the fuzzy patterns of a list of notices."""

    def __init__(self, notices=NOTICES, letters_per_edit: int = LETTERS_PER_EDIT):
        import ahocorasick
        import regex

        self.notices = [(label, phrase, len(phrase) // letters_per_edit) for label, phrase in notices]
        self.fuzzy = [regex.compile(rf"(?e)(?:{regex.escape(p)}){{e<={k}}}") for _, p, k in self.notices]
        self.seeds = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, phrase, k) in enumerate(self.notices):
            cuts = [len(phrase) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(phrase[a:b], []).append((n, a))
        for piece, where in places.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Merged stretches of text in which each notice may lie."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.seeds.iter(text):
            for n, offset in where:
                _, phrase, k = self.notices[n]
                at = end - size + 1 - offset
                found.setdefault(n, []).append((max(0, at - k), min(len(text), at + len(phrase) + k)))
        out: dict[int, list[list[int]]] = {}
        for n, spans in found.items():
            merged = out[n] = []
            for lo, hi in sorted(spans):  # a piece of the notice's end opens a window before one of its beginning
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
        return out

    def matches(self, text: str) -> list[tuple[int, int, int, str, float]]:
        """(start, end, edits, label, similarity) in text; where spans overlap the most similar one stays."""
        found = []
        for n, spans in self.windows(text).items():
            label, phrase, _ = self.notices[n]
            for lo, hi in spans:
                for m in self.fuzzy[n].finditer(text, lo, hi):
                    edits = sum(m.fuzzy_counts)
                    found.append((m.start(), m.end(), edits, label, 1 - edits / len(phrase)))
        found.sort(key=lambda x: (-x[4], x[0] - x[1], x[0], x[3]))
        kept: list[tuple[int, int, int, str, float]] = []
        starts: list[int] = []
        for x in found:
            at = bisect.bisect_left(starts, x[0])
            if (at and kept[at - 1][1] > x[0]) or (at < len(kept) and kept[at][0] < x[1]):
                continue
            starts.insert(at, x[0])
            kept.insert(at, x)
        return kept


def base_places(joined: bytes, phrases: dict[str, str]) -> list[tuple[int, str]]:
    """(first word, label) of each place; joined has a space before and after every word."""
    out = []
    for phrase, label in phrases.items():
        needle = f" {phrase} ".encode()
        at, told, word = joined.find(needle), 0, 0
        while at >= 0:
            told, word = at, word + joined.count(b" ", told, at)  # counted on from the last place
            out.append((word, label))
            at = joined.find(needle, at + 1)
    return sorted(out)


SPAN = pa.struct([("label", pa.string()), ("edits", pa.int32()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
PLACE = pa.struct([("first_word", pa.int64()), ("label", pa.string())])
SCHEMA = "n_words long, places array<struct<first_word:long,label:string>>, spans array<struct<label:string,edits:int,similarity:double,first_word:long,n_words:long,start:long,end:long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """id, n_words, places (exact phrases) and spans (verified notices, in words and code points of the text)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            n_words, places, spans = [], [], []
            for raw in batch.column(1).cast(pa.binary()):
                raw = raw.as_py() or b""
                words = words_of(raw)
                joined = b" " + b" ".join(words) + b" " if words else b""
                n_words.append(len(words))
                places.append([{"first_word": i, "label": x} for i, x in base_places(joined, phrases)])
                text = joined.decode("utf-8", "replace")
                hits = scanner.matches(text)
                spans.append(_located(hits, text, raw) if hits else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(places, pa.list_(PLACE)), pa.array(spans, pa.list_(SPAN))], names=["id", "n_words", "places", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, {SCHEMA}").withColumnRenamed("id", id_col)


def _located(hits, text: str, raw: bytes) -> list[dict]:
    at = [m.span() for m in _WORD.finditer(raw.decode("utf-8", "replace"))]
    spaces = [m.start() for m in re.finditer(" ", text)]
    out = []
    for lo, hi, edits, label, similarity in sorted(hits):
        first = min(max(0, bisect.bisect_left(spaces, lo + 1) - 1), len(at) - 1)
        last = min(max(first, bisect.bisect_left(spaces, hi - 1) - 1), len(at) - 1)
        out.append({"label": label, "edits": edits, "similarity": similarity, "first_word": first, "n_words": last - first + 1, "start": at[first][0], "end": at[last][1]})
    return out


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Digest of the scan of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.transform("places", lambda x: x["label"])
    fuzzy = F.transform("spans", lambda x: x["label"])
    starts = F.transform("places", lambda x: x["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, fuzzy))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda x: x["similarity"])), F.lit(0.0))).alias("score"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["label"], x["start"], x["end"], x["edits"])), ",").alias("spans"),
    )
