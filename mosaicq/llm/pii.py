"""PII by bootstrapped contextual extraction.

Seed identifiers (email, ip, card, phone by their formats) induce lexical patterns: the two or three
units (words or marks) before or after an identifier, the units on both sides, and the unit before
together with the identifier's shape. Whatever stands in a pattern's slot fills it: a piece of text
between blanks without its outer marks, or a run of digit groups. On the graph of patterns and the
instances that fill them, Spark scores both in turn, until a round finds nothing new:

* a pattern is as trustworthy as the places, in all texts, that trusted instances fill, against those
  that ordinary pieces fill: words, what mostly stands elsewhere, and what a format's own check refutes
  (a card number with a wrong check digit). What is neither may be an unseen
  identifier and weighs ``UNKNOWN_WEIGHT`` of that. A pattern needs ``min_support`` distinct instances;
* an instance is trusted if its patterns leave no more doubt than ``1 - min_confidence`` (one side of it
  counts as one witness) and at least ``min_share`` of its mentions, in all texts, stand in trusted
  patterns. An instance of letters alone may be an ordinary word: it needs two witnesses.

Trusted instances that no format covers become additional spans of kind ``ctx_<kind>`` wherever they
are mentioned, and their contexts the next round's patterns.

A round reads the texts for the kinds of pieces in the places of new patterns, for what fills the places
of those that may be trusted at best and are not filled by words for more than ``MOST_WORDS``, for how often new
candidates are mentioned and, of those that can reach their share, for the mentions: each time with a
bounded shard of patterns or instances as a look-up set, and counts are combined before they are
shuffled. What is mentioned often but seldom in trusted places never leaves its task but as a count.
Texts without seeds and digit groups are looked through as arrays of numbered pieces (the same result,
faster). Tables of a round go to the shared folder. The joins of a very frequent pattern or instance are inner joins with one row per key on the
other side, which adaptive execution can split.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one and count
once as evidence (distinct instances); only id and text are read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaicq.workspace import materialise

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SHARE, UNKNOWN_WEIGHT, MOST_WORDS = 5, 0.8, 0.5, 0.1, 0.5
#: So many patterns or instances at a time are looked up by the tasks.
SHARD = 200_000
#: Pieces that a task numbers before it starts anew, their letters, and the pieces looked through at once.
CACHED_PIECES, CACHED_LETTERS, CHUNK_PIECES = 250_000, 1 << 24, 1 << 17

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can begin inside a run of digits only if it can begin at the run's first digit, and none ends there.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
_UNIT = re.compile(r"\w+|[^\w\s]")
_INSIDE = re.compile(r"\w\w")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Digit groups one blank apart, else what stands between blanks.
_PIECE = re.compile(r"[(+]?[0-9][0-9()./-]*+(?: [(+]?[0-9][0-9()./-]*+(?=[.,;:!?]*+(?!\S)))++|\S+")
_GROUP = re.compile(r"[(+]?[0-9][0-9()./-]*[.,;:!?]*$")
_OPENING, _CLOSING = "\"'([{<", ".,;:!?\"'>]}"

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > floor and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind."""
    out = [(a, b, 0) for a, b in _emails(text)]
    out += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def refuted(piece: str) -> bool:
    """Whether a piece has the form of a card or ip, but fails the check."""
    if _IP.fullmatch(piece):
        return not all(map(_small, piece.split(".")))
    digits = piece.replace(" ", "").replace("-", "")
    return bool(_CARD.fullmatch(piece)) and 12 <= len(digits) <= 19 and not luhn(digits)


def core_of(piece: str) -> tuple[int, int]:
    """Where a piece without its outer marks begins and ends; an empty stretch without a letter or digit."""
    core = piece.lstrip(_OPENING)
    lo = len(piece) - len(core)
    core = core.rstrip(_CLOSING)
    if core.endswith(")") and "(" not in core:
        core = core.rstrip(_CLOSING + ")")
    return (lo, lo + len(core)) if any(map(str.isalnum, core)) else (0, 0)


def fillers(text: str, spans: list[Span]) -> list[tuple[int, int, str | None]]:
    """(start, end, kind) of the spans and, without a kind, of every other piece that touches none."""
    out: list[tuple[int, int, str | None]] = list(spans)
    taken, k = sorted((a, b) for a, b, _ in spans), 0
    for m in _PIECE.finditer(text):
        raw = m[0]
        lo, hi = (m.start() + x for x in core_of(raw))
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if lo < hi and not (k < len(taken) and taken[k][0] < hi):
            out.append((lo, hi, None))
    return out


class Units:
    """The units of a text and the patterns around a stretch of it."""

    def __init__(self, text: str):
        found = [(m.start(), m[0].lower()) for m in _UNIT.finditer(text)]
        self.text = text
        self.starts = [a for a, _ in found]
        self.units = ["", "", "", *(u for _, u in found), "", "", ""]  # none stands beyond the ends

    def around(self, a: int, b: int) -> tuple[int, int] | None:
        """Where, in units, the stretch begins and ends; None if it cuts a word."""
        if _INSIDE.match(self.text[max(0, a - 1) : a + 1]) and a or _INSIDE.match(self.text[b - 1 : b + 1]):
            return None
        return bisect_left(self.starts, a) + 3, bisect_left(self.starts, b) + 3

    def patterns(self, a: int, b: int) -> list[str]:
        """All patterns whose slot is the stretch."""
        at = self.around(a, b)
        if not at:
            return []
        (i, j), u = at, self.units
        out = []
        if u[i - 2]:
            out.append(f"{u[i - 2]} {u[i - 1]} <>")
            if u[i - 3]:
                out.append(f"{u[i - 3]} {out[0]}")
        if u[j + 1]:
            right = f"<> {u[j]} {u[j + 1]}"
            out.append(right)
            if u[j + 2]:
                out.append(f"{right} {u[j + 2]}")
        if u[i - 1]:
            if u[j]:
                out.append(f"{u[i - 1]} <> {u[j]}")
            if shape := shape_of(self.text[a:b]):
                out.append(f"{u[i - 1]} <{shape}>")
        return out


def shape_of(instance: str) -> str | None:
    """Letters as one a, each digit as 0, blanks as _; None of letters alone, and of what is too long to repeat."""
    if instance.isalpha() or len(instance) > 200:
        return None
    return re.sub(r"[0-9]", "0", _LETTERS.sub("a", instance)).replace(" ", "_")


def side_of(pattern: Column) -> Column:
    """Which witness of an instance a pattern is: the left or right side, both, or the shape."""
    return F.when(pattern.endswith(" <>"), "left").when(pattern.startswith("<> "), "right").when(pattern.contains(" <> "), "both").otherwise("shape")


class Wanted:
    """Patterns to look for, by number, as units and as sorted keys of unit numbers."""

    def __init__(self, patterns: set[str]):
        self.patterns = sorted(patterns)
        self.numbers = {p: n for n, p in enumerate(self.patterns)}
        split = [p.split(" ") for p in self.patterns]
        self.vocab: dict[str, int] = {}
        self.shapes: dict[str, int] = {}
        for p in split:
            for u in p[:1] if len(p) == 2 else [u for u in p if u != "<>"]:
                self.vocab.setdefault(u, len(self.vocab))
            if len(p) == 2:
                self.shapes.setdefault(p[1][1:-1], len(self.shapes))
        # Places relative to the first unit of the slot (below 0) and to the one behind it (from 0).
        self.keys: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}
        for places, ids in {(-2, -1): 3, (-3, -2, -1): 4, (0, 1): 3, (0, 1, 2): 4, (-1, 0): 3, (-1,): 2}.items():
            slot = {(-1, 0): 1, (-1,): 1}.get(places, ids - 1 if places[0] < 0 else 0)
            of = [(self._key(p, slot), n) for n, p in enumerate(split) if len(p) == ids and (len(p) == 2 or p[slot] == "<>")]
            keys, numbers = (np.array(c, np.int64) for c in zip(*sorted(of))) if of else (np.zeros(0, np.int64),) * 2
            self.keys[places] = keys, numbers

    def _key(self, split: list[str], slot: int) -> int:
        key = 0
        for k, u in enumerate(split):
            if k != slot:
                key = key * (len(self.vocab) + 1) + self.vocab[u]
        return key * (len(self.shapes) + 1) + self.shapes[split[1][1:-1]] if len(split) == 2 else key

    def at(self, units: Units, a: int, b: int) -> list[int]:
        """Numbers of those of the patterns whose slot is the stretch."""
        return [self.numbers[p] for p in units.patterns(a, b) if p in self.numbers]

    def hits(self, units: np.ndarray, first: np.ndarray, behind: np.ndarray, shape: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(stretch, pattern) numbers of all stretches between units first and behind that fill a pattern."""
        for places, (keys, numbers) in self.keys.items():
            if not len(keys):
                continue
            got = np.zeros(len(first), np.int64)
            for k in places:
                got = got * (len(self.vocab) + 1) + units[first + k if k < 0 else behind + k]
            if places == (-1,):
                got = got * (len(self.shapes) + 1) + shape
            at = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
            found = np.nonzero(keys[at] == got)[0]
            yield found, numbers[at[found]]


WORD, REFUTED, OTHER = 0, 1, 2


FACTS = ("begin", "size", "before", "inside", "kind", "shape", "digits", "hit")


class Chunk:
    """Consecutive pieces of texts: their numbers, the texts they are of, and their facts."""

    def __init__(self, number: np.ndarray, owner: np.ndarray, facts: np.ndarray):
        self.number, self.owner, self.facts = number, owner, facts

    def fact(self, name: str) -> np.ndarray:
        return self.facts[:, FACTS.index(name)]

    def with_digit_runs(self) -> set[int]:
        """The texts that have digit groups side by side."""
        group = self.fact("digits") > 0
        return set(self.owner[1:][group[1:] & group[:-1] & (self.owner[1:] == self.owner[:-1])].tolist())

    def without(self, owners: list[int]) -> Chunk:
        keep = ~np.isin(self.owner, owners)
        return self if keep.all() else Chunk(self.number[keep], self.owner[keep], self.facts[keep])


class Pieces(dict):
    """Numbers of pieces (what stands between blanks) with their units, cores and what the cores are."""

    def __init__(self, wanted: Wanted, some: set[str] = frozenset()):
        self.wanted, self.some = wanted, some
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.letters = 0
        self.cores: list[str] = []
        self.units = array("i")
        #: The first unit and how many there are, those before the core and in it, what the core is, its
        #: shape, whether the piece is a digit group, whether its core is looked for: FACTS of each number.
        self.facts = array("i")

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.cores)
        self.letters += len(piece)
        begin, get, none = len(self.units), self.wanted.vocab.get, len(self.wanted.vocab)
        # Most pieces are a word, or a word and a mark.
        word = piece if piece.isalpha() else piece[:-1] if piece[-1] in _CLOSING and piece[:-1].isalpha() else None
        if word:
            self.units.append(get(word.lower(), none))
            if word is not piece:
                self.units.append(get(piece[-1], none))
            self.facts.extend((begin, len(self.units) - begin, 0, 1, WORD, len(self.wanted.shapes), 0, word in self.some))
            self.cores.append(word)
            return n
        lo, hi = core_of(piece)
        core = piece[lo:hi]
        self.units.extend([get(u.lower(), none) for u in _UNIT.findall(piece)])
        kind = -1 if not core else WORD if core.isalpha() else REFUTED if refuted(core) else OTHER
        shape = self.wanted.shapes.get(shape_of(core) if core else None, len(self.wanted.shapes))
        self.facts.extend((begin, len(self.units) - begin, len(_UNIT.findall(piece[:lo])), len(_UNIT.findall(core)), kind, shape, bool(_GROUP.match(piece)), core in self.some))
        self.cores.append(core)
        return n

    def chunks(self, texts: list[str], seeds: Callable[[str], list[Span]]) -> Iterator[tuple[list[tuple[int, list[Span]]], Chunk]]:
        """(texts to be read slowly with their spans, the pieces of the others)."""
        slow, fast, n = [], [], 0
        for row, text in enumerate(texts):
            if spans := seeds(text):
                slow.append((row, spans))
            else:
                fast.append((row, text.split()))
                n += len(fast[-1][1])
            if n > CHUNK_PIECES or row + 1 == len(texts):
                if len(self) > CACHED_PIECES or self.letters > CACHED_LETTERS:
                    self.restart()
                number = np.fromiter(map(self.__getitem__, chain.from_iterable(pieces for _, pieces in fast)), np.int32, n)
                owner = np.repeat(np.array([r for r, _ in fast], np.int32), [len(p) for _, p in fast])
                fast, n = [], 0
                found = Chunk(number, owner, np.array(self.facts, np.int32).reshape(-1, len(FACTS))[number])
                runs = sorted(found.with_digit_runs())
                yield slow + [(r, []) for r in runs], found.without(runs)
                slow = []

    def hits(self, chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in the chunk, pattern numbers) of the pieces that fill a pattern."""
        if not len(chunk.number):
            return
        size, owner = chunk.fact("size"), chunk.owner
        text = np.concatenate([[0], np.cumsum(owner[1:] != owner[:-1])])
        to = np.cumsum(size) - size + 3 * (text + 1)  # three places without a unit around each text
        units = np.full(int(to[-1] + size[-1]) + 4, len(self.wanted.vocab), np.int64)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        units[np.repeat(to, size) + step] = np.array(self.units, np.int32)[np.repeat(chunk.fact("begin"), size) + step]
        filled = np.nonzero(chunk.fact("kind") >= 0)[0]
        first = to[filled] + chunk.fact("before")[filled]
        for found, pattern in self.wanted.hits(units, first, first + chunk.fact("inside")[filled], chunk.fact("shape")[filled]):
            yield filled[found], pattern


MENTION = pa.struct([("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS = "array<struct<kind:string,start:long,end:long>>"
_MENTIONS = "array<struct<kind:string,instance:string,patterns:array<string>>>"
#: What tells rows apart: rows with the same key have the same spans.
_KEY = "key struct<id:string,a:long,b:long>"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    key = F.struct(F.col(id_col).cast("string").alias("id"), F.xxhash64(text, F.lit(1)).alias("a"), F.xxhash64(text, F.lit(2)).alias("b"))
    return docs.select(key.alias("key"), text.alias("text"), F.col(id_col).alias("id"))


def scan(texts: DataFrame, seeds: Callable[[str], list[Span]]) -> DataFrame:
    """id, key, base spans and their mentions with patterns, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, mentions = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = seeds(text)
                bases.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
                units = Units(text) if spans else None
                mentions.append([{"kind": k, "instance": text[a:b], "patterns": units.patterns(a, b)} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(bases, pa.list_(SPAN)), pa.array(mentions, pa.list_(MENTION))], names=["id", "key", "base", "mentions"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, {_KEY}, base {_SPANS}, mentions {_MENTIONS}")


def _sharded(texts: DataFrame, wanted: DataFrame, col: str, schema: str, label: str, look, total: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What look(batches, set) finds in all texts, for one bounded shard of the wanted values after the other."""
    shards = max(1, -(-wanted.count() // SHARD))
    out = None
    for k in range(shards):
        some = {r[col] for r in wanted.where(F.pmod(F.xxhash64(col), F.lit(shards)) == k).select(col).collect()}

        def run(batches: Iterator[pa.RecordBatch], some=some) -> Iterator[pa.RecordBatch]:
            yield from look(batches, some)

        found = materialise(total(texts.mapInArrow(run, schema)), label)
        out = found if out is None else out.unionByName(found)
    return out


def _strings(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def kinds_of(texts: DataFrame, patterns: DataFrame, seeds: Callable[[str], list[Span]]) -> DataFrame:
    """(pattern, n, words, refuted, seeds): pieces in the places of the patterns in all texts, and what they are."""
    names = ("n", "words", "refuted", "seeds")

    def look(batches: Iterator[pa.RecordBatch], some: set[str]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(some)
        pieces = Pieces(wanted)
        n, words, wrong, known = counts = np.zeros((len(names), len(some)), np.int64)
        for batch in batches:
            strings = _strings(batch)
            for slow, chunk in pieces.chunks(strings, seeds):
                for at, pattern in pieces.hits(chunk):
                    kind = chunk.fact("kind")[at]
                    n += np.bincount(pattern, minlength=len(n))
                    words += np.bincount(pattern[kind == WORD], minlength=len(n))
                    wrong += np.bincount(pattern[kind == REFUTED], minlength=len(n))
                for row, spans in slow:
                    text = strings[row]
                    units = Units(text)
                    for a, b, seed in fillers(text, spans):
                        for p in wanted.at(units, a, b):
                            n[p] += 1
                            known[p] += bool(seed)
                            words[p] += not seed and text[a:b].isalpha()
                            wrong[p] += not seed and refuted(text[a:b])
        met = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array([wanted.patterns[p] for p in met], pa.string()), *(pa.array(c[met]) for c in counts)], names=["pattern", *names])

    def total(df: DataFrame) -> DataFrame:
        return df.groupBy("pattern").agg(*[F.sum(c).alias(c) for c in names])

    return _sharded(texts, patterns, "pattern", "pattern string" + "".join(f", {c} long" for c in names), "pii-kinds", look, total)


def places_of(texts: DataFrame, patterns: DataFrame, seeds: Callable[[str], list[Span]]) -> DataFrame:
    """(pattern, instance, n): what fills the places of the patterns in all texts; null for what is refuted."""

    def look(batches: Iterator[pa.RecordBatch], some: set[str]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(some)
        pieces = Pieces(wanted)
        for batch in batches:
            n, strings = Counter(), _strings(batch)
            for slow, chunk in pieces.chunks(strings, seeds):
                for at, pattern in pieces.hits(chunk):
                    kind = chunk.fact("kind")[at]
                    n.update((p, None if k == REFUTED else pieces.cores[i]) for i, p, k in zip(chunk.number[at].tolist(), pattern.tolist(), kind.tolist()))
                for row, spans in slow:
                    text = strings[row]
                    units = Units(text)
                    for a, b, seed in fillers(text, spans):
                        if here := wanted.at(units, a, b):
                            instance = None if not seed and refuted(text[a:b]) else text[a:b]
                            n.update((p, instance) for p in here)
            yield pa.RecordBatch.from_arrays([pa.array([wanted.patterns[p] for p, _ in n], pa.string()), pa.array([i for _, i in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["pattern", "instance", "n"])

    return _sharded(texts, patterns, "pattern", "pattern string, instance string, n long", "pii-places", look, lambda df: df.groupBy("pattern", "instance").agg(F.sum("n").alias("n")))


def totals_of(texts: DataFrame, instances: DataFrame, seeds: Callable[[str], list[Span]]) -> DataFrame:
    """(instance, total): how often the instances are mentioned in all texts."""

    def look(batches: Iterator[pa.RecordBatch], some: set[str]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(Wanted(set()), some)
        for batch in batches:
            n, strings = Counter(), _strings(batch)
            for slow, chunk in pieces.chunks(strings, seeds):
                for i in chunk.number[chunk.fact("hit") > 0].tolist():
                    n[pieces.cores[i]] += 1
                for row, spans in slow:
                    text = strings[row]
                    n.update(i for a, b, seed in fillers(text, spans) if not seed and (i := text[a:b]) in some)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["instance", "total"])

    return _sharded(texts, instances, "instance", "instance string, total long", "pii-totals", look, lambda df: df.groupBy("instance").agg(F.sum("total").alias("total")))


def mentions_of(texts: DataFrame, instances: DataFrame, seeds: Callable[[str], list[Span]]) -> DataFrame:
    """(key, start, end, instance, patterns) of the mentions of the instances in all texts."""

    def look(batches: Iterator[pa.RecordBatch], some: set[str]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(Wanted(set()), some)
        for batch in batches:
            at, out, strings = [], [], _strings(batch)
            for slow, chunk in pieces.chunks(strings, seeds):
                hit = np.unique(chunk.owner[chunk.fact("hit") > 0]).tolist()
                for row, spans in [*slow, *((r, []) for r in hit)]:
                    text, units = strings[row], None
                    for a, b, kind in fillers(text, spans):
                        if not kind and text[a:b] in some:
                            units = units or Units(text)
                            at.append(row)
                            out.append((a, b, text[a:b], units.patterns(a, b)))
            cols = zip(*out) if out else ((),) * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["key", "start", "end", "instance", "patterns"])

    return _sharded(texts, instances, "instance", f"{_KEY}, start long, end long, instance string, patterns array<string>", "pii-mentions", look, lambda df: df.dropDuplicates(["key", "start", "end"]))


def _is_word() -> Column:
    return F.col("instance").rlike(r"^\p{L}+$")


def trusted_patterns(places: DataFrame, trusted: DataFrame, ordinary: DataFrame, min_support: int, min_confidence: float) -> DataFrame:
    """(pattern, kind, trust) from (pattern, instance, n), (instance, kind, confidence) and the ordinary instances.

    The kind is that of most of what fills it.
    Without the ordinary ones a pattern's trust is too high, never too low.
    """
    told = places.join(trusted, "instance", "left").join(ordinary.select("instance", F.lit(True).alias("ordinary")), "instance", "left")
    weight = F.when(F.col("kind").isNotNull(), F.col("confidence")).when(F.col("ordinary") | F.col("instance").isNull() | _is_word(), 1.0).otherwise(UNKNOWN_WEIGHT)
    sums = told.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.sum(F.col("n") * weight).alias("weight"))
    held = F.col("kind").isNotNull()
    found = sums.groupBy("pattern").agg(
        F.sum(F.when(held, F.col("n"))).alias("support"), (F.sum(F.when(held, F.col("weight"))) / F.sum("weight")).alias("trust"), F.max(F.when(held, F.struct("weight", "kind"))).alias("k")
    )
    return found.where((F.col("support") >= min_support) & (F.col("trust") >= min_confidence)).select("pattern", "k.kind", F.least("trust", F.lit(0.99)).alias("trust"))


def possible_patterns(kinds: DataFrame, accepted: DataFrame, min_confidence: float) -> DataFrame:
    """The patterns that may be trusted, at best, and reveal something: from their counts and (pattern, instance, confidence) of mentions.

    Words must not fill most of their places, and some piece there must be neither a seed nor refuted.
    """
    own = accepted.groupBy("pattern").agg(F.sum("confidence").alias("held"), F.count("*").alias("mentions"), F.sum(_is_word().cast("long")).alias("own_words"))
    told = kinds.join(own, "pattern", "left").na.fill(0, ["held", "mentions", "own_words"])
    held = F.col("seeds") + F.col("held")
    words = F.col("words") - F.col("own_words")
    rest = F.col("n") - F.col("seeds") - F.col("refuted") - F.col("mentions") - words
    best = held / (held + words + F.col("refuted") + UNKNOWN_WEIGHT * rest)
    return told.where((best >= min_confidence - 1e-9) & (F.col("words") <= MOST_WORDS * F.col("n")) & (F.col("seeds") + F.col("refuted") < F.col("n"))).select("pattern")


def _inside(mentions: DataFrame, patterns: DataFrame) -> DataFrame:
    """(instance, total, inside): mentions in all and in places of the patterns."""
    total = mentions.groupBy("instance").agg(F.count("*").alias("total"))
    places = mentions.select("key", "start", "instance", F.explode("patterns").alias("pattern")).join(patterns, "pattern", "left_semi")
    inside = places.select("instance", "key", "start").distinct().groupBy("instance").agg(F.count("*").alias("inside"))
    return inside.join(total, "instance")


def trusted_instances(mentions: DataFrame, patterns: DataFrame, min_confidence: float, min_share: float) -> DataFrame:
    """(instance, kind, confidence) of the mentioned candidates that the patterns and their share support."""
    places = mentions.select("instance", F.explode("patterns").alias("pattern")).join(patterns, "pattern")
    sides = places.groupBy("instance", side_of(F.col("pattern")).alias("side")).agg(F.max(F.struct("trust", "kind")).alias("best"))
    sure = sides.groupBy("instance").agg(F.least(1 - F.exp(F.sum(F.log(1 - F.col("best.trust")))), F.lit(0.99)).alias("confidence"), F.count("*").alias("sides"), F.max("best").alias("best"))
    found = sure.join(_inside(mentions, patterns).where(F.col("inside") >= min_share * F.col("total")), "instance")
    return found.where((F.col("confidence") >= min_confidence) & (~_is_word() | (F.col("sides") > 1))).select("instance", "best.kind", "confidence")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def bootstrap(texts: DataFrame, rows: DataFrame, seeds: Callable[[str], list[Span]], min_support: int, min_confidence: float, min_share: float) -> DataFrame | None:
    """(key, start, end, kind, confidence) of the spans that contexts revealed; None if there is none."""
    said = rows.select(F.explode("mentions").alias("m")).select("m.*")
    first = materialise(said.groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("confidence", F.lit(1.0)), "pii-seeds")
    found, trusted = None, first
    evidence = [materialise(said.select("instance", F.explode("patterns").alias("pattern")).distinct(), "pii-evidence")]
    kinds: list[DataFrame] = []
    places: list[DataFrame] = []
    totals: list[DataFrame] = []
    mentions: list[DataFrame] = []
    accepted = evidence[0].limit(0).withColumn("confidence", F.lit(1.0))
    n_found = 0
    while True:
        able = _union(evidence).distinct().groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).select("pattern")
        fresh = materialise(able.join(_union(kinds), "pattern", "left_anti") if kinds else able, "pii-patterns")
        if not fresh.isEmpty():
            kinds.append(kinds_of(texts, fresh, seeds))
        elif found is None or found.count() == n_found:
            break
        n_found = found.count() if found is not None else 0
        possible = materialise(possible_patterns(_union(kinds), accepted, min_confidence), "pii-possible")
        new = possible.join(_union(places).select("pattern").distinct(), "pattern", "left_anti") if places else possible
        if not new.isEmpty():
            places.append(places_of(texts, new, seeds))
        if not places:
            break
        # What fills patterns that may be trusted is looked for in all texts, if it may be mostly there.
        none = trusted.select("instance").limit(0)
        maybe = materialise(trusted_patterns(_union(places), trusted, none, min_support, min_confidence), "pii-patterns")
        if maybe.isEmpty():
            break
        slots = _union(places).join(maybe.select("pattern"), "pattern").where("instance is not null").groupBy("instance").agg(F.sum("n").alias("n"))
        slots = materialise(slots.join(first.select("instance"), "instance", "left_anti"), "pii-slots")
        new = slots.select("instance")
        if totals:
            new = new.join(_union(totals), "instance", "left_anti")
        new = materialise(new, "pii-candidates")
        if not new.isEmpty():
            totals.append(totals_of(texts, new, seeds))
        if not totals:
            break
        near = slots.join(_union(totals), "instance").where(F.col("n") >= min_share * F.col("total")).select("instance")
        if mentions:
            near = near.join(_union(mentions).select("instance").distinct(), "instance", "left_anti")
        near = materialise(near, "pii-near")
        if not near.isEmpty():
            mentions.append(mentions_of(texts, near, seeds))
        if not mentions:
            break
        often = _inside(_union(mentions), maybe).where(F.col("inside") >= min_share * F.col("total"))
        ordinary = slots.join(often, "instance", "left_anti").select("instance")
        patterns = materialise(trusted_patterns(_union(places), trusted, ordinary, min_support, min_confidence), "pii-trusted-patterns")
        found = materialise(trusted_instances(_union(mentions), patterns, min_confidence, min_share), "pii-trusted")
        trusted = first.unionByName(found)
        accepted = materialise(_union(mentions).join(found.select("instance", "confidence"), "instance").select("instance", F.explode("patterns").alias("pattern"), "confidence"), "pii-accepted")
        evidence = [evidence[0], accepted.select("instance", "pattern")]
    if not mentions or found is None or found.isEmpty():
        return None
    return _union(mentions).select("key", "start", "end", "instance").join(found, "instance")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_share: float = MIN_SHARE, seeds: Callable[[str], list[Span]] = base_spans) -> DataFrame:
    """id, base (spans of the formats) and added (spans that contexts revealed, with confidence).

    seeds gives the spans (start, end, kind) of a text that are known; another function may hide some.
    """
    texts = _texts(docs, id_col, text_col)
    rows = materialise(scan(texts, seeds), "pii-scan")
    spans = bootstrap(texts.select("key", "text"), rows, seeds, min_support, min_confidence, min_share)
    none = F.array().cast("array<struct<start:long,end:long,kind:string,confidence:double>>")
    if spans is None:
        return rows.select(F.col("id").alias(id_col), "base", none.alias("added"))
    added = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.concat(F.lit("ctx_"), "kind").alias("kind"), "confidence"))).alias("added"))
    same = F.col("r.key").eqNullSafe(F.col("s.key"))
    return rows.alias("r").join(added.alias("s"), same, "left").select(F.col("id").alias(id_col), "base", F.coalesce("added", none).alias("added"))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Digest of the spans of every document."""
    found = extract(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def of_kind(kind: str):
        return lambda x: x["kind"] == kind

    def rank(kind: Column) -> Column:
        return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, *(f"ctx_{k}" for k in KINDS))]), kind)

    def keyed(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))

    every = F.array_sort(F.concat(F.transform("base", keyed), F.transform("added", keyed)))
    return found.select(
        "doc_id",
        *[F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _digest(every).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
