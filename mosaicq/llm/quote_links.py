"""Quotation linking: quoted passages find the messages they come from.

Lines that begin with one or more ``>`` are quotes of that level; a run of lines of one level is a
passage. Passages and their lines are normalised (case, white space) and hashed, as are the own texts,
paragraphs and lines of all messages; the original of a hash in a conversation is its first author.
A message replies to the original of most of its quoted letters at its lowest quote level (of equal
ones the latest); replies are chased to the first message of their thread by pointer doubling. A
conversation in reply order is its threads by their first message, each in order of turns, every
message without the quotes.

Originals are one row a (conversation, hash), made by an aggregate that combines before the shuffle,
so a line that everybody repeats meets its quotes once each. Positions are sums of counts: of steps of
1024 turns, in these of turns and leading digits of message ids, and so on, so neither a conversation nor a
turn (null in every message, say) is ordered in one task.

Defined results: null and empty texts have no passages and empty content; exactly repeated rows are
one message; messages without a linked quote start a thread of their own; a quote of something never
said before stays unlinked and is still removed; null conversations are one conversation, null turns
come last; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaicq.workspace import materialise

STEP = 1024
#: Leading hexadecimal digits of an id that make a bucket.
DIGITS = 4
_QUOTE = re.compile(r"\s*((?:>\s?)+)")
_SAID = re.compile(r"(?:on\b.*\bwrote|.*\bsaid):\s*$", re.IGNORECASE)
_LAST = (1 << 63) - 1


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """(own text, [(level, lines) of each quoted passage])."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        m = _QUOTE.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            if not last and own and _SAID.match(own[-1]):
                own.pop()
            if level != last:
                passages.append((level, []))
            passages[-1][1].append(line[m.end() :])
        last = level
    return "\n".join(own).strip("\n"), passages


def original_keys(own: str) -> set[str]:
    """Hashes under which a message can be quoted."""
    parts = [own, *re.split(r"\n\s*\n", own), *own.split("\n")]
    return {digest(n) for n in map(normalised, parts) if n}


def quote_keys(passages: list[tuple[int, list[str]]]) -> list[tuple[int, int, bool, str, int]]:
    """(passage, level, whole, hash, letters): of each passage and of each of its lines."""
    out = []
    for k, (level, lines) in enumerate(passages):
        whole = normalised(" ".join(lines))
        if whole:
            out.append((k, level, True, digest(whole), len(whole)))
            out += [(k, level, False, digest(n), len(n)) for n in map(normalised, lines) if n]
    return out


QUOTE = pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("whole", pa.bool_()), ("key", pa.string()), ("letters", pa.int64())])


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row a message: id, conversation key, order key, content, hashes of own text, quotes."""
    kinds = {c: messages.schema[c].dataType.simpleString() for c in (conv_col, turn_col)}
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    text_key = F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("conv", "turn", "role", "text")])
    rows = rows.withColumn("mid", F.md5(text_key)).dropDuplicates(["mid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, keys, quotes, n = [], [], [], []
            for text in batch.column(3).to_pylist():
                own, passages = parse(text or "")
                content.append(own)
                keys.append(sorted(original_keys(own)))
                quotes.append([dict(zip(("passage", "level", "whole", "key", "letters"), q)) for q in quote_keys(passages)])
                n.append(len(passages))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in (0, 1, 2, 4)), pa.array(content, pa.string()), pa.array(keys, pa.list_(pa.string())), pa.array(quotes, pa.list_(QUOTE)), pa.array(n, pa.int64())],
                names=["conv", "turn", "role", "mid", "content", "keys", "quotes", "n_quotes"],
            )

    out = rows.mapInArrow(run, f"conv {kinds[conv_col]}, turn {kinds[turn_col]}, role string, mid string, content string, keys array<string>, quotes array<struct<passage:int,level:int,whole:boolean,key:string,letters:long>>, n_quotes long")
    return out.withColumn("ck", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))).withColumn("at", F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)))


def link_quotes(rows: DataFrame) -> DataFrame:
    """(mid, parent, n_linked): the message replied to, and how many passages found an original."""
    said = rows.select("ck", "at", "mid", F.explode("keys").alias("key")).groupBy("ck", "key").agg(F.min(F.struct("at", "mid")).alias("o"))
    asked = rows.where("n_quotes > 0").select("ck", "at", "mid", F.explode("quotes").alias("q")).select("ck", "at", "mid", "q.*")
    hits = asked.join(said, ["ck", "key"]).where(F.col("o.at") < F.col("at"))
    # A passage found whole needs no lines.
    whole = hits.groupBy("mid", "passage").agg(F.max("whole").alias("any_whole"))
    hits = hits.join(whole, ["mid", "passage"]).where(F.col("whole") == F.col("any_whole"))
    n_linked = hits.groupBy("mid").agg(F.count_distinct("passage").alias("n_linked"), F.min("level").alias("low"))
    votes = hits.join(n_linked, "mid").where("level = low").groupBy("mid", "n_linked", F.col("o.at").alias("pat"), F.col("o.mid").alias("pid")).agg(F.sum("letters").alias("letters"))
    best = votes.groupBy("mid", "n_linked").agg(F.max(F.struct("letters", "pat", "pid")).alias("b"))
    return best.select("mid", F.col("b.pid").alias("parent"), "n_linked")


def roots(links: DataFrame) -> DataFrame:
    """(mid, root, depth) of every message that has a parent, by pointer doubling."""
    up = materialise(links.select("mid", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "quote-roots")
    while True:
        above = up.select(F.col("mid").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        if up.join(above, "root", "left_semi").isEmpty():
            return up
        jumped = up.join(above, "root", "left")
        up = materialise(jumped.select("mid", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "quote-roots")


#: What orders messages, from coarse to fine: each level's bucket, in order, inside the levels before it.
_LEVELS = (("root_step",), ("root_at", "root_digits"), ("root", "step"), ("at", "digits"))


def positioned(rows: DataFrame) -> DataFrame:
    """rows (ck, root_at, root, at, mid) with position: 0, 1, ... in each conversation, by root_at, root, at, mid."""
    rows = rows.withColumns({
        "root_step": F.floor(F.col("root_at") / STEP), "root_digits": F.substring("root", 1, DIGITS),
        "step": F.floor(F.col("at") / STEP), "digits": F.substring("mid", 1, DIGITS),
    })
    names = ["ck", *(c for level in _LEVELS for c in level)]
    counts = offsets = rows.groupBy(names).agg(F.count("*").alias("n"))
    for depth, level in enumerate(_LEVELS):
        outer = names[: names.index(level[0])]
        inner = [*outer, *level]
        sums = counts.groupBy(inner).agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy(outer).orderBy(*level)) - F.col("n")
        offsets = offsets.join(sums.select(*inner, before.alias(f"o{depth}")), inner)
    offsets = offsets.select(*names, sum((F.col(f"o{d}") for d in range(1, len(_LEVELS))), F.col("o0")).alias("offset"))
    own = F.row_number().over(Window.partitionBy(names).orderBy("mid")) - 1
    return rows.withColumn("own", own).join(offsets, names).withColumn("position", (F.col("offset") + F.col("own")).cast("long"))


def reply_order(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a message: its position in its conversation, its thread, and its text without quotes."""
    rows = materialise(parsed(messages, conv_col, turn_col, role_col, text_col), "quote-rows")
    links = materialise(link_quotes(rows), "quote-links")
    tops = roots(links)
    turns = rows.select(F.col("mid").alias("id"), F.col("turn").alias("t"), F.col("at").alias("a"))
    told = rows.select("conv", "turn", "role", "mid", "ck", "at", "content", "n_quotes").join(links, "mid", "left").join(tops, "mid", "left")
    told = told.withColumn("root", F.coalesce("root", "mid"))
    told = told.join(turns.select(F.col("id").alias("root"), F.col("t").alias("root_turn"), F.col("a").alias("root_at")), "root")
    told = told.join(turns.select(F.col("id").alias("parent"), F.col("t").alias("parent_turn")), "parent", "left")
    return positioned(told).select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "position", "root_turn", "parent_turn", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "content"
    )


def op3_quote_linking(spark, sf_dir: str) -> DataFrame:
    """Every message of every conversation in reply order."""
    return reply_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
