"""Quality rules: a threshold table compiled into one native projection.

Every measure is a Spark SQL expression of the text column alone; no Python runs on executors and
nothing is shuffled. Defined results: null text counts as empty (all measures 0, base_failed); an
empty or blank text likewise; repeated rows are measured one by one; other columns, whatever their
names, are neither read nor changed by ``keep``; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "de la le et les des en un du une que pour est par dans qui avec pas sur au "
    "der die und den von zu das mit sich auf für ist im nicht dem ein eine als "
    "el y los se las del por con no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject when ``100 * measure > limit * per`` (above) or ``100 * measure < limit * per`` (below)."""

    name: str
    measure: str
    per: str | None
    limit: int
    above: bool


#: The first two rows are the base rules. Integer percentages: no rounding takes part in a verdict.
RULES = (
    Rule("too_short", "n_words", None, 50, above=False),
    Rule("repeated_windows", "n_repeat_words", "n_words", 50, above=True),
    Rule("symbols", "n_symbols", "n_words", 25, above=True),
    Rule("long_words", "word_chars", "n_words", 2500, above=True),
    Rule("short_words", "word_chars", "n_words", 200, above=False),
    Rule("few_stop_words", "n_stop_words", "n_words", 2, above=False),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 50, above=True),
)
BASE_RULES = ("too_short", "repeated_windows")


def _let(value: Column, body) -> Column:
    """Bind value once for body: lambda variables are evaluated once, outer expressions per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _words(text: Column) -> Column:
    body = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RUN))


def _covered_by_repeats(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, the first occurrence included.

    Windows are hashed to 64 bits; hash and position share one long (as many position bits as the
    text needs), so that one primitive sort brings equal windows together. Neighbours that agree in
    the packed part are compared by the whole hash.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def coverage(h: Column) -> Column:
        return _let(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(h).cast("long")))) - 1, lambda mask: with_mask(h, mask))

    def with_mask(h: Column, mask: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
        return _let(packed, lambda p: _let(F.size(p), lambda n: _let(starts(h, mask, p, n), total)))

    def starts(h: Column, mask: Column, p: Column, n: Column) -> Column:
        def place(x: Column) -> Column:
            return x.bitwiseAND(mask).cast("int")

        def twins(x: Column, y: Column) -> Column:
            return (x.bitwiseXOR(y) <= mask) & (x.bitwiseXOR(y) >= 0) & (h[place(x)] == h[place(y)])

        hit = F.filter(p, lambda x, k: (F.when(k > 0, twins(x, p[k - 1])).otherwise(False)) | (F.when(k < n - 1, twins(x, p[k + 1])).otherwise(False)))
        return F.sort_array(F.transform(hit, place))

    def total(q: Column) -> Column:
        steps = F.transform(q, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - q[F.greatest(k - 1, F.lit(0))])))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(coverage(h))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(windows(words), of_hashes))


def measures(text: Column) -> Column:
    """A struct of all measures of one text."""
    t = F.coalesce(text, F.lit(""))
    stops = [F.lit(x) for x in STOP_WORDS]

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _covered_by_repeats(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*stops))).cast("long").alias("n_stop_words"),
        )

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return F.struct(
        _let(_words(t), of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        F.length(_without(t, SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
    )


def _failed(rule: Rule, m: dict[str, Column]) -> Column:
    value, limit = m[rule.measure], rule.limit * (m[rule.per] if rule.per else F.lit(1).cast("long"))
    value = value * 100 if rule.per else value
    return value > limit if rule.above else value < limit


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, measures, base_failed, kept and the names of the failed rules."""
    m = F.col("_m")
    cols = {k: m["w"][k] for k in ("n_words", "n_repeat_words", "n_stop_words")} | {k: m["l"][k] for k in ("n_lines", "n_dup_lines")} | {k: m[k] for k in ("word_chars", "n_symbols")}
    flat = docs.select(F.col(id_col).alias(id_col), measures(F.col(text_col)).alias("_m")).select(id_col, *[c.alias(k) for k, c in cols.items()])
    named = {k: F.col(k) for k in cols}
    base = F.lit(False)
    every = F.lit(False)
    for r in rules:
        every = every | _failed(r, named)
        base = base | _failed(r, named) if r.name in BASE_RULES else base
    why = F.concat_ws(",", *[F.when(_failed(r, named), F.lit(r.name)) for r in rules])
    return flat.select("*", base.alias("base_failed"), (~every).alias("kept"), why.alias("failed_rules"))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, columns unchanged."""
    m = measures(F.col(text_col))

    def verdict(x: Column) -> Column:
        cols = {k: x["w"][k] for k in ("n_words", "n_repeat_words", "n_stop_words")} | {k: x["l"][k] for k in ("n_lines", "n_dup_lines")} | {k: x[k] for k in ("word_chars", "n_symbols")}
        bad = F.lit(False)
        for r in rules:
            bad = bad | _failed(r, cols)
        return ~bad

    return docs.where(_let(m, verdict))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document measured and judged."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls
  FROM d),
win AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda x: list_contains([__STOPS__], lower(x)))) AS BIGINT) AS n_stop
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 100 * word_chars > 2500 * n_words OR 100 * word_chars < 200 * n_words
       OR 100 * n_stop < 2 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM b
""".replace("__STOPS__", ", ".join(f"'{x}'" for x in STOP_WORDS))
