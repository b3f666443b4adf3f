import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from mosaicq.llm import quote_links as Q


def order(spark, rows):
    got = Q.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return [tuple(r) for r in got.orderBy("conv_id", "position").collect()]


def test_parse_levels():
    own, passages = Q.parse("Hi\nOn Monday A wrote:\n> one\n> > deep\n>> deeper\n> back\n\nmy answer")
    assert own == "Hi\n\nmy answer"
    assert passages == [(1, ["one"]), (2, ["deep", "deeper"]), (1, ["back"])]


def test_threads(spark):
    rows = [
        (1, 0, "user", "First Question about   spark\nand more"),
        (1, 1, "user", "Second topic entirely"),
        (1, 2, "assistant", "> first question ABOUT spark and more\nAnswer one"),
        (1, 3, "assistant", "A said:\n> second topic entirely\nAnswer two"),
        (1, 4, "user", "> > first question about spark\n> Answer one\nThanks"),
        (1, 5, "user", "> never said\nAlone"),
        (1, 5, "user", "> never said\nAlone"),
        (2, 0, "user", "> first question about spark and more\nother conversation"),
        (2, 1, "user", None),
        (None, None, "user", ""),
        (None, 3, None, "x"),
    ]
    got = order(spark, rows)
    first = [(r[1], r[3], r[4], r[5], r[6], r[7], r[8], r[9]) for r in got if r[0] == 1]
    assert first == [
        (0, 0, 0, None, 0, 0, 0, "First Question about   spark\nand more"),
        (2, 1, 0, 0, 1, 1, 1, "Answer one"),
        (4, 2, 0, 2, 2, 2, 2, "Thanks"),
        (1, 3, 1, None, 0, 0, 0, "Second topic entirely"),
        (3, 4, 1, 1, 1, 1, 1, "Answer two"),
        (5, 5, 5, None, 0, 1, 0, "Alone"),
    ]
    assert [(r[1], r[3], r[8], r[9]) for r in got if r[0] == 2] == [(0, 0, 0, "other conversation"), (1, 1, 0, "")]
    assert [(r[1], r[3]) for r in got if r[0] is None] == [(3, 0), (None, 1)]


def test_long_chain_and_repeated_line(spark):
    rows = [(9, 0, "user", "line number 0\nsame words")] + [(9, i, "user", f"> line number {i - 1}\n> same words\nline number {i}\nsame words") for i in range(1, 70)]
    got = order(spark, rows)
    # the shared line's original is message 0, the other line's is the message before
    assert [r[5] for r in got[1:]] == list(range(69)) and [r[6] for r in got] == list(range(70))


def test_plain_chat_and_empty(spark):
    rows = [(c, t, "user", f"hello {t}") for c in range(3) for t in range(2500)]
    got = order(spark, rows)
    assert [(r[0], r[3]) for r in got] == [(c, t) for c in range(3) for t in range(2500)] and all(r[1] == r[3] for r in got)
    assert order(spark, []) == []


def brute(rows):
    """Every column of reply_order, message by message."""
    rows = list(dict.fromkeys(rows))
    last = 2**63 - 1

    def mid(r):
        return hashlib.md5("\0".join("" if v is None else f"={v}" for v in r).encode()).hexdigest()

    def at(r):
        return last if r[1] is None else r[1]

    def norm(t):
        return " ".join(t.lower().split())

    def split(text):
        own, passages, before = [], [], 0
        for line in (text or "").split("\n"):
            level, rest = 0, line.lstrip()
            while rest.startswith(">"):
                level += 1
                rest = rest[1:]
                while level and rest[:1].isspace() and rest[1:].startswith(">"):
                    rest = rest[1:]
            if level and rest[:1].isspace():
                rest = rest[1:]
            if level:
                if not before and own and re.search(r"(?i)(^on\b.*\bwrote|said):\s*$", own[-1]):
                    own.pop()
                if level != before:
                    passages.append((level, []))
                passages[-1][1].append(rest)
            else:
                own.append(line)
            before = level
        return "\n".join(own).strip("\n"), passages

    parts = {r: split(r[3]) for r in rows}
    said = {}
    for r in rows:
        own = parts[r][0]
        for text in [own, *re.split(r"\n\s*\n", own), *own.split("\n")]:
            if norm(text):
                key = (r[0], norm(text))
                said[key] = min(said.get(key, (at(r), mid(r), r)), (at(r), mid(r), r), key=lambda x: x[:2])
    parent, linked = {}, {}
    for r in rows:
        votes, found = collections.Counter(), []
        for level, lines in parts[r][1]:
            whole = norm(" ".join(lines))
            keys = [whole] if whole and said.get((r[0], whole), (last,))[0] < at(r) else [norm(x) for x in lines if norm(x)]
            hits = [(said[r[0], k], len(k)) for k in keys if (r[0], k) in said and said[r[0], k][0] < at(r)]
            if hits:
                found.append((level, hits))
        linked[r] = len(found)
        if found:
            low = min(level for level, _ in found)
            for _, hits in (f for f in found if f[0] == low):
                for of, n in hits:
                    votes[of] += n
            parent[r] = max((n, of[0], of[1], of[2]) for of, n in votes.items())[3]
    out = collections.defaultdict(list)
    for r in rows:
        top, depth = r, 0
        while top in parent:
            top, depth = parent[top], depth + 1
        out[r[0]].append(((at(top), mid(top), at(r), mid(r)), (r[0], r[1], r[2], top[1], parent[r][1] if r in parent else None, depth, len(parts[r][1]), linked[r], parts[r][0])))
    return [(*v[:3], k, *v[3:]) for c in out.values() for k, (_, v) in enumerate(sorted(c, key=lambda x: x[0]))]


def generated(rng, n):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for conv in (1, 2, None):
        said = []
        for turn in range(n):
            lines = [" ".join(rng.choices(words, k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 4))]
            if rng.random() < 0.2:
                lines.insert(0, rng.choice(["same old line", "  SAME   old line", ""]))
            text = "\n".join(lines)
            for _ in range(rng.randrange(3) if said else 0):
                of = rng.choice(said)
                mark = rng.choice(["> ", ">", "  > "])
                part = of if rng.random() < 0.6 else rng.choice(of.split("\n"))
                intro = rng.choice(["", "On Monday somebody wrote:\n", "x said:\n"])
                quoted = "\n".join(mark + (x.upper() if rng.random() < 0.2 else x) for x in part.split("\n"))
                text = rng.choice([f"{intro}{quoted}\n{text}", f"{text}\n{intro}{quoted}"])
            said.append(text)
            when = rng.choice([turn, turn, turn, turn // 4, None])
            rows.append((conv, when, rng.choice(["user", "assistant", None]), text if rng.random() < 0.97 else None))
    return rows + rows[:3]


def test_every_column_equals_brute_force(spark):
    for seed in (1, 2):
        rows = generated(random.Random(seed), 60)
        got = [(r.conv_id, r.turn, r.role, r.position, r.root_turn, r.parent_turn, r.depth, r.n_quotes, r.n_linked, r.content) for r in Q.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
        assert sum(r[8] > 0 for r in got) > 30 and max(r[6] for r in got) > 3


def test_equal_turns_are_not_ordered_in_one_task(spark):
    rows = [(1, None, "user", f"message {i}") for i in range(3000)] + [(2, 5, "user", f"message {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"mid": F.lit(1), "ck": F.lit("x"), "step": F.lit(2)})
    got = Q.reply_order(df).collect()
    assert sorted((r.conv_id, r.position) for r in got) == [(c, p) for c in (1, 2) for p in range(3000)]
    assert len({r.content for r in got if r.conv_id == 1}) == 3000


def test_very_long_message(spark):
    long = "\n".join(f"line {i}" for i in range(30_000))
    got = order(spark, [(1, 0, "user", long), (1, 1, "user", "\n".join("> " + x for x in long.split("\n")) + "\nyes")])
    assert [(r[1], r[5], r[8], r[9]) for r in got] == [(0, None, 0, long), (1, 0, 1, "yes")]
