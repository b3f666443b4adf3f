"""Places of a pattern are counted in all texts."""

import collections
import math
import random
import zlib

from mosaicq.llm import pii


def found(spark, rows):
    return {r.doc_id: [(x.kind, x.start) for x in r.added] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_places_cover_all_texts(spark):
    seeds = [(i, f"word{i} one of the bob{i}@example.com now") for i in range(5)] + [(10, "last one of the 2024-05-17 days")]
    assert found(spark, seeds)[10] == [("ctx_email", 16)]
    other = [(100 + i, f"some OF  the{chr(10) if i % 2 else ' '}people and of\tthe others") for i in range(20)]
    assert not any(found(spark, seeds + [(i, "One  of The people " + t) for i, t in other]).values())


def test_places_match_contexts():
    texts = ["Mail  TO\nbob1@x.org, mail to: a1b2c3d4; mail to \u00fc123456", "x" * 130 + " mail to 10.0.0.1", "y" * 112_000 + " mail to 10.0.0.1 mail to"]
    wanted = pii.Wanted({"mail to <>", "please mail to <>", "to : <>", "<> , mail", "to <> ,", "to <0.0.0.0>", "to <a0@a.a>"})


    def places(text):
        units = pii.Units(text)
        return sorted((p, text[a:b]) for a, b, _ in pii.fillers(text, pii.base_spans(text)) for p in map(wanted.patterns.__getitem__, wanted.at(units, a, b)))

    assert places(texts[0]) == [("<> , mail", "bob1@x.org"), ("mail to <>", "bob1@x.org"), ("mail to <>", "\u00fc123456"), ("to : <>", "a1b2c3d4"), ("to <> ,", "bob1@x.org"), ("to <a0@a.a>", "bob1@x.org")]
    assert places(texts[1]) == places(texts[2]) == [("mail to <>", "10.0.0.1")]
    assert pii.Units(texts[0]).patterns(10, 12) == []  # inside a word


def test_fillers_are_whole_pieces():
    t = 'please call (0171) 555 0199, or mail jane.doe(at)example.org (see notes) "Bob" 4111 1111 1111 1111! 12 days x'
    got = [t[a:b] for a, b, _ in sorted(pii.fillers(t, pii.base_spans(t)), key=lambda x: x[0])]
    assert got == ["please", "call", "0171) 555 0199", "or", "mail", "jane.doe(at)example.org", "see", "notes", "Bob", "4111 1111 1111 1111", "12", "days", "x"]


LEFT = ["please write to {}", "you can reach me under {}", "my address is {}", "kindly send it over to {}", "the sender was {}", "reply directly to {}"]
RIGHT = ["{} is where I live online", "{} sent this yesterday evening", "with {} as the contact", "ask {} for more about it"]


def corpus(rng, n):
    """Texts with identifiers in repeated contexts, others of them in no context, numbers and words in contexts of their own."""
    words = [rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("bcdfgklmnprst") + rng.choice("aeiou") + rng.choice("xyzlmn") for _ in range(400)]
    noise = lambda: " ".join(rng.choices(words, k=rng.randrange(4, 20)))
    rows, names = [], set()
    for i in range(n):
        name = [f"user{i}.{rng.choice(words)}@example{i % 7}.com", f"10.{i % 250}.{rng.randrange(250)}.7", f"+44 20 7946 {1000 + i}", f"{rng.choice(words)}{i}(at)mail.example"][i % 4]
        names.add(name)
        for frame in (rng.choice(LEFT), rng.choice(RIGHT)):
            rows.append(f"{noise()} {frame.format(name)} {noise()}.")
        rows.append(f"{noise()} order number {rng.randrange(10**6)}-{i} came on 2024-0{1 + i % 9}-11 and {noise()}")
        rows.append(f"{noise()} {rng.choice(LEFT).format('411111111111%04d' % i)} {noise()}" if i % 9 == 0 else noise())
        rows.append(f"{noise()} the price was {rng.randrange(10**5)} of {rng.choice(words)} {noise()}")
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)], names


def test_hidden_seeds_are_found_again(spark):
    rng = random.Random(11)
    rows, names = corpus(rng, 320)
    hidden = {n for n in names if zlib.crc32(n.encode()) % 2}

    def half(text):
        return [s for s in pii.base_spans(text) if text[s[0] : s[1]] not in hidden]

    got = pii.extract(spark.createDataFrame(rows, "doc_id long, text string"), seeds=half).collect()
    texts = dict(rows)
    found = {texts[r.doc_id][x.start : x.end] for r in got for x in r.added}
    # Those without a format are unseen to any seed, as are the hidden ones.
    unseen = {n for n in names if n in hidden or "(at)" in n}
    assert len(found & unseen) >= 0.9 * len(unseen) and len(found & unseen) >= 0.9 * len(found)
    spans = sum(len(r.added) for r in got)
    assert spans >= 0.9 * sum(t.count(n) for n in unseen for t in texts.values() if n in t)


def test_letters_alone_need_more_than_one_side(spark):
    rows = [(i, f"x{i} please mail to bob{i}@example.com now or never {i}") for i in range(40)]
    rows += [(100, "ab please mail to nobody else"), (101, "cd please mail to jdoe now or never"), (102, "ef please mail to jane.doe(at)example.org, ok")]
    got = {i: [(x.kind, x.start, x.end) for x in spans] for i, spans in ((r.doc_id, r.added) for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect())}
    assert got[101] == [("ctx_email", 18, 22)] and got[102] == [("ctx_email", 18, 41)] and not got[100] and not got[5]


def test_a_chain_of_hops_is_followed_to_its_end(spark):
    rows = [(i, f"q{i} write me at bob{i}@example.com") for i in range(6)]
    for hop in range(6):
        for i in range(6):
            name = f"n{hop}-{i}-id"
            at = "write me at" if not hop else f"hop {hop} is"
            rows.append((1000 + hop * 100 + i, f"r{i} {at} {name}") if hop else (500 + i, f"r{i} write me at {name}"))
            rows.append((2000 + hop * 100 + i, f"s{i} hop {hop + 1} is {name}"))
    rows += [(3000 + i, f"t{i} write me at bob{i}@example.com") for i in range(20, 60)]
    got = {r.doc_id: len(r.added) for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string"), min_share=0.3).collect()}
    assert all(n == (500 <= i < 3000) for i, n in got.items())


def brute(rows, min_support=5, limit=0.8, share=0.5, unknown=0.1):
    """The same graph in dictionaries over all fillers of all texts."""
    every = []
    for i, t in rows:
        units = pii.Units(t or "")
        every += [(i, a, b, kind, (t or "")[a:b], set(units.patterns(a, b))) for a, b, kind in pii.fillers(t or "", pii.base_spans(t or ""))]
    seeds = {}
    for x in every:
        if x[3]:
            seeds[x[4]] = min(x[3], seeds.get(x[4], x[3]))
    places, of = collections.defaultdict(collections.Counter), collections.defaultdict(list)
    for x in every:
        of[x[4]].append(x)
        for p in x[5]:
            places[p][x[4]] += 1

    def sure_of(trusted, ordinary):
        out = {}
        for p, n in places.items():
            held = [i for i in n if i in trusted]
            weight = {i: k * (trusted[i][1] if i in trusted else 1 if i.isalpha() or i in ordinary or pii.refuted(i) else unknown) for i, k in n.items()}
            trust = sum(weight[i] for i in held) / sum(weight.values())
            words = sum(k for i, k in n.items() if i.isalpha())
            if len(held) >= min_support and trust >= limit and 2 * words <= sum(n.values()):
                votes = collections.Counter()
                for i in held:
                    votes[trusted[i][0]] += weight[i]
                out[p] = (min(trust, 0.99), max((v, k) for k, v in votes.items())[1])
        return out

    def inside(name, sure):
        return sum(any(p in sure for p in x[5]) for x in of[name])

    trusted = {k: (kind, 1.0) for k, kind in seeds.items()}
    while True:
        maybe = sure_of(trusted, set())
        ordinary = {i for i in of if i not in seeds and inside(i, maybe) < share * len(of[i])}
        sure, now = sure_of(trusted, ordinary), {k: (kind, 1.0) for k, kind in seeds.items()}
        for name in {i for i in of if i not in seeds and not pii.refuted(i)}:
            sides = {}
            for p in (p for x in of[name] for p in x[5] if p in sure):
                side = "l" if p.endswith(" <>") else "r" if p.startswith("<> ") else "b" if " <> " in p else "s"
                sides[side] = max(sides.get(side, (0, "")), sure[p])
            conf = min(1 - math.prod(1 - v for v, _ in sides.values()), 0.99)
            if sides and inside(name, sure) >= share * len(of[name]) and conf >= limit and (len(sides) > 1 or not name.isalpha()):
                now[name] = (max(sides.values())[1], conf)
        if now.keys() == trusted.keys():
            return sorted((x[0], x[1], x[2], "ctx_" + now[x[4]][0]) for x in every if not x[3] and x[4] in now)
        trusted = now


def test_refuted_numbers_stay(spark):
    good, bad = (["411111111111%04d" % i for i in range(4000) if pii.luhn("411111111111%04d" % i) == ok] for ok in (True, False))
    assert pii.refuted(bad[0]) and pii.refuted("1.2.3.256") and not any(map(pii.refuted, (good[0], "1.2.3.4", "2024-05-17", "a1", "1.2.3")))
    rows = [(i, f"w{i} the card {good[i]} was used") for i in range(40)] + [(100 + i, f"w{i} the card {bad[i]} was used") for i in range(4)] + [(200, "the card 77-ab-1 was used")]
    got = {r.doc_id: [(x.kind, x.start) for x in r.added] for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200] == [("ctx_card", 9)] and not any(v for k, v in got.items() if k != 200)


def test_scores_equal_brute_force(spark):
    rng = random.Random(12)
    rows, _ = corpus(rng, 100)
    rows += [(10_000, None), (10_001, ""), (10_002, rows[0][1]), (10_003, "word " * 30_000 + "reply directly to z9z9z9 " + "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, x.start, x.end, x.kind) for r in pii.extract(df).collect() for x in r.added)
    assert got and got == brute(rows)
    twice = sorted((r.doc_id, x.start, x.end, x.kind) for r in pii.extract(df.unionByName(df)).collect() for x in r.added)
    assert twice == sorted(got + got)


def test_numbered_pieces_find_what_units_find(sf_dir):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()]
    texts += ["", " ", "a", "(a) [b]. 12 34, x-1 12 (34", "é" * 5, "1 2", "one two three.\n\n— four", "x\x1fy\xa0z w"]
    every = collections.Counter(p for t in texts for u in [pii.Units(t)] for a, b, _ in pii.fillers(t, pii.base_spans(t)) for p in u.patterns(a, b))
    wanted = pii.Wanted({p for n, p in enumerate(sorted(every)) if n % 3 == 0} | {"never there <>", "<> never there"})
    pieces, got, seen = pii.Pieces(wanted), collections.Counter(), 0
    for slow, chunk in pieces.chunks(texts, pii.base_spans):
        seen += len(set(chunk.owner.tolist()))
        for _, pattern in pieces.hits(chunk):
            got.update(map(wanted.patterns.__getitem__, pattern.tolist()))
        for row, spans in slow:
            units = pii.Units(texts[row])
            got.update(wanted.patterns[p] for a, b, _ in pii.fillers(texts[row], spans) for p in wanted.at(units, a, b))
    assert got == collections.Counter({p: n for p, n in every.items() if p in wanted.numbers}) and seen > len(texts) / 2
