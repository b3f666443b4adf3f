"""PII, licences, languages, quality, decontamination: exact checks and held-out accuracy."""

import hashlib
import math
import re

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from mosaicq.llm import decontam, language_id, license_scan, pii, quality

SHAPES = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda g: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda g: all(int(x) <= 255 for x in g.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda g: 12 <= len(re.sub("[^0-9]", "", g)) <= 19 and checksum(re.sub("[^0-9]", "", g))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda g: 9 <= len(re.sub("[^0-9]", "", g)) <= 15),
]


def checksum(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        total += int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def plain_spans(text):
    out = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(SHAPES) for m in re.finditer(p, text) if ok(m[0])]
    return [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


ODD = [
    "a@b.c_d@e.f x@y x@y.z. @a.b a.b@c-.d-e, ü@x.y ..@a.b",
    "1.2.3.4.5 256.1.1.1 1.2.3 001.002.003.004 9.9.9.9.9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1112 0000 0000 0000 1234567890123456789012 +1 (234) 555-0000 +1-2 +44 20 7946 0958 1 +(1",
    "+12345678901234567890 +1........2 +1 + 1 +9 9",
    "x" * 3000 + "@" + "y" * 3000 + ".z " + "1" * 3000 + " " + "1." * 500 + " " + "a@" * 500,
    "",
]


def test_pii_base_is_exact(spark, sf_dir):
    assert [[f"{k}:{a}:{b}" for a, b, k in pii.base_spans(t)] for t in ODD] == [plain_spans(t) for t in ODD]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.op1_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_contexts_reveal_identifiers(spark):
    rows = [(i, f"word{i} please mail to bob{i}@example.com now") for i in range(12)]
    rows += [(100 + i, f"other{i} please mail to user-{i}-{i + 900}-at-home now") for i in range(3)]
    rows += [(200 + i, f"thing{i} order number is part-{i}-{i + 900}-blue") for i in range(3)]
    rows += [(300, None), (301, ""), (302, "please mail to nobody")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit(1), "row": F.lit("x"), "kind": F.lit(2)})
    got = {r.doc_id: r.added for r in pii.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[100 + i][0].kind == "ctx_email" for i in range(3))
    assert not any(got[k] for k in got if not 100 <= k < 103)
    assert pii.extract(df.limit(0)).count() == 0


def test_license_base_against_plain_search(spark, sf_dir):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in license_scan.op2_license_scan(spark, sf_dir).collect():
        w = word.findall(docs[r.doc_id].translate(lower))
        at = sorted((i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) == {x for _, x in at} <= set(r.labels.split(","))


def test_license_edits_and_spans(spark):
    text = "Züge!\nLicensd under the GNU Genral Public License, version 3. End. THIS IS FREE and unencumbered softwre released into the publik domain"
    rows = [(1, text), (2, None), (3, ""), (4, "under the MIT license under the mit-license"), (5, "nothing of that kind here at all"), (5, "nothing of that kind here at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(0), "id": F.lit(1)})
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    a, b = got[1].spans
    assert (a.label, b.label) == ("gpl-3", "unlicense") and a.edits == 2 and text[a.start : a.end].startswith("Licensd under") and text[a.start : a.end].endswith("version 3")
    assert a.first_word == 1 and text[b.start : b.end].endswith("publik domain")
    assert got[2].n_words == 0 and not got[5].spans and [p.first_word for p in got[4].places] == [0, 4]


def edited(rng, phrase, k):
    s = list(phrase)
    for _ in range(k):
        i = rng.randrange(len(s))
        s[i : i + 1] = rng.choice([[], ["q"], [s[i], "q"]])
    return "".join(s)


def test_every_bounded_edit_is_found():
    import random

    rng = random.Random(8)
    scanner = license_scan.Scanner()
    for label, phrase, k in scanner.notices:
        for _ in range(20):
            s = edited(rng, phrase, k)
            found = scanner.matches(" lorem " + s + " ipsum ")
            # the right label, unless the edits made another notice at least as similar
            assert any(m[3] == label or m[4] >= 1 - k / len(phrase) for m in found), (label, s)
            assert not any(m[3] == label and m[2] > k for m in found)


def test_fuzzy_spans_equal_a_search_of_the_whole_text():
    import random

    rng = random.Random(9)
    scanner = license_scan.Scanner()
    vocab = [w for _, p, _ in scanner.notices for w in p.split()] + ["lorem", "ipsum", "dolor"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            _, phrase, k = rng.choice(scanner.notices)
            parts.append(rng.choice([edited(rng, phrase, rng.randrange(k + 3)), " ".join(rng.choices(vocab, k=rng.randrange(1, 30)))]))
        text = " " + " ".join(parts) + " "
        naive = []
        for n, (label, phrase, _) in enumerate(scanner.notices):
            naive += [(m.start(), m.end(), sum(m.fuzzy_counts), label, 1 - sum(m.fuzzy_counts) / len(phrase)) for m in scanner.fuzzy[n].finditer(text)]
        kept = []
        for x in sorted(naive, key=lambda x: (-x[4], x[0] - x[1], x[0], x[3])):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
                kept.append(x)
        assert sorted(scanner.matches(text)) == sorted(kept)


def test_license_of_long_repeated_and_no_texts(spark):
    long = "lorem " * 100_000 + "released under teh MIT license " + "ipsum " * 100_000
    df = spark.createDataFrame([(1, long), (2, "cc by nc"), (2, "cc by nc")], "doc_id long, text string")
    got = {r.doc_id: ([x.label for x in r.spans], r.n_words, len(r.places)) for r in license_scan.scan(df).collect()}
    assert got == {1: (["mit"], 200_005, 0), 2: ([], 3, 1)} and license_scan.scan(df).count() == 3
    assert license_scan.scan(df.limit(0)).count() == 0


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id.op7_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 20 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    rows = [(i, ("the of and " if i % 2 else "der die das ") * 20, "en" if i % 2 else "de") for i in range(80)]
    rows += [(900, None, "en"), (901, "123 ... ²", "en"), (902, "the of", None), (903, "", None), (None, "der das", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(0), "id": F.lit(3), "draw": F.lit(1.0)})
    model = language_id.train(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, model).collect()}
    assert got[900] == got[901] == got[903] == ("und", 0.0) and got[902][0] == "en" and got[None][0] == "de"
    assert language_id.train(df) == model
    nothing = language_id.predict(df, language_id.train(df.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def plain_logits(model, text):
    """The mean of the table's rows of all n-grams of all words, one by one."""
    total, n = [0.0] * len(model.classes), 0
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        marked = f"<{w}>"
        for size in language_id.GRAMS:
            for i in range(len(marked) - size + 1):
                h = size
                for c in marked[i : i + size]:
                    h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                row = model.table[h % language_id.BUCKETS]
                total = [a + float(b) for a, b in zip(total, row)]
                n += 1
    return [a / n + b for a, b in zip(total, model.bias)]


def test_language_scores_equal_a_plain_scorer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.Model.load(language_id.train(docs))
    texts = [r.text for r in docs.where("length(text) < 4000").collect() if r.text and language_id.words(r.text)][:60]
    for text, got in zip(texts, model.predict(texts)):
        x = plain_logits(model, text)
        e = [math.exp((v - max(x)) / model.temperature) for v in x]
        best = max(range(len(x)), key=lambda k: x[k])
        assert got[0] == model.classes[best] and abs(got[1] - e[best] / sum(e)) < 1e-6


def test_many_languages_are_learned(spark):
    rows = [(k * 8 + j, " ".join(chr(0x4E00 + 30 * k + (i * 7 + j) % 20) * 3 for i in range(30)), f"l{k:03d}") for k in range(300) for j in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, language_id.train(df)).collect()}
    assert len(set(got.values())) == 300 and sum(got[i] == lang for i, _, lang in rows) > 0.99 * len(rows)


def test_language_of_repeated_long_and_no_rows(spark):
    rows = [(i, ("the of and " if i % 2 else "der die das ") * 20, "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    odd = spark.createDataFrame([(1, "the of", None), (1, "the of", None), (2, "die das " * 150_000, None), (3, "x" * 300_000, None)], df.schema)
    got = sorted((r.doc_id, r.lang_pred) for r in language_id.predict(odd, model).collect())
    assert got[:3] == [(1, "en"), (1, "en"), (2, "de")] and got[3][1] in ("de", "en")
    assert language_id.predict(df.limit(0), model).count() == 0


def plain_measures(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.sub(r"[\x20\x09-\x0D]+", "", x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_on_odd_texts(spark):
    texts = [None, "", " \n\t", "a", "a b c a b c", "x x x x x x", "a b c d a b c e a b", "é ü #*$%&|<> \x1f", "l\nl\n l\n\nl\n", " a  b\x0bc\x0cd\re ", "w " * 5000, "one two three " * 30 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumns({"n_words": F.lit("clash"), "_m": F.lit(1)})
    for r in quality.score(df).collect():
        want = plain_measures(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality.keep(df).columns == df.columns and quality.score(df.limit(0)).count() == 0


def test_quality_of_repeated_and_long_rows(spark):
    long = " ".join(f"the w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, long)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.kept) for r in quality.score(df).collect()), key=repr)
    assert got == [(1, 2, False), (1, 2, False), (2, 120_000, True), (None, 0, False)] and quality.keep(df).count() == 1


def test_quality_keeps_good_and_rejects_junk(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs).join(labels, "doc_id").collect()
    good, junk = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert all(r.kept for r in good if not r.base_failed) and not any(r.kept for r in junk)
    plan = quality.op8_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def plain_bm25(index, terms):
    score = {}
    for t in terms:
        for i, x in index.postings[t]:
            score[i] = score.get(i, 0) + x
    return score


def test_wand_finds_all_above_threshold():
    import random

    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab[: rng.randrange(5, 60)]) for _ in range(rng.randrange(3, 30)))) for i in range(700)]
    df = {}
    for _, t in items:
        for w in set(t.encode().split()):
            df[w] = df.get(w, 0) + 1
    index = decontam.Index(items, df, len(items), 15.0)
    assert index.block > 1
    for _ in range(150):
        terms = rng.sample(range(len(index.postings)), rng.randrange(1, 30))
        for threshold in (0.2, 0.5, 0.9):
            want = {i for i, s in plain_bm25(index, terms).items() if s >= threshold - 1e-9}
            assert {i for i, _ in index.retrieve(terms, threshold)} == want


def test_search_equals_scoring_every_window():
    import random

    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(8, 40)))) for i in range(60)]
    df = {}
    for _, t in items:
        for w in set(t.encode().split()):
            df[w] = df.get(w, 0) + 1
    index = decontam.Index(items, df, len(items), 20.0)
    texts = []
    for _ in range(40):
        w = rng.choices(vocab + [f"z{i}" for i in range(900)], k=rng.randrange(0, 400))
        if rng.random() < 0.5:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(items)[1].split()
        texts.append(" ".join(w).encode())
    span = (-(-index.longest // decontam.STRIDE) + 1) * decontam.STRIDE
    for text, hits in zip(texts, index.search(decontam.Batch(texts), 0.5)):
        w = text.split()
        want = set()
        for lo in range(0, len(w), decontam.STRIDE):
            terms = {index.vocab[x] for x in w[lo : lo + span] if x in index.vocab}
            want |= {(i, lo) for i, s in plain_bm25(index, terms).items() if s >= 0.5}
        assert {(i, lo) for i, _, lo, _ in hits} == want


def test_leaks_are_found_and_clean_texts_stay(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    norm = lambda t: b" " + b" ".join(decontam.words_of((t or "").encode())) + b" "
    wanted = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if norm(i.text) != b"  " and norm(i.text) in norm(d.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.op6_decontamination(spark, sf_dir).collect()}
    assert wanted and wanted <= got
    left = decontam.without_leaks(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in got})


def test_decontamination_edge_cases(spark):
    items = spark.createDataFrame([(1, "What is the largest moon of Saturn called? It is Titan by far."), (2, None), (3, ""), (4, "What is the largest moon of Saturn called? It is Titan by far.")], "item_id long, text string")
    rows = [(1, "Intro words. what is THE largest moon of saturn called it is titan by far, outro"), (2, "What is the largest moon of Saturn called?"), (3, None), (4, ""), (5, "titan moon saturn largest far called")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item": F.lit(1), "id": F.lit(2)})
    got = {(r.doc_id, r.item_id) for r in decontam.find(docs, items).collect()}
    assert got == {(1, 1), (1, 4)}
    assert decontam.find(docs, items.limit(0)).count() == 0 and decontam.without_leaks(docs, items.limit(0)).count() == 5
    assert decontam.find(docs.limit(0), items).count() == 0


def test_decontamination_ids_of_any_type(spark):
    texts = ["What is the largest moon of Saturn called? It is Titan by far.", "Name the author of the long play. ANSWER: a writer nobody knows today"]
    docs = spark.createDataFrame([("a", texts[0]), ("b", texts[1]), ("b", texts[1]), ("", "clean words")], "doc_id string, text string")
    for kind in ("smallint", "decimal(9,2)", "string", "date", "timestamp", "double"):
        rows = spark.range(3).select((F.col("id") * 1000).alias("n"), F.element_at(F.array(*map(F.lit, texts), F.lit("")), (F.col("id") + 1).cast("int")).alias("text"))
        key = {"string": F.when(F.col("n") > 0, F.lit("x")).otherwise(""), "date": F.date_from_unix_date(F.col("n").cast("int")), "timestamp": F.timestamp_seconds("n")}.get(kind, F.col("n").cast(kind))
        got = decontam.find(docs, rows.select(key.alias("item_id"), "text"))
        assert got.schema["item_id"].dataType.simpleString() == kind
        assert sorted(r.doc_id for r in got.collect()) == ["a", "b", "b"] and len({r.item_id for r in got.collect()}) == 2
    assert decontam.split_item(texts[1]) == 8 and decontam.split_item("İİİİ? yes") == 1 and decontam.split_item("a b c") == 2


def test_many_shards_are_one_scan(spark):
    import random

    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(9, 25)))) for i in range(400)]
    docs = [(d, " ".join([*rng.choices(vocab, k=300), items[d][1], *rng.choices(vocab, k=200)])) for d in range(80)] + [(99, " ".join(rng.choices(vocab, k=50_000)))]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find(docs, items, shard_items=50)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = sorted((r.doc_id, r.item_id, round(r.score, 9), r.first_word) for r in found.collect())
    assert {(d, d) for d in range(80)} <= {r[:2] for r in got}
    assert got == sorted((r.doc_id, r.item_id, round(r.score, 9), r.first_word) for r in decontam.find(docs, items).collect())
    assert {r.doc_id for r in decontam.without_leaks(docs, items, shard_items=50).collect()} == {99} - {r[0] for r in got}


@pytest.mark.parametrize("ids", [[12], [1], [9], [None], [12, 1, 9, None]])
def test_a_language_of_few_ids_is_learned(spark, ids):
    """Rows of one id, or of none, are drawn one by one; exactly repeated rows are one row of their language."""
    rows = [(i, f"the of and in to {i % 50} word{'abcdefghij'[i % 10]}", "en") for i in range(400)]
    rows += [(ids[k % len(ids)], " ".join("zyx zzyzx yxz zxy".split()[(k + j) % 4] + "q" * (j % (k % 7 + 2)) for j in range(12)), "zz") for k in range(60)]
    rows += [(ids[0], "ßöß öäß äöü üßä", "repeated")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, per_language=10)
    assert set(language_id.Model.load(model).classes) >= {"en", "zz"}
    asked = spark.createDataFrame([(2, "zyx zzyzx yxz zxy zyxq", None), (3, "the of and in to", None)], df.schema)
    assert {r.doc_id: r.lang_pred for r in language_id.predict(asked, model).collect()} == {2: "zz", 3: "en"}


def test_slices_of_bounded_bytes():
    """Every row is in one slice, in order; slices are larger where shards are loaded anew for each."""
    column = pa.array(["ab cd " * 200_000, None, "", "ef"] * 40, pa.string())
    for n_shards, most in ((1, decontam.SLICE_BYTES), (decontam.LOADED_SHARDS + 1, decontam.RELOAD_BYTES)):
        at, sizes = 0, []
        for first, texts in decontam._slices(column, n_shards):
            assert first == at
            at += len(texts.rows)
            sizes.append(sum(map(len, column.slice(first, len(texts.rows)).cast(pa.binary()).fill_null(b"").to_pylist())))
        assert at == len(column) and all(most <= s < most + 1_200_000 for s in sizes[:-1]) and len(sizes) > 1


def test_places_in_texts_full_of_notices():
    words = ("x under the mit license y cc by nc " * 3000).split()
    joined = (" " + " ".join(words) + " ").encode()
    at = [(i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    assert license_scan.base_places(joined, license_scan.BASE_PHRASES) == sorted(at)
    text = " ".join(["Released under teh MIT License. Zü!"] * 500)
    normal = b" " + b" ".join(license_scan.words_of(text.encode())) + b" "
    hits = license_scan.Scanner().matches(normal.decode())
    found = license_scan._located(hits, normal.decode(), text.encode())
    assert [(x["first_word"], x["n_words"]) for x in found] == [(6 * i, 5) for i in range(500)]
    assert all(text[x["start"] : x["end"]] == "Released under teh MIT License" for x in found)
