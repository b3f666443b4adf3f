"""Packing, archives, line dedup, the pipeline, and the SQL of all of them."""

import array
import collections
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mosaicq.llm import decontam, line_dedup, ngram_join, packing, quality, registry, warc


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, sf_dir), con.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def check_packed(rows, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for key, text in texts.items():
        ids, at = tok.encode(text or "", add_special_tokens=False).ids + [0], 0
        for k, r in enumerate(sorted(pieces[key], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(array.array("I", ids[at : at + r.length]).tobytes())
            assert r.length == packing.CAPACITY or k == 0
            at += r.length
        assert at == len(ids)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(bins), sum(r.length for r in rows)


def test_packing_round_trip(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n, total = check_packed(packing.op5_best_fit_packing(spark, sf_dir).collect(), texts)
    assert n <= 1.03 * total / packing.CAPACITY + 2


def test_packing_edge_cases(spark):
    texts = {1: None, 2: "", 3: "word " * 2047, 4: "word " * 2046, 5: "word " * 9000, 6: "ü𝛼 <|endoftext|> " * 3, 7: "<|endoftext|>", 8: "<|endoftext|>  at  the start", 9: "at the  end <|endoftext|>", 10: "<|endoftext|><|endoftext|>\n\n <|endoftext |>", 11: "x" * 40_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"row": F.lit("x"), "length": F.lit(1), "sequence_id": F.lit(2)})
    check_packed(packing.pack(df).collect(), texts)
    twice = packing.pack(df.unionByName(df)).collect()
    assert len({(r.row, r.piece) for r in twice}) == len(twice) == 2 * packing.pack(df).count()
    assert packing.pack(df.limit(0)).count() == 0


def test_bounded_best_fit_picks_the_fullest_that_fits():
    b = packing.BestFit(10, 2, 5)
    assert [b.place(x) for x in (6, 7, 3, 4, 10)] == [(5, 0), (6, 0), (6, 7), (5, 6), (7, 0)]
    b = packing.BestFit(10, 2)
    assert [b.place(x)[0] for x in (9, 8, 7)] == [0, 1, 2]  # one too many: the fullest closes
    assert b.place(1) == (1, 8) and b.place(3) == (2, 7)


def test_cut():
    assert packing.cut(5, 2) == [(0, 1), (1, 2), (3, 2)] and packing.cut(4, 2) == [(0, 2), (2, 2)] and packing.cut(1, 2) == [(0, 1)]


def test_archive_round_trip(spark, tmp_path):
    rows = [(5, "http://a", "same"), (3, "http://b\nx", "same"), (9, None, None), (8, "u", ""), (7, "ü", "Grüße" * 9000), (7, "ü", "Grüße" * 9000), (None, "n", "same"), (4, "c", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "first": F.lit(2)})
    index = warc.write_archive(pages, f"file://{tmp_path}/w", frame_bytes=1000, bundle_bytes=60_000)
    got = warc.read_archive(index).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.record].append((r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload).decode()))
    assert by["3"] == [("response", None, 4, "same")] and by["5"] == by[None] == [("revisit", "3", 4, "")]
    assert by["8"] == [("response", None, 0, "")] and by["9"] == [("revisit", "8", 0, "")]
    assert by["7"] == [("response", None, 63000, "Grüße" * 9000)] * 2 and len(got) == len(rows)
    assert warc.read_archive(warc.write_archive(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_archive_of_text_ids(spark, tmp_path):
    rows = [("a\r\nWARC-Type: x", "u", "same"), ("50%25>", "u", "same"), ("ü b", "http://h/%20?q=<1>", "same"), ("ü b", "http://h/%20?q=<1>", "same")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = warc.read_archive(warc.write_archive(pages, f"file://{tmp_path}/w")).collect()
    assert sorted((r.record, r.url, r.record_type, r.refers_to) for r in got) == sorted((i, u, "response" if i == "50%25>" else "revisit", None if i == "50%25>" else "50%25>") for i, u, _ in rows)


def test_bundles_are_plain_zstandard(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archive(pages, f"file://{tmp_path}/w", frame_bytes=4000)
    at = index.orderBy("bundle", "frame", "offset").collect()
    assert max(r.frame for r in at) > 3
    raw = open(at[0].bundle.removeprefix("file://"), "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain.count(b"WARC/1.1") == sum(r.bundle == at[0].bundle for r in at)


def test_line_dedup_rules(spark):
    rows = [(i, "big", f"menu\nown {i}\n\n own line \nmenu") for i in range(100)] + [(1000 + i, "small", f"menu\nown {i}") for i in range(10)]
    rows += [(2000 + i, None, "menu") for i in range(30)] + [(3000, "big", None), (3001, "big", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"r": F.lit(1), "drop": F.lit("x"), "line": F.lit(2)})
    for bound in (1 << 20, 0):  # broadcast, then joined by a shuffle
        out = line_dedup.cleaned(docs, broadcast_bytes=bound)
        assert out.columns == docs.columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert len(got) == len(rows)
        assert got[5] == "own 5\n" and got[1003] == "own 3" and got[2000] == "" and got[3000] is None and got[3001] == ""
    assert line_dedup.cleaned(docs.limit(0)).count() == 0


def test_line_dedup_sql_with_nulls_and_repeats(spark, tmp_path):
    rows = [(i, "a" if i % 2 else None, t) for i, t in enumerate(["m\nx", "m\n\ny", "m", "", None, "m\nm\nz ", "z ", "q"])] * 2 + [(None, "three", "m\n1"), (90, "three", "m\n2"), (91, "three", "n\n3")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.op10_line_dedup(spark, str(tmp_path)).collect()]
    want = con.sql(f"SELECT doc_id, n_lines, n_dropped, text FROM ({registry.ORACLE['op10_line_dedup']})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {(90, 2, 1, "2"), (91, 2, 0, "n\n3"), (4, 0, 0, None), (3, 0, 0, "")} <= set(got)


def test_line_dedup_of_very_long_texts(spark):
    long = "\n".join(f"line {i % 5000}" for i in range(60_000))
    docs = spark.createDataFrame([(1, "h", long), (2, "h", long + "\nown")], "doc_id long, source string, text string")
    got = {r.r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup(docs).collect()}
    assert got == {1: (60_000, 60_000, ""), 2: (60_001, 60_000, "own")}


def test_pipeline_against_plain_stages(spark, sf_dir):
    """Each stage against a plain version of it, on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    at = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at
        at = stage(spark, at, sf_dir).cache()
        assert at.columns == docs.columns, name
        kept[name] = (before, at)
    before, after = kept["quality_rules"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in quality.score(before).where("kept").collect()}
    before, after = kept["line_dedup"]
    assert after.count() == before.count() and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = kept["ngram_jaccard_join"]
    near = ngram_join.near_duplicates(before).collect()
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in near}
    before, after = kept["benchmark_decontamination"]
    leaked = {r.doc_id for r in decontam.find(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaked
    final = corpus_pipeline.run(spark, sf_dir)
    check_packed(final.collect(), {r.doc_id: r.text for r in at.collect()})


def test_pipeline_keeps_one_of_repeated_rows(spark):
    rows = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, "one two three four five six seven"), (2, "other words are standing in this one"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.ngram_jaccard_join(spark, docs, "")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, spark.createDataFrame([rows[0], rows[3], rows[4]], docs.schema).collect()))


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns, an empty table."""
    good = " ".join(f"the word{i} of place{i} and time{i} is here{i}" for i in range(60))
    other = " ".join(f"eine zahl{i} und der mann{i} in haus{i}" for i in range(6000))
    rows = [(1, good, "en", "a", 5), (1, good, "en", "a", 5), (None, None, None, None, None), (2, "", None, "a", 0), (None, good, None, None, None), (3, other, "de", None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"node": F.lit("x"), "key": F.lit(1), "row": F.lit(2), "r": F.lit(None).cast("int"), "drop": F.lit("y"), "_m": F.lit(0)})
    at = df
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), sf_dir).count() == 0, name
        alone = stage(spark, df, sf_dir)
        assert alone.count() >= 1
        at = stage(spark, at, sf_dir)
        if name != "best_fit_packing":
            assert alone.columns == at.columns == df.columns
        if name == "ngram_jaccard_join":
            assert sorted((r.doc_id for r in at.collect()), key=str) == [1, 3, None]  # the line of 1 is boilerplate of its source
    assert {r.doc_id for r in at.collect()} == {1, 3, None}
