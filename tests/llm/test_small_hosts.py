"""The ratio decides at every host size, in the query and in the pipeline's stage."""

import collections

import corpus_pipeline
from mosaicq.llm import line_dedup


def test_small_hosts_are_cleaned(spark, tmp_path):
    rows = [(i, "small", f"menu\nown {i}") for i in range(10)] + [(100 + i, "middle", f"own {i}" + "\nfooter" * (i < 2)) for i in range(50)]
    rows += [(200 + i, "big", f"own {i}" + "\nrare" * (i < 2)) for i in range(100)] + [(300, "one", "alone"), (301, None, "x\na"), (302, None, "x\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pages, on = collections.Counter(h for _, h, _ in rows), collections.Counter((h, x) for _, h, t in rows for x in set(t.split("\n")))
    want = {i: "\n".join(x for x in t.split("\n") if on[h, x] < 2 or on[h, x] * 100 <= pages[h] * 2) for i, h, t in rows}
    assert want[3] == "own 3" and want[100] == "own 0" and want[200] == "own 0\nrare" and want[300] == "alone" and want[301] == "a"
    assert {r.doc_id: r.text for r in line_dedup.op10_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, str(tmp_path)).collect()} == want
