from umbra.llm import line_dedup as L
from umbra.llm.queries import op4_line_dedup

import corpus_pipeline as P

LONG = "A line of more than twenty characters."
ROWS = [(1, f"Yes.\n{LONG}\n\nNo."), (2, f"Yes.\n{LONG}"), (3, "Yes!\n \nNo."), (4, None)]


def test_every_line_has_a_row(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.kept) for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {
        (1, 0): (1, 0, 0, True),
        (1, 1): (1, 1, 0, True),
        (1, 3): (1, 3, 0, True),
        (2, 0): (1, 0, 0, False),
        (2, 1): (1, 1, 0, False),
        (3, 0): (3, 0, 0, True),  # one edit from "Yes.": too short to be linked
        (3, 2): (1, 3, 0, False),
    }


def test_stage_drops_short_repeats(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in P.lines(spark, docs, "").collect()} == {1: ROWS[0][1], 3: "Yes!\n ", 4: None}
