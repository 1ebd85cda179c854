import pytest

#: Nulls, empty, blank, long and repeated texts, ties, a repeated id, extra and clashing columns.
ROWS = [
    (1, "One two three four five six seven.\nA second line here for good measure.", "en", "s1"),
    (2, "One two three four five six seven.\nA second line here for good measure.", "en", "s1"),
    (3, "", "en", "s1"),
    (4, None, None, None),
    (5, " \n\t ", "de", "s2"),
    (6, "Die Katze saß auf der Matte und schlief ein wenig.", "de", "s2"),
    (6, "Die Katze saß auf der Matte und schlief ein wenig.", "de", "s2"),
    (None, "A row without an id but with a text of its own.", "en", None),
    (7, "word " * 30_000, "en", "s3"),
    (8, "x" * 100_000, None, "s3"),
    (9, "😀   naïve é <|endoftext|> ▁ | & tabs\tand\r\nreturns", "fr", "s3"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, len(r[1] or ""), 1.5, [1], "clash", 0) for r in ROWS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score double, shard array<int>, _t string, size int"
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
