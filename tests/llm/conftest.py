import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: a column of every name that an operator adds or uses inside
CLASH = ["chunk", "rows", "bytes", "blob", "bucket", "payload", "rid", "key", "label", "component", "digest", "bands", "keep",
         "n_lines", "n_dropped", "n_words", "stratum", "kept", "score", "lang_pred", "ambiguous", "mix_slot", "mix_order",
         "n_tokens", "pll", "samples", "exact", "group_id", "good", "cuts"]


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, clash=False, parts=3):
        """rows: (doc_id, text[, lang[, source]])"""
        full = [(*r, *("en", "src")[len(r) - 2:], 0) if len(r) < 4 else (*r, 0) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            from pyspark.sql import functions as F
            df = df.withColumns({c: F.lit(f"own {c}") for c in CLASH})
        return df.repartition(parts) if full else df

    return build


LONG = "lorem ipsum dolor sit amet consectetur " * 4000


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    passage = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark forest at night"
    return [(1, None, None, None), (2, "", "en", None), (None, "a text without an id " * 8, "en", "s1"), (3, " \t\n\x0b ", None, "s1"),
            (4, LONG, "en", "s2"), (5, LONG, "en", "s2"), (6, passage, "en", "s1"), (7, passage, "en", "s1"), (7, passage, "en", "s1"),
            (8, "é ü ß 漢字 🙂 ▁ \x00 end", "de", "s3"), (9, "x", "fr", "s3"), (10, "\n\n\n", "fr", "s3"), (11, passage + " and home", "en", "s4"),
            (12, "12345 67890", "en", "s4")]
