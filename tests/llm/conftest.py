from datetime import datetime  # noqa: F401

import pytest

LONG = "word " * 30000


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeats, clashing extra columns."""
    base = "The quick brown fox jumps over the lazy dog while many other animals look on quietly from afar and wait"
    rows = [(i, f"{base} number {i} of all. {base.upper() if i % 7 == 0 else base}\n{i * 31 % 17} lines, more words {i}", "en" if i % 2 else "fr", f"s{i % 3}") for i in range(60)]
    rows += [
        (100, None, "en", "s0"), (101, "", None, "s1"), (102, " \t\n", "en", None), (103, LONG, "en", "s0"), (104, rows[0][1], "en", "s2"), (104, rows[0][1], "en", "s2"),
        (105, rows[0][1] + " tail", "fr", "s1"), (None, "no key here", "fr", "s1"), (106, "été ß İ <|endoftext|> don't x\xa0y\x1cz\x85 　", "fr", "s1"), (107, "three words only", "en", None), (108, "a" * 5000, "en", "s1"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    clash = {c: df.doc_id for c in ("size", "key", "fp", "chunk", "label", "copies", "kept", "k", "v", "n")}
    return df.withColumns(clash).repartition(3)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.select("doc_id", "text", "lang", "source").collect()]
