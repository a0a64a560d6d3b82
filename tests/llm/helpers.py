"""Documents with every awkward case, and the columns of the documents table."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strong coffee near old stone bridges every single morning".split()


def prose(seed: int, n: int = 60) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ing", "ed", "er"]) for _ in range(n))


def awkward() -> list[tuple]:
    texts = [None, "", " \n\t ", "one", "two words", prose(1), prose(1), prose(2) + " é ü 漢字 😀 ﷺ\u00a0x", "A" * 5000, prose(3, 30000), "x\r\ny\u2028z \x0b\x0c end", "\\ '' \"\" <|end|> </s> [INST]"]
    return [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(texts)] + [(None, "null id text", None, None, 3), (3, "one", "en", "src", 3), (3, "one", "en", "src", 3)]


def docs(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOC_SCHEMA)


def clashing(df):
    """The same table with extra columns whose names clash with those of operators."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(n) for n in ("TEXT", "code", "id", "kept", "n_words", "shard", "group", "c0", "spans", "row", "url2", "digest")])
