"""Small tables with the awkward rows that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potent jars of black quartz syrup near old stone bridges".split()


def long_text(n: int, seed: int = 1) -> str:
    x, out = seed, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 97))
    return " ".join(out)


def awkward(spark):
    """Nulls, empty and white texts, one very long text, copies, repeated rows,
    and extra columns whose names clash with those the operators make."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, "  \n\t ", "en", "a", 6),
        (4, "one two", "en", "a", 7),
        (5, "ONE two", "en", "a", 7),
        (6, long_text(3000), "en", "a", 1),
        (7, long_text(3000), "en", "a", 1),
        (8, "Ünïcode ß 漢字  double  spaces \x1c and <|endoftext|> here", "de", "b", 1),
        (9, long_text(60, 7), "en", "b", 1),
        (9, long_text(60, 7), "en", "b", 1),
        (10, "x " * 500, "en", "b", 1),
        (None, long_text(40, 9), "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "1 as start", "2 as score", "'x' as grp", "3 as n", "4L as sequence_id", "5 as shard", "6 as cid", "7 as t")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
