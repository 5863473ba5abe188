"""Awkward documents that every operator must take."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, TH string, kept boolean, text_hash int"
#: Names that operators have used for columns of their own.
CLASHES = "id_ int, th_ int, s_id int, s_th int, bad_id int, _bad_id int, _bad_th int, place int, spans_ int, d int, k int, y int, shard int, v int, b int, norm int, label int, links int, class_id int, best int, f1 int, size int, given int, raw int"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(120_000))


def awkward(spark, rows=True):
    """NULLs in every column, empty, blank and very long texts, repeated rows, one id with two texts, and
    columns whose names the operators use themselves."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from all the hunters of the wood " * 4
    data = [
        (1, prose, "en", "a", len(prose), "x", True, 1), (1, prose, "en", "a", len(prose), "x", True, 1), (2, prose, "en", "b", len(prose), None, None, None), (3, None, "en", "a", None, None, None, None),
        (4, "", "de", "a", 0, None, None, None), (5, "   \n\t ", None, None, 5, None, None, None), (None, prose + " end", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None),
        (6, LONG, "en", "a", len(LONG), None, None, None), (1, "another text under the same number", "en", "a", 34, None, None, None), (7, "!!! ... 123", "en", "a", 11, None, None, None), (8, "größe 漢字 naïve", "de", "a", 14, None, None, None),
    ]
    names = [c.split()[0] for c in CLASHES.split(", ")]
    return spark.createDataFrame([(*r, *[n if n % 2 and r[0] else None for n in range(len(names))]) for r in data] if rows else [], f"{DOCS}, {CLASHES}")
