"""Small tables with the hard cases: nulls everywhere, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + r.choice(["an", "or", "ight", "é", "ound", "ing"]) + r.choice(["", "s", ",", "."]) for _ in range(n))


def documents() -> list[tuple]:
    passage = prose(99, 60)
    rows = [
        (1, None, "en", "a", 0), (2, "", None, "a", None), (3, " \n\t ", "en", None, 3), (None, prose(3, 80), None, None, None),
        (5, "one", "en", "a", 3), (6, "ONE", "en", "a", 3), (7, prose(7, 200) + " " + passage, "en", "a", 0),
        (8, passage + "\n" + prose(8, 90), "en", "b", 0), (8, passage + "\n" + prose(8, 90), "en", "b", 0),
        (9, "so " * 120, "en", "a", 0), (10, "Licensed under the MIT License, or the GNU General Public License. " + prose(10, 70), "en", "a", 0),
        (11, prose(11, 9000), "de", "a", 0), (12, prose(11, 9000).replace("aan ", "aor ", 1), "de", "a", 0), (-3, prose(12, 34), "de", "b", 0),
        (14, "x\x1cy z 　 <|endoftext|> it's ÀÉ <\\|im_end|>", "fr", "c", 0),
    ]
    return rows + [(20 + k, prose(20 + k, 60 + k), "en", "a", 0) for k in range(50)]


def frame(spark, rows=None):
    """The documents with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    return df.selectExpr("*", "'mine' as row", "1.5 as length", "'k' as kept", "7 as n_words", "'c' as cell", "0 as _fp", "'t' as tkey", "'r' as ranges", "2 as bucket")
