"""Small tables that hold every awkward case, and plain versions of what operators compute."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, wl_row string, size long, kept boolean, id string"
SYLLABLES = "ka lo mi tera vun sel pra dok ne ruti gor bal hin wex or tam".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(SYLLABLES, k=draw.randint(1, 3))) for _ in range(n))


def awkward(spark):
    """Null, empty, blank, very long, tied, repeated and null-keyed rows, with columns that clash with internal names."""
    rows = [
        (1, prose(1, 60), "en", "a"), (2, prose(1, 60), "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, "  \n", "de", "b"),
        (6, prose(6, 20_000), "en", "a"), (7, prose(7, 40), "de", None), (7, prose(7, 40), "de", None), (7, prose(8, 40), "de", "c"),
        (None, prose(9, 30), "fr", "c"), (None, None, None, "c"), (8, "x" * 50_000, "en", "c"), (9, "1 2 " * 9000, "en", "a"), (10, "Ünï çödé 漢字 🙂", "xx", "ü"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None, 0.5, "clash", 3, False, "x") for i, t, lang, s in rows], SCHEMA)


def none_of(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"\w+", (text or "").lower())
