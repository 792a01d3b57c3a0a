import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, text_key string, _d int, _k int, _id int, _key string, "
          "_times int, _norm string, band int, class string, first string, row int, place int, size int, `group` int")
WORDS = ["%s%s" % (a, b) for a in ("ba", "ko", "mi", "ru", "te", "zu", "öl") for b in ("na", "ra", "lo", "xi", "pe")]


def prose(seed: int, words: int, per_line: int = 12) -> str:
    r = random.Random(seed)
    found = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(words)]
    return "\n".join(" ".join(found[i : i + per_line]).capitalize() + "." for i in range(0, words, per_line))


def odd_rows() -> list[tuple]:
    """(doc_id, text, source): copies, near copies, nulls, blanks, long texts, repeated rows, ties."""
    a, b = prose(1, 120), prose(2, 200)
    swapped = b.replace(b.split()[50], "changed", 1)
    return [(1, a, "s1"), (2, a, "s1"), (3, a.replace(" ", "  "), "s2"), (4, b, "s1"), (5, swapped, None), (6, None, "s1"),
            (7, "", "s2"), (8, " \t\r\n\x0b\x0c", "s3"), (None, a, None), (None, None, None), (9, "one two", "s1"), (10, "ONE  two", "s1"),
            (11, prose(3, 30_000), "s1"), (12, prose(3, 30_000) + " tail", "s1"), (1, a, "s1"), (1, b, "s9"), (13, "x" * 200_000, "s2"),
            (14, "naïve   café 🙂 " * 40, "s2"), (15, "\\ [INST] </s>", ""), (16, "a\nb\n\nc", "s2"), (17, "!!! ### $$$ | | |" * 30, "s2")]


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    full = [(i, t, "en", s, None if t is None else len(t), "z", 1, 2, 3, "k", 4, "n", 5, "c", "f", 6, 7, 8, 9) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
