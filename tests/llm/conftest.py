import random

import pytest

WORDS = "the of and to in une le der und ist que los anon tion ering onth blea staré ñu züge".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(n))


def edge_texts() -> list[str | None]:
    r = random.Random(5)
    base = prose(r, 120)
    near = base.split(" ")
    near[60] = "changed"
    hot = "A line   that MANY documents share"
    out: list[str | None] = [None, "", "   \n\t ", "\n\n", "Hi", "hi", "HI", "one two three", "One Two THREE", "one two three four", "12 34 $$$ ***", "漢字 🎉 'll don't", base, base, base.upper(), " ".join(near), base + "\n" + hot, base[:300]]
    out += [f"{hot}\n{prose(r, 30)}\n  {hot.lower()}\t\nx" for _ in range(12)]
    passage = prose(r, 60)
    out += [f"{prose(r, 40)} {passage} {prose(r, 20)}" for _ in range(4)]
    out += [prose(r, 9000), "a" * 30_000, ("same words again " * 3000).strip(), "Das ist " + prose(r, 400) + "\n" + hot]
    return out


@pytest.fixture(scope="session")
def edge_rows():
    """doc_id, text, lang, source: nulls in any column, repeated rows, repeated ids with other texts."""
    r = random.Random(6)
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "é", "B"][i % 5]) for i, t in enumerate(edge_texts())]
    rows += [rows[12], rows[12], rows[18], (None, rows[12][1], None, None), (None, "only here, without an id", "en", "a"), (None, None, None, None), (3, "an id that is there twice", "en", "a")]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with further columns whose names operators use themselves."""
    names = ["row", "n", "grp", "digit", "node", "h", "band", "place", "size", "rank", "text_key", "k_doc", "lines", "rest"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*x, *("x" for _ in names)) for x in edge_rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
