"""Documents with every defined edge case, as a table of files."""

import random
import tempfile

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row long, key string, name string, hash long, component long, size int, n int, "
    "copies int, level int, kind string, value string, start long, sample int, __key int"
)
WORDS = "the of and to in a is that for it was on are as with his they at be this".split()


def make_texts() -> list[str | None]:
    rng = random.Random(4)
    prose = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(60)) for _ in range(12)]
    near = prose[0].split()
    near[30] = "changed"
    return [
        *prose,
        " ".join(near),
        prose[0].replace(" ", "\n"),
        prose[1],
        prose[1] + " ",
        "",
        "  \t\n",
        None,
        "one",
        "two words",
        "Écoute: é a.b@c-d.example.com, 10.0.0.255 et +1 (389) 555-5010; 4111 1111 1111 1111 日本😀",
        "x" * 30_000,
        " ".join(prose) * 8,
        "▁mark  and  spaces\n\n <|endoftext|> it's",
    ]


def save(spark, rows, schema=SCHEMA):
    path = f"{tempfile.mkdtemp(prefix='run-', dir='/tmp')}/docs"
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def wide(doc_id, text, source):
    return (doc_id, text, None, source, None, 5, "k", "n", 1, 2, 3, 4, 5, 6, "x", "v", 7, 8, 9)


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, source); the last two rows repeat a row, one has no doc_id."""
    texts = make_texts()
    rows = [(i * 3, t, (None, "", "a", "b")[i % 4]) for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, texts[3], "a")]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return save(spark, [wide(*r) for r in edge_rows])


@pytest.fixture(scope="session")
def nothing(spark):
    return save(spark, [])
