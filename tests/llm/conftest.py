import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words_of(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(_UPPER) if lower else text)


#: Texts every operator must stand: null, empty, blank, short, repeated, very long, not ASCII.
ODD_TEXTS = [
    None,
    "",
    " \t\r\n\x0b\x0c ",
    "one",
    "one two",
    "One two THREE four five six seven eight nine ten eleven twelve",
    "One two THREE four five six seven eight nine ten eleven twelve",
    "äöü Größe 漢字 mots\u00a0ici \u2003 été 🙂 " * 6,
    "na " * 90,
    "w" * 70_000,
    "a b c " * 30_000,
    "\n".join(["same line here"] * 12),
    "### $$$ %%% *** &&& <<< >>> ||| ### $$$ %%%",
]


#: Columns that documents may have besides, called as operators and stages call theirs.
CLASHING = ("key", "comp", "node", "_id", "ROW_ID", "row", "times", "_copy", "copy", "pattern", "_pattern", "base_failed", "_base_failed", "p", "size", "mark", "bucket", "taken", "shard", "slot", "held_out", "sid", "n_words")
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)


@pytest.fixture
def odd_docs(spark):
    """Odd texts with null, repeated and large ids, null languages and sources, and columns with clashing names."""
    extra = tuple(f"own {c}" for c in CLASHING)
    rows = [(i if i % 4 else None, t, None if i % 3 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", *extra) for i, t in enumerate(ODD_TEXTS)]
    rows += [(2**40, ODD_TEXTS[5], "en", "s1", *extra), (2**40, ODD_TEXTS[5], "en", "s1", *extra), (2**40, "other words", "en", "s1", *extra)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(r, n, vocabulary=400):
    """``n`` words of skewed frequencies."""
    return " ".join(f"w{min(int(r.paretovariate(0.6)), vocabulary)}" for _ in range(n))
