import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: columns whose names the operators use themselves
CLASHES = "row string, shard int, text_key string, spans string, fp long, h long, doc long, n_words int, key string"


def fixture_texts() -> list:
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    shared, base = text(70), text(300)
    edited = base.split()
    edited[150] = "changed"
    out = [None, "", "   \n\t ", "one", "one", text(49), text(50), text(120), shared, text(40) + " " + shared + " " + text(30), text(10) + "\n" + shared, base, base, " ".join(edited), text(6000), "x" * 3000, "word " * 200, "word " * 130, "A b C d", "a B c D", "12345 !!", "▁ ▁▁ a", "<|endoftext|> <s> a", text(300) + " " + base]
    return out + ["".join(rng.choices("ab é\n▁\x00\x1c", k=50)) for _ in range(10)]


@pytest.fixture(scope="session")
def texts():
    return fixture_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Texts with ids, one row repeated, one without an id, and columns with clashing names."""
    rows = [(i, t, None if i % 5 == 0 else "xx" if i % 2 else "yy", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[9], (None, texts[7], "xx", None)]
    extra = (None,) * len(CLASHES.split(", "))
    return spark.createDataFrame([(*r, *extra) for r in rows], "doc_id long, text string, lang string, source string, " + CLASHES)


@pytest.fixture(scope="session")
def shared_ids(spark):
    """Different texts under one id and without an id, some of which share a passage, and repeated rows."""
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage, other = text(60), text(70)
    rows = [(1, text(20) + " " + passage + " " + text(30)), (5, text(40) + " " + passage), (5, text(80)), (None, text(5) + " " + passage), (None, text(91)), (None, text(40) + " " + other), (None, other + " " + text(9)), (8, other), (8, text(3) + " " + other), (9, passage)]
    rows += [rows[1], rows[4], (None, "  ".join(rows[4][1].split())), (7, "\n".join(rows[0][1].split())), (None, None), (5, "")]
    return spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, seg string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
