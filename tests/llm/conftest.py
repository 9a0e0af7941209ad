from __future__ import annotations

import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, id string, k1 long, h string, pos string, n string, tid string, root string, sequence_id string, spans string, kept string"
EXTRA = ("x", 1, "x", "x", "x", "x", "x", "x", "x", "x")


def frame(spark, pairs):
    """Documents with columns that clash with inner names."""
    return spark.createDataFrame([(i, t, None if i is None else "en", "s", None if t is None else len(t), *EXTRA) for i, t in pairs], KIND)


def corpus(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, junk, nulls, empty and long texts, repeated rows."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, base = text(60), text(120)
    out: list[tuple[int | None, str | None]] = []
    for i in range(60):
        body = text(rnd.randint(1, 150))
        if i % 5 == 0:
            at = rnd.randint(0, len(body.split()))
            w = body.split()
            body = " ".join([*w[:at], passage, *w[at:]])
        if i % 7 == 0:
            body += "\n" + body.split(" ")[0] + "\n\n" + body.split(" ")[0]
        out.append((i, body))
    for i in range(60, 90):
        w = base.split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        out.append((i, " ".join(w)))
    out += [(90, out[3][1]), (91, out[3][1]), (92, None), (93, ""), (94, "  \n\t "), (95, "la " * 3000), (None, text(80)), (None, None), (96, text(80)), (96, text(50))]
    out += [out[4], out[4], (97, "один два три 漢字 　 x\x1cy"), (98, "a")]
    return out


@pytest.fixture(scope="session")
def pairs():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, pairs):
    return frame(spark, pairs).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [(1, "x")]).limit(0)
