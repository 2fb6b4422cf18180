import random

import pytest

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp string, sh string, rd string, component string"


def frame(spark, rows):
    """rows: (doc_id, text[, lang]) in a table with columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, None, None, None, "x", "x", "x", "x") for r in rows], CLASHING)


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and very long texts, ties, repeated rows, near copies, non-Latin text."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, line = text(70), text(8)
    out = [(i, "\n".join([text(r.randrange(1, 60)), r.choice([passage, line, text(30)]), text(25)])) for i in range(60)]
    copied = out[7][1]
    near = copied.split(" ")
    near[3] = "other"
    out += [(100, copied), (101, copied.replace(" ", "  ")), (102, copied.upper()), (103, " ".join(near)), (104, copied), (104, copied)]
    out += [(200, None), (201, ""), (202, " \n\t"), (None, "lone text"), (None, None), (203, "日本語 テキスト 😀"), (204, "1234 !!"), (205, text(9000)), (206, "a" * 70_000), (207, (line + "\n") * 40), (208, "\r\n".join([line.upper(), " " + line + "\t", line]))]
    return out
