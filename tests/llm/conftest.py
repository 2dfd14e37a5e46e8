from __future__ import annotations

import random

import pytest

@pytest.fixture(scope="session")
def corpus(spark):
    """Prose with copies, near copies, nulls, empty and long texts, ties and extra columns."""
    rng = random.Random(11)
    words = [a + c + b for a in ("th", "ere", "on", "hea", "ou", "sti", "re", "nd") for b in ("ing", "ha", "ly", "tion", "er", "s", "é", "") for c in ("", "wh", "an", "to", "ble", "in", "at", "es")]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))
    rows = [(i, prose(rng.randrange(20, 260)), "en", f"src{i % 4}") for i in range(60)]
    for i in range(60, 80):  # copies and near copies
        text = rows[i % 7][1]
        if i % 2:
            cut = text.split(" ")
            cut[len(cut) // 2] = "changed"
            text = " ".join(cut)
        rows.append((i, text, "en", "src0"))
    shared = prose(60)
    rows += [(i, f"{prose(30)}\n{shared}\n{prose(30)}", "de", None) for i in range(80, 90)]
    rows += [(90, None, None, "src1"), (91, "", "", "src1"), (92, " \n\t ", "xx", "src2"), (93, "a " * 70, "en", "src2"), (94, "x", "en", "src9")]
    rows += [(95, "line one is here\n" * 12, "en", "src3"), (96, prose(9000), "en", "src3"), (97, "\u00a0é\u3000ü " * 30, "fr", "src3")]
    rows += [rows[3], (3, "another text under a used id", "en", "src0"), (None, prose(50), "en", "src1")]
    df = spark.createDataFrame([(*r, len(r[1] or ""), "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string")
    return df.repartition(5)


@pytest.fixture(scope="session")
def texts(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.collect()]

