"""The quality stage where ids are null or repeat: a row goes by its own score only."""

import random

from tallyloom.llm import quality_crf
from tests.llm.fixtures import table


def test_a_bad_text_takes_no_other_row_of_its_id_along(spark):
    rng = random.Random(4)
    line = lambda junk: " ".join(("##" if junk else "") + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) + ("$$$" if junk else "") for _ in range(9))
    text = lambda junk: "\n".join(line(junk) for _ in range(4))
    doc = lambda i, t: (i, t, None, None, 1, "x", "y", "z", 1, False, "q")
    rows = [doc(i, text(i % 3 == 0)) for i in range(120)]
    some = [doc(i, text(junk)) for i in (None, 900) for junk in (False, True, False)] + [doc(None, None), doc(901, None), doc(901, text(False))]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(120)], "doc_id long, quality int")
    docs = table(spark, rows + some)
    left = quality_crf.keep_good(docs, labels)
    assert left.columns == docs.columns
    good = [r[1] for r in rows if r[0] % 3] + [some[k][1] for k in (0, 2, 3, 5, 8)]
    assert sorted(r["text"] for r in left.collect()) == sorted(good)
