import math

import numpy as np

from sedimark.llm import decontaminate as D


def test_short_items_with_one_substitution(spark):
    """Every place of a substitution that verification accepts is met."""
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(3, 13)]
    docs, want = [], set()
    for n, text in items:
        for k in range(-1, n):
            words = text.split()
            if k >= 0:
                words[k] = "changed"
            d = 100 * n + k + 1
            docs.append((d, " ".join(["before", "it", *words, "after", "it"])))
            if D.overlaps((np.arange(n) != k)[None])[2][0] >= min(13, math.ceil(0.8 * n)):
                want.add((d, n))
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(9, 901 + k) for k in (0, 3, 8)} <= {(n, d) for d, n in want}
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(table, bench).collect()} == want
