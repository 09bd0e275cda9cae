"""Range join over many cells and blocks, and documents of one class, copy or repeated row."""

import math

import numpy as np

from quaystone.llm import op8_bayes_jaccard_join as op8
from quaystone.llm import op9_metric_range_join as op9

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    link = {i: set() for i, _, _ in rows}
    for i, x, l in rows:
        for j, y, m in rows:
            if i != j and l == m and len(x) == len(y) and op9.cosine(np.array(x, "<f8").tobytes(), np.array(y, "<f8").tobytes()) >= 0.93:
                link[i].add(j)
    component = {}
    for i in sorted(link):
        todo = [i] if i not in component else []
        while todo:
            k = todo.pop()
            if component.setdefault(k, i) == i:
                todo += [j for j in link[k] if j not in component]
    return {(i, len(link[i]), component[i], component[i] == i) for i in link}


def test_links_over_cell_borders_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(op9, "CELL_ROWS", 8)
    monkeypatch.setattr(op9, "BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), i % 2) for i in range(400)]
    rows += [(400 + i, rows[i][1], rows[i][2]) for i in range(5)]
    rows += [(500, [1.0, 0.0, 0.0, 0.0, 0.0], 0), (501, [93.0, 33.0, 15.0, 6.0, 1.0], 0), (502, [1e-200, 0.0, 0.0, 0.0, 0.0], 0), (503, [92.999, 33.0, 15.0, 6.0, 1.0], 0)]
    got = {tuple(r) for r in op9.range_join(spark.createDataFrame(rows, SCHEMA)).select("vec_id", "n_links", "component_id", "kept").collect()}
    assert got == brute(rows)
    assert sum(n for _, n, _, _ in got) > 500


def test_cosine_at_the_threshold():
    pack = lambda *x: np.array(x, "<f8").tobytes()
    assert op9.cosine(pack(1.0, 0, 0, 0, 0), pack(93.0, 33, 15, 6, 1)) == 0.93
    assert math.isclose(op9.cosine(pack(3e300, 4e300), pack(3e-300, 4e-300)), 1.0)


def test_one_of_each_keeps_one_row_of_copies(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a"), (2, text + " ", "b"), (3, "", "c"), (4, None, "d"), (5, "", "e"), (6, "...", "f"), (7, "other words stand here", "g"), (7, "other words stand here", "h"), (None, text, "i"), (8, "", "j"), (8, "", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = op8.one_of_each(docs)
    assert out.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert left == [(0, text), (1, text), (3, ""), (6, "..."), (7, "other words stand here"), (8, "")]
