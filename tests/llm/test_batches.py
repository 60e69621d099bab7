"""What the operators do with a batch at a time, without Spark."""

import re

import numpy as np
import pyarrow as pa

from weirflow.llm import common, lines


def test_cuts_of_a_batch_as_one_by_one():
    rows = ["one two three. four", None, "", " \u3000zwei\u00a0drei\x1cvier  f\u00fcnf\nsechs ", "\U0001f600 a b", "x y z", "   "]
    cuts = {0: [(2, 3), (0, 1), (1, 2)], 3: [(3, 5), (1, 2)], 4: [(0, 1)], 5: [(0, 1), (2, 3)]}
    pairs = np.asarray([(k, a, b) for k, some in cuts.items() for a, b in some], np.int64).T
    for texts in (pa.array(rows), pa.array(["gone", *rows]).slice(1)):
        text, n_lines, n_cut, spans = lines.cut_texts(texts, *lines.joined(*pairs))
        for k, row in enumerate(rows):
            bounds = [m.start() for m in re.finditer(r"\S+", row or "")]
            bounds = [0, *bounds[1:], len(row or "")]
            some = {0: [(0, 3)], 3: [(1, 2), (3, 5)]}.get(k, cuts.get(k, []))
            own = [(bounds[a], bounds[b]) for a, b in some]
            gone = {i for a, b in own for i in range(a, b)}
            assert text[k].as_py() == (row and "".join(c for i, c in enumerate(row) if i not in gone)) and spans[k] == ",".join(f"{a}:{b}" for a, b in own)
        assert n_lines.tolist() == [2, 0, 0, 2, 1, 1, 0] and n_cut.tolist() == [1, 0, 0, 1, 0, 0, 0]


def test_workers_give_memory_back(monkeypatch):
    calls, batch = [], pa.RecordBatch.from_pydict({"x": list(range(5))})
    monkeypatch.setattr(common, "TRIM", calls.append)
    assert sum(b.num_rows for b in common.by_batch(lambda b: b, 2)([batch, batch, batch])) == 15
    assert len(calls) == 3
