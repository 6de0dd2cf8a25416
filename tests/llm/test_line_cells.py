import random

import numpy as np
import pyarrow as pa
import pytest

from quillmatch.llm import line_edit_join as lj

AT = pa.struct([("no_id", pa.bool_()), ("rk_id", pa.int64()), ("rk_a", pa.int64()), ("rk_b", pa.int64()), ("line_no", pa.int32())])


def cell(lines, places, sides):
    """A cell of all lines, each as an index entry and as a probe."""
    names = [lj.line_ids(x) for x in lines]
    sign = [int(lj._parity(lj._characters([x])[2], np.zeros(1, np.int64))[0]) for x in lines]
    rows = [(i, probe) for i in range(len(lines)) for probe in (False, True)]
    pick = lambda values, kind: pa.array([values[i] for i, _ in rows], kind)
    at = [{"no_id": n is None, "rk_id": n, "rk_a": 0, "rk_b": 0, "line_no": 0} for n in places]
    columns = [
        pick(sign, pa.int64()), pa.array([p for _, p in rows], pa.bool_()), pick(sides, pa.int32()), pick([a for a, _ in names], pa.int64()),
        pick([b for _, b in names], pa.int64()), pick(at, AT), pick(lines, pa.string()),
    ]
    return pa.table(columns, names=["line", "probe", "side", "h_a", "h_b", "at", "body"])


@pytest.mark.parametrize("slice_of", [20, 300_000])
@pytest.mark.parametrize("two", [False, True])
def test_cells_against_brute_force(monkeypatch, slice_of, two):
    """Parts of a cell verified one by one find what all candidates at once do, in cells of one and of two blocks."""
    monkeypatch.setattr(lj, "SLICE", slice_of)
    r = random.Random(7)
    base = ["".join(r.choice("abcdefgh") for _ in range(r.randint(20, 50))) for _ in range(6)]
    lines = set()
    while len(lines) < 90:
        line = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            line[r.randrange(len(line))] = r.choice("xyz")
        lines.add("".join(line))
    lines = sorted(lines)
    places = r.sample(range(1000), len(lines) - 1) + [None]  # a null id comes last
    sides = [r.randrange(2) if two else 0 for _ in lines]
    order = [(p is None, p or 0) for p in places]
    want = {
        lj.line_ids(x)
        for i, x in enumerate(lines)
        for j, y in enumerate(lines)
        if order[j] < order[i] and (not two or sides[i] != sides[j]) and lj._distance(x, y) <= min(2, len(x) // 15, len(y) // 15)
    }
    verifier, got = lj.Verifier(2), []
    table = cell(lines, places, sides)
    for start in (0, 0):  # as two cells in a row
        got.append(verifier(table, start, table.num_rows))
    got.append(verifier.finish())
    found = [(a, b) for batch in got if batch is not None for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    assert set(found) == want and 20 < len(want) < len(lines)


def test_hot_cell_holds_little(monkeypatch):
    """Near copies of one line cost about one comparison each, not one for each two of them."""
    compared = []
    plain = lj.within
    monkeypatch.setattr(lj, "SLICE", 2000)
    monkeypatch.setattr(lj, "within", lambda a, b, edits: compared.append(len(a)) or plain(a, b, edits))
    stem = "a line of a page that says the number of itself here: "
    lines = [f"{stem}{i:02d}" for i in range(100)]
    verifier = lj.Verifier(2)
    given = [verifier(cell(lines, list(range(100)), [0] * 100), 0, 200), verifier.finish()]
    assert {a for b in given if b is not None for a in b.column(0).to_pylist()} == {lj.line_ids(x)[0] for x in lines[1:]}
    assert max(compared) <= 4 * 2000 // len(lines[0]) + 1 and sum(compared) < 600
