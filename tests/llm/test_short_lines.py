import random

import pytest

from quillmatch.llm.line_edit_join import _distance, deletions, edits_of, line_dedup

SCHEMA = "doc_id long, text string"


def dropped(spark, rows, **how):
    return {x["doc_id"]: x["dropped"] for x in line_dedup(spark.createDataFrame(rows, SCHEMA), **how).collect() if x["dropped"]}


def test_short_repeats(spark):
    rows = [(1, "All rights reserved.\nNo\n\n \nitem 17"), (2, "\nAll rights reserved.\n \nNo\nitem 18"), (3, "All rights reserved!\nAll right reserved!\nNo."), (4, "No")]
    assert dropped(spark, rows) == {2: [1, 3], 3: [0, 1], 4: [0]}


def test_short_lines_against_brute_force(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(1, 45))) for _ in range(60)]
    rows = []
    for d in range(150):
        lines = []
        for _ in range(r.randint(1, 5)):
            line = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                line[r.randrange(len(line))] = r.choice(["x", "y", "xy", "", "z"]) or "z"
            lines.append("".join(line))
        rows.append((d, "\n".join(lines)))
    want, seen = {}, []
    for d, text in rows:
        for n, x in enumerate(text.split("\n")):
            if x.strip() and any(x == y or _distance(x, y) <= min(2, len(x) // 15, len(y) // 15) for y in seen):
                want.setdefault(d, []).append(n)
            seen.append(x)
    assert dropped(spark, rows) == want


@pytest.mark.parametrize(("edits", "per_edit"), [(2, 0), (1, 0), (3, 0), (2, 2)])
def test_all_lengths_against_brute_force(spark, edits, per_edit):
    """Lines of 0 to 60 characters, all with the same edits, or with fewer the shorter they are."""
    r = random.Random(edits * 10 + per_edit)
    base = ["".join(r.choice("abcdefghijklmnop é漢") for _ in range(n % 61)) for n in range(90)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(r.randint(1, 3)):
            line = list(r.choice(base))
            for _ in range(r.randint(0, 4)):
                line.insert(r.randint(0, len(line)), r.choice("xyz"))
                del line[r.randrange(len(line))]
            lines.append("".join(line))
        rows.append((d, "\n".join(lines)))
    want, seen, short = {}, [], 0
    for d, text in rows:
        for n, x in enumerate(text.split("\n")):
            if x.strip() and any(x == y or _distance(x, y) <= edits_of(min(len(x), len(y)), edits, per_edit) for y in seen):
                want.setdefault(d, []).append(n)
                short += len(x) <= 2 * edits
            if x.strip():
                seen.append(x)
    assert dropped(spark, rows, edits=edits, per_edit=per_edit) == want and short > 3
    assert len(seen) > sum(map(len, want.values())) + 40


def test_deletions_of_the_shortest():
    row, key = deletions(["ab", "b", "longer", "cab"], 2)
    of = {i: set(key[row == i].tolist()) for i in range(4)}
    assert of[0] & of[1] & of[3] and not of[2] and all(key % 2 == 1)
