import random

from quillmatch.llm.line_edit_join import LEAST, _distance, deduped, line_dedup, within

SCHEMA = "doc_id long, text string, n_chars long, dropped string"


def edited(r, line, n):
    out = list(line)
    for _ in range(n):
        i, k = r.randrange(len(out)), r.random()
        if k < 0.4:
            out.insert(i, r.choice("xyz"))
        elif k < 0.7:
            del out[i]
        else:
            out[i] = r.choice("xyz")
    return "".join(out)


def test_distance_in_bits():
    r = random.Random(3)
    a = ["".join(r.choice("abé") for _ in range(r.randint(0, 40))) for _ in range(800)]
    b = [edited(r, x, r.randint(0, 5)) if len(x) > 6 else x[:2] + "b" for x in a]
    for e in (1, 2, 3):
        assert within(a, b, e).tolist() == [_distance(x, y) <= e for x, y in zip(a, b)]


def brute(rows):
    """doc -> dropped lines, for distinct ids without nulls."""
    order = [(d, n, x) for d, t, *_ in sorted(rows) for n, x in enumerate((t or "").split("\n")) if len(x) >= LEAST]
    gone, seen = {}, []
    for d, n, x in order:
        if any(x == y for y in seen) or any(abs(len(x) - len(y)) <= 2 and _distance(x, y) <= 2 for y in seen):
            gone.setdefault(d, []).append(n)
        if x not in seen:
            seen.append(x)
    return gone


def test_against_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh é") for _ in range(r.randint(38, 60))) for _ in range(25)]
    rows = []
    for d in range(60):
        lines = [r.choice(base) if r.random() < 0.3 else edited(r, r.choice(base), r.randint(1, 4)) for _ in range(r.randint(1, 5))]
        rows.append((d, "\n".join(lines), 1, None))
    got = {x["doc_id"]: x for x in line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert {d: x["dropped"] for d, x in got.items() if x["dropped"]} == want
    assert all(x["n_exact"] + x["n_near"] == len(x["dropped"]) and x["n_lines"] == rows[d][1].count("\n") + 1 for d, x in got.items())
    assert sum(x["n_near"] for x in got.values()) > 5


def test_nulls_repeats_and_empty(spark):
    line = "a line that is long enough to be looked at by this operator"
    rows = [(1, f"{line}\nshort", 9, None), (1, f"{line}\nshort", 9, None), (None, line, 9, None), (2, None, None, None), (3, "", 0, None), (4, f"{line}!\nkept line", 9, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(x["doc_id"]), x["n_lines"], x["dropped"]) for x in line_dedup(docs).collect())
    assert got == [("1", 2, []), ("1", 2, []), ("2", 0, []), ("3", 0, []), ("4", 2, [0]), ("None", 1, [0])]
    out = sorted((str(x["doc_id"]), x["text"], x["n_chars"]) for x in deduped(docs).collect())
    assert ("4", "kept line", 9) in out and not any(d == "None" for d, *_ in out)
    assert len(out) == 5 and deduped(docs).columns == docs.columns
    assert line_dedup(docs.limit(0)).count() == 0 and deduped(docs.limit(0)).count() == 0
