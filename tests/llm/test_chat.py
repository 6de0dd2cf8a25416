from quillmatch.llm import chat_collapse
from quillmatch.llm.chat_collapse import formatted

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    convs = {c: [(v[3] if v[2] else None, v[5] if v[4] else None) for v in sorted(vs)] for c, vs in convs.items()}
    out = {}
    for c, turns in convs.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values()):
            continue
        same = [k for k, o in convs.items() if o == turns]
        if c == min(same, key=lambda k: (k is None, k or 0)):
            out[c] = (len(turns), len(same), "".join(f"<|im_start|>{'user' if r is None else r}\n{x or ''}<|im_end|>\n" for r, x in turns))
    return out


def test_against_brute_force(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"say {t} {'x' if c % 3 else 'y'}") for c in range(30) for t in range(1 + c % 7)]
    rows += [(40, 0, None, None), (40, 1, "user", ""), (41, None, "user", "a"), (41, 0, "user", "b"), (None, 0, "user", "alone"), rows[0], rows[0], (42, 5, "user", "say 0 x")]
    got = {}
    for r in sorted(formatted(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r["part"]):
        got[r["conv_id"]] = (r["n_turns"], r["n_copies"], got.get(r["conv_id"], (0, 0, ""))[2] + r["text"])
    assert got == brute(rows)


def test_long_logs_come_in_parts(spark):
    rows = [(1, t, "user", str(t)) for t in range(2500)] + [(2, t, "user", str(t)) for t in range(1700)]
    got = sorted(formatted(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r["conv_id"], r["part"]))
    assert [(r["conv_id"], r["part"], r["n_turns"]) for r in got] == [(1, 0, 2500), (1, 1, 2500), (1, 2, 2500)]
    assert "".join(r["text"] for r in got).count("<|im_start|>") == 2500


def test_empty_and_plan(spark):
    empty = spark.createDataFrame([], SCHEMA + ", n_turns int")
    assert formatted(empty).count() == 0
    plan = formatted(empty)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "conversations" in chat_collapse.ORACLE_SQL
