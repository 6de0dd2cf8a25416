"""Tables changed in place, replies that are kept, and images from their bytes."""

import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmatch.sources import pixels, providers, tables


def files(root, name):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{root}/{name}") for f in names if f.endswith(".parquet")}


def scan_rows(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("u").alias("user_id"), F.lit("").alias("image_path"))


def test_a_delete_writes_its_partitions_only(spark, tmp_path):
    root = str(tmp_path)
    tables.create(spark, root)
    tables.append(scan_rows(spark, 300), root, "scans")
    tables.append(spark.range(600).select((F.col("id") % 300).cast("string").alias("scan_id"), F.lit("user").alias("role"), F.lit("x").alias("content")), root, "chat_messages")
    before = {name: files(root, name) for name in ("scans", "chat_messages")}
    tables.delete_scans(spark.createDataFrame([("7",), ("nobody",), (None,)], "id string"), root)
    for name, rows in (("scans", 299), ("chat_messages", 598)):
        after = files(root, name)
        gone = before[name].keys() - after.keys()
        assert tables.read(spark, root, name).count() == rows
        assert len({os.path.dirname(f) for f in gone}) <= 3 and all(after[f] == t for f, t in before[name].items() if f in after)
        assert len({os.path.dirname(f) for f in after}) == tables.PARTS
    # A partition that loses all its rows goes.
    part = tables.read(spark, root, "scans").select("id", tables.part_of("scans").alias("part"))
    others = part.filter("part <> 3").count()
    tables.delete(part.filter("part = 3").select("id"), root, "scans")
    assert not os.path.exists(f"{root}/scans/part=3") and tables.read(spark, root, "scans").count() == others


def test_new_users_are_appended(spark, tmp_path):
    root = str(tmp_path)
    tables.create(spark, root)
    user = lambda rows: spark.createDataFrame(rows, "id string, email string, name string, n int")
    tables.insert_absent(user([("1", "a", "A", 1), ("2", "b", "B", 2), ("3", "b", "B2", 1), ("4", None, "no", 1)]), root, "users", "n")
    before = files(root, "users")
    tables.insert_absent(user([("9", "a", "again", 1), ("5", "c", "C", 1)]), root, "users", "n")
    assert before.items() <= files(root, "users").items()
    assert sorted((r["id"], r["email"]) for r in tables.read(spark, root, "users").collect()) == [("1", "a"), ("3", "b"), ("5", "c")]


def test_replies_are_asked_for_once(spark, tmp_path):
    path = str(tmp_path / "replies")

    def model(broken):
        def made():
            def answer(frame):
                if broken and "bad" in set(frame["prompt"]):
                    raise RuntimeError("down")
                return [f"re {p}" for p in frame["prompt"]]

            return answer

        return made

    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "bad")], "id long, prompt string").repartition(4)
    asked = lambda df, broken, **how: {r["id"]: r["said"] for r in providers.ask_once(df, model(broken), "said", ["prompt"], path, **how).collect()}
    some = rows.filter("id < 4")
    assert asked(some, False) == {1: "re x", 2: "re x", 3: "re None"} and providers.kept_replies(spark, path).count() == 2
    with pytest.raises(RuntimeError, match="down"):
        asked(rows, True)
    got = asked(rows, True, on_error=providers.error_json)
    assert json.loads(got[4]) == {"error": "down"} and got[1] == "re x" and providers.kept_replies(spark, path).count() == 2  # a failure is not kept
    assert asked(rows, False)[4] == "re bad" and providers.kept_replies(spark, path).count() == 3


def test_variants_against_a_plain_loop(spark, tmp_path):
    """Every pixel by loops over its neighbours, from the bytes of a file on."""
    r = np.random.default_rng(4)
    g = r.integers(0, 255, (9, 11)).astype(np.uint8)
    (tmp_path / "a.pgm").write_bytes(b"P5 11 9 255\n" + g.tobytes())
    read = spark.read.format("binaryFile").load(str(tmp_path)).select(F.lit("a").alias("image_id"), "content")
    got = {(x["variant"], x["angle"]): x for x in pixels.image_variants(read).collect()}
    even = pixels.even_contrast(g).astype(int)
    pad = lambda a, n: np.pad(a, n, mode="symmetric" if min(a.shape) > n else "edge")
    t, s = 3, 10
    p, quiet = pad(even, t + s), np.zeros(g.shape, np.uint8)
    for y in range(9):
        for x in range(11):
            total = weight = 0.0
            home = p[y + s : y + s + 7, x + s : x + s + 7]
            for dy in range(21):
                for dx in range(21):
                    other = p[y + dy : y + dy + 7, x + dx : x + dx + 7]
                    w = np.exp(-((home - other) ** 2).mean() / 144)
                    total, weight = total + w * other[3, 3], weight + w
            quiet[y, x] = np.rint(total / weight)
    best = max(range(256), key=lambda k: ((quiet <= k).sum() * (quiet > k).sum() * (quiet[quiet <= k].mean() - quiet[quiet > k].mean()) ** 2) if (quiet <= k).any() and (quiet > k).any() else 0)
    two = np.where(quiet > best, 255, 0)
    thick = np.array([[max(two[max(y - 1, 0) : y + 1, max(x - 1, 0) : x + 1].ravel()) for x in range(11)] for y in range(9)])
    for v, image in ((1, two), (2, 255 - two), (3, thick)):
        for angle in (0, 90, 270):
            want = np.rot90(image, angle // 90).astype(np.uint8)
            row = got[v, angle]
            assert (row["height"], row["width"]) == want.shape and bytes(row["pixels"]) == want.tobytes()
    kernel = np.exp(-(np.arange(-7, 8) ** 2) / (2 * (0.3 * 6 + 0.8) ** 2))
    kernel /= kernel.sum()
    q = np.pad(quiet.astype(float), 7, mode="edge")
    local = np.array([[255 if quiet[y, x] > np.rint((q[y : y + 15, x : x + 15] * np.outer(kernel, kernel)).sum()) - 8 else 0 for x in range(11)] for y in range(9)], np.uint8)
    assert bytes(got[0, 0]["pixels"]) == local.tobytes() and zlib.crc32(local.tobytes())
