"""Images in stacks and in files of many: the same pixels as one by one, and none lost."""

import zlib
from pathlib import Path

import numpy as np

from quillmatch.operators.ocr import ANGLES
from quillmatch.plans.queries import QUERIES
from quillmatch.sources import pixels, scratch

R = np.random.default_rng(9)


def test_stacks_and_strips(monkeypatch):
    for shape in ((16, 24), (9, 70), (90, 5), (3, 4)):
        many = [R.integers(0, top, shape).astype(np.uint8) for top in (256, 90, 3, 1, 256)]
        stack = np.stack(many, -1)
        one = [pixels.variants(g) for g in many]
        for k, g in enumerate(pixels.thresholded(pixels.evened(stack))):
            assert all((g[..., i] == one[i][k]).all() for i in range(len(many)))
            for angle in (0, 90, 270, 30):
                assert all((pixels.turned(g, angle)[..., i] == pixels.turned(one[i][k], angle)).all() for i in range(len(many)))
        with monkeypatch.context() as m:
            m.setattr(pixels, "STACK", 1)  # the tall images fall into strips
            assert (pixels.denoise(stack) == np.stack([pixels.denoise(g) for g in many], -1)).all()
        assert (pixels.denoise(stack)[..., 0] == pixels.denoise(many[0])).all()


def test_split():
    a, b = b"P5\n# 17\n3 2\n255\n\n \n12 ", b"P6 # x y\n# z\n1 1 255 P5 "
    got = list(pixels.split_pnm(a + b"\n" + b + b + b"P5\n#\n2 1 65535\nabcd" + b"P5 9 9 255 short"))
    assert [x for x, _ in got] == ["17", "x y", "x y", None, None] and [x for _, x in got[:2]] == [a, b]
    assert pixels.decode_pnm(got[0][1]).tolist() == [[10, 32, 10], [49, 50, 32]] and pixels.decode_pnm(got[-1][1]) is None
    assert list(pixels.split_pnm(b"")) == [] == list(pixels.split_pnm(b"junk"))


def test_sizes_mixed(spark):
    images = [(str(i), R.integers(0, 256, ((7, 5), (5, 7), (6, 6))[i % 3]).astype(np.uint8)) for i in range(50)]
    rows = [(n, b"P5 %d %d 255 " % g.shape[::-1] + g.tobytes()) for n, g in images] + [("junk", b"P5"), ("none", None)]
    for even in (pixels.evened, lambda g: g[1:]):
        want = {(n, v, a, p.tobytes(), p.shape) for n, g in images for v, x in enumerate(pixels.variants(g, even)) for a in ANGLES for p in [pixels.turned(x, a)]}
        got = pixels.image_variants(spark.createDataFrame(rows, "image_id string, content binary"), even=even).collect()
        assert len(got) == len(want) and {(x["image_id"], x["variant"], x["angle"], bytes(x["pixels"]), (x["height"], x["width"])) for x in got} == want


def test_rows_of_part(spark, tmp_path):
    """Every row has its variants, with a key given twice or missing too, and images share files."""
    rows = [(i, f"part {i}") for i in range(2300)] + [(7, "another"), (None, "no key"), (8, None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["image_variants"](spark, str(tmp_path)).collect()
    assert len(list(Path(scratch._MADE[-1][1]).glob("part-*"))) < 10
    by = {}
    for x in got:
        by.setdefault(x["image_id"], []).append(x)
    assert len(got) == 12 * len(rows) and set(by) == {str(i) for i in range(2300)} | {None}
    assert len({x["crc"] for x in by["7"]}) > len({x["crc"] for x in by["9"]}) and {len(by[k]) for k in ("7", "8")} == {24}
    plain = {v: zlib.crc32(p.tobytes()) for v, p in enumerate(pixels.variants(_image("9/part 9")))}
    assert {x["variant"]: x["crc"] for x in by["9"] if x["angle"] == 0} == plain


def _image(key):
    import hashlib

    mark = hashlib.sha256(key.encode()).hexdigest()
    return np.array([ord(mark[i % 64]) + 20 for i in range(384)], np.uint8).reshape(16, 24)
