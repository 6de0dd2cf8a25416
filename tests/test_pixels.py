import numpy as np

from quillmatch.sources import pixels


def test_variants(spark):
    g = np.full((20, 30), 200, np.uint8)
    g[5:9, 5:25] = 30
    data = b"P5\n# made\n30 20\n255\n" + g.tobytes()
    got = pixels.image_variants(spark.createDataFrame([("a", data), ("b", b"junk"), ("c", None)], "image_id string, content binary"), even=lambda g: g).collect()
    assert len(got) == 12 and {r["image_id"] for r in got} == {"a"}
    by = {(r["variant"], r["angle"]): r for r in got}
    shape = lambda k: np.frombuffer(by[k]["pixels"], np.uint8).reshape(by[k]["height"], by[k]["width"])
    two = shape((1, 0))
    assert ((two == 0) == (g == 30)).all() and (shape((2, 0)) == 255 - two).all()
    assert (shape((1, 90)) == np.rot90(two)).all() and by[(1, 270)]["width"] == 20
    assert (shape((3, 0)) >= two).all() and shape((3, 0))[8, 24] == 0 and shape((3, 0))[5, 5] == 255
    assert shape((0, 0))[0, 0] == 255 and shape((0, 0))[5, 10] == 0


def test_shrink_and_grey():
    big = np.zeros((100, 4000, 3), np.uint8)
    big[:, ::2] = 100
    small = pixels.shrink(big)
    assert small.shape == (50, 2000, 3) and (small == 50).all()
    assert pixels.shrink(big[:10, :10]).shape == (10, 10, 3)
    assert pixels.grey(np.array([[[255, 0, 0]]], np.uint8))[0, 0] == 76
    assert pixels.decode_pnm(b"P6 2 1 255 " + bytes(6)).shape == (1, 2, 3) and pixels.decode_pnm(b"P5 9 9 255 x") is None


def test_contrast_noise_and_turns():
    r = np.random.default_rng(2)
    flat = np.full((40, 48), 120, np.uint8)
    assert np.ptp(pixels.even_contrast(flat)) == 0 and (pixels.denoise(flat) == 120).all()
    ramp = np.tile(np.linspace(100, 140, 64).astype(np.uint8), (64, 1))
    assert np.ptp(pixels.even_contrast(ramp)) > np.ptp(ramp)
    noisy = np.clip(120 + r.normal(0, 6, (40, 48)), 0, 255).astype(np.uint8)
    assert pixels.denoise(noisy).std() < 0.4 * noisy.std()
    edge = np.where(np.arange(48)[None, :] < 24, 20, 220).astype(np.uint8).repeat(40, 0)
    assert (np.abs(pixels.denoise(edge).astype(int) - edge) <= 2).all()
    assert (pixels.turned(edge, 90) == np.rot90(edge)).all()
    half = pixels.turned(edge, 45)
    assert half.shape == (int(88 * np.sqrt(0.5)), int(88 * np.sqrt(0.5))) and {20, 220} <= set(half.ravel().tolist())
    assert pixels.evened(r.integers(0, 255, (3, 5)).astype(np.uint8)).shape == (3, 5)
