import numpy as np

from tilefold.plans import train


def test_separate_colors_are_found():
    rng = np.random.default_rng(1)
    centres = np.array([[10, 10, 10], [200, 30, 30], [30, 200, 30], [240, 240, 240]], float)
    pixels = np.concatenate([c + rng.integers(-3, 4, (200, 3)) for c in centres])
    palette = train.train_palette(pixels, 4, seed=2, share=0.5)
    assert all(np.abs(palette - c).max(axis=1).min() <= 4 for c in centres)
    assert (palette == train.train_palette(pixels, 4, seed=2, share=0.5)).all()


def test_ties_and_order():
    assert train.nearest(np.array([[1, 1, 1], [1, 1, 1.0]]), np.array([0, 0, 0])) == 1
    line = np.array([[v, v, v] for v in (0, 200, 50, 150, 100)], float)
    assert train.order(line)[:, 0].tolist() == [0, 50, 100, 150, 200]
    assert len(train.order(line[:1])) == 1


def test_images_in_parallel(spark):
    rows = [(i, p, p % 2 * 200, 10, 10) for i in range(3) for p in range(40)]
    out = train.train(spark.createDataFrame(rows, "image_id int, p int, r int, g int, b int"), 2, share=1.0).collect()
    assert sorted((r.image_id, r.i) for r in out) == [(i, k) for i in range(3) for k in range(2)]
