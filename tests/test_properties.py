"""Properties that hold for any input, of the parts that are plain Python."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.functions.geometry import _share
from quirework.operators.imaging import ink_fraction, mask_components, padded, variant
from quirework.operators.layout import fold_lines

number = st.floats(0, 300, allow_nan=False)
masks = st.integers(1, 12).flatmap(lambda w: st.lists(st.lists(st.booleans(), min_size=w, max_size=w), min_size=1, max_size=12))


def flooded(mask):
    left, out = {(y, x) for y, row in enumerate(mask) for x, v in enumerate(row) if v}, []
    while left:
        stack, part = [left.pop()], []
        while stack:
            y, x = stack.pop()
            part.append((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            stack += near
        ys, xs = zip(*part)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
    return sorted(out)


@given(masks)
@settings(max_examples=200, deadline=None)
def test_components_are_flood_fills(mask):
    assert mask_components(np.array(mask)) == flooded(mask)


@given(st.lists(st.tuples(number, number, st.floats(1, 40), st.floats(1, 40)), max_size=40))
@settings(deadline=None)
def test_every_box_has_one_line_and_order_is_free(boxes):
    rows = np.array([(i, *b) for i, b in enumerate(boxes)]).reshape(-1, 5)

    def found(rows):
        return sorted(zip(*(v.tolist() for v in fold_lines(rows[:, 0].astype(int), rows[:, 1], rows[:, 2], rows[:, 4]))))

    assert [i for i, _ in found(rows)] == list(range(len(rows)))
    assert {n for _, n in found(rows)} == set(range(len({n for _, n in found(rows)})))
    assert found(rows) == found(rows[::-1])


@given(st.tuples(*[st.floats(-50, 150)] * 4), st.floats(1, 100), st.floats(1, 100))
@settings(deadline=None)
def test_the_share_of_a_rectangle(corners, width, height):
    x0, x1 = sorted(corners[:2])
    y0, y1 = sorted(corners[2:])
    got = _share([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], width, height)
    if (x1 - x0) * (y1 - y0) > 1e-3:
        inside = max(0, min(x1, width) - max(x0, 0)) * max(0, min(y1, height) - max(y0, 0))
        assert abs(got - inside / ((x1 - x0) * (y1 - y0))) < 1e-6


@given(st.integers(1, 30), st.integers(1, 30), st.integers(0, 6), st.integers(0, 2**31))
@settings(deadline=None)
def test_pictures_keep_their_shape(height, width, kind, seed):
    grey = np.random.default_rng(seed).integers(0, 256, (height, width), dtype=np.uint8)
    assert variant(grey, kind).shape == grey.shape and 0 <= ink_fraction(grey) <= 1
    assert min(padded(grey).shape) >= 16
