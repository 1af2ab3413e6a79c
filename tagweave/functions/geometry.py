"""Box geometry as Column builders. A box is four double columns or a struct of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from tagweave.functions.text import fixed_decimals
from tagweave.schema import BOX_COLUMNS


def _at_least_zero(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), c))


def _smaller(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def _larger(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


@dataclass(frozen=True)
class Box:
    """Corners as columns. A box with a missing corner has no size, and nothing is measured with it: a
    NULL stays NULL in every function here."""
    x_min: Column
    y_min: Column
    x_max: Column
    y_max: Column

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        return cls(*[F.col(prefix + c) for c in BOX_COLUMNS])

    @classmethod
    def struct(cls, c: Column) -> "Box":
        return cls(*[c[name] for name in BOX_COLUMNS])

    @property
    def width(self) -> Column:
        return _at_least_zero(self.x_max - self.x_min)

    @property
    def height(self) -> Column:
        return _at_least_zero(self.y_max - self.y_min)

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center(self) -> tuple[Column, Column]:
        return self.x_min + self.width / 2, self.y_min + self.height / 2

    def columns(self, prefix: str = "") -> list[Column]:
        return [getattr(self, c).alias(prefix + c) for c in BOX_COLUMNS]

    def as_struct(self) -> Column:
        return F.struct(*self.columns())

    def shifted(self, dx: Column, dy: Column) -> "Box":
        return Box(self.x_min + dx, self.y_min + dy, self.x_max + dx, self.y_max + dy)

    def padded(self, left, top, right, bottom) -> "Box":
        return Box(self.x_min - left, self.y_min - top, self.x_max + right, self.y_max + bottom)

    def half_even(self) -> "Box":
        return Box(*[F.rint(getattr(self, c)) for c in BOX_COLUMNS])


def _within(c: Column, high: Column) -> Column:
    return _at_least_zero(_smaller(high.cast("double"), c))


def clamp(box: Box, width: Column, height: Column) -> Box:
    """Keep the low corner on a pixel of the image, the high corner on its edge."""
    return Box(_within(box.x_min, width - 1), _within(box.y_min, height - 1),
               _within(box.x_max, width), _within(box.y_max, height))


def clip(box: Box, width: Column, height: Column) -> Box:
    return Box(_within(box.x_min, width), _within(box.y_min, height),
               _within(box.x_max, width), _within(box.y_max, height))


def ordered(box: Box) -> Box:
    """Swap corners that arrive the wrong way round."""
    return Box(_smaller(box.x_min, box.x_max), _smaller(box.y_min, box.y_max),
               _larger(box.x_min, box.x_max), _larger(box.y_min, box.y_max))


def expand(box: Box, width: Column, height: Column, pad: float) -> Box:
    return clamp(box.padded(pad, pad, pad, pad), width, height)


def expand_tag(box: Box, width: Column, height: Column, side: float = 0.18, top: float = 0.10,
               bottom: float = 1.45) -> Box:
    w, h = F.greatest(F.lit(1.0), box.width), F.greatest(F.lit(1.0), box.height)
    return clamp(box.padded(side * w, top * h, side * w, bottom * h), width, height)


def grow_code_seed(box: Box, width: Column, height: Column) -> Box:
    """Tag box guessed from the box of its code square."""
    w, h = F.greatest(F.lit(1.0), box.width), F.greatest(F.lit(1.0), box.height)
    return clamp(box.padded(2.2 * w, 1.5 * h, 2.8 * w, 1.7 * h), width, height)


def intersection(a: Box, b: Box) -> Column:
    return (_at_least_zero(_smaller(a.x_max, b.x_max) - _larger(a.x_min, b.x_min))
            * _at_least_zero(_smaller(a.y_max, b.y_max) - _larger(a.y_min, b.y_min)))


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = a.area + b.area - inter
    return F.when(union > 0, inter / union).when(union.isNotNull(), 0.0)


def center_distance(a: Box, b: Box) -> Column:
    (ax, ay), (bx, by) = a.center, b.center
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def near_border(box: Box, width: Column, height: Column, margin: float = 0.015) -> Column:
    mx, my = width * margin, height * margin
    return ((box.x_min <= mx) | (box.y_min <= my) | (box.x_max >= width - mx)
            | (box.y_max >= height - my))


def rotate_ccw(box: Box, source_width: int = 3840) -> Box:
    """Box after the frame is turned 90 degrees counter-clockwise, whole pixels."""
    whole = lambda c: c.cast("bigint").cast("double")
    last = source_width - 1
    return Box(whole(box.y_min), whole(last - box.x_max), whole(box.y_max),
               whole(last - box.x_min))


def usable(box: Box, min_side: float = 3.0) -> Column:
    return (box.x_max - box.x_min >= min_side) & (box.y_max - box.y_min >= min_side)


def normalized_line(box: Box, width: Column, height: Column, label: Column) -> Column:
    """``class cx cy w h`` with six decimals; NULL for a box too small to label."""
    cut = clip(box, width, height)
    values = [
        (cut.x_min + cut.x_max) / 2.0 / width, (cut.y_min + cut.y_max) / 2.0 / height,
        (cut.x_max - cut.x_min) / width, (cut.y_max - cut.y_min) / height,
    ]
    texts = [fixed_decimals(v, 6) for v in values]
    return F.when(usable(cut), F.concat_ws(" ", label.cast("string"), *texts))


def from_normalized(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2.0, cy - h / 2.0, cx + w / 2.0, cy + h / 2.0)


def to_pixels(box: Box, width: Column, height: Column) -> Box:
    return clip(Box(box.x_min * width, box.y_min * height, box.x_max * width,
                    box.y_max * height), width, height)


def axis_starts(length: Column, size: int, stride: int) -> Column:
    """Tile starts along one axis; the last tile always touches the far edge."""
    steps = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), length - size).cast("bigint"),
                       F.lit(stride).cast("bigint"))
    last = F.array((length - size).cast("bigint"))
    return F.when(length <= size, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.array_union(steps, last))


def tiles(width: Column, height: Column, size: int = 640, stride: int = 512,
          max_tiles: int = 0, floor_sizes: bool = True) -> Column:
    """Row-major array of tile structs for one frame."""
    if floor_sizes:
        size, stride = max(64, size), max(32, stride)
    grid = F.flatten(F.transform(
        axis_starts(height, size, stride),
        lambda y: F.transform(axis_starts(width, size, stride), lambda x: F.struct(
            x.alias("x_min"), y.alias("y_min"),
            F.least(width.cast("bigint"), x + size).alias("x_max"),
            F.least(height.cast("bigint"), y + size).alias("y_max")))))
    if max_tiles > 0:
        grid = F.slice(grid, 1, max_tiles)
    empty = F.slice(grid, 1, 0)
    return F.when((width > 0) & (height > 0), grid).otherwise(empty)


def passes_geometry(box: Box, frame_area: Column, min_area: float = 1400.0,
                    max_area_ratio: float = 0.18, min_width: float = 45.0,
                    min_height: float = 25.0, min_aspect: float = 0.25,
                    max_aspect: float = 8.0) -> Column:
    aspect = box.width / F.greatest(F.lit(1.0), box.height)
    return ((box.area >= min_area) & (box.area <= frame_area * max_area_ratio)
            & (box.width >= min_width) & (box.height >= min_height)
            & aspect.between(min_aspect, max_aspect))


# Fractional zones (x0, y0, x1, y1).
CODE_ZONES = {"qr_code": (0.60, 0.00, 1.00, 0.42), "barcode": (0.00, 0.70, 1.00, 1.00)}
READING_ZONES = {
    "full": (0.00, 0.00, 1.00, 1.00), "product_top": (0.00, 0.00, 1.00, 0.62),
    "price_left": (0.00, 0.18, 0.58, 0.92), "price_right": (0.42, 0.18, 1.00, 0.92),
    "lower_codes": (0.00, 0.55, 1.00, 1.00), "center": (0.12, 0.12, 0.88, 0.88),
}
FUSION_ZONES = {
    "full": (0.00, 0.00, 1.00, 1.00), "product_name": (0.00, 0.00, 1.00, 0.55),
    "main_price": (0.00, 0.45, 1.00, 1.00), "barcode_meta": (0.00, 0.55, 1.00, 1.00),
    "left": (0.00, 0.00, 0.50, 1.00), "right": (0.50, 0.00, 1.00, 1.00),
}


def _zone_rows(zones: dict, edge) -> Column:
    rows = []
    for number, (name, (x0, y0, x1, y1)) in enumerate(zones.items()):
        left, top, right, bottom = edge(name, x0, y0, x1, y1)
        rows.append(F.struct(
            F.lit(number).alias("zone_no"), F.lit(name).alias("zone"),
            left.cast("double").alias("x_min"), top.cast("double").alias("y_min"),
            right.cast("double").alias("x_max"), bottom.cast("double").alias("y_max")))
    return F.array(*rows)


def code_zones(width: Column, height: Column) -> Column:
    cut = lambda size, part: F.floor(size * part)
    zones = _zone_rows(CODE_ZONES, lambda _n, x0, y0, x1, y1: (
        cut(width, x0), cut(height, y0), cut(width, x1), cut(height, y1)))
    return F.filter(zones, lambda z: (z.x_max > z.x_min) & (z.y_max > z.y_min))


def reading_zones(width: Column, height: Column) -> Column:
    """Six overlapping zones; tiny ones and ones of an already seen size are dropped."""
    low = lambda size, part: F.greatest(F.lit(0.0), F.least(size - 1.0, F.rint(size * part)))
    high = lambda size, part: F.greatest(F.lit(0.0), F.least(size * 1.0, F.rint(size * part)))
    zones = _zone_rows(READING_ZONES, lambda _n, x0, y0, x1, y1: (
        low(width, x0), low(height, y0), high(width, x1), high(height, y1)))
    big = F.filter(zones, lambda z: (z.x_max - z.x_min >= 18) & (z.y_max - z.y_min >= 18))
    same = lambda a, b: ((a.x_max - a.x_min == b.x_max - b.x_min)
                         & (a.y_max - a.y_min == b.y_max - b.y_min))
    distinct = F.filter(big, lambda z: (z.zone == "full") | ~F.exists(
        big, lambda o: (o.zone_no < z.zone_no) & same(o, z)))
    whole = F.filter(zones, lambda z: z.zone == "full")
    return F.when((width < 24) | (height < 24), whole).otherwise(distinct)


def fusion_zones(width: Column, height: Column) -> Column:
    """Whole crop plus five cuts, each cut at least 8 pixels wide and high."""
    def cut(size, part):
        inner = F.greatest(F.lit(1.0), F.least(size - 1.0, F.floor(size * part).cast("double")))
        return F.lit(0.0) if part == 0 else size * 1.0 if part == 1 else inner
    zones = _zone_rows(FUSION_ZONES, lambda _n, x0, y0, x1, y1: (
        cut(width, x0), cut(height, y0), cut(width, x1), cut(height, y1)))
    cuts = F.filter(zones, lambda z: (z.zone == "full")
                    | ((z.x_max - z.x_min >= 8) & (z.y_max - z.y_min >= 8)))
    whole = F.filter(zones, lambda z: z.zone == "full")
    return F.when((width < 12) | (height < 12), whole).otherwise(cuts)


def region(width: Column, height: Column, x0: float, y0: float, x1: float, y1: float) -> Box:
    """Sub-region of a crop from fractional coordinates, whole pixels."""
    whole = lambda c: F.floor(c).cast("double")
    return Box(F.greatest(F.lit(0.0), whole(x0 * width)), F.greatest(F.lit(0.0), whole(y0 * height)),
               F.least(width * 1.0, whole(x1 * width)), F.least(height * 1.0, whole(y1 * height)))
