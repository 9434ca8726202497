"""Annotation boxes and label strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def normalized_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Centre and size as shares of the frame. The corner moves into the frame without shortening the box, which is then cut at the far side."""
    x, y = F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y)
    w, h = F.least(w, width - x), F.least(h, height - y)
    parts = {"xc": (x + w / 2) / width, "yc": (y + h / 2) / height, "w": w / width, "h": h / height}
    return F.struct(*[_clamp(v, 0.0, 1.0).alias(k) for k, v in parts.items()])


def normalized_box_unclipped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The same without cutting, held within [0.001, 0.999]."""
    parts = {"xc": (x + w / 2) / width, "yc": (y + h / 2) / height, "w": w / width, "h": h / height}
    return F.struct(*[_clamp(v, 0.001, 0.999).alias(k) for k, v in parts.items()])


def label_line(box: Column, cls: int = 0) -> Column:
    return F.format_string(f"{cls} %.6f %.6f %.6f %.6f", box["xc"], box["yc"], box["w"], box["h"])


def stem(path: Column) -> Column:
    """A path's last part without its suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def folder(path: Column) -> Column:
    """The name of the folder that a path's last part is in."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]+$", 1)


def city_image_name(city: Column, stem: Column) -> Column:
    """City first, so that names don't clash; the stem of the annotation becomes that of the image."""
    return F.concat(city, F.lit("_"), F.regexp_replace(stem, "_gtBboxCityPersons", "_leftImg8bit"), F.lit(".png"))


def mode_image_name(mode: str | Column, city: Column, stem: Column) -> Column:
    """Mode, city and stem, without a suffix: it is the found image's."""
    return F.concat_ws("_", F.lit(mode) if isinstance(mode, str) else mode, city, stem)


def has_suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0)).isin(*suffixes)


def rotation_number(name: Column) -> Column:
    """The number in dataset_rotN; 9999 if there is none."""
    return F.coalesce(F.regexp_extract(name, r"dataset_rot([0-9]+)", 1).try_cast("int"), F.lit(9999))


def stepped_rate(rate: float, epoch: Column, step: int = 10, factor: float = 0.5) -> Column:
    return F.lit(rate) * F.pow(F.lit(factor), F.floor(epoch / step))
