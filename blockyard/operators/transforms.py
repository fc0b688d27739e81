"""Moves, flips and rotations of stores, and chains of them.

Each takes a sparse store (ground level 0) and returns a new one.  The cuboid
round the store is one aggregation; with ``by`` it is joined to each store's
rows, so many stores are turned at once.  Flips and rotations also change the
cells (which way a torch faces, and so on).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import transformed
from ..functions.extents import Box
from .store import box_of, copy_region, drop_empty, extents, shifted


def _boxed(store: DataFrame, by: Sequence[str], box: Box | None = None) -> DataFrame:
    """The non-empty rows with their store's cuboid in ``_e``; ``box`` if the caller knows it."""
    rows = drop_empty(store)
    if by:
        return rows.join(extents(rows, by=by).withColumnRenamed("extents", "_e"), list(by))
    return rows.withColumn("_e", (box_of(rows) if box is None else box).column())


def _turned(store: DataFrame, by: Sequence[str], x, z, operation: str, box: Box | None) -> DataFrame:
    e = F.col("_e")
    rows = _boxed(store, by, box).withColumns({"_x": x(e), "_z": z(e)})
    rows = rows.withColumns({"x": F.col("_x"), "z": F.col("_z")}).select(*store.columns)
    return transformed(rows, operation)


def _back(c: str, e) -> F.Column:
    s = c.upper()
    return e[f"max{s}"] - (F.col(c) - e[f"min{s}"])


def move(store: DataFrame, x: int = 0, y: int = 0, z: int = 0) -> DataFrame:
    """``x`` steps to the west, ``y`` to the south and ``z`` upward, as the command's manual says."""
    return shifted(drop_empty(store), -x, z, y)


def flip_x(store: DataFrame, by: Sequence[str] = (), box: Box | None = None) -> DataFrame:
    """Mirror along z; the axis has an older convention's name.  Cells are flipped east to west."""
    return _turned(store, by, lambda e: F.col("x"), lambda e: _back("z", e), "flip_east_west", box)


def flip_y(store: DataFrame, by: Sequence[str] = (), box: Box | None = None) -> DataFrame:
    """Mirror along x; cells are flipped north to south."""
    return _turned(store, by, lambda e: _back("x", e), lambda e: F.col("z"), "flip_north_south", box)


def rotate_180(store: DataFrame, by: Sequence[str] = (), box: Box | None = None) -> DataFrame:
    return _turned(store, by, lambda e: _back("x", e), lambda e: _back("z", e), "rotate_180", box)


def rotate_right(store: DataFrame, by: Sequence[str] = (), box: Box | None = None) -> DataFrame:
    """A quarter turn clockwise: z' = x, x' from z."""
    return _turned(store, by, lambda e: _back("z", e), lambda e: F.col("x"), "rotate_clockwise", box)


def rotate_left(store: DataFrame, by: Sequence[str] = (), box: Box | None = None) -> DataFrame:
    """A quarter turn the other way: x' = z, z' from x."""
    return _turned(store, by, lambda e: F.col("z"), lambda e: _back("x", e), "rotate_anticlockwise", box)


def trim(store: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The store moved so that its cuboid begins at the origin."""
    rows, e = _boxed(store, by), F.col("_e")
    return rows.withColumns({c: F.col(c) - e[f"min{c.upper()}"] for c in "xyz"}).select(*store.columns)


def load_over(store: DataFrame, other: DataFrame) -> DataFrame:
    """Another store's non-air cells over this one, at the origin."""
    return copy_region(store, other, box_of(other), (0, 0, 0))


#: Command name and one-letter form, function, number of whole-number arguments.
COMMANDS: dict[str, tuple[str, Callable[..., DataFrame], int]] = {
    "move": ("m", move, 3),
    "flipx": ("x", flip_x, 0),
    "flipy": ("y", flip_y, 0),
    "rot180": ("u", rotate_180, 0),
    "rotr": ("r", rotate_right, 0),
    "rotl": ("l", rotate_left, 0),
}


def _moved_box(name: str, box: Box, args: Sequence[int]) -> Box:
    """The cuboid after a command: flips and half turns keep it, quarter turns swap x and z."""
    if name == "move":
        x, y, z = args
        return box.offset(-x, z, y)
    return Box(box.minZ, box.maxZ, box.minY, box.maxY, box.minX, box.maxX) if name in ("rotr", "rotl") else box


def run_commands(store: DataFrame, words: Sequence[str], load: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """The store after a chain like ``["--rotr", "--move", "1", "0", "0", "--in", "file"]``, not yet trimmed.

    A command may be written ``--name``, ``-letter`` or ``name``.  ``load`` opens
    what ``in`` names.  A missing argument or an unknown command raises.  The
    cuboid is measured once, and again after ``in``; commands carry it along.
    """
    short = {v[0]: k for k, v in COMMANDS.items()} | {"i": "in"}
    i, box = 0, None
    while i < len(words):
        word = words[i]
        name = short.get(word[1:], "") if word[:1] == "-" and word[:2] != "--" else word.removeprefix("--")
        if name == "in":
            if load is None or i + 1 >= len(words):
                raise ValueError("in needs a file")
            store, box, i = load_over(store, load(words[i + 1])), None, i + 2
            continue
        if name not in COMMANDS:
            raise ValueError(f"unknown command {word!r}")
        _, f, n = COMMANDS[name]
        rest = words[i + 1 : i + 1 + n]
        if len(rest) < n:
            raise ValueError(f"{name} needs {n} arguments")
        args = [int(r) for r in rest]
        if name == "move":
            store = f(store, *args)
        else:
            box = box_of(store) if box is None else box
            store = f(store, box=box)
        box, i = box and _moved_box(name, box, args), i + 1 + n
    return store
