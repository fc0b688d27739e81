"""Values of cells typed by hand: facings, turns and texts, apart from the library's tables."""

import pytest

from blockyard.functions import blocks, cells, describe

# id: data of north, south, east, west (None: cannot face so).  Public block data values.
FACES = {
    50: (4, 3, 1, 2), 75: (4, 3, 1, 2), 76: (4, 3, 1, 2),  # torches hang on the wall behind them
    69: (4, 3, 1, 2), 77: (4, 3, 1, 2), 143: (4, 3, 1, 2),  # levers and buttons
    64: (3, 1, 2, 0), 71: (3, 1, 2, 0), 107: (3, 1, 2, 0),  # doors and gates
    53: (3, 2, 0, 1), 67: (3, 2, 0, 1), 108: (3, 2, 0, 1), 109: (3, 2, 0, 1), 114: (3, 2, 0, 1), 128: (3, 2, 0, 1), 134: (3, 2, 0, 1), 135: (3, 2, 0, 1), 136: (3, 2, 0, 1),  # stairs
    54: (2, 3, 5, 4), 65: (2, 3, 5, 4), 68: (2, 3, 5, 4), 61: (2, 3, 5, 4), 62: (2, 3, 5, 4), 23: (2, 3, 5, 4), 130: (2, 3, 5, 4),  # chests, ladders, wall signs, furnaces, dispensers
    86: (2, 0, 1, 3), 91: (2, 0, 1, 3),  # pumpkins
    26: (0, 2, 1, 3), 93: (0, 2, 1, 3), 94: (0, 2, 1, 3), 120: (0, 2, 1, 3), 127: (0, 2, 1, 3),  # beds, repeaters, portal frames, cocoa
    33: (2, 3, 5, 4), 29: (2, 3, 5, 4), 34: (2, 3, 5, 4),  # pistons
    96: (0, 1, 3, 2),  # trap doors
    131: (2, 0, 3, 1),  # tripwire hooks
}
WAYS = ("north", "south", "east", "west")
#: Bits that say nothing of the direction, set on the way.
SPARE = {50: 8, 75: 8, 76: 8, 69: 8, 77: 8, 143: 8, 64: 12, 71: 12, 107: 4, 53: 4, 26: 8, 93: 12, 94: 12, 33: 8, 29: 8, 34: 8, 96: 4, 131: 12, 127: 12, 120: 4}


@pytest.mark.parametrize("block", sorted(FACES))
def test_facings_and_turns_by_hand(block):
    north, south, east, west = FACES[block]
    for extra in {0, SPARE.get(block, 0)}:
        data = dict(zip(WAYS, (v | extra for v in (north, south, east, west))))
        for way, d in data.items():
            assert cells.facing(block, d) == way and cells.turned_to(block, data["north"], way) == d
        for way, turned in zip(WAYS, ("east", "west", "south", "north")):
            assert cells.rotate(block, data[way], 1) == data[turned]
        for way, turned in zip(WAYS, ("west", "east", "north", "south")):
            assert cells.rotate(block, data[way], 3) == data[turned]
        for way, other in zip(WAYS, ("south", "north", "west", "east")):
            assert cells.rotate(block, data[way], 2) == data[other]
        assert cells.flip(block, data["north"], "ns") == data["south"] and cells.flip(block, data["north"], "ew") == data["north"]
        assert cells.flip(block, data["east"], "ew") == data["west"] and cells.flip(block, data["east"], "ns") == data["east"]


def test_every_family_has_values_by_hand():
    assert set(FACES) == set(cells.FAMILY)


def test_cells_that_turn_in_other_ways():
    assert [cells.rotate(66, d, 1) for d in range(10)] == [1, 0, 5, 4, 2, 3, 7, 8, 9, 6]
    assert [cells.rotate(27, 8 + d, 1) for d in range(6)] == [9, 8, 13, 12, 10, 11]  # powered stays powered
    assert cells.rotate(63, 14, 1) == 2 and cells.rotate(63, 3, 2) == 11 and cells.rotate(63, 3, 3) == 15
    assert cells.rotate(17, 5, 1) == 9 and cells.rotate(17, 9, 3) == 5 and cells.rotate(17, 5, 2) == 5 and cells.rotate(17, 1, 1) == 1
    assert cells.rotate(69, 5, 1) == 6 and cells.rotate(69, 6 | 8, 3) == 5 | 8 and cells.rotate(69, 5, 2) == 5
    assert cells.rotate(33, 0, 1) == 0 and cells.rotate(33, 1, 2) == 1 and cells.rotate(1, 7, 1) == 7


def test_texts_by_hand():
    said = {(b, d): text for b, d, text, _ in describe.details()}
    want = {
        (8, 0): "level 8", (10, 3): "level 5", (17, 1): "conifer", (18, 6): "birch, permanent", (26, 8): "head", (26, 1): "foot", (27, 8): "powered", (31, 2): "fern", (35, 14): "red", (43, 3): "cobblestone", (44, 1): "sandstone",
        (60, 0): "dry", (60, 7): "wetness 7", (55, 0): "off", (55, 9): "power level 9", (64, 13): "top, open", (71, 2): "bottom, closed", (69, 9): "on", (77, 1): "off", (70, 1): "on", (72, 0): "off",
        (76, 5): "on, standing", (75, 1): "off", (92, 2): "4 slices", (94, 12): "on, delay: 4", (93, 0): "off, delay: 1", (96, 4): "open", (107, 0): "closed", (97, 1): "Cobblestone", (131, 12): "active", (131, 4): "connected",
        (131, 0): "disconnected", (132, 4): "live", (140, 9): "cactus", (123, 0): "off", (124, 0): "on", (62, 3): "burning", (74, 0): "glowing",
    }
    assert {k: said.get(k) for k in want} == want


def test_facts_by_hand():
    names = {0: "Air", 1: "Smooth stone", 7: "Bedrock", 54: "Chest", 76: "Redstone torch on", 137: "Command block", 175: "Double plant"}
    assert {i: blocks.NAMES[i] for i in names} == names and 161 not in blocks.NAMES
    items = {256: "Iron Shovel", 264: "Diamond", 331: "Redstone", 382: "Glistering Melon", 2256: "13 Disc", 2266: "11 Disc"}
    assert {i: blocks.ITEMS[i] for i in items} == items and len(blocks.ITEMS) == 127 + 11
    assert blocks.TILE_ENTITIES[52] == "Monster Spawner" and blocks.TILE_ENTITIES[158] == "Dropper" and 1 not in blocks.TILE_ENTITIES
    weights = {1: 4, 7: 8, 0: -8, 17: -6, 20: -2, 89: -1, 9: 2, 12: 6, 151: -10}
    assert {i: blocks.WEIGHTS[i] for i in weights} == weights
    for kind, some in {"opaque": (1, 3, 49), "transparent": (0, 20, 54 - 1), "liquid": (8, 11), "item": (6, 50, 54), "ore": (14, 129), "rail": (27, 157), "piston": (29, 34), "stair": (53, 156)}.items():
        assert all(i in blocks.CLASSES[kind] for i in some)
