"""Static facts about blocks: names, classes, ground weights, expected tile entities, items."""

from __future__ import annotations

LAST_ID = 175
AIR, STONE, SPAWNER, CHEST, COMMAND = 0, 1, 52, 54, 137
HOLE_BIT = 0x10

# The names of the numbers; numbers that are not here are unused.
WORDS = {
    0: "air", 1: "smooth_stone", 2: "grass", 3: "dirt", 4: "cobblestone", 5: "wood_planks", 6: "sapling", 7: "bedrock", 8: "water",
    9: "stationary_water", 10: "lava", 11: "stationary_lava", 12: "sand", 13: "gravel", 14: "gold_ore", 15: "iron_ore", 16: "coal_ore", 17: "log",
    18: "leaves", 19: "sponge", 20: "glass", 21: "lapis_lazuli_ore", 22: "lapis_lazuli_block", 23: "dispenser", 24: "sandstone", 25: "note_block",
    26: "bed", 27: "powered_rail", 28: "detector_rail", 29: "sticky_piston", 30: "cobweb", 31: "tall_grass", 32: "dead_shrubs", 33: "piston",
    34: "piston_head", 35: "cloth", 36: "moving_piston", 37: "yellow_flower", 38: "flower", 39: "brown_mushroom", 40: "red_mushroom",
    41: "gold_block", 42: "iron_block", 43: "double_slab", 44: "single_slab", 45: "brick", 46: "tnt", 47: "bookshelf", 48: "mossy_cobblestone",
    49: "obsidian", 50: "torch", 51: "fire", 52: "mob_spawner", 53: "wooden_stairs", 54: "chest", 55: "redstone_wire", 56: "diamond_ore",
    57: "diamond_block", 58: "workbench", 59: "crops", 60: "soil", 61: "furnace", 62: "burning_furnace", 63: "sign_post", 64: "wooden_door",
    65: "ladder", 66: "rail", 67: "cobblestone_stairs", 68: "wall_sign", 69: "lever", 70: "stone_pressure_plate", 71: "iron_door",
    72: "wooden_pressure_plate", 73: "redstone_ore", 74: "glowing_redstone_ore", 75: "redstone_torch_off", 76: "redstone_torch_on",
    77: "stone_button", 78: "snow", 79: "ice", 80: "snow_block", 81: "cactus", 82: "clay", 83: "reed", 84: "jukebox", 85: "fence", 86: "pumpkin",
    87: "netherrack", 88: "soul_sand", 89: "glowstone", 90: "portal", 91: "jack_o_lantern", 92: "cake", 93: "redstone_repeater_off",
    94: "redstone_repeater_on", 95: "stained_glass", 96: "trapdoor", 97: "stone_with_silverfish", 98: "stone_brick", 99: "huge_brown_mushroom",
    100: "huge_red_mushroom", 101: "iron_bars", 102: "glass_pane", 103: "watermelon", 104: "pumpkin_stem", 105: "melon_stem", 106: "vines",
    107: "gate", 108: "brick_stairs", 109: "stone_brick_stairs", 110: "mycelium", 111: "lily_pad", 112: "nether_brick", 113: "nether_brick_fence",
    114: "nether_brick_stairs", 115: "nether_wart", 116: "enchantment_table", 117: "brewing_stand", 118: "cauldron", 119: "end_portal",
    120: "end_portal_frame", 121: "end_stone", 122: "dragon_egg", 123: "redstone_lamp_off", 124: "redstone_lamp_on", 125: "wooden_double_slab",
    126: "wooden_single_slab", 127: "cocoa_pod", 128: "sandstone_stairs", 129: "emerald_ore", 130: "ender_chest", 131: "tripwire_hook",
    132: "tripwire", 133: "emerald_block", 134: "spruce_wood_stairs", 135: "birch_wood_stairs", 136: "jungle_wood_stairs", 137: "command_block",
    138: "beacon", 139: "cobblestone_wall", 140: "flower_pot", 141: "carrots", 142: "potatoes", 143: "wooden_button", 144: "head", 145: "anvil",
    146: "trapped_chest", 147: "gold_pressure_plate", 148: "iron_pressure_plate", 149: "redstone_comparator_off", 150: "redstone_comparator_on",
    151: "daylight_sensor", 152: "redstone_block", 153: "nether_quartz_ore", 154: "hopper", 155: "quartz_block", 156: "quartz_stairs",
    157: "activator_rail", 158: "dropper", 159: "stained_clay", 160: "stained_glass_pane", 170: "hay_block", 171: "carpet", 172: "hardened_clay",
    173: "coal_block", 174: "packed_ice", 175: "double_plant",
}

# The numbers of each class of blocks.
CLASSES = {
    "opaque": frozenset({
        1, 2, 3, 4, 5, 7, 12, 13, 14, 15, 16, 17, 19, 21, 22, 23, 24, 25, 35, 41, 42, 43, 45, 46, 47, 48, 49, 56, 57, 58, 61, 62, 73, 74, 80, 82, 84,
        86, 87, 88, 91, 97, 98, 99, 100, 103, 110, 112, 121, 123, 124, 125, 129, 133, 137, 152, 153, 155, 158, 159, 170, 172, 173, 174,
    }),
    "transparent": frozenset({
        0, 18, 20, 29, 33, 44, 52, 53, 60, 67, 89, 95, 108, 109, 114, 120, 122, 126, 128, 134, 135, 136, 138, 156,
    }),
    "liquid": frozenset({
        8, 9, 10, 11,
    }),
    "item": frozenset({
        6, 26, 27, 28, 30, 31, 32, 34, 36, 37, 38, 39, 40, 50, 51, 54, 55, 59, 63, 64, 65, 66, 68, 69, 70, 71, 72, 75, 76, 77, 78, 79, 81, 83, 85,
        90, 92, 93, 94, 96, 101, 102, 104, 105, 106, 107, 111, 113, 115, 116, 117, 118, 119, 127, 130, 131, 132, 139, 140, 141, 142, 143, 144, 145,
        146, 147, 148, 149, 150, 151, 154, 157, 160, 171, 175,
    }),
    "tile_entity": frozenset({
        23, 25, 36, 52, 54, 61, 62, 63, 68, 84, 116, 117, 119, 130, 137, 138, 144, 146, 149, 150, 151, 154, 158,
    }),
    "power_source": frozenset({
        28, 54, 61, 69, 70, 72, 75, 76, 77, 131, 143, 146, 147, 148, 149, 150, 151, 152, 154, 158,
    }),
    "power_sink": frozenset({
        23, 25, 27, 46, 55, 64, 66, 71, 75, 76, 107, 123, 124, 137, 149, 150, 154, 157, 158,
    }),
    "vegetable": frozenset({
        6, 17, 18, 31, 32, 37, 38, 39, 40, 59, 81, 83, 86, 99, 100, 103, 104, 105, 106, 111, 115, 127, 141, 142, 175,
    }),
    "ore": frozenset({
        14, 15, 16, 21, 56, 73, 74, 129, 153,
    }),
    "rail": frozenset({
        27, 28, 66, 157,
    }),
    "piston": frozenset({
        29, 33, 34,
    }),
    "stair": frozenset({
        53, 67, 108, 109, 114, 128, 134, 135, 136, 156,
    }),
}
PRIMARY = ("opaque", "transparent", "liquid", "item")

# The weights of the ground test, and the numbers that have each.
_WEIGHTS = {
    -10: (
        151,
    ),
    -8: (
        0, 6, 18, 26, 27, 28, 31, 32, 37, 38, 50, 51, 55, 59, 63, 64, 65, 66, 68, 69, 70, 71, 72, 75, 76, 77, 78, 81, 83, 85, 92, 93, 94, 95, 96, 99,
        100, 104, 105, 106, 107, 111, 113, 115, 116, 117, 118, 119, 122, 123, 124, 127, 131, 132, 133, 138, 139, 140, 141, 142, 143, 144, 145, 147,
        148, 149, 150, 154, 157, 160, 170, 171, 175,
    ),
    -6: (
        17, 120, 152,
    ),
    -4: (
        23, 25, 29, 33, 34, 36, 47, 52, 54, 58, 61, 62, 84, 86, 90, 91, 101, 102, 103, 130, 137, 146, 158,
    ),
    -2: (
        4, 5, 20, 22, 24, 35, 41, 42, 45, 46, 53, 57, 67, 80, 98, 108, 109, 112, 114, 128, 134, 135, 136, 155, 156, 159, 172, 173,
    ),
    -1: (
        89,
    ),
    0: (
        19, 30, 44, 48, 49, 126, 161, 162, 163, 164, 165, 166, 167, 168, 169,
    ),
    1: (
        8, 39, 40,
    ),
    2: (
        9, 10, 43, 79, 82, 125, 174,
    ),
    4: (
        1, 11,
    ),
    6: (
        2, 3, 12, 13, 60, 87, 88, 110, 121,
    ),
    8: (
        7, 14, 15, 16, 21, 56, 73, 74, 97, 129, 153,
    ),
}

#: Name by id; ids without a block have none.
NAMES = {i: w.replace("_", " ").capitalize() for i, w in WORDS.items()}
ID = {w: i for i, w in WORDS.items()}
UNUSED = frozenset(range(LAST_ID + 1)) - frozenset(WORDS)
WEIGHTS = {i: w for w, ids in _WEIGHTS.items() for i in ids}

# Type that a block's tile entity must have.
TILE_ENTITIES = {
    ID["dispenser"]: "Trap",
    ID["moving_piston"]: "Piston",
    ID["note_block"]: "Music",
    ID["mob_spawner"]: "Monster Spawner",
    ID["chest"]: "Chest",
    ID["trapped_chest"]: "Chest",
    ID["furnace"]: "Furnace",
    ID["burning_furnace"]: "Furnace",
    ID["sign_post"]: "Sign",
    ID["wall_sign"]: "Sign",
    ID["jukebox"]: "RecordPlayer",
    ID["enchantment_table"]: "EnchantTable",
    ID["brewing_stand"]: "Cauldron",
    ID["end_portal"]: "Airportal",
    ID["ender_chest"]: "EnderChest",
    ID["command_block"]: "Control",
    ID["beacon"]: "Beacon",
    ID["head"]: "Skull",
    ID["redstone_comparator_off"]: "Comparator",
    ID["redstone_comparator_on"]: "Comparator",
    ID["daylight_sensor"]: "DLDetector",
    ID["hopper"]: "Hopper",
    ID["dropper"]: "Dropper",
}

# Item names by number.
ITEMS = {
    256: "Iron Shovel", 257: "Iron Pickaxe", 258: "Iron Axe", 259: "Flint and Steel", 260: "Red Apple", 261: "Bow", 262: "Arrow", 263: "Coal",
    264: "Diamond", 265: "Iron Ingot", 266: "Gold Ingot", 267: "Iron Sword", 268: "Wooden Sword", 269: "Wooden Shovel", 270: "Wooden Pickaxe",
    271: "Wooden Axe", 272: "Stone Sword", 273: "Stone Shovel", 274: "Stone Pickaxe", 275: "Stone Axe", 276: "Diamond Sword", 277: "Diamond Shovel",
    278: "Diamond Pickaxe", 279: "Diamond Axe", 280: "Stick", 281: "Bowl", 282: "Mushroom Soup", 283: "Gold Sword", 284: "Gold Shovel",
    285: "Gold Pickaxe", 286: "Gold Axe", 287: "String", 288: "Feather", 289: "Gunpowder", 290: "Wooden Hoe", 291: "Stone Hoe", 292: "Iron Hoe",
    293: "Diamond Hoe", 294: "Gold Hoe", 295: "Seeds", 296: "Wheat", 297: "Bread", 298: "Cap", 299: "Leather Tunic", 300: "Leather Pants",
    301: "Leather Boots", 302: "Chain Helmet", 303: "Chain Chestplate", 304: "Chain Leggings", 305: "Chain Boots", 306: "Iron Helmet",
    307: "Iron Chestplate", 308: "Iron Leggings", 309: "Iron Boots", 310: "Diamond Helmet", 311: "Diamond Chestplate", 312: "Diamond Leggings",
    313: "Diamond Boots", 314: "Gold Helmet", 315: "Gold Chestplate", 316: "Gold Leggings", 317: "Gold Boots", 318: "Flint", 319: "Raw Porkchop",
    320: "Cooked Porkchop", 321: "Paintings", 322: "Golden Apple", 323: "Sign", 324: "Wooden door", 325: "Bucket", 326: "Water bucket",
    327: "Lava bucket", 328: "Minecart", 329: "Saddle", 330: "Iron door", 331: "Redstone", 332: "Snowball", 333: "Boat", 334: "Leather", 335: "Milk",
    336: "Clay Brick", 337: "Clay", 338: "Sugar Cane", 339: "Paper", 340: "Book", 341: "Slimeball", 342: "Minecart with Chest",
    343: "Minecart with Furnace", 344: "Egg", 345: "Compass", 346: "Fishing Rod", 347: "Clock", 348: "Glowstone Dust", 349: "Raw Fish",
    350: "Cooked Fish", 351: "Dye", 352: "Bone", 353: "Sugar", 354: "Cake", 355: "Bed", 356: "Redstone Repeater", 357: "Cookie", 358: "Map",
    359: "Shears", 360: "Melon (Slice)", 361: "Pumpkin Seeds", 362: "Melon Seeds", 363: "Raw Beef", 364: "Steak", 365: "Raw Chicken",
    366: "Cooked Chicken", 367: "Rotten Flesh", 368: "Ender Pearl", 369: "Blaze Rod", 370: "Ghast Tear", 371: "Gold Nugget", 372: "Nether Wart",
    373: "Potion", 374: "Glass Bottle", 375: "Spider Eye", 376: "Fermented Spider Eye", 377: "Blaze Powder", 378: "Magma Cream",
    379: "Brewing Stand", 380: "Cauldron", 381: "Eye of Ender", 382: "Glistering Melon", 2256: "13 Disc", 2257: "Cat Disc", 2258: "blocks Disc",
    2259: "chirp Disc", 2260: "far Disc", 2261: "mall Disc", 2262: "mellohi Disc", 2263: "stal Disc", 2264: "strad Disc", 2265: "ward Disc",
    2266: "11 Disc",
}
