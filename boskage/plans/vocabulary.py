"""Word lists and translations of the source inventories."""

# Damage types of the health reports that are kept, and those that are biotic.
DAMAGE_TYPES = (
    "Dégât d'origine entomologique",
    "Dégât d'origine pathologique",
    "Dégât dû à des végétaux",
    "Dégât d'origine abiotique",
    "Dégât d'origine sylvicole",
    "Dégât du à une pollution",
)
BIOTIC_TYPES = DAMAGE_TYPES[:3]

# Species groups of the health reports in English.
REPORT_SPECIES = {
    "Épicéas": "Spruces", "Chênes": "Oaks", "Sapins": "Firs", "Bouleaux": "Birches", "Pins": "Pines", "Douglas": "Douglas", "Charme": "Hornbeam",
    "Autres feuillus": "Other Broadleaves", "Fruitiers": "Fruit Trees", "Peupliers": "Poplars", "Hêtre": "Beech", "Mélèzes": "Larches", "Frênes": "Ash Trees",
    "Cèdres": "Cedars", "Tremble": "Aspen", "Saules": "Willows", "Ormes": "Elms", "Châtaignier": "Chestnut", "Érables": "Maples", "Arbustes": "Shrubs",
    "Aulnes": "Alders", "Noyers": "Walnuts", "Autres résineux": "Other Conifers", "Taxodiacées": "Taxodiaceae (a family of coniferous trees)", "Tilleuls": "Lindens",
}
REPORT_TREES = {"Conifère": "conifer", "Feuillu": "broadleaf"}

# Classes of the cause raster.
RASTER_CAUSES = {1: "Storm,Biotic", 2: "Fire", 3: "Other"}

# Forest types of the forest map in English.
FOREST_TYPES = {
    "Pin maritime": "Maritime Pine", "Mixte": "Mixed", "Feuillus": "Broadleaf", "Pins mélangés": "Mixed Pines", "NR": "NR", "Conifères": "Conifers",
    "Sapin, épicéa": "Fir, Spruce", "Peuplier": "Poplar", "Douglas": "Douglas", "Pin sylvestre": "Scots Pine", "Châtaignier": "Chestnut",
    "Chênes décidus": "Deciduous Oaks", "Pin laricio, pin noir": "Laricio Pine, Black Pine", "Mélèze": "Larch", "Pin autre": "Other Pine", "Hêtre": "Beech",
    "Robinier": "Black Locust", "Pin d'Alep": "Aleppo Pine", "Chênes sempervirents": "Evergreen Oaks", "Pin à crochets, pin cembro": "Hooked Pine, Swiss Pine",
}

# Words of English tree names that tell the tree type, in the order they are tried.
TREE_WORDS = {
    "Broadleaf": [
        "Alder", "Almond", "Apple", "Apricot", "Ash", "Aspen", "Beech", "Birch", "Blackthorn", "Boxwood", "Buckthorn", "Caria", "Carob", "Catalpa",
        "Cherry", "Chestnut", "Dogwood", "Elder", "Elm", "Hackberry", "Hawthorn", "Hazel", "Heath", "Heaven", "Holly", "Hornbeam", "Laburnum",
        "Laurel", "Lebanon", "Lime", "Locust", "Maple", "Mimosa", "Mulberry", "Oak", "Oleaster", "Olive", "Orange", "Paulownia", "Pear", "Persimmon",
        "Pistachio", "Plane", "Plum", "Poplar", "Provence", "Quince", "Rowan", "Serviceberry", "Spindle", "Sumac", "Sweetgum", "Tamarisk", "Tree",
        "Walnut", "Willow", "anagyroides", "leaves", "Broadleaf",
    ],
    "Conifer": [
        "Arborvitae", "Cedar", "Cryptomeria", "Cypress", "Fir", "Hemlock", "Juniper", "Larch", "Pine", "Sequoia", "Spruce", "Yew", "Conifers",
    ],
    "Mixed": [
        "hybrids", "Hybrids", "Mixed",
    ],
}

# Tree types and English names of the species groups of the historical records.
RECORD_TREES = {
    "mixed": ("Conifers;Broadleaves", "Broadleaves and conifers (conifers: 51 to 89%)"),
    "conifer": ("Conifers", "Spruce", "Maritime pine", "Pinus maritima", "Pinus pinaster", "Fir", "Pines"),
    "broadleaf": ("Broadleaves", "Beech", "Oak", "Other broadleaves", "Quercus suber", "Fagus sylvatica", "Quercus spp."),
}
RECORD_SPECIES = {
    "Other broadleaves": "Other Broadleaves", "Maritime pine": "Maritime Pine", "Pinus maritima": "Maritime Pine", "Quercus suber": "Cork Oak", "Pinus pinaster": "Maritime Pine",
    "Broadleaves and conifers (conifers: 51 to 89%)": "Broadleaves and Conifers (conifers: 51 to 89%)", "Fagus sylvatica": "European Beech", "Quercus spp.": "Oaks",
}

# Codes of the forest inventory that speak for a class, strongly (weight 3) and weakly (weight 1).
STRONG = {
    "Fire": {"NINCID": ("1",)},
    "Storm": {"NINCID": ("3", "4")},
    "Biotic-dieback": {},
    "Biotic-mortality": {"NINCID": ("2",)},
    "Drought": {"NINCID": ("2",)},
    "Tree-logging": {"DC": tuple("123456789"), "PRELEV5": ("2",)},
}
WEAK = {
    "Fire": {"VEGET": ("5", "C"), "ACCI": ("4",), "OBSVEGET": ("1",)},
    "Storm": {"VEGET": ("A", "C", "T", "2", "1"), "ACCI": ("1", "2", "3"), "OBSVEGET": ("2",)},
    "Biotic-dieback": {"NINCID": ("5",), "OBSVEGET": ("6",), "MORTB": tuple("1234"), "DPYR": ("1", "2"), "SFGUI": tuple("123"), "SFCOEUR": ("1",), "SFDORGE": ("1", "2")},
    "Biotic-mortality": {"OBSVEGET": ("6",), "VEGET": ("5", "M"), "VEGET5": ("5", "M")},
    "Drought": {"HUMUS": ("42",), "OBSVEGET": ("6",), "MORTB": tuple("1234")},
    "Tree-logging": {"OBSVEGET": ("2", "3"), "VEGET": ("6", "7"), "VEGET5": ("6", "7"), "GEST": ("2",), "ELAG": ("1",), "PRELEV5": ("1",), "DEF5": tuple("12345")},
}
