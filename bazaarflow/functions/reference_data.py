"""Names, aliases and codes that results depend on."""

# Official districts.
DISTRICTS = [
    "Kampala", "Wakiso", "Mukono", "Jinja", "Gulu", "Mbarara", "Mbale", "Lira", "Soroti", "Masaka", "Hoima", "Arua",
    "Kabale", "Kasese", "Fort Portal", "Masindi", "Luwero", "Mpigi", "Iganga", "Tororo", "Kumi", "Kitgum", "Nebbi",
    "Bushenyi", "Kabarole", "Bundibugyo", "Kalangala", "Mityana", "Kayunga", "Nakasongola", "Kiboga", "Sembabule",
    "Rakai", "Isingiro", "Kiruhura", "Lyantonde", "Mbarara City", "Gulu City", "Jinja City", "Mbale City",
    "Arua City", "Entebbe",
]

# Spellings of each district, lower case.
DISTRICT_ALIASES = {
    "Kampala": ["kampala", "kla", "kampala city", "kampala-city", "kampala district", "kampala region", "kampala (central)"],
    "Jinja": ["jinja", "jinjja", "jinja town", "jinja district", "jinji", "jinja city"],
    "Mbarara": ["mbarara", "mbaraa", "mbararra", "mbarara city", "mbarara town"],
    "Gulu": ["gulu", "gulu city", "gullu", "gulu district", "guluu"],
    "Wakiso": ["wakiso", "wakiso district", "wakisio"],
    "Entebbe": ["entebbe", "enteba", "entebbe city"],
    "Mukono": ["mukono", "mukko", "mukkono"],
    "Masaka": ["masaka", "masacka"],
    "Mbale": ["mbale", "mballa"],
    "Lira": ["lira", "lira district"],
    "Kabale": ["kabale", "kabale district"],
    "Hoima": ["hoima", "homa"],
    "Arua": ["arua", "arua city"],
    "Soroti": ["soroti", "soroti district"],
    "Fort Portal": ["fort portal", "fortportal", "fort-portal", "kabarole", "kabarole district"],
    "Kasese": ["kasese", "kisese"],
    "Luwero": ["luwero", "luweero", "luwero district"],
    "Iganga": ["iganga", "iganga town"],
    "Tororo": ["tororo", "torroro"],
    "Bushenyi": ["bushenyi", "bushenyi district"],
    "Masindi": ["masindi", "masindi district"],
    "Mpigi": ["mpigi", "mpigi district"],
    "Mityana": ["mityana", "mityanna"],
}

# Unit labels; those of CONVERTED need their amounts scaled at the source.
UNITS = {
    "kg": ["kg", "kgs", "kilogram", "kilograms", "kilo", "g", "gram", "grams", "gm", "gms"],
    "pcs": ["pcs", "piece", "pieces", "pc", "pce", "unit", "units", "boxes", "bottle", "bottles", "pack", "packs"],
    "liters": ["liters", "litre", "litres", "l", "ml"],
}
CONVERTED = ["g", "gram", "grams", "gm", "gms", "ml"]

# Category labels.
CATEGORIES = {
    "Beverages": ["beverages", "beverage", "bvages", "bevages"],
    "Grains & Cereals": ["grains & cereals", "grains", "grains and cereals", "grains&cereals", "grains & cereal"],
    "Snacks": ["snacks", "snack", "sncks"],
    "Household": ["household", "house hold", "household items", "houshold"],
    "Personal Care": ["personal care", "percare", "personalcare"],
    "Stationery": ["stationery", "stationary", "statio nery"],
}

# Payment spellings, upper case.
PAYMENTS = {
    "MTN_MOMO": ["MTN MOMO", "MTN MOBILE MONEY", "MOMO"],
    "AIRTEL_MOMO": ["AIRTEL MONEY", "AIRTELMONEY"],
    "CARD": ["CARD"],
    "CASH": ["CASH"],
}
MOBILE_MONEY = ["MTN_MOMO", "AIRTEL_MOMO"]

# The online store stands alone.
ONLINE_STORE, ONLINE_CITY = "ECOM01", "E-commerce"


def spellings(table: dict[str, list[str]]) -> dict[str, str]:
    """Spelling to canonical value."""
    return {label: value for value, labels in table.items() for label in labels}
