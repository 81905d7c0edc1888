"""Names, lookup tables and constants that results depend on. Plain data only."""

# Column names that mark a role, in order of preference.
TIME_NAMES = (
    "timestamp", "datetime", "date_time", "date", "time", "ds", "reading_time", "utc_timestamp", "local_time",
)
ID_NAMES = (
    "bldg_id", "building_id", "buildingid", "building", "meter_id", "meterid", "meter", "house_id",
    "household_id", "house", "home_id", "lclid", "dataid", "customer_id", "user_id", "consumer_id", "id",
    "site_id", "unit",
)
VALUE_NAMES = (
    "energy", "kwh", "kw", "consumption", "load", "value", "power", "usage", "reading", "energy_kwh", "energy_kw",
)

# The same for exploratory reads, where a name may also be part of a longer one.
EDA_TIME_NAMES = ("timestamp", "datetime", "date_time", "time", "date", "ts")
EDA_ID_NAMES = (
    "building_id", "buildingid", "building", "meter_id", "customer", "customer_id", "house_id", "household_id",
    "id", "lclid", "dataid",
)
EDA_VALUE_NAMES = (
    "value", "energy", "consumption", "load", "kwh", "kw", "power", "energy_kwh", "power_kw", "mains", "aggregate",
)

# Daubechies-4 decomposition low-pass taps (public wavelet constants).
DB4_LOW = (
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
)

# Learning rate by epoch in the step schedule.
LR_STEPS = {2: 5e-5, 4: 1e-5, 6: 5e-6, 8: 1e-6, 10: 5e-7, 15: 1e-7, 20: 5e-8}

# Most windows one device may hold.
DEVICE_WINDOW_CAP = 10_091_558

# Data sets by sector and country; the last field tells whether data is present.
SUBSETS = (
    ("BDG-2", "Commercial", "EUA", True),
    ("Berkely", "Commercial", "EUA", True),
    ("CLEMD", "Commercial", "Malásia", True),
    ("CU-BEMS", "Commercial", "Tailândia", True),
    ("DGS", "Commercial", "EUA", True),
    ("Enernoc", "Commercial", "EUA", True),
    ("EWELD", "Commercial", "China", True),
    ("HB", "Commercial", "EUA", True),
    ("IBlend", "Commercial", "Índia", True),
    ("IOT", "Commercial", "Emirados Árabes", True),
    ("IPC-Commercial", "Commercial", "China", True),
    ("NEST-Commercial", "Commercial", "Suíça", True),
    ("PSS", "Commercial", "África do Sul", True),
    ("RKP", "Commercial", "Portugal", True),
    ("SEWA", "Commercial", "Emirados Árabes", True),
    ("SKC", "Commercial", "Coreia do Sul", True),
    ("UCIE", "Commercial", "Portugal", True),
    ("ULE", "Commercial", "Reino Unido", True),
    ("UNICON", "Commercial", "Austrália", True),
    ("ECRG-Commercial", "Commercial", "Polônia", False),
    ("AMPD", "Residential", "Canadá", True),
    ("BTS", "Residential", "Austrália", True),
    ("CEEW", "Residential", "Índia", True),
    ("DCB", "Residential", "Japão", True),
    ("DEDDIAG", "Residential", "Alemanha", True),
    ("DESM", "Residential", "França", True),
    ("DTH", "Residential", "Eslováquia", True),
    ("ECCC", "Residential", "Portugal", True),
    ("ECWM", "Residential", "México", True),
    ("ENERTALK", "Residential", "Coreia do Sul", True),
    ("fIEECe", "Residential", "EUA", True),
    ("GoiEner", "Residential", "Espanha", True),
    ("GREEND", "Residential", "Itália/Áustria", True),
    ("HONDA-Smart-Home", "Residential", "EUA", True),
    ("HSG", "Residential", "Alemanha", True),
    ("HUE", "Residential", "Canadá", True),
    ("iFlex", "Residential", "Noruega", True),
    ("IHEPC", "Residential", "França", True),
    ("IPC-Residential", "Residential", "China", True),
    ("IRH", "Residential", "Irlanda", True),
    ("LCL", "Residential", "Reino Unido", True),
    ("LEC", "Residential", "Portugal", True),
    ("MFRED", "Residential", "EUA", True),
    ("MIHEC", "Residential", "África do Sul", True),
    ("NDB", "Residential", "Reino Unido", True),
    ("NEST-Residential", "Residential", "Suíça", True),
    ("Norwegian", "Residential", "Noruega", True),
    ("PES", "Residential", "EUA", True),
    ("Plegma", "Residential", "Grécia", True),
    ("Prayas", "Residential", "Índia", True),
    ("REED", "Residential", "Costa Rica", True),
    ("REFIT", "Residential", "Reino Unido", True),
    ("RHC", "Residential", "Canadá", True),
    ("RSL", "Residential", "Sri Lanka", True),
    ("SFAC", "Residential", "China", True),
    ("SFHG", "Residential", "Alemanha", True),
    ("SGSC", "Residential", "Austrália", True),
    ("SMART-Star", "Residential", "EUA", True),
    ("SRSA", "Residential", "África do Sul", True),
    ("WED", "Residential", "México", True),
    ("METER", "Residential", "Reino Unido", False),
    ("SAVE", "Residential", "Reino Unido", False),
    ("HES", "Residential", "Reino Unido", False),
    ("UKST", "Residential", "Reino Unido", False),
    ("NEEA", "Residential", "EUA", False),
    ("ECRG-Residential", "Residential", "Polônia", False),
    ("NESEMP", "Residential", "Reino Unido", False),
)

# Countries held by each device.
DEVICE_COUNTRIES = {
    1: ("Espanha",),
    2: ("Austrália",),
    3: ("Reino Unido",),
    4: ("EUA", "China", "Eslováquia", "Alemanha", "Canadá", "Itália/Áustria", "Japão", "Irlanda", "Suíça",
        "México", "Malásia"),
    5: ("Noruega", "Portugal", "Sri Lanka", "Índia", "Tailândia", "África do Sul", "Coreia do Sul", "Grécia",
        "França", "Emirados Árabes", "Costa Rica"),
}

# Metadata spelling of an alias -> spelling in the data set table above.
ALIAS_SPELLING = {"flEECe": "fIEECe", "REEDD": "REED"}

# Approximate (lat, lon) of a country.
ISO_COORDS = {
    "USA": (39.8, -98.6), "IND": (22.4, 79.0), "CHN": (35.0, 103.8), "KOR": (36.4, 127.9),
    "CHE": (46.8, 8.2), "THA": (15.1, 101.0), "MYS": (3.8, 109.7), "PRT": (39.6, -8.0),
    "GBR": (54.0, -2.5), "ARE": (24.0, 54.0), "ZAF": (-29.0, 25.1), "POL": (52.1, 19.4),
    "AUS": (-25.7, 134.5), "DEU": (51.1, 10.4), "ESP": (40.2, -3.6), "IRL": (53.2, -8.1),
    "GRC": (39.1, 22.9), "JPN": (36.6, 138.0), "CAN": (56.1, -106.3), "ITA": (42.8, 12.1),
    "NOR": (64.6, 12.7), "FRA": (46.6, 2.5), "SVK": (48.7, 19.5), "MEX": (23.9, -102.5),
    "CRI": (9.9, -84.2), "LKA": (7.7, 80.7), "AUT": (47.6, 14.1),
}

# Fixed values: (lat, lon) of a place; matched as part of the lower-cased location, first match wins.
PLACE_COORDS = {
    "portland": (45.52, -122.68),
    "cambridge": (52.20, 0.12),
    "sharjah": (25.35, 55.42),
    "phoenix": (33.45, -112.07),
    "california": (36.78, -119.42),
    "british columbia": (53.73, -127.65),
    "scotland": (56.49, -4.20),
    "great britain": (54.00, -2.50),
    "southern china": (23.13, 113.26),
    "sceaux": (48.78, 2.29),
    "sri lanka": (7.70, 80.70),
    "italy, austria": (46.60, 13.85),
    "usa, europe": (39.8, -98.6),
}

# Run-log line formats (Java regular expressions).
LOG_SNAPSHOT = (
    r"\[recursos @ ([^\]]+)\].*?RSS=([\d.]+)([KMGT]?B).*?RAM_disp=([\d.]+)([KMGT]?B)"
    r".*?load=([\d./?]+).*?disco_livre=([\d.]+)([KMGT]?B)(?:.*?t\+([\dhms.]+))?"
)
LOG_SHARD_PROGRESS = (
    r"\[step6:(\w+)\] ep (\d+)/(\d+) shard (\d+)/(\d+) \| train=[\d.]+ val=[\d.]+ \(([^,]+),"
)
LOG_FOLD_PROGRESS = r"\[step6:(\w+)\] fold (\d+)/(\d+) ep (\d+): train=[\d.]+ val=[\d.]+ \(([^)]+)\)"
LOG_END_MARK = "# fim:"
# Event classes of log lines. A line needs all phrases of one choice; a choice with True ignores case.
LOG_EVENTS = {
    "training": [(False, ["[step6:", "train=", "val="])],
    "epoch_done": [(True, ["época", "completa"])],
    "stage": [(False, ["estágio"]), (False, ["fonte '"]), (False, ["combinado"]), (False, [": streaming"]), (False, ["shards (amostra"])],
    "shard_written": [(True, ["shard", "grav"])],
    "closing": [(False, ["FIM"]), (True, ["interrompid"])],
}
UNIT_BYTES = {"B": 1, "KB": 2**10, "MB": 2**20, "GB": 2**30, "TB": 2**40}
