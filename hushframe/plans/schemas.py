"""Rule sets of the three ready jobs: building energy, census, taxi fares."""

from __future__ import annotations

from ..functions.generalizers import Aggregation, Categories, NoneGeneralizer
from ..functions.hierarchy import Hierarchy
from ..rules import Rule, RuleSet

# Hierarchies as paths below the root.
EDUCATION = [["Without-Post-Secondary", "Preschool"], *(["Without-Post-Secondary", "Elementary", x] for x in ("1st-4th", "5th-6th", "7th-8th")), *(["Without-Post-Secondary", "Junior-Secondary", x] for x in ("9th", "10th")), *(["Without-Post-Secondary", "Senior-Secondary", x] for x in ("11th", "12th", "HS-grad")), ["Post-Secondary", "Some-college"], *(["Post-Secondary", "Assoc", x] for x in ("Assoc-acdm", "Assoc-voc")), *(["Post-Secondary", "University", x] for x in ("Bachelors", "Prof-school")), *(["Post-Secondary", "University", "Post-grad", x] for x in ("Masters", "Doctorate"))]
MARITAL = [*(["married", "has-spouse", x] for x in ("Married-civ-spouse", "Married-AF-spouse")), *(["not-married", "was-married", x] for x in ("Divorced", "Separated")), ["not-married", "never-married", "Never-married"], *(["married", "alone", x] for x in ("Widowed", "Married-spouse-absent"))]
OCCUPATION = [*(["White-collar", x] for x in ("Exec-managerial", "Prof-specialty", "Sales", "Adm-clerical")), *(["Blue-collar", x] for x in ("Tech-support", "Craft-repair", "Machine-op-inspct", "Handlers-cleaners", "Priv-house-serv", "Transport-moving")), *(["Other", x] for x in ("Protective-serv", "Armed-Forces", "Farming-fishing", "Other-service"))]
PAYMENT = [["CARD", "APPLE PAY"], ["CARD", "CREDIT CARD"], ["CARD", "MAESTRO CARD"], *(["CARD", "PAYPAL", x] for x in ("Ratenzahlung", "Auf Rechnung", "Direktzahlung")), ["CASH", "Banknotes"], ["CASH", "Coins"], ["9-Euro Ticket", "No payment"]]
PRIMARY_USE = [*(["private", x] for x in ("Lodging", "Residential")), ["public", "commercial", "Entertainment", "Technology", "Science", "Office", "Parking"], *(["public", "administrative", x] for x in ("Education", "Public Services", "Utility"))]
ENERGY_COLUMNS = ("BUILDING_ID", "TIMESTAMP", "METER_READING", "PRIMARY_USE", "SQUARE_FEET", "YEAR_BUILD", "FLOOR_COUNT", "AIR_TEMPERATURE", "CLOUD_COVERAGE", "DEW_TEMPERATURE", "PERCIP_DEPTH_1_HR", "SEA_LEVEL_PRESSURE", "WIND_DIRECTION", "WIND_SPEED", "BUILDING_ID2", "UNIXTIMESTAMP", "M_ID", "TS")
ENERGY_DOMAINS = {"SQUARE_FEET": (0, 50), "YEAR_BUILD": (1900, 2020), "FLOOR_COUNT": (0, 15), "AIR_TEMPERATURE": (1, 1), "CLOUD_COVERAGE": (0, 9), "DEW_TEMPERATURE": (1, 1), "SEA_LEVEL_PRESSURE": (1, 1), "WIND_DIRECTION": (1, 1), "WIND_SPEED": (1, 1), "UNIXTIMESTAMP": (1451600000000000000, 1490000000000000000)}
CENSUS_DOMAINS = {"age": (17, 90), "fnlwgt": (13492, 1490400), "capital-gain": (0, 99999), "capital-loss": (0, 4356), "hours-per-week": (1, 99)}


def energy(columns=ENERGY_COLUMNS) -> RuleSet:
    out = []
    for c in columns:
        if c == "PRIMARY_USE":
            g = Categories(Hierarchy(PRIMARY_USE))
        elif c in ENERGY_DOMAINS:  # nanoseconds need a double
            g = Aggregation(*ENERGY_DOMAINS[c], kind="double" if c == "UNIXTIMESTAMP" else "float")
        else:
            g = NoneGeneralizer()
        out.append(Rule(c, g, sensitive=c == "METER_READING"))
    return RuleSet.of(columns, *out)


def census(columns) -> RuleSet:
    trees = {"education": EDUCATION, "marital-status": MARITAL, "occupation": OCCUPATION}
    out = []
    for c in columns:
        g = Categories(Hierarchy(trees[c])) if c in trees else Aggregation(*CENSUS_DOMAINS[c], kind="float") if c in CENSUS_DOMAINS else NoneGeneralizer()
        out.append(Rule(c, g, sensitive=c in ("workclass", "relationship")))
    return RuleSet.of(columns, *out)


def taxi(columns) -> RuleSet:
    from ..functions.generalizers import Reduction

    special = {"taxi_id": Rule("taxi_id", Reduction(), weight=0.8), "payment_type": Rule("payment_type", Categories(Hierarchy(PAYMENT)), sensitive=True, weight=0.1), "tip": Rule("tip", Aggregation(0, 100, kind="float"), weight=0.1)}
    return RuleSet.of(columns, *(special.get(c) or Rule(c, NoneGeneralizer(), sensitive=c in ("tolls", "total_fare")) for c in columns))
