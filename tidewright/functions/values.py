"""The lists and tables that results depend on."""

# Codes of the 48 contiguous states.
LOWER_48 = ["AL", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY"]
# Names of states, the district and territories.
STATE_NAMES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA",
    "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC",
    "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
    "DISTRICT OF COLUMBIA": "DC", "WASHINGTON DC": "DC", "WASHINGTON D.C.": "DC", "PUERTO RICO": "PR", "VIRGIN ISLANDS": "VI", "GUAM": "GU", "AMERICAN SAMOA": "AS", "NORTHERN MARIANA ISLANDS": "MP",
}
# Common abbreviations of states; the longer ones are also written with a period.
STATE_SHORT = {
    "ALA": "AL", "ARIZ": "AZ", "ARK": "AR", "CALIF": "CA", "COLO": "CO", "CONN": "CT", "DEL": "DE", "FLA": "FL", "ILL": "IL", "IND": "IN", "KANS": "KS", "KAN": "KS", "MASS": "MA", "MICH": "MI", "MINN": "MN", "MISS": "MS",
    "MONT": "MT", "NEBR": "NE", "NEB": "NE", "NEV": "NV", "OKLA": "OK", "ORE": "OR", "PENN": "PA", "TENN": "TN", "TEX": "TX", "WASH": "WA", "WIS": "WI", "WYO": "WY",
}
# The names by whose beginnings states are also told, in order.
PREFIX_STATES = {name: code for name, code in STATE_NAMES.items() if name not in ("WASHINGTON DC", "WASHINGTON D.C.", "AMERICAN SAMOA", "NORTHERN MARIANA ISLANDS")}
STATES_51 = sorted({v for v in STATE_NAMES.values() if v not in ("PR", "VI", "GU", "AS", "MP")})
STATE_CODES = sorted(set(STATE_NAMES.values()))
USA = ["US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA"]
BLANKS = ["", "n/a", "na", "null", "none"]
PO_BOXES = ["PO BOX", "P.O. BOX", "P O BOX", "P.O BOX", "PO. BOX", "POST OFFICE BOX", "POBOX", "P.O.BOX"]
EXCLUDED = ["AK", "HI", "PR", "VI", "GU", "AS", "MP", "FM", "MH", "PW", "ALASKA", "HAWAII", "PUERTO RICO", "VIRGIN ISLANDS", "GUAM"]
MILITARY = ["APO", "FPO", "DPO", "APO AE", "APO AP", "APO AA", "FPO AE", "FPO AP", "FPO AA"]
PRESETS = {"PO Boxes": PO_BOXES, "Excluded States (AK, HI, PR, VI, GU)": EXCLUDED, "Military Addresses (APO, FPO, DPO)": MILITARY, "PO Boxes + Excluded States + Military": PO_BOXES + EXCLUDED + MILITARY}
# Title keywords by rank, with the rank's name.
TITLES = {
    1: ("Executive Leadership", ["CHIEF", "CEO", "CFO", "COO", "CMO", "CNO", "CIO", "CTO", "PRESIDENT", "VP", "V.P.", "EVP"]),
    2: ("Senior Director", ["DIRECTOR", "DEPT HEAD", "DEPARTMENT HEAD", "HEAD OF"]),
    3: ("Manager/Administrator", ["MANAGER", "ADMINISTRATOR", "COORDINATOR"]),
    4: ("Supervisor/Lead", ["SUPERVISOR", "LEAD", "CHARGE"]),
    5: ("Clinical", ["NURSE PRACTITIONER", "NP", "PHYSICIAN ASSISTANT", "PA", "NURSE", "RN", "LPN", "MEDICAL ASSISTANT", "MA", "TECHNICIAN", "TECH", "TECHNOLOGIST", "THERAPIST", "SPECIALIST"]),
    6: ("Administrative Support", ["ASSISTANT", "RECEPTIONIST", "RECEPTION", "FRONT DESK", "PATIENT ACCESS", "SECRETARY", "CLERK"]),
}
# Title keywords that count as whole words only, as they stand within others (CTO in DIRECTOR, COO in COORDINATOR, PA in PATIENT).
SHORT_TITLES = ["CEO", "CFO", "COO", "CMO", "CNO", "CIO", "CTO", "VP", "EVP", "NP", "PA", "RN", "LPN", "MA"]
# Street types that are written out.
STREET_TYPES = {
    "ALY": "ALLEY", "AVE": "AVENUE", "BLVD": "BOULEVARD", "CIR": "CIRCLE", "CT": "COURT", "DR": "DRIVE", "HWY": "HIGHWAY", "LN": "LANE", "PKWY": "PARKWAY", "PL": "PLACE", "RD": "ROAD", "SQ": "SQUARE", "ST": "STREET", "TER": "TERRACE", "TRL": "TRAIL",
    "BLVRD": "BOULEVARD", "CRC": "CIRCLE", "CRCL": "CIRCLE", "CRCLE": "CIRCLE", "CRES": "CRESCENT", "CRSNT": "CRESCENT", "EXPWY": "EXPRESSWAY", "FRWY": "FREEWAY", "TPKE": "TURNPIKE",
}
# Directions that are written out.
DIRECTIONS = {"N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST", "NE": "NORTHEAST", "NW": "NORTHWEST", "SE": "SOUTHEAST", "SW": "SOUTHWEST"}
# Kinds of units that are written out.
UNITS = {"APT": "APARTMENT", "BLDG": "BUILDING", "FL": "FLOOR", "FLR": "FLOOR", "RM": "ROOM", "STE": "SUITE", "#": "NUMBER"}
# Kinds of people counted in a survey: a word of the column's name, the name of the output.
ENTITIES = {"student": "Students", "employee": "Employees", "staff": "Staff"}
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
SUITES = "Ste,Suite,Suites,Unit,Units,Apt,Apartment,Bldg,Building,Floor,Flr,#,Room,Rm"
# Kinds of columns, by patterns of their names; the first kind that has one counts.
COLUMN_KINDS = {
    "customer_id": [r"customer.*id", r"cust.*id", r"account.*id", r"^id$", r"customer.*#", r"cust.*#"],
    "company": [r"company", r"business", r"organization", r"firm"],
    "contact_name": [r"^name$", r"contact.*name", r"full.*name", r"person"],
    "first_name": [r"first.*name", r"fname", r"^first$"],
    "last_name": [r"last.*name", r"lname", r"surname", r"^last$"],
    "email": [r"email", r"e-mail", r"mail"],
    "phone": [r"phone", r"telephone", r"tel", r"mobile", r"cell"],
    "address1": [r"address.*1", r"^address$", r"street", r"addr1"],
    "address2": [r"address.*2", r"addr2", r"suite", r"apt"],
    "city": [r"city", r"town"],
    "state": [r"state", r"province", r"^st$"],
    "zip": [r"zip", r"postal", r"postcode"],
    "country": [r"country", r"nation"],
}
# Kinds of columns, by patterns that most of their values have.
CONTENT_KINDS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\d{3}.*\d{3}.*\d{4}",
    "zip": r"^\d{5}(-\d{4})?$",
    "state": r"^[A-Z]{2}$",
}
# Words by which values look like streets.
STREET_HINTS = ["street", "st", "ave", "avenue", "road", "rd", "blvd", "drive", "dr", "lane", "ln"]
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PO_BOX = r"(?i)\b(p\.?\s*o\.?|post\s*office)\s*box\b"
# States to which sending costs more.
COSTLY_STATES = ["AK", "HI", "PR", "GU", "VI", "AS", "MP"]
GENERIC_CONTACTS = ["ACCOUNTS PAYABLE", "A/P", "ACCOUNTING", "OFFICE", "MANAGER"]
