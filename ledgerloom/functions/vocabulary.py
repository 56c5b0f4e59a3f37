"""Words and tables that the cleaning rules need. All are fixed values: results depend on exactly these."""

# Texts that stand for "no value", in lower case.
NULL_TOKENS = [
    "", "-", "--", "—", ".", "..", "n/a", "na", "null", "none", "nil", "#n/a", "unknown", "not available", "0",
    "total owner details", "owner details", "owners data", "total owners", "owner detail",
]

# Names that are column labels, in lower case.
LABEL_NAMES = ["owner", "owners data", "name"]

# UAE mobile prefixes.
MOBILE_PREFIXES = ["50", "52", "54", "55", "56", "58"]

# Square feet in a square metre, and the largest size believed.
SQUARE_FEET = 10.763910416711
LARGEST_SIZE = 100_000

# Spellings of square metres, as a pattern.
SQUARE_METRES = r"(?:sqm|sq\s*\.?\s*m|m2|m²|sq\s*meter|square\s*meter)"

# Date formats in the order in which they are tried.
DATE_FORMATS = ["yyyy-M-d H:m:s", "yyyy-M-d", "d/M/yyyy", "M/d/yyyy h:m:s a", "M/d/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d"]

# The most bedrooms believed.
MOST_BEDROOMS = 10

# Spellings of the United Arab Emirates, in capitals.
UAE_SPELLINGS = ["UAE", "U.A.E", "U.A.E."]

# Community names by their capitals.
COMMUNITIES = {
    "DAMAC HILLS": "DAMAC Hills",
    "DAMAC HILLS 2": "DAMAC Hills 2",
    "DUBAI HILLS": "Dubai Hills Estate",
    "DUBAI HILLS ESTATE": "Dubai Hills Estate",
    "BUSINESS BAY": "Business Bay",
    "AL BARARI": "Al Barari",
    "AL FURJAN": "Al Furjan",
    "PALM JUMEIRAH": "Palm Jumeirah",
    "JUMEIRAH VILLAGE CIRCLE": "Jumeirah Village Circle",
    "JUMEIRAH LAKE TOWERS": "Jumeirah Lake Towers",
    "JUMEIRAH BEACH RESIDENCE": "Jumeirah Beach Residence",
    "DUBAI MARINA": "Dubai Marina",
    "DUBAI SILICON OASIS": "Dubai Silicon Oasis",
    "DOWNTOWN DUBAI": "Downtown Dubai",
    "ARABIAN RANCHES": "Arabian Ranches",
    "AL BARSHA": "Al Barsha",
    "AL KIFAF": "Al Kifaf",
    "MEYDAN": "Meydan",
    "TOWN SQUARE": "Town Square",
}

# Community texts that are sheet titles.
COMMUNITY_NOISE = r"^(total\s+owners?(\s+details)?|owners?\s+details?|owners?\s+data|owner\s+details)(\s*#\d+)?$"

# Community codes of pipe-packed premises.
COMMUNITY_CODES = {"JBR": "Jumeirah Beach Residence", "JLT": "Jumeirah Lake Towers", "BB": "Business Bay", "PJT": "Palm Jumeirah", "JBR-BCH": "JBR Beach"}

# Words that do not tell places apart.
PLACE_NOISE = ["the", "at", "residences", "residence", "tower", "towers", "phase", "overall", "community", "development"]

# Words in file names that name no place, as a pattern.
FILE_NOISE = (
    r"\b(january|february|march|april|may|june|july|august|september|october|november|december|"
    r"jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|"
    r"201\d|202\d|done|new|full|master|others|contacts|ongoing|update|partial|consolidated|"
    r"file is hanging|hanging|end)\b"
)

# Titles, particles and company forms that do not tell names apart.
NAME_NOISE = [
    "MR", "MRS", "MS", "MISS", "DR", "ENG", "ENGINEER", "SHEIKH", "SHEIKHA", "AL", "EL", "BIN", "IBN", "BINT", "THE",
    "LLC", "PJSC", "FZE", "FZCO", "HOLDINGS", "PROPERTIES", "REAL", "ESTATE", "DEVELOPMENT", "LIMITED", "LTD",
]

# Short and variant forms of names.
NAME_FORMS = {
    "MOHD": "MOHAMMED",
    "MOHMD": "MOHAMMED",
    "MD": "MOHAMMED",
    "MOHAMAD": "MOHAMMED",
    "MOHAMMAD": "MOHAMMED",
    "MUHAMMAD": "MOHAMMED",
    "MUHAMMED": "MOHAMMED",
    "AHMD": "AHMED",
    "AHMAD": "AHMED",
    "ABD": "ABDUL",
    "ABDEL": "ABDUL",
    "SYED": "SAYED",
    "FATMA": "FATIMA",
}

# Places whose developer is known without the reference table, and that developer.
KNOWN_SUBPROJECTS = [
    "club villas", "fairway vistas", "sidra", "maple", "park heights", "mulberry", "acacia", "park point", "park ridge",
    "golf place", "golf grove", "golf suites", "golf views", "golf ville", "emerald hills", "majestic vistas",
    "hills grove", "hills view", "collective", "elvira", "lime", "address hillcrest", "ellington house", "dhe",
    "dubai hills", "parkway vistas", "golf link", "golf palace", "parkridge",
]
KNOWN_DEVELOPER = "Emaar Properties"

# Confidence ranks of reference developments.
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}

# Counts that mark a row as a whole building.
BUILDING_MARKERS = ["LEVELS", "SHOPS", "FLATS", "OFFICES"]

# The 23 business columns of a record and the labels that headers map to.
LABELS = {
    "Name": "name", "Community": "community", "Sub-Community": "sub_community", "Building/Cluster": "building_cluster", "Unit Number": "unit_number",
    "Size": "size", "Plot Reg. No": "plot_reg_no", "Plot Number": "plot_number", "DMNO": "dmno", "DMsubno": "dmsubno", "Bedroom": "bedroom",
    "Type (Buyer/Seller)": "party_type", "PI number": "pi_number", "Mobile 1": "mobile_1", "Mobile 2": "mobile_2", "Mobile 3": "mobile_3",
    "Email Address": "email_address", "Nationality": "nationality", "Property Type": "property_type", "Developer": "developer", "Project": "project",
    "Date": "record_date", "Procedure Value": "procedure_value",
}
FIELDS = list(LABELS.values())

# The headerless owner register's columns in order.
OWNER_REGISTER = [
    "P-NUMBER", "AREA", "USAGE", "TOTAL AREA", "PLOT NUMBER", "EMIRATE", "NAME", "AREA OWNED", "ADDRESS", "PHONE", "EMAIL", "FAX", "PO BOX", "GENDER", "DOB",
    "MOBILE", "SECONDARY MOBILE", "PASSPORT", "ISSUE DATE", "EXPIRY DATE", "PLACE OF ISSUE", "EMIRATES ID NUMBER", "EMIRATES ID EXPIRY DATE",
    "RESIDENCE COUNTRY", "NATIONALITY",
]

# Headers that must never enter the data.
EXCLUDED_HEADERS = ["PASSWORD", "LOGIN(OR USE EMAIL)", "PASSPORT", "EMIRATES ID NUMBER", "EMIRATES ID EXPIRY DATE", "IDNUMBER", "UAEIDNUMBER", "PASSPORTEXPIRYDATE", "UNIFIEDNUMBER"]

# Names that count as headings although nothing maps them.
HEADING_NAMES = ["PREMISE 1", "PREMISE 2", "PREMISE 3", "SERIAL NO.", "AREA OWNED", "USAGE", "EMIRATE"]

# Headers kept aside under their own names; a choice of those a register may hold.
ASIDE_HEADERS = ["CUSTOMER TYPE", "CREATED BY", "RESPONSIBLE PERSON", "AGENT", "DEVELOPMENT TYPE", "FLOOR", "SHOPS", "FLATS", "OFFICES", "LEVELS", "AREA OWNED", "PROPERTY NAME", "CONTACT ID", "FAX", "ADDRESS", "GENDER", "DOB", "PO BOX", "USAGE", "EMIRATE"]

#: Default header aliases, a small set; a full set is a table given to the mapping operators.
ALIASES = {
    "NAME": "Name", "FULL NAME": "Name", "OWNER NAME": "Name", "OWNER'S NAME": "Name", "CUSTOMER NAME": "Name",
    "MOBILE": "Mobile 1", "MOBILE 1": "Mobile 1", "PHONE": "Mobile 1", "CONTACT NO.": "Mobile 1", "TELEPHONE": "Mobile 1",
    "MOBILE 2": "Mobile 2", "SECONDARY MOBILE": "Mobile 2", "PHONE HOME": "Mobile 2", "MOBILE 3": "Mobile 3",
    "EMAIL": "Email Address", "EMAIL ADDRESS": "Email Address", "E-MAIL": "Email Address",
    "COMMUNITY": "Community", "MASTER PROJECT": "Community", "AREA": "Size", "PROJECT": "Sub-Community", "PROJECT NAME": "Sub-Community", "SUB COMMUNITY": "Sub-Community",
    "BUILDING NAME": "Building/Cluster", "BUILDING": "Building/Cluster", "UNIT NUMBER": "Unit Number", "UNIT NO": "Unit Number", "FLAT NUMBER": "Unit Number",
    "SIZE": "Size", "TOTAL AREA": "Size", "ACTUAL AREA": "Size", "PLOT NUMBER": "Plot Number", "P-NUMBER": "PI number", "PI NUMBER": "PI number",
    "NATIONALITY": "Nationality", "RESIDENCE COUNTRY": "Nationality", "BEDROOM": "Bedroom", "BEDROOMS": "Bedroom", "TYPE": "Type (Buyer/Seller)",
    "DEVELOPER": "Developer", "PROPERTY TYPE": "Property Type", "DATE": "Date", "PROCEDURE VALUE": "Procedure Value", "PRICE": "Procedure Value",
}

# Ranks of headers that compete for one target; lower wins, 50 where none is given.
RANKS = {
    10: [
        "MOBILE", "MOBILE 1", "MOBILE1", "MOBILE_1", "PHONE MOBILE", "MOBILE 2", "MOBILE2", "MOBILE_2", "SECONDARY MOBILE",
        "NAME", "FULL NAME", "OWNER'S NAME", "OWNER NAME", "OWNERS NAME", "OWNERS_NAME", "OWNER_NAME", "NAMEEN", "IMPORT - OWNER NAME",
        "EMAIL", "EMAIL ADDRESS", "E-MAIL", "OWNERS_EMAIL", "SIZE", "ACTUAL AREA", "ACTUAL SIZE", "BUA", "BUILT UP", "NATIONALITY",
    ],
    20: ["CONTACT NO.", "CONTACT NO", "CONTACT", "MOBILE NO", "CONTACT NUMBER"],
    30: ["CUSTOMER NAME", "JOINT ACCT NAME", "CONTACT/OCCUPIER PERSONS NAME", "TOTAL AREA", "AREA SQFT", "PLOT AREA", "PLOT SIZE", "INTERNAL AREA"],
    40: [
        "PHONE", "PHONE 1", "TELEPHONE", "TELEPHONE NUMBER", "OWNERS_PHONE", "PHONE HOME", "PHONE 2", "TELEPHONE RESIDENCE", "PERSON MAIL ADDRESS",
        "RESIDENCE COUNTRY", "COUNTRYNAMEEN", "LANDLINE", "MOB", "MAIN NUMBER", "SAVED MAIN NUMBER",
    ],
    45: ["OTHER NUMBERS", "OTHER NUMBER", "OTHER NUMBER ( ADMIN)", "NUMBERS"],
}
DEFAULT_RANK = 50
PROJECT_HEADERS = ["PROJECT", "PROJECT NAME", "PROJECT_NAME_EN", "MASTER PROJECT"]

# Headers of reference sheets, words in their names, and headers of contact columns.
REFERENCE_HEADERS = ["MASTER DEVELOPER / BUILDER", "MASTER DEVELOPER", "DEVELOPMENT TYPE", "CONFIDENCE"]
REFERENCE_WORDS = ["developer", "legend", "method", "readme"]
CONTACT_HEADERS = ["NAME", "FULL NAME", "MOBILE", "MOBILE 1", "EMAIL", "EMAIL ADDRESS", "CONTACT NO.", "PHONE", "OWNER'S NAME", "OWNER NAME", "UNIT NUMBER", "NO. OF UNIT", "FLAT NUMBER"]
PERSON_TARGETS = ["Name", "Mobile 1", "Mobile 2", "Mobile 3", "Email Address"]
PLACE_TARGETS = ["Building/Cluster", "Unit Number", "Bedroom", "DMNO", "DMsubno", "Sub-Community", "Plot Reg. No"]
