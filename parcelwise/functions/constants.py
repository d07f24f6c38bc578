"""Labels, rules and lists the reports must agree on."""

# Area code -> market area, quarterly reports.
AREA_LABELS = {
    "11": "West Ashley (11-12)",
    "12": "West Ashley (11-12)",
    "21": "James Island (21)",
    "22": "Folly Beach (22)",
    "23": "Johns Island (23)",
    "25": "Kiawah Island (25)",
    "26": "Edisto Island (26 & 28)",
    "27": "Edisto Beach (27)",
    "28": "Edisto Island (26 & 28)",
    "31": "North Charleston (31-32)",
    "32": "North Charleston (31-32)",
    "41": "North Mt. Pleasant (41)",
    "42": "South Mt. Pleasant (42)",
    "43": "Sulivan's Island (43)",
    "44": "Isle of Palms (44)",
    "45": "Wild Dunes (45)",
    "51": "Downtown Inside Crosstown (51)",
    "52": "Downtown Charleston Above the Crosstown (52)",
    "61": "Summerville (61-63)",
    "62": "Summerville (61-63)",
    "63": "Summerville (61-63)",
    "71": "Hanahan (71)",
    "72": "Goose Creek (72-73)",
    "73": "Goose Creek (72-73)",
    "74": "Nexton/Cane Bay Area (74)",
    "76": "Moncks Corner (76)",
    "77": "Daniel Island (77)",
    "78": "Clements Ferry Road/Cainhoy (78)",
    "82": "Walterboro (82)",
}

# Area code -> market area, supply and demand report.
AREA_LABELS_SUPPLY = {
    "11": "West Ashley (11-12)",
    "12": "West Ashley (11-12)",
    "21": "James Island (21)",
    "22": "Folly Beach (22)",
    "23": "Johns Island (23)",
    "25": "Kiawah Island (25)",
    "26": "Edisto (26-28)",
    "27": "Edisto (26-28)",
    "28": "Edisto (26-28)",
    "31": "North Charleston (31-32)",
    "32": "North Charleston (31-32)",
    "41": "Mt. Pleasant - North of IOP Connector (41)",
    "42": "Mt. Pleasant - South of IOP Connector (42)",
    "43": "Sulivan's Island (43)",
    "44": "Isle of Palms (44)",
    "45": "Wild Dunes (45)",
    "51": "Downtown Inside Crosstown (51)",
    "61": "Summerville (61-63)",
    "62": "Summerville (61-63)",
    "63": "Summerville (61-63)",
    "71": "Hanahan (71)",
    "72": "Goose Creek (72-73)",
    "73": "Goose Creek (72-73)",
    "74": "Jedburg (74)",
    "77": "Daniel Island (77)",
    "78": "Clements Ferry Road/Cainhoy (78)",
    "82": "Walterboro (82)",
}

# Areas that overlap the coded ones.
SOUTH_OF_BROAD = "South of Broad"
TRI_COUNTY_AREA = "CHS Tri-County"
TRI_COUNTY_AREA_COUNTIES = ("Berkeley", "Dorchester", "Charleston")
TRI_COUNTY_AREA_CODES = (11, 78)
SUPPLY_OVERLAYS = {
    "Downtown Charleston (51-52)": ("51", "52"),
    "West Islands (23-26 & 30)": ("23", "24", "25", "26", "30"),
}

# Lower edges of the price bands after the first.
BREAKS_4 = (300_000, 600_000, 1_000_000)
BREAKS_5 = (125_000, 200_000, 350_000, 500_000)
BREAKS_16 = (
    150_000, 200_000, 250_000, 300_000, 350_000, 400_000, 450_000, 500_000,
    600_000, 700_000, 800_000, 900_000, 1_000_000, 1_500_000, 2_000_000,
)

# Brokerage name patterns, in order; the first match names the company.
COMPANY_RULES = (
    ("Keefe %", "Keefe Real Estate"),
    ("@properties%", "@properties"),
    ("%The Real Estate Group%", "CB The Real Estate Group"),
    ("SHOREWEST%", "Shorewest"),
    ("%Geneva Lakefront%", "Geneva Lakefront Realty"),
    ("%Rauland%", "Rauland Agency"),
    ("%Lake Geneva Area%", "Lake Geneva Area Realty"),
    ("%Aprile%", "D'Aprile Properties"),
    ("%Redfin%", "Redfin Corporation"),
    ("NON-MLS%", "NON MLS"),
    ("NON MLS%", "NON MLS"),
)

# Counties, and the data sources that cover them.
TRI_COUNTIES = ("Kenosha", "Racine", "Walworth")
TRI_COUNTY_STATE = 55
TRI_COUNTY_SOURCES = (1, 4, 8)
TRI_COUNTY_SHARE_SOURCES = (1,)
FOURTH_COUNTY = "McHenry"
FOURTH_COUNTY_STATE = 17
FOURTH_COUNTY_SOURCES = (10,)
EXCLUDED_REGION = "Milwaukee"

# Municipalities reported on, with type (city, town, village).
MUNICIPALITIES = (
    ("Bloomfield", "T"),
    ("Burlington", "C"),
    ("Darien", "T"),
    ("Delavan", "C"),
    ("Delavan", "T"),
    ("Elkhorn", "C"),
    ("Fontana-on-Geneva Lake", "V"),
    ("Geneva", "T"),
    ("Genoa City", "V"),
    ("La Grange", "T"),
    ("Lafayette", "T"),
    ("Lake Geneva", "C"),
    ("Linn", "T"),
    ("Lyons", "T"),
    ("Sugar Creek", "T"),
    ("Walworth", "V"),
    ("Whitewater", "C"),
    ("Williams Bay", "V"),
)
COMMUNITY_GEOS = ("Abbey Springs", "Geneva National")
CENSUS_PLACES = (
    "Woodstock", "Richmond", "Harvard", "McHenry", "Crystal Lake", "Hebron", "Bull Valley",
)
CENSUS_PLACE_SOURCE = 10
LAKEFRONT_PATTERN = "%lakefront%"

# Property subtypes in the residential reports.
PROPERTY_SUBTYPES = ("Condominium", "Duplex", "Single Family Residential", "Townhouse")

# Listing statuses, by the rule that decides inventory.
STATUS_ON_MARKET = ("Active", "Active Under Contract", "Pending")
STATUS_OFF_MARKET = ("Expired", "Withdrawn", "Canceled")
STATUS_CLOSED = "Closed"
STATUS_UPCOMING = "Coming Soon"

# Property classes of the county reports.
CLASS_LAND = "Land"
CLASS_CONDO = "Condominium"
CLASS_HOUSE = "Single Family Residential"
CLASS_OTHER = "Other"

# Broker ranking.
OWN_FIRM_PREFIX = "dere"
TOP_RANK = 5
OFFICE_ID_LENGTH = 6
PERIOD_CLOSED = "ytdClosed"
PERIOD_CONTRACT = "ytdUC"
PERIOD_CLOSED_PRIOR = "pytdClosed"
PERIOD_CONTRACT_PRIOR = "pytdUC"

# First close date of the market share reports: years after 2016.
SHARE_FIRST_YEAR = 2017
