"""Fixed values of place names: lists and tables that results depend on, stated as they are."""

# fixed values: national names kept from the official register, by their generic term, with the least relevance at which each is kept
KEEP_TERMS = {
    "Indian Reserve": 0, "Indian Settlement": 0, "First Nation": 0, "Métis Settlement": 0, "City": 0, "Town": 0, "Village": 0,
    "Summer Village": 0, "Hamlet": 0, "Municipal District": 250000, "County": 250000, "Rural Municipality": 250000, "River": 250000,
    "Creek": 1000000, "Lake": 1000000, "Bridge": 0, "Dam": 0, "Provincial Park": 250000, "National Park": 0, "Reservoir": 250000,
}
# fixed values: category kept whatever the term
KEEP_CATEGORY = "Populated Place"
# fixed values: kind of a term; others are localities
KIND_OF_TERM = {
    "Indian Reserve": "first_nation", "Indian Settlement": "first_nation", "First Nation": "first_nation", "Métis Settlement": "first_nation",
    "River": "river", "Creek": "river", "Bridge": "bridge", "Dam": "bridge", "Provincial Park": "park", "National Park": "park",
    "Lake": "region", "Reservoir": "region", "Municipal District": "region", "County": "region", "Rural Municipality": "region",
    "City": "city", "Town": "town", "Village": "village", "Summer Village": "village", "Hamlet": "hamlet",
}
# fixed values: how precise a place of a kind is
PRECISION = {
    "neighbourhood": "point", "suburb": "point", "quarter": "point", "bridge": "point", "park": "point", "road": "line", "river": "line",
    "island": "point", "hamlet": "locality", "village": "locality", "locality": "locality", "town": "locality", "city": "locality",
    "first_nation": "locality", "province": "region", "region": "region",
}
# fixed values: provinces with their centres
PROVINCES = {
    "Alberta": (53.93, -116.58), "British Columbia": (53.73, -127.65), "Saskatchewan": (52.94, -106.45), "Manitoba": (53.76, -98.81),
    "Ontario": (51.25, -85.32), "Quebec": (52.94, -73.55), "New Brunswick": (46.57, -66.46), "Nova Scotia": (44.68, -63.74),
    "Prince Edward Island": (46.51, -63.42), "Newfoundland and Labrador": (53.14, -57.66), "Yukon": (64.28, -135.0),
    "Northwest Territories": (64.83, -124.85), "Nunavut": (70.3, -83.1),
}
# fixed values: short names, airport codes and demonyms of the register's country
ALIASES = {
    "yyc": "Calgary", "yeg": "Edmonton", "yql": "Lethbridge", "yxh": "Medicine Hat", "yqf": "Red Deer", "ymm": "Fort McMurray",
    "ywg": "Winnipeg", "yqt": "Thunder Bay", "yxe": "Saskatoon", "yqr": "Regina", "yvr": "Vancouver", "yyj": "Victoria", "ykf": "Kitchener",
    "yow": "Ottawa", "yyz": "Toronto", "yto": "Toronto", "yul": "Montreal", "ymq": "Montreal", "yqb": "Quebec City", "yhz": "Halifax",
    "yfc": "Fredericton", "yxy": "Whitehorse", "yzf": "Yellowknife", "yka": "Kamloops", "ylw": "Kelowna", "ypa": "Prince Albert",
    "ab": "Alberta", "alberta": "Alberta", "bc": "British Columbia", "sk": "Saskatchewan", "mb": "Manitoba", "on": "Ontario", "ont": "Ontario",
    "qc": "Quebec", "nb": "New Brunswick", "ns": "Nova Scotia", "pei": "Prince Edward Island", "nl": "Newfoundland and Labrador",
    "nwt": "Northwest Territories", "cowtown": "Calgary", "highriver": "High River", "medhat": "Medicine Hat", "kash": "Kashechewan",
    "mh": "Medicine Hat", "calgarian": "Calgary", "calgarians": "Calgary", "albertan": "Alberta", "albertans": "Alberta",
    "edmontonian": "Edmonton", "edmontonians": "Edmonton", "winnipeggers": "Winnipeg", "manitobans": "Manitoba",
    "saskatchewanians": "Saskatchewan", "ontarians": "Ontario", "torontonians": "Toronto",
}
# fixed values: what hashtags end and begin with
TAG_ENDINGS = ["floods", "flooding", "flood", "strong", "relief", "help", "helps", "news", "rain", "storm", "evac", "evacuation", "water", "cleanup", "recovery", "proud", "love"]
TAG_BEGINNINGS = ["prayfor", "pray4", "helpthe", "help", "savethe"]
# fixed values: words that alone are no place
STOP = [
    "the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "is", "it", "we", "my", "our", "your", "this", "that", "all", "rt", "via",
    "amp", "new", "just", "now", "today", "tonight", "day", "canada", "city", "river", "lake", "downtown", "north", "south", "east", "west",
    "centre", "center", "park", "love", "strong", "help", "home", "stay", "safe", "high", "water", "flood", "bridge", "bow",
]
# fixed values: words before a place
PREPOSITIONS = ["in", "at", "near", "to", "from", "around", "across", "through", "into", "outside", "of", "@"]
# fixed values: names that are organisations, storms or words
BLOCK = [
    "red cross", "floods", "flood", "canada post", "global", "salvation army", "hwy", "highway", "downtown", "city hall", "emergency",
    "police", "fire", "news", "sun", "star", "herald", "shaw", "enmax", "telus", "rogers", "bell", "osler", "westjet", "safeway", "sobeys",
    "home depot", "tim hortons", "cbc", "ctv", "city", "trends", "hurricane", "sandy", "typhoon", "tornado", "cyclone", "storm",
    "earthquake", "quake", "tsunami", "yolanda", "haiyan", "pablo", "bopha", "oswald", "marathon", "metro",
]
# fixed values: names of states and countries that are too vague
VAGUE = [
    "central", "western", "eastern", "northern", "southern", "capital", "coast", "coastal", "island", "islands", "lakes", "mountains",
    "mountain", "valley", "border", "national", "federal", "union", "plains", "highlands", "upper", "lower", "middle", "greater", "new",
    "north", "south", "east", "west", "centre", "center", "interior", "orange", "delta", "lagoon", "river", "lake",
]
# fixed values: words before a storm's name
STORMS = ["hurricane", "superstorm", "typhoon", "storm", "cyclone", "tropical", "tornado", "ex-tropical"]
# fixed values: names too broad for a map
TOO_BROAD = [
    "canada", "north america", "world", "rockies", "rocky mountains", "western canada", "eastern canada", "the prairies", "prairies",
    "first nations", "usa", "united states",
]
# fixed values: words of direction before the name of a region
DIRECTIONS = ["southern", "northern", "central", "eastern", "western", "south", "north", "east", "west"]
# fixed values: what a name may begin and end with beside its core
BEGINNINGS = ["downtown ", "the ", "city of ", "town of ", "village of ", "county of "]
ENDINGS = [" first nation", " cree nation", " nation", " indian reserve", " reserve", " community", " neighbourhood", " neighborhood", " area", " district"]
# fixed values: words that may be small within a name
SMALL = ["of", "the", "de", "du", "la"]
# fixed values: other names of countries
COUNTRY_ALIASES = {
    "usa": "US", "u.s.": "US", "u.s.a.": "US", "united states of america": "US", "america": "US", "uk": "GB", "britain": "GB",
    "great britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB", "philippines": "PH", "phillipines": "PH", "philipines": "PH",
    "philipinnes": "PH", "pilipinas": "PH", "russia": "RU", "south korea": "KR", "north korea": "KP", "vietnam": "VN", "czech republic": "CZ",
    "holland": "NL", "the netherlands": "NL", "uae": "AE", "iran": "IR", "syria": "SY", "bolivia": "BO", "venezuela": "VE", "tanzania": "TZ",
    "laos": "LA", "burma": "MM", "ivory coast": "CI", "taiwan": "TW", "aussie": "AU", "oz": "AU",
}
# fixed values: what the people of a country are called
DEMONYMS = {
    "filipino": "PH", "filipinos": "PH", "pinoy": "PH", "australian": "AU", "australians": "AU", "aussies": "AU", "italian": "IT",
    "italians": "IT", "american": "US", "americans": "US", "canadian": "CA", "canadians": "CA", "mexican": "MX", "brazilian": "BR",
    "guatemalan": "GT", "venezuelan": "VE", "bangladeshi": "BD", "spanish": "ES", "russian": "RU", "russians": "RU", "singaporean": "SG",
    "singaporeans": "SG", "indonesian": "ID", "indian": "IN", "pakistani": "PK", "japanese": "JP", "chinese": "CN", "british": "GB",
}
# fixed values: short names of regions, with what they stand for
REGION_ALIASES = {
    "qld": ("Queensland", "AU"), "nsw": ("New South Wales", "AU"), "vic": ("Victoria", "AU"), "ph": ("Philippines", "PH"),
    "pinas": ("Philippines", "PH"), "nyc": ("New York City", "US"), "socal": ("California", "US"), "norcal": ("California", "US"),
    "lax": ("Los Angeles", "US"), "sardegna": ("Sardinia", "IT"), "cdo": ("Cagayan de Oro", "PH"), "ncr": ("Manila", "PH"),
    "metro manila": ("Manila", "PH"), "mm": ("Manila", "PH"),
}
# fixed values: relevance of a register's name from which it is a major city, a significant place, a place that hashtags run together
MAJOR, SIGNIFICANT, RUN_TOGETHER = 7_500_000, 1_000_000, 250_000
# fixed values: people from which a city is great, sizeable, known in small letters, known by other spellings; people that any region counts for
GREAT_CITY, SIZEABLE, KNOWN, SPELLED, REGION_PEOPLE = 1_000_000, 100_000, 500_000, 200_000, 2_000_000
# fixed values: kilometres beyond which a place lies outside an event; kilometres that a tenfold size makes up for
MAX_KM, KM_PER_TENFOLD = 600.0, 60
