"""Work-place type, tech hubs, countries and the US test."""

# ---------------------------------------------------------------------------
# Results depend on these exact words, patterns and their order.
# ---------------------------------------------------------------------------

REMOTE = [r"\bremote\b", r"\bwork\s*from\s*home\b", r"\bwfh\b", r"\bdistributed\b",
          r"\banywhere\b", r"\bfully\s*remote\b", r"\b100%\s*remote\b"]
HYBRID = [r"\bhybrid\b", r"\bflexible\b", r"\bremote.*office\b", r"\boffice.*remote\b",
          r"\b\d+\s*days?\s*(in\s*)?office\b"]
ONSITE = [r"\bon-?site\b", r"\bin-?office\b", r"\bin\s*person\b", r"\boffice\s*based\b",
          r"\bno\s*remote\b"]

COUNTRIES = {
    "US": [r"\bus\b", r"\bu\.s\.\b", r"\bunited\s*states\b", r"\bamerica\b"],
    "UK": [r"\buk\b", r"\bu\.k\.\b", r"\bunited\s*kingdom\b", r"\bbritain\b", r"\bengland\b"],
    "EU": [r"\beu\b", r"\beurope\b", r"\beuropean\b"],
    "Canada": [r"\bcanada\b", r"\bcanadian\b"],
    "Australia": [r"\baustralia\b", r"\baustralian\b"],
    "Germany": [r"\bgermany\b", r"\bgerman\b"],
    "France": [r"\bfrance\b", r"\bfrench\b"],
    "India": [r"\bindia\b", r"\bindian\b"],
}

TECH_HUBS = {
    "san francisco": "San Francisco, CA",
    "sf": "San Francisco, CA",
    "bay area": "San Francisco Bay Area, CA",
    "silicon valley": "San Francisco Bay Area, CA",
    "new york": "New York, NY",
    "nyc": "New York, NY",
    "los angeles": "Los Angeles, CA",
    "la": "Los Angeles, CA",
    "seattle": "Seattle, WA",
    "austin": "Austin, TX",
    "boston": "Boston, MA",
    "chicago": "Chicago, IL",
    "denver": "Denver, CO",
    "miami": "Miami, FL",
    "london": "London, UK",
    "berlin": "Berlin, Germany",
    "toronto": "Toronto, Canada",
    "vancouver": "Vancouver, Canada",
    "bangalore": "Bangalore, India",
    "sydney": "Sydney, Australia",
    "dublin": "Dublin, Ireland",
    "amsterdam": "Amsterdam, Netherlands",
    "paris": "Paris, France",
    "singapore": "Singapore",
    "tokyo": "Tokyo, Japan",
}

US_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR",
    "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID",
    "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV",
    "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM", "new york": "NY",
    "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT",
    "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV",
    "wisconsin": "WI", "wyoming": "WY", "district of columbia": "DC",
}

US_CITIES = [
    "new york", "los angeles", "chicago", "houston", "phoenix", "philadelphia",
    "san antonio", "san diego", "dallas", "san jose", "austin", "jacksonville",
    "fort worth", "columbus", "charlotte", "san francisco", "indianapolis",
    "seattle", "denver", "boston", "el paso", "nashville", "detroit",
    "oklahoma city", "portland", "las vegas", "memphis", "louisville",
    "baltimore", "milwaukee", "albuquerque", "tucson", "fresno", "sacramento",
    "mesa", "atlanta", "kansas city", "colorado springs", "miami", "raleigh",
    "omaha", "long beach", "virginia beach", "oakland", "minneapolis", "tulsa",
    "arlington", "tampa", "new orleans", "cleveland", "pittsburgh", "cincinnati",
    "palo alto", "mountain view", "menlo park", "cupertino", "sunnyvale",
    "redwood city", "santa clara", "fremont", "san mateo", "berkeley",
    "cambridge", "somerville", "brooklyn", "manhattan", "queens", "bronx",
    "santa monica", "venice", "pasadena", "burbank", "culver city",
    "boulder", "salt lake city", "provo", "ann arbor", "madison",
]
US_WORDS = ["united states", "usa", "u.s.a.", "u.s.", "america"]
NON_US_WORDS = [
    "united kingdom", "uk", "u.k.", "england", "london", "manchester",
    "germany", "berlin", "munich", "frankfurt",
    "france", "paris", "lyon",
    "canada", "toronto", "vancouver", "montreal",
    "australia", "sydney", "melbourne",
    "india", "bangalore", "mumbai", "delhi",
    "china", "beijing", "shanghai",
    "japan", "tokyo", "singapore",
    "israel", "tel aviv",
    "netherlands", "amsterdam",
    "sweden", "stockholm",
    "ireland", "dublin",
    "switzerland", "zurich",
]
ZIP_CODE = r"\b\d{5}(?:-\d{4})?\b"
STATE_AFTER_COMMA = r",\s*([A-Z]{2})(?:\s|$|\d)"
CITY_COMMA_STATE = r"[A-Za-z]+,\s*[A-Z]{2}"

LOCATION_SNIPPETS = [
    r"<address[^>]*>([^<]+)</address>",
    r'class="[^"]*address[^"]*"[^>]*>([^<]+)<',
    r"(?:location|headquarters|office|address)[:\s]+([^<\n]+)",
    r'"addressLocality":\s*"([^"]+)"',
    r'"addressRegion":\s*"([^"]+)"',
    r"\b(\d{1,5}\s+[A-Za-z0-9\s,]+,\s*[A-Za-z\s]+,\s*[A-Z]{2}\s+\d{5})\b",
]
LOCATION_PREFIX = r"^\s*(located?\s*(in|at)?|based\s*(in|at)?)\s*"
LOCATION_SUFFIX = r"\s*(area|region|office)?\s*$"

ORG_US_PLACES = [
    "san francisco", "new york", "los angeles", "seattle", "boston",
    "austin", "chicago", "denver", "miami", "atlanta", "portland",
    "san diego", "phoenix", "dallas", "houston", "philadelphia",
    "washington", "dc", "brooklyn", "manhattan", "oakland",
    "palo alto", "mountain view", "menlo park", "cupertino", "sunnyvale",
    "redwood city", "san jose", "santa clara", "fremont",
    "california", "new york", "texas", "washington", "massachusetts",
    "colorado", "florida", "georgia", "oregon", "illinois",
    "pennsylvania", "north carolina", "virginia", "arizona",
    ", ca", ", ny", ", tx", ", wa", ", ma", ", co", ", fl", ", ga",
    ", or", ", il", ", pa", ", nc", ", va", ", az",
    "usa", "united states", "u.s.a", "u.s.",
]
# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------
