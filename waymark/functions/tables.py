"""Word lists, lookup tables and constants.

Results depend on these being exactly what they are, so they are stated
plainly here, once, and nothing else lives in this module.
"""

# Abbreviation -> long form.
ABBREVIATIONS = {
    # units
    "h no": "house number", "hno": "house number", "h.no": "house number",
    "ho no": "house number", "house no": "house number", "hse no": "house number",
    "h/no": "house number", "d no": "door number", "dno": "door number",
    "door no": "door number", "plot no": "plot number", "gat no": "gat number",
    "kh no": "khasra number", "khasra no": "khasra number", "sy no": "survey number",
    "s no": "survey number", "survey no": "survey number", "flat no": "flat",
    "fl no": "flat", "flt": "flat", "shop no": "shop", "room no": "room",
    "qtr": "quarter", "qtrs": "quarters",
    # relations
    "opp": "opposite", "opp.": "opposite", "oppo": "opposite", "nr": "near",
    "nr.": "near", "beh": "behind", "bhind": "behind", "bsd": "beside",
    "adj": "adjacent", "b/h": "behind", "b/s": "beside", "a/p": "at post",
    "nxt to": "next to",
    # buildings, localities, postal words
    "apt": "apartments", "apts": "apartments", "aptt": "apartments",
    "appt": "apartments", "apartment": "apartments", "bldg": "building",
    "bldng": "building", "blg": "building", "twr": "tower", "soc": "society",
    "socy": "society", "chs": "co operative housing society",
    "chsl": "co operative housing society", "resi": "residency", "res": "residency",
    "encl": "enclave", "clny": "colony", "col": "colony", "colny": "colony",
    "sec": "sector", "sect": "sector", "ph": "phase", "blk": "block",
    "vill": "village", "vlg": "village", "po": "post office", "p.o": "post office",
    "ps": "police station", "p.s": "police station", "teh": "tehsil",
    "tq": "taluka", "tal": "taluka", "dist": "district", "distt": "district",
    "dt": "district", "st": "street", "rd": "road", "marg": "marg", "gali": "gali",
    "ln": "lane", "crs": "cross", "mn": "main", "xing": "crossing",
    "chowk": "chowk", "ngr": "nagar", "ngar": "nagar", "puram": "puram",
    "extn": "extension", "ext": "extension", "indl": "industrial",
    "indl.": "industrial", "estt": "estate", "mkt": "market", "bzr": "bazaar",
    "bazar": "bazaar", "hosp": "hospital", "sch": "school", "clg": "college",
    "univ": "university", "stn": "station", "rly": "railway", "rlwy": "railway",
    "jn": "junction", "govt": "government", "pvt": "private", "ltd": "limited",
    "mandir": "mandir", "masjid": "masjid", "gurudwara": "gurudwara",
    # cities
    "blr": "bengaluru", "bangalore": "bengaluru", "bglr": "bengaluru",
    "bom": "mumbai", "bombay": "mumbai", "mum": "mumbai", "del": "delhi",
    "ndls": "new delhi", "n delhi": "new delhi", "gzb": "ghaziabad",
    "ggn": "gurugram", "gurgaon": "gurugram", "hyd": "hyderabad",
    "secbad": "secunderabad", "chn": "chennai", "madras": "chennai",
    "kol": "kolkata", "calcutta": "kolkata", "ahd": "ahmedabad",
    "amd": "ahmedabad", "tvm": "thiruvananthapuram",
    "trivandrum": "thiruvananthapuram", "cochin": "kochi", "ekm": "ernakulam",
    "vizag": "visakhapatnam", "bbsr": "bhubaneswar", "cbe": "coimbatore",
    "mysore": "mysuru", "pondy": "puducherry", "pondicherry": "puducherry",
    "noida": "noida",
    # states
    "mh": "maharashtra", "ka": "karnataka", "tn": "tamil nadu",
    "ap": "andhra pradesh", "ts": "telangana", "up": "uttar pradesh",
    "mp": "madhya pradesh", "hp": "himachal pradesh", "wb": "west bengal",
    "gj": "gujarat", "rj": "rajasthan", "pb": "punjab", "hr": "haryana",
    "kl": "kerala", "od": "odisha", "br": "bihar", "jh": "jharkhand",
    "cg": "chhattisgarh", "uk": "uttarakhand", "as": "assam",
    "ncr": "national capital region",
}

# State or union territory as written -> canonical name.
STATE_ALIASES = {
    "andhra pradesh": "Andhra Pradesh", "arunachal pradesh": "Arunachal Pradesh",
    "assam": "Assam", "bihar": "Bihar", "chhattisgarh": "Chhattisgarh",
    "chattisgarh": "Chhattisgarh", "goa": "Goa", "gujarat": "Gujarat",
    "haryana": "Haryana", "himachal pradesh": "Himachal Pradesh",
    "jharkhand": "Jharkhand", "karnataka": "Karnataka", "kerala": "Kerala",
    "madhya pradesh": "Madhya Pradesh", "maharashtra": "Maharashtra",
    "manipur": "Manipur", "meghalaya": "Meghalaya", "mizoram": "Mizoram",
    "nagaland": "Nagaland", "odisha": "Odisha", "orissa": "Odisha",
    "punjab": "Punjab", "rajasthan": "Rajasthan", "sikkim": "Sikkim",
    "tamil nadu": "Tamil Nadu", "tamilnadu": "Tamil Nadu",
    "telangana": "Telangana", "tripura": "Tripura",
    "uttar pradesh": "Uttar Pradesh", "uttarakhand": "Uttarakhand",
    "uttaranchal": "Uttarakhand", "west bengal": "West Bengal",
    "andaman and nicobar islands": "Andaman & Nicobar Islands",
    "chandigarh": "Chandigarh",
    "dadra and nagar haveli": "Dadra & Nagar Haveli and Daman & Diu",
    "daman and diu": "Dadra & Nagar Haveli and Daman & Diu",
    "delhi": "Delhi", "new delhi": "Delhi", "nct of delhi": "Delhi",
    "jammu and kashmir": "Jammu & Kashmir", "jammu kashmir": "Jammu & Kashmir",
    "ladakh": "Ladakh", "lakshadweep": "Lakshadweep",
    "puducherry": "Puducherry", "pondicherry": "Puducherry",
}

# Administrative district -> the city people write.
CITY_BY_DISTRICT = {
    "Bengaluru Urban": "Bengaluru", "Bengaluru Rural": "Bengaluru",
    "Mumbai": "Mumbai", "Mumbai Suburban": "Mumbai", "Thane": "Thane",
    "Hyderabad": "Hyderabad", "Medchal Malkajgiri": "Hyderabad",
    "Rangareddy": "Hyderabad", "Chennai": "Chennai", "Kolkata": "Kolkata",
    "Pune": "Pune", "Ahmedabad": "Ahmedabad", "Ahmadabad": "Ahmedabad",
    "Jaipur": "Jaipur", "Lucknow": "Lucknow", "Ernakulam": "Kochi",
    "Patna": "Patna", "Kamrup": "Guwahati", "Kamrup Metropolitan": "Guwahati",
    "Bhopal": "Bhopal", "Indore": "Indore", "Nagpur": "Nagpur",
    "Surat": "Surat", "Coimbatore": "Coimbatore", "Chandigarh": "Chandigarh",
    "Gurgaon": "Gurugram", "Gautam Buddha Nagar": "Noida",
    "Ghaziabad": "Ghaziabad", "Visakhapatnam": "Visakhapatnam",
    "Vishakhapatnam": "Visakhapatnam", "Bhubaneswar": "Bhubaneswar",
    "Khordha": "Bhubaneswar", "Varanasi": "Varanasi", "Amritsar": "Amritsar",
    "Ludhiana": "Ludhiana", "Dehradun": "Dehradun", "Ranchi": "Ranchi",
    "Raipur": "Raipur", "Mysuru": "Mysuru", "Madurai": "Madurai",
    "Nashik": "Nashik", "Vadodara": "Vadodara", "Rajkot": "Rajkot",
    "Kanpur Nagar": "Kanpur", "Agra": "Agra", "Jodhpur": "Jodhpur",
    "Thiruvananthapuram": "Thiruvananthapuram", "Kozhikode": "Kozhikode",
    "Jalandhar": "Jalandhar", "Srinagar": "Srinagar", "Jammu": "Jammu",
    "Shimla": "Shimla", "Imphal West": "Imphal", "Shillong": "Shillong",
    "East Khasi Hills": "Shillong", "Aizawl": "Aizawl", "Gangtok": "Gangtok",
    "East Sikkim": "Gangtok", "Panaji": "Panaji", "North Goa": "Panaji",
    "Puducherry": "Puducherry",
}

# Districts that are bare compass words of Delhi.
COMPASS_DISTRICTS = (
    "central", "east", "new delhi", "north", "north east", "north west",
    "south", "south east", "south west", "west", "shahdara",
)

# Delhi district spellings used when seeds are built.
DELHI_DISTRICTS = (
    "Central Delhi", "East Delhi", "New Delhi", "North Delhi",
    "North East Delhi", "North West Delhi", "Shahdara", "South Delhi",
    "South East Delhi", "South West Delhi", "West Delhi", "Central", "East",
    "New Delhi Gpo", "North", "North East", "North West", "South",
    "South East", "South West", "West",
)

# Words that never count as a misspelt city.
NOT_A_CITY = (
    "nagar", "nagara", "colony", "vihar", "puram", "garden", "gardens",
    "market", "bazaar", "extension", "enclave", "layout", "sector", "phase",
    "block", "road", "street", "lane", "cross", "main", "marg", "chowk",
    "pura", "pur", "ganj", "bagh", "kunj", "dham", "palya", "halli", "wadi",
    "wada", "pada", "peth", "para", "gali", "society", "apartments",
    "building", "tower", "house", "number", "floor", "post", "office",
    "police", "station", "village", "district", "north", "south", "east",
    "west", "central", "new", "old", "upper", "lower", "mandir", "masjid",
    "church", "temple", "school", "college", "hospital", "railway",
    "junction", "industrial", "estate", "area",
)

# Relation word before a landmark -> relation.
RELATION_WORDS = {
    "behind": "behind", "back of": "behind", "peeche": "behind",
    "pichhe": "behind", "opposite": "opposite", "in front of": "opposite",
    "saamne": "opposite", "samne": "opposite", "beside": "beside",
    "next to": "beside", "adjacent": "beside", "adjacent to": "beside",
    "paas": "near", "above": "above", "over": "above", "upar": "above",
    "inside": "inside", "within": "inside", "andar": "inside", "near": "near",
    "nearby": "near", "close to": "near",
}

# Relation phrase after a landmark -> relation.
POSTPOSITIONS = {
    "ke pichhe": "behind", "ke peeche": "behind", "ke piche": "behind",
    "ke samne": "opposite", "ke saamne": "opposite", "ke sammne": "opposite",
    "ke paas": "near", "ke pas": "near", "ke nazdeek": "near",
    "ke bagal": "beside", "ke bagal me": "beside", "ke upar": "above",
    "ke andar": "inside", "ke bilkul paas": "near",
}

# Further words that end a landmark phrase.
PHRASE_STOPS = (
    "post office", "post ophis", "post ofis", "police station", "district",
    "tehsil", "taluka", "pincode", "pin", "house number", "flat", "block",
    "sector", "phase", "floor", "tower",
)

# Words that are no landmark on their own.
WEAK_LANDMARKS = (
    "here", "there", "it", "this", "that", "home", "house", "my house", "the",
    "a", "an", "and", "side", "area", "road", "street", "lane",
)

# Unit label and the pattern of its number, in priority order.
UNIT_PATTERNS = (
    ("flat", r"\bflat\s*(?:number\s*)?[:\-]?\s*([0-9]{1,4}\s*[a-z]?(?:\s*[/-]\s*[0-9a-z]{1,4})?)\b"),
    ("house", r"\bhouse\s*number\s*[:\-]?\s*([0-9]{1,5}\s*[a-z]?(?:\s*[/-]\s*[0-9a-z]{1,4})?)\b"),
    ("door", r"\bdoor\s*number\s*[:\-]?\s*([0-9a-z/\-]{1,10})\b"),
    ("plot", r"\bplot\s*number\s*[:\-]?\s*([0-9a-z/\-]{1,10})\b"),
    ("shop", r"\bshop\s*[:\-]?\s*([0-9]{1,4}\s*[a-z]?)\b"),
    ("room", r"\broom\s*[:\-]?\s*([0-9]{1,4}\s*[a-z]?)\b"),
    ("survey", r"\bsurvey\s*number\s*[:\-]?\s*([0-9a-z/\-]{1,12})\b"),
)

# Patterns of floor, block, tower, sector and phase.
FLOOR_PATTERN = (
    r"\b(?:([0-9]{1,2})(?:st|nd|rd|th)?\s*floor"
    r"|(ground|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\s*floor"
    r"|floor\s*[:\-]?\s*([0-9]{1,2}))\b"
)
BLOCK_PATTERN = r"\bblock\s*[:\-]?\s*([a-z0-9]{1,3})\b|\b([a-z])\s*block\b"
TOWER_PATTERN = r"\btower\s*[:\-]?\s*([a-z0-9]{1,3})\b"
SECTOR_PATTERN = r"\bsector\s*[:\-]?\s*([0-9]{1,3}\s*[a-z]?)\b"
PHASE_PATTERN = r"\bphase\s*[:\-]?\s*([0-9ivx]{1,4})\b"

# Delivery instructions that are not part of an address.
CHATTER_PATTERN = (
    r"\b(?:call (?:me |us )?(?:before|b4) (?:coming|delivery|deliver)"
    r"|please call|pls call|plz call|call krke aana|call karke aana"
    r"|ring the bell|ring bell|dont call|do not call"
    r"|deliver (?:after|before) \d{1,2}\s*(?:am|pm)?"
    r"|available (?:after|before) \d{1,2}\s*(?:am|pm)?"
    r"|leave (?:it )?(?:with|at) (?:the )?(?:guard|security|watchman|neighbour))\b"
)

# Devanagari letters -> Latin.
DEVA_CONSONANTS = {
    "क्ष": "ksh", "ज्ञ": "gya", "श्र": "shr", "त्र": "tr",
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n",
    "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m",
    "य": "y", "र": "r", "ल": "l", "व": "v",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h", "ळ": "l",
    "क़": "q", "ख़": "kh", "ग़": "g",
    "ज़": "z", "ड़": "r", "ढ़": "rh",
    "फ़": "f", "य़": "y",
}
DEVA_VOWELS = {
    "अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ऋ": "ri",
    "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऑ": "o", "ॲ": "a",
}
DEVA_MATRAS = {
    "ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u",
    "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au",
    "ॉ": "o", "ॅ": "a",
}
DEVA_NASALS = {"ं": "n", "ँ": "n", "ः": "h"}
DEVA_DIGITS = {
    "०": "0", "१": "1", "२": "2", "३": "3", "४": "4",
    "५": "5", "६": "6", "७": "7", "८": "8", "९": "9",
}
DEVA_VIRAMA = "्"
DEVA_SILENT = ("्", "ऽ", "़")
DEVA_LABIALS = ("प", "फ", "ब", "भ", "म")

# Latin letters -> Devanagari, longest first, for test corpora.
LATIN_TO_DEVA = (
    ("chh", "छ"), ("sh", "श"), ("ch", "च"), ("th", "थ"), ("dh", "ध"),
    ("ph", "फ"), ("bh", "भ"), ("gh", "घ"), ("kh", "ख"), ("jh", "झ"),
    ("aa", "ा"), ("ee", "ी"), ("oo", "ू"), ("ai", "ै"),
    ("au", "ौ"),
    ("k", "क"), ("g", "ग"), ("j", "ज"), ("t", "त"), ("d", "द"), ("n", "न"),
    ("p", "प"), ("b", "ब"), ("m", "म"), ("y", "य"), ("r", "र"), ("l", "ल"),
    ("v", "व"), ("w", "व"), ("s", "स"), ("h", "ह"), ("f", "फ"),
    ("z", "ज़"), ("q", "क़"), ("x", "क्स"), ("c", "क"),
    ("a", ""), ("i", "ि"), ("u", "ु"), ("e", "े"), ("o", "ो"),
)
KNOWN_DEVA = {
    "nagar": "नगर", "delhi": "दिल्ली", "mumbai": "मुंबई", "colony": "कॉलोनी",
    "road": "रोड", "gali": "गली", "mandir": "मंदिर", "masjid": "मस्जिद",
    "market": "मार्केट", "bazaar": "बाज़ार", "post": "पोस्ट",
    "office": "ऑफिस", "sector": "सेक्टर", "block": "ब्लॉक",
    "house": "मकान", "number": "नंबर", "floor": "मंज़िल", "new": "नई",
    "village": "गाँव", "district": "ज़िला", "state": "राज्य",
    "kolkata": "कोलकाता", "chennai": "चेन्नई", "bengaluru": "बेंगलुरु",
    "hyderabad": "हैदराबाद", "pune": "पुणे", "jaipur": "जयपुर",
    "lucknow": "लखनऊ", "patna": "पटना", "bhopal": "भोपाल",
}
HINDI_ORDER = (
    ("near", "के पास"), ("behind", "के पीछे"), ("opposite", "के सामने"),
    ("beside", "के बगल"),
)

# Neighbouring keys on a keyboard.
KEYBOARD_NEIGHBOURS = {
    "a": "sq", "b": "vn", "c": "xv", "d": "sf", "e": "wr", "f": "dg",
    "g": "fh", "h": "gj", "i": "uo", "j": "hk", "k": "jl", "l": "k",
    "m": "n", "n": "bm", "o": "ip", "p": "o", "q": "wa", "r": "et",
    "s": "ad", "t": "ry", "u": "yi", "v": "cb", "w": "qe", "x": "zc",
    "y": "tu", "z": "x",
}
CHATTER_PHRASES = (
    "call before coming", "please call", "ring the bell", "call krke aana",
    "leave with the guard", "deliver after 6 pm",
)

# Words in a place name -> kind of place; first class that hits wins.
TYPE_HINTS = (
    ("religious", ("mandir", "temple", "masjid", "mosque", "church", "gurudwara", "dargah")),
    ("medical", ("hospital", "clinic", "nursing home", "dispensary")),
    ("education", ("school", "college", "university", "vidyalaya", "institute")),
    ("commercial", ("market", "bazaar", "bazar", "mall", "complex")),
    ("transport", ("station", "railway", "metro", "bus stand", "depot")),
    ("civic", ("post office", "police", "court", "bhawan", "bhavan", "office")),
    ("open_space", ("park", "garden", "ground", "stadium")),
    ("locality", ("nagar", "colony", "vihar", "puram", "enclave", "layout", "sector")),
)
STATE_CODES = {
    "Delhi": "DL", "Maharashtra": "MH", "Karnataka": "KA", "Telangana": "TS",
    "Tamil Nadu": "TN", "West Bengal": "WB", "Gujarat": "GJ",
    "Rajasthan": "RJ", "Uttar Pradesh": "UP", "Kerala": "KL", "Assam": "AS",
    "Bihar": "BR", "Madhya Pradesh": "MP", "Odisha": "OD", "Punjab": "PB",
    "Haryana": "HR", "Chandigarh": "CH", "Andhra Pradesh": "AP",
}
TARGET_CITIES = (
    "New Delhi", "Mumbai", "Bengaluru", "Hyderabad", "Chennai", "Kolkata",
    "Pune", "Ahmedabad", "Jaipur", "Lucknow", "Kochi", "Guwahati", "Patna",
    "Bhopal", "Indore", "Nagpur", "Coimbatore", "Varanasi", "Chandigarh",
    "Noida", "Gurugram", "Visakhapatnam", "Bhubaneswar", "Thiruvananthapuram",
)

# Scored address fields and their weights.
FIELDS = (
    "building", "street", "sub_locality", "locality", "city", "district",
    "state", "pincode",
)
COMPLETENESS_WEIGHTS = {
    "building": 0.28, "locality": 0.20, "pincode": 0.18, "sub_locality": 0.12,
    "street": 0.08, "city": 0.08, "district": 0.03, "state": 0.03,
}
EVALUATION_WEIGHTS = {
    "building": 3.0, "street": 1.5, "sub_locality": 1.5, "locality": 2.0,
    "city": 1.0, "district": 0.5, "state": 0.5, "pincode": 2.0,
}
FEATURE_WEIGHTS = {
    "field_completeness": 0.22, "pincode_locality_agreement": 0.20,
    "landmark_match": 0.16, "landmark_observations": 0.08,
    "geo_source_tier": 0.20, "candidate_separation": 0.08,
    "model_self_confidence": 0.06,
}
GEO_TIERS = {"landmark_graph": 1.0, "geocoder": 0.7, "pincode_centroid": 0.3}
RELATION_OFFSET_M = {
    "near": 0.0, "inside": 0.0, "above": 0.0, "beside": 25.0, "behind": 40.0,
    "opposite": 40.0,
}

# The one question per missing field, Hindi and English.
QUESTIONS = (
    ("locality", "Aapka ilaaka ya colony ka naam kya hai?", "Which locality or colony is this?"),
    ("pincode", "Pincode kya hai?", "What is the pincode?"),
    ("building", "Flat ya makaan number kya hai?", "What is the flat or house number?"),
    ("landmark", "Koi nishani bataiye - school, bank, ya bada mandir?",
     "Any nearby landmark - a school, a bank, or a temple?"),
    ("geo_confirm",
     "Address mil gaya, lekin exact location confirm karni hai. Map par apna ghar tap kar dijiye.",
     "We have your address but not the exact spot. Please tap your building on the map."),
)

# Estimated cost per call in USD.
COST_CHEAP_MODEL = 0.00025
COST_STRONG_MODEL = 0.0045
COST_RETRIEVAL = 0.00003

# Fixed values: "addresses seen so far" buckets of the learning curve.
SEEN_BUCKETS = ((0, 0), (1, 1), (2, 3), (4, 7), (8, 15), (16, None))

# Fitted confidence map, (raw, calibrated).
CALIBRATION_KNOTS = (
    (0.2455, 0.0), (0.6988, 0.0), (0.7112, 0.7838), (0.7782, 0.7838),
    (0.7789, 0.875), (0.9068, 0.875), (0.9069, 1.0), (0.9073, 1.0),
)
