"""The word lists that queries and addresses are read with.

All of them are data that results depend on, stated as they are.
"""

# fmt: off
# Spellings, abbreviations and states of search queries.
SPELLING = {
    "banglore": "bangalore", "bangaluru": "bengaluru", "bengalore": "bangalore", "mubmai": "mumbai", "mumbay": "mumbai", "bombay": "mumbai",
    "dilli": "delhi", "dehli": "delhi", "delih": "delhi", "kolkatta": "kolkata", "calcutta": "kolkata", "chennnai": "chennai", "chenai": "chennai",
    "madras": "chennai", "hydrabad": "hyderabad", "hyderbad": "hyderabad", "pune": "pune", "puna": "pune", "poona": "pune", "ahmadabad": "ahmedabad",
    "ahemdabad": "ahmedabad", "gurgaon": "gurugram", "noida": "noida", "jaipur": "jaipur", "jaypur": "jaipur", "lucknow": "lucknow",
    "lucknao": "lucknow", "kochi": "kochi", "cochin": "kochi", "maharastra": "maharashtra", "maharasthra": "maharashtra", "karnatka": "karnataka",
    "karnataka": "karnataka", "tamilnadu": "tamil nadu", "gujrat": "gujarat", "rajastan": "rajasthan", "rajasthaan": "rajasthan", "punjaab": "punjab",
    "harayana": "haryana", "utterpradesh": "uttar pradesh", "westbengal": "west bengal", "telengana": "telangana", "nagur": "nagar", "raod": "road",
    "rood": "road", "strt": "street", "steet": "street", "colny": "colony", "socity": "society", "soceity": "society", "appartment": "apartment",
    "apartement": "apartment", "bulding": "building", "buliding": "building", "neer": "near", "oppsite": "opposite", "oposite": "opposite",
    "sekter": "sector",
}
ABBREVIATIONS = {
    "apt": "apartment", "apt.": "apartment", "apts": "apartment", "appt": "apartment", "ave": "avenue", "blk": "block", "blk.": "block",
    "bldg": "building", "bldg.": "building", "col": "colony", "cir": "circle", "dist": "district", "dist.": "district", "distt": "district",
    "extn": "extension", "ext": "extension", "gpo": "general post office", "hno": "house number", "h.no": "house number", "hwy": "highway",
    "ln": "lane", "marg": "marg", "nr": "near", "ofc": "office", "opp": "opposite", "po": "post office", "p.o": "post office", "ps": "police station",
    "rd": "road", "rd.": "road", "sec": "sector", "st": "street", "st.": "street", "tal": "taluka", "teh": "taluka", "vill": "village",
}
STATES = {
    "ap": "andhra pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh", "ch": "chandigarh", "dl": "delhi", "ga": "goa", "gj": "gujarat",
    "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala", "mh": "maharashtra", "mp": "madhya pradesh",
    "ml": "meghalaya", "mn": "manipur", "mz": "mizoram", "nl": "nagaland", "od": "odisha", "pb": "punjab", "rj": "rajasthan", "sk": "sikkim",
    "tn": "tamil nadu", "ts": "telangana", "uk": "uttarakhand", "up": "uttar pradesh", "wb": "west bengal",
}
# The same for the address parser.
PARSER_SPELLING = {
    "banglore": "bangalore", "maharastra": "maharashtra", "mubmai": "mumbai",
}
PARSER_ABBREVIATIONS = {
    "apt": "apartment", "apt.": "apartment", "rd": "road", "rd.": "road", "st": "street", "st.": "street", "hno": "house number",
    "h.no": "house number", "no": "number", "blk": "block", "vill": "village", "po": "post office",
}
PARSER_STATES = {
    "ap": "andhra pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh", "ch": "chandigarh", "dl": "delhi", "gj": "gujarat", "hr": "haryana",
    "ka": "karnataka", "kl": "kerala", "mh": "maharashtra", "mp": "madhya pradesh", "od": "odisha", "pb": "punjab", "rj": "rajasthan",
    "tn": "tamil nadu", "ts": "telangana", "up": "uttar pradesh", "wb": "west bengal",
}
PARSER_STATE_NAMES = (
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka", "kerala",
    "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "punjab", "rajasthan", "sikkim", "tamil nadu", "telangana", "tripura",
    "uttar pradesh", "uttarakhand", "west bengal", "delhi", "jammu and kashmir", "ladakh", "chandigarh", "puducherry", "dadra and nagar haveli", "daman and diu",
)
# Abbreviations expanded in addresses.
ADDRESS_ABBREVIATIONS = {
    "rd": "Road", "st": "Street", "str": "Street", "dr": "Drive", "ave": "Avenue", "blvd": "Boulevard", "ln": "Lane", "extn": "Extension",
    "ext": "Extension", "ngr": "Nagar", "ng": "Nagar", "col": "Colony", "sec": "Sector", "dist": "District", "opp": "Opposite", "nr": "Near",
    "po": "Post Office", "bo": "Branch Office", "so": "Sub Office", "ho": "Head Office", "apt": "Apartment", "fl": "Floor", "bldg": "Building",
    "bh": "Bungalow", "ch": "Chowk", "mkt": "Market", "mandi": "Mandi", "twp": "Township", "vlg": "Village", "gp": "Gram Panchayat",
}
# Marker words of entities.
BUILDING = ("flat", "house", "building", "plot", "shop", "apartment", "tower", "wing")
BUILDING_INTENT = ("flat", "house", "houseno", "housenumber", "plot", "shop", "apartment", "tower", "wing")
ROAD = ("road", "street", "lane", "rd", "st", "avenue", "ave", "road no", "street no")
ROAD_INTENT = ("road", "street", "lane", "rd", "st")
LOCALITY = ("sector", "layout", "colony", "nagar", "phase", "block", "society", "area", "enclave", "complex", "vihar")
VILLAGE = ("village", "vill", "gram")
BLOCK = ("block",)
TALUKA = ("taluka", "tehsil", "tal")
DISTRICT = ("district", "dist")
OFFICE = (
    "office", "offices", "service", "services", "gpo", "headquarters", "hq", "bhavan", "bhawan", "sadan", "kendra", "karyalaya", "chamber", "chambers",
    "corporate", "corp", "ltd", "limited", "pvt", "private", "bank", "hospital", "school", "institute", "company",
)
LANDMARK_INTENT = ("near", "opposite", "behind", "beside", "adjacent")
PREPOSITIONS = ("near", "opposite", "behind", "beside", "above", "below", "adjacent", "front", "besides", "next")
LANDMARKS = (
    "temple", "mandir", "masjid", "mosque", "church", "gurudwara", "hospital", "clinic", "nursinghome", "school", "college", "university", "institute", "mall", "market",
    "bazaar", "supermarket", "metro", "metrostation", "railwaystation", "busstand", "busstop", "airport", "park", "garden", "ground", "stadium", "theatre", "cinema",
    "hotel", "restaurant", "bank", "atm", "petrolpump", "policestation", "postoffice", "circle", "chowk", "signal", "flyover", "bridge", "crossing", "junction", "gate",
    "tower", "complex", "plaza",
)
PARSER_BUILDING = ("flat", "apartment", "building", "tower", "wing", "block", "house", "plot", "shop")
PARSER_ROAD = ("road", "street", "lane", "nagar", "avenue", "rd", "st")
PARSER_LOCALITY = ("sector", "area", "locality", "colony", "layout", "phase", "nagar")
PARSER_LANDMARK = ("near", "opposite", "behind", "beside")
# Spellings of one place.
LOCALITY_ALIASES = (
    ("hinjewadi", "hinjavadi", "hinjawadi", "hinjewady"), ("bangalore", "bengaluru", "bengalooru"), ("bombay", "mumbai"), ("madras", "chennai"),
    ("calcutta", "kolkata"), ("poona", "pune"), ("gurgaon", "gurugram"), ("mysore", "mysuru"),
)
# Synonyms of the index, word to words.
SYNONYMS = {
    "rd": "road", "st": "street", "str": "street", "hinjewadi": "hinjavadi", "hinjavadi": "hinjewadi", "dr": "drive", "ave": "avenue", "blvd": "boulevard", "ln": "lane",
    "ext": "extension", "extn": "extension", "ngr": "nagar", "ng": "nagar", "col": "colony", "sec": "sector", "dist": "district", "opp": "opposite", "nr": "near",
    "po": "post office", "bo": "branch office", "so": "sub office", "ho": "head office", "apt": "apartment", "bldg": "building", "bh": "bungalow", "ch": "chowk",
    "mkt": "market", "twp": "township", "vlg": "village", "gp": "gram panchayat", "mah": "maharashtra", "mh": "maharashtra", "tn": "tamil nadu", "ka": "karnataka",
    "dl": "delhi", "up": "uttar pradesh",
}
# What counts as no value.
NULL_LIKE = ("", "null", "none", "na", "n/a", "nan", "-", "--", ".")
NULL_LIKE_SOURCE = ("", "nan", "none", "null", "na", "n/a", "-", "--")
NULL_LIKE_QUALITY = ("", "nan", "none", "null", "na", "n/a")
# Weights of the quality score.
QUALITY_WEIGHTS = {
    "building_name": 10, "building_number": 5, "road_name": 10, "locality": 15, "city_name": 15, "district_name": 15, "state_name": 15, "pincode": 10,
    "full_address": 10, "latitude": 5, "longitude": 5,
}
ADDRESS_PARTS = ("building_number", "building_name", "road_name", "locality", "city_name", "district_name", "state_name", "pincode")
HIERARCHY = (("state_code", "state_name"), ("district_code", "district_name"), ("subdistrict_code", "subdistrict_name"), ("block_code", "block_name"), ("locality_code", "locality"))
NAME_COLUMNS = (
    "state_name", "state_name_local", "district_name", "subdistrict_name", "block_name", "city_name", "locality", "local_body_name", "district_panchayat_name",
    "block_panchayat_name", "gram_panchayat_name", "office_name", "road_name", "building_name", "region_name", "division_name", "circle_name",
)
ABBREVIATION_COLUMNS = ("office_name", "road_name", "building_name", "building_number", "locality", "local_body_name", "full_address")
SYMBOL_COLUMNS = ("building_name", "building_number", "road_name", "locality", "city_name", "full_address", "office_name", "local_body_name")
# The standard schema, in order.
STANDARD_COLUMNS = (
    "serial_number", "pincode", "state_code", "state_name", "state_name_local", "state_or_ut", "state_version", "state_major_version", "state_minor_version",
    "district_code", "district_name", "subdistrict_code", "subdistrict_name", "subdistrict_version", "block_code", "block_name", "city_name", "locality",
    "locality_code", "village_category", "village_status", "village_version", "local_body_code", "local_body_name", "local_body_type_code",
    "local_body_type_name", "local_body_major_version", "local_body_minor_version", "district_panchayat_code", "district_panchayat_name",
    "block_panchayat_code", "block_panchayat_name", "gram_panchayat_code", "gram_panchayat_name", "road_name", "building_name", "building_number",
    "office_name", "office_type", "delivery_status", "urban_status", "region_name", "division_name", "circle_name", "latitude", "longitude",
    "census_2001_code", "census_2011_code", "city_code", "full_address", "source_file",
)
# Further spellings of standard columns (see ingest.aliases for those that follow from a rule).
COLUMN_ALIASES = {
    "serial_number": ("s no", "sl no", "sr no", "building rjid", "objectid", "object id"), "pincode": ("pin code", "pin", "postal code", "zipcode", "zip code"),
    "state_code": ("st code",), "state_name": ("statename", "state union territory"), "state_name_local": ("state name local", "state name in local"),
    "state_or_ut": ("state ut", "union territory"), "district_code": ("dist code",), "district_name": ("district", "dist name", "districtname"),
    "subdistrict_code": ("sub district code", "subdistrictcode", "tehsil code", "taluk code"), "subdistrict_name": ("sub district name", "subdistrictname", "tehsil name", "taluk name"),
    "subdistrict_version": ("sub district version",), "block_code": ("development block code",), "block_name": ("development block name",),
    "city_name": ("city town", "city", "town", "cityname"), "city_code": ("citycode",),
    "locality": ("village name", "village", "area", "locality name", "localityname", "villagename", "village name in english"), "locality_code": ("village code", "localitycode"),
    "local_body_code": ("localbody code",), "local_body_name": ("local body name english", "localbody name"), "local_body_type_name": ("localbody type name",),
    "local_body_major_version": ("localbody major version",), "local_body_minor_version": ("localbody minor version",),
    "block_panchayat_code": ("intermediate block panchayat code",), "block_panchayat_name": ("intermediate block panchayat name",),
    "gram_panchayat_code": ("gram village panchayat code", "village panchayat code"), "gram_panchayat_name": ("gram village panchayat name", "village panchayat name"),
    "road_name": ("road", "street", "street name", "address line 1"), "building_name": ("building", "bldgname", "bldg name", "house name", "premise"),
    "building_number": ("building no", "bldgno", "bldg no", "house number", "house no"),
    "full_address": ("bldg address", "building address", "city address", "district address", "address", "complete address"), "office_name": ("officename", "post office"),
    "office_type": ("officetype",), "delivery_status": ("delivery",), "region_name": ("regionname",), "division_name": ("divisionname",), "circle_name": ("circlename",),
    "latitude": ("lat",), "longitude": ("lon", "lng"), "census_2001_code": ("district census 2001 code", "subdistrict census 2001 code", "village census 2001 code"),
    "census_2011_code": ("district census 2011 code", "subdistrict census 2011 code", "village census 2011 code"),
}
# fmt: on
