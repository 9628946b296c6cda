"""Geography dimension tables: regions, cities, IP prefixes, time zones, coordinates.

Small fixed dimensions (about 120 rows each), broadcast in every join.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# Region -> cities, in the original order.  "Dubai, UAE" is listed in two
# regions, so the flattened list has 116 entries and 115 distinct places.
# ---------------------------------------------------------------------------
REGION_TO_CITIES = {
    "Domestic US": ["New York, USA", "Los Angeles, USA", "Chicago, USA", "San Francisco, USA", "Miami, USA",
                    "Dallas, USA", "Houston, USA", "Seattle, USA", "Atlanta, USA", "Boston, USA", "Denver, USA",
                    "Las Vegas, USA", "Philadelphia, USA"],
    "Europe": ["Paris, France", "Berlin, Germany", "Madrid, Spain", "Rome, Italy", "London, UK",
               "Amsterdam, Netherlands", "Vienna, Austria", "Stockholm, Sweden", "Dublin, Ireland",
               "Zurich, Switzerland", "Brussels, Belgium", "Lisbon, Portugal", "Warsaw, Poland",
               "Athens, Greece", "Prague, Czech Republic", "Oslo, Norway"],
    "East Asia": ["Shanghai, China", "Beijing, China", "Tokyo, Japan", "Osaka, Japan", "Seoul, South Korea",
                  "Hong Kong, China", "Taipei, Taiwan", "Shenzhen, China", "Guangzhou, China", "Chengdu, China"],
    "South Asia": ["Mumbai, India", "New Delhi, India", "Bangalore, India", "Chennai, India", "Hyderabad, India",
                   "Kolkata, India", "Dhaka, Bangladesh", "Karachi, Pakistan"],
    "Southeast Asia": ["Singapore, Singapore", "Jakarta, Indonesia", "Bangkok, Thailand", "Kuala Lumpur, Malaysia",
                       "Ho Chi Minh City, Vietnam", "Hanoi, Vietnam", "Manila, Philippines",
                       "Phnom Penh, Cambodia"],
    "South America": ["São Paulo, Brazil", "Rio de Janeiro, Brazil", "Buenos Aires, Argentina", "Santiago, Chile",
                      "Bogotá, Colombia", "Lima, Peru", "Quito, Ecuador", "Montevideo, Uruguay",
                      "Caracas, Venezuela"],
    "Middle East": ["Dubai, UAE", "Abu Dhabi, UAE", "Riyadh, Saudi Arabia", "Jeddah, Saudi Arabia", "Doha, Qatar",
                    "Kuwait City, Kuwait", "Manama, Bahrain", "Muscat, Oman", "Istanbul, Turkey", "Tehran, Iran"],
    "Africa": ["Johannesburg, South Africa", "Cape Town, South Africa", "Lagos, Nigeria", "Nairobi, Kenya",
               "Cairo, Egypt", "Casablanca, Morocco", "Accra, Ghana", "Addis Ababa, Ethiopia",
               "Dar es Salaam, Tanzania", "Algiers, Algeria"],
    "Oceania": ["Sydney, Australia", "Melbourne, Australia", "Brisbane, Australia", "Auckland, New Zealand",
                "Wellington, New Zealand", "Perth, Australia"],
    "Russia & Central Asia": ["Moscow, Russia", "Saint Petersburg, Russia", "Almaty, Kazakhstan",
                              "Tashkent, Uzbekistan", "Baku, Azerbaijan", "Bishkek, Kyrgyzstan", "Yerevan, Armenia"],
    "Offshore Banking": ["Cayman Islands", "British Virgin Islands", "Bahamas", "Panama", "Switzerland",
                         "Luxembourg", "Liechtenstein", "Hong Kong", "Singapore", "Dubai, UAE", "Seychelles",
                         "Mauritius", "Isle of Man", "Monaco", "Andorra", "Vanuatu", "Bermuda", "Cook Islands",
                         "Labuan, Malaysia"],
}

# Place, IP prefix, time zone (115 places, original order).
PLACES = [
    ("New York, USA", "73.56", "America/New_York"),
    ("Los Angeles, USA", "172.58", "America/Los_Angeles"),
    ("Chicago, USA", "98.23", "America/Chicago"),
    ("San Francisco, USA", "66.50", "America/Los_Angeles"),
    ("Miami, USA", "79.45", "America/New_York"),
    ("Dallas, USA", "104.12", "America/Chicago"),
    ("Houston, USA", "107.89", "America/Chicago"),
    ("Seattle, USA", "23.76", "America/Los_Angeles"),
    ("Atlanta, USA", "68.90", "America/New_York"),
    ("Boston, USA", "12.34", "America/New_York"),
    ("Denver, USA", "45.67", "America/Denver"),
    ("Las Vegas, USA", "128.90", "America/Los_Angeles"),
    ("Philadelphia, USA", "150.12", "America/New_York"),
    ("Paris, France", "51.75", "Europe/Paris"),
    ("Berlin, Germany", "88.99", "Europe/Berlin"),
    ("Madrid, Spain", "213.97", "Europe/Madrid"),
    ("Rome, Italy", "151.13", "Europe/Rome"),
    ("London, UK", "81.22", "Europe/London"),
    ("Amsterdam, Netherlands", "83.45", "Europe/Amsterdam"),
    ("Vienna, Austria", "84.56", "Europe/Vienna"),
    ("Stockholm, Sweden", "85.67", "Europe/Stockholm"),
    ("Dublin, Ireland", "86.78", "Europe/Dublin"),
    ("Zurich, Switzerland", "87.89", "Europe/Zurich"),
    ("Brussels, Belgium", "88.90", "Europe/Brussels"),
    ("Lisbon, Portugal", "89.01", "Europe/Lisbon"),
    ("Warsaw, Poland", "90.12", "Europe/Warsaw"),
    ("Athens, Greece", "91.23", "Europe/Athens"),
    ("Prague, Czech Republic", "92.34", "Europe/Prague"),
    ("Oslo, Norway", "93.45", "Europe/Oslo"),
    ("Shanghai, China", "203.195", "Asia/Shanghai"),
    ("Beijing, China", "203.196", "Asia/Shanghai"),
    ("Tokyo, Japan", "210.153", "Asia/Tokyo"),
    ("Osaka, Japan", "210.154", "Asia/Tokyo"),
    ("Seoul, South Korea", "121.254", "Asia/Seoul"),
    ("Hong Kong, China", "211.165", "Asia/Hong_Kong"),
    ("Taipei, Taiwan", "212.176", "Asia/Taipei"),
    ("Shenzhen, China", "203.197", "Asia/Shanghai"),
    ("Guangzhou, China", "203.198", "Asia/Shanghai"),
    ("Chengdu, China", "203.199", "Asia/Shanghai"),
    ("Mumbai, India", "102.34", "Asia/Kolkata"),
    ("New Delhi, India", "102.35", "Asia/Kolkata"),
    ("Bangalore, India", "102.36", "Asia/Kolkata"),
    ("Chennai, India", "102.37", "Asia/Kolkata"),
    ("Hyderabad, India", "102.38", "Asia/Kolkata"),
    ("Kolkata, India", "102.39", "Asia/Kolkata"),
    ("Dhaka, Bangladesh", "103.40", "Asia/Dhaka"),
    ("Karachi, Pakistan", "104.41", "Asia/Karachi"),
    ("Singapore, Singapore", "115.56", "Asia/Singapore"),
    ("Jakarta, Indonesia", "116.67", "Asia/Jakarta"),
    ("Bangkok, Thailand", "117.78", "Asia/Bangkok"),
    ("Kuala Lumpur, Malaysia", "118.89", "Asia/Kuala_Lumpur"),
    ("Ho Chi Minh City, Vietnam", "119.90", "Asia/Ho_Chi_Minh"),
    ("Hanoi, Vietnam", "120.01", "Asia/Ho_Chi_Minh"),
    ("Manila, Philippines", "121.12", "Asia/Manila"),
    ("Phnom Penh, Cambodia", "122.23", "Asia/Phnom_Penh"),
    ("São Paulo, Brazil", "200.98", "America/Sao_Paulo"),
    ("Rio de Janeiro, Brazil", "201.99", "America/Sao_Paulo"),
    ("Buenos Aires, Argentina", "190.3", "America/Argentina/Buenos_Aires"),
    ("Santiago, Chile", "202.88", "America/Santiago"),
    ("Bogotá, Colombia", "203.77", "America/Bogota"),
    ("Lima, Peru", "204.66", "America/Lima"),
    ("Quito, Ecuador", "205.55", "America/Guayaquil"),
    ("Montevideo, Uruguay", "206.44", "America/Montevideo"),
    ("Caracas, Venezuela", "207.33", "America/Caracas"),
    ("Dubai, UAE", "94.200", "Asia/Dubai"),
    ("Abu Dhabi, UAE", "95.201", "Asia/Dubai"),
    ("Riyadh, Saudi Arabia", "188.48", "Asia/Riyadh"),
    ("Jeddah, Saudi Arabia", "189.49", "Asia/Riyadh"),
    ("Doha, Qatar", "190.60", "Asia/Qatar"),
    ("Kuwait City, Kuwait", "191.71", "Asia/Kuwait"),
    ("Manama, Bahrain", "192.82", "Asia/Bahrain"),
    ("Muscat, Oman", "193.93", "Asia/Muscat"),
    ("Istanbul, Turkey", "194.04", "Europe/Istanbul"),
    ("Tehran, Iran", "195.15", "Asia/Tehran"),
    ("Johannesburg, South Africa", "210.16", "Africa/Johannesburg"),
    ("Cape Town, South Africa", "210.17", "Africa/Johannesburg"),
    ("Lagos, Nigeria", "210.18", "Africa/Lagos"),
    ("Nairobi, Kenya", "210.19", "Africa/Nairobi"),
    ("Cairo, Egypt", "210.20", "Africa/Cairo"),
    ("Casablanca, Morocco", "210.21", "Africa/Casablanca"),
    ("Accra, Ghana", "210.22", "Africa/Accra"),
    ("Addis Ababa, Ethiopia", "210.23", "Africa/Addis_Ababa"),
    ("Dar es Salaam, Tanzania", "210.24", "Africa/Dar_es_Salaam"),
    ("Algiers, Algeria", "210.25", "Africa/Algiers"),
    ("Sydney, Australia", "220.26", "Australia/Sydney"),
    ("Melbourne, Australia", "220.27", "Australia/Melbourne"),
    ("Brisbane, Australia", "220.28", "Australia/Brisbane"),
    ("Auckland, New Zealand", "220.29", "Pacific/Auckland"),
    ("Wellington, New Zealand", "220.30", "Pacific/Auckland"),
    ("Perth, Australia", "220.31", "Australia/Perth"),
    ("Moscow, Russia", "230.32", "Europe/Moscow"),
    ("Saint Petersburg, Russia", "230.33", "Europe/Moscow"),
    ("Almaty, Kazakhstan", "230.34", "Asia/Almaty"),
    ("Tashkent, Uzbekistan", "230.35", "Asia/Tashkent"),
    ("Baku, Azerbaijan", "230.36", "Asia/Baku"),
    ("Bishkek, Kyrgyzstan", "230.37", "Asia/Bishkek"),
    ("Yerevan, Armenia", "230.38", "Asia/Yerevan"),
    ("Cayman Islands", "240.39", "America/Cayman"),
    ("British Virgin Islands", "240.40", "America/Tortola"),
    ("Bahamas", "240.41", "America/Nassau"),
    ("Panama", "240.42", "America/Panama"),
    ("Switzerland", "240.43", "Europe/Zurich"),
    ("Luxembourg", "240.44", "Europe/Luxembourg"),
    ("Liechtenstein", "240.45", "Europe/Vaduz"),
    ("Hong Kong", "240.46", "Asia/Hong_Kong"),
    ("Singapore", "240.47", "Asia/Singapore"),
    ("Seychelles", "240.48", "Indian/Mahe"),
    ("Mauritius", "240.49", "Indian/Mauritius"),
    ("Isle of Man", "240.50", "Europe/London"),
    ("Monaco", "240.51", "Europe/Monaco"),
    ("Andorra", "240.52", "Europe/Andorra"),
    ("Vanuatu", "240.53", "Pacific/Efate"),
    ("Bermuda", "240.54", "Atlantic/Bermuda"),
    ("Cook Islands", "240.55", "Pacific/Rarotonga"),
    ("Labuan, Malaysia", "240.56", "Asia/Kuala_Lumpur"),
]

# City, latitude, longitude (47 cities).  The three eastern
# Australian cities are stored with a positive latitude in the source; they are
# negated here (southern hemisphere).
COORDS = [
    ("New York, USA", 40.7128, -74.006),
    ("Los Angeles, USA", 34.0522, -118.2437),
    ("San Francisco, USA", 37.7749, -122.4194),
    ("Chicago, USA", 41.8781, -87.6298),
    ("Miami, USA", 25.7617, -80.1918),
    ("Houston, USA", 29.7604, -95.3698),
    ("Seattle, USA", 47.6062, -122.3321),
    ("Atlanta, USA", 33.749, -84.388),
    ("Boston, USA", 42.3601, -71.0589),
    ("Dallas, USA", 32.7767, -96.797),
    ("London, UK", 51.5074, -0.1278),
    ("Manchester, UK", 53.4808, -2.2426),
    ("Edinburgh, UK", 55.9533, -3.1883),
    ("Berlin, Germany", 52.52, 13.405),
    ("Munich, Germany", 48.1351, 11.582),
    ("Frankfurt, Germany", 50.1109, 8.6821),
    ("Paris, France", 48.8566, 2.3522),
    ("Lyon, France", 45.764, 4.8357),
    ("Marseille, France", 43.2965, 5.3698),
    ("Madrid, Spain", 40.4168, -3.7038),
    ("Barcelona, Spain", 41.3851, 2.1734),
    ("Rome, Italy", 41.9028, 12.4964),
    ("Milan, Italy", 45.4642, 9.19),
    ("Dubai, UAE", 25.276987, 55.296249),
    ("Abu Dhabi, UAE", 24.4539, 54.3773),
    ("Tokyo, Japan", 35.6895, 139.6917),
    ("Osaka, Japan", 34.6937, 135.5023),
    ("Shanghai, China", 31.2304, 121.4737),
    ("Beijing, China", 39.9042, 116.4074),
    ("Hong Kong, China", 22.3193, 114.1694),
    ("Singapore, Singapore", 1.3521, 103.8198),
    ("Sydney, Australia", -33.8688, 151.2093),
    ("Melbourne, Australia", -37.8136, 144.9631),
    ("Brisbane, Australia", -27.4698, 153.0251),
    ("Toronto, Canada", 43.6532, -79.3832),
    ("Vancouver, Canada", 49.2827, -123.1207),
    ("Montreal, Canada", 45.5017, -73.5673),
    ("São Paulo, Brazil", -23.5505, -46.6333),
    ("Rio de Janeiro, Brazil", -22.9068, -43.1729),
    ("Buenos Aires, Argentina", -34.6037, -58.3816),
    ("Cape Town, South Africa", -33.9249, 18.4241),
    ("Johannesburg, South Africa", -26.2041, 28.0473),
    ("Moscow, Russia", 55.7558, 37.6173),
    ("Saint Petersburg, Russia", 59.9343, 30.3351),
    ("Mumbai, India", 19.076, 72.8777),
    ("New Delhi, India", 28.6139, 77.209),
    ("Bangalore, India", 12.9716, 77.5946),
]


REGION_ROWS = [(r, i, c) for r, cs in REGION_TO_CITIES.items() for i, c in enumerate(cs)]
ALL_CITIES = [c for _, _, c in REGION_ROWS]            # 116 entries, duplicates kept

PLACE_SCHEMA = "location string, ip_prefix string, tz string"
COORD_SCHEMA = "location string, lat double, lon double"
REGION_SCHEMA = "region string, pos int, location string"


def places_df(spark):
    return spark.createDataFrame(PLACES, PLACE_SCHEMA)


def coords_df(spark):
    return spark.createDataFrame(COORDS, COORD_SCHEMA)


def regions_df(spark):
    return spark.createDataFrame(REGION_ROWS, REGION_SCHEMA)
