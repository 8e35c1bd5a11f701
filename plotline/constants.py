"""Fixed values of the domain: word lists, unit factors, lookup tables.

Every table here is small and closed.  The full list of townships is *not*
kept in code: it is a parameter (see ``operators.gazetteer``), read from a file
or derived from the transactions themselves.
"""

# One ping in square metres, as used by search, filters and presentation.
PING_SQM = 3.30579
# One ping in square metres, as used when API rows (areas in ping) are imported.
API_PING_SQM = 3.305785

# --- numerals -------------------------------------------------------------
NUMERAL_DIGITS = {
    "○": 0, "零": 0, "〇": 0,
    "一": 1, "壹": 1,
    "二": 2, "貳": 2, "兩": 2,
    "三": 3, "參": 3, "叁": 3,
    "四": 4, "肆": 4,
    "五": 5, "伍": 5,
    "六": 6, "陸": 6,
    "七": 7, "柒": 7,
    "八": 8, "捌": 8,
    "九": 9, "玖": 9,
}
NUMERAL_UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
# Characters that may form a numeral inside an address.
NUMERAL_CHARS = "○零一壹二貳兩三參叁四肆五伍六陸七柒八捌九玖十拾百佰千仟"
PLAIN_DIGITS = "零一二三四五六七八九"
SECTION_NAMES = "一二三四五六七八九十"  # 1段 .. 10段

# --- cities ---------------------------------------------------------------
CITY_BY_CODE = {
    "A": "台北市", "B": "台中市", "C": "基隆市", "D": "台南市",
    "E": "高雄市", "F": "新北市", "G": "宜蘭縣", "H": "桃園市",
    "I": "嘉義市", "J": "新竹縣", "K": "苗栗縣", "M": "南投縣",
    "N": "彰化縣", "O": "新竹市", "P": "雲林縣", "Q": "嘉義縣",
    "T": "屏東縣", "U": "花蓮縣", "V": "台東縣", "W": "金門縣",
    "X": "澎湖縣", "Z": "連江縣",
}
# County names replaced by a municipality.
RENAMED_CITIES = {
    "台北縣": "新北市", "桃園縣": "桃園市", "台中縣": "台中市",
    "台南縣": "台南市", "高雄縣": "高雄市",
}
# City names an address may start with (after 臺 -> 台).
CITY_PREFIX = (
    "台北市|新北市|桃園(?:市|縣)|台中(?:市|縣)|台南(?:市|縣)|"
    "高雄(?:市|縣)|基隆市|新竹(?:市|縣)|嘉義(?:市|縣)|"
    "苗栗縣|彰化縣|南投縣|雲林縣|屏東縣|"
    "台東縣|花蓮縣|宜蘭縣|澎湖縣|金門縣|連江縣|台北縣"
)
# City names accepted as a prefix by the community linker (both spellings).
LINK_CITY_PREFIX = (
    "[臺台]北市|新北市|桃園市|桃園縣|[臺台]中市|[臺台]南市|高雄市|基隆市|新竹市|新竹縣|"
    "苗栗縣|彰化縣|南投縣|雲林縣|嘉義市|嘉義縣|屏東縣|宜蘭縣|花蓮縣|[臺台]東縣|澎湖縣|金門縣|連江縣"
)
# Listing-site region ids by city, and the order tried when the city is unknown.
LISTING_REGION = {
    "台北市": 1, "基隆市": 2, "新北市": 3, "新竹市": 4, "新竹縣": 5, "桃園市": 6,
    "桃園縣": 6, "苗栗縣": 7, "台中市": 8, "彰化縣": 10, "南投縣": 11, "嘉義市": 12,
    "嘉義縣": 13, "雲林縣": 14, "台南市": 15, "高雄市": 17, "屏東縣": 19,
    "宜蘭縣": 21, "台東縣": 22, "花蓮縣": 23, "澎湖縣": 24, "金門縣": 25,
}
LISTING_REGION_ORDER = [1, 3, 6, 8, 15, 17, 5, 4, 10, 21, 19]

# District names shared by several cities, most traded city first.
SHARED_DISTRICTS = {
    "中山區": ["台北市", "基隆市"],
    "中正區": ["台北市", "基隆市"],
    "信義區": ["台北市", "基隆市"],
    "仁愛區": ["基隆市"],
    "大安區": ["台北市", "台中市"],
    "東區": ["台中市", "台南市", "新竹市", "嘉義市"],
    "西區": ["台中市", "嘉義市"],
    "南區": ["台中市", "台南市"],
    "北區": ["台中市", "台南市", "新竹市"],
    "中區": ["台中市"],
    "中西區": ["台南市"],
    "安平區": ["台南市"],
}
# District names with 鎮 or 市 inside; tried before the shortest match.
INNER_SUFFIX_DISTRICTS = "平鎮區|前鎮區|左鎮區|新市區"

# --- geocoding text rules -------------------------------------------------
GEO_CITY_ALIASES = {
    "台北市": "臺北市", "台中市": "臺中市", "台南市": "臺南市",
    "台東市": "臺東市", "台東縣": "臺東縣", "桃園縣": "桃園市",
}
GEO_COUNTY_UPGRADE = {
    "桃園縣": "桃園市", "台北縣": "新北市", "臺北縣": "新北市",
    "台中縣": "臺中市", "臺中縣": "臺中市", "台南縣": "臺南市",
    "臺南縣": "臺南市", "高雄縣": "高雄市",
}

# --- notes ----------------------------------------------------------------
SPECIAL_NOTE_WORDS = [
    "親友", "員工", "共有人", "特殊關係", "利害關係",
    "調協", "欻欄", "法拍", "濟助", "社會住宅",
    "总價顯著偏低", "價格顯著偏高",
    "政府機關", "建商與地主",
    "債權債務", "繼承",
    "急買急賣", "受債權人",
]

# Words that mark an address as a place near something, not a house number.
CROSSING_WORDS = ["口", "旁", "對面", "附近", "和", "與", "及", "交叉"]
MISC_PLACE_WORDS = ["路口", "交叉", "旁", "對面", "和", "與", "及"]

# Bounding box of the territory, exclusive.
LAT_MIN, LAT_MAX, LNG_MIN, LNG_MAX = 20.0, 27.0, 118.0, 123.0
