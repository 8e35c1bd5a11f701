"""Address column functions: normalising, splitting into parts, and derived keys.

Splitting is one anchored pattern of possessive optional groups per address.
Each group commits to its first match, so the pattern reads the parts from left
to right in a single pass and the row stays inside JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plotline import constants as K
from plotline.functions.text import (
    _FULL, _HALF, _c, blank, bound, full_width_digits, half_width, number_variants, numeral_names,
    numeral_value, numerals_before, strip,
)

_HAN = r"[一-鿿]"
_SECTION = "[一二三四五六七八九十]+段"
_ROAD = f"{_HAN}+(?:路|街|大道)(?:{_SECTION})?"
_DISTRICT = f"(?:{K.INNER_SUFFIX_DISTRICTS}|.{{1,4}}?(?:區|鄉|鎮|市))"
_TOWN = f"(?:{K.INNER_SUFFIX_DISTRICTS}|{_HAN}{{1,3}}?[區鎮鄉市])"
_DISTRICT_PLAIN = ".{1,4}?(?:區|鄉|鎮|市)"
_UNITS = "樓層號巷弄之鄰"
_SEP = "\u0001"

ADDRESS_PARTS = (
    "county_city district village neighborhood street lane alley number sub_number floor".split()
)
QUERY_PARTS = "county_city district street lane alley number sub_number floor".split()


# --- normalising ----------------------------------------------------------
def normalize(col: Column | str, for_query: bool = False) -> Column:
    """Half width, 臺 to 台, numerals before a unit to digits, ``3段`` to ``三段``."""
    c = F.translate(_c(col), _FULL + "巿臺", _HALF + "市台")
    if for_query:
        c = strip(c)

    def sections(text: Column) -> Column:
        named = text
        for i, name in reversed(list(enumerate(K.SECTION_NAMES, start=1))):
            named = F.regexp_replace(named, f"(?<![0-9]){i}段", f"{name}段")
        return F.when(text.rlike("[0-9]段"), named).otherwise(text)

    return bound(numerals_before(c, _UNITS + ("Ff" if for_query else "")), sections)


def compact_form(col: Column | str) -> Column:
    """The normal form without spaces, as used in keys."""
    return F.replace(normalize(col), F.lit(" "), F.lit(""))


def rename_city(col: Column) -> Column:
    """Old counties to the municipality that replaced them; 臺 to 台."""
    c = F.replace(col, F.lit("臺"), F.lit("台"))
    out = c
    for old, new in K.RENAMED_CITIES.items():
        out = F.when(c == old, new).otherwise(out)
    return out


# --- splitting ------------------------------------------------------------
def _pieces(col: Column, pattern: str, groups: str) -> Column:
    """Array of captured groups: one replace that lists the groups, then a split."""
    return F.split(F.regexp_replace(col, "(?s)" + pattern + ".*$", groups), _SEP)


def _tail_pattern(floor: str) -> str:
    return (
        r"(?>([0-9]+)巷)?+(?>([0-9]+)弄)?+"
        r"(?>([0-9]+)(?:之([0-9]+))?號)?+(?>之([0-9]+))?+"
        rf"(?>[,，]?\s*([0-9]+)(?:{floor}))?+(?>之([0-9]+))?+"
    )


def _address_pattern(known_districts: bool) -> str:
    district = _DISTRICT if known_districts else _DISTRICT_PLAIN
    return (
        f"^(?>({K.CITY_PREFIX})(?:{K.CITY_PREFIX})?+)?+"
        f"(?>({district}))?+"
        r"(?>(.{1,5}?里)(?=[^0-9]*(?:路|街|大道|[0-9]+鄰)))?+"
        r"(?>([0-9]+鄰))?+"
        r"(?>(.+?(?:路|街|大道)(?>[一二三四五六七八九十0-9]+段)?+)|([^0-9]+?)(?=[0-9]))?+"
        + _tail_pattern("樓|層")
    )


_QUERY_PATTERN = (
    f"^(?>({K.CITY_PREFIX}))?+"
    f"(?>({_DISTRICT})(?=.))?+"
    r"(?>.{1,5}?里)?+(?>[0-9]+鄰)?+"
    r"(?>(.+?(?:路|街|大道)(?>[一二三四五六七八九十0-9]+段)?+))?+"
    + _tail_pattern("樓|層|[Ff]")
)


def _first_of(p: Column, *idx: int) -> Column:
    return F.coalesce(*[F.nullif(p[i], F.lit("")) for i in idx], F.lit(""))


def parts_struct(normal: Column | str, known_districts: bool = True) -> Column:
    """Array of raw pieces of a *normalised* address; read it with ``part_columns``."""
    groups = _SEP.join(["$1", "$2", "$3", "$4", "$5$6", "$7", "$8", "$9", "$10", "$11", "$12", "$13"])
    return _pieces(_c(normal), _address_pattern(known_districts), groups)


def part_columns(p: Column, raw: Column, district_col: Column | None = None) -> dict[str, Column]:
    """The ten parts as columns, from the pieces ``p``; blanks for lot numbers and NULLs."""
    usable = F.coalesce(raw, F.lit("")).contains("地號") == F.lit(False)
    usable = usable & ~blank(raw)
    out = {
        "county_city": rename_city(p[0]),
        "district": p[1],
        "village": p[2],
        "neighborhood": p[3],
        "street": p[4],
        "lane": p[5],
        "alley": p[6],
        "number": p[7],
        "sub_number": _first_of(p, 8, 9, 11),
        "floor": p[10],
    }
    if district_col is not None:
        given = normalize(strip(F.coalesce(district_col, F.lit(""))))
        out["district"] = F.when(p[1] == "", given).otherwise(p[1])
    return {k: F.when(usable, v).otherwise("") for k, v in out.items()}


def parse(col: Column | str, district_col: Column | str | None = None, known_districts: bool = True) -> Column:
    """Struct of the ten address parts (city only where the address names it)."""
    raw = _c(col)
    d = None if district_col is None else _c(district_col)

    def build(p: Column) -> Column:
        cols = part_columns(p, raw, d)
        return F.struct(*[cols[n].alias(n) for n in ADDRESS_PARTS])

    return bound(parts_struct(normalize(strip(raw)), known_districts), build)


def query_pieces(normal: Column | str) -> Column:
    return _pieces(_c(normal), _QUERY_PATTERN, _SEP.join(f"${i}" for i in range(1, 11)))


def query_columns(p: Column) -> dict[str, Column]:
    """The eight parts of a search text from its pieces."""
    return {
        "county_city": rename_city(p[0]),
        "district": p[1],
        "street": p[2],
        "lane": p[3],
        "alley": p[4],
        "number": p[5],
        "sub_number": _first_of(p, 6, 7, 9),
        "floor": p[8],
    }


def parse_query(col: Column | str) -> Column:
    """Struct of the eight parts of a search text."""

    def build(p: Column) -> Column:
        cols = query_columns(p)
        return F.struct(*[cols[n].alias(n) for n in QUERY_PARTS])

    return bound(query_pieces(normalize(col, for_query=True)), build)


# --- cities and districts -------------------------------------------------
def _plain(col: Column | str) -> Column:
    return F.replace(half_width(strip(col)), F.lit("臺"), F.lit("台"))


def extract_city(col: Column | str) -> Column:
    return rename_city(F.regexp_extract(_plain(col), f"^({K.CITY_PREFIX})", 1))


def extract_district(col: Column | str) -> Column:
    return F.regexp_extract(_plain(col), f"^(?>(?:{K.CITY_PREFIX}))?+({_DISTRICT})", 1)


def city_of_shared_district(district: Column, hint: Column | None = None) -> Column:
    """City of a district name used by several cities: the hint if it is one of them, else the first."""
    table = F.create_map(
        *[x for d, cs in K.SHARED_DISTRICTS.items() for x in (F.lit(d), F.array(*map(F.lit, cs)))]
    )
    cities = table[district]
    if hint is None:
        return F.coalesce(cities[0], F.lit(""))
    h = F.replace(F.coalesce(hint, F.lit("")), F.lit("臺"), F.lit("台"))
    return F.coalesce(F.when(F.array_contains(cities, h), h), cities[0], F.lit(""))


def city_from_code(code: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.CITY_BY_CODE.items() for x in kv])
    return F.coalesce(table[_c(code)], F.lit(""))


def listing_regions(city: Column | str) -> Column:
    """Region ids to try for a city: its own, or the fixed order when unknown."""
    table = F.create_map(*[F.lit(x) for kv in K.LISTING_REGION.items() for x in kv])
    own = table[F.replace(_c(city), F.lit("臺"), F.lit("台"))]
    every = F.array(*[F.lit(i) for i in K.LISTING_REGION_ORDER])
    return F.when(own.isNotNull(), F.array(own)).otherwise(every)


# --- cutting --------------------------------------------------------------
def strip_city_district(col: Column | str) -> Column:
    """Without city and district; the rest keeps its spelling."""
    both = K.CITY_PREFIX.replace("台", "[臺台]")
    c = F.regexp_replace(half_width(strip(col)), f"^(?:{both})", "")
    return strip(F.regexp_replace(c, f"^{_TOWN}", ""))


# A located address by its grammar: village and neighbourhood, road and section or a place name, lane, alley, number.
_VILLAGE = f"(?:{_HAN}+?里(?=[0-9]|{_HAN}+?(?:路|街|大道|巷|村)))?(?:[0-9]+鄰)?"
_LOCATED = f"^{_VILLAGE}({_HAN}*?(?:路|街|大道))?({_SECTION})?({_HAN}*)([0-9]+巷)?([0-9]+弄)?([0-9]+(?:[之-][0-9]+)?號)"
# Where the building ends and its inside begins: the storey.
_INSIDE = "(?:地下)?[0-9一二三四五六七八九十百]+(?:樓|層|[Ff](?![a-z]))"


def _located(c: Column) -> Column:
    """Road, section, place name, lane, alley and number, put together; whatever follows the number is left out.

    A text that does not lead to a number is itself, without village and storey.
    """
    def parts(t: Column) -> Column:
        whole = F.concat(*[F.regexp_extract(t, _LOCATED, i) for i in range(1, 7)])
        other = F.regexp_extract(t, f"^{_VILLAGE}(.*?)(?:{_INSIDE}.*)?$", 1)
        return F.when(t.rlike(_LOCATED), whole).otherwise(other)

    return bound(F.regexp_replace(c, r"\s+", ""), parts)


def road_and_number(col: Column | str) -> Column:
    """Road and house number only: no city, district, village, floor, block or remarks."""
    return _located(strip_city_district(col))


def link_form(col: Column | str) -> Column:
    """As ``road_and_number`` with the linker's prefix rules (up to two districts are cut)."""
    c = F.regexp_replace(half_width(strip(col), "digits"), f"^(?:{K.LINK_CITY_PREFIX})", "")
    # A second district only counts where it repeats the first; otherwise 市民大道 would lose its head.
    return _located(F.regexp_replace(c, f"^({_TOWN})\\1?", ""))


def up_to_number(col: Column | str) -> Column:
    """Everything up to the first ``號``; the text itself if there is none."""
    return F.regexp_replace(_c(col), "^(.*?[0-9]+號).*$", "$1")


def up_to_lane(col: Column | str) -> Column:
    return F.regexp_extract(_c(col), r"(.*?[0-9]+巷)", 1)


def main_number_form(col: Column | str) -> Column:
    """``445之3號`` to ``445號``."""
    return F.regexp_replace(_c(col), "([0-9]+)之[0-9]+號", "$1號")


def road(col: Column | str) -> Column:
    return F.regexp_extract(strip_city_district(col), f"({_ROAD})", 1)


def road_in(col: Column | str) -> Column:
    """Road name inside a text that has no city and district any more."""
    return F.regexp_extract(_c(col), f"({_ROAD})", 1)


def road_and_lane(col: Column | str) -> Column:
    """Road with section, lane and alley, put together from its parts."""
    parts = f"({_HAN}+?(?:路|街|大道))({_SECTION})?([0-9]+巷)?((?<=巷)[0-9]+弄)?"
    rest = F.regexp_replace(strip_city_district(col), f"^{_VILLAGE}", "")
    return bound(rest, lambda t: F.concat(*[F.regexp_extract(t, parts, i) for i in (1, 2, 3, 4)]))


def house_number(col: Column | str) -> Column:
    """The number after a lane if there is one, else the first; -1 if none."""
    c = half_width(_c(col))
    after_lane = F.regexp_extract(c, "巷([0-9]+)號", 1).try_cast("int")
    return F.coalesce(after_lane, F.regexp_extract(c, "([0-9]+)號", 1).try_cast("int"), F.lit(-1))


def first_number(col: Column | str) -> Column:
    """The first ``n號``, NULL if none."""
    return F.regexp_extract(_c(col), "([0-9]+)號", 1).try_cast("int")


def strip_city_shown(col: Column | str) -> Column:
    """Display form: no city in front, a district written twice shown once."""
    city = K.CITY_PREFIX.replace("台", "[臺台]")
    district = f"{_HAN}{{2,3}}[區鎮鄉市]"
    return F.regexp_replace(_c(col), f"^(?:{city}|\\S{{2,3}}縣)?(?:({district})(?=\\1))?", "")


def strip_city_for_key(col: Column | str) -> Column:
    names = "|".join(list(K.CITY_BY_CODE.values()) + list(K.RENAMED_CITIES))
    return F.regexp_replace(_c(col), f"^(?:{names})", "")


def strip_floor(col: Column | str) -> Column:
    """Base address of a building: the text without the storey it ends in, and without the marks left at its end."""
    def cut(t: Column) -> Column:
        storey = F.regexp_extract(t, "(?:地下|-)?[0-9]+(?:樓|[Ff])(?:之|[0-9])*$", 0)
        return F.rtrim(F.substring(t, F.lit(1), F.length(t) - F.length(storey)), F.lit("之號号 "))

    return bound(_c(col), cut)


def map_base(col: Column | str) -> Column:
    """Base address used to group map markers."""
    c = F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"[0-9]+樓.*$", "")
    return F.regexp_replace(F.regexp_replace(c, r"(?i)[0-9]+F.*$", ""), r"地下.*$", "")


def after_hash(col: Column | str) -> Column:
    c = F.coalesce(_c(col), F.lit(""))
    return F.when(c.contains("#"), F.regexp_replace(c, "(?s)^[^#]*#", "")).otherwise(c)


# --- floors ---------------------------------------------------------------
def _floor_names() -> dict[str, str]:
    """一 .. 三十 and 地下一 .. 地下三."""
    d = K.PLAIN_DIGITS
    names = {}
    for n in range(1, 31):
        tens, ones = divmod(n, 10)
        head = "" if tens == 0 else ("十" if tens == 1 else d[tens] + "十")
        names[head + (d[ones] if ones else "")] = str(n)
    return names | {"地下" + d[n]: str(-n) for n in (1, 2, 3)}


def _one_floor(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in _floor_names().items() for x in kv])
    return F.coalesce(table[F.rtrim(c, F.lit("層"))], c)


def floor_info(col: Column | str) -> Column:
    """``九層/十五層`` to struct(floor '9', total '15')."""
    def read(p: Column) -> Column:
        two = F.size(p) == 2
        return F.struct(
            _one_floor(F.trim(F.when(two, p[0]).otherwise(F.array_join(p, "/")))).alias("floor"),
            F.when(two, _one_floor(F.trim(F.get(p, F.lit(1))))).otherwise("").alias("total"),
        )

    return bound(F.split(F.coalesce(_c(col), F.lit("")), "/"), read)


def floor_or_raw(col: Column | str) -> Column:
    return F.coalesce(F.nullif(floor_info(col)["floor"], F.lit("")), _c(col))


# --- geocoding forms ------------------------------------------------------
def _upgrade_county(c: Column) -> Column:
    """``桃園縣中壢市`` to ``桃園市中壢區``: a renamed county takes its township along."""
    old = "|".join(K.GEO_COUNTY_UPGRADE)
    city = F.create_map(*[F.lit(x) for kv in K.GEO_COUNTY_UPGRADE.items() for x in kv])
    town = F.regexp_replace(
        F.regexp_replace(c, f"^(?:{old})", ""), f"^({_HAN}{{2,4}}?)[市鎮鄉]", "$1區"
    )
    upgraded = F.when(
        c.startswith("高雄縣三民鄉"), F.regexp_replace(c, "^高雄縣三民鄉", "高雄市那瑪夏區")
    ).otherwise(F.concat(city[F.regexp_extract(c, f"^({old})", 1)], town))
    return F.when(c.rlike(f"^(?:{old})"), upgraded).otherwise(c)


def geo_normalize(col: Column | str) -> Column:
    """Geocoding form: 臺 spelling, counties upgraded, no floor, shared-part or village tails."""
    c = F.regexp_replace(strip(_c(col)), "^null|&[^;；]+[;；]", "")
    c = F.translate(c, "０１２３４５６７８９巿", "0123456789市")
    c = F.regexp_replace(c, "台(?=[北中南]市|東)", "臺")
    c = F.regexp_replace(c, f"^({_HAN}{{2,8}}[市縣])\\1", "$1")
    c = bound(c, _upgrade_county)
    c = F.regexp_replace(
        c, r"(?:[一二三四五六七八九百十]+樓|[0-9]+(?:樓|[Ff])|等?共用|房屋|地下|店(?!區)).*$", ""
    )
    c = F.regexp_replace(c, f"(?<=[區鎮鄉市縣]){_HAN}{{2,4}}里[0-9]*鄰?|\\s+", "")
    return F.nullif(c, F.lit(""))


def geo_base(geo: Column | str) -> Column:
    """Up to the house number; expects the geocoding form."""
    return F.regexp_replace(_c(geo), "^(.+?[0-9]+(?:之[0-9]+)?號).*$", "$1")


def _geo_rest(geo: Column | str) -> Column:
    c = F.regexp_replace(_c(geo), "^.*?[市縣]", "")
    return F.regexp_replace(c, f"^(?:{K.INNER_SUFFIX_DISTRICTS}|[^路街道]*?[區鎮鄉市])", "")


def geo_road(geo: Column | str) -> Column:
    """Road with lane and alley; NULL if there is none."""
    m = F.regexp_extract(_geo_rest(geo), f"({_ROAD}(?:[0-9]+巷)?(?:[0-9]+弄)?)", 1)
    return F.nullif(m, F.lit(""))


def geo_road_base(geo: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_geo_rest(geo), f"({_ROAD})", 1), F.lit(""))


def geo_complete(geo: Column | str, district: Column | str, city: Column) -> Column:
    """Put the city (and district) in front of a geocoding form that has none."""
    d = F.coalesce(_c(district), F.lit(""))
    alias = F.create_map(*[F.lit(x) for kv in K.GEO_CITY_ALIASES.items() for x in kv])
    old = "|".join(K.GEO_CITY_ALIASES)

    def complete(c: Column) -> Column:
        named = F.when(
            c.rlike(f"^(?:{old})"),
            F.concat(alias[F.substring(c, 1, 3)], F.substring(c, F.lit(4), F.length(c))),
        ).otherwise(c)
        has_city = c.rlike("^(?:臺|台|新|桃|高|基|宜|花|屏|雲|嘉|苗|彰|南投|澎|金|連)")
        with_city = F.concat(city, F.when(c.contains(d), "").otherwise(d), c)
        return F.when(has_city, named).when((d != "") & ~blank(city), with_city).otherwise(c)

    return bound(_c(geo), complete)


def road_key(geo: Column | str) -> Column:
    """City and district prefix plus road, one form for every writer and reader of road points."""

    def key(c: Column) -> Column:
        prefix = F.regexp_extract(c, f"^(.*?[市縣](?:{K.INNER_SUFFIX_DISTRICTS}|.*?[區鎮鄉市]))", 1)
        return F.concat(prefix, geo_road(c))

    return bound(_c(geo), key)


_POINT_PATTERN = (
    f"^(?>{_HAN}{{2,4}}?[市縣])?+(?>({K.INNER_SUFFIX_DISTRICTS}|{_HAN}{{1,4}}?[區鎮鄉市]))?+"
    f".*?(?>({_ROAD}))(?>([0-9]+巷))?+(?>([0-9]+弄))?+(?>([0-9]+(?:之[0-9]+)?))?+"
)


def point_key(geo: Column | str) -> Column:
    """struct(district, street incl. lane and alley, housenumber) to look up an address point."""

    def read(p: Column) -> Column:
        pick = lambda i: F.when(F.size(p) == 3, F.nullif(F.get(p, F.lit(i)), F.lit("")))
        return F.struct(
            F.coalesce(pick(0), F.lit("")).alias("district"),
            pick(1).alias("street"),
            pick(2).alias("housenumber"),
        )

    return bound(_pieces(_c(geo), _POINT_PATTERN, _SEP.join(["$1", "$2$3$4", "$5"])), read)


def point_number(col: Column | str) -> Column:
    """House number of a point: half width, no 號, ``126-5`` as ``126之5``."""
    c = F.rtrim(F.trim(half_width(F.coalesce(_c(col), F.lit("")), "digits")), F.lit("號"))
    return F.regexp_replace(c, "^([0-9]+)-([0-9]+)$", "$1之$2")


def point_city(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), "台(?=[北中南]市|東|灣)", "臺")


# --- dedup key ------------------------------------------------------------
def dedup_key(
    date: Column | str, address: Column | str, price: Column | str, normal: Column | str | None = None
) -> Column:
    """``date7|address without city|price``; NULL where the address normalises to nothing.

    ``normal`` may give the address's normal form where a table has it already.
    """
    d = F.substring(F.replace(F.coalesce(_c(date), F.lit("")), F.lit("/"), F.lit("")), 1, 7)
    p = F.coalesce(_c(price).cast("long"), F.lit(0)).cast("string")
    form = compact_form(F.coalesce(_c(address), F.lit(""))) if normal is None else F.replace(
        _c(normal), F.lit(" "), F.lit("")
    )
    return bound(strip_city_for_key(form), lambda a: F.when(a != "", F.concat_ws("|", d, a, p)))


# --- search variants ------------------------------------------------------
_VARIANT_NUMERALS = "[零〇一兩二三四五六七八九十百千]"
_VARIANT_BEFORE = r"(?:[樓層號巷弄段之]|F(?:[0-9]|$))"


def tokens(col: Column | str) -> Column:
    """Array of struct(type num|cn_num|text, val, arabic) of a search text."""
    n = f"{_VARIANT_NUMERALS}+(?={_VARIANT_BEFORE})"
    found = F.regexp_extract_all(
        half_width(_c(col)), F.lit(f"([0-9]+|{n}|(?:(?!{n})[^0-9])+)"), F.lit(1)
    )
    # A numeral piece is followed by its unit, which starts the next piece.
    def token(t: Column) -> Column:
        value = F.when(t.rlike(f"^{_VARIANT_NUMERALS}+$"), numeral_value(t))
        kind = F.when(t.rlike("^[0-9]+$"), "num").when(value > 0, "cn_num").otherwise("text")
        return F.struct(kind.alias("type"), t.alias("val"), F.when(value > 0, value).alias("arabic"))

    return F.transform(found, token)


def variants(col: Column | str) -> Column:
    """All spellings of a search text (digits half, full, written), sorted and distinct."""
    raw = strip(_c(col))

    def spellings(t: Column) -> Column:
        as_text = t["arabic"].cast("string")
        written = F.concat(
            F.array(t["val"], as_text, full_width_digits(as_text)), numeral_names(t["arabic"])
        )
        return (
            F.when(t["type"] == "num", number_variants(t["val"]))
            .when(t["type"] == "cn_num", F.array_distinct(written))
            .otherwise(F.array(t["val"]))
        )

    product = F.aggregate(
        F.transform(tokens(_c(col)), spellings),
        F.array(F.lit("")),
        lambda acc, opts: F.flatten(
            F.transform(acc, lambda head: F.transform(opts, lambda o: F.concat(head, o)))
        ),
    )
    extra = F.array(raw, full_width_digits(half_width(raw)))
    return F.array_sort(F.array_distinct(F.concat(product, extra)))


def shortened(col: Column | str) -> Column:
    """Progressively shorter search texts: full, up to 號, up to 巷, up to the lane digits, road."""

    def cuts(c: Column) -> Column:
        return F.array(
            c,
            F.regexp_extract(c, r"^(.*?[0-9]+(?:之[0-9]+)?號)", 1),
            F.regexp_extract(c, r"^(.*?[0-9]+巷)(?:[0-9]+弄)?", 0),
            F.regexp_extract(c, r"^(.*?[0-9]+巷)", 1),
            F.regexp_extract(c, r"^(.*?[0-9]+)巷", 1),
            F.regexp_extract(c, f"^(.*?(?:路|街|大道)(?:{_SECTION})?)", 1),
        )

    every = bound(normalize(col, for_query=True), cuts)
    return F.array_distinct(F.filter(every, lambda x: x != ""))
