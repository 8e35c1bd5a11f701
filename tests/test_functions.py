"""Golden cases of the address rules and the small column functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.functions import address as A, dates as D, money as M, text as T, values as V
from plotline.operators import gazetteer as G, standardise as Z

NUMERALS = [
    ("一", 1), ("二", 2), ("三", 3), ("十", 10), ("十一", 11), ("二十", 20), ("二十三", 23), ("一百", 100),
    ("一百二十三", 123), ("貳拾參", 23), ("一二三", 123), ("兩千零五", 2005), ("零", 0), ("十甲", None), ("○○", None), ("", None),
]
NORMAL = [
    ("５２號", "52號"), ("二樓", "2樓"), ("２９巷", "29巷"), ("三樓之３", "3樓之3"), ("十三樓", "13樓"),
    ("臺北市", "台北市"), ("台北巿", "台北市"), ("三民路3段", "三民路三段"), ("三民路10段", "三民路十段"),
    ("三民路12段", "三民路12段"), ("四五", "四五"), ("一二三巷", "123巷"),
]
PARTS = "county_city district street lane alley number sub_number floor".split()
ADDRESSES = [
    ("新竹縣竹北市日興一街５２號二樓", "竹北市", "新竹縣 竹北市 日興一街 - - 52 - 2"),
    ("臺北市松山區三民路２９巷１號三樓之３", "松山區", "台北市 松山區 三民路 29 - 1 3 3"),
    ("新北市新店區三民路２９巷２弄３號五樓", "新店區", "新北市 新店區 三民路 29 2 3 - 5"),
    ("台南市永康區王行里育樂街１４３巷１２之１號", "永康區", "台南市 永康區 育樂街 143 - 12 1 -"),
    ("新北市中和區員山路４２３巷１４弄９號三樓", "中和區", "新北市 中和區 員山路 423 14 9 - 3"),
    ("台北市中正區忠孝東路二段１３０號九樓之１", "中正區", "台北市 中正區 忠孝東路二段 - - 130 1 9"),
    ("平鎮段827地號", "平鎮區", "- - - - - - - -"),
    ("新竹縣竹北市竹北市十興里日興一街31巷1號", "竹北市", "新竹縣 竹北市 日興一街 31 - 1 - -"),
    ("高雄市大寮區進學路167巷86號", "大寮區", "高雄市 大寮區 進學路 167 - 86 - -"),
    ("新北市汐止區湖前街１１０巷９７弄６之５號１４樓", "汐止區", "新北市 汐止區 湖前街 110 97 6 5 14"),
    ("臺北市大安區仁愛路三段５３之３號二十一樓", "大安區", "台北市 大安區 仁愛路三段 - - 53 3 21"),
    ("臺北市大安區仁愛路三段５３之８號十二樓", "大安區", "台北市 大安區 仁愛路三段 - - 53 8 12"),
    ("台北市內湖區民權東路六段150之3號9樓之1", "內湖區", "台北市 內湖區 民權東路六段 - - 150 3 9"),
    ("基隆市中正區新豐街486號之5      2樓", "中正區", "基隆市 中正區 新豐街 - - 486 5 2"),
    ("桃園市平鎮區中豐路5號", "", "桃園市 平鎮區 中豐路 - - 5 - -"),
    ("桃園縣中壢市中豐路5號", "", "桃園市 中壢市 中豐路 - - 5 - -"),
]
CITIES = [
    ("中山區松江路25巷5號2樓", "", "台北市"), ("中山區中和路153號", "基隆市", "基隆市"),
    ("中正區忠孝東路一段10號", "台北市", "台北市"), ("中正區新豐街486號", "基隆市", "基隆市"),
    ("東區光復路一段89號", "新竹市", "新竹市"), ("中西區民權路100號", "", "台南市"),
    ("中區三民路100號", "", "台中市"), ("安平區安平路100號", "", "台南市"), ("臺北市大安區忠孝東路100號", "", "台北市"),
]


def test_numerals(spark):
    df = spark.createDataFrame(NUMERALS, "t string, e long")
    assert [(r.t, r.v) for r in df.select("t", T.numeral_value("t").alias("v")).collect()] == NUMERALS


def test_numeral_names_round_trip(spark):
    n = spark.range(1, 10000).select(F.col("id"), F.explode(T.numeral_names("id")).alias("name"))
    assert n.where(~T.numeral_value("name").eqNullSafe(F.col("id"))).count() == 0


def test_normalize(spark):
    df = spark.createDataFrame(NORMAL, "t string, e string")
    assert [(r.t, r.v) for r in df.select("t", A.normalize("t").alias("v")).collect()] == NORMAL


@pytest.mark.parametrize("staged", [False, True])
def test_parse_address(spark, staged):
    df = spark.createDataFrame([(a, d) for a, d, _ in ADDRESSES], "address string, town string")
    if staged:
        got = Z.add_parts(df, district_col="town").collect()
    else:
        got = [r.p for r in df.select(A.parse("address", "town").alias("p")).collect()]
    for row, (address, _, want) in zip(got, ADDRESSES):
        assert [row[p] or "-" for p in PARTS] == want.split(), address


def test_parse_query(spark):
    df = spark.createDataFrame([(" 松山區三民路２９巷１號三F之３ ",), ("三民路",)], "t string")
    a, b = [r.p for r in df.select(A.parse_query("t").alias("p")).collect()]
    assert [a[p] or "-" for p in PARTS] == "- 松山區 三民路 29 - 1 3 3".split()
    assert b.street == "三民路" and b.number == ""


def test_city_of_shared_districts(spark):
    df = spark.createDataFrame(CITIES, "address string, hint string, want string")
    out = G.resolve_city(Z.add_parts(df), None, hint=F.col("hint"))
    assert [r.address for r in out.where("county_city <> want").collect()] == []


def test_gazetteer_orders_by_trades(spark):
    rows = [("台中市", "北區")] * 3 + [("台南市", "北區")] * 5 + [("新竹縣", "竹北市")]
    g = G.derive_gazetteer(spark.createDataFrame(rows, "county_city string, district string"))
    assert {r.district: r.cities for r in g.collect()} == {"北區": ["台南市", "台中市"], "竹北市": ["新竹縣"]}


def test_geocoding_forms(spark):
    cases = [
        ("null台北市大安區和平東路三段１號5樓", "臺北市大安區和平東路三段1號"),
        ("新竹市新竹市光復路1號", "新竹市光復路1號"),
        ("桃園縣中壢市環北路400號", "桃園市中壢區環北路400號"),
        ("高雄縣三民鄉民生路1號", "高雄市那瑪夏區民生路1號"),
        ("新北市新店區北新路1號地下一層", "新北市新店區北新路1號"),
        ("台北市大安區&21414;和平里3鄰和平東路1號等共用部分", "臺北市大安區和平東路1號"),
    ]
    df = spark.createDataFrame(cases, "t string, e string")
    assert [(r.t, r.v) for r in df.select("t", A.geo_normalize("t").alias("v")).collect()] == cases


def test_point_keys(spark):
    rows = [
        ("臺北市大安區和平東路三段168號", ("大安區", "和平東路三段", "168")),
        ("臺北市中正區重慶南路一段122號", ("中正區", "重慶南路一段", "122")),
        ("新北市板橋區文化路一段100巷3弄5之2號", ("板橋區", "文化路一段100巷3弄", "5之2")),
        ("臺北市大安區市民大道四段10號", ("大安區", "市民大道四段", "10")),
        ("平鎮段827地號", ("", None, None)),
    ]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string")
    assert [tuple(r.k) for r in df.select(A.point_key("a").alias("k")).collect()] == [k for _, k in rows]


def test_variants_and_shortened(spark):
    df = spark.createDataFrame([("三民路29巷5號",)], "t string")
    r = df.select(A.variants("t").alias("v"), A.shortened("t").alias("s")).first()
    assert r.v == sorted(r.v) and len(r.v) == 15
    assert {"三民路廿九巷5號", "三民路二十九巷五號", "三民路２９巷５號"} <= set(r.v)
    assert r.s == ["三民路29巷5號", "三民路29巷", "三民路29", "三民路"]


def test_floors_numbers_ranges(spark):
    df = spark.createDataFrame([("九層/十五層", "1,234", "10-20"), ("地下一層", "12.7", "-5"), ("三十一層", "x", "a-b")], "f string, n string, r string")
    got = df.select(A.floor_info("f").alias("f"), V.to_long("n").alias("n"), V.parse_range("r").alias("r")).collect()
    assert [tuple(g.f) for g in got] == [("9", "15"), ("-1", ""), ("三十一層", "")]
    assert [g.n for g in got] == [1234, 12, None]
    assert [tuple(g.r) for g in got] == [(10.0, 20.0), (None, 5.0), (None, None)]


def test_dates(spark):
    df = spark.createDataFrame([("1130101",), ("990101",), ("113/01/01",), ("12",), ("bad date",)], "t string")
    got = df.select(
        D.roc_year("t").alias("y"), D.period_label("t").alias("m"), D.period_label("t", "quarterly").alias("q"),
        D.tx_date("t").cast("string").alias("d"), D.gregorian_text("t").alias("g"),
    ).collect()
    assert [(r.y, r.m, r.q, r.d) for r in got] == [
        (113, "113/01", "113Q1", "2024-01-01"), (99, "99/01", "99Q1", "2010-01-01"),
        (113, "113/01", "113Q1", "2024-01-01"), (None, "未知", "未知", None), (None, "未知", "未知", None),
    ]
    assert got[0].g == "2024/01/01" and got[1].g is None


def test_projected_coordinates(spark):
    # The zone's central meridian is at easting 250 km; the equator at northing 0.
    lat, lng = M.tm2_to_wgs84(F.lit(250000.0), F.lit(0.0))
    r = spark.range(1).select(lat.alias("lat"), lng.alias("lng")).first()
    assert abs(r.lat) < 1e-9 and abs(r.lng - 121.0) < 1e-9


def projected(lat: float, lng: float) -> tuple[float, float]:
    """TM2 metres of a position by definition: the meridian arc, integrated over the complex latitude
    whose isometric latitude is that of the position plus i times its longitude difference."""
    f = 1 / 298.257222101
    e = (f * (2 - f)) ** 0.5
    phi = np.radians(lat)
    iso = np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)) + 1j * np.radians(lng - 121.0)
    z = phi + 0j
    for _ in range(50):
        z = np.arcsin(np.tanh(iso + e * np.arctanh(e * np.sin(z))))
    x, w = np.polynomial.legendre.leggauss(60)
    at = (x + 1) / 2 * z
    arc = 6378137.0 * (1 - e * e) * np.sum(w / 2 * z / (1 - (e * np.sin(at)) ** 2) ** 1.5)
    return 250000.0 + 0.9999 * arc.imag, 0.9999 * arc.real


def test_projected_coordinates_by_definition(spark):
    places = [(25.0339, 121.5645), (22.6, 120.3), (23.9, 121.6), (21.9, 120.8), (24.8, 120.97), (26.2, 119.9)]
    # The length of a meridian quadrant is known: 10,001,965.729 m.
    assert abs(projected(89.9999999, 121.0)[1] / 0.9999 - 10001965.729) < 2e-2
    df = spark.createDataFrame([(*p, *map(float, projected(*p))) for p in places], "lat double, lng double, e double, n double")
    lat, lng = M.tm2_to_wgs84(F.col("e"), F.col("n"))
    for r in df.select("lat", "lng", lat.alias("a"), lng.alias("b")).collect():
        assert abs(r.lat - r.a) < 1e-9 and abs(r.lng - r.b) < 1e-9


def test_sql_functions(spark):
    Z.register_sql_functions(spark)
    r = spark.sql("SELECT to_ping(33.0579D) AS p, house_number_of('29巷5號') AS n, roc_year_of('113/01/01') AS y").first()
    assert (r.p, r.n, r.y) == (10.0, 5, 113)


@pytest.mark.parametrize(("address", "want"), [
    ("臺中市北區三民路三段100號8樓", "三民路三段100號"), ("台北市大安區和平東路二段９巷１弄３之２號５樓之１", "和平東路二段9巷1弄3之2號"),
    ("新北市板橋區文化里3鄰中山路12號旁空地", "中山路12號"), ("桃園市中壢區7鄰 忠孝路 5 號 A棟", "忠孝路5號"), ("臺中市霧峰區大里路12號", "大里路12號"),
    ("宜蘭縣員山鄉中興村12號", "中興村12號"), ("台北市中山區市民大道四段50號B1", "市民大道四段50號"), ("高雄市三民區建國路八樓", "建國路"), ("", ""),
])
def test_road_and_number_by_the_grammar(spark, address, want):
    assert spark.range(1).select(A.road_and_number(F.lit(address))).first()[0] == want


@pytest.mark.parametrize(("address", "want"), [
    ("三民路1號2樓", "三民路1"), ("三民路1號2樓之3", "三民路1"), ("三民路1號地下1樓", "三民路1"), ("三民路1號", "三民路1"),
    ("三民路1號之3", "三民路1號之3"), ("三民路1之2號3F", "三民路1之2"), ("三民路", "三民路"), ("", ""),
])
def test_base_address_has_no_storey(spark, address, want):
    assert spark.range(1).select(A.strip_floor(F.lit(address))).first()[0] == want
